"""Queries of the lives of postings over all runs of their boards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import postings as P
from leadloom.functions import rules
from leadloom.functions.text import display_text
from leadloom.operators import lifecycle, runs
from leadloom.plans.analytics import RUNS, case_first, query
from leadloom.sources.tables import table

#: the references that the titles hold are &nbsp; and &amp;; SQL has no decoder for all
_TITLE = "trim(regexp_replace(nfc_normalize(replace(replace(s.title, '&nbsp;', ' '), '&amp;', '&')), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g'))"
_KEY = "partition by board_id, id order by n"
JUDGED = f"""led as ({RUNS}), dec0 as (select *, max(case when status = 'success' then run_seq end) over w as had, arg_max(jobs_found, case when status = 'success' then run_seq end) over w as jb from led window w as (partition by board_id order by run_seq rows between unbounded preceding and 1 preceding)),
    dec1 as (select *, coalesce(status = 'success' and jobs_found = 0 and jb > 0, false) as suspicious from dec0), dec as (select *, coalesce(lag(suspicious) over (partition by board_id order by run_seq), false) as prior from dec1)"""
LIVES = f"""with {JUDGED},
    counted as (select board_id, run_seq, started_at, row_number() over (partition by board_id order by run_seq) as n, count(*) over (partition by board_id) as total from dec where status = 'success' and not suspicious),
    closing as (select board_id, n, started_at as missing_since, min(n) over w as closing_n, min(started_at) over w as closing_at from counted window w as (partition by board_id order by started_at range between interval 7 days following and unbounded following)),
    copies as (select s.board_id, lower(trim(s.id)) as id, c.n, c.total, c.started_at, {_TITLE} as title, {case_first(f'lower({_TITLE})', rules.SENIORITY_KEYWORDS)} as seniority, s.location_raw, s.loaded_at from board_snapshot s join counted c using (board_id, run_seq) where s.run_status = 'success' and trim(s.id) <> ''),
    seen as (select * exclude (k) from (select *, row_number() over (partition by board_id, id, n order by loaded_at desc, title desc nulls last, seniority desc nulls last, location_raw desc nulls last) as k from copies) where k = 1),
    h as (select seen.*, missing_since, closing_n, closing_at, lag(seen.n) over w as last_n, lead(seen.n) over w as next_n, lag(title) over w as t0, lag(seniority) over w as s0, lag(location_raw) over w as l0 from seen left join closing on closing.board_id = seen.board_id and closing.n = seen.n + 1 window w as (partition by seen.board_id, id order by seen.n)),
    h2 as (select *, coalesce(closing_n >= n + 2 and (next_n is null or closing_n < next_n), false) as closed, last_n = n - 1 as near from h),
    lives as (select *, case when last_n is null then 'opened' when lag(closed) over ({_KEY}) then 'reopened' end as opens, near and (t0 is distinct from title or s0 is distinct from seniority or l0 is distinct from location_raw) as differs from h2) """


def _content() -> dict:
    title = display_text(F.col("title"))
    return {"title": title, "seniority": P.seniority_class(title), "location_raw": F.col("location_raw")}


def _seen(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    snapshots = table(spark, folder, "board_snapshot")
    counted = lifecycle.counted_runs(runs.run_ledger(snapshots))
    return lifecycle.sightings(snapshots, counted, _content()), counted


def _lives(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.history(*_seen(spark, folder))


@query(
    LIVES
    + """select board_id, id, opens as event, n::int as n, epoch_us(started_at) as occurred_micros from lives where opens is not null union all select board_id, id, 'updated', n, epoch_us(started_at) from lives where opens is null and differs
    union all select board_id, id, 'closed', closing_n, epoch_us(closing_at) from lives where closed"""
)
def lifecycle_events(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.events(_lives(spark, folder)).select("board_id", "id", "event", "n", F.unix_micros("occurred_at").alias("occurred_micros"))


@query(
    LIVES
    + """select board_id, id, n, 'title' as field, t0 as old, title as new from lives where near and t0 is distinct from title union all select board_id, id, n, 'seniority', s0, seniority from lives where near and s0 is distinct from seniority
    union all select board_id, id, n, 'location_raw', l0, location_raw from lives where near and l0 is distinct from location_raw"""
)
def material_changes(spark: SparkSession, folder: str) -> DataFrame:
    return lifecycle.material_changes(_lives(spark, folder))


@query(
    LIVES
    + """, last_ as (select *, last_value(case when opens is not null then started_at end ignore nulls) over (partition by board_id, id order by n rows between unbounded preceding and current row) as first_seen from lives)
    select board_id, id, case when closed then 'closed' when n = total then 'open' else 'missing' end as status, (case when closed then closing_n else total end - n)::int as consecutive_absences, epoch_us(first_seen) as first_seen_micros,
    case when n = total then coalesce(opens, case when differs then 'updated' end) when closed and closing_n = total then 'closed' end as event, title from last_ where next_n is null"""
)
def lifecycle_diff(spark: SparkSession, folder: str) -> DataFrame:
    """The last counted run of each board merged into the state before it; the SQL has the state of the whole history."""
    seen, counted = _seen(spark, folder)
    earlier = F.col("n") < F.col("total")
    past_runs = counted.filter(earlier).select("board_id", "n", "started_at", *[F.when(F.col("closing_n") < F.col("total"), F.col(c)).alias(c) for c in ("closing_n", "closing_at")])
    before = lifecycle.state(lifecycle.history(seen.filter(earlier).withColumn("total", F.col("total") - 1), past_runs))
    observed = seen.filter(~earlier).select("board_id", "id", *lifecycle.MATERIAL)
    now = counted.filter(~earlier).select("board_id", F.col("started_at").alias("observed_at"), F.lit(False).alias("held"))
    return lifecycle.merge_run(before, observed, now).select("board_id", "id", "status", "consecutive_absences", F.unix_micros("first_seen_at").alias("first_seen_micros"), "event", "title")


@query(LIVES + "select board_id, count(*) filter (not closed) as open_before, count(*) filter (n = total) as open_now from lives where next_n is null group by board_id")
def open_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Per board the postings that are not closed, and those seen in the last counted run."""
    state = lifecycle.state(_lives(spark, folder))
    return state.groupBy("board_id").agg(F.count_if(F.col("status") != "closed").alias("open_before"), F.count_if(F.col("status") == "open").alias("open_now"))


@query(f"with {JUDGED} select board_id, run_seq, case when suspicious then 'hold' when prior then 'emptied' else 'accept' end as decision from dec where status = 'success' and jobs_found = 0")
def zero_jobs_decision(spark: SparkSession, folder: str) -> DataFrame:
    return runs.zero_jobs_decisions(runs.run_ledger(table(spark, folder, "board_snapshot")))


@query(f"with {JUDGED} select company_id, board_id, run_seq, prior as previous_suspicious from dec")
def previous_suspicious(spark: SparkSession, folder: str) -> DataFrame:
    return runs.judged_runs(runs.run_ledger(table(spark, folder, "board_snapshot"))).select("company_id", "board_id", "run_seq", F.col("prior_suspicious").alias("previous_suspicious"))
