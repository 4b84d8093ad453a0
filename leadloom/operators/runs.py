"""Metrics over scrape runs and over matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators.tables import rate


def run_ledger(snapshots: DataFrame) -> DataFrame:
    """One row per run of a board: company_id, board_id, run_id, run_seq,
    source_platform, started_at, status, jobs_found (distinct ids, trimmed and
    lower case)."""
    ids = F.countDistinct(F.lower(F.trim("id")))
    return snapshots.groupBy("company_id", "board_id", "run_id", "run_seq", "source_platform").agg(F.min("run_at").alias("started_at"), F.min("run_status").alias("status"), ids.alias("jobs_found"))


def latest_run(runs: DataFrame) -> DataFrame:
    """The last run of each company; of runs begun together the one with the least run_id."""
    least_last = F.concat(F.transform(F.split("run_id", ""), lambda c: -F.ascii(c)), F.array(F.lit(1)))  # a smaller run_id is a greater list
    rest = F.struct(*[F.col(c) for c in runs.columns if c != "company_id"])
    best = runs.groupBy("company_id").agg(F.max_by(rest, F.struct("started_at", least_last)).alias("_run"))
    return best.select("company_id", "_run.*")


def coverage(runs: DataFrame) -> DataFrame:
    """One row over the closed runs (with a status): attempted, successful,
    success_rate, degraded, degraded_rate (over the successful); over the last run of each
    company companies, resolved (a careers page is known), resolution_rate,
    with_board (a platform of its own, over the resolved), board_coverage,
    unscraped (without success), empty (successful without jobs). Rates of nothing are null."""
    closed = runs.filter(F.col("status").isNotNull())
    ok = F.col("status") == "success"
    over_runs = closed.agg(F.count("*").alias("attempted"), F.count_if(ok).alias("successful"), rate(F.count_if(ok), F.count("*")).alias("success_rate"), F.count_if(F.col("status") == "parse_degraded").alias("degraded"), rate(F.count_if(F.col("status") == "parse_degraded"), F.count_if(ok)).alias("degraded_rate"))
    known = ~F.col("status").isin(*rules.UNRESOLVED)
    board = known & F.col("source_platform").isin(*rules.ROUTABLE)
    last = latest_run(closed).agg(
        F.count("*").alias("companies"), F.count_if(known).alias("resolved"), rate(F.count_if(known), F.count("*")).alias("resolution_rate"), F.count_if(board).alias("with_board"), rate(F.count_if(board), F.count_if(known)).alias("board_coverage"),
        F.count_if(~ok).alias("unscraped"), F.count_if(ok & (F.col("jobs_found") == 0)).alias("empty"),
    )
    both = over_runs.unionByName(last, allowMissingColumns=True)  # one row each
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def status_frequency(runs: DataFrame, status: str = "ats_unknown") -> DataFrame:
    """source_platform, runs: how often runs of a platform end so; runs without a platform are left out."""
    named = runs.filter((F.col("status") == status) & (F.coalesce("source_platform", F.lit("")) != ""))
    return named.groupBy("source_platform").agg(F.count("*").alias("runs"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("source_platform", "status").agg(F.count("*").alias("runs"))


def judged_runs(runs: DataFrame) -> DataFrame:
    """Each run with first_success (no successful run before it), suspicious
    (successful, without jobs, after a successful run with jobs) and
    prior_suspicious (of the run before it)."""
    by_board = Window.partitionBy("board_id").orderBy("run_seq")
    before = by_board.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("status") == "success"
    had = F.max(F.when(ok, F.col("run_seq"))).over(before)
    jobs_before = F.max_by("jobs_found", F.when(ok, F.col("run_seq"))).over(before)
    judged = runs.select("*", (ok & had.isNull()).alias("first_success"), F.coalesce(ok & (F.col("jobs_found") == 0) & (jobs_before > 0), F.lit(False)).alias("suspicious"))
    return judged.withColumn("prior_suspicious", F.coalesce(F.lag("suspicious").over(by_board), F.lit(False)))


def run_decisions(runs: DataFrame) -> DataFrame:
    """board_id, run_seq, first_success, suspicious of each run."""
    return judged_runs(runs).select("board_id", "run_seq", "first_success", "suspicious")


def zero_jobs_decisions(runs: DataFrame) -> DataFrame:
    """board_id, run_seq, decision of the successful runs without jobs: hold (suspicious), emptied (the run before was held), accept."""
    empty = judged_runs(runs).filter((F.col("status") == "success") & (F.col("jobs_found") == 0))
    return empty.select("board_id", "run_seq", F.when(F.col("suspicious"), "hold").when(F.col("prior_suspicious"), "emptied").otherwise("accept").alias("decision"))


def drift_reasons(runs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """board_id, run_seq, reasons of runs that differ from the platform expected of
    the company (company_id, expected_platform): platform_unexpected; or from the
    run before: platform_changed, became_unhealthy, emptied."""
    if expected is None:
        runs = runs.withColumn("expected_platform", F.lit(None).cast("string"))
    else:
        runs = runs.join(expected.select("company_id", "expected_platform"), "company_id", "left")
    by_board = Window.partitionBy("board_id").orderBy("run_seq")
    was = {c: F.lag(c).over(by_board) for c in ("source_platform", "status", "jobs_found")}
    marked = runs.select("board_id", "run_seq", "source_platform", "expected_platform", "status", "jobs_found", *[c.alias(f"was_{n}") for n, c in was.items()])
    reasons = F.array_compact(
        F.array(
            F.when(F.col("expected_platform") != F.col("source_platform"), "platform_unexpected"),
            F.when(F.col("was_source_platform") != F.col("source_platform"), "platform_changed"),
            F.when((F.col("was_status") == "success") & (F.col("status") != "success"), "became_unhealthy"),
            F.when((F.col("status") == "success") & (F.col("jobs_found") == 0) & (F.col("was_jobs_found") > 0), "emptied"),
        )
    )
    return marked.select("board_id", "run_seq", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


def matching_metrics(jobs: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: jobs, matched, match_rate, founder_share is left to the caller's columns."""
    matched = matches.select("job_id").distinct().withColumn("_m", F.lit(1))
    return jobs.select("job_id").distinct().join(matched, "job_id", "left").agg(F.count("*").alias("jobs"), F.count("_m").alias("matched"), rate(F.count("_m"), F.count("*")).alias("match_rate"))


def unmatched_jobs(jobs: DataFrame, matches: DataFrame, leads: DataFrame) -> DataFrame:
    """job_id, function, reason of jobs without a match: no_leads (the company has none) or no_plausible_owner."""
    companies = leads.select("company_id").distinct().withColumn("_has", F.lit(True))
    left = jobs.join(matches.select("job_id").distinct(), "job_id", "left_anti").join(companies, "company_id", "left")
    return left.select("job_id", F.coalesce("function", F.lit("unknown")).alias("function"), F.when(F.col("_has"), "no_plausible_owner").otherwise("no_leads").alias("reason"))


def missing_functions(jobs: DataFrame, leads: DataFrame) -> DataFrame:
    """company_id, missing: functions with open jobs but no lead, sorted, of companies that have any."""
    wanted = jobs.groupBy("company_id").agg(F.collect_set("function").alias("wanted"))
    known = leads.groupBy("company_id").agg(F.collect_set("function").alias("known"))
    gaps = wanted.join(known, "company_id", "left").select("company_id", F.array_sort(F.array_except("wanted", F.coalesce("known", F.array().cast("array<string>")))).alias("gaps"))
    return gaps.filter(F.size("gaps") > 0).select("company_id", F.array_join("gaps", ",").alias("missing"))
