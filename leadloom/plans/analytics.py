"""Queries of the operators over postings, people, runs and pages, each with
the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import postings as P
from leadloom.functions import rules
from leadloom.operators import boards, matching, runs, web
from leadloom.operators.tables import first_with_word, keyed_scan, last_known, latest_per_key, top_rows, without
from leadloom.sources.files import csv_rows
from leadloom.sources.tables import table
from leadloom.streaming.changes import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def contains_any(text: str, words) -> str:
    return "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"


def case_first(text: str, groups) -> str:
    return "case " + " ".join(f"when {contains_any(text, words)} then '{name}'" for name, words in groups) + " end"


# --- records and keys -------------------------------------------------------

LATEST_LEADS = "select * exclude (n) from (select *, row_number() over (partition by lead_id order by ingest_seq desc) n from lead_record where lead_id is not null) where n = 1"


def _latest_leads(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_key(table(spark, folder, "lead_record"), ["lead_id"], "ingest_seq")


@query(f"select lead_id, ingest_seq, source, title_raw, email, confidence from ({LATEST_LEADS})")
def latest_record_per_key(spark: SparkSession, folder: str) -> DataFrame:
    return _latest_leads(spark, folder).select("lead_id", "ingest_seq", "source", "title_raw", "email", "confidence")


@query("select ingest_seq, lead_id, full_name from lead_record where company_id = 'co-00001' and source = 'pdl'")
def filtered_scan(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_scan(table(spark, folder, "lead_record"), company_id="co-00001", source="pdl", lead_id=None).select("ingest_seq", "lead_id", "full_name")


@query("select gtm_id from gtm_lead where lower(trim(company.domain)) not in (select lower(trim(domain)) from company where not is_active and domain is not null) or company.domain is null")
def denylist_anti(spark: SparkSession, folder: str) -> DataFrame:
    denied = table(spark, folder, "company").filter("not is_active")
    return without(table(spark, folder, "gtm_lead"), F.lower(F.trim("company.domain")), denied, F.lower(F.trim("domain"))).select("gtm_id")


@query(
    """with k as (select gtm_id, coalesce('email:' || nullif(lower(trim(lead.email)), ''), 'name:' || lower(trim(lead.name)) || '@' || lower(trim(company.domain))) key from gtm_lead),
    s as (select distinct 'email:' || lower(trim(email)) key from lead_record where enrichment_status = 'enrichment_identity_weak' and email is not null and trim(email) <> '')
    select gtm_id, key as contact_key from k where key is null or key not in (select key from s)"""
)
def suppression_anti(spark: SparkSession, folder: str) -> DataFrame:
    weak = table(spark, folder, "lead_record").filter("enrichment_status = 'enrichment_identity_weak' and email is not null and trim(email) <> ''")
    leads = table(spark, folder, "gtm_lead").withColumn("contact_key", P.contact_key(F.col("lead.email"), F.col("lead.name"), F.col("company.domain")))
    return without(leads, F.col("contact_key"), weak, F.concat(F.lit("email:"), F.lower(F.trim("email")))).select("gtm_id", "contact_key")


@query("select source, count(*) as lead_rows, count(distinct lead_id) as leads, count(email) as emails, avg(confidence) as mean_confidence from lead_record group by source")
def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lead_record").groupBy("source").agg(F.count("*").alias("lead_rows"), F.countDistinct("lead_id").alias("leads"), F.count("email").alias("emails"), F.avg("confidence").alias("mean_confidence"))


@query(
    """select company_id, gtm_id, relevance_score, place from (select c.id as company_id, gtm_id, relevance_score, row_number() over (partition by c.id order by relevance_score desc, gtm_id) place
    from gtm_lead g join company c on g.company.domain = c.domain) where place <= 5"""
)
def top_leads_per_company(spark: SparkSession, folder: str) -> DataFrame:
    companies = table(spark, folder, "company").select(F.col("id").alias("company_id"), "domain")
    leads = table(spark, folder, "gtm_lead").select("gtm_id", "relevance_score", F.col("company.domain").alias("domain"))
    return top_rows(leads.join(companies, "domain"), ["company_id"], [F.desc("relevance_score"), F.col("gtm_id")], 5).select("company_id", "gtm_id", "relevance_score", "place")


_TEXTS = [("company", c) for c in ("name", "domain", "stage", "headcount")] + [("job", c) for c in ("title", "function", "seniority", "location", "posting_url")] + [("lead", c) for c in ("name", "title", "linkedin_url", "email", "phone", "contactability")]


@query(
    f"""select gtm_id, {", ".join(f"coalesce(cast({s}.{c} as varchar), '') as {s}_{c}" for s, c in _TEXTS)}, coalesce(printf('%.3f', relevance_score), '') as relevance_score, coalesce(printf('%.3f', confidence_score), '') as confidence_score,
    coalesce(rationale, '') as rationale, coalesce(cast(rank as varchar), '') as rank, coalesce(strftime(make_timestamp(epoch_us(generated_at)), '%Y-%m-%dT%H:%M:%SZ'), '') as generated_at from gtm_lead"""
)
def csv_export(spark: SparkSession, folder: str) -> DataFrame:
    return csv_rows(table(spark, folder, "gtm_lead"))


@query(
    """select lead_id, arg_max(email, ingest_seq) filter (email is not null) as email, arg_max(phone, ingest_seq) filter (phone is not null) as phone, arg_max(linkedin_url, ingest_seq) filter (linkedin_url is not null) as linkedin_url,
    arg_max(location_raw, ingest_seq) filter (location_raw is not null) as location_raw from lead_record where lead_id is not null group by 1"""
)
def last_known_fields(spark: SparkSession, folder: str) -> DataFrame:
    return last_known(table(spark, folder, "lead_record"), ["lead_id"], "ingest_seq", ["email", "phone", "linkedin_url", "location_raw"])


@query(
    """select company_id, doc_id, holds from (select company_id, doc_id, coalesce(contains(lower(text), 'hiring'), false) as holds, row_number() over (partition by company_id order by not coalesce(contains(lower(text), 'hiring'), false), doc_id) k
    from documents where doc_kind = 'context' and company_id is not null) where k = 1"""
)
def context_signals(spark: SparkSession, folder: str) -> DataFrame:
    context = table(spark, folder, "documents").filter("doc_kind = 'context' and company_id is not null").select("company_id", "doc_id", "text")
    return first_with_word(context, ["company_id"], "text", "hiring", "doc_id")


# --- normalisation ----------------------------------------------------------


@query(f"select raw_id, {case_first('lower(title)', rules.SENIORITY_KEYWORDS)} as seniority, {case_first("(lower(title) || ' ')", rules.FUNCTION_KEYWORDS)} as function from raw_posting where title is not null")
def title_classes(spark: SparkSession, folder: str) -> DataFrame:
    title = F.col("title")
    return table(spark, folder, "raw_posting").filter("title is not null").select("raw_id", P.seniority_class(title).alias("seniority"), P.function_class(title, F.lit(None).cast("string")).alias("function"))


_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical_sql(raw: str) -> str:
    text = f"regexp_replace({raw}, '{P.EMOJI}', '', 'g')"
    for pattern in (P.PLACE_IN_PARENTHESES, P.REQUISITION):
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    text = f"trim(regexp_replace({text}, '{_WS}', ' ', 'g'))"
    text = f"regexp_replace(regexp_replace({text}, '\\s*/\\s*', ' / ', 'g'), '\\s*,\\s*', ', ', 'g')"
    for short, full in P.ABBREVIATIONS:
        text = f"regexp_replace({text}, '(?i)\\b{short}\\b\\.?', '{full}', 'g')"
    return text


@query(
    f"""with t as (select raw_id, {canonical_sql('title')} as t from raw_posting)
    select raw_id, trim(case when t <> '' and (t = lower(t) or t = upper(t)) then array_to_string(list_transform(regexp_extract_all(lower(t), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: upper(x[1:1]) || x[2:]), '') else t end) as title from t"""
)
def canonical_title(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_posting").select("raw_id", P.canonical_title(F.col("title")).alias("title"))


@query(f"select raw_id, case lower(trim(workplace_type)) {' '.join(f'''when '{k}' then '{v}' ''' for k, v in rules.WORKPLACE_TYPES.items())} end as workplace from raw_posting")
def workplace_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "raw_posting").select("raw_id", P.workplace_type(F.col("workplace_type")).alias("workplace"))


@query(
    """select raw_id, case when trim(coalesce(source_job_id, '')) <> '' then company_id || ':' || source_platform || ':' || trim(source_job_id)
    else company_id || ':hash:' || substr(sha256(company_id || '|' || coalesce(title, '') || '|'), 1, 16) end as job_id from raw_posting"""
)
def job_id_ladder(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, folder, "raw_posting").select("raw_id", P.job_key(F.col("company_id"), F.col("source_platform"), F.col("source_job_id"), none, F.col("title"), none).alias("job_id"))


@query(
    """select ingest_seq, list_aggregate(list_transform(list_filter(list_transform(regexp_split_to_array(location_raw, '\\s*[/;]\\s*'), lambda x: trim(x)), lambda x: x <> ''), lambda x: x), 'string_agg', '|') as places
    from lead_record where location_raw is not null and trim(location_raw) <> ''"""
)
def location_places(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lead_record").filter("location_raw is not null and trim(location_raw) <> ''")
    return rows.select("ingest_seq", F.array_join(F.transform(P.places(F.col("location_raw")), lambda p: p["place"]), "|").alias("places"))


@query(
    """select t.title, r.ref_id from (select distinct trim(title) as title from raw_posting where title is not null) t left join (select min(ref_id) as ref_id, lower(label) as l from canon_ref where kind = 'title' group by lower(label)) r on lower(t.title) = r.l"""
)
def title_cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "raw_posting").select(F.trim("title").alias("title")).filter("title is not null").distinct()
    known = table(spark, folder, "canon_ref").filter("kind = 'title'").groupBy(F.lower("label").alias("l")).agg(F.min("ref_id").alias("ref_id"))
    return titles.join(known, F.lower("title") == F.col("l"), "left").select("title", "ref_id")


@query(
    """with t as (select ingest_seq, list_distinct(list_filter(regexp_extract_all(lower(title_raw), '[a-z]+'), lambda x: length(x) > 1 and x not in ('of', 'the', 'and'))) a,
    list_distinct(list_filter(regexp_extract_all(lower(title_canonical), '[a-z]+'), lambda x: length(x) > 1 and x not in ('of', 'the', 'and'))) b from lead_record where title_raw is not null)
    select ingest_seq, list_has_any(a, b) as overlaps from t"""
)
def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    def words(column: str):
        return F.array_except(F.filter(F.regexp_extract_all(F.lower(column), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) > 1), F.array(*[F.lit(w) for w in ("of", "the", "and")]))

    return table(spark, folder, "lead_record").filter("title_raw is not null").select("ingest_seq", F.arrays_overlap(words("title_raw"), words("title_canonical")).alias("overlaps"))


# --- runs -------------------------------------------------------------------

RUNS = "select company_id, board_id, run_id, run_seq, source_platform, min(run_at) as started_at, min(run_status) as status, count(distinct lower(trim(id))) as jobs_found from board_snapshot group by all"
LAST_RUNS = f"select * exclude (k) from (select *, row_number() over (partition by company_id order by started_at desc, run_id) k from ({RUNS})) where k = 1"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_ledger(table(spark, folder, "board_snapshot"))


@query(f"select company_id, run_id, status, jobs_found from ({LAST_RUNS})")
def latest_run_per_company(spark: SparkSession, folder: str) -> DataFrame:
    return runs.latest_run(_runs(spark, folder)).select("company_id", "run_id", "status", "jobs_found")


_KNOWN, _BOARD = f"status not in ({sql_list(rules.UNRESOLVED)})", f"status not in ({sql_list(rules.UNRESOLVED)}) and source_platform in ({sql_list(rules.ROUTABLE)})"


@query(
    f"""select * from (select count(*) as attempted, count(*) filter (status = 'success') as successful, count(*) filter (status = 'success') / count(*) as success_rate, count(*) filter (status = 'parse_degraded') as degraded, count(*) filter (status = 'parse_degraded') / nullif(count(*) filter (status = 'success'), 0) as degraded_rate from ({RUNS}) where status is not null),
    (select count(*) as companies, count(*) filter ({_KNOWN}) as resolved, count(*) filter ({_KNOWN}) / count(*) as resolution_rate, count(*) filter ({_BOARD}) as with_board, count(*) filter ({_BOARD}) / nullif(count(*) filter ({_KNOWN}), 0) as board_coverage,
    count(*) filter (status <> 'success') as unscraped, count(*) filter (status = 'success' and jobs_found = 0) as empty from ({LAST_RUNS}))"""
)
def coverage_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return runs.coverage(_runs(spark, folder))


@query(f"select source_platform, count(*) as runs from ({RUNS}) where status = 'rate_limited' and source_platform <> '' group by 1")
def status_by_platform(spark: SparkSession, folder: str) -> DataFrame:
    """One status by platform; no run of the tables has the status of unknown boards."""
    return runs.status_frequency(_runs(spark, folder), "rate_limited")


@query(f"select source_platform, status, count(*) as runs from ({RUNS}) group by all")
def run_status_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return runs.status_counts(_runs(spark, folder))


_STAGES = {"success": "extracted", "rate_limited": "retry", "schema_violation": "review", "blocked_403": "blocked"}


@query(f"select board_id, run_seq, case status {' '.join(f"when '{k}' then '{v}'" for k, v in list(_STAGES.items())[:3])} else 'unknown' end as stage from ({RUNS})")
def status_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """Statuses to stages; those the table does not hold are unknown."""
    known = F.create_map(*[F.lit(x) for kv in list(_STAGES.items())[:3] for x in kv])
    return _runs(spark, folder).select("board_id", "run_seq", F.coalesce(F.try_element_at(known, F.col("status")), F.lit("unknown")).alias("stage"))


@query(
    f"""with r as (select *, max(case when status = 'success' then run_seq end) over w as had, arg_max(jobs_found, case when status = 'success' then run_seq end) over w as before from ({RUNS})
    window w as (partition by board_id order by run_seq rows between unbounded preceding and 1 preceding))
    select board_id, run_seq, status = 'success' and had is null as first_success, coalesce(status = 'success' and jobs_found = 0 and before > 0, false) as suspicious from r"""
)
def run_decisions(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_decisions(_runs(spark, folder))


@query(
    f"""with r as (select *, lag(source_platform) over w as p, lag(status) over w as s, lag(jobs_found) over w as j from ({RUNS}) window w as (partition by board_id order by run_seq)),
    e as (select company_id, min(source_platform) as expected from board_snapshot group by 1),
    x as (select board_id, run_seq, concat_ws(',', case when expected <> source_platform then 'platform_unexpected' end, case when p <> source_platform then 'platform_changed' end, case when s = 'success' and status <> 'success' then 'became_unhealthy' end,
    case when status = 'success' and jobs_found = 0 and j > 0 then 'emptied' end) as reasons from r join e using (company_id)) select * from x where reasons <> ''"""
)
def drift_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """The platform expected of a company is the first by name of its boards."""
    ledger = _runs(spark, folder)
    return runs.drift_reasons(ledger, ledger.groupBy("company_id").agg(F.min("source_platform").alias("expected_platform")))


# --- matching ---------------------------------------------------------------

_TIERS = rules.TIERS
_STAGE = "lower(trim(replace(funding_stage, '_', ' ')))"


def tier_sql(part: int) -> str:
    by_size = " ".join(f"when headcount < {t[0]} then {t[part]}::double" for t in _TIERS[:3])
    by_stage = " ".join(f"when {_STAGE} = '{s}' then {_TIERS[i][part]}::double" for s, i in rules.STAGE_TIER.items())
    return f"case when headcount is not null then case {by_size} else {_TIERS[3][part]}::double end else case {by_stage} else {_TIERS[1][part]}::double end end"


@query(f"select id, {tier_sql(1)} as founder_bonus, {tier_sql(2)} as penalty, headcount is null as guessed from company")
def headcount_tier(spark: SparkSession, folder: str) -> DataFrame:
    tier = matching.size_tier(F.col("headcount"), F.col("funding_stage"))
    return table(spark, folder, "company").select("id", tier["founder_bonus"].alias("founder_bonus"), tier["penalty"].alias("penalty"), tier["guessed"].alias("guessed"))


def _rank_sql(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{k}' then {v}" for k, v in rules.SENIORITY_RANK.items()) + " end"


def function_sql(job: str, lead: str, founder: str, recruiter: str) -> str:
    near = " or ".join(f"({job} = '{a}' and {lead} = '{b}') or ({job} = '{b}' and {lead} = '{a}')" for a, b in rules.ADJACENT_FUNCTIONS)
    return f"case when {job} = {lead} then 1.0::double when {founder} then 0.8::double when {recruiter} then 0.7::double when {near} then 0.5::double else 0.0::double end"


def seniority_sql(job: str, lead: str, penalty: str) -> str:
    above = f"({_rank_sql(lead)} - {_rank_sql(job)})"
    base = f"case when {above} is null then 0.3::double when {above} < 0 then 0.0::double " + " ".join(f"when {above} = {d} then {s}::double" for d, s in rules.SENIORITY_BASE.items()) + " else 0.3::double end"
    return f"(1.0::double - (1.0::double - {base}) * {penalty})"


@query(
    f"""select case_id, {function_sql('job.function', 'lead.function', 'lead.is_founder', 'lead.is_recruiter')} as function_score,
    round({seniority_sql('job.seniority', 'lead.seniority', tier_sql(2).replace(_STAGE, "null::varchar"))}, 9) as seniority_score from golden_case"""
)
def match_signals(spark: SparkSession, folder: str) -> DataFrame:
    penalty = matching.size_tier(F.col("headcount"), F.lit(None).cast("string"))["penalty"]
    return table(spark, folder, "golden_case").select(
        "case_id",
        matching.function_score(F.col("job.function"), F.col("lead.function"), F.col("lead.is_founder"), F.col("lead.is_recruiter")).alias("function_score"),
        F.round(matching.seniority_score(F.col("job.seniority"), F.col("lead.seniority"), penalty), 9).alias("seniority_score"),
    )


def matches_of(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    companies = table(spark, folder, "company")
    known = companies.select(F.col("id").alias("company_id"), "domain")
    jobs = table(spark, folder, "gtm_lead").select(F.col("gtm_id").alias("job_id"), F.col("company.domain").alias("domain"), "job.function", "job.seniority", F.col("job.location").alias("location_raw"))
    jobs = jobs.join(known, "domain").drop("domain")
    leads = _latest_leads(spark, folder)
    return jobs, leads, matching.match_top_k(jobs, leads, companies)


_OWNS = "(" + " or ".join(f"(jf = '{f}' and lower(trim(title_raw)) in ({sql_list(t.lower() for t in titles)}))" for f, titles in rules.OWNER_TITLES.items()) + ")"
_W = rules.WEIGHTS
MATCHES = f"""with j as (select gtm_id as job_id, c.id as company_id, job.function jf, job.seniority js, lower(job.location) jl, {tier_sql(1)} as bonus, {tier_sql(2)} as penalty from gtm_lead g join company c on g.company.domain = c.domain),
    l as ({LATEST_LEADS}),
    s as (select company_id, job_id, lead_id, greatest(0.0::double, least(1.0::double, {_W['function']}::double * {function_sql('jf', 'l.function', 'is_founder', 'is_recruiter')} + {_W['seniority']}::double * {seniority_sql('js', 'l.seniority', 'penalty')}
    + {_W['ownership']}::double * case when {_OWNS} then 0.8::double else 0.0::double end + {_W['location']}::double * case when jl <> '' and contains(lower(location_raw), jl) then 0.3::double else 0.0::double end
    + case when is_founder then bonus else 0.0::double end + case when is_recruiter then {_W['recruiter']}::double else 0.0::double end + case when coalesce(tenure_months, 99) < 3 then {_W['short_tenure']}::double else 0.0::double end)) as score from j join l using (company_id)),
    m as (select *, row_number() over (partition by job_id order by score desc, lead_id) place from s where score >= 0.3::double), top3 as (select * from m where place <= 3) """


@query(MATCHES + "select company_id, job_id, lead_id, round(score, 9) as score, place from top3")
def match_topk(spark: SparkSession, folder: str) -> DataFrame:
    return matches_of(spark, folder)[2].withColumn("score", F.round("score", 9))


@query(MATCHES + ", no as (select j.job_id, coalesce(jf, 'unknown') as function, case when exists (select 1 from l where l.company_id = j.company_id) then 'no_plausible_owner' else 'no_leads' end as reason from j where job_id not in (select job_id from top3)) select * from no")
def unmatched_jobs(spark: SparkSession, folder: str) -> DataFrame:
    jobs, leads, matches = matches_of(spark, folder)
    return runs.unmatched_jobs(jobs, matches, leads)


@query(MATCHES + "select count(*) as jobs, count(t.job_id) as matched, count(t.job_id) / count(*) as match_rate from (select distinct job_id from j) x left join (select distinct job_id from top3) t using (job_id)")
def matching_metrics(spark: SparkSession, folder: str) -> DataFrame:
    jobs, _, matches = matches_of(spark, folder)
    return runs.matching_metrics(jobs, matches)


@query(MATCHES + "select a.job_id, a.lead_id as first_lead, b.lead_id as second_lead, round(a.score - b.score, 9) as gap from top3 a join top3 b on a.job_id = b.job_id and a.place = 1 and b.place = 2 where a.score - b.score < 0.05::double")
def tie_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return matching.near_ties(matches_of(spark, folder)[2]).withColumn("gap", F.round("gap", 9))


@query(MATCHES + ", p as (select job_id from top3 where place = 2 and ends_with(lead_id, '7')) select job_id, lead_id, case when job_id in (select job_id from p) and place = 1 then 2 when job_id in (select job_id from p) and place = 2 then 1 else place end as place from top3")
def tie_break_swap(spark: SparkSession, folder: str) -> DataFrame:
    matches = matches_of(spark, folder)[2]
    preferred = matches.filter("place = 2 and endswith(lead_id, '7')").select("job_id", "lead_id")
    return matching.swap_first_two(matches, preferred).select("job_id", "lead_id", "place")


@query(MATCHES + "select l.source, count(*) as first_matches, count(*) filter (l.is_founder) / count(*) as founder_share from top3 t join l using (lead_id) where place = 1 group by l.source")
def founder_share(spark: SparkSession, folder: str) -> DataFrame:
    _, leads, matches = matches_of(spark, folder)
    first = matches.filter("place = 1").join(leads.select("lead_id", "source", "is_founder"), "lead_id")
    return first.groupBy("source").agg(F.count("*").alias("first_matches"), (F.count_if("is_founder") / F.count("*")).alias("founder_share"))


@query(
    f"""with j as (select c.id as company_id, list(distinct job.function) w from gtm_lead g join company c on g.company.domain = c.domain group by 1), k as (select company_id, list(distinct function) filter (function is not null) k from ({LATEST_LEADS}) group by 1),
    d as (select company_id, list_sort(list_filter(w, lambda x: x is not null and not list_contains(coalesce(k, []), x))) g from j left join k using (company_id)) select company_id, array_to_string(g, ',') as missing from d where len(g) > 0"""
)
def lead_cache_refresh(spark: SparkSession, folder: str) -> DataFrame:
    companies = table(spark, folder, "company").select(F.col("id").alias("company_id"), "domain")
    jobs = table(spark, folder, "gtm_lead").select(F.col("company.domain").alias("domain"), "job.function").join(companies, "domain")
    return runs.missing_functions(jobs, _latest_leads(spark, folder))


@query("select gtm_id, contains(lower(rationale), lower(lead.title)) as names_title, contains(lower(rationale), lower(job.function)) as names_function from gtm_lead")
def grounding_check(spark: SparkSession, folder: str) -> DataFrame:
    text = F.lower("rationale")
    return table(spark, folder, "gtm_lead").select("gtm_id", text.contains(F.lower("lead.title")).alias("names_title"), text.contains(F.lower("job.function")).alias("names_function"))


# --- pages ------------------------------------------------------------------


@query(
    """select page_id, case when status_code = 304 then 'not_modified' when status_code = 404 then 'board_not_found' when status_code in (401, 403) then 'blocked_403' when status_code >= 400 or status_code is null then 'schema_violation'
    when payload is null or not regexp_matches(payload, '^[\\s\\x{FEFF}]*[\\[{"]') then 'schema_violation' else 'success' end as status from board_page"""
)
def page_status(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "board_page").select("page_id", boards.page_status(F.col("status_code"), F.col("payload")).alias("status"))


@query(
    """with s as (select company_id, run_id, page_no, case when status_code = 304 then 'not_modified' when status_code = 404 then 'board_not_found' when status_code in (401, 403) then 'blocked_403' when status_code >= 400 or status_code is null then 'schema_violation'
    when payload is null or not regexp_matches(payload, '^[\\s\\x{FEFF}]*[\\[{"]') then 'schema_violation' else 'success' end as status from board_page)
    select company_id, run_id, coalesce(min({'p': page_no, 's': status}) filter (status not in ('success', 'not_modified')).s, 'success') as status, count(*) as pages from s group by 1, 2"""
)
def complete_sweeps(spark: SparkSession, folder: str) -> DataFrame:
    return boards.complete_sweeps(table(spark, folder, "board_page"))


@query(
    "select lead_id, case "
    + " ".join(f"when h = '{host}' or ends_with(h, '.{host}') then '{name}'" for name, host in rules.HOSTS)
    + f""" end as platform from (select lead_id, lower(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) as h from (select lead_id, case ingest_seq % {len(rules.HOSTS) + 1} {' '.join(f"when {i} then 'https://' || case when ingest_seq % 2 = 0 then 'Sub.' else '' end || '{host.upper()}:443/x'" for i, (_, host) in enumerate(rules.HOSTS))} else 'https://notjobs.lever.com/' end as u from ({LATEST_LEADS})))"""
)
def host_platform(spark: SparkSession, folder: str) -> DataFrame:
    """Every known host, as it is and as a subdomain, and an unknown one, dealt to the leads."""
    case = F.col("ingest_seq") % (len(rules.HOSTS) + 1)
    url = F.lit("https://notjobs.lever.com/")
    for i, (_, host) in enumerate(rules.HOSTS):
        url = F.when(case == i, F.concat(F.lit("https://"), F.when(F.col("ingest_seq") % 2 == 0, "Sub.").otherwise(""), F.lit(f"{host.upper()}:443/x"))).otherwise(url)
    return _latest_leads(spark, folder).select("lead_id", web.platform_of_host(web.host_of(url)).alias("platform"))


_PERSONAS = {f: ",".join(sorted({*titles, *rules.FOUNDER_TITLES, *rules.RECRUITING_TITLES})) for f, titles in rules.OWNER_TITLES.items()}


@query(
    f"""with t(function, titles) as (values {', '.join(f"('{f}', '{t}')" for f, t in _PERSONAS.items())})
    select company.domain as domain, count(distinct title) as personas from gtm_lead join t on job.function = t.function, unnest(string_split(titles, ',')) u(title) group by 1"""
)
def personas_for_company(spark: SparkSession, folder: str) -> DataFrame:
    titles = F.split(F.create_map(*[F.lit(x) for kv in _PERSONAS.items() for x in kv])[F.col("function")], ",")
    wanted = table(spark, folder, "gtm_lead").select(F.col("company.domain").alias("domain"), "job.function").filter(F.col("function").isin(*_PERSONAS)).distinct()
    return wanted.select("domain", F.explode(titles).alias("title")).groupBy("domain").agg(F.countDistinct("title").alias("personas"))


# --- events -----------------------------------------------------------------


@query("select epoch_us(time_bucket(interval '1 hour', ts)) as window_micros, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_events(spark: SparkSession, folder: str) -> DataFrame:
    counted = windowed_counts(table(spark, folder, "events"))
    return counted.select(F.unix_micros("window_start").alias("window_micros"), "event_type", "n", F.round("total", 4).alias("total"))
