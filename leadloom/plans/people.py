"""Queries of people: provider records, merges, lookups, budgets and contexts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import people
from leadloom.operators.tables import latest_per_key, top_rows
from leadloom.plans.analytics import LATEST_LEADS, case_first, query, sql_list
from leadloom.session import shared_dir
from leadloom.sources.files import append_log, archive_payloads, read_log
from leadloom.sources.tables import table

#: the instant that ages are counted to
NOW_MICROS = 1_788_220_800_000_000  # 2026-09-01 00:00 UTC
NOW_SQL = "timestamptz '2026-09-01 00:00:00+00'"


def now() -> Column:
    return F.timestamp_micros(F.lit(NOW_MICROS))


_NAME = "coalesce(nullif(trim(name), ''), nullif(concat_ws(' ', nullif(trim(first_name), ''), coalesce(nullif(trim(last_name), ''), nullif(trim(last_name_obfuscated), ''))), ''))"
_CLASSES = f"{case_first('(lower(t) || chr(32))', rules.FUNCTION_KEYWORDS)} as function, {case_first('lower(t)', rules.SENIORITY_KEYWORDS)} as seniority"


def _any(titles: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains(lower(t), '{t.lower()}')" for t in titles) + ")"


@query(
    f"""with p as (select *, {_NAME} as n, nullif(trim(title), '') as t, regexp_extract(employment_start_date, '^([0-9]{{4}})-(0[1-9]|1[0-2])($|[-T ])', 0) as m from person_record), c as (select *, {_CLASSES} from p where n is not null and t is not null)
    select person_id as lead_id, n as full_name, t as title_raw, function, seniority, {_any(rules.FOUNDER_TITLES)} as is_founder, {_any(rules.RECRUITING_TITLES)} as is_recruiter, nullif(concat_ws(', ', nullif(city, ''), nullif(state, ''), nullif(country, '')), '') as location_raw,
    case when m <> '' then greatest(0, (2026 - m[1:4]::int) * 12 + 9 - m[6:7]::int) end as tenure_months, case when function is null or seniority is null then 0.7::double else 1.0::double end as confidence from c"""
)
def person_leads(spark: SparkSession, folder: str) -> DataFrame:
    return people.person_to_lead(table(spark, folder, "person_record"), now())


@query("select person_id, provider, place, ((place - 1) // 25)::int as page from (select person_id, provider, row_number() over (partition by provider order by received_at desc, person_id) as place from person_record where provider is not null) where place <= 50")
def people_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "person_record").select("person_id", "provider", "received_at")
    return people.retrieved(rows, "provider", [F.desc("received_at"), F.col("person_id")]).select("person_id", "provider", "place", "page")


@query(
    """with s as (select company_id as g, right(company_id, 1) as d, count(distinct lead_id) as found, count(distinct case when trim(title_raw) <> '' then lead_id end) as usable from lead_record where company_id is not null group by all)
    select g as "group", case when d = '0' then 'budget_exhausted' when d = '1' then 'lead_discovery_failed' when case when d in ('2', '3') then found * 2 > 5 else found >= 5 end then 'company_identity_suspect' when usable = 0 then 'no_leads_found' else 'leads_ok' end as status from s"""
)
def retrieval_status(spark: SparkSession, folder: str) -> DataFrame:
    """Searches made from the leads of a company: the id's last digit says whether it was admitted, failed, or told its total."""
    counted = table(spark, folder, "lead_record").filter("company_id is not null").groupBy(F.col("company_id").alias("group")).agg(F.countDistinct("lead_id").alias("found"), F.countDistinct(F.when(F.trim("title_raw") != "", F.col("lead_id"))).alias("usable"))
    digit = F.substring("group", -1, 1)
    searches = counted.select("*", (digit != "0").alias("admitted"), (digit == "1").alias("failed"), F.when(digit.isin("2", "3"), F.col("found") * 2).alias("total"))
    return people.retrieval_status(searches, 5)


COMPLETE = "(coalesce(email_status = 'verified', false) and coalesce(trim(phone), '') <> '' and coalesce(trim(title_raw), '') <> '')"


@query(f"select lead_id, not {COMPLETE} as needed, not {COMPLETE} or (enriched_at is not null and epoch({NOW_SQL}) - epoch(enriched_at) >= 90 * 86400) as attempted from ({LATEST_LEADS})")
def enrichment_attempts(spark: SparkSession, folder: str) -> DataFrame:
    leads = latest_per_key(table(spark, folder, "lead_record"), ["lead_id"], "ingest_seq")
    return leads.select("lead_id", people.needs_enrichment(F.col("email_status"), F.col("phone"), F.col("title_raw")).alias("needed"), people.attempts_enrichment(leads, now()).alias("attempted"))


def asked_and_answers(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The leads' first records ask, the records of one provider are the answers; the company stands for its domain."""
    records = table(spark, folder, "lead_record").withColumn("domain", F.col("company_id"))
    first = latest_per_key(records.filter("source <> 'pdl'").withColumn("_o", -F.col("ingest_seq")), ["lead_id"], "_o")
    asked = first.withColumn("linkedin_url", F.when(F.col("ingest_seq") % 3 == 0, F.col("linkedin_url"))).withColumn("email", F.when(F.col("ingest_seq") % 2 == 0, F.col("email")))
    return asked, records.filter("source = 'pdl'").withColumn("answer_id", F.col("ingest_seq"))


WATERFALL = """a as (select * exclude (k, linkedin_url, email), company_id as domain, case when ingest_seq % 3 = 0 then linkedin_url end as linkedin_url, case when ingest_seq % 2 = 0 then email end as email from (select *, row_number() over (partition by lead_id order by ingest_seq) k from lead_record where source <> 'pdl' and lead_id is not null) where k = 1),
    p as (select *, company_id as domain from lead_record where source = 'pdl'), q as (select lead_id, nullif(trim(linkedin_url), '') as l, nullif(trim(email), '') as e, lower(case when contains(full_name, '*') then split_part(full_name, ' ', 1) else full_name end) as n, lower(domain) as d from a),
    bl as (select nullif(trim(linkedin_url), '') as l, min(ingest_seq) as al from p group by 1), be as (select nullif(trim(email), '') as e, min(ingest_seq) as ae from p group by 1), bn as (select lower(full_name) as n, lower(domain) as d, min(ingest_seq) as an from p group by 1, 2),
    w as (select lead_id, coalesce(al, ae, an) as answer_id, case when al is not null then 'linkedin' when ae is not null then 'email' when an is not null then 'name' end as rung from q left join bl using (l) left join be using (e) left join bn on bn.n = q.n and bn.d = q.d and q.l is null and q.e is null)"""


@query(f"with {WATERFALL} select * from w")
def enrichment_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return people.waterfall(*asked_and_answers(spark, folder))


@query(
    """with a as (select * exclude (k) from (select *, row_number() over (partition by lead_id order by ingest_seq) k from lead_record where lead_id is not null) where k = 1),
    t as (select * from (select source_person_id, nullif(trim(full_name), '') as fn, nullif(trim(email), '') as e, nullif(trim(email_status), '') as s, nullif(trim(linkedin_url), '') as l, nullif(trim(location_raw), '') as p, row_number() over (partition by source_person_id order by ingest_seq desc) k from lead_record where source_person_id is not null) where k = 1)
    select lead_id, coalesce(fn, full_name) as full_name, coalesce(nullif(trim(email), ''), e) as email, case when nullif(trim(email), '') is null and e is not null then coalesce(s, 'guessed') else email_status end as email_status,
    coalesce(nullif(trim(linkedin_url), ''), l) as linkedin_url, coalesce(nullif(trim(location_raw), ''), p) as location_raw from a left join t using (source_person_id)"""
)
def reveal_merge(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "lead_record")
    first = latest_per_key(records.withColumn("_o", -F.col("ingest_seq")), ["lead_id"], "_o")
    return people.revealed(first, records.withColumn("answer_id", F.col("ingest_seq"))).select("lead_id", "full_name", "email", "email_status", "linkedin_url", "location_raw")


def _words_sql(text: str, less: tuple[str, ...] = ()) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z]+'), lambda x: length(x) > 1 and x not in ({sql_list((*rules.STOP_WORDS, *less))}))"


def corroborated_sql(title: str, other: str, place: str, other_place: str) -> str:
    generic = rules.GENERIC_TITLE_WORDS
    return f"(coalesce(list_has_any({_words_sql(title, generic)}, {_words_sql(other, generic)}), false) or coalesce(list_has_any({_words_sql(place)}, {_words_sql(other_place)}), false))"


@query(f"select ingest_seq, {corroborated_sql('r.title_raw', 'c.title_raw', 'r.location_raw', 'c.location_raw')} as corroborated from lead_record r join ({LATEST_LEADS}) c using (lead_id)".replace("select ingest_seq,", "select r.ingest_seq,"))
def corroboration(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each record of a lead shares a word of title or place with the lead's last record."""
    records = table(spark, folder, "lead_record")
    last = latest_per_key(records, ["lead_id"], "ingest_seq").select("lead_id", F.col("title_raw").alias("t"), F.col("location_raw").alias("p"))
    met = records.select("ingest_seq", "lead_id", "title_raw", "location_raw").join(last, "lead_id")
    return met.select("ingest_seq", people.corroborated(F.col("title_raw"), F.col("t"), F.col("location_raw"), F.col("p")).alias("corroborated"))


@query(
    f"""with {WATERFALL}, m as (select a.*, rung, p.email as we, p.email_status as ws, p.phone as mo, p.linkedin_url as pr, p.location_raw as pl, p.title_raw as jt from a left join w using (lead_id) left join p on p.ingest_seq = w.answer_id),
    u as (select *, rung is not null and rung = 'name' and not {corroborated_sql('title_raw', 'jt', 'location_raw', 'pl')} as weak, coalesce(email_status = 'verified', false) and coalesce(trim(email), '') <> '' as kept from m),
    v as (select *, rung is not null and not weak as use_ from u)
    select lead_id, case when use_ and not kept and coalesce(trim(we), '') <> '' then we else email end as email, case when use_ and not kept and coalesce(trim(we), '') <> '' then case when ws = 'verified' then 'verified' else 'guessed' end when use_ and not kept and coalesce(trim(email), '') <> '' then coalesce(email_status, 'guessed') else email_status end as email_status,
    case when use_ then coalesce(nullif(trim(phone), ''), nullif(trim(mo), '')) else phone end as phone, case when weak then 'enrichment_identity_weak' when use_ then 'enriched' else 'enrichment_skipped' end as enrichment_status, coalesce(use_ and trim(jt) <> '' and lower(jt) <> lower(title_raw), false) as job_changed from v"""
)
def enrich_merge(spark: SparkSession, folder: str) -> DataFrame:
    asked, answers = asked_and_answers(spark, folder)
    told = answers.select("answer_id", F.col("email").alias("work_email"), F.col("email_status").alias("work_status"), F.col("phone").alias("mobile"), F.col("linkedin_url").alias("profile"), F.col("location_raw").alias("place"), F.col("title_raw").alias("job_title"))
    found = people.waterfall(asked, answers).join(told, "answer_id", "left")
    return people.enriched(asked, found).select("lead_id", "email", "email_status", "phone", "enrichment_status", "job_changed")


@query(
    """with r as (select company_id, ingest_seq, (length(full_name) % 9)::bigint as cost from lead_record where company_id is not null), f as (select company_id, list_reduce(list({'o': ingest_seq, 'c': cost, 'used': 0::bigint, 'taken': []::bigint[]} order by ingest_seq),
    lambda a, x: case when a.used + x.c <= 60 then {'o': 0::bigint, 'c': 0::bigint, 'used': a.used + x.c, 'taken': list_append(a.taken, x.o)} else a end, {'o': 0::bigint, 'c': 0::bigint, 'used': 0::bigint, 'taken': []::bigint[]}) as a from r group by 1)
    select ingest_seq, r.company_id, cost, list_contains(f.a.taken, ingest_seq) as admitted from r join f using (company_id)"""
)
def budget_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Requests of different cost against a ceiling per company."""
    requests = table(spark, folder, "lead_record").filter("company_id is not null").select("ingest_seq", "company_id", (F.length("full_name") % 9).cast("bigint").alias("cost"))
    return people.within_budget(requests, "company_id", "ingest_seq", "cost", 60)


@query(
    f"""with d as (select company_id, doc_id, coalesce(text, '') as t, doc_id % 3 as s, row_number() over (partition by company_id, doc_id % 3 order by doc_id) as k from documents where doc_kind = 'context' and company_id is not null),
    a as (select company_id, coalesce(list(t order by doc_id) filter (s = 0), []) as f, coalesce(list(t order by doc_id) filter (s = 1), []) as h, count(*) as results from d where k <= 5 group by 1),
    x as (select *, nullif(substr(array_to_string(list_filter(f[1:2] || h[1:2], lambda t: t <> ''), ' '), 1, 500), '') as s from a)
    select company_id, coalesce(s, 'No public context found.') as summary, substr(coalesce(list_filter(f, lambda t: {' or '.join(f"contains(lower(t), '{w}')" for w in rules.FUNDING_WORDS)})[1], f[1]), 1, 60) as funding, substr(coalesce(list_filter(h, lambda t: {' or '.join(f"contains(lower(t), '{w}')" for w in rules.HIRING_WORDS)})[1], h[1]), 1, 60) as hiring, results from x"""
)
def company_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """Context texts as search results: of each company and section the first five."""
    docs = table(spark, folder, "documents").filter("doc_kind = 'context' and company_id is not null").select("company_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 3).alias("section"))
    first = top_rows(docs, ["company_id", "section"], [F.col("doc_id")], 5)
    texts = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == n, F.struct("doc_id", "text")))), lambda r: r["text"])
    sections = first.groupBy("company_id").agg(texts(0).alias("funding_texts"), texts(1).alias("hiring_texts"), F.count("*").alias("urls"))
    return people.company_context(sections).select("company_id", "summary", F.substring("funding", 1, 60).alias("funding"), F.substring("hiring", 1, 60).alias("hiring"), F.col("urls").alias("results"))


@query(
    f"""with t as (select raw_id, trim(title) as t from raw_posting where title is not null), c as (select raw_id, t, {_CLASSES} from t), d as (select title_canonical as t, function as f, seniority as s from (select *, row_number() over (partition by title_canonical order by ingest_seq desc) k from lead_record where title_canonical is not null) where k = 1)
    select raw_id, coalesce(function, f) as function, coalesce(seniority, s) as seniority from c left join d using (t)"""
)
def title_residue(spark: SparkSession, folder: str) -> DataFrame:
    from leadloom.functions import postings as P

    title = F.trim("title")
    rows = table(spark, folder, "raw_posting").filter("title is not null").select("raw_id", title.alias("title"), P.function_class(title, F.lit(None).cast("string")).alias("function"), P.seniority_class(title).alias("seniority"))
    decisions = table(spark, folder, "lead_record").filter("title_canonical is not null").select(F.col("title_canonical").alias("title"), "function", "seniority", F.col("ingest_seq").alias("seq"))
    return people.filled_classes(rows, decisions).select("raw_id", "function", "seniority")


@query(f"select company_id, epoch_us(min(retrieved_at)) as oldest_micros, epoch({NOW_SQL}) - epoch(min(retrieved_at)) >= 30 * 86400 as stale from lead_record where company_id is not null group by 1")
def lead_cache_age(spark: SparkSession, folder: str) -> DataFrame:
    oldest = table(spark, folder, "lead_record").filter("company_id is not null").groupBy("company_id").agg(F.min("retrieved_at").alias("at"))
    return oldest.select("company_id", F.unix_micros("at").alias("oldest_micros"), people.stale(F.col("at"), now(), 30).alias("stale"))


@query(f"select c.id as company_id, max(fetched_at) is null or epoch({NOW_SQL}) - epoch(max(fetched_at)) >= 7 * 86400 as stale from company c left join documents d on d.company_id = c.id and doc_kind = 'context' group by 1")
def context_stale(spark: SparkSession, folder: str) -> DataFrame:
    last = table(spark, folder, "documents").filter("doc_kind = 'context'").groupBy("company_id").agg(F.max("fetched_at").alias("at"))
    companies = table(spark, folder, "company").select(F.col("id").alias("company_id")).join(last, "company_id", "left")
    return companies.select("company_id", people.stale(F.col("at"), now(), 7).alias("stale"))


@query("select lead_id, ingest_seq, epoch_us(coalesce(enriched_at, retrieved_at)) as version from lead_record where lead_id is not null and ingest_seq % 2 = 0 union all select lead_id, ingest_seq, epoch_us(coalesce(enriched_at, retrieved_at)) from lead_record where lead_id is not null and ingest_seq % 2 = 1")
def log_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to a JSON-lines log in the shared folder, read again."""
    rows = table(spark, folder, "lead_record").filter("lead_id is not null").select("lead_id", "ingest_seq", F.unix_micros(F.coalesce("enriched_at", "retrieved_at")).alias("version"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    for odd in (0, 1):
        append_log(rows.filter(F.col("ingest_seq") % 2 == odd), path)
    return read_log(spark, path, rows.schema)


@query("select company_id, run_id, page_id, payload from board_page where company_id is not null and run_id is not null")
def payload_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads written by platform in the shared folder, read again."""
    path = f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    archive_payloads(table(spark, folder, "board_page").filter("company_id is not null and run_id is not null"), path, ("source_platform",))
    return read_log(spark, path, "page_id bigint, payload string, company_id string, run_id string").select("company_id", "run_id", "page_id", "payload")


_PAIR = "concat('job: ', job.title, ' (', coalesce(job.function, 'unknown'), ', ', coalesce(job.seniority, 'unknown'), ') in ', coalesce(job.location, 'unknown'), chr(10), 'lead: ', lead.name, ', ', lead.title, chr(10), 'contact: ', lead.contactability, chr(10), 'score: ', {0}, chr(10), 'text: ', substr(rationale, 1, 800))"


@query("select gtm_id, " + _PAIR.format("printf('%.3f', relevance_score)") + " as prompt from gtm_lead")
def pair_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What a scorer is told of each pair, its text cut to 800 characters."""
    return table(spark, folder, "gtm_lead").select("gtm_id", F.expr(_PAIR.format("format_string('%.3f', relevance_score)")).alias("prompt"))
