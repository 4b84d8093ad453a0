"""Queries of matches, scores, ranks and publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import matching, people, ranking, runs
from leadloom.plans.analytics import MATCHES, function_sql, matches_of, query, seniority_sql, sql_list, tier_sql
from leadloom.plans.people import COMPLETE, NOW_SQL, WATERFALL, asked_and_answers, corroborated_sql, now
from leadloom.sources.tables import table

_W = rules.WEIGHTS
_OWNS = "(" + " or ".join(f"(job.function = '{f}' and lower(lead.title_raw) in ({sql_list(t.lower() for t in titles)}))" for f, titles in rules.OWNER_TITLES.items()) + ")"
_HEADCOUNT_ONLY = lambda part: tier_sql(part).replace("lower(trim(replace(funding_stage, '_', ' ')))", "null::varchar")
GOLDEN = f"""with s as (select case_id, expected_label, greatest(0.0::double, least(1.0::double, {_W['function']}::double * {function_sql('job.function', 'lead.function', 'lead.is_founder', 'lead.is_recruiter')} + {_W['seniority']}::double * {seniority_sql('job.seniority', 'lead.seniority', _HEADCOUNT_ONLY(2))}
    + {_W['ownership']}::double * case when {_OWNS} then 0.8::double else 0.0::double end + {_W['location']}::double * 0.0::double + case when lead.is_founder then {_HEADCOUNT_ONLY(1)} else 0.0::double end + case when lead.is_recruiter then {_W['recruiter']}::double else 0.0::double end + 0.0::double)) as score from golden_case),
    g as (select *, case when score >= 0.6::double then 'correct_owner' when score >= 0.3::double then 'plausible' else 'wrong' end as predicted from s) """


def golden_scores(cases: DataFrame) -> DataFrame:
    """case_id, expected_label, score, predicted of golden cases (headcount, job, lead): no place, tenure or description is known of them."""
    tier = matching.size_tier(F.col("headcount"), F.lit(None).cast("string"))
    score = matching.combined_score(
        matching.function_score(F.col("job.function"), F.col("lead.function"), F.col("lead.is_founder"), F.col("lead.is_recruiter")), matching.seniority_score(F.col("job.seniority"), F.col("lead.seniority"), tier["penalty"]),
        matching.ownership_score(F.col("job.function"), F.col("lead.title_raw"), F.lit(None).cast("string")), F.lit(0.0), F.when(F.coalesce("lead.is_founder", F.lit(False)), tier["founder_bonus"]).otherwise(0.0), F.col("lead.is_recruiter"), F.lit(False),
    )
    return cases.select("case_id", "expected_label", score.alias("score")).withColumn("predicted", matching.match_label(F.col("score")))


@query(GOLDEN + "select count(*) as total, count(*) filter (predicted = expected_label) as correct, coalesce(count(*) filter (predicted = expected_label) / nullif(count(*), 0), 0.0) as accuracy, avg((predicted <> expected_label)::int) as disagreement_rate from g")
def golden_set_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """How often the label of the score is the expected one; 0 for no cases, whose disagreement rate is null."""
    told = golden_scores(table(spark, folder, "golden_case"))
    right = F.count_if(F.col("predicted") == F.col("expected_label"))
    return told.agg(F.count("*").alias("total"), right.alias("correct"), F.coalesce(F.try_divide(right.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("accuracy"), F.avg((F.col("predicted") != F.col("expected_label")).cast("int")).alias("disagreement_rate"))


@query(GOLDEN + "select expected_label, predicted, count(*) as cases, round(avg(score), 9) as mean_score from g group by all")
def golden_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return golden_scores(table(spark, folder, "golden_case")).groupBy("expected_label", "predicted").agg(F.count("*").alias("cases"), F.round(F.avg("score"), 9).alias("mean_score"))


_SAYS = "case when ascii(right(gtm_id, 1)) % 3 = 0 then 'Join us. This role reports to the ' || lead.title || ', and more.' when ascii(right(gtm_id, 1)) % 3 = 1 then 'You will report to ' || lead.title || '.;' else 'Reports: none' end"


@query(f"select gtm_id, nullif(regexp_replace(trim(regexp_extract({_SAYS}, '{rules.REPORTS_TO}', 1)), '[.,;]+$', ''), '') as line from gtm_lead")
def reporting_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The reporting line of a sentence made from each lead's title."""
    case = F.ascii(F.substring("gtm_id", -1, 1)) % 3
    text = F.when(case == 0, F.concat(F.lit("Join us. This role reports to the "), F.col("lead.title"), F.lit(", and more."))).when(case == 1, F.concat(F.lit("You will report to "), F.col("lead.title"), F.lit(".;"))).otherwise("Reports: none")
    return table(spark, folder, "gtm_lead").select("gtm_id", matching.reporting_line(text).alias("line"))


_MET = f"""pairs as (select t.company_id, t.job_id, t.lead_id, t.place, t.score, jf, js, {function_sql('jf', 'l.function', 'l.is_founder', 'l.is_recruiter')} as fs, {seniority_sql('js', 'l.seniority', 'penalty')} as ss,
    case when {"(" + " or ".join(f"(jf = '{f}' and lower(title_raw) in ({sql_list(t.lower() for t in titles)}))" for f, titles in rules.OWNER_TITLES.items()) + ")"} then 0.8::double else 0.0::double end as os, case when jl <> '' and contains(lower(location_raw), jl) then 0.3::double else 0.0::double end as ls,
    l.function is not null and l.seniority is not null as classified, c.headcount is null as guessed, coalesce(email_status = 'verified', false) or coalesce(trim(phone), '') <> '' as reachable, email_status, email, phone, is_founder, l.source from top3 t join j using (company_id, job_id) join l using (lead_id) join company c on c.id = t.company_id),
    conf as (select *, (fs > 0)::int + (ss > 0)::int + (os > 0)::int + (ls > 0)::int as met from pairs), cf as (select *, greatest(0.0::double, least(1.0::double, 1.0::double - case when classified then 0.0::double else 0.15::double end - 0.0::double - case when guessed then 0.10::double else 0.0::double end - case when met <= 1 then 0.15::double else 0.0::double end - case when reachable then 0.0::double else 0.15::double end)) as confidence from conf)"""
_SCORED_MATCHES = MATCHES.rstrip() + ", " + _MET + " "


def scored_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The matches with their signals, the number of those met and their confidence."""
    jobs, leads, matches = matches_of(spark, folder)
    companies = table(spark, folder, "company").select(F.col("id").alias("company_id"), matching.size_tier(F.col("headcount"), F.col("funding_stage")).alias("tier"))
    l = leads.select("lead_id", F.col("function").alias("lf"), F.col("seniority").alias("ls"), "title_raw", F.lower("location_raw").alias("lp"), "is_founder", "is_recruiter", "email", "email_status", "phone", "source", "full_name")  # noqa: E741
    met = matches.join(jobs.select("job_id", F.col("function").alias("jf"), F.col("seniority").alias("js"), F.lower("location_raw").alias("jp")), "job_id").join(l, "lead_id").join(companies, "company_id")
    signals = {
        "function": matching.function_score(F.col("jf"), F.col("lf"), F.col("is_founder"), F.col("is_recruiter")), "seniority": matching.seniority_score(F.col("js"), F.col("ls"), F.col("tier.penalty")),
        "ownership": matching.ownership_score(F.col("jf"), F.col("title_raw"), F.lit(None).cast("string")), "location": F.when(F.coalesce(F.col("lp").contains(F.col("jp")) & (F.col("jp") != ""), F.lit(False)), 0.3).otherwise(0.0),
    }
    met = met.withColumns({f"signal_{n}": c for n, c in signals.items()}).withColumn("met", matching.signals_met(*[F.col(f"signal_{n}") for n in signals]))
    reachable = (F.coalesce(F.col("email_status") == "verified", F.lit(False))) | (F.coalesce(F.trim("phone"), F.lit("")) != "")
    return met.withColumn("match_confidence", matching.match_confidence(F.col("lf").isNotNull() & F.col("ls").isNotNull(), F.lit(False), F.col("tier.guessed"), F.col("met"), reachable))


@query(_SCORED_MATCHES + "select job_id, lead_id, place, round(fs, 9) as signal_function, round(ss, 9) as signal_seniority, os as signal_ownership, ls as signal_location, met, round(confidence, 9) as match_confidence from cf")
def match_confidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = scored_matches(spark, folder)
    return rows.select("job_id", "lead_id", "place", F.round("signal_function", 9).alias("signal_function"), F.round("signal_seniority", 9).alias("signal_seniority"), "signal_ownership", "signal_location", "met", F.round("match_confidence", 9).alias("match_confidence"))


@query(MATCHES + ", no as (select coalesce(jf, 'unknown') as function from j where job_id not in (select job_id from top3) and company_id in (select company_id from l)) select function, count(*) as jobs from no group by 1 having count(*) >= 5")
def persona_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of which five jobs or more have leads but no plausible one."""
    jobs, leads, matches = matches_of(spark, folder)
    left = runs.unmatched_jobs(jobs, matches, leads).filter("reason = 'no_plausible_owner'")
    return left.groupBy("function").agg(F.count("*").alias("jobs")).filter("jobs >= 5")


@query(MATCHES + ", f as (select job_id, lead_id, (ascii(right(job_id, 1)) + place) % 3 = 0 as useful from top3 union all select 'none', 'none', true) select count(*) filter ((place = 1) = useful) as agreements, count(*) as total, count(*) filter ((place = 1) = useful) / nullif(count(*), 0) as rate from f join top3 using (job_id, lead_id)")
def feedback_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """Feedback made by arithmetic on matches, with a row on an unknown one."""
    matches = matches_of(spark, folder)[2]
    feedback = matches.select("job_id", "lead_id", ((F.ascii(F.substring("job_id", -1, 1)) + F.col("place")) % 3 == 0).alias("useful"))
    unknown = spark.createDataFrame([("none", "none", True)], "job_id string, lead_id string, useful boolean")
    return ranking.feedback_agreement(feedback.unionByName(unknown), matches)


#: decisions for pairs: of jobs with an even last letter, for the first two places; every fifth cites a signal that was not supplied
_DECIDED = "ascii(right(job_id, 1)) % 2 = 0 and place <= 2"
_PUBLISHED = (
    _SCORED_MATCHES
    + f""", told as (select cf.*, {_DECIDED} and ascii(right(lead_id, 1)) % 5 <> 0 as hit, g.relevance_score, g.confidence_score, g.rationale, g.generated_at from cf join gtm_lead g on g.gtm_id = job_id),
    e as (select *, case when hit then relevance_score else score end as relevance, case when hit then confidence_score else confidence end as conf, coalesce(case when hit then rationale end, '') as why, greatest(0.3::double, pow(0.5::double, greatest(0.0::double, (epoch_us({NOW_SQL}) - epoch_us(generated_at)) / 86400e6) / 14.0)) as recency,
    case when email_status = 'verified' and coalesce(trim(email), '') <> '' then 'verified email' when coalesce(trim(email), '') <> '' then 'guessed email' when coalesce(trim(phone), '') <> '' then 'phone only' else 'no contact on file' end as contactability from told),
    p as (select e.*, round(relevance * conf * recency * case contactability when 'verified email' then 1.0::double when 'guessed email' then 0.7::double when 'phone only' then 0.6::double else 0.4::double end * (1.0::double + case when x.funding is not null then 0.15::double else 0.0::double end + case when x.hiring is not null then 0.10::double else 0.0::double end), 9) as priority
    from e left join (select company_id, min(doc_id) filter (doc_id % 3 = 0) as funding, min(doc_id) filter (doc_id % 3 = 1) as hiring from documents where doc_kind = 'context' group by 1) x using (company_id)),
    r as (select *, row_number() over (partition by company_id order by priority desc, generated_at desc, job_id, lead_id) as rank from p) """
)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Matches scored by decisions or rules, ranked within their company, with what is published of them."""
    matches = scored_matches(spark, folder).withColumn("version", F.lit("v1"))
    g = table(spark, folder, "gtm_lead").select(F.col("gtm_id").alias("job_id"), F.col("relevance_score").alias("relevance"), F.col("confidence_score").alias("confidence"), "rationale", F.col("generated_at").alias("first_seen_at"))
    letter = lambda c: F.ascii(F.substring(c, -1, 1))
    signals = F.array(*[F.lit(s) for s in ("function", "seniority", "ownership", "location")])
    decisions = matches.filter((letter("job_id") % 2 == 0) & (F.col("place") <= 2)).select("job_id", "lead_id", "version").join(g, "job_id")
    decisions = decisions.select("job_id", "lead_id", "version", "relevance", "confidence", "rationale", F.lit(1).alias("seq"), signals.alias("supplied"), F.when(letter("lead_id") % 5 == 0, F.array(F.lit("charm"))).otherwise(F.slice(signals, 1, 2)).alias("cited"))
    scored = ranking.scored(matches, decisions).join(g.select("job_id", "first_seen_at"), "job_id")
    docs = table(spark, folder, "documents").filter("doc_kind = 'context'").groupBy("company_id").agg(F.min(F.when(F.col("doc_id") % 3 == 0, F.col("doc_id"))).alias("funding"), F.min(F.when(F.col("doc_id") % 3 == 1, F.col("doc_id"))).alias("hiring"))
    entries = scored.join(docs, "company_id", "left").withColumn("reach", ranking.reach(F.col("email_status"), F.col("email"), F.col("phone")))
    entries = entries.withColumns({"recency": ranking.recency_weight(F.col("first_seen_at"), now()), "reach_weight": F.col("reach.weight"), "context": ranking.context_weight(F.col("funding"), F.col("hiring"))})
    return ranking.ranked(entries)


@query(_PUBLISHED + "select company_id, rank, job_id, lead_id, priority, contactability, why as rationale, case when why <> '' then 'llm' else 'rules_fallback' end as score_source, source as lead_source from r")
def published_leads(spark: SparkSession, folder: str) -> DataFrame:
    return published(spark, folder).select("company_id", "rank", "job_id", "lead_id", "priority", F.col("reach.label").alias("contactability"), "rationale", "score_source", F.col("source").alias("lead_source"))


@query(
    _PUBLISHED
    + """select 'lead_ready' as event, job_id, lead_id from r union all select 'job_unmatched', job_id, null from j where job_id not in (select job_id from top3)
    union all select 'first_choice', job_id, lead_id from r where rank = 1"""
)
def publication_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a publication as one bag: a lead for each match, the jobs without one, the first choice of each company."""
    jobs, leads, matches = matches_of(spark, folder)
    entries = published(spark, folder)
    ready = entries.select(F.lit("lead_ready").alias("event"), "job_id", "lead_id")
    none = runs.unmatched_jobs(jobs, matches, leads).select(F.lit("job_unmatched").alias("event"), "job_id", F.lit(None).cast("string").alias("lead_id"))
    first = entries.filter("rank = 1").select(F.lit("first_choice").alias("event"), "job_id", "lead_id")
    return ready.unionByName(none).unionByName(first)


@query(
    """with t as (select company.domain as key, gtm_id, coalesce(nullif(trim(lead.email), ''), lead.name) as lead_key, generated_at from gtm_lead where rank = 1 and company.domain is not null),
    p as (select *, lag(lead_key) over (partition by key order by generated_at, gtm_id) as previous from t) select key, gtm_id, previous from p where previous <> lead_key"""
)
def superseded_leads(spark: SparkSession, folder: str) -> DataFrame:
    """First-ranked leads of a company that differ from its first-ranked lead published before."""
    first = table(spark, folder, "gtm_lead").filter("rank = 1 and company.domain is not null")
    return ranking.superseded(first.select(F.col("company.domain").alias("key"), "gtm_id", F.coalesce(F.nullif(F.trim("lead.email"), F.lit("")), "lead.name").alias("lead_key"), "generated_at"))


@query(MATCHES + ", t as (select a.job_id, a.lead_id as f, b.lead_id as s from top3 a join top3 b on a.job_id = b.job_id and a.place = 1 and b.place = 2 where a.score - b.score < 0.05::double) select job_id, s as lead_id from t where ascii(right(job_id, 1)) % 3 = 1")
def tie_choices(spark: SparkSession, folder: str) -> DataFrame:
    """Choices for tied jobs: the second lead for a third of them, for another third a lead that was not offered."""
    ties = matching.near_ties(matches_of(spark, folder)[2])
    case = F.ascii(F.substring("job_id", -1, 1)) % 3
    choices = ties.select("job_id", F.when(case == 1, F.col("second_lead")).when(case == 2, F.lit("ld-unknown")).alias("lead_id"))
    return ranking.chosen_of_two(ties, choices)


@query(
    MATCHES.rstrip()
    + f""", {WATERFALL}, b as (select lead_id, row_number() over (partition by company_id order by ingest_seq) <= 5 as admitted from a), t as (select a.lead_id, a.title_raw as tt, a.location_raw as tl, rung, p.title_raw as jt, p.location_raw as pl from a left join w using (lead_id) left join p on p.ingest_seq = w.answer_id),
    o as (select a.lead_id, case when a.lead_id not in (select lead_id from top3) then 'passed' when {COMPLETE} and not (enriched_at is not null and epoch({NOW_SQL}) - epoch(enriched_at) >= 90 * 86400) then 'complete' when not admitted or right(a.lead_id, 1) = '9' then 'skipped' when rung is null then 'missed'
    when rung = 'name' and not {corroborated_sql('tt', 'jt', 'tl', 'pl')} then 'identity_weak' else 'enriched' end as outcome from a join b using (lead_id) join t using (lead_id))
    select lead_id, outcome, outcome in ('missed', 'identity_weak', 'enriched') as touched from o"""
)
def enrichment_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of every lead: five leads of a company are admitted, the provider fails for ids that end with 9."""
    asked, answers = asked_and_answers(spark, folder)
    matched = matches_of(spark, folder)[2].select("lead_id", F.lit(True).alias("matched")).distinct()
    told = answers.select("answer_id", F.col("title_raw").alias("job_title"), F.col("location_raw").alias("place"))
    found = people.waterfall(asked, answers).join(told, "answer_id", "left")
    budget = people.within_budget(asked.select("company_id", "ingest_seq", "lead_id", F.lit(1).alias("cost")), "company_id", "ingest_seq", "cost", 5).select("lead_id", "admitted")
    leads = asked.withColumn("attempted", people.attempts_enrichment(asked, now())).join(matched, "lead_id", "left").join(budget, "lead_id").join(found, "lead_id", "left")
    leads = leads.withColumns({"failed": F.substring("lead_id", -1, 1) == "9", "corroborated": people.corroborated(F.col("title_raw"), F.col("job_title"), F.col("location_raw"), F.col("place"))})
    return people.enrichment_outcome(leads)
