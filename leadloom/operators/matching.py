"""Scored top-k join of jobs and people within a company.

The score depends on a few classes of either side, so classes are joined, not
rows: however many postings and people a company has, its pairs of classes stay
few, and each job class gets its k best people from the k first of each class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators.tables import top_rows


def size_tier(headcount: Column, stage: Column) -> Column:
    """struct(founder_bonus, penalty, guessed): by headcount, else by funding stage."""
    stage = F.lower(F.trim(F.regexp_replace(stage, "_", " ")))

    def tier(i: int, guessed: bool) -> Column:
        _, bonus, penalty = rules.TIERS[i]
        return F.struct(F.lit(bonus).alias("founder_bonus"), F.lit(penalty).alias("penalty"), F.lit(guessed).alias("guessed"))

    by_size = F.when(headcount < rules.TIERS[0][0], tier(0, False)).when(headcount < rules.TIERS[1][0], tier(1, False)).when(headcount < rules.TIERS[2][0], tier(2, False)).otherwise(tier(3, False))
    by_stage = tier(1, True)
    for i in (0, 1, 2):
        by_stage = F.when(stage.isin(*[s for s, t in rules.STAGE_TIER.items() if t == i]), tier(i, True)).otherwise(by_stage)
    return F.when(headcount.isNotNull(), by_size).otherwise(by_stage)


def function_score(job: Column, lead: Column, founder: Column, recruiter: Column) -> Column:
    adjacent = F.lit(False)
    for a, b in rules.ADJACENT_FUNCTIONS:
        adjacent = adjacent | ((job == a) & (lead == b)) | ((job == b) & (lead == a))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(job == lead), 1.0).when(yes(founder), 0.8).when(yes(recruiter), 0.7).when(yes(adjacent), 0.5).otherwise(0.0)


def seniority_score(job: Column, lead: Column, penalty: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in rules.SENIORITY_RANK.items() for x in kv])
    above = F.try_element_at(ranks, lead) - F.try_element_at(ranks, job)
    base = F.when(above.isNull(), 0.3).when(above < 0, 0.0)
    for delta, score in rules.SENIORITY_BASE.items():
        base = base.when(above == delta, score)
    return F.lit(1.0) - (F.lit(1.0) - base.otherwise(0.3)) * penalty


def reporting_line(description: Column) -> Column:
    """Whom a posting says it reports to, without end marks; null if it says nothing."""
    line = F.regexp_extract(description, rules.REPORTS_TO, 1)
    return F.nullif(F.regexp_replace(F.trim(line), r"[.,;]+$", ""), F.lit(""))


def ownership_score(job_function: Column, title: Column, line: Column) -> Column:
    """1 if the lead's title holds the reporting line, 0.8 if it is one of the function's owner titles, else 0."""
    owns = F.lit(False)
    for function, titles in rules.OWNER_TITLES.items():
        owns = owns | ((job_function == function) & F.lower(title).isin(*[t.lower() for t in titles]))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(F.lower(title).contains(F.lower(line)) & (line != "")), 1.0).when(yes(owns), 0.8).otherwise(0.0)


def signals_met(*signals: Column) -> Column:
    """How many of the signals are above 0."""
    return sum((F.when(s > 0, 1).otherwise(0) for s in signals), F.lit(0))


def match_confidence(classified: Column, degraded: Column, guessed: Column, met: Column, reachable: Column) -> Column:
    """How well founded a match is: 1 less a part for every weakness of its evidence, between 0 and 1, in the order of the rules."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    weak = {"unclassified": ~yes(classified), "degraded": yes(degraded), "guessed": yes(guessed), "thin": met <= 1, "unreachable": ~yes(reachable)}
    score = F.lit(1.0)
    for name, part in rules.CONFIDENCE_LOSS.items():
        score = score - F.when(weak[name], part).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def match_label(score: Column) -> Column:
    """The label of a score: the first threshold it reaches."""
    label = F.lit("wrong")
    for name, least in reversed(rules.LABELS):
        label = F.when(score >= least, name).otherwise(label)
    return label


def combined_score(function: Column, seniority: Column, ownership: Column, location: Column, founder_bonus: Column, recruiter: Column, short_tenure: Column) -> Column:
    """The weighted sum, terms added from left to right, between 0 and 1."""
    w = rules.WEIGHTS
    score = F.lit(w["function"]) * function + F.lit(w["seniority"]) * seniority + F.lit(w["ownership"]) * ownership + F.lit(w["location"]) * location + founder_bonus
    score = score + F.when(F.coalesce(recruiter, F.lit(False)), w["recruiter"]).otherwise(0.0) + F.when(F.coalesce(short_tenure, F.lit(False)), w["short_tenure"]).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def match_top_k(jobs: DataFrame, leads: DataFrame, companies: DataFrame, floor: float = 0.3, k: int = 3) -> DataFrame:
    """company_id, job_id, lead_id, score, place: the k best leads of each job
    with a score of floor or more; equal scores by lead_id.

    jobs: company_id, job_id, function, seniority, location_raw; leads:
    company_id, lead_id, title_raw, function, seniority, is_founder,
    is_recruiter, location_raw, tenure_months. jobs may have reporting_line,
    whom they report to; leads are told apart by their titles then. Jobs and leads without company
    have no match, nulls in other columns score as unknown.
    """
    lines = "reporting_line" in jobs.columns
    job_class = ["company_id", "j_function", "j_seniority", "j_place", *(["j_line"] if lines else [])]
    j = jobs.filter("company_id is not null").select("company_id", "job_id", F.col("function").alias("j_function"), F.col("seniority").alias("j_seniority"), F.lower("location_raw").alias("j_place"), *([F.lower("reporting_line").alias("j_line")] if lines else [])).dropDuplicates(["job_id"])
    owner = F.array(*[F.when(F.lower(F.trim("title_raw")).isin(*[t.lower() for t in titles]), F.lit(f)) for f, titles in rules.OWNER_TITLES.items()])
    lead_class = ["company_id", "l_function", "l_seniority", "is_founder", "is_recruiter", "l_short", "l_owns", "l_place", *(["l_title"] if lines else [])]
    people = leads.filter("company_id is not null").select(
        "company_id", "lead_id", F.col("function").alias("l_function"), F.col("seniority").alias("l_seniority"), "is_founder", "is_recruiter",
        (F.coalesce("tenure_months", F.lit(99)) < 3).alias("l_short"), F.array_compact(owner).alias("l_owns"), F.lower("location_raw").alias("l_place"), *([F.lower("title_raw").alias("l_title")] if lines else []),
    )
    people = top_rows(people, lead_class, [F.col("lead_id")], k, "_n").groupBy(*lead_class).agg(F.array_sort(F.collect_list("lead_id")).alias("lead_ids"))
    tiers = companies.select(F.col("id").alias("company_id"), size_tier(F.col("headcount"), F.col("funding_stage")).alias("tier"))
    pairs = j.select(*job_class).distinct().join(people, "company_id").join(tiers, "company_id", "left")
    founder_bonus = F.when(F.coalesce("is_founder", F.lit(False)), F.col("tier.founder_bonus")).otherwise(0.0)
    here = F.when(F.coalesce(F.col("l_place").contains(F.col("j_place")) & (F.col("j_place") != ""), F.lit(False)), 0.3).otherwise(0.0)
    owns = F.when(F.coalesce(F.array_contains("l_owns", F.col("j_function")), F.lit(False)), 0.8).otherwise(0.0)
    if lines:
        owns = F.when(F.coalesce(F.col("l_title").contains(F.col("j_line")) & (F.col("j_line") != ""), F.lit(False)), 1.0).otherwise(owns)
    score = combined_score(
        function_score(F.col("j_function"), F.col("l_function"), F.col("is_founder"), F.col("is_recruiter")),
        seniority_score(F.col("j_seniority"), F.col("l_seniority"), F.coalesce("tier.penalty", F.lit(rules.TIERS[1][2]))), owns, here, F.coalesce(founder_bonus, F.lit(0.0)), F.col("is_recruiter"), F.col("l_short"),
    )
    scored = pairs.withColumn("score", score).filter(F.col("score") >= floor).select(*job_class, "score", F.explode("lead_ids").alias("lead_id"))
    best = top_rows(scored, job_class, [F.desc("score"), F.col("lead_id")], k)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in job_class]
    return j.alias("a").join(best.alias("b"), on).select("a.company_id", "a.job_id", "b.lead_id", "b.score", "b.place")


def near_ties(matches: DataFrame, band: float = 0.05) -> DataFrame:
    """Jobs whose two best scores differ by less than the band: job_id, first_lead, second_lead, gap."""
    by_job = Window.partitionBy("job_id").orderBy("place")
    two = matches.withColumn("second_lead", F.lead("lead_id").over(by_job)).withColumn("gap", F.col("score") - F.lead("score").over(by_job))
    return two.filter((F.col("place") == 1) & (F.col("gap") < band)).select("job_id", F.col("lead_id").alias("first_lead"), "second_lead", "gap")


def swap_first_two(matches: DataFrame, preferred: DataFrame) -> DataFrame:
    """matches with places 1 and 2 exchanged where preferred (job_id, lead_id) names the second."""
    swap = matches.filter("place = 2").join(preferred.select("job_id", "lead_id"), ["job_id", "lead_id"], "left_semi").select("job_id", F.lit(True).alias("_swap"))
    place = F.when(F.col("_swap") & (F.col("place") == 1), 2).when(F.col("_swap") & (F.col("place") == 2), 1).otherwise(F.col("place"))
    return matches.join(swap, "job_id", "left").withColumn("place", F.coalesce(place, "place")).drop("_swap")
