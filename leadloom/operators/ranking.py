"""Scored pairs to ranked and published leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators.people import given


def recency_weight(first_seen: Column, now: Column) -> Column:
    """Half for every half-life of a posting's age, with a floor; the future counts as now."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(first_seen)) / 86_400e6)
    return F.greatest(F.lit(rules.RECENCY_LEAST), F.pow(F.lit(0.5), age / rules.RECENCY_HALF_LIFE))


def reach(status: Column, email: Column, phone: Column) -> Column:
    """How a lead can be reached: struct(label, weight)."""
    mail = given(email).isNotNull()
    each = [F.struct(F.lit(label).alias("label"), F.lit(weight).alias("weight")) for label, weight in rules.REACH]
    return F.when(F.coalesce(status == "verified", F.lit(False)) & mail, each[0]).when(mail, each[1]).when(given(phone).isNotNull(), each[2]).otherwise(each[3])


def context_weight(funding: Column, hiring: Column) -> Column:
    """1, more for each signal of the company there is."""
    return F.lit(1.0) + F.when(funding.isNotNull(), rules.CONTEXT["funding"]).otherwise(0.0) + F.when(hiring.isNotNull(), rules.CONTEXT["hiring"]).otherwise(0.0)


def scored(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """matches with relevance, confidence, rationale and score_source: of the
    decision for the pair (job_id, lead_id, version; the last by seq; one that
    cites signals not supplied is none), else the rules' own scores without rationale."""
    grounded = decisions.filter(F.size(F.array_except("cited", "supplied")) == 0)
    told = grounded.groupBy("job_id", "lead_id", "version").agg(F.max_by(F.struct("relevance", "confidence", "rationale"), "seq").alias("_d"))
    hit = F.col("_d").isNotNull()
    return matches.join(told, ["job_id", "lead_id", "version"], "left").select(
        *matches.columns, F.when(hit, F.col("_d.relevance")).otherwise(F.col("score")).alias("relevance"), F.when(hit, F.col("_d.confidence")).otherwise(F.col("match_confidence")).alias("confidence"),
        F.coalesce("_d.rationale", F.lit("")).alias("rationale"), F.when(F.coalesce("_d.rationale", F.lit("")) != "", "llm").otherwise("rules_fallback").alias("score_source"),
    )


def ranked(entries: DataFrame, digits: int = 9) -> DataFrame:
    """entries (company_id, job_id, lead_id, relevance, confidence, recency,
    reach_weight, context) with priority, their product, and rank, from 1 within
    the company: by priority (to so many digits), then the later first_seen_at, job and lead."""
    with_priority = entries.withColumn("priority", F.round(F.col("relevance") * F.col("confidence") * F.col("recency") * F.col("reach_weight") * F.col("context"), digits))
    by_company = Window.partitionBy("company_id").orderBy(F.desc("priority"), F.desc("first_seen_at"), "job_id", "lead_id")
    return with_priority.withColumn("rank", F.row_number().over(by_company))


def superseded(published: DataFrame) -> DataFrame:
    """key, gtm_id, previous of first-ranked leads (key, gtm_id, lead_key,
    generated_at) whose lead differs from that of the publication before; equal
    instants by gtm_id."""
    by_key = Window.partitionBy("key").orderBy("generated_at", "gtm_id")
    return published.withColumn("previous", F.lag("lead_key").over(by_key)).filter(F.col("previous") != F.col("lead_key")).select("key", "gtm_id", "previous")


def feedback_agreement(feedback: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: agreements, total, rate of feedback (job_id, lead_id, useful) on
    known matches; it agrees if exactly the first place is useful. No feedback has a null rate."""
    met = feedback.join(matches.select("job_id", "lead_id", "place"), ["job_id", "lead_id"])
    agrees = F.count_if((F.col("place") == 1) == F.col("useful"))
    return met.agg(agrees.alias("agreements"), F.count("*").alias("total"), F.try_divide(agrees.cast("double"), F.count("*").cast("double")).alias("rate"))


def chosen_of_two(ties: DataFrame, choices: DataFrame) -> DataFrame:
    """job_id, lead_id of choices (job_id, lead_id) that name one of the two tied leads; others are no choice."""
    met = choices.join(ties, "job_id").filter((F.col("lead_id") == F.col("first_lead")) | (F.col("lead_id") == F.col("second_lead")))
    return met.select("job_id", "lead_id")
