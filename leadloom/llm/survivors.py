"""The surviving value of each field of a group of records that disagree.

Method: a latent two-sided quality model. Every value of a field is a fact that
is true or not; every kind of claim (field, source, identity flag, confidence
band, verification, and of guessed addresses how they are made) has a sensitivity (how often it names a true value it could
name) and a specificity (how often it leaves a false one alone), both inferred
by expectation-maximisation over all groups. A field may have several true
values over time; all values judged true are kept, and the survivor is the one
seen last.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions.text import squeezed
from leadloom.session import cut

# Entries that stand for a missing value.
NO_TITLES = ("n/a", "na", "-", "--", "---", "...", "…", "tbd", "title", "unknown", "none", "null", "employee", "staff", "not available", "test", "x", "?")
ROLE_BOXES = "info|contact|hello|hi|admin|office|sales|support|jobs|careers|hr|team|mail|noreply|no-reply|webmaster|postmaster|marketing|press"
BANDS = 5  # of confidence
ROUNDS = 12
#: pseudo-counts of true positives, misses, false positives and true negatives of a kind of claim
PRIOR = (4.0, 1.0, 1.0, 4.0)
#: log-odds of a value to be true before any claim, and the least of a survivor
PRIOR_ODDS, LEAST_ODDS = 0.0, 0.0


def _email_text(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"^\s*(?:mailto:)?\s*<?\s*(?:mailto:)?|\s*>?\s*$", "")


def _email_usable(mail: Column) -> Column:
    return mail.rlike(r"^[^@\s*<>()]+@[^@\s*<>()]+\.[a-z]{2,}$") & ~mail.rlike(rf"\.invalid$|@(?:example|test|placeholder)\.[a-z]+$|^(?:{ROLE_BOXES})@")


def email_value(text: Column) -> Column:
    """An address in comparable form; null if it can't be a person's address."""
    return F.when(_email_usable(_email_text(text)), _email_text(text))


def _phone_text(text: Column) -> Column:
    """Digits as country code and number (ten digits alone are North American); null for masked numbers and extensions."""
    plain = F.regexp_replace(F.lower(F.trim(text)), r"\(0\)", "")
    digits = F.regexp_replace(plain, r"[^0-9]", "")
    number = F.when(plain.rlike(r"^(?:tel:)?\s*(?:\+|00)"), F.regexp_replace(digits, r"^00", "")).when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).otherwise(digits)
    return F.when(~plain.contains("*") & ~plain.rlike(r"^ext"), number)


def _phone_usable(number: Column) -> Column:
    return F.length(number).between(9, 15) & ~number.rlike(r"^1?(\d)\1{7,}$|^1?1?234567890?")


def phone_value(text: Column) -> Column:
    """A number as country code and digits; null for masked, short and made-up numbers."""
    return F.when(_phone_usable(_phone_text(text)), _phone_text(text))


def _linkedin_text(text: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(text)), r"/in/([^/?#\s]+)", 1)


def linkedin_value(text: Column) -> Column:
    """The personal part of a profile address; null for other pages."""
    return F.nullif(_linkedin_text(text), F.lit(""))


def _title_text(text: Column) -> Column:
    return F.lower(squeezed(text))


def _title_usable(title: Column) -> Column:
    return title.rlike(r"\p{L}") & ~title.isin(*NO_TITLES) & ~title.rlike(r"(?:…|\.\.\.)$")


def title_value(text: Column) -> Column:
    """A title in lower case, white space collapsed; null for placeholders and titles cut off."""
    return F.when(_title_usable(_title_text(text)), _title_text(text))


def address_shape(email: Column, name: Column) -> Column:
    """How an address is made from a name: split (by a mark), joined (as long as
    the whole name), short, or open (the name is written with an initial)."""
    local = F.substring_index(email, "@", 1)
    letters = F.length(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}]", ""))
    initial = F.coalesce(name, F.lit("")).rlike(r"(?:^|\s)\p{L}\.?(?:\s|$|,)")
    return F.when(local.rlike(r"[._-]"), "split").when(initial | (letters == 0), "open").when(F.length(local) >= letters - 1, "joined").otherwise("short")


#: field: (column, its text in comparable form, whether that is a usable value)
VALUES = {
    "email": ("email", _email_text, _email_usable),
    "phone": ("phone", _phone_text, _phone_usable),
    "linkedin_url": ("linkedin_url", _linkedin_text, lambda slug: slug != ""),
    "title": ("title_raw", _title_text, _title_usable),
}


def claims(records: DataFrame) -> DataFrame:
    """lead_id, field, value, kind, n, seen_first, seen_last, ingest_seq: the
    usable values of all records, counted by kind of claim."""
    band = F.least(F.floor(F.coalesce("confidence", F.lit(0.0)) * BANDS), F.lit(BANDS - 1)).cast("string")
    weak = F.when(F.col("enrichment_status") == "enrichment_identity_weak", "weak").otherwise("own")
    texts = records.filter(F.col("lead_id").isNotNull()).select(
        "lead_id", "full_name", F.concat_ws("|", F.coalesce("source", F.lit("?")), weak, band).alias("kind"), F.coalesce(F.col("email_status") == "verified", F.lit(False)).alias("verified"),
        "retrieved_at", "ingest_seq", *[text(F.col(column)).alias(f"_{field}") for field, (column, text, _) in VALUES.items()],
    )
    # the texts are a step of their own: each is used several times, but made once
    how = F.when(F.col("verified"), "verified").otherwise(F.concat(F.lit("guessed "), address_shape(F.col("_email"), F.col("full_name"))))
    named = [F.when(usable(F.col(f"_{field}")), F.struct(F.lit(field).alias("field"), F.col(f"_{field}").alias("value"), F.concat_ws("|", F.lit(field), "kind", *([how] if field == "email" else [])).alias("kind"))) for field, (_, _, usable) in VALUES.items()]
    rows = texts.select("lead_id", "retrieved_at", "ingest_seq", F.inline(F.array_compact(F.array(*named))))
    return rows.groupBy("lead_id", "field", "value", "kind").agg(F.count("*").alias("n"), F.min("retrieved_at").alias("seen_first"), F.max("retrieved_at").alias("seen_last"), F.max("ingest_seq").alias("ingest_seq"))


def facts(claimed: DataFrame) -> DataFrame:
    """One row per lead, field and value with its evidence: said (kinds of claim
    that name it, with counts) and denied (kinds of claim that name another
    value while it was, or surrounding it). Two values contradict each other if
    one was seen only between two sightings of the other; values that follow
    one another may both be true.

    All steps are by lead and field, so that the claims move once; of every
    value, what it surrounds comes back to it counted by kind of claim.
    """
    key = ["lead_id", "field"]
    by_value = claimed.repartition(*key).groupBy(*key, "value").agg(
        F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("said"), F.min("seen_first").alias("seen_first"), F.max("seen_last").alias("seen_last"), F.max("ingest_seq").alias("ingest_seq"),
    )
    before = Window.partitionBy(*key).orderBy("seen_first", F.desc("seen_last"), "value").rowsBetween(Window.unboundedPreceding, -1)
    around = by_value.withColumn("around", F.max(F.struct("seen_last", "seen_first", "value", "said")).over(before))
    inside = F.col("around").isNotNull() & (F.col("around.seen_last") > F.col("seen_last")) & (F.col("around.seen_first") < F.col("seen_first"))
    empty = F.array().cast("array<struct<kind:string,n:bigint>>")
    own = F.struct("said", F.coalesce(F.when(inside, F.col("around.said")), empty).alias("denied"), "seen_last", "ingest_seq")
    rows = around.select(*key, "value", own.alias("own"), F.when(inside, F.col("around.value")).alias("outer"))
    kind = rows.schema["own"].dataType.simpleString()
    itself = F.array(F.struct("value", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("n"), "own"))
    inner = F.when(F.col("outer").isNotNull(), F.transform("own.said", lambda c: F.struct(F.col("outer").alias("value"), c["kind"].alias("kind"), c["n"].alias("n"), F.lit(None).cast(kind).alias("own")))).otherwise(F.array().cast(f"array<struct<value:string,kind:string,n:bigint,own:{kind}>>"))
    told = rows.select(*key, F.inline(F.concat(itself, inner))).groupBy(*key, "value", "kind").agg(F.sum("n").alias("n"), F.max("own").alias("own"))
    joined = told.groupBy(*key, "value").agg(F.max("own").alias("own"), F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("kind", "n"))).alias("inner"))
    return joined.select(*key, "value", "own.said", F.array_sort(F.concat("own.denied", "inner")).alias("denied"), "own.seen_last", "own.ingest_seq")


def _odds(quality: dict[str, tuple[float, float]]) -> Column:
    """Log-odds of a fact by the sensitivity and specificity of each kind of claim."""
    if not quality:
        return F.lit(PRIOR_ODDS)

    def table(value) -> Column:
        return F.create_map(*[F.lit(x) for k, (sens, spec) in quality.items() for x in (k, value(sens, spec))])

    said = table(lambda sens, spec: math.log(sens / (1 - spec)))
    # a kind of claim that is worse than chance speaks against what it names, but not for what it leaves out
    denied = table(lambda sens, spec: min(0.0, math.log((1 - sens) / spec)))

    def total(column: str, weights: Column) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda acc, c: acc + c["n"] * F.coalesce(weights[c["kind"]], F.lit(0.0)))

    return F.lit(PRIOR_ODDS) + total("said", said) + total("denied", denied)


def source_quality(evidence: DataFrame, rounds: int = ROUNDS) -> dict[str, tuple[float, float]]:
    """Sensitivity and specificity of every kind of claim, over all facts.

    Facts with the same evidence are counted once with their number, so a round
    is one small aggregate; only the kinds of claim (a product of a few short
    lists) come to the driver.
    """
    patterns = cut(evidence.groupBy("said", "denied").agg(F.count("*").alias("facts")))
    kinds = [r["kind"] for r in patterns.select(F.explode("said").alias("c")).select("c.kind").distinct().collect()]
    quality = {k: (0.8, 0.7 if "|weak|" in k else 0.8) for k in kinds}
    tp, miss, fp, tn = PRIOR
    for _ in range(rounds):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), _odds(quality)))))
        scored = patterns.select("facts", p.alias("p"), "said", "denied")
        each = scored.select("facts", "p", F.explode(F.concat(F.transform("said", lambda c: F.struct(c["kind"].alias("kind"), c["n"].alias("said"), F.lit(0).cast("bigint").alias("denied"))), F.transform("denied", lambda c: F.struct(c["kind"].alias("kind"), F.lit(0).cast("bigint").alias("said"), c["n"].alias("denied"))))).alias("c"))
        sums = each.groupBy("c.kind").agg(
            F.sum(F.col("facts") * F.col("p") * F.col("c.said")).alias("tp"), F.sum(F.col("facts") * F.col("p") * F.col("c.denied")).alias("miss"),
            F.sum(F.col("facts") * (1 - F.col("p")) * F.col("c.said")).alias("fp"), F.sum(F.col("facts") * (1 - F.col("p")) * F.col("c.denied")).alias("tn"),
        ).collect()
        quality = {r["kind"]: ((r["tp"] + tp) / (r["tp"] + r["miss"] + tp + miss), (r["tn"] + tn) / (r["fp"] + r["tn"] + fp + tn)) for r in sums}
    return quality


def judged_values(records: DataFrame) -> DataFrame:
    """Every usable value of every lead and field with its log-odds of being
    true: lead_id, field, value, odds, seen_last, ingest_seq (the greatest of
    the rows that carry it)."""
    evidence = cut(facts(claims(records)))
    return evidence.select("lead_id", "field", "value", _odds(source_quality(evidence)).alias("odds"), "seen_last", "ingest_seq")


def surviving_values(records: DataFrame) -> DataFrame:
    """lead_id, field, value, ingest_seq, odds: of leads with two or more rows
    the surviving value of each field, and the last row that carries it.

    Of the values judged true the one seen last survives; of values seen last
    at the same time the later row. Leads without a usable true value of a
    field have no row for it; null lead ids are left out, exact repeats count
    as rows. Empty tables give none.
    """
    several = records.groupBy("lead_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("lead_id")
    judged = judged_values(records).filter(F.col("odds") >= LEAST_ODDS)
    last = judged.groupBy("lead_id", "field").agg(F.max(F.struct("seen_last", "ingest_seq", "value", "odds")).alias("_"))
    return last.select("lead_id", "field", "_.value", "_.ingest_seq", "_.odds").join(several, "lead_id", "left_semi")
