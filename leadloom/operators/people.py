"""People from providers: records to leads, merges that fill gaps, lookups by
falling keys, and the ladders that say what is known of a lead or a company.

What a provider would answer is a table; a missing row is a miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import postings as P
from leadloom.functions import rules


def given(text: Column) -> Column:
    """The trimmed text, null if it is blank."""
    return F.nullif(F.trim(text), F.lit(""))


def _dealt(key: Column, row: Column) -> Column:
    """A join key whose nulls are dealt out by row: they match nothing, and don't meet in one task."""
    return F.coalesce(key, F.concat(F.lit("\u0000"), row.cast("string")))


def full_name(name: Column, first: Column, last: Column, masked: Column) -> Column:
    """The name as given, else the first name with the last one, else with the masked one; null if there is none."""
    return F.coalesce(given(name), F.nullif(F.concat_ws(" ", given(first), F.coalesce(given(last), given(masked))), F.lit("")))


def months_since(start: Column, now: Column) -> Column:
    """Calendar months from an ISO date or month to now, 0 at least; null for other texts."""
    month = F.regexp_extract(start, r"^(\d{4})-(0[1-9]|1[0-2])(?:$|[-T ])", 0)
    months = (F.year(now) - F.substring(month, 1, 4).cast("int")) * 12 + F.month(now) - F.substring(month, 6, 2).cast("int")
    return F.when(month != "", F.greatest(F.lit(0), months))


def _holds_any(text: Column, titles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for title in titles:
        found = found | F.lower(text).contains(title.lower())
    return found


def person_to_lead(persons: DataFrame, now: Column) -> DataFrame:
    """Leads of person records that have a name and a title: lead_id, full_name,
    title_raw, function, seniority, is_founder, is_recruiter, location_raw,
    tenure_months, confidence (less if a class is unknown). Blank parts count as
    missing; records without id get none and stay."""
    title = given(F.col("title"))
    rows = persons.withColumn("_name", full_name(F.col("name"), F.col("first_name"), F.col("last_name"), F.col("last_name_obfuscated"))).withColumn("_title", title).filter("_name is not null and _title is not null")
    function, seniority = P.function_class(F.col("_title"), F.lit(None).cast("string")), P.seniority_class(F.col("_title"))
    place = F.nullif(F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in ("city", "state", "country")]), F.lit(""))
    return rows.select(
        F.col("person_id").alias("lead_id"), F.col("_name").alias("full_name"), F.col("_title").alias("title_raw"), function.alias("function"), seniority.alias("seniority"), _holds_any(F.col("_title"), rules.FOUNDER_TITLES).alias("is_founder"),
        _holds_any(F.col("_title"), rules.RECRUITING_TITLES).alias("is_recruiter"), place.alias("location_raw"), months_since(F.col("employment_start_date"), now).alias("tenure_months"), F.when(function.isNull() | seniority.isNull(), 0.7).otherwise(1.0).alias("confidence"),
    )


def retrieved(persons: DataFrame, group: str, order: list[Column], cap: int = 50, page: int = 25) -> DataFrame:
    """The records of a paged people search per group: page and place of each;
    a search ends with its first short page or at the cap."""
    numbered = persons.filter(F.col(group).isNotNull()).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.filter(F.col("place") <= cap).withColumn("page", F.floor((F.col("place") - 1) / page).cast("int"))


def retrieval_status(searches: DataFrame, cap: int = 50) -> DataFrame:
    """group, status of a people search (group, admitted, failed, total, found,
    usable): the first that holds of budget_exhausted, lead_discovery_failed,
    company_identity_suspect (more than the cap, or the cap met and no total given), no_leads_found, leads_ok."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    over = F.coalesce(F.col("total") > cap, F.col("found") >= cap)
    status = F.when(~yes("admitted"), "budget_exhausted").when(yes("failed"), "lead_discovery_failed").when(over, "company_identity_suspect").when(F.coalesce("usable", F.lit(0)) == 0, "no_leads_found").otherwise("leads_ok")
    return searches.select("group", status.alias("status"))


def words(text: Column, *less: str) -> Column:
    """The distinct words of two letters or more (a to z, small) without stop words and the words given."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) > 1)
    return F.array_except(found, F.array(*[F.lit(w) for w in (*rules.STOP_WORDS, *less)]))


def corroborated(title: Column, other_title: Column, place: Column, other_place: Column) -> Column:
    """Whether titles (without generic words) or places share a word; missing ones share none."""
    generic = [w for w in rules.GENERIC_TITLE_WORDS if w not in rules.STOP_WORDS]
    return F.coalesce(F.arrays_overlap(words(title, *generic), words(other_title, *generic)), F.lit(False)) | F.coalesce(F.arrays_overlap(words(place), words(other_place)), F.lit(False))


def stale(at: Column, now: Column, days: int) -> Column:
    """Never, or so many whole days ago or more."""
    return at.isNull() | ((now.cast("bigint") - at.cast("bigint")) >= days * 86_400)


def needs_enrichment(status: Column, phone: Column, title: Column) -> Column:
    """Whether a verified address, a phone or a title is missing."""
    return ~(F.coalesce(status == "verified", F.lit(False)) & given(phone).isNotNull() & given(title).isNotNull())


def attempts_enrichment(leads: DataFrame, now: Column, days: int = 90) -> Column:
    """Incomplete leads always; complete ones if they were enriched before, so long ago."""
    old = F.col("enriched_at").isNotNull() & stale(F.col("enriched_at"), now, days)
    return needs_enrichment(F.col("email_status"), F.col("phone"), F.col("title_raw")) | old


def waterfall(leads: DataFrame, answers: DataFrame) -> DataFrame:
    """lead_id, answer_id, rung ('linkedin', 'email', 'name') of the first key that
    finds an answer; name and domain are asked only of leads with neither
    profile nor address. leads: lead_id, linkedin_url, email, full_name, domain;
    answers: answer_id and the same keys. Of answers with one key the least id;
    masked names ask by their first word."""
    asked = leads.select("lead_id", given(F.col("linkedin_url")).alias("linkedin"), given(F.col("email")).alias("email"), F.lower(F.when(F.col("full_name").contains("*"), F.split_part("full_name", F.lit(" "), F.lit(1))).otherwise(F.col("full_name"))).alias("name"), F.lower("domain").alias("domain"))

    def known(name: str, *keys: str) -> DataFrame:
        listed = {"linkedin": given(F.col("linkedin_url")), "email": given(F.col("email")), "name": F.lower("full_name"), "domain": F.lower("domain")}
        rows = answers.select("answer_id", *[listed[k].alias(k) for k in keys])
        return rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.min("answer_id").alias(f"by_{name}"))

    by_name = F.when(F.col("linkedin").isNull() & F.col("email").isNull(), F.col("name"))
    keys = asked.select("lead_id", "domain", _dealt(by_name, F.col("lead_id")).alias("name"), _dealt(F.col("linkedin"), F.col("lead_id")).alias("linkedin"), _dealt(F.col("email"), F.col("lead_id")).alias("email"))
    met = keys.join(known("linkedin", "linkedin"), "linkedin", "left").join(known("email", "email"), "email", "left").join(known("name", "name", "domain"), ["name", "domain"], "left")
    rung = F.when(F.col("by_linkedin").isNotNull(), "linkedin").when(F.col("by_email").isNotNull(), "email").when(F.col("by_name").isNotNull(), "name")
    return met.select("lead_id", F.coalesce("by_linkedin", "by_email", "by_name").alias("answer_id"), rung.alias("rung"))


def revealed(leads: DataFrame, answers: DataFrame) -> DataFrame:
    """leads with what a reveal by source_person_id tells: the name is replaced;
    address (with its status, 'guessed' by default), profile and place only fill
    gaps. Of answers to one id the latest by answer_id; extra columns stay."""
    keep = ["full_name", "email", "email_status", "linkedin_url", "location_raw"]
    told = answers.filter("source_person_id is not null").groupBy(F.col("source_person_id").alias("_key")).agg(F.max_by(F.struct(*[given(F.col(c)).alias(c) for c in keep]), "answer_id").alias("_t"))
    new = lambda c: F.col(f"_t.{c}")
    old = lambda c: given(F.col(c))
    changes = {
        "full_name": F.coalesce(new("full_name"), F.col("full_name")), "email": F.coalesce(old("email"), new("email")),
        "email_status": F.when(old("email").isNull() & new("email").isNotNull(), F.coalesce(new("email_status"), F.lit("guessed"))).otherwise(F.col("email_status")),
        "linkedin_url": F.coalesce(old("linkedin_url"), new("linkedin_url")), "location_raw": F.coalesce(old("location_raw"), new("location_raw")),
    }
    return leads.withColumn("_key", _dealt(F.col("source_person_id"), F.col("lead_id"))).join(told, "_key", "left").select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in leads.columns])


def enriched(leads: DataFrame, answers: DataFrame) -> DataFrame:
    """leads with the answer found for them (lead_id, rung, and the answer's
    work_email, work_status, mobile, profile, place, job_title): a verified
    address stays, phone, profile and place fill gaps; job_changed: the titles
    differ, whatever their case; enrichment_status: 'enriched',
    'enrichment_identity_weak' (found by name without a shared word; nothing is
    merged), 'enrichment_skipped' (no answer)."""
    a = leads.join(answers, "lead_id", "left")
    found = F.col("rung").isNotNull()
    weak = found & (F.col("rung") == "name") & ~corroborated(F.col("title_raw"), F.col("job_title"), F.col("location_raw"), F.col("place"))
    use = found & ~weak
    kept = F.coalesce(F.col("email_status") == "verified", F.lit(False)) & given(F.col("email")).isNotNull()
    new_mail = use & ~kept & given(F.col("work_email")).isNotNull()
    fill = lambda c, new: F.when(use, F.coalesce(given(F.col(c)), given(F.col(new)))).otherwise(F.col(c))
    status = F.when(new_mail, F.when(F.col("work_status") == "verified", "verified").otherwise("guessed")).when(use & ~kept & given(F.col("email")).isNotNull(), F.coalesce("email_status", F.lit("guessed"))).otherwise(F.col("email_status"))
    changes = {
        "email": F.when(new_mail, F.col("work_email")).otherwise(F.col("email")), "email_status": status, "phone": fill("phone", "mobile"), "linkedin_url": fill("linkedin_url", "profile"), "location_raw": fill("location_raw", "place"),
        "enrichment_status": F.when(weak, "enrichment_identity_weak").when(use, "enriched").otherwise("enrichment_skipped"),
    }
    moved = F.coalesce(use & given(F.col("job_title")).isNotNull() & (F.lower("job_title") != F.lower("title_raw")), F.lit(False))
    return a.select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in leads.columns], moved.alias("job_changed"))


def within_budget(requests: DataFrame, group: str, order: str, cost: str, ceiling: int) -> DataFrame:
    """requests with admitted: in order, a request is refused if it would exceed
    the group's ceiling, later smaller ones may still pass. Costs are whole; a
    null or negative cost is refused, one of 0 admitted.

    Of requests of one cost c only the first ceiling / c can be admitted, as the sum
    never falls; those few are folded, whatever the group holds.
    """
    by_cost = Window.partitionBy(group, cost).orderBy(order)
    numbered = requests.withColumn("_n", F.row_number().over(by_cost))
    possible = numbered.filter((F.col(cost) > 0) & (F.col("_n") <= ceiling) & (F.col("_n") * F.col(cost) <= ceiling))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda acc, r: F.when(acc["used"] + r["c"] <= ceiling, F.struct((acc["used"] + r["c"]).alias("used"), F.array_append(acc["taken"], r["o"]).alias("taken"))).otherwise(acc)
    folded = possible.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(cost).cast("bigint").alias("c")))).alias("_r")).select(group, F.aggregate("_r", zero, step)["taken"].alias("_taken"))
    taken = folded.select(group, F.explode("_taken").alias(order), F.lit(True).alias("_yes"))
    return requests.join(taken, [group, order], "left").withColumn("admitted", F.coalesce("_yes", F.col(cost) == 0, F.lit(False))).drop("_yes")


def best_text(results: str, keywords: tuple[str, ...]) -> Column:
    """The first text of a list that holds a keyword, else the first; null for an empty list."""
    holds = lambda t: F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.coalesce(F.contains(F.lower(t), k), F.lit(False)))
    return F.coalesce(F.try_element_at(F.filter(results, holds), F.lit(1)), F.try_element_at(F.col(results), F.lit(1)))


def company_context(sections: DataFrame, size: int = 500) -> DataFrame:
    """company_id, summary, funding, hiring, sources of search results per company
    (arrays funding_texts, hiring_texts of the best results in order, and urls):
    the summary is made of the first two texts of either section."""
    first = F.concat(F.slice("funding_texts", 1, 2), F.slice("hiring_texts", 1, 2))
    summary = F.substring(F.array_join(F.filter(first, lambda t: t != ""), " "), 1, size)
    return sections.select("company_id", F.coalesce(F.nullif(summary, F.lit("")), F.lit("No public context found.")).alias("summary"), best_text("funding_texts", rules.FUNDING_WORDS).alias("funding"), best_text("hiring_texts", rules.HIRING_WORDS).alias("hiring"), "urls")


def filled_classes(postings: DataFrame, decisions: DataFrame) -> DataFrame:
    """postings with missing function and seniority taken from the decision of their title (title, function, seniority; the last by seq)."""
    told = decisions.groupBy("title").agg(F.max_by(F.struct("function", "seniority"), "seq").alias("_d"))
    filled = {c: F.coalesce(F.col(c), F.col(f"_d.{c}")) for c in ("function", "seniority")}
    return postings.join(told, "title", "left").select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in postings.columns])


def enrichment_outcome(leads: DataFrame) -> DataFrame:
    """lead_id, outcome, touched of leads (lead_id, matched, attempted, admitted,
    failed, rung, corroborated), the first that holds: passed (no job wants the
    lead), complete (nothing to ask), skipped (no budget, or the provider
    failed), missed (no answer), identity_weak (found by name without a shared
    word), enriched. touched: the try counts as the lead's last one."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    weak = (F.col("rung") == "name") & ~yes("corroborated")
    outcome = F.when(~yes("matched"), "passed").when(~yes("attempted"), "complete").when(~yes("admitted") | yes("failed"), "skipped").when(F.col("rung").isNull(), "missed").when(weak, "identity_weak").otherwise("enriched")
    return leads.select("lead_id", outcome.alias("outcome")).withColumn("touched", F.col("outcome").isin("missed", "identity_weak", "enriched"))
