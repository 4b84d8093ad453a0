from datetime import datetime, timedelta

from pyspark.sql import functions as F

from leadloom.operators import boards, matching, people, ranking
from leadloom.operators.nested import strict_json

NOW = datetime(2026, 9, 1)
now = lambda: F.lit(NOW)
PERSON = "person_id string, name string, first_name string, last_name string, last_name_obfuscated string, title string, city string, state string, country string, employment_start_date string, place string"


def test_person_to_lead(spark):
    rows = [
        ("1", " Ann Lee ", "x", "y", None, "CTO & Founder", "Lyon", "", "FR", "2026-07-15", "c"), ("2", None, "Bo", None, "Ka***n", "VP Sales", None, None, None, "2019-04", "c"), ("3", "", " ", None, None, "Clerk", None, None, None, None, "c"),
        ("4", "Cy", None, None, None, " ", None, None, None, None, "c"), (None, "Di", None, None, None, "Recruiter", None, None, None, "2030-01-01", "c"), ("6", "Ed", None, None, None, "Clerk", None, None, None, "soon", "c"),
    ]
    got = {r.full_name: r for r in people.person_to_lead(spark.createDataFrame(rows, PERSON), now()).collect()}
    assert set(got) == {"Ann Lee", "Bo Ka***n", "Di", "Ed"}
    assert (got["Ann Lee"].is_founder, got["Ann Lee"].location_raw, got["Ann Lee"].tenure_months) == (True, "Lyon, FR", 2)
    assert (got["Bo Ka***n"].tenure_months, got["Bo Ka***n"].function, got["Bo Ka***n"].confidence) == (89, "sales", 1.0)
    assert (got["Di"].is_recruiter, got["Di"].tenure_months, got["Ed"].tenure_months, got["Ed"].confidence) == (True, 0, None, 0.7)


def test_pages_of_a_search(spark):
    rows = spark.createDataFrame([("a", i) for i in range(60)] + [("b", i) for i in range(3)] + [(None, 1)], "g string, place_ int")
    got = people.retrieved(rows, "g", [F.col("place_")]).groupBy("g", "page").count().collect()
    assert {(r.g, r.page): r["count"] for r in got} == {("a", 0): 25, ("a", 1): 25, ("b", 0): 3}
    cases = [("1", False, None, None, 0, 0), ("2", True, True, None, 0, 0), ("3", True, False, 51, 3, 3), ("4", True, False, None, 50, 9), ("5", True, False, 50, 50, 0), ("6", True, None, 7, 7, 7), ("7", None, None, None, None, None)]
    told = people.retrieval_status(spark.createDataFrame(cases, "group string, admitted boolean, failed boolean, total int, found int, usable int"))
    assert {r["group"]: r.status for r in told.collect()} == {"1": "budget_exhausted", "2": "lead_discovery_failed", "3": "company_identity_suspect", "4": "company_identity_suspect", "5": "no_leads_found", "6": "leads_ok", "7": "budget_exhausted"}


LEAD = "lead_id string, source_person_id string, full_name string, title_raw string, email string, email_status string, phone string, linkedin_url string, location_raw string, domain string, enriched_at timestamp, enrichment_status string"


def test_waterfall_and_merges(spark):
    rows = [
        ("a", "p1", "Ann L***", "Head of Data", None, None, None, "in/a", None, "c", None, None), ("b", "p2", "Bo Kay", "Clerk", "b@c", "verified", " ", None, "Rome", "c", None, None), ("c", None, "Cy Roe", "VP Sales", None, None, None, None, "Oslo, NO", "C", None, None),
        ("d", None, "Di M***n", "Clerk", "", None, None, "", None, "c", None, None), ("e", None, None, None, None, None, None, None, None, None, None, None),
    ]
    leads = spark.createDataFrame(rows, LEAD)
    answers = spark.createDataFrame(
        [(1, "in/a", "z@c", "X", "c"), (2, "in/a", None, "Y", "c"), (3, None, "b@c", "Cy Roe", "x"), (4, None, None, "cy roe", "c"), (5, None, None, "di", "C")], "answer_id int, linkedin_url string, email string, full_name string, domain string"
    )
    found = people.waterfall(leads, answers)
    assert {r.lead_id: (r.answer_id, r.rung) for r in found.collect()} == {"a": (1, "linkedin"), "b": (3, "email"), "c": (4, "name"), "d": (5, "name"), "e": (None, None)}
    told = spark.createDataFrame(
        [(1, "new@c", "verified", "+1", None, "Paris", "head of DATA"), (3, "other@c", "verified", "+3", "in/b", "Bonn", "Boss"), (4, "cy@c", None, None, None, "Oslo", "Chief of Sales"), (5, "di@c", None, "+5", None, None, "Other")],
        "answer_id int, work_email string, work_status string, mobile string, profile string, place string, job_title string",
    )
    got = {r.lead_id: r for r in people.enriched(leads, found.join(told, "answer_id", "left")).collect()}
    assert (got["a"].email, got["a"].email_status, got["a"].phone, got["a"].location_raw, got["a"].job_changed) == ("new@c", "verified", "+1", "Paris", False)
    assert (got["b"].email, got["b"].email_status, got["b"].phone, got["b"].location_raw, got["b"].job_changed) == ("b@c", "verified", "+3", "Rome", True)
    assert (got["c"].email, got["c"].email_status, got["c"].enrichment_status) == ("cy@c", "guessed", "enriched")
    assert (got["d"].email, got["d"].phone, got["d"].enrichment_status) == ("", None, "enrichment_identity_weak")
    assert got["e"].enrichment_status == "enrichment_skipped"
    shown = spark.createDataFrame([(1, "p1", "Old", None, None, None, None), (2, "p1", "Ann Lee", "ann@c", "", "in/x", "Lyon"), (3, "p2", " ", "no@c", "verified", None, "Bonn"), (4, None, "Z", "z", None, None, None)], "answer_id int, source_person_id string, full_name string, email string, email_status string, linkedin_url string, location_raw string")
    got = {r.lead_id: r for r in people.revealed(leads, shown).collect()}
    assert (got["a"].full_name, got["a"].email, got["a"].email_status, got["a"].linkedin_url, got["a"].location_raw) == ("Ann Lee", "ann@c", "guessed", "in/a", "Lyon")
    assert (got["b"].full_name, got["b"].email, got["b"].location_raw, len(got)) == ("Bo Kay", "b@c", "Rome", 5)


def test_budget_equals_a_fold(spark):
    import random

    rng, rows, want = random.Random(3), [], {}
    for group in ("hot", "cold", "one"):
        used = 0
        for i in range(400 if group == "hot" else 7):
            cost = rng.choice([0, 1, 2, 3, 7, 30, None, -2])
            rows.append((i, group, cost, "x"))
            ok = cost == 0 or (cost is not None and cost > 0 and used + cost <= 40)
            used += cost if ok else 0
            want[group, i] = ok
    frame = spark.createDataFrame(rows, "seq long, g string, cost long, _n string").drop("_n")
    got = {(r.g, r.seq): r.admitted for r in people.within_budget(frame, "g", "seq", "cost", 40).collect()}
    assert got == want
    assert people.within_budget(frame.limit(0), "g", "seq", "cost", 40).count() == 0


def test_contexts_and_residue(spark):
    sections = spark.createDataFrame([("a", ["no news", "", "They Raised 5"], ["x"], 4), ("b", [], [], 0), ("c", ["y" * 600], [], 1)], "company_id string, funding_texts array<string>, hiring_texts array<string>, urls int")
    got = {r.company_id: r for r in people.company_context(sections).collect()}
    assert (got["a"].summary, got["a"].funding, got["a"].hiring) == ("no news x", "They Raised 5", "x")
    assert (got["b"].summary, got["b"].funding, len(got["c"].summary)) == ("No public context found.", None, 500)
    rows = spark.createDataFrame([(1, "T", None, "senior"), (2, "U", None, None), (3, None, None, None)], "n int, title string, function string, seniority string")
    told = spark.createDataFrame([("T", "data", "entry", 1), ("T", "sales", "vp", 2)], "title string, function string, seniority string, seq int")
    assert {tuple(r) for r in people.filled_classes(rows, told).collect()} == {(1, "T", "sales", "senior"), (2, "U", None, None), (3, None, None, None)}


def test_ages(spark):
    day = lambda n, s=0: NOW - timedelta(days=n, seconds=s)
    frame = spark.createDataFrame([(day(90, -1),), (day(90),), (None,)], "at timestamp")
    assert [r[0] for r in frame.select(people.stale(F.col("at"), now(), 90)).collect()] == [False, True, True]
    weights = spark.createDataFrame([(day(0),), (day(14),), (day(400),), (day(-5),)], "at timestamp").select(ranking.recency_weight(F.col("at"), now()))
    assert [round(r[0], 9) for r in weights.collect()] == [1.0, 0.5, 0.3, 1.0]


def test_confidence_and_labels(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert round(f(matching.match_confidence(lit(True), lit(False), lit(False), lit(3), lit(True))), 9) == 1.0
    assert round(f(matching.match_confidence(lit(None), lit(True), lit(True), lit(1), lit(None))), 9) == 0.25
    assert [f(matching.match_label(lit(x))) for x in (0.6, 0.59, 0.3, 0.1)] == ["correct_owner", "plausible", "plausible", "wrong"]
    assert f(matching.reporting_line(lit("You report to the Head of Data, who"))) == "Head of Data" and f(matching.reporting_line(lit("Reports: none"))) is None
    score = lambda *a: f(matching.ownership_score(*[lit(x).cast("string") for x in a]))
    assert (score("data", "Senior Head of Data", "head of data"), score("data", "head of data", None), score("sales", "Head of Data", ""), score(None, None, None)) == (1.0, 0.8, 0.0, 0.0)


def test_golden_labels(spark):
    """Cases whose labels follow from the rules by hand."""
    from leadloom.plans.scoring import golden_scores

    rows = [
        (1, 18, ("engineering", "senior"), ("CTO", None, "executive", True, None), "correct_owner"), (2, 18, ("sales", "mid"), ("VP Sales", "sales", "vp", False, False), "correct_owner"), (3, 300, ("engineering", "senior"), ("Head of Ops", "operations", "director", False, None), "wrong"),
        (4, 100, ("data", "senior"), ("Recruiter", "people", "mid", False, True), "plausible"), (5, None, (None, None), (None, None, None, None, None), "wrong"),
    ]
    cases = spark.createDataFrame(rows, "case_id int, headcount int, job struct<function:string,seniority:string>, lead struct<title_raw:string,function:string,seniority:string,is_founder:boolean,is_recruiter:boolean>, expected_label string")
    assert {r.case_id: r.predicted for r in golden_scores(cases).collect()} == {1: "correct_owner", 2: "correct_owner", 3: "wrong", 4: "plausible", 5: "wrong"}


def test_ranks_and_scores(spark):
    matches = spark.createDataFrame([("j", "a", "v", 0.4, 0.9, 1), ("j", "b", "v", 0.5, 0.8, 2), ("k", "c", "v", 0.6, 0.7, 1)], "job_id string, lead_id string, version string, score double, match_confidence double, place int")
    told = spark.createDataFrame([("j", "a", "v", 0.9, 1.0, "old", 1, ["s"], ["s"]), ("j", "a", "v", 0.8, 1.0, "why", 2, ["s"], ["s"]), ("j", "b", "v", 0.9, 1.0, "made up", 1, ["z"], ["s"]), ("k", "c", "w", 0.9, 1.0, "other version", 1, [], ["s"])], "job_id string, lead_id string, version string, relevance double, confidence double, rationale string, seq int, cited array<string>, supplied array<string>")
    got = {r.lead_id: (r.relevance, r.confidence, r.rationale, r.score_source) for r in ranking.scored(matches, told).collect()}
    assert got == {"a": (0.8, 1.0, "why", "llm"), "b": (0.5, 0.8, "", "rules_fallback"), "c": (0.6, 0.7, "", "rules_fallback")}
    feedback = spark.createDataFrame([("j", "a", True), ("j", "b", True), ("k", "c", False), ("x", "y", True)], "job_id string, lead_id string, useful boolean")
    assert tuple(ranking.feedback_agreement(feedback, matches).first()) == (1, 3, 1 / 3)
    assert tuple(ranking.feedback_agreement(feedback.limit(0), matches).first()) == (0, 0, None)
    ties = spark.createDataFrame([("j", "a", "b", 0.0)], "job_id string, first_lead string, second_lead string, gap double")
    choices = spark.createDataFrame([("j", "b"), ("j", "z"), ("k", "a")], "job_id string, lead_id string")
    assert [tuple(r) for r in ranking.chosen_of_two(ties, choices).collect()] == [("j", "b")]
    shown = spark.createDataFrame([("u", "g1", "x", 1), ("u", "g2", "x", 2), ("u", "g3", "y", 3), ("v", "g4", "z", 1)], "key string, gtm_id string, lead_key string, generated_at int")
    assert [tuple(r) for r in ranking.superseded(shown).collect()] == [("u", "g3", "x")]


def test_details_of_odd_items(spark):
    items = [("greenhouse", '{"location": {"name": 5}}'), ("ashby", '{"location": "", "secondaryLocations": "x", "isRemote": "yes"}'), ("jsonld", '{"jobLocation": [], "baseSalary": {"value": {"minValue": "a"}}}'), ("lever", "7"), (None, "{}"), ("lever", None)]
    frame = spark.createDataFrame([(p, t, NOW, True) for p, t in items], "platform string, text string, fetched_at timestamp, is_hydrated boolean").withColumn("item", F.expr(strict_json("text")))
    got = boards.posting_details(frame.withColumn("about", F.lit("a Hybrid role")), "about").collect()
    assert [(r.location_raw, r.places, r.pay, r.posted_inferred, r.workplace_type) for r in got[:3]] == [(None, [], None, True, "hybrid")] * 3
    assert [r.extraction_confidence for r in got] == [1.0, 1.0, 1.0, 0.0, 1.0, 0.0]
