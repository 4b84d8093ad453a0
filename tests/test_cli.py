import pytest

from leadloom import __main__ as cli
from leadloom.operators import boards, people
from tests.test_entry import DATA, needs_data


def test_lists_are_appended(spark, tmp_path):
    log = str(tmp_path / "denied")
    for domain in (" Acme.example ", "b.example"):
        cli.main(["denylist-add", domain, "--log", log], spark)
    assert {r.domain for r in spark.read.json(log).collect()} == {"acme.example", "b.example"}
    log = str(tmp_path / "keys")
    cli.main(["suppress-lead", "--email", " A@b.c ", "--log", log], spark)
    cli.main(["suppress-lead", "--name", "Ann Lee", "--domain", "B.c", "--log", log], spark)
    assert {r.contact_key for r in spark.read.json(log).collect()} == {"email:a@b.c", "name:ann lee@b.c"}
    with pytest.raises(SystemExit):
        cli.main(["suppress-lead", "--name", "Ann Lee", "--log", log], spark)


@needs_data
def test_queries_are_shown_and_written(spark, tmp_path, capsys):
    cli.main(["queries"], spark)
    assert "golden_set_accuracy" in capsys.readouterr().out
    cli.main(["metrics", "--data", DATA], spark)
    assert "success_rate" in capsys.readouterr().out
    cli.main(["run", "headcount_tier", "--data", DATA, "--out", str(tmp_path / "t"), "--format", "csv"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 2000
    cli.main(["discover", "--data", DATA, "--out", str(tmp_path / "leads")], spark)
    assert "contactability" in spark.read.option("header", True).csv(str(tmp_path / "leads")).columns


def test_listings_and_details(spark):
    rows = [("c", "a", 0, "success", 2, 4), ("c", "a", 1, "success", 2, 4), ("c", "a", 2, "failed", None, None), ("c", "b", 0, "success", 2, 9), ("c", "b", 1, "failed", None, 9), ("c", "b", 2, "success", 0, 9), ("c", "d", 0, "not_modified", None, None), ("c", "e", 0, "success", 1, 9)]
    got = {r.run_id: (r.pages_read, r.complete) for r in boards.complete_listing(spark.createDataFrame(rows, "company_id string, run_id string, page_no int, status string, listed int, total int")).collect()}
    assert got == {"a": (2, True), "b": (2, False), "d": (1, True), "e": (1, False)}
    postings = spark.createDataFrame([("1", None, "u"), ("2", "old", "u"), ("3", "old", "u"), (None, None, None)], "external_id string, description_raw string, url string")
    details = spark.createDataFrame([("1", '{"postingUrl": "p", "jobAd": {"sections": {"jobDescription": {"text": " Do "}, "qualifications": {"text": "Know"}}}}'), ("2", "{bad"), (None, "{}"), ("1", "")], "external_id string, detail string")
    got = {r.external_id: (r.description_raw, r.url, r.is_hydrated) for r in boards.hydrated(postings, details).collect()}
    assert got == {"1": ("Do\n\nKnow", "p", True), "2": ("old", "u", False), "3": ("old", "u", False), None: (None, None, False)}


def test_enrichment_outcomes(spark):
    rows = [("a", False, True, True, False, "email", True), ("b", True, False, True, False, "email", True), ("c", True, True, False, False, "email", True), ("d", True, True, True, True, "email", True), ("e", True, True, True, None, None, None), ("f", True, True, True, False, "name", False), ("g", True, True, True, False, "name", True), ("h", True, True, True, False, "email", None), ("i", None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "lead_id string, matched boolean, attempted boolean, admitted boolean, failed boolean, rung string, corroborated boolean")
    assert [(r.outcome, r.touched) for r in people.enrichment_outcome(frame).orderBy("lead_id").collect()] == [("passed", False), ("complete", False), ("skipped", False), ("skipped", False), ("missed", True), ("identity_weak", True), ("enriched", True), ("enriched", True), ("passed", False)]
