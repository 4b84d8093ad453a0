import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from leadloom.functions import postings as P
from leadloom.operators import boards, matching, runs, tables, web
from leadloom.sources import files
from leadloom.streaming import changes

T0 = datetime(2026, 1, 1)


def one(spark, value, fn, *more):
    df = spark.createDataFrame([(value, *more)], "v string" + "".join(f", m{i} string" for i in range(len(more))))
    return df.select(fn(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("sr. backend engineer (Remote US)", "Senior backend engineer"), ("BACKEND ENGINEER", "Backend Engineer"), ("co-founder/ceo", "Co-Founder / Ceo"),
        ("🚀 Data Analyst REQ-12345", "Data Analyst"), ("Mgr ,Ops", "Manager, Ops"), ("", ""), (None, None), ("Growth  PM", "Growth PM"),
    ],
)
def test_canonical_title(spark, raw, want):
    assert one(spark, raw, P.canonical_title) == want


def test_classes_and_keys(spark):
    assert one(spark, "Director of Sales", P.seniority_class) == "executive"  # "director" holds "cto"
    assert one(spark, "Data Engineer", P.function_class, None) == "engineering"
    assert one(spark, "Clerk", P.function_class, "Legal") == "legal"
    assert one(spark, None, P.function_class, None) is None
    assert one(spark, " On-Site ", P.workplace_type) == "onsite"
    assert one(spark, "c", P.job_key, "lever", " ", "http://x", "t", "d").startswith("c:url:")
    assert one(spark, "c", P.job_key, "lever", "7", None, "t", "d") == "c:lever:7"
    assert one(spark, "c", P.job_key, "lever", "", None, None, None).startswith("c:hash:")
    assert one(spark, " A@B.c ", P.contact_key, "n", "d") == "email:a@b.c"
    assert one(spark, "", P.contact_key, " N ", "D.x") == "name:n@d.x"


def test_latest_anti_and_top(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, None), (None, 9, "n")], "k string, n int, _v string")
    assert {tuple(r) for r in tables.latest_per_key(log, ["k"], "n").collect()} == {("a", 3, "z"), ("b", 1, None)}
    listed = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert {r.k for r in tables.without(log, F.col("k"), listed, F.col("k")).collect()} == {"b", None}
    assert [(r.k, r.n) for r in tables.top_rows(log.filter("k = 'a'"), ["k"], [F.desc("n")], 2).orderBy("place").collect()] == [("a", 3), ("a", 2)]
    assert tables.keyed_scan(log, k="a", n=None).count() == 3
    assert tables.latest_per_key(log.limit(0), ["k"], "n").count() == 0


def test_top_matches_equal_all_pairs(spark):
    rng = random.Random(3)
    functions = ["engineering", "data", "sales", "design", None]
    levels = ["senior", "manager", "director", "entry", None]
    companies = spark.createDataFrame([("c1", 12, None), ("c2", None, "series_a"), ("c3", 400, None)], "id string, headcount int, funding_stage string")
    jobs = spark.createDataFrame([(rng.choice(["c1", "c2", "c3", None]), f"j{i}", rng.choice(functions), rng.choice(levels), rng.choice(["Paris", None])) for i in range(40)], "company_id string, job_id string, function string, seniority string, location_raw string")
    leads = spark.createDataFrame(
        [(rng.choice(["c1", "c2"]), f"l{i:03}", rng.choice(["Head of Data", "Clerk"]), rng.choice(functions), rng.choice(levels), rng.random() < 0.1, rng.random() < 0.2, rng.choice(["Paris, FR", "Rome", None]), rng.choice([1, 50, None])) for i in range(120)],
        "company_id string, lead_id string, title_raw string, function string, seniority string, is_founder boolean, is_recruiter boolean, location_raw string, tenure_months int",
    )
    got = {(r.job_id, r.place): (r.lead_id, round(r.score, 9)) for r in matching.match_top_k(jobs, leads, companies).collect()}
    j, l = jobs.alias("j"), leads.alias("l")
    tier = matching.size_tier(F.col("headcount"), F.col("funding_stage"))
    score = matching.combined_score(
        matching.function_score(F.col("j.function"), F.col("l.function"), F.col("is_founder"), F.col("is_recruiter")), matching.seniority_score(F.col("j.seniority"), F.col("l.seniority"), tier["penalty"]),
        F.when((F.col("j.function") == "data") & (F.col("title_raw") == "Head of Data"), 0.8).otherwise(0.0), F.when(F.col("l.location_raw").contains("Paris") & (F.col("j.location_raw") == "Paris"), 0.3).otherwise(0.0),
        F.when(F.col("is_founder"), tier["founder_bonus"]).otherwise(0.0), F.col("is_recruiter"), F.coalesce("tenure_months", F.lit(99)) < 3,
    )
    pairs = j.join(l, F.col("j.company_id") == F.col("l.company_id")).join(companies, F.col("j.company_id") == F.col("id")).select("job_id", "lead_id", score.alias("score")).filter("score >= 0.3")
    want = {(r.job_id, r.place): (r.lead_id, round(r.score, 9)) for r in tables.top_rows(pairs, ["job_id"], [F.desc("score"), F.col("lead_id")], 3).collect()}
    assert got == want and got
    swapped = matching.swap_first_two(matching.match_top_k(jobs, leads, companies), spark.createDataFrame([(k[0], v[0]) for k, v in got.items() if k[1] == 2][:1], "job_id string, lead_id string"))
    assert swapped.count() == len(got)


def test_runs(spark):
    rows = [("c", "b", f"r{s}", s, "lever", T0.replace(day=s), status, i) for s, status, ids in ((1, "success", ["a", "A "]), (2, "success", [None]), (3, "blocked_403", [None]), (4, "success", ["x"])) for i in ids]
    ledger = runs.run_ledger(spark.createDataFrame(rows, "company_id string, board_id string, run_id string, run_seq int, source_platform string, run_at timestamp, run_status string, id string"))
    assert {(r.run_seq, r.jobs_found) for r in ledger.collect()} == {(1, 1), (2, 0), (3, 0), (4, 1)}
    assert {(r.run_seq, r.first_success, r.suspicious) for r in runs.run_decisions(ledger).collect()} == {(1, True, False), (2, False, True), (3, False, False), (4, False, False)}
    assert {(r.run_seq, r.reasons) for r in runs.drift_reasons(ledger).collect()} == {(2, "emptied"), (3, "became_unhealthy")}
    row = runs.coverage(ledger).first()
    assert (row.attempted, row.success_rate, row.degraded_rate, row.companies, row.resolved, row.board_coverage, row.unscraped, row.empty) == (4, 0.75, 0.0, 1, 1, 1.0, 0, 0)
    assert runs.coverage(ledger.limit(0)).first().success_rate is None


HTML = """<html><head><meta property="og:description" content="We hire"><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "A", "identifier": {"value": "7"}}, {"@type": "Org"}]}</script>
<script type="application/ld+json">{bad</script></head><body><nav><a href="#">x</a><a href="/careers">Careers</a></nav><ul class="b a"><li class="job"><a href="/jobs/dev-one">Dev &amp; Ops</a></li><li class="job"><a href="/jobs/dev-two">Two</a></li>
<li class="job"><a href="/jobs/dev-two#x">Two</a></li></ul><p><a href="/jobs/apply-now">Apply</a></p><a href="/careers/icon-x.svg">i</a><script src="https://cdn.lever.co/x.js"></script>text</body>"""


def test_pages(spark):
    pages = spark.createDataFrame([(1, "https://a.example/x", HTML), (2, "https://jobs.lever.co/acme", None), (3, "https://b.example", "<a href='/jobs/abc")], "page_id long, url string, html string")
    read = web.read_pages(pages)
    assert web.best_anchor(read).collect()[0].link == "https://a.example/careers"
    assert {r.link for r in web.job_links(read).filter("page_id = 1").collect()} == {"https://a.example/jobs/dev-one", "https://a.example/jobs/dev-two", "https://a.example/jobs/dev-two#x"}
    assert [(r.title, r.external_id) for r in web.jsonld_postings(read).collect()] == [("A", "7")]
    assert {r.page_id: r.route for r in web.route(read).collect()} == {1: "lever", 2: "lever", 3: "generic_html"}
    assert {r.page_id: r.valid for r in web.is_careers_page(read).collect()} == {1: True, 2: False, 3: False}
    assert one(spark, "lever", web.board_token, "https://jobs.lever.co/acme/1") == "acme"
    assert one(spark, "workable", web.board_token, "https://apply.workable.com/j/1") is None
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private")], "host string, text string")
    urls = spark.createDataFrame([("https://a.example/private/1",), ("https://a.example/ok",), ("https://z.example/private",)], "url string")
    assert {r.url: r.allowed for r in web.allowed_by_robots(urls, robots).collect()} == {"https://a.example/private/1": False, "https://a.example/ok": True, "https://z.example/private": True}
    steps = spark.createDataFrame([("c", "u1", "path", True), ("c", "u0", "homepage_own", False), ("d", "u", "search_open", True), ("e", "u", "manual", None), ("f", "u", "guess", True)], "company_id string, url string, strategy string, validated boolean")
    assert {r.company_id: (r.url, r.status, r.confidence) for r in web.resolved_source(steps).collect()} == {"c": ("u0", "resolution_unvalidated", 0.85), "d": ("u", "needs_review", 0.4), "e": ("u", "resolved", 1.0)}


def test_fingerprints_from_the_surest_on(spark):
    none = (None, [], [])
    rows = [
        (1, "https://jobs.lever.co/acme", "<script src='https://embed.ashbyhq.com/z'></script>", *none), (2, "https://a.example", "", "https://acme.recruitee.com/o", [], []), (3, "https://a.example", "<iframe src='https://boards.greenhouse.io/embed/job_board?for=acme'></iframe>", *none),
        (4, "https://a.example", "", None, ["https://x.example", "https://ats.rippling.com/acme/j"], []), (5, "https://a.example", "<div class='x lever-jobs-list'>", *none), (6, "https://a.example", "", None, [], ["cdn.example", "Jobs.Ashbyhq.com"]), (7, "https://a.example", "<p>", *none), (8, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, final_url string, requests array<string>, aliases array<string>")
    read = web.read_pages(frame).join(frame.select("page_id", "final_url", "requests", "aliases"), "page_id")
    got = {r.page_id: (r.platform, r.token, r.signal) for r in web.fingerprint(read).collect()}
    assert got == {1: ("lever", "acme", "url_host"), 2: ("recruitee", "acme", "redirect"), 3: ("greenhouse", "acme", "embed"), 4: ("rippling", "acme", "network"), 5: ("lever", None, "dom"), 6: ("ashby", None, "cname"), 7: (None, None, None), 8: (None, None, None)}


def test_rendered_pages_have_no_job_links(spark):
    pages = [(1, "https://a.example", "<!--$--><p>x</p>"), (2, "https://a.example", "<div id='__next'><a href='/jobs/abc'>A</a></div>"), (3, "https://a.example", "<script type='application/ld+json'>{\"@type\": \"JobPosting\"}</script><div id=app>"), (4, "https://a.example", "<div class='app'>")]
    read = web.read_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r.page_id: r.route for r in web.route(read).collect()} == {1: "rendered_dom", 2: "generic_html", 3: "jsonld", 4: "generic_html"}


def test_title_and_place_of_job_links(spark):
    html = "<div><p><a href='/jobs/one'><b>One</b> <i class=office>Lyon</i></a></p><p><a href='/jobs/two'>Two</a><span>Remote, EU</span></p><ul><li class=c><a href='/jobs/three'>Three</a><em>Rome, IT</em><a href='/x'>more</a></li></ul></div>"
    read = web.read_pages(spark.createDataFrame([(1, "https://a.example", html)], "page_id long, url string, html string"))
    got = [(a.title, a.place) for a in read.first().anchors if "/jobs/" in a.href]
    assert got == [("One", "Lyon"), ("Two", "Remote, EU"), ("Three", None)]


def test_fetches_and_searches(spark):
    tries = [("a", 1, 503), ("a", 2, 200), ("b", 1, 404), ("c", 1, None), ("c", 2, 429), ("d", 1, 403), ("e", 5, 200), ("e", 4, 500), ("f", 1, 304)]
    got = {r.url: (r.attempts, r.status_code, r.outcome) for r in web.fetch_outcome(spark.createDataFrame(tries, "url string, attempt int, status_code int")).collect()}
    assert got == {"a": (2, 200, "ok"), "b": (1, 404, "missing"), "c": (2, 429, "unavailable"), "d": (1, 403, "denied"), "e": (4, 500, "unavailable"), "f": (1, 304, "not_modified")}
    found = [("c", "c.example", True, 1, "https://any.example/p"), ("c", "c.example", False, 0, "https://c.example"), ("d", "d.example", True, 0, ""), ("d", "d.example", False, 0, "https://notd.example"), ("d", "d.example", False, 1, "https://jobs.lever.co/d"), ("e", "e.example", False, 0, None)]
    best = web.search_candidates(spark.createDataFrame(found, "company_id string, domain string, restricted boolean, pos int, url string"))
    assert {tuple(r) for r in best.collect()} == {("c", "https://any.example/p", "search_restricted"), ("d", "https://jobs.lever.co/d", "search_open")}


def test_path_candidates(spark):
    sites = spark.createDataFrame([("c", "https://c.example/"), ("d", "https://d.example"), ("e", "https://e.example")], "company_id string, url string")
    rows = [("https://c.example/careers", 404, 200, True), ("https://c.example/jobs", 405, 200, True), ("https://c.example/join", 200, 200, True), ("https://d.example/careers", 200, 200, False), ("https://d.example/en/careers", 200, 204, True), ("https://e.example/jobs", 200, 500, True)]
    fetched = spark.createDataFrame(rows, "url string, head_code int, code int, is_careers boolean")
    assert {tuple(r) for r in web.path_candidates(sites, fetched).collect()} == {("c", "https://c.example/jobs"), ("d", "https://d.example/en/careers")}


def test_boards(spark):
    page = '{"jobs": [{"id": 5, "title": "sr eng", "absolute_url": "u", "departments": [{"name": "R&D"}], "location": {"name": "Remote / Oslo"}}, 3]}'
    pages = spark.createDataFrame([(1, "c", "r", "greenhouse", 200, 0, page), (2, "c", "r", "greenhouse", 503, 1, None), (3, "d", "r", "lever", 304, 0, None)], "page_id long, company_id string, run_id string, source_platform string, status_code int, page_no int, payload string")
    got = boards.normalized_postings(pages).collect()
    assert [(r.job_id, r.title, r.function, r.seniority, [tuple(p) for p in r.places]) for r in got] == [("c:greenhouse:5", "Senior Engineer", "engineering", "senior", [("Remote / Oslo", True)])]
    assert {r.company_id: r.status for r in boards.complete_sweeps(pages).collect()} == {"c": "schema_violation", "d": "success"}


def test_boards_workplace_and_all_places(spark):
    lever = '[{"id": "a", "workplaceType": " Hybrid", "categories": {"location": "Oslo", "allLocations": ["Oslo", "Bergen", "", null, "Remote"]}}, {"id": "b", "workplaceType": "unspecified", "categories": {"location": "Oslo / Rome", "allLocations": []}}]'
    ashby = '{"jobs": [{"id": "c", "workplaceType": "Remote", "location": "Oslo", "secondaryLocations": ["Kyiv", {"location": "Lima"}, {"other": 1}, "Oslo"]}, {"id": "d", "location": null, "secondaryLocations": ["Rome"]}, {"id": "e", "workplaceType": "On-Site"}]}'
    pages = spark.createDataFrame([(1, "c", "lever", 200, lever), (2, "c", "ashby", 200, ashby)], "page_id long, company_id string, source_platform string, status_code int, payload string")
    raw = {r.external_id: r.workplace_raw for r in boards.board_postings(pages).collect()}
    assert raw == {"a": " Hybrid", "b": "unspecified", "c": "Remote", "d": None, "e": "On-Site"}
    got = {r.job_id[-1]: (r.workplace_type, r.places and [tuple(p) for p in r.places]) for r in boards.normalized_postings(pages).collect()}
    assert got == {
        "a": ("hybrid", [("Oslo", False), ("Bergen", False), ("Remote", True)]),
        "b": (None, [("Oslo / Rome", False)]),
        "c": ("remote", [("Oslo", False), ("Kyiv", False), ("Lima", False)]),
        "d": (None, [("Rome", False)]),
        "e": ("onsite", None),
    }


def test_logs_and_export(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "k string, v int"
    assert files.read_log(spark, path, schema).count() == 0
    rows = spark.createDataFrame([("a", 1), ("b", None)], schema)
    files.append_log(rows, path)
    files.append_log(rows, path)
    assert files.read_log(spark, path, schema).count() == 4
    (tmp_path / "bad.json").write_text('{"k": "a"}\n{nope\n')
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        files.read_log(spark, str(tmp_path / "bad.json"), schema).collect()
    nested = spark.sql("select 'x' as a, named_struct('b', 1.23456D, 'c', cast(null as string)) as s, array(1) as l, timestamp'2026-01-02 03:04:05' as t")
    assert tuple(files.csv_rows(nested).first()) == ("x", "1.235", "", "[1]", "2026-01-02T03:04:05Z")
    files.write_csv(nested, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().s_b == "1.235"
    files.archive_payloads(spark.createDataFrame([("c", "r", 1, "{}")], "company_id string, run_id string, page_id long, payload string"), str(tmp_path / "raw"))
    assert spark.read.json(str(tmp_path / "raw")).first().payload == "{}"


def test_streams_equal_batches(spark, tmp_path):
    schema = "board_id string, run_seq int, run_status string, id string, title string, updated_at string, loaded_at timestamp"
    rows = [("b", s, "success", i, "t", "2026-01-01T00:00:00Z", T0) for s, ids in ((1, "ab"), (2, "bc"), (3, "c")) for i in ids]
    whole = spark.createDataFrame(rows, schema)
    for s in (1, 2, 3):
        whole.filter(f"run_seq = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        changes.follow_snapshots(arriving, str(tmp_path / "runs"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.run_seq, r.id, r.change) for r in changes.current_changes(spark, str(tmp_path / "out")).collect()}
    assert got == {(2, "a", "removed"), (2, "c", "added"), (3, "b", "removed")}
    for s in (1, 3, 2):  # run 2 is late: what changed in run 3 is told anew
        whole.filter(f"run_seq = {s}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
        arriving = spark.readStream.schema(schema).parquet(str(tmp_path / "in2"))
        changes.follow_snapshots(arriving, str(tmp_path / "runs2"), str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert {(r.run_seq, r.id, r.change) for r in changes.current_changes(spark, str(tmp_path / "out2")).collect()} == got
    events = spark.createDataFrame([(T0, "x", 1.0), (T0.replace(minute=59), "x", 2.0), (T0.replace(hour=1), "x", 4.0)], "ts timestamp, event_type string, value double")
    assert sorted((r.n, r.total) for r in changes.windowed_counts(events).collect()) == [(1, 4.0), (2, 3.0)]


def test_embedded_and_captured_lists(spark):
    data = '{"props": {"pageProps": {"dehydratedState": {"queries": [{"queryKey": ["a", "b", "job-posts"], "state": {"data": {"items": [{"id": 1, "name": "Dev", "url": "u"}]}}}, {"queryKey": []}]}}}}'
    html = f"<script id='__NEXT_DATA__' type='application/json'>{data}</script>"
    site = "<urlset><url><loc> https://a.example/about </loc></url><url><loc>https://a.example/careers</loc></url><url><loc>https://a.example/jobs</loc></url></urlset>"
    read = web.read_pages(spark.createDataFrame([(1, "https://a.example", html), (2, "https://a.example/sitemap.xml", site)], "page_id long, url string, html string"))
    assert [tuple(r) for r in web.next_data_postings(read).collect()] == [(1, 0, "1", "Dev", "u")]
    assert [tuple(r) for r in web.sitemap_candidates(read).collect()] == [(2, "https://a.example/careers")]
    bodies = [(1, 0, '{"user": 1}'), (1, 1, '{"results": [{"title": "A", "url": "x"}, {"n": 1}]}'), (1, 2, '[{"title": "B"}]'), (2, 0, "not json"), (2, 1, '[{"a": 1}, {"b": 2}, {"title": "C"}, {}]')]
    got = web.captured_postings(spark.createDataFrame(bodies, "page_id long, pos int, body string")).collect()
    assert sorted((r.page_id, r.item_pos, r.title, r.url) for r in got) == [(1, 0, "A", "x"), (1, 1, None, None)]


def test_last_known_and_first_with_word(spark):
    log = spark.createDataFrame([("a", 1, "x", None), ("a", 2, None, "p"), ("a", 3, None, None), (None, 4, "z", "z")], "k string, n int, e string, f string")
    assert [tuple(r) for r in tables.last_known(log, ["k"], "n", ["e", "f"]).collect()] == [("a", "x", "p")]
    docs = spark.createDataFrame([("c", 1, "no"), ("c", 2, "We are Hiring"), ("d", 5, None)], "c string, n int, t string")
    assert {tuple(r) for r in tables.first_with_word(docs, ["c"], "t", "hiring", "n").collect()} == {("c", 2, True), ("d", 5, False)}
