from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from leadloom.operators import lifecycle

NOW = datetime(2026, 3, 20)
STATE = "board_id string, id string, status string, consecutive_absences int, missing_since timestamp, closed_at timestamp, first_seen_at timestamp, last_seen_at timestamp, title string, seniority string, location_raw string, clash string"
days = lambda n: NOW - timedelta(days=n)


def step(spark, before, observed, held=False):
    old = spark.createDataFrame([("b", *r, "x") for r in before], STATE)
    new = spark.createDataFrame([("b", *r, "x") for r in observed], "board_id string, id string, title string, seniority string, location_raw string, clash string")
    runs = spark.createDataFrame([("b", NOW, held)], "board_id string, observed_at timestamp, held boolean")
    return {r.id: r for r in lifecycle.merge_run(old, new, runs).collect()}


CASES = [  # state before, seen now, status, absences, event
    (None, ("T", None, "L"), "open", 0, "opened"),
    (("open", 0, None), ("T", None, "L"), "open", 0, None),
    (("open", 0, None), ("T2", None, "L"), "open", 0, "updated"),
    (("open", 0, None), ("T", "senior", "L"), "open", 0, "updated"),
    (("missing", 1, 3), ("T2", None, "L"), "open", 0, None),
    (("closed", 2, 9), ("T", None, "L"), "open", 0, "reopened"),
    (("open", 0, None), None, "missing", 1, None),
    (("missing", 1, 6), None, "missing", 2, None),
    (("missing", 1, 7), None, "closed", 2, "closed"),
    (("open", 0, 8), None, "missing", 1, None),
    (("closed", 2, 9), None, "closed", 2, None),
]


def test_every_step_of_the_state(spark):
    before, observed = [], []
    for i, (old, new, *_) in enumerate(CASES):
        if old:
            status, absences, since = old
            before.append((f"p{i:02}", status, absences, days(since) if since else None, days(1) if status == "closed" else None, days(40), days(10), "T", None, "L"))
        if new:
            observed += [(f"p{i:02}", *new)] * 2
    observed.append((None, "T", None, None))
    got = step(spark, before, observed)
    assert [(got[f"p{i:02}"].status, got[f"p{i:02}"].consecutive_absences, got[f"p{i:02}"].event) for i in range(len(CASES))] == [c[2:] for c in CASES]
    assert len(got) == len(CASES)
    assert [(c.field, c.old, c.new) for c in got["p02"].changes] == [("title", "T", "T2")]
    assert (got["p05"].first_seen_at, got["p05"].closed_at, got["p01"].first_seen_at) == (NOW, None, days(40))
    assert (got["p06"].missing_since, got["p08"].closed_at, got["p10"].closed_at, got["p07"].last_seen_at) == (NOW, NOW, days(1), days(10))
    held = step(spark, before, [], held=True)
    assert {(r.status, r.event) for r in held.values()} <= {("open", None), ("missing", None), ("closed", None)} and len(held) == len(before)


def test_empty_sides(spark):
    assert step(spark, [], []) == {}
    assert step(spark, [], [("a", None, None, None)])["a"].event == "opened"


@pytest.mark.parametrize("gap", [1, 2, 7, 8, 9])
def test_closed_form_equals_step_by_step(spark, gap):
    """Runs every three days; a posting is away for some of them."""
    seqs = list(range(1, 14))
    at = {n: datetime(2026, 1, 1) + timedelta(days=3 * n) for n in seqs}
    there = [n for n in seqs if n <= 2 or n > 2 + gap]
    rows = [("c", "b", f"r{n}", n, "p", at[n], "success", i, f"T{n // 5}", "L", at[n]) for n in seqs for i in ("keep", "x") if i == "keep" or n in there]
    snaps = spark.createDataFrame(rows, "company_id string, board_id string, run_id string, run_seq int, source_platform string, run_at timestamp, run_status string, id string, title string, location_raw string, loaded_at timestamp")
    from leadloom.operators.runs import run_ledger

    counted = lifecycle.counted_runs(run_ledger(snaps))
    seen = lifecycle.sightings(snaps, counted, {"title": F.col("title"), "seniority": F.lit(None).cast("string"), "location_raw": F.col("location_raw")})
    lives = lifecycle.history(seen, counted)
    told = sorted((r.n, r.id, r.event) for r in lifecycle.events(lives).collect())
    state, want = [], []
    for n in seqs:
        old = spark.createDataFrame(state, STATE)
        new = spark.createDataFrame([("b", i, f"T{n // 5}", None, "L") for i in ("keep", "x") if i == "keep" or n in there], "board_id string, id string, title string, seniority string, location_raw string")
        runs = spark.createDataFrame([("b", at[n], False)], "board_id string, observed_at timestamp, held boolean")
        got = lifecycle.merge_run(old, new, runs).collect()
        want += [(n, r.id, r.event) for r in got if r.event]
        state = [(r.board_id, r.id, r.status, r.consecutive_absences, r.missing_since, r.closed_at, r.first_seen_at, r.last_seen_at, r.title, r.seniority, r.location_raw, None) for r in got]
    assert told == sorted(want)
    last = {r.id: (r.status, r.consecutive_absences, r.first_seen_at, r.missing_since, r.closed_at) for r in lifecycle.state(lives).collect()}
    assert last == {r[1]: (r[2], r[3], r[6], r[4], r[5]) for r in state}
