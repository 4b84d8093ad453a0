from datetime import datetime

from leadloom.operators import snapshots

SCHEMA = "board_id string, run_seq int, run_status string, id string, title string, updated_at string, loaded_at timestamp, change string, prev_seq int"
T0 = datetime(2026, 1, 1)


def changes(spark, *rows):
    df = spark.createDataFrame([("b", *r, T0, "clash", 9) for r in rows], SCHEMA)
    return sorted((r.run_seq, r.id, r.change) for r in snapshots.snapshot_changes(df).collect())


def test_added_removed_changed_and_failed_runs(spark):
    u1, u2 = "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"
    got = changes(
        spark,
        (1, "success", "A", "Dev", u1), (1, "success", "B", "Ops", u1),
        (2, "blocked_403", None, None, None),
        (3, "success", " a ", "Dev", "2026-01-01T01:00:00+01:00"), (3, "success", "c", "QA", u1),
        (5, "success", "a", "Dev II", u1), (5, "success", "C", "QA", u2), (5, "success", "b", "Ops", u1),
    )
    assert got == [(3, "b", "removed"), (3, "c", "added"), (5, "a", "changed"), (5, "b", "added"), (5, "c", "changed")]


def test_cosmetic_differences_and_nulls_are_none(spark):
    got = changes(
        spark,
        (1, "success", "a", "R&amp;D  Lead", "2026-01-01T00:00:00-0500"), (1, "success", "b", None, None), (1, "success", "c", "Café", "x"),
        (2, "success", "a", " R&D Lead", "2026-01-01T05:00:00.000+00:00"), (2, "success", "b", "T", "2026-01-01T05:00:00Z"), (2, "success", "c", "Café", None),
    )
    assert got == []


def test_repeated_ids_take_the_latest_copy(spark):
    got = changes(
        spark,
        (1, "success", "a", "Old", "2026-01-01T00:00:00Z"), (1, "success", "A", "New", "2026-01-02T00:00:00Z"), (1, "success", "a", "Older", None),
        (2, "success", "a", "New", "2026-01-02T00:00:00Z"), (2, "success", "a", "New", "2026-01-02T00:00:00Z"),
    )
    assert got == []


def test_empty_run_removes_all_and_empty_table(spark):
    got = changes(spark, (1, "success", "a", "x", None), (2, "success", None, None, None), (3, "success", "a", "x", None))
    assert got == [(2, "a", "removed"), (3, "a", "added")]
    assert snapshots.snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
