import json

from leadloom.operators import drift
from leadloom.plans import preparation

SCHEMA = "file_id string, board_id string, file_seq int, line_no int, record string, field string"


def table(spark, files):
    rows = [(f"f{seq}", "b", seq, n, r if isinstance(r, str) or r is None else json.dumps(r), "clash") for seq, records in files.items() for n, r in enumerate(records)]
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r)[1:] for r in drift.schema_changes(table(spark, files)).collect())


def test_renamed_needs_equal_values_of_shared_ids(spark):
    files = {
        1: [{"id": "x", "remote": True, "n": 1}, {"id": "y", "remote": False, "n": 2}, "{bad", None, "[1]"],
        2: [{"id": "x", "isRemote": True, "m": 1}, {"id": "y", "isRemote": False, "m": 3}, {"id": "z", "isRemote": True}],
    }
    assert changes(spark, files) == [(2, "added", "m", ""), (2, "removed", "n", ""), (2, "renamed", "remote", "isRemote")]


def test_types_nulls_and_nested_fields(spark):
    files = {
        1: [{"id": "x", "a": {"b": 1}, "c": None, "d": [1]}],
        3: [{"id": "x", "a": {"b": "1"}, "c": "t", "d": [2]}, {"id": "q", "a": {"b": 2}}],
        4: [{"id": "x", "a": 5, "c": None, "d": []}],
    }
    assert changes(spark, files) == [(3, "type_changed", "a.b", ""), (4, "added", "a", ""), (4, "removed", "a.b", "")]


def test_equal_only_in_content_is_no_rename(spark):
    assert changes(spark, {1: [{"id": "x", "p": 1}], 2: [{"id": "x", "q": "1"}]}) == [(2, "added", "q", ""), (2, "removed", "p", "")]
    assert changes(spark, {1: [{"id": "x", "p": None}], 2: [{"id": "x", "q": None}]}) == [(2, "added", "q", ""), (2, "removed", "p", "")]
    assert drift.schema_changes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_consistent_table_chains_renames(spark):
    files = {1: [{"id": "x", "remote": True, "workplaceType": "remote"}], 2: [{"id": "x", "isRemote": True, "workplaceType": ["remote"]}], 3: [{"id": "x", "remoteOk": True, "workplaceType": "onsite"}]}
    records = table(spark, files)
    got = drift.consistent_table(records, drift.schema_changes(records)).orderBy("file_seq").collect()
    assert [(r.file_seq, r.remote, r.workplace_type) for r in got] == [(1, True, "remote"), (2, True, "remote"), (3, True, "onsite")]


def test_p7_table_holds_every_field(spark, tmp_path):
    # no shared id proves the rename of remote in file 2
    files = {
        1: [{"id": "x", "remote": True, "text": "Ä \"q\"", "owner": {"name": "o"}, "tags": ["a", "b"], "salaryMin": 1.5}],
        2: [{"id": "y", "remoteOk": True, "text": None, "owner": {"name": ["p"]}, "tags": []}],
        3: [{}],
    }
    table(spark, files).write.parquet(str(tmp_path / "board_record.parquet"))
    got = preparation.p7_table(spark, str(tmp_path)).orderBy("file_seq").collect()
    assert [r.remote for r in got] == [True, None, None]
    assert [json.loads(r.fields) for r in got] == [
        {"id": "x", "remote": "true", "text": "Ä \"q\"", "owner.name": "o", "tags": '["a","b"]', "salaryMin": "1.5"},
        {"id": "y", "remoteOk": "true", "text": None, "owner.name": "p", "tags": "[]"},
        {},
    ]


def test_fields_of_one_target_keep_their_values(spark):
    files = {1: [{"id": "x", "remote": True}], 2: [{"id": "x", "isRemote": True}], 3: [{"id": "x", "remote": "no", "isRemote": True, "a.b": 1, "a": {"b": 2}}, {"id": "y", "remote": None, "isRemote": True}]}
    records = table(spark, files)
    got = drift.consistent_table(records, drift.schema_changes(records)).filter("file_seq = 3").orderBy("line_no").collect()
    assert [r.remote for r in got] == [False, True]
    assert [r.fields for r in got] == [{"id": "x", "remote": "no", "isRemote": "true", "a.b": "1", "a.b#2": "2"}, {"id": "y", "remote": "true"}]


def test_migration_steps_are_recorded(spark):
    files = {1: [{"id": "x", "remote": True, "workplaceType": "remote"}, "{bad"], 2: [{"id": "x", "isRemote": True, "workplaceType": ["remote"]}, {"id": "y", "isRemote": "yes"}], 3: [{"id": "z", "isRemote": True}], 4: ["{bad"]}
    records = table(spark, files)
    got = {tuple(r)[1:] for r in drift.migration_steps(records, drift.schema_changes(records)).collect()}
    assert got == {(2, "rename", "isRemote", "remote", ""), (2, "cast", "isRemote", "remote", "boolean,string"), (2, "cast", "workplaceType", "workplaceType", "array"), (3, "rename", "isRemote", "remote", ""), (3, "default", "", "workplaceType", "null")}
    empty = records.limit(0)
    assert drift.migration_steps(empty, drift.schema_changes(empty)).count() == drift.consistent_table(empty, drift.schema_changes(empty)).count() == 0


def test_names_that_come_back_start_anew(spark):
    one = lambda **f: [{"id": "x", **f}]
    files = {1: one(a=1), 2: one(b=1), 3: one(c=1), 4: one(c=1, b=7), 5: one(a=1, b=7), 6: one(b=7)}
    records = table(spark, files)
    spans = {tuple(r)[1:] for r in drift.rename_spans(drift.schema_changes(records)).collect()}
    assert spans == {("b", "a", 2, 3), ("c", "a", 3, 5)}


def test_versions_count_fingerprints(spark):
    files = {1: [{"id": "x", "a": 1}], 2: [{"id": "y", "a": 2}], 3: [{"id": "y", "a": "2"}], 4: [{"id": "y", "a": "3"}]}
    got = sorted((r.file_seq, r.version) for r in drift.file_versions(table(spark, files)).collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 2)]
