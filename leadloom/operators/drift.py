"""Schemas that drift between the files of a board.

Every file gets a versioned fingerprint of its fields and their JSON types.
Only files whose fingerprint differs from that of the file before are compared;
a gone and a new field with equal values for all shared ids are one renamed
field. The recorded steps, chained along the versions, route each record of any
file into one consistent table by rename, default and cast.

Records are read as VARIANT; the expressions are SQL text, as in ``nested``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.operators.nested import is_object, let, strict_json
from leadloom.session import cut

#: JSON types as bits of a set
TYPE_BITS = {"boolean": 1, "number": 2, "string": 4, "array": 8}
#: columns of the consistent table that stand for a field, with the type they are cast to
COLUMNS = {"workplaceType": "string", "remote": "boolean"}
#: Texts read as true and as false
TRUE_TEXTS, FALSE_TEXTS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
#: a record nests no deeper than it has braces
_LEVELS = r"regexp_count(record, r'\{')"


def leaves(v: str) -> str:
    """field, depth and value of every value of the object v that is no object:
    dot-joined paths; an empty object has none."""
    rows = "transform(map_entries(try_variant_get(e.value, '$', 'map<string,variant>')), k -> struct(concat_ws('.', e.field, k.key) as field, e.depth + 1 as depth, k.value as value))"
    return f"aggregate(array_repeat(0, {_LEVELS}), array(struct(cast(null as string) as field, 0 as depth, {v} as value)), (acc, level) -> flatten(transform(acc, e -> coalesce({rows}, array(e)))))"


def of_record(body: str) -> str:
    """An expression over e, an element of the leaves of each readable record
    (one complete JSON object), as an array; null for others."""
    return let(strict_json("record"), lambda v: f"case when {is_object(v)} then {body.format(v=v, leaves=leaves(v))} end")


def type_bit(v: str) -> str:
    """The bit of a value's JSON type, 0 for null; the first letters of its SQL type tell it."""
    return f"coalesce(try_element_at(map('VO', 0, 'BO', 1, 'ST', 4, 'AR', 8), left(schema_of_variant({v}), 2)), 2)"


def content(v: str) -> str:
    """A value with its type as text, equal for equal content: 1 and 1.0 are one number, 1 and "1" differ; null for null."""
    kind = f"schema_of_variant({v})"
    return f"case when {kind} = 'VOID' then null when {kind} = 'DOUBLE' then regexp_replace(to_json({v}), '[.]0+$', '') else to_json({v}) end"


def _rows(records: DataFrame) -> DataFrame:
    """The records; of keys given twice in an object the last counts."""
    records.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return records.withColumn("file_seq", F.col("file_seq").cast("bigint")).filter(F.col("board_id").isNotNull() & F.col("file_seq").isNotNull())


def file_fields(records: DataFrame) -> DataFrame:
    """board_id, file_seq, field, types: the fields of each file (all deliveries
    of a file_seq together) with the bit set of the JSON types of their
    non-null values. Unreadable lines and null records count for nothing."""
    found = of_record(f"transform({{leaves}}, e -> struct(e.field as field, {type_bit('e.value')} as types))")
    return _rows(records).select("board_id", "file_seq", F.expr(f"inline({found})")).groupBy("board_id", "file_seq", "field").agg(F.bit_or("types").alias("types"))


def file_versions(records: DataFrame) -> DataFrame:
    """One row per file with its schema and that of the file before it: board_id,
    file_seq, before_seq, schema and before (map field -> types), fingerprint and
    version (the number of fingerprints of the board so far, neighbours alike counted once)."""
    entry = F.struct("field", "types")
    files = file_fields(records).groupBy("board_id", "file_seq").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("schema"))
    files = files.withColumn("fingerprint", F.xxhash64(F.map_entries("schema")))
    by_board = Window.partitionBy("board_id").orderBy("file_seq")
    seen = files.select("*", *[F.lag(c).over(by_board).alias(n) for c, n in (("file_seq", "before_seq"), ("schema", "before"), ("fingerprint", "before_print"))])
    changed = F.when(F.col("before_print").eqNullSafe(F.col("fingerprint")), 0).otherwise(1)
    return seen.withColumn("version", F.sum(changed).over(by_board.rowsBetween(Window.unboundedPreceding, 0)))


def _missing(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b)))


def renamed_fields(records: DataFrame, versions: DataFrame) -> DataFrame:
    """board_id, file_seq, field, new_field: pairs of a gone and a new field
    whose values are equal in type and content for all ids (one or more) that
    have both in the neighbouring files. Only records of files with gone and
    new fields are read again, and of them only those fields. If several pairs
    share a field, the pair with the most shared ids stays, then the first by name."""
    moved = versions.select("board_id", "file_seq", "before_seq", _missing(F.col("before"), F.col("schema")).alias("gone"), _missing(F.col("schema"), F.col("before")).alias("new"))
    moved = moved.filter((F.size("gone") > 0) & (F.size("new") > 0))
    sides = moved.select(
        "board_id",
        F.col("file_seq").alias("pair_seq"),
        F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("before_seq").alias("file_seq"), F.col("gone").alias("fields")), F.struct(F.lit(1).alias("side"), F.col("file_seq").alias("file_seq"), F.col("new").alias("fields")))),
    )
    rows = _rows(records).select("board_id", "file_seq", "record").join(sides, ["board_id", "file_seq"])
    record_id = let("try_variant_get({v}, '$.id', 'variant')", lambda x: content(x))
    found = of_record(let(record_id, lambda i: f"case when {i} is not null then transform(filter({{leaves}}, e -> array_contains(fields, e.field)), e -> struct({i} as record_id, e.field as field, {content('e.value')} as content)) end"))
    values = rows.select("board_id", "pair_seq", "side", F.expr(f"inline({found})")).filter(F.col("content").isNotNull())
    # an id given more than once has one content only if all its copies agree
    each = values.groupBy("board_id", "pair_seq", "record_id", "side", "field").agg(F.min("content").alias("low"), F.max("content").alias("high"))
    one = F.struct("field", "low", "high")
    both = each.groupBy("board_id", "pair_seq", "record_id").agg(
        F.collect_list(F.when(F.col("side") == 0, one)).alias("olds"), F.collect_list(F.when(F.col("side") == 1, one)).alias("news")
    )
    pairs = F.flatten(
        F.transform(
            "olds",
            lambda o: F.transform(
                F.col("news"),
                lambda n: F.struct(o["field"].alias("field"), n["field"].alias("new_field"), ((o["low"] == n["low"]) & (o["high"] == n["high"]) & (o["low"] == o["high"])).alias("same")),
            ),
        )
    )
    judged = both.select("board_id", "pair_seq", F.inline(pairs)).groupBy("board_id", "pair_seq", "field", "new_field").agg(F.every("same").alias("same"), F.count("*").alias("shared"))
    equal = judged.filter("same")
    best = (F.col("shared").desc(), F.col("field"), F.col("new_field"))
    by_old = Window.partitionBy("board_id", "pair_seq", "field").orderBy(*best)
    by_new = Window.partitionBy("board_id", "pair_seq", "new_field").orderBy(*best)
    ranked = equal.select("*", F.row_number().over(by_old).alias("o"), F.row_number().over(by_new).alias("n"))
    return ranked.filter("o = 1 and n = 1").select("board_id", F.col("pair_seq").alias("file_seq"), "field", "new_field")


def schema_changes(records: DataFrame) -> DataFrame:
    """board_id, file_seq, change, field, new_field: each difference of a file's
    schema from the board's file before it: 'renamed', 'removed', 'added',
    'type_changed' (the sets of JSON types of the non-null values differ, both
    non-empty). new_field is '' unless renamed. The first file of a board and
    empty tables have no changes; extra columns are ignored."""
    versions = file_versions(records).filter(F.col("before").isNotNull() & (F.col("fingerprint") != F.col("before_print")))
    versions = cut(versions)  # a row per file of another schema than the file before, used twice
    renamed = renamed_fields(records, versions)
    named = renamed.groupBy("board_id", "file_seq").agg(F.collect_list(F.struct("field", "new_field")).alias("renames"))
    told = versions.join(named, ["board_id", "file_seq"], "left").withColumn("renames", F.coalesce("renames", F.array().cast("array<struct<field:string,new_field:string>>")))

    def case(change: str, field: Column, new_field: Column | None = None) -> Column:
        return F.struct(F.lit(change).alias("change"), field.alias("field"), (F.lit("") if new_field is None else new_field).alias("new_field"))

    old_names, new_names = F.transform("renames", lambda r: r["field"]), F.transform("renames", lambda r: r["new_field"])
    kept = F.array_intersect(F.map_keys("schema"), F.map_keys("before"))
    types = F.filter(kept, lambda f: (F.col("schema")[f] != F.col("before")[f]) & (F.col("schema")[f] != 0) & (F.col("before")[f] != 0))
    cases = F.concat(
        F.transform("renames", lambda r: case("renamed", r["field"], r["new_field"])),
        F.transform(F.array_except(_missing(F.col("before"), F.col("schema")), old_names), lambda f: case("removed", f)),
        F.transform(F.array_except(_missing(F.col("schema"), F.col("before")), new_names), lambda f: case("added", f)),
        F.transform(types, lambda f: case("type_changed", f)),
    )
    return told.select("board_id", "file_seq", F.inline(cases))


def rename_spans(changes: DataFrame) -> DataFrame:
    """board_id, field, target, from_seq, to_seq: the name that a field's values
    go to in the files from from_seq on, before to_seq (null: to the last).
    Renames are chained along the files of a board: the target is the first
    name in the chain. A name that was renamed away and appears again as an
    added field starts a new chain under its own name.

    Only the steps of a board are folded, its schema's history; neither its
    files nor its records come together.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        spans, now = [], {}  # now: field -> target and the file from which it goes there
        for seq, rows in pdf.groupby("file_seq", sort=True):
            steps = rows[rows["change"] == "renamed"]
            moved = {new: now[old][0] if old in now else old for old, new in zip(steps["field"], steps["new_field"], strict=True)}
            ended = {*steps["field"], *moved, *rows.loc[rows["change"] == "added", "field"]} & now.keys()
            spans += [(f, *now.pop(f), int(seq)) for f in sorted(ended)]
            now |= {new: (target, int(seq)) for new, target in moved.items() if new != target}
        spans += [(f, target, since, None) for f, (target, since) in sorted(now.items())]
        out = pd.DataFrame(spans, columns=["field", "target", "from_seq", "to_seq"]).astype({"to_seq": "Int64"})
        return out.assign(board_id=pdf["board_id"].iloc[0])[["board_id", "field", "target", "from_seq", "to_seq"]]

    steps = changes.filter("change in ('renamed', 'added')").select("board_id", "file_seq", "change", "field", "new_field")
    return steps.groupBy("board_id").applyInPandas(fold, "board_id string, field string, target string, from_seq bigint, to_seq bigint")


def file_routes(records: DataFrame, changes: DataFrame) -> DataFrame:
    """board_id, file_seq, routes (map field -> target) of the files with renamed fields."""
    files = _rows(records).select("board_id", "file_seq").distinct()
    met = files.join(rename_spans(changes), "board_id").filter((F.col("file_seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("file_seq") < F.col("to_seq"))))
    return met.groupBy("board_id", "file_seq").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "target")))).alias("routes"))


def migration_steps(records: DataFrame, changes: DataFrame) -> DataFrame:
    """board_id, file_seq, rule, field, target, detail: each step that brings the
    records of a file into the consistent table. 'rename': the field's values
    go to the target; 'cast': a field of a column holds other types than the
    column's (detail: the types); 'default': no field of the file leads to the
    column, which is null. A file without readable records has no steps."""
    has = file_fields(records).join(file_routes(records, changes), ["board_id", "file_seq"], "left")
    has = has.select("board_id", "file_seq", "field", "types", F.coalesce(F.col("routes")[F.col("field")], F.col("field")).alias("target"))
    wanted = F.create_map(*[F.lit(x) for c, t in COLUMNS.items() for x in (c, TYPE_BITS[t])])
    names = F.array_join(F.array_compact(F.array(*[F.when(F.col("types").bitwiseAND(bit) != 0, F.lit(name)) for name, bit in TYPE_BITS.items()])), ",")
    step = lambda rule, field, target, detail: F.struct(F.lit(rule).alias("rule"), field.alias("field"), target.alias("target"), detail.alias("detail"))
    renames = F.when(F.col("field") != F.col("target"), step("rename", F.col("field"), F.col("target"), F.lit("")))
    casts = F.when(F.col("types").bitwiseAND(F.bitwise_not(F.try_element_at(wanted, F.col("target")))) != 0, step("cast", F.col("field"), F.col("target"), names))
    told = has.select("board_id", "file_seq", F.inline(F.array_compact(F.array(renames, casts))))
    lacking = F.array_except(F.array(*[F.lit(c) for c in COLUMNS]), F.collect_set("target"))
    absent = has.groupBy("board_id", "file_seq").agg(lacking.alias("lacking")).select("board_id", "file_seq", F.inline(F.transform("lacking", lambda c: step("default", F.lit(""), c, F.lit("null")))))
    return told.unionByName(absent)


def _table_fields(entries: str) -> str:
    """The map target -> text of sorted entries. No value replaces another: where
    two fields lead to one name, the first in order keeps it, and the other stays
    under its own path, numbered if that is taken too (null ones are left out)."""
    earlier = f"slice({entries}, 1, i)"
    taken = f"exists({earlier}, x -> x.target = e.target)"
    again = f"size(filter({earlier}, (x, j) -> x.field = e.field and x.text is not null and exists(slice({entries}, 1, j), y -> y.target = x.target)))"
    spare = f"filter(concat(array(e.field), transform(sequence(2, 2 * size({entries}) + 3), n -> concat(e.field, '#', n))), c -> not exists({entries}, x -> x.target = c) and (c = e.field or not exists({entries}, x -> x.field = c)))"
    crowded = f"array_compact(transform({entries}, (e, i) -> case when not {taken} then struct(e.target as key, e.text as value) when e.text is not null then struct(element_at({spare}, {again} + 1) as key, e.text as value) end))"
    plain = f"transform({entries}, e -> struct(e.target as key, e.text as value))"
    return f"map_from_entries(case when size(array_distinct(transform({entries}, e -> e.target))) = size({entries}) then {plain} else {crowded} end)"


def consistent_table(records: DataFrame, changes: DataFrame) -> DataFrame:
    """All readable records in one schema: board_id, file_seq, line_no, file_id,
    record_id, workplace_type, remote, fields (map target field -> text).

    Each record takes its file's routes (chained renames); absent fields
    default to null; one-element arrays are cast to their element, numbers and
    booleans to text; ``remote`` is cast to boolean from true/yes/1 and
    false/no/0 (``fields`` keeps what it said). Records delivered twice keep
    their own rows by file_id and line_no. Values of fields without a proven
    rename are in ``fields`` under their own names.
    """
    rows = _rows(records).select("board_id", "file_seq", F.col("line_no").cast("bigint").alias("line_no"), "file_id", "record").join(file_routes(records, changes), ["board_id", "file_seq"], "left")
    text = let("try_variant_get(e.value, '$', 'array<variant>')", lambda a: f"try_variant_get(case when size({a}) = 1 then {a}[0] else e.value end, '$', 'string')")
    entry = f"struct({text} is null as empty, routes[e.field] is not null as routed, e.depth as depth, e.field as field, coalesce(routes[e.field], e.field) as target, {text} as text)"
    read = rows.withColumn("entries", F.expr(of_record(f"array_sort(transform({{leaves}}, e -> {entry}))"))).filter(F.col("entries").isNotNull())
    flat = read.select("board_id", "file_seq", "line_no", "file_id", F.expr("try_element_at(filter(entries, e -> e.field = 'id' and e.depth = 1), 1).text").alias("record_id"), F.expr(_table_fields("entries")).alias("fields"))
    said = F.lower(F.trim(F.col("fields")["remote"]))
    return flat.select(
        "board_id", "file_seq", "line_no", "file_id", "record_id", F.col("fields")["workplaceType"].alias("workplace_type"),
        F.when(said.isin(*TRUE_TEXTS), True).when(said.isin(*FALSE_TEXTS), False).alias("remote"), "fields",
    )
