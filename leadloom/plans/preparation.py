"""Queries of the data-preparation operators in the core (problems 1, 2, 4, 7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.operators import drift, nested, snapshots, timestamps
from leadloom.plans.time_sql import P2_SQL
from leadloom.sources.tables import spread, table


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "board_page").select("page_id", "source_platform", "payload"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.children_with_text(_pages(spark, folder)).select("page_id", "posting_pos", "kind", "child_pos")


def p1_postings(spark: SparkSession, folder: str) -> DataFrame:
    return nested.postings(_pages(spark, folder))


def p1_children(spark: SparkSession, folder: str) -> DataFrame:
    return nested.children(_pages(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return timestamps.posting_instants(spread(table(spark, folder, "raw_posting").select("raw_id", "company_id", *timestamps.TIME_FIELDS)), table(spark, folder, "company"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, folder, "board_snapshot"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.schema_changes(table(spark, folder, "board_record"))


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    """consistent_table with ``fields`` as JSON text, its keys in order: maps can't be sorted or compared."""
    records = table(spark, folder, "board_record")
    whole = drift.consistent_table(records, drift.schema_changes(records))
    in_order = F.map_from_entries(F.array_sort(F.map_entries("fields")))
    return whole.withColumn("fields", F.to_json(in_order, {"ignoreNullFields": "false"}))


def p7_steps(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "board_record")
    return drift.migration_steps(records, drift.schema_changes(records))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_postings": p1_postings,
    "p1_children": p1_children,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p7_found": p7_found,
    "p7_table": p7_table,
    "p7_steps": p7_steps,
}


def _list_sql(value: str, out: str, keep: str, source: str) -> str:
    """Rows of the elements of a JSON list with their places: a single object is a list of one, a string counts as the JSON it holds."""
    decoded = f"case when json_type({value}) = 'VARCHAR' and json_valid({value} ->> '$') then ({value} ->> '$')::json else {value} end"
    return f"""select {keep}, i as {out}_pos, case when json_type(v) = 'ARRAY' then v -> ('$[' || i || ']') else v end as {out} from (select {keep}, v, unnest(range((case json_type(v) when 'ARRAY' then json_array_length(v) when 'OBJECT' then 1 else 0 end)::bigint)) as i
    from (select {keep}, {decoded} as v from {source}))"""


def _leaf_sql(value: str) -> str:
    return f"case json_type({value}) when 'OBJECT' then {value} ->> '$.name' when 'VARCHAR' then {value} ->> '$' end"


def _child_sql(kind: str, field: str, leaf: str) -> str:
    children = _list_sql(f"item -> '$.{field}'", "child", "page_id, item_pos, source_platform", "item")
    return f"select page_id, item_pos as posting_pos, '{kind}' as kind, child_pos, {_leaf_sql(f"(child -> '$.{leaf}')")} as t from ({children}) where json_type(child) = 'OBJECT'"


_FULL_SQL = f"""select page_id, item_pos as posting_pos, 'full_location' as kind, 0 as child_pos, {_leaf_sql("(child -> '$.fullLocation')")} as t
    from ({_list_sql("item -> '$.location'", "child", "page_id, item_pos, source_platform", "item")}) where child_pos = 0 and source_platform = 'smartrecruiters'"""

P1_ITEMS = f"""with raw as (select page_id, source_platform, regexp_replace(payload, '^[\\s\\x{{FEFF}}]+', '') as s from board_page where payload is not null),
    parsed as (select page_id, source_platform, s::json as j from raw where json_valid(s)),
    whole as (select page_id, source_platform, case when json_type(j) = 'VARCHAR' and json_valid(j ->> '$') then (j ->> '$')::json else j end as j from parsed),
    outer_ as (select page_id, source_platform, coalesce(j -> '$.response', j) as j from whole), inner_ as (select page_id, source_platform, coalesce(j -> '$.data', j) as j from outer_),
    root as (select page_id, source_platform, case when json_type(j -> '$.jobs') in ('ARRAY', 'OBJECT') then j -> '$.jobs' when json_type(j -> '$.content') in ('ARRAY', 'OBJECT') then j -> '$.content' else j end as l from inner_),
    item as ({_list_sql("l", "item", "page_id, source_platform", "root")})"""
_CHILDREN_SQL = " union all ".join(_child_sql(k, f, leaf) for k, (f, leaf) in nested.CHILDREN.items())

P1_SQL = f"""{P1_ITEMS}, found as ({_CHILDREN_SQL} union all {_FULL_SQL})
    select page_id, posting_pos, kind, child_pos::bigint as child_pos from found where regexp_matches(t, '[^\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]')"""
P1_POSTINGS_SQL = f"""{P1_ITEMS} select page_id, item_pos::bigint as posting_pos, coalesce(item ->> '$.id', item ->> '$.shortcode') as external_id, coalesce(item ->> '$.title', item ->> '$.text', item ->> '$.name') as title, json_type(item) = 'OBJECT' as is_posting from item"""
P1_CHILDREN_SQL = f"""{P1_ITEMS}, found as ({_CHILDREN_SQL.replace(" where json_type(child) = 'OBJECT'", "")} union all select i.page_id, i.item_pos, 'full_location', 0, f.t from item i left join ({_FULL_SQL}) f on f.page_id = i.page_id and f.posting_pos = i.item_pos where i.source_platform = 'smartrecruiters')
    select page_id, posting_pos::bigint as posting_pos, kind, child_pos::bigint as child_pos, t as child_text from found"""

_P7 = """with recursive r as (select board_id, file_seq::bigint as file_seq, line_no::bigint as line_no, file_id, record::json as j from board_record where json_valid(record) and json_type(record::json) = 'OBJECT'),
    leaf as (select board_id, file_seq, line_no, file_id, replace(substr(fullkey, 3), '"', '') as field, case when type in ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') then 'number' when type = 'VARCHAR' then 'string' else lower(type) end as kind, value::varchar as v, value as jv, j ->> '$.id' as id
    from r, json_tree(j) where type <> 'OBJECT' and not contains(fullkey, '[')),
    ff as (select board_id, file_seq, field, coalesce(list_sort(list(distinct kind) filter (kind <> 'null')), []) as types from leaf group by all),
    files as (select board_id, file_seq, lag(file_seq) over (partition by board_id order by file_seq) as before from (select distinct board_id, file_seq from ff)),
    here as (select f.board_id, f.file_seq, before, field, types from files f join ff using (board_id, file_seq) where before is not null),
    was as (select f.board_id, f.file_seq, before, field, types from files f join ff x on x.board_id = f.board_id and x.file_seq = before),
    new_ as (select * from here anti join was using (board_id, file_seq, field)), gone as (select * from was anti join here using (board_id, file_seq, field)),
    pair as (select g.board_id, g.file_seq, g.before, g.field, n.field as new_field from gone g join new_ n using (board_id, file_seq)),
    told as (select p.board_id, p.file_seq, p.field, p.new_field, count(distinct a.id) as shared, bool_and(a.kind = b.kind and a.v = b.v) as same from pair p join leaf a on a.board_id = p.board_id and a.file_seq = p.before and a.field = p.field and a.kind <> 'null'
    join leaf b on b.board_id = p.board_id and b.file_seq = p.file_seq and b.field = p.new_field and b.kind <> 'null' and a.id = b.id group by all),
    ranked as (select *, row_number() over (partition by board_id, file_seq, field order by shared desc, field, new_field) as o, row_number() over (partition by board_id, file_seq, new_field order by shared desc, field, new_field) as n from told where same),
    renamed as (select board_id, file_seq, field, new_field from ranked where o = 1 and n = 1)"""
P7_SQL = f"""{_P7} select board_id, file_seq, 'renamed' as change, field, new_field from renamed
    union all select board_id, file_seq, 'removed', field, '' from gone anti join renamed using (board_id, file_seq, field)
    union all select board_id, file_seq, 'added', field, '' from new_ anti join (select board_id, file_seq, new_field as field from renamed) using (board_id, file_seq, field)
    union all select board_id, file_seq, 'type_changed', field, '' from here h join was w using (board_id, file_seq, field) where h.types <> w.types and len(h.types) > 0 and len(w.types) > 0"""
#: where the values of each field of each file go: along the files, by the name in the file before
_P7_ROUTES = f"""{_P7}, link as (select f.board_id, f.file_seq, f.before, x.field, coalesce(n.field, w.field) as origin from files f join ff x using (board_id, file_seq) left join renamed n on n.board_id = f.board_id and n.file_seq = f.file_seq and n.new_field = x.field
    left join was w on w.board_id = f.board_id and w.file_seq = f.file_seq and w.field = x.field),
    route as (select board_id, file_seq, field, field as target from link where origin is null union all select l.board_id, l.file_seq, l.field, s.target from link l join route s on l.board_id = s.board_id and l.before = s.file_seq and l.origin = s.field)"""
_COLUMNS = "(values ('workplaceType', 'string'), ('remote', 'boolean')) c(name, kind)"
P7_STEPS_SQL = f"""{_P7_ROUTES} select board_id, file_seq, 'rename' as rule, field, target, '' as detail from route where field <> target
    union all select board_id, file_seq, 'cast', field, target, array_to_string(list_filter(['boolean', 'number', 'string', 'array'], lambda k: list_contains(types, k)), ',') from route join ff using (board_id, file_seq, field) join {_COLUMNS} on name = target where len(list_filter(types, lambda k: k <> c.kind)) > 0
    union all select board_id, file_seq, 'default', '', name, 'null' from (select distinct board_id, file_seq from ff) f, {_COLUMNS} where not exists (select 1 from route x where x.board_id = f.board_id and x.file_seq = f.file_seq and target = name)"""
P7_TABLE_SQL = f"""{_P7_ROUTES}, said as (select l.*, target, case when kind = 'null' or (kind = 'array' and json_array_length(jv) = 1 and json_type(jv -> '$[0]') = 'NULL') then null when kind = 'array' and json_array_length(jv) = 1 then jv ->> '$[0]' else jv ->> '$' end as t from leaf l join route using (board_id, file_seq, field)),
    placed as (select *, row_number() over (partition by board_id, file_seq, line_no, file_id, target order by t is null, field <> target, len(field) - len(replace(field, '.', '')), field) as k from said),
    named as (select *, case when k = 1 then target else field end as name from placed where k = 1 or t is not null),
    flat as (select board_id, file_seq, line_no, file_id, max(t) filter (field = 'id') as record_id, max(t) filter (name = 'workplaceType') as workplace_type, lower(trim(max(t) filter (name = 'remote'))) as said, '{{' || string_agg(to_json(name)::varchar || ':' || coalesce(to_json(t)::varchar, 'null'), ',' order by name) || '}}' as fields from named group by all)
    select board_id, file_seq, line_no, file_id, record_id, workplace_type, case when said in ('true', 'yes', 'y', '1') then true when said in ('false', 'no', 'n', '0') then false end as remote, fields from flat"""

#: the references that the titles hold are &nbsp; and &amp;; SQL has no decoder for all
P4_SQL = """with runs as (select *, lag(run_seq) over w as prev, lead(run_seq) over w as next from (select distinct board_id, run_seq from board_snapshot where run_status = 'success') window w as (partition by board_id order by run_seq)),
    rows_ as (select board_id, run_seq, lower(regexp_replace(id, '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g')) as id, trim(regexp_replace(nfc_normalize(replace(replace(title, '&nbsp;', ' '), '&amp;', '&')), '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{202F}\\x{3000}]+', ' ', 'g')) as title,
    epoch_us(cast(regexp_replace(trim(updated_at), '([+-][0-9][0-9])([0-9][0-9])$', '\\1:\\2') as timestamptz)) as moment, loaded_at from board_snapshot where run_status = 'success' and id is not null),
    one as (select * exclude (k) from (select *, row_number() over (partition by board_id, run_seq, id order by moment desc nulls last, loaded_at desc, title desc) as k from rows_ where id <> '') where k = 1),
    seen as (select o.*, prev, next, lag(run_seq) over w as seen_before, lead(run_seq) over w as seen_next, lag(title) over w as was, lag(moment) over w as was_moment from one o join runs using (board_id, run_seq) window w as (partition by board_id, id order by run_seq))
    select board_id, run_seq::bigint as run_seq, id, 'added' as change from seen where prev is not null and seen_before is distinct from prev
    union all select board_id, run_seq, id, 'changed' from seen where seen_before = prev and (was <> title or was_moment <> moment)
    union all select board_id, next, id, 'removed' from seen where next is not null and seen_next is distinct from next"""

ORACLE: dict[str, str] = {"p1_found": P1_SQL, "p1_postings": P1_POSTINGS_SQL, "p1_children": P1_CHILDREN_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p7_found": P7_SQL, "p7_table": P7_TABLE_SQL, "p7_steps": P7_STEPS_SQL}
