"""Queries of what postings say in the forms of their platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import boards
from leadloom.operators.nested import strict_json
from leadloom.plans.analytics import canonical_sql, case_first, query
from leadloom.plans.preparation import P1_ITEMS
from leadloom.sources.tables import table

#: an item in a form of its platform for every posting, in SQL that both engines read: platform and JSON text
_N, _S = "cast(raw_id as varchar(20))", "coalesce(source_platform, 'x')"
FORMS = (
    ("greenhouse", f"""concat('{{"location": {{"name": "Remote (', {_S}, ')"}}, "first_published": "2025-03-01T10:00:0', cast(raw_id % 10 as varchar(20)), '-04:00"}}')"""),
    ("greenhouse", f"""concat('{{"location": {{"name": "Berlin; hybrid/', {_N}, '"}}, "first_published": "soon", "datePosted": "2025-01-02"}}')"""),
    ("lever", f"""concat('{{"categories": {{"location": "Lyon", "commitment": " Full Time ", "allLocations": ["Lyon", "", "Remote ', {_S}, '"]}}, "workplaceType": "ONSITE", "createdAt": ', cast(1700000000000 + raw_id * 1000 as varchar(20)), '}}')"""),
    ("lever", """'{"categories": {"location": "Remote - EU", "commitment": "gig", "allLocations": []}, "workplaceType": "unspecified", "createdAt": "1700000000000"}'"""),
    ("ashby", f"""concat('{{"location": "Paris", "secondaryLocations": ["Rome", {{"location": "', {_S}, '"}}, {{"x": 1}}], "isRemote": ', case when raw_id % 2 = 0 then 'true' else 'false' end, ', "employmentType": "FullTime", "publishedAt": "2025-05-06T07:08:09.123Z"}}')"""),
    ("ashby", """'{"location": null, "secondaryLocations": ["Oslo (hybrid)"], "workplaceType": "Hybrid", "employmentType": "Intern"}'"""),
    ("workable", f"""concat('{{"jobLocation": {{"address": {{"addressLocality": "Bonn", "addressRegion": "", "addressCountry": "', {_S}, '"}}}}, "employmentType": ["CONTRACTOR", "FULL_TIME"], "baseSalary": {{"currency": "EUR", "value": {{"minValue": ', {_N}, ', "unitText": "YEAR"}}}}}}')"""),
    ("jsonld", f"""concat('{{"jobLocation": [{{"address": {{"addressLocality": "A"}}}}, 7, {{"address": {{"addressCountry": "B"}}}}], "jobLocationType": "telecommute", "baseSalary": {{"value": {{"value": ', {_N}, '.5}}}}, "datePosted": "2025-02-03T04:05:06Z"}}')"""),
    ("jsonld", f"""concat('{{"jobLocation": "Rome / Remote; ', {_S}, '", "employmentType": "temporary", "datePosted": "03.02.2025", "baseSalary": 5}}')"""),
    ("generic_html", f"""concat('{{"location": "Kyoto, hybrid ', {_S}, '", "jobLocation": "ignored"}}')"""),
    ("rippling", """'[1, 2]'"""),
)
_CASE = lambda i: "case raw_id % 11 " + " ".join(f"when {n} then {form[i] if i else repr(form[i])}" for n, form in enumerate(FORMS)) + " end"


def _map_sql(key: str, table_: dict[str, str]) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then '{v}'" for k, v in table_.items()) + " end"


def _str_sql(path: str, j: str = "j") -> str:
    return f"nullif(case when json_type({j} -> '$.{path}') = 'VARCHAR' then {j} ->> '$.{path}' end, '')"


_REMOTE = "coalesce(regexp_matches({0}, '(?i)\\bremote\\b'), false)"
_NAMES = lambda path: f"list_filter(list_transform(coalesce(cast(j -> '$.{path}' as json[]), []), lambda v: nullif(case json_type(v) when 'VARCHAR' then v ->> '$' else v ->> '$.location' end, '')), lambda t: t is not null)"
_TELL = lambda names: f"list_transform({names}, lambda t: t || case when regexp_matches(t, '(?i)\\bremote\\b') or w = 'remote' then ' R' else '' end)"
_WHOLE = lambda v: f"array_to_string(list_filter([{v} ->> '$.address.addressLocality', {v} ->> '$.address.addressRegion', {v} ->> '$.address.addressCountry'], lambda t: t <> ''), ', ')"
SHAPES = f"""with i as (select raw_id, fetched_at, is_hydrated, {_CASE(0)} as p, ({_CASE(1)})::json as j from raw_posting),
    s as (select *, json_type(j -> '$.jobLocation') as k, case when json_type(j -> '$.jobLocation') = 'ARRAY' then list_filter(cast(j -> '$.jobLocation' as json[]), lambda v: json_type(v) = 'OBJECT') end as ls from i),
    r as (select *, case p when 'greenhouse' then {_str_sql('location.name')} when 'generic_html' then {_str_sql('location')} when 'lever' then {_str_sql('categories.location')} when 'ashby' then {_str_sql('location')} else nullif(case k when 'OBJECT' then {_WHOLE("(j -> '$.jobLocation')")} when 'ARRAY' then
    array_to_string(list_filter(list_transform(ls, lambda v: {_WHOLE('v')}), lambda t: t <> ''), ' / ') when 'VARCHAR' then j ->> '$.jobLocation' end, '') end as raw, coalesce(j ->> '$.isRemote' = 'true', false) as flag, lower(trim({_str_sql('workplaceType')})) as wt from s),
    w as (select *, coalesce(case when p in ('lever', 'ashby') and wt in ('remote', 'hybrid', 'onsite') then wt when p = 'ashby' and flag then 'remote' when p not in ('greenhouse', 'generic_html', 'lever', 'ashby') and upper({_str_sql('jobLocationType')}) = 'TELECOMMUTE' then 'remote' end,
    case when regexp_matches(raw, '(?i)\\bremote\\b') then 'remote' when regexp_matches(raw, '(?i)\\bhybrid\\b') then 'hybrid' end) as w from r),
    x as (select *, case when p in ('greenhouse', 'generic_html') then {_TELL('list_filter([raw], lambda t: t is not null)')} when p = 'lever' then {_TELL(f"case when json_array_length(j -> '$.categories.allLocations') > 0 then {_NAMES('categories.allLocations')} else list_filter([raw], lambda t: t is not null) end")}
    when p = 'ashby' then list_filter([raw || case when {_REMOTE.format('raw')} or flag or w = 'remote' then ' R' else '' end], lambda t: t is not null) || {_TELL(_NAMES('secondaryLocations'))}
    when json_type(j) <> 'OBJECT' then null when k = 'OBJECT' then [raw || case when w = 'remote' then ' R' else '' end] when k = 'ARRAY' then list_transform(ls, lambda v: {_WHOLE('v')} || case when w = 'remote' then ' R' else '' end)
    when k = 'VARCHAR' then {_TELL("list_filter(list_transform(regexp_split_to_array(raw, '\\s*[/;]\\s*'), lambda t: trim(t)), lambda t: t <> '')")} else [] end as ps,
    case when p = 'greenhouse' then epoch_us(try_cast({_str_sql('first_published')} as timestamptz)) when p = 'lever' then case when json_type(j -> '$.createdAt') in ('UBIGINT', 'BIGINT') then (j ->> '$.createdAt')::bigint * 1000 end when p = 'ashby' then epoch_us(try_cast({_str_sql('publishedAt')} as timestamptz)) end as native,
    epoch_us(try_cast({_str_sql('datePosted')} as timestamptz)) as dated, try_cast(j ->> '$.baseSalary.value.minValue' as double) as lo, try_cast(j ->> '$.baseSalary.value.maxValue' as double) as hi, try_cast(j ->> '$.baseSalary.value.value' as double) as one from w) """


@query(
    SHAPES
    + f"""select raw_id, raw as location_raw, array_to_string(ps, '|') as places, w as workplace_type, nullif(regexp_extract(raw, '(?i)remote\\s*\\(([^)]+)\\)', 1), '') as remote_scope,
    case p when 'lever' then {_map_sql(f"lower(trim({_str_sql('categories.commitment')}))", rules.LEVER_TYPES)} when 'ashby' then {_map_sql(f"lower(trim({_str_sql('employmentType')}))", rules.ASHBY_TYPES)} else {_map_sql(f"upper(coalesce(j ->> '$.employmentType[0]', {_str_sql('employmentType')}))", rules.SCHEMA_TYPES)} end as employment_type,
    case when lo is not null or hi is not null then lo else one end as pay_min, case when lo is not null or hi is not null then hi else one end as pay_max, case when coalesce(lo, hi, one) is not null then lower({_str_sql('baseSalary.value.unitText')}) end as pay_period,
    coalesce(native, dated, epoch_us(fetched_at)) as posted_micros, coalesce(native, dated) is null as posted_inferred, case when json_type(j) <> 'OBJECT' then 0.0::double when p = 'generic_html' then 0.3::double when is_hydrated then 1.0::double else 0.7::double end as extraction_confidence from x"""
)
def posting_details(spark: SparkSession, folder: str) -> DataFrame:
    """Items in eleven forms of platforms, made by arithmetic on the postings."""
    rows = table(spark, folder, "raw_posting").select("raw_id", "fetched_at", "is_hydrated", F.expr(_CASE(0)).alias("platform"), F.expr(_CASE(1)).alias("text"))
    items = rows.select("raw_id", "fetched_at", "is_hydrated", "platform", F.expr(strict_json("text")).alias("item"))
    told = F.array_join(F.transform("places", lambda p: F.concat(p["raw"], F.when(p["is_remote"], " R").otherwise(""))), "|")
    return boards.posting_details(items).select(
        "raw_id", "location_raw", told.alias("places"), "workplace_type", "remote_scope", "employment_type", F.col("pay.min").alias("pay_min"), F.col("pay.max").alias("pay_max"), F.col("pay.period").alias("pay_period"), "posted_micros", "posted_inferred", "extraction_confidence",
    )


def _of(**paths: str) -> str:
    """The first of the JSON paths of each platform that has a value."""
    return "case source_platform " + " ".join(f"when '{p}' then coalesce({', '.join(f'item ->> $${x}$$' for x in v.split('|'))}, null)" for p, v in paths.items()) + " end"


_TEXTS = "list_filter(list_transform(cast({0} as json[]), lambda v: trim(case json_type(v) when 'OBJECT' then v ->> '$.location' else v ->> '$' end)), lambda t: t <> '')"
BOARD = f"""{P1_ITEMS}, good as (select i.page_id, item_pos::bigint as posting_pos, company_id, i.source_platform, item from item i join board_page b using (page_id) where json_type(item) = 'OBJECT' and status_code < 400 and status_code <> 304 and regexp_matches(payload, '^[\\s\\x{{FEFF}}]*[\\[{{"]') and i.source_platform in ('greenhouse', 'lever', 'ashby', 'workable', 'smartrecruiters', 'recruitee')),
    posts as (select page_id, posting_pos, company_id, source_platform, {_of(greenhouse='$.id', lever='$.id', ashby='$.id', workable='$.shortcode', smartrecruiters='$.id', recruitee='$.id')} as external_id,
    {_of(greenhouse='$.title', lever='$.text', ashby='$.title', workable='$.title', smartrecruiters='$.name|$.title', recruitee='$.title')} as title_raw, {_of(greenhouse='$.absolute_url', lever='$.hostedUrl', ashby='$.jobUrl', workable='$.url', smartrecruiters='$.ref', recruitee='$.careers_url')} as url,
    {_of(greenhouse='$.departments[0].name', lever='$.categories.department', ashby='$.department', workable='$.department', smartrecruiters='$.department.label|$.department', recruitee='$.department')} as department_raw,
    {_of(greenhouse='$.location.name', lever='$.categories.location', ashby='$.location', workable='$.city', smartrecruiters='$.location.fullLocation|$.location.city', recruitee='$.location')} as location_raw,
    {_of(greenhouse='$.first_published|$.updated_at', lever='$.createdAt', ashby='$.publishedAt', workable='$.published_on', smartrecruiters='$.releasedDate', recruitee='$.published_at')} as posted_text,
    {_of(greenhouse='$.content', lever='$.description', ashby='$.descriptionHtml', recruitee='$.description')} as description_raw, {_of(lever='$.workplaceType', ashby='$.workplaceType')} as workplace_raw,
    {_map_sql("upper(trim(" + _of(lever='$.categories.commitment', ashby='$.employmentType', workable='$.employment_type', recruitee='$.employment_type_code') + "))", rules.EMPLOYMENT_TYPES)} as employment_type,
    case when source_platform = 'lever' and json_type(item -> '$.categories.allLocations') = 'ARRAY' then {_TEXTS.format("(item -> '$.categories.allLocations')")} end as all_places, case when source_platform = 'ashby' and json_type(item -> '$.secondaryLocations') = 'ARRAY' then {_TEXTS.format("(item -> '$.secondaryLocations')")} end as more_places from good) """


@query(BOARD + "select * replace (array_to_string(all_places, '|') as all_places, array_to_string(more_places, '|') as more_places) from posts")
def board_postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = boards.board_postings(table(spark, folder, "board_page"))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("all_places", "more_places")})


_TRIM = "regexp_replace({0}, '^[\\s\\x{{A0}}\\x{{3000}}]+|[\\s\\x{{A0}}\\x{{3000}}]+$', '', 'g')"
_SPLIT = f"list_filter(list_transform(regexp_split_to_array(location_raw, '\\s*[/;]\\s*'), lambda t: {_TRIM.format('t')}), lambda t: t <> '')"


@query(
    BOARD
    + f""", t as (select *, {canonical_sql('title_raw')} as c from posts), n as (select *, trim(case when c <> '' and (c = lower(c) or c = upper(c)) then array_to_string(list_transform(regexp_extract_all(lower(c), '(\\p{{L}}+|[^\\p{{L}}]+)'), lambda x: upper(x[1:1]) || x[2:]), '') else c end) as title from t),
    o as (select *, case when source_platform in ('greenhouse', 'lever', 'ashby') then list_filter([{_TRIM.format('location_raw')}], lambda t: t <> '') else {_SPLIT} end as own, regexp_replace(lower(workplace_raw), '[\\s_-]+', '', 'g') as wp from n)
    select page_id, posting_pos, company_id, source_platform, title, {case_first("lower(coalesce(title, '') || ' ' || coalesce(department_raw, ''))", rules.FUNCTION_KEYWORDS)} as function, {case_first("lower(coalesce(title, ''))", rules.SENIORITY_KEYWORDS)} as seniority,
    array_to_string(list_transform(case when len(all_places) > 0 then list_distinct(all_places) when len(more_places) > 0 then list_distinct(coalesce(own, []) || more_places) else own end, lambda t: t || case when contains(lower(t), 'remote') then ' R' else '' end), '|') as places,
    case when trim(external_id) <> '' then company_id || ':' || source_platform || ':' || trim(external_id) when trim(url) <> '' then company_id || ':url:' || substr(sha256(trim(url)), 1, 16) else company_id || ':hash:' || substr(sha256(company_id || '|' || coalesce(title, '') || '|' || coalesce(department_raw, '')), 1, 16) end as job_id, employment_type,
    case when wp in ('remote', 'hybrid', 'onsite') then wp end as workplace_type, case when regexp_matches(posted_text, '^[0-9]{{13}}$') then posted_text::bigint * 1000 else epoch_us(try_cast(posted_text as timestamptz)) end as posted_micros from o"""
)
def normalized_postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = boards.normalized_postings(table(spark, folder, "board_page"))
    return rows.withColumn("places", F.array_join(F.transform("places", lambda p: F.concat(p["place"], F.when(p["is_remote"], " R").otherwise(""))), "|"))


_DETAIL = "concat('{\"postingUrl\": \"https://p.example/', source_job_id, '\", \"jobAd\": {\"sections\": {\"jobDescription\": {\"text\": \" Do ', cast(raw_id % 7 as varchar(9)), '\"}', case when raw_id % 2 = 0 then ', \"qualifications\": {\"text\": \"Know\"}' else '' end, '}}}')"


@query(
    BOARD
    + f""", d as (select source_job_id as external_id, max({_DETAIL}) as detail from raw_posting where source_job_id is not null and raw_id % 3 > 0 group by 1)
    select page_id, posting_pos, coalesce(detail::json ->> '$.postingUrl', url) as url, coalesce(nullif(concat_ws(chr(10) || chr(10), nullif(trim(detail::json ->> '$.jobAd.sections.jobDescription.text'), ''), nullif(trim(detail::json ->> '$.jobAd.sections.qualifications.text'), '')), ''), description_raw) as description_raw, detail is not null as is_hydrated
    from posts left join d using (external_id) where source_platform = 'smartrecruiters'"""
)
def hydrated_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Listed postings with details made of the postings fetched with the same id."""
    listed = boards.board_postings(table(spark, folder, "board_page").filter("source_platform = 'smartrecruiters'"))
    details = table(spark, folder, "raw_posting").filter("raw_id % 3 > 0").select(F.col("source_job_id").alias("external_id"), F.expr(_DETAIL.replace("varchar(9)", "string")).alias("detail"))
    return boards.hydrated(listed, details).select("page_id", "posting_pos", "url", "description_raw", "is_hydrated")


@query(
    """with p as (select company_id, run_id, page_id, row_number() over (partition by company_id, run_id order by page_id) - 1 as page_no, status_code, page_id % 3 as listed, 4 as total from board_page), s as (select *, case when status_code = 304 then 'not_modified' when status_code < 400 then 'success' else 'failed' end as status, sum(listed) over (partition by company_id, run_id order by page_no) as sofar from p),
    e as (select *, status <> 'failed' as fine, status <> 'failed' and (status = 'not_modified' or sofar >= total or listed = 0 or page_no = 19) as ends from s), x as (select company_id, run_id, min(page_no) filter (ends) as end_ from e group by 1, 2)
    select company_id, run_id, count(*) filter (fine and (end_ is null or page_no <= end_))::int as pages_read, coalesce(end_ is not null and count(*) filter (fine and page_no <= end_) = end_ + 1, false) as complete from e join x using (company_id, run_id) group by company_id, run_id, end_"""
)
def listing_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of a run as pages of a listing of four, with none to two postings each."""
    in_order = Window.partitionBy("company_id", "run_id").orderBy("page_id")
    pages = table(spark, folder, "board_page").select("company_id", "run_id", (F.row_number().over(in_order) - 1).alias("page_no"), F.when(F.col("status_code") == 304, "not_modified").when(F.col("status_code") < 400, "success").otherwise("failed").alias("status"), (F.col("page_id") % 3).alias("listed"), F.lit(4).alias("total"))
    return boards.complete_listing(pages)
