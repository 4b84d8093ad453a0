"""Board responses of several platforms to one posting table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import postings as P
from leadloom.functions import rules
from leadloom.functions.text import trimmed
from leadloom.operators import nested
from leadloom.operators.timestamps import zoned_micros


@dataclass(frozen=True)
class Board:
    """Where a platform's posting keeps its fields (dotted paths, first present wins)."""

    external_id: tuple[str, ...]
    title: tuple[str, ...]
    url: tuple[str, ...]
    department: tuple[str, ...]
    location: tuple[str, ...]
    posted: tuple[str, ...]
    employment: tuple[str, ...] = ()
    description: tuple[str, ...] = ()
    workplace: tuple[str, ...] = ()
    #: lists of places: of all places of the posting, and of those beside its location
    all_places: tuple[str, ...] = ()
    more_places: tuple[str, ...] = ()


#: platform adapters; add an entry to support another board
BOARDS = {
    "greenhouse": Board(("id",), ("title",), ("absolute_url",), ("departments[0].name",), ("location.name",), ("first_published", "updated_at"), description=("content",)),
    "lever": Board(("id",), ("text",), ("hostedUrl",), ("categories.department",), ("categories.location",), ("createdAt",), ("categories.commitment",), ("description",), ("workplaceType",), all_places=("categories.allLocations",)),
    "ashby": Board(("id",), ("title",), ("jobUrl",), ("department",), ("location",), ("publishedAt",), ("employmentType",), ("descriptionHtml",), ("workplaceType",), more_places=("secondaryLocations",)),
    "workable": Board(("shortcode",), ("title",), ("url",), ("department",), ("city",), ("published_on",), ("employment_type",)),
    "smartrecruiters": Board(("id",), ("name", "title"), ("ref",), ("department.label", "department"), ("location.fullLocation", "location.city"), ("releasedDate",)),
    "recruitee": Board(("id",), ("title",), ("careers_url",), ("department",), ("location",), ("published_at",), ("employment_type_code",), ("description",)),
}


def page_status(status_code: Column, payload: Column) -> Column:
    """success, not_modified, board_not_found, blocked_403 or schema_violation of a fetched page."""
    return (
        F.when(status_code == 304, "not_modified").when(status_code == 404, "board_not_found").when(status_code.isin(401, 403), "blocked_403")
        .when((status_code >= 400) | status_code.isNull(), "schema_violation").when(payload.isNull() | ~payload.rlike(r'^[\s\x{FEFF}]*[\[{"]'), "schema_violation").otherwise("success")
    )


def board_postings(pages: DataFrame) -> DataFrame:
    """One row per posting of every readable, successful page: page_id,
    posting_pos, source_platform, external_id, title_raw, url, department_raw,
    location_raw, posted_text, workplace_raw, all_places, more_places (the texts
    of the platform's lists of places, null where it has none), employment_type,
    description_raw. Elements that are no objects give no row; platforms without
    an adapter give none."""

    parts = {"external_id": "external_id", "title": "title_raw", "url": "url", "department": "department_raw", "location": "location_raw", "posted": "posted_text", "employment": "employment_raw", "description": "description_raw", "workplace": "workplace_raw"}

    def read(item: str, part: str) -> str:
        cases = "".join(f" when '{name}' then coalesce({', '.join(nested.field(item, p, 'string') for p in getattr(board, part))}, null)" for name, board in BOARDS.items() if getattr(board, part))
        return f"case source_platform{cases} end"

    def texts(item: str, part: str) -> str:
        def of(path: str) -> str:
            text = lambda x: f"trim(case when {nested.is_object(x)} then {nested.field(x, 'location', 'string')} else try_variant_get({x}, '$', 'string') end)"
            return f"filter({nested.each(nested.field(item, path, 'array<variant>'), lambda x, _: text(x))}, t -> t <> '')"

        cases = "".join(f" when '{name}' then coalesce({', '.join(of(p) for p in getattr(board, part))}, null)" for name, board in BOARDS.items() if getattr(board, part))
        return f"case source_platform{cases} end"

    def row(item: str, place: str) -> str:
        return f"struct(cast({place} as bigint) as posting_pos, {nested.is_object(item)} as is_object, {', '.join(f'{read(item, p)} as {name}' for p, name in parts.items())}, {texts(item, 'all_places')} as all_places, {texts(item, 'more_places')} as more_places)"

    rows = nested.each(nested.posting_list(nested.parse_payload("payload")), lambda v, i: nested.let(nested.decoded(v), lambda x: row(x, i)))
    good = pages.filter(page_status(F.col("status_code"), F.col("payload")) == "success").filter(F.col("source_platform").isin(*BOARDS))
    found = good.select("page_id", "company_id", "source_platform", F.expr(f"inline({rows})")).filter("is_object")
    return found.withColumn("employment_type", P.employment_type(F.col("employment_raw"))).drop("is_object", "employment_raw")


#: Kinds of workplace
WORKPLACES = ("remote", "hybrid", "onsite")


def _all_places() -> Column:
    """The places of a posting, each once if they come from lists; entries of lists
    are not split, nor are the texts of platforms that name one place in them."""
    single = F.when(trimmed(F.col("location_raw")) != "", F.array(P.one_place(trimmed(F.col("location_raw"))))).when(F.col("location_raw").isNotNull(), F.array().cast("array<struct<place:string,is_remote:boolean>>"))
    own = F.when(F.col("source_platform").isin("greenhouse", "lever", "ashby"), single).otherwise(P.places(F.col("location_raw")))
    listed = lambda c: F.transform(c, P.one_place)
    beside = F.concat(F.coalesce(own, F.array().cast("array<struct<place:string,is_remote:boolean>>")), listed("more_places"))
    return F.when(F.size("all_places") > 0, F.array_distinct(listed("all_places"))).when(F.size("more_places") > 0, F.array_distinct(beside)).otherwise(own)


def normalized_postings(pages: DataFrame) -> DataFrame:
    """board_postings with title, function, seniority, places (the platform's
    list of all places, else its location with the places listed beside it),
    workplace_type (remote, hybrid, onsite; null for others), job key and the
    instant of posting (zone-less texts as UTC)."""
    workplace = F.regexp_replace(F.lower("workplace_raw"), r"[\s_-]+", "")  # on-site, OnSite
    found = board_postings(pages).withColumn("title", P.canonical_title(F.col("title_raw")))
    return found.select(
        "page_id", "posting_pos", "company_id", "source_platform", "title",
        P.function_class(F.col("title"), F.col("department_raw")).alias("function"), P.seniority_class(F.col("title")).alias("seniority"), _all_places().alias("places"),
        P.job_key(F.col("company_id"), F.col("source_platform"), F.col("external_id"), F.col("url"), F.col("title"), F.col("department_raw")).alias("job_id"), "employment_type", F.when(workplace.isin(*WORKPLACES), workplace).alias("workplace_type"), zoned_micros(F.col("posted_text")).alias("posted_micros"),
    )


def complete_sweeps(pages: DataFrame) -> DataFrame:
    """company_id, run_id, status, pages: a run is as good as its first failing
    page; pages behind a failing one do not count."""
    each = pages.select("company_id", "run_id", "page_no", page_status(F.col("status_code"), F.col("payload")).alias("status"))
    failing = F.min(F.when(~F.col("status").isin("success", "not_modified"), F.struct("page_no", "status")))
    return each.groupBy("company_id", "run_id").agg(failing.alias("bad"), F.count("*").alias("pages")).select("company_id", "run_id", F.coalesce("bad.status", F.lit("success")).alias("status"), "pages")


def _text(path: str) -> Column:
    """A text of the item that is not empty; null for other values."""
    v = F.try_variant_get("item", f"$.{path}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.nullif(F.try_variant_get("item", f"$.{path}", "string"), F.lit("")))


def _says(text: Column, word: str) -> Column:
    return F.coalesce(text.rlike(rf"(?i)\b{word}\b"), F.lit(False))


def _place(raw: Column, city: Column | None = None, region: Column | None = None, country: Column | None = None, remote: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    parts = {"city": city, "region": region, "country": country}
    return F.struct(raw.alias("raw"), *[(none if c is None else c).alias(n) for n, c in parts.items()], (_says(raw, "remote") if remote is None else remote).alias("is_remote"))


_PLACES = "array<struct<raw:string,city:string,region:string,country:string,is_remote:boolean>>"


def _schema_places() -> tuple[Column, Column]:
    """The place text and the places of an item in the schema.org form: an object, a list of objects, or a text split at slashes and semicolons."""
    part = lambda v, p: F.try_variant_get(v, f"$.address.{p}", "string")
    whole = lambda v: F.array_join(F.filter(F.array(*[part(v, f"address{p}") for p in ("Locality", "Region", "Country")]), lambda t: t != ""), ", ")
    place = lambda v: _place(whole(v), part(v, "addressLocality"), part(v, "addressRegion"), part(v, "addressCountry"), F.lit(False))
    is_object = lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull()
    at = F.try_variant_get("item", "$.jobLocation", "variant")
    listed = F.transform(F.filter(F.try_variant_get("item", "$.jobLocation", "array<variant>"), is_object), place)
    text = _text("jobLocation")
    pieces = F.filter(F.transform(F.split(text, r"\s*[/;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    split = F.transform(pieces, lambda p: _place(p, F.when(~_says(p, "remote"), p)))
    raw = F.when(is_object(at), F.nullif(whole(at), F.lit(""))).when(listed.isNotNull(), F.nullif(F.array_join(F.filter(F.transform(listed, lambda p: p["raw"]), lambda t: t != ""), " / "), F.lit(""))).otherwise(text)
    return raw, F.when(is_object(at), F.array(place(at))).when(listed.isNotNull(), listed).when(F.size(split) > 0, split).when(text.isNotNull(), F.array(_place(text)))


def posting_details(items: DataFrame, description: str | None = None) -> DataFrame:
    """items (platform, item as VARIANT, fetched_at, is_hydrated) with location_raw,
    places (raw, city, region, country, is_remote), workplace_type, remote_scope,
    employment_type, pay (min, max, currency, period), posted_micros,
    posted_inferred and extraction_confidence. description: a column of the
    posting's text, in which hybrid work overrules all else.

    Every platform has its own fields for places; those without come in the
    schema.org form. A field of another type than expected counts as missing;
    a place is split only where a text holds several. The date is the
    platform's own, else datePosted, else the fetch (inferred). An item that is
    no object is degraded: all null, confidence 0.
    """
    platform = F.col("platform")
    schema_raw, schema_places = _schema_places()
    flat = {"greenhouse": _text("location.name"), "generic_html": _text("location"), "lever": _text("categories.location"), "ashby": _text("location")}
    raw = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in flat.items():
        raw = raw.when(platform == name, text)
    raw = raw.otherwise(schema_raw)
    one = lambda text: F.when(text.isNotNull(), F.array(_place(text))).otherwise(F.array().cast(_PLACES))
    # lists of texts, or of objects with a location
    name_of = lambda v: F.nullif(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.location", "string")), F.lit(""))
    several = lambda path: F.transform(F.filter(F.transform(F.try_variant_get("item", f"$.{path}", "array<variant>"), name_of), lambda t: t.isNotNull()), lambda t: _place(t))
    remote_flag = F.coalesce(F.try_variant_get("item", "$.isRemote", "boolean"), F.lit(False))
    lever = F.when(F.size(F.try_variant_get("item", "$.categories.allLocations", "array<variant>")) > 0, several("categories.allLocations")).otherwise(one(flat["lever"]))
    first = F.when(flat["ashby"].isNotNull(), F.array(_place(flat["ashby"], remote=_says(flat["ashby"], "remote") | remote_flag))).otherwise(F.array().cast(_PLACES))
    ashby = F.concat(first, F.coalesce(several("secondaryLocations"), F.array().cast(_PLACES)))
    places = F.when(platform.isin("greenhouse", "generic_html"), one(raw)).when(platform == "lever", lever).when(platform == "ashby", ashby).otherwise(F.coalesce(schema_places, F.array().cast(_PLACES)))
    told = F.lower(F.trim(_text("workplaceType")))
    structured = F.when(platform.isin("lever", "ashby") & told.isin(*WORKPLACES), told).when((platform == "ashby") & remote_flag, "remote").when(~platform.isin(*flat) & (F.upper(_text("jobLocationType")) == "TELECOMMUTE"), "remote")
    workplace = F.coalesce(structured, F.when(_says(F.col("location_raw"), "remote"), "remote").when(_says(F.col("location_raw"), "hybrid"), "hybrid"))
    if description is not None:
        workplace = F.when(_says(F.col(description), "hybrid"), "hybrid").otherwise(workplace)
    lookup = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    listed_type = F.try_variant_get("item", "$.employmentType[0]", "string")
    employment = F.when(platform == "lever", lookup(rules.LEVER_TYPES, F.lower(F.trim(_text("categories.commitment"))))).when(platform == "ashby", lookup(rules.ASHBY_TYPES, F.lower(F.trim(_text("employmentType"))))).otherwise(lookup(rules.SCHEMA_TYPES, F.upper(F.coalesce(listed_type, _text("employmentType")))))
    number = lambda p: F.try_variant_get("item", f"$.baseSalary.value.{p}", "double")
    given_range = number("minValue").isNotNull() | number("maxValue").isNotNull()
    low, high = F.when(given_range, number("minValue")).otherwise(number("value")), F.when(given_range, number("maxValue")).otherwise(number("value"))
    pay = F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max"), _text("baseSalary.currency").alias("currency"), F.lower(_text("baseSalary.value.unitText")).alias("period")))
    millis = F.when(F.schema_of_variant(F.try_variant_get("item", "$.createdAt", "variant")) == "BIGINT", F.try_variant_get("item", "$.createdAt", "bigint"))
    iso = lambda text: zoned_micros(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))
    native = F.when(platform == "greenhouse", iso(_text("first_published"))).when(platform == "lever", millis * 1000).when(platform == "ashby", iso(_text("publishedAt")))
    posted = F.coalesce(native, iso(_text("datePosted")))
    whole = F.try_variant_get("item", "$", "map<string,variant>").isNotNull()
    confidence = F.when(~F.coalesce(whole, F.lit(False)), 0.0).when(platform == "generic_html", 0.3).when(F.col("is_hydrated"), 1.0).otherwise(0.7)
    read = items.withColumns({"location_raw": raw, "_places": F.when(whole, places)})
    read = read.withColumns({"workplace_type": workplace, "remote_scope": F.nullif(F.regexp_extract("location_raw", r"(?i)remote\s*\(([^)]+)\)", 1), F.lit("")), "employment_type": employment, "pay": pay})
    all_remote = F.transform("_places", lambda p: p.withField("is_remote", p["is_remote"] | F.coalesce(F.col("workplace_type") == "remote", F.lit(False))))
    return read.select(*items.columns, "location_raw", all_remote.alias("places"), "workplace_type", "remote_scope", "employment_type", "pay", F.coalesce(posted, F.unix_micros("fetched_at")).alias("posted_micros"), posted.isNull().alias("posted_inferred"), confidence.alias("extraction_confidence"))


def url_identity(external_id: Column, url: Column) -> Column:
    """Which rung of the ladder of ids a posting stands on: external_id, url or content."""
    return F.when(F.trim(external_id) != "", "external_id").when(F.trim(url) != "", "url").otherwise("content")


def complete_listing(pages: DataFrame, most: int = 20) -> DataFrame:
    """company_id, run_id, pages_read, complete of listings in pages (company_id,
    run_id, page_no from 0, status, listed, total): a listing ends with the
    page that reaches the total, an empty page, or the last page allowed; it is
    complete if all its pages up to there came and succeeded (a page that was
    not modified ends it too). Pages behind the end count for nothing."""
    in_order = Window.partitionBy("company_id", "run_id").orderBy("page_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    fine = F.col("status").isin("success", "not_modified")
    ends = (F.col("status") == "not_modified") | (F.sum("listed").over(so_far) >= F.col("total")) | (F.coalesce("listed", F.lit(0)) == 0) | (F.col("page_no") == most - 1)
    marked = pages.filter(F.col("page_no") < most).select("company_id", "run_id", "page_no", fine.alias("fine"), (ends & fine).alias("ends"))
    last = marked.groupBy("company_id", "run_id").agg(F.min(F.when(F.col("ends"), F.col("page_no"))).alias("end"), F.collect_set(F.when(F.col("fine"), F.col("page_no"))).alias("read"))
    wanted = F.sequence(F.lit(0), F.col("end"))
    return last.select("company_id", "run_id", F.size(F.filter("read", lambda n: F.col("end").isNull() | (n <= F.col("end")))).alias("pages_read"), (F.col("end").isNotNull() & (F.size(F.array_except(wanted, "read")) == 0)).alias("complete"))


def hydrated(postings: DataFrame, details: DataFrame) -> DataFrame:
    """postings with description_raw and url of their detail (external_id and
    detail as JSON text): the posting's text and the qualifications, a blank
    line between, and the public address; is_hydrated: a readable detail was
    there. Of details of one posting the greatest text counts."""
    one = details.filter(F.col("external_id").isNotNull()).groupBy("external_id").agg(F.max("detail").alias("_detail"))
    v = F.try_parse_json("_detail")
    part = lambda name: F.nullif(F.trim(F.try_variant_get(v, f"$.jobAd.sections.{name}.text", "string")), F.lit(""))
    text = F.nullif(F.concat_ws("\n\n", part("jobDescription"), part("qualifications")), F.lit(""))
    changes = {"description_raw": F.coalesce(text, "description_raw"), "url": F.coalesce(F.try_variant_get(v, "$.postingUrl", "string"), "url")}
    met = postings.join(one, "external_id", "left")
    return met.select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in postings.columns], F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull(), F.lit(False)).alias("is_hydrated"))
