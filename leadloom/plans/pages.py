"""Queries of web pages. No table holds HTML: a page of every company is made by
arithmetic, with embeds, scripts, blogs, ties and records of several shapes. The
SQL makes the same pages and reads them with regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators import boards, web
from leadloom.plans.analytics import query
from leadloom.sources.tables import table

_N = "cast(substr(id, 4) as bigint)"
_SLUG = "replace(domain, '.example', '')"


def _pick(of: int, *texts: str) -> str:
    return f"case {_N} % {of} " + " ".join(f"when {i} then {t}" for i, t in enumerate(texts)) + " else '' end"


_ROLE = lambda i, tag, cls: f"""case when {_N} % 5 >= {i} then concat('<{tag} class="{cls}"><a href="/jobs/role-{i}"><h3>Role {i}</h3><span class="job-city">', case when {i} % 2 = 0 then 'Berlin' else 'Remote, EU' end, '</span></a></{tag}>') else '' end"""
#: URL and HTML of a company's page, in SQL that both engines read
URL = f"case when {_N} % 11 = 0 then concat('https://jobs.lever.co/', {_SLUG}, '/x') when {_N} % 11 = 1 then concat('https://apply.workable.com/j/', {_N}) else concat('https://', domain, '/') end"
HTML = f"""concat('<html><head><title>', name, '</title>',
    {_pick(6, f'''concat('<script type="application/ld+json">{{"@graph": [{{"@type": "JobPosting", "title": "Lead ', {_N}, '", "identifier": {{"value": "', {_N}, '"}}, "datePosted": "2025-01-02", "jobLocation": "Rome", "employmentType": "INTERN", "baseSalary": {{"value": {{"value": ', {_N}, '}}}}}}, {{"@type": "Thing"}}]}}</script>')''', f'''concat('<script src="https://boards.greenhouse.io/embed/job_board/js?for=', {_SLUG}, '"></script>')''', "'<script>var x = 1;</script>'", '''concat('<script type="application/ld+json">[{"@type": "JobPosting", "title": "', name, '", "url": "/roles/7"}]</script>')''', '''concat('<script type="application/ld+json">{"@type": "JobPosting", ', name, '</script>')''')},
    '</head><body><nav><a href="/blog/careers">Careers blog</a><a href="#top">Jobs</a></nav>', {_pick(7, "'<p>See our open positions</p>'", '''concat('<div id="root"></div>')''', '''concat('<div id="grnhse_app"></div>')''', '''concat('<p>', name, '</p>')''')},
    '<ul class="b a">', {_ROLE(1, 'li', 'role')}, {_ROLE(2, 'li', 'role')}, {_ROLE(3, 'li', 'role')}, '</ul>', case when {_N} % 4 = 1 then '<div class="x"><a href="/jobs/alt-1">Alt one</a></div><div class="x"><a href="/jobs/alt-2">Alt two</a></div><div class="x"><a href="/careers/icons/a.svg">i</a></div>' else '' end,
    '<footer>', {_pick(4, f'''concat('<a href="https://jobs.lever.co/', {_SLUG}, '">Open roles</a>')''', f'''concat('<a href="https://boards.greenhouse.io/', {_SLUG}, '">Jobs</a><a href="https://jobs.ashbyhq.com/', {_SLUG}, '">Jobs</a>')''', """'<a href="/about">About</a>'""", f'''concat('<a href="https://', {_SLUG}, '.recruitee.com/o">Browse all jobs</a><a href="/join-us">Team</a>')''')}, '</footer></body></html>')"""  # fmt: skip


def pages(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "company").select(F.expr(_N).alias("page_id"), F.expr(URL).alias("url"), F.expr(HTML).alias("html"))
    return web.read_pages(made)


_HOST = lambda u: f"lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#:]+)', 1))"
_BY_HOST = lambda h: "case " + " ".join(f"when {h} = '{host}' or ends_with({h}, '.{host}') then '{name}'" for name, host in rules.HOSTS) + " end"
#: RE2 has no look-ahead: a path of j names no board
_TOKEN = lambda p, u: f"case {p} " + " ".join(f"""when '{name}' then nullif({f"case when {u} ilike '%apply.workable.com/j/%' then '' else " if name == 'workable' else ''}regexp_extract({u}, '{pattern.replace("(?!j/)", "")}', 1){' end' if name == 'workable' else ''}, '')""" for name, pattern in rules.TOKENS.items()) + " end"
_EMBED = "case " + " ".join(f"when contains(lower(src), '{part}') then '{name}'" for name, part in rules.EMBEDS) + " end"
_A = '<a href="([^"]*)">(.*?)</a>'


def _anchors_of(part: str, at: int) -> str:
    return f"select page_id, {at} as part, i, regexp_extract_all({part}, '{_A}', 1)[i] as href, regexp_extract_all({part}, '{_A}', 2)[i] as inner_, {at} <> 1 as chrome from (select page_id, {part}, unnest(range(1, len(regexp_extract_all({part}, '{_A}')) + 1)) as i from p)"


READ = f"""with raw as (select {_N} as page_id, {URL} as url, {HTML} as html from company), p as (select *, regexp_extract(html, '<nav>(.*)</nav>', 1) as nav, regexp_extract(html, '</nav>(.*)<footer>', 1) as main, regexp_extract(html, '<footer>(.*)</footer>', 1) as foot, nullif(regexp_extract(html, '<script type="application/ld\\+json">(.*?)</script>', 1), '') as ld, regexp_extract(html, '<script src="([^"]*)"', 1) as src from raw),
    a0 as ({_anchors_of('nav', 0)} union all {_anchors_of('main', 1)} union all {_anchors_of('foot', 2)}),
    a as (select a0.*, row_number() over (partition by page_id order by part, i) - 1 as pos, regexp_replace(inner_, '<[^>]*>', '', 'g') as text, case when href like 'http%' then href when href like '#%' then url || href else regexp_extract(url, '^[a-z]+://[^/]+', 0) || href end as link from a0 join p using (page_id)),
    jobs as (select * from a where regexp_matches(href, '{rules.JOB_LINK}') and not regexp_matches(href, '{rules.ASSET_LINK}')),
    records as (select page_id, url, case json_type(ld::json) when 'ARRAY' then cast(ld::json as json[]) when 'OBJECT' then coalesce(cast(ld::json -> '$."@graph"' as json[]), [ld::json]) end as rs from p where ld is not null and json_valid(ld)),
    posts as (select page_id, url, list_filter(rs, lambda r: r ->> '$."@type"' = 'JobPosting') as rs from records),
    prints as (select page_id, {_BY_HOST(_HOST('url'))} as host, {_TOKEN(_BY_HOST(_HOST('url')), 'url')} as host_token, {_EMBED} as embed, {_TOKEN(_EMBED, 'src')} as embed_token, case when contains(html, 'id="grnhse_app"') then 'greenhouse' end as dom from p),
    f as (select page_id, coalesce(host, embed, dom) as platform, case when host is not null then host_token when embed is not null then embed_token end as token, case when host is not null then 'url_host' when embed is not null then 'embed' when dom is not null then 'dom' end as signal,
    case when host is not null then {rules.FINGERPRINTS['url_host']}::double when embed is not null then {rules.FINGERPRINTS['embed']}::double when dom is not null then {rules.FINGERPRINTS['dom']}::double end as confidence from prints) """
_POINTS = rules.ANCHOR_POINTS
_BEST = f"""best as (select * from (select *, row_number() over (partition by page_id order by score desc, pos) as k from (select page_id, pos, link, case when regexp_matches(text, '{rules.LINK_TEXT.replace("'", "''")}') then {_POINTS['text']} else 0 end + case when regexp_matches(href, '{rules.LINK_HREF}') then {_POINTS['href']} else 0 end + case when {_BY_HOST(_HOST('link'))} is not null then {_POINTS['board']} else 0 end
    + case when chrome then {_POINTS['chrome']} else 0 end + case when regexp_matches(href, '{rules.BLOG_HREF}') then {_POINTS['blog']} else 0 end + case when regexp_matches(text, '{rules.AGGREGATOR_TEXT}') then {_POINTS['aggregator']} else 0 end as score from a where href not like '#%') where score >= 5) where k = 1) """


@query(READ + ", " + _BEST + "select page_id, link, score from best")
def best_anchor(spark: SparkSession, folder: str) -> DataFrame:
    return web.best_anchor(pages(spark, folder))


@query(READ + ", " + _BEST + f"select page_id, {_BY_HOST(_HOST('link'))} as platform, {_TOKEN(_BY_HOST(_HOST('link')), 'link')} as token from best")
def board_tokens(spark: SparkSession, folder: str) -> DataFrame:
    links = web.best_anchor(pages(spark, folder))
    platform = web.platform_of_host(web.host_of(F.col("link")))
    return links.select("page_id", platform.alias("platform"), web.board_token(platform, F.col("link")).alias("token"))


@query(
    READ
    + """, c as (select *, case when href like '/jobs/role%' then 'li' else 'div' end as around from jobs), n as (select page_id, around, count(*) as size from c group by all), o as (select *, coalesce(lead(size) over (partition by page_id order by size desc), 0) as next, row_number() over (partition by page_id order by size desc) as k from n)
    select page_id, pos::int as pos, link, text, coalesce(nullif(regexp_extract(inner_, '<h3>(.*?)</h3>', 1), ''), text) as title, nullif(regexp_extract(inner_, '<span class="job-city">(.*?)</span>', 1), '') as place from c join (select page_id, around from o where k = 1 and size >= 2 and size > next) using (page_id, around)"""
)
def generic_job_links(spark: SparkSession, folder: str) -> DataFrame:
    return web.job_links(pages(spark, folder))


@query(
    READ
    + """, r as (select page_id, url, unnest(rs) as r, unnest(range(len(rs))) as n from posts) select page_id, n::bigint as record_pos, r ->> '$.title' as title, coalesce(r ->> '$.url', url) as url, r ->> '$.identifier.value' as external_id, r ->> '$.jobLocation' as location_raw, case r ->> '$.employmentType' when 'INTERN' then 'internship' end as employment_type,
    (r ->> '$.baseSalary.value.value')::double as pay_max, coalesce(epoch_us((r ->> '$.datePosted')::timestamptz), 0) as posted_micros from r"""
)
def jsonld_postings(spark: SparkSession, folder: str) -> DataFrame:
    records = web.jsonld_postings(pages(spark, folder)).withColumns({"platform": F.lit("jsonld"), "fetched_at": F.timestamp_micros(F.lit(0)), "is_hydrated": F.lit(True)})
    return boards.posting_details(records).select("page_id", "record_pos", "title", "url", "external_id", "location_raw", "employment_type", F.col("pay.max").alias("pay_max"), "posted_micros")


@query(READ + f"select page_id, regexp_matches(main, '{rules.CAREERS_COPY}') or (select count(*) from a where a.page_id = p.page_id and regexp_matches(href, '{rules.JOB_DETAIL}')) >= 3 or coalesce((select len(rs) from posts where posts.page_id = p.page_id), 0) > 0 as valid from p")
def careers_validation(spark: SparkSession, folder: str) -> DataFrame:
    return web.is_careers_page(pages(spark, folder))


@query(READ + "select * from f")
def page_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return web.fingerprint(pages(spark, folder))


@query(
    READ
    + f"""select page_id, case when f.platform in ({', '.join(f"'{p}'" for p in rules.ROUTABLE)}) and confidence >= {rules.ROUTING_LEAST} then f.platform when coalesce(len(rs), 0) > 0 then 'jsonld' when page_id not in (select page_id from jobs) and (contains(html, 'id="root"') or embed is not null) then 'rendered_dom' else 'generic_html' end as route
    from p join f using (page_id) join prints using (page_id) left join posts using (page_id)"""
)
def route_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return web.route(pages(spark, folder))


_STRATEGIES = tuple(rules.RESOLUTION)


@query(
    "with c as (" + " union all ".join(f"select id as company_id, '{s}:' || domain as url, '{s}' as strategy, {n} as step, {sure}::double as confidence, {_N} % {n + 2} = 0 as validated from company where {_N} % {n + 3} = {n % 3}" for n, (s, sure) in enumerate(rules.RESOLUTION.items()))
    + ") select company_id, url, strategy, confidence, case when confidence < 0.5 then 'needs_review' when strategy <> 'manual' and not validated then 'resolution_unvalidated' else 'resolved' end as status from (select *, row_number() over (partition by company_id order by step, url) as k from c) where k = 1"
)
def resolution_ladder(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of all strategies, made by arithmetic."""
    companies = table(spark, folder, "company").select(F.col("id").alias("company_id"), "domain", F.expr(_N).alias("n"))
    each = [F.when(F.col("n") % (i + 3) == i % 3, F.struct(F.concat(F.lit(s + ":"), F.col("domain")).alias("url"), F.lit(s).alias("strategy"), (F.col("n") % (i + 2) == 0).alias("validated"))) for i, s in enumerate(_STRATEGIES)]
    return web.resolved_source(companies.select("company_id", F.inline(F.array_compact(F.array(*each)))))


_SITE = f"""case when {_N} % 3 = 0 then concat('<sitemapindex><sitemap><loc>https://', domain, '/s0.xml</loc></sitemap><sitemap><loc>https://', domain, '/s1.xml</loc></sitemap></sitemapindex>') when {_N} % 3 = 1 then concat('<urlset><url><loc>https://', domain, '/about</loc></url><url><loc> https://', domain, '/careers/all </loc></url></urlset>') else '<urlset></urlset>' end"""


@query(f"select {_N} as page_id, case when {_N} % 3 = 0 then 'https://' || domain || '/jobs' || {_N} % 2 else 'https://' || domain || '/careers/all' end as link from company where {_N} % 3 < 2")
def sitemap_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Sitemaps of the companies; an index has two parts, of which the first has no careers page for every other company."""
    c = table(spark, folder, "company")
    own = c.select(F.expr(_N).alias("page_id"), F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")).alias("url"), F.expr(_SITE).alias("html"))
    part = lambda i: c.filter(F.expr(f"{_N} % 3 = 0")).select((-F.expr(_N)).alias("page_id"), F.concat(F.lit("https://"), "domain", F.lit(f"/s{i}.xml")).alias("url"), F.when(F.expr(f"{_N} % 2 <= {i}"), F.concat(F.lit("<url><loc>https://"), "domain", F.lit("/x</loc></url><url><loc>https://"), "domain", F.lit("/jobs"), F.expr(f"{_N} % 2").cast("string"), F.lit("</loc></url>"))).otherwise("<urlset/>").alias("html"))
    read = web.read_pages(own.unionByName(part(0)).unionByName(part(1)))
    return web.sitemap_candidates(read).filter("page_id >= 0")


@query(f"select u as url, not ({_N} % 2 = 0 and p = '/private/x') and not ({_N} % 3 = 0 and p = '/jobs/y') as allowed from (select id, domain, unnest(['/private/x', '/jobs/y', '/']) as p, 'https://' || domain || p as u from company)")
def robots_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Three addresses of every company against its robots text; every company of a sixth part has none."""
    c = table(spark, folder, "company").select("domain", F.expr(_N).alias("n"))
    urls = c.select(F.explode(F.transform(F.array(*[F.lit(p) for p in ("/private/x", "/jobs/y", "/")]), lambda p: F.concat(F.lit("https://"), "domain", p))).alias("url"))
    rules_ = F.concat(F.lit("User-agent: *\n"), F.when(F.col("n") % 2 == 0, "Disallow: /private\n").otherwise(""), F.when(F.col("n") % 3 == 0, "Disallow: /jobs/\n").otherwise(""))
    robots = c.filter("n % 2 = 0 or n % 3 = 0").select(F.col("domain").alias("host"), rules_.alias("text"))
    return web.allowed_by_robots(urls, robots)


@query(
    """with t as (select url, row_number() over (partition by url order by fetched_at, page_id) as attempt, status_code as code from board_page), k as (select *, coalesce(code = 429 or code >= 500, true) as again from t where attempt <= 4),
    e as (select url, arg_min(code, attempt) filter (not again) as c, min(attempt) filter (not again) as a, max(attempt) as la, arg_max(code, attempt) as lc from k group by 1)
    select url, coalesce(a, la)::int as attempts, coalesce(c, lc) as status_code, case when a is null then 'unavailable' when c = 304 then 'not_modified' when c in (401, 403) then 'denied' when c = 404 then 'missing' when c < 400 then 'ok' else 'failed' end as outcome from e"""
)
def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The fetches of each address of a board, in order, as attempts."""
    in_order = Window.partitionBy("url").orderBy("fetched_at", "page_id")
    tries = table(spark, folder, "board_page").select("url", F.row_number().over(in_order).alias("attempt"), "status_code")
    return web.fetch_outcome(tries)


@query(
    f"""with s as (select id as company_id, {_N} as n, domain from company) select company_id, case when n % 3 = 0 then 'https://any.example/' || n when n % 5 < 2 then 'https://jobs.' || domain || '/r' else 'https://jobs.lever.co/' || n end as url, case when n % 3 = 0 then 'search_restricted' else 'search_open' end as strategy from s where n % 3 = 0 or n % 5 < 4"""
)
def search_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Search results made by arithmetic: a restricted one for every third company, open ones on a foreign host, the company's own, and a board."""
    c = table(spark, folder, "company").select(F.col("id").alias("company_id"), "domain", F.expr(_N).alias("n"))
    row = lambda restricted, pos, url: F.struct(F.lit(restricted).alias("restricted"), F.lit(pos).alias("pos"), url.alias("url"))
    results = F.array(
        F.when(F.col("n") % 3 == 0, row(True, 3, F.concat(F.lit("https://any.example/"), F.col("n").cast("string")))), row(False, 0, F.concat(F.lit("https://not"), "domain", F.lit("/q"))),
        F.when(F.col("n") % 5 < 2, row(False, 1, F.concat(F.lit("https://jobs."), "domain", F.lit("/r")))), F.when(F.col("n") % 5 < 4, row(False, 2, F.concat(F.lit("https://jobs.lever.co/"), F.col("n").cast("string")))),
    )
    return web.search_candidates(c.select("company_id", "domain", F.inline(F.array_compact(results))))


_PATH = lambda n, i: f"({n} * 7 + {i} * 3) % 5"


@query(
    f"""with t as (select id as company_id, {_N} as n, domain, unnest(range({len(rules.CAREERS_PATHS)})) as i from company), m as (select *, ['{"', '".join(rules.CAREERS_PATHS)}'][i + 1] as path, {_PATH('n', 'i')} as k from t)
    select company_id, arg_min('https://' || domain || path, i) as link from m where k in (1, 4) and (n + i) % 2 = 0 group by 1"""
)
def path_probe(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the usual paths of every company: head 404, 405 or 200, page 200 or 500, a careers page or not, by arithmetic."""
    c = table(spark, folder, "company").select(F.col("id").alias("company_id"), F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), "domain", F.expr(_N).alias("n"))
    asked = c.select("domain", "n", F.posexplode(F.array(*[F.lit(p) for p in rules.CAREERS_PATHS])).alias("i", "path")).withColumn("k", F.expr(_PATH("n", "i")))
    fetched = asked.select(F.concat(F.lit("https://"), "domain", "path").alias("url"), F.element_at(F.array(*[F.lit(x) for x in (404, 405, 200, 404, 200)]), (F.col("k") + 1).cast("int")).alias("head_code"), F.when(F.col("k") == 2, 500).otherwise(200).alias("code"), ((F.col("n") + F.col("i")) % 2 == 0).alias("is_careers"))
    return web.path_candidates(c.select("company_id", "url"), fetched)


_BODY = f"""case when {_N} % 4 = 0 then concat('{{"results": [{{"title": "A', {_N}, '", "url": "u"}}, {{"n": 1}}]}}') when {_N} % 4 = 1 then concat('[{{"name": "B', {_N}, '", "jobUrl": "v"}}]') when {_N} % 4 = 2 then '[{{"n": 1}}, {{"n": 2}}, {{"n": 3}}, {{"title": "few"}}]' else 'not json' end""".replace("{{", "{").replace("}}", "}")


@query(
    f"""with c as (select {_N} as page_id, ({_BODY}) as body from company where {_N} % 4 < 2), l as (select page_id, cast(case when json_type(body::json) = 'ARRAY' then body::json else body::json -> '$.results' end as json[]) as items from c), r as (select page_id, unnest(items) as item, unnest(range(len(items))) as i from l)
    select page_id, i::bigint as item_pos, coalesce(item ->> '$.title', item ->> '$.name') as title, coalesce(item ->> '$.url', item ->> '$.jobUrl') as url from r"""
)
def captured_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Responses that pages asked for: a settings object before a job list, or no job list."""
    c = table(spark, folder, "company").select(F.expr(_N).alias("page_id"), F.array(F.lit('{"user": 1}'), F.expr(_BODY)).alias("bodies"))
    return web.captured_postings(c.select("page_id", F.posexplode("bodies").alias("pos", "body")))


_STATE = f"""concat('<html><script id="__NEXT_DATA__" type="application/json">{{"props": {{"pageProps": {{"dehydratedState": {{"queries": [{{"queryKey": ["a", "b", "other"], "state": {{"data": {{"items": [{{"id": 0}}]}}}}}}, {{"queryKey": ["a", "b", "job-posts"], "state": {{"data": {{"items": [{{"id": ', {_N}, ', "name": "Role ', {_N} % 9, '", "url": "u"}}, {{"id": "x", "name": null}}]}}}}}}]}}}}}}}}</script></html>')"""


@query(f"with c as (select {_N} as page_id from company) select page_id, 0::bigint as item_pos, page_id::varchar as external_id, 'Role ' || page_id % 9 as title, 'u' as url from c union all select page_id, 1, 'x', null, null from c")
def embedded_items(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "company").select(F.expr(_N).alias("page_id"), F.lit("https://a.example").alias("url"), F.expr(_STATE).alias("html"))
    return web.next_data_postings(web.read_pages(made))
