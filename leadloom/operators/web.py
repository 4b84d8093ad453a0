"""Web pages to anchors, texts and embedded records, and the ladders that find
a company's board: links, known hosts, paths, sitemaps.

HTML is read once per page by a vectorised function on the standard parser; all
that follows is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from urllib import robotparser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.operators.tables import top_rows

#: keys under which captured responses keep their job list
LIST_KEYS = ("jobs", "postings", "results", "data", "items", "content", "offers")
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = ("script", "style", "noscript", "template")
_CHROME = ("nav", "header", "footer")
PAGE = (
    "page_id bigint, url string, anchors array<struct<pos:int,href:string,link:string,text:string,in_chrome:boolean,cluster:string,title:string,place:string>>, "
    "body string, description string, records array<string>, sources array<string>, sitemap array<string>, is_index boolean, next_data string, marks array<string>"
)


class _Page(HTMLParser):
    """One page as a list of elements in document order, each with the span of
    elements and of texts in it, and what is looked for on the way: meta
    descriptions, ld+json scripts, sources, marks of platforms."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []  # tag, classes, parent, first text, end of texts, end of elements, href
        self.texts: list[str] = []
        self.stack: list[int] = []
        self.body: list[str] = []
        self.meta: dict[str, str] = {}
        self.records: list[str] = []
        self.sources: list[str] = []
        self.marks: dict[str, bool] = {}
        self.script: list[str] | None = None
        self.kind = self.next_data = ""

    def _mark(self, at: dict[str, str]) -> None:
        classes = at.get("class", "").split()
        for platform, sort, name in rules.DOM_MARKS:
            met = {"#": at.get("id") == name, "#*": name in at.get("id", ""), ".": name in classes, ".*": name in at.get("class", ""), "[]": name in at}[sort]
            if met:
                self.marks[platform] = True
        if at.get("id") in rules.SPA_ROOTS:
            self.marks["spa"] = True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v or "" for k, v in attrs}
        if tag == "meta":
            name = (at.get("name") or at.get("property") or "").lower()
            if name in ("description", "og:description"):
                self.meta.setdefault(name, at.get("content", ""))
        if tag in ("script", "iframe") and at.get("src"):
            self.sources.append(at["src"])
        if tag == "script":
            self.kind = "next" if at.get("id") == "__NEXT_DATA__" else "ld" if "ld+json" in at.get("type", "").lower() else ""
            self.script = []
        self._mark(at)
        n = len(self.nodes)
        self.nodes.append([tag, " ".join(sorted(at.get("class", "").split())), self.stack[-1] if self.stack else -1, len(self.texts), len(self.texts), n + 1, at["href"].strip() if tag == "a" and "href" in at else None])
        if tag not in _VOID:
            self.stack.append(n)

    def _end(self, depth: int) -> None:
        for n in self.stack[depth:]:
            self.nodes[n][4:6] = len(self.texts), len(self.nodes)
        del self.stack[depth:]

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.script is not None:
            text = "".join(self.script)
            if self.kind == "ld":
                self.records.append(text)
            elif self.kind == "next":
                self.next_data = text
            self.script = None
        for k in range(len(self.stack) - 1, -1, -1):
            if self.nodes[self.stack[k]][0] == tag:
                self._end(k)
                break

    def handle_data(self, data: str) -> None:
        if self.script is not None:
            self.script.append(data)
            return
        self.texts.append(data)
        if data.strip() and not any(self.nodes[n][0] in _HIDDEN or self.nodes[n][0] in _CHROME for n in self.stack):
            self.body.append(" ".join(data.split()))

    def handle_comment(self, data: str) -> None:
        if data == rules.SUSPENSE_MARK.removeprefix("<!--").removesuffix("-->"):
            self.marks["spa"] = True

    def close(self) -> None:
        super().close()
        self._end(0)

    def text(self, n: int) -> str:
        return " ".join("".join(self.texts[self.nodes[n][3] : self.nodes[n][4]]).split())

    def _place(self, n: int, title: str) -> str | None:
        """The text in element n that is like a place: by its class, else by its words."""
        inner = [(self.nodes[k][1], self.text(k)) for k in range(n + 1, self.nodes[n][5])]
        inner = [(c, t) for c, t in inner if t and t != title and len(t) <= rules.PLACE_LENGTH]
        return next((t for c, t in inner if re.search(rules.PLACE_CLASS, c)), None) or next((t for _, t in inner if re.search(rules.PLACE_TEXT, t)), None)

    def anchors(self, base: str) -> list[tuple]:
        """Anchors with their text, title (of a heading in them, else the text) and
        place (in them, else in the element around that holds no other anchor)."""
        out = []
        for n, (tag, _, parent, *_, href) in enumerate(self.nodes):
            if tag != "a" or href is None:
                continue
            text = self.text(n)
            heads = (self.text(k) for k in range(n + 1, self.nodes[n][5]) if self.nodes[k][0] in rules.HEADINGS)
            title = next((t for t in heads if t), text)
            place, up, chrome = None, parent, False
            while up >= 0:
                chrome = chrome or self.nodes[up][0] in _CHROME
                up = self.nodes[up][2]
            if re.search(rules.JOB_LINK, href):
                place = self._place(n, title)
                if place is None and parent >= 0 and sum(self.nodes[k][0] == "a" for k in range(parent + 1, self.nodes[parent][5])) <= 1:
                    place = self._place(parent, title)
            around = self.nodes[parent] if parent >= 0 else ("", "")
            out.append((len(out), href, urljoin(base, href), text, chrome, f"{around[0]}.{around[1]}", title, place))
        return out


def _postings_in(text: str) -> Iterator[str]:
    """JobPosting objects of one ld+json script: an object, a list, or a graph; bad JSON holds none."""
    try:
        got = json.loads(text)
    except ValueError:
        return
    items = got if isinstance(got, list) else got.get("@graph", [got]) if isinstance(got, dict) else []
    for item in items if isinstance(items, list) else []:
        if isinstance(item, dict) and item.get("@type") == "JobPosting":
            yield json.dumps(item, ensure_ascii=False)


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url and what its html holds: anchors in document order (with
    absolute link, text, whether inside nav, header or footer, the tag and
    classes around, title and place of job links), body text (a line for each
    text), description, JobPosting records, script and frame sources, sitemap
    locations and whether they are sitemaps, embedded page data, marks of
    platforms and of pages made by scripts. Null and empty html holds nothing."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page_id, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                page = _Page()
                page.feed(html or "")
                page.close()
                records = [r for text in page.records for r in _postings_in(text)]
                sitemap = re.findall(r"(?is)<loc>\s*(.*?)\s*</loc>", html or "")
                is_index = bool(re.search(r"(?i)<sitemapindex[\s>]", html or ""))
                rows.append((page_id, url, page.anchors(url or ""), "\n".join(page.body), page.meta.get("description") or page.meta.get("og:description"), records, page.sources, sitemap, is_index, page.next_data or None, sorted(page.marks)))
            yield pd.DataFrame(rows, columns=["page_id", "url", "anchors", "body", "description", "records", "sources", "sitemap", "is_index", "next_data", "marks"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInPandas(read, PAGE)


def _let(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def platform_of_host(host: Column, hosts: tuple[tuple[str, str], ...] = rules.HOSTS) -> Column:
    """The platform of a board host (equal or a subdomain), or null."""
    return _let(host, lambda h: F.coalesce(*[F.when((h == suffix) | h.endswith("." + suffix), F.lit(name)) for name, suffix in hosts]))


def board_token(platform: Column, url: Column) -> Column:
    """The board's name in a URL of its platform, or null."""


    def token(p: Column) -> Column:
        cases = F.when(F.lit(False), F.lit(None).cast("string"))
        for name, pattern in rules.TOKENS.items():
            cases = cases.when(p == name, F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")))
        return cases

    return _let(platform, token)


def job_like(href: Column) -> Column:
    return href.rlike(rules.JOB_LINK) & ~href.rlike(rules.ASSET_LINK)


def anchors(read: DataFrame) -> DataFrame:
    """One row per anchor: page_id, pos, href, link, text, in_chrome, cluster, score (how like a careers link)."""
    rows = read.select("page_id", F.inline("anchors"))
    known = platform_of_host(host_of(F.col("link"))).isNotNull()
    tests = {"text": F.col("text").rlike(rules.LINK_TEXT), "href": F.col("href").rlike(rules.LINK_HREF), "board": known, "chrome": F.col("in_chrome"), "blog": F.col("href").rlike(rules.BLOG_HREF), "aggregator": F.col("text").rlike(rules.AGGREGATOR_TEXT)}
    points = [(tests[name], n) for name, n in rules.ANCHOR_POINTS.items()]
    return rows.withColumn("score", reduce(lambda a, b: a + b, [F.when(c, F.lit(n)).otherwise(0) for c, n in points]))


def best_anchor(read: DataFrame, least: int = 5) -> DataFrame:
    """The best careers link of each page, the first in the document of equals: page_id, link, score."""
    rows = anchors(read).filter((F.col("href") != "") & ~F.col("href").rlike(r"^(?i)(?:#|mailto:|tel:|javascript:)") & (F.col("score") >= least))
    return top_rows(rows, ["page_id"], [F.desc("score"), F.col("pos")], 1).select("page_id", "link", "score")


def is_careers_page(read: DataFrame) -> DataFrame:
    """page_id, valid: careers wording, three job links, or a JobPosting record."""
    details = F.size(F.filter("anchors", lambda a: a["href"].rlike(rules.JOB_DETAIL)))
    return read.select("page_id", (F.col("body").rlike(rules.CAREERS_COPY) | (details >= 3) | (F.size("records") > 0)).alias("valid"))


def job_links(read: DataFrame) -> DataFrame:
    """Job links of pages without a known board: page_id, pos, link, text, title, place. Of the
    links that look like jobs (the first of each address), the group with the
    same surroundings that is larger than all others, with two links or more."""
    links = anchors(read).filter(job_like(F.col("href")))
    links = top_rows(links, ["page_id", "link"], [F.col("pos")], 1, "_n")
    sizes = links.groupBy("page_id", "cluster").agg(F.count("*").alias("size"))
    ranked = Window.partitionBy("page_id").orderBy(F.desc("size"))
    sizes = sizes.withColumn("_place", F.row_number().over(ranked)).withColumn("_next", F.lead("size").over(ranked))
    largest = sizes.filter((F.col("_place") == 1) & (F.col("size") >= 2) & (F.col("size") > F.coalesce("_next", F.lit(0))))
    return links.join(largest.select("page_id", "cluster"), ["page_id", "cluster"], "left_semi").select("page_id", "pos", "link", "text", "title", "place")


def jsonld_postings(read: DataFrame) -> DataFrame:
    """page_id, record_pos, title, url, posted, external_id, item (the record as
    VARIANT, for ``boards.posting_details``) of embedded JobPosting records."""
    rows = read.select("page_id", F.col("url").alias("page_url"), F.posexplode("records").alias("record_pos", "record"))
    v = F.try_parse_json("record")
    get = lambda path: F.try_variant_get(v, path, "string")
    return rows.select("page_id", F.col("record_pos").cast("bigint").alias("record_pos"), get("$.title").alias("title"), F.coalesce(get("$.url"), F.col("page_url")).alias("url"), get("$.datePosted").alias("posted"), F.coalesce(get("$.identifier.value"), get("$.identifier")).alias("external_id"), v.alias("item"))


def _job_link(a: Column) -> Column:
    return a["href"].rlike(rules.JOB_LINK) & ~a["href"].rlike(rules.ASSET_LINK)


def _embedded(source: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(source).contains(part), F.lit(name)) for name, part in rules.EMBEDS])


def _first_known(urls: Column, platform) -> Column:  # noqa: ANN001
    return F.try_element_at(F.filter(urls, lambda u: platform(u).isNotNull()), F.lit(1))


def _print(read: DataFrame) -> Column:
    """The fingerprint of a page as struct(platform, token, signal, confidence); see ``fingerprint``."""
    has = lambda c, kind: F.col(c) if c in read.columns else F.lit(None).cast(kind)
    by_host = lambda u: platform_of_host(host_of(u))
    bare = lambda h: platform_of_host(F.lower(h))
    source, asked, alias = _first_known(F.col("sources"), _embedded), _first_known(has("requests", "array<string>"), by_host), _first_known(has("aliases", "array<string>"), bare)
    marked = F.coalesce(*[F.when(F.array_contains("marks", name), F.lit(name)) for name, *_ in rules.DOM_MARKS])
    none = F.lit(None).cast("string")
    ways = {
        "url_host": (by_host(F.col("url")), F.col("url")), "redirect": (by_host(has("final_url", "string")), has("final_url", "string")), "embed": (_embedded(source), source),
        "network": (by_host(asked), asked), "dom": (marked, none), "cname": (bare(alias), F.col("url")),
    }

    def told(signal: str, platform: Column, of: Column) -> Column:
        found = lambda p: F.struct(p.alias("platform"), board_token(p, of).alias("token"), F.lit(signal).alias("signal"), F.lit(rules.FINGERPRINTS[signal]).alias("confidence"))
        return _let(platform, lambda p: F.when(p.isNotNull(), found(p)))

    return F.coalesce(*[told(signal, *way) for signal, way in ways.items()])


def fingerprint(read: DataFrame) -> DataFrame:
    """page_id, platform, token, signal, confidence: the first way that tells a
    page's platform, from the surest on: its host, where it redirects to
    (final_url), an embedded source, a requested host (requests), a mark in the
    page (no token), an alias of its host (aliases). final_url, requests and
    aliases are optional columns. All null if nothing tells it."""
    return read.select("page_id", _print(read).alias("_f")).select("page_id", "_f.platform", "_f.token", "_f.signal", "_f.confidence")


def route(read: DataFrame) -> DataFrame:
    """page_id, route: the first way that fits to read a page: the platform it
    surely has and that has an adapter, JobPosting records, rendering (no job
    links, but an embed or a page made by scripts), else its links."""
    sure = _let(_print(read), lambda f: F.when(f["platform"].isin(*rules.ROUTABLE) & (f["confidence"] >= rules.ROUTING_LEAST), f["platform"]))
    scripted = F.array_contains("marks", "spa") | F.exists("sources", lambda s: _embedded(s).isNotNull())
    rendered = F.when(~F.exists("anchors", _job_link) & scripted, "rendered_dom")
    return read.select("page_id", F.coalesce(sure, F.when(F.size("records") > 0, "jsonld"), rendered, F.lit("generic_html")).alias("route"))


def allowed_by_robots(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """urls with allowed: by the robots text of the host (host, text); hosts without one allow all."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers: dict[str, robotparser.RobotFileParser] = {}
        for batch in batches:
            out = []
            for url, text in zip(batch["url"], batch["robots"], strict=True):
                if text is None:
                    out.append(True)
                    continue
                if text not in parsers:
                    parsers[text] = robotparser.RobotFileParser()
                    parsers[text].parse(text.splitlines())
                out.append(parsers[text].can_fetch(agent, url))
            yield pd.DataFrame({"url": batch["url"], "allowed": out})

    joined = urls.select("url", host_of(F.col("url")).alias("host")).join(robots.select("host", F.col("text").alias("robots")), "host", "left")
    return joined.select("url", "robots").mapInPandas(judge, "url string, allowed boolean")


def next_data_postings(read: DataFrame) -> DataFrame:
    """page_id, item_pos, external_id, title, url of job items in embedded page
    data: the items of the query whose key names job posts."""
    queries = F.try_variant_get(F.try_parse_json("next_data"), "$.props.pageProps.dehydratedState.queries", "array<variant>")
    jobs = F.filter(queries, lambda q: F.try_variant_get(q, "$.queryKey[2]", "string") == "job-posts")
    items = F.flatten(F.transform(jobs, lambda q: F.coalesce(F.try_variant_get(q, "$.state.data.items", "array<variant>"), F.array().cast("array<variant>"))))
    rows = read.select("page_id", F.posexplode(items).alias("item_pos", "item"))
    return rows.select("page_id", F.col("item_pos").cast("bigint").alias("item_pos"), *[F.try_variant_get("item", f"$.{k}", "string").alias(n) for k, n in (("id", "external_id"), ("name", "title"), ("url", "url"))])


def captured_postings(captured: DataFrame) -> DataFrame:
    """page_id, item_pos, title, url of the first captured response (page_id,
    pos, body) of a page that looks like a job list: a list, or the first list
    under a usual key, of whose items half or more, one at least, have a title."""
    body = F.try_parse_json("body")
    lists = F.coalesce(F.try_variant_get(body, "$", "array<variant>"), *[F.try_variant_get(body, f"$.{k}", "array<variant>") for k in LIST_KEYS])
    title = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in ("title", "name", "text")])
    named = captured.select("page_id", "pos", lists.alias("items")).withColumn("titled", F.size(F.filter("items", lambda v: title(v).isNotNull())))
    good = named.filter((F.col("titled") >= F.greatest(F.lit(1), F.floor(F.size("items") / 2))))
    first = top_rows(good, ["page_id"], [F.col("pos")], 1)
    rows = first.select("page_id", F.posexplode("items").alias("item_pos", "item"))
    return rows.select("page_id", F.col("item_pos").cast("bigint").alias("item_pos"), title(F.col("item")).alias("title"), F.coalesce(*[F.try_variant_get("item", f"$.{k}", "string") for k in ("url", "absolute_url", "hostedUrl", "jobUrl")]).alias("url"))


def sitemap_candidates(read: DataFrame, most: int = 10) -> DataFrame:
    """page_id, link: the first address of a sitemap whose path is like a careers
    page's. A sitemap of sitemaps stands for the first so many of them that
    were read too (by url), in order."""
    own = read.filter("not is_index").select("page_id", F.lit(0).alias("part"), F.posexplode("sitemap").alias("pos", "link"))
    parts = read.filter("is_index").select("page_id", F.posexplode(F.slice("sitemap", 1, most)).alias("part", "child"))
    theirs = parts.join(read.select(F.col("url").alias("child"), "sitemap"), "child").select("page_id", "part", F.posexplode("sitemap").alias("pos", "link"))
    path = F.regexp_extract("link", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return own.unionByName(theirs).filter(path.rlike(rules.LINK_HREF)).groupBy("page_id").agg(F.min_by("link", F.struct("part", "pos")).alias("link"))


def search_candidates(results: DataFrame) -> DataFrame:
    """company_id, url, strategy of web search results (company_id, domain,
    restricted, pos, url): the first of a search restricted to the domain, else
    the first of an open one on the domain or a known board."""
    host = host_of(F.col("url"))
    own = (host == F.lower("domain")) | host.endswith(F.concat(F.lit("."), F.lower("domain")))
    fit = results.filter((F.coalesce("url", F.lit("")) != "") & (F.col("restricted") | F.coalesce(own, F.lit(False)) | platform_of_host(host).isNotNull()))
    best = fit.groupBy("company_id").agg(F.min(F.struct((~F.col("restricted")).alias("open"), "pos", "url")).alias("_b"))
    return best.select("company_id", "_b.url", F.when(F.col("_b.open"), "search_open").otherwise("search_restricted").alias("strategy"))


def resolved_source(candidates: DataFrame) -> DataFrame:
    """One source per company of candidates (company_id, url, strategy, validated):
    that of the first strategy of the ladder, with its confidence; what is not
    validated stops the ladder. status: needs_review (confidence below 0.5),
    resolution_unvalidated or resolved."""
    ladder = F.create_map(*[F.lit(x) for n, (name, sure) in enumerate(rules.RESOLUTION.items()) for x in (name, F.struct(F.lit(n).alias("step"), F.lit(sure).alias("confidence")))])
    known = candidates.withColumn("_l", F.try_element_at(ladder, F.col("strategy"))).filter("_l is not null")
    first = top_rows(known, ["company_id"], [F.col("_l.step"), F.col("url")], 1)
    sure = F.col("_l.confidence")
    status = F.when(sure < 0.5, "needs_review").when((F.col("strategy") != "manual") & ~F.coalesce("validated", F.lit(False)), "resolution_unvalidated").otherwise("resolved")
    return first.select("company_id", "url", "strategy", sure.alias("confidence"), status.alias("status"))


def fetch_outcome(attempts: DataFrame, most: int = 4) -> DataFrame:
    """url, attempts, status_code, outcome of logged fetches (url, attempt from 1,
    status_code, null for a transport error): an attempt is repeated after 429,
    5xx and transport errors, so many times at most; the first other one counts:
    ok, not_modified, denied (401, 403), missing (404), failed; else the last: unavailable."""
    again = F.col("status_code").isNull() | (F.col("status_code") == 429) | (F.col("status_code") >= 500)
    tried = attempts.filter(F.col("attempt") <= most)
    ends = tried.groupBy("url").agg(F.min(F.when(~again, F.struct("attempt", "status_code"))).alias("_e"), F.max(F.struct("attempt", "status_code")).alias("_l"))
    code = F.col("_e.status_code")
    outcome = F.when(F.col("_e").isNull(), "unavailable").when(code == 304, "not_modified").when(code.isin(401, 403), "denied").when(code == 404, "missing").when(code < 400, "ok").otherwise("failed")
    return ends.select("url", F.coalesce("_e.attempt", "_l.attempt").alias("attempts"), F.coalesce(code, F.col("_l.status_code")).alias("status_code"), outcome.alias("outcome"))


def path_candidates(sites: DataFrame, fetched: DataFrame) -> DataFrame:
    """company_id, link: of every site (company_id, url of its home) the first
    usual careers path whose HEAD request was good or not supported, whose page
    came, and is a careers page (fetched: url, head_code, code, is_careers)."""
    paths = F.array(*[F.lit(p) for p in rules.CAREERS_PATHS])
    tried = sites.select("company_id", F.regexp_replace("url", "/+$", "").alias("home"), F.posexplode(paths).alias("pos", "path"))
    fine = lambda code: F.col(code).between(200, 299)
    pages = fetched.filter((fine("head_code") | F.col("head_code").isin(405, 501)) & fine("code") & F.col("is_careers")).select(F.col("url").alias("link"))
    found = tried.select("company_id", "pos", F.concat("home", "path").alias("link")).join(pages, "link")
    return found.groupBy("company_id").agg(F.min_by("link", "pos").alias("link"))
