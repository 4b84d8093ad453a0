"""Matching published leads with provider records that share no identifier.

Method: cross-table retrieval. All attributes of a lead are terms of an
inverted index, weighted by BM25 (every term occurs once in a record and
records are of one length, so a weight is its inverse document frequency times
its field's share). A record is scored against the leads that can reach the
least score, and its TOP nearest are compared attribute by attribute. It goes to
its nearest lead. On the lead's side several records may be wanted, as all
repetitions of a person are, so how near the record is to the lead's nearest
counts instead of a place. Score, gap to the next lead, nearness from the
lead's side and agreement give a confidence through a logistic curve. Its labels
come from a mixture of matches and others fitted to the pairs themselves.

Records equal in all compared attributes are one class; classes are matched and
the pairs expanded to their members at the end.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadloom.llm.canonical import SHORT, one_slip
from leadloom.operators.tables import top_rows
from leadloom.session import cut

# Words around names and companies.
HONORIFICS = set("mr ms mrs miss dr prof sir dame phd mba msc bsc md jd cpa esq jr sr ii iii pmp".split())
LEGAL = set("inc llc ltd limited gmbh ag sa se bv nv plc corp corporation co company group holding holdings kg oy ab as srl spa pte pty".split())
SUBDOMAINS = set("www careers mail jobs de en us uk fr es m web app about work team hello".split())
ENDINGS = set("example test com net org io co ai dev app eu de uk us invalid local".split())
#: Short forms of given names.
NICKNAMES = {
    "becca": "rebecca", "becky": "rebecca", "tim": "timothy", "andy": "andrew", "drew": "andrew", "rob": "robert", "bob": "robert", "bobby": "robert", "bert": "robert", "mike": "michael", "mick": "michael", "dan": "daniel", "danny": "daniel",
    "dave": "david", "matt": "matthew", "chris": "christopher", "kit": "christopher", "topher": "christopher", "jen": "jennifer", "jenny": "jennifer", "jenn": "jennifer", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzy": "elizabeth", "eliza": "elizabeth",
    "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "kath": "katherine", "nick": "nicholas", "nico": "nicholas", "steph": "stephanie", "sam": "samantha", "sammy": "samantha", "ben": "benjamin", "benny": "benjamin", "alex": "alexander", "sandy": "alexander", "xander": "alexander",
    "tom": "thomas", "tommy": "thomas", "will": "william", "bill": "william", "billy": "william", "jim": "james", "jimmy": "james", "joe": "joseph", "joey": "joseph", "jon": "jonathan", "ed": "edward", "eddie": "edward", "ted": "edward", "ned": "edward",
    "greg": "gregory", "jess": "jessica", "jessie": "jessica", "meg": "margaret", "maggie": "margaret", "peggy": "margaret", "pat": "patricia", "trish": "patricia", "patty": "patricia", "tricia": "patricia", "rick": "richard", "rich": "richard", "dick": "richard", "ricky": "richard", "richie": "richard",
    "sue": "susan", "suzy": "susan", "susie": "susan", "deb": "deborah", "debbie": "deborah", "debby": "deborah", "vicky": "victoria", "vicki": "victoria", "tori": "victoria", "judy": "judith", "jude": "judith", "theo": "theodore", "teddy": "theodore", "gabby": "gabriella", "gabi": "gabriella", "ella": "gabriella",
    "toby": "tobias", "tony": "anthony", "ron": "ronald", "ken": "kenneth", "larry": "lawrence", "charlie": "charles", "chuck": "charles", "fred": "frederick", "gus": "gustav", "max": "maximilian", "nate": "nathan", "pete": "peter", "phil": "philip", "steve": "stephen", "zach": "zachary", "mandy": "amanda", "benji": "benjamin", "jonny": "jonathan", "sammie": "samantha", "sasha": "alexander", "suzie": "susan", "cathy": "catherine", "cindy": "cynthia",
}
#: Chief officers.
CHIEFS = {"ceo": "chief executive officer", "cfo": "chief financial officer", "cto": "chief technology officer", "coo": "chief operating officer", "cmo": "chief marketing officer", "cro": "chief revenue officer", "cpo": "chief product officer"}
#: fields of terms: family name, whole name, company with family name, its beginning, its end, a mask; company, given name, title word
FIELDS = "LNKPSMCFT"
#: share of a field in the score; others 1
SHARES = {"C": 0.1, "F": 0.3, "T": 0.1}
#: least score of a match, as a part of the weight of a term of one lead
LEAST_SCORE = 0.7
#: least confidence of a match
LEAST_CONFIDENCE = 0.5
#: pairs, drawn by hash, to which the logistic curve is fitted on the driver (about; fewer if there are fewer)
LABELLED = 20_000
#: nearest leads of a record that are compared attribute by attribute
TOP = 5
FEATURES = "class_id bigint, first string, last string, mask string, cores array<string>, heads array<string>, title array<string>, terms array<bigint>"


def fold(text: str | None) -> str:
    """Lower-case ASCII letters, digits, spaces and marks of a text; umlauts and their spellings become one."""
    if not text:
        return ""
    text = unicodedata.normalize("NFKD", text.replace("Ł", "L").replace("ł", "l").replace("Ø", "O").replace("ø", "o").replace("ß", "ss").replace("æ", "ae").replace("Æ", "Ae").replace("đ", "d"))
    return "".join(c for c in text if not unicodedata.combining(c)).encode("ascii", "ignore").decode().lower()


def _letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", text)


def _name_key(part: str) -> str:
    """A name part in comparable form; "oe", "ae", "ue" are spellings of umlauts, "aa" of a ring."""
    return re.sub(r"([aou])e(?=[^aeiou]|$)", r"\1", _letters(part)).replace("aa", "a")


def split_name(name: str | None, first: str | None, last: str | None) -> tuple[str, str]:
    """Given and family name in comparable form; an initial stays one letter, a missing part is ""."""
    text = fold(name)
    given, family = "", ""
    if text.strip():
        words_of = lambda t: [w for w in re.findall(r"[a-z][a-z'\-]*", t) if _letters(w) and _letters(w) not in HONORIFICS]
        head, comma, tail = text.partition(",")
        if comma and words_of(tail) and words_of(head):
            family, given = words_of(head)[-1], words_of(tail)[0]
        else:
            words = words_of(text)
            if len(words) >= 2:
                given, family = words[0], words[-1]
            elif words:
                given = words[0]
    fields = [w for w in re.findall(r"[a-z][a-z'\-]*", fold(last)) if len(w) > 1 and w not in HONORIFICS]
    if fields:
        family = fields[-1] if not family or len(fields[-1]) >= len(family) else family
    fields = [w for w in re.findall(r"[a-z][a-z'\-]*", fold(first)) if w not in HONORIFICS]
    if fields and (not given or len(_letters(given)) == 1 or len(fields[0]) > len(given)):
        given = fields[0]
    given = _letters(given)
    given = NICKNAMES.get(given, given)
    return _name_key(given) if len(given) > 1 else given, "-".join(filter(None, (_name_key(p) for p in family.split("-"))))


@lru_cache(1 << 16)
def domain_core(site: str | None) -> str:
    """The name in a site's host, without host parts that many sites share."""
    host = re.sub(r"^[a-z]+://", "", fold(site).strip()).split("/")[0].split("?")[0].split(":")[0].strip(". ")
    labels = [x for x in host.split(".") if x]
    while len(labels) > 1 and labels[-1] in ENDINGS:
        labels.pop()
    while len(labels) > 1 and labels[0] in SUBDOMAINS:
        labels.pop(0)
    core = labels[-1] if labels else ""
    core = re.sub(r"-(hq|app|inc|io|hr)$", "", core)
    core = _letters(core)
    return _stem(core)


def _stem(core: str) -> str:
    if core.startswith("get") and len(core) > 7:
        core = core[3:]
    return re.sub(r"(?:app|hq)$", "", core) if len(core) > 7 else core


@lru_cache(1 << 16)
def company_words(name: str | None) -> list[str]:
    """The words of a company's name without legal forms."""
    words = re.findall(r"[a-z]+", re.sub(r"(?<=\b[a-z])\.(?=[a-z]\b)", "", fold(name)))
    while len(words) > 1 and words[-1] in LEGAL:
        words.pop()
    return words


@lru_cache(1 << 16)
def title_words(title: str | None) -> list[str]:
    """The words of a title, abbreviations written out (the first meaning), in order of the alphabet."""
    out = set()
    for word in re.findall(r"[a-z]+", fold(title)):
        out.update((CHIEFS.get(word) or SHORT.get(word, word)).split("|")[0].split())
    return sorted(out - {"of", "and", "the", "emea", "us", "eu"})


def term_key(term: str) -> int:
    """A term as a number: its field in the four highest bits, behind it its hash."""
    key = FIELDS.index(term[0]) << 60 | xxhash.xxh64_intdigest(term) >> 4
    return key - (1 << 64) if key >> 63 else key


def _features(first: str, last: str, mask: str, cores: list[str], heads: list[str], title: list[str], asked: bool = False) -> list[int]:
    """The index terms of a record; asked: as a query, where a full name needs no term of masked ones."""
    terms = []
    parts = [p for p in last.split("-") if p]
    whole = parts[0] if parts else ""
    real = len(first) > 1
    for part in parts:
        terms.append(f"L|{part}")
        if real:
            terms.append(f"N|{first}|{part}")
    for core in dict.fromkeys([*cores, *heads]):
        for part in parts:
            terms.append(f"K|{core}|{part}")
        if real and whole:
            terms += [f"P|{core}|{first}|{whole[:3]}", f"S|{core}|{first}|{whole[-3:]}"]
            if not asked:
                terms.append(f"M|{core}|{first}|{whole[:2]}{whole[-1]}")
        if real and mask:
            terms.append(f"M|{core}|{first}|{mask[:2]}{mask[-1]}")
        terms.append(f"C|{core}")
    if real:
        terms.append(f"F|{first}")
    terms += [f"T|{t}" for t in title]
    return sorted({term_key(t) for t in terms})


def _class_id(*parts: object) -> int:
    return xxhash.xxh64_intdigest(repr(parts)) - (1 << 63)


def lead_features(leads: DataFrame) -> DataFrame:
    """member (gtm_id) and the features of its class; leads without a name have no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for member, name, title, company, domain in zip(*(batch[c] for c in ("member", "name", "title", "company", "domain")), strict=True):
                first, last = split_name(name, None, None)
                if not (first or last):
                    continue
                words, core = company_words(company), domain_core(domain)
                cores = sorted({c for c in (core, _stem("".join(words))) if c})
                heads = [words[0]] if len(words) > 1 and len(words[0]) > 3 else []
                parts = (first, last, "", cores, heads)
                rows.append((member, _class_id(*parts), *parts, title_words(title)))
            out = [(*r, _features(*r[2:])) for r in rows]
            yield pd.DataFrame(out, columns=["member", "class_id", "first", "last", "mask", "cores", "heads", "title", "terms"])

    rows = leads.select(F.col("gtm_id").alias("member"), F.col("lead.name").alias("name"), F.col("lead.title").alias("title"), F.col("company.name").alias("company"), F.col("company.domain").alias("domain")).filter(F.col("member").isNotNull())
    return rows.mapInPandas(read, "member string, " + FEATURES)


def person_features(persons: DataFrame) -> DataFrame:
    """member (person_id) and the features of its class; records without any name have no row."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for member, name, first, last, hidden, title, org, site in zip(*(batch[c] for c in ("member", "name", "first_name", "last_name", "hidden", "title", "org_name", "org_website")), strict=True):
                given, family = split_name(name, first, last)
                masked = re.sub(r"[^a-z*]", "", fold(hidden)) if not family and hidden else ""
                mask = masked if masked.count("*") and len(masked.replace("*", "")) >= 2 and masked[-1] != "*" else ""
                if not (given or family):
                    continue
                words, core = company_words(org), domain_core(site)
                cores = sorted({c for c in (core, _stem("".join(words))) if c})
                heads = [words[0]] if len(words) > 1 and len(words[0]) > 3 else []
                parts = (given, family, mask, cores, heads)
                titles = title_words(title)
                rows.append((member, _class_id(*parts, titles), *parts, titles))
            out = [(*r, _features(*r[2:], asked=True)) for r in rows]
            yield pd.DataFrame(out, columns=["member", "class_id", "first", "last", "mask", "cores", "heads", "title", "terms"])

    rows = persons.select(F.col("person_id").alias("member"), "name", "first_name", "last_name", F.col("last_name_obfuscated").alias("hidden"), "title", "org_name", "org_website").filter(F.col("member").isNotNull())
    return rows.mapInPandas(read, "member string, " + FEATURES)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per class; of the titles of its members the one with most words."""
    lists = [F.first(c).alias(c) for c in ("first", "last", "mask", "cores", "heads")]
    return rows.groupBy("class_id").agg(*lists, F.max_by("title", F.size("title")).alias("title"), F.max_by("terms", F.size("title")).alias("terms"))


def candidates(leads: DataFrame, persons: DataFrame, k: int = TOP) -> tuple[DataFrame, float]:
    """The k lead classes of the highest BM25 score of each person class: person,
    lead, found (the score over all shared terms), place; and the weight of a term of one lead.

    The top k are exact among the leads whose score reaches the least score:
    the commonest terms of a record whose weights together stay below it can't
    bring a lead there by themselves, so that only leads sharing one of
    the other terms are scored; these are scored over all terms.
    """
    n = leads.count()
    top = math.log(1 + (n - 0.5) / 1.5)
    posting = leads.select(F.col("class_id").alias("lead"), F.explode("terms").alias("key"))
    asked = persons.select(F.col("class_id").alias("person"), F.explode("terms").alias("key"))
    field = F.shiftrightunsigned("key", 60)
    share = F.lit(1.0)
    for name, part in SHARES.items():
        share = F.when(field == FIELDS.index(name), part).otherwise(share)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = posting.groupBy("key").agg(F.count("*").alias("df")).select("key", (idf * share).alias("weight"))
    terms = asked.join(weights, "key").groupBy("person").agg(F.array_sort(F.collect_list(F.struct("weight", "key"))).alias("query"))
    terms = cut(terms)  # a row per record, read by the look-up and by the scoring
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda acc, t: acc + t["weight"])
    rarer = F.filter("query", lambda t: total(F.filter("query", lambda u: u <= t)) >= LEAST_SCORE * top)
    looked_up = terms.select("person", F.explode(F.transform(rarer, lambda t: t["key"])).alias("key"))
    pairs = looked_up.join(posting, "key").select("person", "lead").distinct()
    keys = leads.select(F.col("class_id").alias("lead"), F.col("terms").alias("keys"))
    shared = F.filter("query", lambda t: F.array_contains("keys", t["key"]))
    scored = pairs.join(terms, "person").join(keys, "lead").select("person", "lead", total(shared).alias("found")).filter(F.col("found") >= LEAST_SCORE * top)
    return top_rows(scored, ["person"], [F.desc("found"), F.col("lead")], k), top


def _same_first(a: str, b: str) -> float:
    """Agreement of given names: 1 equal, less for an initial or a slip, 0 for different ones."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0
    if min(len(a), len(b)) == 1:
        return 0.7 if a[0] == b[0] else 0.0
    if one_slip(a, b) or (len(a) >= 4 and len(b) >= 4 and (a.startswith(b) or b.startswith(a))):
        return 0.8
    return 0.0


def _slips(a: str, b: str) -> bool:
    """Whether two slips at most lead from one word to the other (long words)."""
    if one_slip(a, b):
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    half = len(a) // 2
    return any(one_slip(a[:i], b[: i + d]) and one_slip(a[i:], b[i + d :]) for i in range(3, len(a) - 2) for d in (-1, 0, 1)) if half else False


def _same_last(last: str, mask: str, lead: str) -> float:
    if not lead:
        return 0.4
    if last:
        if last == lead:
            return 1.0
        a, b = last.split("-"), lead.split("-")
        if set(a) & set(b):
            return 0.9
        if one_slip(a[0], b[0]) and min(len(a[0]), len(b[0])) >= 4:
            return 0.8
        if _slips(a[0], b[0]):
            return 0.6
        return 0.7 if len(last) == 1 and lead[0] == last else 0.0
    if mask:
        bare = lead.replace("-", "")
        if bare[:2] == mask[:2] and bare[-1] == mask[-1]:
            # spellings of umlauts may have been shortened
            return 0.85 if len(bare) == len(mask) else 0.75 if 0 < len(mask) - len(bare) <= 2 else 0.6
        return 0.0
    return 0.4


def _same_company(cores: list[str], heads: list[str], lead_cores: list[str], lead_heads: list[str]) -> float:
    """1 for a company in common, less for a slip or the first word alone, 0.5 for none named, 0 for others."""
    if not cores:
        return 0.5
    if set(cores) & set(lead_cores):
        return 1.0
    if any(len(a) >= 5 and _slips(a, b) for a in cores for b in lead_cores):
        return 0.9
    if set(cores) & set(lead_heads) or any(len(a) >= 5 and one_slip(a, b) for a in cores for b in lead_heads):
        return 0.7
    return 0.0


def _same_title(a: list[str], b: list[str]) -> float:
    if not len(a) or not len(b):
        return 0.5
    met = sum(1 for x in a if x in b or any(len(x) >= 4 and one_slip(x, y) for y in b))
    return met / max(len(a), len(b))


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The attribute checks of candidate pairs."""
    for x in batches:
        rows = []
        for r in x.itertuples(index=False):
            first, last = _same_first(r.p_first, r.l_first), _same_last(r.p_last, r.p_mask, r.l_last)
            company = _same_company(list(r.p_cores), list(r.p_heads), list(r.l_cores), list(r.l_heads))
            title = _same_title(list(r.p_title), list(r.l_title))
            rows.append((r.person, r.lead, r.found, first, last, company, title))
        yield pd.DataFrame(rows, columns=["person", "lead", "found", "first", "last", "company", "title"])


#: lower bounds of the levels of agreement of names, companies and titles, and of the gap as a part of the score
NAME_LEVELS, COMPANY_LEVELS, TITLE_LEVELS, GAP_LEVELS = (0.01, 0.45, 0.55, 0.65, 0.75, 0.95), (0.01, 0.6, 0.8, 0.95), (0.01, 0.34, 0.5, 0.51, 0.67, 0.95), (0.0, 0.05, 0.3, 0.6, 0.9)


def _level(value: Column, bounds: tuple[float, ...]) -> Column:
    return sum((F.when(value >= bound, 1).otherwise(0) for bound in bounds), F.lit(0)).cast("int")


#: what is told apart in a pair, with the number of levels: who it is (name and company together), the title, the gap
VIEWS = {"who": (len(NAME_LEVELS) + 1) * (len(COMPANY_LEVELS) + 1), "what": len(TITLE_LEVELS) + 1, "apart": len(GAP_LEVELS) + 1}


def view(name: str) -> Column:
    """The level of a pair in a view."""
    if name == "who":
        return _level(F.col("first") * F.col("last"), NAME_LEVELS) * (len(COMPANY_LEVELS) + 1) + _level(F.col("company"), COMPANY_LEVELS)
    return _level(F.col("title"), TITLE_LEVELS) if name == "what" else _level(F.col("gap"), GAP_LEVELS)


def agreement_weights(near: DataFrame, rounds: int = 60) -> tuple[int, float, dict[str, list[float]]]:
    """The number of pairs, the log-odds of a pair to be one person before its
    views, and what each level of each view adds: a mixture of matches and
    others with independent views, fitted by expectation-maximisation to the
    counts of all combinations of levels (at most 1,470 rows, whatever the
    input). No labels and no rules of decision are used. No pairs give zeros."""
    sizes = list(VIEWS.values())
    rows = near.groupBy(*[view(v).alias(v) for v in VIEWS]).agg(F.count("*").alias("n"), F.avg((F.col("first") * F.col("last") * 2 + F.col("company") + F.col("title")) / 4).alias("p")).collect()
    if not rows:
        return 0, 0.0, {v: [0.0] * size for v, size in VIEWS.items()}
    levels, n = np.array([[r[v] for v in VIEWS] for r in rows]), np.array([r["n"] for r in rows], dtype=float)
    p = np.clip([r["p"] for r in rows], 0.02, 0.98)  # pairs that agree more are likelier one person, to begin with
    for _ in range(rounds):
        share = np.clip((n * p).sum() / n.sum(), 1e-3, 1 - 1e-3)
        logs = []
        for j, size in enumerate(sizes):
            m, u = np.bincount(levels[:, j], n * p, size) + 0.5, np.bincount(levels[:, j], n * (1 - p), size) + 0.5
            logs.append(np.log(m / m.sum()) - np.log(u / u.sum()))
        odds = math.log(share / (1 - share)) + sum(logs[j][levels[:, j]] for j in range(len(sizes)))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return int(n.sum()), math.log(share / (1 - share)), {v: logs[j].tolist() for j, v in enumerate(VIEWS)}


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Intercept and slopes of a logistic curve of the columns of x to the labels y between 0 and 1, by Newton steps (ridge 1e-2)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w), -5, 5)
    return w


def matched_people(leads: DataFrame, persons: DataFrame) -> DataFrame:
    """gtm_id, person_id, confidence, mutual: pairs of a published lead and a
    provider record about the same person at the same company, every repetition
    included; mutual: the record is also the lead's nearest.

    Records without a name match nothing; a missing company or title is no
    contradiction; of equally near leads the one that agrees better by title,
    then the first class. Empty tables give no pairs; extra columns are ignored.
    """
    lead_rows, person_rows = cut(lead_features(leads)), cut(person_features(persons))
    lead_classes, person_classes = cut(_classes(lead_rows)), cut(_classes(person_rows))  # read by several steps
    pairs, top = candidates(lead_classes, person_classes)

    def side(classes: DataFrame, key: str, letter: str) -> DataFrame:
        return classes.select(F.col("class_id").alias(key), *[F.col(c).alias(f"{letter}_{c}") for c in ("first", "last", "mask", "cores", "heads", "title")])

    wide = pairs.join(side(person_classes, "person", "p"), "person").join(side(lead_classes, "lead", "l"), "lead")
    checked = wide.mapInPandas(_check, "person bigint, lead bigint, found double, first double, last double, company double, title double")
    of_person = Window.partitionBy("person").orderBy(F.desc("found"), F.desc("title"), "lead")
    ranked = checked.select("*", F.row_number().over(of_person).alias("place"), F.lead("found", 1, 0.0).over(of_person).alias("next"), F.first("found").over(of_person).alias("best"))
    gap = F.col("found") - F.when(F.col("place") == 1, F.col("next")).otherwise(F.col("best"))
    ranked = cut(ranked.withColumn("gap", gap / F.col("found")).withColumn("score", F.col("found") / F.lit(top)))
    of_lead = ranked.groupBy("lead").agg(F.max("found").alias("most"))
    near = ranked.join(of_lead, "lead").withColumn("nearness", F.col("found") / F.col("most"))
    n, base, weights = agreement_weights(near)
    odds = lambda *views: F.lit(base) + sum((F.array(*[F.lit(w) for w in weights[v]])[view(v)] for v in views), F.lit(0.0))
    near = near.withColumn("agreement", odds("who", "what")).withColumn("label", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), odds(*VIEWS))))))
    features = ("agreement", "score", "gap", "nearness")
    sampled = F.pmod(F.xxhash64("person", "lead"), F.lit(1_000_000)) < F.lit(1_000_000 * LABELLED // max(n, LABELLED))
    sample = np.array([tuple(r) for r in near.filter(sampled).select(*features, "label").collect()], dtype=float).reshape(-1, len(features) + 1)
    w = _fit(sample[:, :-1], sample[:, -1])
    confidence = 1 / (1 + F.exp(-sum((F.lit(float(v)) * F.col(f) for v, f in zip(w[1:], features, strict=True)), F.lit(float(w[0])))))
    kept = near.withColumn("confidence", confidence).filter((F.col("place") == 1) & (F.col("confidence") >= LEAST_CONFIDENCE) & (F.col("company") > 0))
    kept = kept.select("person", "lead", "confidence", (F.col("nearness") == 1).alias("mutual"))
    members = kept.join(person_rows.select(F.col("class_id").alias("person"), F.col("member").alias("person_id")), "person")
    return members.join(lead_rows.select(F.col("class_id").alias("lead"), F.col("member").alias("gtm_id")), "lead").select("gtm_id", "person_id", "confidence", "mutual").dropDuplicates(["gtm_id", "person_id"])
