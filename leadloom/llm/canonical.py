"""Free-entered values to the entries of a reference list.

Method: an automaton over all canonical names and aliases finds embedded
mentions; of those that don't overlap the longest wins. What they do not settle goes to
token-set similarity: every typed token is read as reference tokens (itself,
an abbreviation, a beginning, one typing slip, several words run together), and
the entry whose tokens are all met, with none left over, at the least cost is
meant. Values that meet no entry are reported with 0.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations and translations of words, as typed on job boards.
SHORT = {
    "sr": "senior", "snr": "senior", "jr": "junior", "jnr": "junior", "princ": "principal", "prin": "principal",
    "eng": "engineer|engineering", "engr": "engineer", "engg": "engineering", "mgr": "manager", "mngr": "manager", "mgmt": "management", "mngmt": "management", "dir": "director",
    "exec": "executive", "spec": "specialist", "rep": "representative", "dev": "development", "biz": "business", "ops": "operations|operating", "admin": "administrator",
    "acq": "acquisition", "cust": "customer", "mktg": "marketing", "mktng": "marketing", "mkt": "marketing", "infra": "infrastructure", "tech": "technical|technology", "prod": "product",
    "fin": "financial|finance", "acct": "account|accounts", "acctg": "accounting", "actg": "accounting", "assur": "assurance", "svc": "services", "svcs": "services", "serv": "services",
    "prof": "professional", "sw": "software", "coord": "coordinator", "anlyst": "analyst", "arch": "architect", "assoc": "associate", "off": "officer", "hd": "head", "res": "research", "comms": "communications",
    "qa": "quality assurance", "ml": "machine learning", "ux": "user experience", "vp": "vice president", "v": "vice", "hr": "human resources", "pm": "product manager", "tpm": "technical program manager",
    "leiter": "head", "leiterin": "head", "vertrieb": "sales", "ventas": "sales", "helpdesk": "technical support", "datenanalyst": "data analyst", "analista datos": "data analyst",
}
#: Further names of entries (kind, entry, name).
NAMES = (
    ("title", "Data Analyst", "Analista de datos"),
    ("title", "Head of People", "Leiter Personal"),
    ("title", "Head of Sales", "Directeur commercial"),
    ("title", "Chief Financial Officer", "CFO"),
    ("title", "Chief Marketing Officer", "CMO"),
)
#: Words without meaning for the entry.
IDLE = set("of the and de la für y et und e for a an in at with".split())
NOISE = set("remote hybrid onsite urgent hiring wanted new ref job position role vacancy now m w d f x h gn div all genders amp nbsp full time part".split())
LEVELS = ("senior", "principal", "junior")
_CUTS = (
    re.compile(r"\((?:\s*[a-z*]{1,3}\s*[/|,]\s*)+[a-z*]{1,3}\s*\)"),  # (m/w/d)
    re.compile(r"[(\[]?\bref\.?\s*[:#]?\s*[\d][\w-]*[)\]]?"),
    re.compile(r"#\s*\d+"),
    re.compile(r"\d+\s*(?:[-–]\s*\d+\s*)?%"),
    re.compile(r"\*[^*]*\*"),
    re.compile(r"\[[^\]]*\]"),
    re.compile(r"^\W*(?:hiring|wanted|new|urgent|we are hiring|now hiring|job)\s*[:!–-]+"),
    re.compile(r"^\s*\d+[.)]\s+"),
    re.compile(r"(?<=\S)\s*[@|]\s.*$"),
    re.compile(r"\s[-–]\s*(?:remote|hybrid|onsite)\s*$"),
)
_TOKEN = re.compile(r"[^\W\d_]+")
#: costs of reading a typed token
EXACT, SHORTENED, BEGUN, JOINED, SLIP, SHORT_SLIP = 0.0, 0.05, 0.15, 0.1, 0.3, 0.4
MOST_COST = 0.95
#: joins of one token whose costs stay below the most
MOST_JOINS = 9


def _plain(text: str) -> str:
    """Lower case without accents, widths and combining marks."""
    text = unicodedata.normalize("NFKC", html.unescape(text)).casefold()
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def tokens(text: str) -> list[str]:
    """The words of a value that may carry meaning."""
    text = " ".join(_plain(text).split())
    for cut in _CUTS:
        less = cut.sub(" ", text)
        if _TOKEN.search(less):
            text = less
    return [t for t in _TOKEN.findall(text) if t not in IDLE]


def one_slip(a: str, b: str) -> bool:
    """Whether two different words differ by one letter left out, added, replaced, or two neighbours swapped."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[i + 1 :] == short[i:]


class Canon:
    """The entries of one kind."""

    def __init__(self, entries: Iterable[tuple[int, str, list[str] | None]], kind: str, words: dict[str, str] | None = None) -> None:
        """entries: id, label, aliases; words: translations of single words beside the fixed ones."""
        self.short = SHORT | (words or {})
        self.bags: dict[tuple[str, ...], int] = {}
        self.mentions = ahocorasick.Automaton()
        labels = {label: ref for ref, label, _ in sorted(entries, key=lambda e: e[0])}
        names = [(ref, label) for label, ref in labels.items()]
        names += [(ref, a) for ref, _, aliases in entries for a in (aliases if aliases is not None else []) if a]
        names += [(labels[label], name) for k, label, name in NAMES if k == kind and label in labels]
        by_ref = {ref: label for label, ref in labels.items()}
        self.higher: dict[tuple[int, str], int] = {}
        for ref, name in names:
            self._add(ref, tokens(name))
            for level in LEVELS:
                higher = labels.get(f"{level.capitalize()} {by_ref[ref]}")
                if higher is not None:
                    self.higher[ref, level] = higher
                    self._add(higher, [level, *tokens(name)])
        self.mentions.make_automaton()
        self.vocabulary = {t for bag in self.bags for t in bag} | set(LEVELS)
        self.longest = max(map(len, self.vocabulary | set(self.short) | IDLE))
        # the bags that hold a word so many times
        self.holders: dict[tuple[str, int], set[int]] = {}
        for n, bag in enumerate(self.bags):
            for word, times in Counter(bag).items():
                for k in range(1, times + 1):
                    self.holders.setdefault((word, k), set()).add(n)
        self.read: dict[str, list[tuple[float, tuple[str, ...]]]] = {}
        self.known: dict[str, int] = {}

    def _add(self, ref: int, words: list[str]) -> None:
        if words:
            self.bags.setdefault(tuple(sorted(words)), ref)
            self.mentions.add_word(" " + " ".join(words) + " ", (ref, len(words), self.bags[tuple(sorted(words))]))

    def _simple(self, token: str) -> list[tuple[float, tuple[str, ...]]]:
        """Readings of a token as one word or a known abbreviation."""
        found: dict[tuple[str, ...], float] = {}
        if token in self.vocabulary:
            found[(token,)] = EXACT
        for meaning in self.short.get(token, "").split("|"):
            words = tuple(meaning.split())
            if words and all(w in self.vocabulary for w in words):
                found.setdefault(words, SHORTENED)
        return [(c, w) for w, c in found.items()]

    def readings(self, token: str) -> list[tuple[float, tuple[str, ...]]]:
        """All readings of a token as reference tokens with their costs; several
        words run together are taken apart, with one slip in one of them at most."""
        known = self.read.get(token)
        if known is not None:
            return known
        found = {words: cost for cost, words in self._simple(token)}
        for word in self.vocabulary:
            if len(token) >= 3 and len(word) >= len(token) + 2 and word.startswith(token):
                found.setdefault((word,), BEGUN)
            elif len(token) >= 2 and len(word) >= 2 and word != token and one_slip(token, word):
                found.setdefault((word,), SLIP if len(word) >= 4 else SHORT_SLIP)
        for short in self.short:
            if len(short) >= 3 and len(token) >= 2 and short != token and one_slip(token, short):
                for _, words in self._simple(short):
                    found.setdefault(words, (SLIP if len(short) >= 4 else SHORT_SLIP) + SHORTENED)
        if not found and len(token) >= 5:
            found = self._apart(token, True, MOST_JOINS, {})
        out = sorted((c, w) for w, c in found.items())
        if len(self.read) > 200_000:
            self.read.clear()
        self.read[token] = out
        return out

    def _held(self, words: tuple[str, ...]) -> bool:
        """Whether some bag holds all the words, each as often as it is given."""
        sets = [self.holders.get(w, set()) for w in Counter(words).items()]
        return not sets or bool(set.intersection(*sets))

    def _slipped(self, part: str) -> list[tuple[float, tuple[str, ...]]]:
        return [(SLIP, (w,)) for w in self.vocabulary if len(w) >= 5 and one_slip(part, w)] if len(part) >= 4 else []

    def _apart(self, token: str, slip: bool, joins: int, known: dict[tuple[str, bool, int], dict]) -> dict[tuple[str, ...], float]:
        """The words of a run-together token with their least cost: all that cost
        less than MOST_COST and lie in one bag, as no others can meet an entry."""
        if joins < 1 or len(token) > (joins + 1) * (self.longest + 1):
            return {}
        if (token, slip, joins) in known:
            return known[token, slip, joins]
        out: dict[tuple[str, ...], float] = {}
        for cut in range(2, min(len(token) - 1, self.longest + 2)):
            head, tail = token[:cut], token[cut:]
            heads = [(0.0, ())] if head in IDLE else self._simple(head) or (self._slipped(head) if slip else [])
            for cost, words in heads:
                rest_slip = slip and cost < SLIP
                rests = self._simple(tail) or (self._slipped(tail) if rest_slip and len(tail) <= self.longest + 1 else [])
                if not rests and len(tail) >= 4:
                    rests = [(c, w) for w, c in self._apart(tail, rest_slip, joins - 1, known).items()]
                for c, w in rests:
                    both, total = words + w, cost + c + JOINED
                    if total < MOST_COST and total < out.get(both, MOST_COST) and self._held(both):
                        out[both] = total
        known[token, slip, joins] = out
        return out

    def _mention(self, words: list[str]) -> tuple[int, int, list[str]] | None:
        """The longest of the mentions that don't overlap (the first of equals):
        entry, its number of words, the words in no mention. Longer mentions take
        their words first."""
        if not self.bags:
            return None
        line = " " + " ".join(words) + " "
        met = []
        for end, (_, size, ref) in self.mentions.iter(line):
            met.append((-size, line[: end + 1].count(" ") - 1 - size, ref))
        free, chosen = [True] * len(words), []
        for size, start, ref in sorted(met):
            if all(free[start : start - size]):
                free[start : start - size] = [False] * -size
                chosen.append((ref, -size))
        if not chosen:
            return None
        return *chosen[0], [w for w, is_free in zip(words, free, strict=True) if is_free]

    def find(self, value: str) -> int:
        """The entry a value means, or 0."""
        known = self.known.get(value)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[value] = self._find(value)
        return known

    def _find(self, value: str) -> int:
        typed = tokens(value)
        if not typed:
            return 0
        mention = self._mention(typed)
        if mention and all(w in NOISE for w in mention[2]):
            return mention[0]
        kept = [w for w in typed if w not in NOISE]
        ways = [typed, kept]
        # words that a space split ("back end"), and a mistyped "&amp;"
        ways += [kept[:i] + [kept[i] + kept[i + 1]] + kept[i + 2 :] for i in range(len(kept) - 1)]
        ways.append([w for w in kept if not (len(w) <= 4 and (one_slip(w, "amp") or one_slip(w, "and")))])
        for words in ways:
            ref = self._set_similarity(words)
            if ref:
                return ref
        if mention and mention[1] >= 2:
            levels = [w for w in mention[2] if w in LEVELS]
            return self.higher.get((mention[0], levels[0]), mention[0]) if levels else mention[0]
        return 0

    def _set_similarity(self, words: list[str]) -> int:
        """The entry met at the least cost, the first reading of equals. Word by
        word, the bags read so far are kept with their least cost; those that no
        entry holds can't meet one."""
        options = [self.readings(w) for w in words]
        if not words or not all(options):
            return 0
        most = round(100 * MOST_COST)
        states: dict[tuple[str, ...], tuple[int, tuple[int, ...]]] = {(): (0, ())}
        for choices in options:
            after: dict[tuple[str, ...], tuple[int, tuple[int, ...]]] = {}
            for bag, (cost, path) in states.items():
                for i, (c, ws) in enumerate(choices):
                    at = (cost + round(100 * c), (*path, i))
                    key = tuple(sorted(bag + ws))
                    if at[0] < most and (at < after[key] if key in after else self._held(key)):
                        after[key] = at
            states = after
        met = [(at, self.bags[bag]) for bag, at in states.items() if self.bags.get(bag)]
        return min(met)[1] if met else 0


def translations(entries: Iterable[tuple[int, str, str, list[str] | None]]) -> dict[str, str]:
    """One-word aliases of one-word entries, as words that other names may hold ("Head of Finanzen")."""
    out = {}
    for _, _, label, aliases in entries:
        for alias in aliases or []:
            a, b = tokens(alias), tokens(label)
            if len(a) == len(b) == 1 and len(a[0]) > 3:
                out[a[0]] = b[0]
    return out


#: fields of a case with the kind of entry that fits
FIELDS = (("job.title", "title"), ("job.department", "department"), ("lead.title_raw", "title"))


def canonical_values(cases: DataFrame, reference: DataFrame) -> DataFrame:
    """case_id, field, ref_id: the entry that each non-null value of a case
    means, 0 if none. Empty and blank values and values without letters mean
    none; null values are no case; repeated cases keep their own rows.

    The reference list is a fixed table of a few hundred entries and goes to
    every task.
    """
    entries = [(r["ref_id"], r["kind"], r["label"], list(r["aliases"]) if r["aliases"] is not None else None) for r in reference.select("ref_id", "kind", "label", "aliases").collect() if r["label"]]

    words = translations(entries)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = {kind: Canon([(i, label, aliases) for i, k, label, aliases in entries if k == kind], kind, words) for kind in {k for _, k in FIELDS}}
        for batch in batches:
            parts = []
            for n, (field, kind) in enumerate(FIELDS):
                values = batch[f"v{n}"]
                some = values.notna()
                find = canon[kind].find
                parts.append(pd.DataFrame({"case_id": batch.loc[some, "case_id"], "field": field, "ref_id": [find(v) for v in values[some]]}))
            yield pd.concat(parts).astype({"ref_id": "int64"})

    return cases.select("case_id", *[F.col(f).alias(f"v{n}") for n, (f, _) in enumerate(FIELDS)]).mapInPandas(match, "case_id bigint, field string, ref_id bigint")
