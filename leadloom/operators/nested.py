"""Nested board responses to related flat tables.

One VARIANT parse per payload; nested ``transform`` calls attach the keys and
indices of all ancestors to every child, ``flatten`` joins the arrays of one
payload, and a single ``inline`` emits the rows of a target table.

The expressions are written as SQL text: they nest deeply, and one parse of the
text is far cheaper than thousands of calls that build the same tree.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys under which deliveries wrap the response (outer before inner).
WRAPPERS = ("response", "data", "result", "payload", "body")
#: Keys that hold the posting list; a response without them is the list itself.
LIST_KEYS = ("jobs", "content", "offers", "postings")
#: kind of child: (array field of the posting, text field of the child)
CHILDREN = {
    "office": ("offices", "location"),
    "list": ("lists", "content"),
    "location": ("locations", "country"),
}
#: Fixed value: the known last element behind a value that is parsed.
END = "end of the value"
_CHILD_ROWS = "array<struct<kind:string,child_pos:bigint,child_text:string>>"
_names = itertools.count()


def let(value: str, body: Callable[[str], str]) -> str:
    """``body(name)`` with value computed once (a lambda variable is not recomputed)."""
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(array: str, body: Callable[[str, str], str]) -> str:
    """``body(element, place)`` of every element."""
    n = next(_names)
    return f"transform({array}, (v{n}, i{n}) -> {body(f'v{n}', f'i{n}')})"


def field(v: str, path: str, kind: str = "variant") -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def _array(v: str) -> str:
    return f"try_variant_get({v}, '$', 'array<variant>')"


def is_object(v: str) -> str:
    return f"(try_variant_get({v}, '$', 'map<string,variant>') is not null)"


def strict_json(text: str) -> str:
    """text as VARIANT, null unless it is one complete JSON value.

    Spark's parser stops at the end of the first value, so the text is read as
    the first element of a list with a known last one: whatever follows the
    value makes the list another one.
    """
    n = next(_names)
    read = f"try_variant_get(try_parse_json(concat('[', {text}, ',\"{END}\"]')), '$', 'array<variant>')"
    return f"try_element_at(filter(array({read}), v{n} -> size(v{n}) = 2 and try_variant_get(v{n}[1], '$', 'string') = '{END}'), 1)[0]"


def _held(v: str) -> str:
    """The text of a string that may hold JSON, without white space before it; else null."""
    return rf"case when {_array(v)} is null and not {is_object(v)} then nullif(regexp_extract(try_variant_get({v}, '$', 'string'), r'(?s)^[\s\x{{FEFF}}]*([\[\{{\"].*)', 1), '') end"


def decoded(v: str) -> str:
    """JSON held in a string counts as what it holds, however often it is held.

    A text that begins with n quotes (escaped or not) before its value holds
    n more strings in one another at most, so n + 1 steps reach the end.
    """
    n = next(_names)
    steps = lambda x: rf"coalesce(1 + length(regexp_replace(regexp_extract({_held(x)}, r'^[\s\"\\]+', 0), r'[^\"]', '')), 0)"
    return let(v, lambda x: f"aggregate(array_repeat(0, {steps(x)}), {x}, (v{n}, i{n}) -> coalesce({strict_json(_held(f'v{n}'))}, v{n}))")


def _as_list(v: str) -> str:
    """A list of children: the array, or a single object in place of one; else null."""
    return let(decoded(v), lambda x: f"coalesce({_array(x)}, case when {is_object(x)} then array({x}) end)")


def _text(v: str) -> str:
    """The text of a leaf: an object counts by its name, an array holds none."""
    return let(decoded(v), lambda x: f"case when {_array(x)} is not null then null when {is_object(x)} then {field(x, 'name', 'string')} else try_variant_get({x}, '$', 'string') end")


def parse_payload(payload: str) -> str:
    """The response as VARIANT, unwrapped; null for text that is not complete JSON.

    Every wrapper is a key of the text, so there are no more levels than such keys.
    """
    body = rf"regexp_replace({payload}, r'^[\s\x{{FEFF}}]+|[\s\x{{FEFF}}]+$', '')"
    n = next(_names)
    held = f"coalesce({', '.join(field(f'v{n}', k) for k in WRAPPERS)})"
    inner = f"case when {held} is null then v{n} else {decoded(held)} end"
    levels = rf"coalesce(regexp_count({payload}, r'(?:{'|'.join(WRAPPERS)})\\*\"\s*:|\\u00'), 0)"
    return f"aggregate(array_repeat(0, {levels}), {decoded(strict_json(body))}, (v{n}, i{n}) -> {inner})"


def posting_list(root: str) -> str:
    """The posting list of a response, single objects as one-element lists."""
    return let(root, lambda v: f"coalesce({', '.join(_as_list(field(v, k)) for k in LIST_KEYS)}, {_as_list(v)})")


def _children(item: str, place: str) -> str:
    """The child rows of one posting."""

    def of(kind: str, name: str, leaf: str) -> str:
        rows = each(_as_list(field(item, name)), lambda c, j: f"struct('{kind}' as kind, cast({j} as bigint) as child_pos, {_text(field(decoded(c), leaf))} as child_text)")
        return f"coalesce({rows}, cast(array() as {_CHILD_ROWS}))"

    first = let(_as_list(field(item, "location")), lambda a: f"try_element_at({a}, 1)")
    full = f"case when source_platform = 'smartrecruiters' then array(struct('full_location' as kind, cast(0 as bigint) as child_pos, {_text(field(decoded(first), 'fullLocation'))} as child_text)) else cast(array() as {_CHILD_ROWS}) end"
    rows = f"flatten(array({', '.join(of(k, f, leaf) for k, (f, leaf) in CHILDREN.items())}, {full}))"
    return each(rows, lambda c, _: f"struct(cast({place} as bigint) as posting_pos, {c}.kind as kind, {c}.child_pos as child_pos, {c}.child_text as child_text)")


def _read(pages: DataFrame, rows: str) -> DataFrame:
    """page_id and the rows; of keys given twice in an object the last counts, as in other JSON readers."""
    pages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return pages.select("page_id", F.expr(f"inline({rows})"))


def postings(pages: DataFrame) -> DataFrame:
    """One row per element of a page's posting list: page_id, posting_pos,
    external_id, title, is_posting (the element is an object). Pages without a
    readable payload give no rows."""

    def row(x: str, i: str) -> str:
        first = lambda *keys: "coalesce(" + ", ".join(field(x, k, "string") for k in keys) + ")"
        return f"struct(cast({i} as bigint) as posting_pos, {first('id', 'shortcode')} as external_id, {first('title', 'text', 'name')} as title, {is_object(x)} as is_posting)"

    rows = each(posting_list(parse_payload("payload")), lambda v, i: let(decoded(v), lambda x: row(x, i)))
    return _read(pages, rows)


def children(pages: DataFrame) -> DataFrame:
    """One row per child of a posting: page_id, posting_pos, kind, child_pos,
    child_text. The pair (page_id, posting_pos) links to :func:`postings`.

    Positions count every element of their list from 0, elements that are no
    objects included. A child without text (null, blank, absent, an array) has
    a null or blank child_text; null, unreadable or incomplete payloads give no
    rows; repeated pages keep their own rows by page_id.
    """
    rows = each(posting_list(parse_payload("payload")), lambda v, i: let(decoded(v), lambda x: _children(x, i)))
    return _read(pages.select("page_id", "source_platform", "payload"), f"flatten({rows})")


def children_with_text(pages: DataFrame) -> DataFrame:
    """The children whose text is not blank (no-break and ideographic spaces are blank)."""
    return children(pages).filter(F.col("child_text").rlike(r"(?U)\S"))
