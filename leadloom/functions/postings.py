"""Column functions that normalise postings: titles, classes, ids, types, places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import rules
from leadloom.functions.text import SPACE, trimmed

# What is cut from titles, and the abbreviations written out.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]+"
PLACE_IN_PARENTHESES = r"(?i)\s*\([^)]*(?:remote|hybrid|onsite|us|usa|uk|emea|nyc|sf)[^)]*\)\s*$"
REQUISITION = r"(?i)\s*[-–—(\[]?\s*(?:req|job)[\s#-]*\d{3,}\)?\]?\s*$"
ABBREVIATIONS = (("sr", "Senior"), ("jr", "Junior"), ("eng", "Engineer"), ("mgr", "Manager"), ("dir", "Director"))


def title_case(text: Column) -> Column:
    """Every run of letters with a capital first letter, the rest small."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def canonical_title(raw: Column) -> Column:
    """A title without emoji, place and requisition number, spaces and
    separators evened, five abbreviations written out; in title case if it was
    all small or all capitals. Null stays null."""
    text = F.regexp_replace(raw, EMOJI, "")
    text = F.regexp_replace(F.regexp_replace(text, PLACE_IN_PARENTHESES, ""), REQUISITION, "")
    text = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    text = F.regexp_replace(F.regexp_replace(text, r"\s*/\s*", " / "), r"\s*,\s*", ", ")
    for short, full in ABBREVIATIONS:
        text = F.regexp_replace(text, rf"(?i)\b{short}\b\.?", full)
    same = (text != "") & ((text == F.lower(text)) | (text == F.upper(text)))
    return F.trim(F.when(same, title_case(text)).otherwise(text))


def _first_with(text: Column, table) -> Column:
    """The first class of the table one of whose substrings the text holds."""
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [text.contains(k) for k in words]), F.lit(name)) for name, words in table])


def function_class(title: Column, department: Column) -> Column:
    """The job function told by title and department, or null."""
    return _first_with(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(department, F.lit("")))), rules.FUNCTION_KEYWORDS)


def seniority_class(title: Column) -> Column:
    """The level told by a title, or null."""
    return _first_with(F.lower(F.coalesce(title, F.lit(""))), rules.SENIORITY_KEYWORDS)


def _literal_map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def workplace_type(raw: Column) -> Column:
    """remote, hybrid or onsite; null for anything else."""
    return F.try_element_at(_literal_map(rules.WORKPLACE_TYPES), F.lower(F.trim(raw)))


def employment_type(raw: Column) -> Column:
    return F.try_element_at(_literal_map(rules.EMPLOYMENT_TYPES), F.upper(F.trim(raw)))


def job_key(company: Column, platform: Column, external_id: Column, url: Column, title: Column, department: Column) -> Column:
    """The first identity a posting has: the board's id, its URL, its title and
    department; empty texts count as missing."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    rest = F.concat_ws("|", company, F.coalesce(title, F.lit("")), F.coalesce(department, F.lit("")))
    return F.coalesce(F.concat(company, F.lit(":"), platform, F.lit(":"), given(external_id)), F.concat(company, F.lit(":url:"), short(given(url))), F.concat(company, F.lit(":hash:"), short(rest)))


def one_place(text: Column) -> Column:
    return F.struct(text.alias("place"), F.lower(text).contains("remote").alias("is_remote"))


def places(raw: Column) -> Column:
    """The places of a location text, split at slashes and semicolons, with a
    flag for remote ones: array of place, is_remote."""
    parts = F.filter(F.transform(F.split(raw, r"\s*[/;]\s*"), trimmed), lambda p: p != "")
    return F.transform(parts, one_place)


def contact_key(email: Column, name: Column, domain: Column) -> Column:
    """The key under which a person is suppressed: the address, else name and domain."""
    mail = F.nullif(F.lower(F.trim(email)), F.lit(""))
    return F.coalesce(F.concat(F.lit("email:"), mail), F.concat(F.lit("name:"), F.lower(F.trim(name)), F.lit("@"), F.lower(F.trim(domain))))
