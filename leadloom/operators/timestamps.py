"""Time texts of mixed formats, precisions and zones to one UTC instant.

Every format is an alternative of one regular expression with named groups.
The expression runs once per value: a single ``regexp_replace`` writes all
components, separated, and ``split`` takes them apart. Calendar ranges are
checked, the instant is assembled by integer day arithmetic, and wall clock
times are resolved against the offsets their zone has on the days around.
Everything stays in JVM expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names of the supported locales, by month.
MONTHS = (
    ("january", "jan", "januar", "jänner", "janvier", "janv", "enero", "ene", "janeiro", "gennaio", "januari"),
    ("february", "feb", "februar", "février", "févr", "fevrier", "febrero", "fevereiro", "fev", "febbraio", "februari"),
    ("march", "mar", "märz", "maerz", "mrz", "mars", "marzo", "março", "marco", "maart"),
    ("april", "apr", "avril", "avr", "abril", "abr", "aprile"),
    ("may", "mai", "mayo", "maio", "maggio", "mei"),
    ("june", "jun", "juni", "juin", "junio", "junho", "giugno"),
    ("july", "jul", "juli", "juillet", "juil", "julio", "julho", "luglio"),
    ("august", "aug", "août", "aout", "agosto", "ago", "augustus"),
    ("september", "sep", "sept", "septembre", "septiembre", "setembro", "set", "settembre"),
    ("october", "oct", "oktober", "okt", "octobre", "octubre", "outubro", "out", "ottobre"),
    ("november", "nov", "novembre", "noviembre", "novembro"),
    ("december", "dec", "dezember", "dez", "décembre", "déc", "decembre", "diciembre", "dic", "dezembro", "dicembre"),
)
#: Minutes east of UTC of zone abbreviations with one meaning.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
    "BRT": -180, "BRST": -120, "ART": -180, "NPT": 345, "PKT": 300, "JST": 540, "KST": 540, "SGT": 480, "HKT": 480,
    "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "SAST": 120,
}
#: Abbreviations whose meaning depends on where they are used:
#: (abbreviation, zones where the meaning holds as a pattern, minutes). The last of each is the default.
LOCAL_ZONES = (
    ("IST", r"^Europe/", 60),
    ("IST", r"^Asia/(Jerusalem|Tel_Aviv)", 120),
    ("IST", r".", 330),
    ("BST", r"^Asia/(Dhaka|Thimphu)", 360),
    ("BST", r".", 60),
    ("CST", r"^Asia/", 480),
    ("CST", r".", -360),
    ("AST", r"^Asia/", 180),
    ("AST", r".", -240),
)
_TIME = r"(?<{p}h>\d{{1,2}})[:h](?<{p}m>\d{{2}})(?::(?<{p}s>\d{{2}})(?:[.,](?<{p}f>\d{{1,18}}))?)?"
_AMPM = r"(?:\s*(?<{p}ap>[AaPp]\.?[Mm]\.?))?"
_OFF = r"(?:\s*(?:GMT|UTC)?(?<{p}o>[+-]\d{{2}}(?::?\d{{2}})?)(?:\s*\[[A-Za-z_/+-]+\])?|\s*(?!Uhr)(?<{p}z>[A-Za-z]{{1,5}})(?:\s*\[[A-Za-z_/+-]+\])?)?"
_REST = _TIME + _AMPM + _OFF
_W = r"[\p{L}]{3,12}\.?"


def _alt(prefix: str, pattern: str) -> str:
    """A date pattern (with P for the group prefix) and the optional time behind it."""
    return "(?:" + pattern.replace("<P", f"<{prefix}") + ")"


def _with_time(prefix: str, gap: str, end: str = "") -> str:
    return f"(?:{gap}{_REST.format(p=prefix)}{end})?"


#: One alternative per format family, in the order in which they are tried.
_FORMATS = (
    # bare numbers since 1970, unit by size; eight digits are a compact date
    r"(?<nn>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})(?:\.(?<nf>\d{1,18}))?",
    # 20240131, 20240131T235959Z, 20240131T235959+0100
    _alt("a", r"(?<Py>\d{4})(?<Pmo>\d{2})(?<Pd>\d{2})(?:[Tt ]?(?<Ph>\d{2})(?<Pm>\d{2})(?:(?<Ps>\d{2})(?:[.,](?<Pf>\d{1,18}))?)?\s*(?:(?<Po>[+-]\d{2}:?\d{2})|(?<Pz>[A-Za-z]{1,5}))?)?"),
    # 2024-01-31T23:59:59.5+01:00[Europe/Paris], 2024/1/31 23:59, 2024.01.31
    _alt("b", r"(?<Py>\d{4})([-/.])(?<Pmo>\d{1,2})\k<sb>(?<Pd>\d{1,2})").replace("([-/.])", "(?<sb>[-/.])") + _with_time("b", r"(?:[Tt]|,?\s+)"),
    # 2024年1月31日 23:59
    _alt("c", r"(?<Py>\d{4})\s?年\s?(?<Pmo>\d{1,2})\s?月\s?(?<Pd>\d{1,2})\s?日") + _with_time("c", r"\s*"),
    # 31/01/2024 23:59, 01/31/24 1:59 PM, 31.01.2024: order by locale
    r"(?<n1>\d{1,2})(?<sd>[-/.])(?<n2>\d{1,2})\k<sd>(?<n3>\d{4}|\d{2})" + _with_time("d", r",?\s+"),
    # Sat, 06 Jul 2024 14:25:15 +0545; 19. Mai 2024, 12:03 Uhr; 10 juillet 2025 à 3h27; 9 de maio de 2026, 21:00
    r"(?:" + _W + r",?\s+)?" + _alt("e", r"(?<Pd>\d{1,2})(?:\.|er|st|nd|rd|th|º)?\s+(?:de\s+|of\s+)?(?<Pw>" + _W + r"),?\s+(?:de\s+|del\s+)?(?<Py>\d{4})") + _with_time("e", r"(?:,|\s+à|\s+a\s+las|\s+at|\s+um)?\s+", r"(?:\s*Uhr)?"),
    # June 26, 2025 3:45 PM; Sep 14, 2025 4:41 AM JST
    r"(?:" + _W + r",?\s+)?" + _alt("g", r"(?<Pw>" + _W + r")\s+(?<Pd>\d{1,2})(?:st|nd|rd|th)?,?\s+(?<Py>\d{4})") + _with_time("g", r"(?:,|\s+at)?\s+"),
)
PATTERN = "^(?:" + "|".join(_FORMATS) + ")$"
_SEP = "\u0001"
_TIMED = "abcdeg"  # prefixes of the alternatives that have a time of day
#: name of each component, and the groups that may hold it
_PARTS = {
    "num": ["nn"],
    "numfrac": ["nf"],
    "year": [f"{p}y" for p in "abceg"],
    "month": [f"{p}mo" for p in "abc"],
    "word": ["ew", "gw"],
    "day": [f"{p}d" for p in "abceg"],
    "n1": ["n1"],
    "n2": ["n2"],
    "n3": ["n3"],
    "hour": [f"{p}h" for p in _TIMED],
    "minute": [f"{p}m" for p in _TIMED],
    "second": [f"{p}s" for p in _TIMED],
    "frac": [f"{p}f" for p in _TIMED],
    "ampm": [f"{p}ap" for p in "bcdeg"],
    "offset": [f"{p}o" for p in _TIMED],
    "zone": [f"{p}z" for p in _TIMED],
}
_REPLACEMENT = "\u0002" + _SEP.join("".join("${" + g + "}" for g in groups) for groups in _PARTS.values())
_SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _int(text: Column) -> Column:
    return F.when(text != "", text.cast("int"))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic."""
    a = F.floor((F.lit(14) - m) / 12)
    yy, mm = y + 4800 - a, m + a * 12 - 3
    jdn = d + F.floor((mm * 153 + 2) / 5) + yy * 365 + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) - 32045
    return (jdn - 2440588).cast("bigint")


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def zone_offset(seconds: Column, zone: Column) -> Column:
    """Seconds east of UTC that a zone has at an instant."""
    at = F.timestamp_seconds(seconds)
    return F.unix_seconds(F.from_utc_timestamp(at, zone)) - F.unix_seconds(at)


def _abbreviation_minutes(abbr: Column, zone: Column) -> Column:
    fixed = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    local = reduce(lambda c, r: c.when((abbr == r[0]) & F.coalesce(zone, F.lit("-")).rlike(r[1]), F.lit(r[2])), LOCAL_ZONES, F.when(F.lit(False), F.lit(0)))
    return F.coalesce(local, F.try_element_at(fixed, abbr))


def utc_micros(text: Column, zone: Column, locale: Column) -> Column:
    """Microseconds since 1970 UTC that a time text names, or null.

    text: as written; zone: IANA zone of wall clock times without zone; locale:
    decides the order of numeric dates (en-US month first, East Asian year
    first, else day first). Null for null, blank and relative texts, impossible
    dates and times, wall clock times that the zone skips or has twice, unknown
    zones of zone-less times, and bare years. A date alone is the first instant
    of its day. Digits finer than microseconds are cut.
    """
    ascii_digits = F.translate(text, "０１２３４５６７８９：／", "0123456789:/")
    trimmed = F.regexp_replace(ascii_digits, f"^{_SPACE}+|{_SPACE}+$", "")
    even = F.regexp_replace(trimmed, _SPACE, " ")
    parts = F.split(F.regexp_replace(even, PATTERN, _REPLACEMENT), _SEP)
    return _let(parts, lambda p: _assemble(p, zone, locale))


def zoned_micros(text: Column) -> Column:
    """:func:`utc_micros` for texts that are nearly always ISO with a written
    zone: those take Spark's own cast, all others the general way (as UTC)."""
    iso = text.rlike(r"^\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})\s*$")
    return F.when(iso, F.unix_micros(text.try_cast("timestamp"))).otherwise(utc_micros(text, F.lit("UTC"), F.lit("en-GB")))


def _assemble(p: Column, zone: Column, locale: Column) -> Column:
    part = {name: p[i] for i, name in enumerate(_PARTS)}
    matched = F.substring(p[0], 1, 1) == "\u0002"
    num = F.substring(p[0], 2, 30)

    # bare numbers
    n, size = num.cast("bigint"), F.length(num)
    frac6 = F.rpad(F.substring(part["numfrac"], 1, 6), 6, "0").cast("bigint")
    frac3 = F.rpad(F.substring(part["numfrac"], 1, 3), 3, "0").cast("bigint")
    number = (
        F.when(size <= 10, n * 1000000 + F.coalesce(frac6, F.lit(0)))
        .when(size <= 13, n * 1000 + F.coalesce(frac3, F.lit(0)))
        .when(size <= 16, n)
        .otherwise(F.substring(num, 1, size - 3).cast("bigint"))
    )

    # date
    months = F.create_map(*[F.lit(x) for i, names in enumerate(MONTHS, 1) for name in names for x in (name, i)])
    named = F.try_element_at(months, F.lower(F.regexp_replace(part["word"], r"\.", "")))
    n1, n2, n3 = _int(part["n1"]), _int(part["n2"]), _int(part["n3"])
    year_first = locale.rlike("^(ja|zh|ko|hu)") & (F.length(part["n3"]) == 2)
    month_first = locale.rlike("^en[-_](US|PH)$") & ~year_first
    short = F.when(year_first, part["n1"]).otherwise(part["n3"])
    numeric_year = _int(short) + F.when(F.length(short) <= 2, F.lit(2000)).otherwise(F.lit(0))
    y = F.coalesce(_int(part["year"]), numeric_year)
    m = F.coalesce(_int(part["month"]), named, F.when(month_first, n1).otherwise(n2))
    d = F.coalesce(_int(part["day"]), F.when(year_first, n3).when(month_first, n2).otherwise(n1))

    # time of day
    h, mi, s = _int(part["hour"]), _int(part["minute"]), F.coalesce(_int(part["second"]), F.lit(0))
    half = F.upper(F.substring(part["ampm"], 1, 1))
    hour = F.when(half == "", h).when((h >= 1) & (h <= 12), h % 12 + F.when(half == "P", 12).otherwise(0))
    micros = F.when(part["frac"] != "", F.rpad(F.substring(part["frac"], 1, 6), 6, "0").cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    has_time = part["hour"] != ""

    # zone
    digits = F.regexp_replace(part["offset"], "[^0-9]", "")
    off_h, off_m = _int(F.substring(digits, 1, 2)), F.coalesce(_int(F.substring(digits, 3, 2)), F.lit(0))
    offset = F.when((off_h <= 18) & (off_m <= 59), (off_h * 60 + off_m) * F.when(F.substring(part["offset"], 1, 1) == "-", -1).otherwise(1))
    minutes = F.when(part["offset"] != "", offset).when(part["zone"] != "", _abbreviation_minutes(F.upper(part["zone"]), zone))
    zoned = (part["offset"] != "") | (part["zone"] != "")

    date_ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_length(y, m))
    time_ok = ~has_time | ((hour <= 23) & (mi <= 59) & (s <= 59))
    local = days_from_civil(y, m, d) * 86400 + F.when(has_time, hour * 3600 + mi * 60 + s).otherwise(F.lit(0))

    def resolve(wall: Column) -> Column:
        """The instant of a wall clock time: the offsets of the day before and of the day after are the candidates."""

        def pick(o: Column) -> Column:
            first, second = wall - o[0], wall - o[1]
            first_ok, second_ok = zone_offset(first, zone) == o[0], zone_offset(second, zone) == o[1]
            one = F.when(o[0] == o[1], F.when(first_ok, first)).when(first_ok & second_ok, F.lit(None)).when(first_ok, first).when(second_ok, second)
            # a day that begins in a gap starts at the change, one that begins twice at its first beginning
            return F.when(has_time, one).otherwise(F.coalesce(one, first))

        return F.when(zone.isNotNull(), _let(F.array(zone_offset(wall - 86400, zone), zone_offset(wall + 86400, zone)), pick))

    instant = F.when(zoned, local - minutes * 60).otherwise(_let(local, resolve))
    dated = F.when(date_ok & time_ok, instant * 1000000 + micros)
    return F.when(matched, F.when(num != "", number).otherwise(dated))


#: the time columns of a raw posting
TIME_FIELDS = ("updated_at", "created_at", "published_at", "released_date")


def posting_instants(raw: DataFrame, company: DataFrame, fields: tuple[str, ...] = TIME_FIELDS) -> DataFrame:
    """One row per (posting, time field) whose text names exactly one instant:
    raw_id, field, utc_micros. Postings of unknown companies keep their values
    with a written zone; zone-less values of theirs name no instant."""
    boards = company.select(F.col("id").alias("company_id"), "board_tz", "board_locale").dropDuplicates(["company_id"])
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return (
        raw.select("raw_id", "company_id", *fields)
        .join(boards, "company_id", "left")
        .select("raw_id", "board_tz", "board_locale", F.inline(values))
        .filter(F.col("text").isNotNull())
        .select("raw_id", "field", utc_micros(F.col("text"), F.col("board_tz"), F.coalesce(F.col("board_locale"), F.lit("en-GB"))).alias("utc_micros"))
        .filter(F.col("utc_micros").isNotNull())
    )
