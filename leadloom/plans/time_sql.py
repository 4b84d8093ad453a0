"""The SQL of p2_found: the same formats, without named groups, back references
and look-ahead, which the other engine's regular expressions lack."""

from __future__ import annotations

from leadloom.operators.timestamps import LOCAL_ZONES, MONTHS, TIME_FIELDS, ZONES

_REST = r"([0-9]{1,2})[:h]([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,18}))?)?(?:\s*([AaPp]\.?[Mm]\.?))?(?:\s*(?:GMT|UTC)?([+-][0-9]{2}(?::?[0-9]{2})?)(?:\s*\[[A-Za-z_/+-]+\])?|\s*([A-Za-z]{1,5})(?:\s*\[[A-Za-z_/+-]+\])?)?"
_CLOCK = ["h", "m", "s", "f", "ap", "o", "z"]
_MIDDLE = r"(?:-([0-9]{1,2})-|/([0-9]{1,2})/|\.([0-9]{1,2})\.)"
_W = r"[\p{L}]{3,12}\.?"
#: pattern and names of its groups, in the order in which they are tried
_FORMATS = (
    (r"([0-9]{9,10}|[0-9]{12,13}|[0-9]{15,16}|[0-9]{18,19})(?:\.([0-9]{1,18}))?", ["nn", "nf"]),
    (r"([0-9]{4})([0-9]{2})([0-9]{2})(?:[Tt ]?([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]{1,18}))?)?\s*(?:([+-][0-9]{2}:?[0-9]{2})|([A-Za-z]{1,5}))?)?", ["y", "mo", "d", "h", "m", "s", "f", "o", "z"]),
    (r"([0-9]{4})" + _MIDDLE + r"([0-9]{1,2})(?:(?:[Tt]|,?\s+)" + _REST + ")?", ["y", "ma", "mb", "mc", "d", *_CLOCK]),
    (r"([0-9]{4})\s?年\s?([0-9]{1,2})\s?月\s?([0-9]{1,2})\s?日(?:\s*" + _REST + ")?", ["y", "mo", "d", *_CLOCK]),
    (r"([0-9]{1,2})" + _MIDDLE + r"([0-9]{4}|[0-9]{2})(?:,?\s+" + _REST + ")?", ["n1", "ma", "mb", "mc", "n3", *_CLOCK]),
    (r"(?:" + _W + r",?\s+)?([0-9]{1,2})(?:\.|er|st|nd|rd|th|º)?\s+(?:de\s+|of\s+)?(" + _W + r"),?\s+(?:de\s+|del\s+)?([0-9]{4})(?:(?:,|\s+à|\s+a\s+las|\s+at|\s+um)?\s+" + _REST + r"(?:\s*Uhr)?)?", ["d", "w", "y", *_CLOCK]),
    (r"(?:" + _W + r",?\s+)?(" + _W + r")\s+([0-9]{1,2})(?:st|nd|rd|th)?,?\s+([0-9]{4})(?:(?:,|\s+at)?\s+" + _REST + ")?", ["w", "d", "y", *_CLOCK]),
)
_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _part(name: str) -> str:
    """A component of a matched text; null where its format has none or it is left out."""
    return "nullif(case k " + " ".join(f"when {n} then g{n}.{name}" for n, (_, names) in enumerate(_FORMATS) if name in names) + " end, '')"


def _offset(at: str) -> str:
    return f"(epoch(timezone(tz, to_timestamp({at})))::bigint - ({at}))"


_MONTH = "case w " + " ".join(f"when '{name}' then {i}" for i, names in enumerate(MONTHS, 1) for name in names) + " end"
_ZONE = "case " + " ".join(f"when z = '{a}' and regexp_matches(coalesce(tz, '-'), '{where}') then {minutes}" for a, where, minutes in LOCAL_ZONES) + " " + " ".join(f"when z = '{a}' then {minutes}" for a, minutes in ZONES.items()) + " end"
_FRACTION = "coalesce(rpad(substr(f, 1, {0}), {0}, '0')::bigint, 0)"

P2_SQL = f"""with v as ({" union all ".join(f"select raw_id, '{f}' as field, {f} as text, board_tz as tz, coalesce(board_locale, 'en-GB') as loc from raw_posting r left join company c on c.id = r.company_id where {f} is not null" for f in TIME_FIELDS)}),
    t as (select *, regexp_replace(regexp_replace(translate(text, '０１２３４５６７８９：／', '0123456789:/'), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '{_BLANK}', ' ', 'g') as t from v),
    k as (select *, case {" ".join(f"when regexp_matches(t, '^(?:{p})$') then {n}" for n, (p, _) in enumerate(_FORMATS))} end as k from t),
    g as (select *, {", ".join(f"regexp_extract(t, '^(?:{p})$', [{', '.join(repr(x) for x in names)}]) as g{n}" for n, (p, names) in enumerate(_FORMATS))} from k where k is not null),
    p as (select raw_id, field, tz, loc, {_part('nn')} as nn, {_part('nf')} as nf, {_part('y')}::int as y, coalesce({_part('mo')}, {_part('ma')}, {_part('mb')}, {_part('mc')})::int as mo, lower(replace({_part('w')}, '.', '')) as w, {_part('d')}::int as d, {_part('n1')} as n1, {_part('n3')} as n3,
    {_part('h')}::int as h, {_part('m')}::int as mi, coalesce({_part('s')}::int, 0) as s, {_part('f')} as f, upper(substr({_part('ap')}, 1, 1)) as ap, {_part('o')} as o, nullif(upper({_part('z')}), 'UHR') as z from g),
    c as (select *, regexp_matches(loc, '^(ja|zh|ko|hu)') and length(n3) = 2 as year_first, regexp_matches(loc, '^en[-_](US|PH)$') as month_first from p),
    x as (select *, case when n1 is null then y when year_first then 2000 + n1::int else n3::int + case when length(n3) <= 2 then 2000 else 0 end end as yy, case when w is not null then {_MONTH} when n1 is null or year_first then mo when month_first then n1::int else mo end as mm,
    case when n1 is null then d when year_first then n3::int when month_first then mo else n1::int end as dd, case when ap is null then h when h between 1 and 12 then h % 12 + case when ap = 'P' then 12 else 0 end end as hour, regexp_replace(o, '[^0-9]', '', 'g') as od from c),
    w as (select *, try_cast(printf('%04d-%02d-%02d', yy, mm, dd) as date) as day, case when o is not null then case when od[1:2]::int <= 18 and coalesce(nullif(od[3:4], '')::int, 0) <= 59 then (od[1:2]::int * 60 + coalesce(nullif(od[3:4], '')::int, 0)) * case when o[1] = '-' then -1 else 1 end end when z is not null then {_ZONE} end as minutes from x),
    l as (select *, epoch(day)::bigint + case when h is null then 0 else hour * 3600 + mi * 60 + s end as wall from w where nn is not null or (day is not null and (h is null or (hour <= 23 and mi <= 59 and s <= 59)))),
    r as (select *, case when tz is not null and wall is not null then {_offset('wall - 86400')} end as o1, case when tz is not null and wall is not null then {_offset('wall + 86400')} end as o2 from l),
    q as (select *, case when o1 is not null then {_offset('(wall - o1)')} = o1 end as ok1, case when o1 is not null then {_offset('(wall - o2)')} = o2 end as ok2 from r),
    i as (select *, case when o1 = o2 then case when ok1 then wall - o1 end when ok1 and ok2 then null when ok1 then wall - o1 when ok2 then wall - o2 end as one from q),
    u as (select raw_id, field, case when nn is not null then case when length(nn) <= 10 then nn::bigint * 1000000 + coalesce(rpad(substr(nf, 1, 6), 6, '0')::bigint, 0) when length(nn) <= 13 then nn::bigint * 1000 + coalesce(rpad(substr(nf, 1, 3), 3, '0')::bigint, 0) when length(nn) <= 16 then nn::bigint else substr(nn, 1, length(nn) - 3)::bigint end
    when o is not null or z is not null then (wall - minutes * 60) * 1000000 + {_FRACTION.format(6)} else case when h is null then coalesce(one, wall - o1) else one end * 1000000 + {_FRACTION.format(6)} end as utc_micros from i)
    select * from u where utc_micros is not null"""
