from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from leadloom.operators import timestamps as ts


def micros(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, zone string, locale string")
    got = df.select("i", ts.utc_micros(F.col("text"), F.col("zone"), F.col("locale")).alias("u")).orderBy("i").collect()
    return [r.u for r in got]


def at(*parts, tz="UTC", us=0):
    return int((datetime(*parts, tzinfo=ZoneInfo(tz)).astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) + us


NY, US, BERLIN, TOKYO = ("America/New_York", "en-US"), ("en-US"), ("Europe/Berlin", "de-DE"), ("Asia/Tokyo", "ja-JP")
CASES = [
    (("2025-01-02T03:04:05Z", *NY), at(2025, 1, 2, 3, 4, 5)),
    (("  2025-01-02t03:04:05.1234567z\n", *NY), at(2025, 1, 2, 3, 4, 5, us=123456)),
    (("2025-07-01T12:00:00+05:45", *NY), at(2025, 7, 1, 6, 15)),
    (("2025-07-01 12:00:00 GMT-0600", *NY), at(2025, 7, 1, 18)),
    (("2025-07-01 12:00:00,5-04", *NY), at(2025, 7, 1, 16, us=500000)),
    (("2025-06-04T18:23:27+01:00[Europe/London]", *NY), at(2025, 6, 4, 17, 23, 27)),
    (("20250206T163228Z", *NY), at(2025, 2, 6, 16, 32, 28)),
    (("20250206", *BERLIN), at(2025, 2, 6, tz="Europe/Berlin")),
    (("2025-02-06", *BERLIN), at(2025, 2, 6, tz="Europe/Berlin")),
    (("1735689600", *NY), 1735689600000000),
    (("1735689600.25", *NY), 1735689600250000),
    (("1735689600123", *NY), 1735689600123000),
    (("1735689600123456", *NY), 1735689600123456),
    (("1735689600123456789", *NY), 1735689600123456),
    (("03/04/2025 5:18 PM", *NY), at(2025, 3, 4, 17, 18, tz=NY[0])),
    (("12/31/25 12:05 AM", *NY), at(2025, 12, 31, 0, 5, tz=NY[0])),
    (("03/04/2025 17:18", "Europe/London", "en-GB"), at(2025, 4, 3, 17, 18, tz="Europe/London")),
    (("19. Mai 2024, 12:03 Uhr", *BERLIN), at(2024, 5, 19, 12, 3, tz=BERLIN[0])),
    (("10 juillet 2025 à 3h27", "Europe/Paris", "fr-FR"), at(2025, 7, 10, 3, 27, tz="Europe/Paris")),
    (("9 de maio de 2026, 21:00", "America/Sao_Paulo", "pt-BR"), at(2026, 5, 9, 21, tz="America/Sao_Paulo")),
    (("2025年4月16日 16:59", *TOKYO), at(2025, 4, 16, 16, 59, tz="Asia/Tokyo")),
    (("Sat, 06 Jul 2024 14:25:15 +0545", *NY), at(2024, 7, 6, 8, 40, 15)),
    (("Sep 14, 2025 4:41 AM JST", *TOKYO), at(2025, 9, 13, 19, 41)),
    (("2025-01-05 10:00:00 CST", "Asia/Shanghai", "zh-CN"), at(2025, 1, 5, 2)),
    (("2025-01-05 10:00:00 CST", "America/Chicago", "en-US"), at(2025, 1, 5, 16)),
    (("2026-11-01 01:30:00 EST", *NY), at(2026, 11, 1, 6, 30)),
    (("2026-03-08 02:30:00", *NY), None),  # skipped
    (("2026-11-01 01:30:00", *NY), None),  # occurs twice
    (("2025-02-30T10:00:00Z", *NY), None),
    (("30/13/2025 10:00", "Europe/London", "en-GB"), None),
    (("2025-01-01 24:61:00", *NY), None),
    (("yesterday", *NY), None),
    (("3 days ago", *NY), None),
    (("2026", *NY), None),
    (("", *NY), None),
    ((None, *NY), None),
    (("2025-01-01 10:00:00", None, "en-US"), None),
    (("2025-01-01 10:00:00 XYZ", *NY), None),
]


@pytest.fixture(scope="module")
def results(spark):
    return micros(spark, *[c[0] for c in CASES])


@pytest.mark.parametrize("k", range(len(CASES)), ids=[str(c[0][0]) for c in CASES])
def test_value(results, k):
    assert results[k] == CASES[k][1]


def test_against_zoneinfo_over_changes_of_clocks(spark):
    zone = ZoneInfo("Europe/London")
    rows, want = [], []
    for day in (datetime(2025, 3, 30), datetime(2025, 10, 26), datetime(2025, 6, 1)):
        for minute in range(0, 240, 15):
            wall = day + timedelta(minutes=minute)
            both = {wall.replace(tzinfo=zone, fold=f).astimezone(UTC) for f in (0, 1)}
            real = {u for u in both if u.astimezone(zone).replace(tzinfo=None) == wall}
            rows.append((wall.strftime("%Y-%m-%d %H:%M:%S"), "Europe/London", "en-GB"))
            want.append(int((real.pop() - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1)) if len(real) == 1 else None)
    assert micros(spark, *rows) == want


def test_posting_instants(spark):
    company = spark.createDataFrame([("c1", "Europe/Berlin", "de-DE")], "id string, board_tz string, board_locale string")
    raw = spark.createDataFrame([(1, "c1", "01.02.2025 00:00", None, "x", "1735689600"), (2, "zz", "2025-01-01T00:00:00Z", "2025-01-01", None, None)], "raw_id long, company_id string, updated_at string, created_at string, published_at string, released_date string").withColumn("field", F.lit("clash"))
    got = {(r.raw_id, r.field): r.utc_micros for r in ts.posting_instants(raw, company).collect()}
    assert got == {(1, "updated_at"): at(2025, 2, 1, tz="Europe/Berlin"), (1, "released_date"): 1735689600000000, (2, "updated_at"): at(2025, 1, 1)}
    assert ts.posting_instants(raw.limit(0), company).count() == 0
