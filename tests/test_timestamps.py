import random
from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest

from strata.operators.timestamps import human_date, resolve, to_iso

CASES = [
    ("2025-03-17T03:31:56+01", None, "2025-03-17T02:31:56+00:00"),
    ("2025-03-30 02:30:00", "Europe/Berlin", "2025-03-30T01:30:00+00:00"),  # skipped: the offset before
    ("2025-10-26 02:30:00", "Europe/Berlin", "2025-10-26T00:30:00+00:00"),  # twice: the first
    ("2024-11-03 01:30", "America/New_York", "2024-11-03T05:30:00+00:00"),
    ("5:09 pm on 6 October, 2024", "Asia/Kolkata", "2024-10-06T11:39:00+00:00"),
    ("12:00 am on 6 October, 2024", None, "2024-10-06T00:00:00+00:00"),
    ("January 25, 2025 12:37:22 PM UTC", "Asia/Tokyo", "2025-01-25T12:37:22+00:00"),
    ("07.12.2024 04:33", None, "2024-12-07T04:33:00+00:00"),
    ("06/23/2025 12:18 PM", None, "2025-06-23T12:18:00+00:00"),
    ("2024/09/10 (Tue) 20:52", None, "2024-09-10T20:52:00+00:00"),
    ("17 Aug 2025 13:22 EST", "Europe/Berlin", "2025-08-17T18:22:00+00:00"),
    ("Fri, 12 Jan 2024 08:46:04 +05:30", None, "2024-01-12T03:16:04+00:00"),
    ("20250904T011002Z", None, "2025-09-04T01:10:02+00:00"),
    ("20240120", "Asia/Tokyo", "2024-01-19T15:00:00+00:00"),
    ("2025-12-15T09:28:21+01:00[Europe/Berlin]", "Asia/Tokyo", "2025-12-15T08:28:21+00:00"),
    ("2025-12-26 03:49:21 Asia/Kolkata", "Asia/Tokyo", "2025-12-25T22:19:21+00:00"),
    ("\t2025-01-07 07:56:38.489436907+05:45\n", None, "2025-01-07T02:11:38.489436+00:00"),
    ("2024-08-29T19:22:27,316", None, "2024-08-29T19:22:27.316000+00:00"),
    ("1772782389", None, "2026-03-06T07:33:09+00:00"),
    ("1716680652986", None, "2024-05-25T23:44:12.986000+00:00"),
    ("1727187366794391", None, "2024-09-24T14:16:06.794391+00:00"),
    ("1710669980.6529", None, "2024-03-17T10:06:20.652900+00:00"),
    ("2025-01-01 00:00", "Not/AZone", "2025-01-01T00:00:00+00:00"),
    *[(bad, "UTC", None) for bad in ("", " ", "soon", "25:61", "T09:00", "2024-11-05T27:15:00Z", "2025-02-30", "n/a", "-", "12", None, "2025-01-01 10:00 QQQ")],
]


def test_formats_and_zones(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, value string, zone string")
    got = {r.i: r.utc_us for r in resolve(df, "value", "utc_us", "zone").collect()}
    for i, (v, z, want) in enumerate(CASES):
        us = None if want is None else round((datetime.fromisoformat(want) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1_000_000)
        assert got[i] == us, (v, z)


@pytest.mark.parametrize("zone", ["America/St_Johns", "Africa/Casablanca", "Australia/Lord_Howe", "Europe/Dublin"])
def test_every_half_hour_around_changes_equals_zoneinfo(spark, zone):
    rows = [(f"2025-{m:02d}-{d:02d} {h:02d}:{mi:02d}:00",) for m in (3, 4, 10, 11) for d in range(1, 31) for h in (0, 1, 2, 3) for mi in (0, 30)]
    df = spark.createDataFrame(rows, "value string")
    from pyspark.sql import functions as F

    for r in resolve(df.withColumn("zone", F.lit(zone)), "value", "utc_us", "zone", flag="how").collect():
        local = datetime.fromisoformat(r.value).replace(tzinfo=ZoneInfo(zone), fold=0)
        assert r.utc_us == round(local.timestamp() * 1_000_000), r.value
        again = datetime.fromisoformat(r.value).replace(tzinfo=ZoneInfo(zone), fold=1)
        assert (r.how == "unique") == (again.utcoffset() == local.utcoffset()), r.value


def test_years_beyond_the_table_have_their_own_offsets(spark):
    days = [f"{y}-{m:02d}-{d:02d} {t}" for y in (1700, 1883, 1942, 1965, 2041, 2045, 2086, 2501, 2750, 9998) for m, d, t in ((1, 1, "00:00"), (7, 1, "12:00"), (12, 31, "23:30"))]
    days += ["2045-03-26 02:30", "2045-10-29 02:30", "1965-10-31 01:30", "1965-04-25 02:30", "2750-10-25 02:30"]
    zones = ("Europe/Berlin", "America/New_York", "Africa/Casablanca", "Australia/Lord_Howe")
    df = spark.createDataFrame([(v, z) for v in days for z in zones], "value string, zone string")
    rows = resolve(df, "value", "utc_us", "zone", flag="how").collect()
    assert len(rows) == len(days) * len(zones)
    for r in rows:
        local = datetime.fromisoformat(r.value).replace(tzinfo=ZoneInfo(r.zone), fold=0)
        again = local.replace(fold=1)
        assert r.utc_us == round((local.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000, (r.value, r.zone)
        assert (r.how == "unique") == (again.utcoffset() == local.utcoffset()), (r.value, r.zone)


def test_zone_names_in_any_case_and_unknown_ones(spark):
    df = spark.createDataFrame([("2045-07-01 12:00", "europe/BERLIN "), ("2025-07-01 12:00", "EUROPE/berlin"), ("2025-07-01 12:00 america/new_york", None), ("2025-07-01 12:00", "Mars/Base")], "value string, zone string")
    got = {(r.zone, (r.utc_us // 3_600_000_000) % 24, r.how) for r in resolve(df, "value", "utc_us", "zone", flag="how").collect()}
    assert got == {("europe/BERLIN ", 10, "unique"), ("EUROPE/berlin", 10, "unique"), (None, 16, "unique"), ("Mars/Base", 12, "unknown")}


def test_ten_zones_from_1900_to_2100(spark):
    zones = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe", "Africa/Casablanca", "America/Sao_Paulo", "Asia/Tehran", "Pacific/Apia", "Europe/London", "America/St_Johns"]
    r = random.Random(7)
    values = [f"{r.randint(1900, 2100)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}" for _ in range(300)]
    df = spark.createDataFrame([(v, z) for v in values for z in zones], "value string, zone string")
    for x in resolve(df, "value", "utc_us", "zone").collect():
        local = datetime.fromisoformat(x.value).replace(tzinfo=ZoneInfo(x.zone), fold=0)
        assert x.utc_us == round((local.astimezone(UTC) - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds()) * 1_000_000, (x.value, x.zone)


def test_layouts_and_extra_columns(spark):
    df = spark.createDataFrame([("2025-01-01", 5, "x")], "value string, year int, spans string")
    r = resolve(df, "value").collect()[0]
    assert (r.year, r.spans) == (5, "x")
    from pyspark.sql import functions as F

    iso, day = df.select(to_iso(F.lit(datetime(2025, 1, 1, 2, 3, 4, 5))), human_date(F.lit(None).cast("timestamp"))).collect()[0]
    assert (iso, day) == ("2025-01-01T02:03:04.000005+00:00", "unknown date")
    assert resolve(spark.createDataFrame([], "value string"), "value").count() == 0
