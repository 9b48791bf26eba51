"""Timestamps in many formats, precisions and zones as one UTC instant.

``parse_local`` turns a value into a wall clock and what it says about its zone,
with built-in expressions only. ``resolve`` then looks the wall clock up in the
zone-offset intervals of the zone that holds for it: an as-of join on
(zone, year), the intervals being exploded by year. Two matching intervals mean
that the clock occurs twice (the first counts), none that it is skipped (the
offset before the change counts), one gives the offset.

Defined cases: null, empty, meaningless or impossible values (month 13, hour 27)
give no row; zone names are read in any case; an unknown one counts as none given; digits finer than
microseconds are cut off; missing parts are 0; every year has its own offsets; extra columns are kept as they
are, the added ones end in ``_`` or are named by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo, available_timezones

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions.plan import hold
from strata.functions.text import BLANK_CLASS
from strata.session import cut

# fixed values: offsets of zone abbreviations in minutes
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0,
    "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "WAT": 60,
    "CEST": 120, "MESZ": 120, "EET": 120, "CAT": 120, "SAST": 120,
    "EEST": 180, "MSK": 180, "EAT": 180,
    "PKT": 300, "IST": 330, "NPT": 345,
    "WIB": 420, "ICT": 420, "HKT": 480, "SGT": 480, "AWST": 480, "JST": 540, "KST": 540,
    "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NDT": -150, "NST": -210, "ADT": -180, "AST": -240, "EDT": -240, "EST": -300,
    "CDT": -300, "CST": -360, "MDT": -360, "MST": -420, "PDT": -420, "PST": -480,
    "AKDT": -480, "AKST": -540, "HST": -600,
}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_ZONE = r"\s*([A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+\-]+)+|[+\-−]\d{2}(?::?\d{2})?(?::?\d{2})?|)(?:\s*\[([A-Za-z0-9_/+\-]+)\])?$"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_AMPM = r"(?:\s*([AaPp])\.?[Mm]\.?(?![A-Za-z]))?"
_DAY = r"(?:[A-Za-z]{3,9}\.?,?\s+)?"
#: (pattern, replacement) to year|month|day|hour|minute|second|fraction|a or p|zone|zone in brackets
_FORMS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:\s*\([A-Za-z]+\))?(?:(?:[Tt]|\s+)" + _CLOCK + r")?" + _AMPM + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?:\s*\([A-Za-z]+\))?(?:(?:[Tt]|,?\s+)" + _CLOCK + r")?" + _AMPM + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{4})(\d{2})(\d{2})(?:[Tt]?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?(?=[^\d]))?()" + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?()()()$", "$1|$2|$3|$4|$5|$6|$7|||"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+" + _CLOCK + r")?" + _AMPM + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+" + _CLOCK + r")?" + _AMPM + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (r"^" + _DAY + r"(\d{1,2})\.?[\s\-]+([A-Za-z]{3,9})\.?,?[\s\-]+(\d{4})(?:,?\s+(?:at\s+)?" + _CLOCK + r")?" + _AMPM + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (r"^" + _DAY + r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?:,?\s+(?:at\s+)?" + _CLOCK + r")?" + _AMPM + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
    (r"^" + _CLOCK + _AMPM + r"\s+on\s+" + _DAY + r"(\d{1,2})\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})" + _ZONE, "$8|$7|$6|$1|$2|$3|$4|$5|$9|$10"),
    (r"^" + _CLOCK + _AMPM + r"\s+on\s+" + _DAY + r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})" + _ZONE, "$8|$6|$7|$1|$2|$3|$4|$5|$9|$10"),
)


def _literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def parse_local(df: DataFrame, value: str, default_zone: str | None) -> DataFrame:
    """Adds ``local_us_`` (wall clock as microseconds), ``year_``, ``offset_us_`` (if the value fixes
    it, 0 for epoch numbers) and ``zone_`` (else the zone name that holds, UTC at last)."""
    keep = df.columns
    v = F.col("v_")
    df = df.select(*keep, F.regexp_replace(F.col(value), f"^{BLANK_CLASS}+|{BLANK_CLASS}+$", "").alias("v_"))
    number = v.rlike(r"^\d+(?:\.\d*)?(?:[eE]\+?\d{1,2})?$") & ~v.rlike(r"^\d{8}$")
    form = F.lit(None).cast("string")
    for pattern, order in reversed(_FORMS):
        form = F.when(v.rlike(pattern), F.regexp_replace(v, pattern, order)).otherwise(form)
    df = df.select(*keep, F.when(number, v).alias("digits_"), F.split(F.when(~number, form), r"\|").alias("p_"))
    part = lambda i: F.nullif(F.get("p_", F.lit(i)), F.lit(""))
    whole = lambda i: part(i).try_cast("int")
    months = _literal_map({m: i + 1 for i, m in enumerate(_MONTHS)})
    df = df.select(
        *keep,
        F.col("digits_").try_cast("double").alias("number_"),
        F.col("digits_").try_cast("decimal(38,12)").alias("exact_"),
        whole(0).alias("year_"),
        F.coalesce(whole(1), F.try_element_at(months, F.lower(F.substring(part(1), 1, 3)))).alias("month_"),
        whole(2).alias("day_"),
        whole(3).alias("hour_"),
        F.coalesce(whole(4), F.lit(0)).alias("minute_"),
        F.coalesce(whole(5), F.lit(0)).alias("second_"),
        F.rpad(F.coalesce(F.substring(part(6), 1, 6), F.lit("")), 6, "0").try_cast("bigint").alias("frac_"),
        F.lower(part(7)).alias("half_"),
        F.upper(part(8)).alias("text_"),
        F.regexp_replace(F.when(part(8).rlike(r"^[+\-\u2212]"), part(8)), ":", "").alias("signed_"),
        F.coalesce(part(9), F.when(part(8).contains("/"), part(8))).alias("named_"),
    )
    hour = F.coalesce("hour_", F.lit(0))
    hour = F.when(F.col("half_").isNull(), hour).when(hour.between(1, 12), F.pmod(hour, F.lit(12)) + F.when(F.col("half_") == "p", 12).otherwise(0)).otherwise(F.lit(99))
    second = F.when(F.col("second_") < 60, F.col("second_")).cast("decimal(8,6)")
    clock = F.try_make_timestamp(F.col("year_"), F.col("month_"), F.col("day_"), hour, F.col("minute_"), second, F.lit("UTC"))
    # plain numbers: seconds, milliseconds or microseconds (nanoseconds beyond) by their size
    scale = F.when(F.col("number_") < 1e11, F.lit(1000000)).when(F.col("number_") < 1e14, F.lit(1000)).when(F.col("number_") < 1e17, F.lit(1))
    epoch = F.when(F.col("number_") >= 1e8, F.coalesce(F.floor(F.col("exact_") * scale).try_cast("bigint"), F.floor(F.col("exact_") / 1000).try_cast("bigint")))
    signed = F.col("signed_")
    digits = lambda at: F.coalesce(F.nullif(F.substring(signed, at, 2), F.lit("")).try_cast("int"), F.lit(0))
    seconds = digits(2) * 3600 + digits(4) * 60 + digits(6)
    fixed = F.when((seconds <= 18 * 3600) & (digits(4) < 60), seconds * F.when(signed.startswith("+"), 1).otherwise(-1))
    offset = F.when(signed.isNotNull(), fixed).otherwise(F.try_element_at(_literal_map(ABBREVIATIONS), F.col("text_")) * 60)
    zone = F.lower(F.trim(F.coalesce(F.col("named_"), F.col(default_zone) if default_zone else F.lit(None).cast("string"), F.lit("UTC"))))
    df = df.select(*keep, epoch.alias("epoch_"), (F.unix_micros(clock) + F.col("frac_")).alias("clock_"), "year_", offset.alias("off_"), (F.col("text_").isNotNull() & ~F.col("text_").contains("/")).alias("says_"), zone.alias("zone_"))
    bad_zone = F.col("says_") & F.col("off_").isNull()
    return df.select(
        *keep,
        F.coalesce("epoch_", F.when(~F.coalesce(bad_zone, F.lit(False)), F.col("clock_"))).alias("local_us_"),
        "year_",
        F.when(F.col("epoch_").isNotNull(), F.lit(0)).otherwise(F.col("off_")).cast("bigint").alias("offset_s_"),
        "zone_",
    )


#: years of the table that every query gets; other years of the data are worked out as they occur
YEARS = (1970, 2040)
#: years with intervals of their own: earlier ones have the local mean time of this one, later ones
#: follow rules that repeat after 400 years
FIRST, LAST = 1800, 2500
CYCLE_S = 146_097 * 86_400


def _zone_years(name: str, first: int, last: int, days: int = 27) -> list[tuple[str, int, list[tuple[int, int, int, bool]]]]:
    """(zone, year, [(local start, local end, offset, is a gap)]) in seconds."""
    # a year more at both ends: local years don't start at midnight UTC
    lo, hi = datetime(first - 1, 1, 1, tzinfo=UTC), datetime(last + 2, 1, 1, tzinfo=UTC)
    step, out = timedelta(days=days), []
    far = 1 << 40
    zone = ZoneInfo(name)
    off = lambda t, z=zone: int(t.astimezone(z).utcoffset().total_seconds())
    changes, t, cur = [], lo, off(lo)
    spans = [[-far, None, cur]]
    while t < hi:
        nxt = min(t + step, hi)
        if (o := off(nxt)) != cur:
            a, b = int(t.timestamp()), int(nxt.timestamp())
            while b - a > 1:
                m = (a + b) // 2
                a, b = (m, b) if off(datetime.fromtimestamp(m, UTC)) == cur else (a, m)
            cur = off(datetime.fromtimestamp(b, UTC))
            changes.append(b)
            spans[-1][1] = b
            spans.append([b, None, cur])
            if cur != o:  # two changes within one step
                t = datetime.fromtimestamp(b, UTC)
                continue
        t = nxt
    spans[-1][1] = far
    local = [(a + o, b + o, o, False) for a, b, o in spans]
    local += [(p[1], n[0], p[2], True) for p, n in zip(local, local[1:], strict=False) if n[0] > p[1]]
    for year in range(first, last + 1):
        y0, y1 = int(datetime(year, 1, 1, tzinfo=UTC).timestamp()), int(datetime(year + 1, 1, 1, tzinfo=UTC).timestamp())
        out.append((name, year, [x for x in local if x[0] < y1 and x[1] > y0]))
    return out


@cache
def _intervals(first: int, last: int) -> list[tuple[str, int, list[tuple[int, int, int, bool]]]]:
    """The intervals of every zone of the tz database, under its name in lower case."""
    return [(row[0].lower(), *row[1:]) for name in sorted(available_timezones()) for row in _zone_years(name, first, last)]


def _other_years(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = {z.lower(): z for z in available_timezones()}
    for batch in batches:
        rows = [(z, *row[1:]) for z, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if z in known for row in _zone_years(known[z], y, y, days=6)]
        spans = [[dict(zip(("lo", "hi", "off", "gap"), s, strict=True)) for s in row[2]] for row in rows]
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("off", pa.int64()), ("gap", pa.bool_())]))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array(spans, kind)], ["zone_", "year_", "spans_"])


SPANS = "zone_ string, year_ int, spans_ array<struct<lo: bigint, hi: bigint, off: bigint, gap: boolean>>"


def zone_intervals(spark: SparkSession, first: int = YEARS[0], last: int = YEARS[1]) -> DataFrame:
    """Zone-offset intervals exploded by (zone, year): about 600 zones by the years, a fixed size."""
    return spark.createDataFrame(_intervals(first, last), SPANS)


def resolve(df: DataFrame, value: str, out: str = "utc_us", default_zone: str | None = None, flag: str | None = None, years: tuple[int, int] = YEARS) -> DataFrame:
    """``df`` with the instant of ``value`` in microseconds since 1970 UTC, null where there is none.

    ``flag`` names a column that says how the offset was found: ``given``,
    ``unique``, ``ambiguous``, ``skipped`` or, with UTC taken, ``unknown`` (a zone name that doesn't exist).
    """
    late = F.greatest(F.lit(0), F.ceil((F.col("year_") - LAST) / 400)).cast("bigint")
    parsed = cut(parse_local(df, value, default_zone).withColumn("cycles_", F.coalesce(late, F.lit(0))), "parsed")
    parsed = parsed.withColumn("year_", F.greatest(F.lit(FIRST), (F.col("year_") - 400 * F.col("cycles_")).cast("int")))
    other = parsed.where(~F.col("year_").between(*years) & F.col("offset_s_").isNull() & F.col("local_us_").isNotNull()).select("zone_", "year_").distinct()
    # both tables' sizes are bounded by the tz database, so they may be broadcast at any scale: zones by the years up to LAST
    spans = zone_intervals(df.sparkSession, *years).unionByName(other.mapInArrow(_other_years, SPANS))
    j = parsed.join(F.broadcast(spans), ["zone_", "year_"], "left")
    keep = [c for c in df.columns if c not in (out, flag)]
    sec = F.floor(F.col("local_us_") / 1000000) - F.col("cycles_") * CYCLE_S
    spans = F.filter("spans_", lambda s: (s["lo"] <= sec) & (sec < s["hi"]))
    j = j.select(*keep, "local_us_", "offset_s_", spans.alias("hits_"))
    # of two matches the one with the larger offset is the earlier instant
    first = F.array_max(F.transform(F.filter("hits_", lambda s: ~s["gap"]), lambda s: s["off"]))
    skipped = F.array_max(F.transform(F.filter("hits_", lambda s: s["gap"]), lambda s: s["off"]))
    found = F.coalesce("offset_s_", first, skipped, F.lit(0))
    how = F.when(F.col("local_us_").isNotNull(), F.when(F.col("offset_s_").isNotNull(), "given").when(F.col("hits_").isNull(), "unknown").when(skipped.isNotNull(), "skipped").when(F.size("hits_") > 1, "ambiguous").otherwise("unique"))
    done = hold(j, **{out: F.col("local_us_") - found * 1000000}, **({flag: how} if flag else {}))
    return done.select(*keep, out, *([flag] if flag else []))


def to_iso(c: Column) -> Column:
    """Fixed layout in UTC; text order is time order. The session zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+00:00")


def human_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("unknown date"))
