"""Timestamps in many spellings and zones, normalised to one UTC second (problem 4).

A stamp is taken apart by one regular expression. Local times are looked up in a table of zone-offset intervals exploded by
zone and year, which is an as-of join on the local time: two matching intervals mean that the local time occurs twice (the
earlier occurrence is taken), none means that it was skipped (the offset before the change is taken), one gives the offset.
"""

from __future__ import annotations

import datetime as dt
import zoneinfo
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deponent.session import lookup_join

#: Local years for which intervals are made; earlier and later times use the first and last of them.
FIRST_YEAR, LAST_YEAR = 1970, 2069

# Names of months by their first letters (English, Spanish, German, Tagalog).
MONTHS = {
    1: "jan ene enero january januar jän enero",
    2: "feb febrero february februar pebrero",
    3: "mar marzo march märz mrz marso",
    4: "apr abr abril april",
    5: "may mayo mai",
    6: "jun junio june juni hunyo",
    7: "jul julio july juli hulyo",
    8: "aug ago agosto august",
    9: "sep sept septiembre setiembre september setyembre",
    10: "oct octubre october okt oktober oktubre",
    11: "nov noviembre november nobyembre",
    12: "dec dic diciembre december dez dezember disyembre",
}
# Short zone names in common use for zones whose database entry has a number or another name; hours from UTC.
ZONE_NAMES = {
    "GST": 4.0, "PHT": 8.0, "PHST": 8.0, "NPT": 5.75, "SGT": 8.0, "MYT": 8.0, "ICT": 7.0, "WIB": 7.0, "WITA": 8.0, "WIT": 9.0,
    "IST": 5.5, "PKT": 5.0, "BDT": 6.0, "BST": 1.0, "LKT": 5.5, "UZT": 5.0, "AST": 3.0, "TRT": 3.0, "MSK": 3.0, "HKT": 8.0,
    "BRT": -3.0, "ART": -3.0, "CLT": -4.0, "CLST": -3.0, "COT": -5.0, "PET": -5.0, "VET": -4.0, "BOT": -4.0, "UYT": -3.0,
    "NZST": 12.0, "NZDT": 13.0, "AEST": 10.0, "AEDT": 11.0, "ACST": 9.5, "ACDT": 10.5, "AWST": 8.0, "WAT": 1.0, "CAT": 2.0, "EAT": 3.0, "SAST": 2.0,
}

_STAMP = (
    r"(?Us)^\s*(?:"
    r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"  # 1-3: the year leads
    r"|(\d{4})(\d{2})(\d{2})(?=T)"  # 4-6: no separators
    r"|(\d{1,2})([/.\-])(\d{1,2})\8(\d{4}|\d{2})(?!\d)"  # 7-10: the year ends
    r"|(?:\p{L}+\.?,?\s+)?(\d{1,2})(?:\.|st|nd|rd|th)?\s+(?:de\s+)?(\p{L}+)\.?,?\s+(?:del?\s+)?(\d{4})"  # 11-13: day, month's name
    r"|(?:\p{L}+,\s+)?(\p{L}+)\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"  # 14-16: month's name, day
    r")(?:T|,?\s+)(?:at\s+|um\s+|a\s+las\s+)?"
    r"(\d{1,2})[:h.]?(\d{2})(?:[:.]?(\d{2})(?:[.,]\d+)?)?"  # 17-19: time of day
    r"\s*(?:([AaPp])\.?\s?[Mm]\.?(?!\p{L}))?\s*"  # 20: half of the day
    r"(.*?)\s*$"  # 21: zone
)
_GROUPS = 21


def _intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The offset intervals of each zone by local year: start and end in local seconds, offset in seconds, short name."""
    utc, step = dt.timezone.utc, 14 * 86400
    epoch = dt.datetime(1970, 1, 1, tzinfo=utc)
    first = int(dt.datetime(FIRST_YEAR - 1, 12, 1, tzinfo=utc).timestamp())
    last = int(dt.datetime(LAST_YEAR + 1, 2, 1, tzinfo=utc).timestamp())
    for pdf in batches:
        rows: list[tuple] = []
        for name in pdf["zone"]:
            zone = zoneinfo.ZoneInfo(name)

            def at(s: int) -> tuple[int, str]:
                local = (epoch + dt.timedelta(seconds=s)).astimezone(zone)
                return int(local.utcoffset().total_seconds()), local.tzname() or ""

            changes, now = [(first, *at(first))], at(first)
            for s in range(first + step, last + step, step):
                if (then := at(s)) != now:
                    lo, hi = s - step, s
                    while hi - lo > 1:
                        mid = (lo + hi) // 2
                        lo, hi = (mid, hi) if at(mid) == now else (lo, mid)
                    changes.append((hi, *then))
                    now = then
            spans = [(s + off, (changes[i + 1][0] if i + 1 < len(changes) else 1 << 40) + off, off, short) for i, (s, off, short) in enumerate(changes)]
            spans[0] = (-(1 << 40), *spans[0][1:])
            k = 0
            for year in range(FIRST_YEAR, LAST_YEAR + 1):
                lo, hi = (int(dt.datetime(y, 1, 1, tzinfo=utc).timestamp()) for y in (year, year + 1))
                while k + 1 < len(spans) and spans[k][1] < lo - 2 * 86400:
                    k += 1
                rows += [(name, year, *x) for x in spans[k:] if x[0] < hi + 2 * 86400]
        yield pd.DataFrame(rows, columns=["zone", "local_year", "lo", "hi", "off", "short"])


def zone_intervals(spark: SparkSession) -> DataFrame:
    """Zone-offset intervals exploded to one row per zone and local year, the intervals of it in order of time.

    Its size is bounded by the zone database (some 600 zones by 100 years), whatever the data.
    """
    names = sorted(n for n in zoneinfo.available_timezones() if not n.startswith(("posix/", "right/")) and n not in ("localtime", "posixrules"))
    exploded = spark.createDataFrame([(n,) for n in names], "zone string").repartition(8).mapInPandas(_intervals, "zone string, local_year int, lo long, hi long, off int, short string")
    return exploded.groupBy("zone", "local_year").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "off", "short"))).alias("spans"))



def _first(*parts: Column) -> Column:
    return F.coalesce(*[F.when(p != "", p) for p in parts])


def parse_stamps(df: DataFrame, stamp: str, locale: str, zone: str) -> DataFrame:
    """Adds ``_epoch`` (seconds, for stamps that need no zone table), ``_local`` (local seconds), ``_zone`` and ``_short``.

    ``_local`` is null where the stamp has no day, no time of day, or an impossible one.
    """
    s = F.regexp_replace(F.col(stamp), r"(?U)^\s+|\s+$", "")
    df = df.withColumn("_s", s)
    df = df.withColumn("_p", F.when(F.col("_s").rlike(_STAMP), F.split(F.regexp_replace("_s", _STAMP, "\u0001".join(f"${i}" for i in range(1, _GROUPS + 1))), "\u0001")))
    g = lambda i: F.col("_p")[i - 1]
    us = (F.col(locale) == "en_US") & (g(8) == "/")
    year = _first(g(1), g(4), g(10), g(13), g(16))
    month_name = F.lower(_first(g(12), g(14)))
    names = F.create_map(*[F.lit(x) for n, words in MONTHS.items() for w in dict.fromkeys(words.split()) for x in (w, n)])
    month = F.coalesce(_first(g(2), g(5), F.when(us, g(7)).otherwise(g(9))).try_cast("int"), names[month_name])
    day = _first(g(3), g(6), F.when(us, g(9)).otherwise(g(7)), g(11), g(15)).try_cast("int")
    y = F.when(F.length(year) == 2, year.try_cast("int") + 2000).otherwise(year.try_cast("int"))
    df = df.withColumns({"_y": y, "_m": month, "_d": day, "_h": g(17).try_cast("int"), "_i": g(18).try_cast("int"), "_sec": F.coalesce(_first(g(19)).try_cast("int"), F.lit(0)), "_half": F.lower(g(20)), "_z": g(21)})
    leap = ((F.col("_y") % 4 == 0) & (F.col("_y") % 100 != 0)) | (F.col("_y") % 400 == 0)
    days = F.when(F.col("_m") == 2, F.when(leap, 29).otherwise(28)).when(F.col("_m").isin(4, 6, 9, 11), 30).otherwise(31)
    possible = F.col("_m").between(1, 12) & F.col("_d").between(1, days) & (F.col("_y") >= 1) & F.col("_i").between(0, 59) & F.col("_sec").between(0, 59) & F.when(F.col("_half") != "", F.col("_h").between(1, 12)).otherwise(F.col("_h").between(0, 23))
    hour = F.when(F.col("_half") == "", F.col("_h")).otherwise(F.col("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0))
    local = F.when(possible, F.unix_date(F.make_date("_y", "_m", "_d")).cast("long") * 86400 + hour * 3600 + F.col("_i") * 60 + F.col("_sec"))
    df = df.withColumn("_local", local)
    offset_pattern = r"^(?:UTC|GMT)?\s?([+\-−])(\d{1,2})(?::?(\d{2}))?(?:\s*\[[^\]]*\])?$"
    sign = F.when(F.regexp_extract("_z", offset_pattern, 1) == "+", 1).otherwise(-1)
    offset = sign * (F.regexp_extract("_z", offset_pattern, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract("_z", offset_pattern, 3).try_cast("int"), F.lit(0)) * 60)
    given = F.when(F.upper("_z").isin("Z", "UTC", "GMT", "ZULU"), 0).when(F.col("_z").rlike(offset_pattern), offset)
    epoch = (
        F.when(F.col("_s").rlike(r"^-?\d{9,10}(?:[.,]\d+)?$"), F.regexp_extract("_s", r"^(-?\d+)", 1).try_cast("long"))
        .when(F.col("_s").rlike(r"^\d{12,13}$"), F.floor(F.col("_s").try_cast("long") / 1000))
        .when(F.col("_s").rlike(r"^\d{15,16}$"), F.floor(F.col("_s").try_cast("long") / 1000000))
    )
    region = F.regexp_extract("_z", r"^\[?([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)+)\]?$", 1)
    short = F.regexp_extract("_z", r"^\(?([A-Z]{2,5})\)?$", 1)
    readable = (F.col("_z") == "") | (region != "") | (short != "")
    return df.withColumns({
        "_epoch": F.coalesce(epoch, F.col("_local") - given),
        "_zone": F.when(F.col("_local").isNotNull() & readable, F.when(region != "", region).otherwise(F.trim(zone))),
        "_short": short,
        "_local_year": F.greatest(F.lit(FIRST_YEAR), F.least(F.lit(LAST_YEAR), F.col("_y"))),
    })


def resolve_utc(df: DataFrame, stamp: str, locale: str, zone: str) -> DataFrame:
    """``df`` with ``utc_epoch`` (long, null where the stamp denotes no moment) and ``local_matches`` (int).

    ``local_matches`` is 2 for a local time that occurs twice, 0 for a skipped one, 1 else, and null where the zone table
    was not needed. Null, empty and unreadable stamps, unknown zones, and local times without any zone give null. Every
    row is kept, repeated rows included; columns of the input keep their names.
    """
    spark = df.sparkSession
    parsed = parse_stamps(df, stamp, locale, zone)
    joined = parsed.join(F.broadcast(zone_intervals(spark).withColumnsRenamed({"zone": "_tz_name", "local_year": "_tz_year", "spans": "_spans"})), (F.col("_zone") == F.col("_tz_name")) & (F.col("_local_year") == F.col("_tz_year")), "left")
    t = F.col("_local")
    matches = F.filter("_spans", lambda x: (x["lo"] <= t) & (t < x["hi"]))
    before = F.element_at(F.filter("_spans", lambda x: x["hi"] <= t), -1)
    named = F.filter("_spans", lambda x: x["short"] == F.col("_short"))
    aliases = F.create_map(*[F.lit(x) for k, v in ZONE_NAMES.items() for x in (k, int(v * 3600))])
    alias = aliases[F.col("_short")]
    spoken = F.when(F.col("_short") != "", F.when(F.size(named) > 0, named[0]["off"]).when(F.exists("_spans", lambda x: x["off"] == alias), alias))
    joined = joined.withColumn("_hit", matches)
    offset = F.coalesce(spoken, F.when(F.size("_hit") > 0, F.col("_hit")[0]["off"]).otherwise(before["off"]))
    return joined.withColumns({
        "utc_epoch": F.coalesce(F.col("_epoch"), t - offset),
        "local_matches": F.when(F.col("_epoch").isNull() & F.col("_spans").isNotNull(), F.size("_hit")),
    }).select(*[F.col(c) for c in df.columns], "utc_epoch", "local_matches")


def is_estimated(flag: str) -> Column:
    """``True`` or ``False`` as text; null and unknown spellings are ``False``."""
    return F.when(F.lower(F.regexp_replace(flag, r"(?U)^\s+|\s+$", "")).isin("true", "1", "yes", "y"), "True").otherwise("False")


def normalized_stamps(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per transcript row whose stamp denotes a moment: ``row_id``, ``utc_second``, ``estimated``.

    Rows whose conversation is missing have neither zone nor locale. An empty table gives an empty result.
    """
    facts = rows.select("row_id", "conv_key", "msg_timestamp", "estimated_timestamp")
    dim = conversations.groupBy("conv_key").agg(F.min(F.struct("device_tz", "device_locale")).alias("x")).select("conv_key", "x.device_tz", "x.device_locale")
    found = resolve_utc(lookup_join(facts, dim, "conv_key"), "msg_timestamp", "device_locale", "device_tz").filter(F.col("utc_epoch").isNotNull())
    utc = F.date_format(F.timestamp_seconds("utc_epoch"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return found.select("row_id", utc.alias("utc_second"), is_estimated("estimated_timestamp").alias("estimated"))
