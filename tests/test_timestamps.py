import datetime as dt
import random
import zoneinfo

from pyspark.sql import functions as F

from deponent.operators import timestamps as TS

ZONES = ["Europe/London", "America/New_York", "Asia/Kathmandu", "Australia/Sydney", "Africa/Casablanca", "Asia/Manila"]


def resolve(spark, rows):
    df = spark.createDataFrame(rows, "stamp string, locale string, zone string, utc_epoch_in long")
    got = TS.resolve_utc(df, "stamp", "locale", "zone").withColumn("u", F.date_format(F.timestamp_seconds("utc_epoch"), "yyyy-MM-dd'T'HH:mm:ss")).collect()
    return {(r.stamp, r.locale, r.zone): r for r in got}


def test_local_times_against_zoneinfo(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for _ in range(400):
        zone = rng.choice(ZONES)
        local = dt.datetime(2023, 1, 1) + dt.timedelta(seconds=rng.randrange(3 * 365 * 86400))
        if rng.random() < 0.4:  # near a change
            day = {"Europe/London": [(2024, 3, 31), (2024, 10, 27)], "America/New_York": [(2024, 3, 10), (2024, 11, 3)], "Australia/Sydney": [(2024, 10, 6), (2025, 4, 6)]}.get(zone)
            if day:
                local = dt.datetime(*rng.choice(day)) + dt.timedelta(seconds=rng.randrange(4 * 3600))
        stamp = local.strftime("%d/%m/%Y %H:%M:%S")
        aware = local.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0)  # the first occurrence; in a gap the offset before it
        rows.append((stamp, "en_GB", zone, None))
        want[(stamp, "en_GB", zone)] = int(aware.timestamp())
    got = resolve(spark, rows)
    assert {k: r.utc_epoch for k, r in got.items()} == want


def test_spellings_and_impossible_stamps(spark):
    cases = {
        ("03/04/2025 10:00", "en_US", "UTC"): "2025-03-04T10:00:00",
        ("03/04/2025 10:00", "en_GB", "UTC"): "2025-04-03T10:00:00",
        ("03.04.25 10:00", "en_US", "UTC"): "2025-04-03T10:00:00",
        ("03-04-2025 14h42", None, "UTC"): "2025-04-03T14:42:00",
        ("2025/04/03 10:00", "en_US", "UTC"): "2025-04-03T10:00:00",
        ("03/04/2025, 12:05 AM", "en_GB", "UTC"): "2025-04-03T00:05:00",
        ("7 de junio de 2025, 0:19", "es_ES", "Europe/Madrid"): "2025-06-06T22:19:00",
        ("June 8, 2025 6:13:17 PM", "en_US", "UTC"): "2025-06-08T18:13:17",
        ("Tue, 02 Jun 2026 15:13:38 +0200", None, None): "2026-06-02T13:13:38",
        ("20260605T083025Z", None, None): "2026-06-05T08:30:25",
        ("1780323063", None, None): "2026-06-01T14:11:03",
        ("1780323063999", None, None): "2026-06-01T14:11:03",
        ("07/10/2026 13:23:07 EDT", "en_US", "America/New_York"): "2026-07-10T17:23:07",
        ("07/10/2026 13:23:07 EST", "en_US", "America/New_York"): "2026-07-10T18:23:07",
        ("28/12/2024 02:49:39 PHT", "en_PH", "Asia/Manila"): "2024-12-27T18:49:39",
        ("28/12/2024 02:49:39 UTC+8", "en_PH", None): "2024-12-27T18:49:39",
        ("2026-06-08 01:11:28 Europe/Madrid", None, "Asia/Manila"): "2026-06-07T23:11:28",
        ("2026-06-13T02:09:15+02:00[Europe/Madrid]", None, None): "2026-06-13T00:09:15",
        ("30/02/2025 10:00", "en_GB", "UTC"): None,
        ("29/02/2024 10:00", "en_GB", "UTC"): "2024-02-29T10:00:00",
        ("29/02/2025 10:00", "en_GB", "UTC"): None,
        ("10/10/2025 25:17", "en_GB", "UTC"): None,
        ("10/10/2025 13:17 PM", "en_GB", "UTC"): None,
        ("??/??/???? 07:24", "en_GB", "UTC"): None,
        ("10/10/2025", "en_GB", "UTC"): None,
        ("07:24", "en_GB", "UTC"): None,
        ("10/10/2025 07:24", "en_GB", None): None,
        ("10/10/2025 07:24", "en_GB", "Nowhere/Else"): None,
        ("", "en_GB", "UTC"): None,
        (None, None, None): None,
        (" 10/10/2025 07:24\n", "en_GB", "UTC"): "2025-10-10T07:24:00",
    }
    got = resolve(spark, [(*k, None) for k in cases])
    assert {k: r.u for k, r in got.items()} == cases


def test_matches_say_ambiguous_and_skipped(spark):
    got = resolve(spark, [("26/10/2025 01:30", "en_GB", "Europe/London", None), ("30/03/2025 01:30", "en_GB", "Europe/London", None), ("30/03/2025 04:30", "en_GB", "Europe/London", None)])
    assert sorted(r.local_matches for r in got.values()) == [0, 1, 2]


def test_tables_with_nulls_repeats_and_other_columns(spark):
    rows = spark.createDataFrame([(1, "c", "10/10/2025 07:24", " YES ", 5), (1, "c", "10/10/2025 07:24", None, 5), (2, None, "10/10/2025 07:24", "1", 5), (3, "x", None, "True", 5)], "row_id long, conv_key string, msg_timestamp string, estimated_timestamp string, _zone int")
    talks = spark.createDataFrame([("c", "UTC", "en_GB", 1), ("c", "UTC", "en_GB", 2)], "conv_key string, device_tz string, device_locale string, _zone int")
    got = sorted(tuple(r) for r in TS.normalized_stamps(rows, talks).collect())
    assert got == [(1, "2025-10-10T07:24:00Z", "False"), (1, "2025-10-10T07:24:00Z", "True")]
    assert TS.normalized_stamps(rows.limit(0), talks).count() == 0
