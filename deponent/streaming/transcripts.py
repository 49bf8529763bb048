"""Transcript rows as a stream: exact repeats dropped within a watermark, windows over arrival, state kept per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from deponent.functions import dates as D
from deponent.functions import text as T


def stream_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A folder of Parquet files read as a stream, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def unique_rows(rows: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows without those delivered again with the same file and place; rows later than the watermark are dropped.

    ``loaded_at`` is the time of arrival; it is cast, as watermarks need a timestamp with zone.
    """
    timed = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    return timed.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["source_csv", "source_row"])


def arrivals(rows: DataFrame, every: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows by case, kind and window of arrival."""
    timed = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    counted = timed.groupBy(F.window("loaded_at", every).alias("w"), "case_id", "source_kind").agg(F.count("*").alias("rows"), F.count_if(T.is_unresolved(F.col("sender"))).alias("unresolved"))
    return counted.select(F.col("w.start").alias("start"), "case_id", "source_kind", "rows", "unresolved")


def arrival_sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Runs of arrivals in a conversation with no pause longer than ``gap``."""
    timed = rows.withColumn("loaded_at", F.col("loaded_at").cast("timestamp")).withWatermark("loaded_at", late)
    counted = timed.groupBy(F.session_window("loaded_at", gap).alias("w"), "conv_key").agg(F.count("*").alias("rows"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "conv_key", "rows")


_OUT = st.StructType([st.StructField("conv_key", st.StringType()), st.StructField("row_id", st.LongType()), st.StructField("day", st.StringType())])
_STATE = st.StructType([st.StructField("day", st.StringType())])


def carried_days(rows: DataFrame) -> DataFrame:
    """Each row's day: its own if its time is readable, else the last one seen in its conversation, also in earlier batches."""

    def carry(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        day = state.get[0] if state.exists else None
        pdf = pd.concat(list(parts)).sort_values(["source_row", "row_id"])
        out = []
        for row, own in zip(pdf["row_id"], pdf["own"]):
            day = own if own is not None and own == own else day
            out.append((key[0], row, day))
        state.update((day,))
        yield pd.DataFrame(out, columns=["conv_key", "row_id", "day"])

    dated = rows.select("conv_key", "row_id", F.coalesce("source_row", F.lit(0)).alias("source_row"), F.date_format(D.row_time(F.col("msg_timestamp")), "dd/MM/yyyy").alias("own"))
    return dated.filter("conv_key is not null").groupBy("conv_key").applyInPandasWithState(carry, _OUT, _STATE, "append", "NoTimeout")
