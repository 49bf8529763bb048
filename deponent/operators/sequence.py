"""Operators along the order of rows: islands, rising times, renumbering after anchors, carried dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.operators.ordering import number_in_order
from deponent.operators.scan import carry_forward, lagged, running_max


def speaker_label(c: Column) -> Column:
    """A backend's speaker label as S01, S02, ...; labels of the form SPEAKER_00 count from 0."""
    up = F.upper(F.trim(c))
    zero, one = F.regexp_extract(up, r"^\[?SPEAKER_(\d+)", 1), F.regexp_extract(up, r"^\[?(?:SPEAKER[\s-]?|SPKR[ -]?|SPK[ -]?|S)(\d+)", 1)
    return F.when(zero != "", F.format_string("S%02d", zero.try_cast("int") + 1)).when(one != "", F.format_string("S%02d", one.try_cast("int"))).otherwise(F.when(up == "", "S00").otherwise(up))


def islands(df: DataFrame, key: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the place of the first row of the run of equal ``value`` that a row belongs to, by ``order``."""
    at = F.struct(*order)
    marked = carry_forward(df, key, block, order, {"_last": F.struct(F.coalesce(F.col(value), F.lit("")).alias("v"))}, inclusive=False)
    starts = marked.withColumn("_start", F.when(F.col("_last").isNull() | (F.col("_last.v") != F.coalesce(F.col(value), F.lit(""))), at)).drop("_last")
    return carry_forward(starts, key, block, order, {name: F.col("_start")}).drop("_start")


def rising_seconds(df: DataFrame, key: list[str], block: str, order: list[str], time: str, name: str) -> DataFrame:
    """Adds ``name``: whole minutes of ``time`` moved on by a second at least from row to row, in order; null times stay null.

    The recurrence out(n) = max(minute(n), out(n-1) + 1) is a running maximum of minute(n) - n, taken over blocks of a key.
    """
    timed = number_in_order(df.filter(F.col(time).isNotNull()), key, block, order, "_n")
    step = timed.withColumn("_m", F.unix_timestamp(F.date_trunc("minute", time)) - F.col("_n"))
    run = running_max(step, key, block, order, "_m", "_run")
    done = run.select(*df.columns, F.timestamp_seconds(F.col("_run") + F.col("_n")).alias(name))
    return done.unionByName(df.filter(F.col(time).isNull()).withColumn(name, F.lit(None).cast("timestamp")))


def renumbered(rows: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Estimated chat rows after an observed one get its time plus 1, 2, ... seconds; gaps left by removed rows close.

    Needs ``source_csv``, ``source_row``, ``row_id``, ``source_kind``, ``msg_timestamp``, ``estimated``. An observed row
    without a readable time ends the numbering. Rows of other kinds are unchanged. Files of any length are split in blocks.
    """
    chat = rows.filter((F.col("source_kind") == "chat") & F.col("source_csv").isNotNull()).withColumn("_block", F.floor(F.coalesce("source_row", F.lit(0)) / block_rows))
    rest = rows.filter((F.col("source_kind") != "chat") | F.col("source_kind").isNull() | F.col("source_csv").isNull())
    placed = number_in_order(chat, ["source_csv"], "_block", ["source_row", "row_id"], "_pos")
    anchor = F.when(F.col("estimated") == "False", F.struct(F.col("_pos").alias("pos"), D.row_time(F.col("msg_timestamp")).alias("ts")))
    run = carry_forward(placed, ["source_csv"], "_block", ["source_row", "row_id"], {"_anchor": anchor})
    moved = (F.col("estimated") == "True") & F.col("_anchor.ts").isNotNull()
    again = D.row_text(F.timestamp_seconds(F.unix_timestamp("_anchor.ts") + F.col("_pos") - F.col("_anchor.pos")))
    done = run.withColumn("msg_timestamp", F.when(moved, again).otherwise(F.col("msg_timestamp"))).select(*rows.columns)
    return done.unionByName(rest)


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, order: list[str]) -> DataFrame:
    """Adds ``session_start``: the time and order columns of the first row after a pause of more than ``gap_seconds``.

    Rows are compared with the one before over blocks of a day, so a key that holds most rows is spread over tasks.
    """
    dated = df.withColumns({"_t": F.col(time).cast("timestamp"), "_day": F.to_date(time)}).filter(F.col("_t").isNotNull())
    at = ["_t", *order]
    near = lagged(dated, [key], "_day", at, {"_before": "_t"})
    new = F.col("_before").isNull() | (F.unix_timestamp("_t") - F.unix_timestamp("_before") > gap_seconds)
    starts = near.withColumn("_start", F.when(new, F.struct(*at)))
    return carry_forward(starts, [key], "_day", at, {"session_start": F.col("_start")}).select(*df.columns, "session_start")
