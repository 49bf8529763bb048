"""The merged transcript: cleaned, without repeats, in order, renumbered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T
from deponent.operators.dedupe import transcript_unique
from deponent.operators.ordering import number_in_order
from deponent.operators.sequence import renumbered
from deponent.operators.timestamps import is_estimated
from deponent.session import checkpointed


def readable_rows(rows: DataFrame) -> DataFrame:
    """Rows with time, sender, receiver and message, trimmed, the flag as True or False; others are no transcript rows."""
    trimmed = rows.withColumns({c: F.trim(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) for c in ("msg_timestamp", "sender", "receiver", "message")})
    full = trimmed.filter("msg_timestamp <> '' and sender <> '' and receiver <> '' and message <> ''")
    return full.withColumn("estimated", is_estimated("estimated_timestamp"))


def merged_transcript(rows: DataFrame) -> DataFrame:
    """``case_id``, ``seq``, ``row_id``, ``msg_timestamp``, ``estimated``, ``sender``, ``receiver``, ``message`` of each case in order.

    Rows of a case are ordered by time, unreadable times last, then by ``row_id``. Null cases form a case of their own.
    """
    # A message with a sign keeps one in the cleanup, so no row is lost by it; a filter here would have every message cleaned twice.
    clean = readable_rows(rows).withColumn("message", T.final_message(F.col("message")))
    once = checkpointed(transcript_unique(clean).select("case_id", "row_id", "source_csv", "source_row", "source_kind", "msg_timestamp", "estimated", "sender", "receiver", "message").withColumn("_id", F.monotonically_increasing_id()))
    # Places are found for keys and times alone; the messages are joined once, at the end.
    final = renumbered(once.drop("sender", "receiver", "message")).withColumn("_ts", D.row_time(F.col("msg_timestamp"))).withColumn("_block", order_block(F.col("_ts"), F.col("row_id")))
    numbered = number_in_order(checkpointed(final.select("_id", "case_id", "row_id", "msg_timestamp", "_ts", "_block")), ["case_id"], "_block", [F.col("_ts").asc_nulls_last(), "row_id"], "seq")
    return numbered.select("_id", "seq", "msg_timestamp").join(once.drop("msg_timestamp"), "_id").select("case_id", "seq", "row_id", "msg_timestamp", "estimated", "sender", "receiver", "message")


def order_block(time: Column, row_id: Column) -> Column:
    """A number that never falls along (time, nulls last, row_id): the hour of a time, and pieces of ids where there is none.

    Rows without a readable time may be most of a case; they are cut as finely as those with one.
    """
    return F.coalesce(F.floor(F.unix_timestamp(time) / 3600), F.lit(1 << 40) + F.floor(row_id / (1 << 16)), F.lit(1 << 60))
