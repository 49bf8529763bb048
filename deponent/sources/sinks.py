"""Sinks: the merged transcript as quoted CSV, audio rows, turns as text, the run's manifest as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_transcript(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Writes transcript rows with every field quoted, in order of ``seq``; in one folder per value of ``by`` if given."""
    named = {"msg_timestamp": "Timestamp", "estimated": "Estimated_Timestamp", "sender": "Sender", "receiver": "Receiver", "message": "Message"}
    cols = [F.col(a).alias(b) for a, b in named.items()]
    if by:
        out = rows.repartition(by).sortWithinPartitions(by, "seq").select(by, *cols)
        out.write.mode("overwrite").partitionBy(by).option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    else:
        rows.orderBy("seq").select(*cols).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def offset_text(c: Column) -> Column:
    """Seconds with at most three decimals and no zeros at the end."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.greatest(F.lit(0.0), c)), r"0+$", ""), r"\.$", "")


def turn_line(number: Column, label: Column, start: Column, end: Column, message: Column) -> Column:
    """A turn as a line of text; its times only if both are known."""
    stamp = F.when(start.isNotNull() & end.isNotNull(), F.format_string("[%.2f-%.2f] ", start, end)).otherwise("")
    return F.concat(F.format_string("TURN_%03d | ", number), stamp, label, F.lit(": "), message)


def manifest(counts: DataFrame, settings: dict[str, str]) -> DataFrame:
    """One JSON object per row of counts, with the settings of the run."""
    fixed = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return counts.select(F.to_json(F.struct(F.struct(*fixed).alias("settings") if fixed else F.lit(None).alias("settings"), F.struct(*counts.columns).alias("counts"))).alias("value"))
