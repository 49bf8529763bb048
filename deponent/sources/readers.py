"""Readers of evidence: transcript, side and audio CSV files, positioned text blocks, recognised speech, archives, reports."""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T
from deponent.operators.files import classified
from deponent.operators.sequence import speaker_label
from deponent.operators.timestamps import is_estimated

# Folders that hold no evidence.
IGNORED_FOLDERS = ("__macosx", ".git", ".svn", "__pycache__", ".ds_store", "node_modules")


def _named(df: DataFrame) -> DataFrame:
    """Columns named as in the header without byte-order mark and blanks."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def transcript_csv(spark: SparkSession, path: str) -> DataFrame | None:
    """Rows of transcript files with ``Timestamp`` or, in older ones, ``Time``; None if a needed column is missing.

    Rows need time, sender, receiver and message. Without the flag's column rows are not estimated. ``source_csv`` is the
    file and ``source_row`` the row's place in it, from 2 on.
    """
    df = _named(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    stamp = next((c for c in ("Timestamp", "Time") if c in df.columns), None)
    if stamp is None or not {"Sender", "Receiver", "Message"} <= set(df.columns):
        return None
    flag = is_estimated("Estimated_Timestamp") if "Estimated_Timestamp" in df.columns else F.lit("False")
    rows = df.select(F.trim(stamp).alias("msg_timestamp"), flag.alias("estimated"), F.trim("Sender").alias("sender"), F.trim("Receiver").alias("receiver"), F.trim("Message").alias("message"), F.col("_metadata.file_path").alias("source_csv"), F.monotonically_increasing_id().alias("_id"))
    placed = rows.withColumn("source_row", (F.row_number().over(Window.partitionBy("source_csv").orderBy("_id")) + 1).cast("int")).drop("_id")
    return placed.filter("msg_timestamp <> '' and sender <> '' and receiver <> '' and message <> ''")


def audio_csv(spark: SparkSession, path: str, base_date: str | None, include_undated: bool = False) -> DataFrame | None:
    """Rows of audio files at ``base_date`` (day/month/year) plus their offset, always estimated; None without the columns.

    Negative offsets count as 0, empty ones too; rows whose offset is no number are left out.
    """
    df = _named(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    if not {"Offset_Seconds", "Sender", "Receiver", "Message"} <= set(df.columns):
        return None
    raw = F.coalesce(F.trim("Offset_Seconds"), F.lit(""))
    offset = F.when(raw == "", F.lit(0.0)).otherwise(raw.try_cast("double"))
    base = F.unix_timestamp(F.to_timestamp(F.lit(base_date), "d/M/yyyy")) if base_date else F.lit(None).cast("long")
    rows = df.select(F.greatest(F.lit(0.0), offset).alias("offset_s"), offset.isNotNull().alias("_ok"), F.trim("Sender").alias("sender"), F.trim("Receiver").alias("receiver"), F.trim("Message").alias("message"), F.col("_metadata.file_path").alias("source_csv")).filter("_ok").drop("_ok")
    stamped = rows.select(D.row_text(F.timestamp_seconds(base + F.floor("offset_s"))).alias("msg_timestamp"), F.lit("True").alias("estimated"), "*")
    full = F.expr("sender <> '' and receiver <> '' and message <> ''")
    return stamped.filter(full if include_undated else full & F.col("msg_timestamp").isNotNull())


def side_csv(spark: SparkSession, path: str) -> DataFrame:
    """``pos``, ``time``, ``side``, ``message`` of side files; further fields belong to the message, other sides are left out.

    Quoted messages may hold several lines, so each file is read by one task.
    """

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(2**31 - 1)
        for pdf in batches:
            for text in pdf["value"]:
                bare = re.sub(r"(?m)^```.*\n?", "", text.removeprefix("\ufeff"))
                rows = [(r[0], r[1], ",".join(r[2:])) for r in csv.reader(io.StringIO(bare, newline="")) if len(r) >= 3]
                yield pd.DataFrame(rows, columns=["time", "side", "message"], dtype="object")

    read = spark.read.text(path, wholetext=True).mapInPandas(records, "time string, side string, message string").withColumn("pos", F.monotonically_increasing_id())
    side = F.upper(F.trim("side"))
    side = F.when(side.isin("LEFT", "INCOMING"), "LEFT").when(side.isin("RIGHT", "OUTGOING"), "RIGHT")
    rows = read.select("pos", F.trim("time").alias("time"), side.alias("side"), F.trim("message").alias("message"))
    return rows.filter("lower(time) <> 'time' and time <> '' and side is not null and message <> ''")


def text_blocks(lines: DataFrame, doc: str = "doc", pos: str = "pos", line: str = "line") -> DataFrame:
    """Positioned blocks of recognised screens: ``doc``, ``screen`` (carried on from its heading), geometry, text."""
    block = r"(?i)\[BLOCK\s+(\d+)\]\s+\[POS=(LEFT|RIGHT|CENTER)\]\s+\[X=(\d+)\]\s+\[Y=(\d+)\]\s+\[W=(\d+)\]\s+\[H=(\d+)\](?:\s+\[CONF=([^\]]*)\])?\s+(.*)$"
    screen = F.regexp_extract(F.trim(line), r"(?i)^\[SCREEN\s+(\d+)\]", 1).try_cast("int")
    carried = F.last(screen, ignorenulls=True).over(Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))
    part = lambda i: F.regexp_extract(F.trim(line), block, i)
    rows = lines.withColumn("screen", carried).filter(F.trim(line).rlike(block))
    return rows.select(doc, "screen", part(1).cast("int").alias("block"), F.upper(part(2)).alias("side"), *[part(i).cast("int").alias(n) for i, n in ((3, "x"), (4, "y"), (5, "w"), (6, "h"))], part(7).try_cast("double").alias("conf"), F.trim(part(8)).alias("text"))


def speech_text(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Segments of recognised speech in its three spellings: ``key``, ``pos``, ``label``, ``start_s``, ``end_s``, ``message``.

    Labels in brackets may stand anywhere; otherwise each line may begin with one. A segment's start is the number in
    brackets just before its label, its end the first one after its words. Segments without words are left out.
    """
    label = r"(?i)\[(?:S\d{1,3}|SPEAKER_\d{1,3})\]"
    t = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"```\w*", " ")
    embedded = texts.select(key, F.when(t.rlike(label), t).otherwise(F.regexp_replace(t, r"(?mi)^\s*(S\d{1,3}|SPEAKER[_\s-]?\d{1,3})\s*[:\-]\s*", "[$1] ")).alias("t")).filter(F.col("t").rlike(r"(?i)\[(?:S\d{1,3}|SPEAKER[_\s-]?\d{1,3})\]"))
    marked = F.regexp_replace("t", r"(?i)(?:\[(\d+(?:\.\d+)?)\]\s*)?\[(S\d{1,3}|SPEAKER[_\s-]?\d{1,3})\]", "\u0001$1\u0002$2\u0003")
    parts = embedded.select(key, F.posexplode(F.split(marked, "\u0001")).alias("pos", "p"))
    lead = parts.filter("pos = 0").select(key, F.col("p").alias("_lead"))
    body = F.regexp_extract("p", "(?s)\u0003(.*)$", 1)
    rows = parts.filter("pos > 0").join(lead, key, "left")
    words = T.clean_message(F.regexp_replace(F.when(F.col("pos") == 1, F.concat_ws(" ", "_lead", body)).otherwise(body), r"\[\d+(?:\.\d+)?\]", " "))
    number = lambda c: F.when(c != "", c.cast("double"))
    out = rows.select(key, "pos", speaker_label(F.regexp_extract("p", "\u0002(.*?)\u0003", 1)).alias("label"), number(F.regexp_extract("p", "^(.*?)\u0002", 1)).alias("start_s"), number(F.regexp_extract(body, r"\[(\d+(?:\.\d+)?)\]", 1)).alias("end_s"), words.alias("message"))
    return out.filter("message <> ''")


def json_object(c: Column, schema: str) -> Column:
    """The object in a model's answer, without fences and talk around its outer braces; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def strict_json_object(c: Column, schema: str) -> Column:
    """struct<value, error> of a model's answer: an answer without a whole object has the error that says so and no value."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull()
    error = F.when(F.coalesce(body, F.lit("")) == "", "no object").when(~whole, "broken object")
    return F.struct(F.when(error.isNull(), F.from_json(body, schema)).alias("value"), error.alias("error"))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """All files under ``root`` but those in folders without evidence: ``rel_path``, ``length``, ``modified``, ``ext``, ``kind``, ``platform``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path"), "length", F.col("modificationTime").alias("modified"))
    rel = F.regexp_replace("path", r"^.*?" + root.rstrip("/").replace(".", r"\."), "")
    listed = found.withColumn("rel_path", F.regexp_replace(rel, "^/+", "")).filter(~F.lower("rel_path").rlike("(?:^|/)(?:" + "|".join(x.replace(".", r"\.") for x in IGNORED_FOLDERS) + ")(?:/|$)"))
    return classified(listed.withColumn("file_ext", F.lit(""))).drop("file_ext")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip archives as bytes: ``archive``, ``folder`` (stable for the archive's state), ``member``, ``content``.

    Members whose names lead out of the archive's folder are left out, as are folders; an unreadable archive has no members.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    folder = F.concat(T.safe_stem(F.col("path")), F.lit("_"), F.substring(F.sha1(F.concat_ws(":", "path", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))), 1, 10))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, where, content in zip(pdf["path"], pdf["folder"], pdf["content"]):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            inside = posixpath.normpath(m.filename.replace("\\", "/"))
                            if not m.is_dir() and m.filename and not inside.startswith(("../", "/")) and inside != "..":
                                rows.append((name, where, inside, z.read(m)))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(rows, columns=["archive", "folder", "member", "content"])

    return files.select("path", folder.alias("folder"), "content").mapInPandas(expand, "archive string, folder string, member string, content binary")


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path``, ``text``; UTF-8 with or without mark, else Latin-1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    utf = F.try_validate_utf8(F.decode("content", "UTF-8"))
    ok = F.expr("is_valid_utf8(cast(content as string))")
    return raw.select("path", F.regexp_replace(F.when(ok, utf).otherwise(F.decode("content", "ISO-8859-1")), "^﻿", "").alias("text"))
