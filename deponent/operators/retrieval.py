"""Retrieval of the rows and passages that matter for a question, by shared words and names, best few of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deponent.functions import dates as D
from deponent.functions import text as T

# Words that do not tell one day's talk from another's.
CONTEXT_STOPWORDS = "about after again also been before being could from have here into just more much only should that their there these they this through very what when where which with would your will shall hello thanks thank".split()


def date_context(rows: DataFrame, max_dates: int = 14, max_rows: int = 8) -> DataFrame:
    """The days of a case's chat that share most words with its recordings, and each day's best rows.

    Columns: ``case_id``, ``place``, ``day``, ``row_id``, ``overlap``. Days are ranked by the sum, then the maximum of shared
    words, then by date; rows by shared words, then by id. Cases without recorded speech have no rows.
    """
    keep = lambda c: (F.length(c) >= 4) & ~c.isin(*CONTEXT_STOPWORDS)
    said = rows.filter("source_kind = 'audio' and message is not null").select("case_id", F.explode(F.array_distinct(T.words(F.col("message")))).alias("t")).distinct().filter(keep(F.col("t")))
    chat = rows.filter("source_kind = 'chat' and message is not null").select("row_id", "case_id", D.row_time(F.col("msg_timestamp")).cast("date").alias("d"), F.array_distinct(T.words(F.col("message"))).alias("w")).filter("d is not null")
    chat = chat.join(said.select("case_id").distinct(), "case_id", "left_semi")
    hits = chat.select("row_id", "case_id", F.explode("w").alias("t")).join(said, ["case_id", "t"]).groupBy("row_id").agg(F.count("*").alias("n"))
    scored = chat.select("row_id", "case_id", "d").join(hits, "row_id", "left").select("row_id", "case_id", "d", F.coalesce("n", F.lit(0)).alias("overlap"))
    days = scored.groupBy("case_id", "d").agg(F.sum("overlap").alias("s"), F.max("overlap").alias("m"))
    days = days.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("s"), F.desc("m"), "d"))).filter(F.col("place") <= max_dates).drop("s", "m")
    k = F.row_number().over(Window.partitionBy("case_id", "d").orderBy(F.desc("overlap"), "row_id"))
    return scored.join(days, ["case_id", "d"]).withColumn("k", k).filter(F.col("k") <= max_rows).select("case_id", F.col("place").cast("long").alias("place"), F.date_format("d", "dd/MM/yyyy").alias("day"), "row_id", "overlap")


def passages_naming_parties(documents: DataFrame, participants: DataFrame, most: int = 12) -> DataFrame:
    """The paragraphs of a case's documents that name most of its parties: ``case_id``, ``doc_id``, ``pos``, ``names``, ``place``.

    A party's name is looked up by its first word, which must stand in the paragraph, before the whole name is searched.
    """
    p = documents.filter("case_id is not null and text is not null").select("doc_id", "case_id", F.posexplode(F.split("text", r"\n\s*\n")).alias("pos", "body")).filter(F.trim("body") != "").withColumn("low", F.lower("body"))
    names = participants.filter("full_name is not null and trim(full_name) <> ''").select("case_id", F.lower(F.trim("full_name")).alias("k")).distinct().withColumn("t", F.get(T.words(F.col("k")), 0))
    words = p.select("doc_id", "case_id", "pos", "low", F.explode(F.array_distinct(T.words(F.col("low")))).alias("t"))
    hits = words.join(names, ["case_id", "t"]).filter(F.contains(F.col("low"), F.col("k"))).groupBy("case_id", "doc_id", "pos").agg(F.countDistinct("k").alias("names"))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("names"), "doc_id", "pos"))
    return hits.withColumn("place", place.cast("long")).filter(F.col("place") <= most).select("case_id", "doc_id", F.col("pos").cast("long").alias("pos"), "names", "place")
