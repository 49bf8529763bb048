"""Evidence files: kinds by suffix, platforms by path, likely reports, unique output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions import text as T
from deponent.operators.ordering import number_in_order

# Suffixes by kind, words of a path by platform (the first platform that fits counts), weights of a report's name.
IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
AUDIO = ("mp3", "wav", "m4a", "aac", "flac", "ogg", "opus", "wma", "mp4", "mkv", "mov")
REPORTS = ("pdf", "txt")
PLATFORMS = (("facebook", ("facebook", "messenger", "fb_", "/fb/")), ("viber", ("viber",)), ("email", ("email", "e-mail", "mail_", "/mail/")))
REPORT_WEIGHTS = ((("overview",), 60), (("allegation", "initial"), 45), (("case",), 35), (("report",), 30), (("complaint", "complainant", "victim"), 25), (("statement",), 15), (("log", "ground_truth", "groundtruth", "accuracy", "result", "output", "debug", "extracted", "merged", "transcript"), -40))

EXTENSION_SQL = r"CASE WHEN coalesce(trim(file_ext), '') <> '' THEN regexp_replace(lower(trim(file_ext)), '^\.', '') ELSE regexp_extract(lower(coalesce(rel_path, '')), '\.([a-z0-9]+)$', 1) END"
KIND_SQL = f"CASE WHEN {EXTENSION_SQL} IN {IMAGES} THEN 'image' WHEN {EXTENSION_SQL} IN {AUDIO} THEN 'audio' WHEN {EXTENSION_SQL} IN {REPORTS} THEN 'report' WHEN {EXTENSION_SQL} = 'zip' THEN 'archive' ELSE 'other' END"
PLATFORM_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(rel_path, '')), '{w}')" for w in ws) + f" THEN '{p}'" for p, ws in PLATFORMS) + " ELSE 'unknown' END"
_NAME = r"lower(regexp_replace(rel_path, '^.*/', ''))"
SCORE_SQL = (
    rf"(CASE WHEN regexp_matches({_NAME}, 'cases?[_\s-]*overview') THEN 100 ELSE 0 END"
    + "".join(" + CASE WHEN " + " OR ".join(f"contains({_NAME}, '{w}')" for w in ws) + f" THEN {n} ELSE 0 END" for ws, n in REPORT_WEIGHTS)
    + " - 3 * greatest(0, len(string_split(rel_path, '/')) - 1) - CASE WHEN contains(lower(rel_path), 'evidence') THEN 8 ELSE 0 END - CASE WHEN contains(lower(rel_path), 'structured') THEN 10 ELSE 0 END"
    + f" - CASE WHEN contains(lower(rel_path), 'unstructured') THEN 3 ELSE 0 END + CASE WHEN ends_with({_NAME}, '.pdf') THEN 5 ELSE 0 END)"
)


def extension(ext: str, path: str) -> Column:
    """A file's suffix in lower case without its dot; taken from the path where it is missing."""
    given = F.regexp_replace(F.lower(F.trim(ext)), r"^\.", "")
    return F.when(F.coalesce(F.trim(ext), F.lit("")) != "", given).otherwise(F.regexp_extract(F.lower(F.coalesce(F.col(path), F.lit(""))), r"\.([a-z0-9]+)$", 1))


def platform(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    out = None
    for name, words in PLATFORMS:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def classified(files: DataFrame) -> DataFrame:
    """The inventory with ``ext``, ``kind`` (image, audio, report, archive, other) and ``platform``; null paths are unknown."""
    with_ext = files.withColumn("ext", extension("file_ext", "rel_path"))
    kind = F.when(F.col("ext").isin(*IMAGES), "image").when(F.col("ext").isin(*AUDIO), "audio").when(F.col("ext").isin(*REPORTS), "report").when(F.col("ext") == "zip", "archive").otherwise("other")
    return with_ext.withColumns({"kind": kind, "platform": platform(F.col("rel_path"))})


def unique_stems(files: DataFrame, block_files: int = 1 << 16) -> DataFrame:
    """``file_id`` and a file-name stem; stems equal but for case get _002, _003, ... in the order of ids, counted over blocks of ids."""
    stems = files.filter("rel_path is not null").select("file_id", T.safe_stem(F.col("rel_path")).alias("stem"))
    keyed = stems.withColumns({"_low": F.lower("stem"), "_block": F.floor(F.col("file_id") / block_files)})
    k = F.col("_k")
    return number_in_order(keyed, ["_low"], "_block", ["file_id"], "_k").select("file_id", F.when(k == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), F.format_string("%03d", k))).alias("stem"))


def report_score(path: Column) -> Column:
    """How much a path looks like a case's report."""
    low, name = F.lower(path), F.lower(F.regexp_replace(path, r"^.*/", ""))
    score = F.when(name.rlike(r"cases?[_\s-]*overview"), 100).otherwise(0)
    for words, n in REPORT_WEIGHTS:
        hit = name.contains(words[0])
        for w in words[1:]:
            hit = hit | name.contains(w)
        score = score + F.when(hit, n).otherwise(0)
    depth = F.size(F.split(path, "/"))
    for word, n in (("evidence", 8), ("structured", 10), ("unstructured", 3)):
        score = score - F.when(low.contains(word), n).otherwise(0)
    return score - 3 * F.greatest(F.lit(0), depth - 1) + F.when(name.endswith(".pdf"), 5).otherwise(0)


def best_report(files: DataFrame) -> DataFrame:
    """The file of each case that looks most like its report: ``case_id``, ``rel_path``, ``score``."""
    scored = files.filter("rel_path is not null and case_id is not null").select("case_id", "rel_path", report_score(F.col("rel_path")).alias("score"))
    return scored.groupBy("case_id").agg(F.max(F.struct("score", (-F.size(F.split("rel_path", "/"))).alias("d"), "rel_path")).alias("b")).select("case_id", "b.rel_path", "b.score")


def rows_without_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose ``source_image`` is no path of the inventory; rows without an image are left out."""
    return rows.filter("source_image is not null").join(files.select(F.col("rel_path").alias("source_image")), "source_image", "left_anti")
