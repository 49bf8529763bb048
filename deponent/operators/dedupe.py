"""Exact and near duplicates among transcript rows and recordings."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deponent.functions import text as T
from deponent.operators.joins import sharing_pairs
from deponent.operators.scan import carry_forward, lagged
from deponent.session import checkpointed

#: Two adjacent messages are the same from this ratio on, or if one of at least so many words is part of the other.
NEAR_RATIO, NEAR_WORDS, NEAR_MINUTES = 0.88, 4, 2
#: A row of a recording is covered by another's from these values on; across different dates from the second ones.
ROW_RATIO, ROW_SHARE, ROW_TOKENS = 0.88, 0.85, 8
CROSS_RATIO, CROSS_SHARE = 0.96, 0.95


def keep_first(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row by ``order`` of each group with equal keys; null equals null. Equal rows are added up before the shuffle."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    row = F.struct(*df.columns)
    return df.groupBy(*named).agg(F.min_by(row, F.struct(*order)).alias("_r")).select("_r.*")


def transcript_unique(rows: DataFrame, message: str = "message") -> DataFrame:
    """Rows without repeats: chat and email by time, people and message, audio by file and place, as repeated speech may be evidence."""
    audio = F.col("source_kind") == "audio"
    keys = [
        F.when(audio, "audio").otherwise("chat"),
        F.col("case_id"),
        F.when(audio, F.col("source_csv")).otherwise(F.col("msg_timestamp")),
        F.when(audio, F.col("source_row").cast("string")).otherwise(F.col("sender")),
        F.when(~audio, F.col("receiver")),
        F.when(~audio, T.dedupe_key(F.col(message))),
    ]
    return keep_first(rows, keys, ["row_id"])


def near_same(a: str, b: str) -> bool:
    """Whether two messages, in comparison form, differ by no more than recognition may cause."""
    if not a or not b:
        return False
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    if len(short.split()) >= NEAR_WORDS and short in long:
        return True
    m = SequenceMatcher(None, a, b)
    return m.real_quick_ratio() >= NEAR_RATIO and m.quick_ratio() >= NEAR_RATIO and m.ratio() >= NEAR_RATIO


def quality(c: Column) -> Column:
    """How full and clean a text is, for choosing among near copies: words, length, and whether it ends as a sentence less odd signs."""
    odd = F.length(F.regexp_replace(c, r"(?U)[\w\s,.;:!?€£$+@%/'\"()-]", ""))
    return F.struct(F.size(F.filter(F.split(T.spoken_key(c), " "), lambda x: x != "")).alias("words"), F.length(c).alias("length"), (F.when(c.rlike(r"[.!?…]$"), 1).otherwise(0) - odd).alias("tidy"))


def _folded(runs: pd.Series) -> pd.Series:
    """For each run of rows, in order: the row that each one repeats (itself if none), by comparison with the last row kept."""
    out = []
    for run in runs:
        last, kept = None, []
        for r in run:
            close = last is not None and (r["minutes"] is None or last["minutes"] is None or abs(r["minutes"] - last["minutes"]) <= NEAR_MINUTES)
            if not (close and near_same(last["norm"] or "", r["norm"] or "")):
                last = r
            kept.append(last["id"])
        out.append(kept)
    return pd.Series(out)


def adjacent_near_duplicates(rows: DataFrame, key: list[str], block: str, order: list[str], side: str, message: str, time: str, row: str = "row_id") -> DataFrame:
    """Rows that the row kept before them, of the same side and day and at most NEAR_MINUTES off, already says: ``row``, ``first_row``, ``best_row``.

    ``first_row`` keeps its time; ``best_row`` is the one of its near copies with the best text, the first of equal ones. A row
    that repeats nothing is its own first row. Only rows of one run, neighbours of one side without a known pause or change of
    day between them, can repeat each other; runs are found over blocks of a key, so neither a conversation nor its undated
    rows are ever one group. A run is the talk of one side without a pause.
    """
    timed = rows.select(*key, block, *order, F.col(row).alias("_row"), F.coalesce(F.col(side), F.lit("")).alias("_side"), F.col(message).alias("_text"), F.col(time).alias("_time"))
    near = lagged(timed, key, block, order, {"_before": "_side", "_then": "_time"})
    pause = (F.to_date("_time") != F.to_date("_then")) | (F.abs(F.unix_timestamp("_time") - F.unix_timestamp("_then")) > 60 * NEAR_MINUTES)
    start = F.when(F.col("_before").isNull() | (F.col("_before") != F.col("_side")) | F.coalesce(pause, F.lit(False)), F.struct(*order))
    runs = carry_forward(near.withColumn("_start", start), key, block, order, {"_run": F.col("_start")})
    item = F.struct(*order, F.col("_row").alias("id"), T.spoken_key(F.col("_text")).alias("norm"), (F.unix_timestamp("_time") / 60.0).alias("minutes"), quality(F.coalesce("_text", F.lit(""))).alias("q"))
    grouped = runs.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(item)).alias("run"))
    alone = grouped.filter("size(run) = 1").select(F.col("run")[0]["id"].alias("id"), F.col("run")[0]["id"].alias("first_row"), F.col("run")[0]["q"].alias("q"))
    several = grouped.filter("size(run) > 1").withColumn("first", F.pandas_udf(_folded, "array<bigint>")(F.transform("run", lambda x: F.struct(x["id"].alias("id"), x["norm"].alias("norm"), x["minutes"].alias("minutes")))))
    folded = several.select(F.explode(F.arrays_zip("run", "first")).alias("x")).select("x.run.id", F.col("x.first").alias("first_row"), "x.run.q")
    every = alone.unionByName(folded)
    best = folded.groupBy("first_row").agg(F.max_by("id", F.struct("q.words", "q.length", "q.tidy", -F.col("id"))).alias("best_row"))
    return every.join(best, "first_row", "left").select(F.col("id").alias(row), "first_row", F.coalesce("best_row", "id").alias("best_row"))


def _matched(rows: pd.Series, pairs: pd.Series) -> pd.Series:
    """Whether each of so many rows, in order, finds its best partner among those not taken; ``pairs`` holds (x, ratio, share, y)."""
    out = []
    for n, found in zip(rows, pairs):
        taken: set = set()
        of: dict = {}
        for p in found:
            of.setdefault(p["x"], []).append((-p["ratio"], -p["share"], p["y"]))
        for x in sorted(of):
            best = min((p for p in of[x] if p[2] not in taken), default=None)
            if best is None:
                break
            taken.add(best[2])
        out.append(len(taken) == n)
    return pd.Series(out, dtype="bool")


def covered_recordings(segments: DataFrame) -> DataFrame:
    """Pairs of recordings of which the first one's rows are all said by the second: ``recording_id``, ``covered_by``, ``rows``.

    All rows with a message count, and each needs a row of its own in the other recording, taken in order, best first. A row
    of fewer than ROW_TOKENS distinct words has no match, so its recording is not covered. Where ``recorded_at`` (if there is
    such a column) has the same day, ROW_RATIO and ROW_SHARE hold, else the stricter values. Of mutual covers the later
    recording is the covered one. Candidates are all rows that share enough words, by prefixes.
    """
    when = F.col("recorded_at") if "recorded_at" in segments.columns else F.lit(None).cast("timestamp")
    said = segments.filter("recording_id is not null and trim(message) <> ''").select("recording_id", "case_id", "segment_id", when.alias("at"), T.spoken_key(F.col("message")).alias("norm"))
    said = checkpointed(said.withColumn("w", F.array_distinct(F.filter(F.split("norm", " "), lambda x: x != ""))))
    total = said.groupBy("recording_id").agg(F.count("*").alias("rows"), F.min(F.size("w")).alias("least"), F.min("at").alias("at"))
    rows = said.filter(F.col("case_id").isNotNull() & (F.size("w") >= ROW_TOKENS))
    whole = rows.join(total.filter(F.col("least") >= ROW_TOKENS).select("recording_id"), "recording_id", "left_semi")
    bags = lambda df: df.select(F.col("segment_id").alias("k"), "case_id", "w")
    side = lambda df, c: df.select(F.col("segment_id").alias(c), F.col("recording_id").alias(f"r{c}"), F.to_date("at").alias(f"d{c}"), F.col("norm").alias(f"n{c}"), F.col("w").alias(f"w{c}"))
    full = sharing_pairs(bags(whole), bags(rows), "case_id", ROW_SHARE).join(side(whole, "x"), "x").join(side(rows, "y"), "y").filter("rx <> ry")
    same = F.coalesce(F.col("dx") == F.col("dy"), F.lit(False))
    share = F.size(F.array_intersect("wx", "wy")) / F.least(F.size("wx"), F.size("wy"))
    least = F.when(same, ROW_RATIO).otherwise(CROSS_RATIO)
    near = full.withColumn("share", share).filter(F.col("share") >= F.when(same, ROW_SHARE).otherwise(CROSS_SHARE))
    near = near.filter(2 * F.least(F.length("nx"), F.length("ny")) >= (F.length("nx") + F.length("ny")) * least - 1e-9)  # the ratio is at most this
    near = near.withColumn("ratio", T.sequence_ratio(F.col("nx"), F.col("ny"))).filter(F.col("ratio") >= least)
    hit = near.groupBy("rx", "ry").agg(F.countDistinct("x").alias("covered"), F.collect_set(F.struct("x", "ratio", "share", "y")).alias("pairs"))
    every = hit.join(total.select(F.col("recording_id").alias("rx"), "rows", F.col("at").alias("ax")), "rx").filter("covered = rows")
    covers = every.filter(F.pandas_udf(_matched, "boolean")("rows", "pairs")).join(total.select(F.col("recording_id").alias("ry"), F.col("at").alias("ay")), "ry").select("rx", "ry", "rows", "ax", "ay")
    covers = checkpointed(covers)
    turned = covers.select(F.col("ry").alias("rx"), F.col("rx").alias("ry"), F.lit(True).alias("mutual"))
    far = F.lit("9999-12-31").cast("timestamp")
    earlier = F.struct(F.coalesce("ax", far), F.col("rx")) < F.struct(F.coalesce("ay", far), F.col("ry"))
    return covers.join(turned, ["rx", "ry"], "left").filter(F.col("mutual").isNull() | ~earlier).select(F.col("rx").alias("recording_id"), F.col("ry").alias("covered_by"), "rows")


def contained_neighbours(rows: DataFrame, key: list[str], block: str, order: list[str], side: str, message: str, most: int = 40) -> DataFrame:
    """Rows with a short message that the same side's message just before or after contains, case and spacing aside. All columns of ``rows``.

    ``block`` and ``order`` must be numbers, as rows are also read backwards. Null and empty messages contain and are contained in nothing.
    """
    m = rows.withColumn("_k", T.dedupe_key(F.col(message)))
    ahead = lagged(m, key, block, order, {"_before": "_k", "_who": side})
    turned = ahead.withColumns({"_block": -F.col(block), **{f"_o{i}": -F.col(c) for i, c in enumerate(order)}})
    both = lagged(turned, key, "_block", [f"_o{i}" for i in range(len(order))], {"_after": "_k", "_next": side})
    inside = lambda other, who: F.coalesce((F.col(who) == F.col(side)) & (F.length(other) > F.length("_k")) & F.contains(F.col(other), F.col("_k")), F.lit(False))
    return both.filter((F.col("_k") != "") & (F.length("_k") < most) & (inside("_before", "_who") | inside("_after", "_next"))).select(*rows.columns)


def ordered_union(parts: DataFrame, part: str, place: str, keys: list[str]) -> DataFrame:
    """Rows of several parts in their order without those that an earlier one gives; null keys are equal to each other."""
    return keep_first(parts, [F.col(k) for k in keys], [part, place])


def best_recordings(rows: DataFrame, group: list[str], recording: str, offset: str | None = None) -> DataFrame:
    """The recording of each group with the best evidence: ``group``, ``recording``, ``resolved``, ``people``, ``rows``, ``words``.

    Recordings are compared by whether all participants are resolved, resolved fields, distinct people, rows, rows after the
    start (where there is an ``offset``), words of speech, and then by name, the first of equal ones.
    """
    known = lambda c: ~T.is_unresolved(F.col(c))
    name = lambda c: F.when(known(c), F.lower(F.trim(c)))
    late = F.count_if(F.col(offset) > 0) if offset else F.lit(0)
    people = F.size(F.array_union(F.collect_set(name("sender")), F.collect_set(name("receiver"))))
    words = F.sum(F.size(F.filter(F.split(F.coalesce(T.spoken_key(F.col("message")), F.lit("")), " "), lambda x: x != "")))
    each = rows.groupBy(*group, recording).agg((F.count_if(known("sender")) + F.count_if(known("receiver"))).alias("resolved"), people.alias("people"), F.count("*").alias("rows"), late.alias("late"), words.alias("words"))
    rank = F.struct((F.col("resolved") == 2 * F.col("rows")).alias("whole"), "resolved", "people", "rows", "late", "words")
    top = each.groupBy(*group).agg(F.max(rank).alias("top"))
    first = each.withColumn("_rank", rank).join(top, group).filter(F.col("_rank") == F.col("top")).groupBy(*group).agg(F.min(F.struct(recording, "resolved", "people", "rows", "words")).alias("b"))
    return first.select(*group, "b.*")
