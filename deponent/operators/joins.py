"""Joins of texts by what they share, blocked on rare words or on runs of words instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deponent.functions import text as T
from deponent.session import checkpointed, lookup_join

#: The length in words from which one text inside another is evidence.
DONOR_WORDS = 20


def _runs(df: DataFrame, key: str, within: str, text: str, n: int) -> DataFrame:
    w = df.select(key, within, T.words(F.col(text)).alias("w")).filter(F.size("w") >= n)
    return w.select(key, within, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(n)), " "))))).alias("s"))


def _bags(df: DataFrame, key: str, within: str, text: str) -> DataFrame:
    """Distinct bags of words of each group: ``w`` (each word with how often it came before) and the smallest ``key``."""
    w = F.array_sort(T.words(F.col(text)))
    numbered = F.transform("w", lambda x, i: F.concat(x, F.lit(" "), (i + 1 - F.array_position("w", x)).cast("string")))
    bags = df.select(F.col(key).alias("k"), within, w.alias("w")).filter(F.col(within).isNotNull() & (F.size("w") > 0))
    return bags.groupBy(within, "w").agg(F.min("k").alias("k")).select("k", within, numbered.alias("w"))


def sharing_pairs(a: DataFrame, b: DataFrame, within: str, least: float) -> DataFrame:
    """Pairs ``x``, ``y`` of keys ``k`` of the same group that may share ``least`` of the shorter set of words ``w``; none that does is missed."""
    hashed = F.explode(F.transform("w", lambda x: F.xxhash64(x))).alias("t")  # equal hashes of two words only add candidates
    seen = a.select(hashed).unionByName(b.select(hashed)).groupBy("t").agg(F.count("*").alias("n"))
    need = F.greatest(F.lit(1), F.ceil(F.size("w") * F.lit(least) - 1e-9)).cast("int")

    def placed(bags: DataFrame) -> DataFrame:
        """Each word of a bag by its place from the rarest on."""
        words = lookup_join(bags.select("k", within, hashed), seen, "t")
        ranked = words.groupBy("k", within).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("w"))
        return ranked.select("k", within, F.size("w").alias("size"), need.alias("need"), F.posexplode("w.t").alias("i", "t"))

    def candidates(short: DataFrame, long: DataFrame, names: tuple[str, str], fits: str) -> DataFrame:
        s = short.filter("i <= size - need").select(within, "t", F.col("k").alias(names[0]), F.col("size").alias("s"), "need")
        o = long.select(within, "t", F.col("k").alias(names[1]), F.col("size").alias("o"), "i")
        return s.join(o, [within, "t"]).filter(fits).filter("o - i >= need").select("x", "y")

    pa, pb = checkpointed(placed(a)), checkpointed(placed(b))
    return candidates(pa, pb, ("x", "y"), "s <= o").unionByName(candidates(pb, pa, ("y", "x"), "s < o")).distinct()


def best_overlap(left: DataFrame, left_key: str, right: DataFrame, right_key: str, within: str, text: str, least: float) -> DataFrame:
    """For each left text the right one of the same group that shares most of the shorter one's words, from ``least`` on.

    Exact by prefixes: of the shorter text's n words at least n * ``least`` must be shared, so one of its rarest
    n - n * ``least`` + 1 words is, whatever the order. Equal bags of words are compared once. Ties go to the smaller right
    key. Columns: both keys and ``ratio``. Texts without words match nothing.
    """
    a, b = checkpointed(_bags(left, left_key, within, text)), checkpointed(_bags(right, right_key, within, text))
    pairs = sharing_pairs(a, b, within, least - 0.00005)  # ``least`` holds for the ratio rounded to four places
    full = pairs.join(a.select(F.col("k").alias("x"), F.col("w").alias("wx")), "x").join(b.select(F.col("k").alias("y"), F.col("w").alias("wy")), "y")
    ratio = F.round(F.size(F.array_intersect("wx", "wy")) / F.least(F.size("wx"), F.size("wy")), 4)
    best = full.select("x", "y", ratio.alias("ratio")).filter(F.col("ratio") >= least).groupBy("x").agg(F.max_by(F.struct("y", "ratio"), F.struct(F.col("ratio"), -F.col("y"))).alias("b"))
    sorted_words = F.array_sort(T.words(F.col(text)))
    texts = left.select(left_key, within, sorted_words.alias("w")).filter(F.col(within).isNotNull() & (F.size("w") > 0))
    same = texts.groupBy(within, "w").agg(F.min(left_key).alias("x"), F.collect_set(left_key).alias("all"))
    every = same.join(best, "x").select(F.explode("all").alias(left_key), "b")
    return every.groupBy(left_key).agg(F.max_by("b", F.struct(F.col("b.ratio"), -F.col("b.y"))).alias("b")).select(left_key, F.col("b.y").alias(right_key), "b.ratio")


def filled_from_donors(rows: DataFrame) -> DataFrame:
    """Unknown senders and receivers filled from the single row of another file whose long text contains theirs or lies in it.

    Gives ``row_id``, ``sender``, ``receiver``, ``donor_row``. A donor is fully known and contradicts no known field; two
    matching donors fill nothing. Texts of fewer than DONOR_WORDS words are no evidence.
    """
    r = rows.select("row_id", "case_id", "source_csv", "sender", "receiver", T.spoken_key(F.col("message")).alias("n")).filter(F.size(F.split("n", " ")) >= DONOR_WORDS)
    known = ~T.is_unresolved(F.col("sender")) & ~T.is_unresolved(F.col("receiver"))
    need, donors = r.filter(~known), r.filter(known)
    pairs = _runs(need, "row_id", "case_id", "n", DONOR_WORDS).join(_runs(donors.withColumnRenamed("row_id", "donor_row"), "donor_row", "case_id", "n", DONOR_WORDS), ["case_id", "s"]).select("row_id", "donor_row").distinct()
    d = donors.select(F.col("row_id").alias("donor_row"), F.col("sender").alias("ds"), F.col("receiver").alias("dr"), F.col("n").alias("dn"), F.col("source_csv").alias("dcsv"))
    j = pairs.join(need, "row_id").join(d, "donor_row").filter("source_csv <> dcsv and (contains(n, dn) or contains(dn, n)) and lower(ds) <> lower(dr)")
    fits = (T.is_unresolved(F.col("sender")) | (F.lower(F.trim("sender")) == F.lower(F.trim("ds")))) & (T.is_unresolved(F.col("receiver")) | (F.lower(F.trim("receiver")) == F.lower(F.trim("dr"))))
    one = j.filter(fits).groupBy("row_id").agg(F.count("*").alias("k"), F.first(F.struct("ds", "dr", "donor_row")).alias("d")).filter("k = 1")
    return one.select("row_id", F.col("d.ds").alias("sender"), F.col("d.dr").alias("receiver"), F.col("d.donor_row").alias("donor_row"))
