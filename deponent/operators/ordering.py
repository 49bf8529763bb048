"""Places in an order, found without one task sorting a whole key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def number_in_order(df: DataFrame, key: list[str], block: str, order: list, name: str) -> DataFrame:
    """Adds ``name``: the row's place from 1 within ``key`` by ``order``.

    ``block`` never falls along the order within a key. Rows are numbered within their block, and blocks are offset by
    the rows before them, of which one count each is kept. Null blocks come last.
    """
    first = F.col(block).asc_nulls_last()
    counts = df.groupBy(*key, block).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(block).alias("_kb"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_at", F.row_number().over(Window.partitionBy(*key, block).orderBy(*order)))
    same = inside[block].eqNullSafe(F.col("_kb"))
    for i, k in enumerate(key):
        same = same & inside[k].eqNullSafe(F.col(f"_k{i}"))
    return inside.join(counts, same, "left").select(*df.columns, (F.col("_at") + F.col("_before")).cast("long").alias(name))
