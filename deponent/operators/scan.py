"""Running values along an order without putting a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, key: list[str], block: str, order: list[str], values: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """Adds each of ``values`` as the last non-null value at or before the row (before it, unless ``inclusive``).

    ``block`` is a column that never falls along ``order`` within ``key``; it cuts a long key into pieces. Values run inside
    each piece, and from piece to piece over one summary row each, so the largest window holds a piece or the list of
    pieces, never all rows of a key. Keys and blocks must not be null.
    """
    parts = [*key, block]
    upto = 0 if inclusive else -1
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    tagged = df.withColumns({f"_v_{name}": F.struct(value.alias("x")) for name, value in values.items()})
    known = {name: F.when(F.col(f"_v_{name}")["x"].isNotNull(), F.col(f"_v_{name}")["x"]) for name in values}
    summary = tagged.groupBy(*parts).agg(*[F.max_by(F.col(f"_v_{n}")["x"], F.when(F.col(f"_v_{n}")["x"].isNotNull(), F.struct(*order))).alias(f"_s_{n}") for n in values])
    summary = summary.select(*parts, *[F.last(f"_s_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in values])
    run = tagged.withColumns({f"_i_{n}": F.last(known[n], ignorenulls=True).over(inside) for n in values})
    joined = run.join(summary, parts, "left")
    return joined.select(*df.columns, *[F.coalesce(f"_i_{n}", f"_b_{n}").alias(n) for n in values])


def lagged(df: DataFrame, key: list[str], block: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds columns, by the name to be given, with the values of the row just before; null where there is none before.

    A null value of the row before is null too, so callers who need to tell the two cases apart take along a column that is never null.
    """
    packed = carry_forward(df, key, block, order, {"_row_before": F.struct(*[F.col(v).alias(n) for n, v in values.items()])}, inclusive=False)
    return packed.select(*df.columns, *[F.col(f"_row_before.{n}").alias(n) for n in values])


def running_max(df: DataFrame, key: list[str], block: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the greatest ``value`` at or before the row, over blocks as in carry_forward."""
    parts = [*key, block]
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    summary = df.groupBy(*parts).agg(F.max(value).alias("_m")).select(*parts, F.max("_m").over(before).alias("_b"))
    return df.withColumn("_i", F.max(value).over(inside)).join(summary, parts, "left").select(*df.columns, F.greatest("_i", "_b").alias(name))
