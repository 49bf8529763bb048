"""Session helpers: reading tables, the shared checkpoint folder, size-checked broadcasts and skew-proof joins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if the optimizer's estimate of its size is at most this.
BROADCAST_LIMIT = 32 * 1024 * 1024
#: Pieces into which a key of the large side is split when the small side must be shuffled.
SALTS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is named, a folder of this machine, but only if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    where = named or os.path.join(tempfile.gettempdir(), "deponent-checkpoints")
    spark.sparkContext.setCheckpointDir(where)
    return where


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, with its lineage cut."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of ``df``; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(facts: DataFrame, dim: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Join of ``facts`` with a dimension that has unique keys, safe against a key that holds most of the facts.

    The dimension is broadcast if its estimated size is at most ``limit``. Otherwise both sides are shuffled on the key
    and a salt: the facts get one of SALTS values, the dimension is repeated once for each. Null keys match nothing.
    """
    if estimated_bytes(dim) <= limit:
        return facts.join(F.broadcast(dim), key, how)
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*facts.columns[:4]), F.lit(SALTS)).cast("int"))
    spread = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, [key, "_salt"], how).drop("_salt")


def bounded_sample(df: DataFrame, column: str, limit: int) -> DataFrame:
    """At most ``limit`` rows with a ``column``, evenly by a hash of it, the same on every run; all rows if there are no more.

    Only as many rows as the share of the hash range lets through are read on, so no task gets more than a few thousand.
    """
    rows = df.filter(F.col(column).isNotNull())
    share = 1.2 * limit / max(1, df.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64(column), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    return rows.limit(limit)
