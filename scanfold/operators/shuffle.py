"""Join and ranking helpers for keys that may hold a large share of all rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scanfold.sources.workspace import ensure_checkpoint_dir

SALTS = 32


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list, spread_by: list,
                how: str = "left") -> DataFrame:
    """Join many rows per key with one row per key.

    The key side is repeated once per salt, so a key that holds a third of all rows is
    spread over ``SALTS`` tasks. Adaptive execution turns the join into a broadcast
    join when the key side proves small.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALTS)).cast("int"))
    repeated = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def rank_rows(rows: DataFrame, keys: list, order: list, name: str = "rank") -> DataFrame:
    """Exact row number per key without putting a key into one task.

    Rows are range-sorted by key and order, then numbered by position: the place within
    the sorted partition plus the rows of the same key in earlier partitions. The sorted
    rows are checkpointed first, so both uses see the same partitions even when an
    executor is lost.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = (rows.orderBy(*keys, *order)
              .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True))
    placed = placed.withColumn("_part", F.shiftright("_mid", 33))
    runs = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    earlier = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_part").rowsBetween(
        W.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = placed.join(runs, [*keys, "_part"])
    rank = F.col("_mid") - F.col("_first") + F.col("_before") + 1
    return joined.withColumn(name, rank).drop("_mid", "_part", "_first", "_before")


def latest(rows: DataFrame, keys: list, by: Column) -> DataFrame:
    """The row with the highest ``by`` per key, combined map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(
        *keys, "_r.*").select(*rows.columns)


def earliest(rows: DataFrame, keys: list, by: Column) -> DataFrame:
    """The row with the lowest ``by`` per key, combined map-side."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_r")).select(
        *keys, "_r.*").select(*rows.columns)


