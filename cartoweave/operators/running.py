"""Running sums and ranks over orders of any length, in many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.session import materialise

#: Bytes that Spark may estimate for a range before its rows are counted, rows of a range, and the most ranges (each leaves
#: one row per key for the sums of the ranges).
RANGE_BYTES, RANGE_ROWS, MOST_RANGES = 256 << 20, 2_000_000, 100_000


def in_ranges(df: DataFrame, *order: Column, parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned by an order, into ``parts`` ranges or as many as its size asks for.

    Up to the session's number of shuffle partitions the adaptive planner joins small ranges. Where Spark's estimate, which
    may be far too high, asks for more, the rows are computed and counted first.
    """
    if parts is None:
        usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > RANGE_BYTES * usual:
            df = materialise(df)
            needed = min(MOST_RANGES, df.count() // RANGE_ROWS)
            parts = needed if needed > usual else None
    return df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)


def running_sum(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows up to and with the own one, in ``order`` within ``keys``.

    The order should be total. Rows are range-partitioned by keys and order and summed within each range; the sums of the
    ranges (one row per range and key) are summed up and joined back. No key is collected into one task.
    """
    placed = materialise(in_ranges(df.withColumn("_v", value), *[F.col(k) for k in keys], *order, parts=parts).withColumn("_p", F.spark_partition_id()))
    upto = Window.partitionBy("_p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = placed.groupBy("_p", *keys).agg(F.sum("_v").alias("_s"))
    before = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s")).drop("_s")
    own = placed.withColumn("_w", F.sum("_v").over(upto))
    renamed = before.select(F.col("_p").alias("_bp"), *[F.col(k).alias(f"_b_{k}") for k in keys], "_before")
    match = own["_p"] == renamed["_bp"]
    for k in keys:
        match = match & own[k].eqNullSafe(renamed[f"_b_{k}"])
    return own.join(renamed, match).withColumn(name, F.col("_before") + F.col("_w")).select(*df.columns, name)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with its 0-based position in a total ``order``."""
    return running_sum(df, [], order, F.lit(1).cast("bigint"), name, parts).withColumn(name, F.col(name) - 1)
