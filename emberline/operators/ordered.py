"""Order-dependent aggregates without a single-partition window or an in-memory group.

Both helpers are two-level prefix sums: a window inside bounded ranges plus the
running total of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import cut


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Add the inclusive running total of ``value`` in the given total order.

    Rows are range-partitioned on the full order key, so ties on its first part
    spread too; the partition layout is checkpointed before it is read twice.
    """
    spread = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: the only un-partitioned window, bounded by the shuffle width.
    offsets = (spread.groupBy("_part").agg(F.sum(value).alias("_sum"))
               .select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before")))
    return (spread.withColumn("_local", F.sum(value).over(inside)).join(offsets, "_part")
            .select(*df.columns, (F.col("_local") + F.col("_before")).alias(name)))


def _bucket(value: Column) -> Column:
    """A monotone, heavy-tail-friendly range key: about 0.1 % of the magnitude per bucket."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) * 1000.0) * 1024).cast("long")


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], by: list[str] = ()) -> DataFrame:
    """Exact quantiles (linear interpolation) in long form: by..., metric, prob, value.

    Values are first reduced to (value, multiplicity), then ranked by a
    two-level prefix sum, so memory never follows the group size.
    """
    by = list(by)
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_r"))
    long = long.select(*by, "_r.metric", "_r.value").filter("value is not null")
    keys = [*by, "metric"]
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("k")).withColumn("_b", _bucket(F.col("value")))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    buckets = (counts.groupBy(*keys, "_b").agg(F.sum("k").alias("_k"))
               .select(*keys, "_b", F.coalesce(F.sum("_k").over(earlier), F.lit(0)).alias("_before"),
                       F.sum("_k").over(whole).alias("_n")))
    inside = Window.partitionBy(*keys, "_b").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counts.withColumn("_upto", F.sum("k").over(inside)).join(buckets, [*keys, "_b"])
              .withColumn("_last", F.col("_upto") + F.col("_before") - 1)        # 0-based ranks of this value
              .withColumn("_first", F.col("_last") - F.col("k") + 1))
    wanted = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    spot = F.col("prob") * (F.col("_n") - 1)
    wanted = wanted.withColumn("_lo", F.floor(spot)).withColumn("_hi", F.ceil(spot)).withColumn("_w", spot - F.floor(spot))
    wanted = wanted.filter("(_first <= _lo and _lo <= _last) or (_first <= _hi and _hi <= _last)")

    def pick(rank: str) -> Column:
        return F.max(F.when((F.col("_first") <= F.col(rank)) & (F.col(rank) <= F.col("_last")), F.col("value")))

    return wanted.groupBy(*keys, "prob").agg((pick("_lo") + (pick("_hi") - pick("_lo")) * F.max("_w")).alias("value"))
