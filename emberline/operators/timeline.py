"""Counting over time without sliding frames.

A sliding RANGE frame re-reads its whole frame for every row, which is
quadratic for one hot key.  Here a window count is the difference of two
cumulative counts, and the cumulative count is a two-level prefix sum: inside a
time bucket (a bounded group) plus the total of the earlier buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
_FAR = 1 << 60


@dataclass(frozen=True)
class Span:
    """Half-open interval ``[at + low, at + high)`` in microseconds; ``None`` is unbounded."""

    name: str
    low: int | None
    high: int | None
    value: str = "n"


def past(name: str, days: float | None, value: str = "n") -> Span:
    """Strictly before the instant, at most ``days`` earlier (inclusive)."""
    return Span(name, None if days is None else -int(days * DAY_US), 0, value)


def around(name: str, days: float | None, value: str = "n") -> Span:
    """At most ``days`` away on either side (inclusive)."""
    if days is None:
        return Span(name, None, None, value)
    return Span(name, -int(days * DAY_US), int(days * DAY_US) + 1, value)


def totals_before(series: DataFrame, marks: DataFrame, keys: list[str], values: list[str],
                  bucket_us: int = DAY_US) -> DataFrame:
    """For every mark ``(keys, at)``: per value column, the sum over series rows with an earlier ``at``."""
    rows = (series.select(*keys, "at", *values, F.lit(False).alias("_mark"))
            .unionByName(marks.select(*keys, "at", *[F.lit(0).cast("long").alias(v) for v in values],
                                      F.lit(True).alias("_mark")))
            .withColumn("_bucket", F.floor(F.col("at") / F.lit(bucket_us)).cast("long")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (rows.groupBy(*keys, "_bucket").agg(*[F.sum(v).alias(v) for v in values])
               .select(*keys, "_bucket", *[F.sum(v).over(earlier).alias(f"_p_{v}") for v in values]))
    local = rows.select(*keys, "at", "_bucket", "_mark",
                        *[F.sum(v).over(inside).alias(f"_l_{v}") for v in values]).filter("_mark")
    zero = F.lit(0).cast("long")
    return (local.join(buckets, [*keys, "_bucket"])
            .select(*keys, "at",
                    *[(F.coalesce(f"_l_{v}", zero) + F.coalesce(f"_p_{v}", zero)).alias(v) for v in values]))


def span_counts(series: DataFrame, probes: DataFrame, keys: list[str], spans: list[Span],
                bucket_us: int = DAY_US) -> DataFrame:
    """Per distinct probe ``(keys, at)``: one sum per span over the series of the same keys."""
    ends = sorted({e for s in spans for e in ((s.low,) if s.low is not None else ()) +
                   ((s.high,) if s.high is not None else (_FAR,))})
    values = sorted({s.value for s in spans})
    offsets = F.array(*[F.lit(e).cast("long") for e in ends])
    # An absolute far mark stands for "no upper end".
    fan = probes.select(*keys, F.col("at").alias("_t")).withColumn("_off", F.explode(offsets))
    fan = fan.withColumn("at", F.when(F.col("_off") == _FAR, F.lit(_FAR)).otherwise(F.col("_t") + F.col("_off")))
    before = totals_before(series, fan.select(*keys, "at").distinct(), keys, values, bucket_us)
    joined = fan.join(before, [*keys, "at"])

    def at_end(end: int, value: str):
        return F.max(F.when(F.col("_off") == F.lit(end), F.col(value)))

    out = []
    for s in spans:
        high = at_end(_FAR if s.high is None else s.high, s.value)
        low = F.lit(0) if s.low is None else at_end(s.low, s.value)
        out.append((high - low).cast("long").alias(s.name))
    return joined.groupBy(*keys, F.col("_t").alias("at")).agg(*out)
