"""Mixing sources to target weights: capped water-filling, seeded whole and fractional repetitions.

DataFrame functions only.  The fill level is found on one row per source, by
running totals over the sources in order of the level at which each reaches its
cap.  Documents are taken in a seeded order that is cut into hash ranges, so a
source with a third of all rows is summed by many tasks and only the range in
which the target is reached is ranked row by row.

Defined cases: null text has size 0 and is never taken; null source is a source
of its own, last in order; repeated rows are separate documents, and rows alike
in id and size are interchangeable; a source of size 0 has target 0; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import TOKEN, land, table
from emberline.llm.registry import query
from emberline.operators.ordered import running_total

#: Weights of the sources in order, repeating; share of all words; most repetitions of a source; seed.
WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2.0, "mix"
#: Hex digits of the seeded key that name a range of the order (16 ** 3 ranges in a source).
RANGE_DIGITS = 3


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(TOKEN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Per source of (_s, size): source_size and target = min(epochs * source_size, level * weight).

    The level makes the targets sum to ``share`` of all sizes, or to all caps if
    that is less.  A source is clamped if the level, with all sources clamped that
    fill up before it, is still above its own fill point.
    """
    totals = sizes.groupBy("_s").agg(F.sum("size").alias("source_size"), F.lit(1).alias("_one"))
    repeat = F.array(*[F.lit(float(w)) for w in weights])
    totals = land(running_total(totals, ["_s"], "_one", "_rank").select(
        "_s", "source_size", F.element_at(repeat, ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).alias("_w"))
        .withColumn("_cap", epochs * F.col("source_size")).withColumn("_full_at", F.col("_cap") / F.col("_w")), "mix-sources")
    size, weight = totals.agg(F.sum("source_size"), F.sum("_w")).first()
    want, weight = share * (size or 0), weight or 0.0
    order = ["_full_at", "_s"]
    steps = running_total(running_total(totals, order, "_cap", "_caps"), order, "_w", "_ws")
    clamped = F.lit(want) - (F.col("_caps") - F.col("_cap")) > F.col("_full_at") * (F.lit(weight) - (F.col("_ws") - F.col("_w")))
    caps, used = steps.filter(clamped).agg(F.max("_caps"), F.max("_ws")).first()      # two numbers
    left = weight - (used or 0.0)
    level = F.lit((want - (caps or 0.0)) / left if left else float("inf"))
    return totals.select("_s", "source_size", F.least("_cap", level * F.col("_w")).alias("target"))


def mix(docs: DataFrame, size: str = "size", source: str = "source", id_col: str = "doc_id", weights=WEIGHTS,
        share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, sizes: DataFrame | None = None) -> DataFrame:
    """Add source_size, target and taken (how much of the row's size the mix takes, repeats counted).

    Every row is taken floor(target / source_size) times; the rest of the target
    is met in seeded order, by whole rows and then by a part of one.  ``docs`` is
    read several times: pass a stored table, and if its rows are wide, ``sizes`` as
    well, a stored table of their id, source and size.  What a row needs to know is
    one line per source (its last range in the order), so wide rows aren't moved but
    for the few of that range.
    """

    def ranged(df: DataFrame) -> DataFrame:
        key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("-"))).cast("binary"))
        return (df.withColumn("_s", F.coalesce(F.concat(F.lit("."), F.col(source)), F.lit("/")))
                .withColumn("_key", key).withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)))

    narrow = ranged(docs if sizes is None else sizes).select("_s", "_range", F.col(size).alias("size"))
    targets = (source_targets(narrow, weights, share, epochs)
               .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
               .withColumn("_rest", F.floor(F.col("target") - F.col("_whole") * F.col("source_size")))
               .withColumnRenamed("_s", "_t"))
    before = Window.partitionBy("_s").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (narrow.groupBy("_s", "_range").agg(F.sum("size").alias("_sum"))
              .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))))
    # Sums only grow along the order: the ranges that begin below the rest are its first ones, and only the last of them may be cut.
    last = (ranges.join(targets.select("_t", "_rest"), F.col("_s") == F.col("_t")).filter(F.col("_before") < F.col("_rest"))
            .withColumn("_cut", F.col("_before") + F.col("_sum") > F.col("_rest"))
            .groupBy("_s").agg(F.max(F.struct("_range", "_before", "_cut")).alias("_last")))
    lines = land(targets.join(last, F.col("_s") == F.col("_t"), "left").select(
        "_t", "source_size", "target", "_whole", "_rest", F.col("_last._range").alias("_to"), F.col("_last._before").alias("_before"),
        F.coalesce("_last._cut", F.lit(False)).alias("_cut")), "mix-ranges")
    placed = ranged(docs).join(lines, F.col("_s") == F.col("_t"))
    base, edge = F.col("_whole") * F.col(size), F.col("_cut") & (F.col("_range") == F.col("_to"))
    plain = placed.filter(~edge | F.col("_to").isNull()).withColumn(
        "taken", base + F.when(F.col("_range") <= F.col("_to"), F.col(size)).otherwise(0))
    within = Window.partitionBy("_s", "_range").orderBy("_key", size).rowsBetween(Window.unboundedPreceding, -1)
    partly = placed.filter(edge).withColumn("_earlier", F.col("_before") + F.coalesce(F.sum(size).over(within), F.lit(0)))
    partly = partly.withColumn("taken", base + F.greatest(F.lit(0), F.least(F.col(size), F.col("_rest") - F.col("_earlier"))))
    columns = [*[F.col(f"`{c}`") for c in docs.columns], "source_size", "target", F.col("taken").cast("long").alias("taken")]
    return plain.select(*columns).unionByName(partly.select(*columns))


def repeat_rows(docs: DataFrame, text: str = "text", stored: bool = False, **params) -> DataFrame:
    """The mix itself: each row as often as it is taken; a part of at least half a row counts as the row.

    A frame that is read from files as it stands (``stored``) isn't written again; its sizes are.
    """
    names = docs.columns
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id"), F.col("source"),
                        words_in(text).alias("size"))
    if stored:
        params["sizes"] = land(plain.drop("_row"), "mix-sizes")
    else:
        plain = land(plain, "mix-docs")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return (mix(plain, **params).withColumn("_n", F.explode(F.sequence(F.lit(0), times))).filter("_n > 0")
            .select(*[F.col(f"_row.`{c}`").alias(c) for c in names]))


SQL = f"""
with d as (select doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size, coalesce('.' || source, '/') as s,
    md5('{SEED}:' || coalesce(cast(doc_id as varchar), '-')) as k from documents),
t as (select s, cast(sum(size) as bigint) as source_size, case (row_number() over (order by s) - 1) % 3 when 0 then 3e0 when 1 then 1e0 else 2e0 end as w
  from d group by s),
f as (select *, {EPOCHS}e0 * source_size as cap, {EPOCHS}e0 * source_size / w as full_at from t),
g as (select *, sum(cap) over o as caps, sum(w) over o as ws, {SHARE}e0 * sum(source_size) over () as want, sum(w) over () as weight from f
  window o as (order by full_at, s rows unbounded preceding)),
l as (select max(want) as want, max(weight) as weight, coalesce(max(caps) filter (want - (caps - cap) > full_at * (weight - (ws - w))), 0e0) as caps,
  coalesce(max(ws) filter (want - (caps - cap) > full_at * (weight - (ws - w))), 0e0) as ws from g),
x as (select s, source_size, case when weight = ws then cap else least(cap, (l.want - l.caps) / (l.weight - l.ws) * w) end as target from f, l),
y as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from x),
z as (select d.doc_id, d.size, y.source_size, y.target, y.whole, floor(y.target - y.whole * y.source_size) as rest,
  coalesce(sum(d.size) over (partition by d.s order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) as earlier from d join y using (s))
select doc_id, cast(size as bigint) as size, source_size, target,
  cast(whole * size + greatest(0, least(size, rest - earlier)) as bigint) as taken from z"""


@query("op8_mixture", SQL)
def op8_mixture(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = land(docs.select("doc_id", "source", words_in("text").alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")
