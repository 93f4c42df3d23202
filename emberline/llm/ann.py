"""Nearest neighbours by cosine: a vantage-point tree per shard, searched in query blocks.

Rows are dealt to shards by a hash of their id; in each pair of shard and query
block a task builds the shard's tree over unit vectors (chord length is a metric)
and runs the block's queries down it together, the nearer side first.  A side is
skipped if the triangle inequality puts all its points beyond the query's k-th best,
with the bound multiplied by ``relax``: above one it prunes more and may miss some
neighbours, one is exact.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and null ids, take no part; only vectors of equal length are compared;
of a query id that repeats, the smallest vector is searched; rows with the query's
id are its own; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import table
from emberline.llm.registry import query

NEIGHBOURS, QUERY_STEP = 5, 50
#: Rows of a shard, queries of a block, points of a leaf; 1: exact search.
SHARD_ROWS, BLOCK_QUERIES, LEAF, RELAX = 8192, 4096, 128, 1.0
#: Room for rounding where chords are compared.
SLACK = 1e-6


class VantageTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, np.ascontiguousarray(vectors, np.float64)
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.units = self.vectors / self.norms[:, None]
        self.leaf = leaf
        self.root = self._build(np.argsort(ids, kind="stable"))

    def _build(self, rows: np.ndarray):
        """A leaf's rows, or (vantage, radius range inside, radius range outside, inside, outside)."""
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[len(rows) // 2]
        chord = np.sqrt(np.maximum(0.0, 2 - 2 * self.units[rows] @ self.units[vantage]))
        order = np.argsort(chord, kind="stable")
        half = len(rows) // 2
        near, far = order[:half], order[half:]
        return (vantage, (chord[near].min(), chord[near].max()), (chord[far].min(), chord[far].max()),
                self._build(rows[near]), self._build(rows[far]))

    def search(self, ids: np.ndarray, vectors: np.ndarray, k: int = NEIGHBOURS, relax: float = RELAX):
        """(scores, ids) of the k best of each query, best first; missing ones have score -inf."""
        q = np.ascontiguousarray(vectors, np.float64)
        norms = np.sqrt(np.einsum("ij,ij->i", q, q))
        units = q / norms[:, None]
        best = np.full((len(q), k), -np.inf)
        names = np.full((len(q), k), np.iinfo(np.int64).max)

        def visit(node, who: np.ndarray) -> None:
            if not len(who):
                return
            if not isinstance(node, tuple):
                # One pair's sum doesn't depend on its neighbours here, so equal vectors have equal scores.
                score = np.einsum("qd,nd->qn", q[who], self.vectors[node]) / (norms[who, None] * self.norms[node])
                score[ids[who, None] == self.ids[node]] = -np.inf
                use = score.max(1) >= best[who, -1]
                who, score = who[use], score[use]
                if len(who):
                    every = np.concatenate([best[who], score], 1)
                    name = np.concatenate([names[who], np.broadcast_to(self.ids[node], score.shape)], 1)
                    top = np.lexsort((name, -every), axis=-1)[:, :k]
                    best[who], names[who] = np.take_along_axis(every, top, 1), np.take_along_axis(name, top, 1)
                return
            vantage, inner, outer, inside, outside = node
            chord = np.sqrt(np.maximum(0.0, 2 - 2 * units[who] @ self.units[vantage]))

            def may(rng, sub, d) -> np.ndarray:
                bound = np.maximum(0.0, np.maximum(d - rng[1], rng[0] - d)) * relax
                kth = np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(best[sub, -1], -1.0)))
                return bound <= kth + SLACK

            closer = chord <= (inner[1] + outer[0]) / 2
            visit(inside, who[closer])
            visit(outside, who[~closer])
            a, b = who[closer], who[~closer]
            visit(outside, a[may(outer, a, chord[closer])])
            visit(inside, b[may(inner, b, chord[~closer])])

        visit(self.root, np.arange(len(q)))
        return best, names


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, relax: float = RELAX, shard_rows: int = SHARD_ROWS,
            block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` (vec_id, embedding) to each of ``queries``."""
    rows, asked = vectors.count(), queries.count()
    shards, blocks = max(1, math.ceil(rows / shard_rows)), max(1, math.ceil(asked / block_queries))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        """Each row once in its own shard or block, against every block or shard."""
        return (df.withColumn("dim", F.size("embedding")).withColumn(own, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))))

    index = dealt(vectors, "shard", shards, "block", blocks)
    ask = dealt(queries, "block", blocks, "shard", shards)

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return kind.empty_table()

        def matrix(t: pa.Table) -> np.ndarray:
            return t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

        asked_ids = right.column("vec_id").to_numpy()
        score, name = VantageTree(left.column("vec_id").to_numpy(), matrix(left)).search(asked_ids, matrix(right), k, relax)
        hit = np.isfinite(score)
        return pa.table([np.repeat(asked_ids, k).reshape(-1, k)[hit], name[hit], score[hit]], schema=kind)

    keys = ["dim", "shard", "block"]
    found = index.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(find, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")        # k rows of each shard
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(df: DataFrame) -> DataFrame:
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    return df.filter(F.col("vec_id").isNotNull() & F.coalesce(fits, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


SQL = f"""
with v as (select vec_id, cast(embedding as double[]) as e from embeddings where vec_id is not null and embedding is not null
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) as score
  from v q join v c on q.vec_id % {QUERY_STEP} = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= {NEIGHBOURS}"""


@query("op7_vantage", SQL)
def op7_vantage(spark, sf_dir):
    vectors = usable(table(spark, sf_dir, "embeddings"))
    queries = vectors.filter(F.col("vec_id") % QUERY_STEP == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return nearest(vectors, queries)
