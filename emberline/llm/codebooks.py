"""Vector codes by product quantisation, trained by member-resident Lloyd rounds.

Vectors become integer vectors and are cut into equal consecutive parts, each
part position with a codebook of its own.  The parts live in partitions that own
a (position, entry, salt): they are dealt out once, an owner sums its resident
members to update its entry, and in the next shuffle only the parts whose nearest
entry has changed move to their new owner; all others stay where they are.  Each
position has as many salts as it has partitions, and an entry's members are dealt
evenly over the salts, so an entry that holds most rows is spread over all
partitions of its position.  What meets on the driver is the codebooks and their
sums, ``positions x entries`` rows whatever the input.  Coding itself is a scan
with the finished codebooks: it moves nothing.

Members travel as blocks of arrays, not row by row.  The first layout and every
``CHECKPOINT_EVERY``-th one are written to the checkpoint folder, so a lost
executor costs a few rounds at most.

Defined cases: rows whose vector is null or holds null or non-finite components
are dropped; null ids come last in the order that seeds the codebooks, and repeated
ids take a place each, in order of their vectors; with fewer rows than entries
there are fewer entries; vectors of another length than the most frequent one
(ties: the shorter) are kept with null code and error and train nothing; a length
that the parts don't divide is filled up with zeros; components beyond 2^26 are
computed in unbounded integers, and an error beyond a long is the largest long.
Other columns are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import clean_name, land, schema_of, table
from emberline.llm.registry import query
from emberline.session import checkpoint_dir

POSITIONS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows that share a salt when they are dealt out, members of a block, layouts between two checkpoints.
DEALT_ROWS, BLOCK_ROWS, CHECKPOINT_EVERY = 1024, 8192, 3
#: Components below this are held as longs.
NARROW = 1 << 26
LONGEST = (1 << 63) - 1


def integers(vectors: pa.Array, scale: int = SCALE) -> np.ndarray:
    """Rows of ``floor(scale * x)`` of equally long vectors: long, or unbounded integers if one needs them."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(flat):
        return np.zeros((len(vectors), 0), np.int64)
    if np.abs(flat).max() * scale < NARROW:
        return np.floor(flat * scale).astype(np.int64).reshape(len(vectors), -1)
    exact = [math.floor(x * scale) if abs(x) < 2.0 ** 60 else int(x) * scale for x in flat.tolist()]
    return np.array(exact, object).reshape(len(vectors), -1)


def in_parts(rows: np.ndarray, positions: int) -> np.ndarray:
    """(rows, positions, width), filled up with zeros."""
    width = -(-rows.shape[1] // positions)
    if width * positions > rows.shape[1]:
        rows = np.concatenate([rows, np.zeros((len(rows), width * positions - rows.shape[1]), rows.dtype)], 1)
    return rows.reshape(len(rows), positions, width)


def nearest(members: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each member's nearest entry (ties: the first) and the squared distance, exact."""
    reach = max(int(np.abs(members).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2 * 4 * max(1, members.shape[1])
    if reach >= 1 << 62:
        apart = ((members.astype(object)[:, None, :] - entries.astype(object)[None]) ** 2).sum(-1) + np.zeros((1, 1), object)
        best = np.array([min(range(len(row)), key=row.__getitem__) for row in apart.tolist()], np.int64)
    elif reach < 1 << 53:               # every term is exact in doubles
        x, c = members.astype(np.float64), entries.astype(np.float64)
        apart = (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None]).astype(np.int64)
        best = apart.argmin(1)
    else:
        apart = ((members.astype(np.int64)[:, None, :] - entries.astype(np.int64)[None]) ** 2).sum(-1)
        best = apart.argmin(1)
    return best, apart[np.arange(len(best)), best]


class Owners:
    """Places (position, entry, salt) in partitions: each position has ``salts`` of them, each entry is spread over all of these."""

    def __init__(self, partitions: int, positions: int, entries: int):
        self.salts, self.positions, self.entries = max(1, partitions // positions), positions, entries

    @property
    def partitions(self) -> int:
        return self.salts * self.positions

    def __call__(self, key: tuple[int, int, int]) -> int:
        position, entry, salt = key
        return position * self.salts + (entry + salt) % self.salts


def deal(vectors: DataFrame, column: str, codebooks: list[np.ndarray], owners: Owners, scale: int) -> DataFrame:
    """(position, entry, salt, members): the parts in blocks, by their nearest entry; ``DEALT_ROWS`` rows share a salt."""
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 3 + [pa.binary()]
        salt = TaskContext.get().partitionId() * 7919            # tasks begin at different salts
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT_ROWS):
                parts = in_parts(integers(batch.slice(at, DEALT_ROWS).column(column), scale), len(codebooks))
                out = []
                for p, book in enumerate(codebooks):
                    entry = nearest(parts[:, p], book)[0]
                    out += [(p, int(e), salt % owners.salts, pickle.dumps(parts[entry == e, p])) for e in np.unique(entry)]
                salt += 1
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["position", "entry", "salt", "members"])

    return vectors.select(column).mapInArrow(cut_up, "position int, entry int, salt int, members binary")


def _merged(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """Join the blocks of an owner into few, up to ``BLOCK_ROWS`` members each."""
    held: dict[tuple, list] = {}
    for key, members in blocks:
        own = held.setdefault(key, [])
        own.append(members)
        if sum(map(len, own)) >= BLOCK_ROWS:
            yield key, np.concatenate(held.pop(key))
    for key, own in held.items():
        yield key, np.concatenate(own) if len(own) > 1 else own[0]


def _staying(codebooks: list[np.ndarray]):
    def keep(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for key, members in blocks:
            same = nearest(members, codebooks[key[0]])[0] == key[1]
            if same.any():
                yield key, members if same.all() else members[same]
    return keep


def _moving(codebooks: list[np.ndarray]):
    def leave(blocks: Iterator[tuple]) -> Iterator[tuple]:
        for (position, own, salt), members in blocks:
            entry = nearest(members, codebooks[position])[0]
            for e in np.unique(entry[entry != own]).tolist():
                yield (position, e, salt), members[entry == e]
    return leave


def _sums(blocks: Iterator[tuple]) -> Iterator[tuple]:
    """One (position, entry) -> (count, sums) for each entry of an owner's partition."""
    total: dict[tuple, tuple] = {}
    for (position, entry, _), members in blocks:
        n, before = total.get((position, entry), (0, 0))
        total[position, entry] = n + len(members), before + members.sum(0).astype(object)
    yield from total.items()


def update(state: RDD, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry's floored mean of its resident members; an entry without members stays."""
    found = dict(state.mapPartitions(_sums).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1])).collect())       # positions x entries rows
    out = []
    for p, book in enumerate(codebooks):
        rows = [[int(s) // found[p, e][0] for s in found[p, e][1]] if (p, e) in found else book[e].tolist() for e in range(len(book))]
        wide = any(abs(x) >= NARROW for row in rows for x in row)
        out.append(np.array(rows, object if wide else np.int64).reshape(book.shape))
    return out


def train(vectors: DataFrame, column: str, seeds: np.ndarray, rounds: int = ROUNDS, positions: int = POSITIONS,
          scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks of equally long ``vectors`` after ``rounds`` rounds, from integer ``seeds`` (entries, length)."""
    spark = vectors.sparkSession
    checkpoint_dir(spark)
    codebooks = list(in_parts(seeds, positions).transpose(1, 0, 2))
    owners = Owners(int(spark.conf.get("spark.sql.shuffle.partitions")), positions, len(seeds))
    dealt = deal(vectors, column, codebooks, owners, scale).rdd.map(lambda r: ((r[0], r[1], r[2]), pickle.loads(r[3])))
    state = dealt.partitionBy(owners.partitions, owners).mapPartitions(_merged, preservesPartitioning=True)
    before = None
    for turn in range(rounds):
        if turn:
            stay = state.mapPartitions(_staying(codebooks), preservesPartitioning=True)
            move = state.mapPartitions(_moving(codebooks)).partitionBy(owners.partitions, owners)
            before, state = state, stay.union(move).mapPartitions(_merged, preservesPartitioning=True)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        if turn % CHECKPOINT_EVERY == 0:
            state.checkpoint()
        codebooks = update(state, codebooks)
        if before is not None:
            before.unpersist()
    state.unpersist()
    return codebooks


def encode(vectors: DataFrame, column: str, codebooks: list[np.ndarray], length: int, scale: int = SCALE) -> DataFrame:
    """Replace the vectors by ``code`` (two hex digits a part) and ``error`` (squared distance over all parts): a scan."""
    kept = [c for c in vectors.columns if c.lower() not in (column.lower(), "code", "error")]
    digits = np.array([f"{e:02x}" for e in range(max([len(b) for b in codebooks], default=0))], object)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(column)
            fits = np.array([n == length for n in own.value_lengths().to_pylist()], bool) & bool(codebooks)
            code, error = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            if fits.any():
                parts = in_parts(integers(own.filter(pa.array(fits)), scale), len(codebooks))
                found = [nearest(parts[:, p], book) for p, book in enumerate(codebooks)]
                code[fits] = sum((digits[e] for e, _ in found[1:]), digits[found[0][0]])
                far = np.array([d for _, d in found])
                if far.dtype == object or far.max(initial=0) >= LONGEST // len(found):
                    error[fits] = [min(LONGEST, sum(map(int, column))) for column in far.T.tolist()]
                else:
                    error[fits] = far.sum(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(code, pa.string()), pa.array(error, pa.int64())],
                                             names=[*kept, "code", "error"])

    rest = vectors.select(*[F.col(f"`{c}`") for c in kept])
    return vectors.select(*[F.col(f"`{c}`") for c in [*kept, column]]).mapInArrow(measure, schema_of(rest, "code string", "error bigint"))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite components only."""
    return vectors.filter(F.coalesce(F.forall(column, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)), F.lit(False)))


def quantise(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", positions: int = POSITIONS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """The usable rows with code and error instead of the vector, and the codebooks."""
    rows = land(usable(vectors, column), "quantise")
    size = rows.groupBy(F.size(column).alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = size["n"] if size else 0
    same = rows.filter(F.size(column) == length)
    first = same.orderBy(F.col(id_col).asc_nulls_last(), column).limit(entries).select(F.col(column).cast("array<double>").alias("v")).collect()
    if not first:
        return encode(rows, column, [], length, scale), []
    seeds = integers(pa.array([list(r["v"]) for r in first], pa.list_(pa.float64())), scale).reshape(len(first), length)
    codebooks = train(same, column, seeds, rounds, positions, scale)
    return encode(rows, column, codebooks, length, scale), codebooks


def fingerprint(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, in decimal, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def with_group_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: the error summed over equal labels, nulls together."""
    own = clean_name(coded, "_label")
    totals = coded.groupBy(F.col(label).alias(own)).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col(label).eqNullSafe(F.col(own)), "left").drop(own)


def _sql() -> str:
    """The whole training as DuckDB SQL, one pair of common table expressions for each round."""
    rows = f"""
with v as (select row_number() over (order by vec_id nulls last, embedding) as rn, vec_id, label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as c
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select cast(max(len(c)) / {POSITIONS} as bigint) as width from v),
x as (select rn, (i - 1) // width as pos, (i - 1) % width as j, c[i] as x from v, w, unnest(generate_series(1, len(c))) as t(i)),
b0 as (select pos, rn - 1 as entry, j, x as y from x where rn <= {ENTRIES})"""
    def assign(name: str, book: str) -> str:
        return f""",
{name} as materialized (select rn, pos, m % {ENTRIES} as entry, m // {ENTRIES} as apart from (
  select rn, pos, min(d * {ENTRIES} + entry) as m from (
    select x.rn, x.pos, b.entry, cast(sum((x.x - b.y) * (x.x - b.y)) as bigint) as d from x join {book} b on x.pos = b.pos and x.j = b.j group by 1, 2, 3)
  group by 1, 2))"""
    for r in range(ROUNDS):
        rows += assign(f"a{r}", f"b{r}") + f""",
b{r + 1} as materialized (select b.pos, b.entry, b.j, coalesce(u.y, b.y) as y from b{r} b left join (
  select a.pos, a.entry, x.j, cast(floor(cast(sum(x.x) as double) / count(*)) as bigint) as y
  from x join a{r} a on x.rn = a.rn and x.pos = a.pos group by 1, 2, 3) u on b.pos = u.pos and b.entry = u.entry and b.j = u.j)"""
    return rows + assign("a", f"b{ROUNDS}") + f""",
coded as (select rn, string_agg(printf('%02x', entry), '' order by pos) as code, cast(sum(apart) as bigint) as error from a group by rn),
book as (select sha256(string_agg(cast(y as varchar), ',' order by pos, entry, j)) as codebooks_sha256 from b{ROUNDS})
select v.vec_id, coded.code, coded.error, cast(sum(coded.error) over (partition by v.label) as bigint) as label_error, book.codebooks_sha256
from v join coded on v.rn = coded.rn, book"""


@query("op11_member_lloyd", _sql())
def op11_member_lloyd(spark, sf_dir):
    coded, codebooks = quantise(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    return with_group_error(coded).select("vec_id", "code", "error", "label_error", F.lit(fingerprint(codebooks)).alias("codebooks_sha256"))
