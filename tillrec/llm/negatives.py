"""Hard negatives by rotated one-bit codes with deterministic residual intervals.

Rows are (vec_id, label, embedding); a vector's components become floor(256 x). Anchors are the rows whose
id ``ANCHOR_STEP`` divides. An anchor's positives are its first other rows of the same label by integer
inner product; for each, the negatives are the first rows of other labels whose score lies between
``LOW_PCT`` and ``HIGH_PCT`` percent of the positive's.

Code of a vector x: rotate it by a fixed orthogonal matrix R and keep the signs, c = sign(R x) / sqrt(d),
one bit a component, with the stored alignment <R x, c>. What the code does not explain is orthogonal to
c; it is rotated and coded again, ``LEVELS`` times, and the length of the last residual is stored. A query is
rotated alike and each of its components written in ``QUERY_BITS`` bits, so <c, q> is a few popcounts of code words
against bit planes. The estimate sum(alignment <c, q>) misses the score by no more than the residual's
length times that of the query orthogonal to the last code (Cauchy-Schwarz), plus the rounding of the planes. These
intervals are certain, not probable: a row is dropped only if its interval lies outside of what can still
be among the first, after each level; what survives is scored in integers. So the result is exact.

Rows are coded once and stored. Anchors are taken in blocks of at most ``BLOCK_BYTES``, each broadcast
to one pass over the rows; a task holds a chunk of rows and each anchor's first rows so far. Before
the pass over all rows, one over a sixteenth of them gives a floor for every list (the score of its last
place), so all tasks together return a few rows more than wanted per list, however many tasks there are.

Defined cases: rows with a null vec_id or label, a null vector, or a null or non-finite component take no
part (nor those where 256 x is 2^52 or more in size); equal rows count once; rows of one vec_id but other
vectors are rows of their own, never partners of one another; vectors of other lengths than
the anchor's aren't compared with it, empty vectors score 0. A score beyond 64 bits is compared
exactly and returned as the nearest long. An anchor without positives gives no rows; an empty table gives
none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillrec.llm import common

ANCHOR_STEP = 100
POSITIVES, NEGATIVES = 5, 10
LOW_PCT, HIGH_PCT = 30, 90
LEVELS = 6
QUERY_BITS = 8
LARGEST = 2.0 ** 52                            # components beyond it aren't whole doubles any more
SEED_SHARE = 16                                # one row in so many gives the floors
BLOCK_BYTES = 8 << 20                          # of anchors' components in a broadcast
CHUNK_BYTES = 16 << 20                         # of rows' components that a task holds at a time

_LONG = 1 << 63
_CODED = {"vec_id": pa.int64(), "label": pa.int32(), "dims": pa.int32(), "v": pa.list_(pa.float64()), "code": pa.binary(), "align": pa.binary()}
_CODED_DDL = "vec_id long, label int, dims int, v array<double>, code binary, align binary"
_SCORE = pa.decimal128(38, 0)
_FOUND = {"anchor": pa.int32(), "slot": pa.int32(), "positive_id": pa.int64(), "positive_score": _SCORE, "row_id": pa.int64(), "score": _SCORE}
_FOUND_DDL = "anchor int, slot int, positive_id long, positive_score decimal(38,0), row_id long, score decimal(38,0)"
_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


# --------------------------------------------------------------------------- codes

@cache
def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))[0]


def words_of(signs: np.ndarray) -> np.ndarray:
    """Boolean rows as 64-bit words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    out = np.zeros((len(signs), -(-signs.shape[1] // 64) * 8), dtype=np.uint8)
    out[:, :packed.shape[1]] = packed
    return out.view("<u8")


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code words (rows, LEVELS, words) and alignments with the last residual's length (rows, LEVELS + 1)."""
    n, dims = vectors.shape
    codes = np.zeros((n, LEVELS, -(-dims // 64)), dtype=np.uint64)
    align = np.zeros((n, LEVELS + 1))
    rest, unit = vectors, 1 / np.sqrt(max(dims, 1))
    for level in range(LEVELS):
        rest = rest @ rotation(dims).T
        signs = rest >= 0
        codes[:, level] = words_of(signs)
        align[:, level] = np.abs(rest).sum(axis=1) * unit
        rest = rest - (align[:, level] * unit)[:, None] * np.where(signs, 1.0, -1.0)
    align[:, LEVELS] = np.sqrt((rest * rest).sum(axis=1))
    return codes, align


@dataclass
class Query:
    """A rotated query as bit planes, one set for each level."""
    planes: np.ndarray           # (LEVELS, QUERY_BITS, words)
    low: np.ndarray              # value of a component whose bits are all 0
    step: np.ndarray
    total: np.ndarray            # sum over components of the written numbers
    missed: np.ndarray           # sum over components of the rounding
    length: float
    dims: int

    @classmethod
    def of(cls, vector: np.ndarray) -> Query:
        dims, top = len(vector), (1 << QUERY_BITS) - 1
        planes, low, step, total, missed = [], [], [], [], []
        q = vector
        for _ in range(LEVELS):
            q = rotation(dims) @ q
            least = q.min() if dims else 0.0
            width = (q.max(initial=least) - least) / top or 1.0
            written = np.clip(np.rint((q - least) / width), 0, top).astype(np.int64)
            planes.append(words_of((written[None, :] >> np.arange(QUERY_BITS)[:, None]) & 1 == 1))
            low.append(least)
            step.append(width)
            total.append(written.sum())
            missed.append(np.abs(q - (least + width * written)).sum())
        return cls(np.array(planes), np.array(low), np.array(step), np.array(total), np.array(missed), float(np.linalg.norm(vector)), dims)

    def aligned(self, level: int, codes: np.ndarray) -> np.ndarray:
        """<c, q> of code words (rows, words), up to ``missed / sqrt(dims)``."""
        ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
        inside = np.zeros(len(codes), dtype=np.int64)
        for bit, plane in enumerate(self.planes[level]):
            inside += np.bitwise_count(codes & plane).sum(axis=1, dtype=np.int64) << bit
        plain = self.low[level] * (2 * ones - self.dims) + self.step[level] * (2 * inside - self.total[level])
        return plain / np.sqrt(max(self.dims, 1))


@dataclass
class Rows:
    """A chunk of rows of one dimension, sorted by label."""
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray                # whole numbers as doubles
    codes: np.ndarray
    align: np.ndarray
    left: np.ndarray = field(init=False)      # residual's length after each level
    largest: float = field(init=False)

    def __post_init__(self) -> None:
        order = np.lexsort((self.ids, self.labels))
        self.ids, self.labels, self.v, self.codes, self.align = (x[order] for x in (self.ids, self.labels, self.v, self.codes, self.align))
        squares = np.cumsum((self.align * self.align)[:, ::-1], axis=1)[:, ::-1]
        self.left = np.sqrt(squares[:, 1:])
        self.largest = float(np.abs(self.v).max(initial=0))

    def scores(self, at: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """Integer inner products; Python integers where 64 bits might not do."""
        bound = len(vector) * self.largest * float(np.abs(vector).max(initial=0))
        if 100 * bound < 2.0 ** 62:
            return self.v[at].astype(np.int64) @ vector.astype(np.int64)
        q = [int(x) for x in vector]
        return np.array([sum(int(x) * y for x, y in zip(row, q)) for row in self.v[at].tolist()], dtype=object)

    def intervals(self, q: Query, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, lower, upper) level by level; the caller sends back which of the rows to go on with."""
        estimate, rounding = np.zeros(len(at)), np.zeros(len(at))
        # beyond the doubles' own rounding
        slack = 1e-9 * q.length * np.sqrt((self.align[at] ** 2).sum(axis=1)) + 1e-9
        for level in range(LEVELS):
            c = q.aligned(level, self.codes[at, level])
            off = q.missed[level] / np.sqrt(max(q.dims, 1))
            estimate = estimate + self.align[at, level] * c
            rounding = rounding + self.align[at, level] * off
            across = np.sqrt(np.maximum(q.length ** 2 - np.maximum(np.abs(c) - off, 0) ** 2, 0))
            half = self.left[at, level] * across + rounding + slack
            stay = yield at, estimate - half, estimate + half
            at, estimate, rounding, slack = at[stay], estimate[stay], rounding[stay], slack[stay]
            if not len(at):
                return


def _nth_largest(values: np.ndarray, n: int) -> float:
    return -np.inf if len(values) < n else float(np.partition(values, len(values) - n)[len(values) - n])


class Best:
    """The first ``size`` rows of a list so far, by score descending, then id."""

    def __init__(self, size: int, floor: int | None):
        self.size, self.floor = size, floor
        self.rows: list[tuple[int, int]] = []       # (-score, id)

    @property
    def least(self) -> float:
        """No row below this score can come in."""
        bar = -np.inf if self.floor is None else self.floor
        return max(bar, -self.rows[-1][0]) if len(self.rows) == self.size else bar

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids):
            return
        if scores.dtype != object and len(ids) > 4 * self.size:    # those that score less than the last place can't stay
            able = scores >= np.partition(scores, len(scores) - self.size)[len(scores) - self.size]
            scores, ids = scores[able], ids[able]
        bar = self.least
        new = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s >= bar]
        self.rows = sorted(self.rows + new)[:self.size]


def first_of_label(rows: Rows, anchor: Anchor, q: Query, best: Best) -> None:
    """Offer the rows of the anchor's label to its list of positives."""
    a, b = np.searchsorted(rows.labels, [anchor.label, anchor.label + 1])
    at = np.arange(a, b)[rows.ids[a:b] != anchor.vec_id]
    if len(at) > best.size:
        steps, stay = rows.intervals(q, at), None
        while True:
            try:
                at, low, high = next(steps) if stay is None else steps.send(stay)
            except StopIteration:
                at = at[stay]
                break
            stay = high >= max(best.least, _nth_largest(low, best.size))
    best.add(rows.scores(at, anchor.v), rows.ids[at])


def first_in_windows(rows: Rows, anchor: Anchor, q: Query, windows: list[tuple[int, int]], best: list[Best]) -> None:
    """Offer the rows of other labels to the lists of the anchor's windows of scores."""
    at = np.flatnonzero((rows.labels != anchor.label) & (rows.ids != anchor.vec_id))
    if len(at):
        steps, stay = rows.intervals(q, at), None
        while True:
            try:
                at, low, high = next(steps) if stay is None else steps.send(stay)
            except StopIteration:
                at = at[stay]
                break
            stay = np.zeros(len(at), dtype=bool)
            for (least, most), held in zip(windows, best):
                inside = low[(low >= least) & (high <= most)]
                stay |= (low <= most) & (high >= max(least, held.least, _nth_largest(inside, held.size)))
    scores, ids = rows.scores(at, anchor.v), rows.ids[at]
    for (least, most), held in zip(windows, best):
        fits = np.asarray((scores >= least) & (scores <= most), dtype=bool)
        held.add(scores[fits], ids[fits])


def window(score: int) -> tuple[int, int]:
    """Least and largest negative score for a positive's score."""
    return -(-LOW_PCT * score // 100), HIGH_PCT * score // 100


# --------------------------------------------------------------------------- passes

def coded(vectors: DataFrame) -> DataFrame:
    """The distinct rows that take part, with whole components and codes."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"),
                          F.transform("embedding", lambda x: x.cast("double") * 256).alias("x")) \
        .filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL") \
        .filter(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST))) \
        .withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))) \
        .dropDuplicates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, flat = _components(batch.column(2))
            flat = np.floor(flat)
            starts = np.cumsum(sizes) - sizes
            codes, align = [b""] * len(sizes), [b""] * len(sizes)
            for dims in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dims)
                c, a = encode(flat[starts[at][:, None] + np.arange(dims)])
                for k, i in enumerate(at.tolist()):
                    codes[i], align[i] = c[k].tobytes(), a[k].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)), pa.int32()), pa.array(flat, pa.float64())),
                 pa.array(codes, pa.binary()), pa.array(align, pa.binary())], schema=common.arrow_schema(_CODED))

    return rows.mapInArrow(run, _CODED_DDL)


def _components(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and their components one after the other."""
    return np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Rows]:
    """Rows of one dimension each, of about CHUNK_BYTES."""
    held: dict[int, list[list[np.ndarray]]] = {}

    def rows(dims: int) -> Rows:
        return Rows(*[np.concatenate(x) for x in zip(*held.pop(dims))])

    for batch in batches:
        sizes, flat = _components(batch.column(3))
        starts = np.cumsum(sizes) - sizes
        for dims in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == dims)
            some = batch.take(pa.array(at))
            n, words = len(at), -(-dims // 64)
            codes = np.frombuffer(b"".join(some.column(4).to_pylist()), dtype="<u8").reshape(n, LEVELS, words)
            align = np.frombuffer(b"".join(some.column(5).to_pylist())).reshape(n, LEVELS + 1)
            held.setdefault(dims, []).append([some.column(0).to_numpy(), some.column(1).to_numpy(),
                                              flat[starts[at][:, None] + np.arange(dims)], codes, align])
            if sum(len(x[0]) for x in held[dims]) * 8 * max(dims, 1) >= CHUNK_BYTES:
                yield rows(dims)
    for dims in list(held):
        yield rows(dims)


@dataclass
class Anchor:
    """An anchor of a block; ``lists`` are its positives' list, or a list for each positive."""
    vec_id: int
    label: int
    v: np.ndarray
    positives: list[tuple[int, int]] = field(default_factory=list)      # (id, score)
    floors: dict[int, int] = field(default_factory=dict)                # score of a list's last place among the seed rows


def _searched(rows: DataFrame, anchors: Broadcast, positives: bool) -> DataFrame:
    """Every task's first rows for each anchor's list of positives, or for its lists of negatives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[Anchor] = anchors.value
        size = POSITIVES if positives else NEGATIVES
        best = [[Best(size, a.floors.get(k)) for k in range(1 if positives else len(a.positives))] for a in block]
        queries: dict[int, Query] = {}
        for chunk in _chunks(batches):
            for n, a in enumerate(block):
                if len(a.v) != chunk.v.shape[1] or not best[n]:
                    continue
                if n not in queries:
                    queries[n] = Query.of(a.v)
                if positives:
                    first_of_label(chunk, a, queries[n], best[n][0])
                else:
                    first_in_windows(chunk, a, queries[n], [window(s) for _, s in a.positives], best[n])
        found = [(n, k, *(a.positives[k] if a.positives else (None, None)), i, -s)
                 for n, a in enumerate(block) for k, b in enumerate(best[n]) for s, i in b.rows]
        columns = list(zip(*found)) or [[]] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array([None if x is None else Decimal(x) for x in c] if f.type == _SCORE else c, f.type)
                                          for c, f in zip(columns, common.arrow_schema(_FOUND))], schema=common.arrow_schema(_FOUND))

    return rows.mapInArrow(run, _FOUND_DDL)


def _merged(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` rows of every list, with their rank."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def _with_floors(rows: DataFrame, block: list[Anchor], positives: bool) -> Broadcast:
    """The block with the floors that a share of the rows gives, broadcast."""
    spark = rows.sparkSession
    size = POSITIVES if positives else NEGATIVES
    plain = spark.sparkContext.broadcast(block)
    seeds = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(SEED_SHARE)) == 0)
    for r in _merged(_searched(seeds, plain, positives), size).filter(F.col("rank") == size).collect():
        block[r["anchor"]].floors[r["slot"]] = int(r["score"])
    plain.destroy()
    return spark.sparkContext.broadcast(block)


def _anchors(rows: DataFrame, step: int) -> Iterator[list[Anchor]]:
    """The anchors in blocks of about BLOCK_BYTES."""
    picked = rows.filter(F.col("vec_id") % step == 0).select("vec_id", "label", "dims", "v")
    total = picked.agg(F.sum(8 * F.col("dims") + 512)).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    for n in range(blocks):
        part = picked.filter(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)) == n).toArrow()
        block = [Anchor(i, c, np.array(v, dtype=np.float64)) for i, c, v in
                 zip(*(part.column(k).to_pylist() for k in ("vec_id", "label", "v")))]
        if block:
            yield block


def hard_negatives(vectors: DataFrame, step: int = ANCHOR_STEP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = common.stored(coded(vectors), "negatives-codes")
    path = common.shared_path(spark, "negatives")
    spark.createDataFrame([], _MINED).write.parquet(path)
    for block in _anchors(rows, step):
        with_floors = _with_floors(rows, block, True)
        for r in _merged(_searched(rows, with_floors, True), POSITIVES).orderBy("anchor", "rank").collect():
            block[r["anchor"]].positives.append((r["row_id"], int(r["score"])))
        with_floors.destroy()
        for a in block:
            a.floors = {}
        with_floors = _with_floors(rows, block, False)
        ids = spark.createDataFrame([(n, a.vec_id) for n, a in enumerate(block)], "anchor int, anchor_id long")
        bound = lambda c: F.greatest(F.least(c, F.lit(Decimal(_LONG - 1))), F.lit(Decimal(-_LONG))).cast("long")
        _merged(_searched(rows, with_floors, False), NEGATIVES).join(ids, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"),
            bound("positive_score").alias("positive_score"), bound("score").alias("negative_score")) \
            .write.mode("append").parquet(path)
        with_floors.destroy()
    return spark.read.schema(_MINED).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = r"""
WITH e AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS row_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5),
n AS (SELECT p.*, row_id AS negative_id, score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
