"""Near-duplicates by SimHash with a binary trie self-join.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, features the three-word shingles with repeats (all
words as one if fewer). A fingerprint bit is 1 if it is set in over half of the shingles' XXH64 (seed 42);
a text without words has fingerprint zero. Fingerprints that differ in at most two bits are linked, and
linked documents share a component.

Only distinct fingerprints are joined. They are the leaves of a binary trie by their bits from the
highest down. A node of the trie that holds more than ``BUCKET`` fingerprints is split by its next
``STEP`` bits, so a dense region is split deeper than the rest. Pairs of nodes are then followed down
together, as a frontier table that starts with (root, root): each step joins both nodes with their
children, adds the bits in which these differ, and drops the pair as soon as the sum passes ``MAX_BITS``.
What is left are pairs of buckets; each is one bounded task, which goes on in the same way bit by bit
down to the leaves. A fingerprint has at most 1 + 64 + 2016 partners, so work and frontier grow with
the number of fingerprints, however many lie close together. A task returns links that span its linked
groups, never all pairs.

Defined cases: null, empty or wordless text: fingerprint zero, linked like any other. Rows with a null
doc_id take part; a component's id is its least doc_id that isn't null. Repeated rows each give a row.
An empty table gives no rows; extra columns are ignored. Long texts are hashed slice by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm import common
from tillrec.llm.components import components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
BITS = 64
STEP = 4                                       # bits by which a full node is split
BUCKET = 16_384                                # fingerprints in a bucket

_SLICE = 1 << 18                               # bytes of a text that are split into words at a time
_FRONTIER = 1 << 17                            # node pairs that a task follows at a time
_LEAVES = 64                                   # leaf pairs below which a node pair is compared directly
_LINKS = 1 << 20                               # links that a task holds before it reduces them


def _bit_counts(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the shingles buffer[starts:ends] have each bit set, highest bit first."""
    hashed = xxhash.xxh64_intdigest
    hashes = np.array([hashed(buffer[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], dtype=">u8")
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    total, count, carried = np.zeros(BITS, np.int64), 0, []
    for part in common.slices(text or b"", _SLICE):
        words = carried + common.byte_words(part)
        if len(words) >= SHINGLE:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            total += _bit_counts(b" ".join(words), starts[:1 - SHINGLE], ends[SHINGLE - 1:])
            count += len(words) - SHINGLE + 1
        carried = words[1 - SHINGLE:]
    if not count and carried:                  # fewer words than a shingle has
        whole = b" ".join(carried)
        total, count = _bit_counts(whole, np.array([0]), np.array([len(whole)])), 1
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, node (the fingerprint as a signed long) for every row of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in common.utf8_column(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))],
                                             names=["doc_id", "node"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, node long")


def _prefix(depth: int, node: Column | None = None) -> Column:
    """The first ``depth`` bits of a fingerprint, as a number."""
    node = F.col("node") if node is None else node
    return F.shiftrightunsigned(node, BITS - depth) if depth else F.lit(0).cast("long")


def buckets(nodes: DataFrame, size: int = BUCKET) -> tuple[DataFrame, list[DataFrame]]:
    """Fingerprints with their bucket (``depth``, ``prefix``), and for every STEP bits the trie's nodes
    (``prefix``, ``leaf``) that full nodes were split into."""
    left, done, levels = nodes.select("node"), [], []
    for depth in range(0, BITS + 1, STEP):
        named = left.withColumn("prefix", _prefix(depth))
        level = common.stored(named.groupBy("prefix").agg((F.count("*") <= size).alias("leaf")), "simhash-level")
        levels.append(level)
        placed = named.join(level, "prefix")
        done.append(placed.filter("leaf").select("node", F.lit(depth).alias("depth"), "prefix"))
        if level.filter("NOT leaf").isEmpty():
            break
        left = common.stored(placed.filter("NOT leaf").select("node"), "simhash-full")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, levels


def bucket_pairs(levels: list[DataFrame]) -> DataFrame:
    """Pairs of buckets (a_depth, a, b_depth, b) whose common bits differ in MAX_BITS at most.

    The frontier holds pairs of trie nodes, each unordered pair once or both ways; a node that is a
    bucket already waits for the other to reach its own.
    """
    frontier = levels[0].select(*[c for s in "ab" for c in (F.lit(0).alias(f"{s}_depth"), F.col("prefix").alias(s), F.col("leaf").alias(f"{s}_leaf"))],
                                F.lit(0).alias("differ"))
    ready = []
    for n, level in enumerate(levels[1:], 1):
        ready.append(frontier.filter("a_leaf AND b_leaf"))
        open_pairs = frontier.filter("NOT (a_leaf AND b_leaf)")
        for side in "ab":
            child = level.select(F.shiftrightunsigned("prefix", STEP).alias(f"{side}_up"), F.col("prefix").alias(f"{side}_new"),
                                 F.col("leaf").alias(f"{side}_new_leaf"))
            full = open_pairs.filter(f"NOT {side}_leaf").join(child, F.col(side) == F.col(f"{side}_up"))
            waiting = open_pairs.filter(f"{side}_leaf") \
                .select("*", F.lit(None).cast("long").alias(f"{side}_up"), F.col(side).alias(f"{side}_new"), F.lit(True).alias(f"{side}_new_leaf"))
            open_pairs = full.unionByName(waiting)
        both = F.col("a_up").isNotNull() & F.col("b_up").isNotNull()
        low = (1 << STEP) - 1
        step = F.bit_count(F.col("a_new").bitwiseXOR(F.col("b_new")).bitwiseAND(F.lit(low)))
        moved = open_pairs.select(
            *[F.when(F.col(f"{s}_up").isNotNull(), F.lit(n * STEP)).otherwise(F.col(f"{s}_depth")).alias(f"{s}_depth") for s in "ab"],
            *[F.col(f"{s}_new").alias(s) for s in "ab"], *[F.col(f"{s}_new_leaf").alias(f"{s}_leaf") for s in "ab"],
            (F.col("differ") + F.when(both, step).otherwise(0)).alias("differ"))
        # of two children pairs that mirror each other below one node, one is enough
        frontier = common.stored(moved.filter(f"differ <= {MAX_BITS} AND (a_depth <> b_depth OR a <= b)"), "simhash-frontier")
    ready.append(frontier.filter("a_leaf AND b_leaf"))
    out = ready[0]
    for part in ready[1:]:
        out = out.unionByName(part)
    ordered = "(a_depth < b_depth OR (a_depth = b_depth AND a <= b))"
    return out.selectExpr(*[f"IF({ordered}, {x}, {y}) AS {x}" for x, y in (("a_depth", "b_depth"), ("a", "b"), ("b_depth", "a_depth"), ("b", "a"))]) \
        .distinct()


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its group) that connect what the links (u, v) connect."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[:len(u)], at[len(u):]
    root = np.arange(len(nodes))
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            break
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:                            # every node points at its root
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _leaf_pairs(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, blo: np.ndarray, bhi: np.ndarray,
                same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of node pairs that differ in MAX_BITS at most, compared leaf by leaf."""
    wide = bhi - blo
    count = (hi - lo) * wide
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wide = np.repeat(wide, count)
    i, j = np.repeat(lo, count) + k // wide, np.repeat(blo, count) + k % wide
    near = np.bitwise_count(a[i] ^ b[j]) <= MAX_BITS
    if same:
        near &= i < j
    return a[i[near]], b[j[near]]


def linked(a: np.ndarray, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between two buckets (sorted distinct uint64), or inside one: node pairs are
    followed down together, highest bit first."""
    same = b is None
    b = a if same else b
    held_u, held_v, held = [], [], 0
    if not len(a) or not len(b):
        return a[:0], b[:0]
    zeros = {}

    def split(side: int, arr: np.ndarray, depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the leaves with the bit set begin."""
        if (side, depth) not in zeros:
            unset = ((arr >> np.uint64(BITS - 1 - depth)) & np.uint64(1)) == 0
            zeros[side, depth] = np.append(0, np.cumsum(unset))
        before = zeros[side, depth]
        return lo + before[hi] - before[lo]

    one = lambda n: np.array([n], dtype=np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), one(0))]
    while stack:
        depth, lo, hi, blo, bhi, differ = stack.pop()
        if len(lo) > _FRONTIER:
            for part in np.array_split(np.arange(len(lo)), -(-len(lo) // _FRONTIER)):
                stack.append((depth, lo[part], hi[part], blo[part], bhi[part], differ[part]))
            continue
        small = ((hi - lo) * (bhi - blo) <= _LEAVES) | (depth == BITS)
        if small.any():
            u, v = _leaf_pairs(a, b, lo[small], hi[small], blo[small], bhi[small], same)
            held_u.append(u)
            held_v.append(v)
            held += len(u)
            if held > _LINKS:
                u, v = spanning(np.concatenate(held_u), np.concatenate(held_v))
                held_u, held_v, held = [u], [v], len(u)
        go = ~small
        if not go.any():
            continue
        lo, hi, blo, bhi, differ = lo[go], hi[go], blo[go], bhi[go], differ[go]
        mid, bmid = split(0, a, depth, lo, hi), split(1, b, depth, blo, bhi)
        itself = (lo == blo) & (hi == bhi) if same else np.zeros(len(lo), bool)
        below = [(lo, mid, blo, bmid, differ, None), (mid, hi, bmid, bhi, differ, None),
                 (lo, mid, bmid, bhi, differ + 1, None), (mid, hi, blo, bmid, differ + 1, ~itself)]
        parts = []
        for w, x, y, z, d, only in below:
            keep = (x > w) & (z > y) & (d <= MAX_BITS)
            if only is not None:
                keep &= only
            parts.append((w[keep], x[keep], y[keep], z[keep], d[keep]))
        merged = [np.concatenate([p[k] for p in parts]) for k in range(5)]
        if len(merged[0]):
            stack.append((depth + 1, *merged))
    if not held:
        return a[:0], b[:0]
    return spanning(np.concatenate(held_u), np.concatenate(held_v))


def links(nodes: DataFrame, size: int = BUCKET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column ``node``) that connect all that are close."""
    placed, levels = buckets(nodes, size)
    leaves = common.stored(placed.groupBy("depth", "prefix").agg(F.sort_array(F.collect_list("node")).alias("nodes")), "simhash-buckets")
    pairs = bucket_pairs(levels)
    for side in "ab":
        pairs = pairs.join(leaves.select(F.col("depth").alias(f"{side}_depth"), F.col("prefix").alias(side), F.col("nodes").alias(f"{side}_nodes")),
                           [f"{side}_depth", side])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pydict()
                left = np.sort(np.array(row["a_nodes"][0], dtype=np.int64).view(np.uint64))
                itself = (row["a_depth"], row["a"]) == (row["b_depth"], row["b"])
                right = None if itself else np.sort(np.array(row["b_nodes"][0], dtype=np.int64).view(np.uint64))
                u, v = linked(left, right)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    # a pair is heavy work for few bytes: one task each, as far as there are partitions
    parts = max(64, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(parts).mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of (doc_id, text)."""
    marked = common.stored(fingerprints(docs), "simhash-fingerprints")
    classes = common.stored(marked.groupBy("node").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    roots = components(common.stored(links(classes, size), "simhash-links"))
    grouped = classes.join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    ids = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    found = grouped.join(ids, "root").select("node", "component_id")
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return marked.join(found, "node").select("doc_id", hexed.alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
