"""Near-duplicates by circulant MinHash with exact Jaccard verification.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a document's set holds its distinct five-word
shingles as 64-bit hashes (all words as one shingle if fewer; nothing without words). Signature
coordinate k of a set S is ``min over x in S of pi(sigma(x) + k mod 2^32)``: sigma is one fixed
permutation of the 32-bit universe, pi a second one used at every circular shift k, so two
permutations give all 240 coordinates. 48 bands of five coordinates then propose pairs: a pair at
similarity 0.75 misses every band with probability (1 - 0.75^5)^48 = 2e-6.

No group is ever expanded into all its pairs:

1. Equal sets collapse into one class first (partial aggregation, hot copies cost one row a task).
2. In every bucket the class of least hash is the centre, and each class proposes itself to one
   centre a round. Proposed pairs are verified on full sets and confirmed links contracted to
   components. Buckets whose members already share a component need nothing more.
3. Rounds go on while they join components. The classes that then still share a bucket with another
   component are checked in full, so no link is lost: first by an exact bound (a class three quarters of
   whose shingles no other such class has can't have a link), then, cluster by cluster (classes that
   share buckets), in blocks of classes against blocks, each a bounded task that returns only the links
   that join components.

The result has each document's component, not links. Sets are built only for classes in a shared
bucket. Intermediate tables are stored in the shared folder.

Defined cases: null, empty or wordless text: n_shingles 0, linked with nothing. A null doc_id is
linked with nothing (component null, kept). Repeated rows each give a row with the same component;
rows that share a doc_id but not the text are separate documents whose components are reported under
that id. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm import common
from tillrec.llm.components import components

SHINGLE = 5
MIN_SIMILARITY_PCT = 75
BANDS, ROWS = 48, 5
STAR_ROUNDS = 4
BLOCK = 256                                    # classes of a cluster that a task holds on either side

_COORDINATES = BANDS * ROWS
_SHIFTS = np.arange(_COORDINATES, dtype=np.uint32)[:, None]
_BLOCK = 512                                   # shingles whose coordinates are held at a time

# odd constants of multiplicative mixing (fixed values)
_WORD_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                          0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S1, _S2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_P1, _P2 = np.uint32(0x7FEB352D), np.uint32(0x846CA68B)


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles."""
    if not words:
        return np.empty(0, np.uint64)
    one = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    size = min(SHINGLE, len(words))
    count = len(words) - size + 1
    mixed = np.full(count, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        part = one[j:j + count]
        mixed += (part ^ (part >> np.uint64(29))) * _WORD_FACTORS[j]
    mixed ^= mixed >> np.uint64(33)
    mixed *= _M1
    mixed ^= mixed >> np.uint64(33)
    mixed *= _M2
    mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed)


def sigma(x: np.ndarray) -> np.ndarray:
    """First permutation of the 32-bit universe."""
    x = x ^ (x >> np.uint32(16))
    x = x * _S1
    x ^= x >> np.uint32(13)
    x *= _S2
    x ^= x >> np.uint32(16)
    return x


def pi(x: np.ndarray) -> np.ndarray:
    """Second permutation, in place."""
    t = x >> np.uint32(16)
    x ^= t
    x *= _P1
    np.right_shift(x, np.uint32(15), out=t)
    x ^= t
    x *= _P2
    np.right_shift(x, np.uint32(16), out=t)
    x ^= t
    return x


def signature(hashes: np.ndarray) -> np.ndarray:
    """All coordinates: the second permutation, shifted by one more place for each."""
    start = sigma(hashes.astype(np.uint32))
    out = np.full(_COORDINATES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(start), _BLOCK):
        np.minimum(out, pi(start[at:at + _BLOCK] + _SHIFTS).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _M1
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * _M2
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def set_hash(hashes: np.ndarray) -> int:
    """Identity of a set, as a signed long."""
    h = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return h - (1 << 64) if h >= 1 << 63 else h


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node (identity of the set, null if empty), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, bands = [], [], []
            for text in common.utf8_column(batch, "text"):
                hashes = shingle_hashes(common.byte_words(text))
                sizes.append(len(hashes))
                nodes.append(set_hash(hashes) if len(hashes) else None)
                bands.append(band_keys(signature(hashes)) if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n_shingles", "node", "bands"])

    return docs.select("doc_id", "text", _text_key().alias("text_key")).mapInArrow(
        run, "doc_id long, text_key long, n_shingles long, node long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """node, items (the sorted shingle hashes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(common.byte_words(t)) for t in common.utf8_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([set_hash(h) if len(h) else None for h in found], pa.int64()),
                 pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["node", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("items").alias("b"), F.size("items").alias("nb"))
    sized = pairs.join(right, "v").join(left, "u").withColumn("na", F.size("a"))
    near = sized.filter(100 * F.least("na", "nb") >= MIN_SIMILARITY_PCT * F.greatest("na", "nb"))
    return near.withColumn("shared", F.size(F.array_intersect("a", "b"))) \
        .filter(100 * F.col("shared") >= MIN_SIMILARITY_PCT * (F.col("na") + F.col("nb") - F.col("shared"))) \
        .select("u", "v")


def _relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    """Labels after the components of a graph over labels."""
    r = roots.select(F.col("node").alias("label"), "root")
    return labels.join(r, "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (key, node, label) of the buckets that hold two components or more, with the label
    (``major``) and node (``centre``) of their least member."""
    named = members.join(labels, "node")
    top = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                   F.min(F.struct("label", "node")).alias("least")) \
        .filter("low <> high").select("key", F.col("least.label").alias("major"), F.col("least.node").alias("centre"))
    return named.join(top, "key")


def rest_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join the components that still meet in buckets; none is missed."""
    opened = _open_buckets(members, labels).select("node", "label").distinct()
    items = common.stored(sets.join(opened, "node"), "minhash-open")
    # shingles that no other open class has can't be shared: an exact upper bound of every overlap
    alone = items.select("node", F.explode("items").alias("x")).groupBy("x") \
        .agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1") \
        .groupBy("node").agg(F.count("*").alias("alone"))
    size = F.size("items")
    able = common.stored(
        items.join(alone, "node", "left")
        .filter(100 * (size - F.coalesce("alone", F.lit(0))) >= MIN_SIMILARITY_PCT * size).drop("alone"), "minhash-able")

    met = members.join(able.select("node", "label"), "node")
    least = met.groupBy("key").agg(F.min("node").alias("v"), F.min("label").alias("low"), F.max("label").alias("high")) \
        .filter("low <> high").select("key", "v")
    edges = met.join(least, "key").select(F.col("node").alias("u"), "v")
    roots = components(edges)
    clusters = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    blocks = clusters.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = able.join(clusters, "node").join(blocks, "root") \
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("root", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
                         "own", "node", "label", "items") \
        .groupBy("root", "a", "b").applyInPandas(_joining_links, "u long, v long")


def _joining_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks of a cluster (or inside one) that join different components."""
    a, b = int(rows["a"].iat[0]), int(rows["b"].iat[0])
    rows = rows.sort_values("node")
    left, right = rows[rows["own"] == a], rows[rows["own"] == b]
    links: list[tuple[int, int]] = []
    if rows["label"].nunique() > 1 and len(left) and len(right):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        sizes = right["items"].map(len).to_numpy()
        flat = np.concatenate(right["items"].to_list())
        order = np.argsort(flat, kind="stable")
        owner = np.repeat(np.arange(len(right)), sizes)[order]
        keys, first = np.unique(flat[order], return_index=True)
        ends = np.append(first[1:], len(flat))
        nodes, marks = right["node"].to_numpy(), right["label"].to_numpy()
        for u, label, items in zip(left["node"], left["label"], left["items"]):
            at = np.searchsorted(keys, items)
            at[at == len(keys)] = 0
            at = at[keys[at] == items]
            count = ends[at] - first[at]
            places = np.repeat(first[at] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            shared = np.bincount(owner[places], minlength=len(right))
            near = 100 * shared >= MIN_SIMILARITY_PCT * (len(items) + sizes - shared)
            for k in np.flatnonzero(near & (marks != label)):
                x, y = find(int(label)), find(int(marks[k]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((int(u), int(nodes[k])))
    return pd.DataFrame(links, columns=["u", "v"], dtype="int64")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document row."""
    return _labelled(docs).drop("text_key", "label")


def _text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _labelled(docs: DataFrame) -> DataFrame:
    """The rows of ``near_duplicates`` with their text's key and their component's label (null: no set)."""
    signed = common.stored(signatures(docs), "minhash-signatures")
    solid = signed.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    classes = common.stored(solid.groupBy("node").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")),
                            "minhash-classes")
    banded = classes.select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    members = common.stored(banded.join(shared, "key", "left_semi"), "minhash-members")

    # full sets of the classes that share a bucket, from one document each
    wanted = members.select("node").distinct().join(classes.select("node", "rep"), "node")
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = common.stored(full_sets(texts.dropDuplicates()).filter("node IS NOT NULL"), "minhash-sets")

    labels = members.select("node").distinct().withColumn("label", F.col("node"))
    for step in range(STAR_ROUNDS):
        opened = _open_buckets(members, labels).filter("label <> major")
        pairs = opened.groupBy("node").agg(F.min("centre").alias("u"), F.first("label").alias("label")) \
            if step == 0 else opened.groupBy("node").agg(F.max("centre").alias("u"))
        links = common.stored(verified(pairs.select(F.col("node").alias("v"), "u"), sets), "minhash-links")
        labels, joined = _contracted(labels, links)
        if not joined:
            break
    labels, _ = _contracted(labels, common.stored(rest_links(members, labels, sets), "minhash-links"))

    # a component's id is the least document of its classes
    grouped = classes.select("node", "rep").join(labels, "node", "left") \
        .select("node", "rep", F.coalesce("label", "node").alias("label"))
    ids = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    found = grouped.join(ids, "label").select("node", "label", "component_id")
    keyed = signed.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    return keyed.join(found, "node", "left").select(
        "doc_id", "text_key", "label", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _contracted(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, bool]:
    """Labels after links between nodes, and whether any components were joined."""
    if links.isEmpty():
        return labels, False
    lu = labels.select(F.col("node").alias("u"), F.col("label").alias("lu"))
    lv = labels.select(F.col("node").alias("v"), F.col("label").alias("lv"))
    edges = links.join(lu, "u").join(lv, "v").select(F.col("lu").alias("u"), F.col("lv").alias("v")).filter("u <> v")
    roots = components(edges)
    if roots.isEmpty():
        return labels, False
    return common.stored(_relabelled(labels, roots), "minhash-labels"), True


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One document of each component (its least id; of several texts under that id, the one of least
    key); all columns stay. Rows without a doc_id stay; of rows that repeat a kept doc_id and text, or
    have no words under one doc_id, one stays."""
    found = common.stored(_labelled(docs).filter("doc_id IS NOT NULL").select("doc_id", "text_key", "label", "kept"),
                          "minhash-found")
    several = found.filter("kept").groupBy("doc_id", "label").agg(F.min("text_key").alias("least"), F.max("text_key").alias("most")) \
        .filter("least <> most").select(F.col("doc_id").alias("id"), F.col("label").alias("of"), "least")
    others = found.filter("kept").join(
        several, (F.col("doc_id") == F.col("id")) & F.col("label").eqNullSafe(F.col("of")) & (F.col("text_key") != F.col("least")))
    keys = ["doc_id", "text_key"]
    gone = found.filter("NOT kept").select(keys).unionByName(others.select(keys)).distinct() \
        .withColumnsRenamed({k: f"__minhash_{k}" for k in keys})
    named = docs.filter("doc_id IS NOT NULL").withColumn("__minhash_key", _text_key())
    named = named.join(gone, (F.col("doc_id") == F.col("__minhash_doc_id")) & (F.col("__minhash_key") == F.col("__minhash_text_key")),
                       "left_anti").dropDuplicates(["doc_id", "__minhash_key"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))
