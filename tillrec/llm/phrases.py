"""Phrase collocations counted in a HAT-trie of word ids.

Texts (A-Z lowered) are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words ``[^\\x20\\x09]+``.
Per language (null: ``und``) ``n`` is the number of words and f(phrase) the number of places where a
phrase stands within a piece. Phrases of two to four words with f of ``MIN_COUNT`` or more are
candidates; a candidate's score is floor(2000000 f / (f(first words) + f(other words))) at the cut where
it is lowest, in exact decimals. A candidate most of whose places lie in a longer candidate goes.

A task reads blocks of about ``_BLOCK`` bytes, in which a word is looked up once, however often it stands there.
It counts in a trie over word ids whose nodes are hash containers: a container that holds more than
``BURST`` tails is burst into one container for each next word. When the trie holds more than ``HELD``
entries, its largest subtrees are spilled whole, as a sorted run of (phrase, count). A phrase's runs meet in
the partition of its prefix (all its words but the last) and are merged there by summing; no count depends
on when a task spilled. Phrases of n words are counted only where both phrases of n - 1 words in them
have ``MIN_COUNT`` places or more, so each length is one pass that reads a filter of the shorter phrases: a Bloom
filter of at most 2^``FILTER_BITS`` bits (16 MB). Its errors, and its being too small, cost counts of
phrases that then turn out rare, never a result.

Defined cases: null text counts as empty; a null doc_id doesn't matter; repeated rows count again;
an empty table gives no rows; extra columns are ignored; long texts are read slice by slice, also
inside one piece. Ties are in the order of score, count, phrase (UTF-8 bytes).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillrec.llm import common

MAX_WORDS = 4
MIN_COUNT = 30
SCALE = 2_000_000
COVERED_PCT = 80
TOP = 2000

BURST = 8_192                                  # tails in a container before it is burst
HELD = 600_000                                 # entries of a task's tries before subtrees are spilled
VOCABULARY = 600_000                           # words of a task before it spills all and forgets them
FILTER_BITS = 27

_BLOCK = 1 << 22                               # bytes that are counted at a time
_SLICE = 1 << 20                               # bytes of a text that are split at a time
_ROWS = 1 << 16                                # rows of a spilled batch
_CUTS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
_LOW = (1 << 32) - 1
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_RUN = {"lang": pa.string(), "part": pa.int64(), "phrase": pa.string(), "n": pa.int64()}
_RUN_DDL = "lang string, part long, phrase string, n long"


# --------------------------------------------------------------------------- filters of frequent phrases

def phrase_hash(words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their words, position by position."""
    h = words[0].copy()
    for w in words[1:]:
        h = (h ^ (h >> np.uint64(29))) * _M1 + w
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def _seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang.encode()) & 0x7FFFFFFF


class Filter:
    """Bloom filter with two positions a phrase."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.mask = np.uint64(64 * len(bits) - 1)

    @staticmethod
    def places(h: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        return h & mask, (h >> np.uint64(32)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), dtype=bool)
        for at in self.places(h, self.mask):
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def _filter(grams: DataFrame) -> Broadcast:
    """Filter of the phrases (lang, phrase); its size follows their number up to 2^FILTER_BITS bits."""
    spark = grams.sparkSession
    count = grams.count()
    size = 1 << min(FILTER_BITS, max(12, (16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = np.array([_hash_of(lang, phrase) for lang, phrase in
                               zip(common.column(batch, "lang"), common.utf8_column(batch, "phrase"))], dtype=np.uint64)
            at = np.unique(np.concatenate(Filter.places(hashes, np.uint64(size - 1))))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    slots = grams.select("lang", "phrase").mapInArrow(run, "slot long, bits long") \
        .groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.int64)
    bits[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits.view(np.uint64))


def _hash_of(lang: str, phrase: bytes) -> int:
    words = [np.array([xxhash.xxh64_intdigest(w, _seed(lang))], dtype=np.uint64) for w in phrase.split(b" ")]
    return int(phrase_hash(words)[0])


# --------------------------------------------------------------------------- words and trie of a task

class Words(dict):
    """Ids of one language's words; 0 is the end of a piece, and a word that is too rare."""

    def __init__(self, lang: str, frequent: Filter | None):
        super().__init__()
        self.seed, self.frequent = _seed(lang), frequent
        self.listed: list[bytes] = [b""]
        self.hashes = np.zeros(1, dtype=np.uint64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Ids of distinct words; new ones are listed if they are frequent, so far as the filter knows."""
        ids = np.fromiter(map(self.get, words, repeat(0)), np.int64, len(words))
        at = np.flatnonzero(ids == 0)
        new = [words[i] for i in at.tolist()]
        hashes = np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], dtype=np.uint64)
        if self.frequent is not None:
            some = np.flatnonzero(self.frequent.has(phrase_hash([hashes])))
            at, hashes, new = at[some], hashes[some], [new[i] for i in some.tolist()]
        if new:
            ids[at] = np.arange(len(self.listed), len(self.listed) + len(new))
            self.update(zip(new, ids[at].tolist()))
            self.listed += new
            self.hashes = np.concatenate([self.hashes, hashes])
        return ids


class Node:
    """A container of packed tails, or, once burst, one node for each next word."""
    __slots__ = ("counts", "children", "size")

    def __init__(self) -> None:
        self.counts: dict[int, int] | None = {}
        self.children: dict[int, Node] | None = None
        self.size = 0


class Entries:
    """Distinct phrases, one a row in the order of their ids, and their counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams, self.counts = grams, counts.tolist()
        self.packed: dict[int, list[int]] = {}

    def tails(self, depth: int) -> list[int]:
        """Every phrase from ``depth`` on, packed."""
        if depth not in self.packed:
            self.packed[depth] = _packed(self.grams, depth)
        return self.packed[depth]


class HatTrie:
    """Counts of phrases of ``n`` word ids."""

    def __init__(self, n: int):
        self.n = n
        self.root = Node()

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct phrases (one a row, in the order of their ids) and their counts."""
        if len(grams):
            self._add(self.root, Entries(grams, counts), 0, len(grams), 0)

    def _add(self, node: Node, entries: Entries, start: int, end: int, depth: int) -> int:
        if node.children is None and end - start > BURST and self.n - depth > 1:
            self._burst(node, depth)                 # it would be, once they are in
        if node.children is None:
            box = node.counts
            old, get = len(box), box.get
            some = zip(entries.tails(depth)[start:end], entries.counts[start:end])
            if old:
                for tail, c in some:
                    box[tail] = get(tail, 0) + c
            else:
                box.update(some)
            grown = len(box) - old
            if len(box) > BURST and self.n - depth > 1:
                self._burst(node, depth)
        else:
            first = entries.grams[start:end, depth]
            edges = np.flatnonzero(first[1:] != first[:-1]) + 1
            words = first[np.concatenate([[0], edges])].tolist()
            edges = [start, *(edges + start).tolist(), end]
            grown = 0
            for word, a, b in zip(words, edges, edges[1:]):
                child = node.children.get(word)
                if child is None:
                    child = node.children[word] = Node()
                grown += self._add(child, entries, a, b, depth + 1)
        node.size += grown
        return grown

    def _burst(self, node: Node, depth: int) -> None:
        shift = 32 * (self.n - depth - 1)
        children = node.children = {}
        for tail, c in node.counts.items():
            child = children.get(tail >> shift)
            if child is None:
                child = children[tail >> shift] = Node()
            child.counts[tail & ((1 << shift) - 1)] = c
        node.counts = None
        for child in children.values():
            child.size = len(child.counts)

    def spilled(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out whole subtrees, the largest first, until ``keep`` entries are left: their phrases (one
        a row) and counts."""
        if self.root.children is None or not keep:
            out = self._entries([(self.root, ())])
            self.root = Node()
            return out
        gone = []
        for word, child in sorted(self.root.children.items(), key=lambda x: -x[1].size):
            if self.root.size <= keep:
                break
            del self.root.children[word]
            self.root.size -= child.size
            gone.append((child, (word,)))
        return self._entries(gone)

    def _entries(self, subtrees: list[tuple[Node, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
        leaves: list[list[tuple[tuple[int, ...], dict[int, int]]]] = [[] for _ in range(self.n)]
        while subtrees:
            node, path = subtrees.pop()
            if node.children is None:
                leaves[len(path)].append((path, node.counts))
            else:
                subtrees += [(child, (*path, word)) for word, child in node.children.items()]
        grams, counts = [], []
        for depth, some in enumerate(leaves):
            sizes = [len(box) for _, box in some]
            m = sum(sizes)
            paths = np.repeat(np.array([p for p, _ in some], dtype=np.int64).reshape(len(some), depth), sizes, axis=0)
            grams.append(np.concatenate([paths, _unpacked(chain.from_iterable(box for _, box in some), m, self.n - depth)], axis=1))
            counts.append(np.fromiter(chain.from_iterable(box.values() for _, box in some), np.int64, m))
        return np.concatenate(grams), np.concatenate(counts)


def _unpacked(tails: Iterable[int], count: int, words: int) -> np.ndarray:
    """The word ids of packed tails, one tail a row."""
    if words > 2:
        whole = list(tails)
        first = _unpacked((t >> 64 for t in whole), count, words - 2)
        return np.concatenate([first, _unpacked((t & ((1 << 64) - 1) for t in whole), count, 2)], axis=1)
    flat = np.fromiter(tails, np.int64, count)
    return flat[:, None] if words == 1 else np.stack([flat >> 32, flat & _LOW], axis=1)


def _packed(grams: np.ndarray, depth: int) -> list[int]:
    """Word ids from ``depth`` on as one number a row, 32 bits each."""
    tails = grams[:, depth:]
    if tails.shape[1] == 1:
        return tails[:, 0].tolist()
    out = ((tails[:, 0] << 32) | tails[:, 1]).tolist()
    for k in range(2, tails.shape[1]):
        out = [(x << 32) | y for x, y in zip(out, tails[:, k].tolist())]
    return out


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases in the order of their ids, and how often each occurs."""
    if len(grams) == 1:
        key, counts = np.unique(grams[0], return_counts=True)
        return key[:, None], counts
    if len(grams) == 2:
        key, counts = np.unique((grams[0] << 32) | grams[1], return_counts=True)
        return np.stack([key >> 32, key & _LOW], axis=1), counts
    key = grams[0]
    for column in grams[1:]:                   # dense numbers leave room for 32 bits more
        key = (np.unique(key, return_inverse=True)[1] << 32) | column
    _, at, counts = np.unique(key, return_index=True, return_counts=True)
    return np.stack([g[at] for g in grams], axis=1), counts


class Counter:
    """Phrases of ``n`` words of the texts of one language."""

    def __init__(self, lang: str, n: int, words_filter: Filter | None, shorter: Filter | None):
        self.lang, self.n, self.words_filter, self.shorter = lang, n, words_filter, shorter
        self.trie = HatTrie(n)
        self.words = Words(lang, words_filter)
        self.held: list[bytes] = []
        self.length = 0
        self.last = np.empty(0, np.int64)
        self.total = 0

    def read(self, text: bytes) -> None:
        spaced = text.lower().translate(_CUTS).replace(b".", b" .")
        for part in common.slices(spaced, _SLICE):
            self.held.append(part)
            self.length += len(part)
            if self.length > _BLOCK:
                self.count()
        self.held.append(b".")

    def _ids(self) -> np.ndarray:
        """Ids of the words held, in order, and 0 between pieces. A word is looked up once, however often it stands here."""
        octets = np.frombuffer(b"".join([b" ", *self.held, b" "]), np.uint8)
        dots = octets == ord(".")
        solid = ~dots & (octets != ord(" "))
        edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts = edges[::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(edges[1::2] - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(octets[solid])]).dictionary_encode()
        ids = self.words.ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())[words.indices.to_numpy()]
        ends = np.searchsorted(starts, np.flatnonzero(dots))
        return np.insert(ids, ends[np.diff(ends, prepend=-1) > 0], 0)

    def count(self) -> None:
        """Count the words held; the last n - 1 stay, as the next may go on from them."""
        if not self.held:
            return
        ids = np.concatenate([self.last, self._ids()])
        starts = max(0, len(ids) - self.n + 1)
        if self.n == 1:
            solid = ids[ids > 0]
            self.total += len(solid)
            grams = [solid]
        else:
            able = self._able(ids)
            at = np.flatnonzero(able[:starts] & able[1:starts + 1])
            grams = [ids[at + k] for k in range(self.n)]
        if len(grams[0]):
            self.trie.add(*_distinct(grams))
        self.held, self.length, self.last = [], 0, ids[starts:].copy()

    def _able(self, ids: np.ndarray) -> np.ndarray:
        """Where a phrase of n - 1 words starts that is frequent, so far as the filter knows."""
        m = self.n - 1
        count = len(ids) - m + 1
        able = np.zeros(max(count, 0) + 1, dtype=bool)
        if count > 0:
            whole = np.ones(count, dtype=bool)
            for k in range(m):
                whole &= ids[k:count + k] > 0
            if m > 1:
                hashes = self.words.hashes
                at = np.flatnonzero(whole)
                whole[at] = self.shorter.has(phrase_hash([hashes[ids[at + k]] for k in range(m)]))
            able[:count] = whole
        return able

    def forget_words(self) -> None:
        """Start a new vocabulary (the trie is empty); the words that the next may go on from stay."""
        old, self.words = self.words, Words(self.lang, self.words_filter)
        last = [old.listed[i] for i in self.last.tolist()]
        self.words.ids(sorted({*last} - {b""}))
        self.last = np.array([self.words.get(word, 0) for word in last], dtype=np.int64)

    def runs(self, keep: int) -> Iterator[pa.RecordBatch]:
        """Spilled subtrees as a run, sorted by the phrases' words."""
        grams, counts = self.trie.spilled(keep)
        if not len(grams):
            return
        words = pa.array(self.words.listed, pa.binary())
        rank = np.empty(len(words), np.int64)
        rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
        if self.n == 2:
            order = np.argsort((rank[grams[:, 0]] << 32) | rank[grams[:, 1]])
        else:
            order = np.lexsort([rank[grams[:, k]] for k in range(self.n - 1, -1, -1)])
        grams, counts = grams[order], counts[order]
        hashes = self.words.hashes
        parts = phrase_hash([hashes[grams[:, k]] for k in range(max(self.n - 1, 1))]).view(np.int64)
        for at in range(0, len(grams), _ROWS):
            some = slice(at, at + _ROWS)
            columns = [words.take(pa.array(grams[some, k])) for k in range(self.n)]
            yield _rows(self.lang, parts[some], pc.binary_join_element_wise(*columns, b" ") if self.n > 1 else columns[0], counts[some])


def _rows(lang: str, parts: np.ndarray, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(parts)), pa.array(parts, pa.int64()),
                                       phrases.cast(pa.string()), pa.array(counts, pa.int64())], schema=common.arrow_schema(_RUN))


# --------------------------------------------------------------------------- passes over the corpus

def counted(texts: DataFrame, n: int, words: Broadcast | None = None, shorter: Broadcast | None = None) -> DataFrame:
    """lang, phrase, n: phrases of ``n`` words and their counts, of those that the filters let through. For
    n = 1 a row with an empty phrase has the number of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = [Filter(b.value) if b is not None else None for b in (words, shorter)]
        counters: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(common.column(batch, "lang"), common.utf8_column(batch, "text")):
                if lang not in counters:
                    counters[lang] = Counter(lang, n, *filters)
                counters[lang].read(text)
                yield from _relieved(counters)
        for c in counters.values():
            c.count()
            yield from c.runs(0)
            if n == 1:
                yield _rows(c.lang, np.zeros(1, np.int64), pa.array([b""]), np.array([c.total]))

    runs = texts.mapInArrow(run, _RUN_DDL).repartition("part")
    return runs.groupBy("part", "lang", "phrase").agg(F.sum("n").alias("n")).drop("part")


def _relieved(counters: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    """Runs of the counters when they hold too much together."""
    if sum(c.length for c in counters.values()) > 2 * _BLOCK:
        for c in counters.values():
            c.count()
    if sum(len(c.words) for c in counters.values()) > VOCABULARY:
        for c in counters.values():
            c.count()
            yield from c.runs(0)
            c.forget_words()
    elif sum(c.trie.root.size for c in counters.values()) > HELD:
        for c in counters.values():
            yield from c.runs(c.trie.root.size // 2)


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to MAX_WORDS words with ``min_count`` places or
    more, and (lang, n) of every language."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter("text <> ''")
    every = common.stored(counted(texts, 1).filter(f"phrase = '' OR n >= {int(min_count)}"), "phrases-1")
    totals = every.filter("phrase = ''").select("lang", "n")
    last = every.filter("phrase <> ''")
    levels = [last]
    words = shorter = _filter(last)
    for n in range(2, MAX_WORDS + 1):
        last = common.stored(counted(texts, n, words, shorter).filter(F.col("n") >= min_count), f"phrases-{n}")
        levels.append(last)
        if n < MAX_WORDS:
            following = _filter(last)
            if shorter is not words:
                shorter.destroy()
            shorter = following
    out = [level.select("lang", F.lit(n).alias("words"), "phrase", F.col("n").alias("f")) for n, level in enumerate(levels, 1)]
    grams = out[0]
    for part in out[1:]:
        grams = grams.unionByName(part)
    return grams, totals


def _cut(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(grams: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r, score of every candidate at its lowest cut."""
    cuts = grams.filter("words > 1").withColumn("parts", F.split("phrase", " ")) \
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1))) \
        .select("lang", "words", "phrase", F.col("f").alias("a"), "k", _cut(F.col("parts"), 1, F.col("k")).alias("head"),
                _cut(F.col("parts"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = grams.select("lang", "phrase", "f")
    both = cuts.join(part.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"]) \
        .join(part.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"])
    # decimals: 2000000 times a count may pass 64 bits
    score = F.expr(f"CAST((CAST(a AS DECIMAL(20,0)) * {SCALE}BD) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0))) AS LONG)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return both.groupBy("lang", "words", "phrase", "a").agg(lowest) \
        .select("lang", "words", "phrase", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame) -> DataFrame:
    """Candidates without those that mostly stand inside a longer one."""
    inner = candidates.filter("words > 2").withColumn("parts", F.split("phrase", " ")) \
        .withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1))) \
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1))) \
        .select("lang", F.slice("parts", F.col("at"), F.col("m")).alias("some"), "a") \
        .groupBy("lang", F.array_join("some", " ").alias("phrase")).agg(F.max("a").alias("around"))
    return candidates.join(inner, ["lang", "phrase"], "left") \
        .filter(f"around IS NULL OR 100BD * around < {COVERED_PCT}BD * a").drop("around")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of every language: lang, rank, phrase, a, l, r, n, score."""
    grams, totals = frequent_phrases(docs, min_count)
    found = uncovered(common.stored(scored(grams), "phrases-scored"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.documents(spark, sf_dir))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
w AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p),
g AS (SELECT lang, m AS words, array_to_string(ws[i:i + m - 1], ' ') AS phrase
      FROM w, (SELECT unnest(range(1, 5)) AS m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE words > 1 AND f >= 30),
j AS (SELECT c.*, unnest(range(1, words)) AS k FROM c),
h AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS head, array_to_string(ws[k + 1:words], ' ') AS tail FROM j),
s AS (SELECT h.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
      FROM h JOIN f x ON x.lang = h.lang AND x.phrase = h.head JOIN f y ON y.lang = h.lang AND y.phrase = h.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT lang, ws, a, unnest(range(2, words)) AS m, words FROM c WHERE words > 2),
z AS (SELECT lang, ws, a, m, unnest(range(1, words - m + 2)) AS i FROM q),
o AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM z GROUP BY ALL),
t AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE around IS NULL OR 100 * around < 80 * a)
SELECT t.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000
"""
