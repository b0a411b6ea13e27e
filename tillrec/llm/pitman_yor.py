"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` (A-Z lowered) of a text and one end token. A token's
context is the word before it. Every word of the training texts has a restaurant of its own. Its parent is
the restaurant of its class (63 classes by the last two bytes, one for the text's start, where first words sit);
the classes share one parent over words, whose base is uniform over the V known tokens and one unknown. With discounts f, d, e and strengths s, s, r, for c customers and t tables of word u, class k::

    p(w | u) = (c_uw - f t_uw + (s + f T_u) p(w | k)) / (s + C_u)
    p(w | k) = (c_kw - d t_kw + (s + d T_k) p(w)) / (s + C_k)
    p(w)     = (t_.w - e k_w + (r + e K) / (V + 1)) / (r + T)

A class's customers are its words' tables and, at a text's start, tokens. Seating is sampled by
blocked Gibbs sweeps: a dish's customers leave a restaurant and are seated again one by one by the
Chinese-restaurant rule, given the other dishes; of three such seatings one is drawn by its weight (the
product of the predictive numerators), which corrects for the customers' dish being given. First the
words, then the classes, then the parent. Within a sweep the restaurants' totals are those of the sweep
before, so words are independent and a sweep is one map over them; only the totals (one number per
restaurant) meet on the driver. Restaurants of words below 1/16384 of the tokens, however many, are kept by key and never
meet there: their pairs are dealt by the word before and added up; a pair seen once is one table for good and reaches
the word's part as a count by class, one seen more often with the number of its restaurant's dishes. Its seating takes the
other dishes for a table each, as they are at the start, in all sweeps; the scores count the tables that they have. Seats are stored after every sweep and go on from there. Beyond 64 customers,
blocks of up to j/32 customers are seated at once by a normal draw, so that a dish of any size takes a few hundred
steps. Draws are hashes of (word, restaurant, sweep, step): a lost task is redone with the same result.
Probabilities in a class are averaged over the sweeps after burn-in, as are a word restaurant's own part and
its weight of the class.

Words are dealt to parts by their hash, and pairs of a part are merged in one task. A part holds the words of ``PART_TOKENS``
training tokens at most on average, so their number grows with the corpus. It is kept as rows of arrays, whole words of
about ``BLOCK`` pairs each, that are swept one by one. Rows go to Python, into pages and into row groups by their bytes, not
their number: what Arrow and Parquet hold outside the JVM's heap follows the largest of these.
Tasks read texts in slices of about ``SLICE`` tokens (a long text is several), so memory doesn't follow
the number of tokens in a batch or text, and pairs are added up over slices before they leave a task.

Scoring: words that make up 1/16384 of the tokens or more are broadcast, with their probabilities in every class,
and so are pairs that make up 2^-20 or more. What else a slice needs (a rarer word after its context, once per text; a frequent word
in a word restaurant) goes, packed, to the part that knows it, and its sums come back per text. A token after a rarer word goes to
that word's part, for its weight and what its own customers add, and from there on to the token's part unless the token is
frequent. A frequent word's pairs are dealt by pair, so no part is hot. Words meet as 64-bit hashes.

Defined cases: null text is empty (the end token alone); a null doc_id trains and isn't held out; repeated
rows are separate texts; without training tokens every score is 0; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm import common

CLASSES = 64                     # 0 is the start of a text
FREQUENT = 16384                 # words of at least 1/FREQUENT of the tokens are broadcast, and their restaurants are numbered
HOT = 1 << 20                    # pairs of them of at least 1/HOT of the tokens are broadcast
SLICE = 1 << 17                  # tokens that a task holds at a time
SLICE_BYTES = 1 << 20            # bytes of a text that are split into words at a time
MAX_PIECES = 1 << 15             # texts of a slice
PAIRS = 1 << 20                  # distinct pairs that a task adds up
VOCABULARY = 150_000             # words that a task numbers before it forgets them
TEXTS = 512                      # texts of an Arrow batch that are taken out at a time
BATCH = 1000                     # rows of an Arrow batch
BATCH_BYTES = 1 << 22            # bytes after which a batch takes no more rows
BLOCK = 1 << 18                  # pairs of a row of the model; the last word may go beyond, by a pair for each context
PART_TOKENS = 1 << 22            # training tokens whose pairs are merged, and words looked up, in a task
PARTS = 48                       # at least; not by the session's partitions, so that a text meets as many at any size
SWEEPS, BURN_IN = 3, 1
PARTICLES = 3
STRENGTH, ROOT_STRENGTH = 10.0, 10.0
EXACT = 64                       # customers that are seated one at a time
END = b""                        # no word is empty
RARER = (1 << 16) - CLASSES      # from here on: the class of a rarer word, for its pairs seen more than once
#: Parquet would count 100 rows before it looks at their size
STORED = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(1 << 24), "parquet.enable.dictionary": "false",
          "compression": "zstd"}

# malloc hands every freed array of a slice back to the system, and faults its pages in again for the next, until
# it has seen a large block freed (untouched here); rows of whole parts used to be such blocks
np.empty((1 << 25) - (1 << 16), np.uint8)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class _Vocabulary(dict):
    """Numbers of the words of a task."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


@dataclass
class Slice:
    """Tokens of some texts, end to end: numbers of words and of the words before (0: none), restaurants (the class of
    the word before, or CLASSES + its place in the contexts), and for each piece of a text its start and the text's number."""
    word: np.ndarray
    before: np.ndarray
    context: np.ndarray
    starts: np.ndarray
    text: np.ndarray

    def far(self, size: int) -> np.ndarray:
        """Restaurants of all words before: the numbered ones (less than ``size``), or ``size`` + a rarer word's number."""
        return np.where((self.context > 0) & (self.context < CLASSES), size + self.before, self.context)


def found_at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 for those that aren't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    place = np.searchsorted(keys, wanted)
    place[place == len(keys)] = 0
    place[keys[place] != wanted] = -1
    return place


class Reader:
    """Reads texts in slices; numbers their words, with the hash, class, restaurant and place among the
    ``frequent`` words of each."""

    def __init__(self, contexts: np.ndarray, frequent: np.ndarray | None = None):
        self.contexts = contexts
        self.frequent = np.empty(0, np.int64) if frequent is None else frequent
        self.forget()

    def forget(self) -> None:
        self.vocabulary = _Vocabulary({END: 0})
        self.keys = self.classes = self.restaurant = self.place = np.empty(0, np.int64)
        self._learn()

    def _learn(self) -> None:
        """What is known of the words that are new since the last slice."""
        new = list(islice(self.vocabulary, len(self.keys), None))
        keys = np.array([xxhash.xxh3_64_intdigest(w) for w in new], dtype=np.uint64).view(np.int64)
        classes = np.array([1 + zlib.crc32(w[-2:]) % (CLASSES - 1) for w in new], dtype=np.int64)
        own = found_at(self.contexts, keys)
        values = keys, classes, np.where(own < 0, classes, CLASSES + own), found_at(self.frequent, keys)
        self.keys, self.classes, self.restaurant, self.place = (
            np.concatenate(x) for x in zip((self.keys, self.classes, self.restaurant, self.place), values))

    @property
    def full(self) -> bool:
        return len(self.vocabulary) > VOCABULARY

    def read(self, texts: list[bytes | None]) -> Iterator[Slice]:
        """Slices of texts numbered by their place in the list."""
        number = self.vocabulary.__getitem__
        held: list[tuple[int, int, np.ndarray]] = []           # text, number of the word before (0: start), words
        size = 0
        for no, text in enumerate(texts):
            before = None
            rest = common.slices(text or b"", SLICE_BYTES)
            part = next(rest)
            while part is not None:
                after = next(rest, None)
                ws = common.byte_words(part)
                ids = np.empty(len(ws) + (after is None), dtype=np.int64)
                ids[:len(ws)] = list(map(number, ws))
                ids[len(ws):] = 0
                for at in range(0, len(ids), SLICE):
                    held.append((no, 0 if before is None else number(before), ids[at:at + SLICE]))
                    size += len(held[-1][2])
                    before = ws[min(at + SLICE, len(ws)) - 1] if ws else before
                    if size >= SLICE or len(held) == MAX_PIECES:
                        yield self._slice(held)
                        number = self.vocabulary.__getitem__
                        held, size = [], 0
                part = after
        if held:
            yield self._slice(held)

    def _slice(self, held: list[tuple[int, int, np.ndarray]]) -> Slice:
        self._learn()
        word = np.concatenate([ids for _, _, ids in held])
        sizes = np.array([len(ids) for _, _, ids in held])
        starts = np.cumsum(sizes) - sizes
        before = np.append(0, word[:-1])
        before[starts] = [b for _, b, _ in held]
        return Slice(word, before, np.where(before > 0, self.restaurant[before], 0), starts, np.array([t for t, _, _ in held]))


# ---- counts ------------------------------------------------------------------------------------

@dataclass
class Contexts:
    """Words whose restaurants are numbered: sorted keys, and the class of every numbered restaurant (classes first)."""
    keys: np.ndarray
    klass: np.ndarray


def context_words(docs: DataFrame) -> tuple[Contexts, int]:
    """The words whose restaurants are numbered, and n: those with c >= n // FREQUENT in the training texts, so less than
    2 FREQUENT, and all words of a small corpus. All others' restaurants are kept by key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, n = Reader(np.empty(0, np.int64)), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            # the first word is the end token, which precedes nothing; its row counts all tokens
            return pa.RecordBatch.from_arrays(
                [pa.array(reader.keys[:len(n)], mask=np.arange(len(n)) == 0), pa.array(reader.classes[:len(n)].astype(np.int8)),
                 pa.array(np.append(n.sum(), n[1:]))], names=["key", "class", "n"])

        for ids, texts in some_texts(batches):
            for part in reader.read(training(ids, texts)):
                more = np.bincount(part.word, minlength=len(n))
                more[:len(n)] += n
                n = more
                if reader.full:
                    yield rows()
                    reader.forget()
                    n = np.zeros(0, np.int64)
        if len(n):
            yield rows()

    counts = docs.select("doc_id", "text").mapInArrow(run, "key long, class byte, n long") \
        .groupBy("key").agg(F.max("class").alias("class"), F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), F.col("key").asc_nulls_first()).limit(2 * FREQUENT + 1).collect()
    rows = sorted((r["key"], r["class"]) for r in top[1:] if r["n"] >= top[0]["n"] // FREQUENT)
    return Contexts(np.array([k for k, _ in rows], dtype=np.int64),
                    np.array([*range(CLASSES), *[c for _, c in rows]], dtype=np.int64)), top[0]["n"] if top else 0


def some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes | None]]]:
    """doc_ids and texts, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            part = batch.slice(at, TEXTS)
            yield part.column(0).cast(pa.int64()).to_pylist(), common.utf8_column(part, "text")


def training(ids: list, texts: list[bytes | None]) -> list[bytes | None]:
    return [t for i, t in zip(ids, texts) if not held_out(i)]


#: pairs of words (key; other: contexts), or, by restaurant, of rarer words before (key, class; other: places of their words in words)
COUNTED = "part int, rarer boolean, key binary, size binary, class binary, other binary, words binary, n binary"
#: before, dishes: of the pairs of RARER contexts, the word before and the number of its restaurant's dishes
WORDS = "part int, key binary, size binary, context binary, n binary, before binary, dishes binary"
WORD_COLUMNS = [f.split(" ")[0] for f in WORDS.split(", ")]
STATE = WORDS + ", own binary, t binary, k binary, seats binary, extra binary, mine binary, sums binary"


def _row(schema: str, **values) -> dict:
    """Arrays as bytes; packed in rows that are shuffled by the token."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    held = _packed if schema in (COUNTED, WANTED) else np.ndarray.tobytes
    return {n: held(v) if isinstance(v := values.get(n), np.ndarray) else v for n in names}


def _packed(x: np.ndarray) -> bytes:
    """The length, then an array's bytes, those of one place side by side, compressed."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(b: bytes, kind: type = np.float64) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _record(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in schema.split(", ")]
    return pa.table([pa.array([r[n] for r in rows], t) for n, t in fields], schema=pa.schema(fields))


def _each(table: pa.Table) -> Iterator[dict]:
    """Rows one at a time."""
    for batch in table.to_batches():
        columns = [batch.column(k) for k in range(batch.num_columns)]
        for n in range(batch.num_rows):
            yield {name: column[n].as_py() for name, column in zip(batch.schema.names, columns)}


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Never a batch of no columns or none at all."""
    return iter(table.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], schema=table.schema)])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and their lengths."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return first, np.diff(np.append(first, len(key)))


def _blocks(key: np.ndarray, size: int) -> np.ndarray:
    """Edges of rows of whole words of about ``size`` pairs."""
    first, _ = _groups(key)
    return np.append(first[np.append(True, np.diff(first // size) > 0)], len(key))


def _packed_words(key: np.ndarray, context: np.ndarray, n: np.ndarray, before: np.ndarray, dishes: np.ndarray) -> dict[str, np.ndarray]:
    """Pairs in the order of (key, context, before) as arrays: keys, how many pairs each has, contexts, counts."""
    first, size = _groups(key)
    rarer = context >= RARER
    return {"key": key[first], "size": size.astype(np.int32), "context": context.astype(np.uint16), "n": n.astype(np.int64),
            "before": before[rarer], "dishes": dishes[rarer].astype(np.uint32)}


def _packed_pairs(rarer: bool, key: np.ndarray, other: np.ndarray, n: np.ndarray, klass: np.ndarray) -> dict:
    first, size = _groups(key)
    words = np.empty(0, np.int64)
    if rarer:
        words, other = np.unique(other, return_inverse=True)
    return {"rarer": rarer, "key": key[first], "size": size.astype(np.int32), "class": klass[first].astype(np.int8),
            "other": other.astype(np.int32), "words": words, "n": n.astype(np.int64)}


def pair_counts(docs: DataFrame, contexts: Contexts, parts: int) -> DataFrame:
    """Pairs of the training texts (COUNTED) by the part of the word, or of a rarer word before: a row for each part and
    kind whenever a task has many."""
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        size = len(own.klass)
        reader = Reader(own.keys)
        codes, counts, held = [], [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            code, at = np.unique(np.concatenate(codes), return_inverse=True)
            return code, np.bincount(at, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)

        def rows(code: np.ndarray, count: np.ndarray) -> Iterator[pa.RecordBatch]:
            before, word = code >> 32, reader.keys[code & 0xFFFFFFFF]
            out = []
            for rarer in (False, True):
                some = np.flatnonzero((before >= size) == rarer)
                if not len(some):
                    continue
                u = before[some] - size
                key, other, klass = (reader.keys[u], word[some], reader.classes[u]) if rarer else (word[some], before[some], np.zeros(len(some)))
                part, n = part_of(key, parts), count[some]
                order = np.lexsort((other, key, part))
                key, other, klass, part, n = (x[order] for x in (key, other, klass, part, n))
                first, sizes = _groups(part)
                out += [_row(COUNTED, part=int(part[a]), **_packed_pairs(rarer, key[a:b], other[a:b], n[a:b], klass[a:b]))
                        for a, b in zip(first, first + sizes)]
            yield from _batches(_record(out, COUNTED))

        for ids, texts in some_texts(batches):
            for part in reader.read(training(ids, texts)):
                code, n = np.unique(part.word + (part.far(size) << 32), return_counts=True)
                codes.append(code)
                counts.append(n)
                held += len(code)
                if held > PAIRS or reader.full:
                    code, n = added()
                    codes, counts, held = [code], [n], len(code)
                    if 2 * held > PAIRS or reader.full:
                        yield from rows(code, n)
                        codes, counts, held = [], [], 0
                        reader.forget()
        if held:
            yield from rows(*added())

    return docs.select("doc_id", "text").mapInArrow(run, COUNTED)


def _pairs_of(r: dict) -> tuple[np.ndarray, ...]:
    """key, other, n, class of every pair of a COUNTED row, flat."""
    size, other = _unpacked(r["size"], np.int32), _unpacked(r["other"], np.int32)
    at = np.repeat(np.arange(len(size)), size)
    return (_unpacked(r["key"], np.int64)[at], _unpacked(r["words"], np.int64)[other] if r["rarer"] else other.astype(np.int64),
            _unpacked(r["n"], np.int64), _unpacked(r["class"], np.int8)[at])


def counted_rows(pairs: DataFrame) -> DataFrame:
    """COUNTED: the pairs of a part added up, in rows of whole words, or of whole restaurants of rarer words."""
    def merged(table: pa.Table) -> pa.Table:
        out = []
        for rarer in (False, True):
            found = [_pairs_of(r) for r in _each(table.filter(pc.field("rarer") == rarer))]
            if not found:
                continue
            key, other, n, klass = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((other, key))
            key, other, n, klass = (x[order] for x in (key, other, n, klass))
            at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (other[1:] != other[:-1])))
            key, other, n, klass = key[at], other[at], np.add.reduceat(n, at), klass[at]
            edges = _blocks(key, BLOCK)
            out += [_record([_row(COUNTED, part=table.column("part")[0].as_py(), **_packed_pairs(rarer, key[a:b], other[a:b], n[a:b], klass[a:b]))], COUNTED)
                    for a, b in zip(edges, edges[1:])]
        return pa.concat_tables(out)

    return pairs.groupBy("part").applyInArrow(merged, COUNTED)


def word_rows(counted: DataFrame, parts: int) -> DataFrame:
    """WORDS: all pairs of a word, in rows of whole words; a batch for each row. After rarer words, pairs seen once are
    counted by class, the others keep the word before."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _each(pa.Table.from_batches([batch]))):
            key, other, n, klass = _pairs_of(r)
            none = np.zeros(len(key), np.int64)
            if not r["rarer"]:
                yield from _batches(_record([_row(WORDS, part=r["part"], **_packed_words(key, other, n, none, none))], WORDS))
                continue
            first, sizes = _groups(key)
            once = n == 1
            u, word = np.where(once, 0, key), other
            context = np.where(once, klass, RARER + klass.astype(np.int64))
            dishes, part = np.repeat(sizes, sizes), part_of(word, parts)
            order = np.lexsort((u, context, word, part))
            u, word, context, dishes, part, n = (x[order] for x in (u, word, context, dishes, part, n))
            at = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1]) | (u[1:] != u[:-1])))
            u, word, context, dishes, part, n = u[at], word[at], context[at], dishes[at], part[at], np.add.reduceat(n, at)
            first, sizes = _groups(part)
            yield from _batches(_record([_row(WORDS, part=int(part[a]), **_packed_words(word[a:b], context[a:b], n[a:b], u[a:b], dishes[a:b]))
                                         for a, b in zip(first, first + sizes)], WORDS))

    def merged(table: pa.Table) -> pa.Table:
        found = []
        for r in _each(table):
            w = Words.of(r)
            before, dishes = np.zeros(len(w.n), np.int64), np.zeros(len(w.n), np.int64)
            before[w.context >= RARER], dishes[w.context >= RARER] = w.before, w.dishes
            found.append((w.key[w.owner], w.context, w.n, before, dishes))
        key, context, n, before, dishes = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((before, context, key))
        key, context, n, before, dishes = (x[order] for x in (key, context, n, before, dishes))
        at = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (before[1:] != before[:-1])))
        key, context, n, before, dishes = key[at], context[at], np.add.reduceat(n, at), before[at], dishes[at]
        edges, part = _blocks(key, BLOCK), table.column("part")[0].as_py()
        return pa.concat_tables([_record([_row(WORDS, part=part, **_packed_words(*(x[a:b] for x in (key, context, n, before, dishes))))], WORDS)
                                 for a, b in zip(edges, edges[1:])])

    return counted.mapInArrow(dealt, WORDS).groupBy("part").applyInArrow(merged, WORDS)


# ---- seating -----------------------------------------------------------------------------------

_G = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ALL = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(seed: np.ndarray, step: int) -> np.ndarray:
    """Uniform draws in (0, 1) that depend on nothing but seed and step."""
    x = _mixed(seed + np.uint64((step + 1) * int(_G) & _ALL))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0


def seated(c: np.ndarray, strength: np.ndarray, p: np.ndarray, d: float, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables and log weight of one seating of c customers of a dish, by the Chinese-restaurant rule.

    ``strength`` is s + d times the other dishes' tables, ``p`` the parent's probability of the dish.
    """
    tables, weight = np.ones(len(c)), np.zeros(len(c))
    at = np.flatnonzero(c > 1)
    cc, ss, pp, seeds = c[at].astype(np.float64), strength[at], p[at], seed[at]
    t, w = np.ones(len(at)), np.zeros(len(at))
    j, step = 1, 0
    while len(at):
        m = 1 if j < EXACT else j // 32
        fresh = (ss + d * t) * pp
        total = fresh + (j - d * t)
        new = fresh / total
        u = uniform(seeds, step)
        if m == 1:
            n = (u < new).astype(np.float64)
            w += np.log(total)
        else:
            size = np.minimum(m, cc - j)
            z = np.sqrt(-2 * np.log(u)) * np.cos(2 * math.pi * uniform(seeds, step + (1 << 20)))
            n = np.clip(np.rint(size * new + z * np.sqrt(size * new * (1 - new))), 0, size)
            w += size * np.log(total)
        t += n
        j += m
        step += 1
        on = cc > j
        if not on.all():
            off = ~on
            tables[at[off]], weight[at[off]] = t[off], w[off]
            at, cc, ss, pp, seeds, t, w = at[on], cc[on], ss[on], pp[on], seeds[on], t[on], w[on]
    return tables, weight


def drawn(c: np.ndarray, strength: np.ndarray, p: np.ndarray, d: float, seed: np.ndarray) -> np.ndarray:
    """Tables of one of several seatings, chosen by their weights."""
    out = np.ones(len(c))
    many = np.flatnonzero(c > 1)
    if not len(many):
        return out
    c, strength, p, seed = c[many], strength[many], p[many], seed[many]
    found = [seated(c, strength, p, d, seed + np.uint64((k + 1) * int(_M2) & _ALL)) for k in range(PARTICLES)]
    # the largest of log weight + Gumbel noise is a draw in proportion to the weights
    noisy = np.array([w - np.log(-np.log(uniform(seed, (1 << 21) + k))) for k, (_, w) in enumerate(found)])
    out[many] = np.array([t for t, _ in found])[noisy.argmax(axis=0), np.arange(len(many))]
    return out


@dataclass
class Totals:
    """What the driver knows of the corpus, one set for each sweep so far (the first: a table per dish)."""
    n: int                       # training tokens
    v: int                       # distinct training tokens
    customers: np.ndarray        # tokens per class
    own: np.ndarray              # tokens per word restaurant
    klass: np.ndarray            # of every restaurant
    f: float
    d: float
    e: float
    own_tables: list[np.ndarray]  # per word restaurant, for each sweep
    guests: list[np.ndarray]     # customers per class: tokens after rarer words, tables of its words
    tables: list[np.ndarray]     # per class
    root_tables: list[float]


@dataclass
class Words:
    """The words of a part and their pairs, flat."""
    key: np.ndarray
    owner: np.ndarray            # the word of each pair
    context: np.ndarray
    n: np.ndarray
    before: np.ndarray           # of pairs of RARER contexts, as are
    dishes: np.ndarray

    @staticmethod
    def of(r: dict) -> Words:
        sizes = np.frombuffer(r["size"], np.int32)
        return Words(np.frombuffer(r["key"], np.int64), np.repeat(np.arange(len(sizes)), sizes),
                     np.frombuffer(r["context"], np.uint16).astype(np.int64), np.frombuffer(r["n"], np.int64),
                     np.frombuffer(r["before"], np.int64), np.frombuffer(r["dishes"], np.uint32).astype(np.int64))

    def classes(self, klass: np.ndarray) -> np.ndarray:
        return np.where(self.context >= RARER, self.context - RARER, klass[np.minimum(self.context, len(klass) - 1)])


class Seats:
    """The words of a part as dishes of the restaurants, with a table per dish at first, or as ``r`` left them."""

    def __init__(self, w: Words, klass: np.ndarray, r: dict | None = None):
        self.w = w
        dish, self.dish = np.unique(w.owner * CLASSES + w.classes(klass), return_inverse=True)
        self.owner, self.klass = dish // CLASSES, dish % CLASSES        # of the dishes of classes
        self.first = np.flatnonzero(np.append(True, self.owner[1:] != self.owner[:-1])) if len(dish) else dish
        self.leaves = np.flatnonzero(w.context >= CLASSES)              # pairs in word restaurants
        self.slot = self.dish[self.leaves]
        rarer = w.context[self.leaves] >= RARER
        self.near, self.rarer = np.flatnonzero(~rarer), np.flatnonzero(rarer)   # of the leaves: in numbered restaurants, and in the others
        self.place = w.context[self.leaves[self.near]] - CLASSES
        alone = w.context < CLASSES
        self.direct = np.bincount(self.dish[alone], weights=w.n[alone], minlength=len(dish))
        self.own = np.ones(len(self.leaves))
        self.t, self.k = np.ones(len(dish)), np.ones(len(w.key))
        if r is not None and r.get("k") is not None:
            self.own, self.t, self.k = (np.frombuffer(r[x], np.uint32).astype(np.float64) for x in ("own", "t", "k"))
        self.meet()

    def meet(self) -> None:
        """Customers of the classes' dishes."""
        self.g = self.direct + np.bincount(self.slot, weights=self.own, minlength=len(self.t))

    def customers(self) -> np.ndarray:
        return np.add.reduceat(self.t, self.first) if len(self.first) else np.zeros(len(self.k))

    def totals(self, now_size: int) -> list[np.ndarray]:
        """Tables of the parent, classes and word restaurants; customers of the classes."""
        return [np.concatenate([[self.k.sum()], np.bincount(self.klass, weights=self.t, minlength=CLASSES),
                                np.bincount(self.place, weights=self.own[self.near], minlength=now_size - CLASSES)]),
                np.concatenate([[0.0], np.bincount(self.klass, weights=self.g, minlength=CLASSES),
                                np.zeros(now_size - CLASSES)])]


def sweep(x: Seats, now: Totals, s: int) -> None:
    """Seat everybody again, given the totals after sweep s (0: the start)."""
    w, base = x.w, 1.0 / (now.v + 1)
    word_seed = w.key.view(np.uint64)
    seed = lambda owner, place: _mixed(word_seed[owner] + (place + 1).astype(np.uint64) * _M1)
    pair_seed, own_seed = seed(x.owner, x.klass), seed(w.owner[x.leaves], w.context[x.leaves])
    own_seed[x.rarer] = _mixed(own_seed[x.rarer] ^ w.before.view(np.uint64))
    own, tables, guests, root = now.own_tables[s], now.tables[s], now.guests[s], now.root_tables[s]
    p = ((x.customers() - now.e * x.k + (ROOT_STRENGTH + now.e * root) * base) / (ROOT_STRENGTH + tables.sum()))[x.owner]
    in_class = (x.g - now.d * x.t + (STRENGTH + now.d * tables[x.klass]) * p) / (STRENGTH + guests[x.klass])
    mark = np.uint64((s + 1) << 32)
    others = np.empty(len(x.leaves))             # tables of the restaurant's other dishes
    others[x.near], others[x.rarer] = np.maximum(own[x.place] - x.own[x.near], 0), w.dishes - 1
    x.own = drawn(w.n[x.leaves], STRENGTH + now.f * others, in_class[x.slot], now.f, own_seed + mark)
    x.meet()
    x.t = drawn(x.g, STRENGTH + now.d * np.maximum(tables[x.klass] - x.t, 0), p, now.d, pair_seed + mark)
    x.k = drawn(x.customers(), ROOT_STRENGTH + now.e * np.maximum(root - x.k, 0), np.full(len(x.k), base), now.e, word_seed + mark)


@dataclass
class Averages:
    """What the kept sweeps give a word: ``seats``, its customers less e per table in the parent (a row for each
    sweep), ``extra``, what its own customers add in a class, and ``mine``, the same in a numbered restaurant, and its tables
    in the others."""
    seats: np.ndarray
    extra: np.ndarray
    mine: np.ndarray

    @staticmethod
    def of(r: dict, x: Seats) -> Averages:
        if r.get("extra") is None:
            return Averages(np.empty((0, len(x.k))), np.zeros(len(x.t)), np.zeros(len(x.own)))
        return Averages(np.frombuffer(r["seats"]).reshape(-1, len(x.k)), np.frombuffer(r["extra"], np.float32).astype(np.float64),
                        np.frombuffer(r["mine"], np.float32).astype(np.float64))

    def plus(self, x: Seats, now: Totals, s: int) -> Averages:
        """With the state after sweep s."""
        mine = x.own.copy()
        mine[x.near] = (x.w.n[x.leaves[x.near]] - now.f * x.own[x.near]) / (STRENGTH + now.own[x.place])
        return Averages(np.concatenate([self.seats, (x.customers() - now.e * x.k)[None, :]]),
                        self.extra + (x.g - now.d * x.t) / (STRENGTH + now.guests[s][x.klass]) / (SWEEPS - BURN_IN),
                        self.mine + mine / (SWEEPS - BURN_IN))


def _summed(words: DataFrame, size: int, names: list[str], of) -> dict[str, np.ndarray]:
    """Sums over the parts of what ``of`` gives for each, by restaurant (the first: the parent): at most
    1 + CLASSES + FREQUENT rows on the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 + size))
        for batch in batches:
            for n in range(batch.num_rows):
                total += of(batch.slice(n, 1).to_pylist()[0])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(x[at]) for x in total]], names=["place", *names])

    rows = words.mapInArrow(run, "place int, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).collect()
    out = {n: np.zeros(1 + size) for n in names}
    for r in rows:
        for n in names:
            out[n][r["place"]] = r[n]
    return out


def first_totals(words: DataFrame, contexts: Contexts) -> Totals:
    """Counts of the corpus; discounts from the pairs, dishes of classes and words seen once and twice."""
    klass = contexts.klass
    size = len(klass)

    def of(r: dict) -> list[np.ndarray]:
        w = Words.of(r)
        x = Seats(w, klass)
        count = np.bincount(x.owner, minlength=len(w.key))
        own_n = w.n[x.leaves]
        by = lambda at, n, length: np.bincount(at, weights=np.asarray(n, dtype=np.float64), minlength=length)
        # the last place: pairs after rarer words; those seen once are counted in the classes of words
        after = {1: w.n[(w.context > 0) & (w.context < CLASSES)].sum(), 2: (own_n[x.rarer] == 2).sum()}
        seen = lambda k: np.concatenate([[(count == k).sum()], by(x.klass, x.g == k, CLASSES),
                                         by(x.place, own_n[x.near] == k, size - CLASSES), [after[k]]])
        tokens_at = np.concatenate([[0.0], by(w.classes(klass), w.n, CLASSES), by(x.place, own_n[x.near], size - CLASSES), [0.0]])
        return [tokens_at, *[np.append(t, 0.0) for t in x.totals(size)], seen(1), seen(2)]

    got = _summed(words, size + 1, ["n", "tables", "guests", "once", "twice"], of)
    discount = lambda a, b: float(np.clip(a / (a + 2 * b) if a + b else 0.5, 0.05, 0.95))
    levels = slice(0, 1), slice(1, CLASSES + 1), slice(CLASSES + 1, None)
    e, d, f = (discount(got["once"][x].sum(), got["twice"][x].sum()) for x in levels)
    n, tables = got["n"][:-1], got["tables"][:-1]
    return Totals(int(n[levels[1]].sum()), int(tables[0]), n[levels[1]], n[levels[2]], klass, f, d, e,
                  [tables[levels[2]]], [got["guests"][levels[1]]], [tables[levels[1]]], [float(tables[0])])


def next_state(words: DataFrame, now: Totals, s: int) -> DataFrame:
    """STATE after sweep s, from the rows after sweep s - 1; ``sums`` are the totals of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                w = Words.of(r)
                x = Seats(w, now.klass, r)
                kept = Averages.of(r, x)
                if s - 1 > BURN_IN:
                    kept = kept.plus(x, now, s - 1)
                sweep(x, now, s - 1)
                averages = {} if s - 1 <= BURN_IN else {"seats": kept.seats, "extra": kept.extra.astype(np.float32), "mine": kept.mine.astype(np.float32)}
                yield from _batches(_record([_row(
                    STATE, **{k: r[k] for k in WORD_COLUMNS}, own=x.own.astype(np.uint32), t=x.t.astype(np.uint32),
                    k=x.k.astype(np.uint32), sums=np.array(x.totals(len(now.klass))), **averages)], STATE))

    return words.mapInArrow(run, STATE)


def next_totals(state: DataFrame, now: Totals) -> Totals:
    """Totals with those of one more sweep."""
    size = len(now.klass)
    got = _summed(state.select("sums"), size, ["tables", "guests"], lambda r: np.frombuffer(r["sums"]).reshape(2, -1))
    return replace(now, own_tables=[*now.own_tables, got["tables"][CLASSES + 1:]],
                   guests=[*now.guests, got["guests"][1:CLASSES + 1]], tables=[*now.tables, got["tables"][1:CLASSES + 1]],
                   root_tables=[*now.root_tables, float(got["tables"][0])])


@dataclass
class Model:
    """``state``: seats after the last sweep, some rows per part. For each kept sweep: ``back``, the parent's
    weight by class; ``norm``, what a seat is worth; ``unknown``, the parent's probability of an unknown
    word. ``own_back``: the class's weight by numbered restaurant, averaged. ``counted``: pairs, with the restaurants of
    rarer words."""
    state: DataFrame
    counted: DataFrame
    totals: Totals
    contexts: Contexts
    parts: int
    back: np.ndarray
    norm: np.ndarray
    unknown: np.ndarray
    own_back: np.ndarray


@dataclass
class PartValues:
    """A part of the model, or a row of one: words in the order of their keys, with counts, seats of the kept sweeps, and
    codes (word and class, word and context) with what they add."""
    key: np.ndarray
    c: np.ndarray
    seats: np.ndarray
    classes: np.ndarray
    extra: np.ndarray
    pairs: np.ndarray
    mine: np.ndarray
    n: np.ndarray                # of the pairs

    @staticmethod
    def of(r: dict, now: Totals) -> PartValues:
        w = Words.of(r)
        x = Seats(w, now.klass, r)
        kept, leaves = Averages.of(r, x).plus(x, now, SWEEPS), x.leaves[x.near]
        return PartValues(w.key, np.bincount(w.owner, weights=w.n, minlength=len(w.key)).astype(np.int64), kept.seats,
                          x.owner * CLASSES + x.klass, kept.extra, w.owner[leaves] * len(now.klass) + CLASSES + x.place, kept.mine[x.near], w.n[leaves])

    @staticmethod
    def joined(rows: Iterator[dict], now: Totals) -> PartValues | None:
        """The rows of a part as one; words of a row lie between those of the others."""
        found = sorted((PartValues.of(r, now) for r in rows), key=lambda v: v.key[0])
        if len(found) < 2:
            return found[0] if found else None
        before = np.cumsum([0, *[len(v.key) for v in found[:-1]]])
        flat = lambda arrays: np.concatenate(list(arrays))
        return PartValues(flat(v.key for v in found), flat(v.c for v in found), np.concatenate([v.seats for v in found], axis=1),
                          flat(v.classes + b * CLASSES for b, v in zip(before, found)), flat(v.extra for v in found),
                          flat(v.pairs + b * len(now.klass) for b, v in zip(before, found)), flat(v.mine for v in found), flat(v.n for v in found))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python a thousand at a time, rows of the model by their bytes; the session's own batch sizes
    come back afterwards."""
    name = "spark.sql.execution.arrow.max{}PerBatch"
    wanted = {name.format("Records"): str(BATCH), name.format("Bytes"): str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fit(docs: DataFrame) -> Model:
    with small_batches(docs.sparkSession):
        return _fitted(docs)


def _fitted(docs: DataFrame) -> Model:
    contexts, n = context_words(docs)
    parts = max(PARTS, n // PART_TOKENS)
    counted = common.stored(counted_rows(pair_counts(docs, contexts, parts)), "pitman-yor-pairs", **STORED)
    state = common.stored(word_rows(counted, parts), "pitman-yor-words", **STORED)
    now = first_totals(state, contexts)
    for s in range(1, SWEEPS + 1):
        state = common.stored(next_state(state, now, s), "pitman-yor-seats", **STORED)
        now = next_totals(state, now)
    kept = range(BURN_IN + 1, SWEEPS + 1)
    back = np.array([(STRENGTH + now.d * now.tables[s]) / (STRENGTH + now.guests[s]) for s in kept])
    norm = np.array([1 / (ROOT_STRENGTH + now.tables[s].sum()) for s in kept])
    unknown = np.array([(ROOT_STRENGTH + now.e * now.root_tables[s]) / (now.v + 1) for s in kept]) * norm
    own_back = np.mean([(STRENGTH + now.f * now.own_tables[s]) / (STRENGTH + now.own) for s in kept], axis=0)
    return Model(state, counted, now, contexts, parts, back, norm, unknown, own_back)


# ---- scores ------------------------------------------------------------------------------------

@dataclass
class Frequent:
    """Frequent words: sorted keys, probability by class, log10(c + 1); their hot pairs: sorted codes of
    place and context, what the word restaurant adds. ``klass``, ``weight``: of every restaurant."""
    keys: np.ndarray
    p: np.ndarray
    log_c: np.ndarray
    pairs: np.ndarray
    own: np.ndarray
    contexts: np.ndarray
    klass: np.ndarray
    weight: np.ndarray


def frequent_words(model: Model) -> Frequent:
    """At most FREQUENT words, those with c >= n / FREQUENT, and at most HOT pairs."""
    now, size = model.totals, len(model.contexts.klass)
    norm, unknown, back = model.norm, model.unknown, model.back

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                v = PartValues.of(batch.slice(n, 1).to_pylist()[0], now)
                often = np.flatnonzero(v.c * FREQUENT >= now.n)
                p = np.zeros((len(often), CLASSES))
                roots = (v.seats[:, often] * norm[:, None] + unknown[:, None]).T
                p += roots @ back / len(back)
                at = found_at(often, v.classes // CLASSES)
                mine = np.flatnonzero(at >= 0)
                p[at[mine], v.classes[mine] % CLASSES] += v.extra[mine]
                at = found_at(often, v.pairs // size)
                hot = np.flatnonzero((at >= 0) & (v.n * HOT >= now.n))
                yield from _batches(_record([_row("key binary, c binary, p binary, word binary, context binary, own binary", key=v.key[often], c=v.c[often], p=p,
                                                  word=v.key[often][at[hot]], context=v.pairs[hot] % size, own=v.mine[hot])],
                                            "key binary, c binary, p binary, word binary, context binary, own binary"))

    rows = model.state.mapInArrow(run, "key binary, c binary, p binary, word binary, context binary, own binary").collect() if now.n else []
    joined = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows]) if rows else np.empty(0, kind)
    key, p = joined("key", np.int64), joined("p", np.float64).reshape(-1, CLASSES)
    order = np.argsort(key)
    keys = key[order]
    codes = found_at(keys, joined("word", np.int64)) * size + joined("context", np.int64)
    by_code = np.argsort(codes)
    return Frequent(keys, p[order], np.log10(joined("c", np.int64)[order] + 1.0), codes[by_code], joined("own", np.float64)[by_code],
                    model.contexts.keys, model.contexts.klass, np.append(np.ones(CLASSES), model.own_back))


#: of a slice: sums over its pieces (row, doc_id .. log_p), words to look up (key, size, row, context, n), pairs to look up (code, row, n),
#: tokens after rarer words (key before, size, row, word, n, class; the word is a place among the frequent words, or beyond them in g);
#: of the model: frequent words' pairs, restaurants of rarer words (key, size, place of a word in e, n) and their pairs' tables (key, key, tables);
#: on the way: rarer tokens after rarer words (steps of row, keys, place of a key, class, n, the weight of the class and what the restaurant adds)
WANTED = "part int, kind int, row binary, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
SUMS, WORD, PAIR, OWN, BEFORE, PLACES, TABLES, AFTER = range(8)
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, log_c double, log_p double"


def _split(part: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays by part, in the order of the first."""
    order = np.lexsort((arrays[0], part))
    part, arrays = part[order], [x[order] for x in arrays]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else [], len(part)).astype(np.int64)
    for a, b in zip(edges, edges[1:]):
        yield int(part[a]), [x[a:b] for x in arrays]


def wanted(docs: DataFrame, frequent: Broadcast, parts: int) -> DataFrame:
    """WANTED rows of all texts. ``row`` numbers texts by task and place, so a redone task repeats it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        size = len(often.klass)
        reader = Reader(often.contexts, often.keys)
        row = TaskContext.get().partitionId() << 40
        for ids, texts in some_texts(batches):
            for s in reader.read(texts):
                yield from _batches(_record(list(_asked(s, reader, often, size, row, ids, parts)), WANTED))
                if reader.full:
                    reader.forget()
            row += len(ids)

    return docs.select("doc_id", "text").mapInArrow(run, WANTED)


def _asked(s: Slice, reader: Reader, often: Frequent, size: int, row: int, ids: list, parts: int) -> Iterator[dict]:
    n, words = len(s.starts), len(reader.keys)
    lengths = np.diff(np.append(s.starts, len(s.word)))
    wide = size + words
    code, count = np.unique((np.repeat(np.arange(n), lengths) * words + s.word) * wide + s.far(size), return_counts=True)
    far, word, piece = code % wide, code // wide % words, code // wide // words
    after = far >= size                          # a rarer word
    before = np.where(after, far - size, 0)
    context = np.where(after, reader.classes[before], far)
    klass, weight = often.klass[context], often.weight[context]
    at = reader.place[word]
    frequent, own = at >= 0, context >= CLASSES
    hot = found_at(often.pairs, np.where(frequent, at * size + context, -1))
    ready = frequent & ~after & (~own | (hot >= 0))
    p = np.zeros(len(code))
    p[ready] = weight[ready] * often.p[at[ready], klass[ready]]
    p[hot >= 0] += often.own[hot[hot >= 0]]
    add = lambda rows, values: np.bincount(piece[rows], weights=values * count[rows], minlength=n)
    doc = [ids[t] for t in s.text.tolist()]
    yield _row(WANTED, part=int(part_of(np.array([row + s.text[0]]), parts)[0]), kind=SUMS, row=row + s.text,
               a=np.array([0 if i is None else i for i in doc], np.int64), b=np.array([2 if i is None else held_out(i) for i in doc], np.int8),
               c=lengths, d=add(frequent, np.ones(int(frequent.sum()))), e=add(frequent, often.log_c[at[frequent]]), f=add(ready, np.log10(p[ready])))
    rows = s.text - s.text[0]
    base = np.array([row + s.text[0]])
    rare = np.flatnonzero(~frequent & ~after)
    keys = reader.keys[word[rare]]
    for part, (key, r, k, c) in _split(part_of(keys, parts), keys, rows[piece[rare]], context[rare], count[rare]):
        first, times = _groups(key)
        yield _row(WANTED, part=part, kind=WORD, row=base, a=key[first], b=times.astype(np.uint32), c=r.astype(np.uint16),
                   d=k.astype(np.uint16), e=c.astype(np.uint32))
    pair = np.flatnonzero(frequent & ~ready & ~after)
    codes = at[pair] * size + context[pair]
    for part, (asked, r, c) in _split(part_of(codes, parts), codes, rows[piece[pair]], count[pair]):
        yield _row(WANTED, part=part, kind=PAIR, row=base, a=asked.astype(np.uint32), c=r.astype(np.uint16), e=c.astype(np.uint32))
    some = np.flatnonzero(after)
    keys = reader.keys[before[some]]
    for part, (key, r, w, f, k, c) in _split(part_of(keys, parts), keys, rows[piece[some]], word[some], at[some], klass[some], count[some]):
        first, times = _groups(key)
        others, beyond = np.unique(reader.keys[w[f < 0]], return_inverse=True)
        f[f < 0] = len(often.keys) + beyond
        yield _row(WANTED, part=parts + part, kind=BEFORE, row=base, a=key[first], b=times.astype(np.uint32), c=r.astype(np.uint16), d=f.astype(np.int32),
                   e=c.astype(np.uint32), f=k[first].astype(np.int8), g=others)


def own_pairs(model: Model, frequent: Broadcast) -> DataFrame:
    """What frequent words' own customers add in word restaurants, dealt by pair (kind OWN: a codes, f values)."""
    now, parts, size = model.totals, model.parts, len(model.contexts.klass)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                v = PartValues.of(batch.slice(n, 1).to_pylist()[0], now)
                at = found_at(frequent.value.keys, v.key)[v.pairs // size]
                some = np.flatnonzero(at >= 0)
                codes = at[some] * size + v.pairs[some] % size
                yield from _batches(_record([_row(WANTED, part=p, kind=OWN, a=c.astype(np.uint32), f=x.astype(np.float32))
                                             for p, (c, x) in _split(part_of(codes, parts), codes, v.mine[some])], WANTED))

    return model.state.mapInArrow(run, WANTED)


def restaurants(model: Model) -> DataFrame:
    """Restaurants of rarer words (PLACES), and how many tables their pairs seen more than once have on average (TABLES; the
    others have one), beside the parts of words."""
    now, parts = model.totals, model.parts

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _each(pa.Table.from_batches([batch]))):
            yield from _batches(_record([_row(WANTED, part=parts + r["part"], kind=PLACES, a=r["key"], b=r["size"], c=r["other"], d=r["n"],
                                              e=r["words"])], WANTED))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in _each(pa.Table.from_batches([batch]))):
            w = Words.of(r)
            x = Seats(w, now.klass, r)
            mean, word = Averages.of(r, x).plus(x, now, SWEEPS).mine[x.rarer], w.key[w.owner[x.leaves[x.rarer]]]
            yield from _batches(_record([_row(WANTED, part=parts + p, kind=TABLES, a=a, c=c, f=f.astype(np.float32))
                                         for p, (a, c, f) in _split(part_of(w.before, parts), w.before, word, mean)], WANTED))

    return model.counted.where("rarer").mapInArrow(places, WANTED).unionByName(model.state.drop("sums").mapInArrow(tables, WANTED))


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(before.view(np.uint64)) + word.view(np.uint64)).view(np.int64)


class Restaurants:
    """Rarer words' restaurants of a part: the weight of the class, what a pair's own customers add."""

    def __init__(self, rows: pa.Table, now: Totals):
        rows = [{k: x for k, x in r.items() if x is not None} for r in _each(rows.filter(pc.field("kind").isin([PLACES, TABLES])))]
        flat = lambda kind, of, dtype: np.concatenate([np.empty(0, dtype), *[of(r) for r in rows if r["kind"] == kind]])
        column = lambda kind, name, dtype: flat(kind, lambda r: _unpacked(r[name], dtype), dtype)
        key, size, n = column(PLACES, "a", np.int64), column(PLACES, "b", np.int32), column(PLACES, "d", np.int64).astype(np.float64)
        owner = np.repeat(np.arange(len(key)), size)
        pairs = _pair_keys(key[owner], flat(PLACES, lambda r: _unpacked(r["e"], np.int64)[_unpacked(r["c"], np.int32)], np.int64))
        order = np.argsort(pairs)
        self.pairs, n, owner = pairs[order], n[order], owner[order]
        tables = np.ones(len(n))
        tables[found_at(self.pairs, _pair_keys(column(TABLES, "a", np.int64), column(TABLES, "c", np.int64)))] = column(TABLES, "f", np.float32)
        customers, total = (np.bincount(owner, weights=x, minlength=len(key)) for x in (n, tables))
        self.mine = (n - now.f * tables) / (STRENGTH + customers[owner])
        order = np.argsort(key)
        self.key, self.weight = key[order], ((STRENGTH + now.f * total) / (STRENGTH + customers))[order]

    def of(self, before: np.ndarray, times: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and own part of tokens after words, each of them ``times`` times; unknown words have no restaurant."""
        at = found_at(self.key, before)
        weight = np.where(at >= 0, self.weight[at], 1.0) if len(self.key) else np.ones(len(at))
        at = found_at(self.pairs, _pair_keys(np.repeat(before, times), word))
        return np.repeat(weight, times), np.where(at >= 0, self.mine[at], 0.0) if len(self.pairs) else np.zeros(len(at))


def _in_class(values: PartValues | None, model: Model, asked: np.ndarray, times: np.ndarray, klass: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words, each ``times`` times in a class: place in the part (-1: unknown), count, probability in the class."""
    at = found_at(values.key, asked) if values is not None else np.full(len(asked), -1)
    c = np.where(at >= 0, values.c[at], 0) if values is not None else np.zeros(len(asked))
    seats = np.where(at >= 0, values.seats[:, at], 0) if values is not None else np.zeros((len(model.norm), len(asked)))
    at = np.repeat(at, times)
    roots = np.repeat(seats * model.norm[:, None] + model.unknown[:, None], times, axis=1)
    p = (roots * model.back[:, klass]).sum(axis=0) / len(model.back)
    if values is not None:
        known = np.flatnonzero(at >= 0)
        extra = found_at(values.classes, at[known] * CLASSES + klass[known])
        p[known] += np.where(extra >= 0, values.extra[extra], 0)
    return at, np.repeat(c, times), p


def _answers(rows: pa.Table, state: pa.Table, model: Model, often: Frequent) -> pa.Table:
    """WANTED rows of a part: sums of each text's words and pairs that the part knows (SUMS), and what other parts are to add (AFTER)."""
    now, size = model.totals, len(model.contexts.klass)
    values = PartValues.joined(_each(state), now)
    ours = list(_each(rows.filter(pc.field("kind") == OWN)))
    own_codes = np.concatenate([_unpacked(r["a"], np.uint32) for r in ours]).astype(np.int64) if ours else np.empty(0, np.int64)
    order = np.argsort(own_codes)
    own_codes, own_values = own_codes[order], (np.concatenate([_unpacked(r["f"], np.float32) for r in ours]) if ours else np.empty(0, np.float32))[order]
    places = Restaurants(rows, now)
    out: list[tuple[np.ndarray, ...]] = []
    later: list[tuple[np.ndarray, ...]] = []
    answer: list[dict] = []
    for r in _each(rows.filter(~pc.field("kind").isin([OWN, PLACES, TABLES]))):
        kind = r["kind"]
        if kind == SUMS:
            answer.append(r)
            continue
        n = _unpacked(r["e"], np.uint32).astype(np.float64)
        if kind == AFTER:
            klass, keys = _unpacked(r["d"], np.int8).astype(np.int64), _unpacked(r["a"], np.int64)[_unpacked(r["b"], np.int32)]
            _, c, p = _in_class(values, model, keys, np.ones(len(n), np.int64), klass)
            weight, own = _unpacked(r["f"], np.float32).reshape(2, -1)
            out.append((np.cumsum(_unpacked(r["row"], np.int64)), n * (c > 0), n * np.log10(c + 1.0), n * np.log10(weight * p + own)))
            continue
        base, place = _unpacked(r["row"], np.int64)[0], _unpacked(r["c"], np.uint16).astype(np.int64)
        known = log_c = np.zeros(len(n))
        if kind == BEFORE:
            before, times, word = _unpacked(r["a"], np.int64), _unpacked(r["b"], np.uint32), _unpacked(r["d"], np.int32)
            klass = np.repeat(_unpacked(r["f"], np.int8), times).astype(np.int64)
            keys = np.append(often.keys, _unpacked(r["g"], np.int64))[word]
            weight, own = places.of(before, times, keys)
            rare = word >= len(often.keys)
            later.append(tuple(x[rare] for x in (base + place, keys, klass, n, weight, own)))
            place, word, klass, n, weight, own = (x[~rare] for x in (place, word, klass, n, weight, own))
            known = log_c = np.zeros(len(n))
            p = weight * often.p[word, klass] + own
        elif kind == WORD:
            times, context = _unpacked(r["b"], np.uint32), _unpacked(r["d"], np.uint16).astype(np.int64)
            at, c, in_class = _in_class(values, model, _unpacked(r["a"], np.int64), times, often.klass[context])
            own = np.zeros(len(n))
            if values is not None and len(values.mine):
                here = np.flatnonzero(at >= 0)
                mine = found_at(values.pairs, at[here] * size + context[here])
                own[here] = np.where(mine >= 0, values.mine[mine], 0)
            p = often.weight[context] * in_class + own
            known, log_c = n * (c > 0), n * np.log10(c + 1.0)
        else:
            asked = _unpacked(r["a"], np.uint32).astype(np.int64)
            word, context = asked // size, asked % size
            mine = found_at(own_codes, asked)
            p = often.weight[context] * often.p[word, often.klass[context]] + (np.where(mine >= 0, own_values[mine], 0) if len(own_values) else 0)
        texts = np.flatnonzero(np.bincount(place))
        out.append((base + texts, *[np.bincount(place, weights=x)[texts] for x in (known, log_c, n * np.log10(p))]))
    if out:
        text, at = np.unique(np.concatenate([o[0] for o in out]), return_inverse=True)
        known, log_c, log_p = (np.bincount(at, weights=np.concatenate([o[k] for o in out]), minlength=len(text)) for k in (1, 2, 3))
        none = np.zeros(len(text), np.int64)
        answer.append(_row(WANTED, part=rows.column("part")[0].as_py() % model.parts, kind=SUMS, row=text, a=none, b=np.full(len(text), 2, np.int8), c=none,
                           d=known, e=log_c, f=log_p))
    if later:
        row, word, klass, n, weight, own = (np.concatenate(x) for x in zip(*later))
        for part, (r, w, k, c, x, y) in _split(part_of(word, model.parts), row, word, klass, n, weight, own):
            keys, at = np.unique(w, return_inverse=True)
            answer.append(_row(WANTED, part=part, kind=AFTER, row=np.diff(r, prepend=0), a=keys, b=at.astype(np.int32), d=k.astype(np.int8), e=c.astype(np.uint32),
                               f=np.concatenate([x, y]).astype(np.float32)))
    return _record(answer, WANTED)


def _scored(rows: pa.Table) -> pa.Table:
    """SCORED rows of SUMS."""
    sums = []
    for r in _each(rows):
        b = _unpacked(r["b"], np.int8)
        sums.append(pa.table([pa.array(_unpacked(r["row"], np.int64)), pa.array(_unpacked(r["a"], np.int64), mask=b == 2), pa.array(b == 1),
                              pa.array(_unpacked(r["c"], np.int64)), pa.array(np.rint(_unpacked(r["d"])).astype(np.int64)),
                              pa.array(_unpacked(r["e"])), pa.array(_unpacked(r["f"]))], names=_NAMES))
    return pa.concat_tables(sums) if sums else _record([], SCORED)


_NAMES = [f.split(" ")[0] for f in SCORED.split(", ")]


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of all texts (columns ``doc_id``, ``text``), training and held out."""
    often = frequent_words(model)
    shared = docs.sparkSession.sparkContext.broadcast(often)
    bare = replace(model, state=None, counted=None)   # tasks get the numbers, not the frames
    asked = wanted(docs, shared, model.parts).unionByName(own_pairs(model, shared)).unionByName(restaurants(model))
    state = model.state.drop("sums").groupBy("part")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return _answers(left, right, bare, shared.value)

    def last(left: pa.Table, right: pa.Table) -> pa.Table:
        return _scored(_answers(left, right, bare, shared.value))

    # parts know words; as many beside them know the restaurants of rarer words
    half = asked.groupBy("part").cogroup(state).applyInArrow(answer, WANTED)
    found = half.groupBy("part").cogroup(state).applyInArrow(last, SCORED)
    per_text = found.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.bool_or("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"), F.sum("log_c").alias("log_c"), F.sum("log_p").alias("score"))
    size = float(np.log10(model.totals.n + model.totals.v + 1))
    with small_batches(docs.sparkSession):
        per_text = common.stored(per_text, "pitman-yor-scores")
    return per_text.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.totals.n).cast("long").alias("train_tokens"),
        (F.col("log_c") - F.col("n_tokens") * F.lit(size)).alias("base_score"), "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return scores(docs, fit(docs))
