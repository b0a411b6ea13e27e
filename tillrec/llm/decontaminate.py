"""Benchmark decontamination with a generalised suffix automaton.

The normalised items (A-Z lowered, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) form one automaton
over word numbers. A document's words stream through it; at each word the automaton gives the
longest run of words ending there that occurs in an item. A run of ten or more means that a window
(ten consecutive item words) occurs; an item shorter than ten words is one window, and occurs where
the run covers it whole. Words inside any occurring window are hit. ``remove_contamination`` cuts
hit spans out of the text and rejects documents of which too large a share is hit.

The items are the side whose size is known to be small: their word count is measured first. They
are dealt by hash into as many shards as keep each near ``SHARD_WORDS`` words or below (an item is
never split), one broadcast automaton each, and every document row passes all shards; hits of the
shards are united per row. A larger benchmark costs more passes, never a larger broadcast, and loses nothing.
Documents are only streamed: no shuffle, memory is one Arrow batch and one automaton.

Defined cases: null text has no words (0 hits, not contaminated, kept); null items match nothing and
null item_ids are left out of ``items_sha256`` (their windows still hit); items with equal text all
count; repeated or null doc_ids give one row per input row; an empty benchmark hits nothing; an
empty table gives no rows; extra columns stay (``remove_contamination``) or are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm import common

WINDOW = 10
SHARD_WORDS = 1_000_000          # bound of one broadcast automaton: at most twice as many states
MAX_HIT_PCT = 50                 # a document with more of its words hit is rejected

#: a byte's place in a word: digits, lower-case letters and all of non-ASCII stay, the rest cuts
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
              for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for _, ws in items]
        for word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        # per state: the state of its window-long suffix, items of that window, whole short items
        self.items = [key for key, _ in items]
        self.window_state: list[int] = [0] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[state] >= window:
                up = self.link[state]
                self.window_state[state] = self.window_state[up] if self.length[up] >= window else state
        self.window_items: dict[int, list[int]] = {}
        self.short_items: dict[int, list[int]] = {}
        for n, word_ids in enumerate(coded):
            state = run = 0
            for c in word_ids:
                state, run = self._step(state, run, c)
                if run >= window:
                    self._add(self.window_items, self.window_state[state], n)
            if 0 < len(word_ids) < window:
                self._add(self.short_items, state, n)

    @staticmethod
    def _add(into: dict[int, list[int]], state: int, n: int) -> None:
        have = into.setdefault(state, [])
        if not have or have[-1] != n:
            have.append(n)

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        state = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def _step(self, state: int, run: int, c: int) -> tuple[int, int]:
        """Longest run of words ending with ``c`` that occurs in an item."""
        after = self.next
        while state and c not in after[state]:
            state = self.link[state]
            run = self.length[state]
        if c in after[state]:
            return after[state][c], run + 1
        return 0, 0

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word spans [a, b) in order, united, and the numbers of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        after, link, length, window = self.next, self.link, self.length, self.window
        short = self.short_items
        state = run = 0
        for i, c in enumerate(map(self.vocabulary.get, ws)):
            if c is None:
                state = run = 0
                continue
            t = after[state].get(c)
            while t is None and state:
                state = link[state]
                run = length[state]
                t = after[state].get(c)
            if t is None:
                continue                                  # at the root with run 0
            state = t
            run += 1
            first = i + 1
            if run >= window:
                first = i + 1 - window
                found.update(self.window_items[self.window_state[state]])
            if short:
                s = state
                while s:                                  # whole short items that end here
                    for n in short.get(s, ()):
                        if length[s] <= run:
                            found.add(n)
                            first = min(first, i + 1 - length[s])
                    s = link[s]
            if first <= i:
                while spans and spans[-1][1] >= first:    # join with earlier spans it touches
                    first = min(first, spans.pop()[0])
                spans.append((first, i + 1))
        return spans, found


def shards(benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> list[Broadcast]:
    """One broadcast automaton for each shard of the items; the driver builds one at a time."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    # a word takes two bytes or more with its space, so bytes / 2 bounds the words
    count = max(1, -(-size // (2 * shard_words)))
    keyed = benchmark.select(F.col("item_id").cast("string").alias("item"), "text",
                             F.pmod(F.xxhash64("item_id", "text"), F.lit(count)).alias("shard"))
    out = []
    for n in range(count):
        part = keyed if count == 1 else keyed.filter(F.col("shard") == n)
        rows = [(r["item"], words(r["text"].encode() if r["text"] else None))
                for r in part.select("item", "text").toLocalIterator()]
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        out.append(spark.sparkContext.broadcast(Automaton([r for r in rows if r[1]])))
    return out


def _united(ws: list[bytes], automata: list[Automaton]) -> tuple[list[tuple[int, int]], set[str | None], int]:
    """Hit spans over all shards, ids of the items that occur, and their number."""
    if len(automata) == 1:
        spans, found = automata[0].scan(ws)
        return spans, {automata[0].items[n] for n in found}, len(found)
    every, keys, total = [], set(), 0
    for a in automata:
        spans, found = a.scan(ws)
        every += spans
        keys |= {a.items[n] for n in found}
        total += len(found)
    out: list[tuple[int, int]] = []
    for a, b in sorted(every):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out, keys, total


FIELDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(),
          "items_sha256": pa.string(), "contaminated": pa.bool_(), "longest_hit": pa.int64()}
DDL = ("doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
       "contaminated boolean, longest_hit long")


def contamination(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Hit words and items per document row (columns ``doc_id``, ``text``)."""
    broadcast = shards(benchmark, shard_words)
    schema = common.arrow_schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [b.value for b in broadcast]
        for batch in batches:
            rows = []
            for text in common.utf8_column(batch, "text"):
                ws = words(text)
                spans, keys, total = _united(ws, automata)
                hit = sum(b - a for a, b in spans)
                ids = ",".join(sorted(k for k in keys if k is not None))
                rows.append((len(ws), hit, total, hashlib.sha256(ids.encode()).hexdigest(), hit > 0,
                             max((b - a for a, b in spans), default=0)))
            cols = [batch.column(0).cast(pa.int64())]
            cols += [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(schema)[1:])]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the characters from the first to the last letter of each span of words."""
    folded = text.translate(_FOLD)
    out, done, n, at = [], 0, 0, 0
    bounds = iter(spans)
    span = next(bounds, None)
    start = 0
    while span is not None:
        while at < len(folded) and folded[at] == 32:
            at += 1
        if n == span[0]:
            start = at
        end = folded.find(b" ", at)
        at = len(folded) if end < 0 else end
        n += 1
        if n == span[1]:
            out.append(text[done:start])
            done = at
            span = next(bounds, None)
    out.append(text[done:])
    return b"".join(out)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, min_words: int = 1,
                         max_hit_pct: int = MAX_HIT_PCT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Documents without their hit spans of ``min_words`` words or more (``n_chars`` follows); those
    with more than ``max_hit_pct`` percent of their words hit are rejected. All columns stay."""
    broadcast = shards(benchmark, shard_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [b.value for b in broadcast]
        for batch in batches:
            names = batch.schema.names
            texts, keep, changed = common.utf8_column(batch, "text"), [], {}
            for i, text in enumerate(texts):
                ws = words(text)
                spans, _, _ = _united(ws, automata)
                keep.append(100 * sum(b - a for a, b in spans) <= max_hit_pct * len(ws))
                spans = [s for s in spans if s[1] - s[0] >= min_words]
                if spans and keep[-1]:
                    changed[i] = cut(text, spans)
            if changed:
                i = names.index("text")
                new = [changed.get(n, t) for n, t in enumerate(texts)]
                field = batch.schema.field(i)
                batch = batch.set_column(i, field, pa.array(new, pa.binary()).cast(field.type))
                if "n_chars" in names:
                    i = names.index("n_chars")
                    field = batch.schema.field(i)
                    old = batch.column(i).to_pylist()
                    batch = batch.set_column(i, field, pa.array(
                        [len(changed[n].decode()) if n in changed else v for n, v in enumerate(old)], field.type))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS t
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN w ON w.t = dw.t AND w.n = dw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id),
marks AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g
          FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits)),
longest AS (SELECT doc_id, max(c) AS longest_hit FROM (SELECT doc_id, count(*) AS c FROM marks GROUP BY doc_id, g) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(longest_hit, 0)::BIGINT AS longest_hit
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""
