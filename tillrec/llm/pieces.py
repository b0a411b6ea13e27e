"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised by the model's own rule (a leading space mark, spaces as marks), cut before
each run of space marks, and every chunk is merged by an agenda: a heap of adjacent symbol pairs
whose concatenation is a piece, best score first, leftmost first among equals. Popped pairs whose
symbols have changed since are skipped. Symbols outside the vocabulary become byte pieces, or the
unknown id. The cut is sound because no piece has a space mark after another character (checked
when the model is loaded; otherwise the whole text is one chunk).

Chunks repeat, so each Python worker keeps a bounded cache of chunk -> ids. Every chunk that the
agenda encodes anew is compared with the sentencepiece library in the same Arrow batch
(``check="chunks"``); ``check="documents"`` compares whole texts instead, ``"none"`` neither. The
comparison only fills ``library_equal``; the ids are the agenda's. Decoding is the library's.

Defined cases: null text is empty (the end id alone); rows are independent, so null or repeated
doc_ids give one row each; an empty table gives no rows; extra columns are ignored. A text without
spaces is one chunk: n log n steps, never a quadratic search.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillrec.llm import common

MARK = "▁"
CACHE_CHUNKS = 400_000          # cached chunks in each of a worker's two cache generations
SHORT = 24                      # characters of a chunk whose agenda is a plain list
NONE = float("inf")
CACHED_CHARS = 64               # longer chunks are encoded each time

FIELDS = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(),
          "decoded_sha256": pa.string(), "library_equal": pa.bool_()}
DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, library_equal boolean"


class MergeModel:
    """Vocabulary, scores and the agenda encoder of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        lib = self.library
        usable = [i for i in range(lib.get_piece_size())
                  if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.ids = {lib.id_to_piece(i): i for i in usable}
        self.cost = {lib.id_to_piece(i): -lib.get_score(i) for i in usable}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_fallback = all(lib.is_byte(i) for i in self.bytes)
        self.unknown, self.end = lib.unk_id(), lib.eos_id()
        spanning = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.chunks = None if spanning else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.decimal = list(map(str, range(lib.get_piece_size())))
        self.cache: dict[str, tuple[int, ...]] = {}
        self.last = self.cache
        self.marked = lib.normalize("x") == MARK + "x"

    def merge(self, chunk: str) -> list[str]:
        """Symbols that the agenda leaves of a chunk."""
        return self.merge_long(chunk) if len(chunk) > SHORT else self.merge_short(chunk)

    def merge_short(self, chunk: str) -> list[str]:
        """The agenda as a plain list of the costs of adjacent pairs: quicker than a heap here."""
        cost = self.cost.get
        symbols = list(chunk)
        agenda = [cost(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == NONE:
                break
            i = agenda.index(best)                        # leftmost among equals
            symbols[i] = merged = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = cost(merged + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + merged, NONE)
        return symbols

    def merge_long(self, chunk: str) -> list[str]:
        """The agenda as a heap; pairs whose symbols have changed since are skipped."""
        cost = self.cost
        symbols: list[str | None] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in cost:
                agenda.append((cost[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or after[i] != j or len(left) + len(right) != len(pair):
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = pair + symbols[k]
                if longer in cost:
                    heapq.heappush(agenda, (cost[longer], i, k, longer))
            h = before[i]
            if h >= 0:
                longer = symbols[h] + pair
                if longer in cost:
                    heapq.heappush(agenda, (cost[longer], h, i, longer))
        return [s for s in symbols if s is not None]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(chunk):
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            elif self.byte_fallback:
                out.extend(self.bytes[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return out

    def split(self, normal: str) -> list[str]:
        """Cache keys of a normalised text's chunks: ``word`` for a mark and a word, else a mark
        and the chunk (words hold no mark, so the two don't meet)."""
        if not normal:
            return []
        if self.chunks is None:
            return [MARK + normal]
        if normal[0] == MARK and normal[-1] != MARK and MARK + MARK not in normal:
            return normal[1:].split(MARK)
        return [c[1:] if c[0] == MARK and len(c) > 1 and c[1] != MARK else MARK + c
                for c in self.chunks.findall(normal)]

    def look_up(self, keys: list[str]) -> list[tuple[int, ...] | None]:
        found = list(map(self.cache.get, keys))
        if None in found:                                 # those of the cache's last generation
            for i, x in enumerate(found):
                if x is None and (x := self.last.get(keys[i])) is not None:
                    found[i] = self.cache[keys[i]] = x
        return found

    def encode_all(self, texts: list[str], check: str) -> tuple[list[list[int]], list[bool]]:
        """Ids of whole texts, and whether the library agrees."""
        if len(self.cache) > CACHE_CHUNKS:
            self.cache, self.last = {}, self.cache
        out, agrees = [], []
        for keys in map(self.split, self.library.normalize(texts)):
            found = self.look_up(keys)
            equal = True
            if None in found:
                new = list({k for k, x in zip(keys, found) if x is None})
                chunks = [k[1:] if k[0] == MARK else MARK + k for k in new]
                ids = [self.chunk_ids(c) for c in chunks]
                own = {k: tuple(x) for k, x in zip(new, ids)}
                wrong = {k for k, x, y in zip(new, ids, self.library_ids(chunks)) if x != y} \
                    if check == "chunks" else set()
                equal = not wrong
                self.cache.update((k, x) for k, x in own.items() if len(k) <= CACHED_CHARS and k not in wrong)
                found = [own[k] if x is None else x for k, x in zip(keys, found)]
            found.append((self.end,))
            out.append(list(chain.from_iterable(found)))
            agrees.append(equal)
        if check == "documents":
            agrees = [x == y for x, y in zip(out, self.library.encode(texts, add_eos=True, num_threads=1))]
        return out, agrees

    def digest(self, ids: list[int]) -> str:
        """Hex SHA-256 of the decimal ids, one space between."""
        return hashlib.sha256(" ".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()

    def library_ids(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of chunks; its leading mark stands for a chunk's first mark."""
        lib, marked = self.library, self.marked
        texts, cuts = [], []
        for c in chunks:
            if marked and c[0] == MARK:
                texts.append(c[1:].replace(MARK, " ") if len(c) > 1 else "")
                cuts.append(0 if len(c) > 1 else None)
            else:
                texts.append(c.replace(MARK, " "))
                cuts.append(0)
        found = lib.encode(texts, num_threads=1)
        return [self.chunk_ids(c) if k is None else f for c, k, f in zip(chunks, cuts, found)]


@lru_cache(maxsize=2)
def model(model_file: str) -> MergeModel:
    return MergeModel(model_file)


def encode_decode(docs: DataFrame, model_file: str, check: str = "chunks") -> DataFrame:
    """Digests of every text's ids and of its decoded form (columns ``doc_id``, ``text``)."""
    schema = common.arrow_schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in batches:
            rows: list[tuple] = []
            texts = [t or "" for t in common.column(batch, "text")]
            for at in range(0, len(texts), 256):          # ids of 256 texts in memory at a time
                part = texts[at:at + 256]
                found, agrees = m.encode_all(part, check)
                decoded = m.library.decode(found, num_threads=1)
                rows += [(len(ids), m.digest(ids), hashlib.sha256(back.encode()).hexdigest(), ok)
                         for ids, back, ok in zip(found, decoded, agrees)]
            cols = [batch.column(0).cast(pa.int64())]
            cols += [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(schema)[1:])]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, DDL)


def encode_ids(docs: DataFrame, model_file: str, check: str = "chunks") -> DataFrame:
    """The ids themselves: ``doc_id``, ``ids`` (array of int, end id last)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in batches:
            texts = [t or "" for t in common.column(batch, "text")]
            for at in range(0, len(texts), 256):
                found, _ = m.encode_all(texts[at:at + 256], check)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256).cast(pa.int64()),
                     pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir), default_model())
