"""Personal data in whole texts, with offset-preserving deobfuscation.

Base kinds are plain patterns on the source text: leftmost, non-overlapping, each kind by itself;
a match that fails its check (ip parts, Luhn, digit counts) is dropped without a retry.

On top, transducers rewrite a text into a normal form and remember where each piece came from:

1. homoglyphs, one character for one: compatibility forms of ASCII (wide, styled, circled) and
   Cyrillic or Greek letters that look like Latin ones;
2. invisible characters are dropped;
3. bracketed ``(at)`` / ``[dot]``, spelled ``name at host dot ending`` and spaced ``name @ host . ending``
   (any top-level domain) become ``@`` and ``.``;
4. runs of spelled digits, ``plus``, ``dot``, ``double``, ``triple`` and plain digits become digits where
   they then, with the digits beside them, pass the check of an ip, a card or a phone number; others do
   from seven spelled digits on. So do letters posing as digits inside long digit runs.

The same patterns run on the normal form; a find that touches a rewritten piece is mapped back to
source characters and added unless it overlaps a base span of its kind. Base spans always stay.
A spelled run of 9 to 15 digits without a plus sign that is no card counts as a phone number.

All of it is per row: no shuffle, memory is one Arrow batch, time is linear in the text (patterns
are possessive or anchored at run starts).

Defined cases: null text is empty (no spans, digest of the empty string); null or repeated doc_ids
give one row per input row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillrec.llm import common
from tillrec.llm.endings import ENDINGS

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NON_DIGITS = re.compile(r"[^0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """The pattern from its ``@`` outwards: the local part is the run of its characters to the left,
    up to the last match; quick and linear also in texts without one."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1                                # what lies left of a failed @ can't match again
        at = text.find("@", done)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in _CARD.finditer(text):
        digits = _NON_DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NON_DIGITS.sub("", m[0])) <= 15]


def plain(text: str) -> dict[str, list[Span]]:
    """Base spans of every kind."""
    numeric = _DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if numeric else [],
            "card": cards(text) if numeric else [], "phone": phones(text) if numeric else []}


# ---- transducers -------------------------------------------------------------------------------

# fixed values: letters of other scripts that look like Latin ones
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "һ": "h", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K",
    "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i",
    "ı": "i", "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
# endings that are words too, which after an article are prose
ENDING_WORDS = ("am", "as", "at", "be", "by", "do", "he", "in", "is", "it", "me", "my", "no", "so", "to", "us")
INVISIBLE = "­​‌‍⁠﻿"
# FIXED VALUES: the digits 0 to 9 in English, German, Spanish and French
SPELLED_DIGITS = (
    "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve", "zéro un deux trois quatre cinq six sept huit neuf",
)
DIGIT_WORDS = {"oh": "0", **{w: str(d) for words in SPELLED_DIGITS for d, w in enumerate(words.split())}}
MIN_SPELLED = 7                  # of a run that passes no check by itself
COUNTING = ("0123456789", "9876543210")   # counting up or down is prose


def _compatibility() -> dict[int, str]:
    """Characters whose compatibility form is one printable ASCII character, or that are digits."""
    out = {ord(k): v for k, v in LOOKALIKES.items()}
    for code in (*range(0x2000, 0x2500), *range(0x660, 0x1000), *range(0xff00, 0xff5f), *range(0x1d400, 0x1d800)):
        c = chr(code)
        if code in out or c.isspace():
            continue
        folded = unicodedata.normalize("NFKC", c)
        if len(folded) == 1 and "!" <= folded <= "~":
            out[code] = folded
        elif unicodedata.category(c) == "Nd":
            out[code] = str(unicodedata.digit(c))
    return out


HOMOGLYPHS = _compatibility()
_STRANGE = frozenset(map(chr, HOMOGLYPHS)) | frozenset(INVISIBLE)
_INVISIBLE = re.compile(f"[{INVISIBLE}]+")
_AT_WORDS, _DOT_WORDS = r"(?:at|@|arroba)", r"(?:dot|\.|punkt|punto|point)"


def _bracketed(word: str, tag: str) -> re.Pattern:
    pairs = "|".join(rf"\{a}[\x20]?{word}[\x20]?\{b}" for a, b in ("[]", "()", "{}"))
    return re.compile(rf"[\x20\t]{{0,3}}(?:{pairs}|<{tag}>)[\x20\t]{{0,3}}", re.IGNORECASE)


_AT, _DOT = _bracketed(_AT_WORDS, "at"), _bracketed(_DOT_WORDS, "dot")
_OPEN_AT = re.compile(r"[\[({<]\x20?(?:at|@|arroba)", re.IGNORECASE)
_OPEN_DOT = re.compile(r"[\[({<]\x20?(?:dot|\.|punkt|punto|point)", re.IGNORECASE)
_ENDING = r"(?:" + "|".join(sorted(ENDINGS, key=len, reverse=True)) + r")(?![A-Za-z0-9])"
_HOST = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_PROSE = rf"(?!(?:the|a|an|this|that)[\x20_-]dot[\x20_-](?:{'|'.join(ENDING_WORDS)})(?![\x20_-]dot[\x20_-])(?![A-Za-z0-9]))"
_SPOKEN = re.compile(
    r"(?<![A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}(?P<at>[\x20_-]at[\x20_-]|\x20?@\x20?)"
    rf"{_PROSE}{_HOST}(?:[\x20_-]dot[\x20_-]{_HOST}){{0,125}}[\x20_-]dot[\x20_-]{_ENDING}", re.IGNORECASE)
#: a name with a dot, digit or underscore before a plain "at", or an @ set apart
_SPACED = re.compile(
    r"(?<![A-Za-z0-9._%+-])(?:[A-Za-z0-9%+-]{0,64}[._0-9][A-Za-z0-9._%+-]{0,64}(?P<at>\x20at\x20)|[A-Za-z0-9._%+-]{1,64}(?P<sign>\x20@\x20?|@\x20))"
    rf"{_HOST}(?:(?:\x20\.\x20|\.){_HOST}){{0,125}}(?:\x20\.\x20|\.){_ENDING}", re.IGNORECASE)
_INNER_DOT = re.compile(r"[A-Za-z0-9](?:\x20\.\x20|\.)[A-Za-z0-9]")
_SPOKEN_PART = re.compile(r"\x20?@\x20?|[\x20_-]at[\x20_-]|[\x20_-]dot[\x20_-]|\x20\.\x20", re.IGNORECASE)
_WORD = rf"(?:{'|'.join(DIGIT_WORDS)}|double|triple|plus|dot|\+?[0-9]+)"
_SPELLED = re.compile(rf"(?<![\w+])\+?{_WORD}(?:[\x20,.\t-]{{1,3}}{_WORD})+(?!\w)", re.IGNORECASE)
_SPELLED_WORDS = DIGIT_WORDS.keys() | {"plus", "dot"}
_SPELLED_TOKEN = re.compile(r"[^\W\d_]+|\+?[0-9]+|\+")
_BESIDE = re.compile(r"[\x20().0-9+-]*")
_BESIDE_CHARS = frozenset(" ().0123456789+-")
_POSING = re.compile(
    r"(?<![A-Za-z0-9])(?:\+[0-9](?:[\x20().-]{0,2}[0-9OoIl]){8,14}|[0-9OoIl](?:[\x20-]?[0-9OoIl]){12,18})(?![A-Za-z0-9])")
_POSING_MAP = str.maketrans("OoIl", "0011")

Edit = tuple[int, int, str]


def _spelled_items(text: str, start: int, end: int) -> list[tuple[int, int, str, str]]:
    """Start, end, digits or mark, and sort (word, plain, plus, dot) of a run's tokens."""
    items, times, since = [], 1, None
    for m in _SPELLED_TOKEN.finditer(text, start, end):
        token = m[0].lower()
        if token in ("double", "triple"):
            times, since = 2 if token == "double" else 3, m.start()
            continue
        begin = m.start() if since is None else since
        if token in DIGIT_WORDS:
            items.append((begin, m.end(), DIGIT_WORDS[token] * times, "word"))
        elif token in ("plus", "+"):
            items.append((m.start(), m.end(), "+", "plus"))
        elif token == "dot":
            items.append((m.start(), m.end(), ".", "dot"))
        else:
            items.append((m.start(), m.end(), token, "plain"))
        times, since = 1, None
    return items


def _spelled_numbers(text: str, start: int, end: int, items: list[tuple[int, int, str, str]]) -> list[Edit]:
    """Rewrites of those parts of a run that are an ip, a card or a phone number, with the digits beside it."""
    left = start
    while left and text[left - 1] in _BESIDE_CHARS:
        left -= 1
    before, after = text[left:start], _BESIDE.match(text, end)[0]
    for gap in (" ", "", "."):                           # what may stand between digits of two sorts
        line, places, last = before, [], None
        for begin, stop, piece, sort in items:
            if last is not None:
                between = text[last[1]:begin]
                if last[3] == sort == "plain" or gap == "." == between:
                    line += between
                elif gap != "." and "dot" not in (sort, last[3]) and last[3] != "plus" and sort != last[3]:
                    line += gap
            places.append((len(line), len(line) + len(piece)))
            line += piece
            last = (begin, stop, piece, sort)
        line += after
        starts, ends = [x for x, _ in places], [y for _, y in places]
        found: list[list[int]] = []
        for a, b in sorted(ips(line) + cards(line) + phones(line)):
            i, j = bisect_right(ends, a), bisect_left(starts, b) - 1
            if not any(items[k][3] != "plain" for k in range(i, j + 1)):
                continue
            if found and i <= found[-1][1]:
                found[-1][1] = max(found[-1][1], j)
            else:
                found.append([i, j])
        if found:
            return [(items[i][0], items[j][1], line[places[i][0]:places[j][1]]) for i, j in found]
    return []


def _spelled(text: str, start: int, end: int) -> list[Edit]:
    """Rewrites of a run of spelled and plain digits."""
    items = _spelled_items(text, start, end)
    if all(sort == "plain" for *_, sort in items):
        return []
    digits = "".join(piece for _, _, piece, _ in items)
    long = sum(len(piece) for _, _, piece, sort in items if sort == "word") >= MIN_SPELLED
    if long and digits.isdigit() and all(sort == "word" for *_, sort in items):
        return [(start, end, digits)]
    return _spelled_numbers(text, start, end, items) or ([(start, end, digits)] if long else [])


def edits(text: str) -> list[Edit]:
    """Rewrites of a (homoglyph-free) text, in order and without overlaps."""
    found: list[Edit] = []
    low = text.lower()
    if not text.isascii():
        found += [(*m.span(), "") for m in _INVISIBLE.finditer(text)]
    brackets = any(b in text for b in "([{<")
    if brackets and _OPEN_AT.search(text):
        found += [(*m.span(), "@") for m in _AT.finditer(text)]
    if brackets and _OPEN_DOT.search(text):
        found += [(*m.span(), ".") for m in _DOT.finditer(text)]
    spoken = any(x in low for x in (" dot ", "_dot_", "-dot-"))
    spaced = ("@ " in low or " @" in low or " at " in low) and _INNER_DOT.search(text)
    for pattern, worth in ((_SPOKEN, spoken), (_SPACED, spaced)):
        for m in pattern.finditer(text) if worth else ():
            at = m.start("at") if m["at"] else m.start("sign")
            found += [(m.start() + p.start(), m.start() + p.end(), "@" if "@" in p[0] or "at" in p[0].lower() else ".")
                      for p in _SPOKEN_PART.finditer(m[0], at - m.start())]
    for mark in ",.-":
        low = low.replace(mark, " ")
    if not _SPELLED_WORDS.isdisjoint(low.split()):
        for m in _SPELLED.finditer(text):
            found += _spelled(text, *m.span())
    if _DIGIT.search(text):
        for m in _POSING.finditer(text):
            letters, digits = sum(map(m[0].count, "OoIl")), len(_NON_DIGITS.sub("", m[0]))
            if 0 < letters <= digits / 2:
                found.append((*m.span(), m[0].translate(_POSING_MAP)))
    found.sort()
    out: list[Edit] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


class Normal:
    """A normal form and the way back to source characters."""

    def __init__(self, text: str, source: str, changes: list[Edit]):
        parts, self.norm, self.src, self.kind = [], [], [], []
        at = length = 0
        for start, end, new in (*changes, (len(text), len(text), "")):
            for begin, stop, piece, edit in ((at, start, text[at:start], False), (start, end, new, True)):
                if piece or edit:
                    parts.append(piece)
                    self.norm.append(length)
                    self.src.append((begin, stop))
                    self.kind.append(edit)
                    length += len(piece)
            at = end
        self.text = "".join(parts)
        self.strange = [i for i, (a, b) in enumerate(zip(text, source)) if a != b] if text != source else []

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a normal span, and whether it touches something rewritten."""
        i, j = bisect_right(self.norm, start) - 1, bisect_right(self.norm, end - 1) - 1
        a = self.src[i][0] if self.kind[i] else self.src[i][0] + start - self.norm[i]
        b = self.src[j][1] if self.kind[j] else self.src[j][0] + end - self.norm[j]
        k = bisect_right(self.strange, a - 1)
        return a, b, any(self.kind[i:j + 1]) or (k < len(self.strange) and self.strange[k] < b)


def disguised(source: str) -> list[tuple[str, int, int]]:
    """Spans that only the normal form shows, in source characters."""
    text = source
    if not source.isascii() and not _STRANGE.isdisjoint(source):
        text = source.translate(HOMOGLYPHS)
    changes = edits(text)
    if not changes and text == source:
        return []
    normal = Normal(text, source, changes)
    out = []
    for kind, spans in plain(normal.text).items():
        for start, end in spans:
            a, b, rewritten = normal.back(start, end)
            if rewritten:
                out.append((kind, a, b))
    for start, end, digits in changes:
        if digits.isdigit() and 9 <= len(digits) <= 15 and not any(digits in c for c in COUNTING) and not luhn_card(digits) \
                and not _DIGIT.match(source, start) and not any(a < end and start < b for _, a, b in out):
            out.append(("phone", start, end))
    return out


def luhn_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def find(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans (base and added) of a text, by kind, each in order."""
    if not text:
        empty: dict[str, list[Span]] = {k: [] for k in KINDS}
        return empty, empty
    base = plain(text)
    added = disguised(text)
    if not added:
        return base, base
    every = {k: list(v) for k, v in base.items()}
    for kind, a, b in added:
        if not any(x < b and a < y for x, y in every[kind]):
            every[kind].append((a, b))
    return base, {k: sorted(v) for k, v in every.items()}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


FIELDS = {"doc_id": pa.int64(), **{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(),
          "spans": pa.string(), "n_spans": pa.int64()}
DDL = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
       "spans string, n_spans long")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans, per document row."""
    schema = common.arrow_schema(FIELDS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [find(t) for t in common.column(batch, "text")]
        cols = [batch.column(0).cast(pa.int64())]
        cols += [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in KINDS]
        cols.append(pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]))
        cols.append(pa.array([listed(every) for _, every in found], pa.string()))
        cols.append(pa.array([sum(map(len, every.values())) for _, every in found], pa.int64()))
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(common.per_batch(run), DDL)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(common.documents(spark, sf_dir))
