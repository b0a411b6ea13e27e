"""Quality rules, line first.

Every line is judged by itself; failing lines are removed, and a document that loses too much of
its text is rejected. A line is a piece between ``\\n``; a line without a word passes. A line fails

* *navigation*: at least two words are separator marks and they are a fifth of its words;
* *symbols*: three words or more and over one symbol character per four words;
* *shouting*: three words or more and over one ``!!`` per four words;
* *boilerplate*: it holds one of the fixed phrases (A-Z lowered);
* *unterminated*: nowhere in it does a sentence end (a mark before a space or the line's end;
  in scripts that end sentences with a space, a letter there).

Whole-document rules come before: too few words, or too many words inside repeated three-word
windows. All of it is per row, so there is no shuffle and memory is one Arrow batch.

Defined cases: null text counts as empty (no words, base failed, not kept); rows with a null or
repeated doc_id are judged like any other and each gives one row; an empty table gives no rows;
extra columns are ignored by ``line_verdicts`` and passed on unchanged by ``clean_documents``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillrec.llm import common

# fixed values
SYMBOLS = "#*$%&|<>"
SEPARATORS = ("|", ">", "»", "•", "·")
BOILERPLATE = (
    "all rights reserved", "click here", "cookie policy", "enable javascript", "licensed under",
    "lorem ipsum", "powered by", "privacy policy", "skip to content", "subscribe to our newsletter",
    "terms of service", "terms of use",
)
# Thai, Lao and Khmer letters: these scripts end a sentence with a space
SENTENCE_END = r"""([.!?…。！？:;।॥؟۔።]["'”’»)\]]*|[ก-ໟក-៝])([\x20\x09-\x0D]|$)"""

_END = re.compile(SENTENCE_END)
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)).encode())
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)

FIELDS = {
    "doc_id": pa.int64(), "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(),
    "kept": pa.bool_(), "n_failed_lines": pa.int64(), "lost_chars": pa.int64(),
}
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
       "n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long, lost_chars long")


@dataclass(frozen=True)
class Limits:
    """Production limits of the rules."""
    min_words: int = 50
    max_repeat_pct: int = 50
    max_lost_pct: int = 50


def word_chars(text: str) -> int:
    return len(text) - sum(map(text.count, common.SPACES))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    distinct = set(windows)
    if len(distinct) == len(windows):
        return 0
    seen: set = set()
    twice: set = set()
    for w in windows:
        if w in seen:
            twice.add(w)
        else:
            seen.add(w)
    covered = total = 0
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def line_fails(line: str) -> str | None:
    """Name of the first rule that a line breaks."""
    raw = line.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return None
    separators = sum(map(_SEPARATORS.__contains__, words))
    if separators >= 2 and 5 * separators >= n:
        return "navigation"
    if n >= 3 and 4 * sum(map(line.count, SYMBOLS)) > n:
        return "symbols"
    if n >= 3 and 4 * line.count("!!") > n:
        return "shouting"
    if _BOILER.search(raw.lower()):
        return "boilerplate"
    if not _END.search(line):
        return "unterminated"
    return None


@dataclass
class Judged:
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_failed_lines: int
    lost_chars: int
    text: str


def judge(text: str | None, limits: Limits = Limits()) -> Judged:
    """All counts of a text, its verdict, and the text without its failing lines."""
    text = text or ""
    words = text.encode().split()
    chars = word_chars(text)
    seen: set[str] = set()
    dup = failed = lost = 0
    good = []
    for line in text.split("\n"):
        if line.strip(common.SPACES):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
            if line_fails(line):
                failed += 1
                lost += word_chars(line)
                continue
        good.append(line)
    repeat = repeated_words(words)
    base = len(words) < limits.min_words or 100 * repeat > limits.max_repeat_pct * len(words)
    kept = not base and 100 * lost <= limits.max_lost_pct * chars
    return Judged(len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeat, base, kept,
                  failed, lost, "\n".join(good) if failed else text)


def line_verdicts(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row of counts and verdicts per document row (columns ``doc_id``, ``text``)."""
    schema = common.arrow_schema(FIELDS)

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, limits) for t in common.column(batch, "text")]
        cols = [batch.column(0).cast(pa.int64())]
        cols += [pa.array([getattr(r, f.name) for r in rows], f.type) for f in list(schema)[1:]]
        return pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(common.per_batch(judged), DDL)


def clean_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Kept documents with their failing lines removed (``n_chars`` follows); all columns stay."""
    def cleaned(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [judge(t, limits) for t in common.column(batch, "text")]
        names = batch.schema.names
        for name, values in (("text", [r.text for r in rows]), ("n_chars", [len(r.text) for r in rows])):
            if name in names:
                i = names.index(name)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
        return batch.filter(pa.array([r.kept for r in rows], pa.bool_()))

    return docs.mapInArrow(common.per_batch(cleaned), docs.schema)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(common.documents(spark, sf_dir))


# the values are written out here again, so that the SQL doesn't follow a slip in the code above
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (
  SELECT doc_id, i, ws[i] || chr(31) || ws[i + 1] || chr(31) || ws[i + 2] AS t
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) AS s(o) GROUP BY doc_id),
lines AS (
  SELECT doc_id, pos, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
worded AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS nth, len(ws) AS n,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS chars,
         len(list_filter(ws, lambda x: x IN ('|', '>', '»', '•', '·'))) AS seps,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms,
         len(regexp_extract_all(line, '!!')) AS shouts
  FROM lines WHERE len(ws) > 0),
judged AS (
  SELECT *, (seps >= 2 AND 5 * seps >= n) OR (n >= 3 AND 4 * syms > n) OR (n >= 3 AND 4 * shouts > n)
    OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(all rights reserved|click here|cookie policy|enable javascript|licensed under|lorem ipsum|powered by|privacy policy|skip to content|subscribe to our newsletter|terms of service|terms of use)')
    OR NOT regexp_matches(line, '([.!?…。！？:;।॥؟۔።]["''”’»)\]]*|[ก-ໟក-៝])([\x20\x09-\x0D]|$)') AS fails
  FROM worded),
byline AS (
  SELECT doc_id, count(*) FILTER (nth > 1) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines,
         coalesce(sum(chars) FILTER (fails), 0) AS lost_chars
  FROM judged GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(ws) AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM w LEFT JOIN byline USING (doc_id) LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost_chars <= 50 * word_chars AS kept,
       n_failed_lines::BIGINT AS n_failed_lines, lost_chars::BIGINT AS lost_chars
FROM base
"""
