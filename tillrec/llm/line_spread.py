"""Cross-site line dedup by distinct-site spread (DataFrame operations only).

A line (a piece between ``\\n``, spaces at its ends cut, A-Z lowered) is boilerplate when it stands on
at least ``min_sites`` distinct sites. Per line hash a HyperLogLog sketch of its sites is built and
merged by aggregation. Lines clearly below the threshold are done, lines clearly above it are
boilerplate; those within the sketch's error of it get an exact distinct count. Boilerplate lines
are removed from every document but the one of least doc_id, so that no text vanishes altogether.

The sketch of a line has a fixed size however hot the line is, and partial aggregation sends one per
task and line. Exact counts combine by (line, site) first. Line hashes are stored once and read by
the later steps; documents are joined with the places of the lines to remove, at most their own lines.

Defined cases: null text counts as empty; blank lines are never removed; a null source is no site; rows with a null doc_id count
for the spread but keep their text; rows that repeat a doc_id are cleaned each by its own text; the least doc_id of
a line that only null doc_ids hold is null, and then nothing is removed. An empty table gives no
rows. Extra columns stay (``remove_boilerplate``) or are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.llm import common

MIN_SITES = 6
SKETCH_BITS = 12
#: three standard errors of a sketch with 2^12 registers, and one site
MARGIN = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)

_EDGES = " \t\r\x0b\x0c"
_FLAGS, _KEPT, _ID, _TEXT = (f"__line_spread_{x}" for x in ("flags", "kept", "id", "text"))


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(_EDGES)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _text_key() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, site, pos, line (hash) of every line that isn't blank."""
    return docs.select("doc_id", _text_key().alias("text_key"), F.col("source").alias("site"),
                       F.posexplode(_lines(F.col("text"))).alias("pos", "raw")) \
        .withColumn("key", _key(F.col("raw"))).filter("key <> ''") \
        .select("doc_id", "text_key", "site", "pos", F.xxhash64("key").alias("line"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """line, first_doc: the lines on ``min_sites`` sites or more."""
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    spread = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"), F.min("doc_id").alias("first_doc"))
    wide = common.stored(spread.filter(F.col("sites") >= low), "line-spread")
    near = wide.filter(F.col("sites") < high)
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line", "site").agg(F.lit(1).alias("one")) \
        .groupBy("line").agg(F.count("site").alias("exact")).filter(F.col("exact") >= min_sites)
    return wide.filter(F.col("sites") >= high).select("line", "first_doc") \
        .unionByName(near.join(exact, "line", "left_semi").select("line", "first_doc"))


def _flagged(docs: DataFrame, min_sites: int) -> DataFrame:
    """Documents with the places of the lines to remove from them (null if none)."""
    lines = common.stored(line_hashes(docs), "line-hashes")
    found = common.stored(boilerplate(lines, min_sites), "line-boilerplate")
    flags = lines.join(found, "line").filter("doc_id <> first_doc") \
        .groupBy(F.col("doc_id").alias(_ID), F.col("text_key").alias(_TEXT)).agg(F.collect_set("pos").alias(_FLAGS))
    # the flags are hashed, so the texts are shuffled but not sorted
    return docs.join(flags.hint("shuffle_hash"), (F.col("doc_id") == F.col(_ID)) & (_text_key() == F.col(_TEXT)), "left").drop(_ID, _TEXT)


def _with_kept_text(flagged: DataFrame) -> DataFrame:
    """``_KEPT``: the text without its flagged lines. A one-row ``explode`` keeps Catalyst from repeating
    the work in filters and for every use."""
    left = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains(F.col(_FLAGS), i)), "\n")
    return flagged.select("*", F.explode(F.array(F.when(F.col(_FLAGS).isNull(), F.col("text")).otherwise(left))).alias(_KEPT))


def line_counts(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines and n_removed (lines that aren't blank), n_chars and sha256 of the cleaned text."""
    cleaned = _with_kept_text(_flagged(docs.select("doc_id", "source", "text"), min_sites))
    kept = F.coalesce(_KEPT, F.lit(""))
    worded = F.size(F.filter(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_EDGES)) != "")).cast("long")
    return cleaned.select("doc_id", worded.alias("n_lines"),
                          F.when(F.col(_FLAGS).isNull(), 0).otherwise(F.size(_FLAGS)).cast("long").alias("n_removed"),
                          F.char_length(kept).cast("long").alias("n_chars"), F.sha2(kept, 256).alias("cleaned_sha256"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Documents without boilerplate lines (``n_chars`` follows); those of which only blank lines would
    be left go. All columns stay."""
    untouched = F.col(_FLAGS).isNull()
    cleaned = _with_kept_text(_flagged(docs, min_sites)).filter(untouched | (F.btrim(_KEPT, F.lit("\n" + _EDGES)) != ""))
    new = {"text": F.col(_KEPT)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(untouched, F.col("n_chars")).otherwise(F.char_length(_KEPT).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_counts(common.documents(spark, sf_dir))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, source, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
b AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE key <> '' GROUP BY key HAVING count(DISTINCT source) >= 6),
m AS (SELECT l.*, b.key IS NOT NULL AND doc_id <> first_doc AS gone FROM l LEFT JOIN b USING (key)),
t AS (SELECT doc_id, count(*) FILTER (key <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS cleaned
      FROM m GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_removed::BIGINT AS n_removed, length(cleaned)::BIGINT AS n_chars,
       sha256(cleaned) AS cleaned_sha256 FROM t
"""
