"""Quoted CSV read by many tasks per file.

A line break inside quotes belongs to its record, so where a record starts depends on all quotes before.
Whether a line leaves a quoted field open depends only on the line and on whether one was open before it:
a function of two states. Such functions compose, so each split of a file is reduced to one (``effects``: one
row per split), these are combined from the file's start on, and then every split knows whether it starts inside a
quoted field. The splits are read again: each task glues its lines to records, and what crosses the
ends of splits (at most two fragments each) is put together by file and place. Records are then parsed
by Spark's CSV parser.

Quotes count where the parser takes them as such: at the start of a field; one in the middle of an
unquoted field is text, and after a closing quote the field goes on to the delimiter.

Files without any open line need none of this: ``broken_files`` finds those that do, in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillrec.session import kept

RECORD, HEAD, TAIL = 0, 1, 2          # a whole record; lines that go on from the split before; lines left open at the end


def open_line_pattern(sep: str) -> str:
    """Matches a line that ends inside a quoted field, if it starts outside of one. The same for Java and Python."""
    d = re.escape(sep) if sep != "\t" else r"\t"
    inside = r'[^"]*+(?:""[^"]*+)*+'
    closed = f'"{inside}"(?!")[^{d}]*+'
    plain = f'(?:[^"{d}][^{d}]*+)?+'
    return f'\\A(?:(?:{closed}|(?!"){plain}){d})*+"{inside}\\z'


def _python_pattern(sep: str) -> re.Pattern[bytes]:
    return re.compile(open_line_pattern(sep).replace("\\z", "\\Z").encode())


def lines_of(spark: SparkSession, files: list[str]) -> DataFrame:
    """value, file, block (the split's start) of every line, in order within a split."""
    return spark.read.option("lineSep", "\n").text(files).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def broken_files(spark: SparkSession, files: list[str], sep: str) -> set[str]:
    """Those of the files in which some line leaves a quoted field open (their names only)."""
    value: Column = F.col("value")
    found = lines_of(spark, files).where(F.contains(value, F.lit('"')) & value.rlike(open_line_pattern(sep)))
    return {r["file"] for r in found.select("file").distinct().collect()}


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[bytes]]]:
    """Runs of lines of one split."""
    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lines = batch.column(0).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(lines):
            key, end = (files[at], blocks[at]), at
            while end < len(lines) and blocks[end] == key[1] and files[end] == key[0]:
                end += 1
            yield key, iter(lines[at:end])
            at = end


def _opens(pattern: re.Pattern[bytes]) -> Callable[[bytes, bool], bool]:
    def after(line: bytes, inside: bool) -> bool:
        """Whether a quoted field is open after the line."""
        if b'"' not in line:
            return inside
        return pattern.match(b'"' + line if inside else line) is not None
    return after


def effects(lines: DataFrame, sep: str) -> DataFrame:
    """file, block, from_outside, from_inside, blank: what each split makes of the two states, one row per split."""
    pattern = _python_pattern(sep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = _opens(pattern)
        found: dict[tuple[str, int], list[bool]] = {}
        for key, some in _by_split(batches):
            state = found.setdefault(key, [False, True, True])
            for line in some:
                if b'"' in line:
                    outside = after(line, state[0])
                    state[:2] = outside, outside if state[0] == state[1] else after(line, state[1])
                state[2] = state[2] and not line.strip()
        rows = [(*k, *v) for k, v in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))], names=["file", "block", "from_outside", "from_inside", "blank"])

    return lines.mapInArrow(run, "file string, block long, from_outside boolean, from_inside boolean, blank boolean")


def starts(found: DataFrame) -> tuple[set[tuple[str, int]], set[tuple[str, int]]]:
    """Splits that start inside a quoted field, and those that hold their file's header (metadata: a row per split)."""
    inside, headers = set(), set()
    state: dict[str, bool] = {}
    headed: set[str] = set()
    for r in sorted(found.collect(), key=lambda r: (r["file"], r["block"])):
        key = (r["file"], r["block"])
        if state.get(r["file"], False):
            inside.add(key)
        if not r["blank"] and r["file"] not in headed:
            headed.add(r["file"])
            headers.add(key)
        state[r["file"]] = r["from_inside"] if state.get(r["file"], False) else r["from_outside"]
    return inside, headers


def glued(lines: DataFrame, sep: str, inside: set[tuple[str, int]], headers: set[tuple[str, int]]) -> DataFrame:
    """file, block, kind, closed, header, text: the records of each split and its fragments. Blank lines outside of
    quotes are no records; a file's first record is its header."""
    pattern = _python_pattern(sep)
    shared = lines.sparkSession.sparkContext.broadcast((inside, headers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        after = _opens(pattern)
        inside, headers = shared.value
        key, held, kind, first = None, [], RECORD, False
        rows: list[tuple] = []

        def end(closed: bool) -> None:
            """The lines held are a record, or a fragment."""
            nonlocal held, kind, first
            text = b"\n".join(held)
            of = kind if kind == HEAD else RECORD if closed else TAIL
            if text.strip() or of != RECORD:
                is_header = first and of != HEAD
                first = first and not is_header
                if not (is_header and of == RECORD):
                    rows.append((*key, of, closed, is_header, text[:-1] if closed and text.endswith(b"\r") else text))
            held, kind = [], RECORD

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()))]
            columns[5] = columns[5].cast(pa.string())
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "kind", "closed", "header", "text"])

        is_open = False
        for split, some in _by_split(batches):
            if split != key:
                if held:
                    end(False)
                key, is_open, first = split, split in inside, split in headers
                kind = HEAD if is_open else RECORD
            for line in some:
                is_open = after(line, is_open)
                held.append(line)
                if not is_open:
                    end(True)
            if len(rows) >= 10_000:
                yield batch()
        if held:
            end(False)
        yield batch()

    return lines.mapInArrow(run, "file string, block long, kind int, closed boolean, header boolean, text string")


def across_splits(fragments: DataFrame) -> DataFrame:
    """Records (file, block of their first line, text) from fragments, in the order of their places."""
    place = Window.partitionBy("file").orderBy("block", "kind")
    chained = fragments.withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(place))
    parts = F.sort_array(F.collect_list(F.struct("block", "kind", "text")))
    return chained.groupBy("file", "chain").agg(
        F.min("block").alias("block"), F.bool_or("header").alias("header"),
        F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text")) \
        .where(~F.col("header")).select("file", "block", "text")


def records(spark: SparkSession, files: list[str], sep: str) -> DataFrame:
    """file, block, text of every record after the headers. Records that cross splits come last."""
    lines = lines_of(spark, files)
    # stored: whole records and fragments are both taken from it
    rows = kept(glued(lines, sep, *starts(effects(lines, sep))), "records")
    return rows.where(F.col("kind") == RECORD).select("file", "block", "text") \
        .unionByName(across_splits(rows.where(F.col("kind") != RECORD)))


def read(spark: SparkSession, files: list[str], schema: T.StructType, sep: str, options: dict[str, str]) -> DataFrame:
    """Columns of ``schema`` plus ``_file`` and ``_block``."""
    parsed = records(spark, files, sep).select(
        F.from_csv("text", F.lit(schema.simpleString()), {**options, "sep": sep, "multiLine": "true"}).alias("r"), "file", "block")
    return parsed.select("r.*", F.col("file").alias("_file"), F.col("block").alias("_block"))
