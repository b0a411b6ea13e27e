"""File sources for the three exports: delimiter sniffing, CSV, header mapping.

The CSV itself is read by Spark's CSV parser (all columns as strings, malformed
lines captured in ``_corrupt``), many tasks a file. Only each file's header record is looked
at on the driver, to pick the delimiter and the columns.
"""

from __future__ import annotations

import csv
import glob
import io
import os
import re
from concurrent.futures import ThreadPoolExecutor
from pathlib import PurePath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillrec.functions.text import py_strip
from tillrec.operators.validate import BLANK_COL, ROW_COL
from tillrec.sources import quoted_csv
from tillrec.sources.spec import SourceSpec

CORRUPT_COL = "_corrupt"
HEADER_READERS = 16          # heads of files read at a time

# FIXED VALUES: cell texts read as missing by the original CSV reader (its default NA words).
NA_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


class AmbiguousHeaderError(ValueError):
    pass


def export_files(spark: SparkSession, path: str) -> list[str]:
    """Files that a path, folder or glob names, in name order (the names only)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(root) or []:
        inside = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [s.getPath().toString() for s in inside
                if not s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    return sorted(out)


def header_record(spark: SparkSession, path: str) -> str:
    """First record of a file that isn't blank: one line, or more if a quoted heading has a break.
    Only the head of the file is read, through the file system that Spark uses."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).open(target)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        record = ""
        while (line := reader.readLine()) is not None:
            line = line.lstrip("\ufeff") if not record else line
            if not record and not line.strip():
                continue
            record = f"{record}\n{line}" if record else line
            if record.count('"') % 2 == 0:
                return record
        if record:
            return record
    finally:
        reader.close()
    raise ValueError(f"{path}: empty file")


def split_header(record: str, sep: str) -> list[str]:
    return next(csv.reader(io.StringIO(record), delimiter=sep))


def sniff_delimiter(header: str, delimiters: tuple[str, ...]) -> str:
    """First delimiter that splits the header into more than one column (quoted text doesn't count)."""
    for d in delimiters:
        if len(split_header(header, d)) > 1:
            return d
    raise ValueError(f"could not parse header {header[:80]!r} with delimiters {delimiters!r}")


def _check_path(path: str) -> None:
    """Local paths and globs must match something; remote URIs are left to Spark."""
    if "://" in path:
        return
    if any(ch in path for ch in "*?[") and glob.glob(path):
        return
    if not os.path.exists(path):
        raise FileNotFoundError(path)


def _csv_options() -> dict[str, str]:
    return {"encoding": "UTF-8", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL,
            "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def header_records(spark: SparkSession, paths: list[str]) -> list[str]:
    """Heads of many files, read side by side (the names and heads only)."""
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        return list(pool.map(lambda p: header_record(spark, p), paths))


def read_delimited(spark: SparkSession, path: str, delimiters: tuple[str, ...],
                   multi_line: bool | None = None) -> list[DataFrame]:
    """All-string frames with the files' own header names plus ``_corrupt`` and an order key: one frame
    for each (delimiter, header) among the files, so that columns are read by name, not by position.

    Quoted text may hold line breaks. Files with such breaks are split all the same (``quoted_csv``); the
    others go to Spark's reader, which splits them by line. ``multi_line`` True reads each file as one
    split, False takes it that no file has such breaks and doesn't look for them.
    """
    _check_path(path)
    groups: dict[tuple[str, tuple[str, ...]], list[str]] = {}
    names = export_files(spark, path)
    for name, record in zip(names, header_records(spark, names)):
        sep = sniff_delimiter(record, delimiters)
        groups.setdefault((sep, tuple(h.strip() for h in split_header(record, sep))), []).append(name)
    frames = []
    for (sep, header), members in groups.items():
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(header))]
                              + [T.StructField(CORRUPT_COL, T.StringType())])
        broken = quoted_csv.broken_files(spark, members, sep) if multi_line is None else set()
        plain = [m for m in members if not any(_same_file(m, b) for b in broken)]
        parts = []
        if plain:
            df = spark.read.schema(schema).options(**_csv_options(), header=True, sep=sep, multiLine=bool(multi_line)).csv(plain)
            parts.append(df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")))
        if broken:
            parts.append(quoted_csv.read(spark, sorted(set(members) - set(plain)), schema, sep, _csv_options()))
        for df in parts:
            frames.append(df.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(header)], CORRUPT_COL, "_file", "_block"))
    return frames


def _same_file(a: str, b: str) -> bool:
    """File names as the file system and as Spark's metadata write them (``file:/x``, ``file:///x``, escapes)."""
    plain = lambda p: re.sub("^([a-z0-9]+):/+", r"\1:/", unquote(p))
    return plain(a) == plain(b)


def normalise_columns(raw: DataFrame, spec: SourceSpec) -> DataFrame:
    """Header strip+lower, alias map, injected constants, blank-row drop, trim, known fields only.

    Returns canonical string columns + ``source_row_index`` + ``_corrupt``.
    """
    meta = {CORRUPT_COL, "_file", "_block"}
    file_cols = [c for c in raw.columns if c not in meta]
    lowered = {c: c.strip().lower() for c in file_cols}
    mapped: dict[str, str] = {}
    for c in file_cols:
        target = spec.headers.get(lowered[c], lowered[c])
        if target in mapped.values():
            raise AmbiguousHeaderError(f"two columns map to {target!r} in the {spec.name} export")
        mapped[c] = target
    na = F.lit(None).cast("string")
    cols = [F.when(F.col(f"`{c}`").isin(*NA_WORDS), na).otherwise(F.col(f"`{c}`")).alias(mapped[c])
            for c in file_cols]
    df = raw.select(*cols, CORRUPT_COL, "_file", "_block")
    for name, value in spec.injected.items():
        df = df.withColumn(name, F.lit(value))
    # rows with no value in any column are blank — after injection, so an
    # all-blank settlement row survives (and is quarantined) as in the source
    check = [mapped[c] for c in file_cols] + list(spec.injected)
    blank = F.coalesce(*[F.col(f"`{c}`") for c in check], F.col(CORRUPT_COL)).isNull()
    df = df.withColumn(ROW_COL, F.monotonically_increasing_id()).withColumn(BLANK_COL, blank)
    keep = [f for f in spec.field_names if f in df.columns]
    return df.select(*[py_strip(F.col(f)).alias(f) for f in keep], ROW_COL, CORRUPT_COL, "_file", "_block", BLANK_COL)


def normalise_cells(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Workbook rows (``cells`` map) -> the same shape as ``normalise_columns``.

    Header names are normalised inside the map (strip + lower) and each field
    takes the cell of whichever alias the workbook uses; a row whose header
    has two aliases of one field is marked corrupt (quarantined).
    """
    cells = F.transform_keys(F.col("cells"), lambda k, v: F.lower(F.trim(k)))
    aliases: dict[str, list[str]] = {}
    for raw_name, field in spec.headers.items():
        aliases.setdefault(field, []).append(raw_name)
    for field in spec.field_names:
        aliases.setdefault(field, [])
        if field not in aliases[field]:
            aliases[field].append(field)
    na = F.lit(None).cast("string")

    def cell(name: str) -> F.Column:
        v = F.try_element_at(F.col("_cells"), F.lit(name))
        return F.when(v.isin(*NA_WORDS), na).otherwise(v)

    df = rows.select(cells.alias("_cells"), "_file", F.col("_row").alias("_block"))
    def among(names: list[str]):
        return lambda k: k.isin(*names)

    ambiguous = F.greatest(*[F.size(F.filter(F.map_keys("_cells"), among(a))) for a in aliases.values()]) > 1
    fields = {f: F.coalesce(*[cell(a) for a in aliases[f]]) for f in spec.field_names}
    for name, value in spec.injected.items():
        fields[name] = F.lit(value)
    df = df.select(*[v.alias(k) for k, v in fields.items()],
                   F.when(ambiguous, F.lit("ambiguous header")).alias(CORRUPT_COL), "_file", "_block")
    blank = F.coalesce(*[F.col(c) for c in fields], F.col(CORRUPT_COL)).isNull()
    df = df.withColumn(ROW_COL, F.monotonically_increasing_id()).withColumn(BLANK_COL, blank)
    return df.select(*[py_strip(F.col(f)).alias(f) for f in spec.field_names], ROW_COL, CORRUPT_COL,
                     "_file", "_block", BLANK_COL)


def read_export(spark: SparkSession, path: str, spec: SourceSpec, multi_line: bool | None = None) -> DataFrame:
    """Read one export (CSV or XLSX by suffix) into canonical string columns."""
    suffix = PurePath(path).suffix.lower()
    if suffix == ".csv":
        frames = [normalise_columns(f, spec) for f in read_delimited(spark, path, spec.delimiters, multi_line)]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out
    if suffix == ".xlsx":
        from tillrec.sources.xlsx import read_workbooks
        _check_path(path)
        return normalise_cells(read_workbooks(spark, path), spec)
    raise ValueError(f"unsupported export format {suffix!r}")
