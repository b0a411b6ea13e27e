"""WARC archives: a Spark writer and a Python data source.

``write_archives`` lays out one record per page as text that ends in two line ends, which is just what
Spark's text sink writes with that separator: archives go to any file system Spark writes to, with its
commit protocol, gzip-compressed. Records with equal payloads of 100 bytes or more become revisits of
the one with the least page_id; their block is the HTTP head alone, as the standard has it. Which
record comes first is found on (page_id, digest) rows; page bodies are shuffled once.

``WarcSource`` reads archives: the driver lists files and packs them into partitions by size; record
type and header predicates are pushed into the reader, which parses each record's headers first and
skips the block of a record that no predicate wants, or reads only its HTTP head where payloads aren't
asked for. A partition streams its files record by record; batches are bounded in rows and bytes.

Options: ``path``; ``payload`` = ``bytes`` (default), ``digest`` (length and SHA-256 of what is read,
no bytes kept) or ``none``; ``partitionBytes``. A malformed archive is an error, never a short read.

Defined cases: null html is an empty payload, null url leaves the target header out; a null page_id is
never an original while another row has an id; rows that repeat the least page_id with the same payload
are all responses; rows that repeat another are all revisits. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from tillrec.llm import common

MIN_REVISIT_BYTES = 100
DATE = "1970-01-01T00:00:00Z"        # pages carry no date
RECORD = "urn:tillrec:page:"
END = "\r\n\r\n"

SCHEMA = ("record_id string, warc_type string, target_uri string, warc_date string, content_type string, "
          "payload_digest string, refers_to string, content_length long, payload_length long, "
          "payload_sha256 string, payload binary, file string")
#: columns that the headers alone decide
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri",
           "warc_date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest",
           "refers_to": "warc-refers-to"}
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def marked(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Pages (page_id, url, body) with ``digest``, ``bytes`` and, for revisits, ``original``."""
    body = F.coalesce(F.col("html"), F.lit(""))
    bodies = pages.select("page_id", "url", body.alias("body")) \
        .withColumn("digest", F.sha2("body", 256)).withColumn("bytes", F.octet_length("body").cast("long"))
    narrow = bodies.filter(F.col("bytes") >= min_bytes).select("page_id", "digest")
    firsts = narrow.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")) \
        .filter("n > 1 AND original IS NOT NULL").drop("n")
    again = narrow.join(firsts, "digest").filter("page_id IS NULL OR page_id > original").distinct() \
        .select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "original")
    return bodies.join(again, F.col("page_id").eqNullSafe(F.col("again_id"))
                       & (F.col("digest") == F.col("again_digest")), "left").drop("again_id", "again_digest")


def _id(column: str):
    return F.concat(F.lit(f"<{RECORD}"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = DATE) -> None:
    """One WARC record per page (columns ``page_id``, ``url``, ``html``) below ``path``."""
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("original").isNotNull()
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "body"))
    target = F.when(F.col("url").isNotNull(), F.concat(
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("\r\n"))).otherwise("")
    refers = F.when(revisit, F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
        _id("original"), F.lit("\r\n"))).otherwise("")
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _id("page_id"), F.lit(f"\r\nWARC-Date: {date}\r\n"), target, refers,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit(END), F.col("block"))
    marked(pages).withColumn("head", head).withColumn("block", block).select(record.alias("value")) \
        .write.option("lineSep", END).option("compression", "gzip").text(path)


# ---- the data source ---------------------------------------------------------------------------

@dataclass
class FileGroup(InputPartition):
    """Files that one task reads, in order."""
    files: tuple[str, ...]


def _filesystem(uri: str):
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "bytes")
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        if self.payload not in ("bytes", "digest", "none"):
            raise ValueError(f"payload must be bytes, digest or none, not {self.payload}")
        self.wanted: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep what the headers decide; hand the rest back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.wanted.append(("in", HEADERS[name], (f.value,)))
            elif isinstance(f, In):
                self.wanted.append(("in", HEADERS[name], tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append(("prefix", HEADERS[name], (f.value,)))
            elif isinstance(f, IsNotNull):
                self.wanted.append(("present", HEADERS[name], ()))
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        """Files packed by size, largest first, each into the emptiest group."""
        import heapq

        from pyarrow import fs
        system, root = _filesystem(self.path)
        found = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True))
                 if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        prefix = self.path[:self.path.index("://") + 3] if "://" in self.path else ""
        prefix = "" if prefix == "file://" else prefix
        groups = max(1, -(-sum(f.size for f in found) // self.partition_bytes))
        heap: list[tuple[int, int, list[str]]] = [(0, n, []) for n in range(min(groups, max(1, len(found))))]
        for f in sorted(found, key=lambda f: (-f.size, f.path)):
            size, n, names = heapq.heappop(heap)
            heapq.heappush(heap, (size + f.size, n, [*names, prefix + f.path]))
        return [FileGroup(tuple(names)) for _, _, names in sorted(heap, key=lambda g: g[1])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for name in partition.files:
            system, path = _filesystem(name)
            with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as raw:
                stream = _plain_stream(raw, path)
                for row in records(stream, name, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row[10] or b"")
                    if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t])
                   for n, t in (x.split() for x in SCHEMA.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


def _plain_stream(raw, path: str) -> io.BufferedIOBase:
    """Uncompressed bytes; gzip archives may be one member or one per record."""
    source = io.BufferedReader(raw, 1 << 20)
    return io.BufferedReader(gzip.GzipFile(fileobj=source), 1 << 20) if path.endswith(".gz") else source


def _headers(stream, name: str) -> dict[str, str] | None:
    """Headers of the next record; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{name}: no WARC record where one should start")
    out: dict[str, str] = {}
    while True:
        line = stream.readline()
        if line in (b"\r\n", b"\n"):
            return out
        if not line:
            raise ValueError(f"{name}: headers end early")
        key, _, value = line.decode("utf-8", "replace").partition(":")
        out[key.strip().lower()] = value.strip()


def _skip(stream, size: int, name: str) -> None:
    while size:
        got = len(stream.read(min(size, 1 << 20)))
        if not got:
            raise ValueError(f"{name}: a block ends early")
        size -= got


def _wants(headers: dict[str, str], wanted: list[tuple[str, str, tuple]]) -> bool:
    for kind, key, values in wanted:
        value = headers.get(key)
        if value is None or kind == "in" and value not in values or kind == "prefix" and not value.startswith(values[0]):
            return False
    return True


def records(stream, name: str, wanted: list[tuple[str, str, tuple]], payload: str) -> Iterator[tuple]:
    """Rows of the records that the header predicates want."""
    while (headers := _headers(stream, name)) is not None:
        size = int(headers.get("content-length", 0))
        if not _wants(headers, wanted):
            _skip(stream, size, name)
            continue
        left, length, digest, body = size, None, None, None
        declared = None
        if headers.get("content-type", "").startswith("application/http"):
            while left:                                        # the HTTP head
                line = stream.readline(left)
                if not line:
                    raise ValueError(f"{name}: a block ends early")
                left -= len(line)
                if line in (b"\r\n", b"\n"):
                    break
                if line.lower().startswith(b"content-length:"):
                    declared = int(line.partition(b":")[2])
        if headers.get("warc-type") == "revisit":
            length = declared                                  # of the payload that it stands for
            _skip(stream, left, name)
        elif payload == "none":
            length = left
            _skip(stream, left, name)
        elif payload == "digest":
            length, sha = left, hashlib.sha256()
            while left:
                part = stream.read(min(left, 1 << 20))
                if not part:
                    raise ValueError(f"{name}: a block ends early")
                sha.update(part)
                left -= len(part)
            digest = sha.hexdigest()
        else:
            body = stream.read(left)
            if len(body) != left:
                raise ValueError(f"{name}: a block ends early")
            length, digest = left, hashlib.sha256(body).hexdigest()
        yield (*(headers.get(k) for k in HEADERS.values()), size, length, digest, body, name)


def read_archives(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)


def digests(archives: DataFrame) -> DataFrame:
    """Per page record: its page_id, payload size and digest, type, and the page it revisits."""
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<{RECORD}(-?[0-9]+)>', 1) AS BIGINT)")
    declared = F.regexp_extract("payload_digest", "^sha256:([0-9a-f]{64})$", 1)
    revisit = F.col("warc_type") == "revisit"
    return archives.filter(F.col("warc_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.when(revisit, declared).otherwise(F.col("payload_sha256")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return digests(read_archives(spark, path, payload="digest"))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f USING (h)
"""
