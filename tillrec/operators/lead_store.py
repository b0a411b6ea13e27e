"""A lead line store with versions: deep pages and erasures that read few files.

Lines lie in text files that are never changed. A version is a manifest: which files are live, in what
order, how many well-formed leads each holds, and between which times they were received. Beside it lies an id sketch per file
(a Bloom filter of ``SKETCH_BITS`` bits, stored as its non-zero words). The newest manifest that was written whole is the store;
a reader sees the old version or the new one.

* ``page``: counts of the files before give the place of any page. Files wholly inside or outside the range of times are
  counted from the manifest, the others by a job; only the page's own files are read for its rows.
* ``erase``: the sketches name the files that may hold an id; only those are read, only those that do hold one are
  written anew (one file each, lines in their order, in the place of the old), and nothing is sorted across files.

The manifest (a row per file) reaches the driver, lines never do. A deleted lead's old file stays until ``vacuum_list`` names it
for removal, so readers of the old version finish.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.operators.leads import lead_erase, parse_lines, received_ts

SKETCH_BITS = 1 << 20
MANIFEST = "seq long, path string, lines long, leads long, undated long, first_ts timestamp_ntz, last_ts timestamp_ntz"
_SKETCHES = "path string, slot int, bits long"


def _places(lead_id: Column) -> Column:
    """Two bit positions of an id."""
    return F.array(F.pmod(F.xxhash64(lead_id), F.lit(SKETCH_BITS)), F.pmod(F.xxhash64(lead_id, F.lit(1)), F.lit(SKETCH_BITS)))


class LeadStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- versions

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> LeadStore:
        store = cls(spark, path)
        store._publish(spark.createDataFrame([], MANIFEST), 0)
        return store

    def _folders(self, name: str) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{name}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(root)
                if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS"))] if fs.exists(root) else []

    def version(self) -> int:
        """The newest version that was written whole."""
        return max(int(f.removeprefix("v=")) for f in self._folders("manifest"))

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v={v}")

    def _publish(self, manifest: DataFrame, version: int) -> None:
        manifest.write.mode("error").parquet(f"{self.path}/manifest/v={version}")

    # ---- lines

    def _lines(self, files: list) -> DataFrame:
        """Lines of files, with the file's seq and an order inside it."""
        if not files:
            return self.spark.createDataFrame([], "seq long, at struct<block:long,row:long>, value string, path string")
        read = self.spark.read.text([f"{self.path}/{f['path']}" for f in files])
        rel = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/seq=\d+/[^/]+)$", 1)
        lines = read.select(rel.alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"),
                                                        F.monotonically_increasing_id().alias("row")).alias("at"), "value")
        seqs = self.spark.createDataFrame([(f["path"], f["seq"]) for f in files], "path string, seq long")
        return lines.join(F.broadcast(seqs), "path").select("seq", "at", "value", "path")     # a row per file

    @staticmethod
    def _parsed(lines: DataFrame) -> DataFrame:
        kept = lines.withColumn("line_no", F.struct("seq", "at"))
        return received_ts(parse_lines(kept.select("line_no", "value"))) \
            .select(F.col("line_no.seq").alias("seq"), F.col("line_no.at").alias("at"), "line_no", "value", "lead", "blank", "received_ts")

    def lines(self, version: int | None = None) -> DataFrame:
        """(line_no, value) of a version, for the operators of ``leads``."""
        rows = self._lines(self.manifest(version).orderBy("seq").collect())
        return rows.select(F.struct("seq", "at").alias("line_no"), "value")

    def _write(self, lines: DataFrame) -> DataFrame:
        """Write (seq, at, value) as one file per seq, index the files, and return their manifest rows."""
        batch = uuid.uuid4().hex
        lines.repartition("seq").sortWithinPartitions("seq", "at").select("seq", "value") \
            .write.partitionBy("seq").text(f"{self.path}/data/{batch}")
        rel = F.regexp_extract(F.col("_metadata.file_path"), r"(data/[^/]+/seq=\d+/[^/]+)$", 1)
        read = self.spark.read.schema("value string, seq long").text(f"{self.path}/data/{batch}").select(
            "seq", rel.alias("path"), "value")
        parsed = received_ts(parse_lines(read.select(F.struct("seq", "path").alias("line_no"), "value")))
        ok = F.col("lead").isNotNull()
        index = parsed.select("line_no.*", "lead", "blank", "received_ts")
        ids = index.where(F.col("lead.id").isNotNull()).select("path", F.explode(_places(F.col("lead.id"))).alias("bit"))
        ids.groupBy("path", F.shiftright("bit", 6).cast("int").alias("slot")) \
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")) \
            .write.mode("append").parquet(f"{self.path}/sketch")
        return index.groupBy("seq", "path").agg(
            F.count(F.lit(1)).alias("lines"), F.count_if(ok).alias("leads"), F.count_if(ok & F.col("received_ts").isNull()).alias("undated"),
            F.min(F.when(ok, F.col("received_ts"))).alias("first_ts"), F.max(F.when(ok, F.col("received_ts"))).alias("last_ts"))

    def append(self, lines: DataFrame, files: int = 1) -> int:
        """Add (line_no, value) rows after those of the store, in ``files`` files; the new version's number."""
        version = self.version()
        live = self.manifest(version)
        first = live.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0] + 1
        placed = lines.repartitionByRange(files, "line_no").select(
            (F.spark_partition_id() + F.lit(first)).cast("long").alias("seq"), F.col("line_no").alias("at"), "value")
        self._publish(live.unionByName(self._write(placed)), version + 1)
        return version + 1

    # ---- pages

    def page(self, from_ts: str | None = None, to_ts: str | None = None, skip: int = 0, limit: int = 100,
             version: int | None = None) -> DataFrame:
        """(line_no, id, received_ts) of well-formed leads in line order, as ``leads.lead_page`` gives them;
        any ``skip``. Reads the files that the page lies in, and those that the ends of the range cut."""
        if not 1 <= limit <= 1000 or skip < 0:
            raise ValueError("limit must be 1..1000 and skip 0 or more")
        ts = F.col("received_ts")
        lo, hi = (F.lit(t).cast("timestamp_ntz") if t else F.lit(None).cast("timestamp_ntz") for t in (from_ts, to_ts))
        inside = ts.isNull() | ((lo.isNull() | (ts >= lo)) & (hi.isNull() | (ts <= hi)))
        whole = F.col("first_ts").isNull() | ((lo.isNull() | (F.col("first_ts") >= lo)) & (hi.isNull() | (F.col("last_ts") <= hi)))
        none = (F.col("last_ts") < lo) | (F.col("first_ts") > hi)
        files = self.manifest(version).withColumn(
            "n", F.when(whole, F.col("leads")).when(none, F.col("undated"))).orderBy("seq").collect()      # a row per file
        cut = [f for f in files if f["n"] is None]
        counts = {r["seq"]: r["count"] for r in self._parsed(self._lines(cut)).where(F.col("lead").isNotNull() & inside)
                  .groupBy("seq").count().collect()} if cut else {}
        wanted, before, offset = [], 0, 0
        for f in files:
            n = counts.get(f["seq"], 0) if f["n"] is None else f["n"]
            if n and before + n > skip and before < skip + limit:
                offset = skip - before if not wanted else offset
                wanted.append(f)
            before += n
        rows = self._parsed(self._lines(wanted)).where(F.col("lead").isNotNull() & inside)
        # at most one file's rows lie before the page
        first = rows.where(F.col("seq") == wanted[0]["seq"]).orderBy("at").offset(offset).limit(limit) if wanted else rows.limit(0)
        later = rows.where(F.col("seq") > wanted[0]["seq"]).orderBy("seq", "at").limit(limit) if len(wanted) > 1 else rows.limit(0)
        return first.unionByName(later).orderBy("seq", "at").limit(limit).select("line_no", F.col("lead.id").alias("id"), "received_ts")

    # ---- erasure

    def _may_hold(self, ids: DataFrame, live: DataFrame) -> list:
        """Files whose sketch has both bits of some id (a row per file)."""
        asked = ids.select("id", F.posexplode(_places(F.col("id"))).alias("nth", "bit")) \
            .select("id", "nth", F.shiftright("bit", 6).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(bit & 63 AS int))").alias("mask"))
        sketch = self.spark.read.schema(_SKETCHES).parquet(f"{self.path}/sketch")
        found = sketch.join(asked, "slot").where(F.col("bits").bitwiseAND(F.col("mask")) != 0) \
            .groupBy("path", "id").agg(F.count_distinct("nth").alias("n")).where("n = 2").select("path").distinct()
        return live.join(found, "path", "left_semi").orderBy("seq").collect()

    def erase(self, erase_ids: DataFrame) -> int:
        """Drop every well-formed line of the ids; malformed lines stay, blank lines of rewritten files vanish.
        KeyError if no line has any of them. The new version's number."""
        version = self.version()
        live = self.manifest(version)
        ids = erase_ids.select("id").where("id IS NOT NULL").distinct()
        parsed = self._parsed(self._lines(self._may_hold(ids, live)))
        holding = [r["seq"] for r in parsed.join(ids.select(F.col("id").alias("_id")), F.col("lead.id") == F.col("_id"), "left_semi")
                   .select("seq").distinct().collect()]                                                    # a row per file
        if not holding:
            raise KeyError("lead id not found")
        rows = parsed.where(F.col("seq").isin(holding)).select("line_no", "value", "lead", "blank")
        kept = lead_erase(rows, ids).select(F.col("line_no.seq").alias("seq"), F.col("line_no.at").alias("at"), "value")
        self._publish(live.where(~F.col("seq").isin(holding)).unionByName(self._write(kept)), version + 1)
        return version + 1

    def vacuum_list(self, keep_versions: int = 1) -> DataFrame:
        """Files that only versions before the last ``keep_versions`` hold."""
        versions = sorted(int(f.removeprefix("v=")) for f in self._folders("manifest"))
        paths = lambda some: self.spark.read.schema(MANIFEST).parquet(
            *[f"{self.path}/manifest/v={v}" for v in some]).select("path").distinct()
        return paths(versions).join(paths(versions[-keep_versions:]), "path", "left_anti")
