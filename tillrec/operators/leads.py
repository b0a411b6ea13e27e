"""Lead records: quality checks, paging, lookup, erasure and counts.

The lead store is a line file (one JSON document per line). Lines are read
with ``spark.read.text`` and parsed with ``from_json``, so malformed lines
stay visible (they count, and erasure keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillrec.constants import LEAD_SOURCES, REVENUE_BRACKETS, SYSTEM_IDS
from tillrec.functions.text import clean_markup, py_strip

LEAD_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("received_at", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("restaurant", T.StringType()),
    T.StructField("revenue", T.StringType()),
    T.StructField("systems", T.ArrayType(T.StringType())),
    T.StructField("phone", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("lgpd_consent", T.BooleanType()),
])

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def parse_lines(lines: DataFrame) -> DataFrame:
    """(line_no, value) -> plus ``lead`` struct (null for malformed lines) and ``blank``.

    A line is well-formed when it is a JSON object; it need not have an ``id``.
    """
    parsed = F.from_json(F.col("value"), LEAD_SCHEMA, {"mode": "PERMISSIVE"})
    ok = F.get_json_object(F.col("value"), "$").isNotNull() & py_strip(F.col("value")).startswith("{")
    return lines.select("line_no", "value", F.when(ok, parsed).alias("lead"),
                        (py_strip(F.col("value")) == "").alias("blank"))


def lead_count(parsed: DataFrame) -> DataFrame:
    """Non-blank lines, malformed ones included."""
    return parsed.agg(F.count_if(~F.col("blank")).alias("lead_count"))


def lead_validate(parsed: DataFrame) -> DataFrame:
    """Submission rules: cleaned name 3..120 and restaurant 2..120, known revenue bracket,
    at least one allow-listed system, raw phone 10..20 chars with 10 or 11 digits,
    consent true, optional well-formed e-mail; unknown source becomes ``other``."""
    lead = parsed.where(F.col("lead").isNotNull()).select("line_no", "lead.*")
    name = clean_markup(F.col("name"))
    restaurant = clean_markup(F.col("restaurant"))
    systems = F.filter(F.coalesce(F.col("systems"), F.array().cast("array<string>")),
                       lambda s: s.isin(*SYSTEM_IDS))
    digits = F.regexp_replace(F.col("phone"), r"[^0-9]", "")
    src = F.lower(py_strip(F.col("source")))
    checks = {
        "name": F.length(name).between(3, 120),
        "restaurant": F.length(restaurant).between(2, 120),
        "revenue": F.col("revenue").isin(*REVENUE_BRACKETS),
        "systems": F.size(systems) > 0,
        "phone": F.length(F.col("phone")).between(10, 20) & F.length(digits).between(10, 11),
        "email": F.col("email").isNull() | F.col("email").rlike(EMAIL_PATTERN),
        "lgpd_consent": F.coalesce(F.col("lgpd_consent"), F.lit(False)),
    }
    failed = F.concat_ws(",", *[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()])
    return lead.select(
        "line_no", "id",
        name.alias("name"), restaurant.alias("restaurant"),
        F.array_join(systems, ",").alias("systems"),
        digits.alias("phone"),
        F.when(src.isin(*LEAD_SOURCES), src).otherwise(F.lit("other")).alias("source"),
        (failed == "").alias("is_valid"),
        F.nullif(failed, F.lit("")).alias("failed_checks"),
    )


ISO_TIME = r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)(Z|z|[+-]\d{2}:?\d{2})?$"


def iso_utc(text: Column) -> Column:
    """ISO time text as a zone-free UTC timestamp: ``Z`` and offsets are applied, a time without one is
    UTC; null when unparseable. The session's time zone plays no part."""
    local = F.replace(F.replace(F.regexp_extract(text, ISO_TIME, 1), F.lit(" "), F.lit("T")), F.lit(","), F.lit("."))
    zone = F.replace(F.regexp_extract(text, ISO_TIME, 2), F.lit(":"), F.lit(""))
    minutes = F.when(F.length(zone) == 5, F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int")
                     * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int"))).otherwise(F.lit(0))
    parsed = F.when(local != "", F.when(F.length(local) == 16, F.concat(local, F.lit(":00"))).otherwise(local))
    at = parsed.try_cast("timestamp_ntz")
    return F.timestamp_add("MINUTE", -minutes, at)


def received_ts(parsed: DataFrame) -> DataFrame:
    """Lead received time (ISO text) as a UTC timestamp, null when unparseable."""
    return parsed.withColumn("received_ts", iso_utc(F.col("lead.received_at")))


def lead_page(parsed: DataFrame, from_ts: str | None, to_ts: str | None, skip: int = 0,
              limit: int = 100, after: int | None = None) -> DataFrame:
    """Well-formed leads in line order, date range inclusive at both ends (unparseable dates are
    kept). ``after`` is the last ``line_no`` of the page before: any page then costs one bounded top-n.
    A ``skip`` beyond 1000 numbers the lines by range partitions (one shuffle); ``lead_store`` finds deep pages from counts per file."""
    if not 1 <= limit <= 1000 or skip < 0:
        raise ValueError("limit must be 1..1000 and skip 0 or more")
    p = received_ts(parsed.where(F.col("lead").isNotNull()))
    ts = F.col("received_ts")
    keep = F.lit(True) if after is None else F.col("line_no") > F.lit(after)
    if from_ts:
        keep = keep & (ts.isNull() | (ts >= F.lit(from_ts).cast("timestamp_ntz")))
    if to_ts:
        keep = keep & (ts.isNull() | (ts <= F.lit(to_ts).cast("timestamp_ntz")))
    rows = p.where(keep).select("line_no", F.col("lead.id").alias("id"), "received_ts")
    if skip <= 1000:
        return rows.orderBy("line_no").offset(skip).limit(limit)
    return _numbered(rows).where((F.col("_nth") > skip) & (F.col("_nth") <= skip + limit)).orderBy("line_no").drop("_nth")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``_nth``, their place in the order of ``line_no``: a count inside each range partition and the
    sizes of the partitions before (a row each)."""
    from tillrec.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(rows.sparkSession)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    staged = rows.repartitionByRange(parts, "line_no").withColumn("_piece", F.spark_partition_id()).checkpoint(eager=True)
    sizes = staged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_piece", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_piece").orderBy("line_no"))
    return staged.withColumn("_inside", inside).join(before, "_piece").withColumn("_nth", F.col("_inside") + F.col("_before")) \
        .drop("_piece", "_inside", "_before")


def lead_lookup(parsed: DataFrame, lead_id: str) -> DataFrame:
    """First well-formed line carrying the id."""
    hit = parsed.where(F.col("lead.id") == lead_id)
    return hit.agg(F.min_by(F.struct("line_no", "lead.id", "lead.name"), "line_no").alias("r")) \
              .where(F.col("r").isNotNull()).select("r.*")


def lead_erase(parsed: DataFrame, erase_ids: DataFrame) -> DataFrame:
    """Drop every well-formed line whose id is in ``erase_ids``; keep malformed lines; blank
    lines vanish. Write the result to a NEW path (never over the one being read)."""
    keep = parsed.where(~F.col("blank"))
    ids = erase_ids.select(F.col("id").alias("_erase_id")).distinct()
    return (keep.join(ids, F.col("lead.id") == F.col("_erase_id"), "left_anti")
                .select("line_no", "value", F.col("lead.id").alias("id")))


def append_leads(records: DataFrame, path: str) -> None:
    """Append lead records (LEAD_SCHEMA columns) to the line store, one JSON document per line."""
    cols = [f.name for f in LEAD_SCHEMA.fields if f.name in records.columns]
    records.select(F.to_json(F.struct(*cols)).alias("value")).write.mode("append").text(path)


def read_lead_lines(spark, path: str) -> DataFrame:
    """Line store -> (line_no, value); line_no orders lines by file, split and position."""
    return spark.read.text(path).select(
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("line_no"), "value")


def erase_to_new_version(spark, store_path: str, erase_ids: DataFrame, new_path: str) -> str:
    """Erasure job: read the store, drop the ids, write the kept lines to a NEW path.

    Raises when ``new_path`` is the store itself (never overwrite what is being read) or when
    none of the ids exists (an unknown id is an error). The existence check is ``limit(1)``.
    """
    import os
    if os.path.normpath(new_path) == os.path.normpath(store_path):
        raise ValueError("write the erased store to a new path, not over the one being read")
    parsed = parse_lines(read_lead_lines(spark, store_path))
    ids = erase_ids.select(F.col("id").alias("_erase_id")).distinct()
    if parsed.join(ids, F.col("lead.id") == F.col("_erase_id"), "left_semi").limit(1).count() == 0:
        raise KeyError("lead id not found")
    lead_erase(parsed, erase_ids).orderBy("line_no").select("value").write.mode("error").text(new_path)
    return new_path
