"""Past income-statement artefacts (JSON files written by earlier runs).

Both layouts are read: the single-document file with a nested ``gaps``
array, and our own split layout (summary records carrying ``gaps_value_brl``
with the gap rows stored beside them). Unreadable files are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GAP_STRUCT = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("amount_brl", T.DoubleType()),
    T.StructField("gap_type", T.StringType()),
    T.StructField("detail", T.StringType()),
])

ARTEFACT_SCHEMA = T.StructType([
    T.StructField("reference_month", T.StringType()),
    T.StructField("gross_revenue_pdv_brl", T.DoubleType()),
    T.StructField("gross_revenue_ifood_brl", T.DoubleType()),
    T.StructField("total_gross_revenue_brl", T.DoubleType()),
    T.StructField("total_ifood_commission_brl", T.DoubleType()),
    T.StructField("total_card_fees_brl", T.DoubleType()),
    T.StructField("total_deductions_brl", T.DoubleType()),
    T.StructField("net_revenue_brl", T.DoubleType()),
    T.StructField("revenue_by_payment", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("gaps_detected", T.LongType()),
    T.StructField("gaps_value_brl", T.DoubleType()),
    T.StructField("gaps", T.ArrayType(GAP_STRUCT)),
    T.StructField("generated_at", T.StringType()),
    T.StructField("_corrupt", T.StringType()),
])


def read_artefacts(spark: SparkSession, pattern: str, multi_line: bool = True) -> DataFrame:
    """Artefact table: statement columns, ``gaps_value_brl`` and ``file_name`` (run order key).

    Runs are ordered by their stamp: the ``run=<stamp>`` folder of our own layout (its part files have
    random names), else the file name, which holds the stamp in single-document artefacts.
    """
    df = (spark.read.schema(ARTEFACT_SCHEMA)
          .option("multiLine", multi_line).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt")
          .json(pattern))
    # an artefact without a month is kept ("N/A" in the KPIs) and counts in the totals; a JSON
    # document without any statement field isn't an artefact
    known = F.coalesce(*[F.col(c).cast("string") for c in (
        "reference_month", "total_gross_revenue_brl", "net_revenue_brl", "gaps_detected", "generated_at")])
    df = df.where(F.col("_corrupt").isNull() & known.isNotNull())
    stamp = F.regexp_extract(F.col("_metadata.file_path"), r"/run=([^/]+)/", 1)
    from_array = F.aggregate(F.coalesce(F.col("gaps"), F.array().cast(T.ArrayType(GAP_STRUCT))),
                             F.lit(0).cast("decimal(38,2)"),
                             lambda acc, g: (acc + F.coalesce(g["amount_brl"], F.lit(0.0)).cast("decimal(18,2)"))
                             .cast("decimal(38,2)"))
    value = F.when(F.col("gaps").isNotNull(), F.round(from_array, 2).cast("double")) \
             .otherwise(F.coalesce(F.col("gaps_value_brl"), F.lit(0.0)))
    return df.select(
        *[c for c in df.columns if c not in ("_corrupt", "gaps", "gaps_value_brl")],
        value.alias("gaps_value_brl"),
        F.when(stamp != "", stamp).otherwise(F.col("_metadata.file_name")).alias("file_name"),
        "gaps",
    )


def artefact_gaps(artefacts: DataFrame) -> DataFrame:
    """Gap rows of legacy artefacts, tagged with month, file and place in the file (``gap_order``). A run
    without gaps has one row of nulls, so that it still counts as the month's first run."""
    placed = artefacts.select("reference_month", "file_name", F.posexplode_outer("gaps").alias("gap_order", "g"))
    return placed.select("reference_month", "file_name", "g.*", "gap_order")


def read_run_gaps(spark: SparkSession, gaps_dir: str) -> DataFrame:
    """Gap rows of all stored runs (``<gaps_dir>/run=<stamp>/reference_month=<month>``), with the stamp
    as ``file_name`` like the artefacts; month and run are partition columns, so filters prune files."""
    fields = [*GAP_STRUCT.fields, T.StructField("gap_date", T.TimestampNTZType()),
              T.StructField("gap_order", T.IntegerType()), T.StructField("run", T.StringType()),
              T.StructField("reference_month", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(gaps_dir).withColumnRenamed("run", "file_name")
