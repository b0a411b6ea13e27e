"""Continuous ingest of export files dropped into a landing folder.

``readStream`` picks up new CSV files of one source; each micro-batch is
normalised and validated with the same Column rules as the batch job and
written to two tables (valid rows, quarantine) in ``foreachBatch``, each epoch
into a partition of its own: a replayed epoch replaces its rows, so restarts and
lost executors neither lose nor double any. The CSV header of the source is given up front (a stream needs a
fixed schema).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillrec.operators import validate as V
from tillrec.sources.files import CORRUPT_COL, normalise_columns
from tillrec.sources.spec import SourceSpec


def landing_stream(spark: SparkSession, landing_dir: str, spec: SourceSpec, header: list[str],
                   sep: str = ";") -> DataFrame:
    schema = T.StructType([T.StructField(h, T.StringType()) for h in header]
                          + [T.StructField(CORRUPT_COL, T.StringType())])
    raw = (spark.readStream.schema(schema)
           .option("header", True).option("sep", sep).option("encoding", "UTF-8")
           .option("quote", '"').option("escape", '"').option("multiLine", True)
           .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT_COL)
           .csv(landing_dir))
    return raw.select(*[F.col(f"`{h}`") for h in header], CORRUPT_COL,
                      F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"))


def ingest_batch(spec: SourceSpec, out_dir: str):
    """foreachBatch body: validate once, write valid rows and quarantine into the epoch's own
    partition. ``foreachBatch`` may run an epoch again after a failure; it then replaces what it wrote."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        v = V.validate(normalise_columns(batch, spec), spec).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            V.valid_rows(v, spec).write.mode("overwrite").parquet(f"{out_dir}/valid/epoch_id={epoch_id}")
            V.quarantine_rows(v, spec).write.mode("overwrite").parquet(f"{out_dir}/quarantine/epoch_id={epoch_id}")
        finally:
            v.unpersist()
    return run


def start_ingest(spark: SparkSession, landing_dir: str, spec: SourceSpec, header: list[str], out_dir: str,
                 checkpoint_dir: str, sep: str = ";", available_now: bool = False):
    """Start the ingest query; ``available_now`` processes what is there and stops."""
    stream = landing_stream(spark, landing_dir, spec, header, sep)
    writer = stream.writeStream.foreachBatch(ingest_batch(spec, out_dir)).option("checkpointLocation",
                                                                                 checkpoint_dir)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
