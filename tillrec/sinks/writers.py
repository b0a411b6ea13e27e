"""Table sinks of a monthly run.

Every output is a partitioned dataset written by the executors (no single
writer task, nothing through the driver). The statement artefact carries its
totals and gap count; the gap rows live beside it as their own dataset, so a
month with millions of gaps is never gathered into one record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillrec.constants import GAP_HEADINGS, LEDGER_HEADINGS
from tillrec.functions.dates import ntz_text


def ledger_sheet(ledger: DataFrame) -> DataFrame:
    """Ledger with the finance team's column headings."""
    present = {k: v for k, v in LEDGER_HEADINGS.items() if k in ledger.columns}
    return ledger.withColumnsRenamed(present)


def gap_sheet(gaps: DataFrame) -> DataFrame:
    """Five gap columns with headings (in the listing order of the gap types)."""
    return gaps.select(*[F.col(k).alias(v) for k, v in GAP_HEADINGS.items()])


def statement_records(statements: DataFrame, revenue_maps: DataFrame, generated_at: str) -> DataFrame:
    """Artefact rows: statement totals, revenue map, gap count/value, generation time."""
    return (statements.join(revenue_maps, "reference_month", "left")
                      .withColumn("generated_at", F.lit(generated_at)))


# FIXED VALUES: what an empty sheet says
NO_LEDGER = "Sem dados no ledger."
NO_GAPS = "Nenhum furo de caixa detectado. ✓"
NO_QUARANTINE = "Nenhuma linha rejeitada. Todos os dados passaram na validação. ✓"


def write_tables(out_dir: str, run_stamp: str, gaps: DataFrame, ledger: DataFrame, quarantine: DataFrame,
                 mode: str = "overwrite") -> dict[str, str]:
    """Write the tables of a run under ``out_dir/<dataset>/run=<stamp>/...``; return the paths."""
    paths = {d: f"{out_dir}/{d}/run={run_stamp}" for d in ("gaps", "ledger", "quarantine")}
    (ledger.withColumn("reference_month", ntz_text(F.col("date"), "yyyy-MM"))
           .write.mode(mode).partitionBy("reference_month").parquet(paths["ledger"]))
    (gaps.withColumn("reference_month", ntz_text(F.col("gap_date"), "yyyy-MM"))
         .write.mode(mode).partitionBy("reference_month").parquet(paths["gaps"]))
    quarantine.write.mode(mode).partitionBy("source").parquet(paths["quarantine"])
    return paths


def read_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table written by ``write_tables``, with the columns of ``like``."""
    fields = [*like.schema.fields, T.StructField("reference_month", T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(path).select(like.columns)


def _sheet(rows: DataFrame, empty_text: str, path: str, mode: str) -> None:
    """A CSV sheet; an empty one says so in an ``info`` row."""
    if rows.isEmpty():
        rows = rows.sparkSession.range(1).select(F.lit(empty_text).alias("info"))
    rows.write.mode(mode).option("header", True).csv(path)


def write_reports(out_dir: str, run_stamp: str, statements: DataFrame, gaps: DataFrame, ledger: DataFrame,
                  quarantine: DataFrame, rows: DataFrame, alerts: DataFrame, mode: str = "overwrite") -> dict[str, str]:
    """Write the statement, the sheets and the alerts of a run; return the paths."""
    paths = {d: f"{out_dir}/{d}/run={run_stamp}" for d in
             ("statement", "gap_sheet", "ledger_sheet", "quarantine_sheet", "statement_rows", "alerts")}
    # one small record per month of the run; kept whole so readers see reference_month in it
    statements.write.mode(mode).json(paths["statement"])
    _sheet(gap_sheet(gaps), NO_GAPS, paths["gap_sheet"], mode)
    _sheet(ledger_sheet(ledger), NO_LEDGER, paths["ledger_sheet"], mode)
    _sheet(quarantine.withColumn("original", F.to_json("original")), NO_QUARANTINE, paths["quarantine_sheet"], mode)
    rows.write.mode(mode).partitionBy("reference_month").option("header", True).csv(paths["statement_rows"])
    alerts.write.mode(mode).parquet(paths["alerts"])
    return paths


def append_outbox(outbox: DataFrame, path: str, batch: str) -> None:
    """Write routed alerts to the delivery outbox, under the batch's own partition: writing a batch
    again replaces it, so neither a repeated run nor a replayed epoch doubles a delivery."""
    outbox.write.mode("overwrite").partitionBy("channel").parquet(f"{path}/batch={batch}")


def stream_outbox(routing_stream: DataFrame, path: str, checkpoint_dir: str):
    """Streamed variant: every micro-batch of routed alerts replaces its own partition."""
    return (routing_stream.writeStream
            .foreachBatch(lambda batch, epoch: append_outbox(batch, path, f"epoch-{epoch}"))
            .option("checkpointLocation", checkpoint_dir).start())
