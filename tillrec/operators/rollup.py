"""Month totals from stored partial aggregates: a late file updates its months without rereading the ledger.

A batch of ledger and gap rows is reduced to one row per (month, source, method) of sums and counts and
appended as a partition ``run``/``batch`` of its own (a repeated batch replaces itself). Sums and counts merge by
addition, so a month's statement is the sum of its batches; a batch is retracted by dropping its partition from the sum. A
month run anew is another ``run``: ``latest_run_only`` takes the newest run of each month, else all count.

Money stays in decimals until a statement is asked for, so merged months equal those of the whole ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.constants import SOURCE_MARKETPLACE, SOURCE_POS
from tillrec.operators.statement import STATEMENT_MONEY, month_of

_SUM = "decimal(38,2)"
PARTIALS = (f"reference_month string, kind string, source string, payment_method string, n long, clipped {_SUM}, positive {_SUM}, "
            f"commission {_SUM}, fees {_SUM}, gap_value {_SUM}")
_KEYS = ["reference_month", "kind", "source", "payment_method"]
_SUMS = ["n", "clipped", "positive", "commission", "fees", "gap_value"]


def _money(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(_SUM)


def partials(ledger: DataFrame, gaps: DataFrame) -> DataFrame:
    """PARTIALS rows of a batch: ``kind`` ledger (per month, source and method) and gap (per month and source)."""
    zero, gross = F.lit(0).cast("decimal(18,2)"), F.col("gross_value")
    nothing = F.lit(0).cast(_SUM)
    of_ledger = ledger.groupBy(month_of(F.col("date")).alias("reference_month"), F.lit("ledger").alias("kind"), "source", "payment_method").agg(
        F.count(F.lit(1)).alias("n"), _money(F.greatest(gross, zero)).alias("clipped"), _money(F.when(gross > 0, gross)).alias("positive"),
        _money(F.col("ifood_commission_computed")).alias("commission"), _money(F.col("mdr_fee")).alias("fees"), nothing.alias("gap_value"))
    of_gaps = gaps.groupBy(month_of(F.col("gap_date")).alias("reference_month"), F.lit("gap").alias("kind"), "source",
                           F.lit(None).cast("string").alias("payment_method")).agg(
        F.count(F.lit(1)).alias("n"), *[nothing.alias(c) for c in ("clipped", "positive", "commission", "fees")],
        _money(F.col("amount_brl").cast("decimal(18,2)")).alias("gap_value"))
    return of_ledger.unionByName(of_gaps)


class MonthBook:
    """Partial aggregates of all batches, below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, ledger: DataFrame, gaps: DataFrame, run: str, batch: int = 0) -> None:
        """Append a batch of a run; the same batch again replaces what it wrote."""
        partials(ledger, gaps).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")

    def retract(self, run: str, batch: int = 0) -> None:
        """Take a batch out of all sums (an empty batch stands in its place)."""
        self.spark.createDataFrame([], PARTIALS).write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")

    def _rows(self, latest_run_only: bool) -> DataFrame:
        rows = self.spark.read.schema(f"{PARTIALS}, run string, batch int").parquet(self.path)
        if latest_run_only:
            newest = rows.groupBy(F.col("reference_month").alias("_month")).agg(F.max("run").alias("_run"))
            rows = rows.join(newest, F.col("reference_month").eqNullSafe(F.col("_month")) & (F.col("run") == F.col("_run")), "left_semi")
        return rows

    def merged(self, latest_run_only: bool = False) -> DataFrame:
        """PARTIALS rows, one per key, over all batches."""
        return self._rows(latest_run_only).groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in _SUMS])

    def statements(self, latest_run_only: bool = False) -> DataFrame:
        """One row per month, as ``statement.monthly_statements`` gives them for the whole ledger and gaps."""
        m = self.merged(latest_run_only)
        of = lambda c, kind, source=None: F.coalesce(F.sum(F.when(
            (F.col("kind") == kind) & (F.lit(True) if source is None else F.col("source") == source), F.col(c))), F.lit(0))
        sums = m.groupBy("reference_month").agg(
            F.round(of("clipped", "ledger", SOURCE_POS), 2).alias("_pos"), F.round(of("clipped", "ledger", SOURCE_MARKETPLACE), 2).alias("_mk"),
            F.round(of("commission", "ledger"), 2).alias("_comm"), F.round(of("fees", "ledger"), 2).alias("_fees"),
            of("n", "gap").cast("int").alias("gaps_detected"), F.round(of("gap_value", "gap"), 2).cast("double").alias("gaps_value_brl"),
            F.sum("n").alias("_rows")).where("_rows > 0")
        total, deductions = F.col("_pos") + F.col("_mk"), F.col("_comm") + F.col("_fees")
        values = [F.col("_pos"), F.col("_mk"), total, F.col("_comm"), F.col("_fees"), deductions, total - deductions]
        return sums.select("reference_month", *[v.cast("double").alias(c) for v, c in zip(values, STATEMENT_MONEY)],
                           "gaps_detected", "gaps_value_brl")

    def revenue_by_payment(self, latest_run_only: bool = False) -> DataFrame:
        """Positive gross per month and method, as ``statement.revenue_by_payment``."""
        return self.merged(latest_run_only).where("kind = 'ledger'").groupBy("reference_month", "payment_method") \
            .agg(F.sum("positive").alias("s")).where("s > 0") \
            .select("reference_month", "payment_method", F.round("s", 2).cast("double").alias("revenue_brl"))
