"""KPIs over past income-statement artefacts (one row per run).

An artefact table has the statement columns plus ``gaps_value_brl``,
``generated_at`` and ``file_name`` (runs sort by file name). It comes either
from the JSON files written by past runs (``sources.artefacts``) or straight
from a ledger grouped by month (``artefacts_from_ledger``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillrec.constants import HOURS_PER_GAP
from tillrec.functions.dates import ntz_text
from tillrec.operators.statement import monthly_statements


def artefacts_from_ledger(ledger: DataFrame, gaps: DataFrame, run_stamp: str = "20260401_000000",
                          generated_at: str = "2026-04-01T00:00:00") -> DataFrame:
    """One artefact per calendar month of the ledger/gap dates (history of monthly runs)."""
    st = monthly_statements(ledger, gaps)
    return st.select(
        "*",
        F.lit(generated_at).alias("generated_at"),
        F.concat(F.lit("statement_"), F.col("reference_month"), F.lit(f"_{run_stamp}.json")).alias("file_name"),
    )


def _margin(net: Column, gross: Column) -> Column:
    return F.when(gross > 0, F.round(net / gross * 100, 2)).otherwise(F.lit(0.0))


def period_metrics(artefacts: DataFrame) -> DataFrame:
    """Per-artefact KPIs; net margin % = round(net / gross x 100, 2), 0 when gross <= 0."""
    gross, net = F.coalesce(F.col("total_gross_revenue_brl"), F.lit(0.0)), F.coalesce(F.col("net_revenue_brl"), F.lit(0.0))
    return artefacts.select(
        F.coalesce(F.col("reference_month"), F.lit("N/A")).alias("reference_month"),
        gross.alias("gross_revenue_brl"),
        net.alias("net_revenue_brl"),
        F.coalesce(F.col("total_deductions_brl"), F.lit(0.0)).alias("total_deductions_brl"),
        F.coalesce(F.col("total_ifood_commission_brl"), F.lit(0.0)).alias("ifood_commission_brl"),
        F.coalesce(F.col("total_card_fees_brl"), F.lit(0.0)).alias("card_fees_brl"),
        _margin(net, gross).alias("net_margin_pct"),
        F.coalesce(F.col("gaps_detected"), F.lit(0)).cast("int").alias("gaps_count"),
        F.coalesce(F.col("gaps_value_brl"), F.lit(0.0)).alias("gaps_value_brl"),
        F.col("generated_at"),
        F.col("file_name"),
    )


def period_index(metrics: DataFrame) -> DataFrame:
    return (metrics.select("reference_month", "gross_revenue_brl", "net_revenue_brl", "gaps_count")
                   .orderBy("reference_month"))


def latest_period(metrics: DataFrame) -> DataFrame:
    """Last artefact after a stable sort by month: the newest run of the newest month."""
    cols = [c for c in metrics.columns if c != "file_name"]
    best = metrics.agg(F.max_by(F.struct(*cols), F.struct("reference_month", "file_name")).alias("p"))
    return best.select("p.*")


def trend_last_n(metrics: DataFrame, n: int = 6, latest_run_only: bool = False) -> DataFrame:
    """Last ``n`` artefacts (1..24) by (month, file name) — a top-n report, so the limit is the feature."""
    if not 1 <= n <= 24:
        raise ValueError("n must be within 1..24")
    metrics = latest_runs(metrics) if latest_run_only else metrics
    top = metrics.orderBy(F.col("reference_month").desc(), F.col("file_name").desc()).limit(n)
    return top.orderBy("reference_month", "file_name").select(
        F.col("reference_month").alias("month"), F.col("gross_revenue_brl").alias("gross_revenue"),
        F.col("net_revenue_brl").alias("net_revenue"), "gaps_count")


def period_lookup(metrics: DataFrame, month: str) -> DataFrame:
    """First artefact by file name for the month (the oldest run)."""
    cols = [c for c in metrics.columns if c != "file_name"]
    return (metrics.where(F.col("reference_month") == month)
                   .agg(F.min_by(F.struct(*cols), F.col("file_name")).alias("p"))
                   .where(F.col("p").isNotNull()).select("p.*"))


def gap_drilldown(gaps: DataFrame, month: str, min_amount: float = 0.0) -> DataFrame:
    """Gaps of one month with amount >= min_amount, largest first (distributed range sort)."""
    # the threshold applies to the stored amount; rounding is for display only
    g = gaps.where((ntz_text(F.col("gap_date"), "yyyy-MM") == month)
                   & (F.coalesce(F.col("amount_brl"), F.lit(0.0)) >= F.lit(min_amount)))
    return (g.select("transaction_id", "source", F.coalesce("gap_type", F.lit("UNKNOWN")).alias("gap_type"),
                     F.round(F.col("amount_brl"), 2).alias("amount_brl"), "detail", "gap_order")
             .orderBy(F.col("amount_brl").desc(), "gap_order", "transaction_id"))


def latest_runs(artefacts: DataFrame) -> DataFrame:
    """The newest run of each month only: a month that was run again doesn't count twice. Runs without a month
    are one group."""
    return (artefacts.groupBy(F.col("reference_month").alias("_month"))
            .agg(F.max_by(F.struct(*artefacts.columns), F.col("file_name")).alias("r")).select("r.*"))


def dashboard_totals(metrics: DataFrame, open_alerts: DataFrame, latest_run_only: bool = False) -> DataFrame:
    """Recovered value and hours over ALL artefacts (or the newest run of each month), plus the open-alert
    count (one row)."""
    totals = (latest_runs(metrics) if latest_run_only else metrics).agg(
        F.round(F.coalesce(F.sum(F.col("gaps_value_brl").cast("decimal(18,2)")), F.lit(0)), 2)
         .cast("double").alias("total_recovered_brl"),
        F.round(F.coalesce(F.sum("gaps_count"), F.lit(0)) * F.lit(HOURS_PER_GAP), 1).alias("total_hours_saved"))
    opened = open_alerts.agg(F.count(F.lit(1))).scalar()
    return totals.select("*", opened.alias("alerts_open"))


def stored_gaps(gaps: DataFrame, month: str, min_amount: float = 0.0, shown_run: str | None = None) -> DataFrame:
    """Gaps of one month over stored runs (``artefacts.read_run_gaps`` or ``artefacts.artefact_gaps``):
    those of the month's first run, the one that ``period_lookup`` shows; largest first, then in the run's
    order. ``shown_run`` names it where it may have no gap rows (a run folder of parquet has none then)."""
    of_month = gaps.where(F.col("reference_month") == month)
    shown = F.lit(shown_run) if shown_run else of_month.agg(F.min("file_name")).scalar()
    is_gap = F.col("gap_type").isNotNull() | F.col("transaction_id").isNotNull()
    return (of_month.where((F.col("file_name") == shown) & is_gap & (F.coalesce(F.col("amount_brl"), F.lit(0.0)) >= F.lit(min_amount)))
            .orderBy(F.col("amount_brl").desc_nulls_last(), "gap_order", "transaction_id")
            .select("file_name", "transaction_id", "source", F.coalesce("gap_type", F.lit("UNKNOWN")).alias("gap_type"),
                    F.round(F.col("amount_brl"), 2).alias("amount_brl"), "detail"))
