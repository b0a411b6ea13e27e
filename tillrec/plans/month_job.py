"""One monthly run: three export files in, statement, gaps, ledger and quarantine out.

Stages:
  read + normalise (per source) -> validate (stored below spark.checkpoint.dir for its
  consumers, the three exports side by side) -> valid rows -> commission / fee lookup / ledger -> gaps, both written first
  -> from those tables: statement (one row, month as label), per-method revenue, sheets, alerts.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.config import JobArgs
from tillrec.functions.dates import ntz_text
from tillrec.operators import alerts as A, enrich, reconcile, statement, validate as V
from tillrec.plans import staging
from tillrec.sinks import writers
from tillrec.sources import files
from tillrec.sources.spec import MARKETPLACE, POS, acquirer_spec


@dataclass
class RunOutputs:
    ledger: DataFrame
    gaps: DataFrame
    quarantine: DataFrame
    counts: DataFrame
    statement: DataFrame
    by_payment: DataFrame
    summary: DataFrame


def _union(parts) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def _derived(ledger: DataFrame, gaps: DataFrame, counts: DataFrame, month: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statement, revenue by method and summary of a ledger and its gaps."""
    st = statement.income_statement(ledger, gaps, month)
    by_payment = statement.revenue_by_payment(ledger).withColumn("reference_month", F.lit(month))

    def valid_of(source: str):
        return counts.where(F.col("source") == source).agg(F.sum("valid_rows")).scalar()

    summary = st.select(
        F.lit("success").alias("status"), "reference_month", valid_of("marketplace").alias("total_ifood_orders"),
        valid_of("pos").alias("total_pdv_transactions"), valid_of("acquirer").alias("total_acquirer_transactions"),
        counts.agg(F.sum("quarantined_rows")).scalar().alias("quarantined_rows"),
        F.col("total_gross_revenue_brl").alias("gross_revenue_brl"),
        F.col("total_deductions_brl").alias("total_fees_brl"), "net_revenue_brl", "gaps_detected")
    return st, by_payment, summary


def build_run(spark: SparkSession, args: JobArgs, filter_month: bool = False, legacy_nan: bool = False,
              gap_mode: str = "as_executed") -> RunOutputs:
    rates = args.rates
    specs = {"marketplace": MARKETPLACE, "pos": POS, "acquirer": acquirer_spec(args.acquirer_name)}
    paths = {"marketplace": args.marketplace_path, "pos": args.pos_path, "acquirer": args.acquirer_path}
    validated = staging.stored({k: (V.validate(files.read_export(spark, paths[k], specs[k]), specs[k], legacy_nan), specs[k])
                                for k in specs})
    valid = {k: V.valid_rows(validated[k], specs[k]) for k in specs}
    if filter_month:
        date_col = {"marketplace": "order_date", "pos": "transaction_date", "acquirer": "settlement_date"}
        valid = {k: v.where(ntz_text(F.col(date_col[k]), "yyyy-MM") == args.reference_month)
                 for k, v in valid.items()}
    quarantine = _union(V.quarantine_log(validated[k], specs[k], k) for k in specs)
    counts = _union(V.counts(validated[k], k) for k in specs)
    order = V.file_order(valid["acquirer"])
    ledger = enrich.ledger_net(enrich.unified_ledger(
        enrich.marketplace_enriched(valid["marketplace"], rates),
        enrich.pos_enriched(valid["pos"], valid["acquirer"], rates, order)))
    gaps = reconcile.gaps_all(valid["pos"], valid["acquirer"], valid["marketplace"], rates, gap_mode)
    return RunOutputs(ledger, gaps, quarantine, counts, *_derived(ledger, gaps, counts, args.reference_month))


def run_month(spark: SparkSession, args: JobArgs, out_dir: str, run_stamp: str | None = None,
              filter_month: bool = False, legacy_nan: bool = False, gap_mode: str = "as_executed",
              subscribers: DataFrame | None = None) -> tuple[RunOutputs, dict[str, str]]:
    """Build and write one run; returns the outputs and the written paths.

    The ledger and the gaps are written first; the statement, the sheets, the summary and the alerts
    read those tables, so the fee join and the gap joins run once.
    """
    run_stamp = run_stamp or dt.datetime.now(dt.timezone.utc).strftime("%Y%m%d_%H%M%S")
    generated_at = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat()
    built = build_run(spark, args, filter_month, legacy_nan, gap_mode)
    paths = writers.write_tables(out_dir, run_stamp, built.gaps, built.ledger, built.quarantine)
    ledger = writers.read_table(spark, paths["ledger"], built.ledger)
    gaps = writers.read_table(spark, paths["gaps"], built.gaps)
    st, by_payment, summary = _derived(ledger, gaps, built.counts, args.reference_month)
    out = RunOutputs(ledger, gaps, built.quarantine, built.counts, st, by_payment, summary)
    gaps_value = statement.gap_totals(gaps).select("gaps_value_brl").scalar()
    records = writers.statement_records(st.withColumn("gaps_value_brl", gaps_value),
                                        statement.revenue_map(by_payment, "reference_month"), generated_at)
    rows = statement.statement_rows(st, by_payment, dt.datetime.now().strftime("%d/%m/%Y %H:%M"),
                                    str(args.rates.commission_rate))
    alerts = A.alerts_from_gaps(gaps, args.reference_month)
    paths |= writers.write_reports(out_dir, run_stamp, records, gaps, ledger, built.quarantine, rows, alerts)
    if subscribers is not None:
        paths["outbox"] = f"{out_dir}/outbox"
        writers.append_outbox(A.delivery_outbox(alerts, subscribers), paths["outbox"], run_stamp)
    return out, paths
