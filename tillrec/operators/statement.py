"""Income statement aggregates (one hash aggregate, partial + final).

Grouping keys are optional: ``group=None`` gives the one-row statement of a
run (the month is only a label); ``group="reference_month"`` gives one
statement per calendar month of the row dates (history).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillrec.constants import SOURCE_MARKETPLACE, SOURCE_POS
from tillrec.functions.dates import ntz_text
from tillrec.functions.money import MONEY
from tillrec.functions.text import brl_grouped, capitalize

STATEMENT_MONEY = ["gross_revenue_pdv_brl", "gross_revenue_ifood_brl", "total_gross_revenue_brl",
                   "total_ifood_commission_brl", "total_card_fees_brl", "total_deductions_brl",
                   "net_revenue_brl"]


def month_of(ts: Column) -> Column:
    return ntz_text(ts, "yyyy-MM")


def _r2(c: Column) -> Column:
    return F.round(c, 2)


def statement_totals(ledger: DataFrame, group: str | None = None) -> DataFrame:
    """Clipped gross per source, deductions and net, each rounded to cents (as double)."""
    zero = F.lit(0).cast(MONEY)
    pos_gross = F.sum(F.when(F.col("source") == SOURCE_POS, F.greatest(F.col("gross_value"), zero)))
    mk_gross = F.sum(F.when(F.col("source") == SOURCE_MARKETPLACE, F.greatest(F.col("gross_value"), zero)))
    aggs = [
        _r2(F.coalesce(pos_gross, zero)).alias("_pos"),
        _r2(F.coalesce(mk_gross, zero)).alias("_mk"),
        _r2(F.coalesce(F.sum("ifood_commission_computed"), zero)).alias("_comm"),
        _r2(F.coalesce(F.sum("mdr_fee"), zero)).alias("_fees"),
    ]
    if group:
        agg = ledger.withColumn(group, month_of(F.col("date"))).groupBy(group).agg(*aggs)
        keys = [group]
    else:
        agg = ledger.agg(*aggs)
        keys = []
    total = _r2(F.col("_pos") + F.col("_mk"))
    deductions = _r2(F.col("_comm") + F.col("_fees"))
    return agg.select(
        *keys,
        F.col("_pos").cast("double").alias("gross_revenue_pdv_brl"),
        F.col("_mk").cast("double").alias("gross_revenue_ifood_brl"),
        total.cast("double").alias("total_gross_revenue_brl"),
        F.col("_comm").cast("double").alias("total_ifood_commission_brl"),
        F.col("_fees").cast("double").alias("total_card_fees_brl"),
        deductions.cast("double").alias("total_deductions_brl"),
        _r2(total - deductions).cast("double").alias("net_revenue_brl"),
    )


def gap_totals(gaps: DataFrame, group: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).cast("int").alias("gaps_detected"),
            F.round(F.coalesce(F.sum(F.col("amount_brl").cast("decimal(18,2)")), F.lit(0)), 2)
             .cast("double").alias("gaps_value_brl")]
    if group:
        return gaps.withColumn(group, month_of(F.col("gap_date"))).groupBy(group).agg(*aggs)
    return gaps.agg(*aggs)


def income_statement(ledger: DataFrame, gaps: DataFrame, reference_month: str) -> DataFrame:
    """One-row statement of a run: totals over all ledger rows, labelled with the month.

    The gap count is an uncorrelated scalar subquery (one value), so no join
    is needed to put the two global aggregates side by side.
    """
    n_gaps = gap_totals(gaps).select("gaps_detected").scalar()
    return statement_totals(ledger).select(F.lit(reference_month).alias("reference_month"),
                                           *STATEMENT_MONEY, n_gaps.alias("gaps_detected"))


def revenue_by_payment(ledger: DataFrame, group: str | None = None) -> DataFrame:
    """Positive gross per payment method, rounded (long form; one row per method)."""
    keys = [group] if group else []
    src = ledger.where(F.col("gross_value") > 0)
    if group:
        src = src.withColumn(group, month_of(F.col("date")))
    return (src.groupBy(*keys, "payment_method")
               .agg(F.round(F.sum("gross_value"), 2).cast("double").alias("revenue_brl")))


def revenue_map(by_payment: DataFrame, group: str | None = None) -> DataFrame:
    """Long form -> ``map<method, revenue>``; one entry per payment method (at most 6)."""
    keys = [group] if group else []
    return by_payment.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("payment_method", "revenue_brl"))))
         .alias("revenue_by_payment"))


def monthly_statements(ledger: DataFrame, gaps: DataFrame) -> DataFrame:
    """One statement per month present in the ledger or among the gaps."""
    g = "reference_month"
    totals = statement_totals(ledger, g)
    gt = gap_totals(gaps, g)
    out = totals.join(gt, g, "full_outer")
    return out.select(
        g, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STATEMENT_MONEY],
        F.coalesce(F.col("gaps_detected"), F.lit(0)).alias("gaps_detected"),
        F.coalesce(F.col("gaps_value_brl"), F.lit(0.0)).alias("gaps_value_brl"))


# FIXED VALUES: statement sheet layout (label, value column or None, negative flag)
def _layout(commission_pct: str) -> list[tuple[str, str | None, bool]]:
    return [
        ("", None, False),
        ("DEMONSTRATIVO DE RESULTADO DO EXERCÍCIO", None, False),
        ("Período de Referência", "reference_month", False),
        ("Gerado em", "generated_at", False),
        ("", None, False),
        ("RECEITA BRUTA", None, False),
        ("  Vendas PDV (físico)", "gross_revenue_pdv_brl", False),
        ("  Pedidos iFood (bruto)", "gross_revenue_ifood_brl", False),
        ("  TOTAL RECEITA BRUTA", "total_gross_revenue_brl", False),
        ("", None, False),
        ("DEDUÇÕES", None, False),
        (f"  Comissão iFood ({commission_pct}%)", "total_ifood_commission_brl", True),
        ("  Taxas MDR (cartões)", "total_card_fees_brl", True),
        ("  TOTAL DEDUÇÕES", "total_deductions_brl", True),
        ("", None, False),
        ("RECEITA LÍQUIDA", "net_revenue_brl", False),
        ("", None, False),
        ("FUROS DE CAIXA DETECTADOS", "gaps_detected", False),
        ("", None, False),
        ("RECEITA POR FORMA DE PAGAMENTO", None, False),
    ]


def statement_rows(statements: DataFrame, by_payment: DataFrame, generated_at: str,
                   commission_rate: str = "0.23") -> DataFrame:
    """(reference_month, line_no, item, value) rows of the statement sheet.

    ``statements`` has one row per reference_month; ``by_payment`` is the long
    form of revenue per method for the same months.
    """
    pct = f"{float(commission_rate) * 100:g}"
    entries = []
    for n, (label, col, negative) in enumerate(_layout(pct)):
        if col is None:
            value = F.lit("")
        elif col == "reference_month":
            value = F.col("reference_month")
        elif col == "generated_at":
            value = F.lit(generated_at)
        elif col == "gaps_detected":
            value = F.col("gaps_detected").cast("string")
        else:
            value = brl_grouped(F.col(col))
            if negative:
                value = F.concat(F.lit("- "), value)
        entries.append(F.struct(F.lit(n).alias("line_no"), F.lit(label).alias("item"), value.alias("value")))
    fixed = statements.select("reference_month", F.inline(F.array(*entries)))
    base = len(entries)
    methods = by_payment.select(
        "reference_month",
        (F.lit(base) - 1 + F.dense_rank().over(
            Window.partitionBy("reference_month").orderBy("payment_method"))).alias("line_no"),
        F.concat(F.lit("  "), capitalize(F.col("payment_method"))).alias("item"),
        brl_grouped(F.col("revenue_brl")).alias("value"))
    return fixed.unionByName(methods)
