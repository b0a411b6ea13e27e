"""Registry of named queries: Spark builders and their DuckDB oracle SQL.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole shared tables. Money columns leave as DOUBLE; column names match the
oracle SQL exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.config import Rates
from tillrec.functions.enums import in_enum, normalise
from tillrec.functions.money import is_optional_blank, parse_money
from tillrec.functions.text import py_strip
from tillrec.constants import (
    ACQUIRER_PAYMENT_MAP, MARKETPLACE_PAYMENT_MAP, ORDER_STATUSES, PAYMENT_METHODS, POS_PAYMENT_MAP, STATUS_MAP,
)
from tillrec.operators import alerts as A, bursts, enrich, history as H, leads as L, reconcile, statement, \
    validate as V
from tillrec.plans import oracle, staging, stored_queries
from tillrec.session import kept
from tillrec.sources import derived, spec as S

REFERENCE_MONTH = "2026-03"
RATES = Rates()

Builder = Callable[[SparkSession, str], DataFrame]


def _d(col: str) -> F.Column:
    return F.col(col).cast("double").alias(col)


class Inputs:
    """Lazily built, per-call source tables for one (spark, sf_dir)."""

    def __init__(self, spark: SparkSession, sf_dir: str, rates: Rates = RATES):
        self.spark, self.sf_dir, self.rates = spark, sf_dir, rates

    def pos(self) -> DataFrame:
        return derived.pos(self.spark, self.sf_dir)

    def acquirer(self) -> DataFrame:
        return derived.acquirer(self.spark, self.sf_dir)

    def marketplace(self) -> DataFrame:
        return derived.marketplace(self.spark, self.sf_dir)

    def mk_enriched(self) -> DataFrame:
        return enrich.marketplace_enriched(self.marketplace(), self.rates)

    def pos_with_fees(self) -> DataFrame:
        return enrich.pos_with_fees(self.pos(), self.acquirer(), self.rates)

    def pos_enriched(self) -> DataFrame:
        return enrich.pos_enriched(self.pos(), self.acquirer(), self.rates)

    def ledger(self) -> DataFrame:
        return enrich.unified_ledger(self.mk_enriched(), self.pos_enriched())

    def gaps(self) -> DataFrame:
        return reconcile.gaps_all(self.pos(), self.acquirer(), self.marketplace(), self.rates)


def q_marketplace_enriched(spark, sf_dir):
    m = Inputs(spark, sf_dir).mk_enriched()
    return m.select("source", "order_id", "order_date", _d("gross_value"), _d("ifood_commission_computed"),
                    _d("net_value"), _d("mdr_fee"), "payment_method", "status")


def q_pos_fee_lookup(spark, sf_dir):
    p = Inputs(spark, sf_dir).pos_with_fees()
    return p.select("transaction_id", _d("gross_value"), "matched", _d("mdr_fee"))


def q_pos_fee_fallback(spark, sf_dir):
    p = Inputs(spark, sf_dir).pos_with_fees().where(~F.col("matched"))
    return p.select("transaction_id", "payment_method", _d("gross_value"),
                    F.col("mdr_fee").cast("double").alias("fallback_fee"))


def q_pos_enriched(spark, sf_dir):
    p = Inputs(spark, sf_dir).pos_enriched()
    return p.select("source", "transaction_id", "transaction_date", _d("gross_value"),
                    _d("ifood_commission_computed"), _d("net_value"), _d("mdr_fee"), "payment_method", "matched")


def q_unified_ledger(spark, sf_dir):
    led = Inputs(spark, sf_dir).ledger()
    return led.select("source", "record_id", "date", _d("gross_value"), _d("net_value"), _d("mdr_fee"),
                      _d("ifood_commission_computed"), "payment_method", "status")


def q_ledger_net(spark, sf_dir):
    led = enrich.ledger_net(Inputs(spark, sf_dir).ledger())
    return led.select("source", "record_id", _d("net_value_final"))


def q_income_statement(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return statement.income_statement(i.ledger(), i.gaps(), REFERENCE_MONTH)


def q_revenue_by_payment(spark, sf_dir):
    return statement.revenue_by_payment(Inputs(spark, sf_dir).ledger())


def q_gaps_pos_missing(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reconcile.gaps_pos_missing(i.pos(), i.acquirer(), i.rates)


def q_gaps_acquirer_missing(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reconcile.gaps_acquirer_missing(i.acquirer(), i.pos(), i.rates)


def q_gaps_cancelled(spark, sf_dir):
    return reconcile.gaps_cancelled(Inputs(spark, sf_dir).marketplace())


def q_gaps_amount_mismatch_documented(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reconcile.gaps_amount_mismatch(i.pos(), i.acquirer(), i.rates, "documented")


def q_gaps_all_documented(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reconcile.gaps_all(i.pos(), i.acquirer(), i.marketplace(), i.rates, "documented")


def q_gaps_all_repeats(spark, sf_dir):
    """Documented gaps where ids repeat and many amounts are equal."""
    i = Inputs(spark, sf_dir)
    sales, settlements = derived.with_repeats(i.pos(), i.acquirer())
    return reconcile.gaps_all(sales, settlements, i.marketplace(), i.rates, "documented")


def q_gaps_all(spark, sf_dir):
    return Inputs(spark, sf_dir).gaps()


# ------------------------------------------------------------------ parse / validate (raw export text)

def stripped(df: DataFrame) -> DataFrame:
    """Trim every string column (python strip semantics); keep the row order as row index."""
    cols = [py_strip(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    return df.select(*cols).withColumnRenamed("row_order", V.ROW_COL)


class RawInputs:
    """Validated exports; nothing is stored here: most queries read each of them once."""

    def __init__(self, spark: SparkSession, sf_dir: str, rates: Rates = RATES):
        self.spark, self.sf_dir, self.rates = spark, sf_dir, rates

    def v_marketplace(self) -> DataFrame:
        return V.validate(stripped(derived.raw_marketplace(self.spark, self.sf_dir)), S.MARKETPLACE)

    def v_pos(self) -> DataFrame:
        return V.validate(stripped(derived.raw_pos(self.spark, self.sf_dir)), S.POS)

    def v_acquirer(self) -> DataFrame:
        return V.validate(stripped(derived.raw_acquirer(self.spark, self.sf_dir)), S.ACQUIRER)


def q_parse_money(spark, sf_dir):
    raw = derived.raw_pos(spark, sf_dir)
    return raw.select("row_order", F.col("gross_value").alias("gross_text"),
                      parse_money(F.col("gross_value")).cast("double").alias("gross_value"))


def q_parse_optional_money(spark, sf_dir):
    v = RawInputs(spark, sf_dir).v_marketplace()
    return v.select(F.col(V.ROW_COL).alias("row_order"), F.col("raw_ifood_commission").alias("commission_text"),
                    F.col("ifood_commission").cast("double").alias("commission"),
                    (is_optional_blank(F.col("raw_ifood_commission")) | F.col("ifood_commission").isNotNull())
                    .alias("commission_ok"))


def q_parse_dates(spark, sf_dir):
    r = RawInputs(spark, sf_dir)
    p = r.v_pos().select(F.lit("pos").alias("source"), F.col(V.ROW_COL).alias("row_order"),
                         F.col("raw_transaction_date").alias("date_text"), F.col("transaction_date").alias("parsed"))
    a = r.v_acquirer().select(F.lit("acquirer").alias("source"), F.col(V.ROW_COL).alias("row_order"),
                              F.col("raw_settlement_date").alias("date_text"),
                              F.col("settlement_date").alias("parsed"))
    return p.unionByName(a)


def q_normalise_payment(spark, sf_dir):
    out = None
    for source, fn, mapping in (("marketplace", derived.raw_marketplace, MARKETPLACE_PAYMENT_MAP),
                                ("pos", derived.raw_pos, POS_PAYMENT_MAP),
                                ("acquirer", derived.raw_acquirer, ACQUIRER_PAYMENT_MAP)):
        raw = stripped(fn(spark, sf_dir))
        norm = normalise(F.col("payment_method"), mapping)
        part = raw.select(F.lit(source).alias("source"), F.col(V.ROW_COL).alias("row_order"),
                          F.col("payment_method").alias("method_text"), norm.alias("payment_method"),
                          in_enum(norm, PAYMENT_METHODS).alias("is_valid"))
        out = part if out is None else out.unionByName(part)
    return out


def q_normalise_status(spark, sf_dir):
    raw = stripped(derived.raw_marketplace(spark, sf_dir))
    norm = normalise(F.col("status"), STATUS_MAP)
    return raw.select(F.col(V.ROW_COL).alias("row_order"), F.col("status").alias("status_text"),
                      norm.alias("status"), in_enum(norm, ORDER_STATUSES).alias("is_valid"))


def q_trim_strings(spark, sf_dir):
    raw = derived.raw_pos(spark, sf_dir)
    return raw.select("row_order", F.col("cashier_id").alias("cashier_text"),
                      py_strip(F.col("cashier_id")).alias("cashier_id"))


def q_validate_split(spark, sf_dir):
    v = RawInputs(spark, sf_dir).v_marketplace()
    return v.select(V.ROW_COL, F.col("raw_order_id").alias("order_id"),
                    F.col(V.ERROR_COL).isNull().alias("is_valid"), V.ERROR_COL)


def q_validate_installments(spark, sf_dir):
    v = RawInputs(spark, sf_dir).v_acquirer()
    return v.select(V.ROW_COL, F.col("raw_installments").alias("installments_text"), "installments",
                    F.col("installments").isNotNull().alias("installments_ok"))


def q_validate_net_le_gross(spark, sf_dir):
    v = V.parsed_once(RawInputs(spark, sf_dir).v_acquirer())
    only_cross = F.col(V.ERROR_COL).isNull() | (F.col(V.ERROR_COL) == V.MSG_NET_GT_GROSS)
    return v.where(only_cross).select(
        V.ROW_COL, _d("gross_value"), _d("net_value"),
        (F.col(V.ERROR_COL).isNull()).alias("net_ok"))


def q_quarantine_log(spark, sf_dir):
    r = RawInputs(spark, sf_dir)
    out = None
    for source, v, sp in (("marketplace", r.v_marketplace(), S.MARKETPLACE), ("pos", r.v_pos(), S.POS),
                          ("acquirer", r.v_acquirer(), S.ACQUIRER)):
        q = V.quarantine_log(V.parsed_once(v), sp, source)
        out = q if out is None else out.unionByName(q)
    # the map as text: field=value in name order
    entries = F.array_sort(F.map_entries("original"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return out.withColumn("original", text)


def q_extraction_counts(spark, sf_dir):
    r = RawInputs(spark, sf_dir)
    return (V.counts(r.v_marketplace(), "marketplace")
            .unionByName(V.counts(r.v_pos(), "pos"))
            .unionByName(V.counts(r.v_acquirer(), "acquirer")))


def run_tables(spark: SparkSession, sf_dir: str, rates: Rates = RATES):
    """Valid rows of the three raw exports -> (ledger, gaps, counts)."""
    r = RawInputs(spark, sf_dir, rates)
    exports = staging.stored({"marketplace": (r.v_marketplace(), S.MARKETPLACE), "pos": (r.v_pos(), S.POS),
                              "acquirer": (r.v_acquirer(), S.ACQUIRER)}, originals=False)
    vm, vp, va = exports["marketplace"], exports["pos"], exports["acquirer"]
    mk = V.valid_rows(vm, S.MARKETPLACE)
    ps = V.valid_rows(vp, S.POS)
    aq = V.valid_rows(va, S.ACQUIRER)
    order = F.struct(F.col(V.ROW_COL), F.col("authorization_code"))
    ledger = enrich.unified_ledger(enrich.marketplace_enriched(mk, rates),
                                   enrich.pos_enriched(ps, aq, rates, order))
    gaps = reconcile.gaps_all(ps, aq, mk, rates)
    counts = (V.counts(vm, "marketplace").unionByName(V.counts(vp, "pos"))
              .unionByName(V.counts(va, "acquirer")))
    return ledger, gaps, counts


def q_run_summary(spark, sf_dir):
    ledger, gaps, counts = run_tables(spark, sf_dir)
    st = statement.income_statement(ledger, gaps, REFERENCE_MONTH)

    def valid_of(source: str):
        return counts.where(F.col("source") == source).agg(F.sum("valid_rows")).scalar()

    return st.select(
        "reference_month", valid_of("marketplace").alias("total_ifood_orders"),
        valid_of("pos").alias("total_pdv_transactions"), valid_of("acquirer").alias("total_acquirer_transactions"),
        counts.agg(F.sum("quarantined_rows")).scalar().alias("quarantined_rows"),
        F.col("total_gross_revenue_brl").alias("gross_revenue_brl"),
        F.col("total_deductions_brl").alias("total_fees_brl"), "net_revenue_brl", "gaps_detected")


# ------------------------------------------------------------------ history, alerts, leads, bursts

LOOKUP_MONTH = "1998-06"
DRILL_MIN_AMOUNT = 1000.0
TREND_N = 6
RUN_STAMP = "20260401_000000"
GENERATED_AT = "2026-04-01T00:00:00"
LEAD_ID = "LEAD-00000042"
PAGE_FROM, PAGE_TO, PAGE_SKIP, PAGE_LIMIT = "2026-01-15 00:00:00", "2026-02-15 00:00:00", 10, 100


def _metrics(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return H.period_metrics(H.artefacts_from_ledger(i.ledger(), i.gaps(), RUN_STAMP, GENERATED_AT))


def q_period_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir).drop("file_name")


def q_period_index(spark, sf_dir):
    return H.period_index(_metrics(spark, sf_dir))


def q_latest_period(spark, sf_dir):
    return H.latest_period(_metrics(spark, sf_dir))


def q_trend_last_n(spark, sf_dir):
    return H.trend_last_n(_metrics(spark, sf_dir), TREND_N)


def q_period_lookup(spark, sf_dir):
    return H.period_lookup(_metrics(spark, sf_dir), LOOKUP_MONTH)


def q_gap_drilldown(spark, sf_dir):
    return H.gap_drilldown(Inputs(spark, sf_dir).gaps(), LOOKUP_MONTH, DRILL_MIN_AMOUNT)


def _alerts(spark, sf_dir):
    return A.alerts_from_gaps(Inputs(spark, sf_dir).gaps())


def q_alerts_from_gaps(spark, sf_dir):
    return _alerts(spark, sf_dir)


ALERT_ID = "IFOOD_ORDER_CANCELLED:0"


def q_alert_lookup(spark, sf_dir):
    return A.alert_lookup(_alerts(spark, sf_dir), ALERT_ID)


def q_alert_routing(spark, sf_dir):
    return A.alert_routing(_alerts(spark, sf_dir), derived.subscribers(spark, sf_dir)).select(
        "alert_id", "severity", "subscriber_id", "channel")


def _kept_alerts(gaps):
    """What states and totals read of the alerts, stored: acknowledgements derive from them as well."""
    return kept(A.alerts_from_gaps(gaps).select("alert_id", "severity", "amount_brl", "created_at"), "alerts")


def q_alert_state(spark, sf_dir):
    al = _kept_alerts(Inputs(spark, sf_dir).gaps())
    return A.alert_state(al, derived.acknowledgements(al))


def q_alerts_open(spark, sf_dir):
    al = _kept_alerts(Inputs(spark, sf_dir).gaps())
    return A.alerts_open(al, derived.acknowledgements(al)).select("alert_id", "severity", "amount_brl")


def q_dashboard_totals(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    gaps = kept(i.gaps(), "gaps")
    al = _kept_alerts(gaps)
    metrics = H.period_metrics(H.artefacts_from_ledger(i.ledger(), gaps, RUN_STAMP, GENERATED_AT))
    return H.dashboard_totals(metrics, A.alerts_open(al, derived.acknowledgements(al)))


def _lead_lines(spark, sf_dir):
    return L.parse_lines(derived.lead_lines(spark, sf_dir))


def q_lead_count(spark, sf_dir):
    return L.lead_count(_lead_lines(spark, sf_dir))


def q_lead_validate(spark, sf_dir):
    return L.lead_validate(_lead_lines(spark, sf_dir))


def q_lead_page(spark, sf_dir):
    return L.lead_page(_lead_lines(spark, sf_dir), PAGE_FROM, PAGE_TO, PAGE_SKIP, PAGE_LIMIT)


def q_lead_lookup(spark, sf_dir):
    return L.lead_lookup(_lead_lines(spark, sf_dir), LEAD_ID)


def q_lead_erase(spark, sf_dir):
    parsed = _lead_lines(spark, sf_dir)
    erase = (derived.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 29 == 0)
             .select(F.concat(F.lit("LEAD-"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("id")))
    return L.lead_erase(parsed, erase).select("line_no", "id")


def q_clean_html_text(spark, sf_dir):
    from tillrec.functions.text import clean_markup
    pages = derived.table(spark, sf_dir, "pages")
    text = clean_markup(F.col("html"))
    return pages.select("page_id", text.alias("clean_text"), F.length(text).alias("n_chars"))


def q_burst_counts(spark, sf_dir):
    return bursts.burst_counts(derived.table(spark, sf_dir, "events"))


def q_burst_flags(spark, sf_dir):
    """Exact admission flags (a sequential fold per key)."""
    return bursts.burst_flags(derived.table(spark, sf_dir, "events"))


# ------------------------------------------------------------------ sinks (the tables a run writes)

def q_ledger_export(spark, sf_dir):
    from tillrec.sinks.writers import ledger_sheet
    led = enrich.ledger_net(Inputs(spark, sf_dir).ledger())
    money = ["gross_value", "net_value", "mdr_fee", "ifood_commission_computed", "net_value_final"]
    return ledger_sheet(led.select(*[_d(c) if c in money else F.col(c) for c in led.columns]))


def q_gap_export(spark, sf_dir):
    from tillrec.sinks.writers import gap_sheet
    return gap_sheet(Inputs(spark, sf_dir).gaps())


def _monthly(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    ledger, gaps = i.ledger(), i.gaps()
    return statement.monthly_statements(ledger, gaps), statement.revenue_by_payment(ledger, "reference_month")


def q_income_statement_json(spark, sf_dir):
    from tillrec.sinks.writers import statement_records
    st, byp = _monthly(spark, sf_dir)
    rec = statement_records(st, statement.revenue_map(byp, "reference_month"), GENERATED_AT)
    entries = F.array_sort(F.map_entries("revenue_by_payment"))
    text = F.array_join(F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("decimal(18,2)").cast("string"))), ";")
    return rec.withColumn("revenue_by_payment", text)


def q_statement_rows(spark, sf_dir):
    st, byp = _monthly(spark, sf_dir)
    return statement.statement_rows(st, byp, GENERATED_AT, str(RATES.commission_rate))


def queries() -> dict[str, Builder]:
    own = {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
    return own | stored_queries.queries()


def oracle_sql() -> dict[str, str]:
    sql = {}
    sql.update(oracle.core_sql(REFERENCE_MONTH))
    sql.update(oracle.mismatch_sql())
    sql.update(oracle.raw_sql(REFERENCE_MONTH))
    sql.update(oracle.sink_sql(GENERATED_AT))
    sql.update(oracle.alert_lookup_sql(ALERT_ID))
    sql.update(oracle.more_sql(LOOKUP_MONTH, DRILL_MIN_AMOUNT, TREND_N, RUN_STAMP, GENERATED_AT, LEAD_ID,
                               PAGE_FROM, PAGE_TO, PAGE_SKIP, PAGE_LIMIT))
    return sql | stored_queries.oracle_sql(sql)
