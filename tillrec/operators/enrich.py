"""Commission, card-fee lookup, fee fallback and the unified ledger.

Scale notes
-----------
* ``fee_lookup`` is a grouped ``max_by`` on ``(amount, day)`` — partial
  aggregation runs map-side, so a hot key (one price on one day) is combined
  before the shuffle. Its output is hash-partitioned on the same keys as the
  following join, so the acquirer side is shuffled once.
* The pos side joins with a LEFT equi-join on ``(gross_value, day)``; AQE
  picks broadcast only when the aggregated side measures small at run time
  and splits skewed pos partitions otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillrec.config import Rates
from tillrec.constants import SOURCE_MARKETPLACE, SOURCE_POS
from tillrec.functions.enums import lookup
from tillrec.functions.money import MONEY, rate_lit, round_money

def marketplace_enriched(orders: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Listed commission if > 0 else round(gross x rate, 2); cancelled orders negate gross
    and carry no commission; net = gross - commission (delivery fee not deducted)."""
    listed = F.col("ifood_commission")
    computed = F.when(listed.isNotNull() & (listed > 0), listed).otherwise(
        round_money(F.col("gross_value") * rate_lit(rates.commission_rate)))
    cancelled = F.col("status") == "cancelado"
    gross = F.when(cancelled, -F.col("gross_value")).otherwise(F.col("gross_value")).cast(MONEY)
    commission = F.when(cancelled, F.lit(0)).otherwise(computed).cast(MONEY)
    return orders.select(
        F.lit(SOURCE_MARKETPLACE).alias("source"),
        "order_id", "order_date",
        gross.alias("gross_value"),
        commission.alias("ifood_commission_computed"),
        (gross - commission).cast(MONEY).alias("net_value"),
        F.lit(0).cast(MONEY).alias("mdr_fee"),
        "payment_method", "status",
    )


def fee_lookup(settlements: DataFrame, order: Column | str = "row_order") -> DataFrame:
    """(gross_value, day) -> fee of the LAST settlement row in file order.

    A blank fee on the winning row counts as 0, like a missing fee column.
    """
    order_col = F.col(order) if isinstance(order, str) else order
    return (settlements
            .select(F.col("gross_value").alias("lk_gross"),
                    F.to_date("settlement_date").alias("lk_day"),
                    F.coalesce(F.col("acquirer_fee"), F.lit(0).cast(MONEY)).alias("fee"),
                    order_col.alias("_order"))
            .groupBy("lk_gross", "lk_day")
            .agg(F.max_by("fee", "_order").alias("lk_fee")))


def fallback_fee(gross: Column, method: Column, rates: Rates = Rates()) -> Column:
    """round(gross x rate(method), 2); unknown methods pay the credit rate."""
    rate = F.coalesce(lookup(method, {m: str(r) for m, r in rates.fee_by_method().items()}),
                      F.lit(str(rates.credit_fee))).cast("decimal(5,4)")
    return round_money(gross * rate)


def pos_with_fees(sales: DataFrame, settlements: DataFrame, rates: Rates = Rates(),
                  order: Column | str = "row_order") -> DataFrame:
    """Every pos row with ``matched`` (a settlement has its amount and day) and ``mdr_fee``."""
    lookup = fee_lookup(settlements, order)
    joined = sales.join(
        lookup,
        (sales["gross_value"] == lookup["lk_gross"]) & (F.to_date(sales["transaction_date"]) == lookup["lk_day"]),
        "left")
    matched = F.col("lk_day").isNotNull()
    fee = F.when(matched, F.col("lk_fee")).otherwise(
        fallback_fee(F.col("gross_value"), F.col("payment_method"), rates))
    return joined.select(*sales.columns, matched.alias("matched"), fee.cast(MONEY).alias("mdr_fee"))


def pos_enriched(sales: DataFrame, settlements: DataFrame, rates: Rates = Rates(),
                 order: Column | str = "row_order") -> DataFrame:
    with_fees = pos_with_fees(sales, settlements, rates, order)
    return with_fees.select(
        F.lit(SOURCE_POS).alias("source"),
        "transaction_id", "transaction_date", "gross_value",
        F.lit(0).cast(MONEY).alias("ifood_commission_computed"),
        (F.col("gross_value") - F.col("mdr_fee")).cast(MONEY).alias("net_value"),
        "mdr_fee", "payment_method", "matched",
    )


def unified_ledger(marketplace_rows: DataFrame, pos_rows: DataFrame) -> DataFrame:
    """Union of both enriched sources with one id, one date and zero-filled numbers."""
    mk = marketplace_rows.select(
        "source", F.col("order_id").alias("record_id"), F.col("order_date").alias("date"),
        "gross_value", "net_value", "mdr_fee", "ifood_commission_computed", "payment_method", "status")
    ps = pos_rows.select(
        "source", F.col("transaction_id").alias("record_id"), F.col("transaction_date").alias("date"),
        "gross_value", "net_value", "mdr_fee", "ifood_commission_computed", "payment_method")
    ledger = mk.unionByName(ps, allowMissingColumns=True)
    zero = F.lit(0).cast(MONEY)
    return ledger.select(
        "source", "record_id", "date",
        *[F.coalesce(F.col(c), zero).alias(c)
          for c in ("gross_value", "net_value", "mdr_fee", "ifood_commission_computed")],
        "payment_method", "status")


def ledger_net(ledger: DataFrame) -> DataFrame:
    """net_value_final = round(gross - mdr - commission, 2)."""
    return ledger.withColumn(
        "net_value_final",
        round_money(F.col("gross_value") - F.col("mdr_fee") - F.col("ifood_commission_computed")))
