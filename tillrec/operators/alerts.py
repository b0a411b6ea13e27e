"""Alerts from gaps, subscriber routing and acknowledgement state.

Routing is an equi-join: each alert is expanded to the severity ranks it
satisfies (at most four) and joined to subscribers on their filter rank, so
no nested-loop join is planned; AQE broadcasts the subscriber side only when
it measures small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillrec.constants import SEVERITY_RANK, SEVERITY_THRESHOLDS
from tillrec.functions.dates import ntz_text
from tillrec.functions.enums import lookup


def severity(amount: Column) -> Column:
    expr = None
    for threshold, name in SEVERITY_THRESHOLDS:
        expr = F.when(amount >= threshold, F.lit(name)) if expr is None else expr.when(amount >= threshold,
                                                                                         F.lit(name))
    return expr.otherwise(F.lit("low"))


def severity_rank(sev: Column) -> Column:
    return lookup(sev, {k: str(v) for k, v in SEVERITY_RANK.items()}).cast("int")


# FIXED VALUES: message of a gap without a detail text
DEFAULT_MESSAGE = "Divergencia financeira detectada."


def alert_id(gap_type: Column, transaction_id: Column, source: Column, amount: Column, date: Column) -> Column:
    """``type:transaction:digest``: a transaction can have several gaps, told apart by source, amount and
    date. Gaps equal in all of these can't be told apart and share an id."""
    digest = F.md5(F.concat_ws("|", F.coalesce(source, F.lit("")), amount.cast("decimal(18,2)").cast("string"),
                               F.coalesce(ntz_text(date, "yyyy-MM-dd HH:mm:ss"), F.lit(""))))
    return F.concat_ws(":", F.coalesce(gap_type, F.lit("GAP")), F.coalesce(transaction_id, F.lit("")), F.left(digest, F.lit(12)))


def alerts_from_gaps(gaps: DataFrame, reference_month: str | None = None) -> DataFrame:
    """One alert per gap: severity by amount, title and message; the run's month (without one, the
    month of the gap) as label."""
    amount = F.coalesce(F.col("amount_brl"), F.lit(0.0))
    month = F.lit(reference_month) if reference_month else ntz_text(F.col("gap_date"), "yyyy-MM")
    return gaps.select(
        alert_id(F.col("gap_type"), F.col("transaction_id"), F.col("source"), amount, F.col("gap_date")).alias("alert_id"),
        severity(amount).alias("severity"),
        # FIXED VALUES: alert title wording
        F.concat(F.lit("["), F.coalesce(F.col("gap_type"), F.lit("GAP")), F.lit("] Furo detectado - R$ "),
                 amount.cast("decimal(18,2)").cast("string")).alias("title"),
        F.coalesce(F.col("detail"), F.lit(DEFAULT_MESSAGE)).alias("message"),
        "transaction_id",
        amount.alias("amount_brl"),
        month.alias("reference_month"),
        F.col("gap_date").alias("created_at"),
    )


def alert_routing(alerts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(alert, subscriber) for active subscribers whose filter rank <= the alert's rank, with all of
    the alert's columns. The key has four values: this is for a subscriber table small enough for AQE
    to broadcast."""
    expanded = alerts.select("*", F.explode(F.sequence(F.lit(0), severity_rank(F.col("severity")))).alias("_rank"))
    subs = subscribers.where(F.col("active")).select(
        F.col("id").alias("subscriber_id"), "channel", "webhook_url",
        severity_rank(F.col("severity_filter")).alias("_rank"))
    return expanded.join(subs, "_rank").drop("_rank")


def alert_state(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Current state = alerts left-joined with the latest acknowledgement (re-ack: last wins)."""
    last = acks.groupBy("alert_id").agg(F.max("ack_at").alias("acknowledged_at"))
    return (alerts.join(last, "alert_id", "left")
                  .select("alert_id", F.col("acknowledged_at").isNotNull().alias("acknowledged"),
                          "acknowledged_at"))


def alerts_open(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    return alerts.join(acks.select("alert_id"), "alert_id", "left_anti")


def alert_lookup(alerts: DataFrame, alert_id: str) -> DataFrame:
    """One alert by id, or all alerts of ``type:transaction`` (empty when unknown)."""
    return alerts.where((F.col("alert_id") == alert_id) | F.col("alert_id").startswith(f"{alert_id}:"))


def delivery_outbox(alerts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One outbox row per (alert, subscriber): the JSON payload a webhook sender would post.

    The payload is built before routing, so nothing is joined back by id. Delivery itself (HTTP) is
    outside the data job; a sender drains this table.
    """
    payload = F.to_json(F.struct("alert_id", "severity", "title", "message", "transaction_id", "amount_brl",
                                 "reference_month", F.col("created_at").cast("string").alias("created_at")))
    ready = alerts.select("alert_id", "severity", payload.alias("payload"))
    return alert_routing(ready, subscribers).select("alert_id", "subscriber_id", "channel", "webhook_url", "payload")
