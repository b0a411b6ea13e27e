"""Cash gaps as sales and settlements arrive.

A sale is a gap once its day is over and no settlement of that day lies within the tolerance; so is a
settlement without a sale. Both are outer joins of streams: day (a window that carries the watermark) and bin of the
amount are the keys, as in the batch anti-join (``operators.reconcile``), and a row without a match comes out when the
watermark passes the end of its day. The other side is first reduced to its distinct amounts of a
(day, bin), at most 4 t + 1 for a tolerance of t cents, so neither state nor output grows with the square of a hot amount.
Rows later than the watermark allows are dropped by Spark; a day's state goes when the watermark has passed it.

The batch rule that an export without any rows gives no gaps needs a whole run and doesn't apply here.
Cancelled orders are gaps at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillrec.config import Rates
from tillrec.constants import CARD_METHODS
from tillrec.functions.money import cents
from tillrec.operators import alerts as A
from tillrec.operators.reconcile import acquirer_missing_gaps, gaps_cancelled, pos_missing_gaps
from tillrec.sinks.writers import stream_outbox


EVENT = "_event_time"


def _timed(rows: DataFrame, ts: str, watermark: str) -> DataFrame:
    """Rows with the wall-clock time taken as UTC, so that days don't depend on the session's zone."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    return rows.withColumn(EVENT, F.timestamp_micros(micros)).withWatermark(EVENT, watermark)


def _day() -> Column:
    return F.window(F.col(EVENT), "1 day")


def _unmatched(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """Rows of the left stream that no row of the right one matched until their day was over."""
    width = 2 * tolerance + 1
    c = cents(F.col("gross_value"))
    bins = F.array_distinct(F.array(F.floor((c - tolerance) / width), F.floor((c + tolerance) / width)))
    amounts = right.select(_day().alias("r_day"), F.explode(bins.cast("array<bigint>")).alias("r_bin"), c.alias("r_cents")) \
        .where("r_cents IS NOT NULL").dropDuplicates(["r_day", "r_bin", "r_cents"])
    rows = left.select("*", _day().alias("l_day"), F.floor(c / width).cast("bigint").alias("l_bin"), c.alias("l_cents"))
    joined = rows.join(amounts, (F.col("l_day") == F.col("r_day")) & (F.col("l_bin") == F.col("r_bin"))
                       & (F.abs(F.col("l_cents") - F.col("r_cents")) <= tolerance), "left_outer")
    return joined.where(F.col("r_cents").isNull()).select(left.columns)


def gaps_stream(sales: DataFrame, settlements: DataFrame, orders: DataFrame | None = None, rates: Rates = Rates(),
                watermark: str = "2 days") -> DataFrame:
    """Gap rows (``reconcile.GAP_COLUMNS``) of streams of valid sales, settlements and marketplace orders."""
    sales = _timed(sales, "transaction_date", watermark)
    settlements = _timed(settlements, "settlement_date", watermark)
    card = sales.where(F.col("payment_method").isin(*CARD_METHODS))
    t = rates.tolerance_cents
    out = pos_missing_gaps(_unmatched(card, settlements, t)) \
        .unionByName(acquirer_missing_gaps(_unmatched(settlements, sales, t)))
    return out if orders is None else out.unionByName(gaps_cancelled(orders))


def start_gap_alerts(gaps: DataFrame, subscribers: DataFrame, outbox_path: str, checkpoint_dir: str):
    """Alerts of a gap stream, routed to the subscribers (a table), into the delivery outbox."""
    return stream_outbox(A.delivery_outbox(A.alerts_from_gaps(gaps), subscribers), outbox_path, checkpoint_dir)
