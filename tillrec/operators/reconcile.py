"""Cash-gap detection: band anti-joins between sales and settlements.

Band anti-join at scale
-----------------------
"No settlement on the same day within +/- t cents" is a non-equi predicate;
written naively Spark plans it as a nested-loop join. We make it an equi-join:

* amounts become integer cents; bins have width ``w = 2t + 1``;
* a right row at ``b`` can only match left amounts in ``[b - t, b + t]``,
  which touch at most two bins, so each right row is emitted once or twice;
* the right side is reduced to its distinct ``(day, cents)`` first, by a hash
  aggregate that is partial before the shuffle, so one hot amount on one day
  collapses to a single entry and a ``(day, bin)`` holds at most ``4t + 1``
  whatever the data volume (collected sets would be objects, which Spark
  aggregates by sorting all rows once there are more than a few groups);
* the left side joins LEFT ANTI on ``(day, bin)`` with the exact, codegen'd
  residual ``|cents - x| <= t``.

The reduced side is shuffled twice, as day and cents only; AQE turns the join
into a broadcast when it measures small and splits skewed left partitions
otherwise.
Matches are not consumed: one settlement can clear many sales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillrec.config import Rates
from tillrec.constants import (
    CARD_METHODS, GAP_ACQUIRER_MISSING, GAP_AMOUNT_MISMATCH, GAP_CANCELLED, GAP_ORDER,
    GAP_POS_MISSING, GAP_SOURCE_ACQUIRER, GAP_SOURCE_MARKETPLACE, GAP_SOURCE_PAIR, GAP_SOURCE_POS,
)
from tillrec.functions.dates import ntz_text
from tillrec.functions.money import cents
from tillrec.functions.text import brl
from tillrec.session import ensure_checkpoint_dir, kept

GAP_COLUMNS = ["transaction_id", "source", "amount_brl", "gap_type", "detail", "gap_date", "gap_order"]


def _stamp(ts: Column) -> Column:
    return ntz_text(ts, "yyyy-MM-dd HH:mm:ss")


def band_anti_join(left: DataFrame, right: DataFrame, left_day: Column, left_cents: Column,
                   right_day: Column, right_cents: Column, tolerance_cents: int) -> DataFrame:
    """Rows of ``left`` with no ``right`` row on the same day within ``tolerance_cents``."""
    t = int(tolerance_cents)
    w = 2 * t + 1
    rc = F.col("_r_cents")
    bins = F.array_distinct(F.array(F.floor((rc - t) / w), F.floor((rc + t) / w)))
    reduced = (right.select(right_day.alias("_r_day"), right_cents.alias("_r_cents"))
                    .where(F.col("_r_day").isNotNull() & F.col("_r_cents").isNotNull())
                    .distinct()
                    .select("_r_day", F.explode(bins.cast("array<bigint>")).alias("_r_bin"), "_r_cents"))
    probe = left.select("*", left_day.alias("_l_day"), left_cents.alias("_l_cents"),
                        F.floor(left_cents / w).cast("bigint").alias("_l_bin"))
    cond = ((probe["_l_day"] == reduced["_r_day"]) & (probe["_l_bin"] == reduced["_r_bin"])
            & (F.abs(reduced["_r_cents"] - probe["_l_cents"]) <= t))
    return probe.join(reduced, cond, "left_anti").drop("_l_day", "_l_cents", "_l_bin")


def _only_if_nonempty(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Keep ``rows`` only when ``other`` has at least one row.

    An uncorrelated scalar subquery (``limit(1)``, so one value at most) —
    a filter, not a join, and no driver-side ``count()``.
    """
    flag = other.select(F.lit(1).alias("_one")).limit(1).scalar()
    return rows.where(flag.isNotNull())


def pos_missing_rows(sales: DataFrame, settlements: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Card sales (credit, debit, voucher) with no settlement on the same day within tolerance."""
    card = sales.where(F.col("payment_method").isin(*CARD_METHODS))
    missing = band_anti_join(
        card, settlements,
        F.to_date(card["transaction_date"]), cents(card["gross_value"]),
        F.to_date(settlements["settlement_date"]), cents(settlements["gross_value"]),
        rates.tolerance_cents)
    return _only_if_nonempty(missing, settlements)


def acquirer_missing_rows(settlements: DataFrame, sales: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Settlements with no pos sale (any method) on the same day within tolerance."""
    missing = band_anti_join(
        settlements, sales,
        F.to_date(settlements["settlement_date"]), cents(settlements["gross_value"]),
        F.to_date(sales["transaction_date"]), cents(sales["gross_value"]),
        rates.tolerance_cents)
    return _only_if_nonempty(missing, sales)


def gaps_pos_missing(sales: DataFrame, settlements: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Card sales (credit, debit, voucher) with no settlement on the same day within tolerance."""
    return pos_missing_gaps(pos_missing_rows(sales, settlements, rates))


def pos_missing_gaps(missing: DataFrame) -> DataFrame:
    amt = F.col("gross_value")
    return missing.select(
        F.col("transaction_id").alias("transaction_id"),
        F.lit(GAP_SOURCE_POS).alias("source"),
        amt.cast("double").alias("amount_brl"),
        F.lit(GAP_POS_MISSING).alias("gap_type"),
        # FIXED VALUES: gap detail wording
        F.concat(F.lit("Card transaction "), brl(amt), F.lit(" on "), _stamp(F.col("transaction_date")),
                 F.lit(" found in PDV but not in acquirer settlement.")).alias("detail"),
        F.col("transaction_date").alias("gap_date"),
        F.lit(GAP_ORDER[GAP_POS_MISSING]).alias("gap_order"),
    )


def gaps_acquirer_missing(settlements: DataFrame, sales: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Settlements with no pos sale (any method) on the same day within tolerance."""
    return acquirer_missing_gaps(acquirer_missing_rows(settlements, sales, rates))


def acquirer_missing_gaps(missing: DataFrame) -> DataFrame:
    amt = F.col("gross_value")
    return missing.select(
        F.col("authorization_code").alias("transaction_id"),
        F.lit(GAP_SOURCE_ACQUIRER).alias("source"),
        amt.cast("double").alias("amount_brl"),
        F.lit(GAP_ACQUIRER_MISSING).alias("gap_type"),
        # FIXED VALUES: gap detail wording
        F.concat(F.lit("Acquirer settled "), brl(amt), F.lit(" on "), _stamp(F.col("settlement_date")),
                 F.lit(" (auth: "), F.col("authorization_code"),
                 F.lit(") but no matching PDV transaction found.")).alias("detail"),
        F.col("settlement_date").alias("gap_date"),
        F.lit(GAP_ORDER[GAP_ACQUIRER_MISSING]).alias("gap_order"),
    )


def gaps_cancelled(orders: DataFrame) -> DataFrame:
    """Every cancelled marketplace order (read before enrichment, so gross is positive)."""
    cancelled = orders.where(F.col("status") == "cancelado")
    amt = F.abs(F.col("gross_value"))
    return cancelled.select(
        F.col("order_id").alias("transaction_id"),
        F.lit(GAP_SOURCE_MARKETPLACE).alias("source"),
        amt.cast("double").alias("amount_brl"),
        F.lit(GAP_CANCELLED).alias("gap_type"),
        # FIXED VALUES: gap detail wording
        F.concat(F.lit("iFood order "), F.col("order_id"), F.lit(" was cancelled ("), brl(amt),
                 F.lit("). Verify it is not counted as revenue.")).alias("detail"),
        F.col("order_date").alias("gap_date"),
        F.lit(GAP_ORDER[GAP_CANCELLED]).alias("gap_order"),
    )


def _pieces(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` range-partitioned by group and order, stored, with the partition as ``piece``: a group
    with very many rows spreads over many partitions, and all later steps see the same ones."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    return rows.repartitionByRange(parts, *group, *order).withColumn("piece", F.spark_partition_id()).checkpoint(eager=True)


def _nearest_counterparts(nodes: DataFrame) -> DataFrame:
    """``nodes`` (day, method, c, n, left) with the nearest node of the other side on the same day
    and method: ``best`` (c, n). Ties go to the lower amount.

    Inside each piece of a (day, method) the last counterpart before and the first after are running
    values; what lies beyond a piece comes from the pieces' own first and last nodes: at most one row per
    piece, and a (day, method) has at most as many pieces as there are partitions.
    """
    staged = _pieces(nodes, ["day", "method"], ["c", "left"])
    node = F.struct("c", "n")
    side = lambda is_left: F.when(F.col("left") == F.lit(is_left), node)
    group = ["day", "method", "piece"]
    ordered = Window.partitionBy(*group).orderBy("c", "left")
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    ends = staged.groupBy(*group).agg(*[f(side(b)).alias(n) for f, b, n in (
        (F.max, True, "max_left"), (F.max, False, "max_right"), (F.min, True, "min_left"), (F.min, False, "min_right"))])
    pieces = Window.partitionBy("day", "method").orderBy("piece")
    earlier, later = pieces.rowsBetween(Window.unboundedPreceding, -1), pieces.rowsBetween(1, Window.unboundedFollowing)
    beyond = ends.select(*group, *[F.last(f"max_{s}", ignorenulls=True).over(earlier).alias(f"prev_{s}") for s in ("left", "right")],
                         *[F.first(f"min_{s}", ignorenulls=True).over(later).alias(f"next_{s}") for s in ("left", "right")])
    near = staged.select(
        "*", *[F.last(side(b), ignorenulls=True).over(before).alias(f"in_prev_{s}") for s, b in (("left", True), ("right", False))],
        *[F.first(side(b), ignorenulls=True).over(after).alias(f"in_next_{s}") for s, b in (("left", True), ("right", False))])
    joined = near.join(beyond, group)

    def other(which: str) -> Column:
        return F.when(F.col("left"), F.coalesce(f"in_{which}_right", f"{which}_right")) \
                .otherwise(F.coalesce(f"in_{which}_left", f"{which}_left"))

    found = joined.select("day", "method", "c", "n", "left", other("prev").alias("prev"), other("next").alias("next"))
    take_prev = F.col("prev").isNotNull() & (
        F.col("next").isNull() | (F.col("c") - F.col("prev.c") <= F.col("next.c") - F.col("c")))
    return found.select("day", "method", "c", "n", "left",
                        F.when(take_prev, F.col("prev")).otherwise(F.col("next")).alias("best")) \
                .where(F.col("best").isNotNull())


def _ranked(missing: DataFrame, date: str, ident: str) -> DataFrame:
    """Missing rows with (day, method, c) and their rank among the rows that share them, by id and
    time. Ranks count inside the pieces of a group and go on from the pieces before, so a group of any
    size is never one task. Rows without a day, method or amount have no rank."""
    keys = ["day", "method", "c"]
    # what pairs and gaps need; the rows are shuffled and stored
    keyed = missing.select(ident, date, "gross_value", F.to_date(date).alias("day"), F.col("payment_method").alias("method"),
                           cents(F.col("gross_value")).alias("c"))
    # ranges are sampled first: what finds the rows would run once for the sample and again for the pieces
    staged = _pieces(kept(keyed, "missing"), keys, [ident, date])
    pieces = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = staged.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("size")) \
        .select(*keys, "piece", F.coalesce(F.sum("size").over(pieces), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "piece").orderBy(ident, date))
    return staged.withColumn("inside", inside).join(offsets, [*keys, "piece"], "left") \
        .withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "piece")


def _mutual_amounts(sales: DataFrame, settlements: DataFrame, rates: Rates) -> DataFrame:
    """(day, method, l_c, r_c, pairs): amounts of one day and method that are each other's nearest and differ
    by more than the tolerance, and how many rows of both sides pair up. The inputs are ``_ranked`` rows."""
    nodes = sales.select("day", "method", "c", F.lit(True).alias("left")) \
        .unionByName(settlements.select("day", "method", "c", F.lit(False).alias("left"))) \
        .where("day IS NOT NULL AND method IS NOT NULL AND c IS NOT NULL") \
        .groupBy("day", "method", "c", "left").agg(F.count(F.lit(1)).alias("n"))
    near = _nearest_counterparts(nodes)
    l_best = near.where(F.col("left")).select("day", "method", F.col("c").alias("l_c"), F.col("best.c").alias("r_c"),
                                              F.least("n", "best.n").alias("pairs"))
    r_best = near.where(~F.col("left")).select("day", "method", F.col("c").alias("r_c"), F.col("best.c").alias("l_c"))
    return l_best.join(r_best, ["day", "method", "l_c", "r_c"]) \
        .where(F.abs(F.col("l_c") - F.col("r_c")) > rates.tolerance_cents)


def _paired(sales: DataFrame, settlements: DataFrame, mutual: DataFrame) -> DataFrame:
    """(l_id, r_id, l_c, r_c, ts): the k-th sale of an amount with the k-th settlement of its counterpart."""
    of = lambda rows, c: rows.join(mutual.withColumnRenamed(c, "c"), ["day", "method", "c"]) \
        .where("rank <= pairs").withColumnRenamed("c", c)
    left = of(sales, "l_c").select("day", "method", "l_c", "r_c", "rank", F.col("transaction_id").alias("l_id"),
                                   F.col("transaction_date").alias("ts"))
    right = of(settlements, "r_c").select("day", "method", "l_c", "r_c", "rank", F.col("authorization_code").alias("r_id"))
    return left.join(right, ["day", "method", "l_c", "r_c", "rank"]).select("l_id", "r_id", "l_c", "r_c", "ts")


def _left_over(ranked: DataFrame, mutual: DataFrame, c: str) -> DataFrame:
    """Ranked rows of one side without those that are paired; no row goes for sharing another's id."""
    taken = mutual.select(F.col("day").alias("_day"), F.col("method").alias("_method"), F.col(c).alias("_c"), "pairs")
    return ranked.join(taken, (F.col("day") == F.col("_day")) & (F.col("method") == F.col("_method"))
                       & (F.col("c") == F.col("_c")) & (F.col("rank") <= F.col("pairs")), "left_anti")


def amount_mismatch_pairs(missing_sales: DataFrame, missing_settlements: DataFrame, rates: Rates = Rates()) -> DataFrame:
    """Documented reading: unmatched card sales and unmatched settlements of the same day and method,
    paired when each one's amount is the other's nearest and the difference exceeds the tolerance (no upper
    bound). Rows of equal day, method and amount pair up one by one, by id: k sales and m settlements
    give min(k, m) pairs.

    (l_id, r_id, l_c, r_c, ts); the inputs are ``pos_missing_rows`` and ``acquirer_missing_rows``.
    """
    sales = _ranked(missing_sales, "transaction_date", "transaction_id")
    settlements = _ranked(missing_settlements, "settlement_date", "authorization_code")
    return _paired(sales, settlements, _mutual_amounts(sales, settlements, rates))


def mismatch_rows(pairs: DataFrame) -> DataFrame:
    """Gap rows of amount-mismatch pairs."""
    to_money = lambda c: (F.col(c) / 100).cast("decimal(18,2)")
    diff = (F.abs(F.col("l_c") - F.col("r_c")) / 100).cast("decimal(18,2)")
    return pairs.select(
        F.col("l_id").alias("transaction_id"),
        F.lit(GAP_SOURCE_PAIR).alias("source"),
        diff.cast("double").alias("amount_brl"),
        F.lit(GAP_AMOUNT_MISMATCH).alias("gap_type"),
        # FIXED VALUES: gap detail wording
        F.concat(F.lit("PDV recorded "), brl(to_money("l_c")), F.lit(" but acquirer settled "),
                 brl(to_money("r_c")), F.lit(". Difference: "), brl(diff), F.lit(".")).alias("detail"),
        F.col("ts").alias("gap_date"),
        F.lit(GAP_ORDER[GAP_AMOUNT_MISMATCH]).alias("gap_order"),
    )


def gaps_amount_mismatch(sales: DataFrame, settlements: DataFrame, rates: Rates = Rates(),
                         mode: str = "as_executed") -> DataFrame:
    """Matched pairs whose difference exceeds the tolerance.

    ``as_executed``: the pair is looked for only among settlements already
    within the tolerance, so "difference > tolerance" never holds and the
    result is empty by construction (Catalyst folds it to an empty relation).
    ``documented``: see ``amount_mismatch_pairs``.
    """
    if mode == "documented":
        return mismatch_rows(amount_mismatch_pairs(pos_missing_rows(sales, settlements, rates),
                                                   acquirer_missing_rows(settlements, sales, rates), rates))
    card = sales.where(F.col("payment_method").isin(*CARD_METHODS))
    amt = F.col("gross_value")
    return card.where(F.lit(False)).select(
        F.col("transaction_id"),
        F.lit(GAP_SOURCE_PAIR).alias("source"),
        amt.cast("double").alias("amount_brl"),
        F.lit(GAP_AMOUNT_MISMATCH).alias("gap_type"),
        F.lit("").alias("detail"),
        F.col("transaction_date").alias("gap_date"),
        F.lit(GAP_ORDER[GAP_AMOUNT_MISMATCH]).alias("gap_order"),
    )


def gaps_all(sales: DataFrame, settlements: DataFrame, orders: DataFrame, rates: Rates = Rates(),
             mode: str = "as_executed") -> DataFrame:
    """All gap types in one relation; ``gap_order`` keeps the listing order
    (pos-side gaps, then settlement-side, then cancellations).

    ``documented`` also reports amount mismatches; a paired sale or settlement is then not listed as
    missing. The two sets of unmatched rows and the paired amounts are checkpointed, since several branches read them.
    """
    if mode not in ("as_executed", "documented"):
        raise ValueError(f"mode must be as_executed or documented, not {mode!r}")
    missing_sales = pos_missing_rows(sales, settlements, rates)
    missing_settlements = acquirer_missing_rows(settlements, sales, rates)
    if mode == "as_executed":
        return pos_missing_gaps(missing_sales).unionByName(acquirer_missing_gaps(missing_settlements)) \
            .unionByName(gaps_cancelled(orders))
    sales_rows = _ranked(missing_sales, "transaction_date", "transaction_id")
    settled_rows = _ranked(missing_settlements, "settlement_date", "authorization_code")
    mutual = _mutual_amounts(sales_rows, settled_rows, rates).checkpoint()
    return mismatch_rows(_paired(sales_rows, settled_rows, mutual)) \
        .unionByName(pos_missing_gaps(_left_over(sales_rows, mutual, "l_c"))) \
        .unionByName(acquirer_missing_gaps(_left_over(settled_rows, mutual, "r_c"))).unionByName(gaps_cancelled(orders))
