import datetime as dt
import random
from decimal import Decimal

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillrec.functions.money import cents
from tillrec.operators import reconcile

D = dt.datetime(2026, 3, 5, 12)
D2 = dt.datetime(2026, 3, 6, 12)


def _sales(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, transaction_date timestamp_ntz, "
                                       "gross_value decimal(18,2), payment_method string")


def _settlements(spark, rows):
    return spark.createDataFrame(rows, "authorization_code string, settlement_date timestamp_ntz, "
                                       "gross_value decimal(18,2), acquirer_fee decimal(18,2)")


def test_tolerance_edges_and_next_day(spark):
    sales = _sales(spark, [("P0", D, Decimal("10.00"), "credito"),
                           ("P5", D, Decimal("20.00"), "credito"),
                           ("P6", D, Decimal("30.00"), "credito"),
                           ("PN", D2, Decimal("40.00"), "credito"),
                           ("PX", D, Decimal("99.00"), "pix")])
    sett = _settlements(spark, [("A0", D, Decimal("10.00"), None),
                                ("A5", D, Decimal("20.05"), None),
                                ("A6", D, Decimal("30.06"), None),
                                ("AN", D, Decimal("40.00"), None)])
    missing = {r["transaction_id"] for r in reconcile.gaps_pos_missing(sales, sett).collect()}
    assert missing == {"P6", "PN"}             # 0.05 is inside (exact decimals), 0.06 is out; pix ignored
    extra = {r["transaction_id"] for r in reconcile.gaps_acquirer_missing(sett, sales).collect()}
    assert extra == {"A6", "AN"}


def test_one_settlement_clears_many_sales(spark):
    sales = _sales(spark, [("P1", D, Decimal("10.00"), "credito"), ("P2", D, Decimal("10.02"), "debito")])
    sett = _settlements(spark, [("A1", D, Decimal("10.01"), None)])
    assert reconcile.gaps_pos_missing(sales, sett).count() == 0


def test_empty_side_means_no_gaps(spark):
    sales = _sales(spark, [("P1", D, Decimal("10.00"), "credito")])
    empty = _settlements(spark, [])
    assert reconcile.gaps_pos_missing(sales, empty).count() == 0
    assert reconcile.gaps_acquirer_missing(empty, sales).count() == 0
    sett = _settlements(spark, [("A1", D, Decimal("10.00"), None)])
    assert reconcile.gaps_acquirer_missing(sett, _sales(spark, [])).count() == 0


def test_gap_detail_text(spark):
    sales = _sales(spark, [("P1", D, Decimal("1234.50"), "credito")])
    sett = _settlements(spark, [("A9", D2, Decimal("5.00"), None)])
    g = reconcile.gaps_pos_missing(sales, sett).collect()[0]
    assert g["detail"] == ("Card transaction R$ 1234.50 on 2026-03-05 12:00:00 found in PDV but not in "
                           "acquirer settlement.")
    assert g["amount_brl"] == 1234.5 and g["source"] == "PDV"


def test_band_anti_join_equals_brute_force(spark):
    rnd = random.Random(7)
    days = [dt.datetime(2026, 3, d) for d in (1, 2, 3)]
    left = [(f"L{i}", rnd.choice(days), rnd.randint(-300, 300)) for i in range(400)]
    right = [(f"R{i}", rnd.choice(days), rnd.randint(-300, 300)) for i in range(150)]
    for t in (0, 1, 5, 17):
        expected = {lid for lid, ld, lc in left
                    if not any(rd == ld and abs(rc - lc) <= t for _, rd, rc in right)}
        lf = spark.createDataFrame(left, "id string, day timestamp_ntz, c long")
        rf = spark.createDataFrame(right, "rid string, rday timestamp_ntz, rc long")
        got = {r["id"] for r in reconcile.band_anti_join(
            lf, rf, F.to_date(lf["day"]), lf["c"], F.to_date(rf["rday"]), rf["rc"], t).collect()}
        assert got == expected, t


def test_band_anti_join_plan_is_equi_join(spark):
    lf = _sales(spark, [("P1", D, Decimal("10.00"), "credito")])
    rf = _settlements(spark, [("A1", D, Decimal("10.00"), None)])
    out = reconcile.band_anti_join(lf, rf, F.to_date(lf["transaction_date"]), cents(lf["gross_value"]),
                                   F.to_date(rf["settlement_date"]), cents(rf["gross_value"]), 5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan
    assert "LeftAnti" in plan


@settings(max_examples=8, deadline=None)
@given(t=st.integers(0, 40),
       left=st.lists(st.tuples(st.integers(0, 2), st.integers(-500, 500)), min_size=1, max_size=60),
       right=st.lists(st.tuples(st.integers(0, 2), st.integers(-500, 500)), max_size=60))
def test_band_anti_join_property(spark, t, left, right):
    days = [dt.datetime(2026, 3, d + 1) for d in range(3)]
    lrows = [(f"L{i}", days[d], c) for i, (d, c) in enumerate(left)]
    rrows = [(f"R{i}", days[d], c) for i, (d, c) in enumerate(right)]
    expected = {i for i, d, c in lrows if not any(rd == d and abs(rc - c) <= t for _, rd, rc in rrows)}
    lf = spark.createDataFrame(lrows, "id string, day timestamp_ntz, c long")
    rf = spark.createDataFrame(rrows, "rid string, rday timestamp_ntz, rc long")
    got = {r["id"] for r in reconcile.band_anti_join(
        lf, rf, F.to_date(lf["day"]), lf["c"], F.to_date(rf["rday"]), rf["rc"], t).collect()}
    assert got == expected


def test_ledger_identities_on_test_tables(spark):
    from tillrec.operators import enrich, statement
    from tillrec.plans.catalog import Inputs
    i = Inputs(spark, "/root/testdata/sf0.001")
    led = enrich.ledger_net(i.ledger())
    bad = led.where(F.col("net_value_final") != F.col("gross_value") - F.col("mdr_fee")
                    - F.col("ifood_commission_computed")).count()
    assert bad == 0
    s = statement.income_statement(i.ledger(), i.gaps(), "2026-03").collect()[0]
    assert round(s["total_gross_revenue_brl"] - s["total_deductions_brl"], 2) == s["net_revenue_brl"]
    # every pos gap really has no settlement within tolerance on its day (disjoint from matches)
    gaps = reconcile.gaps_pos_missing(i.pos(), i.acquirer()).select("transaction_id")
    p = i.pos().join(gaps, "transaction_id").select("transaction_id", F.to_date("transaction_date").alias("d"),
                                                    cents(F.col("gross_value")).alias("c"))
    a = i.acquirer().select(F.to_date("settlement_date").alias("d"), cents(F.col("gross_value")).alias("ac"))
    assert p.join(a, "d").where(F.abs(F.col("c") - F.col("ac")) <= 5).count() == 0


def _pairs_brute(left, right, t=5):
    """Mutual nearest amounts of one day and method; rows of equal amounts pair up one by one, by id."""
    out = []
    for key in {(d, m) for _, d, m, _ in left} | {(d, m) for _, d, m, _ in right}:
        ls, rs = {}, {}
        for side, rows in ((ls, left), (rs, right)):
            for i, d, m, c in sorted(rows):
                if (d, m) == key:
                    side.setdefault(c, []).append(i)
        nearest = lambda c, others: min(others, key=lambda o: (abs(o - c), o)) if others else None
        for c in ls:
            b = nearest(c, rs)
            if b is not None and nearest(b, ls) == c and abs(b - c) > t:
                out += list(zip(ls[c], rs[b]))
    return sorted(out)


def test_mismatch_pairs_are_mutual_nearest_without_a_bound(spark):
    rnd = random.Random(4)
    left = [(f"P{i:04d}", rnd.choice([D, D2]), rnd.choice(["credito", "debito"]), rnd.randint(0, 400_000)) for i in range(300)]
    right = [(f"A{i:04d}", rnd.choice([D, D2]), rnd.choice(["credito", "debito"]), rnd.randint(0, 400_000)) for i in range(200)]
    left += [("P9998", D, "pix", 10_000)]
    right += [("A9998", D, "pix", 60_000)]                               # R$ 500.00 apart
    cols = "decimal(18,2), payment_method string"
    money = lambda c: Decimal(c) / 100
    sales = spark.createDataFrame([(i, d, money(c), m) for i, d, m, c in left],
                                  f"transaction_id string, transaction_date timestamp_ntz, gross_value {cols}")
    sett = spark.createDataFrame([(i, d, money(c), m) for i, d, m, c in right],
                                 f"authorization_code string, settlement_date timestamp_ntz, gross_value {cols}")
    pairs = sorted((r["l_id"], r["r_id"]) for r in reconcile.amount_mismatch_pairs(sales, sett).collect())
    assert ("P9998", "A9998") in pairs
    day = lambda rows: [(i, d.date(), m, c) for i, d, m, c in rows]
    assert pairs == _pairs_brute(day(left), day(right))


def test_documented_mode_lists_a_pair_once_and_as_executed_none(spark):
    sales = _sales(spark, [("P1", D, Decimal("100.00"), "credito"), ("P2", D, Decimal("5.00"), "debito")])
    sett = spark.createDataFrame([("A1", D, Decimal("600.00"), None, "credito")],
                                 "authorization_code string, settlement_date timestamp_ntz, gross_value decimal(18,2), "
                                 "acquirer_fee decimal(18,2), payment_method string")
    orders = spark.createDataFrame([], "order_id string, order_date timestamp_ntz, gross_value decimal(18,2), status string")
    got = {(r["gap_type"], r["transaction_id"]) for r in reconcile.gaps_all(sales, sett, orders, mode="documented").collect()}
    assert got == {("AMOUNT_MISMATCH", "P1"), ("PDV_MISSING_IN_ACQUIRER", "P2")}
    got = {(r["gap_type"], r["transaction_id"]) for r in reconcile.gaps_all(sales, sett, orders).collect()}
    assert got == {("PDV_MISSING_IN_ACQUIRER", "P1"), ("PDV_MISSING_IN_ACQUIRER", "P2"), ("ACQUIRER_MISSING_IN_PDV", "A1")}
    assert reconcile.gaps_amount_mismatch(sales, sett).count() == 0


def _settled(spark, rows):
    return spark.createDataFrame([(i, d, Decimal(g), None, m) for i, d, g, m in rows],
                                 "authorization_code string, settlement_date timestamp_ntz, gross_value decimal(18,2), "
                                 "acquirer_fee decimal(18,2), payment_method string")


def _documented(spark, sales, sett):
    orders = spark.createDataFrame([], "order_id string, order_date timestamp_ntz, gross_value decimal(18,2), status string")
    sales = _sales(spark, [(i, d, Decimal(g), m) for i, d, g, m in sales])
    got = reconcile.gaps_all(sales, _settled(spark, sett), orders, mode="documented").collect()
    return sorted((r["gap_type"], r["transaction_id"], r["amount_brl"]) for r in got)


def test_documented_gaps_of_repeated_ids_stay(spark):
    # X is paired on day 1; its other sale of day 2 and the other settlement of code Y are still missing
    got = _documented(spark, [("X", D, "100.00", "credito"), ("X", D2, "500.00", "credito")],
                      [("Y", D, "130.00", "credito"), ("Y", D2, "900.00", "debito")])
    assert got == [("ACQUIRER_MISSING_IN_PDV", "Y", 900.0), ("AMOUNT_MISMATCH", "X", 30.0), ("PDV_MISSING_IN_ACQUIRER", "X", 500.0)]


def test_equal_rows_pair_up_one_by_one(spark):
    two = [("P1", D, "100.00", "credito"), ("P2", D, "100.00", "credito")]
    got = _documented(spark, two, [("A1", D, "130.00", "credito"), ("A2", D, "130.00", "credito")])
    assert got == [("AMOUNT_MISMATCH", "P1", 30.0), ("AMOUNT_MISMATCH", "P2", 30.0)]
    # the same id thrice (equal rows) against two settlements: one sale stays missing, and rows without a method too
    got = _documented(spark, [two[0]] * 3 + [("P9", D, "100.00", None)],
                      [("A1", D, "130.00", "credito"), ("A2", D, "130.00", "credito"), ("A3", D, "77.00", None)])
    assert got == [("ACQUIRER_MISSING_IN_PDV", "A3", 77.0)] + [("AMOUNT_MISMATCH", "P1", 30.0)] * 2 + [("PDV_MISSING_IN_ACQUIRER", "P1", 100.0)]


def test_pairing_with_repeats_equals_brute_force(spark):
    rnd = random.Random(11)
    draw = lambda p, n, amounts: [(f"{p}{rnd.randint(0, 25)}", rnd.choice([D, D2]), rnd.choice(["credito", "debito"]),
                                   rnd.choice(amounts)) for _ in range(n)]
    left = draw("P", 150, [1000, 1000, 2000, 5000, 9000]) + [("P7", D, "credito", 70_000)] * 120         # a hot amount
    right = draw("A", 130, [1500, 2600, 5200, 9900]) + [("A7", D, "credito", 71_000)] * 90
    money = lambda c: Decimal(c) / 100
    cols = "decimal(18,2), payment_method string"
    sales = spark.createDataFrame([(i, d, money(c), m) for i, d, m, c in left],
                                  f"transaction_id string, transaction_date timestamp_ntz, gross_value {cols}")
    sett = spark.createDataFrame([(i, d, money(c), m) for i, d, m, c in right],
                                 f"authorization_code string, settlement_date timestamp_ntz, gross_value {cols}")
    pairs = sorted((r["l_id"], r["r_id"]) for r in reconcile.amount_mismatch_pairs(sales, sett).collect())
    assert pairs == _pairs_brute(left, right) and pairs.count(("P7", "A7")) >= 90


def test_amounts_are_reduced_without_collecting_sets(spark):
    """Sets are objects: Spark sorts all rows to aggregate them."""
    lf = _sales(spark, [("P1", D, Decimal("10.00"), "credito")])
    rf = _settlements(spark, [("A1", D, Decimal("10.00"), None)])
    plan = reconcile.pos_missing_rows(lf, rf)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan and "HashAggregate" in plan


def test_documented_gaps_store_only_what_pairs_and_gaps_need(spark, monkeypatch):
    seen, real = [], reconcile.kept
    monkeypatch.setattr(reconcile, "kept", lambda rows, name: seen.append(rows.columns) or real(rows, name))
    sales = _sales(spark, [("P1", D, Decimal("10.00"), "credito"), ("P2", D, Decimal("50.00"), "debito")]).withColumn("note", F.lit("x"))
    settled = _settlements(spark, [("A1", D, Decimal("11.00"), None)]).withColumn("payment_method", F.lit("credito")).withColumn("note", F.lit("x"))
    orders = spark.createDataFrame([], "order_id string, order_date timestamp_ntz, gross_value decimal(18,2), status string")
    got = sorted((r["gap_type"], r["transaction_id"], r["amount_brl"]) for r in reconcile.gaps_all(sales, settled, orders, mode="documented").collect())
    assert [x[1:] for x in got] == [("P1", 1.0), ("P2", 50.0)]
    assert [sorted(x) for x in seen] == [sorted(["transaction_id", "transaction_date", "gross_value", "day", "method", "c"]),
                                         sorted(["authorization_code", "settlement_date", "gross_value", "day", "method", "c"])]
