import datetime as dt
import random
from decimal import Decimal

from tillrec.operators import enrich, reconcile, statement
from tillrec.operators.gap_book import GapBook
from tillrec.operators.rollup import MonthBook
from tillrec.plans.catalog import Inputs

SALE = "transaction_id string, transaction_date timestamp_ntz, gross_value decimal(18,2), payment_method string"
SETTLED = "authorization_code string, settlement_date timestamp_ntz, gross_value decimal(18,2), payment_method string"


def test_merged_months_equal_the_whole_ledger(spark, tmp_path):
    i = Inputs(spark, "/root/testdata/sf0.001")
    ledger, gaps = enrich.ledger_net(i.ledger()), i.gaps()
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole = rows(statement.monthly_statements(ledger, gaps))
    by_method = rows(statement.revenue_by_payment(ledger, "reference_month"))
    book = MonthBook(spark, str(tmp_path / "months"))
    part = lambda df, key, n: df.where(f"pmod(hash({key}), 3) = {n}")
    for n in (0, 1, 2, 1):                                          # a repeated batch replaces itself
        book.add(part(ledger, "record_id", n), part(gaps, "transaction_id", n), "20260401", n)
    assert rows(book.statements()) == whole
    assert rows(book.revenue_by_payment()) == by_method
    # a late batch is added and taken out again; no ledger is read
    extra = ledger.limit(40)
    book.add(extra, gaps.limit(5), "20260401", 7)
    assert rows(book.statements()) != whole
    book.retract("20260401", 7)
    assert rows(book.statements()) == whole and rows(book.revenue_by_payment()) == by_method


def test_a_month_run_again_counts_once_if_asked(spark, tmp_path):
    ledger = lambda gross: spark.createDataFrame(
        [("pdv", "r", dt.datetime(2026, m, 3), Decimal(g), Decimal("1.00"), Decimal("0.00"), "pix") for m, g in gross],
        "source string, record_id string, date timestamp_ntz, gross_value decimal(18,2), mdr_fee decimal(18,2), "
        "ifood_commission_computed decimal(18,2), payment_method string")
    gaps = spark.createDataFrame([], "transaction_id string, source string, amount_brl double, gap_date timestamp_ntz")
    book = MonthBook(spark, str(tmp_path / "months"))
    book.add(ledger([(1, "10.00"), (2, "20.00")]), gaps, "20260301")
    book.add(ledger([(1, "15.00"), (1, "-3.00")]), gaps, "20260302")
    got = lambda **k: {r["reference_month"]: (r["total_gross_revenue_brl"], r["total_card_fees_brl"]) for r in book.statements(**k).collect()}
    assert got() == {"2026-01": (25.0, 3.0), "2026-02": (20.0, 1.0)}
    assert got(latest_run_only=True) == {"2026-01": (15.0, 2.0), "2026-02": (20.0, 1.0)}


def _rows(rnd, prefix, n, days):
    amounts = [1000, 1003, 1005, 1006, 1010, 1011, 1012, 5000, 5005, 99900]
    return [(f"{prefix}{rnd.randint(0, n)}", dt.datetime(2026, 3, 1) + dt.timedelta(days=rnd.choice(days), minutes=rnd.randint(0, 1439)),
             Decimal(rnd.choice(amounts)) / 100, rnd.choice(["credito", "debito", "pix"])) for _ in range(n)]


def _gap_keys(df):
    return sorted((r["gap_type"], r["transaction_id"], r["amount_brl"], r["gap_date"]) for r in df.collect())


def test_partial_loads_equal_one_full_load(spark, tmp_path):
    rnd = random.Random(9)
    loads = [(_rows(rnd, "P", 40, range(6)), _rows(rnd, "A", 12, range(6))), (_rows(rnd, "P", 5, [2]), _rows(rnd, "A", 20, [1, 2])),
             ([], _rows(rnd, "A", 6, [4]))]
    book = GapBook(spark, str(tmp_path / "book"))
    orders = spark.createDataFrame([], "order_id string, order_date timestamp_ntz, gross_value decimal(18,2), status string")
    sales, settled = [], []
    for number, (s, a) in enumerate(loads):
        before = _gap_keys(book.gaps())
        changes = book.load(spark.createDataFrame(s, SALE), spark.createDataFrame(a, SETTLED), number).collect()
        sales += s
        settled += a
        want = _gap_keys(reconcile.gaps_all(spark.createDataFrame(sales, SALE), spark.createDataFrame(settled, SETTLED), orders))
        now = _gap_keys(book.gaps())
        assert now == want and len(want) > 3
        key = lambda r: (r["gap_type"], r["transaction_id"], r["amount_brl"], r["gap_date"])
        grown = sorted(before + [key(r) for r in changes for _ in range(r["change"])])
        for r in changes:
            for _ in range(-r["change"]):
                grown.remove(key(r))
        assert grown == want
        touched = {r[1].date() for r in s + a}
        assert {r["gap_date"].date() for r in changes} <= touched
    assert any(r["change"] < 0 for r in book.changes(1).collect() + book.changes(2).collect())
    # a finished load isn't counted again
    book.load(spark.createDataFrame(loads[1][0], SALE), spark.createDataFrame(loads[1][1], SETTLED), 1)
    assert _gap_keys(book.gaps()) == want


def test_a_load_reads_only_the_months_it_touches(spark, tmp_path):
    rnd = random.Random(1)
    book = GapBook(spark, str(tmp_path / "book"))
    book.load(spark.createDataFrame(_rows(rnd, "P", 40, [1, 40, 80]), SALE), spark.createDataFrame(_rows(rnd, "A", 12, [1, 40, 80]), SETTLED), 0)
    one = book._table("sales", SALE, [0], ["2026-04"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "2026-04" in plan.split("PartitionFilters: [")[1][:120] and one.count() < 40
    assert all("/period=2026-" in f for f in one.inputFiles())


def test_a_load_stores_changes_once_and_shuffles_amounts(spark, tmp_path, monkeypatch):
    """What the rows meet is stored: cells and open amounts, no ids; the mark of a finished load has no rows of its own."""
    from tillrec.operators import gap_book
    seen, real = [], gap_book.kept
    monkeypatch.setattr(gap_book, "kept", lambda rows, name: seen.append((name, sorted(rows.columns))) or real(rows, name))
    rnd = random.Random(4)
    book = GapBook(spark, str(tmp_path / "book"))
    changes = book.load(spark.createDataFrame(_rows(rnd, "P", 40, range(3)), SALE), spark.createDataFrame(_rows(rnd, "A", 12, range(3)), SETTLED), 0)
    assert seen == [("gap-cells", ["b", "d"]), ("gap-amounts", ["c", "d"]), ("gap-amounts", ["c", "d"])]
    assert changes.count() > 0 and all("/changes_by_period/" in f for f in changes.inputFiles())
    assert spark.read.parquet(str(tmp_path / "book" / "changes" / "load=0")).columns == ["load"]
    assert _gap_keys(book.gaps()) == _gap_keys(changes)
