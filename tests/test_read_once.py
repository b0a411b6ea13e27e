"""What several steps read is stored once, and wide parses are compiled."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillrec.functions.text import py_strip
from tillrec.operators import reconcile, validate as V
from tillrec.operators.gap_book import GapBook
from tillrec.operators.rollup import MonthBook
from tillrec.plans import catalog, stored_queries
from tillrec.sources import quoted_csv, spec as S


@pytest.fixture()
def tables(spark, tmp_path):
    day = dt.datetime(2026, 3, 1)
    items = [(k, 10 + k, 3, 1 + k % 4, 100.0 + k, 0.05, day + dt.timedelta(days=k % 5)) for k in range(40)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, "
                          "l_shipdate timestamp_ntz").write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(k, k, "FPO"[k % 3], 50.0 + k, day, "1-URGENT") for k in range(12)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                          "o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


def _sources(df):
    return [f for f in df.inputFiles() if "lineitem.parquet" in f or "orders.parquet" in f]


@pytest.mark.parametrize("name", ["alert_state", "alerts_open"])
def test_states_read_stored_alerts(spark, tables, name):
    found = catalog.queries()[name](spark, tables)
    assert found.count() > 0 and not _sources(found)


@pytest.mark.parametrize("name, book, method, at", [
    ("months_merged", MonthBook, "add", (0, 1)), ("gaps_incremental", GapBook, "load", (0, 1))])
def test_batches_come_from_stored_rows(spark, tables, monkeypatch, name, book, method, at):
    seen, real = [], getattr(book, method)

    def watched(self, *args, **kwargs):
        seen.extend(_sources(args[i]) for i in at)
        return real(self, *args, **kwargs)

    monkeypatch.setattr(book, method, watched)
    assert stored_queries.queries()[name](spark, tables).count() > 0
    assert seen and not any(seen)


def test_ranges_are_sampled_from_stored_rows(spark, tables, monkeypatch):
    seen, real = [], reconcile._pieces

    def watched(rows, *args):
        seen.append(_sources(rows))
        return real(rows, *args)

    monkeypatch.setattr(reconcile, "_pieces", watched)
    catalog.queries()["gaps_amount_mismatch_documented"](spark, tables).collect()
    assert seen and not any(seen)


def test_dashboard_finds_gaps_once(spark, tables, monkeypatch):
    seen, real = [], catalog.H.artefacts_from_ledger
    monkeypatch.setattr(catalog.H, "artefacts_from_ledger", lambda ledger, gaps, *a: seen.append(_sources(gaps)) or real(ledger, gaps, *a))
    assert catalog.queries()["dashboard_totals"](spark, tables).count() == 1
    assert seen == [[]]


def test_records_and_fragments_come_from_one_pass(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('a;b\n"1";"x\ny"\n"2";"z"\n')
    found = quoted_csv.records(spark, [f"file://{path}"], ";")
    assert sorted(r["text"] for r in found.collect()) == ['"1";"x\ny"', '"2";"z"']
    assert not [f for f in found.inputFiles() if f.endswith("a.csv")]
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_validation_limits_method_size(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    row = spark.createDataFrame([("P1", "2026-03-01", "1,00", "pix", 1)],
                                "transaction_id string, transaction_date string, gross_value string, payment_method string, source_row_index long")
    found = V.validate(row, S.POS).collect()[0]
    assert found["gross_value"] == Decimal("1.00")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_strip_as_python(spark):
    texts = ["", " ", "a", " a", "a ", "\ta\n", " a　", "a b", "é", " é ", "aé", "éa ", "\x7f", "a\x7f", "\x1ca", "a\x85", "!", "~", "~ ", "日本"]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", py_strip(F.col("t")).alias("s")).collect()
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip()) for r in rows)
