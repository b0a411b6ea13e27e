import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillrec.constants import ACQUIRER_PAYMENT_MAP, MARKETPLACE_PAYMENT_MAP, PAYMENT_METHODS, POS_PAYMENT_MAP, \
    SALES_DATE_LAYOUTS, SETTLEMENT_DATE_LAYOUTS, STATUS_MAP
from tillrec.functions.dates import parse_timestamp
from tillrec.functions.enums import in_enum, normalise
from tillrec.functions.money import parse_money, parse_optional_money
from tillrec.functions.text import capitalize, clean_markup, py_strip


def one_col(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(expr(F.col("s"))).collect()]


def test_money_pt_br(spark):
    got = one_col(spark, ["1.234,56", "R$ 1.234,56", "1234.56", "-5,00", "abc", "", None, " 7,5 "], parse_money)
    assert got == [Decimal("1234.56"), Decimal("1234.56"), Decimal("123456.00"), Decimal("-5.00"),
                   None, None, None, Decimal("7.50")]


def test_optional_money_blank_words(spark):
    got = one_col(spark, ["-", "N/A", "", None, "2,50", "x"], parse_optional_money)
    assert got == [None, None, None, None, Decimal("2.50"), None]


def test_sales_dates(spark):
    got = one_col(spark, ["2026-03-05 14:30:00", "05/03/2026 14:30:00", "5/3/2026", "2026-03-05T14:30:00",
                          "2026-03-05", "31/02/2026", "05/03/26", "2026-3-5 4:3:2"],
                  lambda c: parse_timestamp(c, SALES_DATE_LAYOUTS))
    assert got == [dt.datetime(2026, 3, 5, 14, 30), dt.datetime(2026, 3, 5, 14, 30), dt.datetime(2026, 3, 5),
                   dt.datetime(2026, 3, 5, 14, 30), None, None, None, dt.datetime(2026, 3, 5, 4, 3, 2)]


def test_settlement_dates_accept_date_only(spark):
    got = one_col(spark, ["2026-03-05", "05/03/2026", "2026-03-05T14:30:00", "2026-03-05 10:00:60"],
                  lambda c: parse_timestamp(c, SETTLEMENT_DATE_LAYOUTS))
    assert got == [dt.datetime(2026, 3, 5), dt.datetime(2026, 3, 5), None, None]


def test_payment_maps_per_source(spark):
    vals = ["PIX", "Crédito", "especie", "credit", "outro", "Outro", "dinheiro"]
    mk = one_col(spark, vals, lambda c: normalise(c, MARKETPLACE_PAYMENT_MAP))
    pos = one_col(spark, vals, lambda c: normalise(c, POS_PAYMENT_MAP))
    acq = one_col(spark, vals, lambda c: normalise(c, ACQUIRER_PAYMENT_MAP))
    assert mk == ["pix", "credito", "especie", "credit", "outro", "Outro", "dinheiro"]
    assert pos == ["pix", "credito", "dinheiro", "credit", "outro", "Outro", "dinheiro"]
    # accents are not folded: "crédito" is a pos/marketplace spelling, not an acquirer one
    assert acq == ["pix", "Crédito", "especie", "credito", "outro", "Outro", "dinheiro"]
    ok = one_col(spark, acq, lambda c: in_enum(c, PAYMENT_METHODS))
    assert ok == [True, False, False, True, True, False, True]


def test_status_accents(spark):
    got = one_col(spark, ["Concluído", "cancelado", "cancelada"], lambda c: normalise(c, STATUS_MAP))
    assert got == ["concluido", "cancelado", "cancelada"]


def test_python_strip_and_markup(spark):
    assert one_col(spark, ["\t a  \n", "<b>Zé</b>\u0000 "], py_strip) == ["a", "<b>Zé</b>\u0000"]
    assert one_col(spark, ["<b>Zé</b>\u0000 "], clean_markup) == ["Zé"]
    assert one_col(spark, ["pix", "dINHEIRO"], capitalize) == ["Pix", "Dinheiro"]
