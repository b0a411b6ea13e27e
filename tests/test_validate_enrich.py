import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tillrec.config import Rates
from tillrec.operators import enrich, validate as V
from tillrec.sources import spec as S

ACQ_COLS = ["authorization_code", "settlement_date", "gross_value", "net_value", "acquirer_fee",
            "payment_method", "installments", "acquirer_name", "nsu", "source_row_index"]


def acq_frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ACQ_COLS[:-1]) + ", source_row_index long")


def test_installments_and_cross_field(spark):
    base = ["A1", "2026-03-05", "10,00", "9,50", "0,50", "credit", "1", "stone", None]
    cases = {"1": True, "24": True, "25": False, "0": False, "3.0": True, "3.5": False, None: False}
    rows = []
    for i, (inst, _) in enumerate(cases.items()):
        r = list(base)
        r[6] = inst
        rows.append((*r, i))
    rows.append(("A2", "2026-03-05", "10,00", "10,01", "0", "credit", "1", "stone", None, 100))
    rows.append(("A3", "2026-03-05", "10,00", "10,02", "0", "credit", "1", "stone", None, 101))
    v = V.validate(acq_frame(spark, rows), S.ACQUIRER)
    got = {r["source_row_index"]: r["validation_error"] for r in v.collect()}
    for i, ok in enumerate(cases.values()):
        assert (got[i] is None) == ok, (i, got[i])
    assert got[100] is None
    assert got[101] == V.MSG_NET_GT_GROSS


def test_marketplace_errors_in_field_order_and_split_counts(spark):
    cols = [f.name for f in S.MARKETPLACE.fields]
    rows = [("1", "2026-03-05 10:00:00", "10,00", None, "PIX", "Concluído", None, None, 0),
            ("2", "31/02/2026", "-5,00", "x", "Outro", "cancelada", None, None, 1),
            ("", "2026-03-05", "abc", "-", "pix", "pendente", None, None, 2)]   # date-only: sales refuse it
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols) + ", source_row_index long")
    v = V.validate(df, S.MARKETPLACE)
    errs = {r["source_row_index"]: r["validation_error"] for r in v.collect()}
    assert errs[0] is None
    assert errs[1] == ("order_date: cannot parse datetime; gross_value: must be >= 0; "
                       "ifood_commission: must be numeric; payment_method: not an allowed value; "
                       "status: not an allowed value")
    assert errs[2] == ("order_id: should have at least 1 character; order_date: cannot parse datetime; "
                       "gross_value: must be numeric")
    c = V.counts(v, "marketplace").collect()[0]
    assert (c["raw_rows"], c["valid_rows"], c["quarantined_rows"]) == (3, 1, 2)
    assert V.valid_rows(v, S.MARKETPLACE).count() + V.quarantine_rows(v, S.MARKETPLACE).count() == 3


def test_missing_required_column_quarantines_every_row(spark):
    df = spark.createDataFrame([("2026-03-05 10:00:00", "10,00", "pix", 0)],
                               "transaction_date string, gross_value string, payment_method string, "
                               "source_row_index long")
    v = V.validate(df, S.POS).collect()[0]
    assert v["validation_error"] == "transaction_id: field required"


def _sales(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, transaction_date timestamp_ntz, "
                                       "gross_value decimal(18,2), payment_method string, row_order long")


def _settlements(spark, rows):
    return spark.createDataFrame(rows, "authorization_code string, settlement_date timestamp_ntz, "
                                       "gross_value decimal(18,2), acquirer_fee decimal(18,2), row_order long")


D = dt.datetime(2026, 3, 5, 12)


def test_fee_lookup_last_wins_blank_fee_and_cash_match(spark):
    sales = _sales(spark, [("P1", D, Decimal("100.00"), "credito", 1),
                           ("P2", D, Decimal("50.00"), "dinheiro", 2),
                           ("P3", D, Decimal("70.00"), "pix", 3),
                           ("P4", D, Decimal("80.00"), "voucher", 4)])
    sett = _settlements(spark, [("A1", D, Decimal("100.00"), Decimal("2.00"), 1),
                                ("A2", D, Decimal("100.00"), Decimal("3.00"), 2),
                                ("A3", D, Decimal("50.00"), Decimal("0.40"), 3),
                                ("A4", D, Decimal("70.00"), None, 4)])
    got = {r["transaction_id"]: (r["matched"], r["mdr_fee"])
           for r in enrich.pos_with_fees(sales, sett).collect()}
    assert got["P1"] == (True, Decimal("3.00"))      # last row in file order wins
    assert got["P2"] == (True, Decimal("0.40"))      # cash can match too
    assert got["P3"] == (True, Decimal("0.00"))      # matched blank fee counts as 0
    assert got["P4"] == (False, Decimal("1.19"))     # voucher fallback = debit rate
    credit_only = {r["transaction_id"]: r["mdr_fee"]
                   for r in enrich.pos_with_fees(sales, sett, Rates(fee_fallback="credit_only")).collect()}
    assert credit_only["P4"] == Decimal("2.39")


def test_commission_rules(spark):
    orders = spark.createDataFrame(
        [("1", D, Decimal("100.00"), Decimal("10.00"), "pix", "concluido"),
         ("2", D, Decimal("100.00"), Decimal("0.00"), "pix", "concluido"),
         ("3", D, Decimal("100.00"), None, "pix", "concluido"),
         ("4", D, Decimal("100.00"), Decimal("10.00"), "pix", "cancelado")],
        "order_id string, order_date timestamp_ntz, gross_value decimal(18,2), ifood_commission decimal(18,2), "
        "payment_method string, status string")
    got = {r["order_id"]: (r["gross_value"], r["ifood_commission_computed"], r["net_value"])
           for r in enrich.marketplace_enriched(orders).collect()}
    assert got["1"] == (Decimal("100.00"), Decimal("10.00"), Decimal("90.00"))
    assert got["2"] == (Decimal("100.00"), Decimal("23.00"), Decimal("77.00"))
    assert got["3"] == (Decimal("100.00"), Decimal("23.00"), Decimal("77.00"))
    assert got["4"] == (Decimal("-100.00"), Decimal("0.00"), Decimal("-100.00"))


def test_legacy_nan_mode_swaps_blank_rules(spark):
    df = spark.createDataFrame([("P1", "2026-03-05 10:00:00", None, "pix", "op", None, None, 0)],
                               "transaction_id string, transaction_date string, gross_value string, "
                               "payment_method string, cashier_id string, table_number string, notes string, "
                               "source_row_index long")
    strict = V.validate(df, S.POS).collect()[0]
    legacy = V.validate(df, S.POS, legacy_nan=True).collect()[0]
    assert strict["validation_error"] == "gross_value: field required"
    assert legacy["validation_error"] == ("table_number: should be a valid string; "
                                          "notes: should be a valid string")


def test_statement_sheet_rows(spark):
    from tillrec.operators import statement
    ledger = spark.createDataFrame(
        [("pdv", "P1", D, Decimal("1234.56"), Decimal("1197.65"), Decimal("36.91"), Decimal("0.00"), "credito", None),
         ("ifood", "1", D, Decimal("100.00"), Decimal("77.00"), Decimal("0.00"), Decimal("23.00"), "pix", "concluido"),
         ("ifood", "2", D, Decimal("-50.00"), Decimal("-50.00"), Decimal("0.00"), Decimal("0.00"), "pix", "cancelado")],
        "source string, record_id string, date timestamp_ntz, gross_value decimal(18,2), net_value decimal(18,2), "
        "mdr_fee decimal(18,2), ifood_commission_computed decimal(18,2), payment_method string, status string")
    gaps = spark.createDataFrame([("2", 50.0, D)], "transaction_id string, amount_brl double, gap_date timestamp_ntz")
    st = statement.income_statement(ledger, gaps, "2026-03")
    byp = statement.revenue_by_payment(ledger).withColumn("reference_month", F.lit("2026-03"))
    rows = {r["line_no"]: (r["item"], r["value"])
            for r in statement.statement_rows(st, byp, "02/04/2026 10:00").collect()}
    assert rows[2] == ("Período de Referência", "2026-03")
    assert rows[6] == ("  Vendas PDV (físico)", "R$ 1,234.56")
    assert rows[7] == ("  Pedidos iFood (bruto)", "R$ 100.00")          # cancelled order clipped at 0
    assert rows[8] == ("  TOTAL RECEITA BRUTA", "R$ 1,334.56")
    assert rows[11] == ("  Comissão iFood (23%)", "- R$ 23.00")
    assert rows[13] == ("  TOTAL DEDUÇÕES", "- R$ 59.91")
    assert rows[15] == ("RECEITA LÍQUIDA", "R$ 1,274.65")
    assert rows[17] == ("FUROS DE CAIXA DETECTADOS", "1")
    assert rows[20] == ("  Credito", "R$ 1,234.56") and rows[21] == ("  Pix", "R$ 100.00")
