import io
import json
import zipfile

import pytest

from tillrec.config import JobArgs
from tillrec.operators import history as H, validate as V
from tillrec.plans.month_job import build_run, run_month
from tillrec.sources import artefacts, files
from tillrec.sources.spec import MARKETPLACE, POS, acquirer_spec

MK_CSV = ("﻿Código do Pedido;Data do Pedido;Valor Total;Comissão iFood;Forma de Pagamento;Status;"
          "ID Cliente;Taxa de Entrega\n"
          "1;2026-03-05 14:30:00;1.234,56;;Cartão de Crédito;Concluído;c1;5,00\n"
          "\n"
          "2;05/03/2026;R$ 100,00;10,00;PIX;Cancelado;c2;\n"
          ";;;;;;;\n"
          "3;31/02/2026;abc;-;Outro;cancelada;c3;\n")
POS_CSV = ("ID Transacao,Data/Hora,Valor Total,Forma de Pagamento,Operador,Mesa,Obs\n"
           "P1,2026-03-05 10:00:00,\"1.234,56\",Crédito,op1,1,\n"
           "P2,2026-03-05 11:00:00,\"50,00\",especie,op2,2,\n"
           "P3,2026-03-05 12:00:00,\"80,00\",débito,op1,3,\n"
           "P4,2026-03-06 12:00:00,\"-5,00\",pix,op1,3,\n")
STONE_CSV = ("Codigo de Autorizacao;NSU;Data de Liquidacao;Valor Bruto;Valor Liquido;Taxa MDR;"
             "Tipo de Pagamento;Parcelas\n"
             "A1;1;2026-03-05;1.234,58;1.200,00;34,58;credit;1\n"
             "A2;2;2026-03-05;999,00;990,00;9,00;debit;3.0\n"
             ";;;;;;;\n")


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_csv_sniff_bom_and_blank_rows(spark, tmp_path):
    mk = files.read_export(spark, write(tmp_path, "mk.csv", MK_CSV), MARKETPLACE)
    v = V.validate(mk, MARKETPLACE)
    got = {r["order_id"]: r[V.ERROR_COL] for r in v.where(f"NOT {V.BLANK_COL}").collect()}
    assert set(got) == {"1", "2", "3"}          # blank line and all-empty row are no records
    c = V.counts(v, "marketplace").collect()[0]  # but the all-empty row counts as read
    assert (c["raw_rows"], c["valid_rows"], c["quarantined_rows"]) == (4, 2, 1)
    assert got["1"] is None and got["2"] is None
    assert "gross_value: must be numeric" in got["3"]
    pos = files.read_export(spark, write(tmp_path, "pos.csv", POS_CSV), POS)   # falls back to ','
    assert pos.count() == 4


def test_acquirer_blank_row_is_quarantined(spark, tmp_path):
    acq = files.read_export(spark, write(tmp_path, "st.csv", STONE_CSV), acquirer_spec("stone"))
    v = V.validate(acq, acquirer_spec("stone"))
    assert V.counts(v, "acquirer").collect()[0]["quarantined_rows"] == 1


def test_ambiguous_header_is_an_error(spark, tmp_path):
    path = write(tmp_path, "amb.csv", "Valor;Valor Total;ID Transacao\n1;2;x\n")
    with pytest.raises(files.AmbiguousHeaderError):
        files.read_export(spark, path, POS)


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_export(spark, str(tmp_path / "nope.csv"), POS)


def _xlsx(rows):
    shared = sorted({c for r in rows for c in r if c is not None})
    idx = {s: i for i, s in enumerate(shared)}
    sheet_rows = []
    for n, r in enumerate(rows, start=1):
        cells = "".join(f'<c r="{chr(65 + i)}{n}" t="s"><v>{idx[v]}</v></c>' for i, v in enumerate(r) if v)
        sheet_rows.append(f'<row r="{n}">{cells}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/>'
                                      "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels",
                   '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(sheet_rows)}</sheetData></worksheet>")
    return buf.getvalue()


def test_xlsx_pos_export(spark, tmp_path):
    p = tmp_path / "pos.xlsx"
    p.write_bytes(_xlsx([["ID Transacao", "Data/Hora", "Valor", "Forma de Pagamento"],
                         ["P1", "2026-03-05 10:00:00", "10,00", "pix"],
                         ["P2", "05/03/2026", "20,00", "Crédito"]]))
    df = files.read_export(spark, str(p), POS)
    v = V.validate(df, POS)
    got = sorted((r["transaction_id"], str(r["gross_value"]), r["payment_method"]) for r in
                 V.valid_rows(v, POS).collect())
    assert got == [("P1", "10.00", "pix"), ("P2", "20.00", "credito")]


def test_month_run_end_to_end(spark, tmp_path):
    args = JobArgs(write(tmp_path, "mk.csv", MK_CSV), write(tmp_path, "pos.csv", POS_CSV),
                   write(tmp_path, "st.csv", STONE_CSV), "2026-03", "stone")
    out = build_run(spark, args)
    s = out.summary.collect()[0]
    assert (s["total_ifood_orders"], s["total_pdv_transactions"], s["total_acquirer_transactions"]) == (2, 3, 2)
    assert s["quarantined_rows"] == 1 + 1 + 1
    gaps = {(r["gap_type"], r["transaction_id"]) for r in out.gaps.collect()}
    # P1 1234.56 vs A1 1234.58: inside tolerance; P3 debit 80.00 unmatched; A2 unmatched; order 2 cancelled
    assert gaps == {("PDV_MISSING_IN_ACQUIRER", "P3"), ("ACQUIRER_MISSING_IN_PDV", "A2"),
                    ("IFOOD_ORDER_CANCELLED", "2")}
    _, paths = run_month(spark, args, str(tmp_path / "out"), run_stamp="20260401_000000")
    art = artefacts.read_artefacts(spark, paths["statement"] + "/*.json", multi_line=False)
    m = H.period_metrics(art).collect()[0]
    assert m["gaps_count"] == 3 and m["reference_month"] == "2026-03"
    q = {r["record_id"]: r for r in spark.read.parquet(paths["quarantine"]).collect()}
    assert q["3"]["original"]["gross_value"] == "abc" and q["P4"]["original"]["gross_value"] == "-5,00"
    assert spark.read.parquet(paths["alerts"]).where("reference_month = '2026-03'").count() == 3


def test_documented_run_history_and_drilldown(spark, tmp_path, capsys):
    from tillrec.__main__ import main
    paths = [write(tmp_path, n, t) for n, t in (("mk.csv", MK_CSV), ("pos.csv", POS_CSV.replace("80,00", "500,00")),
                                                ("st.csv", STONE_CSV))]
    (tmp_path / "subs.json").write_text(json.dumps(
        {"id": "S1", "channel": "slack", "webhook_url": "https://h", "severity_filter": "low", "active": True}))
    out = str(tmp_path / "out")
    args = JobArgs(*paths, "2026-03", "stone")
    # three runs of one month; ranks follow the stamps, not the random part-file names
    from tillrec.config import Rates
    from decimal import Decimal
    for stamp, rate in (("20260401_000000", "0.10"), ("20260402_000000", "0.20"), ("20260403_000000", "0.30")):
        a = JobArgs(*paths, "2026-03", "stone", Rates(commission_rate=Decimal(rate)))
        run_month(spark, a, out, run_stamp=stamp, gap_mode="documented", subscribers=spark.read.json(str(tmp_path / "subs.json")))
    m = H.period_metrics(artefacts.read_artefacts(spark, f"{out}/statement/*/*.json", multi_line=False))
    net = [r["net_revenue_brl"] for r in m.orderBy("file_name").collect()]
    assert len(net) == 3 and H.latest_period(m).collect()[0]["net_revenue_brl"] == net[-1] == min(net)
    assert H.period_lookup(m, "2026-03").collect()[0]["net_revenue_brl"] == net[0] == max(net)
    # the sale of 500.00 and the settlement of 999.00 are one mismatch of 499.00, not two missing rows
    got = {(r["gap_type"], r["amount_brl"]) for r in
           H.stored_gaps(artefacts.read_run_gaps(spark, f"{out}/gaps"), "2026-03").collect()}
    assert got == {("AMOUNT_MISMATCH", 499.0), ("IFOOD_ORDER_CANCELLED", 100.0)}
    outbox = spark.read.parquet(f"{out}/outbox")
    assert outbox.count() == 3 * 2 and outbox.where("payload LIKE '%2026-03%'").count() == 6
    run_month(spark, args, out, run_stamp="20260403_000000", gap_mode="documented",
              subscribers=spark.read.json(str(tmp_path / "subs.json")))
    assert spark.read.parquet(f"{out}/outbox").count() == 6              # a repeated run replaces its rows
    capsys.readouterr()
    main(["gaps", "--gaps", f"{out}/gaps", "--month", "2026-03", "--min-amount", "200"])
    assert [json.loads(x)["amount_brl"] for x in capsys.readouterr().out.splitlines()] == [499.0]
    main(["period", "--artefacts", f"{out}/statement/*/*.json", "--json-lines", "--month", "2026-03"])
    assert json.loads(capsys.readouterr().out)["net_revenue_brl"] == net[0]
    main(["dashboard", "--artefacts", f"{out}/statement/*/*.json", "--json-lines", "--alerts", f"{out}/alerts/run=20260403_000000"])
    assert json.loads(capsys.readouterr().out)["alerts_open"] == 2


def _metric_rows(spark, rows):
    return spark.createDataFrame([(m, f, 1.0, net, gaps, value) for m, f, net, gaps, value in rows],
                                 "reference_month string, file_name string, gross_revenue_brl double, net_revenue_brl double, "
                                 "gaps_count int, gaps_value_brl double")


def test_latest_run_only_counts_a_month_once(spark):
    m = _metric_rows(spark, [("2026-01", "a1", 1.0, 4, 10.0), ("2026-01", "a2", 2.0, 6, 30.5), ("2026-02", "b1", 3.0, 2, 5.0),
                             ("2026-01", "a3", 9.0, 1, 2.25)])
    every = H.dashboard_totals(m, spark.range(0)).collect()[0]
    newest = H.dashboard_totals(m, spark.range(0), latest_run_only=True).collect()[0]
    assert (every["total_recovered_brl"], newest["total_recovered_brl"]) == (47.75, 7.25)
    assert newest["total_hours_saved"] == every["total_hours_saved"] / 13 * 3
    assert [(r["month"], r["net_revenue"]) for r in H.trend_last_n(m, 6, latest_run_only=True).collect()] == [("2026-01", 9.0), ("2026-02", 3.0)]


def test_gaps_and_period_show_the_same_run(spark, tmp_path):
    gap = lambda i, v: {"transaction_id": i, "source": "PDV", "amount_brl": v, "gap_type": "T", "detail": "d"}
    for name, net, gaps in (("dre_2026-03_20260401.json", 1.0, [gap("b", 5.0), gap("a", 5.0), gap("c", 7.0)]),
                            ("dre_2026-03_20260402.json", 2.0, [gap("z", 9.0)]), ("dre_2026-04_20260501.json", 3.0, []),
                            ("dre_2026-04_20260502.json", 4.0, [gap("y", 1.0)])):
        (tmp_path / name).write_text(json.dumps({"reference_month": name[4:11], "net_revenue_brl": net, "gaps_detected": len(gaps), "gaps": gaps}))
    art = artefacts.read_artefacts(spark, str(tmp_path / "*.json"))
    gaps, m = artefacts.artefact_gaps(art), H.period_metrics(art)
    # ties stay in the file's order; a first run without gaps shows none, not the later run's
    assert [r["transaction_id"] for r in H.stored_gaps(gaps, "2026-03").collect()] == ["c", "b", "a"]
    assert H.period_lookup(m, "2026-03").collect()[0]["net_revenue_brl"] == 1.0
    assert H.stored_gaps(gaps, "2026-04").collect() == [] and H.period_lookup(m, "2026-04").collect()[0]["gaps_count"] == 0
    assert [r["transaction_id"] for r in H.stored_gaps(gaps, "2026-04", shown_run="dre_2026-04_20260502.json").collect()] == ["y"]


def test_empty_sheets_say_so(spark, tmp_path):
    from tillrec.sinks import writers
    empty = spark.createDataFrame([], "transaction_id string, source string, amount_brl double, gap_type string, detail string")
    writers._sheet(writers.gap_sheet(empty), writers.NO_GAPS, str(tmp_path / "g"), "overwrite")
    assert spark.read.option("header", True).csv(str(tmp_path / "g")).collect()[0]["info"] == writers.NO_GAPS


def test_quoted_text_headers_and_line_breaks(spark, tmp_path):
    text = ('"ID Transacao";"Data/Hora";"Valor; Total";Valor;Forma de Pagamento;Obs\n'
            'P1;2026-03-05 10:00:00;x;10,00;pix;"diz ""oi"" ok"\n'
            'P2;2026-03-05 10:00:00;x;10,00;pix;"linha 1\nlinha 2; fim"\n')
    v = V.validate(files.read_export(spark, write(tmp_path, "q.csv", text), POS), POS).collect()
    got = {r["transaction_id"]: (r["notes"], r[V.ERROR_COL]) for r in v}
    assert got == {"P1": ('diz "oi" ok', None), "P2": ("linha 1\nlinha 2; fim", None)}


def test_files_of_a_glob_are_read_by_their_own_headers(spark, tmp_path):
    d = tmp_path / "pos"
    d.mkdir()
    (d / "a.csv").write_text("ID Transacao;Data/Hora;Valor;Forma de Pagamento\nP1;2026-03-05 10:00:00;10,00;pix\n", encoding="utf-8")
    (d / "b.csv").write_text("Valor,Forma de Pagamento,ID Transacao,Data/Hora\n\"20,00\",Crédito,P2,05/03/2026\n", encoding="utf-8")
    v = V.validate(files.read_export(spark, str(d / "*.csv"), POS), POS)
    got = sorted((r["transaction_id"], str(r["gross_value"]), r[V.ERROR_COL]) for r in v.collect())
    assert got == [("P1", "10.00", None), ("P2", "20.00", None)]


def _sheet_xml(rows):
    return "".join(f'<row r="{n}">' + "".join(f'<c r="{chr(65 + i)}{n}"{a}>{v}</c>' for i, (a, v) in enumerate(r)) + "</row>"
                   for n, r in enumerate(rows, 1))


def test_xlsx_typed_cells(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rns = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    text = lambda t: (' t="inlineStr"', f"<is><t>{t}</t></is>")
    rows = [[text(h) for h in ("ID Transacao", "Data/Hora", "Valor", "Forma de Pagamento", "Obs")],
            [text("P1"), (' s="1"', "<v>46086.4375</v>"), ("", "<v>10.5</v>"), text("pix"), (' t="b"', "<v>1</v>")],
            [text("P2"), (' s="2"', "<v>46086</v>"), ("", "<v>20</v>"), text("pix"), (' t="e"', "<v>#N/A</v>")],
            [text("P3"), (' t="str"', "<v>05/03/2026</v>"), ("", "<v>3</v>"), text("pix"), ("", "")]]
    for epoch, name, days in (("", "a.xlsx", 0), ('<workbookPr date1904="1"/>', "b.xlsx", 1462)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {ns} {rns}>{epoch}<sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="[$-416]dd/mm/yyyy &quot;x&quot;"/></numFmts>'
                                        '<cellXfs><xf numFmtId="0"/><xf numFmtId="22"/><xf numFmtId="164"/></cellXfs></styleSheet>')
            z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{_sheet_xml(rows)}</sheetData></worksheet>")
        df = files.read_export(spark, str(tmp_path / name), POS)
        v = {r["transaction_id"]: r for r in V.validate(df, POS).collect()}
        import datetime as dt
        shift = dt.timedelta(days=days)
        assert v["P1"]["transaction_date"] == dt.datetime(2026, 3, 5, 10, 30) + shift and v["P1"][V.ERROR_COL] is None
        assert v["P2"]["transaction_date"] == dt.datetime(2026, 3, 5) + shift
        assert v["P3"]["transaction_date"] == dt.datetime(2026, 3, 5)
        assert (v["P1"]["notes"], v["P2"]["notes"], v["P3"]["notes"]) == ("True", None, None)
        assert str(v["P2"]["gross_value"]) == "20.00"


def test_xls_is_refused_before_anything_runs():
    with pytest.raises(ValueError, match="xlsx"):
        JobArgs("a.csv", "b.xls", "c.csv", "2026-03")


def test_artefacts_without_a_month_are_kept(spark, tmp_path):
    (tmp_path / "statement_x.json").write_text(json.dumps({"net_revenue_brl": 5.0, "gaps_detected": 2, "gaps": [{"amount_brl": 7.0}]}))
    (tmp_path / "statement_y.json").write_text(json.dumps({"something": "else"}))
    m = H.period_metrics(artefacts.read_artefacts(spark, str(tmp_path / "*.json"))).collect()
    assert [(r["reference_month"], r["gaps_count"], r["gaps_value_brl"]) for r in m] == [("N/A", 2, 7.0)]


def test_artefacts_skip_corrupt_and_rank_runs(spark, tmp_path):
    d = tmp_path / "hist"
    d.mkdir()
    base = {"total_gross_revenue_brl": 100.0, "net_revenue_brl": 90.0, "total_deductions_brl": 10.0,
            "total_ifood_commission_brl": 5.0, "total_card_fees_brl": 5.0, "gaps_detected": 2,
            "generated_at": "x"}
    (d / "statement_2026-03_20260401_000000.json").write_text(json.dumps(
        {**base, "reference_month": "2026-03", "gaps": [{"amount_brl": 10.5}, {"amount_brl": None}]}))
    (d / "statement_2026-03_20260402_000000.json").write_text(json.dumps(
        {**base, "reference_month": "2026-03", "net_revenue_brl": 80.0, "gaps": None}))
    (d / "statement_2026-02_20260301_000000.json").write_text(json.dumps(
        {**base, "reference_month": "2026-02", "total_gross_revenue_brl": 0.0, "gaps": []}))
    (d / "statement_2026-01_x.json").write_text("{not json")
    art = artefacts.read_artefacts(spark, str(d / "statement_*.json"))
    m = H.period_metrics(art)
    assert m.count() == 3
    latest = H.latest_period(m).collect()[0]
    first = H.period_lookup(m, "2026-03").collect()[0]
    assert latest["net_revenue_brl"] == 80.0 and first["net_revenue_brl"] == 90.0   # newest vs oldest run
    assert first["gaps_value_brl"] == 10.5
    feb = m.where("reference_month = '2026-02'").collect()[0]
    assert feb["net_margin_pct"] == 0.0
    assert H.dashboard_totals(m, spark.range(2)).collect()[0]["total_hours_saved"] == 12.0


def test_header_alias_override(spark, tmp_path):
    path = write(tmp_path, "vendor.csv", "num_trans;quando;valor;pagto\nT1;2026-03-05 10:00:00;1,00;pix\n")
    spec = POS.with_aliases({"num_trans": "transaction_id", "quando": "transaction_date",
                             "pagto": "payment_method"})
    v = V.validate(files.read_export(spark, path, spec), spec).collect()[0]
    assert v["transaction_id"] == "T1" and v[V.ERROR_COL] is None


def test_last_wins_across_files_in_name_order(spark, tmp_path):
    d = tmp_path / "acq"
    d.mkdir()
    head = "Codigo de Autorizacao;Data de Liquidacao;Valor Bruto;Valor Liquido;Taxa MDR;Tipo de Pagamento\n"
    (d / "a.csv").write_text(head + "A1;2026-03-05;100,00;98,00;2,00;credit\n", encoding="utf-8")
    (d / "b.csv").write_text(head + "B1;2026-03-05;100,00;97,00;3,00;credit\n"
                             + "".join(f"B{i};2026-03-0{1 + i % 4};{i},00;{i},00;0,00;debit\n" for i in range(2, 300)),
                             encoding="utf-8")
    spec = acquirer_spec("stone")
    acq = V.valid_rows(V.validate(files.read_export(spark, str(d / "*.csv"), spec), spec), spec)
    from tillrec.operators import enrich
    lk = enrich.fee_lookup(acq, V.file_order(acq)).where("lk_gross = 100 AND lk_day = DATE'2026-03-05'").collect()
    assert [str(r["lk_fee"]) for r in lk] == ["3.00"]


def test_structure_edges(spark, tmp_path):
    # extra column dropped silently; a ragged line (too many fields) is quarantined as malformed
    text = ("ID Transacao;Data/Hora;Valor Total;Forma de Pagamento;Extra\n"
            "P1;2026-03-05 10:00:00;10,00;pix;x\n"
            "P2;2026-03-05 10:00:00;10,00;pix;x;y;z\n")
    v = V.validate(files.read_export(spark, write(tmp_path, "ragged.csv", text), POS), POS)
    errs = {r["transaction_id"]: r[V.ERROR_COL] for r in v.collect()}
    assert errs["P1"] is None
    assert errs["P2"].startswith(V.MSG_MALFORMED)
    assert "Extra" not in v.columns and "extra" not in v.columns
    # wrong delimiter: the header does not split with any accepted delimiter
    with pytest.raises(ValueError):
        files.read_export(spark, write(tmp_path, "pipe.csv", "a|b|c\n1|2|3\n"), POS)
    # missing id column: every row quarantined with "field required"
    v2 = V.validate(files.read_export(spark, write(tmp_path, "noid.csv", "Data;Valor;Forma Pagamento\n"
                                                  "2026-03-05 10:00:00;1,00;pix\n"), POS), POS)
    assert v2.collect()[0][V.ERROR_COL] == "transaction_id: field required"


def test_new_source_is_only_a_spec(spark, tmp_path):
    from tillrec.sources.spec import FieldRule, SourceSpec
    rappi = SourceSpec(name="rappi", delimiters=(";", ","), id_field="order_id",
                       headers={"pedido": "order_id", "data": "order_date", "total": "gross_value"},
                       fields=(FieldRule("order_id", "req_str"),
                               FieldRule("order_date", "datetime", layouts=("%d/%m/%Y %H:%M:%S",)),
                               FieldRule("gross_value", "money", non_negative=True)))
    path = write(tmp_path, "rappi.csv", "Pedido,Data,Total\nR1,05/03/2026 10:00:00,\"12,50\"\nR2,x,1\n")
    v = V.validate(files.read_export(spark, path, rappi), rappi)
    got = {r["order_id"]: (str(r["gross_value"]), r[V.ERROR_COL]) for r in v.collect()}
    assert got["R1"] == ("12.50", None)
    assert got["R2"][1] == "order_date: cannot parse datetime"
