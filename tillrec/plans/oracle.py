"""DuckDB SQL mirrors of every registered query (the correctness oracle).

Written independently of the Spark code: plain SQL over the shared tables,
correlated ``NOT EXISTS`` for the band joins, window counts for bursts.
Money leaves every query as DOUBLE, as on the Spark side.
"""

from __future__ import annotations

# ------------------------------------------------------------------ derived source tables
BASE = """
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount, l_shipdate,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         l_orderkey*7 + l_partkey*3 + l_suppkey + l_linenumber AS k
  FROM lineitem),
li2 AS (
  SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(price*100 AS BIGINT)) AS rid
  FROM li),
pos AS (
  SELECT 'P' || rid AS transaction_id, l_shipdate AS transaction_date, price AS gross_value,
         (['credito','debito','pix','dinheiro','voucher','outro'])[k % 6 + 1] AS payment_method,
         k AS row_order
  FROM li2 WHERE k % 10 <> 0),
acquirer AS (
  SELECT 'A' || rid AS authorization_code, l_shipdate AS settlement_date,
         CAST(price + CASE WHEN k % 11 = 0 THEN 0.04 WHEN k % 13 = 0 THEN 3.50 ELSE 0 END AS DECIMAL(18,2))
           AS gross_value,
         CAST(round(price * CAST(l_discount AS DECIMAL(5,4)), 2) AS DECIMAL(18,2)) AS acquirer_fee,
         (['credito','debito','pix','dinheiro','voucher','outro'])[k % 6 + 1] AS payment_method,
         k, rid
  FROM li2 WHERE k % 6 IN (0,1,2,4) AND (k % 17 <> 0 OR k % 10 = 0)),
marketplace AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderdate AS order_date,
         CAST(o_totalprice AS DECIMAL(18,2)) AS gross_value,
         CAST(CASE o_orderkey % 3
                WHEN 0 THEN round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.20 AS DECIMAL(5,4)), 2)
                WHEN 1 THEN 0 END AS DECIMAL(18,2)) AS ifood_commission,
         (['credito','debito','pix','voucher','dinheiro'])[CAST(substr(o_orderpriority,1,1) AS INTEGER)]
           AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'concluido' WHEN 'P' THEN 'cancelado' ELSE 'pendente' END AS status,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         o_orderkey AS row_order
  FROM orders),
"""

CHAIN = """
mk_enriched AS (
  SELECT 'ifood' AS source, order_id, order_date,
         CASE WHEN status = 'cancelado' THEN -gross_value ELSE gross_value END AS gross_value,
         CAST(CASE WHEN status = 'cancelado' THEN 0
                   WHEN ifood_commission IS NOT NULL AND ifood_commission > 0 THEN ifood_commission
                   ELSE round(gross_value * CAST(0.23 AS DECIMAL(5,4)), 2) END AS DECIMAL(18,2))
           AS ifood_commission_computed,
         payment_method, status
  FROM {mk}),
fee_lk AS (
  SELECT gross_value AS lk_gross, CAST(settlement_date AS DATE) AS lk_day,
         arg_max(coalesce(acquirer_fee, 0), (k, rid)) AS lk_fee
  FROM {acq} GROUP BY ALL),
pos_fees AS (
  SELECT p.*, lk.lk_day IS NOT NULL AS matched,
         CAST(CASE WHEN lk.lk_day IS NOT NULL THEN lk.lk_fee
              ELSE round(p.gross_value * CAST(CASE p.payment_method
                     WHEN 'credito' THEN 0.0299 WHEN 'debito' THEN 0.0149 WHEN 'pix' THEN 0.0099
                     WHEN 'dinheiro' THEN 0.0 WHEN 'voucher' THEN 0.0149 ELSE 0.0299 END AS DECIMAL(5,4)), 2)
              END AS DECIMAL(18,2)) AS mdr_fee
  FROM {pos} p LEFT JOIN fee_lk lk
    ON lk.lk_gross = p.gross_value AND lk.lk_day = CAST(p.transaction_date AS DATE)),
ledger AS (
  SELECT source, order_id AS record_id, order_date AS date, gross_value,
         gross_value - ifood_commission_computed AS net_value, CAST(0 AS DECIMAL(18,2)) AS mdr_fee,
         ifood_commission_computed, payment_method, status
  FROM mk_enriched
  UNION ALL
  SELECT 'pdv', transaction_id, transaction_date, gross_value, gross_value - mdr_fee, mdr_fee,
         CAST(0 AS DECIMAL(18,2)), payment_method, NULL
  FROM pos_fees),
gap_pos AS (
  SELECT transaction_id, 'PDV' AS source, CAST(gross_value AS DOUBLE) AS amount_brl,
         'PDV_MISSING_IN_ACQUIRER' AS gap_type,
         'Card transaction R$ ' || CAST(gross_value AS VARCHAR) || ' on '
           || strftime(transaction_date, '%Y-%m-%d %H:%M:%S')
           || ' found in PDV but not in acquirer settlement.' AS detail,
         transaction_date AS gap_date, 1 AS gap_order
  FROM {pos} p
  WHERE payment_method IN ('credito','debito','voucher')
    AND EXISTS (SELECT 1 FROM {acq})
    AND NOT EXISTS (SELECT 1 FROM {acq} a
                    WHERE CAST(a.settlement_date AS DATE) = CAST(p.transaction_date AS DATE)
                      AND abs(a.gross_value - p.gross_value) <= 0.05)),
gap_acq AS (
  SELECT authorization_code AS transaction_id, 'Acquirer' AS source, CAST(gross_value AS DOUBLE) AS amount_brl,
         'ACQUIRER_MISSING_IN_PDV' AS gap_type,
         'Acquirer settled R$ ' || CAST(gross_value AS VARCHAR) || ' on '
           || strftime(settlement_date, '%Y-%m-%d %H:%M:%S') || ' (auth: ' || authorization_code
           || ') but no matching PDV transaction found.' AS detail,
         settlement_date AS gap_date, 2 AS gap_order
  FROM {acq} a
  WHERE EXISTS (SELECT 1 FROM {pos})
    AND NOT EXISTS (SELECT 1 FROM {pos} p
                    WHERE CAST(a.settlement_date AS DATE) = CAST(p.transaction_date AS DATE)
                      AND abs(a.gross_value - p.gross_value) <= 0.05)),
gap_cancel AS (
  SELECT order_id AS transaction_id, 'iFood' AS source, CAST(abs(gross_value) AS DOUBLE) AS amount_brl,
         'IFOOD_ORDER_CANCELLED' AS gap_type,
         'iFood order ' || order_id || ' was cancelled (R$ ' || CAST(abs(gross_value) AS VARCHAR)
           || '). Verify it is not counted as revenue.' AS detail,
         order_date AS gap_date, 3 AS gap_order
  FROM {mk} WHERE status = 'cancelado'),
gaps AS (
  SELECT * FROM gap_pos UNION ALL SELECT * FROM gap_acq UNION ALL SELECT * FROM gap_cancel)
"""

DERIVED = BASE.rstrip().rstrip(",") + ",\n" + CHAIN.format(pos="pos", acq="acquirer", mk="marketplace")


def with_derived(body: str) -> str:
    return "WITH " + DERIVED.strip() + "\n" + body.strip()


MONEY7 = """
  CAST(round(pos_g, 2) AS DOUBLE) AS gross_revenue_pdv_brl,
  CAST(round(mk_g, 2) AS DOUBLE) AS gross_revenue_ifood_brl,
  CAST(round(round(pos_g, 2) + round(mk_g, 2), 2) AS DOUBLE) AS total_gross_revenue_brl,
  CAST(round(comm, 2) AS DOUBLE) AS total_ifood_commission_brl,
  CAST(round(fees, 2) AS DOUBLE) AS total_card_fees_brl,
  CAST(round(round(comm, 2) + round(fees, 2), 2) AS DOUBLE) AS total_deductions_brl,
  CAST(round(round(round(pos_g, 2) + round(mk_g, 2), 2) - round(round(comm, 2) + round(fees, 2), 2), 2)
       AS DOUBLE) AS net_revenue_brl"""

TOTALS = """
  coalesce(sum(CASE WHEN source = 'pdv' THEN greatest(gross_value, 0) END), 0) AS pos_g,
  coalesce(sum(CASE WHEN source = 'ifood' THEN greatest(gross_value, 0) END), 0) AS mk_g,
  coalesce(sum(ifood_commission_computed), 0) AS comm,
  coalesce(sum(mdr_fee), 0) AS fees"""


def core_sql(reference_month: str) -> dict[str, str]:
    q: dict[str, str] = {}
    q["marketplace_enriched"] = with_derived("""
SELECT source, order_id, order_date, CAST(gross_value AS DOUBLE) AS gross_value,
       CAST(ifood_commission_computed AS DOUBLE) AS ifood_commission_computed,
       CAST(gross_value - ifood_commission_computed AS DOUBLE) AS net_value,
       CAST(0 AS DOUBLE) AS mdr_fee, payment_method, status
FROM mk_enriched""")
    q["pos_fee_lookup"] = with_derived("""
SELECT transaction_id, CAST(gross_value AS DOUBLE) AS gross_value, matched, CAST(mdr_fee AS DOUBLE) AS mdr_fee
FROM pos_fees""")
    q["pos_fee_fallback"] = with_derived("""
SELECT transaction_id, payment_method, CAST(gross_value AS DOUBLE) AS gross_value,
       CAST(mdr_fee AS DOUBLE) AS fallback_fee
FROM pos_fees WHERE NOT matched""")
    q["pos_enriched"] = with_derived("""
SELECT 'pdv' AS source, transaction_id, transaction_date, CAST(gross_value AS DOUBLE) AS gross_value,
       CAST(0 AS DOUBLE) AS ifood_commission_computed, CAST(gross_value - mdr_fee AS DOUBLE) AS net_value,
       CAST(mdr_fee AS DOUBLE) AS mdr_fee, payment_method, matched
FROM pos_fees""")
    q["unified_ledger"] = with_derived("""
SELECT source, record_id, date, CAST(gross_value AS DOUBLE) AS gross_value, CAST(net_value AS DOUBLE) AS net_value,
       CAST(mdr_fee AS DOUBLE) AS mdr_fee, CAST(ifood_commission_computed AS DOUBLE) AS ifood_commission_computed,
       payment_method, status
FROM ledger""")
    q["ledger_net"] = with_derived("""
SELECT source, record_id,
       CAST(round(gross_value - mdr_fee - ifood_commission_computed, 2) AS DOUBLE) AS net_value_final
FROM ledger""")
    q["income_statement"] = with_derived(f"""
, t AS (SELECT {TOTALS} FROM ledger)
SELECT '{reference_month}' AS reference_month, {MONEY7},
       (SELECT CAST(count(*) AS INTEGER) FROM gaps) AS gaps_detected
FROM t""")
    q["revenue_by_payment"] = with_derived("""
SELECT payment_method, CAST(round(sum(gross_value), 2) AS DOUBLE) AS revenue_brl
FROM ledger WHERE gross_value > 0 GROUP BY payment_method""")
    cols = "transaction_id, source, amount_brl, gap_type, detail, gap_date, gap_order"
    q["gaps_pos_missing"] = with_derived(f"SELECT {cols} FROM gap_pos")
    q["gaps_acquirer_missing"] = with_derived(f"SELECT {cols} FROM gap_acq")
    q["gaps_cancelled"] = with_derived(f"SELECT {cols} FROM gap_cancel")
    q["gaps_all"] = with_derived(f"SELECT {cols} FROM gaps")
    return q


# ------------------------------------------------------------------ raw export text
def _br(x: str) -> str:
    return f"translate(format('{{:,.2f}}', {x}), ',.', '.,')"


def _broken(k: str, kind: int) -> str:
    return f"({k} % 19 = 0 AND ({k} // 19) % 5 = {kind})"


def _shape(ts: str, idx: str, shapes: list[str]) -> str:
    whens = " ".join(f"WHEN {idx} = {i} THEN strftime({ts}, '{s}')" for i, s in enumerate(shapes))
    return f"CASE {whens} END"


SALES_SHAPES = ["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%-d/%-m/%Y", "%Y-%m-%dT%H:%M:%S"]
SETTLE_SHAPES = ["%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S"]

RAW = f"""
raw_pos AS (
  SELECT CASE WHEN {_broken('k', 3)} THEN '' ELSE 'P' || rid END AS transaction_id,
         CASE WHEN {_broken('k', 1)} THEN '31/02/' || CAST(year(l_shipdate) AS VARCHAR)
              ELSE {_shape('l_shipdate', 'k % 4', SALES_SHAPES)} END AS transaction_date,
         CASE WHEN {_broken('k', 0)} THEN 'abc' WHEN {_broken('k', 4)} THEN '-5,00'
              ELSE (CASE WHEN k % 5 = 0 THEN 'R$ ' ELSE '' END) || {_br('price')} END AS gross_value,
         CASE WHEN {_broken('k', 2)} THEN 'Outro'
              ELSE (['Crédito','DEBITO','Pix','especie','voucher','outro'])[k % 6 + 1] END AS payment_method,
         'op' || CAST(k % 7 AS VARCHAR) AS cashier_id,
         CAST(l_linenumber AS VARCHAR) AS table_number, CAST(NULL AS VARCHAR) AS notes,
         k AS row_order,
         CASE WHEN k % 3 = 0 THEN ' op' || CAST(k % 7 AS VARCHAR) || chr(9)
              ELSE 'op' || CAST(k % 7 AS VARCHAR) END AS cashier_text
  FROM li2),
raw_mk AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
         CASE WHEN {_broken('o_orderkey', 1)} THEN '31/02/2026'
              ELSE {_shape('o_orderdate', 'o_orderkey % 4', SALES_SHAPES)} END AS order_date,
         CASE WHEN {_broken('o_orderkey', 0)} THEN 'abc'
              ELSE (CASE WHEN o_orderkey % 5 = 0 THEN 'R$ ' ELSE '' END)
                   || {_br('CAST(o_totalprice AS DECIMAL(18,2))')} END AS gross_value,
         CASE WHEN {_broken('o_orderkey', 4)} THEN 'xyz'
              WHEN o_orderkey % 3 = 0
                THEN {_br('round(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.20 AS DECIMAL(5,4)), 2)')}
              WHEN o_orderkey % 3 = 1 THEN '0,00'
              ELSE ([NULL, '-', 'N/A'])[(o_orderkey // 3) % 3 + 1] END AS ifood_commission,
         CASE WHEN {_broken('o_orderkey', 2)} THEN 'Outro'
              ELSE (['Cartão de Crédito','Débito','PIX','Voucher','dinheiro'])
                   [CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] END AS payment_method,
         CASE WHEN {_broken('o_orderkey', 3)} THEN 'cancelada'
              WHEN o_orderstatus = 'F' THEN 'Concluído' WHEN o_orderstatus = 'P' THEN 'Cancelado'
              ELSE 'pendente' END AS status,
         CAST(o_custkey AS VARCHAR) AS customer_id,
         {_br('CAST(o_custkey % 10 AS DECIMAL(18,2))')} AS delivery_fee,
         o_orderkey AS row_order
  FROM orders),
raw_acq AS (
  SELECT 'A' || rid AS authorization_code, CAST(k AS VARCHAR) AS nsu,
         CASE WHEN {_broken('k', 3)} THEN '31/02/2026'
              ELSE {_shape('l_shipdate', 'k % 4', SETTLE_SHAPES)} END AS settlement_date,
         CASE WHEN {_broken('k', 4)} THEN 'N/A' ELSE {_br('a_gross')} END AS gross_value,
         {_br('CASE WHEN ' + _broken('k', 0) + ' THEN a_gross + 0.02 ELSE a_gross - a_fee END')} AS net_value,
         {_br('a_fee')} AS acquirer_fee,
         (['credit','Debit','pix','dinheiro','voucher','outro'])[k % 6 + 1] AS payment_method,
         CASE WHEN {_broken('k', 1)} THEN '25' WHEN {_broken('k', 2)} THEN '3.5'
              WHEN k % 7 = 0 THEN '3.0' ELSE CAST(k % 12 + 1 AS VARCHAR) END AS installments,
         'stone' AS acquirer_name, k AS row_order
  FROM (SELECT *,
          CAST(price + CASE WHEN k % 11 = 0 THEN 0.04 WHEN k % 13 = 0 THEN 3.50 ELSE 0 END AS DECIMAL(18,2))
            AS a_gross,
          CAST(round(price * CAST(l_discount AS DECIMAL(5,4)), 2) AS DECIMAL(18,2)) AS a_fee
        FROM li2)),
"""


def _money(x: str) -> str:
    return f"TRY_CAST(trim(replace(replace(replace({x}, 'R$', ''), '.', ''), ',', '.')) AS DECIMAL(18,2))"


def _opt_blank(x: str) -> str:
    return f"({x} IS NULL OR trim({x}) IN ('', '-', 'N/A'))"


def _ts(x: str, layouts: list[str]) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({x}, '{f}')" for f in layouts) + ")"


SALES_LAYOUTS = ["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S"]
SETTLE_LAYOUTS = ["%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S"]


def _map(x: str, cases: str) -> str:
    return f"coalesce(CASE lower(trim({x})) {cases} END, {x})"


# FIXED VALUES: spellings, written out here again so that a slip in the code under test shows
MARKETPLACE_METHODS = """WHEN 'cartão de crédito' THEN 'credito' WHEN 'credito' THEN 'credito' WHEN 'crédito' THEN 'credito'
  WHEN 'cartão de débito' THEN 'debito' WHEN 'debito' THEN 'debito' WHEN 'débito' THEN 'debito' WHEN 'pix' THEN 'pix'
  WHEN 'dinheiro' THEN 'dinheiro' WHEN 'voucher' THEN 'voucher'"""
POS_METHODS = """WHEN 'crédito' THEN 'credito' WHEN 'credito' THEN 'credito' WHEN 'débito' THEN 'debito'
  WHEN 'debito' THEN 'debito' WHEN 'pix' THEN 'pix' WHEN 'dinheiro' THEN 'dinheiro' WHEN 'especie' THEN 'dinheiro'
  WHEN 'voucher' THEN 'voucher'"""
ACQUIRER_METHODS = """WHEN 'credit' THEN 'credito' WHEN 'credito' THEN 'credito' WHEN 'debit' THEN 'debito'
  WHEN 'debito' THEN 'debito' WHEN 'pix' THEN 'pix' WHEN 'voucher' THEN 'voucher'"""
STATUSES = """WHEN 'concluído' THEN 'concluido' WHEN 'concluido' THEN 'concluido' WHEN 'cancelado' THEN 'cancelado'
  WHEN 'pendente' THEN 'pendente'"""


def _validation_ctes() -> str:
    pm = "('credito','debito','pix','dinheiro','voucher','outro')"
    return f"""
v_mk AS (
  SELECT *, nullif(concat_ws('; ',
      CASE WHEN order_id IS NULL THEN 'order_id: field required' END,
      CASE WHEN length(order_id) < 1 THEN 'order_id: should have at least 1 character' END,
      CASE WHEN order_date IS NULL THEN 'order_date: field required' END,
      CASE WHEN order_date IS NOT NULL AND p_date IS NULL THEN 'order_date: cannot parse datetime' END,
      CASE WHEN gross_value IS NULL THEN 'gross_value: field required' END,
      CASE WHEN gross_value IS NOT NULL AND p_gross IS NULL THEN 'gross_value: must be numeric' END,
      CASE WHEN p_gross < 0 THEN 'gross_value: must be >= 0' END,
      CASE WHEN NOT {_opt_blank('ifood_commission')} AND p_comm IS NULL THEN 'ifood_commission: must be numeric' END,
      CASE WHEN payment_method IS NULL THEN 'payment_method: field required' END,
      CASE WHEN payment_method IS NOT NULL AND p_method NOT IN {pm} THEN 'payment_method: not an allowed value' END,
      CASE WHEN status IS NULL THEN 'status: field required' END,
      CASE WHEN status IS NOT NULL AND p_status NOT IN ('concluido','cancelado','pendente')
           THEN 'status: not an allowed value' END,
      CASE WHEN NOT {_opt_blank('delivery_fee')} AND p_fee IS NULL THEN 'delivery_fee: must be numeric' END
    ), '') AS validation_error
  FROM (SELECT *, {_ts('order_date', SALES_LAYOUTS)} AS p_date, {_money('gross_value')} AS p_gross,
               CASE WHEN {_opt_blank('ifood_commission')} THEN NULL ELSE {_money('ifood_commission')} END AS p_comm,
               {_map('payment_method', MARKETPLACE_METHODS)} AS p_method,
               {_map('status', STATUSES)} AS p_status,
               CASE WHEN {_opt_blank('delivery_fee')} THEN NULL ELSE {_money('delivery_fee')} END AS p_fee
        FROM raw_mk)),
v_pos AS (
  SELECT *, nullif(concat_ws('; ',
      CASE WHEN transaction_id IS NULL THEN 'transaction_id: field required' END,
      CASE WHEN length(transaction_id) < 1 THEN 'transaction_id: should have at least 1 character' END,
      CASE WHEN transaction_date IS NULL THEN 'transaction_date: field required' END,
      CASE WHEN transaction_date IS NOT NULL AND p_date IS NULL THEN 'transaction_date: cannot parse datetime' END,
      CASE WHEN gross_value IS NULL THEN 'gross_value: field required' END,
      CASE WHEN gross_value IS NOT NULL AND p_gross IS NULL THEN 'gross_value: must be numeric' END,
      CASE WHEN p_gross < 0 THEN 'gross_value: must be >= 0' END,
      CASE WHEN payment_method IS NULL THEN 'payment_method: field required' END,
      CASE WHEN payment_method IS NOT NULL AND p_method NOT IN {pm} THEN 'payment_method: not an allowed value' END
    ), '') AS validation_error
  FROM (SELECT *, {_ts('transaction_date', SALES_LAYOUTS)} AS p_date, {_money('gross_value')} AS p_gross,
               {_map('payment_method', POS_METHODS)} AS p_method
        FROM raw_pos)),
v_acq0 AS (
  SELECT *, concat_ws('; ',
      CASE WHEN authorization_code IS NULL THEN 'authorization_code: field required' END,
      CASE WHEN length(authorization_code) < 1 THEN 'authorization_code: should have at least 1 character' END,
      CASE WHEN settlement_date IS NULL THEN 'settlement_date: field required' END,
      CASE WHEN settlement_date IS NOT NULL AND p_date IS NULL THEN 'settlement_date: cannot parse datetime' END,
      CASE WHEN gross_value IS NULL THEN 'gross_value: field required' END,
      CASE WHEN gross_value IS NOT NULL AND p_gross IS NULL THEN 'gross_value: must be numeric' END,
      CASE WHEN net_value IS NULL THEN 'net_value: field required' END,
      CASE WHEN net_value IS NOT NULL AND p_net IS NULL THEN 'net_value: must be numeric' END,
      CASE WHEN NOT (acquirer_fee IS NULL OR trim(acquirer_fee) = '') AND p_fee IS NULL
           THEN 'acquirer_fee: must be numeric' END,
      CASE WHEN payment_method IS NULL THEN 'payment_method: field required' END,
      CASE WHEN payment_method IS NOT NULL AND p_method NOT IN {pm} THEN 'payment_method: not an allowed value' END,
      CASE WHEN p_inst IS NULL THEN 'installments: must be an integer between 1 and 24' END,
      CASE WHEN acquirer_name IS NULL THEN 'acquirer_name: field required' END,
      CASE WHEN length(acquirer_name) < 1 THEN 'acquirer_name: should have at least 1 character' END
    ) AS field_errors
  FROM (SELECT *, {_ts('settlement_date', SETTLE_LAYOUTS)} AS p_date, {_money('gross_value')} AS p_gross,
               {_money('net_value')} AS p_net,
               CASE WHEN acquirer_fee IS NULL OR trim(acquirer_fee) = '' THEN NULL
                    ELSE {_money('acquirer_fee')} END AS p_fee,
               {_map('payment_method', ACQUIRER_METHODS)} AS p_method,
               CASE WHEN regexp_full_match(installments, '\\s*[+-]?\\d+(\\.0+)?\\s*')
                     AND CAST(trim(installments) AS DECIMAL(38,0)) BETWEEN 1 AND 24
                    THEN CAST(CAST(trim(installments) AS DECIMAL(38,0)) AS INTEGER) END AS p_inst
        FROM raw_acq)),
v_acq AS (
  SELECT *, nullif(concat_ws('; ', nullif(field_errors, ''),
      CASE WHEN field_errors = '' AND p_net > p_gross + 0.01
           THEN 'root: net_value cannot exceed gross_value' END), '') AS validation_error
  FROM v_acq0),
valid_pos AS (
  SELECT transaction_id, p_date AS transaction_date, p_gross AS gross_value, p_method AS payment_method, row_order
  FROM v_pos WHERE validation_error IS NULL),
valid_acq AS (
  SELECT authorization_code, p_date AS settlement_date, p_gross AS gross_value, p_net AS net_value,
         p_fee AS acquirer_fee, p_method AS payment_method, row_order AS k, authorization_code AS rid
  FROM v_acq WHERE validation_error IS NULL),
valid_mk AS (
  SELECT order_id, p_date AS order_date, p_gross AS gross_value, p_comm AS ifood_commission,
         p_method AS payment_method, p_status AS status, row_order
  FROM v_mk WHERE validation_error IS NULL),
"""


def with_raw(body: str, run_chain: bool = False) -> str:
    head = BASE.rstrip() + "\n" + RAW.strip() + "\n" + _validation_ctes().strip()
    if run_chain:
        head = head + "\n" + CHAIN.format(pos="valid_pos", acq="valid_acq", mk="valid_mk").strip()
    else:
        head = head.rstrip().rstrip(",")
    return "WITH " + head.strip() + "\n" + body.strip()


def raw_sql(reference_month: str) -> dict[str, str]:
    q: dict[str, str] = {}
    q["parse_money"] = with_raw("""
SELECT row_order, gross_value AS gross_text, CAST(TRY_CAST(trim(replace(replace(replace(gross_value, 'R$', ''),
       '.', ''), ',', '.')) AS DECIMAL(18,2)) AS DOUBLE) AS gross_value
FROM raw_pos""")
    q["parse_optional_money"] = with_raw(f"""
SELECT row_order, ifood_commission AS commission_text, CAST(p_comm AS DOUBLE) AS commission,
       ({_opt_blank('ifood_commission')} OR p_comm IS NOT NULL) AS commission_ok
FROM v_mk""")
    q["parse_dates"] = with_raw("""
SELECT 'pos' AS source, row_order, transaction_date AS date_text, p_date AS parsed FROM v_pos
UNION ALL
SELECT 'acquirer', row_order, settlement_date, p_date FROM v_acq""")
    q["normalise_payment"] = with_raw("""
SELECT 'marketplace' AS source, row_order, payment_method AS method_text, p_method AS payment_method,
       p_method IN ('credito','debito','pix','dinheiro','voucher','outro') AS is_valid FROM v_mk
UNION ALL
SELECT 'pos', row_order, payment_method, p_method,
       p_method IN ('credito','debito','pix','dinheiro','voucher','outro') FROM v_pos
UNION ALL
SELECT 'acquirer', row_order, payment_method, p_method,
       p_method IN ('credito','debito','pix','dinheiro','voucher','outro') FROM v_acq""")
    q["normalise_status"] = with_raw("""
SELECT row_order, status AS status_text, p_status AS status,
       p_status IN ('concluido','cancelado','pendente') AS is_valid
FROM v_mk""")
    q["trim_strings"] = with_raw("""
SELECT row_order, cashier_text, regexp_replace(cashier_text, '^\\s+|\\s+$', '', 'g') AS cashier_id
FROM raw_pos""")
    q["validate_split"] = with_raw("""
SELECT row_order AS source_row_index, order_id, validation_error IS NULL AS is_valid, validation_error
FROM v_mk""")
    q["validate_installments"] = with_raw("""
SELECT row_order AS source_row_index, installments AS installments_text, p_inst AS installments,
       p_inst IS NOT NULL AS installments_ok
FROM v_acq""")
    q["validate_net_le_gross"] = with_raw("""
SELECT row_order AS source_row_index, CAST(p_gross AS DOUBLE) AS gross_value, CAST(p_net AS DOUBLE) AS net_value,
       NOT (p_net > p_gross + 0.01) AS net_ok
FROM v_acq0 WHERE field_errors = ''""")
    def original(fields: str) -> str:
        return "concat_ws('|', " + ", ".join(f"'{f}=' || {f}" for f in sorted(fields.split())) + ")"

    q["quarantine_log"] = with_raw(f"""
SELECT 'marketplace' AS source, order_id AS record_id,
       {original('order_id order_date gross_value ifood_commission payment_method status customer_id delivery_fee')} AS original,
       validation_error, row_order AS source_row_index
FROM v_mk WHERE validation_error IS NOT NULL
UNION ALL
SELECT 'pos', transaction_id,
       {original('transaction_id transaction_date gross_value payment_method cashier_id table_number notes')},
       validation_error, row_order FROM v_pos WHERE validation_error IS NOT NULL
UNION ALL
SELECT 'acquirer', authorization_code,
       {original('authorization_code nsu settlement_date gross_value net_value acquirer_fee payment_method installments acquirer_name')},
       validation_error, row_order FROM v_acq WHERE validation_error IS NOT NULL""")
    q["extraction_counts"] = with_raw("""
SELECT 'marketplace' AS source, count(*) AS raw_rows, count(*) FILTER (WHERE validation_error IS NULL) AS valid_rows,
       count(*) FILTER (WHERE validation_error IS NOT NULL) AS quarantined_rows FROM v_mk
UNION ALL
SELECT 'pos', count(*), count(*) FILTER (WHERE validation_error IS NULL),
       count(*) FILTER (WHERE validation_error IS NOT NULL) FROM v_pos
UNION ALL
SELECT 'acquirer', count(*), count(*) FILTER (WHERE validation_error IS NULL),
       count(*) FILTER (WHERE validation_error IS NOT NULL) FROM v_acq""")
    q["run_summary"] = with_raw(f"""
, t AS (SELECT {TOTALS} FROM ledger)
SELECT '{reference_month}' AS reference_month,
       (SELECT count(*) FROM valid_mk) AS total_ifood_orders,
       (SELECT count(*) FROM valid_pos) AS total_pdv_transactions,
       (SELECT count(*) FROM valid_acq) AS total_acquirer_transactions,
       (SELECT count(*) FROM v_mk WHERE validation_error IS NOT NULL)
         + (SELECT count(*) FROM v_pos WHERE validation_error IS NOT NULL)
         + (SELECT count(*) FROM v_acq WHERE validation_error IS NOT NULL) AS quarantined_rows,
       CAST(round(round(pos_g, 2) + round(mk_g, 2), 2) AS DOUBLE) AS gross_revenue_brl,
       CAST(round(round(comm, 2) + round(fees, 2), 2) AS DOUBLE) AS total_fees_brl,
       CAST(round(round(round(pos_g, 2) + round(mk_g, 2), 2) - round(round(comm, 2) + round(fees, 2), 2), 2)
            AS DOUBLE) AS net_revenue_brl,
       (SELECT CAST(count(*) AS INTEGER) FROM gaps) AS gaps_detected
FROM t""", run_chain=True)
    return q


# ------------------------------------------------------------------ history, alerts, leads, pages, bursts
def _coalesced_money7() -> str:
    out = []
    for line in MONEY7.strip().split(",\n"):
        expr, alias = line.rsplit(" AS ", 1)
        out.append(f"coalesce({expr.strip()}, 0.0) AS {alias.strip()}")
    return ",\n  ".join(out)


def _py_space_class() -> str:
    # Unicode white space: category Zs, and the bidirectional types WS, B and S
    return r"[\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def more_sql(month: str, min_amount: float, trend_n: int, run_stamp: str, generated_at: str, lead_id: str,
             page_from: str, page_to: str, skip: int, limit: int) -> dict[str, str]:
    q: dict[str, str] = {}
    art = f"""
, mt AS (SELECT strftime(date, '%Y-%m') AS reference_month, {TOTALS} FROM ledger GROUP BY 1),
gt AS (SELECT strftime(gap_date, '%Y-%m') AS reference_month, count(*) AS gaps_detected,
              round(sum(CAST(amount_brl AS DECIMAL(18,2))), 2) AS gv FROM gaps GROUP BY 1),
art AS (
  SELECT coalesce(mt.reference_month, gt.reference_month) AS reference_month,
         {_coalesced_money7()},
         CAST(coalesce(gt.gaps_detected, 0) AS INTEGER) AS gaps_detected,
         CAST(coalesce(gt.gv, 0) AS DOUBLE) AS gaps_value_brl,
         '{generated_at}' AS generated_at,
         'statement_' || coalesce(mt.reference_month, gt.reference_month) || '_{run_stamp}.json' AS file_name
  FROM mt FULL OUTER JOIN gt ON mt.reference_month = gt.reference_month),
pm AS (
  SELECT reference_month, total_gross_revenue_brl AS gross_revenue_brl, net_revenue_brl, total_deductions_brl,
         total_ifood_commission_brl AS ifood_commission_brl, total_card_fees_brl AS card_fees_brl,
         CASE WHEN total_gross_revenue_brl > 0 THEN round(net_revenue_brl / total_gross_revenue_brl * 100, 2)
              ELSE 0.0 END AS net_margin_pct,
         gaps_detected AS gaps_count, gaps_value_brl, generated_at, file_name
  FROM art),
alerts AS (
  SELECT gap_type || ':' || transaction_id || ':' || left(md5(concat_ws('|', source,
           CAST(CAST(amount_brl AS DECIMAL(18,2)) AS VARCHAR), strftime(gap_date, '%Y-%m-%d %H:%M:%S'))), 12) AS alert_id,
         CASE WHEN amount_brl >= 5000 THEN 'critical' WHEN amount_brl >= 1000 THEN 'high'
              WHEN amount_brl >= 100 THEN 'medium' ELSE 'low' END AS severity,
         '[' || gap_type || '] Furo detectado - R$ ' || CAST(CAST(amount_brl AS DECIMAL(18,2)) AS VARCHAR) AS title,
         detail AS message, transaction_id, amount_brl, strftime(gap_date, '%Y-%m') AS reference_month,
         gap_date AS created_at
  FROM gaps),
subs AS (
  SELECT 'SUB-' || CAST(n_nationkey AS VARCHAR) AS subscriber_id,
         (['slack','telegram','whatsapp','email','generic_webhook'])[n_nationkey % 5 + 1] AS channel,
         (['low','medium','high','critical'])[n_nationkey % 4 + 1] AS severity_filter,
         n_nationkey % 6 <> 0 AS active
  FROM nation),
acks AS (
  SELECT alert_id, created_at + INTERVAL 1 DAY AS ack_at FROM alerts
  WHERE CAST(CAST(amount_brl * 100 AS DECIMAL(18,0)) AS BIGINT) % 4 = 0
  UNION ALL
  SELECT alert_id, created_at + INTERVAL 2 DAY FROM alerts
  WHERE CAST(CAST(amount_brl * 100 AS DECIMAL(18,0)) AS BIGINT) % 8 = 0),
open_alerts AS (SELECT * FROM alerts a WHERE NOT EXISTS (SELECT 1 FROM acks k WHERE k.alert_id = a.alert_id))
"""
    pm_cols = ("reference_month, gross_revenue_brl, net_revenue_brl, total_deductions_brl, ifood_commission_brl, "
               "card_fees_brl, net_margin_pct, gaps_count, gaps_value_brl, generated_at")
    q["period_metrics"] = with_derived(art + f"SELECT {pm_cols} FROM pm")
    q["period_index"] = with_derived(art + "SELECT reference_month, gross_revenue_brl, net_revenue_brl, gaps_count "
                                           "FROM pm ORDER BY reference_month")
    q["latest_period"] = with_derived(art + f"SELECT {pm_cols} FROM pm ORDER BY reference_month DESC, "
                                            "file_name DESC LIMIT 1")
    q["trend_last_n"] = with_derived(art + f"""SELECT reference_month AS month, gross_revenue_brl AS gross_revenue,
       net_revenue_brl AS net_revenue, gaps_count
FROM (SELECT * FROM pm ORDER BY reference_month DESC, file_name DESC LIMIT {trend_n}) ORDER BY month""")
    q["period_lookup"] = with_derived(art + f"SELECT {pm_cols} FROM pm WHERE reference_month = '{month}' "
                                            "ORDER BY file_name LIMIT 1")
    q["gap_drilldown"] = with_derived(f"""
SELECT transaction_id, source, coalesce(gap_type, 'UNKNOWN') AS gap_type, round(amount_brl, 2) AS amount_brl,
       detail, gap_order
FROM gaps WHERE strftime(gap_date, '%Y-%m') = '{month}' AND coalesce(amount_brl, 0) >= {min_amount}
ORDER BY amount_brl DESC, gap_order, transaction_id""")
    q["alerts_from_gaps"] = with_derived(art + "SELECT * FROM alerts")
    q["alert_routing"] = with_derived(art + """
SELECT a.alert_id, a.severity, s.subscriber_id, s.channel
FROM alerts a JOIN subs s
  ON s.active AND list_position(['low','medium','high','critical'], s.severity_filter)
                  <= list_position(['low','medium','high','critical'], a.severity)""")
    q["alert_state"] = with_derived(art + """
SELECT a.alert_id, k.ack_at IS NOT NULL AS acknowledged, k.ack_at AS acknowledged_at
FROM alerts a LEFT JOIN (SELECT alert_id, max(ack_at) AS ack_at FROM acks GROUP BY 1) k USING (alert_id)""")
    q["alerts_open"] = with_derived(art + "SELECT alert_id, severity, amount_brl FROM open_alerts")
    q["dashboard_totals"] = with_derived(art + """
SELECT CAST(round(coalesce(sum(CAST(gaps_value_brl AS DECIMAL(18,2))), 0), 2) AS DOUBLE) AS total_recovered_brl,
       CAST(round(coalesce(sum(gaps_count), 0) * 2.0, 1) AS DOUBLE) AS total_hours_saved,
       (SELECT count(*) FROM open_alerts) AS alerts_open
FROM pm""")

    ws = _py_space_class()
    leads = f"""
WITH lines AS (
  SELECT c_custkey AS line_no, c_custkey % 23 = 0 AS blank,
         c_custkey % 23 <> 0 AND c_custkey % 17 = 0 AS malformed,
         CASE WHEN c_custkey % 19 <> 0 THEN 'LEAD-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS id,
         CASE WHEN c_custkey % 31 = 0 THEN NULL
              ELSE TIMESTAMP '2026-01-01 00:00:00' + to_minutes(CAST(c_custkey * 37 AS BIGINT)) END AS received_ts,
         CASE WHEN c_custkey % 11 = 0 THEN '<b>' || c_name || '</b>' ELSE c_name END AS name,
         c_mktsegment AS restaurant,
         (['50k-100k','100k-250k','250k-500k','500k+','unknown'])[c_custkey % 5 + 1] AS revenue,
         CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 7 = 1 THEN 'ifood' ELSE 'ifood,pdv,stone' END
           AS systems,
         CASE WHEN c_custkey % 9 = 0 THEN '12345'
              ELSE '(' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || ') 9'
                   || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone,
         CASE WHEN c_custkey % 13 = 0 THEN 'bad-email' WHEN c_custkey % 13 = 1 THEN NULL
              ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@example.com' END AS email,
         (['landing_page','WhatsApp','unknown',' referral '])[c_custkey % 4 + 1] AS source,
         c_custkey % 10 <> 0 AS lgpd_consent
  FROM customer),
good AS (SELECT * FROM lines WHERE NOT blank AND NOT malformed)
"""

    def clean(x: str) -> str:
        return f"regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '^{ws}+|{ws}+$', '', 'g')"

    q["lead_count"] = leads + "SELECT count(*) AS lead_count FROM lines WHERE NOT blank"
    q["lead_validate"] = leads + f"""
SELECT line_no, id, {clean('name')} AS name, {clean('restaurant')} AS restaurant, systems,
       regexp_replace(phone, '[^0-9]', '', 'g') AS phone,
       CASE WHEN lower(trim(source)) IN ('landing_page','whatsapp','referral','google_ads','instagram','linkedin',
                                         'organic','other') THEN lower(trim(source)) ELSE 'other' END AS source,
       failed = '' AS is_valid, nullif(failed, '') AS failed_checks
FROM (SELECT *, concat_ws(',',
        CASE WHEN NOT length({clean('name')}) BETWEEN 3 AND 120 THEN 'name' END,
        CASE WHEN NOT length({clean('restaurant')}) BETWEEN 2 AND 120 THEN 'restaurant' END,
        CASE WHEN revenue NOT IN ('50k-100k','100k-250k','250k-500k','500k+') THEN 'revenue' END,
        CASE WHEN systems = '' THEN 'systems' END,
        CASE WHEN NOT (length(phone) BETWEEN 10 AND 20
                       AND length(regexp_replace(phone, '[^0-9]', '', 'g')) BETWEEN 10 AND 11) THEN 'phone' END,
        CASE WHEN email IS NOT NULL AND NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') THEN 'email' END,
        CASE WHEN NOT lgpd_consent THEN 'lgpd_consent' END) AS failed
      FROM good)"""
    q["lead_page"] = leads + f"""
SELECT line_no, id, received_ts FROM good
WHERE (received_ts IS NULL OR received_ts >= TIMESTAMP '{page_from}')
  AND (received_ts IS NULL OR received_ts <= TIMESTAMP '{page_to}')
ORDER BY line_no LIMIT {limit} OFFSET {skip}"""
    q["lead_lookup"] = leads + f"SELECT line_no, id, name FROM good WHERE id = '{lead_id}' ORDER BY line_no LIMIT 1"
    q["lead_erase"] = leads + """
SELECT line_no, CASE WHEN malformed THEN NULL ELSE id END AS id FROM lines
WHERE NOT blank AND (malformed OR id IS NULL OR line_no % 29 <> 0)"""
    q["clean_html_text"] = f"""
SELECT page_id, t AS clean_text, CAST(length(t) AS INTEGER) AS n_chars
FROM (SELECT page_id, regexp_replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), chr(0), ''),
                                     '^{ws}+|{ws}+$', '', 'g') AS t FROM pages)"""
    q["burst_counts"] = """
SELECT event_id, user_id, ts, n_in_window, n_in_window > 5 AS over_limit
FROM (SELECT event_id, user_id, ts,
             count(*) OVER (PARTITION BY user_id ORDER BY ts
                            RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n_in_window
      FROM events)"""
    q["burst_flags"] = """
WITH RECURSIVE numbered AS (
  SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
fold AS (
  SELECT event_id, user_id, ts, n, true AS accepted, [ts] AS held FROM numbered WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, ts, n, len(recent) < 5, CASE WHEN len(recent) < 5 THEN list_append(recent, ts) ELSE recent END
  FROM (SELECT e.event_id, e.user_id, e.ts, e.n, list_filter(f.held, lambda t: t >= e.ts - INTERVAL 60 SECONDS) AS recent
        FROM fold f JOIN numbered e ON e.user_id = f.user_id AND e.n = f.n + 1))
SELECT event_id, user_id, ts, accepted FROM fold"""
    return q


# ------------------------------------------------------------------ sinks
def sink_sql(generated_at: str) -> dict[str, str]:
    q: dict[str, str] = {}
    q["ledger_export"] = with_derived("""
SELECT source AS "Origem", record_id AS "ID Transação", date AS "Data",
       CAST(gross_value AS DOUBLE) AS "Valor Bruto (R$)", CAST(net_value AS DOUBLE) AS net_value,
       CAST(mdr_fee AS DOUBLE) AS "Taxa MDR (R$)",
       CAST(ifood_commission_computed AS DOUBLE) AS "Comissão iFood (R$)",
       payment_method AS "Forma de Pagamento", status AS "Status",
       CAST(round(gross_value - mdr_fee - ifood_commission_computed, 2) AS DOUBLE) AS "Valor Líquido (R$)"
FROM ledger""")
    q["gap_export"] = with_derived("""
SELECT transaction_id AS "ID Transação", source AS "Origem", amount_brl AS "Valor (R$)", gap_type AS "Tipo de Furo",
       detail AS "Detalhe" FROM gaps""")
    monthly = f"""
, mt AS (SELECT strftime(date, '%Y-%m') AS reference_month, {TOTALS} FROM ledger GROUP BY 1),
gt AS (SELECT strftime(gap_date, '%Y-%m') AS reference_month, count(*) AS gaps_detected,
              round(sum(CAST(amount_brl AS DECIMAL(18,2))), 2) AS gv FROM gaps GROUP BY 1),
st AS (
  SELECT coalesce(mt.reference_month, gt.reference_month) AS reference_month,
         {_coalesced_money7()},
         CAST(coalesce(gt.gaps_detected, 0) AS INTEGER) AS gaps_detected,
         CAST(coalesce(gt.gv, 0) AS DOUBLE) AS gaps_value_brl
  FROM mt FULL OUTER JOIN gt ON mt.reference_month = gt.reference_month),
byp AS (
  SELECT strftime(date, '%Y-%m') AS reference_month, payment_method,
         CAST(round(sum(gross_value), 2) AS DOUBLE) AS revenue_brl
  FROM ledger WHERE gross_value > 0 GROUP BY 1, 2)
"""
    q["income_statement_json"] = with_derived(monthly + f"""
SELECT st.*, m.revenue_by_payment, '{generated_at}' AS generated_at
FROM st LEFT JOIN (
  SELECT reference_month,
         string_agg(payment_method || '=' || CAST(CAST(revenue_brl AS DECIMAL(18,2)) AS VARCHAR), ';'
                    ORDER BY payment_method) AS revenue_by_payment
  FROM byp GROUP BY 1) m USING (reference_month)""")

    def fmt(col: str) -> str:
        return f"'R$ ' || format('{{:,.2f}}', CAST({col} AS DECIMAL(18,2)))"

    # FIXED VALUES: lines of the statement sheet (item, column, shown as a deduction)
    layout = [
        ("", None, False),
        ("DEMONSTRATIVO DE RESULTADO DO EXERCÍCIO", None, False),
        ("Período de Referência", "reference_month", False),
        ("Gerado em", "generated_at", False),
        ("", None, False),
        ("RECEITA BRUTA", None, False),
        ("  Vendas PDV (físico)", "gross_revenue_pdv_brl", False),
        ("  Pedidos iFood (bruto)", "gross_revenue_ifood_brl", False),
        ("  TOTAL RECEITA BRUTA", "total_gross_revenue_brl", False),
        ("", None, False),
        ("DEDUÇÕES", None, False),
        ("  Comissão iFood (23%)", "total_ifood_commission_brl", True),
        ("  Taxas MDR (cartões)", "total_card_fees_brl", True),
        ("  TOTAL DEDUÇÕES", "total_deductions_brl", True),
        ("", None, False),
        ("RECEITA LÍQUIDA", "net_revenue_brl", False),
        ("", None, False),
        ("FUROS DE CAIXA DETECTADOS", "gaps_detected", False),
        ("", None, False),
        ("RECEITA POR FORMA DE PAGAMENTO", None, False),
    ]
    parts = []
    for n, (label, col, negative) in enumerate(layout):
        if col is None:
            value = "''"
        elif col == "reference_month":
            value = "reference_month"
        elif col == "generated_at":
            value = f"'{generated_at}'"
        elif col == "gaps_detected":
            value = "CAST(gaps_detected AS VARCHAR)"
        else:
            value = fmt(col)
            if negative:
                value = "'- ' || " + value
        safe = label.replace("'", "''")
        parts.append(f"SELECT reference_month, {n} AS line_no, '{safe}' AS item, {value} AS value FROM st")
    n_fixed = len(layout)
    q["statement_rows"] = with_derived(monthly + "\n" + "\nUNION ALL\n".join(parts) + f"""
UNION ALL
SELECT reference_month,
       CAST({n_fixed - 1} + dense_rank() OVER (PARTITION BY reference_month ORDER BY payment_method) AS INTEGER),
       '  ' || upper(substr(payment_method, 1, 1)) || lower(substr(payment_method, 2)), {fmt('revenue_brl')}
FROM byp""")
    return q


# ------------------------------------------------------------------ documented amount mismatch
def mismatch_sql() -> dict[str, str]:
    """Rows of equal day, method and amount are numbered by id; amounts pair, then the k-th rows of both."""
    def body(pos: str, acq: str) -> str:
        return f"""
, lo AS (SELECT transaction_id AS id, CAST(transaction_date AS DATE) AS day, payment_method AS method, gross_value,
                CAST(gross_value * 100 AS BIGINT) AS c, transaction_date AS ts,
                row_number() OVER (PARTITION BY CAST(transaction_date AS DATE), payment_method, gross_value
                                   ORDER BY transaction_id, transaction_date) AS k
         FROM {pos} p
         WHERE payment_method IN ('credito','debito','voucher') AND EXISTS (SELECT 1 FROM {acq})
           AND NOT EXISTS (SELECT 1 FROM {acq} a WHERE CAST(a.settlement_date AS DATE) = CAST(p.transaction_date AS DATE)
                           AND abs(a.gross_value - p.gross_value) <= 0.05)),
ro AS (SELECT authorization_code AS id, CAST(settlement_date AS DATE) AS day, payment_method AS method, gross_value,
              CAST(gross_value * 100 AS BIGINT) AS c, settlement_date AS ts,
              row_number() OVER (PARTITION BY CAST(settlement_date AS DATE), payment_method, gross_value
                                 ORDER BY authorization_code, settlement_date) AS k
       FROM {acq} a
       WHERE EXISTS (SELECT 1 FROM {pos})
         AND NOT EXISTS (SELECT 1 FROM {pos} p WHERE CAST(a.settlement_date AS DATE) = CAST(p.transaction_date AS DATE)
                         AND abs(a.gross_value - p.gross_value) <= 0.05)),
la AS (SELECT day, method, c, count(*) AS n FROM lo GROUP BY ALL),
ra AS (SELECT day, method, c, count(*) AS n FROM ro GROUP BY ALL),
near AS (SELECT la.day, la.method, la.c AS lc, ra.c AS rc, abs(la.c - ra.c) AS d, least(la.n, ra.n) AS m,
                row_number() OVER (PARTITION BY la.day, la.method, la.c ORDER BY abs(la.c - ra.c), ra.c) AS l_first,
                row_number() OVER (PARTITION BY la.day, la.method, ra.c ORDER BY abs(la.c - ra.c), la.c) AS r_first
         FROM la JOIN ra ON la.day = ra.day AND la.method = ra.method),
both_first AS (SELECT * FROM near WHERE l_first = 1 AND r_first = 1 AND d > 5),
pairs AS (SELECT lo.id AS lid, ro.id AS rid, lc, rc, d, lo.ts
          FROM both_first b JOIN lo ON lo.day = b.day AND lo.method = b.method AND lo.c = b.lc AND lo.k <= b.m
                            JOIN ro ON ro.day = b.day AND ro.method = b.method AND ro.c = b.rc AND ro.k = lo.k),
mismatch AS (
SELECT lid AS transaction_id, 'PDV vs Acquirer' AS source, CAST(CAST(d AS DECIMAL(18,2)) / 100 AS DOUBLE) AS amount_brl,
       'AMOUNT_MISMATCH' AS gap_type,
       'PDV recorded R$ ' || CAST(CAST(lc / 100 AS DECIMAL(18,2)) AS VARCHAR) || ' but acquirer settled R$ '
         || CAST(CAST(rc / 100 AS DECIMAL(18,2)) AS VARCHAR) || '. Difference: R$ '
         || CAST(CAST(d / 100 AS DECIMAL(18,2)) AS VARCHAR) || '.' AS detail,
       ts AS gap_date, 1 AS gap_order
FROM pairs),
left_pos AS (
SELECT id AS transaction_id, 'PDV' AS source, CAST(gross_value AS DOUBLE) AS amount_brl, 'PDV_MISSING_IN_ACQUIRER' AS gap_type,
       'Card transaction R$ ' || CAST(gross_value AS VARCHAR) || ' on ' || strftime(ts, '%Y-%m-%d %H:%M:%S')
         || ' found in PDV but not in acquirer settlement.' AS detail, ts AS gap_date, 1 AS gap_order
FROM lo WHERE NOT EXISTS (SELECT 1 FROM both_first b WHERE lo.day = b.day AND lo.method = b.method AND lo.c = b.lc AND lo.k <= b.m)),
left_acq AS (
SELECT id AS transaction_id, 'Acquirer' AS source, CAST(gross_value AS DOUBLE) AS amount_brl, 'ACQUIRER_MISSING_IN_PDV' AS gap_type,
       'Acquirer settled R$ ' || CAST(gross_value AS VARCHAR) || ' on ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' (auth: ' || id
         || ') but no matching PDV transaction found.' AS detail, ts AS gap_date, 2 AS gap_order
FROM ro WHERE NOT EXISTS (SELECT 1 FROM both_first b WHERE ro.day = b.day AND ro.method = b.method AND ro.c = b.rc AND ro.k <= b.m))
"""
    cols = "transaction_id, source, amount_brl, gap_type, detail, gap_date, gap_order"
    every = " UNION ALL ".join(f"SELECT {cols} FROM {t}" for t in ("mismatch", "left_pos", "left_acq", "gap_cancel"))
    repeats = """
, pos_r AS (SELECT * REPLACE (split_part(transaction_id, '-', 1) AS transaction_id,
                              CAST(floor(gross_value / 1000) * 1000 AS DECIMAL(18,2)) AS gross_value) FROM pos),
acq_r AS (SELECT * REPLACE (split_part(authorization_code, '-', 1) AS authorization_code,
                            CAST(floor(gross_value / 1000) * 1000 + CASE WHEN k % 13 = 0 THEN 3.50 ELSE 0 END
                                 AS DECIMAL(18,2)) AS gross_value) FROM acquirer)
"""
    return {"gaps_amount_mismatch_documented": with_derived(body("pos", "acquirer") + f"SELECT {cols} FROM mismatch"),
            "gaps_all_documented": with_derived(body("pos", "acquirer") + every),
            "gaps_all_repeats": with_derived(repeats + body("pos_r", "acq_r") + every)}


def alert_lookup_sql(alert_id: str) -> dict[str, str]:
    sql = more_sql("0000-00", 0.0, 1, "x", "x", "x", "2000-01-01 00:00:00", "2000-01-01 00:00:00", 0, 1)
    head, _ = sql["alerts_from_gaps"].rsplit("SELECT * FROM alerts", 1)
    body = head + f"SELECT * FROM alerts WHERE starts_with(alert_id, '{alert_id}:')"
    return {"alert_lookup": body}
