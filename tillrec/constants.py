"""Fixed values that results depend on.

FIXED VALUES — these must equal the behaviour being reproduced (header names
of the exports, accepted spellings, rates, labels, thresholds). They are data,
kept together here in their natural order.
"""

from __future__ import annotations

# --- FIXED VALUES: canonical enums -------------------------------------------
PAYMENT_METHODS = ("credito", "debito", "pix", "dinheiro", "voucher", "outro")
ORDER_STATUSES = ("concluido", "cancelado", "pendente")
CARD_METHODS = ("credito", "debito", "voucher")

# --- FIXED VALUES: accepted payment spellings per source (lower-cased) -------
MARKETPLACE_PAYMENT_MAP = {
    "cartão de crédito": "credito",
    "credito": "credito",
    "crédito": "credito",
    "cartão de débito": "debito",
    "debito": "debito",
    "débito": "debito",
    "pix": "pix",
    "dinheiro": "dinheiro",
    "voucher": "voucher",
}
POS_PAYMENT_MAP = {
    "crédito": "credito",
    "credito": "credito",
    "débito": "debito",
    "debito": "debito",
    "pix": "pix",
    "dinheiro": "dinheiro",
    "especie": "dinheiro",
    "voucher": "voucher",
}
ACQUIRER_PAYMENT_MAP = {
    "credit": "credito",
    "credito": "credito",
    "debit": "debito",
    "debito": "debito",
    "pix": "pix",
    "voucher": "voucher",
}
STATUS_MAP = {
    "concluído": "concluido",
    "concluido": "concluido",
    "cancelado": "cancelado",
    "pendente": "pendente",
}

# --- FIXED VALUES: export header aliases (lower-cased, stripped) -------------
MARKETPLACE_HEADERS = {
    "código do pedido": "order_id",
    "codigo do pedido": "order_id",
    "id do pedido": "order_id",
    "data do pedido": "order_date",
    "data": "order_date",
    "valor total": "gross_value",
    "valor bruto": "gross_value",
    "comissão ifood": "ifood_commission",
    "comissao ifood": "ifood_commission",
    "forma de pagamento": "payment_method",
    "pagamento": "payment_method",
    "status": "status",
    "id cliente": "customer_id",
    "id do cliente": "customer_id",
    "taxa de entrega": "delivery_fee",
    "entrega": "delivery_fee",
}
POS_HEADERS = {
    "id transacao": "transaction_id",
    "id da transacao": "transaction_id",
    "numero transacao": "transaction_id",
    "transacao": "transaction_id",
    "cod. transacao": "transaction_id",
    "data": "transaction_date",
    "data transacao": "transaction_date",
    "data/hora": "transaction_date",
    "data e hora": "transaction_date",
    "valor": "gross_value",
    "valor total": "gross_value",
    "valor bruto": "gross_value",
    "forma pagamento": "payment_method",
    "forma de pagamento": "payment_method",
    "tipo pagamento": "payment_method",
    "operador": "cashier_id",
    "caixa": "cashier_id",
    "id caixa": "cashier_id",
    "mesa": "table_number",
    "numero mesa": "table_number",
    "observacao": "notes",
    "obs": "notes",
    "observações": "notes",
}
STONE_HEADERS = {
    "codigo de autorizacao": "authorization_code",
    "código de autorização": "authorization_code",
    "nsu": "nsu",
    "data de liquidacao": "settlement_date",
    "data liquidação": "settlement_date",
    "data liquidacao": "settlement_date",
    "valor bruto": "gross_value",
    "valor liquido": "net_value",
    "valor líquido": "net_value",
    "taxa": "acquirer_fee",
    "taxa mdr": "acquirer_fee",
    "tipo de pagamento": "payment_method",
    "forma de pagamento": "payment_method",
    "parcelas": "installments",
    "numero de parcelas": "installments",
}
CIELO_HEADERS = {
    "codigo autorizacao": "authorization_code",
    "codigo de autorizacao": "authorization_code",
    "nsu": "nsu",
    "data pagamento": "settlement_date",
    "data de pagamento": "settlement_date",
    "valor bruto": "gross_value",
    "valor liquido": "net_value",
    "taxa adquirente": "acquirer_fee",
    "produto": "payment_method",
    "tipo transacao": "payment_method",
    "qtde parcelas": "installments",
}

# --- FIXED VALUES: accepted timestamp layouts, in trial order ----------------
# (python strptime spellings; see functions/dates.py for the Spark patterns)
SALES_DATE_LAYOUTS = ("%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y", "%Y-%m-%dT%H:%M:%S")
SETTLEMENT_DATE_LAYOUTS = ("%Y-%m-%d", "%d/%m/%Y", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S")

# --- FIXED VALUES: words read as "no value" in optional money cells ----------
OPTIONAL_MONEY_NULL_WORDS = ("", "-", "N/A")

# --- FIXED VALUES: output labels ----------------------------------------------
SOURCE_MARKETPLACE = "ifood"
SOURCE_POS = "pdv"
GAP_POS_MISSING = "PDV_MISSING_IN_ACQUIRER"
GAP_ACQUIRER_MISSING = "ACQUIRER_MISSING_IN_PDV"
GAP_CANCELLED = "IFOOD_ORDER_CANCELLED"
GAP_AMOUNT_MISMATCH = "AMOUNT_MISMATCH"
GAP_SOURCE_POS = "PDV"
GAP_SOURCE_ACQUIRER = "Acquirer"
GAP_SOURCE_MARKETPLACE = "iFood"
GAP_SOURCE_PAIR = "PDV vs Acquirer"
# gap list order: pos missing (1), mismatch (4) per pos row, acquirer (2), cancelled (3)
GAP_ORDER = {GAP_POS_MISSING: 1, GAP_AMOUNT_MISMATCH: 1, GAP_ACQUIRER_MISSING: 2, GAP_CANCELLED: 3}

LEDGER_HEADINGS = {
    "source": "Origem",
    "record_id": "ID Transação",
    "date": "Data",
    "gross_value": "Valor Bruto (R$)",
    "mdr_fee": "Taxa MDR (R$)",
    "ifood_commission_computed": "Comissão iFood (R$)",
    "net_value_final": "Valor Líquido (R$)",
    "payment_method": "Forma de Pagamento",
    "status": "Status",
}
GAP_HEADINGS = {
    "transaction_id": "ID Transação",
    "source": "Origem",
    "amount_brl": "Valor (R$)",
    "gap_type": "Tipo de Furo",
    "detail": "Detalhe",
}

# --- FIXED VALUES: alerts ------------------------------------------------------
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
SEVERITY_THRESHOLDS = ((5000, "critical"), (1000, "high"), (100, "medium"))
HOURS_PER_GAP = 2.0

# --- FIXED VALUES: leads ---------------------------------------------------------
REVENUE_BRACKETS = ("50k-100k", "100k-250k", "250k-500k", "500k+")
SYSTEM_IDS = ("ifood", "rappi", "pdv", "stone", "cielo", "excel")
LEAD_SOURCES = ("landing_page", "whatsapp", "referral", "google_ads", "instagram",
                "linkedin", "organic", "other")
HTML_TAG_PATTERN = r"<[^>]+>"

# --- FIXED VALUES: request admission windows (re-aimed as burst flags) ----------

# --- FIXED VALUES: job argument rules ----------------------------------------------
MONTH_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])$"
ACQUIRERS = ("stone", "cielo")
FILE_SUFFIXES = (".csv", ".xlsx", ".xls")
