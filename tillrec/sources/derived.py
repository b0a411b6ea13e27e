"""Source tables derived from the shared test tables (``orders``/``lineitem``).

The three exports of a restaurant month (marketplace orders, pos sales,
acquirer settlements) are derived row-for-row from the star-schema tables
so that every query grows with the data. Membership rules (``k % 10`` etc.)
decide which sales also reach the acquirer — they simulate missing and
surplus settlements; every row is a sale, a settlement or both.

Typed tables feed the finance operators; ``raw_*`` tables render the same
rows as export text (pt-BR money, four date shapes, source spellings, with a
deterministic share of broken rows) to drive parsing and validation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillrec.functions.dates import ntz_text
from tillrec.functions.money import MONEY, RATE
from tillrec.session import compiled_code


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    compiled_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] for a small literal list (0-based)."""
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v)))
    return expr


def _lineitem_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_shipdate")
    price = F.col("l_extendedprice").cast(MONEY)
    k = F.col("l_orderkey") * 7 + F.col("l_partkey") * 3 + F.col("l_suppkey") + F.col("l_linenumber")
    return (li.withColumn("price", price)
              .withColumn("k", k)
              .withColumn("rid", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                             (F.col("price") * 100).cast("bigint"))))


POS_METHODS = ["credito", "debito", "pix", "dinheiro", "voucher", "outro"]
MARKETPLACE_METHODS = ["credito", "debito", "pix", "voucher", "dinheiro"]


def _acquirer_member(k: Column) -> Column:
    return (k % 6).isin(0, 1, 2, 4) & ((k % 17 != 0) | (k % 10 == 0))


def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_keys(spark, sf_dir).where(F.col("k") % 10 != 0)
    return li.select(
        F.concat(F.lit("P"), "rid").alias("transaction_id"),
        F.col("l_shipdate").alias("transaction_date"),
        F.col("price").alias("gross_value"),
        _pick(F.col("k") % 6, POS_METHODS).alias("payment_method"),
        F.col("k").alias("row_order"),
    )


def acquirer(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _lineitem_keys(spark, sf_dir).where(_acquirer_member(F.col("k")))
    k = F.col("k")
    bump = (F.when(k % 11 == 0, F.lit("0.04")).when(k % 13 == 0, F.lit("3.50")).otherwise(F.lit("0"))
            .cast(MONEY))
    fee = F.round(F.col("price") * F.col("l_discount").cast(RATE), 2).cast(MONEY)
    gross = (F.col("price") + bump).cast(MONEY)
    return li.select(
        F.concat(F.lit("A"), "rid").alias("authorization_code"),
        F.col("l_shipdate").alias("settlement_date"),
        gross.alias("gross_value"),
        (gross - fee).cast(MONEY).alias("net_value"),
        fee.alias("acquirer_fee"),
        _pick(k % 6, POS_METHODS).alias("payment_method"),
        F.lit(1).alias("installments"),
        F.lit("stone").alias("acquirer_name"),
        F.col("k").cast("string").alias("nsu"),
        # file order of the settlement export: (k, rid)
        F.struct(F.col("k"), F.col("rid")).alias("row_order"),
    )


def marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    gross = F.col("o_totalprice").cast(MONEY)
    listed = (F.when(key % 3 == 0, F.round(gross * F.lit("0.20").cast(RATE), 2))
               .when(key % 3 == 1, F.lit(0))).cast(MONEY)
    prio = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return o.select(
        key.cast("string").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        gross.alias("gross_value"),
        listed.alias("ifood_commission"),
        _pick(prio, MARKETPLACE_METHODS).alias("payment_method"),
        F.when(F.col("o_orderstatus") == "F", "concluido").when(F.col("o_orderstatus") == "P", "cancelado")
         .otherwise("pendente").alias("status"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        key.alias("row_order"),
    )


def with_repeats(sales: DataFrame, settlements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same sales and settlements with ids that repeat (one per order) and equal amounts: whole
    thousands, for one settlement in thirteen 3.50 more."""
    order = lambda c: F.substring_index(c, "-", 1)
    whole = (F.floor(F.col("gross_value") / 1000) * 1000).cast(MONEY)
    more = F.when(F.col("nsu").cast("long") % 13 == 0, F.lit("3.50")).otherwise(F.lit("0")).cast(MONEY)
    return (sales.withColumn("transaction_id", order("transaction_id")).withColumn("gross_value", whole),
            settlements.withColumn("authorization_code", order("authorization_code")).withColumn("gross_value", (whole + more).cast(MONEY)))


# ----------------------------------------------------------------------------- raw text variants

def pt_br(amount: Column) -> Column:
    """decimal -> ``1.234,56``."""
    return F.translate(F.format_number(amount, 2), ",.", ".,")


SALES_SHAPES = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "d/M/yyyy", "yyyy-MM-dd'T'HH:mm:ss"]
SETTLE_SHAPES = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]


def _shape(ts: Column, idx: Column, shapes: list[str]) -> Column:
    expr = None
    for i, s in enumerate(shapes):
        expr = (F.when(idx == i, ntz_text(ts, s)) if expr is None
                else expr.when(idx == i, ntz_text(ts, s)))
    return expr


def _broken(k: Column, kind: int) -> Column:
    return (k % 19 == 0) & ((k / 19).cast("bigint") % 5 == kind)


def raw_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as export text: parsing and validation read all of them."""
    li = _lineitem_keys(spark, sf_dir)
    k = F.col("k")
    money = F.concat(F.when(k % 5 == 0, F.lit("R$ ")).otherwise(F.lit("")), pt_br(F.col("price")))
    spelled = _pick(k % 6, ["Crédito", "DEBITO", "Pix", "especie", "voucher", "outro"])
    return li.select(
        F.when(_broken(k, 3), F.lit(" ")).otherwise(F.concat(F.lit("P"), "rid")).alias("transaction_id"),
        F.when(_broken(k, 1), F.concat(F.lit("31/02/"), F.year("l_shipdate").cast("string")))
         .otherwise(_shape(F.col("l_shipdate"), k % 4, SALES_SHAPES)).alias("transaction_date"),
        F.when(_broken(k, 0), F.lit("abc")).when(_broken(k, 4), F.lit("-5,00")).otherwise(money)
         .alias("gross_value"),
        F.when(_broken(k, 2), F.lit("Outro")).otherwise(spelled).alias("payment_method"),
        F.when(k % 3 == 0, F.concat(F.lit(" op"), (k % 7).cast("string"), F.lit("\t")))
         .otherwise(F.concat(F.lit("op"), (k % 7).cast("string"))).alias("cashier_id"),
        F.col("l_linenumber").cast("string").alias("table_number"),
        F.lit(None).cast("string").alias("notes"),
        k.alias("row_order"),
    )


def raw_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    key = F.col("o_orderkey")
    gross = F.col("o_totalprice").cast(MONEY)
    money = F.concat(F.when(key % 5 == 0, F.lit("R$ ")).otherwise(F.lit("")), pt_br(gross))
    commission = (F.when(_broken(key, 4), F.lit("xyz"))
                   .when(key % 3 == 0, pt_br(F.round(gross * F.lit("0.20").cast(RATE), 2)))
                   .when(key % 3 == 1, F.lit("0,00"))
                   .otherwise(_pick((key / 3).cast("bigint") % 3, ["", "-", "N/A"])))
    prio = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    spelled = _pick(prio, ["Cartão de Crédito", "Débito", "PIX", "Voucher", "dinheiro"])
    status = (F.when(F.col("o_orderstatus") == "F", "Concluído").when(F.col("o_orderstatus") == "P", "Cancelado")
               .otherwise("pendente"))
    return o.select(
        key.cast("string").alias("order_id"),
        F.when(_broken(key, 1), F.lit("31/02/2026"))
         .otherwise(_shape(F.col("o_orderdate"), key % 4, SALES_SHAPES)).alias("order_date"),
        F.when(_broken(key, 0), F.lit("abc")).otherwise(money).alias("gross_value"),
        F.when(commission == "", F.lit(None)).otherwise(commission).alias("ifood_commission"),
        F.when(_broken(key, 2), F.lit("Outro")).otherwise(spelled).alias("payment_method"),
        F.when(_broken(key, 3), F.lit("cancelada")).otherwise(status).alias("status"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        pt_br((F.col("o_custkey") % 10).cast(MONEY)).alias("delivery_fee"),
        key.alias("row_order"),
    )


def raw_acquirer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as settlement text."""
    li = _lineitem_keys(spark, sf_dir)
    k = F.col("k")
    bump = (F.when(k % 11 == 0, F.lit("0.04")).when(k % 13 == 0, F.lit("3.50")).otherwise(F.lit("0"))
            .cast(MONEY))
    fee = F.round(F.col("price") * F.col("l_discount").cast(RATE), 2).cast(MONEY)
    gross = (F.col("price") + bump).cast(MONEY)
    net = F.when(_broken(k, 0), gross + F.lit("0.02").cast(MONEY)).otherwise(gross - fee).cast(MONEY)
    spelled = _pick(k % 6, ["credit", "Debit", "pix", "dinheiro", "voucher", "outro"])
    installments = (F.when(_broken(k, 1), F.lit("25")).when(_broken(k, 2), F.lit("3.5"))
                     .when(k % 7 == 0, F.lit("3.0")).otherwise(((k % 12) + 1).cast("string")))
    return li.select(
        F.concat(F.lit("A"), "rid").alias("authorization_code"),
        F.col("k").cast("string").alias("nsu"),
        F.when(_broken(k, 3), F.lit("31/02/2026"))
         .otherwise(_shape(F.col("l_shipdate"), k % 4, SETTLE_SHAPES)).alias("settlement_date"),
        F.when(_broken(k, 4), F.lit("N/A")).otherwise(pt_br(gross)).alias("gross_value"),
        pt_br(net).alias("net_value"),
        pt_br(fee).alias("acquirer_fee"),
        spelled.alias("payment_method"),
        installments.alias("installments"),
        F.lit("stone").alias("acquirer_name"),
        k.alias("row_order"),
    )


# ----------------------------------------------------------------------------- alert and lead inputs

def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert subscribers derived from ``nation`` (one per row)."""
    n = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return n.select(
        F.concat(F.lit("SUB-"), key.cast("string")).alias("id"),
        _pick(key % 5, ["slack", "telegram", "whatsapp", "email", "generic_webhook"]).alias("channel"),
        F.concat(F.lit("https://hooks.example.org/"), key.cast("string")).alias("webhook_url"),
        _pick(key % 4, ["low", "medium", "high", "critical"]).alias("severity_filter"),
        (key % 6 != 0).alias("active"),
    )


def acknowledgements(alerts: DataFrame) -> DataFrame:
    """Ack log derived from alerts: a quarter acknowledged a day later, an eighth re-acknowledged."""
    c = (F.col("amount_brl") * 100).cast("decimal(18,0)").cast("bigint")
    first = alerts.where(c % 4 == 0).select("alert_id", (F.col("created_at") + F.expr("INTERVAL 1 DAY")).alias("ack_at"))
    again = alerts.where(c % 8 == 0).select("alert_id", (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("ack_at"))
    return first.unionByName(again)


def lead_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead store lines (``line_no``, ``value``) derived from ``customer``: JSON documents with
    markup in names, bad brackets/systems/phones/e-mails, refused consent, malformed and blank lines."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    at = F.timestamp_add("MINUTE", key * 37, F.lit("2026-01-01 00:00:00").cast("timestamp_ntz"))
    iso = lambda t: ntz_text(t, "yyyy-MM-dd'T'HH:mm:ss")
    lead = F.struct(
        F.when(key % 19 != 0, F.concat(F.lit("LEAD-"), F.lpad(key.cast("string"), 8, "0"))).alias("id"),
        # the same instant in the forms that stores hold: no zone, offsets, Z, fractions
        F.when(key % 31 == 0, F.lit("not-a-date")).when(key % 4 == 0, iso(at))
         .when(key % 4 == 1, F.concat(iso(at), F.lit("+00:00")))
         .when(key % 4 == 2, F.concat(iso(at), F.lit(".000000Z")))
         .otherwise(F.concat(iso(F.timestamp_add("MINUTE", F.lit(-180), at)), F.lit("-03:00"))).alias("received_at"),
        F.when(key % 11 == 0, F.concat(F.lit("<b>"), F.col("c_name"), F.lit("</b>"))).otherwise(F.col("c_name"))
         .alias("name"),
        F.col("c_mktsegment").alias("restaurant"),
        _pick(key % 5, ["50k-100k", "100k-250k", "250k-500k", "500k+", "unknown"]).alias("revenue"),
        F.when(key % 7 == 0, F.array(F.lit("fax"))).when(key % 7 == 1, F.array(F.lit("ifood"), F.lit("fax")))
         .otherwise(F.array(F.lit("ifood"), F.lit("pdv"), F.lit("stone"))).alias("systems"),
        F.when(key % 9 == 0, F.lit("12345")).otherwise(
            F.concat(F.lit("("), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(") 9"),
                     F.lpad(key.cast("string"), 8, "0"))).alias("phone"),
        F.when(key % 13 == 0, F.lit("bad-email")).when(key % 13 == 1, F.lit(None))
         .otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@example.com"))).alias("email"),
        _pick(key % 4, ["landing_page", "WhatsApp", "unknown", " referral "]).alias("source"),
        (key % 10 != 0).alias("lgpd_consent"),
    )
    value = (F.when(key % 23 == 0, F.lit(""))
              .when(key % 17 == 0, F.concat(F.lit('{"id": "LEAD-'), key.cast("string"), F.lit('", broken')))
              .otherwise(F.to_json(lead)))
    return c.select(key.alias("line_no"), value.alias("value"))
