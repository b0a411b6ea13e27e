import datetime as dt


from tillrec.sources.spec import POS
from tillrec.streaming import bursts_stream, landing

HEADER = ["ID Transacao", "Data/Hora", "Valor Total", "Forma de Pagamento"]


def test_landing_ingest_available_now(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.csv").write_text(";".join(HEADER) + "\nP1;2026-03-05 10:00:00;10,00;pix\nP2;bad;1,00;pix\n",
                                encoding="utf-8")
    (land / "b.csv").write_text(";".join(HEADER) + "\nP3;05/03/2026;20,00;Crédito\n", encoding="utf-8")
    q = landing.start_ingest(spark, str(land), POS, HEADER, str(tmp_path / "out"), str(tmp_path / "ckpt"),
                             available_now=True)
    q.awaitTermination(120)
    valid = spark.read.parquet(str(tmp_path / "out" / "valid"))
    quarantine = spark.read.parquet(str(tmp_path / "out" / "quarantine"))
    assert sorted(r["transaction_id"] for r in valid.collect()) == ["P1", "P3"]
    assert [r["transaction_id"] for r in quarantine.collect()] == ["P2"]


def test_streaming_admission_flags(spark, tmp_path):
    src = tmp_path / "events"
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, 1, t0 + dt.timedelta(seconds=10 * i)) for i in range(7)]      # 7 within 60 s
    rows.append((7, 1, t0 + dt.timedelta(seconds=130)))
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(src))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(src))
    q = (bursts_stream.admission_flags(stream).writeStream.format("memory").queryName("adm")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
         .start())
    q.awaitTermination(120)
    got = {r["event_id"]: r["accepted"] for r in spark.sql("SELECT * FROM adm").collect()}
    assert [got[i] for i in range(8)] == [True] * 5 + [False, False, True]


def test_a_replayed_epoch_replaces_itself(spark, tmp_path):
    from pyspark.sql import functions as F
    batch = spark.createDataFrame([("P1", "2026-03-05 10:00:00", "10,00", "pix"), ("P2", "bad", "1,00", "pix")],
                                  "`ID Transacao` string, `Data/Hora` string, `Valor Total` string, `Forma de Pagamento` string") \
        .select("*", F.lit(None).cast("string").alias("_corrupt"), F.lit("f").alias("_file"), F.lit(0).cast("long").alias("_block"))
    write = landing.ingest_batch(POS, str(tmp_path))
    for epoch in (0, 1, 1):
        write(batch, epoch)
    assert spark.read.parquet(str(tmp_path / "valid")).count() == 2
    assert spark.read.parquet(str(tmp_path / "quarantine")).count() == 2


def _files(spark, folder, frames):
    """One file a micro-batch, in the order given."""
    import os
    import time
    for n, df in enumerate(frames):
        tmp = f"{folder}/_{n}"
        df.coalesce(1).write.parquet(tmp)
        name = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        os.rename(f"{tmp}/{name}", f"{folder}/{n:03d}.parquet")
        os.utime(f"{folder}/{n:03d}.parquet", (time.time() + n, time.time() + n))


def test_admission_in_order_gives_the_batch_flags(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from tillrec.operators import bursts
    rnd = random.Random(3)
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, rnd.choice([1, 1, 1, 2]), t0 + dt.timedelta(milliseconds=1000 * rnd.randint(0, 1200) + rnd.choice([0, 0, 7]))) for i in range(500)]
    arrival = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rnd.randint(0, 100)))       # late by less than the watermark
    end = [(1000 + k, 9, t0 + dt.timedelta(hours=2 + k)) for k in range(2)]                       # pushes the watermark on
    (tmp_path / "in").mkdir()
    schema = "event_id long, user_id long, ts timestamp"
    parts = [arrival[i:i + 125] for i in range(0, 500, 125)] + [end[:1], end[1:]]
    _files(spark, str(tmp_path / "in"), [spark.createDataFrame(p, schema) for p in parts])
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/*.parquet")
    q = (bursts_stream.admission_in_order(stream).writeStream.format("memory").queryName("in_order")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r["event_id"]: r["accepted"] for r in spark.sql("SELECT * FROM in_order WHERE event_id < 1000").collect()}
    batch = bursts.burst_flags(spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    assert got == {r["event_id"]: r["accepted"] for r in batch.collect()} and len(got) == 500 and not all(got.values())
    # what is left waits for the last watermark: the two events at the end and their timers
    left = sum(op.numRowsTotal for op in q.lastProgress.stateOperators) if hasattr(q.lastProgress, "stateOperators") \
        else sum(op["numRowsTotal"] for op in q.lastProgress["stateOperators"])
    assert left <= 20


def test_streamed_gaps_equal_the_batch_gaps(spark, tmp_path):
    import random
    from decimal import Decimal

    from tillrec.operators import reconcile
    from tillrec.streaming import gaps_stream
    rnd = random.Random(6)
    t0 = dt.datetime(2026, 3, 1)
    day = lambda lo, hi: t0 + dt.timedelta(days=rnd.randint(lo, hi), seconds=rnd.randint(0, 86399))
    amounts = [Decimal(c) / 100 for c in (1000, 1004, 1005, 1006, 1011, 5000, 5003, 99900)]
    make = lambda p, n: [(f"{p}{i}", day(0, 9), rnd.choice(amounts), rnd.choice(["credito", "debito", "pix"])) for i in range(n)]
    sales, settled = make("P", 120), make("A", 60)
    sales += [("P900", t0, Decimal("77.00"), "credito")] * 2                      # equal rows
    s_schema = "transaction_id string, transaction_date timestamp_ntz, gross_value decimal(18,2), payment_method string"
    a_schema = "authorization_code string, settlement_date timestamp_ntz, gross_value decimal(18,2), payment_method string"
    late = lambda rows: sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=rnd.randint(0, 40)))
    end = lambda p, k: [(f"{p}END{k}", t0 + dt.timedelta(days=60 + 30 * k), Decimal("1.00"), "credito")]
    frames = {}
    for name, rows, schema, p in (("s", late(sales), s_schema, "P"), ("a", late(settled), a_schema, "A")):
        (tmp_path / name).mkdir()
        size = -(-len(rows) // 4)
        parts = [rows[i:i + size] for i in range(0, len(rows), size)] + [end(p, 0), end(p, 1)]
        _files(spark, str(tmp_path / name), [spark.createDataFrame(x, schema) for x in parts])
        frames[name] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name) + "/*.parquet")
    gaps = gaps_stream.gaps_stream(frames["s"], frames["a"])
    q = (gaps.writeStream.format("memory").queryName("gaps").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    key = lambda r: (r["gap_type"], r["transaction_id"], r["amount_brl"], r["detail"], r["gap_date"])
    got = sorted(key(r) for r in spark.sql("SELECT * FROM gaps").collect() if "END" not in r["transaction_id"])
    b_sales, b_settled = spark.createDataFrame(sales, s_schema), spark.createDataFrame(settled, a_schema)
    orders = spark.createDataFrame([], "order_id string, order_date timestamp_ntz, gross_value decimal(18,2), status string")
    want = sorted(key(r) for r in reconcile.gaps_all(b_sales, b_settled, orders).collect())
    assert got == want and len(want) > 10
