import datetime as dt
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tillrec.operators import bursts, leads as L


def lines(spark, docs):
    rows = [(i, d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)]
    return L.parse_lines(spark.createDataFrame(rows, "line_no long, value string"))


GOOD = {"id": "LEAD-1", "received_at": "2026-01-10T10:00:00", "name": "<b>Ana</b>", "restaurant": "Casa",
        "revenue": "50k-100k", "systems": ["ifood", "fax"], "phone": "(31) 99999-0000", "email": None,
        "source": " WhatsApp ", "lgpd_consent": True}


def test_lead_rules(spark):
    docs = [GOOD,
            {**GOOD, "id": "LEAD-2", "phone": "123456789"},          # 9 digits
            {**GOOD, "id": "LEAD-3", "phone": "3199990000"},         # 10 digits ok
            {**GOOD, "id": "LEAD-4", "phone": "319999000011"},       # 12 digits
            {**GOOD, "id": "LEAD-5", "systems": ["fax"]},
            {**GOOD, "id": "LEAD-6", "lgpd_consent": False},
            "{broken", ""]
    p = lines(spark, docs)
    v = {r["id"]: r for r in L.lead_validate(p).collect()}
    assert v["LEAD-1"]["is_valid"] and v["LEAD-1"]["name"] == "Ana" and v["LEAD-1"]["systems"] == "ifood"
    assert v["LEAD-1"]["source"] == "whatsapp"
    assert not v["LEAD-2"]["is_valid"] and v["LEAD-3"]["is_valid"] and not v["LEAD-4"]["is_valid"]
    assert v["LEAD-5"]["failed_checks"] == "systems" and v["LEAD-6"]["failed_checks"] == "lgpd_consent"
    assert L.lead_count(p).collect()[0]["lead_count"] == 7      # malformed counted, blank not


def test_lead_page_erase_idempotent(spark):
    docs = [{**GOOD, "id": f"LEAD-{i}", "received_at": f"2026-01-{i + 1:02d}T00:00:00"} for i in range(9)]
    docs.append({**GOOD, "id": "LEAD-X", "received_at": "garbage"})
    docs.append("{broken")
    p = lines(spark, docs)
    page = [r["id"] for r in L.lead_page(p, "2026-01-03 00:00:00", "2026-01-05 00:00:00", 1, 2).collect()]
    assert page == ["LEAD-3", "LEAD-4"]                           # inclusive range, skip 1
    page_all = [r["id"] for r in L.lead_page(p, "2026-01-03 00:00:00", None, 0, 1000).collect()]
    assert "LEAD-X" in page_all                                   # unparseable date kept
    erase = spark.createDataFrame([("LEAD-1",)], "id string")
    once = L.lead_erase(p, erase)
    twice = L.lead_erase(once.withColumn("blank", F.lit(False)).withColumn(
        "lead", F.when(F.col("id").isNotNull(), F.struct(F.col("id").alias("id")))), erase)
    assert once.count() == 10 and twice.count() == 10
    assert L.lead_lookup(p, "LEAD-2").collect()[0]["line_no"] == 2


def test_burst_counts_edges_and_brute_force(spark):
    t0 = dt.datetime(2026, 1, 1, 0, 0, 30)
    ev = [(i, t0 + dt.timedelta(seconds=12 * i), 1) for i in range(5)]
    ev.append((5, t0 + dt.timedelta(seconds=60), 1))                       # exactly 60 s after the first
    ev.append((6, t0 + dt.timedelta(seconds=120, microseconds=1000), 1))    # 60.001 s after event 5
    rnd = random.Random(3)
    base = dt.datetime(2026, 1, 1)
    ev += [(100 + i, base + dt.timedelta(seconds=rnd.randint(0, 600), microseconds=rnd.randint(0, 999999)),
            rnd.randint(2, 4)) for i in range(300)]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long")
    got = {r["event_id"]: r["n_in_window"] for r in bursts.burst_counts(df).collect()}
    for eid, ts, uid in ev:
        expect = sum(1 for _, t2, u2 in ev if u2 == uid and ts - dt.timedelta(seconds=60) <= t2 <= ts)
        assert got[eid] == expect, eid
    assert got[5] == 6 and got[6] == 1


def _brute_flags(ev, limit=5, window=60):
    out = {}
    by_key = {}
    for eid, ts, uid in sorted(ev, key=lambda e: (e[2], e[1], e[0])):
        acc = by_key.setdefault(uid, [])
        acc[:] = [t for t in acc if t >= ts - dt.timedelta(seconds=window)]
        if len(acc) >= limit:
            out[eid] = False
        else:
            acc.append(ts)
            out[eid] = True
    return out


def test_burst_flags_exact(spark):
    t0 = dt.datetime(2026, 1, 1, 0, 0, 0)
    # five in the first 48 s, a sixth at exactly 60 s (rejected: the first is still in the window),
    # a seventh at 60.001 s after the first (accepted: the first has left), rejected ones never count
    ev = [(i, t0 + dt.timedelta(seconds=12 * i), 1) for i in range(5)]
    ev.append((5, t0 + dt.timedelta(seconds=60), 1))
    ev.append((6, t0 + dt.timedelta(seconds=60, milliseconds=1), 1))
    rnd = random.Random(11)
    ev += [(100 + i, t0 + dt.timedelta(seconds=rnd.randint(0, 300)), rnd.randint(2, 5)) for i in range(400)]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long")
    out = bursts.burst_flags(df).collect()
    got = {r["event_id"]: r["accepted"] for r in out}
    assert {(r["event_id"], r["ts"], r["user_id"]) for r in out} == set(ev)
    assert got[5] is False and got[6] is True
    assert got == _brute_flags(ev)


def test_burst_flags_hot_key_across_partitions(spark):
    # one key with most of the events, dense enough that it spans every range partition and
    # the carried state decides acceptances right after each boundary
    t0 = dt.datetime(2026, 1, 1)
    rnd = random.Random(5)
    ev = [(i, t0 + dt.timedelta(seconds=rnd.randint(0, 900)), 7) for i in range(1500)]
    ev += [(5000 + i, t0 + dt.timedelta(seconds=rnd.randint(0, 900)), rnd.randint(1, 3)) for i in range(300)]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long")
    got = {r["event_id"]: r["accepted"] for r in bursts.burst_flags(df, partitions=12).collect()}
    assert got == _brute_flags(ev)


def _counted(monkeypatch):
    """The folds of burst_flags: (rows folded by them, jobs)."""
    seen = []
    plain = bursts._fold

    def fold(links, leads, serial, *rest):
        seen.append((len(links), leads, serial))
        return plain(links, leads, serial, *rest)

    monkeypatch.setattr(bursts, "_fold", fold)
    return seen


@pytest.mark.parametrize("step", [1, 13])
def test_a_dense_key_takes_three_folds_whatever_the_partitions(spark, monkeypatch, step):
    """One key over all partitions, its window always full (1) or never quite (13)."""
    t0 = dt.datetime(2026, 1, 1)
    ev = [(i, t0 + dt.timedelta(seconds=step * i), 1) for i in range(800)]
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long")
    for n in (4, 64):
        seen = _counted(monkeypatch)
        out = bursts.burst_flags(df, partitions=n)
        assert len(seen) <= 3 and seen[0][0] <= n
        assert out.count() == 800                      # a row of two passes would be there twice
        assert {r["event_id"]: r["accepted"] for r in out.collect()} == _brute_flags(ev)
        monkeypatch.undo()
    assert bursts.burst_flags(df.limit(0)).collect() == []


def test_right_states_stop_the_third_fold(spark, monkeypatch):
    # bursts with quiet times between them: the state of a partition's end doesn't depend on its start
    t0 = dt.datetime(2026, 1, 1)
    ev = [(i, t0 + dt.timedelta(seconds=200 * (i // 40) + i % 40), 1) for i in range(800)]
    seen = _counted(monkeypatch)
    df = spark.createDataFrame(ev, "event_id long, ts timestamp_ntz, user_id long")
    got = {r["event_id"]: r["accepted"] for r in bursts.burst_flags(df, partitions=16).collect()}
    assert got == _brute_flags(ev) and [x[1:] for x in seen] == [(False, False), (True, False)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 6), st.integers(1, 40))
def test_admission_in_batches_equals_brute_force(seed, limit, batch):
    rnd = random.Random(seed)
    rows = sorted((rnd.randint(1, 3), rnd.randint(0, rnd.choice([60, 400]))) for _ in range(120))
    keys, times = np.array([k for k, _ in rows]), np.array([t for _, t in rows])
    want, acc = [], {}
    for k, t in rows:
        live = [a for a in acc.get(k, []) if a >= t - 20]
        want.append(len(live) < limit)
        acc[k] = live + [t] * want[-1]
    a = bursts.Admission(limit, 20)
    got = np.concatenate([a.feed(keys[i:i + batch], times[i:i + batch]) for i in range(0, len(rows), batch)])
    assert got.tolist() == want
    # from a seed: the rest of the first key's events
    cut = rnd.randint(1, 119)
    a = bursts.Admission(limit, 20)
    a.feed(keys[:cut], times[:cut])
    b = bursts.Admission(limit, 20, a.key, tuple(a.accepted))
    assert np.concatenate([b.feed(keys[i:i + batch], times[i:i + batch]) for i in range(cut, len(rows), batch)]).tolist() == want[cut:]


def test_lead_times_lines_without_id_and_paging(spark):
    forms = {"a": "2026-01-10T10:00:00+00:00", "b": "2026-01-10T07:00:00-03:00", "c": "2026-01-10T10:00:00.000Z",
             "d": "2026-01-10T10:00:00", "e": "2026-01-10 10:00", "f": "2020-01-10T10:00:00+00:00", "g": "bad"}
    docs = [{**GOOD, "id": k, "received_at": v} for k, v in forms.items()]
    docs += [{k: v for k, v in GOOD.items() if k != "id"}, "[1]", "{broken", '"text"']
    p = lines(spark, docs)
    ts = {r["lead"]["id"]: r["received_ts"] for r in L.received_ts(p).where("lead IS NOT NULL").collect()}
    assert all(ts[k] == dt.datetime(2026, 1, 10, 10) for k in "abcde") and ts["g"] is None
    page = L.lead_page(p, "2026-01-01 00:00:00", None).collect()
    assert [r["id"] for r in page] == ["a", "b", "c", "d", "e", "g", None]     # 2020 is out, no id is in
    first = L.lead_page(p, None, None, limit=3).collect()
    assert [r["id"] for r in L.lead_page(p, None, None, limit=3, after=first[-1]["line_no"]).collect()] == ["d", "e", "f"]


def test_pandas_functions_work_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {root!r})\n"
            "from tillrec.session import build_session\nfrom tillrec.operators import bursts\n"
            "s = build_session('local[2]', 2)\n"
            "e = s.sql(\"SELECT id AS event_id, id % 2 AS user_id, timestamp_ntz'2026-01-01 00:00:00' AS ts FROM range(20)\")\n"
            "print('rows', bursts.burst_flags(e).count())\n")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 20" in done.stdout, done.stderr[-2000:]


def test_no_checkpoint_folder_on_a_cluster_is_an_error():
    import pytest
    from tillrec import session

    class Context:
        master = "spark://h:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: None)

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_gap_plans_read_no_fee_columns(spark):
    import __spark_entry__ as E
    for name in ("gaps_pos_missing", "gaps_acquirer_missing"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "l_discount" not in plan and "InMemoryTableScan" not in plan, name


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() == 1
    assert set(E.oracle_sql()) <= set(E.queries())


def test_append_and_read_lead_store(spark, tmp_path):
    store = str(tmp_path / "leads")
    recs = spark.createDataFrame([("LEAD-1", "Ana"), ("LEAD-2", "Bia")], "id string, name string")
    L.append_leads(recs, store)
    L.append_leads(recs.limit(1), store)
    p = L.parse_lines(L.read_lead_lines(spark, store))
    assert L.lead_count(p).collect()[0]["lead_count"] == 3


def test_alert_fanout_outbox(spark, tmp_path):
    from tillrec.operators import alerts as A
    from tillrec.sinks.writers import append_outbox
    gaps = spark.createDataFrame(
        [("T1", "PDV", 6000.0, "PDV_MISSING_IN_ACQUIRER", "d1", dt.datetime(2026, 3, 5), 1),
         ("T2", "iFood", 50.0, "IFOOD_ORDER_CANCELLED", "d2", dt.datetime(2026, 3, 6), 3)],
        "transaction_id string, source string, amount_brl double, gap_type string, detail string, "
        "gap_date timestamp_ntz, gap_order int")
    subs = spark.createDataFrame(
        [("S1", "slack", "https://h/1", "low", True), ("S2", "email", "https://h/2", "critical", True),
         ("S3", "telegram", "https://h/3", "medium", False)],
        "id string, channel string, webhook_url string, severity_filter string, active boolean")
    al = A.alerts_from_gaps(gaps)
    sev = {r["transaction_id"]: r["severity"] for r in al.collect()}
    assert sev == {"T1": "critical", "T2": "low"}
    routed = A.alert_routing(al, subs)
    pairs = {(r["alert_id"].rsplit(":", 1)[0], r["subscriber_id"]) for r in routed.collect()}
    assert pairs == {("PDV_MISSING_IN_ACQUIRER:T1", "S1"), ("PDV_MISSING_IN_ACQUIRER:T1", "S2"),
                     ("IFOOD_ORDER_CANCELLED:T2", "S1")}
    for _ in range(2):                              # a replayed batch replaces itself
        append_outbox(A.delivery_outbox(al, subs), str(tmp_path / "outbox"), "epoch-1")
    append_outbox(A.delivery_outbox(al, subs), str(tmp_path / "outbox"), "epoch-2")
    assert spark.read.parquet(str(tmp_path / "outbox")).count() == 6
    # two gaps of one transaction: two alerts, one acknowledgement closes one
    two = gaps.unionByName(gaps.where("transaction_id = 'T1'").withColumn("amount_brl", F.lit(7.0))
                           .withColumn("detail", F.lit(None).cast("string")))
    al2 = A.alerts_from_gaps(two, "2026-04")
    ids = [r["alert_id"] for r in al2.where("transaction_id = 'T1'").collect()]
    assert len(set(ids)) == 2 and A.delivery_outbox(al2, subs).count() == 4
    acks = spark.createDataFrame([(ids[0], dt.datetime(2026, 3, 7))], "alert_id string, ack_at timestamp")
    assert A.alerts_open(al2, acks).count() == 2
    assert {r["reference_month"] for r in al2.collect()} == {"2026-04"}
    assert al2.where("amount_brl = 7").collect()[0]["message"] == A.DEFAULT_MESSAGE


def test_erase_to_new_version(spark, tmp_path):
    import pytest
    store = str(tmp_path / "leads_v1")
    recs = spark.createDataFrame([("LEAD-1", "Ana"), ("LEAD-2", "Bia"), ("LEAD-1", "Ana again")],
                                 "id string, name string")
    L.append_leads(recs, store)
    ids = spark.createDataFrame([("LEAD-1",)], "id string")
    with pytest.raises(ValueError):
        L.erase_to_new_version(spark, store, ids, store)
    with pytest.raises(KeyError):
        L.erase_to_new_version(spark, store, spark.createDataFrame([("LEAD-9",)], "id string"), str(tmp_path / "x"))
    out = L.erase_to_new_version(spark, store, ids, str(tmp_path / "leads_v2"))
    kept = L.parse_lines(L.read_lead_lines(spark, out)).select("lead.id").collect()
    assert [r["id"] for r in kept] == ["LEAD-2"]


def test_flagship_plans_have_no_pair_joins(spark):
    import __spark_entry__ as E
    for name in ("income_statement", "gaps_all", "alert_routing", "dashboard_totals",
                 "gaps_amount_mismatch_documented", "gaps_all_documented"):
        df = E.queries()[name](spark, "/root/testdata/sf0.001")
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
