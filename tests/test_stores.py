import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tillrec.operators import alerts as A, leads as L
from tillrec.operators.ack_log import AckLog
from tillrec.operators.lead_store import LeadStore


def lead_lines(n, start=0):
    t0 = dt.datetime(2026, 1, 1)
    out = []
    for i in range(start, start + n):
        if i % 17 == 3:
            out.append('{"broken')
        elif i % 29 == 5:
            out.append("")
        else:
            at = "not a date" if i % 13 == 2 else (t0 + dt.timedelta(hours=i)).isoformat()
            out.append(json.dumps({"id": f"L{i}", "received_at": at, "name": f"n{i}"}))
    return out


@pytest.fixture
def store(spark, tmp_path):
    s = LeadStore.create(spark, str(tmp_path / "store"))
    for start, files in ((0, 5), (300, 3)):
        rows = [(i, v) for i, v in enumerate(lead_lines(300, start))]
        s.append(spark.createDataFrame(rows, "line_no long, value string"), files)
    return s


def brute(lines, lo=None, hi=None):
    out = []
    for v in lines:
        if v.startswith('{"id'):
            r = json.loads(v)
            at = None if r["received_at"] == "not a date" else dt.datetime.fromisoformat(r["received_at"])
            if at is None or ((lo is None or at >= lo) and (hi is None or at <= hi)):
                out.append(r["id"])
    return out


def test_pages_of_any_depth(spark, store):
    every = brute(lead_lines(600))
    assert store.version() == 2 and len(store.manifest().collect()) == 8
    for skip, limit in ((0, 5), (61, 40), (399, 100), (len(every) - 3, 10), (10 ** 6, 5)):
        page = store.page(skip=skip, limit=limit)
        assert [r["id"] for r in page.collect()] == every[skip:skip + limit]
        assert len(store._lines([]).inputFiles()) == 0
    lo, hi = dt.datetime(2026, 1, 5, 3), dt.datetime(2026, 1, 17)
    some = brute(lead_lines(600), lo, hi)
    for skip in (0, 7, 150, 280):
        got = [r["id"] for r in store.page(str(lo), str(hi), skip, 60).collect()]
        assert got == some[skip:skip + 60]
    assert [r["id"] for r in L.lead_page(L.parse_lines(store.lines()), None, None, skip=450, limit=20).collect()] == every[450:470]


def test_a_deep_page_reads_its_own_files(spark, store, monkeypatch):
    read = []
    plain = LeadStore._lines
    monkeypatch.setattr(LeadStore, "_lines", lambda self, files: read.append(len(files)) or plain(self, files))
    store.page(skip=400, limit=10).collect()
    assert read == [1]
    read.clear()
    store.page("2026-01-05 03:00:00", "2026-01-17 00:00:00", 100, 10).collect()
    assert read[0] == 2 and read[1] <= 2                      # the two files that the range's ends cut, then the page's


def test_erasure_rewrites_only_files_with_the_id(spark, store):
    before = {r["seq"]: r["path"] for r in store.manifest().collect()}
    store.erase(spark.createDataFrame([("L70",), ("nobody",)], "id string"))
    after = {r["seq"]: r["path"] for r in store.manifest().collect()}
    assert [s for s in before if before[s] != after[s]] == [1] and before.keys() == after.keys()
    want = [i for i in brute(lead_lines(600)) if i != "L70"]
    got = store.page(limit=1000)
    assert [r["id"] for r in got.collect()] == want
    # malformed lines stay; a reader of the old version still sees all of it
    assert store.lines().where("value = '{\"broken'").count() == sum(v == '{"broken' for v in lead_lines(600))
    assert [r["id"] for r in store.page(version=2, limit=1000).collect()] == brute(lead_lines(600))
    assert store.vacuum_list().count() == 1 and store.vacuum_list(2).count() == 0
    with pytest.raises(KeyError):
        store.erase(spark.createDataFrame([("L70",)], "id string"))
    assert store.version() == 3


def test_a_version_that_was_not_written_whole_is_not_seen(spark, store, tmp_path):
    (tmp_path / "store" / "manifest" / "v=9").mkdir()
    assert store.version() == 2


def test_deep_skip_equals_a_full_sort(spark):
    rnd = random.Random(2)
    rows = [(i, v) for i, v in enumerate(lead_lines(3000))]
    rnd.shuffle(rows)
    parsed = L.parse_lines(spark.createDataFrame(rows, "line_no long, value string"))
    every = brute(lead_lines(3000))
    for skip in (1000, 1001, 2500, len(every) - 1, 10 ** 6):
        assert [r["id"] for r in L.lead_page(parsed, None, None, skip, 30).collect()] == every[skip:skip + 30]


def test_ack_state_after_compaction_equals_the_whole_log(spark, tmp_path):
    log = AckLog(spark, str(tmp_path / "acks"))
    assert log.state().collect() == [] and log.compact() == -1
    rnd = random.Random(4)
    t0 = dt.datetime(2026, 1, 1)
    every = []
    alerts = spark.createDataFrame([(f"a{k}",) for k in range(30)], "alert_id string")
    for batch in range(6):
        acks = [(f"a{rnd.randrange(25)}", t0 + dt.timedelta(minutes=rnd.randrange(1000))) for _ in range(20)]
        every += acks
        df = spark.createDataFrame(acks, "alert_id string, ack_at timestamp_ntz")
        log.append(df, batch)
        log.append(df, batch)                                 # a repeated batch replaces itself
        if batch in (1, 3):
            assert log.compact() == batch
        full = spark.createDataFrame(every, "alert_id string, ack_at timestamp_ntz")
        assert sorted(A.alert_state(alerts, log.state()).collect()) == sorted(A.alert_state(alerts, full).collect())
        assert sorted(A.alerts_open(alerts, log.state()).collect()) == sorted(A.alerts_open(alerts, full).collect())
    assert len(log._numbers("log")) == 6 and log._rows().inputFiles() and all("batch=0" not in f for f in log._rows().inputFiles())
    with pytest.raises(ValueError):
        log.append(full, 3)
    (tmp_path / "acks" / "snapshot" / "upto=99").mkdir()      # a compaction that broke off
    assert log.snapshot() == 3
