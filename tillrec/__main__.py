"""Command line: ``run`` (one monthly run), ``dashboard`` and ``period`` (KPIs), ``gaps`` (drill-down)."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys


def _run(ns: argparse.Namespace) -> None:
    from tillrec.config import JobArgs, Rates
    from tillrec.plans.month_job import run_month
    from tillrec.session import build_session

    spark = build_session()
    rates = Rates.from_env()                       # TILLREC_* variables; the option wins
    if ns.fee_fallback:
        rates = dataclasses.replace(rates, fee_fallback=ns.fee_fallback)
    args = JobArgs(ns.marketplace, ns.pos, ns.acquirer, ns.month, ns.acquirer_name, rates)
    subscribers = spark.read.json(ns.subscribers) if ns.subscribers else None
    out, paths = run_month(spark, args, ns.out, filter_month=ns.filter_month, legacy_nan=ns.legacy_nan,
                           gap_mode=ns.gap_mode, subscribers=subscribers)
    row = out.summary.collect()[0].asDict()   # one summary row
    row["outputs"] = paths
    print(json.dumps(row, default=str))


def _metrics(ns: argparse.Namespace):
    from tillrec.operators import history as H
    from tillrec.session import build_session
    from tillrec.sources.artefacts import read_artefacts

    spark = build_session()
    return spark, H.period_metrics(read_artefacts(spark, ns.artefacts, multi_line=not ns.json_lines))


def _dashboard(ns: argparse.Namespace) -> None:
    from tillrec.operators import alerts as A, history as H

    spark, metrics = _metrics(ns)
    opened = spark.range(0)
    if ns.alerts:
        alerts = spark.read.parquet(ns.alerts)
        acks = spark.read.schema("alert_id string, ack_at timestamp").json(ns.acks) if ns.acks \
            else spark.createDataFrame([], "alert_id string, ack_at timestamp")
        opened = A.alerts_open(alerts, acks)
    latest = [r.asDict() for r in H.latest_period(metrics).collect()]          # one row
    trend = [r.asDict() for r in H.trend_last_n(metrics, ns.trend, ns.latest_run_only).collect()]  # at most 24 rows
    totals = H.dashboard_totals(metrics, opened, ns.latest_run_only).collect()[0].asDict()
    print(json.dumps({"latest_period": latest[0] if latest else None, "trend": trend, **totals}, default=str))


def _period(ns: argparse.Namespace) -> None:
    from tillrec.operators import history as H

    rows = H.period_lookup(_metrics(ns)[1], ns.month).collect()                # one row
    print(json.dumps(rows[0].asDict() if rows else None, default=str))


def _gaps(ns: argparse.Namespace) -> None:
    from tillrec.operators import history as H
    from tillrec.session import build_session
    from tillrec.sources import artefacts

    spark = build_session()
    gaps = artefacts.read_run_gaps(spark, ns.gaps) if ns.gaps \
        else artefacts.artefact_gaps(artefacts.read_artefacts(spark, ns.artefacts))
    found = H.stored_gaps(gaps, ns.month, ns.min_amount, ns.run)
    if ns.out:
        found.write.mode("overwrite").option("header", True).csv(ns.out)
        return
    for r in found.limit(ns.top).collect():                                    # a top-n report
        print(json.dumps(r.asDict(), default=str, ensure_ascii=False))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tillrec")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("run", help="one monthly run from three export files")
    r.add_argument("--marketplace", required=True)
    r.add_argument("--pos", required=True)
    r.add_argument("--acquirer", required=True)
    r.add_argument("--month", required=True)
    r.add_argument("--acquirer-name", default="stone")
    r.add_argument("--out", required=True)
    r.add_argument("--fee-fallback", choices=["by_method", "credit_only"])
    r.add_argument("--gap-mode", default="as_executed", choices=["as_executed", "documented"],
                   help="documented also pairs unmatched sales and settlements as amount mismatches")
    r.add_argument("--subscribers", help="JSON lines of alert subscribers; writes the delivery outbox")
    r.add_argument("--filter-month", action="store_true")
    r.add_argument("--legacy-nan", action="store_true", help="blank numbers pass, blank optional text fails")
    r.set_defaults(fn=_run)
    d = sub.add_parser("dashboard", help="KPIs over past statement artefacts")
    d.add_argument("--trend", type=int, default=6)
    d.add_argument("--latest-run-only", action="store_true", help="count only the newest run of each month")
    d.add_argument("--alerts", help="alerts of past runs (their alerts folder)")
    d.add_argument("--acks", help="JSON lines of acknowledgements (alert_id, ack_at)")
    d.set_defaults(fn=_dashboard)
    m = sub.add_parser("period", help="KPIs of one month (its oldest run)")
    m.add_argument("--month", required=True)
    m.set_defaults(fn=_period)
    for q in (d, m):
        q.add_argument("--artefacts", required=True, help="glob of statement JSON files")
        q.add_argument("--json-lines", action="store_true", help="artefacts are JSON lines (our writer)")
    g = sub.add_parser("gaps", help="gaps of one month over stored runs (the month's first run, as in period)")
    where = g.add_mutually_exclusive_group(required=True)
    where.add_argument("--gaps", help="gaps folder of past runs")
    where.add_argument("--artefacts", help="glob of single-document artefacts")
    g.add_argument("--month", required=True)
    g.add_argument("--run", help="stamp of another run of the month")
    g.add_argument("--min-amount", type=float, default=0.0)
    g.add_argument("--top", type=int, default=100)
    g.add_argument("--out", help="write all of them as CSV instead")
    g.set_defaults(fn=_gaps)
    ns = p.parse_args(argv)
    ns.fn(ns)


if __name__ == "__main__":
    main(sys.argv[1:])
