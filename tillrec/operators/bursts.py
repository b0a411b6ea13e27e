"""Sliding-window burst counts per key (re-aimed request admission windows).

``burst_counts``: for each event, the number of events of the same key in
``[ts - window, ts]`` (an event exactly ``window`` old still counts; events
at the same instant all count). A flag marks events above the limit.

Skew: a window partitioned by key alone puts a hot key (say a third of all
events) into one task. We partition by ``(key, bucket)`` with buckets of the
window length instead: an event's window touches only its own bucket and
the previous one, so each event is emitted twice — once as "self" in its
bucket, once as "prev" in the next bucket — and every window partition
holds at most two bucket-lengths of one key's events.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = "1970-01-01 00:00:00"


def _micros(ts_col: str) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col(ts_col).cast("timestamp_ntz"))


def burst_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
                 window_seconds: int = 60, limit: int = 5) -> DataFrame:
    width = window_seconds * 1_000_000
    base = events.select(F.col(id_col), F.col(key), F.col(ts), _micros(ts).alias("_us")) \
                 .withColumn("_own", F.floor(F.col("_us") / width).cast("bigint"))
    # one scan; each event as itself in its bucket and as an earlier one in the next
    rows = base.withColumn("_b", F.explode(F.array("_own", F.col("_own") + 1))) \
               .withColumn("_self", (F.col("_b") == F.col("_own")).cast("int")) \
               .withColumn("_prev", 1 - F.col("_self"))
    part = Window.partitionBy(key, "_b")
    ordered = part.orderBy("_us")
    self_upto = F.sum("_self").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    prev_all = F.sum("_prev").over(part)
    prev_before = F.coalesce(F.sum("_prev").over(ordered.rangeBetween(Window.unboundedPreceding, -width - 1)),
                             F.lit(0))
    counted = rows.select(id_col, key, ts, "_self",
                          (self_upto + prev_all - prev_before).alias("n_in_window"))
    return counted.where(F.col("_self") == 1).select(
        id_col, key, ts, F.col("n_in_window").cast("bigint").alias("n_in_window"),
        (F.col("n_in_window") > limit).alias("over_limit"))


class Admission:
    """Folds events of sorted keys: an event is accepted if fewer than ``limit`` accepted ones of its key lie
    in the window before it.

    An event with fewer than ``limit`` events of its key in the window is accepted whatever came before,
    so these are flagged at once; only the crowded ones are stepped through, from one accepted event to the next
    (a full window rejects all up to the time when its oldest one leaves). What is kept between calls: the
    last key, its newest accepted times in the window and its last ``limit`` event times.
    """

    def __init__(self, limit: int, width: int, key=None, accepted: tuple[int, ...] = ()):
        self.limit, self.width, self.key = limit, width, key
        self.accepted = list(accepted)
        self.recent = np.empty(0, np.int64)

    def feed(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Flags of the next events."""
        if not len(times):
            return np.empty(0, bool)
        goes_on = self.key is not None and keys[0] == self.key
        before = self.accepted if goes_on else []
        p = len(self.recent) if goes_on else 0          # rows from here on are new
        k = np.concatenate([np.repeat(keys[:1], p), keys])
        t = np.concatenate([self.recent[len(self.recent) - p:], times])
        n, limit, width = len(t), self.limit, self.width
        crowded = np.zeros(n, bool)
        crowded[limit:] = (k[limit:] == k[:-limit]) & (t[limit:] - t[:-limit] <= width)
        if before:                                      # the events before a seed aren't known
            crowded[:limit] = k[:limit] == k[0]
        crowded[:p] = False
        ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, n)
        ok = np.ones(n, bool)

        def held_at(j: int) -> list[int]:
            """The newest accepted times before row j, whose row before isn't crowded: few rows are looked at."""
            found, at = [], j - 1
            while at >= p and len(found) < limit and k[at] == k[j] and t[at] >= t[j] - width:
                if ok[at]:
                    found.append(int(t[at]))
                at -= 1
            found.reverse()
            return (before + found)[-limit:] if at < p and k[j] == k[0] else found

        todo = np.flatnonzero(crowded)
        i, at = -1, 0
        while at < len(todo):
            i = int(todo[at])
            held, end = held_at(i), int(ends[np.searchsorted(ends, i, side="right")])
            while i < end and crowded[i]:
                while held and held[0] < t[i] - width:  # exactly `window` old still counts
                    held.pop(0)
                if len(held) < limit:
                    held.append(int(t[i]))
                    i += 1
                else:
                    free = i + int(np.searchsorted(t[i:end], held[0] + width, side="right"))
                    ok[i:free] = False
                    i = free
            at += int(np.searchsorted(todo[at:], i))
        self._keep(k, t, ok, p, before, int(ends[-2]) if len(ends) > 1 else 0)
        return ok[p:]

    def _keep(self, k: np.ndarray, t: np.ndarray, ok: np.ndarray, p: int, before: list[int], start: int) -> None:
        """The state after the last row; its key's rows begin at ``start``."""
        least = t[-1] - self.width
        new = max(start, p, int(np.searchsorted(t[start:], least)) + start)
        mine = t[new:][ok[new:]][-self.limit:].tolist()
        carried = [x for x in before if x >= least] if start == 0 else []
        self.accepted = (carried + mine)[-self.limit:]
        self.key, self.recent = k[-1], t[max(start, len(t) - self.limit):].copy()


@dataclass(frozen=True)
class Link:
    """What a task knows of a partition: whether its first rows go on from the partition before (same key, no
    gap longer than the window), the accepted times left there, and what the pass before took them for."""
    linked: bool
    seed: tuple[int, ...] = ()
    taken: tuple[int, ...] | None = None
    tail: tuple[int, ...] | None = None


def _fold(links: dict[int, Link], leads: bool, serial: bool, limit: int, width: int, key: str, id_col: str):
    """mapInPandas body over sorted rows of partitions, one after the other.

    A partition's *lead* are its rows up to the first change of key or gap longer than the window; the
    state is empty after it whatever came before. Without ``leads``, all rows are folded, but the
    leads of linked partitions (from an empty state) give no flags. With ``leads`` only those of linked
    partitions are folded, from their seeds; if ``serial``, from the state that the partition before was left
    in, unless the pass before took just that for it. Emits flags, and for each partition folded one tail row: the accepted
    times at its end, and whether all of it is lead.
    """
    def run(batches):
        state, pid, link, in_lead, last, skip = None, None, None, True, None, False
        carried: tuple[int, ...] | None = None

        def tail() -> pd.DataFrame:
            return pd.DataFrame({id_col: [None], key: [None], "_us": [None], "accepted": [None], "_pid": [pid],
                                 "_tail": [[int(x) for x in state.accepted]], "_all_lead": [in_lead]})

        for pdf in batches:
            edges = np.flatnonzero(np.diff(pdf["_pid"].to_numpy())) + 1 if len(pdf) else []
            for part in np.split(np.arange(len(pdf)), edges):
                if not len(part):
                    continue
                rows = pdf.iloc[part]
                keys, times = rows[key].to_numpy(), rows["_us"].to_numpy()
                if int(rows["_pid"].iat[0]) != pid:
                    if pid is not None:
                        carried = link.tail if skip else tuple(state.accepted) if in_lead else None
                        if not skip:
                            yield tail()
                    pid = int(rows["_pid"].iat[0])
                    link, in_lead, last = links[pid], True, None
                    seed = carried if serial and carried is not None else link.seed
                    skip = serial and carried is not None and link.taken == carried
                    state = Admission(limit, width, keys[0], seed if link.linked and leads else ())
                if skip or (leads and not in_lead):
                    continue
                new = np.append(last is None or keys[0] != last[0] or times[0] - last[1] > width,
                                (keys[1:] != keys[:-1]) | (np.diff(times) > width))
                new[0] &= last is not None
                cut = int(np.argmax(new)) if in_lead and new.any() else len(rows) if in_lead else 0
                last = keys[-1], times[-1]
                if leads:
                    keys, times, rows = keys[:cut], times[:cut], rows.iloc[:cut]
                flags = state.feed(keys, times)
                shown = slice(0, None) if leads or not link.linked else slice(cut, None)
                in_lead = in_lead and not new.any()
                yield pd.DataFrame({id_col: rows[id_col].to_numpy()[shown], key: keys[shown], "_us": times[shown], "accepted": flags[shown],
                                    "_pid": pid, "_tail": None, "_all_lead": None})
        if pid is not None and not skip:
            yield tail()

    return run


def burst_flags(events: DataFrame, key: str = "user_id", ts: str = "ts", id_col: str = "event_id",
                window_seconds: int = 60, limit: int = 5, partitions: int | None = None) -> DataFrame:
    """Exact admission flags: an event is accepted when fewer than ``limit`` accepted events of
    its key lie in ``[ts - window, ts]``; rejected events do not count later.

    The fold is sequential per key by definition, but its state is small (at most ``limit`` times) and
    empty after a gap longer than the window. Three jobs fold everything, however many partitions a
    dense key spans:

    0. events are range-partitioned by (key, time, id) into equal-sized partitions and stored by partition number;
       all partitions are folded, the leading rows of those that go on from the one before as if
       nothing had come before them;
    1. those leading rows are folded again from the state that the partition before was left in;
    2. where that state was itself wrong (a partition of one key, left otherwise once its own start was
       known), the leading rows from there on are folded one partition after the other, in one task for each such chain,
       up to the partition that had been given the right state.

    States differ for long only if a key's window stays full over whole partitions; then step 2 reads them in
    order, in jumps from one accepted event to the next. Only two rows per partition reach the driver (its ends, and at
    most ``limit`` times). Flags are written to one folder below ``spark.checkpoint.dir``.
    """
    from tillrec.session import ensure_checkpoint_dir

    spark = events.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/bursts-{uuid.uuid4().hex}"
    width = window_seconds * 1_000_000
    n = partitions or max(spark.sparkContext.defaultParallelism,
                          int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = events.select(F.col(id_col), F.col(key), _micros(ts).alias("_us"))
    key_type = dict(base.dtypes)[key]
    (base.repartitionByRange(n, key, "_us", id_col).sortWithinPartitions(key, "_us", id_col)
         .withColumn("_pid", F.spark_partition_id()).write.partitionBy("_pid").parquet(f"{root}/staged"))
    staged = spark.read.schema(f"{id_col} long, {key} {key_type}, _us long, _pid int").parquet(f"{root}/staged")
    ends = staged.groupBy("_pid").agg(F.min(F.struct(key, "_us")).alias("lo"), F.max(F.struct(key, "_us")).alias("hi")) \
        .orderBy("_pid").collect()                                       # one row per partition
    order = [r["_pid"] for r in ends]
    linked = {b["_pid"] for a, b in zip(ends, ends[1:]) if a["hi"][key] == b["lo"][key] and b["lo"]["_us"] - a["hi"]["_us"] <= width}
    before = dict(zip(order[1:], order))
    schema = f"{id_col} long, {key} {key_type}, _us long, accepted boolean, _pid int, _tail array<long>, _all_lead boolean"

    def fold(step: int, links: dict[int, Link], group: dict[int, int] | None = None) -> dict[int, tuple[tuple[int, ...], bool]]:
        """Fold partitions, those of a group in one task; (accepted times at the end, all lead) of each."""
        rows = staged if step == 0 else staged.where(F.col("_pid").isin(list(links)))
        by = F.col("_pid") if group is None else F.element_at(F.create_map(*[F.lit(x) for kv in group.items() for x in kv]), F.col("_pid"))
        spread = rows.repartition(max(1, min(len(links), n)), by).sortWithinPartitions("_pid", key, "_us", id_col)
        spread.mapInPandas(_fold(links, step > 0, step == 2, limit, width, key, id_col), schema).write.parquet(f"{root}/pass={step}")
        tails = spark.read.schema(schema).parquet(f"{root}/pass={step}").where("_tail IS NOT NULL").collect()
        return {r["_pid"]: (tuple(r["_tail"]), r["_all_lead"]) for r in tails}

    if not order:
        return spark.createDataFrame([], f"{id_col} long, {key} {key_type}, {ts} timestamp_ntz, accepted boolean")
    first = fold(0, {p: Link(p in linked) for p in order})
    second = fold(1, {p: Link(True, first[before[p]][0]) for p in order if p in linked}) if linked else {}
    # chains of partitions whose first state was wrong: from the first one after a partition that ended otherwise than taken
    final: dict[int, tuple[int, ...] | None] = {}
    redo: dict[int, Link] = {}
    chains: dict[int, int] = {}
    for p in order:
        if p not in linked or not first[p][1]:
            final[p] = first[p][0]                     # the state is empty somewhere inside: known from the first pass
        elif final[before[p]] == first[before[p]][0]:
            final[p] = second[p][0]
        else:
            final[p] = None                            # known when the chain is folded
        if p in linked and final[before[p]] != first[before[p]][0]:
            chains[p] = chains.get(before[p], p)
            redo[p] = Link(True, final[before[p]] or (), first[before[p]][0], second[p][0])
    redone = fold(2, redo, chains) if redo else {}
    flags = spark.read.schema(schema).parquet(f"{root}/pass=0")
    if linked:
        flags = flags.unionByName(spark.read.schema(schema).parquet(f"{root}/pass=1").where(~F.col("_pid").isin(list(redone))))
    if redo:
        flags = flags.unionByName(spark.read.schema(schema).parquet(f"{root}/pass=2"))
    back = F.timestamp_add("MICROSECOND", F.col("_us"), F.lit(EPOCH).cast("timestamp_ntz"))
    return flags.where("accepted IS NOT NULL").select(id_col, key, back.alias(ts), "accepted")
