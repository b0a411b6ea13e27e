import math

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from tillrec.llm import negatives as N

SCHEMA = "vec_id long, label int, embedding array<float>, rank int, score long, v int, code string, row_id int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, 9, "c", 1) for r in rows], SCHEMA)


def brute(rows, step=100, scale=256):
    solid = set()
    for i, c, x in rows:
        if i is None or c is None or x is None or any(e is None or not math.isfinite(e) for e in x):
            continue
        v = tuple(math.floor(scale * float(np.float32(e))) for e in x)
        solid.add((i, int(math.fmod(c + 1, 10)) if i % 7 == 0 else c, v))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, c, v in solid:
        if i % step:
            continue
        others = sorted((-dot(v, w), j, k) for j, k, w in solid if j != i and len(w) == len(v))
        for s, j, _ in [o for o in others if o[2] == c][:5]:
            fit = [o for o in others if o[2] != c and 30 * -s <= 100 * -o[0] <= 90 * -s][:10]
            clamp = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
            out += [(i, j, n, o[1], clamp(-s), clamp(-o[0])) for n, o in enumerate(fit, 1)]
    return out


def same(spark, rows, step=100):
    got = sorted(rows_of(N.hard_negatives(frame(spark, rows), step), *COLUMNS))
    assert got == sorted(brute(rows, step))
    return got


def normal(rng, n, dims, labels=4):
    x = rng.standard_normal((n, dims))
    return [(k, int(rng.integers(labels)), (row / np.linalg.norm(row)).tolist()) for k, row in enumerate(x)]


@pytest.mark.parametrize("dims", [1, 5, 64, 70, 130])
def test_intervals_hold_and_narrow(dims):
    rng = np.random.default_rng(dims)
    v = np.floor(256 * rng.standard_normal((300, dims)))
    v[0] = 0
    v[1] = 1000
    codes, align = N.encode(v)
    rows = N.Rows(np.arange(300), np.zeros(300, int), v, codes, align)
    for q in (v[5], v[0], v[1], -3 * v[1]):
        steps, stay, widths = rows.intervals(N.Query.of(q), np.arange(300)), None, []
        for _ in range(N.LEVELS):
            at, low, high = next(steps) if stay is None else steps.send(stay)
            exact = rows.v[at] @ q
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
            stay = np.ones(len(at), bool)
        if q is v[5] and dims >= 64:
            assert widths[-1] < widths[0] / 8


def test_filter_leaves_few_rows_to_score():
    rng = np.random.default_rng(4)
    v = np.floor(256 * np.array([x for _, _, x in normal(rng, 4000, 64)]))
    rows = N.Rows(np.arange(4000), np.zeros(4000, int), v, *N.encode(v))
    seen = []
    plain = rows.scores
    rows.scores = lambda at, q: seen.append(len(at)) or plain(at, q)
    best = N.Best(5, None)
    N.first_of_label(rows, N.Anchor(0, 0, rows.v[0]), N.Query.of(rows.v[0]), best)
    assert seen[0] < 1000 and len(best.rows) == 5


def test_equals_brute_force(spark):
    assert len(same(spark, normal(np.random.default_rng(1), 700, 64))) > 100


def test_small_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(N, "CHUNK_BYTES", 20_000)
    rows = normal(np.random.default_rng(2), 400, 20)
    blocks = list(N._anchors(N.coded(frame(spark, rows)), 20))
    assert len(blocks) > 2 and sorted(a.vec_id for b in blocks for a in b) == list(range(0, 400, 20))
    same(spark, rows, 20)


def test_ties_copies_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    some = normal(rng, 150, 6, 3)
    rows = some + [(k + 200, c, [round(e, 1) for e in x]) for k, c, x in some]      # many ties
    rows += [(k + 1000, 1, [0.5, 0.5, 0.1, 0.0, 0.0, 0.0]) for k in range(300)]          # one vector for a third of the rows
    rows += [rows[0], rows[3], rows[3], (100, 2, rows[4][2])]                      # repeated rows, and an id of two vectors
    rows += [(None, 1, [1.0] * 6), (600, None, [1.0] * 6), (700, 1, None), (701, 1, [None] + [1.0] * 5),
             (800, 2, [math.nan] * 6), (801, 2, [math.inf] * 6), (900, 1, []), (901, 1, []), (902, 2, []),
             (-100, 1, [-0.3] * 6), (-7, -1, [0.2] * 6), (300, 1, [0.0] * 6), (400, 5, [1.0, 2.0]), (401, 5, [1.0, 2.5]), (402, 6, [0.7, 1.0])]
    assert len(same(spark, rows)) > 50


def test_scores_beyond_64_bits(spark):
    big = 1.5e13
    rows = [(0, 0, [big, 1.0]), (1, 1, [big, 2.0]), (2, 1, [big / 2, 2.0]), (3, 2, [big / 4, 0.0]), (4, 2, [big / 4, 1.0]), (5, 2, [big / 2, 1.0])]
    assert len(same(spark, rows)) > 2
    assert N.coded(frame(spark, [(1, 1, [2e13])])).collect() == []


def test_empty_table(spark):
    out = N.hard_negatives(frame(spark, []))
    assert out.collect() == [] and out.columns == COLUMNS
