import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import rows_of
from tillrec.llm import common, pitman_yor as P


def corpus():
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "or", "ti", "us")]
    p = 1 / np.arange(1, len(words) + 1)
    return [(i, " ".join(rng.choice(words, size=rng.integers(0, 60), p=p / p.sum()))) for i in range(150)] + \
        [(200, None), (201, ""), (None, "ban bor Ban"), (3, "ban"), (202, "unseen words only"), (203, "ban " * 20_000)]


def brute(docs):
    words = lambda t: (t or "").encode().lower().split() + [b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n,
             round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in docs]


@pytest.fixture(scope="module")
def model(spark, make_docs):
    return P.fit(make_docs(corpus()))


def test_base_scores_equal_brute_force(model, make_docs):
    got = [(*r[:5], round(r[5], 6)) for r in rows_of(P.scores(make_docs(corpus()), model), "doc_id", "held_out", "n_tokens",
                                                     "n_known", "train_tokens", "base_score")]
    assert sorted(got, key=str) == sorted(brute(corpus()), key=str)


def parts_of(model):
    return [P.PartValues.of(r.asDict(), model.totals) for r in model.state.collect()]


def class_probabilities(model, v):
    """Of the words of a part in every class."""
    p = (v.seats * model.norm[:, None] + model.unknown[:, None]).T @ model.back / len(model.back)
    np.add.at(p, (v.classes // P.CLASSES, v.classes % P.CLASSES), v.extra)
    return p


def test_probabilities_sum_to_one_in_every_class(model):
    total = np.zeros(P.CLASSES)
    for v in parts_of(model):
        total += class_probabilities(model, v).sum(axis=0)
    total += model.unknown @ model.back / len(model.back)
    assert np.allclose(total, 1, atol=1e-5)


def test_tables_are_possible(model):
    now = model.totals
    for tables, root in zip(now.tables, now.root_tables):
        assert (tables <= now.customers).all() and ((tables > 0) == (now.customers > 0)).all()
        assert now.v <= root <= tables.sum()


def test_joined_words_score_as_broadcast_ones_do(model, make_docs, monkeypatch):
    docs = make_docs(corpus())
    before = sorted(rows_of(P.scores(docs, model), "doc_id", "n_tokens", "score"), key=str)
    monkeypatch.setattr(P, "FREQUENT", 2)
    after = sorted(rows_of(P.scores(docs, model), "doc_id", "n_tokens", "score"), key=str)
    assert [x[:2] for x in before] == [x[:2] for x in after]
    assert np.allclose([x[2] for x in before], [x[2] for x in after], rtol=1e-5)


def test_held_out_texts_score_better_than_the_base(model, make_docs):
    held = P.scores(make_docs(corpus()), model).filter("held_out AND n_known = n_tokens AND n_tokens > 10").collect()
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(math.isclose(r["perplexity"], 10 ** (-r["score"] / r["n_tokens"])) for r in held)


def test_scores_equal_a_plain_walk_over_the_model(model, make_docs):
    """Every token's probability looked up one by one in the model's parts."""
    from xxhash import xxh3_64_intdigest
    size = len(model.contexts.klass)
    key = lambda w: int(np.array([xxh3_64_intdigest(w)], dtype=np.uint64).view(np.int64)[0])
    words, extra, mine = {}, {}, {}
    for v in parts_of(model):
        for i, k in enumerate(v.key.tolist()):
            words[k] = v.seats[:, i]
        extra |= {(int(v.key[c // P.CLASSES]), int(c % P.CLASSES)): x for c, x in zip(v.classes.tolist(), v.extra)}
        mine |= {(int(v.key[c // size]), int(c % size)): x for c, x in zip(v.pairs.tolist(), v.mine)}
    places = {int(k): P.CLASSES + i for i, k in enumerate(model.contexts.keys)}

    def score(text):
        total, before = 0.0, None
        for w in [*(text or "").encode().lower().split(), b""]:
            context = 0 if before is None else places.get(key(before), 1 + zlib.crc32(before[-2:]) % (P.CLASSES - 1))
            klass, weight = (context, 1.0) if context < P.CLASSES else (int(model.contexts.klass[context]), model.own_back[context - P.CLASSES])
            roots = words.get(key(w), np.zeros(len(model.norm))) * model.norm + model.unknown
            in_class = (roots * model.back[:, klass]).mean() + extra.get((key(w), klass), 0.0)
            total += math.log10(weight * in_class + mine.get((key(w), context), 0.0))
            before = w
        return total

    docs = corpus() + [(300, "ban " + " ".join(f"new{k} bor ban" for k in range(3000)))]
    got = dict((i, s) for i, s in rows_of(P.scores(make_docs(docs), model), "doc_id", "score") if i not in (None, 3))
    want = {i: score(t) for i, t in docs if i not in (None, 3)}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)


def test_slices_cut_long_texts_and_change_nothing(make_docs, monkeypatch):
    """Many distinct words in one text; slices, vocabularies and pair sums of any size."""
    rng = np.random.default_rng(7)
    docs = corpus() + [(400, " ".join(f"w{k}" for k in rng.integers(0, 3000, 9000))), (401, "x" * 5000)]
    wanted = ("doc_id", "n_tokens", "n_known", "train_tokens", "score")
    whole = sorted(rows_of(P.scores(make_docs(docs), P.fit(make_docs(docs))), *wanted), key=str)
    for name, value in (("SLICE", 50), ("SLICE_BYTES", 200), ("MAX_PIECES", 3), ("PAIRS", 500), ("VOCABULARY", 300)):
        monkeypatch.setattr(P, name, value)
    parts = sorted(rows_of(P.scores(make_docs(docs), P.fit(make_docs(docs))), *wanted), key=str)
    assert [x[:4] for x in whole] == [x[:4] for x in parts]
    assert np.allclose([x[4] for x in whole], [x[4] for x in parts], rtol=1e-5)


def test_seatings_follow_the_restaurant_rule():
    """Mean tables of one seating against the exact recursion, also beyond the exact steps."""
    d, s, p, c = 0.5, 4.0, 0.1, 40
    exact = np.zeros(c + 1)
    exact[1] = 1.0
    for j in range(1, c):
        fresh = (s + d * np.arange(c + 1)) * p
        new = fresh / (fresh + np.maximum(j - d * np.arange(c + 1), 0.5))     # t <= j has weight only
        exact = exact * (1 - new) + np.concatenate([[0], (exact * new)[:-1]])
    many = 4000
    seeds = np.random.default_rng(5).integers(0, 2**64, many, dtype=np.uint64)
    t, w = P.seated(np.full(many, c), np.full(many, s), np.full(many, p), d, seeds)
    assert abs(t.mean() - (exact * np.arange(c + 1)).sum()) < 0.15 and w.std() > 0
    big, _ = P.seated(np.array([10, 10_000, 10**9]), np.full(3, s), np.full(3, p), d, seeds[:3])
    assert 1 <= big[0] <= 10 and big[1] <= 10_000 and 1 <= big[2] <= 10**9
    again, _ = P.seated(np.array([10, 10_000, 10**9]), np.full(3, s), np.full(3, p), d, seeds[:3])
    assert (big == again).all()


def test_empty_tables(make_docs):
    empty = P.fit(make_docs([]))
    assert P.scores(make_docs([]), empty).collect() == []
    rows = rows_of(P.scores(make_docs([(1, "a b"), (2, None)]), empty), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert sorted(rows) == [(1, 0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0)]


def test_words_of_one_class_have_contexts_of_their_own(make_docs, monkeypatch):
    """'new' and 'few' end alike: only the one is followed by 'york'."""
    docs = [(None, "new york"), (None, "few men")] * 50
    model = P.fit(make_docs(docs))
    assert len(model.contexts.keys) == 4
    texts = make_docs([(1, "new york"), (2, "few york"), (3, "new men")])
    got = dict(rows_of(P.scores(texts, model), "doc_id", "score"))
    assert got[1] - got[2] > 0.5 and got[1] - got[3] > 0.5
    # the words looked up instead of broadcast, and the pairs looked up instead of broadcast
    for frequent, hot in ((2, 0), (16384, 0), (16384, 1 << 20)):
        monkeypatch.setattr(P, "FREQUENT", frequent)
        monkeypatch.setattr(P, "HOT", hot)
        again = dict(rows_of(P.scores(texts, model), "doc_id", "score"))
        assert all(math.isclose(got[i], again[i], rel_tol=1e-5) for i in got)


def test_probabilities_sum_to_one_after_every_word(model):
    total = np.zeros(len(model.contexts.keys))
    weight, classes = model.own_back, model.contexts.klass[P.CLASSES:]
    for v in parts_of(model):
        total += (weight * class_probabilities(model, v)[:, classes]).sum(axis=0)
        np.add.at(total, v.pairs % len(model.contexts.klass) - P.CLASSES, v.mine)
    total += weight * (model.unknown @ model.back / len(model.back))[classes]
    assert len(total) > 20 and np.allclose(total, 1, atol=1e-5)


def test_only_frequent_words_have_contexts_of_their_own(make_docs, monkeypatch):
    """Also with words and pairs of every kind: the share decides, and the sums of a text stay whole."""
    monkeypatch.setattr(P, "FREQUENT", 40)
    model = P.fit(make_docs(corpus()))
    c = Counter(w for i, t in corpus() if not P.held_out(i) for w in [*(t or "").lower().split(), ""])
    n = sum(c.values())
    want = {w for w in c if w and c[w] * 40 >= n}
    assert 0 < len(want) < len(c) - 1 and len(model.contexts.keys) == len(want)
    assert (model.totals.guests[-1] <= model.totals.customers).all()
    joined = sorted(rows_of(P.scores(make_docs(corpus()), model), "doc_id", "n_tokens", "n_known", "score"), key=str)
    monkeypatch.setattr(P, "FREQUENT", 10**6)
    shared = sorted(rows_of(P.scores(make_docs(corpus()), model), "doc_id", "n_tokens", "n_known", "score"), key=str)
    assert [x[:3] for x in joined] == [x[:3] for x in shared]
    assert np.allclose([x[3] for x in joined], [x[3] for x in shared], rtol=1e-5)


def test_rows_of_a_part_are_bounded_and_change_nothing(spark, make_docs, monkeypatch):
    """Many rows a part, many parts: whole words, about BLOCK pairs a row, the same seats and scores."""
    docs, columns = make_docs(corpus()), ("doc_id", "n_tokens", "n_known", "score")
    monkeypatch.setattr(P, "PARTS", 2)
    whole = P.fit(docs)
    monkeypatch.setattr(P, "BLOCK", 20)
    monkeypatch.setattr(P, "PART_TOKENS", 5000)
    model = P.fit(docs)
    assert model.parts == model.totals.n // 5000 > 2
    sizes = lambda m: [(r["part"], np.frombuffer(r["size"], np.int32), r["key"]) for r in m.state.collect()]
    rows = sizes(model)
    keys = np.concatenate([np.frombuffer(k, np.int64) for _, _, k in rows])
    assert len(keys) == len(set(keys.tolist())) == model.totals.v and len(sizes(whole)) == 2
    assert max(Counter(part for part, _, _ in rows).values()) > 2
    assert all(s.sum() - s[-1] < 20 for _, s, _ in rows)
    for a, b in zip(whole.totals.own_tables + whole.totals.tables, model.totals.own_tables + model.totals.tables):
        assert (a == b).all()
    before, after = (sorted(rows_of(P.scores(docs, m), *columns), key=str) for m in (whole, model))
    assert [x[:3] for x in before] == [x[:3] for x in after]
    assert np.allclose([x[3] for x in before], [x[3] for x in after], rtol=1e-5)


def test_large_rows_are_stored_and_sent_by_their_bytes(spark):
    """Not a hundred to a page and a thousand to a batch; the session's own batch sizes come back."""
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq

    def megabytes(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array([np.random.default_rng(n).bytes(2 << 20)], pa.binary())], names=["n"])

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    names = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(n) for n in names]
    rows = spark.range(0, 24, 1, 1).mapInArrow(megabytes, "n binary")
    stored = common.stored(rows, "large-rows", **P.STORED)
    (path,) = stored.inputFiles()
    written = pq.ParquetFile(Path(path.removeprefix("file:"))).metadata
    assert written.num_rows == 24 and written.num_row_groups > 2
    with P.small_batches(spark):
        sent = stored.coalesce(1).mapInArrow(sizes, "n long").collect()
    assert sum(r["n"] for r in sent) == 24 and max(r["n"] for r in sent) <= 3
    assert [spark.conf.get(n) for n in names] == before


def whole_model(model):
    """Of rarer words: pairs (before, word) with counts and, of those seen more than once, mean tables."""
    pairs, tables = {}, {}
    for r in model.counted.where("rarer").collect():
        u, w, n, _ = P._pairs_of(r.asDict())
        pairs |= dict(zip(zip(u.tolist(), w.tolist()), n.tolist()))
    for r in (r.asDict() for r in model.state.collect()):
        w = P.Words.of(r)
        x = P.Seats(w, model.totals.klass, r)
        mean = P.Averages.of(r, x).plus(x, model.totals, P.SWEEPS).mine[x.rarer]
        tables |= dict(zip(zip(w.before.tolist(), w.key[w.owner[x.leaves[x.rarer]]].tolist()), mean.tolist()))
    return pairs, tables


def test_every_word_before_has_a_restaurant(make_docs, monkeypatch):
    """However rare: 'new' and 'few' end alike and make up little, only the one is followed by 'york'."""
    monkeypatch.setattr(P, "FREQUENT", 2)
    model = P.fit(make_docs([(None, "new york"), (None, "few men")] * 50 + [(None, "anew here")]))
    assert len(model.contexts.keys) == 0
    got = dict(rows_of(P.scores(make_docs([(1, "new york"), (2, "few york"), (3, "new men"), (4, "anew here"), (5, "knew here")]), model), "doc_id", "score"))
    assert got[1] - got[2] > 0.5 and got[1] - got[3] > 0.5 and got[4] - got[5] > 0


@pytest.mark.parametrize("frequent, later", [(40, 2), (40, 10**6), (2, 40)])
def test_scores_equal_a_plain_walk_over_all_restaurants(make_docs, monkeypatch, frequent, later):
    """Also those of words that aren't numbered: known and unknown words after them, frequent and rare ones."""
    from xxhash import xxh3_64_intdigest
    key = lambda w: int(np.array([xxh3_64_intdigest(w)], dtype=np.uint64).view(np.int64)[0])
    monkeypatch.setattr(P, "FREQUENT", frequent)
    rng = np.random.default_rng(3)
    docs = [*corpus(), *[(500 + k, " ".join(f"r{x}" for x in rng.zipf(1.5, 40) % 300)) for k in range(60)]]
    model = P.fit(make_docs(docs))
    now, size = model.totals, len(model.contexts.klass)
    pairs, tables = whole_model(model)
    followed, before = Counter(), {}
    for i, t in docs:
        if not P.held_out(i):
            ws = [*(t or "").encode().lower().split(), b""]
            followed.update(zip(ws[:-1], ws[1:]))
            before |= {key(w): 1 + zlib.crc32(w[-2:]) % (P.CLASSES - 1) for w in ws}
    numbered = set(model.contexts.keys.tolist())
    want = {(key(u), key(w)): n for (u, w), n in followed.items() if key(u) not in numbered}
    assert pairs == want and tables.keys() == {p for p, n in want.items() if n > 1} and len({u for u, _ in want}) > 50
    assert all(1 <= t <= want[p] for p, t in tables.items()) and any(t > 1 for t in tables.values())
    c, t = Counter(), Counter()
    for (u, w), n in pairs.items():
        c[u] += n
        t[u] += tables.get((u, w), 1.0)
    words, extra, mine = {}, {}, {}
    for v in parts_of(model):
        words |= {k: v.seats[:, i] for i, k in enumerate(v.key.tolist())}
        extra |= {(int(v.key[c // P.CLASSES]), int(c % P.CLASSES)): x for c, x in zip(v.classes.tolist(), v.extra)}
        mine |= {(int(v.key[c // size]), int(c % size)): x for c, x in zip(v.pairs.tolist(), v.mine)}
    places = {int(k): P.CLASSES + i for i, k in enumerate(model.contexts.keys)}

    def probability(u, w, class_of_u):
        if u in places:
            klass, weight, own = int(model.contexts.klass[places[u]]), model.own_back[places[u] - P.CLASSES], mine.get((w, places[u]), 0.0)
        else:
            n = pairs.get((u, w), 0)
            klass, weight = class_of_u, (P.STRENGTH + now.f * t[u]) / (P.STRENGTH + c[u])
            own = (n - now.f * tables.get((u, w), 1.0)) / (P.STRENGTH + c[u]) if n else 0.0
        roots = words.get(w, np.zeros(len(model.norm))) * model.norm + model.unknown
        return weight * ((roots * model.back[:, klass]).mean() + extra.get((w, klass), 0.0)) + own

    for u in sorted({u for u, _ in pairs})[:3]:
        total = sum(probability(u, w, before[u]) for w in words) + probability(u, 1, before[u])
        assert math.isclose(total, 1, abs_tol=1e-5)

    def score(text):
        ws = [*(text or "").encode().lower().split(), b""]
        first = (words.get(key(ws[0]), np.zeros(len(model.norm))) * model.norm + model.unknown) * model.back[:, 0]
        return math.log10(first.mean() + extra.get((key(ws[0]), 0), 0.0)) + sum(
            math.log10(probability(key(u), key(w), 1 + zlib.crc32(u[-2:]) % (P.CLASSES - 1))) for u, w in zip(ws, ws[1:]))

    asked = docs + [(700, "ban " + " ".join(f"new{k} bor r{k % 300} r{k % 7}" for k in range(500)))]
    monkeypatch.setattr(P, "FREQUENT", later)
    found = dict((i, s) for i, s in rows_of(P.scores(make_docs(asked), model), "doc_id", "score") if i not in (None, 3))
    expected = {i: score(x) for i, x in asked if i not in (None, 3)}
    assert found.keys() == expected.keys() and all(math.isclose(found[i], expected[i], rel_tol=1e-5) for i in expected)
    base = sorted((*r[:5], round(r[5], 6)) for r in rows_of(P.scores(make_docs(docs), model), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens",
                                                            "base_score") if r[0] is not None)
    assert base == sorted(r for r in brute(docs) if r[0] is not None)
