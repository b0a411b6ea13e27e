import random

import numpy as np

from tests.llm.conftest import rows_of
from tillrec.llm import minhash
from tillrec.llm.components import components


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(docs):
    """doc_id -> component, over all pairs (a small fixture)."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12):
    rng = random.Random(seed)
    docs, n = [], 0
    passage = [f"p{i}" for i in range(40)]
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.randint(1, 8)):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                words[rng.randrange(len(words))] = f"e{rng.randrange(9999)}"
            docs.append((n := n + 1, " ".join(words)))
    rng.shuffle(docs)
    return docs


def test_components_equal_brute_force(make_docs):
    docs = corpus(1)
    got = {i: (n, c) for i, n, c in rows_of(minhash.near_duplicates(make_docs(docs)), "doc_id", "n_shingles", "component_id")}
    assert got == brute(docs)


def test_large_group_of_near_copies_is_one_component(make_docs):
    base = [f"w{i}" for i in range(200)]
    docs = [(i, " ".join(base[:i % 190] + [f"x{i}"] + base[i % 190 + 1:])) for i in range(1, 150)]
    assert {c for (c,) in rows_of(minhash.near_duplicates(make_docs(docs)), "component_id")} == {1}


def test_edges(make_docs):
    same = "One two three four five six"
    docs = make_docs([(5, same), (2, same.upper().replace("ONE", "one")), (7, None), (8, ""), (9, " \t"), (10, "short text"),
                      (11, "short text"), (None, same), (5, same), (12, "a\x1cb c")])
    got = sorted(rows_of(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept"), key=str)
    assert got == sorted([(5, 2, 2, False), (2, 2, 2, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
                          (10, 1, 10, True), (11, 1, 10, False), (None, 2, None, True), (5, 2, 2, False), (12, 1, 12, True)], key=str)
    kept = minhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(rows_of(kept, "doc_id"), key=str) == sorted([(2,), (7,), (8,), (9,), (10,), (12,), (None,)], key=str)
    assert minhash.near_duplicates(make_docs([])).collect() == []
    assert minhash.keep_representatives(make_docs([])).collect() == []


def test_repeated_rows_stay_once(make_docs):
    text = "a repeated row of seven whole words"
    assert rows_of(minhash.keep_representatives(make_docs([(1, text), (1, text), (2, text)])), "doc_id") == [(1,)]


def test_very_long_text(make_docs):
    words = [f"w{i}" for i in range(30_000)]
    near = list(words)
    near[15_000] = "changed"
    got = rows_of(minhash.near_duplicates(make_docs([(1, " ".join(words)), (2, " ".join(near))])), "component_id")
    assert got == [(1,), (1,)]


def test_coordinates_estimate_similarity():
    a = minhash.shingle_hashes([b"w%d" % i for i in range(1000)])
    b = minhash.shingle_hashes([b"w%d" % i for i in range(100, 1100)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.1
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(minhash.sigma(x.copy()))) == len(x) == len(np.unique(minhash.pi(x.copy())))


def test_rest_in_blocks_misses_no_link(make_docs, monkeypatch):
    """Without star rounds everything is left to the blocks; small blocks make many of them."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    base = [f"w{i}" for i in range(120)]
    rng = random.Random(8)
    docs = corpus(2)
    for i in range(500, 540):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(120)] = f"e{rng.randrange(9999)}"
        docs.append((i, " ".join(words)))
    got = {i: (n, c) for i, n, c in rows_of(minhash.near_duplicates(make_docs(docs)), "doc_id", "n_shingles", "component_id")}
    assert got == brute(docs)


def test_star_contraction(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + k) for k in range(50)] \
        + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7), (3, 2)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    got = dict(rows_of(components(spark.createDataFrame(edges, "u long, v long")), "node", "root"))
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_rows_of_one_id_and_other_texts_are_separate(make_docs):
    a, b = "the first text of seven whole words", "another text that has eight quite different words"
    docs = make_docs([(3, b), (7, a), (7, b), (8, a), (9, a + " x"), (9, b + " y"), (9, ""), (9, " ")])
    got = sorted(rows_of(minhash.keep_representatives(docs), "doc_id", "text"), key=str)
    assert [r for r in got if r[0] != 9] == [(3, b), (7, a)]
    # a has three shingles, a + " x" four: 3 of 4 are shared; of b likewise; of the wordless texts one stays
    assert len([r for r in got if r[0] == 9]) == 1 and not [r for r in got if r[0] == 9][0][1].strip()


def test_one_of_several_close_texts_of_an_id_stays(make_docs):
    words = [f"w{i}" for i in range(60)]
    docs = make_docs([(4, " ".join(words)), (4, " ".join([*words, "x"])), (4, "quite another text of seven whole words"), (5, " ".join(words))])
    got = rows_of(minhash.keep_representatives(docs), "doc_id", "n_chars")
    assert [i for i, _ in got] == [4, 4] and len({n for _, n in got}) == 2
