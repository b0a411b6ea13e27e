import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings, strategies as st

from tests.llm.conftest import rows_of
from tillrec.llm import simhash as S

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(UPPER)) if w]
    parts = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(values):
    """Least member of the group of every distinct value."""
    values = sorted(set(values))
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(values):
        for y in values[i + 1:]:
            if (x ^ y).bit_count() <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {x: find(x) for x in values}


def brute(docs):
    prints = [(i, brute_fingerprint(t)) for i, t in docs]
    groups = brute_groups(p for _, p in prints)
    least = {}
    for i, p in prints:
        if i is not None:
            least[groups[p]] = min(least.get(groups[p], i), i)
    return [(i, f"{p:016x}", least.get(groups[p])) for i, p in prints]


def test_fingerprints_by_slices(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["A", "bé", "c\tD", "e\x0bf", "g\xa0h", "\x1c"]) for _ in range(n)) for n in (1, 2, 3, 4, 50, 300)]
    texts += ["", None, "  \t ", "x" * 1000, "a  b", "ÀB c"]
    for size in (1, 7, 1 << 18):
        monkeypatch.setattr(S, "_SLICE", size)
        assert [S.fingerprint(t.encode() if t is not None else None) for t in texts] == [brute_fingerprint(t) for t in texts]


def near(rng, base, bits):
    for _ in range(rng.randint(0, bits)):
        base ^= 1 << rng.randrange(64)
    return base


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.booleans())
def test_trie_join_finds_the_groups(seed, bits, tight):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(rng.randint(1, 5))]
    if tight:
        centres = [c & 0xFF for c in centres]
    values = sorted({near(rng, rng.choice(centres), bits) for _ in range(150)})
    arr = np.array(values, dtype=np.uint64)
    u, v = S.linked(arr)
    half = len(values) // 2
    groups = brute_groups(values)
    assert groups == joined(values, zip(u.tolist(), v.tolist()))
    parts = [S.linked(arr[:half]), S.linked(arr[half:]), S.linked(arr[:half], arr[half:])]
    assert groups == joined(values, [p for u, v in parts for p in zip(u.tolist(), v.tolist())])


def joined(values, links):
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        a, b = find(x), find(y)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in values}


def test_small_frontiers_and_held_links(monkeypatch):
    monkeypatch.setattr(S, "_FRONTIER", 5)
    monkeypatch.setattr(S, "_LINKS", 3)
    monkeypatch.setattr(S, "_LEAVES", 1)
    rng = random.Random(8)
    values = sorted({near(rng, rng.choice([0, 1 << 40, (1 << 64) - 1]), 3) for _ in range(200)})
    u, v = S.linked(np.array(values, dtype=np.uint64))
    assert brute_groups(values) == joined(values, zip(u.tolist(), v.tolist()))


def test_buckets_of_different_depths(spark):
    rng = random.Random(5)
    values = {near(rng, rng.choice([0, 0xF0F0 << 48, 1 << 63]), 4) for _ in range(250)} | {rng.getrandbits(64) for _ in range(60)}
    values |= {x ^ (1 << rng.randrange(64)) for x in list(values)[::4]}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(values)]
    nodes = spark.createDataFrame([(x,) for x in signed], "node long")
    placed, levels = S.buckets(nodes, 20)
    assert len(levels) > 2 and placed.count() == len(values) and placed.select("depth").distinct().count() > 1
    found = [(u % (1 << 64), v % (1 << 64)) for u, v in rows_of(S.links(nodes, 20), "u", "v")]
    assert brute_groups(values) == joined(sorted(values), found)


def test_documents_equal_brute_force(make_docs):
    rng = random.Random(2)
    base = [f"w{k}" for k in range(400)]
    docs = []
    for i in range(60):
        words = list(base) if i % 2 else [f"d{i}x{k}" for k in range(30)]
        for _ in range(rng.randint(0, 6) if i % 2 else 0):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        docs.append((i + 5, " ".join(words)))
    docs += [(1, None), (2, ""), (3, " \t"), (None, docs[1][1]), (None, "all alone"), docs[3], docs[3], (4, "one"), (70, "one two"),
             (80, "x" * 300_000), (81, "a b c " * 60_000)]
    assert sorted(rows_of(S.near_duplicates(make_docs(docs), 8), "doc_id", "fingerprint", "component_id"), key=str) \
        == sorted(brute(docs), key=str)


def test_empty_table(make_docs):
    out = S.near_duplicates(make_docs([]))
    assert out.collect() == [] and out.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
