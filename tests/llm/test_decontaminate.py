import hashlib
import random

from tests.llm.conftest import rows_of
from tillrec.llm import decontaminate as D

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def brute(items, doc, window):
    hit, found = set(), set()
    for n, (_, ws) in enumerate(items):
        size = min(window, len(ws))
        for s in range(len(ws) - size + 1):
            for p in range(len(doc) - size + 1):
                if size and doc[p:p + size] == ws[s:s + size]:
                    hit.update(range(p, p + size))
                    found.add(n)
    return hit, found


def test_automaton_equals_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        window, letters = rng.choice([2, 3, 4]), [b"a", b"b", b"c"][:rng.choice([2, 3])]
        items = [(str(i), [rng.choice(letters) for _ in range(rng.randint(1, 9))]) for i in range(rng.randint(0, 5))]
        doc = [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 25))]
        spans, found = D.Automaton(items, window).scan(doc)
        hit = {x for a, b in spans for x in range(a, b)}
        assert (hit, found) == brute(items, doc, window)
        assert D.words(D.cut(b", ".join(doc), spans)) == [w for i, w in enumerate(doc) if i not in hit]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_rows_and_edges(spark, make_docs):
    benchmark = bench(spark, [(7, ITEM), (8, "Tiny Item"), (9, None), (10, ""), (11, ITEM), (None, "only null id")])
    docs = make_docs([(1, f"Before: {ITEM.upper()}! after"), (2, None), (2, ""), (None, "a tiny; item b"),
                      (4, " ".join(ITEM.split()[:9])), (5, "has only null id"), (6, "word " * 50_000 + ITEM)])
    got = {(r["doc_id"], r["n_words"]): r for r in D.contamination(docs, benchmark).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    r = got[(1, 14)]
    assert (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["longest_hit"]) == (12, 2, sha("11,7"), True, 12)
    assert [(k, v["n_hit"]) for k, v in got.items() if k[0] == 2] == [((2, 0), 0)]
    assert got[(None, 4)]["items_sha256"] == sha("8") and not got[(4, 9)]["contaminated"]
    assert (got[(5, 4)]["n_hit"], got[(5, 4)]["n_items"], got[(5, 4)]["items_sha256"]) == (3, 1, sha(""))
    assert got[(6, 50_012)]["n_hit"] == 12
    assert len(D.contamination(docs, benchmark).collect()) == 7
    assert D.contamination(make_docs([]), benchmark).collect() == []
    assert not D.contamination(docs, bench(spark, [])).filter("contaminated").collect()


def test_shards_give_the_same(spark, make_docs):
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(3, 25)))) for i in range(60)]
    docs = make_docs([(i, " ".join([f"w{rng.randrange(30)}" for _ in range(30)] + items[i % 60][1].split()[:12])) for i in range(80)])
    benchmark = bench(spark, items)
    assert len(D.shards(benchmark, 100)) > 3
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(D.contamination(docs, benchmark, 100)) == key(D.contamination(docs, benchmark))


def test_spans_go_and_mostly_contaminated_documents_are_rejected(spark, make_docs):
    benchmark = bench(spark, [(7, ITEM)])
    clean = "an innocent text. " * 20
    docs = make_docs([(1, clean), (2, clean + ITEM + ". " + clean), (3, ITEM + " end"), (4, None), (None, clean)])
    kept = D.remove_contamination(docs, benchmark)
    assert kept.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert set(got) == {1, 2, 4, None} and got[1][0] == clean and got[4] == (None, None)
    assert got[2] == (clean + ". " + clean, len(clean + ". " + clean))
    longer = {r["doc_id"]: r["text"] for r in D.remove_contamination(docs, benchmark, min_words=13).collect()}
    assert longer[2] == clean + ITEM + ". " + clean
