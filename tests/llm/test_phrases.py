import collections
import random
import re

import pytest

from tests.llm.conftest import rows_of
from tillrec.llm import phrases as P

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
DOCS = "doc_id long, text string, lang string, phrase string, n int, f int, part int"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    f, total = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(ws)
            for n in range(1, 5):
                f.update((lang, tuple(ws[i:i + n])) for i in range(len(ws) - n + 1))
    held = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, ws), a in held.items():
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                if 100 * a >= 80 * f[lang, ws[i:i + m]]:
                    covered.add((lang, ws[i:i + m]))
    out = collections.defaultdict(list)
    for (lang, ws), a in held.items():
        if (lang, ws) not in covered:
            cuts = [(2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return [(lang, rank, p.decode(), -a, l, r, total[lang], -s)
            for lang in out for rank, (s, a, p, l, r) in enumerate(sorted(out[lang])[:top], 1)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, 3) for i, (t, lang) in enumerate(docs)], DOCS)


def some_docs(seed, count=120):
    rng = random.Random(seed)
    words = ["New", "york", "É", "é", "the", "a\xa0b", "\x1c", "of", "end", "x" * 40, "🙂", "'s"]
    gaps = [" ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b", " the city of ", " in point of fact "]
    docs = [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""]))
            for _ in range(count)]
    return docs + [(None, "en"), ("", "fr"), ("one", "fr"), (docs[0][0], docs[0][1])] * 2


def limits(monkeypatch, burst, held, vocabulary, block, size):
    for name, value in (("BURST", burst), ("HELD", held), ("VOCABULARY", vocabulary), ("_BLOCK", block), ("_SLICE", size)):
        monkeypatch.setattr(P, name, value)


@pytest.mark.parametrize("sizes", [(8192, 600_000, 600_000, 1 << 19, 1 << 20), (2, 40, 600, 30, 10), (3, 10, 4, 7, 1)])
def test_task_counts_do_not_depend_on_limits(monkeypatch, sizes):
    limits(monkeypatch, *sizes)
    docs = [(t, lang or "und") for t, lang in some_docs(4, 40) if t]
    want = collections.Counter()
    for text, lang in docs:
        for piece in re.split("[.,;:!?\n-\r]", text.translate(UPPER)):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            want.update((lang, n, " ".join(ws[i:i + n])) for n in range(1, 5) for i in range(len(ws) - n + 1))
    everything = P.Filter(P.np.full(64, (1 << 64) - 1, dtype=P.np.uint64))
    got = collections.Counter()
    for n in range(1, 5):
        counters, batches = {}, []
        for text, lang in docs:
            counters.setdefault(lang, P.Counter(lang, n, everything, everything)).read(text.encode())
            batches += P._relieved(counters)
        for c in counters.values():
            c.count()
            batches += c.runs(0)
        for batch in batches:
            rows = batch.to_pydict()
            assert rows["phrase"] == sorted(rows["phrase"], key=lambda p: p.encode().split(b" "))       # sorted runs
            for lang, phrase, count in zip(rows["lang"], rows["phrase"], rows["n"]):
                got[lang, n, phrase] += count
    assert got == want


def test_collocations_equal_brute_force(spark):
    docs = some_docs(1)
    for least, top in ((3, 2000), (6, 7)):
        got = rows_of(P.collocations(frame(spark, docs), least, top), *COLUMNS)
        want = brute(docs, least, top)
        assert sorted(got) == sorted(want) and len(want) > 20


def test_a_filter_that_lets_all_through_changes_nothing(spark, monkeypatch):
    docs = some_docs(2)
    monkeypatch.setattr(P, "FILTER_BITS", 6)
    assert sorted(rows_of(P.collocations(frame(spark, docs), 5), *COLUMNS)) == sorted(brute(docs, 5, P.TOP))


def test_long_text_empty_table_and_order_of_ties(spark):
    long = [("a b c " * 50_000 + "d", "en"), ("z y. é y. b y. " * 40, "en")]
    assert sorted(rows_of(P.collocations(frame(spark, long)), *COLUMNS)) == sorted(brute(long, 30, 2000))
    out = P.collocations(frame(spark, []))
    assert out.collect() == [] and out.columns == COLUMNS
    assert {t for c, t in out.dtypes if c not in ("lang", "phrase")} == {"bigint"}


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3 * 10 ** 18
    grams = spark.createDataFrame([("en", 1, "a", big + 1), ("en", 1, "b", big), ("en", 2, "a b", big - 1)],
                                  "lang string, words int, phrase string, f long")
    assert rows_of(P.scored(grams), "score") == [(2_000_000 * (big - 1) // (2 * big + 1),)]


def test_a_rare_word_is_hashed_once_a_block_not_at_each_of_its_places(monkeypatch):
    hashed, digest = [], P.xxhash.xxh64_intdigest
    monkeypatch.setattr(P.xxhash, "xxh64_intdigest", lambda word, seed: hashed.append(word) or digest(word, seed))
    nothing = P.Filter(P.np.zeros(64, dtype=P.np.uint64))
    counter = P.Counter("en", 2, nothing, nothing)
    for _ in range(50):
        counter.read(b"One rare  word.one\trare " * 20)
    counter.count()
    assert sorted(hashed) == [b"one", b"rare", b"word"] and list(counter.runs(0)) == []


def test_pieces_of_nothing_but_separators_hold_no_words(spark):
    docs = [("..", "en"), (" \t \n", "en"), (" . a\x00b c . . a\x00b c", "en"), (".a\x00b c", "en"), ("c", "en"), ("\x85  ", "en")] * 3
    got = rows_of(P.collocations(frame(spark, docs), 3), *COLUMNS)
    assert sorted(got) == sorted(brute(docs, 3, P.TOP)) and len(got) == 2
