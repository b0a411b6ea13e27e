import hashlib
import random

import pytest

from tests.llm.conftest import rows_of
from tillrec.llm import pieces

ALPHABET = "ab \n\tß▁<>0xé'漢🙂\x00​"


@pytest.fixture(scope="module")
def model():
    return pieces.MergeModel(pieces.default_model())


def texts(n=1500, seed=4):
    rng = random.Random(seed)
    words = ["the", "tokenization", "überraschung", "1234567", "don't", "ﬀ", "Ａ", "a" * 40, "<s>", "</s>", "<0x41>"]
    return ["", " ", "  a  b ", "▁", "▁▁x", "a" * 3000, " " * 500, "x\x00y"] + \
        ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 80))) for _ in range(n)] + \
        [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_ids_equal_the_library(model):
    every = texts()
    ids, agrees = model.encode_all(every, "chunks")
    assert ids == model.library.encode(every, add_eos=True) and all(agrees)
    assert model.encode_all(every, "documents") == (ids, [True] * len(every))


def test_both_agendas_agree(model):
    for text in texts(300, 9):
        chunk = text.replace(" ", "▁")
        assert model.merge_short(chunk) == model.merge_long(chunk)


def test_whole_text_as_one_chunk_gives_the_same(model):
    every = texts(100, 5)
    cut = model.encode_all(every, "none")[0]
    whole = pieces.MergeModel(pieces.default_model())
    whole.chunks = None
    assert whole.encode_all(every, "none")[0] == cut


def test_a_full_cache_starts_anew(model, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHUNKS", 50)
    small = pieces.MergeModel(pieces.default_model())
    every = texts(200, 6)
    for _ in range(2):
        for at in range(0, len(every), 40):
            assert small.encode_all(every[at:at + 40], "none")[0] == model.library.encode(every[at:at + 40], add_eos=True)


def test_a_disagreeing_chunk_is_marked(model, monkeypatch):
    small = pieces.MergeModel(pieces.default_model())
    monkeypatch.setattr(small, "chunk_ids", lambda c: [5] if c == "▁bad" else model.chunk_ids(c))
    ids, agrees = small.encode_all(["good bad", "good", "bad"], "chunks")
    assert agrees == [False, True, False] and ids[0] == [*model.library.encode("good"), 5, 2]


def test_query_rows_and_edges(make_docs, model):
    docs = make_docs([(1, "a b"), (2, None), (2, ""), (None, "x"), (4, "word " * 20000)])
    lib = model.library
    want = []
    for i, t in [(1, "a b"), (2, ""), (2, ""), (None, "x"), (4, "word " * 20000)]:
        ids = lib.encode(t, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids).encode()).hexdigest(), True))
    got = rows_of(pieces.encode_decode(docs, pieces.default_model()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "library_equal")
    assert sorted(got, key=str) == sorted(want, key=str)
    back = {r["doc_id"]: r["ids"] for r in pieces.encode_ids(docs, pieces.default_model()).collect()}
    assert back[1] == lib.encode("a b", add_eos=True)
    assert pieces.encode_decode(make_docs([]), pieces.default_model()).collect() == []
