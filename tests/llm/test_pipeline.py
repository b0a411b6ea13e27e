import hashlib

import corpus_pipeline as P
from tests.llm.conftest import rows_of
from tillrec.llm import common, line_spread, pieces, quality
from tests.llm.test_minhash import brute as components
from tests.llm.test_decontaminate import ITEM


def prose(tag, n=12):
    return "\n".join(" ".join(f"{tag}{i}w{k}" for k in range(9)) + "." for i in range(n))


def test_stages_against_brute_force(spark, tmp_path):
    boiler = "This shared notice stands everywhere."
    rows = [(i, prose(f"d{i}x") + ("\n" + boiler if i < 9 else ""), "en", f"s{i}", 0) for i in range(12)]
    rows += [(20, prose("d3x") + "\nOne more line here.", "en", "s1", 0),          # near copy of 3
             (21, "too short.", "en", "s1", 0), (22, None, "en", "s1", 0),
             (23, prose("q") + "\n" + ITEM + ".\nA last line of it.", "en", "s2", 0),   # a benchmark passage
             (24, prose("n") + "\nHome | News | About", "en", "s3", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # the same steps by hand
    step = {i: quality.judge(t) for i, t, *_ in rows}
    texts = {i: j.text for i, j in step.items() if j.kept}
    assert set(texts) == set(range(12)) | {20, 23, 24} and "Home" not in texts[24]
    texts = {i: t.replace("\n" + boiler, "") if i else t for i, t in texts.items()}
    kept = {i for i, (_, c) in components(sorted(texts.items())).items() if c == i}
    assert kept == set(texts) - {20}
    texts = {i: texts[i].replace(ITEM, "") for i in kept}
    lib = pieces.MergeModel(pieces.default_model()).library
    want = [(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest())
            for i, x in ((i, lib.encode(t, add_eos=True)) for i, t in texts.items())]
    assert sorted(rows_of(P.run(spark, str(tmp_path)), "doc_id", "n_tokens", "ids_sha256")) == sorted(want)


def test_stages_return_the_columns_of_documents(spark, make_docs, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([(1, prose("a")), (None, prose("b")), (1, prose("a")), (2, None)])
    for _, stage in P.STAGES[:-1]:
        after = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert after.columns == docs.columns
        docs = after
    assert sorted(rows_of(docs, "doc_id"), key=str) == [(1,), (None,)]


def test_ties_repeats_and_long_texts(spark, make_docs, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = prose("l", 4000)
    docs = make_docs([(5, prose("a")), (2, prose("a")), (2, prose("a")), (7, prose("b")), (7, prose("c")), (9, long), (10, long + "\nOne more line here."),
                      (None, prose("a")), (11, ""), (12, "x" * 300_000)])
    for _, stage in P.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
    got = sorted(rows_of(docs, "doc_id", "text"), key=str)
    assert got == sorted([(2, prose("a")), (7, prose("b")), (7, prose("c")), (9, long), (None, prose("a"))], key=str)


def test_empty_documents(spark, make_docs, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs([])
    for _, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.collect() == []


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "sentencepiece_codes"]
    assert line_spread.MIN_SITES == 6
