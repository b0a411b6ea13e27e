import random

from tests.llm.conftest import rows_of
from tillrec.llm import common, line_spread as L

LINE = "Subscribe to our newsletter."


def key(line):
    return line.strip(" \t\r\x0b\x0c").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute(docs, min_sites):
    sites, first = {}, {}
    for i, text, site in docs:
        for line in map(key, (text or "").split("\n")):
            if line:
                sites.setdefault(line, set()).update({site} - {None})
                if i is not None:
                    first[line] = min(first.get(line, i), i)
    out = []
    for i, text, _ in docs:
        lines = (text or "").split("\n")
        left = [x for x in lines if not (key(x) and len(sites[key(x)]) >= min_sites and i is not None and i != first[key(x)])]
        out.append((i, sum(bool(key(x)) for x in lines), sum(bool(key(x)) for x in lines) - sum(bool(key(x)) for x in left),
                    len("\n".join(left))))
    return out


def test_equals_brute_force(make_docs):
    rng = random.Random(1)
    lines = [LINE, "  subscribe TO our newsletter.\t", "x", "É line", "é line", "", " "] + [f"line {k}" for k in range(25)]
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9))), f"s{rng.randrange(9)}") for i in range(120)]
    docs += [(3000, None, "s1"), (3001, "", "s2"), (3002, LINE, None), (None, LINE + "\nown", "s3"), (3003, "x" * 100_000, "s4")]
    got = rows_of(L.line_counts(make_docs(docs)), "doc_id", "n_lines", "n_removed", "n_chars")
    assert sorted(got, key=str) == sorted(brute(docs, L.MIN_SITES), key=str)


def test_threshold_is_exact_also_where_sketches_are_not(spark):
    # 1000 sites: the sketch's error is larger than one site, so lines near the threshold are counted
    rows = [(s, f"s{s}", line) for line in range(6) for s in range(997 + line)]
    lines = spark.createDataFrame(rows, "doc_id long, site string, line long")
    assert sorted(rows_of(L.boilerplate(lines, 1000), "line", "first_doc")) == [(3, 0), (4, 0), (5, 0)]


def test_documents_keep_columns_and_empty_ones_go(make_docs):
    docs = [(i, f"{LINE}\nown text {i}.", f"s{i}") for i in range(8)] + [(20, LINE, "s1"), (21, "", "s1"), (22, None, "s2")]
    frame = make_docs(docs)
    kept = L.remove_boilerplate(frame)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept.collect()}
    assert got[0] == (f"{LINE}\nown text 0.", 40) and got[5] == ("own text 5.", 11)
    assert 20 not in got and got[21] == ("", 0) and got[22] == (None, None)


def test_empty_table_and_plain_operators(make_docs):
    empty = L.line_counts(make_docs([]))
    assert empty.collect() == [] and L.remove_boilerplate(make_docs([])).collect() == []
    plan = empty._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
