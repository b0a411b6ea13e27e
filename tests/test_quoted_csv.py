import random

import pytest

from tillrec.sources import files, quoted_csv as Q
from tillrec.sources.spec import POS

DELIMITERS = (";", ",")


def cell(rng, sep):
    kind = rng.randrange(8)
    word = lambda: "".join(rng.choice("abcé1 ") for _ in range(rng.randint(1, 6)))
    if kind == 0:
        return ""
    if kind == 1:
        return '"' + word() + "\n" + word() + '"'
    if kind == 2:
        return '"' + f'{sep}""\n{sep}""x{sep}\r\n' * rng.randint(1, 6) + '"'
    if kind == 3:
        return word().strip() + '5" pipe'                       # a quote inside unquoted text
    if kind == 4:
        return '"' + word() + f'""{sep}' + '"'
    if kind == 5:
        return '""'
    return word()


def text_of(rng, sep, end, rows):
    lines = [sep.join(["id", "a", "b", "c"])]
    for i in range(rows):
        lines.append(sep.join([f"r{i}", *[cell(rng, sep) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))]]))
        if rng.random() < 0.1:
            lines.append("")
    return end.join(lines) + (end if rng.random() < 0.7 else "")


def rows(frames):
    """The one-split parser writes \\r\\n inside quotes as \\n; the glued lines keep it as it stands."""
    same = lambda v: v and v.replace("\r\n", "\n")
    return sorted(((tuple(same(r[c]) for c in ("id", "a", "b", "c")), r["_corrupt"] is None) for f in frames for r in f.collect()), key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_many_splits_read_what_one_split_reads(spark, tmp_path, seed):
    rng = random.Random(seed)
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_bytes(text_of(rng, DELIMITERS[seed % 2], ["\n", "\r\n"][seed // 2 % 2], 60).encode())
    (tmp_path / "plain.csv").write_text("id;a;b;c\nr0;1;2;3\n" if seed % 2 == 0 else "id,a,b,c\nr0,1,2,3\n")
    one = rows(files.read_delimited(spark, str(tmp_path), DELIMITERS, multi_line=True))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([40, 90, 400])))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        frames = files.read_delimited(spark, str(tmp_path), DELIMITERS)
        many = rows(frames)
        tasks = max(f.rdd.getNumPartitions() for f in frames)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert many == one and len(one) > 100 and tasks > 3


def test_only_files_with_breaks_are_glued(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;x\n1;"a\nb"\n')
    (tmp_path / "b with space.csv").write_text('id;x\n1;"a;b"\n2;5" pipe\n')
    found = Q.broken_files(spark, files.export_files(spark, str(tmp_path)), ";")
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.csv"]
    frames = files.read_delimited(spark, str(tmp_path), DELIMITERS)
    assert sorted(tuple(r)[:2] for f in frames for r in f.collect()) == [("1", "a\nb"), ("1", "a;b"), ("2", '5" pipe')]


def test_export_order_follows_the_file_across_splits(spark, tmp_path):
    from tillrec.operators import validate as V
    text = "ID Transacao;Data/Hora;Valor Total;Forma de Pagamento;Obs\n" + "".join(
        f'P{i:03d};2026-03-05 10:00:00;1,00;pix;"line\nbreak {i}"\n' for i in range(80))
    (tmp_path / "pos.csv").write_text(text)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        v = V.validate(files.read_export(spark, str(tmp_path / "pos.csv"), POS), POS)
        valid = V.valid_rows(v, POS)
        got = [r["transaction_id"] for r in valid.orderBy(V.file_order(valid)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == [f"P{i:03d}" for i in range(80)]
