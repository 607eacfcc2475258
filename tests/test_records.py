"""CSV records cut in parallel, against the csv module."""

from __future__ import annotations

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout.sources import records as rec, tables as src


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few dozen bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


CELLS = ["", "a", "x, y", 'say "so"', "two\nlines", '"', "a\n\n\nb", ",\n,", '"\n"', "é\r\nü", 'end"', "w" * 70, "\n" * 40, '""\n""']


def as_csv(rows, end):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize(("size", "end"), [(61, "\n"), (150, "\r\n")])
def test_any_cells_and_blocks(spark, tmp_path, small_blocks, size, end):
    rng = random.Random(size)
    rows = [["k", "one", "two"]] + [[f"r{i}", rng.choice(CELLS), rng.choice(CELLS)] for i in range(90)]
    (tmp_path / "t.csv").write_bytes(as_csv(rows, end).encode())
    small_blocks(size)
    lines = rec.file_lines(spark, [str(tmp_path / "t.csv")])
    assert lines.rdd.getNumPartitions() > 8
    found = rec.csv_records(spark, [str(tmp_path / "t.csv")]).collect()
    assert [next(csv.reader(io.StringIO(bytes(r.record).decode(), newline=""))) for r in found if r.first] == [rows[0]]
    got = sorted(next(csv.reader(io.StringIO(bytes(r.record).decode(), newline=""))) for r in found if not r.first)
    assert got == sorted(rows[1:])
    table = src.read_table(spark, str(tmp_path / "t.csv"))
    assert "multiLine=true" not in table._jdf.queryExecution().toString()
    assert sorted((r.k, r.one or "", r.two or "") for r in table.collect()) == sorted(map(tuple, rows[1:]))


def test_one_cell_over_many_blocks(spark, tmp_path, small_blocks):
    long = "line, of \"text\"\n" * 300
    rows = [["n", "head\nover lines"], ["1", long], ["2", "b"], ["3", long + "end"], ["4", "a\nb"]]
    (tmp_path / "t.csv").write_bytes(as_csv(rows, "\n").encode())
    small_blocks(400)
    df = src.read_table(spark, str(tmp_path / "t.csv"))
    assert df.columns == ["n", "head\nover lines"]
    assert [tuple(r) for r in df.orderBy("n").collect()] == [(int(a), b) for a, b in rows[1:]]


#: Quotes inside unquoted cells open nothing; signs after a closing quote belong to the cell.
STRAY = 'n,a,b\n1,5" pipe,x\n2,"two\nlines",5" y\n3,it"s "so",z\n\n4,"q ""r""\n",\n5,,"last\ncell"\n'


@pytest.mark.parametrize("size", [7, 1000])
def test_stray_quotes_like_pandas(spark, tmp_path, small_blocks, size):
    (tmp_path / "t.csv").write_text(STRAY)
    small_blocks(size)
    wanted = pd.read_csv(tmp_path / "t.csv").astype(object)
    wanted = [tuple(None if v != v else v for v in r) for r in wanted.itertuples(index=False)]
    assert [tuple(r) for r in src.read_table(spark, str(tmp_path / "t.csv")).orderBy("n").collect()] == wanted


def test_a_cell_never_closed_and_other_encodings(spark, tmp_path, small_blocks):
    small_blocks(30)
    (tmp_path / "open.csv").write_text('a,b\n1,"x\ny"\n2,"never\nclosed\n' + "z\n" * 30)
    found = rec.csv_records(spark, [str(tmp_path / "open.csv")]).where("not first").collect()
    assert sorted(bytes(r.record) for r in found) == [b'1,"x\ny"', b'2,"never\nclosed' + b"\nz" * 30]
    folder = tmp_path / "some.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes('a,b\n1,"é\nü"\n'.encode("utf-8-sig"))
    (folder / "b.csv").write_bytes('a,b\r\n2,"é\r\nü"\r\n'.encode("latin1"))
    (folder / "c.csv").write_bytes(b"a,b\r3,c\r4,d\r")
    df = src.read_table(spark, str(folder))
    assert [tuple(r) for r in df.orderBy("a").collect()] == [(1, "é\nü"), (2, "é\r\nü"), (3, "c"), (4, "d")]


def test_state_functions_are_chained_as_if_walked(spark):
    rng = random.Random(4)
    rows, wanted = [], []
    for f in range(20):
        state = owner = None
        for k in range(30):
            to = [rng.random() < 0.5, rng.random() < 0.5]
            begun = [True, rng.random() < 0.5]
            inside = bool(state)
            wanted.append((f"f{f}", k * 10, inside, owner))
            rows.append((f"f{f}", k * 10, int(to[0]), int(to[1]), *begun))
            owner = k * 10 if begun[inside] else owner
            state = to[inside]
    df = spark.createDataFrame(rows, "file string, block long, to0 int, to1 int, begun0 boolean, begun1 boolean").repartition(5)
    assert [tuple(r) for r in rec.block_starts(df).orderBy(F.length("file"), "file", "block").collect()] == wanted
