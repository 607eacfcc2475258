from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tabscout.sources import tables as src


def write(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_types_tokens_and_header(spark, tmp_path):
    path = write(tmp_path, ' id , ,name,price,ok,name\n1,a,"x, ""y""",1.5,True,p\n'
                           '2,NA,null,N/A,false,q\n\n3,b,"two\nlines",7,,r\n')
    df = src.read_table(spark, path)
    assert df.columns == ["id", "Column 2", "name", "price", "ok", "name.1"]
    assert [t for _, t in df.dtypes] == ["bigint", "string", "string", "double", "boolean", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, "a", 'x, "y"', 1.5, True, "p"), (2, None, None, None, False, "q"),
        (3, "b", "two\nlines", 7.0, None, "r")]


def test_csv_encodings(spark, tmp_path):
    assert src.read_table(spark, write(tmp_path, "a,b\né,1\n")).first().a == "é"
    assert src.read_table(spark, write(tmp_path, "a,b\né,1\n", "utf-8-sig")).columns == ["a", "b"]
    assert src.read_table(spark, write(tmp_path, "a,b\né,1\n", "latin1")).first().a == "é"


def test_blank_header_cell(spark, tmp_path):
    assert src.read_table(spark, write(tmp_path, ",a\n1,2\n")).columns == ["Unnamed: 0", "a"]


def test_plain_csv_stays_splittable(spark, tmp_path):
    df = src.read_table(spark, write(tmp_path, 'a,b\n"x",1\n'))
    assert "multiLine=true" not in df._jdf.queryExecution().toString()


def test_each_file_has_its_own_mode(spark, tmp_path):
    folder = tmp_path / "many files.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("Name,size,name\né,1,x\n".encode())
    (folder / "b.csv").write_bytes("Name,size,name\nü,2,y\n".encode("latin1"))
    (folder / "c.csv").write_bytes('Name,size,name\n5" pipe,3,z\n'.encode())
    (folder / "d.csv").write_bytes('Name,size,name\n"two\nlines",4,z\n'.encode())
    df = src.read_table(spark, str(folder), save_to=str(tmp_path / "t.parquet"))
    assert df.columns == ["Name", "size", "name.1"]
    assert [r.Name for r in df.orderBy("size").collect()] == ["é", "ü", '5" pipe', "two\nlines"]
    assert "csv" not in df._jdf.queryExecution().executedPlan().toString().lower().replace("many files.csv", "")
    modes = src._csv_modes(spark, str(folder))
    assert {k: [f[-5:] for f in v] for k, v in modes.items()} == {
        (True, False): ["a.csv", "c.csv"], (False, False): ["b.csv"], (True, True): ["d.csv"]}


def test_empty_tables_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        src.read_table(spark, write(tmp_path, "a,b\n"))
    spark.createDataFrame([], "a int").write.parquet(str(tmp_path / "e.parquet"))
    with pytest.raises(ValueError, match="no rows"):
        src.read_table(spark, str(tmp_path / "e.parquet"))


def test_parquet_round_trip_and_meta(spark, tmp_path):
    df = spark.range(7).withColumn("b", F.lit("x"))
    src.save_table(df, str(tmp_path / "t.parquet"))
    back = src.read_table(spark, str(tmp_path / "t.parquet"))
    assert back.count() == 7
    assert tuple(src.table_meta(back, "t").first()) == ("t", 7, 2)


def test_preview_orders(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 2)
    assert [r.id for r in src.preview(df, 3, ["id"]).collect()] == [0, 1, 2]
    one, other = src.preview(df, 25), src.preview(df.repartition(13), 25)
    assert sorted(r.id for r in one.collect()) == sorted(r.id for r in other.collect())


def test_json_rows(spark):
    df = spark.sql("SELECT double('NaN') AS a, double('inf') AS b, 1.5D AS c, "
                   "TIMESTAMP_NTZ'2024-01-05 10:00:00' AS d, DATE'2024-01-05' AS e, "
                   "CAST(NULL AS string) AS f")
    assert json.loads(src.to_json_rows(df).first().json) == {
        "a": None, "b": None, "c": 1.5, "d": "2024-01-05T10:00:00", "e": "2024-01-05", "f": None}
