"""Text and spreadsheet sources and sinks."""

import pytest
from pyspark.errors import PySparkException

from loomgraph.sources import text, xlsx


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body, encoding="utf-8")
    return str(p)


def test_lenient_edges(spark, tmp_path):
    p = write(tmp_path, "e.txt", "1 2\n\n 3\n4 5 6\n1 2\n7 7\n")
    assert sorted(map(tuple, text.read_edges(spark, p).collect())) == [(1, 2), (1, 2), (4, 5), (7, 7)]
    with pytest.raises(PySparkException):
        text.read_edges(spark, write(tmp_path, "x.txt", "a b\n")).collect()


def test_strict_edges(spark, tmp_path):
    p = write(tmp_path, "e.txt", "1 2\n2 1\n1 2\n3 3\n")
    assert sorted(map(tuple, text.read_edges(spark, p, strict=True, n=3).collect())) == [(1, 2), (2, 1)]
    assert sorted(map(tuple, text.read_edges(spark, write(tmp_path, "f.txt", "1 9\n"), strict=True, flip=True).collect())) == [(9, 1)]
    for body in ("0 1\n", "1 4\n", "1\n", "1 x\n"):
        with pytest.raises(PySparkException):
            text.read_edges(spark, write(tmp_path, "bad.txt", body), strict=True, n=3).collect()


def test_tables(spark, tmp_path):
    p = write(tmp_path, "m.csv", 'FirmID;Sector\nFirm_1;"12.0"\nFirm_2;7\n')
    assert [tuple(r) for r in text.read_mapping(spark, p).orderBy("firm_id").collect()] == [("Firm_1", "12"), ("Firm_2", "7")]
    p = write(tmp_path, "s.csv", "Firm_ID,Size\nFirm_1,3.5\nFirm_2,-1\nFirm_3,\n")
    assert [r["size"] for r in text.read_strength(spark, p).orderBy("firm_id").collect()] == [3.5, 0.0, 0.0]
    with pytest.raises(ValueError):
        text.read_mapping(spark, p)
    assert text.delimiter("a\tb\tc,d") == "\t" and text.delimiter("abc") == ","


def test_matrix(spark, tmp_path):
    p = write(tmp_path, "iot.csv", '﻿sep=;\n\nx;"1.0";2\n1;0,5;-3\n2;4;\n')
    got = {(r["k"], r["l"]): r["value"] for r in text.read_matrix(spark, p).collect()}
    assert got == {("1", "1"): 0.0, ("1", "2"): 0.0, ("2", "1"): 4.0, ("2", "2"): 0.0}
    # fewer rows than columns: cut to the sectors that have one
    assert [tuple(r) for r in text.read_matrix(spark, write(tmp_path, "r.csv", "x,1,2\n1,4,1\n")).collect()] == [("1", "1", 4.0)]
    # quoted names may hold the delimiter, and quotes
    p = write(tmp_path, "q.csv", 'x, "Agri, forestry","B ""b""" \n"1, a",1,2\n2, 3 ,"4"\n')
    assert {(r["k"], r["l"]): r["value"] for r in text.read_matrix(spark, p).collect()} == {("Agri, forestry", "Agri, forestry"): 1.0, ("Agri, forestry", 'B "b"'): 2.0, ('B "b"', "Agri, forestry"): 3.0, ('B "b"', 'B "b"'): 4.0}
    with pytest.raises(PySparkException, match="fewer cells"):
        text.read_matrix(spark, write(tmp_path, "s.csv", "x,1,2\n1,4,1\n2,1\n")).collect()
    with pytest.raises(ValueError):
        text.read_matrix(spark, write(tmp_path, "e.csv", "\n"))


def test_network_money_sectors(spark, tmp_path):
    p = write(tmp_path, "n.txt", "# c\n2,3,1,3,0\n\n1,2\n")
    rows = {r["buyer"]: r["suppliers"] for r in text.read_network(spark, p).collect()}
    assert rows == {1: [2], 2: [1, 3]}
    text.write_lines(text.network_lines(text.read_network(spark, p)), str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1,2", "2,1,3"]
    m = text.read_money(spark, write(tmp_path, "m.txt", "1,5\n1,7\n2,-3\n9,1\n"), top=5)
    assert {r["id"]: r["size"] for r in m.collect()} == {1: 7.0, 2: 0.0}
    s, every = text.read_sectors(spark, write(tmp_path, "s.txt", "1,30\n1,10\n2,20\n"))
    assert {r["id"]: r["sector"] for r in s.collect()} == {1: 10, 2: 20} and [r[0] for r in every.collect()] == [10, 20, 30]
    assert text.read_deltas(spark, str(tmp_path / "none.txt")).count() == 0
    with pytest.raises(FileNotFoundError):
        text.exists(spark, str(tmp_path / "none.txt"))
    assert text.read_deltas(spark, write(tmp_path, "d.txt", "3,0.5\n")).first()["delta"] == 0.5


def test_weights_round_trip(spark, tmp_path):
    w = spark.createDataFrame([(1, 2, 0.1 + 0.2)], "buyer long, seller long, weight double")
    text.write_weights(w, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w"), header=True, schema="buyer long, seller long, weight double").first()["weight"] == 0.1 + 0.2


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("Firm_1", 2.5, "a<b&c"), ("Firm_2", None, None)], "Firm_ID string, ` Size` double, note string")
    p = str(tmp_path / "t.xlsx")
    xlsx.write_table(df, p)
    back = xlsx.read_table(spark, p)
    assert back.columns == ["Firm_ID", "Size", "note"]
    assert sorted(map(tuple, back.collect())) == [("Firm_1", "2.5", "a<b&c"), ("Firm_2", None, None)]
    m = spark.createDataFrame([("10", 1.0, 2.0), ("20", 3.0, None)], "sector string, `10` double, `20` double")
    xlsx.write_table(m, str(tmp_path / "m.xlsx"))
    got = {(r["k"], r["l"]): r["value"] for r in xlsx.read_matrix(spark, str(tmp_path / "m.xlsx")).collect()}
    assert got == {("10", "10"): 1.0, ("10", "20"): 2.0, ("20", "10"): 3.0, ("20", "20"): 0.0}


def test_a_sheet_of_many_rows_is_a_folder(spark, tmp_path):
    df = spark.range(2500, numPartitions=3).selectExpr("id", "concat('F<', id, '>') as name", "if(id % 3 = 0, null, id / 8) as size")
    path = str(tmp_path / "many.xlsx")
    xlsx.write_table(df, path, rows=300)
    assert len(list((tmp_path / "many.xlsx").glob("part-*.xlsx"))) >= 9
    back = xlsx.read_table(spark, path).selectExpr("cast(id as long) id", "name", "cast(size as double) size")
    assert sorted(back.collect()) == sorted(df.collect())
    xlsx.write_table(df.limit(3), path, rows=300)  # in the folder's place
    assert xlsx.read_table(spark, path).count() == 3
