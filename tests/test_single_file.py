"""One ordered CSV file from parts joined in parallel."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from repsight.sources import single_file
from repsight.sources.single_file import can_join, header_line, write_ordered_csv, write_result_file


def _lines(path):
    with open(path, newline="") as f:
        return list(csv.reader(f, escapechar="\\"))


def test_rows_stand_in_order_under_one_header(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") * 7919 % 20_000).alias("place"), F.lit("a,b").alias("note")).repartition(7)
    path = str(tmp_path / "out.csv")
    write_ordered_csv(rows, path, [F.col("place").desc()], max_records_per_file=900)
    got = _lines(path)
    assert got[0] == ["id", "place", "note"]
    assert [int(r[1]) for r in got[1:]] == list(range(19_999, -1, -1)) and all(r[2] == "a,b" for r in got[1:])
    assert sorted(os.listdir(tmp_path)) == ["out.csv"]                      # no work folder, no stale checksum
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 20_000 and back.columns == ["id", "place", "note"]


def test_large_copies_and_unicode(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(single_file, "CHUNK", 1000)
    rows = spark.range(300).select("id", F.repeat(F.concat(F.lit("z\u00fc\u6c34"), F.col("id").cast("string")), 500).alias("text"))
    path = f"file://{tmp_path}/deep/er/out.csv"
    write_ordered_csv(rows, path, ["id"])
    got = _lines(tmp_path / "deep/er/out.csv")[1:]
    assert [r[1] for r in got] == [f"z\u00fc\u6c34{i}" * 500 for i in range(300)]


def test_an_existing_file_is_replaced_and_a_failed_run_leaves_it(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    write_ordered_csv(spark.range(5), path, ["id"])
    with pytest.raises(Exception, match="(?i)divi"):
        write_ordered_csv(spark.range(5).select((F.lit(1) / (F.col("id") - 3)).alias("x")), path, ["x"])
    assert [r[0] for r in _lines(path)] == ["id", "0", "1", "2", "3", "4"] and os.listdir(tmp_path) == ["out.csv"]
    write_ordered_csv(spark.range(2), path, [F.col("id").desc()])
    assert [r[0] for r in _lines(path)] == ["id", "1", "0"]


def test_empty_result_is_a_header(spark, tmp_path):
    write_ordered_csv(spark.range(0).selectExpr("id", "id as other"), str(tmp_path / "out.csv"), ["id"])
    assert _lines(tmp_path / "out.csv") == [["id", "other"]]


def test_header_is_the_one_of_the_writer(spark, tmp_path):
    names = ["plain", "a b", "a,b", 'a"b', " led", "a\\b"]
    frame = spark.createDataFrame([tuple("x" * len(names))], ", ".join(f"`{n}` string" for n in names))
    frame.coalesce(1).write.option("header", True).csv(str(tmp_path / "own"))
    part = next(f for f in os.listdir(tmp_path / "own") if f.endswith(".csv"))
    with open(tmp_path / "own" / part) as f:
        assert f.readline() == header_line(spark, names)


def test_folder_holds_the_file_alone(spark, tmp_path):
    folder = str(tmp_path / "m9")
    spark.range(50).write.csv(folder)
    write_result_file(spark.range(3), folder, ["id"])
    assert os.listdir(folder) == ["m9.csv"]


def test_part_numbers_beyond_their_padding():
    class Status:
        def __init__(self, name, size):
            self.name, self.size = name, size

        def getPath(self):
            return self

        def getName(self):
            return self.name

        def toString(self):
            return f"/x/{self.name}"

        def getLen(self):
            return self.size

    class Files:
        def listStatus(self, _):
            return [Status(n, s) for n, s in (("part-100000-u-c1-c000.csv", 1), ("part-99999-u-c1-c001.csv", 2), ("part-99999-u-c1-c000.csv", 3), ("part-00001-u-c1-c000.csv", 0), ("_SUCCESS", 0))]

    assert [s for _, s in single_file._parts(Files(), None)] == [3, 2, 1]


def test_file_systems(spark, tmp_path):
    assert can_join(spark, str(tmp_path)) and can_join(spark, f"file://{tmp_path}/new")
