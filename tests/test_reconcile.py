"""Types that hold several types, and reads across directories whose types differ."""

import itertools
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, NullType, StructType

from sluicebox.functions.types import common_schema, common_type, widen
from sluicebox.plans.preprocess import Narrowed, preprocess_day, read_published
from sluicebox.sources.reconcile import read_reconciled, schema_classes

pytestmark = pytest.mark.usefixtures("spark")

VALUES = ["1", "2.5", "12345678901234567890", "true", '"t"', "[1]", "[2.5]", '["t"]', '{"a":1}', '{"a":"t","b":2}', '[{"a":1}]']


def ddl(text):
    return DataType.fromDDL(text)


@pytest.mark.parametrize("left,right", itertools.combinations(range(len(VALUES)), 2))
def test_types_widen_as_the_json_reader_widens_them(spark, write_lines, left, right):
    lines = ['{"x":%s}' % VALUES[i] for i in (left, right)]
    alone = [spark.read.json(write_lines(f"{i}.json", [line])).schema for i, line in enumerate(lines)]
    both = spark.read.json(write_lines("both.json", lines)).schema
    assert common_schema(alone).simpleString() == both.simpleString()
    assert common_schema(alone[::-1]).simpleString() == both.simpleString()


def test_types_that_json_does_not_have():
    assert common_type(ddl("int"), ddl("bigint")) == ddl("bigint")
    assert common_type(ddl("decimal(10,2)"), ddl("decimal(12,4)")) == ddl("decimal(12,4)")
    assert common_type(ddl("decimal(38,0)"), ddl("decimal(10,5)")) == ddl("double")
    assert common_type(NullType(), ddl("date")) == common_type(ddl("date"), NullType()) == ddl("date")
    assert common_type(ddl("date"), ddl("bigint")) == ddl("string")
    assert common_type(ddl("map<string,int>"), ddl("map<string,double>")) == ddl("map<string,double>")
    assert common_type(ddl("map<string,int>"), ddl("array<int>")) == ddl("string")


def test_widened_values(spark):
    found, wanted = ddl("struct<a: int, l: array<int>>"), ddl("struct<a: string, b: int, l: array<double>>")
    df = spark.createDataFrame([((1, [2, None]),), ((None, None),), (None,)], StructType().add("s", found))
    rows = [row[0] for row in df.select(widen(F.col("s"), found, wanted)).collect()]
    assert [row and (row[0], row[1], row[2]) for row in rows] == [("1", None, [2.0, None]), (None, None, None), None]
    text = [row[0] for row in df.select(widen(F.col("s"), found, ddl("string"))).collect()]
    assert [t and json.loads(t) for t in text] == [{"a": 1, "l": [2, None]}, {}, None]


def test_classes_are_as_few_as_the_types_at_odds(spark):
    schemas = {f"{i}": ddl(f"struct<x: {'bigint' if i % 2 else 'string'}, f{i}: int>") for i in range(50)}
    classes = schema_classes(schemas)
    assert sorted(len(paths) for paths, _ in classes) == [25, 25]
    assert all(f"f{p}" in schema.names for paths, schema in classes for p in paths)
    assert schema_classes({}) == []


def write(spark, path, text, schema):
    spark.createDataFrame(text, schema).write.parquet(str(path))


def test_directories_at_odds_are_one_table(spark, tmp_path):
    write(spark, tmp_path / "d/1", [(1, None), (None, 5)], "x bigint, y int")
    write(spark, tmp_path / "d/2", [("t", 1.5)], "x string, z double")
    write(spark, tmp_path / "d/3", [([1], True)], "x array<bigint>, `odd name.` boolean")
    df = read_reconciled(spark, [str(tmp_path / "d/*")], lambda d: d.withColumn("file", F.col("_metadata.file_name")))
    assert df.schema["x"].dataType.simpleString() == "string" and df.columns == ["odd name.", "x", "y", "z", "file"]
    rows = sorted((str(r.x), r.y, r.z, r["odd name."]) for r in df.collect())
    assert rows == [("1", None, None, None), ("None", 5, None, None), ("[1]", None, None, True), ("t", None, 1.5, None)]
    plan = df.where("z > 1").select("z")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<z:double" in plan and "x:" not in plan


def test_directories_that_agree_are_one_scan(spark, tmp_path):
    write(spark, tmp_path / "d/1", [(1, 2)], "x bigint, y int")
    write(spark, tmp_path / "d/2", [(3, "t")], "x bigint, z string")
    df = read_reconciled(spark, [str(tmp_path / "d/*")])
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted((r.x, r.y, r.z) for r in df.collect()) == [(1, 2, None), (3, None, "t")]


def event(i, version, **fields):
    return {"event_type": "a", "event_id": i, "application": {"version_name": version}, **fields}


@pytest.mark.parametrize("publish", ["move", "run"])
def test_day_at_odds_is_read_and_what_narrowing_takes_is_counted(spark, write_lines, tmp_path, publish):
    big = 12345678901234567890
    lines = {
        "00": [event(1, "1.0.0", x=big, old="t", l=[big]), event(2, "2.0.0", x=7, l=[1]), event(3, "1.0.0", old="u")],
        "01": [event(4, "2.0.0", x="t")],
        "02": [event(5, "2.0.0", x=2.5)],
    }
    for hour, records in lines.items():
        write_lines(f"raw/2018/06/01/{hour}/a.json", records)
    source, target = str(tmp_path / "raw"), str(tmp_path / "events")
    done = preprocess_day(spark, "20180601", source, target, hours=range(3), publish=publish)
    assert done.narrowed == [
        Narrowed("00", "a", "l", "misfit", 1),
        Narrowed("00", "a", "old", "dropped", 2),
        Narrowed("00", "a", "x", "misfit", 1),
    ]
    df = read_published(spark, target, "20180601", place=True)
    assert df.schema["x"].dataType.simpleString() == "string"
    rows = sorted((r.event_id, r.x, r.et, r.hh) for r in df.collect())
    assert rows == [(1, None, "a", "00"), (2, "7", "a", "00"), (3, None, "a", "00"), (4, "t", "a", "01"), (5, "2.5", "a", "02")]
    assert read_published(spark, target, "20180601", hour="02").first().x == 2.5
