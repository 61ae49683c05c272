import gzip
import json
import shutil

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.readwriter import DataFrameWriter
from pyspark.sql.types import StructType

from sluicebox.sources import staged_lines
from sluicebox.sources.json_events import (
    batch_hours,
    infer_hour_schemas,
    infer_json_schema,
    list_types,
    merge_schemas,
    read_hours,
    read_json,
    read_type,
    read_types,
    type_schemas,
)
from sluicebox.sources.sinks import write_split
from sluicebox.sources.staged_lines import hour_lines, read_staged, stage_lines

# Parsing a schema text needs a session.
pytestmark = pytest.mark.usefixtures("spark")


def ddl(text):
    return StructType.fromDDL(text)


def test_inference_keeps_case_twins_and_drops_empty_objects(spark, write_lines):
    path = write_lines("a.json", [{"Ab": 1, "ab": 2, "e": {}, "n": None, "b": 12345678901234567890}])
    assert read_json(spark, path).schema.simpleString() == "struct<Ab:bigint,ab:bigint,b:decimal(20,0),n:string>"


def test_malformed_line_gives_no_field(spark, write_lines, tmp_path):
    write_lines("d/a.json", [{"event_type": "a"}, "{bad", '{"event_type":"b","x":'])
    schema = infer_json_schema(spark, [str(tmp_path / "d")])
    assert schema.simpleString() == "struct<event_type:string>"
    rows = read_json(spark, str(tmp_path / "d"), schema).collect()
    assert sorted(r.event_type or "" for r in rows) == ["", "", "a"]


def test_schema_on_read(spark, write_lines):
    path = write_lines("a.json", ['{"a":1.5,"b":{"q":1},"s":{"x":"bad","y":"k"},"other":1}', '{"b":5}', "{broken"])
    schema = ddl("a bigint, b string, s struct<x: bigint, y: string>, absent int")
    first, second, third = read_json(spark, path, schema).collect()
    assert (first.a, first.b, tuple(first.s), first.absent) == (None, '{"q":1}', (None, "k"), None)
    assert (second.a, second.b, second.s) == (None, "5", None)
    assert all(value is None for value in third)


def test_merged_schemas():
    left, right = ddl("a bigint, s struct<x: int>, l array<struct<x: int>>"), ddl("b string, s struct<y: int>, l array<struct<y: int>>")
    assert merge_schemas(left, right).simpleString() == (
        "struct<a:bigint,b:string,l:array<struct<x:int,y:int>>,s:struct<x:int,y:int>>"
    )
    assert merge_schemas(ddl("a bigint"), ddl("a double")) is None
    assert merge_schemas(ddl("s struct<x: int>"), ddl("s string")) is None
    assert merge_schemas(ddl("l array<int>"), ddl("l array<string>")) is None


def test_hours_are_batched_while_types_and_names_agree():
    schemas = {
        "00": ddl("a bigint, awsAccountId string"),
        "01": ddl("a double, awsAccountId bigint"),
        "02": ddl("a bigint, b string, awsAccountId double"),
        "03": ddl("platform string"),
        "04": ddl("device struct<platform: struct<name: string>>"),
    }
    batches = [(hours, schema.simpleString()) for hours, schema in batch_hours(schemas)]
    assert batches == [
        (["00", "02", "03"], "struct<a:bigint,b:string,platform:string>"),
        (["01", "04"], "struct<a:double,device:struct<platform:struct<name:string>>>"),
    ]


def test_hours_come_from_the_path(spark, write_lines, tmp_path):
    write_lines("raw/2018/06/01/00/a.json", [{"x": 1}])
    write_lines("raw/2018/06/01/01/deeper/b.json", [{"x": 2, "y": "t"}])
    write_lines("raw/2018/06/01/02/c.json", [{"x": 3}])
    write_lines("raw/2018/06/02/00/d.json", [{"x": 4}])
    root = str(tmp_path / "raw") + "/"
    schemas = infer_hour_schemas(spark, root, "20180601", ["00", "01"])
    assert {hour: schema.names for hour, schema in schemas.items()} == {"00": ["x"], "01": ["x", "y"]}
    rows = read_hours(spark, root, "20180601", ["00", "01"], ddl("x bigint")).collect()
    assert sorted((r.hh, r.x) for r in rows) == [("00", 1), ("01", 2)]
    with pytest.raises(ValueError):
        read_hours(spark, root, "20180601", ["00"], ddl("hh string"))
    with pytest.raises(AnalysisException):
        read_hours(spark, root, "20180601", ["05"], ddl("x bigint"))


def test_gzip_is_read(spark, tmp_path):
    folder = tmp_path / "2018/06/01/00"
    folder.mkdir(parents=True)
    with gzip.open(folder / "a.gz", "wt") as out:
        out.write(json.dumps({"x": 1}) + "\n")
    assert read_hours(spark, str(tmp_path), "20180601", ["00"], ddl("x bigint")).first().x == 1


def test_split_by_type_and_back(spark, tmp_path):
    rows = [("c:d/e%", 1, None), ("view", None, 2.5), ("007", 3, None), ("view", None, 3.5), ("", 4, None)]
    df = spark.createDataFrame(rows, "event_type string, x bigint, y double")
    path = str(tmp_path / "split")
    write_split(df, path)
    assert [r.et for r in list_types(spark, path).collect()] == [None, "007", "c:d/e%", "view"]
    assert read_type(spark, path, "view").schema.simpleString() == "struct<event_type:string,y:double>"
    assert read_type(spark, path, "c:d/e%").collect()[0].asDict() == {"event_type": "c:d/e%", "x": 1}
    assert {et: scan.count() for et, scan in read_types(spark, path).items()} == {"": 1, "007": 1, "c:d/e%": 1, "view": 2}
    files = list((tmp_path / "split" / "et=view").glob("*.json.gz"))
    assert files
    lines = [json.loads(line) for file in files for line in gzip.open(file, "rt")]
    assert sorted(lines, key=str) == [{"event_type": "view", "y": 2.5}, {"event_type": "view", "y": 3.5}]
    with pytest.raises(AnalysisException):
        write_split(df, path)


def test_listing_types_reads_no_content(spark, tmp_path):
    path = str(tmp_path / "split")
    write_split(spark.createDataFrame([("a", 1)], "event_type string, x int"), path)
    plan = list_types(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "ReadSchema: struct<>" in plan
    assert spark.conf.get("spark.sql.sources.partitionColumnTypeInference.enabled") == "true"


LINES = {
    "a": [{"x": 1, "s": {"q": 1, "e": {}}}, {"x": 2.5, "s": {"r": [1, None]}}],
    "whole": [{"x": 1}, {"x": 1.0}],
    "point": [{"x": 1.0, "l": [2.0]}],
    "big": [{"x": 12345678901234567890}, {"x": 1}],
    "mixed": [{"x": 1, "y": None, "z": True}, {"x": {"k": 1}, "z": "t"}],
    "odd": ['{"x":1}', "{'y':2}", '{"z":NaN}', "{broken", "   ", '[{"w":1},{"w":2}]'],
    "007": [{"x": "1"}],
}


def test_types_are_inferred_in_one_pass_as_the_reader_would(spark, write_lines, tmp_path):
    for kind, lines in LINES.items():
        write_lines(f"split/et={kind}/a.json", lines)
    path = str(tmp_path / "split")
    found = type_schemas(spark, path)
    assert list(found) == sorted(LINES)
    for kind, schema in found.items():
        alone = infer_json_schema(spark, [f"{path}/et={kind}"])
        assert schema.simpleString() == alone.simpleString(), kind
    rows = read_types(spark, path)["odd"].collect()
    assert len(rows) == 6 and {r.w for r in rows} == {None, 1, 2}


def test_many_types_cost_as_many_jobs_as_few(spark, write_lines, tmp_path):
    jobs = []
    for name, kinds in (("few", 2), ("many", 60)):
        for kind in range(kinds):
            write_lines(f"{name}/et=t{kind}/a.json", [{"event_type": f"t{kind}", f"f{kind}": kind}])
        spark.sparkContext.setJobGroup(name, name)
        found = type_schemas(spark, str(tmp_path / name))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        assert {k: s.names for k, s in found.items()} == {f"t{k}": ["event_type", f"f{k}"] for k in range(kinds)}
    assert jobs[1] <= jobs[0] + 1, jobs  # listing more than 32 folders may be a job


def test_staged_hours_are_read_once_and_as_the_reader_would(spark, write_lines, tmp_path):
    hours = {f"{i:02d}": kind for i, kind in enumerate([*LINES, "empty"])}
    for hour, kind in hours.items():
        write_lines(f"raw/2018/06/01/{hour}/a.json", LINES.get(kind, [""]))
    root, folder = str(tmp_path / "raw"), str(tmp_path / "staged")
    want = infer_hour_schemas(spark, root, "20180601", list(hours))
    rows = {h: read_hours(spark, root, "20180601", [h], want[h]) for h in hours if want[h].fields}
    rows = {hour: sorted(map(str, df.collect())) for hour, df in rows.items()}
    staged = stage_lines(hour_lines(spark, root, "20180601", list(hours)), list(hours), folder)
    assert {h: s.simpleString() for h, s in staged.schemas.items()} == {h: s.simpleString() for h, s in want.items()}
    shutil.rmtree(root)
    for hour, expected in rows.items():
        found = read_staged(spark, staged, [hour], want[hour])
        assert sorted(map(str, found.collect())) == expected
    assert read_staged(spark, staged, ["23"], want["00"]).collect() == []
    with pytest.raises(ValueError):
        read_staged(spark, staged, ["00"], ddl("hh string"))


def test_staging_parses_each_line_once_for_its_types(spark, write_lines, tmp_path, monkeypatch):
    """The write moves text only, whatever the number of hours, and the reader infers each hour once."""
    hours, plans, inferred = [f"{i:02d}" for i in range(12)], [], []
    for hour in hours:
        write_lines(f"raw/2018/06/01/{hour}/a.json", [{"event_type": "a", f"f{hour}": 1}, {"event_type": "b", "x": "t"}])
    real_text, real_infer = DataFrameWriter.text, staged_lines.infer_json_schema

    def text(writer, path, *args, **options):
        plans.append(writer._df._jdf.queryExecution().executedPlan().toString())
        return real_text(writer, path, *args, **options)

    monkeypatch.setattr(DataFrameWriter, "text", text)
    monkeypatch.setattr(staged_lines, "infer_json_schema", lambda s, p: (inferred.extend(p), real_infer(s, p))[1])
    folder = str(tmp_path / "staged")
    staged = stage_lines(hour_lines(spark, str(tmp_path / "raw"), "20180601", hours), hours, folder)
    assert len(plans) == 1 and "parseJson" not in plans[0] and "CollectMetrics" not in plans[0]
    assert sorted(inferred) == [f"{folder}/HOUR={hour}" for hour in hours]
    assert {h: s.names for h, s in staged.schemas.items()} == {h: ["event_type", f"f{h}", "x"] for h in hours}
