import os
import random
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from sluicebox.functions.predicates import VERSION_PATTERN
from sluicebox.plans import preprocess
from sluicebox.plans.preprocess import narrow_hour, preprocess_day, read_published, split_events, split_hour
from sluicebox.sources import layout
from sluicebox.sources.json_events import read_types
from sluicebox.sources.sinks import write_split

DAY = "20180601"


@pytest.fixture
def raw(write_lines, tmp_path):
    """Write hours of raw events; gives the source folder, with a final slash."""

    def write(**hours):
        for hour, records in hours.items():
            write_lines(f"raw/2018/06/01/{hour[1:]}/events.json", records)
        return f"{tmp_path}/raw/"

    return write


def event(kind, i, version="1.0.0", **fields):
    return {"event_type": kind, "event_id": i, "application": {"version_name": version}, **fields}


def published(spark, target):
    """Schema and rows of every published directory."""
    base = Path(target, "2018/06/01")
    found = {}
    for folder in base.glob("*/*"):
        df = spark.read.parquet(str(folder))
        found[f"{folder.parent.name}/{folder.name}"] = (
            df.schema.simpleString().removeprefix("struct<").removesuffix(">"),
            sorted((tuple(r) for r in df.collect()), key=str),
        )
    return found


def run(spark, source, target, hours, **options):
    return preprocess_day(spark, DAY, source, target, hours=hours, order_by=["event_id"], **options)


def test_each_hour_and_type_has_its_own_schema(spark, raw, tmp_path):
    source = raw(
        h00=[
            event("view", 1, x=1, platform="p"),
            event("view", 2, "0.9.0", y=1.5),
            event("click", 3, device={"make": "m"}),
            event("Event1", 4),
            event("bad_type", 5),
            {"event_id": 6},
            "{broken",
            event("old", 7, "dev"),
            event("old", 8, None),
        ],
        h01=[event("view", 9, x=1.5), event("view", 10, x=2, awsAccountId="1", Caps=2)],
    )
    target = str(tmp_path / "events")
    moved = run(spark, source, target, [0, 1])
    assert [m.removeprefix(f"{target}/2018/06/01/") for m in moved] == ["click/00", "view/00", "view/01"]
    assert published(spark, target) == {
        "view/00": (
            "app_version_name:string,event_id:bigint,event_type:string,platform:string,x:bigint",
            [("0.9.0", 2, "view", None, None), ("1.0.0", 1, "view", "p", 1)],
        ),
        "click/00": (
            "app_version_name:string,event_id:bigint,event_type:string,make:string",
            [("1.0.0", 3, "click", "m")],
        ),
        "view/01": (
            "app_version_name:string,event_id:bigint,event_type:string,x:double",
            [("1.0.0", 10, "view", 2.0), ("1.0.0", 9, "view", 1.5)],
        ),
    }
    assert sorted(p.name for p in Path(target).iterdir()) == ["2018"]
    assert {r.event_id for r in read_published(spark, target, DAY, "view", "00").collect()} == {1, 2}


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_runs_and_moved_output_agree(spark, raw, tmp_path):
    source = raw(h00=random_hour(5), h01=random_hour(6))
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    moved = run(spark, source, one, [0, 1])
    for _ in range(3):
        run(spark, source, two, [0, 1], publish="run")
    for path in moved:
        kind, hour = path.removeprefix(f"{one}/2018/06/01/").split("/")
        found = read_published(spark, two, DAY, kind, hour)
        want = spark.read.parquet(path)
        assert found.schema.simpleString() == want.schema.simpleString() and rows_of(found) == rows_of(want)
    assert len(list(Path(two, "2018/06/01").glob("run-*"))) == 2
    with pytest.raises(ValueError, match="publish"):
        run(spark, source, two, [0], publish="later")


@pytest.mark.parametrize("first", [0, 1])
@pytest.mark.parametrize("module, step", [(preprocess, "switch_current"), (layout, "_create_manifest")])
def test_runs_that_overlap_keep_each_others_hours(spark, raw, tmp_path, monkeypatch, first, module, step):
    """A whole run of the other hour ends when the first has written its folder, or when the first has read what is
    current and is about to say what will be."""
    target, folder = str(tmp_path / "events"), tmp_path / "events/2018/06/01"
    source = raw(h00=[event("a", 1), event("b", 2)], h01=[event("a", 3)])
    real, waiting = getattr(module, step), [1 - first]

    def after_the_other(*args):
        if waiting:
            run(spark, source, target, [waiting.pop()], publish="run")
        return real(*args)

    monkeypatch.setattr(module, step, after_the_other)
    run(spark, source, target, [first], publish="run")
    assert not waiting and sorted(r.event_id for r in read_published(spark, target, DAY).collect()) == [1, 2, 3]
    current = layout.read_current(spark, str(folder))
    assert set(current) == {"00", "01"} and set(current.values()) <= {p.name for p in folder.glob("run-*")}
    assert sorted(p.name for p in folder.glob("_current*")) == ["_current.1", "_current.2"]


def test_a_number_is_given_once(spark, tmp_path):
    folder = str(tmp_path / "day")
    Path(folder, "run-a").mkdir(parents=True)
    layout.switch_current(spark, folder, ["00"], "run-a")
    assert not layout._create_manifest(spark, folder, 1, {"00": "run-b"})
    assert layout.read_current(spark, folder) == {"00": "run-a"} and not list(Path(folder).glob("_new*"))
    with pytest.raises(FileNotFoundError, match="nothing was published"):
        layout.switch_current(spark, folder, ["01"], "run-gone")


def test_leases_protect_runs_that_are_written(spark, tmp_path):
    folder = tmp_path / "day"
    for name in ("run-a", "run-b", "run-c", "run-live", "run-dead"):
        (folder / name).mkdir(parents=True)
        layout.touch_lease(spark, str(folder / name))
    for name in ("run-a", "run-b", "run-c"):
        layout.switch_current(spark, str(folder), ["00"], name)
    os.utime(folder / "run-dead" / "_lease", (1, 1))
    layout.remove_runs(spark, str(folder))
    assert sorted(p.name for p in folder.glob("run-*")) == ["run-b", "run-c", "run-live"]
    assert sorted(p.name for p in folder.glob("_current*")) == ["_current.2", "_current.3"]


def test_a_run_that_is_gone_is_an_error(spark, raw, tmp_path):
    target = str(tmp_path / "events")
    run(spark, raw(h00=[event("a", 1)], h01=[event("a", 3)]), target, [0, 1], publish="run")
    folder = next((tmp_path / "events/2018/06/01").glob("run-*"))
    folder.rename(folder.with_name("moved"))
    with pytest.raises(FileNotFoundError, match="gone"):
        read_published(spark, target, DAY)


def test_a_run_replaces_its_hours_at_once(spark, raw, tmp_path, monkeypatch):
    target = str(tmp_path / "events")
    run(spark, raw(h00=[event("a", 1), event("b", 2)], h01=[event("a", 3)]), target, [0, 1], publish="run")
    events = lambda: sorted(r.event_id for r in read_published(spark, target, DAY).collect())
    assert events() == [1, 2, 3]
    source = raw(h00=[event("a", 4)])

    def stop(*args, **kwargs):
        raise RuntimeError("stopped")

    for step in ("write_parquet", "switch_current"):
        monkeypatch.setattr(preprocess, step, stop)
        with pytest.raises(RuntimeError):
            run(spark, source, target, [0], publish="run")
        monkeypatch.undo()
        assert events() == [1, 2, 3] and len(list(Path(target, "2018/06/01").glob("run-*"))) == 1
    monkeypatch.setattr(preprocess, "remove_runs", stop)
    with pytest.raises(RuntimeError):
        run(spark, source, target, [0], publish="run")
    monkeypatch.undo()
    assert events() == [3, 4]
    with pytest.raises(FileNotFoundError):
        read_published(spark, target, DAY, "b", "00")


def test_types_narrow_as_they_do_through_files(spark, raw, tmp_path):
    big = 12345678901234567890
    source = raw(
        h00=[
            event("a", 1, "1.0.0", d=big, l=[1, 2], m={"q": 1}),
            event("a", 2, "2.0.0", d=7, l=[], m=5),
        ]
    )
    target = str(tmp_path / "events")
    run(spark, source, target, [0])
    assert published(spark, target)["a/00"] == (
        "app_version_name:string,d:bigint,event_id:bigint,event_type:string,l:array<string>,m:string",
        [("1.0.0", None, 1, "a", ["1", "2"], '{"q": 1}'), ("2.0.0", 7, 2, "a", [], "5")],
    )


def test_wide_layout(spark, raw, tmp_path):
    source = raw(h00=[event("view", 1, x=1), event("view", 2, "0.9.0", y=1.5)], h01=[event("c:d", 3, y=2.5)])
    target = str(tmp_path / "events")
    for _ in range(2):
        assert run(spark, source, target, [0, 1], layout="wide") == []
    schema = "event_type string, event_id bigint, app_version_name string, x bigint, y double, dt string, et string, hh string"
    rows = spark.read.schema(schema).parquet(target).collect()
    assert sorted((r.event_id, r.event_type, r.x, r.y, r.dt, r.et, r.hh) for r in rows) == [
        (1, "view", 1, None, DAY, "view", "00"),
        (2, "view", None, None, DAY, "view", "00"),
        (3, "c:d", None, 2.5, DAY, "c:d", "01"),
    ]


def test_odd_type_names(spark, raw, tmp_path):
    source = raw(h00=[event(kind, i) for i, kind in enumerate(["c:d/e%", "", "a b", "a,b", "a_b", "007"])])
    target = str(tmp_path / "events")
    run(spark, source, target, [0])
    found = {folder: rows[0][2] for folder, (_, rows) in published(spark, target).items()}
    assert found == {"c%3Ad%2Fe%25/00": "c:d/e%", "__HIVE_DEFAULT_PARTITION__/00": "", "007/00": "007"}


def test_rerun_replaces(spark, raw, tmp_path):
    target = str(tmp_path / "events")
    source = raw(h00=[event("a", 1), event("b", 2)])
    run(spark, source, target, [0])
    first = published(spark, target)
    run(spark, source, target, [0])
    assert published(spark, target) == first
    raw(h00=[event("a", 3)])
    run(spark, source, target, [0])
    after = published(spark, target)
    assert after == {"a/00": ("app_version_name:string,event_id:bigint,event_type:string", [("1.0.0", 3, "a")])}


def test_nothing_is_published_if_an_hour_fails(spark, raw, tmp_path, monkeypatch):
    target = str(tmp_path / "events")
    source = raw(h00=[event("a", 1, x=1)], h01=[event("a", 2, x="t")])
    with pytest.raises(AnalysisException):
        run(spark, source, target, [0, 1, 2])
    assert not Path(target, "2018").exists()

    calls = []

    def failing(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("second batch")
        return real(*args, **kwargs)

    for step, publish in (("find_groups", "run"), ("find_groups", "move"), ("write_parquet", "move")):
        calls.clear()
        real = getattr(preprocess, step)
        monkeypatch.setattr(preprocess, step, failing)
        with pytest.raises(RuntimeError):
            run(spark, source, target, [0, 1], publish=publish)
        assert not list(Path(target).glob("2018/06/01/[!_.]*"))
        assert not list(Path(target).glob("**/_staging*"))
        monkeypatch.undo()
    run(spark, source, target, [0, 1])
    assert sorted(published(spark, target)) == ["a/00", "a/01"]


def test_given_schema_spares_the_inference(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(preprocess, "stage_lines", None)
    source = raw(h00=[event("a", 1, x=1, y=2)], h01=[event("a", 2)])
    target = str(tmp_path / "events")
    schema = StructType.fromDDL(
        "event_type string, event_id bigint, application struct<version_name: string>, x bigint, never string"
    )
    run(spark, source, target, [0, 1], schema=schema)
    assert {k: v[0].split(",")[-1] for k, v in published(spark, target).items()} == {
        "a/00": "x:bigint",
        "a/01": "event_type:string",
    }


def test_wrong_input(spark, raw, tmp_path):
    target = str(tmp_path / "events")
    with pytest.raises(ValueError, match="share one column name"):
        run(spark, raw(h00=[event("a", 1, platform="p", device={"platform": {"name": "n"}})]), target, [0])
    source = raw(h00=[event("a", 1, hh="x")])
    with pytest.raises(ValueError, match="hh"):
        run(spark, source, target, [0])
    with pytest.raises(ValueError, match="layout"):
        run(spark, source, target, [0], layout="deep")
    with pytest.raises(ValueError):
        run(spark, source, target, [24])
    run(spark, source, target, [0], hour_column="hour_dir")
    assert published(spark, target)["a/00"][1] == [("1.0.0", 1, "a", "x")]


def test_events_without_versions_write_nothing(spark, raw, tmp_path):
    target = str(tmp_path / "events")
    assert run(spark, raw(h00=[{"event_type": "a", "x": 1}]), target, [0]) == []
    assert run(spark, raw(h00=[event("a", 1, "dev")]), target, [0]) == []
    assert run(spark, raw(h00=[event("a_b", 1)]), target, [0]) == []


def random_hour(seed):
    """Events whose fields come and go, with values of mixed types."""
    rng = random.Random(seed)

    def value():
        return rng.choice(
            [rng.randint(-5, 5), rng.random(), "text", True, 10**19 + rng.randint(0, 9), [1, 2], [], [None], None, {"k": 1}]
        )

    records = []
    for i in range(300):
        fields = {f"f{j}": value() for j in range(6) if rng.random() < 0.25}
        fields |= {"n": rng.choice([1, 2.5])} if rng.random() < 0.2 else {}
        fields |= {"big": rng.choice([3, 10**19])} if rng.random() < 0.2 else {}
        fields |= {"items": [{"sku": "s", "qty": rng.choice([1, None])}] * rng.randint(0, 2)} if rng.random() < 0.3 else {}
        kind = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c:d", "x_y"])
        records.append(event(kind, i, rng.choice(["1.0.0", "2.0.0", "10.0.0", "dev", None]), **fields))
    return records


@pytest.mark.parametrize("seed", range(4))
def test_narrow_output_equals_the_way_through_files(spark, raw, tmp_path, seed):
    """Write each type as JSON, infer its schema from the written rows of its newest version, read its lines with that schema."""
    source = raw(h00=random_hour(seed))
    target, split = str(tmp_path / "events"), str(tmp_path / "split")
    run(spark, source, target, [0])

    write_split(split_events(spark.read.json(f"{source}2018/06/01/00")), split)
    want = {}
    for kind, lines in read_types(spark, split).items():
        if "app_version_name" not in lines.columns:
            continue
        versions = lines.where(lines.app_version_name.rlike(VERSION_PATTERN)).select("app_version_name").distinct()
        newest = max((r[0] for r in versions.collect()), default=None)
        if newest is None:
            continue
        sample = str(tmp_path / f"sample{len(want)}")
        lines.where(lines.app_version_name == newest).write.json(sample)
        escaped = kind.replace(":", "%3A")
        narrowed = spark.read.json(f"{split}/et={escaped}", spark.read.json(sample).schema)
        want[f"{escaped}/00"] = (
            narrowed.schema.simpleString().removeprefix("struct<").removesuffix(">"),
            sorted((tuple(r) for r in narrowed.collect()), key=str),
        )
    assert published(spark, target) == want and len(want) >= 3


def test_split_and_narrow_hour_by_hour(spark, write_lines, tmp_path):
    lines = [event("view", 1, x=1), event("view", 2, "0.9.0", y=1.5), event("007", 3), event("", 4), event("Event2", 5)]
    source = write_lines("raw/00/a.json", lines)
    split, target = str(tmp_path / "split"), str(tmp_path / "events/2018/06/01")
    split_hour(spark, str(Path(source).parent), split)
    assert sorted(p.name for p in Path(split).glob("et=*")) == ["et=007", "et=__HIVE_DEFAULT_PARTITION__", "et=view"]
    for _ in range(2):
        moved = narrow_hour(spark, split, target, "00")
        assert [m.removeprefix(f"{target}/") for m in moved] == ["007/00", "__HIVE_DEFAULT_PARTITION__/00", "view/00"]
    found = published(spark, str(tmp_path / "events"))
    assert found["view/00"] == (
        "app_version_name:string,event_id:bigint,event_type:string,x:bigint",
        [("0.9.0", 2, "view", None), ("1.0.0", 1, "view", 1)],
    )
    assert found["007/00"][1] == [("1.0.0", 3, "007")]


def test_runs_without_an_order_agree(spark, raw, tmp_path):
    records = random_hour(9)
    results = []
    for name in ("one", "two"):
        random.Random(name).shuffle(records)
        target = str(tmp_path / name)
        preprocess_day(spark, DAY, raw(h00=records), target, hours=[0])
        results.append(published(spark, target))
    assert results[0] == results[1]


def test_fields_with_names_of_our_own(spark, raw, tmp_path):
    names = ["_row_order", "sample_rank", "_file", "_row", "_lane", "_rank", "_salt", "_shown", "n"]
    target = str(tmp_path / "events")
    run(spark, raw(h00=[event("a", 1, **{name: 7 for name in names})]), target, [0])
    schema, rows = published(spark, target)["a/00"]
    assert all(f"{name}:bigint" in schema.split(",") for name in names) and rows[0].count(7) == len(names)
    with pytest.raises(ValueError, match="'et'"):
        run(spark, raw(h00=[event("a", 1, et="x")]), target, [0])
    with pytest.raises(ValueError, match="'et'"):
        run(spark, raw(h00=[event("a", 1, et="x")]), target, [0], layout="wide")


def test_what_is_left_out_is_reported(spark, raw, tmp_path, caplog):
    records = [event("a", 1), event("old", 2, "dev"), event("old", 3, None), event("Event1", 4), event("x y", 5)]
    source = raw(h00=[*records, {"event_id": 6}, "{broken"], h01=[event("old", 7, "2.0.0")])
    done = run(spark, source, str(tmp_path / "events"), [0, 1])
    assert done.skipped == {
        ("no version", "old"): 2,
        ("denied", None): 1,
        ("unclean name", None): 1,
        ("no type", None): 2,
    }
    assert "left out 2 events of type 'old': no version" in caplog.text
    assert sorted(done)[0].endswith("a/00") and len(done) == 2


def test_rows_limits_what_shows_the_schema(spark, raw, tmp_path):
    records = [event("a", i, **({"price": 1.5} if i >= 10 else {})) for i in range(100)]
    all_rows, ten = str(tmp_path / "all"), str(tmp_path / "ten")
    run(spark, raw(h00=records), all_rows, [0])
    run(spark, raw(h00=records), ten, [0], rows=10)
    assert "price:double" in published(spark, all_rows)["a/00"][0]
    assert "price" not in published(spark, ten)["a/00"][0]
