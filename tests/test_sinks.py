import random
from urllib.parse import unquote

import pyarrow.parquet as pq
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from sluicebox.plans.preprocess import publish_wide
from sluicebox.session import sql_settings
from sluicebox.sources import compaction
from sluicebox.sources.compaction import compact_text
from sluicebox.sources.layout import publish_partitions
from sluicebox.sources.sinks import clustered, write_day, write_parquet, write_split


def contents(spark, path, schema="id bigint, k string"):
    return sorted((tuple(r) for r in spark.read.schema(schema).parquet(str(path)).collect()), key=str)


def keyed(spark, n):
    return spark.range(n).withColumn("k", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)))


def test_rows_per_file_are_capped(spark, tmp_path):
    write_parquet(spark.range(250).coalesce(1), str(tmp_path / "p"), max_rows=100)
    files = list((tmp_path / "p").glob("*.parquet"))
    assert sorted(pq.ParquetFile(f).metadata.num_rows for f in files) == [50, 100, 100]
    with pytest.raises(AnalysisException):
        write_parquet(spark.range(1), str(tmp_path / "p"))


def test_hot_partition_is_written_by_several_tasks(spark, tmp_path):
    with sql_settings(
        spark,
        spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
        spark__sql__adaptive__coalescePartitions__minPartitionSize="1KB",
    ):
        df = spark.range(0, 60000, 1, 8).withColumn("k", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold"))
        write_parquet(clustered(df, ["k"]), str(tmp_path / "p"), ["k"])
    assert len(list((tmp_path / "p" / "k=hot").glob("*.parquet"))) > 1
    assert contents(spark, tmp_path / "p") == sorted((tuple(r) for r in df.collect()), key=str)


def test_few_files_per_partition(spark, tmp_path):
    write_parquet(clustered(keyed(spark, 5000).repartition(16), ["k"]), str(tmp_path / "p"), ["k"])
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "p").glob("k=*"))


def test_overwrite_replaces_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "p")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, k string")
    write_parquet(first, path, ["k"])
    write_parquet(spark.createDataFrame([(3, "b")], "id bigint, k string"), path, ["k"], "overwrite")
    assert contents(spark, path) == [(1, "a"), (3, "b")]


def test_day_path(spark, tmp_path):
    path = write_day(spark.range(3), f"{tmp_path}/", "20180601")
    assert path == f"{tmp_path}/2018/06/01"
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(AnalysisException):
        write_day(spark.range(3), str(tmp_path), "20180601")
    write_day(spark.range(4), str(tmp_path), "20180601", "overwrite")
    assert spark.read.parquet(path).count() == 4


def test_partitions_are_moved_and_replaced(spark, tmp_path):
    rows = [(1, "a", "00"), (2, "b/c", "00"), (3, "a", "01")]
    for value, staged in ((0, "s1"), (10, "s2")):
        df = spark.createDataFrame([(i + value, k, h) for i, k, h in rows], "id int, k string, h string")
        df.write.partitionBy("k", "h").parquet(str(tmp_path / staged / "0"))
        moved = publish_partitions(spark, str(tmp_path / staged), str(tmp_path / "t"), ["k", "h"])
        assert [path.removeprefix(f"{tmp_path}/t/") for path in moved] == ["a/00", "a/01", "b%2Fc/00"]
        found = {m: [r.id for r in spark.read.parquet(m).collect()] for m in moved}
        assert list(found.values()) == [[1 + value], [3 + value], [2 + value]]


def test_publishing_nothing(spark, tmp_path):
    assert publish_partitions(spark, str(tmp_path / "none"), str(tmp_path / "t"), ["k"]) == []


def test_wide_rerun_gives_the_same_table(spark, tmp_path):
    rows = [(i, "00", "a" if i % 2 else "", f"{i % 3}.0.0", i if i % 5 else None) for i in range(60)]
    schema = "event_id int, hh string, event_type string, app_version_name string, x int"
    df = spark.createDataFrame(rows, schema)
    path = str(tmp_path / "p")
    for _ in range(2):
        publish_wide(df, path, "20180601", order_by=["event_id"])
    found = spark.read.schema(f"{schema}, dt string, et string").parquet(path).collect()
    assert len(found) == 60
    assert {r.event_type for r in found} == {"a", ""} and {r.dt for r in found} == {"20180601"}
    publish_wide(df, path, "20180602", order_by=["event_id"])
    assert spark.read.schema(f"{schema}, dt string, et string").parquet(path).count() == 120
    with pytest.raises(ValueError):
        publish_wide(df.withColumn("dt", F.lit(1)), path, "20180602")


def test_small_files_are_merged(spark, tmp_path):
    source, target = tmp_path / "small", str(tmp_path / "merged")
    lines = []
    for i in range(40):
        (source / f"h{i % 3}").mkdir(parents=True, exist_ok=True)
        text = [f"{i}-{j} \t é 'q'" for j in range(5)]
        lines += text
        (source / f"h{i % 3}" / f"f{i}.txt").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    compact_text(spark, str(source), target)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    files = sorted((tmp_path / "merged").glob("*/*.txt"))
    assert [f.parent.name for f in files] == ["directory=h0", "directory=h1", "directory=h2"]
    assert sorted(line for f in files for line in f.read_text().splitlines()) == sorted(lines)
    assert all(int(line.split("-")[0]) % 3 == i for i, f in enumerate(files) for line in f.read_text().splitlines())


def test_merged_files_have_about_the_target_size(spark, tmp_path):
    source, target = tmp_path / "small", tmp_path / "merged"
    source.mkdir()
    for i in range(12):
        (source / f"f{i}.txt").write_text(("x" * 99 + "\n") * 3000)
    compact_text(spark, str(source), str(target), target_mib=1)
    sizes = [f.stat().st_size for f in target.glob("*/*.txt")]
    assert sum(sizes) == 12 * 300000 and len(sizes) == 4 and max(sizes) <= 1.1 * 1024 * 1024


@pytest.mark.parametrize("lane", [100_000, 7])
def test_each_directory_has_as_many_files_as_its_bytes_need(spark, tmp_path, monkeypatch, lane):
    """Twenty directories of small, large and empty files, read and merged by many tasks."""
    monkeypatch.setattr(compaction, "LANE_FILES", lane)
    rng, source, target, mib = random.Random(6), tmp_path / "small", tmp_path / "merged", 1 << 20
    want, lanes = {}, {}
    for d in range(20):
        folder = source / f"d {d}%"
        folder.mkdir(parents=True)
        lines = []
        for i in range(rng.randint(1, 25)):
            part = [f"{d}-{i}-{j}-" + "x" * rng.randint(0, 200) for j in range(rng.choice([0, 3, 50, 400, 9000 if d < 3 else 80]))]
            (folder / f"f{i}.txt").write_text("".join(f"{line}\n" for line in part))
            lines += part
            lanes[folder.name] = -(-(i + 1) // lane)
        want[folder.name] = lines
    compact_text(spark, str(source), str(target), target_mib=1)
    found = {}
    for file in target.glob("*/*.txt"):
        found.setdefault(unquote(file.parent.name.removeprefix("directory=")), []).append(file)
    for name, lines in want.items():
        got = [line for file in found.get(name, []) for line in file.read_text().splitlines()]
        assert sorted(got) == sorted(lines)
        needed = -(-sum(len(line) + 1 for line in lines) // mib)
        assert len(found.get(name, [])) <= needed + lanes[name]
    assert set(found) <= set(want)
    assert max(file.stat().st_size for files in found.values() for file in files) < 3 * mib


def test_a_field_that_would_clash_with_the_directory(spark, tmp_path):
    df = spark.createDataFrame([("a", "x")], "event_type string, et string")
    with pytest.raises(ValueError, match="'et'"):
        write_split(df, str(tmp_path / "split"))
