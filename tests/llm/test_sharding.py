import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from sluicebox.llm.common import numbered
from sluicebox.llm.sharding import jump_shard, shard_documents


def jump(key, shards):
    at, then = -1, 0
    while then < shards:
        at = then
        key = (key * 2862933555777941757 + 1) % 2**64
        then = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def key_of(value):
    return 42 if value is None else xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed=42)


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 100, 5000])
def test_jumps_against_the_loop(spark, shards):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(-300, 300, 7)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = df.select("k", jump_shard(F.col("k"), shards).alias("s")).collect()
    assert [r.s for r in found] == [jump(r.k % 2**64, shards) for r in found]
    with pytest.raises(ValueError):
        jump_shard(F.col("k"), 0)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    rows = shard_documents(df, 8).collect()
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {8} and 300 < len(moved) < 600
    assert all(380 < sum(r.shard == s for r in rows) < 620 for s in range(8))


def test_rows_slots_nulls_and_copies(spark):
    rows = [(1, "é", "x"), (1, "é", "x"), (2, None, "x"), (3, "", "x"), (None, "n", "x")] + [(9, "hot", "x")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(6)
    found = shard_documents(df, 8).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.shard == jump(key_of(r.doc_id), 8) and r.grown_shard == jump(key_of(r.doc_id), 9)
    for shard in {r.shard for r in found}:
        mine = sorted((r for r in found if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(len(mine)))
        keys = [-1 if r.doc_id is None else r.doc_id for r in mine]
        assert keys == sorted(keys)
    sizes = {(r.doc_id, r["size"], r.text_crc32) for r in found}
    assert sizes == {(k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, _ in rows}
    assert shard_documents(df.limit(0), 8).count() == 0


def test_numbers_spread_a_hot_group(spark):
    df = spark.range(0, 5000, 1, 10).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("g"), "id")
    found = numbered(df, ["g"], ["id"], "n").collect()
    for g in range(7):
        mine = sorted((r.id, r.n) for r in found if r.g == g)
        assert [n for _, n in mine] == list(range(len(mine)))
