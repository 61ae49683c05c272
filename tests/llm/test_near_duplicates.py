import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import sluicebox.llm.common as common
import sluicebox.llm.near_duplicates as near
from sluicebox.llm.components import connected_components

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def by_definition(rows, n, percent):
    sets = [shingle_set(t, n) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] and 100 * same >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (key, _), x in zip(rows, label):
        if key is not None:
            least[x] = min(key, least.get(x, key))
    return [(key, len(s), least.get(x) if s else key) for (key, _), s, x in zip(rows, sets, label)]


def corpus(seed, group):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 80))]
        for _ in range(rng.choice([1, 1, 1, 3])):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 10**6))
            rows.append(" ".join(copy))
    base = [rng.choice(WORDS) for _ in range(150)]
    for _ in range(group):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = "new" + str(rng.randint(0, 10**6))
        rows.append(" ".join(copy))
    rows += ["Exact COPY of one text, again"] * 40 + [None, "", " \n", "one", "ONE", "two words", "Two  words", "É", "é"]
    rng.shuffle(rows)
    return list(enumerate(rows, 100))


@pytest.mark.parametrize(
    ("words", "percent", "block", "leaders", "size"),
    [(3, 85, 4096, 256, 32 << 20), (5, 80, 30, 6, 32 << 20), (3, 70, 20, 1, 32 << 20), (3, 40, 4096, 256, 8000), (5, 80, 4096, 8, 900)],
)
def test_against_brute_force(spark, monkeypatch, words, percent, block, leaders, size):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_BYTES", size)
    monkeypatch.setattr(near, "LEADERS", leaders)
    monkeypatch.setattr(near, "TILE", 16 if block < 100 else 512)
    rows = corpus(words, 150)
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, component_id string")
    found = near.near_duplicates(df.repartition(4), words=words, percent=percent).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == sorted(by_definition(rows, words, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_bands_lose_few_pairs_at_any_threshold():
    assert near.banding(85) == (32, 6) and near.banding(80) == (38, 5)
    for percent in range(7, 101):
        bands, size = near.banding(percent)
        assert bands * size <= near.SAMPLES and (1 - (percent / 100) ** size) ** bands <= near.MISSED
    with pytest.raises(ValueError):
        near.banding(5)


def test_a_cluster_of_long_texts_is_compared_in_blocks_of_bounded_bytes(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 4 << 20)
    real, most = near.compared, []

    def compared(dealt, group, percent):
        sets = dealt.groupBy(*group).agg(F.sum(F.size("items") * 8).alias("total"), F.count(F.lit(1)).alias("n"))
        most.extend((r["total"], r["n"]) for r in sets.collect())
        return real(dealt, group, percent)

    monkeypatch.setattr(near, "compared", compared)
    rng = random.Random(3)
    base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(150_000)]
    rows = []
    for i in range(30):
        copy = list(base)
        for _ in range(400):
            copy[rng.randrange(len(copy))] = f"new{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(copy)))
    assert sum(len(t) for _, t in rows) > 30_000_000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    found = near.near_duplicates(df, words=3, percent=85).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(i, 0) for i in range(30)}
    whole = sum(r.n_shingles * 8 for r in found)
    assert whole > 30 << 20 and max(size for size, _ in most) <= 4 * near.BLOCK_BYTES and max(n for _, n in most) < 30


def test_rows_of_one_value_are_looked_up_in_many_tasks(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("set_a"))
    table = rows.select("set_a").distinct().where("set_a <> 4500").withColumn("value", F.col("set_a") * 2)
    found = near.looked_up(rows, table, "set_a")
    assert sorted((r.id, r.value) for r in found.collect()) == [
        (i, 14 if i < 4000 else 2 * i) for i in range(5000) if i != 4500
    ]


def test_null_and_repeated_keys(spark):
    text = "the same text of many words here"
    rows = [(None, text), (5, text), (5, text), (3, "something else is written here"), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in near.near_duplicates(df, words=3).collect())
    want = [(None, 5, 5, False), (5, 5, 5, True), (5, 5, 5, True), (3, 3, 3, True), (3, 0, 3, True), (None, 0, None, True)]
    assert found == sorted(map(str, want))
    assert near.near_duplicates(df.limit(0)).count() == 0


def test_sketch_distance_follows_similarity_and_limit_loses_nothing():
    rng = np.random.default_rng(4)
    limit, similar, different = near.sketch_limit(85), [], []
    for _ in range(60):
        common = rng.integers(0, 1 << 62, 850, np.uint64)
        own = [rng.integers(0, 1 << 62, 75, np.uint64) for _ in range(2)]
        far = rng.integers(0, 1 << 62, 1000, np.uint64)
        sets = [near.mix(np.concatenate((common, x))) for x in own] + [near.mix(far)]
        sketches = near.odd_sketches(np.array([near.least_samples(s) for s in sets])).view(np.uint64)
        distance = lambda i, j: int(np.bitwise_count(sketches[i] ^ sketches[j]).sum())
        similar.append(distance(0, 1))
        different.append(distance(0, 2))
    assert max(similar) < limit < min(different)


@pytest.mark.parametrize("seed", range(3))
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    edges += [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(60)]
    rng.shuffle(edges)
    label = {}
    for u, v in edges:
        a, b = label.setdefault(u, u), label.setdefault(v, v)
        if a != b:
            label = {n: min(a, b) if x in (a, b) else x for n, x in label.items()}
    df = spark.createDataFrame(edges + edges[:5], "u long, v long")
    found = {r.node: r.root for r in connected_components(df).collect()}
    alone = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    assert found == {n: x for n, x in label.items() if n not in alone}
    assert connected_components(df.limit(0)).count() == 0


def test_possible_rows_are_all_that_a_join_would_meet(spark, monkeypatch):
    rows = spark.range(20000).withColumn("name", F.when(F.col("id") % 7 > 0, F.concat(F.lit("n"), "id")))
    table = rows.where("id % 100 = 3").unionByName(rows.where("id = 7"))
    for words, most in ((1 << 18, 250), (4, 20000)):
        monkeypatch.setattr(common, "FILTER_WORDS", words)
        found = common.with_possible(rows, table, ["id", "name"])
        assert found.columns == ["id", "name", "POSSIBLE"] and found.count() == 20000
        possible = {r.id for r in found.where("POSSIBLE").collect()}
        assert {r.id for r in table.collect()} <= possible and len(possible) <= most
    assert not common.with_possible(rows, table.limit(0), ["id"]).where("POSSIBLE IS NULL OR POSSIBLE").count()


def test_texts_are_not_shuffled_for_nothing(spark, monkeypatch):
    """Texts without a candidate are left out before the join, and small clusters are dealt once."""
    real_sets, real_compared, plans, sides = near.cluster_sets, near.compared, [], []

    def sets(*args):
        found = real_sets(*args)
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        return found

    def compared(dealt, group, percent):
        sides.append({(r.side, r.n) for r in dealt.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()})
        return real_compared(dealt, group, percent)

    monkeypatch.setattr(near, "cluster_sets", sets)
    monkeypatch.setattr(near, "compared", compared)
    rows = corpus(3, 30)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = near.near_duplicates(df.repartition(2), words=3, percent=85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()) == sorted(by_definition(rows, 3, 85))
    assert "getbit" in plans[0]
    assert {side for side, _ in sides[0]} == {0} and not sides[1]


def test_workers_keep_no_arrow_memory_of_tasks_that_ended(spark):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [pa.array([1] * 1000) for _ in range(10)]
            yield batch.slice(0, len(kept))

    real, calls = common.pa.default_memory_pool, []

    class Pool:
        def release_unused(self):
            calls.append(1)

    common.pa.default_memory_pool = Pool
    try:
        df = type("Frame", (), {"sparkSession": spark, "mapInArrow": lambda self, task, ddl: task})()
        task = common.map_batches(df, run, "id long")
        made = list(task(iter([common.pa.record_batch({"id": [1, 2]})])))
    finally:
        common.pa.default_memory_pool = real
    assert made[0].num_rows == 2 and calls == [1]
