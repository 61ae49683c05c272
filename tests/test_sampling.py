import random

import pytest
from pyspark.sql import functions as F

from sluicebox.operators.lookups import join_lookup
from sluicebox.operators.sampling import bernoulli_sample, first_rows, newest_version_sample
from sluicebox.operators.versions import newest_version
from sluicebox.session import materialise, sql_settings

KEYS = ["hh", "event_type"]


def events(seed=1, n=4000):
    """Events of which more than a third fall into one group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.4
        rows.append(
            (i, "00" if hot else f"{rng.randint(0, 3):02d}", "hot" if hot else rng.choice("abc"), f"{rng.randint(1, 3)}.0.0")
        )
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id int, hh string, event_type string, app_version_name string").repartition(16)


def expected(rows, count):
    newest, chosen = {}, {}
    for _, hour, kind, version in rows:
        newest[hour, kind] = max(version, newest.get((hour, kind), ""))
    for i, hour, kind, version in sorted(rows):
        if version == newest[hour, kind]:
            chosen.setdefault((hour, kind), []).append(i)
    return {key: found[:count] for key, found in chosen.items()}


def collected(df):
    found = {}
    for r in sorted(df.collect(), key=lambda r: r.sample_rank):
        found.setdefault((r.hh, r.event_type), []).append(r.event_id)
    return found


@pytest.mark.parametrize("lanes", [1, 3, 512])
def test_first_rows_does_not_depend_on_lanes(spark, lanes):
    rows = events()
    ranked = first_rows(frame(spark, rows), KEYS, 5, ["event_id"], lanes)
    want = {}
    for i, hour, kind, _ in sorted(rows):
        want.setdefault((hour, kind), []).append(i)
    assert collected(ranked) == {key: found[:5] for key, found in want.items()}


def test_sample_of_the_newest_version(spark):
    rows = events()
    df = frame(spark, rows)
    newest = materialise(newest_version(df), "newest")
    sample = newest_version_sample(df, newest, order_by=["event_id"])
    assert sample.columns == [*df.columns, "sample_rank"]
    assert collected(sample) == expected(rows, 10)


def test_sample_without_an_order_is_repeatable(spark):
    rows = events(n=500)
    newest = materialise(newest_version(frame(spark, rows)), "newest")
    first = collected(newest_version_sample(frame(spark, rows), newest))
    again = collected(newest_version_sample(frame(spark, list(reversed(rows))), newest))
    assert first == again
    assert {k: len(v) for k, v in first.items()} == {k: len(v) for k, v in expected(rows, 10).items()}


def test_bernoulli(spark):
    df = spark.range(1000)
    assert bernoulli_sample(df, 1.0).count() == 1000
    part = bernoulli_sample(df, 0.3, seed=7)
    assert 200 < part.count() < 400
    assert part.distinct().count() == part.count()


def test_lookups_are_broadcast_by_their_measured_size(spark):
    facts = spark.range(3000).select((F.col("id") % 3 * F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("k"), "id")
    lookup = materialise(spark.createDataFrame([(0, "zero"), (1, "one")], "k bigint, name string"), "lookup")
    joined = join_lookup(facts, lookup, ["k"])
    assert joined.count() == 2800
    with sql_settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert join_lookup(facts, lookup, ["k"]).count() == 2800


def test_fields_with_our_own_names_stay(spark):
    fields = "event_id int, hh string, event_type string, app_version_name string, _lane int, _rank int"
    df = spark.createDataFrame([(1, "00", "a", "1.0.0", 5, 6)], fields)
    assert first_rows(df, KEYS, 3).columns == [*df.columns, "sample_rank"]
