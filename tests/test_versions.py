import random
import re

import pytest

from sluicebox.operators.versions import newest_version, top_versions, version_counts

KEYS = ["hh", "event_type"]
SCHEMA = "hh string, event_type string, app_version_name string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def newest(spark, versions, **options):
    rows = newest_version(frame(spark, [("00", "a", v) for v in versions]), **options).collect()
    assert len(rows) <= 1
    return rows[0].app_version_name if rows else None


def by_hand(versions):
    """The greatest of all matching strings."""
    return max((v for v in versions if v is not None and re.search(r"\d+.\d+.\d+", v)), default=None)


def test_text_order_puts_nine_before_ten(spark):
    assert newest(spark, ["9.0.0", "10.0.0", "2.5.1"]) == "9.0.0"
    assert newest(spark, ["9.0.0", "10.0.0", "2.5.1"], order="numeric") == "10.0.0"


def test_numeric_order_compares_every_number_and_ignores_text(spark):
    assert newest(spark, ["1.10.0", "1.9.9", "v1.10.0-b", "dev"], order="numeric") == "v1.10.0-b"
    assert newest(spark, ["1.2.3", "1.2.3.1"], order="numeric") == "1.2.3.1"
    assert newest(spark, ["9" * 60 + ".0.0", "1.0.0"], order="numeric") is not None


def test_group_without_a_version_has_no_row(spark):
    assert newest(spark, ["dev", None, "1.2"]) is None
    assert newest(spark, [None]) is None


@pytest.mark.parametrize("order", ["text", "numeric"])
def test_greater_strings_that_do_not_match_hide_no_version(spark, order):
    dev = [f"dev{i:03d}" for i in range(120)]
    assert newest(spark, [*dev, None, *["1.2.3"] * 50], order=order) == "1.2.3"


def test_newest_is_one_partial_aggregate(spark):
    plan = newest_version(frame(spark, [("00", "a", "1.0.0")]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_unknown_order(spark):
    with pytest.raises(ValueError):
        newest_version(frame(spark, [("00", "a", "1.0.0")]), order="age")


@pytest.mark.parametrize("seed", range(3))
def test_newest_and_top_against_brute_force_with_a_hot_group(spark, seed):
    rng = random.Random(seed)
    names = [None, "dev", "1.2"] + [f"{rng.randint(1, 12)}.{rng.randint(0, 30)}.{rng.randint(0, 3)}" for _ in range(400)]
    rows = [
        ("00" if rng.random() < 0.4 else f"{rng.randint(0, 5):02d}", "hot" if rng.random() < 0.4 else rng.choice("bcd"), rng.choice(names))
        for _ in range(6000)
    ]
    groups = {}
    for hour, kind, version in rows:
        groups.setdefault((hour, kind), []).append(version)
    df = frame(spark, rows)
    assert {(r.hh, r.event_type): r.app_version_name for r in newest_version(df).collect()} == {
        key: by_hand(found) for key, found in groups.items() if by_hand(found)
    }
    top = {}
    for r in top_versions(df, limit=7).collect():
        top.setdefault((r.hh, r.event_type), {})[r.version_rank] = (r.app_version_name, r.n)
    for key, found in groups.items():
        ordered = sorted({v for v in found if v is not None}, reverse=True) + ([None] if None in found else [])
        assert top[key] == {i + 1: (v, found.count(v)) for i, v in enumerate(ordered[:7])}


def test_counts_keep_the_missing_version(spark):
    df = frame(spark, [("00", "a", None), ("00", "a", None), ("00", "a", "1.0.0")])
    assert {(r.app_version_name, r.n) for r in version_counts(df).collect()} == {(None, 2), ("1.0.0", 1)}


def test_top_versions_are_cut_before_the_shuffle(spark):
    plan = top_versions(frame(spark, [("00", "a", "1.0.0")]))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
