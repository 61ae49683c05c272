import re

from sluicebox.operators.event_types import count_events, distinct_event_types, retain_event_types
from sluicebox.functions.predicates import is_version
from pyspark.sql import functions as F


def test_types_that_are_retained(spark):
    kept = ["view", "c:d/e%", "a-b", "é", ""]
    dropped = ["Event1", "Event3", "a b", "a,b", "a_b", "a\tb", "a\nb", "a\u00a0b", "a\u2003b", "a\x1cb", "a\x1fb", "a\x85b", None]
    df = spark.createDataFrame([(t,) for t in kept + dropped], "event_type string")
    assert {row[0] for row in retain_event_types(df).collect()} == set(kept)


def test_cleanliness_agrees_with_python_on_every_space(spark):
    spaces = [chr(i) for i in range(0x3100) if re.search(r"\s", chr(i))]
    others = ["\u200b", "\u180e", "\x00", "\x1b", "."]
    df = spark.createDataFrame([(f"a{c}b",) for c in spaces + others], "event_type string")
    assert {row[0] for row in retain_event_types(df).collect()} == {f"a{c}b" for c in others}


def test_denied_list_is_a_parameter(spark):
    df = spark.createDataFrame([("Event1",), ("view",)], "event_type string")
    assert [r[0] for r in retain_event_types(df, ["view"]).collect()] == ["Event1"]
    assert retain_event_types(df, []).count() == 2


def test_distinct_types_are_sorted_with_the_missing_type_last(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,), ("b",), ("c",)], "event_type string")
    assert [r[0] for r in distinct_event_types(df).collect()] == ["c", "b", "a", None]


def test_counts(spark):
    df = spark.createDataFrame([("a", "00"), ("a", "00"), ("b", "01")], "event_type string, hh string")
    assert {tuple(r) for r in count_events(df).collect()} == {("a", "00", 2), ("b", "01", 1)}


def test_version_pattern(spark):
    matches = ["1.2.3", "12345", "v10.0.0-b", "1a2b3"]
    misses = ["1234", "1.2", "dev", ""]
    df = spark.createDataFrame([(v,) for v in matches + misses + [None]], "v string")
    found = {r.v: r.m for r in df.select("v", is_version(F.col("v")).alias("m")).collect()}
    assert all(found[v] for v in matches) and not any(found[v] for v in misses)
    assert found[None] is None
