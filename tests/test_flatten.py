import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from sluicebox.operators.flatten import flatten_events, kept_leaves, leaves, prune_schema

# Parsing a schema text needs a session.
pytestmark = pytest.mark.usefixtures("spark")


def parsed(spark, text, schema):
    return spark.createDataFrame([(text,)], "v string").select(F.from_json("v", schema).alias("r")).select("r.*")


def paths(ddl):
    return [leaf.path for leaf in leaves(StructType.fromDDL(ddl))]


def test_leaves_in_schema_order():
    assert paths("b struct<y: int, x: struct<z: int>>, a string") == ["b.y", "b.x.z", "a"]


def test_arrays_of_structs_are_entered_one_level_deep():
    assert paths("a array<struct<x: int>>, n array<int>, aa array<array<struct<c: int>>>") == ["a.x", "n", "aa"]


def test_drop_filter_and_rename(spark):
    df = parsed(
        spark,
        '{"awsAccountId":"1","client_context":{"custom":"c"},"Ab":1,"ab":2,"attributes":{"user_id":"u","Level":"3"},'
        '"device":{"make":"m","locale":{"code":"en"}},"x y":1}',
        "awsAccountId string, client_context struct<custom: string>, Ab bigint, ab bigint, "
        "attributes struct<user_id: string, Level: string>, "
        "device struct<make: string, locale: struct<code: string>>, `x y` bigint",
    )
    flat = flatten_events(df)
    assert flat.columns == ["ab", "user_id", "make", "device_locale_code"]
    assert flat.first().asDict() == {"ab": 2, "user_id": "u", "make": "m", "device_locale_code": "en"}
    assert "locale" in flatten_events(df, fix_locale=True).columns
    assert "client_context_custom" in flatten_events(df, dropped=[]).columns


def test_dropping_a_missing_field_is_no_error(spark):
    assert flatten_events(spark.range(1)).columns == ["id"]


@pytest.mark.parametrize(
    "text, schema, column, value",
    [
        ('{"a":[{"x":1},{"x":2}]}', "a array<struct<x: bigint>>", "a_x", [1, 2]),
        ('{"a":[{"s":{"x":1}}]}', "a array<struct<s: struct<x: bigint>>>", "a_s_x", [1]),
        ('{"a":[{"b":[{"c":1},{"c":2}]},{"b":[]}]}', "a array<struct<b: array<struct<c: bigint>>>>", "a_b_c", [[1, 2], []]),
        (
            '{"a":[{"b":[{"c":[{"d":1}]}]}]}',
            "a array<struct<b: array<struct<c: array<struct<d: bigint>>>>>>",
            "a_b_c_d",
            [[[1]]],
        ),
        (
            '{"a":[{"b":[{"s":{"c":7}}]}]}',
            "a array<struct<b: array<struct<s: struct<c: bigint>>>>>",
            "a_b_s_c",
            [[7]],
        ),
        ('{"a":[{"n":[1,2]}]}', "a array<struct<n: array<bigint>>>", "a_n", [[1, 2]]),
        ('{"d.o":1}', "`d.o` bigint", "d_o", 1),
        ('{"s":{"d.o":{"e.f":1}}}', "s struct<`d.o`: struct<`e.f`: bigint>>", "s_d_o_e_f", 1),
        ('{"q\'x":1}', "`q'x` bigint", "qx", 1),
        ('{"b`t":1}', "`b``t` bigint", "bt", 1),
        ('{"a,b":1}', "`a,b` bigint", "a,b", 1),
    ],
)
def test_values_of_odd_paths(spark, text, schema, column, value):
    flat = flatten_events(parsed(spark, text, schema))
    assert flat.columns == [column]
    assert flat.first()[0] == value


def test_array_of_arrays_is_one_leaf(spark):
    flat = flatten_events(parsed(spark, '{"aa":[[{"c":1}]]}', "aa array<array<struct<c: bigint>>>"))
    assert flat.columns == ["aa"]
    assert flat.first().aa[0][0].c == 1


def test_collision_is_raised_before_any_job(spark):
    df = parsed(
        spark, '{"platform":"a"}', "platform string, device struct<platform: struct<name: string>>"
    )
    with pytest.raises(ValueError, match="device.platform.name"):
        flatten_events(df)


def test_pruned_schema_holds_kept_leaves_only():
    schema = StructType.fromDDL(
        "awsAccountId string, a struct<b: int, C: int, d: struct<E: int>>, l array<struct<x: int, Y: int>>, m array<int>"
    )
    kept = prune_schema(schema, kept_leaves(schema))
    assert kept.simpleString() == "struct<a:struct<b:int>,l:array<struct<x:int>>,m:array<int>>"


def test_scan_reads_only_the_leaves_that_are_used(spark, tmp_path):
    path = str(tmp_path / "p")
    parsed(
        spark, '{"s":{"a":1,"b":2},"l":[{"x":1,"z":2}]}', "s struct<a: int, b: int>, l array<struct<x: int, z: int>>"
    ).write.parquet(path)
    plan = flatten_events(spark.read.parquet(path)).select("s_a", "l_x")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l:array<struct<x:int>>,s:struct<a:int>>" in plan or (
        "ReadSchema: struct<s:struct<a:int>,l:array<struct<x:int>>>" in plan
    )


NAMES = st.sampled_from(["a", "b", "c_d", "x.y", "Ab", "s p", "q'", "n"])


def types(depth):
    if depth == 0:
        return st.just(LongType())
    inner = types(depth - 1)
    struct = st.lists(st.tuples(NAMES, inner), min_size=1, max_size=3, unique_by=lambda pair: pair[0]).map(
        lambda pairs: StructType([StructField(name, data_type) for name, data_type in pairs])
    )
    return st.one_of(st.just(LongType()), struct, struct.map(ArrayType), inner.map(ArrayType))


SCHEMAS = st.lists(st.tuples(NAMES, types(3)), min_size=1, max_size=4, unique_by=lambda pair: pair[0]).map(
    lambda pairs: StructType([StructField(f"{name}{i}", data_type) for i, (name, data_type) in enumerate(pairs)])
)


def sample_value(data_type, rng):
    if rng.random() < 0.15:
        return None
    if isinstance(data_type, StructType):
        return {f.name: sample_value(f.dataType, rng) for f in data_type.fields}
    if isinstance(data_type, ArrayType):
        return [sample_value(data_type.elementType, rng) for _ in range(rng.randint(0, 3))]
    return rng.randint(0, 99)


def reach(value, parts):
    """The value of a path, with one result per element of every array on the way."""
    if value is None or not parts:
        return value
    if isinstance(value, list):
        return [reach(element, parts) for element in value]
    return reach(value[parts[0]], parts[1:])


def plain(value):
    if isinstance(value, Row):
        return {name: plain(value[name]) for name in value.__fields__}
    return [plain(element) for element in value] if isinstance(value, list) else value


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(schema=SCHEMAS, seed=st.integers(0, 1000))
def test_values_of_any_nested_schema(spark, schema, seed):
    rng = random.Random(seed)
    records = [{f.name: sample_value(f.dataType, rng) for f in schema.fields} for _ in range(4)]
    df = spark.createDataFrame([tuple(r[f.name] for f in schema.fields) for r in records], schema)
    found = [leaf for leaf in leaves(schema)]
    assert len({leaf.parts for leaf in found}) == len(found)
    rows = df.select([leaf.column().alias(f"c{i}") for i, leaf in enumerate(found)]).collect()
    for record, row in zip(records, rows):
        assert [plain(value) for value in row] == [reach(record, leaf.parts) for leaf in found]
