"""The registered queries: each runs one operator or job over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sluicebox.functions.dates import dated_table, day_column, day_path, day_path_column, hour_column, hour_name, under
from sluicebox.functions.predicates import is_version
from sluicebox.operators.event_types import count_events, distinct_event_types, retain_event_types, skipped_events
from sluicebox.operators.flatten import flatten_events
from sluicebox.operators.narrowing import column_counts, narrow_wide, newest_rows, schema_table
from sluicebox.operators.sampling import newest_version_sample
from sluicebox.operators.versions import newest_version, top_versions, version_counts
from sluicebox.plans.preprocess import (
    narrow_hour,
    preprocess_day,
    publish_wide,
    read_published,
    split_events,
    split_hour,
)
from sluicebox.plans.transfer import country_chain, lake_to_warehouse, warehouse_to_lake
from sluicebox.queries.raw_events import DAY, DENIED, FIELDS, load_events, raw_events
from sluicebox.session import configure, materialise, scratch_path
from sluicebox.sources.compaction import compact_text
from sluicebox.sources.json_events import read_json, read_split, type_schemas
from sluicebox.sources.layout import publish_partitions
from sluicebox.sources.sinks import MAX_ROWS_PER_FILE, clustered, write_parquet, write_split
from sluicebox.sources.staged_lines import stage_hours
from sluicebox.sources.tables import read_day, read_table, register_view, write_table
from sluicebox.sources.work import Work, input_prints

_PLACE = [StructField("et", StringType()), StructField("hh", StringType())]

Query = Callable[[SparkSession, str], DataFrame]


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten_events(raw_events(spark, sf_dir))


def _retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_events(raw_events(spark, sf_dir), DENIED)


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    register_view(flat.withColumn("et", flat.event_type), "flat_events")
    return spark.sql("SELECT * FROM flat_events")


def flat_array_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flatten_events(raw_events(spark, sf_dir, with_items=True))
    offers = F.transform("items_offers_code", lambda codes: F.array_join(codes.cast("array<string>"), "+"))
    return flat.select(
        "event_id",
        F.array_join("items_sku", ",").alias("items_sku"),
        F.array_join(F.col("items_qty").cast("array<string>"), ",").alias("items_qty"),
        F.array_join(offers, ",").alias("items_offers_code"),
    )


def distinct_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinct_event_types(_flat(spark, sf_dir))


def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retain_event_types(_flat(spark, sf_dir), DENIED).select("event_id", "hh", "event_type")


def skipped_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skipped_events(_flat(spark, sf_dir), DENIED)


def events_per_type_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_events(_retained(spark, sf_dir))


def events_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    compact_day = F.date_format("ts", "yyyyMMdd")
    ts = F.col("ts")
    dated = load_events(spark, sf_dir).select(
        day_path_column(ts).alias("day_path"), hour_column(ts).alias("hh"), day_column(compact_day).alias("day")
    )
    return dated.groupBy("day_path", "hh").agg(
        F.count(F.lit(1)).alias("n"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("day")
    )


def version_counts_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_counts(_retained(spark, sf_dir))


def version_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _flat(spark, sf_dir)
    return flat.groupBy(is_version(F.col("app_version_name")).alias("matches")).agg(F.count(F.lit(1)).alias("n"))


def top_versions_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_versions(_retained(spark, sf_dir), ["event_type"])


def newest_version_lexicographic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_version(_retained(spark, sf_dir))


def newest_version_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_version(_retained(spark, sf_dir), order="numeric")


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    retained = _retained(spark, sf_dir)
    newest = materialise(newest_version(retained), "newest")
    return newest_version_sample(retained, newest, order_by=["event_id"])


def newest_version_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sample(spark, sf_dir).select("hh", "event_type", "app_version_name", "event_id", "sample_rank")


def type_column_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return column_counts(_retained(spark, sf_dir))


def type_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    retained = _retained(spark, sf_dir)
    newest = materialise(newest_version(retained), "newest")
    return schema_table(newest_rows(retained, newest), retained.columns)


def narrowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return narrow_wide(_retained(spark, sf_dir))


def json_roundtrip_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    _flat(spark, sf_dir).write.option("compression", "gzip").json(path)
    return read_json(spark, path)


def json_partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "split")
    write_split(_retained(spark, sf_dir), path)
    return read_split(spark, path)


def json_schema_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    _flat(spark, sf_dir).write.json(path)
    wanted = "event_id string, event_timestamp bigint, app_version_code bigint"
    return read_json(spark, path, f"{wanted}, metrics_amount string, hh string, absent string")


def compact_small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small, merged = scratch_path(spark, "small"), scratch_path(spark, "merged")
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS")
    raw = load_events(configure(spark), sf_dir).select(
        "event_id", ts.alias("ts"), "user_id", "event_type", "value", "props", F.concat(F.lit("h"), hour_column(F.col("ts"))).alias("H")
    )
    # The directories of the small files have plain names, so that only merging gives them a column.
    raw.repartition(64, "event_id").write.partitionBy("H").json(f"{small}/staged")
    publish_partitions(spark, small, f"{small}-by-hour", ["H"])
    compact_text(spark, f"{small}-by-hour", merged)
    return read_json(spark, merged, StructType([*raw.drop("H").schema.fields, StructField("directory", StringType())]))


def compacted_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each hour's lines are in as many merged files as their bytes need, and how many lines there are."""
    small, merged = scratch_path(spark, "small"), scratch_path(spark, "merged")
    raw = load_events(configure(spark), sf_dir).select("event_id", "user_id", F.concat(F.lit("h"), hour_column(F.col("ts"))).alias("H"))
    raw.repartition(16, "event_id").write.partitionBy("H").json(f"{small}/staged")
    publish_partitions(spark, small, f"{small}-by-hour", ["H"])
    compact_text(spark, f"{small}-by-hour", merged, target_mib=1)
    lines = spark.read.option("recursiveFileLookup", "true").text(merged)
    place = F.regexp_extract("_metadata.file_path", "directory=([^/]*)/", 1).alias("directory")
    files = lines.select(place, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
    of_file = files.groupBy("directory", "file").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("lines"))
    counts = of_file.groupBy("directory").agg(
        F.sum("lines").alias("lines"), (F.count(F.lit(1)) <= F.ceil(F.sum("size") / (1 << 20))).alias("as_few_as_needed")
    )
    return counts


def parquet_capped_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "capped")
    retained = _retained(spark, sf_dir)
    write_parquet(clustered(retained, ["event_type"]), path)
    written = spark.read.schema(retained.schema).parquet(path)
    files = written.groupBy(F.col("_metadata.file_path")).agg(F.count(F.lit(1)).alias("n"))
    largest = files.agg((F.max("n") <= MAX_ROWS_PER_FILE).alias("within_cap"))
    return written.join(F.broadcast(largest), F.lit(True))


def publish_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "published")
    retained = _retained(spark, sf_dir)
    for _ in range(2):
        publish_wide(retained, path, DAY)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in retained.schema.fields)
    return spark.read.schema(f"{fields}, dt string, et string").parquet(path)


def _write_raw_hours(spark: SparkSession, sf_dir: str) -> str:
    """Raw JSON lines at ``root/yyyy/mm/dd/hh/``."""
    staged, root = scratch_path(spark, "hours"), scratch_path(spark, "raw")
    clustered(raw_events(spark, sf_dir), ["hh"]).write.partitionBy("hh").json(f"{staged}/0")
    publish_partitions(spark, staged, under(root, "2018/06/01"), ["hh"])
    return root


def with_directories(events: DataFrame) -> DataFrame:
    """Type and hour of the directory that holds each row."""
    parts = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    value = lambda i: F.regexp_replace(F.element_at(parts, i), "^(et|hh)=", "")
    return events.select("*", value(-3).alias("et"), value(-2).alias("hh"))


def split_and_narrow_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, split, target = (scratch_path(spark, name) for name in ("raw", "split", "hour"))
    raw_events(spark, sf_dir).write.json(source)
    split_hour(spark, source, split, denied=DENIED)
    narrow_hour(spark, split, target, "00", hour_column="hour_dir")
    return spark.read.option("mergeSchema", "true").parquet(f"{target}/*/00")


def preprocess_day_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _write_raw_hours(spark, sf_dir), scratch_path(spark, "events")
    for _ in range(2):
        preprocess_day(spark, DAY, source, target, denied=DENIED)
    return with_directories(read_published(spark, target, DAY))


def preprocess_day_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _write_raw_hours(spark, sf_dir), scratch_path(spark, "events")
    for hours in (range(24), range(12, 24)):
        preprocess_day(spark, DAY, source, target, hours=hours, publish="run", denied=DENIED)
    return with_directories(read_published(spark, target, DAY))


def concurrent_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs of some hours each, at the same time and into the same day."""
    source, target = _write_raw_hours(spark, sf_dir), scratch_path(spark, "events")
    publish = lambda hours: preprocess_day(spark, DAY, source, target, hours=hours, publish="run", denied=DENIED)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(publish, (range(8), range(8, 16), range(16, 24))))
    return with_directories(read_published(spark, target, DAY))


def resumed_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day whose first run was lost after it had staged half of the hours."""
    source, target, work = _write_raw_hours(spark, sf_dir), scratch_path(spark, "events"), scratch_path(spark, "work")
    hours, kept = [hour_name(hour) for hour in range(12)], Work(spark, under(work, f"day-{DAY}"))
    prints = input_prints(spark, source, DAY, hours)
    stage_hours(spark, source, DAY, hours, scratch_path(spark, "raw", kept.folder), kept, prints)
    preprocess_day(spark, DAY, source, target, denied=DENIED, work=work)
    return read_published(spark, target, DAY, place=True)


#: Fields whose type differs: ``score`` by the hour, ``serial`` by the version, beside ``legacy`` that some versions lack.
_SCORE = """parse_json(CASE CAST(hh AS INT) % 3 WHEN 0 THEN string(event_id % 1000)
                   WHEN 1 THEN string(event_id % 1000 + 0.5D) ELSE '"s' || event_id % 7 || '"' END)"""
_NINE = "user_id % 12 + 1 = 9"
_SERIAL = f"CASE WHEN {_NINE} THEN decimal(event_id % 5) ELSE 12345678901234567890 END"
_LEGACY = f"CASE WHEN NOT ({_NINE}) THEN string(event_id % 3) END"


def _write_uneven_hours(spark: SparkSession, sf_dir: str, **fields: str) -> str:
    """Raw JSON lines as of :func:`_write_raw_hours` with more fields, from the columns of the table and the hour."""
    staged, root = scratch_path(spark, "hours"), scratch_path(spark, "raw")
    added = [f"{expression} AS {name}" for name, expression in fields.items()]
    raw = load_events(spark, sf_dir).withColumn("hh", F.date_format("ts", "HH")).selectExpr(*FIELDS, *added)
    clustered(raw, ["hh"]).write.partitionBy("hh").json(f"{staged}/0")
    publish_partitions(spark, staged, under(root, day_path(DAY)), ["hh"])
    return root


def reconciled_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day whose hours disagree on the type of a column, read as one table."""
    source, target = _write_uneven_hours(spark, sf_dir, score=_SCORE), scratch_path(spark, "events")
    preprocess_day(spark, DAY, source, target, denied=DENIED)
    return read_published(spark, target, DAY, place=True).select("event_id", "event_type", "score", "et", "hh")


def narrowed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values narrowing takes from the events of each hour and type, by column and reason."""
    source, target = _write_uneven_hours(spark, sf_dir, serial=_SERIAL, legacy=_LEGACY), scratch_path(spark, "events")
    done = preprocess_day(spark, DAY, source, target, denied=DENIED)
    return spark.createDataFrame(done.narrowed, "hh string, event_type string, column string, reason string, n bigint")


def type_partition_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that each type's lines of a split show."""
    path = scratch_path(spark, "split")
    write_split(_retained(spark, sf_dir), path)
    rows = [(et, schema.simpleString()) for et, schema in type_schemas(spark, path).items()]
    return spark.createDataFrame(rows, "et string, lines_schema string")


def preprocess_day_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = _write_raw_hours(spark, sf_dir), scratch_path(spark, "events")
    preprocess_day(spark, DAY, source, target, layout="wide", denied=DENIED)
    fields = spark.read.parquet(target).drop("dt", "et", "hh").schema.fields
    return spark.read.schema(StructType([*fields, *_PLACE])).parquet(target).drop("dt")


def _database(spark: SparkSession, label: str) -> str:
    """A new database in the scratch folder."""
    path = scratch_path(spark, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{path}'")
    return name


def _scaled(embedding: Column) -> Column:
    """Components as whole numbers, so that two engines spell them alike; a power of two keeps their digits."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * (1 << 40)))


def _text_time(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


def warehouse_to_lake_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{_database(configure(spark), 'warehouse')}.orders"
    lake = scratch_path(spark, "lake")
    write_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), table, "overwrite")
    warehouse_to_lake(spark, DAY, table, lake)
    return _text_time(read_day(spark, lake, DAY), "o_orderdate")


def lake_to_warehouse_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{_database(configure(spark), 'warehouse')}.embeddings"
    lake = scratch_path(spark, "lake")
    warehouse_to_lake(spark, DAY, f"{sf_dir}/embeddings.parquet", lake, fmt="parquet")
    for _ in range(2):
        lake_to_warehouse(spark, DAY, lake, table)
    return read_table(spark, table).select(
        "vec_id",
        "label",
        F.array_join(_scaled(F.col("embedding")).cast("array<string>"), ",").alias("components"),
    )


def lake_to_warehouse_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{_database(configure(spark), 'warehouse')}.lineitem"
    lake = scratch_path(spark, "lake")
    warehouse_to_lake(spark, DAY, f"{sf_dir}/lineitem.parquet", lake, fmt="parquet")
    lake_to_warehouse(spark, DAY, lake, table)
    return _text_time(read_table(spark, table), "l_shipdate")


def country_chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, test = _database(configure(spark), "events"), _database(spark, "test")
    users = _flat(spark, sf_dir).select("user_id", "country").distinct()
    write_table(users, dated_table(f"{events}.user_info", DAY), "overwrite")
    copy = country_chain(
        spark,
        DAY,
        scratch_path(spark, "lake"),
        source=f"{events}.user_info",
        result=f"{test}.user_info_test",
        copy=f"{test}.user_info_test_froms3",
    )
    return read_table(spark, copy)


def country_chain_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of the chain over different users, each repeated; the result table has every run once."""
    events, test = _database(configure(spark), "events"), _database(spark, "test")
    users = _flat(spark, sf_dir).select("user_id", "country").distinct()
    lake = scratch_path(spark, "lake")
    names = {"source": f"{events}.user_info", "result": f"{test}.result", "copy": f"{test}.copy"}
    parts = {"all": users, "us": users.where("country = 'US'")}
    for run, part in parts.items():
        write_table(part, dated_table(f"{events}.user_info", DAY), "overwrite")
        for _ in range(2):
            copy = country_chain(spark, DAY, under(lake, run), **names, run=run)
    return read_table(spark, copy).groupBy("country").agg(F.count(F.lit(1)).alias("runs"))


QUERIES: dict[str, Query] = {
    "flat_events": flat_events,
    "flat_array_leaves": flat_array_leaves,
    "distinct_event_types": distinct_types,
    "retained_events": retained_events,
    "skipped_events": skipped_event_counts,
    "events_per_type_hour": events_per_type_hour,
    "events_per_path": events_per_path,
    "version_counts": version_counts_per_group,
    "version_pattern": version_pattern,
    "top_versions_per_type": top_versions_per_type,
    "newest_version_lexicographic": newest_version_lexicographic,
    "newest_version_numeric": newest_version_numeric,
    "newest_version_sample": newest_version_rows,
    "type_column_presence": type_column_presence,
    "type_schema": type_schema,
    "narrowed_events": narrowed_events,
    "json_roundtrip_inferred": json_roundtrip_inferred,
    "json_partition_scan": json_partition_scan,
    "json_schema_on_read": json_schema_on_read,
    "compact_small_files": compact_small_files,
    "compacted_file_counts": compacted_file_counts,
    "parquet_capped_write": parquet_capped_write,
    "publish_day": publish_day,
    "split_and_narrow_hour": split_and_narrow_hour,
    "preprocess_day_narrow": preprocess_day_narrow,
    "preprocess_day_runs": preprocess_day_runs,
    "concurrent_publish": concurrent_publish,
    "resumed_day": resumed_day,
    "reconciled_hours": reconciled_hours,
    "narrowed_values": narrowed_values,
    "type_partition_schemas": type_partition_schemas,
    "preprocess_day_wide": preprocess_day_wide,
    "warehouse_to_lake": warehouse_to_lake_orders,
    "lake_to_warehouse": lake_to_warehouse_embeddings,
    "lake_to_warehouse_lineitem": lake_to_warehouse_lineitem,
    "country_chain": country_chain_query,
    "country_chain_retried": country_chain_retried,
}
