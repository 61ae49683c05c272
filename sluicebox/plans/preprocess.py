"""From raw nested events to Parquet tables per event type and hour."""

from __future__ import annotations

import logging
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from sluicebox.functions.dates import day_path, hour_name, under
from sluicebox.functions.predicates import DENIED_TYPES
from sluicebox.functions.types import common_schema
from sluicebox.operators.event_types import count_left_out, retain_event_types
from sluicebox.operators.flatten import DROPPED_FIELDS, flatten_events
from sluicebox.operators.narrowing import group_schemas, narrow_wide, newest_rows, typed_columns
from sluicebox.operators.versions import VERSION, newest_version
from sluicebox.session import configure, materialise, scratch_path
from sluicebox.sources.json_events import (
    batch_hours,
    kept_schema,
    read_hours,
    read_split,
)
from sluicebox.sources.layout import (
    glob_exists,
    path_exists,
    publish_partitions,
    read_current,
    remove_runs,
    remove_stale,
    remove_tree,
    switch_current,
    touch_lease,
)
from sluicebox.sources.reconcile import read_reconciled
from sluicebox.sources.sinks import MAX_ROWS_PER_FILE, clustered, write_parquet, write_split
from sluicebox.sources.staged_lines import hour_lines, read_staged, stage_hours, stage_lines
from sluicebox.sources.work import Work, input_prints

log = logging.getLogger(__name__)

# Write jobs submitted at once; each reads a part of the split, so several are needed to keep a cluster busy.
CONCURRENT_WRITES = 32


class Narrowed(NamedTuple):
    """Values of a column that narrowing took from the events of one type within one hour.

    The reason is ``dropped`` where the rows of the newest version show no such column, and ``misfit`` where a value
    does not fit the type that they show.
    """

    hour: str
    event_type: str
    column: str
    reason: str
    n: int


class Published(list):
    """The directories written, in ``skipped`` how many events were left out, by reason and type, and in ``narrowed``
    how many values the events that stay have lost.

    The reasons are those of :func:`left_out_reason`, and ``no version`` for the types of an hour without a version.
    """

    def __init__(
        self,
        paths: Iterable[str] = (),
        skipped: dict[tuple[str, str | None], int] | None = None,
        narrowed: Iterable[Narrowed] = (),
    ):
        super().__init__(paths)
        self.skipped = skipped or {}
        self.narrowed = sorted(narrowed)


class Group(NamedTuple):
    """Events of one type within one hour, the schema that the rows of their newest version show, and the values that
    all of them hold, by column."""

    hour: str
    event_type: str
    schema: StructType
    values: dict[str, int]


def split_events(
    raw: DataFrame,
    denied: Iterable[str] = DENIED_TYPES,
    dropped: Iterable[str] = DROPPED_FIELDS,
    fix_locale: bool = False,
) -> DataFrame:
    """Raw nested events to flat events of the retained types. One projection and one filter, no action."""
    return retain_event_types(flatten_events(raw, dropped, fix_locale), denied)


def split_hour(
    spark: SparkSession,
    source: str,
    split: str,
    *,
    denied: Iterable[str] = DENIED_TYPES,
    dropped: Iterable[str] = DROPPED_FIELDS,
    fix_locale: bool = False,
) -> None:
    """The raw JSON lines below one folder to gzip JSON lines in one folder per event type."""
    configure(spark)
    dropped = list(dropped)
    scratch = scratch_path(spark, "run")
    try:
        lines = spark.read.option("recursiveFileLookup", "true").text(source).withColumn("HOUR", F.lit("all"))
        staged = stage_lines(lines, ["all"], scratch)
        raw = read_staged(spark, staged, ["all"], kept_schema(staged.schemas["all"], dropped, fix_locale), None)
        write_split(split_events(raw, denied, dropped, fix_locale), split)
    finally:
        remove_tree(spark, scratch)


def stage_split(flat: DataFrame, path: str, hour: str = "hh") -> DataFrame:
    """Write flat events once, by hour and event type, and read them back.

    The raw text is parsed a single time; the later steps read only the columns and directories they need. The
    type is also kept as a column, since a directory name cannot tell an empty type from a missing one.
    """
    check_reserved(flat)
    split = flat.withColumn("et", F.col("event_type"))
    clustered(split, [hour, "et"]).write.partitionBy(hour, "et").parquet(path)
    return read_stage(flat, path, hour)


def read_stage(flat: DataFrame, path: str, hour: str = "hh") -> DataFrame:
    """What :func:`stage_split` wrote for these events."""
    fields = [f for f in flat.schema.fields if f.name not in (hour, "et")]
    partitions = [StructField(hour, StringType()), StructField("et", StringType())]
    return flat.sparkSession.read.schema(StructType([*fields, *partitions])).parquet(path)


def check_reserved(flat: DataFrame) -> None:
    """Raise if an event field has the name of the type's directory. Other names of ours hold a capital letter, which
    no event field does."""
    if "et" in flat.columns:
        raise ValueError("the events have a field named 'et', which is taken by the directory of the type")


def find_groups(
    split: DataFrame,
    hour: str = "hh",
    *,
    order: str = "text",
    order_by: Sequence[str] = (),
    rows: int | None = None,
    scratch: str | None = None,
) -> tuple[list[Group], dict[tuple[str, str | None], int]]:
    """The (hour, type) groups of a staged split that have a version, with the schemas that the rows of their newest
    version show, and the number of events by type that are left out as their group has none."""
    columns = [c for c in split.columns if c not in (hour, "et")]
    keys = [hour, "event_type"]
    if VERSION not in columns:
        left = split.groupBy("event_type").agg(F.count(F.lit(1)).alias("N"))
        return [], report_skipped({("no version", r["event_type"]): r["N"] for r in left.collect()})
    newest = materialise(newest_version(split, keys, order=order), "newest", scratch)
    held = [F.count(F.col(f"`{c}`")) for c in columns]
    counts = split.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"), F.array(*held).alias("HELD"))
    values = {(r[hour], r["event_type"]): (r["N"], dict(zip(columns, r["HELD"], strict=True))) for r in counts.collect()}
    shown = newest_rows(split, newest, keys, rows=rows, order_by=order_by)
    groups = [Group(*group, schema, values[group][1]) for group, schema in group_schemas(shown, columns, keys)]
    left = Counter()
    for group in values.keys() - {group[:2] for group in groups}:
        left["no version", group[1]] += values[group][0]
    return groups, report_skipped(dict(left))


def count_misfits(split: DataFrame, alike: Sequence[Group], hour: str = "hh") -> list[Narrowed]:
    """Values that became null, or lost elements, as they do not fit the schema that these groups have in common.

    One grouped aggregate over the columns whose type differs from the split's, and over the directories of the groups
    only; none, which is usual, costs no job. Counted from the staged table and not by observing the write, so that a
    write task that is repeated counts once.
    """
    schema = alike[0].schema
    found = {f.name: f.dataType for f in split.schema.fields}
    odd = [f for f in schema.fields if found[f.name].simpleString() != f.dataType.simpleString()]
    if not odd:
        return []
    typed = typed_columns(split, StructType(odd))
    part = split.where(_directory(hour).isin([f"{g.hour}/{g.event_type}" for g in alike]))
    pairs = part.select(
        hour, "event_type", *[F.col(f"`{f.name}`").alias(f"OLD{i}") for i, f in enumerate(odd)],
        *[column.alias(f"NEW{i}") for i, column in enumerate(typed)],
    )
    lost = []
    for i, field in enumerate(odd):
        old, new = F.col(f"OLD{i}"), F.col(f"NEW{i}")
        gone = old.isNotNull() & new.isNull()
        if isinstance(found[field.name], ArrayType) and isinstance(field.dataType, ArrayType):
            gone |= F.size(F.array_compact(new)) < F.size(F.array_compact(old))
        lost.append(F.count(F.when(gone, 1)))
    counts = pairs.groupBy(hour, "event_type").agg(F.array(*lost).alias("LOST")).collect()
    return [
        Narrowed(row[hour], row["event_type"], field.name, "misfit", n)
        for row in counts
        for field, n in zip(odd, row["LOST"], strict=True)
        if n
    ]


def narrowed_values(split: DataFrame, groups: Sequence[Group], hour: str = "hh", concurrent: int = 8) -> list[Narrowed]:
    """All values that narrowing takes from the events of these groups, see :class:`Narrowed`."""
    out = []
    for group in groups:
        kept = set(group.schema.names)
        lost = [(column, n) for column, n in group.values.items() if n and column not in kept]
        out += [Narrowed(group.hour, group.event_type, column, "dropped", n) for column, n in lost]
    with ThreadPoolExecutor(concurrent) as pool:
        for found in pool.map(lambda alike: count_misfits(split, alike, hour), same_schema(groups)):
            out += found
    by_reason = Counter()
    for lost in out:
        by_reason[lost.reason] += lost.n
    for reason, n in sorted(by_reason.items()):
        log.warning("narrowing took %d values: %s", n, reason)
    return out


def same_schema(groups: Sequence[Group]) -> list[list[Group]]:
    """The groups, with those of the same schema together."""
    by_schema: dict[str, list[Group]] = {}
    for group in groups:
        by_schema.setdefault(group.schema.json(), []).append(group)
    return list(by_schema.values())


def report_skipped(skipped: dict[tuple[str, str | None], int]) -> dict[tuple[str, str | None], int]:
    for (reason, kind), n in sorted(skipped.items(), key=str):
        log.warning("left out %d events%s: %s", n, "" if kind is None else f" of type {kind!r}", reason)
    return skipped


def _concurrently(jobs: Sequence[Callable[[], object]], concurrent: int) -> list:
    """Run write jobs side by side; the first error is raised after the jobs under way have ended."""
    with ThreadPoolExecutor(concurrent) as pool:
        running = [pool.submit(job) for job in jobs]
        try:
            return [job.result() for job in running]
        except BaseException:
            pool.shutdown(cancel_futures=True)
            raise


def _leased(spark: SparkSession, folder: str, job: Callable[[], object]) -> object:
    """Run a write job and say that its run is alive."""
    done = job()
    touch_lease(spark, folder)
    return done


def _directory(hour: str) -> Column:
    """Hour and type of a staged directory, for choosing directories without reading them."""
    return F.concat(F.col(hour), F.lit("/"), F.coalesce(F.col("et"), F.lit("")))


def write_staged(
    split: DataFrame, groups: Sequence[Group], staged: str, hour: str = "hh", max_rows: int = MAX_ROWS_PER_FILE
) -> list[Callable[[], object]]:
    """Jobs that write the groups of a split below ``staged``, one job for all groups with the same schema.

    A job reads only the directories of its groups and shuffles nothing.
    """

    def write(number: int, alike: list[Group]) -> None:
        part = split.where(_directory(hour).isin([f"{group.hour}/{group.event_type}" for group in alike]))
        typed = part.select(*typed_columns(split, alike[0].schema), "et", hour)
        write_parquet(typed, under(staged, str(number)), ["et", hour], max_rows=max_rows)

    return [partial(write, number, alike) for number, alike in enumerate(same_schema(groups))]


def write_groups(
    spark: SparkSession,
    found: Sequence[tuple[DataFrame, Sequence[Group]]],
    target: str,
    hours: Sequence[str],
    hour: str = "hh",
    *,
    publish: str = "move",
    staging: str | None = None,
    max_rows: int = MAX_ROWS_PER_FILE,
    concurrent: int = CONCURRENT_WRITES,
) -> list[str]:
    """Write the groups of some splits, each with the columns and types of its own schema, one job for each schema.

    ``move`` writes everything to a new folder below ``staging``, by default ``target``, and then renames the finished
    directories to ``target/type/hour/``. A failed write leaves the target as it was; types that the given hours no
    longer have are removed. ``run`` writes to ``target/run-.../n/et=type/hh=hour/``, on any store, and then makes the
    run current for its hours by one small file of the next number, which :func:`read_published` follows: whenever a run
    ends, the hours are all old or all new. Runs may end at the same time; each takes over its own hours and leaves the
    others to the runs that hold them, see :func:`switch_current`. The run that was current before stays for its readers
    until the next one, and a run that is still being written stays as long as it touches its lease.
    Returns the directories written, for ``run`` its folder.
    """
    if publish == "run":
        name = f"run-{uuid.uuid4().hex}"
        folder = under(target, name)
    else:
        folder = scratch_path(spark, "_staging", staging or target)
    try:
        jobs = []
        for number, (split, groups) in enumerate(found):
            place = under(folder, str(number)) if publish == "move" else under(folder, f"batch{number}")
            jobs += write_staged(split, groups, place, hour, max_rows)
        if publish == "run":
            touch_lease(spark, folder)
            jobs = [partial(_leased, spark, folder, job) for job in jobs]
        _concurrently(jobs, concurrent)
        if publish == "run":
            switch_current(spark, target, hours, name)
            remove_runs(spark, target)
            return [folder]
        moved = publish_partitions(spark, f"{folder}/*", target, ["et", hour])
        remove_stale(spark, target, hours, moved)
        return moved
    except BaseException:
        if publish == "run" and name not in read_current(spark, target).values():
            remove_tree(spark, folder)
        raise
    finally:
        if publish == "move":
            remove_tree(spark, folder)


def narrow_hour(
    spark: SparkSession,
    split: str,
    target: str,
    hour: str,
    *,
    hour_column: str = "hh",
    order: str = "text",
    order_by: Sequence[str] = (),
    rows: int | None = None,
    publish: str = "move",
    max_rows: int = MAX_ROWS_PER_FILE,
) -> Published:
    """What :func:`split_hour` wrote to Parquet under ``target/type/hour/``; options as for :func:`preprocess_day`."""
    configure(spark)
    scratch = scratch_path(spark, "run")
    events = read_split(spark, split).drop("et").withColumn(hour_column, F.lit(hour))
    try:
        staged = stage_split(events, under(scratch, "split"), hour_column)
        how = {"order": order, "order_by": order_by, "rows": rows, "scratch": scratch}
        groups, skipped = find_groups(staged, hour_column, **how)
        paths = write_groups(
            spark, [(staged, groups)], target, [hour], hour_column, publish=publish, max_rows=max_rows
        )
        return Published(paths, skipped, narrowed_values(staged, groups, hour_column))
    finally:
        remove_tree(spark, scratch)


def publish_wide(
    df: DataFrame,
    target: str,
    day: str,
    hour: str = "hh",
    *,
    order: str = "text",
    order_by: Sequence[str] = (),
    rows: int | None = None,
    max_rows: int = MAX_ROWS_PER_FILE,
    staged: bool = False,
    scratch: str | None = None,
) -> None:
    """Narrow flat events into one table under ``target``, partitioned by day, type and hour, in one committed write.

    Only the partitions of this run are replaced, so a rerun gives the same table. ``staged`` says that ``df`` comes
    from :func:`stage_split`, whose files already hold one partition each; other input is shuffled before the write.
    """
    if "dt" in df.columns:
        raise ValueError("the events have a column 'dt', which names the day's partition")
    if not staged:
        check_reserved(df)
    keys = [hour, "event_type"]
    narrowed = narrow_wide(df, keys, order=order, order_by=order_by, rows=rows, scratch=scratch)
    dated = narrowed.withColumn("et", F.col("event_type")).withColumn("dt", F.lit(day))
    partitions = ["dt", "et", hour]
    write_parquet(dated if staged else clustered(dated, partitions), target, partitions, "overwrite", max_rows)


def preprocess_day(
    spark: SparkSession,
    day: str,
    source: str,
    target: str,
    *,
    hours: Iterable[int] = range(24),
    schema: StructType | None = None,
    layout: str = "narrow",
    publish: str = "move",
    denied: Iterable[str] = DENIED_TYPES,
    dropped: Iterable[str] = DROPPED_FIELDS,
    fix_locale: bool = False,
    order: str = "text",
    order_by: Sequence[str] = (),
    rows: int | None = None,
    max_rows: int = MAX_ROWS_PER_FILE,
    hour_column: str = "hh",
    work: str | None = None,
) -> Published:
    """Events under ``source/yyyy/mm/dd/hh/`` to Parquet; the target is written after every hour was worked out.

    ``narrow`` writes ``target/yyyy/mm/dd/type/hh/``, each directory with the columns and types that the newest version
    of its events shows; for ``publish`` see :func:`write_groups`. ``wide`` writes one table under ``target`` with the
    partitions ``dt``, ``et`` and the hour. A given ``schema`` spares the scan that infers one. ``order`` is the order of
    versions. ``rows`` limits the rows of the newest version that are looked at, by default all, and ``order_by`` then
    orders them. Returns the directories published (narrow only), what was left out, and (narrow only) the values that
    narrowing took from the events that stay. Without a schema the raw files are read once, see :func:`stage_lines`.

    ``work`` names a folder for a run that may be repeated. What a run that failed or was killed has staged there is used
    again by the next one: raw lines of hours whose files have the same names, lengths and times, and events split from
    the same hours by the same rules. The folder is removed once the run has published; one run at a time may use it.
    """
    if layout not in ("narrow", "wide"):
        raise ValueError(f"layout must be 'narrow' or 'wide', not {layout!r}")
    if publish not in ("move", "run"):
        raise ValueError(f"publish must be 'move' or 'run', not {publish!r}")
    configure(spark)
    names = [hour_name(hour) for hour in hours]
    denied, dropped = list(denied), list(dropped)
    scratch = scratch_path(spark, "run")
    kept = Work(spark, under(work, f"day-{day}")) if work else None
    prints = input_prints(spark, source, day, names) if kept else {}
    narrowing = {"order": order, "order_by": order_by, "rows": rows, "scratch": scratch}
    skipped: Counter[tuple[str, str | None]] = Counter()

    def staged_split(batch: Sequence[str], batch_schema: StructType) -> DataFrame:
        if lines is None:
            raw = read_hours(spark, source, day, batch, batch_schema, hour_column)
        else:
            raw = read_staged(spark, lines, batch, batch_schema, hour_column)
        flat = flatten_events(raw, dropped, fix_locale)
        check_reserved(flat)
        rules = [source, day, {hour: prints.get(hour) for hour in batch}, batch_schema.json(), denied, dropped]
        depends = [*rules, fix_locale, hour_column]
        done = kept.find("split", depends) if kept else None
        if done:
            skipped.update(report_skipped({(reason, None): n for reason, n in done["skipped"].items()}))
            return read_stage(flat, done["folder"], hour_column)
        seen = Observation()
        observed = flat.observe(seen, *count_left_out(denied))
        place = scratch_path(spark, "split", kept.folder if kept else scratch)
        split = stage_split(retain_event_types(observed, denied), place, hour_column)
        try:
            counts = seen.get
        except Py4JJavaError:  # nothing is retained: Spark then drops the plan with the counts in it
            counts = flat.agg(*count_left_out(denied)).first().asDict()
        if kept:
            kept.finish("split", depends, {"folder": place, "skipped": {reason: n for reason, n in counts.items() if n}})
        skipped.update(report_skipped({(reason, None): n for reason, n in counts.items() if n}))
        return split

    try:
        lines = None
        if schema is None and kept:
            place = scratch_path(spark, "raw", kept.folder)
            lines = stage_hours(spark, source, day, names, place, kept, prints)
        elif schema is None:
            lines = stage_lines(hour_lines(spark, source, day, names), names, scratch_path(spark, "raw", scratch))
        if layout == "wide":
            found = schema or common_schema(lines.schemas.values())
            split = staged_split(names, kept_schema(found, dropped, fix_locale))
            publish_wide(split, target, day, hour_column, staged=True, max_rows=max_rows, **narrowing)
            if kept:
                remove_tree(spark, kept.folder)
            return Published([], skipped)
        if schema is None:
            batches = batch_hours(lines.schemas, dropped, fix_locale)
        else:
            batches = [(names, kept_schema(schema, dropped, fix_locale))]
        splits = [staged_split(batch, batch_schema) for batch, batch_schema in batches]
        grouped = []
        for split in splits:
            groups, left = find_groups(split, hour_column, **narrowing)
            grouped.append((split, groups))
            skipped.update(left)
        day_target = under(target, day_path(day))
        paths = write_groups(
            spark, grouped, day_target, names, hour_column, publish=publish, staging=target, max_rows=max_rows
        )
        narrowed = [lost for split, groups in grouped for lost in narrowed_values(split, groups, hour_column)]
        if kept:
            remove_tree(spark, kept.folder)
        return Published(paths, skipped, narrowed)
    finally:
        remove_tree(spark, scratch)


def with_place(events: DataFrame, hour_column: str = "hh") -> DataFrame:
    """Type and hour of the published directory that holds each row, as ``et`` and ``hour_column``."""
    parts = F.split(F.url_decode(F.col("_metadata.file_path")), "/")
    value = lambda i, name: F.regexp_replace(F.element_at(parts, i), f"^{name}=", "").alias(name)
    return events.select("*", value(-3, "et"), value(-2, hour_column))


def read_published(
    spark: SparkSession,
    target: str,
    day: str,
    event_type: str = "*",
    hour: str = "*",
    hour_column: str = "hh",
    place: bool = False,
) -> DataFrame:
    """Narrow output of a day as one table. A column whose type differs between hours or types has the least type that
    holds all its values, see :func:`read_reconciled`.

    If the day was published by runs, each hour is read from its current run. ``place`` adds the type and the hour of
    the directory.
    """
    folder = under(target, day_path(day))
    current = read_current(spark, folder)
    paths = [under(folder, event_type, hour)]
    if current:
        wanted = [(h, run) for h, run in sorted(current.items()) if hour in ("*", h)]
        for run in {run for _, run in wanted}:
            if not path_exists(spark, under(folder, run)):
                raise FileNotFoundError(f"{under(folder, run)} is current, but gone")
        paths = [under(folder, run, "*", "*", f"et={event_type}", f"{hour_column}={h}") for h, run in wanted]
        paths = [path for path in paths if glob_exists(spark, path)]
        if not paths:
            raise FileNotFoundError(f"nothing is published for type {event_type!r} and hour {hour!r} in {folder}")
    placed = partial(with_place, hour_column=hour_column) if place else lambda events: events
    return read_reconciled(spark, paths, placed)
