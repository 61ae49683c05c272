"""Narrow each group of events to the columns that the rows of its newest version show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, LongType, StringType, StructField, StructType

from sluicebox.functions.types import parse_variant_type, read_type
from sluicebox.operators.lookups import join_lookup
from sluicebox.operators.sampling import newest_version_sample
from sluicebox.operators.versions import KEYS, VERSION, newest_version
from sluicebox.session import materialise


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def column_counts(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Non-null values of every column per group: a column with none does not exist for that group."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.count(_col(c)).alias(f"n_{c}") for c in others])


def newest_rows(
    df: DataFrame,
    newest: DataFrame,
    keys: Sequence[str] = KEYS,
    version: str = VERSION,
    rows: int | None = None,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """The rows of each group's newest version: all of them, or the first ``rows``, ordered by ``order_by``."""
    if rows is not None:
        return newest_version_sample(df, newest, keys, version, rows, order_by).drop("sample_rank")
    return join_lookup(df, newest, [*keys, version]).select(*[f"`{c}`" for c in df.columns])


def column_flags(shown: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """One flag per column and group: do the rows hold a value? In the order of ``columns``."""
    return shown.groupBy(*keys).agg(F.array(*[F.count(_col(c)) > 0 for c in columns]).alias("SHOWN"))


def narrow_wide(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    version: str = VERSION,
    order_by: Sequence[str] = (),
    order: str = "text",
    rows: int | None = None,
    scratch: str | None = None,
) -> DataFrame:
    """All groups in one table: a column that a group's newest version never fills is null there, types stay as read.

    Groups without a version are left out. The newest versions and the flags are small written tables. ``rows`` limits
    the rows of the newest version that are looked at, ``order_by`` then orders them.
    """
    if version not in df.columns:
        return df.limit(0)
    others = [c for c in df.columns if c not in keys]
    newest = materialise(newest_version(df, keys, version, order), "newest", scratch)
    shown = newest_rows(df, newest, keys, version, rows, order_by)
    flags = materialise(column_flags(shown, others, keys), "flags", scratch)
    masked = {c: F.when(F.get("SHOWN", F.lit(i)), _col(c)).alias(c) for i, c in enumerate(others)}
    return join_lookup(df, flags, keys).select([masked.get(c, _col(c)) for c in df.columns])


def _json_text(df: DataFrame, columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[_col(c) for c in columns]))


def _plain(data_type: DataType) -> bool:
    """A type whose JSON text always reads as itself."""
    return isinstance(data_type, (BooleanType, DoubleType, LongType, StringType))


def group_schemas(
    shown: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS
) -> list[tuple[tuple, StructType]]:
    """The schema that each group's rows show as JSON, as (key values, schema), in the order of the names.

    Fields without a value do not exist, and a value shows the type that its text has. One grouped aggregate on the
    executors works this out over all rows: whether a plain column holds a value, and the merged type of the variants of
    any other one. A row of flags and type names for each group comes to the driver, no event does.
    """
    fields = [shown.schema[c] for c in sorted(columns)]
    count = [F.count(_col(f.name)) > 0 for f in fields]
    odd = [f for f in fields if not _plain(f.dataType)]
    types = [F.schema_of_variant_agg(F.parse_json(_json_text(shown, [f.name]))) for f in odd]
    found = shown.groupBy(*keys).agg(
        F.array(*count).alias("SHOWN"), F.array(*types, F.lit(None).cast("string")).alias("TYPES")
    )
    out, known = [], {}
    for row in found.collect():
        names = tuple(zip(row["SHOWN"], [f.name for f in fields])), tuple(row["TYPES"])
        if names not in known:
            known[names] = _schema(fields, row["SHOWN"], dict(zip([f.name for f in odd], row["TYPES"])))
        out.append((tuple(row[k] for k in keys), known[names]))
    return out


def _schema(fields: Sequence[StructField], shown: Sequence[bool], types: dict[str, str]) -> StructType:
    kept = []
    for field, present in zip(fields, shown, strict=True):
        if not present:
            continue
        if field.name not in types:
            kept.append(StructField(field.name, field.dataType))
            continue
        inner = read_type(parse_variant_type(types[field.name]))
        if inner is not None:
            kept += [StructField(field.name, f.dataType) for f in inner.fields]
    return StructType(kept)


def schema_table(shown: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """The group schemas as a table of (keys, DDL text)."""
    rows = [(*group, schema.simpleString()) for group, schema in group_schemas(shown, columns, keys)]
    key_types = ", ".join(f"`{k}` {shown.schema[k].dataType.simpleString()}" for k in keys)
    return shown.sparkSession.createDataFrame(rows, f"{key_types}, type_schema string")


def typed_columns(df: DataFrame, schema: StructType) -> list[Column]:
    """The columns of a sample schema, in its order and with its types.

    A column whose type agrees is passed on. Any other goes through its JSON text, which gives null where a value
    does not fit, as reading a file with that schema does.
    """
    found = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for field in schema.fields:
        if found[field.name].simpleString() == field.dataType.simpleString():
            columns.append(_col(field.name))
        else:
            parsed = F.from_json(_json_text(df, [field.name]), StructType([field]))
            columns.append(parsed.getField(field.name).alias(field.name))
    return columns
