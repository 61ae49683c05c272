"""Nested schema to flat columns: drop, flatten, filter by name, rename.

Everything here looks at the schema only, so that the result is one ``select`` which Spark can prune into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from sluicebox.functions.naming import check_distinct, column_name, keeps_path

# Top-level fields that are never kept.
DROPPED_FIELDS = ("awsAccountId", "client_context")


@dataclass(frozen=True)
class Leaf:
    """One flat column: field names from the root, and how many arrays enclose each step below the first."""

    parts: tuple[str, ...]
    enclosing_arrays: tuple[int, ...]

    @property
    def path(self) -> str:
        return ".".join(self.parts)

    def column(self) -> Column:
        value = F.col("`" + self.parts[0].replace("`", "``") + "`")
        for name, arrays in zip(self.parts[1:], self.enclosing_arrays, strict=True):
            value = _member(value, name, arrays)
        return value


def _member(value: Column, name: str, arrays: int) -> Column:
    # Spark reads a field through one array by itself; only arrays of arrays need a lambda.
    if arrays < 2:
        return value.getField(name)
    return F.transform(value, lambda inner: _member(inner, name, arrays - 1))


def leaves(schema: StructType) -> list[Leaf]:
    """Leaf paths in schema order. Structs, and arrays of structs, are entered; all else is a leaf."""
    found: list[Leaf] = []

    def enter(struct: StructType, parts: tuple[str, ...], steps: tuple[int, ...], arrays: int) -> None:
        for field in struct.fields:
            here = (*parts, field.name)
            taken = (*steps, arrays) if parts else ()
            inner, depth = field.dataType, arrays
            if isinstance(inner, ArrayType):
                inner, depth = inner.elementType, arrays + 1
            if isinstance(inner, StructType):
                enter(inner, here, taken, depth)
            else:
                found.append(Leaf(here, taken))

    enter(schema, (), (), 0)
    return found


def kept_leaves(schema: StructType, dropped: Iterable[str] = DROPPED_FIELDS) -> list[Leaf]:
    dropped = set(dropped)
    return [leaf for leaf in leaves(schema) if leaf.parts[0] not in dropped and keeps_path(leaf.path)]


def flat_columns(
    schema: StructType, dropped: Iterable[str] = DROPPED_FIELDS, fix_locale: bool = False
) -> list[tuple[Leaf, str]]:
    """The kept leaves and their column names; raises if two leaves share a name."""
    kept = kept_leaves(schema, dropped)
    names = [column_name(leaf.path, fix_locale) for leaf in kept]
    check_distinct([leaf.path for leaf in kept], names)
    return list(zip(kept, names, strict=True))


def flatten_events(
    df: DataFrame, dropped: Iterable[str] = DROPPED_FIELDS, fix_locale: bool = False
) -> DataFrame:
    """Drop, flatten, filter and rename as one projection."""
    dropped = list(dropped)
    columns = flat_columns(df.schema, dropped, fix_locale)
    return df.drop(*dropped).select([leaf.column().alias(name) for leaf, name in columns])


def prune_schema(schema: StructType, kept: Iterable[Leaf]) -> StructType:
    """The part of a nested schema that the kept leaves need.

    A JSON scan parses whole structs, so a schema without the dropped fields spares it their values.
    """
    tree: dict = {}
    for leaf in kept:
        node = tree
        for part in leaf.parts:
            node = node.setdefault(part, {})

    def cut(struct: StructType, wanted: dict) -> StructType:
        fields = [f for f in struct.fields if f.name in wanted]
        return StructType([StructField(f.name, cut_type(f.dataType, wanted[f.name]), f.nullable) for f in fields])

    def cut_type(data_type: DataType, wanted: dict) -> DataType:
        if not wanted:
            return data_type
        if isinstance(data_type, ArrayType):
            return ArrayType(cut_type(data_type.elementType, wanted), data_type.containsNull)
        return cut(data_type, wanted)

    return cut(schema, tree)
