"""Types that can hold the values of several types, as the JSON reader widens them."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    MapType,
    NullType,
    StringType,
    StructField,
    StructType,
    VariantType,
)

# The digits of a long, and the most that a decimal has.
_LONG_DIGITS, _MAX_DIGITS = 20, 38


def _digits(data_type: DataType) -> tuple[int, int] | None:
    """Digits before and after the point of a whole number or a decimal."""
    if isinstance(data_type, IntegralType):
        return _LONG_DIGITS, 0
    if isinstance(data_type, DecimalType):
        return data_type.precision - data_type.scale, data_type.scale
    return None


def common_type(left: DataType, right: DataType) -> DataType:
    """The least type that holds the values of both sides; text where nothing else does.

    Whole numbers widen to decimals and these to doubles, structs hold the fields of both sides, arrays and maps widen
    what they hold.
    """
    if left == right or isinstance(right, NullType):
        return left
    if isinstance(left, NullType):
        return right
    if isinstance(left, StructType) and isinstance(right, StructType):
        return common_schema([left, right])
    if isinstance(left, ArrayType) and isinstance(right, ArrayType):
        return ArrayType(common_type(left.elementType, right.elementType))
    if isinstance(left, MapType) and isinstance(right, MapType) and left.keyType == right.keyType:
        return MapType(left.keyType, common_type(left.valueType, right.valueType))
    if isinstance(left, IntegralType) and isinstance(right, IntegralType):
        return max(left, right, key=lambda t: ["tinyint", "smallint", "int", "bigint"].index(t.simpleString()))
    numbers = [_digits(left), _digits(right)]
    if None not in numbers:
        before, after = (max(pair) for pair in zip(*numbers))
        return DecimalType(before + after, after) if before + after <= _MAX_DIGITS else DoubleType()
    real = (DoubleType, FloatType)
    if all(isinstance(t, real) or _digits(t) for t in (left, right)):
        return DoubleType()
    return StringType()


def common_schema(schemas: Iterable[StructType]) -> StructType:
    """All fields of all schemas, by name, each with the least type that holds it."""

    def merge(left: dict[str, DataType], right: StructType) -> dict[str, DataType]:
        new = {f.name: common_type(left[f.name], f.dataType) if f.name in left else f.dataType for f in right.fields}
        return {**left, **new}

    fields = reduce(merge, schemas, {})
    return StructType([StructField(name, fields[name]) for name in sorted(fields)])


def widen(value: Column, found: DataType, wanted: DataType) -> Column:
    """Values of one type as a type that :func:`common_type` gave for it. What becomes text is spelled as JSON, if it
    holds more than one value, else as Spark casts it. No value becomes null."""
    if found == wanted:
        return value
    if isinstance(wanted, StringType):
        return F.to_json(value) if isinstance(found, (StructType, ArrayType, MapType)) else value.cast("string")
    if isinstance(found, StructType) and isinstance(wanted, StructType):
        had = {f.name: f.dataType for f in found.fields}
        parts = [
            widen(value.getField(f.name), had[f.name], f.dataType) if f.name in had else F.lit(None).cast(f.dataType)
            for f in wanted.fields
        ]
        named = F.struct(*[part.alias(f.name) for part, f in zip(parts, wanted.fields, strict=True)])
        return F.when(value.isNotNull(), named)
    if isinstance(found, ArrayType) and isinstance(wanted, ArrayType):
        return F.transform(value, lambda inner: widen(inner, found.elementType, wanted.elementType))
    if isinstance(found, MapType) and isinstance(wanted, MapType):
        return F.transform_values(value, lambda _, inner: widen(inner, found.valueType, wanted.valueType))
    return value.cast(wanted)


def read_type(data_type: DataType) -> DataType | None:
    """The type that the JSON reader gives to values whose variants have this type; None for an empty struct."""
    if isinstance(data_type, StructType):
        fields = [(f.name, read_type(f.dataType)) for f in data_type.fields]
        kept = [StructField(name, inner) for name, inner in fields if inner is not None]
        return StructType(sorted(kept, key=lambda f: f.name)) if kept else None
    if isinstance(data_type, ArrayType):
        inner = read_type(data_type.elementType)
        return None if inner is None else ArrayType(inner)
    if isinstance(data_type, DecimalType):
        # Whole numbers of less than 19 digits are longs, so a short decimal was written with a point.
        return data_type if data_type.scale == 0 and data_type.precision >= 19 else DoubleType()
    if isinstance(data_type, FloatType):
        return DoubleType()
    return StringType() if isinstance(data_type, (NullType, VariantType)) else data_type


def parse_variant_type(text: str) -> DataType:
    """The type that Spark spells as the schema of a variant; names may be quoted."""
    parts = re.split(r"(`(?:[^`]|``)*`)", text)
    return DataType.fromDDL("".join(p if p.startswith("`") else p.replace("OBJECT<", "STRUCT<") for p in parts))


def ambiguous(text: str) -> bool:
    """Does the merged type of variants leave open what the JSON reader would say? Whole numbers beyond a long, and longs
    beside numbers such as ``1.0``, give the same decimal."""
    return re.search(r"DECIMAL\((19|[23]\d),0\)", text) is not None
