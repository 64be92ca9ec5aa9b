"""Type names, PostgreSQL aliases and conversions between types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names and the Spark types that hold them.
TYPES: dict[str, T.DataType] = {
    "string": T.StringType(), "text": T.StringType(), "varchar": T.StringType(), "char": T.StringType(),
    "number": T.DoubleType(), "smallint": T.ShortType(), "integer": T.IntegerType(), "bigint": T.LongType(),
    "real": T.FloatType(), "double": T.DoubleType(), "numeric": T.DecimalType(38, 18), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampNTZType(), "json": T.StringType(), "jsonb": T.StringType(),
    "uuid": T.StringType(), "binary": T.BinaryType(),
    "real[]": T.ArrayType(T.FloatType()), "double[]": T.ArrayType(T.DoubleType()), "text[]": T.ArrayType(T.StringType()),
    "serial": T.IntegerType(), "bigserial": T.LongType(), "smallserial": T.ShortType(),
}
#: Other spellings.
ALIASES = {
    "int2": "smallint", "int4": "integer", "int": "integer", "int8": "bigint", "float4": "real", "float8": "double", "double precision": "double",
    "bool": "boolean", "bpchar": "char", "character": "char", "character varying": "varchar", "decimal": "numeric", "bytea": "binary",
    "float4[]": "real[]", "float8[]": "double[]", "timestamp without time zone": "timestamp", "serial4": "serial", "serial8": "bigserial", "serial2": "smallserial",
}
SERIAL = frozenset(("serial", "bigserial", "smallserial"))
_SIZED = re.compile(r"^([a-z0-9_ ]+?)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)$")
_UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def name_of(declared: str) -> tuple[str, tuple[int, ...]]:
    """The canonical name and the sizes in parentheses."""
    text = " ".join(declared.strip().lower().split())
    sizes: tuple[int, ...] = ()
    if m := _SIZED.match(text):
        text, sizes = m[1].strip(), tuple(int(x) for x in m.groups()[1:] if x)
    name = ALIASES.get(text, text)
    if name not in TYPES:
        raise ValueError(f"unknown type: {declared}")
    return name, sizes


def spark_type(declared: str) -> T.DataType:
    name, sizes = name_of(declared)
    if name == "numeric" and sizes:
        return T.DecimalType(sizes[0], sizes[1] if len(sizes) > 1 else 0)
    return TYPES[name]


def _dashed(uuid: Column) -> Column:
    """A UUID as PostgreSQL shows it."""
    return F.regexp_replace(F.lower(F.regexp_replace(uuid, "-", "")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def convert(value: Column, declared: str) -> Column:
    """A value on its way into a column of this type: errors out of range, as the engine's inserts do."""
    name, sizes = name_of(declared)
    if name == "uuid":
        text = F.nullif(F.trim(value.cast("string")), F.lit(""))
        return F.when(text.isNull() | text.rlike(_UUID), _dashed(text)).otherwise(F.raise_error(F.concat(F.lit("invalid uuid: "), text)))
    if name in ("varchar", "char") and sizes:
        text = value.cast("string")
        return F.when(text.isNull() | (F.length(text) <= sizes[0]), text).otherwise(F.raise_error(F.lit(f"value too long for {declared}")))
    if name in ("json", "jsonb"):
        return F.to_json(F.parse_json(value.cast("string")))
    return value.cast(spark_type(declared))


def try_convert(value: Column, declared: str) -> Column:
    """The same, but null where the value doesn't fit."""
    name, _ = name_of(declared)
    if name == "uuid":
        text = F.trim(value.cast("string"))
        return F.when(text.rlike(_UUID), _dashed(text))
    if name in ("json", "jsonb"):
        return F.to_json(F.try_parse_json(value.cast("string")))
    return value.try_cast(spark_type(declared))


def is_valid(value: Column, declared: str) -> Column:
    return value.isNull() | try_convert(value, declared).isNotNull()


def infer(value: object) -> str:
    """The type name of a Python value, for tables that are created by their first rows."""
    import datetime
    import decimal

    for kinds, name in (((bool,), "boolean"), ((int,), "bigint"), ((float,), "double"), ((decimal.Decimal,), "numeric"), ((datetime.datetime,), "timestamp"), ((datetime.date,), "date"), ((bytes, bytearray), "binary"), ((dict, list), "json")):
        if isinstance(value, kinds):
            return name
    return "string"
