"""Logical types and their Spark types."""

from __future__ import annotations

from datetime import UTC, date, datetime

from pyspark.sql import types as T

LOGICAL = ("STRING", "TEXT", "INTEGER", "BIGINT", "NUMBER", "MONEY", "DAY", "DATETIME", "BOOL", "DICT", "UNKNOWN")

#: Other names that a model may use.
ALIASES = {
    "VARCHAR": "TEXT", "CHAR": "TEXT", "NVARCHAR": "TEXT", "CLOB": "TEXT",
    "SMALLINT": "INTEGER", "TINYINT": "INTEGER", "INT": "INTEGER", "LONG": "BIGINT",
    "DECIMAL": "NUMBER", "NUMERIC": "NUMBER", "FLOAT": "NUMBER", "DOUBLE": "NUMBER", "REAL": "NUMBER", "BIGDECIMAL": "NUMBER",
    "DATE": "DAY", "TIMESTAMP": "DATETIME", "TIME": "DATETIME", "BIT": "BOOL", "BOOLEAN": "BOOL",
}

SPARK = {
    "STRING": T.StringType(), "TEXT": T.StringType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType(), "NUMBER": T.DecimalType(38, 10),
    "MONEY": T.DecimalType(18, 2), "DAY": T.DateType(), "DATETIME": T.TimestampType(), "BOOL": T.BooleanType(),
}

#: Formats of date parameters, by their length.
DATE_FORMATS = {19: "%Y-%m-%d %H:%M:%S", 16: "%Y-%m-%d %H:%M", 13: "%Y-%m-%d %H", 10: "%Y-%m-%d", 7: "%Y-%m"}


def logical(code: str | None) -> str:
    """The logical type that a code or alias names; UNKNOWN for anything else."""
    code = (code or "").upper()
    return code if code in LOGICAL else ALIASES.get(code, "UNKNOWN")


def spark_type(code: str | None, found: T.DataType | None = None) -> T.DataType | None:
    """Type to read a column as; floating columns stay floating, unknown types as found."""
    kind = logical(code)
    if kind in ("NUMBER", "MONEY") and isinstance(found, T.FractionalType):
        return found
    return SPARK.get(kind, found)


def logical_of(found: T.DataType) -> str:
    for kinds, name in (((T.StringType,), "STRING"), ((T.ByteType, T.ShortType, T.IntegerType), "INTEGER"), ((T.LongType,), "BIGINT"), ((T.FractionalType,), "NUMBER"), ((T.DateType,), "DAY"), ((T.TimestampType, T.TimestampNTZType), "DATETIME"), ((T.BooleanType,), "BOOL")):
        if isinstance(found, kinds):
            return name
    return "UNKNOWN"


def dimension_type(code: str | None) -> str:
    """Kind of a dimension, by the type of its column."""
    return {"DATETIME": "DATETIME", "DICT": "DICT", "BOOL": "BOOL", "DAY": "DAY", "NUMBER": "DOUBLE", "MONEY": "DOUBLE", "INTEGER": "INTEGER", "BIGINT": "INTEGER"}.get(logical(code), "NORMAL")


def condition_type(code: str | None, is_dimension: bool = False, has_dictionary: bool = False) -> str:
    """Kind of filter that a form offers for a field."""
    if has_dictionary:
        return "DICT"
    if is_dimension:
        return "DIM"
    return {"BOOL": "BOOL", "DATETIME": "DATE_RANGE", "DAY": "DAY_RANGE", "NUMBER": "DOUBLE", "MONEY": "DOUBLE", "INTEGER": "INTEGER", "BIGINT": "INTEGER", "DICT": "DICT"}.get(logical(code), "COMMON")


def to_datetime(value: object) -> datetime | None:
    """A date parameter; numbers are milliseconds since 1970 (UTC), what can't be read is None."""
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, int):
        return datetime.fromtimestamp(value / 1000, UTC).replace(tzinfo=None)
    text = str(value).strip()
    try:
        if len(text) > 20:
            return datetime.fromisoformat(text.replace("Z", "+00:00")).replace(tzinfo=None)
        return datetime.strptime(text, DATE_FORMATS[len(text)])
    except (KeyError, ValueError):
        return None


def parameter(value: object, code: str | None) -> object:
    """A request's value as a field of this logical type compares it."""
    if isinstance(value, (list, tuple)):
        return [parameter(v, code) for v in value]
    kind = logical(code)
    if kind in ("DAY", "DATETIME") and value is not None:
        when = to_datetime(value)
        return when.date() if when is not None and kind == "DAY" else when
    return value
