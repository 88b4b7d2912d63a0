"""The dialect's types and their Spark counterparts.

A type is a string, or ("array", type), or ("range", type).  Parquet columns are widened so that each has exactly one type:
all integers to int64, float32 to float64, zoned timestamps to plain ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BindError

NAMES = {
    "bool": "bool", "boolean": "bool", "int64": "int64", "bigint": "int64", "integer": "int64", "uint64": "uint64", "float": "float64", "float64": "float64", "double": "float64",
    "uuid": "uuid", "timestamp": "timestamp", "datetime": "timestamp", "json": "json", "jsonb": "json", "text": "text", "string": "text", "varchar": "text", "bytes": "bytes", "bytea": "bytes",
    "hstore": "hstore", "textvector": "textvector", "tsvector": "textvector",
}
SQL = {"bool": "BOOLEAN", "int64": "BIGINT", "uint64": "DECIMAL(20,0)", "float64": "DOUBLE", "uuid": "STRING", "timestamp": "TIMESTAMP_NTZ", "json": "STRING", "text": "STRING", "bytes": "BINARY", "hstore": "MAP<STRING, STRING>", "textvector": "ARRAY<STRUCT<term: STRING, positions: ARRAY<INT>, weight: STRING>>", "null": "VOID"}
SORTABLE = {"bool", "int64", "uint64", "float64", "uuid", "timestamp", "text", "bytes"}
#: Key of the field metadata that tells types which share a Spark type.
META = "marlwick.type"


def sql_type(t) -> str:
    """The Spark SQL name of a type."""
    if isinstance(t, tuple):
        inner = sql_type(t[1])
        return f"ARRAY<{inner}>" if t[0] == "array" else f"STRUCT<lower: {inner}, upper: {inner}, lower_inc: BOOLEAN, upper_inc: BOOLEAN, is_empty: BOOLEAN>"
    return SQL[t]


def name_of(t) -> str:
    if isinstance(t, tuple):
        return f"{name_of(t[1])}[]" if t[0] == "array" else f"range<{name_of(t[1])}>"
    return t


def from_name(text: str):
    """The type of name_of(type), for catalogs on disk."""
    if text.endswith("[]"):
        return ("array", from_name(text[:-2]))
    if text.startswith("range<"):
        return ("range", from_name(text[6:-1]))
    return text


def from_spark(kind: T.DataType, metadata: dict | None = None):
    """The type as which a Spark column is loaded."""
    if metadata and META in metadata:
        return from_name(metadata[META])
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "int64"
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "float64"
    if isinstance(kind, T.DecimalType) and (kind.precision, kind.scale) == (20, 0):
        return "uint64"
    if isinstance(kind, T.StringType):
        return "text"
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return "timestamp"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        return "hstore"
    if isinstance(kind, T.NullType):
        return "null"
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType) and kind.elementType.names == ["term", "positions", "weight"]:
            return "textvector"
        return ("array", from_spark(kind.elementType))
    if isinstance(kind, T.StructType) and kind.names == ["lower", "upper", "lower_inc", "upper_inc", "is_empty"]:
        return ("range", from_spark(kind["lower"].dataType))
    raise BindError(f"no type for {kind.simpleString()}")


def widened(df: DataFrame) -> tuple[DataFrame, list[tuple[str, object, bool]]]:
    """df with one Spark type for each of its columns' types, and (name, type, nullable) of the columns."""
    columns, out = [], []
    for f in df.schema.fields:
        t = from_spark(f.dataType, f.metadata)
        columns.append((f.name.lower(), t, f.nullable))
        c = F.col("`" + f.name.replace("`", "``") + "`")
        out.append((c if f.dataType.simpleString().upper().replace(":", ": ") == sql_type(t) else c.cast(sql_type(t))).alias(f.name.lower()))
    if len({c[0] for c in columns}) < len(columns):
        raise BindError("column names differ by case only")
    return df.select(*out), columns
