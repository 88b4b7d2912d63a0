"""The casts of the dialect; text that doesn't spell a value of the type is an error."""

from __future__ import annotations

import json

import pandas as pd

from ..errors import BindError
from ..types import name_of
from .text import fail, quoted

FINITE = "the number is not finite"


def finite(x: str) -> str:
    """A double that must be finite; -0.0 becomes 0.0."""
    return f"(CASE WHEN isnan({x}) OR abs({x}) = double('infinity') THEN {fail(FINITE, 'DOUBLE')} ELSE {x} + 0.0D END)"


def _spelt(x: str, pattern: str, value: str, kind: str, what: str) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} RLIKE {quoted(pattern)} THEN {value} ELSE {fail(f'not a {what}', kind)} END)"


def _float_text(x: str) -> str:
    """Digits without an exponent, and without a fraction that is zero, as far as 38 digits go."""
    whole = f"CAST(CAST({x} AS DECIMAL(38, 0)) AS STRING)"
    small = f"regexp_replace(CAST(CAST({x} AS DECIMAL(38, 30)) AS STRING), '\\\\.?0+$', '')"
    return f"(CASE WHEN {x} = floor({x}) AND abs({x}) < 1e37 THEN {whole} WHEN abs({x}) < 1e-3 AND abs({x}) > 1e-25 THEN {small} ELSE CAST({x} AS STRING) END)"


def _timestamp_text(x: str) -> str:
    fraction = f"regexp_replace(date_format({x}, '.SSSSSS'), '\\\\.?0+$', '')"
    return f"concat(date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss\"), {fraction}, 'Z')"


def cast(x: str, source, target) -> str:
    if source == target:
        return x
    if source == "null":
        from ..types import sql_type

        return f"CAST(NULL AS {sql_type(target)})"
    pair = (source, target)
    if pair == ("int64", "text"):
        return f"CAST({x} AS STRING)"
    if pair == ("text", "int64"):
        return _spelt(x, "^[+-]?[0-9]+$", f"CAST({x} AS BIGINT)", "BIGINT", "number")
    if pair == ("int64", "float64"):
        return f"CAST({x} AS DOUBLE)"
    if pair == ("float64", "text"):
        return _float_text(x)
    if pair == ("text", "float64"):
        return _spelt(x, "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$", finite(f"CAST({x} AS DOUBLE)"), "DOUBLE", "number")
    if pair == ("uuid", "text") or pair == ("json", "text"):
        return x
    if pair == ("text", "uuid"):
        return _spelt(x, "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", f"lower({x})", "STRING", "UUID")
    if pair == ("timestamp", "text"):
        return _timestamp_text(x)
    if pair == ("text", "timestamp"):
        plain = f"CAST(replace(replace({x}, 'T', ' '), 'Z', '') AS TIMESTAMP_NTZ)"
        return _spelt(x, "^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{1,6})?Z?$", plain, "TIMESTAMP_NTZ", "timestamp")
    if pair == ("bool", "text"):
        return f"CAST({x} AS STRING)"
    if pair == ("text", "bool"):
        return _spelt(x, "^(?i)(true|false)$", f"(lower({x}) = 'true')", "BOOLEAN", "boolean")
    if pair == ("text", "json"):
        return f"mw_json({x})"
    raise BindError(f"no cast from {name_of(source)} to {name_of(target)}")


def canonical_json(text):
    if text is None:
        return None

    def constant(name):
        raise ValueError(f"{name} is not JSON")

    return json.dumps(json.loads(text, parse_constant=constant), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def register(spark) -> None:
    from pyspark.sql.functions import pandas_udf

    def to_json(text: pd.Series) -> pd.Series:
        return text.map(canonical_json, na_action="ignore")

    spark.udf.register("mw_json", pandas_udf(to_json, "string"))
