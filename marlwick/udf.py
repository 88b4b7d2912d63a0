"""Definitions of user functions, by kind, and how Spark runs each kind.

Scalar functions are called from the dialect (Session.create_function).  The dialect has no call syntax for aggregate, table and
window functions; those definitions are resolved by name and exact argument types, as scalar ones are, and run on DataFrames.
All work on Arrow batches; none is called row by row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .errors import BindError
from .types import name_of, sql_type

KINDS = ("scalar", "aggregate", "table", "window")


@dataclass(frozen=True)
class Definition:
    name: str
    kind: str
    arguments: tuple
    result: object  # a type; for table functions, (name, type) columns
    implementation: Callable


class Registry:
    """Definitions by name and argument types; names may be overloaded."""

    def __init__(self):
        self.held: dict[tuple, Definition] = {}

    def define(self, name: str, kind: str, arguments: tuple, result, implementation: Callable) -> Definition:
        if kind not in KINDS:
            raise BindError(f"unknown kind of function: {kind}")
        key = (name.lower(), tuple(arguments))
        if key in self.held:
            raise BindError(f"the function {name} exists for these types")
        self.held[key] = Definition(name.lower(), kind, tuple(arguments), result, implementation)
        return self.held[key]

    def resolve(self, name: str, arguments: tuple) -> Definition:
        try:
            return self.held[(name.lower(), tuple(arguments))]
        except KeyError:
            raise BindError(f"no function {name}({', '.join(map(name_of, arguments))})") from None

    def column(self, name: str, arguments: tuple, *columns: str) -> Column:
        """A scalar, aggregate (series to scalar) or window function (with .over) as a column."""
        d = self.resolve(name, arguments)
        if d.kind == "table":
            raise BindError(f"{name} is a table function")
        return F.pandas_udf(d.implementation, sql_type(d.result))(*columns)

    def table(self, name: str, arguments: tuple, rows: DataFrame) -> DataFrame:
        """A table function over rows: an iterator of data frames to an iterator of data frames."""
        d = self.resolve(name, arguments)
        if d.kind != "table":
            raise BindError(f"{name} is no table function")
        return rows.mapInPandas(d.implementation, ", ".join(f"`{n}` {sql_type(t)}" for n, t in d.result))
