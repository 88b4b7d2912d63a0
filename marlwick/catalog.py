"""What a session knows: tables, indexes, roles, grants, policies, triggers, procedures, functions and operators."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, field

from .errors import BindError
from .plans.parser import ColumnDef

DEFAULT_SCHEMA = "public"
SUPERUSER = "admin"


@dataclass
class Table:
    name: str
    columns: list[ColumnDef]
    owner: str
    #: Parquet paths of the rows, or a DataFrame that was registered
    paths: list[str] = field(default_factory=list)
    frame: object = None


@dataclass
class Index:
    name: str
    table: str
    keys: tuple
    method: str
    unique: bool


@dataclass
class Function:
    name: str
    args: tuple
    result: object
    call: str | None = None  # the registered Spark function, if it can be executed


@dataclass
class Catalog:
    tables: dict[str, Table] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    roles: set[str] = field(default_factory=lambda: {SUPERUSER})
    superusers: set[str] = field(default_factory=lambda: {SUPERUSER})
    decryptors: set[str] = field(default_factory=set)
    grants: set[tuple] = field(default_factory=set)  # (privilege, kind, name, role)
    policies: dict[str, dict[str, tuple]] = field(default_factory=dict)
    triggers: dict[str, tuple] = field(default_factory=dict)  # name -> (event, table, body)
    procedures: dict[tuple, str] = field(default_factory=dict)  # (name, types) -> body
    functions: dict[tuple, Function] = field(default_factory=dict)
    operators: dict[tuple, dict] = field(default_factory=dict)  # (symbol, left, right) -> options
    deny_by_default: bool = False

    def snapshot(self) -> Catalog:
        """A copy that later changes leave alone; rows are immutable files and need none."""
        out = copy.copy(self)
        out.tables = {k: copy.copy(t) for k, t in self.tables.items()}
        for t in out.tables.values():
            t.columns, t.paths = list(t.columns), list(t.paths)
        for attr in ("indexes", "roles", "superusers", "decryptors", "grants", "triggers", "procedures", "functions", "operators"):
            setattr(out, attr, copy.copy(getattr(self, attr)))
        out.policies = {k: dict(v) for k, v in self.policies.items()}
        return out

    @staticmethod
    def key(table: tuple) -> str:
        return f"{table[0] or DEFAULT_SCHEMA}.{table[1]}"

    def table(self, table: tuple) -> Table:
        try:
            return self.tables[self.key(table)]
        except KeyError:
            raise BindError(f"no table {table[1]}") from None

    def allowed(self, role: str, privilege: str, kind: str, name) -> bool:
        return role in self.superusers or kind == "table" and name in self.tables and self.tables[name].owner == role or (privilege, kind, name, role) in self.grants

    def bypasses(self, role: str, table: Table) -> bool:
        return role in self.superusers or table.owner == role


#: A Python function over Arrow-backed series.
Vectorised = Callable
