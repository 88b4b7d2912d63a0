"""Sessions: statements in, DataFrames, row counts or texts out."""

from __future__ import annotations

import re
import time
import uuid
import weakref
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import SUPERUSER, Catalog, Function, Index, Table
from .errors import BindError, ConstraintError, SecurityError
from .functions import casts, fts
from .functions.scalars import Col, Scope
from .functions.text import name, quoted
from .operators.ranking import TASK_BYTES, input_bytes, sort_key, sorted_by_range, sorted_bytes, with_rank
from .operators.relational import Lowered, Relational
from .plans.parser import ColumnDef, Query, Recursive, Select, parse
from .sources.store import Store, load_parquet
from .types import name_of, sql_type, widened

RECURSION_LIMIT = 999
#: Files of a table beyond which INSERT writes them into one.
MOST_FILES = 64
UNIQUE_METHODS = {"btree", "hash"}
#: Spark sessions that have the settings and functions which the dialect needs.
_READY: weakref.WeakSet = weakref.WeakSet()


@dataclass
class Result:
    """Of a statement: rows, a number of rows affected, or a text."""

    kind: str  # rows, affected, schema, text
    rows: DataFrame | None = None
    affected: int = 0
    text: str = ""


class Pending:
    """A statement under way in a job group of its own."""

    def __init__(self, session: Session, text: str):
        self.session, self.group, self.outcome, self.error = session, f"marlwick-{uuid.uuid4().hex}", None, None

        def work():
            session.spark.sparkContext.setJobGroup(self.group, text, True)
            try:
                out = session.execute(text)
                self.outcome = out.rows.collect() if out.rows is not None else out
            except BaseException as e:  # handed on to whoever asks for the result
                self.error = e

        self.thread = InheritableThread(target=work, daemon=True)
        self.thread.start()

    def cancel(self) -> None:
        self.session.spark.sparkContext.cancelJobGroup(self.group)

    def result(self, timeout: float | None = None):
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError("the statement is still running")
        if self.error:
            raise self.error
        return self.outcome


KEY_PROPERTY = "marlwick.encryption.key"


class Session(Relational):
    """Runs the dialect over tables.  strict=True also refuses what the dialect's original restrictions refuse."""

    #: Rows of a ranking window, in bytes of a sort, up to which one task ranks them all.
    one_task_bytes = TASK_BYTES

    def __init__(self, spark: SparkSession, role: str = SUPERUSER, strict: bool = False, folder: str | None = None, catalog: Catalog | None = None, encryption_key: str | None = None):
        super().__init__()
        self.spark, self.role, self.strict = spark, role, strict
        self.catalog, self.store = catalog or Catalog(), Store(spark, folder)
        self.saved: Catalog | None = None
        self.key_view = self._hidden(encryption_key)
        self.views: dict[int, tuple[str, object]] = {}
        self.running: list = []
        self.cte = None
        if spark not in _READY:
            spark.conf.set("spark.sql.ansi.enabled", "true")
            spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
            casts.register(spark)
            fts.register(spark)
            _READY.add(spark)

    def as_role(self, role: str) -> Session:
        """A session of another role over the same catalog."""
        if role not in self.catalog.roles:
            raise BindError(f"no role {role}")
        out = Session(self.spark, role, self.strict, self.store.folder, self.catalog)
        out.key_view = self.key_view
        return out

    def _hidden(self, key: str | None) -> str | None:
        """A view whose only row is the key of encrypted columns, of 16, 24 or 32 bytes.  Plans, logs and EXPLAIN show its name only.

        Statements read it by a scalar subquery, whose value Spark hands to the tasks, so executors need nothing before.  The row
        is an RDD's: the optimizer would evaluate rows that it holds itself.  Without a key every JVM gets the property KEY_PROPERTY
        by spark.driver.extraJavaOptions and spark.executor.extraJavaOptions.  There is no default key."""
        if key is None:
            return None
        sc, jvm, js = self.spark.sparkContext, self.spark._jvm, self.spark._jsparkSession
        values, held = sc._gateway.new_array(jvm.java.lang.Object, 1), jvm.java.util.ArrayList()
        values[0] = key
        held.add(jvm.org.apache.spark.sql.RowFactory.create(values))
        kind = js.parseDataType(T.StructType([T.StructField("k", T.StringType(), False)]).json())
        label = f"mw_key_{uuid.uuid4().hex}"
        DataFrame(js.createDataFrame(sc._jsc.parallelize(held, 1), kind), self.spark).createOrReplaceTempView(label)
        return label

    def _key(self) -> str:
        if self.key_view is not None:
            return f"(SELECT k FROM {self.key_view})"
        if self.spark._jvm.System.getProperty(KEY_PROPERTY) is None:
            raise SecurityError("there is no key for encrypted columns")
        return f"java_method('java.lang.System', 'getProperty', {quoted(KEY_PROPERTY)})"

    # --- tables

    def register(self, table: str, frame: DataFrame, owner: str | None = None) -> None:
        """A DataFrame as a read-only table."""
        df, columns = widened(frame)
        key = Catalog.key((None, table.lower()))
        self.catalog.tables[key] = Table(key, [ColumnDef(n, t, null) for n, t, null in columns], owner or self.role, frame=df)

    def register_parquet(self, folder: str, *tables: str) -> Session:
        for t in tables:
            self.register(t, load_parquet(self.spark, folder, t))
        return self

    def view(self, t: Table) -> str:
        """A temporary view over the present rows of a table."""
        mark = (id(t.frame), tuple(t.paths), tuple(t.columns))
        known = self.views.get(t.name)
        if known is None or known[1] != mark:
            label = f"mw_{uuid.uuid4().hex}"
            self.store.read(t).createOrReplaceTempView(label)
            self.views[t.name] = known = (label, mark, t.frame)
        return known[0]

    def table(self, table: tuple) -> Lowered:
        if self.cte and table == (None, self.cte[0]):
            return Lowered(f"SELECT * FROM {name(self.cte[0])}", self.cte[1])
        t = self.catalog.table(table)
        self.require("select", t)
        cols = [(c.name, c.type, c.nullable) for c in t.columns]
        sql = self._decrypted(t)
        policy = self.policy(t)
        if policy is not None:
            a = self.alias()
            scope = Scope([Col(table[1], n, f"{a}.{name(n)}", k, null) for n, k, null in cols])
            sql = f"SELECT {a}.* FROM ({sql}) {a} WHERE {self.scalars.boolean(policy, scope, True)}"
        return Lowered(sql, cols)

    def _decrypted(self, t: Table) -> str:
        if not any(c.encrypted for c in t.columns):
            return f"SELECT * FROM {self.view(t)}"
        if self.role not in self.catalog.superusers | self.catalog.decryptors:
            raise SecurityError(f"{self.role} has no right to decrypt")
        key = self._key()
        cols = [f"CAST(CAST(aes_decrypt({name(c.name)}, {key}, 'GCM') AS STRING) AS {sql_type(c.type)}) AS {name(c.name)}" if c.encrypted else name(c.name) for c in t.columns]
        return f"SELECT {', '.join(cols)} FROM {self.view(t)}"

    def has_index(self, table: tuple, column: str) -> bool:
        return any(i.table == Catalog.key(table) and i.keys[0] == ("col", None, column) for i in self.catalog.indexes.values())

    def has_policy(self, table: tuple) -> bool:
        return self.policy(self.catalog.table(table)) is not None

    # --- rights

    def require(self, privilege: str, t: Table) -> None:
        if not self.catalog.allowed(self.role, privilege, "table", t.name):
            raise SecurityError(f"{self.role} has no right to {privilege.upper()} on {t.name}")

    def policy(self, t: Table) -> tuple | None:
        """All policies of a table must hold; superusers and the owner bypass them."""
        if self.catalog.bypasses(self.role, t):
            return None
        all_ = list(self.catalog.policies.get(t.name, {}).values())
        if not all_:
            return ("bool", False) if self.catalog.deny_by_default else None
        out = all_[0]
        for p in all_[1:]:
            out = ("and", out, p)
        return out

    # --- functions and operators

    def create_function(self, function: str, arguments: tuple, result, implementation=None) -> None:
        """A scalar function; implementation works on pandas series, one for each argument."""
        label = None
        if implementation is not None:
            from pyspark.sql.functions import pandas_udf

            label = f"mw_{function}_{uuid.uuid4().hex[:8]}"
            self.spark.udf.register(label, pandas_udf(implementation, sql_type(result)))
        self.catalog.functions[(function.lower(), tuple(arguments))] = Function(function, tuple(arguments), result, label)

    def function(self, f: str, args: list) -> tuple[str, object]:
        hits = [x for (n, kinds), x in self.catalog.functions.items() if n == f and len(kinds) == len(args) and all(k == a[1] or a[1] == "null" for k, a in zip(kinds, args))]
        if len(hits) != 1:
            raise BindError(f"no function {f}({', '.join(name_of(a[1]) for a in args)})")
        if hits[0].call is None:
            raise BindError(f"the function {f} has no implementation")
        return f"{hits[0].call}({', '.join(casts.cast(*a, k) if a[1] == 'null' else a[0] for a, k in zip(args, hits[0].args))})", hits[0].result

    def custom_operator(self, op: str, a, b) -> tuple[str, object]:
        options = self.catalog.operators.get((op, a[1], b[1]))
        if options is None:
            raise BindError(f"no operator {name_of(a[1])} {op} {name_of(b[1])}")
        return self.function(options["function"], [a, b])

    # --- statements

    def sql(self, text: str) -> DataFrame:
        """The rows of a query."""
        out = self.execute(text)
        if out.rows is None:
            raise BindError("the statement has no rows")
        return out.rows

    def execute(self, text: str) -> Result:
        return self.run(parse(text))

    def lower(self, statement) -> Lowered:
        return self.recursive(statement, RECURSION_LIMIT) if isinstance(statement, Recursive) else self.query(statement)

    def frame(self, q: Lowered) -> DataFrame:
        names = [n for n, _, _ in q.cols]
        if q.ranked:
            base = self.spark.sql(q.ranked.base)
            # a window over the whole table is one task; beyond a size the ranks are made partition by partition.  The estimate
            # only spares the count of what is large
            if input_bytes(base) > self.one_task_bytes or sorted_bytes(base) > self.one_task_bytes:
                return self._ranked(q, base).toDF(*names)
        return self.spark.sql(q.sql).toDF(*names)

    def _ranked(self, q: Lowered, df: DataFrame) -> DataFrame:
        r = q.ranked
        for i, function, keys in r.windows:
            df = with_rank(df, f"c{i}", function, keys, r.keys if function == "row_number" else [])
        order = [sort_key(*k) for k in r.keys]
        if order and (r.offset or r.limit is not None):
            df = df.orderBy(*order)
        elif order:
            df = sorted_by_range(df, order)
        if r.offset:
            df = df.offset(r.offset)
        if r.limit is not None:
            df = df.limit(r.limit)
        return df.select(*(f"c{i}" for i in range(len(q.cols))))

    def execute_async(self, text: str) -> Pending:
        """Runs a statement in a thread; rows are collected.  It can be cancelled while it runs."""
        return Pending(self, text)

    def run(self, statement) -> Result:
        if isinstance(statement, (Query, Recursive, Select)):
            return Result("rows", self.frame(self.lower(statement)))
        return getattr(self, "do_" + statement[0])(*statement[1:])

    def do_explain(self, options: frozenset, statement) -> Result:
        if not isinstance(statement, (Query, Recursive)):
            raise BindError("EXPLAIN takes a query")
        df = self.frame(self.lower(statement))
        mode = "cost" if "costs" in options else "formatted" if "physical" in options else "extended"
        q = df._jdf.queryExecution()
        text = q.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        if "analyze" in options:
            began = time.perf_counter()
            n = df.count()
            text += f"\nAnalyze rows={n} elapsed_us={int((time.perf_counter() - began) * 1e6)}"
        return Result("text", text=text)

    # transactions: the catalog is copied, the files are never changed

    def do_begin(self) -> Result:
        if self.saved is not None:
            raise BindError("a transaction is open")
        self.saved = self.catalog.snapshot()
        return Result("text", text="BEGIN")

    def do_commit(self) -> Result:
        if self.saved is None:
            raise BindError("no transaction is open")
        self.saved = None
        return Result("text", text="COMMIT")

    def do_rollback(self) -> Result:
        if self.saved is None:
            raise BindError("no transaction is open")
        self._restore(self.saved)
        self.saved = None
        return Result("text", text="ROLLBACK")

    def _restore(self, catalog: Catalog) -> None:
        """Puts a snapshot back into the catalog that roles' sessions share."""
        self.catalog.__dict__.update(catalog.__dict__)

    def checkpoint(self, folder: str) -> None:
        self.store.checkpoint(self.catalog, folder)

    def restore(self, folder: str) -> None:
        self._restore(self.store.restore(folder))

    # definitions

    def _super(self) -> None:
        if self.role not in self.catalog.superusers:
            raise SecurityError(f"{self.role} is no superuser")

    def do_create_table(self, table: tuple, columns: tuple, skip: bool) -> Result:
        key = Catalog.key(table)
        if key in self.catalog.tables:
            if skip:
                return Result("schema")
            raise BindError(f"the table {table[1]} exists")
        if len({c.name for c in columns}) < len(columns):
            raise BindError("column names repeat")
        t = Table(key, list(columns), self.role)
        for i, c in enumerate(columns):
            if c.generated:
                scope = Scope([Col(table[1], x.name, name(x.name), x.type) for x in columns[:i]], restricted=self.strict)
                if self.scalars(c.generated, scope)[1] != c.type:
                    raise BindError(f"the expression of {c.name} is not {name_of(c.type)}")
            if c.references:
                parent = t if Catalog.key(c.references[0]) == key else self.catalog.table(c.references[0])
                if not any(x.name == c.references[1] and x.type == c.type for x in parent.columns):
                    raise BindError(f"{c.name} references no column of its type")
        self.catalog.tables[key] = t
        return Result("schema")

    def do_add_column(self, table: tuple, column: ColumnDef) -> Result:
        t = self._changeable(table)
        if any(c.name == column.name for c in t.columns):
            raise BindError(f"the column {column.name} exists")
        if not column.nullable and not self.store.read(t).isEmpty():
            raise ConstraintError("a new column of a table with rows may be NULL")
        t.columns.append(column)
        return Result("schema")

    def do_set_encrypted(self, table: tuple, column: str, on: bool) -> Result:
        t = self._changeable(table)
        if not self.store.read(t).isEmpty():
            raise ConstraintError("encryption changes on an empty table only")
        at = next((i for i, c in enumerate(t.columns) if c.name == column), None)
        if at is None:
            raise BindError(f"no column {column}")
        t.columns[at] = t.columns[at]._replace(encrypted=on)
        return Result("schema")

    def _changeable(self, table: tuple) -> Table:
        t = self.catalog.table(table)
        if t.frame is not None:
            raise BindError(f"{table[1]} is a registered DataFrame and read-only")
        return t

    def do_create_index(self, index: tuple, table: tuple, keys: tuple, method: str, unique: bool, skip: bool) -> Result:
        label = Catalog.key(index)
        if label in self.catalog.indexes:
            if skip:
                return Result("schema")
            raise BindError(f"the index {index[1]} exists")
        t = self.catalog.table(table)
        if len(keys) > 1 and method != "btree":
            raise BindError("an index of several keys is a btree")
        if unique and method not in UNIQUE_METHODS:
            raise BindError(f"a {method} index is not unique")
        scope = Scope([Col(table[1], c.name, name(c.name), c.type) for c in t.columns], restricted=self.strict)
        for k in keys:
            kind = self.scalars(k, scope)[1]
            if method in UNIQUE_METHODS and kind not in ("int64", "text"):
                raise BindError(f"a {method} index has keys of int64 or text, not {name_of(kind)}")
        i = Index(label, t.name, keys, method, unique)
        if unique:
            self._unique(t, i, self.spark.sql(self._decrypted(t)))
        self.catalog.indexes[label] = i
        return Result("schema")

    def do_create_role(self, role: str, skip: bool) -> Result:
        self._super()
        if role in self.catalog.roles and not skip:
            raise BindError(f"the role {role} exists")
        self.catalog.roles.add(role)
        return Result("schema")

    def _role(self, role: str) -> None:
        if role not in self.catalog.roles:
            raise BindError(f"no role {role}")

    def do_grant(self, privilege: str, table: tuple, role: str) -> Result:
        t = self.catalog.table(table)
        if not self.catalog.bypasses(self.role, t):
            raise SecurityError("only the owner or a superuser grants")
        self._role(role)
        self.catalog.grants.add((privilege, "table", t.name, role))
        return Result("schema")

    def do_grant_procedure(self, procedure: str, kinds: tuple, role: str) -> Result:
        self._super()
        self._role(role)
        if (procedure, kinds) not in self.catalog.procedures:
            raise BindError(f"no procedure {procedure}")
        self.catalog.grants.add(("execute", "procedure", (procedure, kinds), role))
        return Result("schema")

    def do_create_policy(self, policy: str, table: tuple, predicate: tuple, skip: bool) -> Result:
        t = self.catalog.table(table)
        if not self.catalog.bypasses(self.role, t):
            raise SecurityError("only the owner or a superuser makes policies")
        scope = Scope([Col(table[1], c.name, name(c.name), c.type) for c in t.columns])
        self.scalars.boolean(predicate, scope, True)
        held = self.catalog.policies.setdefault(t.name, {})
        if policy in held and not skip:
            raise BindError(f"the policy {policy} exists")
        held.setdefault(policy, predicate)
        return Result("schema")

    def _define(self, where: dict, key, value, skip: bool, what: str) -> Result:
        if key in where and not skip:
            raise BindError(f"the {what} exists")
        where.setdefault(key, value)
        return Result("schema")

    def do_create_trigger(self, trigger: str, event: str, table: tuple, body: str, skip: bool) -> Result:
        t = self.catalog.table(table)
        return self._define(self.catalog.triggers, trigger, (event, t.name, body), skip, f"trigger {trigger}")

    def do_create_procedure(self, procedure: str, kinds: tuple, body: str, skip: bool) -> Result:
        return self._define(self.catalog.procedures, (procedure, kinds), body, skip, f"procedure {procedure}")

    def do_create_function(self, function: str, kinds: tuple, result, language: str | None, body: str | None, options: tuple, skip: bool) -> Result:
        """A definition; what it does is given by create_function, since module code of other engines is not run here."""
        if language not in (None, "wasm"):
            raise BindError(f"unknown language {language}")
        if language == "wasm" and (kinds, result) != (("int64",), "int64"):
            raise BindError("a module function takes an int64 and gives an int64")
        return self._define(self.catalog.functions, (function, kinds), Function(function, kinds, result), skip, f"function {function}")

    def do_create_operator(self, symbol: str, options: tuple) -> Result:
        o = dict(options)
        if (o["function"], (o["leftarg"], o["rightarg"])) not in self.catalog.functions:
            raise BindError(f"no function {o['function']} for the operator")
        return self._define(self.catalog.operators, (symbol, o["leftarg"], o["rightarg"]), o, False, f"operator {symbol}")

    def do_drop(self, kind: str, what, more, skip: bool) -> Result:
        c = self.catalog
        if kind == "table":
            where, keys = c.tables, [Catalog.key(what)]
            if keys[0] in c.tables and not c.bypasses(self.role, c.tables[keys[0]]):
                raise SecurityError("only the owner or a superuser drops a table")
            for t in c.tables.values():
                if t.name != keys[0] and any(x.references and Catalog.key(x.references[0]) == keys[0] for x in t.columns):
                    raise ConstraintError(f"{t.name} references the table")
        elif kind == "index":
            where, keys = c.indexes, [Catalog.key(what)]
        elif kind == "trigger":
            where, keys = c.triggers, [what]
        elif kind in ("function", "procedure"):
            where = c.functions if kind == "function" else c.procedures
            keys = [k for k in where if k[0] == what and (more is None or k[1] == more)]
        elif kind == "operator":
            where, keys = c.operators, [(what, *more)]
        elif kind == "role":
            self._super()
            if what in c.roles:
                c.roles.remove(what)
                c.grants = {g for g in c.grants if g[3] != what}
                return Result("schema")
            where, keys = {}, [what]
        else:
            held = [h for t, h in c.policies.items() if what in h and (more is None or t == Catalog.key(more))]
            where, keys = (held[0] if held else {}), [what]
        keys = [k for k in keys if k in where]
        if not keys and not skip:
            raise BindError(f"no such {kind}")
        for k in keys:
            del where[k]
            if kind == "table":
                c.indexes = {n: i for n, i in c.indexes.items() if i.table != k}
                c.triggers = {n: t for n, t in c.triggers.items() if t[1] != k}
                c.policies.pop(k, None)
        return Result("schema")

    # procedures

    def do_call(self, procedure: str, args: tuple) -> Result:
        values = [self.scalars(a, Scope([])) for a in args]
        hits = [(k, b) for k, b in self.catalog.procedures.items() if k[0] == procedure and len(k[1]) == len(args) and all(t == v[1] or v[1] == "null" for t, v in zip(k[1], values))]
        if len(hits) != 1:
            raise BindError(f"no procedure {procedure} with such arguments")
        key, body = hits[0]
        if not self.catalog.allowed(self.role, "execute", "procedure", key):
            raise SecurityError(f"{self.role} has no right to EXECUTE {procedure}")
        if ("procedure", key) in self.running:
            raise BindError(f"the procedure {procedure} calls itself")
        self.running.append(("procedure", key))
        try:
            return self.execute(_expanded(body, [_literal(a) for a in args]))
        finally:
            self.running.pop()

    # rows

    def _mutate(self, t: Table, event: str, change) -> Result:
        """change() gives the number of rows and the new paths; then constraints, then triggers; any error undoes all of it."""
        before = self.catalog.snapshot()
        try:
            count, paths = change()
            if count:
                t.paths = paths
                self._check(t, event)
                self._fire(t, event)
            return Result("affected", affected=count)
        except BaseException:
            self._restore(before)
            raise

    def _fire(self, t: Table, event: str) -> None:
        for label, (when, table, body) in sorted(self.catalog.triggers.items()):
            if (when, table) == (event, t.name):
                if ("trigger", label) in self.running:
                    raise BindError(f"the trigger {label} fires itself")
                self.running.append(("trigger", label))
                try:
                    self.execute(body)
                finally:
                    self.running.pop()

    def _stored(self, t: Table, rows: DataFrame) -> str:
        """Writes full rows, in plain values, as the table keeps them."""
        cols = [f"aes_encrypt(CAST({name(c.name)} AS STRING), {self._key()}, 'GCM') AS {name(c.name)}" if c.encrypted else f"CAST({name(c.name)} AS {sql_type(c.type)}) AS {name(c.name)}" for c in t.columns]
        return self.store.write(rows.selectExpr(*cols))

    def _generated(self, t: Table, table: str, rows: DataFrame) -> DataFrame:
        for c in t.columns:
            if c.generated:
                x, _ = self.scalars(c.generated, Scope([Col(table, o.name, name(o.name), o.type) for o in t.columns]))
                rows = rows.selectExpr(*[f"{x} AS {name(c.name)}" if o.name == c.name else name(o.name) for o in t.columns])
        return rows

    def _allowed_rows(self, t: Table, table: str, rows: DataFrame) -> None:
        policy = self.policy(t)
        if policy is not None:
            ok = self.scalars.boolean(policy, Scope([Col(table, c.name, name(c.name), c.type) for c in t.columns]), False)
            if not rows.where(f"NOT coalesce({ok}, false)").isEmpty():
                raise SecurityError(f"a row policy of {t.name} forbids a new row")

    def do_insert(self, table: tuple, columns: tuple, values: tuple) -> Result:
        t = self._changeable(table)
        self.require("insert", t)
        given = dict(zip(columns, values))
        if len(given) < len(columns):
            raise BindError("INSERT names a column twice")
        parts = []
        for c in t.columns:
            if c.generated and c.name in given:
                raise BindError(f"{c.name} is generated")
            x, kind = self.scalars(given.pop(c.name, ("null",)), Scope([]))
            if kind not in ("null", c.type):
                raise BindError(f"{c.name} is {name_of(c.type)}, not {name_of(kind)}")
            parts.append(f"CAST({x} AS {sql_type(c.type)}) AS {name(c.name)}")
        if given:
            raise BindError(f"no column {next(iter(given))}")

        def change():
            row = self._generated(t, table[1], self.spark.sql(f"SELECT {', '.join(parts)}"))
            self._allowed_rows(t, table[1], row)
            paths = t.paths
            if len(paths) >= MOST_FILES:  # single rows make small files; now and then they become one
                paths = [self.store.write(self.store.read(t))]
            return 1, [*paths, self._stored(t, row)]

        return self._mutate(t, "insert", change)

    def insert_rows(self, table: str, rows: DataFrame) -> Result:
        """Many rows at once, under the same checks as INSERT; columns are matched by name, and missing ones are NULL."""
        t = self._changeable((None, table))
        self.require("insert", t)
        df, columns = widened(rows)
        kinds = {n: k for n, k, _ in columns}
        for c in t.columns:
            if c.name in kinds and (c.generated or kinds[c.name] not in (c.type, "null")):
                raise BindError(f"{c.name} is generated, or of another type")
        if set(kinds) - {c.name for c in t.columns}:
            raise BindError("the rows have columns that the table lacks")

        def change():
            full = df.selectExpr(*[f"{name(c.name) if c.name in kinds else f'CAST(NULL AS {sql_type(c.type)})'} AS {name(c.name)}" for c in t.columns])
            path = self._stored(t, self._generated(t, table, full))
            part = Table(t.name + "+", t.columns, t.owner, [path])
            fresh = self.spark.sql(self._decrypted(part))
            self._allowed_rows(t, table, fresh)
            return fresh.count(), [*t.paths, path]

        return self._mutate(t, "insert", change)

    def _visible(self, t: Table, table: str, where: tuple | None) -> str:
        """The condition of rows that the role sees and the statement means; never NULL."""
        scope = Scope([Col(table, c.name, name(c.name), c.type) for c in t.columns])
        conditions = [self.scalars.boolean(e, scope, True) for e in (self.policy(t), where) if e is not None]
        return f"coalesce({' AND '.join(f'({c})' for c in conditions) or 'true'}, false)"

    def do_update(self, table: tuple, sets: tuple, where: tuple | None) -> Result:
        t = self._changeable(table)
        self.require("update", t)
        new = dict(sets)
        scope = Scope([Col(table[1], c.name, name(c.name), c.type) for c in t.columns])
        exprs = {}
        for column, e in new.items():
            c = next((c for c in t.columns if c.name == column), None)
            if c is None:
                raise BindError(f"no column {column}")
            if c.generated:
                raise BindError(f"{column} is generated")
            x, kind = self.scalars(e, scope)
            if kind not in ("null", c.type):
                raise BindError(f"{column} is {name_of(c.type)}, not {name_of(kind)}")
            exprs[column] = f"CAST({x} AS {sql_type(c.type)})"

        def change():
            seen = self._visible(t, table[1], where)
            rows = self.spark.sql(self._decrypted(t)).selectExpr("*", f"{seen} AS hit_")
            count = rows.where("hit_").count()
            if not count:
                return 0, t.paths
            changed = rows.selectExpr(*[f"CASE WHEN hit_ THEN {exprs[c.name]} ELSE {name(c.name)} END AS {name(c.name)}" if c.name in exprs else name(c.name) for c in t.columns], "hit_")
            plain = self._generated(t, table[1], changed.drop("hit_"))
            self._allowed_rows(t, table[1], self._generated(t, table[1], changed.where("hit_").drop("hit_")))
            return count, [self._stored(t, plain)]

        return self._mutate(t, "update", change)

    def do_delete(self, table: tuple, where: tuple | None) -> Result:
        t = self._changeable(table)
        self.require("delete", t)

        def change():
            seen = self._visible(t, table[1], where)
            rows = self.spark.sql(self._decrypted(t))
            count = rows.where(seen).count()
            return count, ([self._stored(t, rows.where(f"NOT {seen}"))] if count else t.paths)

        return self._mutate(t, "delete", change)

    # constraints

    def _check(self, t: Table, event: str) -> None:
        rows = self.spark.sql(self._decrypted(t))
        if event != "delete":
            fresh = rows
            if event == "insert":
                # only the new file, the last, can break NOT NULL or a reference
                part = Table(t.name + "+", t.columns, t.owner, t.paths[-1:])
                fresh = self.spark.sql(self._decrypted(part))
            bad = [f"{name(c.name)} IS NULL" for c in t.columns if not c.nullable]
            if bad and not fresh.where(" OR ".join(bad)).isEmpty():
                raise ConstraintError(f"NULL in a NOT NULL column of {t.name}")
            for i in self.catalog.indexes.values():
                if i.unique and i.table == t.name:
                    self._unique(t, i, rows)
            for c in t.columns:
                if c.references:
                    self._referenced(t, c, fresh)
        if event != "insert":
            for child in self.catalog.tables.values():
                for c in child.columns:
                    if c.references and Catalog.key(c.references[0]) == t.name:
                        self._referenced(child, c, self.spark.sql(self._decrypted(child)))

    def _unique(self, t: Table, i: Index, rows: DataFrame) -> None:
        """No two rows share the keys; rows with a null key are not in the index."""
        scope = Scope([Col(t.name.split(".")[1], c.name, name(c.name), c.type) for c in t.columns])
        keys = [f"{self.scalars(k, scope)[0]} AS k{n}" for n, k in enumerate(i.keys)]
        names = [f"k{n}" for n in range(len(keys))]
        if not rows.selectExpr(*keys).dropna(subset=names).groupBy(*names).count().where("count > 1").isEmpty():
            raise ConstraintError(f"the unique index {i.name} has a key twice")

    def _referenced(self, child: Table, c: ColumnDef, rows: DataFrame) -> None:
        parent = self.catalog.table(c.references[0])
        keys = self.spark.sql(self._decrypted(parent)).selectExpr(f"{name(c.references[1])} AS p_")
        left = rows.selectExpr(f"{name(c.name)} AS c_").where("c_ IS NOT NULL")
        if not left.join(keys, left["c_"] == keys["p_"], "left_anti").isEmpty():
            raise ConstraintError(f"{child.name}.{c.name} references a row that is not there")


def _literal(e: tuple) -> str:
    if e[0] == "text":
        return "'" + e[1].replace("'", "''") + "'"
    if e[0] == "neg":
        return f"- {_literal(e[1])}"
    if e[0] in ("int", "float"):
        return str(e[1])
    if e[0] == "bool":
        return str(e[1]).upper()
    if e[0] == "null":
        return "NULL"
    raise BindError("the arguments of a procedure are literals")


def _expanded(body: str, args: list[str]) -> str:
    """$1, $2, ... replaced outside of quotes."""
    out = []
    for k, part in enumerate(re.split(r"('(?:[^']|'')*')", body)):
        if k % 2 == 0:

            def one(m):
                n = int(m[1])
                if not 1 <= n <= len(args):
                    raise BindError(f"the procedure has no argument ${n}")
                return args[n - 1]

            part = re.sub(r"\$(\d+)", one, part)
        out.append(part)
    return "".join(out)


__all__ = ["Result", "Session"]
