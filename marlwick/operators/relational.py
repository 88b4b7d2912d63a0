"""Selects, joins, aggregation, windows, set operations and recursion.

Every query becomes one Spark SQL text whose columns are c0, c1, ...; names are put on at the end.  Join order, decorrelation,
pruning, pushdown and physical strategies are Catalyst's.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import BindError
from ..functions.scalars import AGGREGATES, Col, Scalars, Scope, has_window, is_aggregate, ordered, parts
from ..functions.text import name
from ..plans.parser import Join, Order, Query, Recursive, Select, SetOp
from ..types import SORTABLE, name_of, sql_type


@dataclass
class Lowered:
    sql: str
    cols: list[tuple[str, object, bool]]  # name, type, nullable
    ranked: Ranked | None = None


@dataclass
class Ranked:
    """The same query in parts, for ranking windows over more rows than one task should hold."""

    base: str  # columns c.. but for windows, their keys w.., and sort keys k..
    windows: list[tuple[int, str, list[tuple[str, bool, bool]]]]  # output, function, (column, desc, nulls first)
    keys: list[tuple[str, bool, bool]]
    limit: int | None
    offset: int


class Relational:
    """Lowers queries.  Subclasses say where tables, functions and operators come from."""

    strict = False

    def __init__(self):
        self.scalars = Scalars(self)
        self.aliases = 0

    # --- to be given

    def table(self, table: tuple) -> Lowered:
        """What a role sees of a table: its columns under their own names."""
        raise NotImplementedError

    def has_index(self, table: tuple, column: str) -> bool:
        return False

    def has_policy(self, table: tuple) -> bool:
        return False

    def function(self, f: str, args: list) -> tuple[str, object]:
        raise BindError(f"no function {f}")

    def custom_operator(self, op: str, a, b) -> tuple[str, object]:
        raise BindError(f"no operator {op}")

    # --- queries

    def alias(self) -> str:
        self.aliases += 1
        return f"q{self.aliases}"

    def query(self, q: Query, outer: Scope | None = None) -> Lowered:
        if isinstance(q.body, Select):
            return self.select(q.body, outer, q.order, q.limit, q.offset)
        body = self.set_operation(q.body, outer)
        if not q.order and q.limit is None and not q.offset:
            return body
        a = self.alias()
        keys = [ordered(f"{a}.c{i}", body.cols[i][1], o) for o in q.order for i in [self._output(o.expr, body.cols)]]
        return Lowered(f"SELECT {a}.* FROM ({body.sql}) {a}" + self._tail(keys, q.limit, q.offset), body.cols)

    @staticmethod
    def _output(e: tuple, cols) -> int:
        """The output column that a key of a set operation names."""
        if e[0] == "int":
            if not 1 <= e[1] <= len(cols):
                raise BindError("no such output column")
            return e[1] - 1
        hits = [i for i, c in enumerate(cols) if e[0] == "col" and e[1] is None and c[0] == e[2]]
        if len(hits) != 1:
            raise BindError("the result of a set operation is ordered by its columns")
        return hits[0]

    @staticmethod
    def _tail(keys: list[str], limit: int | None, offset: int) -> str:
        return (f" ORDER BY {', '.join(keys)}" if keys else "") + (f" LIMIT {limit}" if limit is not None else "") + (f" OFFSET {offset}" if offset else "")

    def set_operation(self, body, outer: Scope | None) -> Lowered:
        if isinstance(body, Select):
            return self.select(body, outer)
        left, right = self.set_operation(body.left, outer), self.set_operation(body.right, outer)
        if [c[1] for c in left.cols] != [c[1] for c in right.cols]:
            raise BindError("the sides of a set operation have the same types")
        # maps can't be told apart by Spark's set operations; their sorted entries can
        maps = [i for i, c in enumerate(left.cols) if c[1] == "hstore"]
        plain = body.op == "union" and body.all

        def side(x: Lowered) -> str:
            if not maps or plain:
                return f"({x.sql})"
            cols = ", ".join(f"array_sort(map_entries(c{i})) AS c{i}" if i in maps else f"c{i}" for i in range(len(x.cols)))
            return f"(SELECT {cols} FROM ({x.sql}))"

        sql = f"SELECT * FROM {side(left)} {body.op.upper()}{' ALL' if body.all else ''} SELECT * FROM {side(right)}"
        if maps and not plain:
            sql = "SELECT " + ", ".join(f"map_from_entries(c{i}) AS c{i}" if i in maps else f"c{i}" for i in range(len(left.cols))) + f" FROM ({sql})"
        return Lowered(sql, [(a[0], a[1], a[2] or b[2]) for a, b in zip(left.cols, right.cols)])

    # --- select

    def source(self, s: Select, outer: Scope | None) -> tuple[str, Scope]:
        """The FROM clause and its columns."""
        base = self.table(s.table)
        a = self.alias()
        cols = [Col(s.table[1], n, f"{a}.{name(n)}", t, null) for n, t, null in base.cols]
        sql = f"({base.sql}) {a}"
        if not s.join:
            cte = getattr(self, "cte", None)
            return sql, Scope(cols, outer, restricted=self.strict and cte is not None and s.table == (None, cte[0]))
        return self.join(s, sql, cols, outer)

    def join(self, s: Select, sql: str, cols: list[Col], outer: Scope | None) -> tuple[str, Scope]:
        join: Join = s.join
        grouped = s.group or s.having or any(i != ("*",) and (is_aggregate(i[0]) or has_window(i[0])) for i in s.items)
        if self.strict and grouped:
            raise BindError("a join has no grouping, HAVING, aggregates or windows (strict)")
        if join.kind == "lateral":
            if s.group or s.having:
                raise BindError("a lateral join has no GROUP BY or HAVING")
            if self.has_policy(join.table):
                raise BindError("the inner table of a lateral join has no row policy")
        base = self.table(join.table)
        b = self.alias()
        names = {c.name for c in cols}
        right = []
        for n, t, null in base.cols:
            out = n
            while out in names:
                out = f"inner_{out}"
            names.add(out)
            right.append((n, Col(join.table[1], out, f"{b}.{name(n)}", t, null or join.kind == "left")))
        # inside ON both tables are known by the names of their columns; later the right table's go by their output names
        if join.table[1] == s.table[1]:
            on = Scope(cols + [c for _, c in right], outer)
        else:
            on = Scope(cols + [Col(c.table, n, c.sql, c.type, c.nullable) for n, c in right], outer)
        on.restricted = self.strict
        if join.kind == "lateral":
            self._lateral(join, on, cols)
        condition = self.scalars.boolean(join.on, on, True)
        scope = Scope(cols + [c for _, c in right] + [Col(f"{c.table}", n, c.sql, c.type, c.nullable) for n, c in right if n != c.name], outer)
        scope.restricted = self.strict
        scope.output = cols + [c for _, c in right]
        how = "LEFT JOIN" if join.kind == "left" else "JOIN"
        return f"{sql} {how} ({base.sql}) {b} ON {condition}", scope

    def _lateral(self, join: Join, scope: Scope, left: list[Col]) -> None:
        """A lateral join is a lookup: inner.column = outer.column."""
        e = join.on
        sides = [x for x in e[2:4] if x[0] == "col"] if e[0] == "op" and e[1] == "=" else []
        if len(sides) != 2:
            raise BindError("a lateral join compares a column of the inner table with one of the outer")
        tables = [scope.find(x[1], x[2]) for x in sides]
        inner = [c for c in tables if c not in left]
        if len(inner) != 1:
            raise BindError("a lateral join compares a column of the inner table with one of the outer")
        if self.strict and (inner[0].type not in ("int64", "text") or not self.has_index(join.table, inner[0].name)):
            raise BindError("a lateral join needs an index on the inner column (strict)")

    def select(self, s: Select, outer: Scope | None = None, order: tuple[Order, ...] = (), limit: int | None = None, offset: int = 0) -> Lowered:
        source, scope = self.source(s, outer)
        where = f" WHERE {self.scalars.boolean(s.where, scope, True)}" if s.where else ""
        items: list[tuple[tuple, str | None]] = []
        for item in s.items:
            if item == ("*",):
                items += [(("out", i), None) for i in range(len(getattr(scope, "output", scope.cols)))]
            else:
                items.append(item)
        outputs = getattr(scope, "output", scope.cols)
        for i, c in enumerate(outputs):
            scope.known[("out", i)] = (c.sql, c.type)
        order = tuple(o._replace(expr=self._order_expr(o.expr, items, scope)) for o in order)
        if s.group or s.sets is not None or s.having or any(is_aggregate(e) for e, _ in items):
            if scope.restricted:
                raise BindError("a recursive query has no aggregates (strict)")
            if s.having and not (s.group or s.sets is not None or any(is_aggregate(e) for e, _ in items) or is_aggregate(s.having)):
                raise BindError("HAVING needs groups or an aggregate")
            return self.grouped(s, items, outputs, f"{source}{where}", scope, order, limit, offset)
        if any(has_window(o.expr) for o in order):
            raise BindError("a window function is no ORDER BY key")
        keys = [self.scalars(o.expr, scope) for o in order]
        scope.windows = True
        scope.ties = [ordered(*k, o) for k, o in zip(keys, order)]
        lowered = [self.scalars(e, scope) for e, _ in items]
        cols = self._named(items, lowered, outputs)
        body = "SELECT " + ", ".join(f"{x} AS c{i}" for i, (x, _) in enumerate(lowered))
        if order or s.distinct:
            body += "".join(f", {x} AS k{i}" for i, (x, _) in enumerate(keys))
        out = self._finish(f"{body} FROM {source}{where}", s.distinct, cols, list(zip(keys, order)), limit, offset)
        windows = [(i, e[1], e[2]) for i, (e, _) in enumerate(items) if e[0] == "window"]
        if windows and outer is None and not s.distinct and not any(has_window(e) for e, _ in items if e[0] != "window"):
            parts_ = [f"{x} AS c{i}" for i, ((e, _), (x, _)) in enumerate(zip(items, lowered)) if e[0] != "window"]
            parts_ += [f"{self.scalars(o.expr, scope)[0]} AS w{i}_{j}" for i, _, by in windows for j, o in enumerate(by)]
            parts_ += [f"{x} AS k{i}" for i, (x, _) in enumerate(keys)]
            sorts = [(f"k{i}", o.desc, o.nulls_first) for i, o in enumerate(order)]
            out.ranked = Ranked(f"SELECT {', '.join(parts_)} FROM {source}{where}", [(i, f, [(f"w{i}_{j}", o.desc, o.nulls_first) for j, o in enumerate(by)]) for i, f, by in windows], sorts, limit, offset)
        return out

    def _order_expr(self, e: tuple, items, scope: Scope) -> tuple:
        """A key by ordinal or output name is that item."""
        if e[0] == "int":
            if not 1 <= e[1] <= len(items):
                raise BindError("no such output column")
            return items[e[1] - 1][0]
        if e[0] == "col" and e[1] is None:
            for expr, alias in items:
                if alias == e[2]:
                    return expr
        return e

    def _named(self, items, lowered, outputs) -> list[tuple[str, object, bool]]:
        cols = []
        for i, ((e, alias), (_, kind)) in enumerate(zip(items, lowered)):
            if e[0] == "out":
                c = outputs[e[1]]
                cols.append((alias or c.name, kind, c.nullable))
            else:
                label = alias or (e[2] if e[0] == "col" else f"expr{i + 1}")
                null = not (e[0] == "count" or e[0] == "count_distinct" or e[0] == "window" or e[0] in ("int", "float", "text", "bool"))
                cols.append((label, kind, null))
        return cols

    def _finish(self, body: str, distinct: bool, cols, keys: list, limit: int | None, offset: int) -> Lowered:
        """DISTINCT, ORDER BY, OFFSET and LIMIT over a body with columns c0 .. and keys k0 .."""
        a, n = self.alias(), len(cols)
        outs = ", ".join(f"{a}.c{i}" for i in range(n))
        order = [ordered(f"{a}.k{i}", k[1], o) for i, (k, o) in enumerate(keys)]
        if distinct:
            maps = {i for i, c in enumerate(cols) if c[1] == "hstore"}
            same = ", ".join(f"array_sort(map_entries(c{i}))" if i in maps else f"c{i}" for i in range(n))
            if not keys and not maps:
                body = f"SELECT DISTINCT * FROM ({body})"
            else:
                # the first of equal rows in the query's order stands for them
                inner = [ordered(f"k{i}", k[1], o) for i, (k, o) in enumerate(keys)] or ["1"]
                body = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {same} ORDER BY {', '.join(inner)}) AS first_ FROM ({body})) WHERE first_ = 1"
        elif not keys and limit is None and not offset:
            return Lowered(body, cols)
        return Lowered(f"SELECT {outs} FROM ({body}) {a}" + self._tail(order, limit, offset), cols)

    # --- aggregation

    def grouped(self, s: Select, items, outputs, source: str, scope: Scope, order, limit, offset) -> Lowered:
        def key(e: tuple) -> tuple:
            if e[0] == "int":
                if not 1 <= e[1] <= len(items):
                    raise BindError("no such output column")
                return items[e[1] - 1][0]
            if e[0] == "col" and e[1] is None:
                for expr, alias in items:
                    if alias == e[2]:
                        return expr  # an output name wins over a column
            return e

        keys = list(dict.fromkeys(key(e) for e in s.group))
        sets = None if s.sets is None else [tuple(key(e) for e in x) for x in s.sets]
        a = self.alias()
        inner, known = [], {}
        for i, k in enumerate(keys):
            x, kind = self.scalars(k, scope)
            if kind not in SORTABLE and kind != "null":
                raise BindError(f"{name_of(kind)} can't be grouped by")
            inner.append(f"{x} AS g{i}")
            known[k] = (f"{a}.g{i}", kind)
        # what the aggregates read
        used = list(dict.fromkeys(x for e in [*(e for e, _ in items), *([s.having] if s.having else []), *(o.expr for o in order)] for x in self._aggregates(e)))
        aggregates = {}
        for i, e in enumerate(x for x in used if x[1] is not None):
            x, kind = self.scalars(e[1], scope)
            inner.append(f"{x} AS a{i}")
            aggregates[e] = self.scalars((e[0], ("arg", i)), Scope([], None, {("arg", i): (f"{a}.a{i}", kind)}, aggregates=True))
        aggregates |= {e: ("count(1)", "int64") for e in used if e[1] is None}
        over = Scope([], scope.outer, {**known, **aggregates}, aggregates=True)
        if not self.strict:
            # a column that is a key is known by its bare name too
            over.cols = [Col(k[1], k[2], *known[k]) for k in keys if k[0] == "col"]
        elif any(is_aggregate(e) and e not in aggregates for e, _ in items):
            raise BindError("an aggregate is a whole select item (strict)")
        for e, alias in items:
            if alias and s.having:
                over.known.setdefault(("col", None, alias), self.scalars(e, over))
        lowered = [self.scalars(e, over) for e, _ in items]
        cols = self._named(items, lowered, outputs)
        sorts = [self.scalars(o.expr, over) for o in order]
        having = f" HAVING {self.scalars.boolean(s.having, over, True)}" if s.having else ""
        base = f"(SELECT {', '.join(inner) or '1 AS one'} FROM {source}) {a}"
        out = "SELECT " + ", ".join([f"{x} AS c{i}" for i, (x, _) in enumerate(lowered)] + [f"{x} AS k{i}" for i, (x, _) in enumerate(sorts)])
        if sets is None:
            by = f" GROUP BY {', '.join(known[k][0] for k in keys)}" if keys else ""
            body = f"{out} FROM {base}{by}{having}"
        else:
            listed = ", ".join("(" + ", ".join(known[k][0] for k in x) + ")" for x in sets)
            body = f"{out} FROM {base} GROUP BY GROUPING SETS ({listed}){having}"
            if () in sets:
                # the empty set has a row over empty input too, which Spark does not give: of constants, if the input is empty
                none = {k: (f"CAST(NULL AS {sql_type(t)})", t) for k, (_, t) in known.items()}
                none |= {e: (("0L" if e[0].startswith("count") else f"CAST(NULL AS {sql_type(t)})"), t) for e, (_, t) in aggregates.items()}
                empty = Scope([Col(k[1], k[2], *none[k]) for k in keys if k[0] == "col"], scope.outer, none, aggregates=True)
                for e, alias in items:
                    if alias and s.having:
                        empty.known.setdefault(("col", None, alias), self.scalars(e, empty))
                row = ", ".join([f"{self.scalars(e, empty)[0]} AS c{i}" for i, (e, _) in enumerate(items)] + [f"{self.scalars(o.expr, empty)[0]} AS k{i}" for i, o in enumerate(order)])
                times = "UNION ALL ".join(["SELECT 1 AS one "] * sets.count(()))
                cond = f" AND {self.scalars.boolean(s.having, empty, True)}" if s.having else ""
                body = f"{body} UNION ALL SELECT {row} FROM ({times}) WHERE (SELECT count(1) FROM (SELECT 1 FROM {source} LIMIT 1)) = 0{cond}"
        return self._finish(body, s.distinct, cols, list(zip(sorts, order)), limit, offset)

    def _aggregates(self, e: tuple) -> list[tuple]:
        if e and e[0] in AGGREGATES:
            return [e]
        return [x for y in parts(e) for x in self._aggregates(y)]

    # --- recursion

    def recursive(self, r: Recursive, limit: int) -> Lowered:
        """WITH RECURSIVE: each step sees what the one before it added.  limit is the session's level limit."""
        seed = self.select(r.seed)
        if len(seed.cols) != len(r.columns):
            raise BindError("the CTE's columns are as many as its seed's")
        for part in (r.step, r.query.body):
            if not isinstance(part, Select) or part.table != (None, r.name) or part.join:
                raise BindError("the step and the query of a recursive CTE read the CTE alone")
            if part.group or part.having or part.sets:
                raise BindError("a recursive CTE has no groups")
        cols = [(n, t, True) for n, (_, t, _) in zip(r.columns, seed.cols)]
        outer, self.cte = getattr(self, "cte", None), (r.name, cols)
        try:
            step, query = self.select(r.step), self.query(r.query)
        finally:
            self.cte = outer
        if [t for _, t, _ in step.cols] != [t for _, t, _ in cols]:
            raise BindError("the step of a recursive CTE has the types of its seed")
        typed = ", ".join(f"CAST(c{i} AS {sql_type(t)}) AS c{i}" for i, (_, t, _) in enumerate(cols))
        names = ", ".join(name(c) for c in r.columns)
        return Lowered(f"WITH RECURSIVE {name(r.name)}({names}) MAX RECURSION LEVEL {limit} AS (SELECT {typed} FROM ({seed.sql}) UNION ALL SELECT {typed} FROM ({step.sql})) {query.sql}", query.cols)


__all__ = ["Lowered", "Relational", "SetOp"]
