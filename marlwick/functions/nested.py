"""Arrays, hstores, ranges and bounding boxes as Spark SQL.

A range is a struct (lower, upper, lower_inc, upper_inc, is_empty) whose null bounds are unbounded; ranges are continuous.
The functions give NULL for null operands; the comparisons that must be FALSE then are made so where they are lowered.
"""

from __future__ import annotations

from .text import fail, let


def make_range(lower: str, upper: str, bounds: str, element: str) -> str:
    """A range literal; lower > upper, or equal bounds that aren't both included, make it empty."""
    both = "true" if bounds == "[]" else "false"
    lo, hi = f"CAST({lower} AS {element})", f"CAST({upper} AS {element})"
    empty = f"coalesce({lo} > {hi} OR ({lo} = {hi} AND NOT {both}), false)"
    return f"named_struct('lower', {lo}, 'upper', {hi}, 'lower_inc', {'true' if bounds[0] == '[' else 'false'}, 'upper_inc', {'true' if bounds[1] == ']' else 'false'}, 'is_empty', {empty})"


def _before(a: str, b: str) -> str:
    """Whether range a ends before range b starts."""
    return f"coalesce({a}.upper < {b}.lower OR ({a}.upper = {b}.lower AND NOT ({a}.upper_inc AND {b}.lower_inc)), false)"


def overlaps(a: str, b: str) -> str:
    body = f"NOT (x.is_empty OR y.is_empty OR {_before('x', 'y')} OR {_before('y', 'x')})"
    return let(f"struct({a} AS x, {b} AS y)", "p", f"CASE WHEN p.x IS NOT NULL AND p.y IS NOT NULL THEN {body.replace('x.', 'p.x.').replace('y.', 'p.y.')} END")


def _op(body: str, a: str, b: str) -> str:
    return let(f"struct({a} AS x, {b} AS y)", "p", f"CASE WHEN p.x IS NOT NULL AND p.y IS NOT NULL THEN {body} END")


def contains_value(r: str, v: str) -> str:
    low = "(r.x.lower IS NULL OR r.x.lower < r.y OR (r.x.lower = r.y AND r.x.lower_inc))"
    high = "(r.x.upper IS NULL OR r.y < r.x.upper OR (r.x.upper = r.y AND r.x.upper_inc))"
    return let(f"struct({r} AS x, {v} AS y)", "r", f"coalesce(NOT r.x.is_empty AND r.y IS NOT NULL AND {low} AND {high}, false)")


def adjacent(a: str, b: str) -> str:
    """Whether the ranges touch with no gap and no overlap."""
    touch = lambda x, y: f"coalesce({x}.upper = {y}.lower AND {x}.upper_inc <> {y}.lower_inc, false)"
    return _op(f"NOT p.x.is_empty AND NOT p.y.is_empty AND ({touch('p.x', 'p.y')} OR {touch('p.y', 'p.x')})", a, b)


def intersection(a: str, b: str) -> str:
    """The common part: the greater lower bound and the lesser upper one; of equal bounds the excluding one."""
    first = "(p.y.lower IS NULL OR p.x.lower > p.y.lower OR (p.x.lower = p.y.lower AND NOT p.x.lower_inc))"
    last = "(p.y.upper IS NULL OR p.x.upper < p.y.upper OR (p.x.upper = p.y.upper AND NOT p.x.upper_inc))"
    x_low, x_high = f"coalesce({first}, false)", f"coalesce({last}, false)"
    both = f"named_struct('lower', if({x_low}, p.x.lower, p.y.lower), 'upper', if({x_high}, p.x.upper, p.y.upper), 'lower_inc', if({x_low}, p.x.lower_inc, p.y.lower_inc), 'upper_inc', if({x_high}, p.x.upper_inc, p.y.upper_inc))"
    empty = "(p.x.is_empty OR p.y.is_empty OR coalesce(i.lower > i.upper OR (i.lower = i.upper AND NOT (i.lower_inc AND i.upper_inc)), false))"
    return _op(let(both, "i", f"named_struct('lower', i.lower, 'upper', i.upper, 'lower_inc', i.lower_inc, 'upper_inc', i.upper_inc, 'is_empty', {empty})"), a, b)


def union(a: str, b: str, kind: str) -> str:
    """The range that both make together; an error if a gap would lie between them."""
    low = "coalesce(p.x.lower IS NULL OR p.x.lower < p.y.lower OR (p.x.lower = p.y.lower AND p.x.lower_inc), false)"
    high = "coalesce(p.x.upper IS NULL OR p.x.upper > p.y.upper OR (p.x.upper = p.y.upper AND p.x.upper_inc), false)"
    both = f"named_struct('lower', if({low}, p.x.lower, p.y.lower), 'upper', if({high}, p.x.upper, p.y.upper), 'lower_inc', if({low}, p.x.lower_inc, p.y.lower_inc), 'upper_inc', if({high}, p.x.upper_inc, p.y.upper_inc), 'is_empty', false)"
    apart = lambda x, y: f"coalesce({x}.upper < {y}.lower OR ({x}.upper = {y}.lower AND NOT {x}.upper_inc AND NOT {y}.lower_inc), false)"
    return _op(f"CASE WHEN p.x.is_empty THEN p.y WHEN p.y.is_empty THEN p.x WHEN {apart('p.x', 'p.y')} OR {apart('p.y', 'p.x')} THEN {fail('the union of ranges has a gap', kind)} ELSE {both} END", a, b)


def boxes_overlap(a: str, b: str) -> str:
    """Boxes of one range for each axis: whether they meet on all axes, bounds included."""
    axis = "(q, r) -> q.lower <= r.upper AND r.lower <= q.upper"
    bad = "exists(concat(p.x, p.y), r -> r IS NULL OR r.lower IS NULL OR r.upper IS NULL)"
    return _op(f"CASE WHEN size(p.x) <> size(p.y) THEN {fail('boxes of different rank', 'BOOLEAN')} WHEN {bad} THEN {fail('a box has finite bounds', 'BOOLEAN')} WHEN exists(concat(p.x, p.y), r -> r.is_empty) THEN false ELSE forall(zip_with(p.x, p.y, {axis}), v -> v) END", a, b)


def array_contains_all(a: str, b: str) -> str:
    """Every element of b occurs in a; NULL equals NULL."""
    return f"(size(array_except({b}, {a})) = 0 AND {a} IS NOT NULL AND {b} IS NOT NULL)"


def map_contains_all(a: str, b: str) -> str:
    return let(f"struct({a} AS x, {b} AS y)", "p", "forall(map_entries(p.y), e -> map_contains_key(p.x, e.key) AND p.x[e.key] <=> e.value)")
