"""Bound statements to DataFrames; Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import ast
from ..errors import QuarryError
from ..functions import scalars
from .binder import BoundSelect, BoundSet, Scope, Source, conjuncts, walk


def column_name(source: str, column: str) -> str:
    """Internal name of a column of a source; unique in a plan."""
    return f"{source}·{column}"


class Expressions:
    """Makes Spark columns of bound expressions; ``slots`` maps whole parts to made columns."""

    def __init__(self, scope: Scope, slots: dict[ast.Node, str] | None = None):
        self.scope, self.slots = scope, slots or {}

    def __call__(self, node: ast.Node) -> Column:
        if isinstance(node, ast.InSelect):
            raise QuarryError("IN and EXISTS over a SELECT are conditions of their own, joined by AND, in WHERE")
        if node in self.slots:
            return F.col(f"`{self.slots[node]}`")
        if isinstance(node, ast.Lit):
            return F.lit(node.value)
        if isinstance(node, ast.Col):
            return F.col(f"`{column_name(node.table, node.name)}`")
        if isinstance(node, ast.Unary):
            return ~self(node.arg) if node.op == "NOT" else -self(node.arg)
        if isinstance(node, ast.Binary):
            return self._binary(node)
        if isinstance(node, ast.InList):
            return self(node.arg).isin(*[self(v) for v in node.values])
        if isinstance(node, ast.Between):
            return self(node.arg).between(self(node.low), self(node.high))
        if isinstance(node, ast.Like):
            return self(node.arg).like(node.pattern)
        if isinstance(node, ast.IsNull):
            return self(node.arg).isNull()
        if isinstance(node, ast.Func):
            return scalars.make(node.name, [self(a) for a in node.args])
        if isinstance(node, ast.Case):
            made = None
            for when, then in node.branches:
                test = self(when) if node.subject is None else self(node.subject) == self(when)
                made = F.when(test, self(then)) if made is None else made.when(test, self(then))
            return made if node.otherwise is None else made.otherwise(self(node.otherwise))
        raise TypeError(f"no column for {node}")

    def _is_float(self, node: ast.Node) -> bool:
        return isinstance(node, ast.Col) and self.scope.kind(node) == "FLOAT"

    def _binary(self, node: ast.Binary) -> Column:
        left, right = self(node.left), self(node.right)
        if node.op in ("=", "<>", "<", ">", "<=", ">="):
            # a literal takes the width of the FLOAT column it is compared with
            if self._is_float(node.left) and isinstance(node.right, ast.Lit):
                right = right.cast("float")
            if self._is_float(node.right) and isinstance(node.left, ast.Lit):
                left = left.cast("float")
        if node.op == "+" and self.scope.type_of(node) == "CHAR":
            return F.concat(left, right)
        return {
            "+": lambda: left + right,
            "-": lambda: left - right,
            "*": lambda: left * right,
            "/": lambda: left / right,
            "=": lambda: left == right,
            "<>": lambda: left != right,
            "<": lambda: left < right,
            ">": lambda: left > right,
            "<=": lambda: left <= right,
            ">=": lambda: left >= right,
            "AND": lambda: left & right,
            "OR": lambda: left | right,
        }[node.op]()


def aggregate(agg: ast.Agg, arg: Column | None) -> Column:
    if agg.distinct and agg.fn in ("COUNT", "SUM", "AVG"):
        count, total = F.count_distinct(arg), F.sum_distinct(arg)
        return {"COUNT": count, "SUM": total, "AVG": total / count}[agg.fn]
    if agg.fn == "COUNT":
        return F.count(F.lit(1) if arg is None else arg)
    return {"SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}[agg.fn](arg)


def scan(frame: DataFrame, source: Source) -> DataFrame:
    return frame.select(*[F.col(f"`{c}`").alias(column_name(source.name, c)) for c in source.kinds])


def _rows(made: DataFrame, limit: int | None, offset: int) -> DataFrame:
    made = made.offset(offset) if offset else made
    return made if limit is None else made.limit(limit)


def _set_frame(bound: BoundSet, frame_of: Callable[[Source], DataFrame], hint: str | None) -> DataFrame:
    operation = bound.operation
    left, right = to_frame(bound.left, frame_of, hint), to_frame(bound.right, frame_of, hint)
    if len(left.columns) != len(right.columns):
        raise QuarryError(f"{operation.op} of {len(left.columns)} and {len(right.columns)} columns")
    if operation.op == "UNION":
        made = left.unionAll(right)
        made = made if operation.every else made.distinct()
    elif operation.op == "INTERSECT":
        made = left.intersectAll(right) if operation.every else left.intersect(right)
    else:
        made = left.exceptAll(right) if operation.every else left.subtract(right)
    keys = []
    for key, down in operation.order_by:
        if isinstance(key, ast.Lit) and isinstance(key.value, int) and 1 <= key.value <= len(made.columns):
            name = made.columns[key.value - 1]
        elif isinstance(key, ast.Col) and key.table is None and made.columns.count(key.name) == 1:
            name = key.name
        else:
            raise QuarryError(f"ORDER BY of {operation.op} takes a column's name or number")
        keys.append(F.col(f"`{name}`").desc() if down else F.col(f"`{name}`").asc())
    return _rows(made.orderBy(*keys) if keys else made, operation.limit, operation.offset)


def _tables(node: ast.Node) -> set[str]:
    return {n.table for n in walk(node) if isinstance(n, ast.Col)}


#: Types of numbers that keep their order when Spark converts one to another to compare them.
_ORDERED = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def _compared(left: DataFrame, right: DataFrame, node: ast.Node, own: set[str], make: Expressions) -> ast.Node | None:
    """What a comparison other than equality takes from ``right``, whose sources are ``own``; None for other conditions."""
    if not isinstance(node, ast.Binary) or node.op not in ("<>", "<", ">", "<=", ">="):
        return None
    inner, outer = (node.left, node.right) if _tables(node.left) & own else (node.right, node.left)
    if not _tables(inner) <= own or _tables(outer) & own:
        return None
    (_, a), (_, b) = left.select(make(outer)).dtypes + right.select(make(inner)).dtypes
    return inner if a == b or {a, b} <= _ORDERED else None


def _half_join(left: DataFrame, right: DataFrame, tests: list[ast.Node], own: set[str], make: Expressions, how: str) -> DataFrame:
    """The semi or anti join with ``right``, whose sources are ``own``.

    Without an equality Spark compares each row with all of ``right``.  Where at most one
    comparison relates the sides, one row stands for ``right``: any, or its least and greatest values.
    """
    both = [c for c in tests if _tables(c) & own and _tables(c) - own]
    value = _compared(left, right, both[0], own, make) if len(both) == 1 else None
    if both and value is None:
        columns = [make(c) for c in tests]
    else:
        for c in tests:
            right = right.where(make(c)) if _tables(c) and _tables(c) <= own else right
        columns = [make(c) for c in tests if not _tables(c) & own]
        if value is None:
            right = right.limit(1)
        else:  # what holds for some value holds for one of the ends
            right = right.agg(F.min(make(value)).alias("least·0"), F.max(make(value)).alias("greatest·0"))
            columns.append(Expressions(make.scope, {value: "least·0"})(both[0]) | Expressions(make.scope, {value: "greatest·0"})(both[0]))
    test = columns[0] if columns else F.lit(True)
    for c in columns[1:]:
        test = test & c
    return left.join(right, test, how)


def _is_inside(node: ast.Node) -> bool:
    return isinstance(node, ast.InSelect) or isinstance(node, ast.Unary) and node.op == "NOT" and isinstance(node.arg, ast.InSelect)


def _matched(made: DataFrame, node: ast.Node, scope: Scope, frame_of: Callable[[Source], DataFrame], hint: str | None) -> DataFrame:
    """The rows for which an IN or EXISTS over a SELECT holds: a semi or anti join."""
    negated = isinstance(node, ast.Unary)
    node = node.arg if negated else node
    negated, query = negated != node.negated, node.select
    local: list[ast.Node] = []
    outer: list[ast.Node] = []
    if isinstance(query, BoundSelect):
        own = {s.name for s in query.sources}
        for c in conjuncts(query.select.where):
            tables = {n.table for n in walk(c) if isinstance(n, ast.Col)}
            (outer if tables - own and not _is_inside(c) else local).append(c)
    if outer:
        if query.grouped or query.select.limit is not None or query.select.offset or query.select.distinct:
            raise QuarryError("a SELECT that refers to the one around it takes no grouping, DISTINCT or LIMIT")
        where = None
        for c in local:
            where = c if where is None else ast.Binary("AND", where, c)
        # columns that the join needs come out under their own names
        needed = dict.fromkeys(n for c in outer for n in walk(c) if isinstance(n, ast.Col) and n.table in own)
        first = () if node.arg is None else (replace(query.select.items[0], alias="in·0"),)
        items = (*first, *(ast.Item(n, column_name(n.table, n.name)) for n in needed))
        query = replace(query, select=replace(query.select, where=where, items=items or (ast.Item(ast.Lit(1), "in·0"),), order_by=()))
    right = to_frame(query, frame_of, hint)
    if node.arg is not None and not outer:
        if len(right.columns) != 1:
            raise QuarryError(f"IN takes a SELECT of one column, {len(right.columns)} given")
        right = right.toDF("in·0")
    if node.arg is None and not outer:
        return made.join(right.limit(1), F.lit(True), "left_anti" if negated else "left_semi")
    make = Expressions(Scope(scope.sources, (*query.sources, *scope.outer)) if outer else scope)
    if node.arg is None:
        return _half_join(made, right, outer, own, make, "left_anti" if negated else "left_semi")
    tests = [make(c) for c in outer]
    same = make(node.arg) == F.col("`in·0`")
    if negated and not outer:  # a NULL on either side leaves it open whether the value is among them
        made = made.join(right.where("`in·0` IS NULL").limit(1), F.lit(True), "left_anti").join(right.limit(1), make(node.arg).isNull(), "left_anti")
    tests.append(same | same.isNull() if negated and outer else same)
    test = tests[0]
    for t in tests[1:]:
        test = test & t
    return made.join(right, test, "left_anti" if negated else "left_semi")


def to_frame(bound: BoundSelect | BoundSet, frame_of: Callable[[Source], DataFrame], hint: str | None = None) -> DataFrame:
    """The DataFrame of a bound query; ``hint`` is a join strategy for equi joins."""
    if isinstance(bound, BoundSet):
        return _set_frame(bound, frame_of, hint)
    select, scope = bound.select, Scope(bound.sources, bound.outer)
    make = Expressions(scope)
    made = scan(frame_of(bound.sources[0]), bound.sources[0])
    have = {bound.sources[0].name}
    # inner joins pool their conditions with WHERE: each goes to the first join that has its tables
    outer = any(j.how in ("left", "right", "full") for j in select.joins)
    inside = [c for c in conjuncts(select.where) if _is_inside(c)]
    pooled = [c for c in conjuncts(select.where) if not _is_inside(c)] + [c for j in select.joins if j.how == "inner" and not outer for c in conjuncts(j.on)]

    for join, source in zip(select.joins, bound.sources[1:]):
        right = scan(frame_of(source), source)
        on = conjuncts(join.on) if join.how != "inner" or outer else []
        if join.how == "inner" and not outer:
            on = [c for c in pooled if source.name in _tables(c) and _tables(c) <= have | {source.name} and len(_tables(c)) > 1]
            pooled = [c for c in pooled if not any(c is x for x in on)]
        if hint and any(isinstance(c, ast.Binary) and c.op == "=" for c in on):
            right = right.hint(hint)
        if join.how == "semi":
            made = _half_join(made, right, on, {source.name}, make, "left_semi")
        elif on:
            test = make(on[0])
            for c in on[1:]:
                test = test & make(c)
            made = made.join(right, test, join.how)
        elif join.how == "inner":
            made = made.crossJoin(right)
        else:
            made = made.join(right, F.lit(True), join.how)
        if join.how != "semi":
            have.add(source.name)
    for c in pooled:
        made = made.where(make(c))
    for c in inside:
        made = _matched(made, c, scope, frame_of, hint)

    if bound.grouped:
        nodes = [*(i.expr for i in select.items), *([select.having] if select.having is not None else []), *(k for k, _ in select.order_by)]
        keys = {k: f"key·{n}" for n, k in enumerate(dict.fromkeys(select.group_by))}
        aggs = dict.fromkeys(n for node in nodes for n in walk(node) if isinstance(n, ast.Agg))
        slots = {**keys, **{a: f"agg·{n}" for n, a in enumerate(aggs)}}
        measures = [aggregate(a, make(a.arg) if a.arg else None).alias(slots[a]) for a in aggs]
        grouping = made.groupBy(*[make(k).alias(name) for k, name in keys.items()])
        made = grouping.agg(*measures) if measures else made.select(*[make(k).alias(name) for k, name in keys.items()]).distinct()
        make = Expressions(scope, slots)
        if select.having is not None:
            made = made.where(make(select.having))
    out = [make(i.expr).alias(i.alias or _label(i.expr)) for i in select.items]
    if select.distinct:
        made = made.select(*out).distinct()
        if select.order_by:
            labels = {i.expr: i.alias or _label(i.expr) for i in select.items}
            made = made.orderBy(*[F.col(f"`{labels[k]}`").desc() if down else F.col(f"`{labels[k]}`").asc() for k, down in select.order_by])
        return _rows(made, select.limit, select.offset)
    if select.order_by:
        made = made.orderBy(*[make(k).desc() if down else make(k).asc() for k, down in select.order_by])
    return _rows(made, select.limit, select.offset).select(*out)


def _label(node: ast.Node) -> str:
    if isinstance(node, ast.Col):
        return node.name
    if isinstance(node, ast.Agg):
        return str(node)
    if isinstance(node, ast.Func):
        return node.name
    return "expr"
