"""Name and type resolution of statements, before any Spark plan exists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace

from ..dialect import ast
from ..errors import AmbiguousColumnError, ColumnNotFoundError, IncompatibleTypeError, InvalidAggregateError, QuarryError
from ..functions.scalars import TEXT_RESULT, check

TEXT, NUMBER, FLAG = "CHAR", "NUMBER", "BOOL"


@dataclass(frozen=True)
class Source:
    """A table in scope: the name it goes by, the real one and its columns' kinds."""

    name: str
    table: str
    kinds: dict[str, str] = field(hash=False)  # INT, FLOAT, CHAR or another type name
    label: str = ""  # the name in the statement, where ``name`` was changed to be unique

    def called(self, name: str) -> bool:
        return name == (self.label or self.name)


@dataclass(frozen=True)
class BoundSelect:
    select: ast.Select  # all columns carry the name of their source
    sources: tuple[Source, ...]
    visible: tuple[Source, ...]  # without the right sides of semi joins
    grouped: bool
    outer: tuple[Source, ...] = ()  # of the SELECTs around it


@dataclass(frozen=True)
class BoundSet:
    operation: ast.SetOperation
    left: BoundSelect | BoundSet
    right: BoundSelect | BoundSet


def children(node) -> Iterator[ast.Node]:
    for f in fields(node):
        stack = [getattr(node, f.name)]
        while stack:
            v = stack.pop()
            if isinstance(v, ast.Node):
                yield v
            elif isinstance(v, tuple):
                stack.extend(reversed(v))


def walk(node: ast.Node) -> Iterator[ast.Node]:
    """``node`` and its parts, without the inside of other SELECTs."""
    yield node
    for c in children(node):
        if not isinstance(node, ast.InSelect) or c is node.arg:
            yield from walk(c)


def rewrite(node, change: Callable[[ast.Node], ast.Node | None]):
    """``node`` with every part for which ``change`` gives another replaced."""
    if isinstance(node, tuple):
        return tuple(rewrite(v, change) for v in node)
    if not isinstance(node, ast.Node):
        return node
    made = change(node)
    if made is not None:
        return made
    if not is_dataclass(node):
        return node
    new = {f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}
    return replace(node, **new) if any(new[k] is not getattr(node, k) for k in new) else node


def conjuncts(node: ast.Node | None) -> list[ast.Node]:
    if node is None:
        return []
    if isinstance(node, ast.Binary) and node.op == "AND":
        return conjuncts(node.left) + conjuncts(node.right)
    return [node]


class Scope:
    """The sources of a SELECT, and those of the SELECTs around it, which it sees behind its own."""

    def __init__(self, sources: tuple[Source, ...], outer: tuple[Source, ...] = ()):
        self.sources, self.outer = sources, outer

    def resolve(self, col: ast.Col) -> ast.Col:
        if col.table is not None:
            found = [s for s in self.sources if s.called(col.table)] or [s for s in self.sources if s.table == col.table]
            if not found and self.outer:
                return Scope(self.outer).resolve(col)
            if len(found) != 1 or col.name not in found[0].kinds:
                raise ColumnNotFoundError(str(col))
            return ast.Col(col.name, found[0].name)
        found = [s for s in self.sources if col.name in s.kinds]
        if not found and self.outer:
            return Scope(self.outer).resolve(col)
        if not found:
            raise ColumnNotFoundError(col.name)
        if len(found) > 1:
            raise AmbiguousColumnError(col.name)
        return ast.Col(col.name, found[0].name)

    def kind(self, col: ast.Col) -> str:
        return next(s for s in (*self.sources, *self.outer) if s.name == col.table).kinds[col.name]

    def bind(self, node, aggregates: bool = False):
        if not aggregates:
            for n in walk(node) if isinstance(node, ast.Node) else ():
                if isinstance(n, ast.Agg):
                    raise QuarryError(f"aggregate {n} is not allowed here")

        def change(n: ast.Node) -> ast.Node | None:
            if isinstance(n, ast.InSelect):  # bound with the SELECT around it
                return n
            return self.resolve(n) if isinstance(n, ast.Col) else None

        return rewrite(node, change)

    def type_of(self, node: ast.Node) -> str | None:
        """CHAR, NUMBER, BOOL or None where it cannot be told; checks the parts."""
        if isinstance(node, ast.Lit):
            return None if node.value is None else FLAG if isinstance(node.value, bool) else TEXT if isinstance(node.value, str) else NUMBER
        if isinstance(node, ast.Col):
            kind = self.kind(node)
            return NUMBER if kind in ("INT", "FLOAT") else TEXT if kind == "CHAR" else None
        if isinstance(node, ast.Agg):
            if node.arg is None or node.fn == "COUNT":
                return NUMBER
            kind = self.type_of(node.arg)
            if kind == TEXT:
                raise IncompatibleTypeError(node.fn, "CHAR")
            return kind
        if isinstance(node, ast.Unary):
            inner = self.type_of(node.arg)
            if node.op == "-" and inner == TEXT:
                raise IncompatibleTypeError("-", TEXT)
            return FLAG if node.op == "NOT" else inner
        if isinstance(node, ast.Binary):
            left, right = self.type_of(node.left), self.type_of(node.right)
            if node.op in ("AND", "OR"):
                return FLAG
            if left and right and left != right or TEXT in (left, right) and node.op in ("-", "*", "/"):
                raise IncompatibleTypeError(left or "?", right or "?")
            return FLAG if node.op in ("=", "<>", "<", ">", "<=", ">=") else left or right
        if isinstance(node, (ast.InList, ast.Between)):
            own = self.type_of(node.arg)
            for v in node.values if isinstance(node, ast.InList) else (node.low, node.high):
                other = self.type_of(v)
                if own and other and own != other:
                    raise IncompatibleTypeError(own, other)
            return FLAG
        if isinstance(node, ast.InSelect):
            if node.arg is not None:
                self.type_of(node.arg)
            return FLAG
        if isinstance(node, (ast.Like, ast.IsNull)):
            self.type_of(node.arg)
            return FLAG
        if isinstance(node, ast.Func):
            kinds = [self.type_of(a) for a in node.args]
            check(node.name, kinds)
            return TEXT if node.name in TEXT_RESULT else kinds[0] if node.name == "COALESCE" and kinds else NUMBER
        if isinstance(node, ast.Case):
            kinds = {self.type_of(v) for _, v in node.branches} | ({self.type_of(node.otherwise)} if node.otherwise else set())
            for w, _ in node.branches:
                self.type_of(w)
            kinds.discard(None)
            return kinds.pop() if len(kinds) == 1 else None
        return None


def _has_aggregate(node) -> bool:
    return node is not None and any(isinstance(n, ast.Agg) for n in walk(node))


def _grouped_only(node: ast.Node, keys: set[ast.Node]) -> None:
    """Every column outside an aggregate must be a grouping key."""
    if node in keys or isinstance(node, ast.Agg):
        return
    if isinstance(node, ast.Col):
        raise InvalidAggregateError(str(node), "a list that is not grouped by it")
    for c in children(node):
        _grouped_only(c, keys)


def bind_query(query: ast.Node, source_of: Callable[[ast.TableRef], Source], outer: tuple[Source, ...] = ()) -> BoundSelect | BoundSet:
    """A bound SELECT or set operation; ``outer`` are the sources of the SELECTs around it."""
    if isinstance(query, ast.SetOperation):
        return BoundSet(query, bind_query(query.left, source_of, outer), bind_query(query.right, source_of, outer))
    return bind_select(query, source_of, outer)


def bind_select(select: ast.Select, source_of: Callable[[ast.TableRef], Source], outer: tuple[Source, ...] = ()) -> BoundSelect:
    refs = [select.first, *(j.ref for j in select.joins)]
    sources = tuple(source_of(r) for r in refs)
    if outer:  # names of other SELECTs may come again
        sources = tuple(replace(s, name=f"{len(outer)}·{s.name}", label=s.name) for s in sources)
    names = [s.name for s in sources]
    for node in [*(j.on for j in select.joins), select.having, *(i.expr for i in select.items or ()), *(k for k, _ in select.order_by)]:
        if node is not None and any(isinstance(n, ast.InSelect) for n in walk(node)):
            raise QuarryError("IN and EXISTS over a SELECT stand in WHERE only")
    if len(set(names)) < len(names):
        raise QuarryError(f"table name or alias used twice: {next(s.label or s.name for s in sources if names.count(s.name) > 1)}")
    visible = tuple(s for s, how in zip(sources, ["", *(j.how for j in select.joins)]) if how != "semi")
    scope, everything = Scope(visible, outer), Scope(sources, outer)

    joins = tuple(replace(j, on=everything.bind(j.on)) if j.on is not None else j for j in select.joins)
    inside = lambda n: replace(n, arg=scope.bind(n.arg), select=bind_query(n.select, source_of, (*visible, *outer))) if isinstance(n, ast.InSelect) else None
    where = rewrite(scope.bind(select.where), inside)
    if select.items is None:
        items = tuple(ast.Item(ast.Col(c, s.name)) for s in visible for c in s.kinds)
    else:
        items = tuple(ast.Item(scope.bind(i.expr, True), i.alias) for i in select.items)
    aliases = {i.alias: i.expr for i in items if i.alias}

    def known(node: ast.Node, aggregates: bool = True) -> ast.Node:
        """A key by alias, or an expression."""
        if isinstance(node, ast.Col) and node.table is None and node.name in aliases and not any(node.name in s.kinds for s in visible):
            return aliases[node.name]
        return scope.bind(node, aggregates)

    group = tuple(known(g, False) for g in select.group_by)
    having = rewrite(select.having, lambda n: known(n) if isinstance(n, ast.Col) else None)
    order = tuple((known(k), down) for k, down in select.order_by)
    grouped = bool(group) or any(_has_aggregate(i.expr) for i in items) or _has_aggregate(having) or any(_has_aggregate(k) for k, _ in order)
    if having is not None and not grouped:
        raise InvalidAggregateError("HAVING", "neither GROUP BY nor an aggregate")
    if grouped:
        if select.items is None:
            raise InvalidAggregateError("*", "GROUP BY")
        for node in [*(i.expr for i in items), *([having] if having is not None else []), *(k for k, _ in order)]:
            _grouped_only(node, set(group))
    for node in [where, *(j.on for j in joins)]:
        if node is not None:
            everything.type_of(node)
    for node in [*(i.expr for i in items), having, *group, *(k for k, _ in order)]:
        if node is not None:
            scope.type_of(node)
    bound = replace(select, items=items, joins=joins, where=where, group_by=group, having=having, order_by=order)
    return BoundSelect(bound, sources, visible, grouped, outer)
