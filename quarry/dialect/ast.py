"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


class Node:
    pass


# Expressions -------------------------------------------------------------


@dataclass(frozen=True)
class Lit(Node):
    value: object  # int, float, str, bool or None


@dataclass(frozen=True)
class Col(Node):
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


@dataclass(frozen=True)
class Unary(Node):
    op: str  # "-" or "NOT"
    arg: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str  # + - * / = <> < > <= >= AND OR
    left: Node
    right: Node


@dataclass(frozen=True)
class Agg(Node):
    fn: str  # COUNT SUM MIN MAX AVG
    arg: Col | None  # None is *
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.fn}({'DISTINCT ' if self.distinct else ''}{self.arg.name if self.arg else '*'})"


@dataclass(frozen=True)
class Func(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Case(Node):
    branches: tuple[tuple[Node, Node], ...]
    otherwise: Node | None
    subject: Node | None = None


@dataclass(frozen=True)
class InList(Node):
    arg: Node
    values: tuple[Node, ...]


@dataclass(frozen=True)
class InSelect(Node):
    """``arg`` among the only column of a SELECT; without ``arg``: whether it has a row."""

    arg: Node | None
    select: Node  # Select
    negated: bool = False


@dataclass(frozen=True)
class Between(Node):
    arg: Node
    low: Node
    high: Node


@dataclass(frozen=True)
class Like(Node):
    arg: Node
    pattern: str


@dataclass(frozen=True)
class IsNull(Node):
    arg: Node


@dataclass(frozen=True)
class Item(Node):
    """An entry of a select list."""

    expr: Node
    alias: str | None = None


@dataclass(frozen=True)
class TableRef(Node):
    table: str
    alias: str | None = None

    @property
    def name(self) -> str:
        return self.alias or self.table


@dataclass(frozen=True)
class Join(Node):
    how: str  # inner semi left right full
    ref: TableRef
    on: Node | None


# Statements --------------------------------------------------------------


@dataclass(frozen=True)
class Select(Node):
    items: tuple[Item, ...] | None  # None is *
    first: TableRef
    joins: tuple[Join, ...] = ()
    where: Node | None = None
    group_by: tuple[Node, ...] = ()
    having: Node | None = None
    order_by: tuple[tuple[Node, bool], ...] = ()  # expression, descending
    limit: int | None = None
    distinct: bool = False
    offset: int = 0


@dataclass(frozen=True)
class SetOperation(Node):
    """Two SELECTs whose columns pair by position; ORDER BY (by column name or number) and LIMIT hold for the result."""

    op: str  # UNION, INTERSECT or EXCEPT
    every: bool  # ALL
    left: Node
    right: Node
    order_by: tuple[tuple[Node, bool], ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class CreateTable(Node):
    table: str
    columns: tuple[tuple[str, str, int], ...]  # name, INT FLOAT or CHAR, length


@dataclass(frozen=True)
class DropTable(Node):
    table: str


@dataclass(frozen=True)
class Desc(Node):
    table: str


@dataclass(frozen=True)
class ShowTables(Node):
    pass


@dataclass(frozen=True)
class ShowIndex(Node):
    table: str


@dataclass(frozen=True)
class CreateIndex(Node):
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class DropIndex(Node):
    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Checkpoint(Node):
    restore: int | None = None  # a version to go back to


@dataclass(frozen=True)
class Insert(Node):
    table: str
    rows: tuple[tuple[object, ...], ...] = ()
    columns: tuple[str, ...] | None = None  # None is all
    select: Node | None = None  # in place of rows


@dataclass(frozen=True)
class Delete(Node):
    table: str
    where: Node | None = None


@dataclass(frozen=True)
class Update(Node):
    table: str
    sets: tuple[tuple[str, Node], ...] = field(default_factory=tuple)
    where: Node | None = None


@dataclass(frozen=True)
class Load(Node):
    path: str
    table: str


@dataclass(frozen=True)
class Explain(Node):
    statement: Node


@dataclass(frozen=True)
class Transaction(Node):
    kind: str  # BEGIN COMMIT ROLLBACK


@dataclass(frozen=True)
class SetKnob(Node):
    knob: str
    value: bool


@dataclass(frozen=True)
class SetOutput(Node):
    on: bool


@dataclass(frozen=True)
class Help(Node):
    pass


@dataclass(frozen=True)
class Exit(Node):
    pass
