"""Recursive-descent parser of the SQL dialect.

Keywords are case-insensitive, identifiers keep their case.  Beyond the core dialect it
takes OR, NOT, IN, BETWEEN, LIKE, IS NULL, CASE, scalar functions, DISTINCT, outer joins,
VARCHAR, arithmetic anywhere an expression stands, IN and EXISTS over a SELECT, UNION,
INTERSECT and EXCEPT, OFFSET, and INSERT with a column list, several rows or a SELECT.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from ..errors import SyntaxProblem
from . import ast

_TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<num>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|\d+)
    |(?P<str>'(?:[^']|'')*')
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><>|!=|<=|>=|[-+*/=<>(),.;])""",
    re.S | re.X,
)
_LOAD = re.compile(r"\s*LOAD\s+(?:'([^']+)'|(\S+))\s+INTO\s+([A-Za-z_]\w*)\s*;?\s*", re.I)
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")
COMPARISONS = ("=", "<>", "<", ">", "<=", ">=")
#: Words that end a table alias position.
_CLAUSES = frozenset("WHERE GROUP HAVING ORDER LIMIT OFFSET JOIN SEMI LEFT RIGHT FULL INNER CROSS ON AS FROM SET AND OR UNION INTERSECT EXCEPT".split())


@dataclass
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper()


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0]))
    return out


class Parser:
    def __init__(self, text: str):
        self.items = tokens(text)
        self.at = 0

    # Helpers

    def peek(self, ahead: int = 0) -> Token:
        k = self.at + ahead
        return self.items[k] if k < len(self.items) else Token("end", "")

    def next(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def is_(self, *words: str) -> bool:
        return all(self.peek(k).kind in ("word", "op") and self.peek(k).upper == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SyntaxProblem(f"expected {' '.join(words)} before {self.peek().text or 'the end'!r}")

    def name(self) -> str:
        t = self.next()
        if t.kind != "word":
            raise SyntaxProblem(f"expected a name before {t.text or 'the end'!r}")
        return t.text

    def names(self) -> tuple[str, ...]:
        self.need("(")
        out = [self.name()]
        while self.take(","):
            out.append(self.name())
        self.need(")")
        return tuple(out)

    # Statements

    def statement(self) -> ast.Node:
        made = self._statement()
        self.take(";")
        if self.peek().kind != "end":
            raise SyntaxProblem(f"unexpected {self.peek().text!r}")
        return made

    def _statement(self) -> ast.Node:
        for kind, words in (("BEGIN", "BEGIN"), ("COMMIT", "COMMIT"), ("ROLLBACK", "ROLLBACK"), ("ROLLBACK", "ABORT")):
            if self.take(words):
                return ast.Transaction(kind)
        if self.take("HELP"):
            return ast.Help()
        if self.take("EXIT"):
            return ast.Exit()
        if self.take("EXPLAIN"):
            return ast.Explain(self._data())
        if self.take("SHOW", "TABLES"):
            return ast.ShowTables()
        if self.take("SHOW", "INDEX", "FROM"):
            return ast.ShowIndex(self.name())
        if self.take("DESC"):
            return ast.Desc(self.name())
        if self.take("SET"):
            return self._set()
        if self.take("CREATE", "STATIC_CHECKPOINT"):
            return ast.Checkpoint()
        if self.take("RESTORE", "STATIC_CHECKPOINT"):
            return ast.Checkpoint(self._number())
        if self.take("CREATE", "TABLE"):
            return self._create_table()
        if self.take("DROP", "TABLE"):
            return ast.DropTable(self.name())
        if self.take("CREATE", "INDEX"):
            if self.peek(1).upper == "ON":  # CREATE INDEX name ON t(...): the name is dropped
                self.at += 2
            return ast.CreateIndex(self.name(), self.names())
        if self.take("DROP", "INDEX"):
            return ast.DropIndex(self.name(), self.names())
        return self._data()

    def _set(self) -> ast.Node:
        knob = self.name().upper()
        if knob == "OUTPUT_FILE":
            if self.take("ON"):
                return ast.SetOutput(True)
            self.need("OFF")
            return ast.SetOutput(False)
        if knob not in ("ENABLE_NESTLOOP", "ENABLE_SORTMERGE"):
            raise SyntaxProblem(f"unknown knob {knob}")
        self.need("=")
        if self.take("TRUE"):
            return ast.SetKnob(knob, True)
        self.need("FALSE")
        return ast.SetKnob(knob, False)

    def _create_table(self) -> ast.CreateTable:
        table, columns = self.name(), []
        self.need("(")
        while True:
            column, kind, size = self.name(), self.name().upper(), 4
            if kind in ("CHAR", "VARCHAR"):
                self.need("(")
                kind, size = "CHAR", int(self.next().text)
                self.need(")")
            elif kind not in ("INT", "FLOAT"):
                raise SyntaxProblem(f"unknown type {kind}")
            columns.append((column, kind, size))
            if not self.take(","):
                break
        self.need(")")
        return ast.CreateTable(table, tuple(columns))

    def _data(self) -> ast.Node:
        if self.take("INSERT", "INTO"):
            table = self.name()
            columns = self.names() if self.is_("(") else None
            if self.take("SELECT"):
                return ast.Insert(table, (), columns, self._query())
            self.need("VALUES")
            rows = []
            while not rows or self.take(","):
                self.need("(")
                values = [self._value()]
                while self.take(","):
                    values.append(self._value())
                self.need(")")
                rows.append(tuple(values))
            return ast.Insert(table, tuple(rows), columns)
        if self.take("DELETE", "FROM"):
            return ast.Delete(self.name(), self._where())
        if self.take("UPDATE"):
            table, sets = self.name(), []
            self.need("SET")
            while True:
                column = self.name()
                self.need("=")
                sets.append((column, self.expr(5)))
                if not self.take(","):
                    break
            return ast.Update(table, tuple(sets), self._where())
        if self.take("SELECT"):
            return self._query()
        raise SyntaxProblem(f"unexpected {self.peek().text or 'end'!r}")

    def _number(self) -> int:
        t = self.next()
        if t.kind != "num" or not t.text.isdigit():
            raise SyntaxProblem(f"expected a whole number before {t.text or 'the end'!r}")
        return int(t.text)

    def _value(self) -> object:
        sign = -1 if self.take("-") else 1
        if sign == 1:
            self.take("+")
        t = self.next()
        if t.kind == "num":
            return sign * (float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
        if t.kind == "str":
            return t.text[1:-1].replace("''", "'")
        if t.upper in ("TRUE", "FALSE"):
            return t.upper == "TRUE"
        if t.upper == "NULL":
            return None
        raise SyntaxProblem(f"expected a value before {t.text or 'the end'!r}")

    def _where(self) -> ast.Node | None:
        return self.expr() if self.take("WHERE") else None

    def _ref(self) -> ast.TableRef:
        table = self.name()
        if self.take("AS"):
            return ast.TableRef(table, self.name())
        if self.peek().kind == "word" and self.peek().upper not in _CLAUSES:
            return ast.TableRef(table, self.name())
        return ast.TableRef(table)

    def _query(self) -> ast.Node:
        """A SELECT (its first word is read) or several under set operations; INTERSECT binds closer."""
        made = self._operation(("UNION", "EXCEPT"))
        order, limit, offset = self._tail()
        return replace(made, order_by=order, limit=limit, offset=offset)

    def _operation(self, ops: tuple[str, ...]) -> ast.Node:
        inner = lambda: self._operation(("INTERSECT",)) if "UNION" in ops else self._select()
        left = inner()
        while self.peek().upper in ops:
            op = self.next().upper
            every = self.take("ALL")
            self.need("SELECT")
            left = ast.SetOperation(op, every, left, inner())
        return left

    def _tail(self) -> tuple[tuple, int | None, int]:
        order, limit, offset = [], None, 0
        if self.take("ORDER", "BY"):
            while True:
                key = self.expr(5)
                down = self.take("DESC")
                if not down:
                    self.take("ASC")
                order.append((key, down))
                if not self.take(","):
                    break
        if self.take("LIMIT"):
            limit = self._number()
        if self.take("OFFSET"):
            offset = self._number()
        return tuple(order), limit, offset

    def _select(self) -> ast.Select:
        distinct, items = self.take("DISTINCT"), None
        if not self.take("*"):
            items = [self._item()]
            while self.take(","):
                items.append(self._item())
        self.need("FROM")
        first, joins = self._ref(), []
        while True:
            if self.take(",") or self.take("CROSS", "JOIN"):
                joins.append(ast.Join("inner", self._ref(), None))
                continue
            how = None
            for words, kind in ((("SEMI",), "semi"), (("LEFT", "OUTER"), "left"), (("LEFT", "SEMI"), "semi"), (("LEFT",), "left"), (("RIGHT", "OUTER"), "right"), (("RIGHT",), "right"), (("FULL", "OUTER"), "full"), (("FULL",), "full"), (("INNER",), "inner"), ((), "inner")):
                if self.take(*words, "JOIN"):
                    how = kind
                    break
            if how is None:
                break
            ref = self._ref()
            joins.append(ast.Join(how, ref, self.expr() if self.take("ON") else None))
        where, group, having = self._where(), [], None
        if self.take("GROUP", "BY"):
            group.append(self.expr(5))
            while self.take(","):
                group.append(self.expr(5))
        if self.take("HAVING"):
            having = self.expr()
        return ast.Select(tuple(items) if items else None, first, tuple(joins), where, tuple(group), having, distinct=distinct)

    def _item(self) -> ast.Item:
        e = self.expr(5)
        return ast.Item(e, self.name() if self.take("AS") else None)

    # Expressions; levels: 1 OR, 2 AND, 3 NOT, 4 comparison, 5 sum, 6 product, 7 sign

    def expr(self, level: int = 1) -> ast.Node:
        if level <= 2:
            word = "OR" if level == 1 else "AND"
            left = self.expr(level + 1)
            while self.take(word):
                left = ast.Binary(word, left, self.expr(level + 1))
            return left
        if level == 3:
            return ast.Unary("NOT", self.expr(3)) if self.take("NOT") else self.expr(4)
        if level == 4:
            return self._comparison()
        if level in (5, 6):
            ops = ("+", "-") if level == 5 else ("*", "/")
            left = self.expr(level + 1)
            while self.peek().kind == "op" and self.peek().text in ops:
                op = self.next().text
                left = ast.Binary(op, left, self.expr(level + 1))
            return left
        if self.take("+"):
            return self.expr(7)
        if self.take("-"):
            arg = self.expr(7)
            return ast.Lit(-arg.value) if isinstance(arg, ast.Lit) and type(arg.value) in (int, float) else ast.Unary("-", arg)
        return self._primary()

    def _comparison(self) -> ast.Node:
        left = self.expr(5)
        if self.peek().kind == "op" and (op := self.peek().text.replace("!=", "<>")) in COMPARISONS:
            self.next()
            return ast.Binary(op, left, self.expr(5))
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return ast.Unary("NOT", ast.IsNull(left)) if negated else ast.IsNull(left)
        negated = self.is_("NOT") and self.peek(1).upper in ("IN", "BETWEEN", "LIKE") and bool(self.next())
        made = None
        if self.take("IN"):
            self.need("(")
            if self.take("SELECT"):
                made = ast.InSelect(left, self._query(), negated)
                self.need(")")
                return made
            values = [self.expr(5)]
            while self.take(","):
                values.append(self.expr(5))
            self.need(")")
            made = ast.InList(left, tuple(values))
        elif self.take("BETWEEN"):
            low = self.expr(5)
            self.need("AND")
            made = ast.Between(left, low, self.expr(5))
        elif self.take("LIKE"):
            made = ast.Like(left, str(self._value()))
        if made is None:
            return left
        return ast.Unary("NOT", made) if negated else made

    def _primary(self) -> ast.Node:
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        t = self.peek()
        if t.kind in ("num", "str") or t.upper in ("TRUE", "FALSE", "NULL"):
            return ast.Lit(self._value())
        if self.take("CASE"):
            return self._case()
        if self.take("EXISTS"):
            self.need("(", "SELECT")
            made = ast.InSelect(None, self._query())
            self.need(")")
            return made
        name = self.name()
        if self.take("("):
            if name.upper() in AGGREGATES:
                arg, distinct = None, self.take("DISTINCT")
                if distinct or not (name.upper() == "COUNT" and self.take("*")):
                    arg = self._column(self.name())
                self.need(")")
                return ast.Agg(name.upper(), arg, distinct)
            args = []
            if not self.is_(")"):
                args.append(self.expr())
                while self.take(","):
                    args.append(self.expr())
            self.need(")")
            return ast.Func(name.upper(), tuple(args))
        return self._column(name)

    def _column(self, name: str) -> ast.Col:
        return ast.Col(self.name(), name) if self.take(".") else ast.Col(name)

    def _case(self) -> ast.Case:
        subject = None if self.is_("WHEN") else self.expr(5)
        branches, otherwise = [], None
        while self.take("WHEN"):
            when = self.expr(5) if subject is not None else self.expr()
            self.need("THEN")
            branches.append((when, self.expr(5)))
        if self.take("ELSE"):
            otherwise = self.expr(5)
        self.need("END")
        return ast.Case(tuple(branches), otherwise, subject)


def parse(text: str) -> ast.Node | None:
    """The statement of a text; None for an empty one."""
    if m := _LOAD.fullmatch(text):
        return ast.Load(m[1] or m[2], m[3])
    if (m := re.match(r"\s*EXPLAIN\b", text, re.I)) and (load := _LOAD.fullmatch(text, m.end())):
        return ast.Explain(ast.Load(load[1] or load[2], load[3]))
    parser = Parser(text)
    return parser.statement() if parser.items else None
