"""A client's session: statements in, results out.

Outside a transaction every statement publishes a state of its own.  Inside one, changes
collect in an overlay that only this session sees; each statement reads the last published
state under it.  COMMIT publishes the overlay if no changed table was published meanwhile,
else the transaction is aborted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .dialect import ast
from .dialect.parser import parse
from .errors import (
    ColumnNotFoundError,
    EvaluationError,
    IndexExistsError,
    IndexNotFoundError,
    NonUniqueIndexError,
    QuarryError,
    TableNotFoundError,
    TransactionAbortError,
)
from .operators import dml
from .plans.binder import BoundSelect, BoundSet, Source, bind_query
from .plans.compile import to_frame
from .plans.explain import Printer, query_lines
from .sources import render
from .sources.catalog import Catalog, State, Table

HELP = """Statements end in a semicolon.
  CREATE TABLE t (column INT | FLOAT | CHAR(n), ...)    DROP TABLE t    DESC t    SHOW TABLES
  CREATE INDEX t (column, ...)    DROP INDEX t (column, ...)    SHOW INDEX FROM t
  INSERT INTO t [(column, ...)] VALUES (value, ...), ... | SELECT ...    DELETE FROM t [WHERE ...]    UPDATE t SET column = expr, ... [WHERE ...]
  LOAD file INTO t
  SELECT * | expr [AS name], ... FROM t [[SEMI | LEFT | RIGHT | FULL] JOIN u [ON ...]] [WHERE ...]
    [GROUP BY ...] [HAVING ...] [UNION | INTERSECT | EXCEPT [ALL] SELECT ...] [ORDER BY ... [ASC | DESC]] [LIMIT n] [OFFSET n]
  EXPLAIN statement    BEGIN    COMMIT    ROLLBACK    CREATE STATIC_CHECKPOINT    RESTORE STATIC_CHECKPOINT version
  SET ENABLE_NESTLOOP = TRUE | FALSE    SET ENABLE_SORTMERGE = TRUE | FALSE    SET OUTPUT_FILE ON | OFF
"""


@dataclass
class Result:
    """What a statement gives: a DataFrame, rows made on the driver, or a text."""

    frame: DataFrame | None = None
    columns: list[str] | None = None
    rows: list[tuple] | None = None
    text: str = ""

    def __iter__(self) -> Iterable[tuple]:
        if self.frame is not None:
            return iter(tuple(r) for r in self.frame.toLocalIterator())
        return iter(self.rows or [])

    def table(self) -> str:
        """The client's table format; only as many rows as it shows come to the driver."""
        if self.frame is not None:
            rows = [tuple(r) for r in self.frame.limit(render.most_rows(len(self.frame.columns))).collect()]
            return render.table(list(self.frame.columns), rows, self.frame.count())
        return render.table(list(self.columns), self.rows or [], len(self.rows or [])) if self.columns else self.text


def external(frame: DataFrame, ref: ast.TableRef) -> Source:
    """A DataFrame as a source of the binder."""
    kinds = {"int": "INT", "bigint": "INT", "smallint": "INT", "tinyint": "INT", "float": "FLOAT", "double": "DOUBLE", "string": "CHAR"}
    of = {c: kinds.get(t, "INT" if t.startswith("decimal") else t) for c, t in frame.dtypes}
    return Source(ref.name, ref.table, {c: "INT" if k == "DOUBLE" else k for c, k in of.items()})


def select_frames(text: str, frames: Callable[[str], DataFrame]) -> DataFrame:
    """A SELECT of the dialect over given DataFrames (by table name)."""
    select = parse(text)
    if not isinstance(select, (ast.Select, ast.SetOperation)):
        raise QuarryError("a SELECT is needed here")
    bound = bind_query(select, lambda ref: external(frames(ref.table), ref))
    return to_frame(bound, lambda s: frames(s.table))


class Session:
    def __init__(self, spark: SparkSession, root: str, output: str | None = None, simultaneous_set: bool = False):
        """``root`` is the database's folder, ``output`` a local file that collects results."""
        self.spark, self.catalog, self.output = spark, Catalog(spark, root), output
        self.simultaneous_set = simultaneous_set
        self.output_on, self.closed = output is not None, False
        self.knobs = {"ENABLE_NESTLOOP": True, "ENABLE_SORTMERGE": False}
        self.overlay: dict[str, Table | None] | None = None
        self.base: State | None = None

    # State

    def state(self) -> State:
        """What this session sees now."""
        now = self.catalog.state()
        if not self.overlay:
            return now
        tables = {**now.tables, **{n: t for n, t in self.overlay.items() if t is not None}}
        for n, t in self.overlay.items():
            if t is None:
                tables.pop(n, None)
        return State(now.version, tables)

    def _change(self, state: State, name: str, table: Table | None) -> None:
        if self.overlay is None:
            self.catalog.publish(state, {name: table})
            return
        if name not in self.overlay:  # the version that the change is based on
            tables = dict(self.base.tables)
            if name in state.tables:
                tables[name] = state.tables[name]
            else:
                tables.pop(name, None)
            self.base = State(self.base.version, tables)
        self.overlay[name] = table

    def _transaction(self, kind: str) -> Result:
        if kind == "BEGIN":
            self._commit()
            self.overlay, self.base = {}, self.catalog.state()
        elif kind == "COMMIT":
            self._commit()
        else:
            self.overlay = self.base = None
        return Result(text=kind)

    def _commit(self) -> None:
        overlay, base = self.overlay, self.base
        self.overlay = self.base = None
        if overlay:
            self.catalog.publish(base, overlay)

    # Statements

    def execute(self, text: str) -> Result:
        """Run one statement; errors leave the session as it was (an abort ends its transaction)."""
        statement = parse(text)
        try:
            result = self._run(statement)
            if self.output_on and self.output and (result.frame is not None or result.columns):
                names = list(result.frame.columns if result.frame is not None else result.columns)
                with open(self.output, "a", encoding="utf-8") as f:
                    f.writelines(render.bars(names, result))
            return result
        except PySparkException as e:
            self._failed()
            raise EvaluationError(str(e).split("\n")[0]) from e
        except QuarryError as e:
            self._failed()
            if isinstance(e, TransactionAbortError):
                self.overlay = self.base = None
            raise

    def _failed(self) -> None:
        if self.output_on and self.output:
            with open(self.output, "a", encoding="utf-8") as f:
                f.write("failure\n")

    def append(self, name: str, rows: DataFrame) -> None:
        """Add the rows of a DataFrame to a table, column by column, under the rules of INSERT."""
        state = self.state()
        self._change(state, name, dml.insert_frame(self.catalog, state.table(name), rows))

    def sql(self, text: str) -> DataFrame:
        """The DataFrame of a SELECT."""
        result = self._run(parse(text))
        if result.frame is None:
            raise QuarryError("a SELECT is needed here")
        return result.frame

    def bind(self, query: ast.Node, state: State) -> BoundSelect | BoundSet:
        return bind_query(query, lambda ref: Source(ref.name, ref.table, {c: k for c, k, _ in state.table(ref.table).columns}))

    def _run(self, s: ast.Node | None) -> Result:
        if s is None:
            return Result()
        if isinstance(s, ast.Help):
            return Result(text=HELP)
        if isinstance(s, ast.Exit):
            self.overlay, self.closed = None, True
            return Result()
        if isinstance(s, ast.Transaction):
            return self._transaction(s.kind)
        if isinstance(s, ast.SetKnob):
            self.knobs[s.knob] = s.value
            return Result()
        if isinstance(s, ast.SetOutput):
            self.output_on = s.on
            return Result()
        if isinstance(s, ast.Checkpoint) and s.restore is not None:
            if self.overlay is not None:
                raise QuarryError("no checkpoint is restored inside a transaction")
            return Result(text=f"restored as version {self.catalog.restore(s.restore).version}")
        if isinstance(s, ast.Checkpoint):
            return Result(text=f"checkpoint of version {self.catalog.checkpoint()}")
        state = self.state()
        if isinstance(s, (ast.Select, ast.SetOperation)):
            return Result(frame=self._select(s, state))
        if isinstance(s, ast.Explain):
            return Result(text=self._explain(s.statement, state))
        if isinstance(s, (ast.ShowTables, ast.Desc, ast.ShowIndex)):
            return self._describe(s, state)
        self._alter(s, state)
        return Result()

    def _select(self, s: ast.Node, state: State) -> DataFrame:
        bound = self.bind(s, state)
        hint, parts = None, [bound]
        while any(isinstance(p, BoundSet) for p in parts):
            parts = [q for p in parts for q in ([p.left, p.right] if isinstance(p, BoundSet) else [p])]
        if any(len(p.sources) > 1 for p in parts):
            if not any(self.knobs.values()):
                raise QuarryError("No join executor selected!")
            hint = None if self.knobs["ENABLE_NESTLOOP"] else "merge"
        return to_frame(bound, lambda source: self.catalog.frame(state.table(source.table)), hint)

    def _explain(self, s: ast.Node, state: State) -> str:
        keys = {n: t.keys for n, t in state.tables.items()}
        if isinstance(s, (ast.Update, ast.Delete)):  # the plan that finds their rows
            s = ast.Select(None, ast.TableRef(s.table), (), s.where)
            return Printer(self.bind(s, state), keys).scan(s.first.table)[1][0] + "\n"
        if isinstance(s, (ast.Insert, ast.Load)):
            table = state.table(s.table).name
            if isinstance(s, ast.Load):
                return f"Load(table={table}, file={s.path})\n"
            source = [f"Values(rows={len(s.rows)})"] if s.select is None else query_lines(self.bind(s.select, state), keys)
            return "\n".join([f"Insert(table={table})", *("\t" + x for x in source)]) + "\n"
        return "\n".join(query_lines(self.bind(s, state), keys)) + "\n"

    def _describe(self, s: ast.Node, state: State) -> Result:
        if isinstance(s, ast.ShowTables):
            return Result(columns=["Tables"], rows=[(n,) for n in sorted(state.tables)])
        table = state.table(s.table)
        if isinstance(s, ast.ShowIndex):
            return Result(columns=["Table", "Unique", "Columns"], rows=[(table.name, "unique", f"({','.join(k)})") for k in table.keys])
        indexed = {c for k in table.keys for c in k}
        kind = lambda k, n: f"CHAR({n})" if k == "CHAR" else k
        return Result(columns=["Field", "Type", "Index"], rows=[(c, kind(k, n), "YES" if c in indexed else "NO") for c, k, n in table.columns])

    def _alter(self, s: ast.Node, state: State) -> None:
        catalog = self.catalog
        if isinstance(s, ast.CreateTable):
            self._change(state, s.table, catalog.create(state, s.table, s.columns))
            return
        table = state.table(s.table)
        if isinstance(s, ast.DropTable):
            new = None
        elif isinstance(s, ast.CreateIndex):
            for c in s.columns:
                if table.kind(c) is None:
                    raise ColumnNotFoundError(c)
            if s.columns in table.keys:
                raise IndexExistsError(table.name, s.columns)
            if dml.duplicates(catalog.frame(table), s.columns):
                raise NonUniqueIndexError(table.name, s.columns)
            if not table.keys:  # the first key orders the files
                table = dml.clustered(catalog, table, s.columns)
            new = replace(table, keys=(*table.keys, s.columns))
        elif isinstance(s, ast.DropIndex):
            if s.columns not in table.keys:
                raise IndexNotFoundError(table.name, s.columns)
            new = replace(table, keys=tuple(k for k in table.keys if k != s.columns))
        elif isinstance(s, ast.Insert):
            new = dml.insert(catalog, table, s.rows, s.columns) if s.select is None else dml.insert_frame(catalog, table, self._select(s.select, state), s.columns)
        elif isinstance(s, ast.Load):
            new = dml.load(catalog, table, s.path)
        elif isinstance(s, ast.Delete):
            new = dml.delete(catalog, table, s.where)
        elif isinstance(s, ast.Update):
            new = dml.update(catalog, table, s.sets, s.where, self.simultaneous_set)
        else:
            raise TableNotFoundError(getattr(s, "table", "?"))
        self._change(state, table.name, new)
