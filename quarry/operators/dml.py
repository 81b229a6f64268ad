"""Row changes as new table states: files in, files out, nothing updated in place.

INSERT and LOAD add files.  UPDATE and DELETE rewrite only the files that hold matching
rows (found through the file path that Spark attaches to each row); all others are
shared between the old and the new state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dialect import ast
from ..errors import ColumnNotFoundError, EvaluationError, IncompatibleTypeError, InvalidValueCountError, StringOverflowError, UniqueCheckError
from ..plans.binder import Scope, Source
from ..plans.compile import Expressions, column_name, scan
from ..sources.catalog import Catalog, Table
from ..sources.csvload import read_rows


def coerce(value: object, kind: str, length: int) -> object:
    """A literal as a value of a column; numbers convert to each other, texts must fit."""
    if value is None:
        return None
    if kind == "CHAR":
        if not isinstance(value, str):
            raise IncompatibleTypeError(kind, type(value).__name__)
        if len(value.encode()) > length:
            raise StringOverflowError
        return value
    if isinstance(value, str) or isinstance(value, bool):
        raise IncompatibleTypeError(kind, type(value).__name__)
    return int(value) if kind == "INT" else float(value)


def duplicates(rows: DataFrame, key: tuple[str, ...]) -> bool:
    return not rows.groupBy(*key).count().where("count > 1").isEmpty()


def check_unique(catalog: Catalog, table: Table, new: DataFrame) -> None:
    """``new`` rows against themselves and the table's rows, for every unique key."""
    old = catalog.frame(table)
    for key in table.keys:
        if duplicates(new, key) or table.files and not old.join(new.select(*key), list(key), "left_semi").isEmpty():
            raise UniqueCheckError


def _places(table: Table, columns: tuple[str, ...] | None) -> list[int]:
    """The places in ``table`` of the columns of an INSERT."""
    names = [c for c, _, _ in table.columns]
    for c in columns or ():
        if c not in names:
            raise ColumnNotFoundError(c)
    if len(set(columns or ())) < len(columns or ()):
        raise InvalidValueCountError
    return [names.index(c) for c in columns or names]


def insert(catalog: Catalog, table: Table, rows: tuple[tuple[object, ...], ...], columns: tuple[str, ...] | None = None) -> Table:
    """Add rows of literals; columns that are not named are NULL."""
    places, made = _places(table, columns), []
    for values in rows:
        if len(values) != len(places):
            raise InvalidValueCountError
        row: list[object] = [None] * len(table.columns)
        for k, v in zip(places, values):
            row[k] = coerce(v, *table.columns[k][1:])
        made.append(tuple(row))
    new = catalog.spark.createDataFrame(made, table.schema)
    check_unique(catalog, table, new)
    return replace(table, files=table.files + catalog.add_files(table, new.coalesce(1)))


def insert_frame(catalog: Catalog, table: Table, rows: DataFrame, columns: tuple[str, ...] | None = None) -> Table:
    """Add the rows of a query, whose columns go by position."""
    places = _places(table, columns)
    if len(rows.columns) != len(places):
        raise InvalidValueCountError
    named, kinds = rows.toDF(*[f"c{k}" for k in range(len(places))]), [t for _, t in rows.dtypes]
    made = []
    for k, (name, kind, length) in enumerate(table.columns):
        if k not in places:
            made.append(F.lit(None).cast(table.schema[name].dataType).alias(name))
            continue
        at = places.index(k)
        if (kind == "CHAR") != (kinds[at] == "string"):
            raise IncompatibleTypeError(kind, kinds[at])
        made.append(_assigned(F.col(f"c{at}"), kind, length, False).alias(name))
    try:
        added = catalog.add_files(table, named.select(*made))
        if table.keys:
            check_unique(catalog, table, catalog.frame(replace(table, files=added)))
    except PySparkException as e:
        raise EvaluationError(str(e).split("\n")[0]) from e
    return replace(table, files=table.files + added)


def ordered(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows in files of their own key ranges, so that a lookup by the key's first columns skips files and row groups."""
    return rows.repartitionByRange(*key).sortWithinPartitions(*key)


def clustered(catalog: Catalog, table: Table, key: tuple[str, ...]) -> Table:
    """``table`` with its files written again in the order of ``key``."""
    return replace(table, files=catalog.add_files(table, ordered(catalog.frame(table), key))) if table.files else table


def load(catalog: Catalog, table: Table, path: str) -> Table:
    new = read_rows(catalog.spark, path, table)
    new = ordered(new, table.keys[0]) if table.keys else new
    added = catalog.add_files(table, new)
    if table.keys:
        check_unique(catalog, table, catalog.frame(replace(table, files=added)))
    return replace(table, files=table.files + added)


def _scope(table: Table) -> tuple[Scope, Source]:
    source = Source(table.name, table.name, {c: k for c, k, _ in table.columns})
    return Scope((source,)), source


def _hit(catalog: Catalog, table: Table, test: Column, source: Source) -> tuple[str, ...]:
    """Files that hold a matching row."""
    rows = catalog.frame(table).select("*", F.col("_metadata.file_path").alias("_file"))
    named = rows.select(*[F.col(f"`{c}`").alias(column_name(source.name, c)) for c in source.kinds], "_file")
    found = {r[0] for r in named.where(test).select("_file").distinct().collect()}
    norm = lambda f: catalog._path(f).toUri().getPath()
    paths = {norm(f) for f in found}
    return tuple(f for f in table.files if norm(f) in paths)


def _rewritten(catalog: Catalog, table: Table, where: ast.Node | None, change: Callable[[DataFrame, Column, Expressions, Source], DataFrame]) -> tuple[Table, tuple[str, ...]]:
    scope, source = _scope(table)
    make = Expressions(scope)
    bound = scope.bind(where)
    if bound is not None:
        scope.type_of(bound)
    test = F.coalesce(make(bound), F.lit(False)) if bound is not None else F.lit(True)
    if not table.files:
        return table, ()
    try:
        hit = _hit(catalog, table, test, source) if bound is not None else table.files
        if not hit:
            return table, ()
        rows = scan(catalog.frame(replace(table, files=hit)), source)
        new = change(rows, test, make, source)
        out = new.select(*[F.col(f"`{column_name(source.name, c)}`").alias(c) for c in source.kinds])
        added = catalog.add_files(table, out)
    except PySparkException as e:
        raise EvaluationError(str(e).split("\n")[0]) from e
    kept = tuple(f for f in table.files if f not in hit)
    return replace(table, files=kept + added), added


def delete(catalog: Catalog, table: Table, where: ast.Node | None) -> Table:
    if where is None:
        return replace(table, files=())
    return _rewritten(catalog, table, where, lambda rows, test, make, source: rows.where(~test))[0]


def _assigned(value: Column, kind: str, length: int, is_text: bool) -> Column:
    """A SET value in its column's type; texts that are too long fail."""
    if kind == "CHAR":
        text = value.cast("string")
        return F.when(F.octet_length(text) > length, F.raise_error(F.lit("String is too long")).cast("string")).otherwise(text)
    # numbers lose their fraction on the way to INT, texts are read as numbers
    number = value.cast("double") if is_text else value
    return number.cast("int" if kind == "INT" else "float")


def update(catalog: Catalog, table: Table, sets: tuple[tuple[str, ast.Node], ...], where: ast.Node | None, simultaneous: bool = False) -> Table:
    """SET clauses see the clauses before them, unless ``simultaneous``; the rows are fixed before."""
    scope, _ = _scope(table)
    bound = []
    for column, expr in sets:
        if table.kind(column) is None:
            raise ColumnNotFoundError(column)
        e = scope.bind(expr)
        bound.append((column, e, scope.type_of(e) == "CHAR"))

    def change(rows: DataFrame, test: Column, make: Expressions, source: Source) -> DataFrame:
        made = rows.withColumn("_hit", test)
        values = {}
        for column, expr, is_text in bound:
            kind, length = next((k, n) for c, k, n in table.columns if c == column)
            target = column_name(source.name, column)
            value = F.when(F.col("_hit"), _assigned(make(expr), kind, length, is_text)).otherwise(F.col(f"`{target}`"))
            if simultaneous:
                values[target] = value
            else:
                made = made.withColumn(target, value)
        return made.withColumns(values) if simultaneous else made

    new, added = _rewritten(catalog, table, where, change)
    touched = {c for c, _ in sets}
    for key in table.keys:
        if added and touched & set(key):
            moved = catalog.frame(replace(table, files=added)).select(*key).distinct()
            if duplicates(catalog.frame(new).join(moved, list(key), "left_semi"), key):
                raise UniqueCheckError
    return new
