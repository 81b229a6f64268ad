"""Errors that statements raise; messages are part of the surface."""

from __future__ import annotations


class QuarryError(Exception):
    """Base of all errors of this package."""


class SyntaxProblem(QuarryError):
    """The text is not a statement of the dialect."""


class TableNotFoundError(QuarryError):
    def __init__(self, table: str):
        super().__init__(f"Table not found: {table}")


class TableExistsError(QuarryError):
    def __init__(self, table: str):
        super().__init__(f"Table already exists: {table}")


class ColumnNotFoundError(QuarryError):
    def __init__(self, column: str):
        super().__init__(f"Column not found: {column}")


class AmbiguousColumnError(QuarryError):
    def __init__(self, column: str):
        super().__init__(f"Ambiguous column: {column}")


class IndexNotFoundError(QuarryError):
    def __init__(self, table: str, columns):
        super().__init__(f"Index not found: {table}.({', '.join(columns)})")


class IndexExistsError(QuarryError):
    def __init__(self, table: str, columns):
        super().__init__(f"Index already exists: {table}.({', '.join(columns)})")


class InvalidValueCountError(QuarryError):
    def __init__(self):
        super().__init__("Invalid value count")


class StringOverflowError(QuarryError):
    def __init__(self):
        super().__init__("String is too long")


class IncompatibleTypeError(QuarryError):
    def __init__(self, left: str, right: str):
        super().__init__(f"Incompatible type error: lhs {left}, rhs {right}")


class InvalidAggregateError(QuarryError):
    def __init__(self, column: str, reason: str):
        super().__init__(f"Can not use {column} with {reason}")


class UniqueCheckError(QuarryError):
    def __init__(self):
        super().__init__("Unique check failed")


class NonUniqueIndexError(QuarryError):
    def __init__(self, table: str, columns):
        super().__init__(f"Rows of {table} are not unique in ({', '.join(columns)})")


class EvaluationError(QuarryError):
    """An expression failed on a row: division by zero, a bad conversion."""


class TransactionAbortError(QuarryError):
    """Another session committed first; the transaction is rolled back."""
