"""Scalar functions of the dialect, all built-in Spark expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import IncompatibleTypeError, QuarryError

#: name -> (least arguments, most arguments or None, maker)
FUNCTIONS: dict[str, tuple[int, int | None, Callable[..., Column]]] = {
    "UPPER": (1, 1, F.upper),
    "LOWER": (1, 1, F.lower),
    "SUBSTRING": (3, 3, lambda s, a, n: s.substr(a, n)),
    "CONCAT": (1, None, F.concat),
    "LENGTH": (1, 1, F.length),
    "ABS": (1, 1, F.abs),
    "COALESCE": (1, None, F.coalesce),
    "ROUND": (1, 2, F.round),
}
TEXT_RESULT = frozenset({"UPPER", "LOWER", "SUBSTRING", "CONCAT"})
#: Kinds of arguments: of the first, and of all others.
ARGUMENTS = {
    "UPPER": ("CHAR", None),
    "LOWER": ("CHAR", None),
    "LENGTH": ("CHAR", None),
    "CONCAT": ("CHAR", "CHAR"),
    "SUBSTRING": ("CHAR", "NUMBER"),
    "ABS": ("NUMBER", None),
    "ROUND": ("NUMBER", "NUMBER"),
}


def check(name: str, kinds: list[str | None]) -> None:
    """Raise unless the function exists and takes arguments of these kinds (None is unknown)."""
    if name not in FUNCTIONS:
        raise QuarryError(f"no such function: {name}")
    least, most, _ = FUNCTIONS[name]
    if len(kinds) < least or most is not None and len(kinds) > most:
        count = str(least) if least == most else f"{least} or more" if most is None else f"{least} to {most}"
        raise QuarryError(f"{name} takes {count} argument{'' if count == '1' else 's'}, {len(kinds)} given")
    first, rest = ARGUMENTS.get(name, (None, None))
    for k, kind in enumerate(kinds):
        wanted = rest if k else first
        if wanted and kind and kind != wanted:
            raise IncompatibleTypeError(name, kind)


def make(name: str, args: list[Column]) -> Column:
    """The expression of a checked call."""
    return FUNCTIONS[name][2](*args)
