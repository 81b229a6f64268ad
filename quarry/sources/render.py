"""Result sinks: the client's table format and the bar format of output files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

WIDTH = 16
LIMIT_BYTES = 8192
#: Bytes kept free for the record count.
RESERVED = 40


def cell(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def most_rows(columns: int, limit: int = LIMIT_BYTES) -> int:
    """Rows of which a table of ``limit`` bytes shows one less at most."""
    return max(1, limit // ((WIDTH + 3) * columns + 2))


def table(columns: list[str], rows: Iterable[tuple], total: int, limit: int = LIMIT_BYTES) -> str:
    """Cells of 16 characters, right-aligned; output over ``limit`` bytes ends in an ellipsis.

    ``rows`` are the first ones, as many as fit, of ``total``.
    """
    rule = ("+" + "-" * (WIDTH + 2)) * len(columns) + "+\n"
    line = lambda cells: "".join(f"| {c if len(c) <= WIDTH else c[: WIDTH - 3] + '...':>{WIDTH}} " for c in cells) + "|\n"
    text, full = rule + line(columns) + rule, False
    for row in rows:
        more = line([cell(v) for v in row])
        full = len((text + more).encode()) + RESERVED >= limit
        if full:
            break
        text += more
    return text + ("... ...\n" if full else rule) + f"Total record(s): {total}\n"


def bars(columns: list[str], rows: Iterable[tuple]) -> Iterator[str]:
    """One ``| a | b |`` line per row, the column names first; rows come as they are written."""
    yield "|" + "".join(f" {c} |" for c in columns) + "\n"
    for row in rows:
        yield "|" + "".join(f" {cell(v)} |" for v in row) + "\n"
