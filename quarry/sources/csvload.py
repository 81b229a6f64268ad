"""The LOAD reader: comma-separated text, one header line per file, no quoting.

Fields go to columns by position; rows with too few fields are dropped, further fields
ignored; texts are cut to their column's length; numbers are read up to the first
character that does not belong to one (0 if there is none).
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Table

_NEVER = "\u0001"


def resolve(path: str) -> str:
    """A path with a scheme or from the root stays; others are looked up from here."""
    if "://" in path or path.startswith("/"):
        return path
    return str(Path(path).resolve())


def read_rows(spark: SparkSession, path: str, table: Table) -> DataFrame:
    # a separator that never occurs: the CSV reader then only drops each file's header line
    lines = spark.read.schema("value string").option("header", True).option("sep", _NEVER).option("quote", "").option("enforceSchema", True).csv(resolve(path))
    fields = F.split(F.regexp_replace("value", r"\r$", ""), ",", -1)
    out = []
    for k, (name, kind, length) in enumerate(table.columns):
        raw = F.get(F.col("f"), F.lit(k))
        if kind == "CHAR":
            value = F.substring(raw, 1, length)
        elif kind == "INT":
            digits = F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1)
            value = F.when(digits == "", 0).otherwise(F.expr(f"try_cast(nullif(regexp_extract(get(f, {k}), '^\\\\s*([+-]?\\\\d+)', 1), '') as int)"))
        else:
            digits = F.regexp_extract(raw, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
            value = F.when(digits == "", F.lit(0.0)).otherwise(digits.try_cast("double")).cast("float")
        out.append(value.alias(name))
    return lines.where("value is not null").select(fields.alias("f")).where(F.size("f") >= len(table.columns)).select(*out)
