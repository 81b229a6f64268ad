"""Byte-bounded sharding by extendible hashing.

Each row has a 60-bit hash of its key and content.  A shard is a run of leading
hash bits; shards start as the whole space, and only those over the byte limit
split on one more bit.  Bytes are pre-aggregated per cell of leading bits before
anything is decided, so no step sees more than one row per cell and task, and a
hot source or key cannot matter: rows are spread by content.

Defined cases: null ids and texts hash and weigh as empty strings; rows that are
equal in both share their hash and cannot be parted by more bits, so a cell still
over the limit at 60 bits is cut into pages (``page`` from 0 on), dealt first to groups
of bounded size; a single row over the limit is a shard of its own; other columns are
ignored; an empty table gives no shards.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, text_or_empty

HASH_BITS = 60
SHARD_BYTES = 64 << 20
#: Bits added per round to the cells that are still too large.
ROUND_BITS = 8
#: Equal rows that are numbered together when they are cut into pages.
PAGE_ROWS = 100_000


def _prefix(bits):
    return F.shiftright(F.col("h"), HASH_BITS - bits)


def directory(rows: DataFrame, limit: int, bits: int) -> DataFrame:
    """Leaves over ``rows`` (h, bytes): cell (the first ``bits`` bits), depth, shard_bytes.

    A cell's leaf is its shortest prefix whose bytes fit; cells that fit at no depth
    have a null depth.
    """
    cells = rows.groupBy(_prefix(bits).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    levels = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {bits} - depth)")
    )
    sizes = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
    fits = levels.select("cell", "depth", "prefix").join(sizes.where(F.col("shard_bytes") <= limit), ["depth", "prefix"])
    leaf = fits.groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
    return cells.select("cell").join(leaf, "cell", "left").select("cell", "leaf.depth", "leaf.shard_bytes")


def extendible_shards(
    df: DataFrame, scratch: Scratch, key: str = "doc_id", content: str = "text", limit: int = SHARD_BYTES
) -> DataFrame:
    """Shard of each row: key, shard (its bits), depth, page, row_bytes, shard_bytes."""
    content_col = text_or_empty(content)
    hashed = df.select(
        F.col(key).alias("key"),
        F.conv(F.substring(F.md5(F.concat(text_or_empty(key), F.lit("\x1f"), content_col)), 1, 15), 16, 10).cast("long").alias("h"),
        F.octet_length(content_col).cast("long").alias("bytes"),
    )
    rows = scratch.table(hashed, "hashed")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, math.ceil(math.log2(max(1, total / limit))) + 3))
    done, left = None, rows
    while True:
        known = scratch.table(directory(left, limit, bits), f"directory-{bits}")
        placed = left.join(known.where("depth is not null"), _prefix(bits) == F.col("cell")).select(
            "key",
            F.col("bytes").alias("row_bytes"),
            F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"substring(lpad(bin(h), {HASH_BITS}, '0'), 1, depth)")).alias("shard"),
            "depth",
            F.lit(0).cast("long").alias("page"),
            "shard_bytes",
        )
        done = placed if done is None else done.unionByName(placed)
        over = known.where("depth is null").select("cell")
        if over.isEmpty():
            return done
        left = scratch.table(left.join(over, _prefix(bits) == F.col("cell"), "left_semi"), f"left-{bits}")
        if bits == HASH_BITS:
            return done.unionByName(_pages(left, limit, scratch))
        bits = min(HASH_BITS, bits + ROUND_BITS)


def _pages(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Equal rows, too many for one shard: pages of at most ``limit`` bytes (one row at least)."""
    rows = scratch.table(rows.withColumn("tag", F.monotonically_increasing_id()), "tagged")
    groups = rows.groupBy("h").agg(F.ceil(F.count("*") / PAGE_ROWS).cast("long").alias("groups"))
    each = F.broadcast(groups.where("groups > 1"))  # fewer than the rows by PAGE_ROWS
    dealt = rows.join(each, "h", "left").withColumn("groups", F.coalesce("groups", F.lit(1).cast("long")))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("tag"), F.col("groups")))
    spread = dealt.withColumn("n", F.row_number().over(Window.partitionBy("h", "group").orderBy("tag")) - 1)
    page = F.floor(F.col("n") / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("bytes"))))).cast("long")
    paged = spread.withColumn("page", page * F.col("groups") + F.col("group"))
    sizes = paged.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(sizes, ["h", "page"]).select(
        "key",
        F.col("bytes").alias("row_bytes"),
        F.expr(f"lpad(bin(h), {HASH_BITS}, '0')").alias("shard"),
        F.lit(HASH_BITS).alias("depth"),
        "page",
        "shard_bytes",
    )


def write_shards(df: DataFrame, assignment: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of ``df``, one folder per shard and page; keys must be unique here."""
    placed = df.join(assignment.select(F.col("key").alias(key), "shard", "page"), key)
    placed.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
