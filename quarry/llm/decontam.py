"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents long, so the question is containment: an item counts as
leaked if 3/4 or more of its distinct 5-word shingles are in a document.  Items are put
in size classes (powers of two of their shingle count).  An item's signature holds the
smallest values of a second hash of its n shingles, n - ceil(3/4 n) + 1 of them: a document
that lacks all of these holds fewer than 3/4 of the item, so no leak is missed.  Documents
shorter than 3/4 of a class's smallest item skip the class.  Every candidate is verified
against the item's whole shingle set.

Shingle sets of items are made on the executors.  The items are the query set: they go back
in blocks of ``BLOCK_ITEMS`` (each at most ``BLOCK_SHINGLES`` shingles, or one item), one
at a time.  A single block meets the documents in one pass.  If there are more, one pass
over the documents writes those with any signature value (told by a bitmap of
``FILTER_BITS`` bits), and the blocks are run over these only.  Documents never move.

Defined cases: items and documents without words match nothing; items of fewer than five
words are runs of that many words and match where the run occurs; null ids pass through;
texts are searched whole; repeated rows are reported each; other columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, prepare, without
from .shingles import SHINGLE_WORDS, mix64, whole_hash, window_hashes, word_hashes

#: Share of an item's shingles, in hundredths.
CONTAINED = 75
BLOCK_ITEMS = 20_000
BLOCK_SHINGLES = 4_000_000
FILTER_BITS = 28
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def needed(n: int) -> int:
    """Shingles of an item of ``n`` that a document must hold."""
    return -(-CONTAINED * n // 100)


def signature(found: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a document that holds enough has one at least."""
    return found[np.argsort(mix64(found ^ _SECOND), kind="stable")[: len(found) - needed(len(found)) + 1]]


class ItemIndex:
    """Signatures and shingle sets of a block of items, by size class."""

    def __init__(self, items: list[tuple]):
        """``items`` are rows of :func:`item_sets`."""
        self.ids = [i for i, _, _ in items]
        self.sets = [np.empty(0, np.uint64) if width else found for _, width, found in items]
        #: Items under a shingle: by their number of words, then their hash.
        self.short: dict[int, dict[int, list[int]]] = {}
        classes: dict[int, list[int]] = {}
        for k, (_, width, found) in enumerate(items):
            if width:
                self.short.setdefault(width, {}).setdefault(int(found[0]), []).append(k)
            else:
                classes.setdefault(len(found).bit_length(), []).append(k)
        #: (least shingles a document needs, sorted signature values, their items)
        self.classes: list[tuple[int, np.ndarray, np.ndarray]] = []
        for _, members in sorted(classes.items()):
            keys, owners = [], []
            for k in members:
                keys.append(signature(self.sets[k]))
                owners.append(np.full(len(keys[-1]), k))
            flat, of = np.concatenate(keys), np.concatenate(owners)
            by = np.argsort(flat, kind="stable")
            least = min(len(self.sets[k]) for k in members)
            self.classes.append((needed(least), flat[by], of[by]))

    def hits(self, windows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per class: the positions of ``windows`` that are signature values, and where in the class's list."""
        out = []
        for _, keys, _ in self.classes:
            at = np.searchsorted(keys, windows)
            at[at == len(keys)] = 0
            good = np.flatnonzero(keys[at] == windows)
            out.append((good, at[good]))
        return out

    def candidates(self, low: int, high: int, hits) -> set[int]:
        """Items with a signature value among the windows from ``low`` to ``high``."""
        found: set[int] = set()
        for (least, keys, owners), (good, at) in zip(self.classes, hits):
            if high - low < least:
                continue
            a, b = np.searchsorted(good, [low, high])
            for k in np.unique(at[a:b]):
                end = int(np.searchsorted(keys, keys[k], "right"))
                found.update(int(o) for o in owners[k:end])
        return found


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, widths, found = [], [], []
        for first, words, offsets in word_hashes(batch.column(1)):
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                if b > a:
                    rows.append(first + i)
                    widths.append(b - a if b - a < SHINGLE_WORDS else 0)
                    found.append(whole_hash(words[a:b]) if widths[-1] else np.unique(window_hashes(words[a:b])))
        arrays = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(widths, pa.int32()), arrays], names=["item_id", "width", "found"])


def item_sets(items: DataFrame, item: str, text: str) -> DataFrame:
    """item_id, width, found of the items with words: their shingles, or for under five words their number and one hash."""
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_sets, "item_id long, width int, found array<long>")


def item_blocks(sets: DataFrame) -> Iterator[ItemIndex]:
    """The items in blocks of bounded size, one after the other."""
    held, size = [], 0
    for row in sets.toLocalIterator():
        held.append((row[0], row[1], np.array(row[2], np.int64).view(np.uint64)))
        size += len(row[2])
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_SHINGLES:
            yield ItemIndex(held)
            held, size = [], 0
    if held:
        yield ItemIndex(held)


def _words(sets: DataFrame) -> tuple[np.ndarray, list[int]]:
    """A bitmap of the signature values of all items, and the word counts of those without a shingle."""
    low = np.uint64(64 - FILTER_BITS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.array(found, np.int64).view(np.uint64)
                at = (found if width else signature(found)) >> low
                n = pa.array(np.full(len(at), width, np.int32))
                yield pa.RecordBatch.from_arrays([n, pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["width", "at", "bits"])

    rows = sets.select("width", "found").mapInArrow(bits, "width int, at long, bits long")
    table = rows.groupBy("at").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()  # 2**(FILTER_BITS - 6) rows at most
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[table.column(0).to_numpy()] = table.column(1).to_numpy().view(np.uint64)
    return out, [r[0] for r in rows.where("width > 0").select("width").distinct().collect()]


def _suspects(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) that may hold a signature value."""
    shared, low = docs.sparkSession.sparkContext.broadcast(_words(sets)), np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, widths = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for first, words, offsets in word_hashes(batch.column(1)):
                for width in [0, *widths]:
                    runs = window_hashes(words, width) ^ np.uint64(width) if width else window_hashes(words)
                    at = runs >> low
                    hits = np.flatnonzero(bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1))
                    row = np.searchsorted(offsets, hits, "right") - 1
                    keep[first + row[hits + (width or SHINGLE_WORDS) <= offsets[row + 1]]] = True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def _searched(index: ItemIndex, column: pa.Array) -> Iterator[tuple[int, int, float]]:
    """(row, item number, containment) of the leaks in a column of texts."""
    for first, words, offsets in word_hashes(column):
        windows = window_hashes(words)
        hits = index.hits(windows)
        busy = np.unique(np.concatenate([np.searchsorted(offsets, g, "right") - 1 for g, _ in hits] or [np.empty(0, np.int64)]))
        for i in busy:
            low, high = int(offsets[i]), int(offsets[i + 1]) - SHINGLE_WORDS + 1
            if high <= low:
                continue
            found = index.candidates(low, high, hits)
            if found:
                own = np.unique(windows[low:high])
                for k in sorted(found):
                    both = len(np.intersect1d(index.sets[k], own, assume_unique=True))
                    if both >= needed(len(index.sets[k])):
                        yield first + int(i), k, both / len(index.sets[k])
        for width, wanted in index.short.items():
            runs = window_hashes(words, width) ^ np.uint64(width)
            seen: set[tuple[int, int]] = set()
            for at in np.flatnonzero(np.isin(runs, np.array(list(wanted), np.uint64))):
                i = int(np.searchsorted(offsets, at, "right")) - 1
                if at + width <= offsets[i + 1]:
                    seen.update((i, k) for k in wanted[int(runs[at])])
            for i, k in sorted(seen):
                yield first + i, k, 1.0


def _found_by(index) -> callable:
    """A map of (doc_id, text) to leaks; ``index`` is a broadcast block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(_searched(index.value, batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([index.value.ids[h[1]] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64())],
                names=["doc_id", "item_id", "containment"],
            )

    return run


_LEAKS = "doc_id long, item_id long, containment double"


def _first_blocks(items: DataFrame, scratch: Scratch, item: str, text: str) -> tuple[DataFrame, list[ItemIndex], Iterator[ItemIndex]]:
    """The items' sets, their first two blocks (or fewer) and the others."""
    sets = scratch.table(item_sets(items, item, text), "items")
    blocks = item_blocks(sets)
    return sets, list(islice(blocks, 2)), blocks


def leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, containment of each leak."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sets, first, more = _first_blocks(items, scratch, item, item_text)
    return _leaks(rows, sets, first, more, scratch)


def _leaks(rows: DataFrame, sets: DataFrame, first: list[ItemIndex], more: Iterator[ItemIndex], scratch: Scratch) -> DataFrame:
    spark = rows.sparkSession
    if not first:
        return spark.createDataFrame([], _LEAKS)
    if len(first) == 1:
        return rows.mapInArrow(_found_by(spark.sparkContext.broadcast(first[0])), _LEAKS)
    rows, found = scratch.table(_suspects(rows, sets), "suspects"), None
    for k, block in enumerate(chain(first, more)):
        shared = spark.sparkContext.broadcast(block)
        part = scratch.table(rows.mapInArrow(_found_by(shared), _LEAKS), f"leaks-{k}")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    scratch.drop("suspects")
    return found


def keep_uncontaminated(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) without a leak, with all their columns."""
    prepare(docs.sparkSession)
    sets, first, more = _first_blocks(items, scratch, "item_id", "text")
    at = docs.columns.index("text")
    if not first:
        return docs
    if len(first) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(first[0])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                bad[[h[0] for h in _searched(shared.value, batch.column(at))]] = True
                yield batch.filter(pa.array(~bad))

        return docs.mapInArrow(run, docs.schema)
    # texts are told by their hash, as ids may be null or repeated
    mark = free_name("leaked", docs)
    bad = _leaks(docs.select(F.xxhash64("text").alias("doc_id"), "text"), sets, first, more, scratch)
    bad = scratch.table(bad.select(F.col("doc_id").alias(mark)).distinct(), "leaked")
    return without(docs, bad, F.xxhash64("text") == F.col(mark))
