"""N-gram Jaccard self-join: prefix keys, size-banded tiles, bitmap bounds, exact check.

Two texts link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct 5-word
shingles.  Steps:

1. Equal sets are found by a 128-bit fingerprint and stand behind one representative.
2. Shingles are ordered: rare ones by hash, then the very common ones (``hot``).  Any
   total order gives right results; this one keeps common passages out of the keys.
   Linked sets share one of the first |A| - ceil(3/4 |A|) + 1 shingles of that order,
   and all of these are a set's keys, so no link is missed.
3. Per key, some sets are drawn as centres; the others are paired with them, each at the
   first few of its keys (``FIRST``), and those that do not link with the set most like
   their centre.  When the links among these pairs are merged, all sets of a key that are still in different components are paired, tile by tile: a key
   of many sets is dealt to tiles of ``TILE`` sets each, and every pair of tiles is a group
   of its own, in which sizes (ratio 4/3 at most) bound the rows that are compared.
   Keys that list the same sets count once, and of the keys that two sets have among
   their first ones only the smallest makes the pair.
4. A pair passes if the bit counts of two folded parity bitmaps allow the overlap:
   |A & B| <= (|A| + |B| - popcount(a xor b)) / 2.
5. Exact intersection of sorted arrays.

No list of a key, component or pair is collected.  The result is the components: pairs
that are already in one component are not tested, so neither the links inside it nor
their number are known.

Defined cases: texts that are null, empty or white space have no shingles and link
with nothing; texts under five words have one shingle, the whole sequence; rows with a
null id get a null component and link nothing; rows sharing an id are one node; texts have
no length limit; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, looked_up, prepare, tidy, without
from .components import connected_components
from .shingles import mix64, shingle_sets

LINK = 75
#: A shingle is hot from this many texts on, if one task sees it this often at least.
HOT_TEXTS, HOT_SEEN = 48, 3
#: Most hot shingles kept (the most frequent ones); it bounds the broadcast, not the result.
HOT_MOST = 1 << 19
#: First rare and first hot keys of a set, at which it meets centres, and centres drawn per key.
FIRST, CENTRES = 8, 3
#: Sets of a key in a tile.
TILE = 4096
#: Bytes of bitmaps that are compared at once.
COMPARED = 4 << 20
#: Up to so many ids of candidates are broadcast to the texts, more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Shingles counted at once in a task.
BLOCK = 2 << 20
#: Shuffle files go with the table they were made for, so that those of all steps do not add up.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BITS_LEAST, BITS_MOST, BITS_EACH = 64, 1 << 17, 4
#: Most bytes of the bitmaps that travel with each key; they have half the bits of the others.
SMALL_MOST = 1024


def _long_list(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    values = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _hot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): shingles seen in several different sets of this task."""
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def flush() -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= HOT_SEEN
        return pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["key", "n"])

    for batch in batches:
        for _, found in shingle_sets(batch.column(0)):
            print_ = hash(found.tobytes())
            if len(found) and print_ not in seen:
                seen.add(print_)
                held.append(found)
                size += len(found)
                if size >= BLOCK:
                    yield flush()
                    held, seen, size = [], set(), 0
    if held:
        yield flush()


_ONE, _TOP = np.uint64(1), np.uint64(1 << 63)


def prefix_length(n: int) -> int:
    """Shingles of which one at least is shared by any linked set."""
    return n - (LINK * n + 99) // 100 + 1


def keys_of(found: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set is listed (see step 2), in order, and the first rare and first hot ones of them.

    A key is a shingle's hash with the highest bit telling the hot ones, so that keys are in order as numbers.
    """
    need = prefix_length(len(found))
    at = np.searchsorted(hot, found) if len(hot) else np.zeros(0, np.int64)
    at[at == len(hot)] = 0
    common = hot[at] == found if len(hot) else np.zeros(len(found), bool)
    rare, often = (found[~common] >> _ONE)[:need], found[common] >> _ONE | _TOP
    often = often[: need - len(rare)]
    return np.concatenate([rare, often]), np.concatenate([rare[:FIRST], often[:FIRST]])


def bitmap_of(found: np.ndarray) -> bytes:
    """Parity bitmap of a set; its width is a power of two, ``BITS_EACH`` bits a shingle or more.

    Sets that differ in d shingles show about d - d * d / width odd bits, so at this width
    the bound tells a similarity of 0.72 from one of 0.75.
    """
    width = min(BITS_MOST, max(BITS_LEAST, BITS_EACH << max(0, len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    # packbits keeps bit order, so halves fold onto each other
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def small_bitmap(bits: bytes) -> bytes:
    """The bitmap folded for the rows of tiles."""
    return _folded(np.frombuffer(bits, np.uint8), min(SMALL_MOST, max(BITS_LEAST // 8, len(bits) // 2)) if bits else 0).tobytes()


def may_link(n: int, m: int, a: bytes, b: bytes) -> bool:
    """Whether the bitmaps allow a link between sets of ``n`` and ``m`` shingles."""
    if 100 * min(n, m) < LINK * max(n, m):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
    most = (n + m - differ) // 2
    return (100 + LINK) * most >= LINK * (n + m)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def links(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted distinct arrays."""
    both = shared(a, b)
    return len(a) > 0 and 100 * both >= LINK * (len(a) + len(b) - both)


def hot_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most common shingles; bounded by ``HOT_MOST``."""
    counts = texts.select("text").mapInArrow(tidy(_hot_counts), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_TEXTS)
    rows = counts.orderBy(F.desc("n"), "key").limit(HOT_MOST).select("key").toArrow()
    return np.sort(rows.column(0).to_numpy().view(np.uint64)) if rows.num_rows else np.empty(0, np.uint64)


def signatures(texts: DataFrame, hot: np.ndarray) -> DataFrame:
    """doc_id, n, f1, f2 (fingerprint of the set), keys, firsts, bits, small of each row of ``texts`` (doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            n, f1, f2, keys, firsts, bits, small = [], [], [], [], [], [], []
            for _, found in shingle_sets(batch.column(1)):
                n.append(len(found))
                f1.append(int(mix64(found).sum(dtype=np.uint64)) if len(found) else 0)
                f2.append(int((mix64(found ^ np.uint64(0xA5A5A5A55A5A5A5A)) * (found | np.uint64(1))).sum(dtype=np.uint64)) if len(found) else 0)
                own, first = keys_of(found, often) if len(found) else (found, found)
                keys.append(own)
                firsts.append(first)
                bits.append(bitmap_of(found) if len(found) else b"")
                small.append(small_bitmap(bits[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(f1, np.uint64).view(np.int64)), pa.array(np.array(f2, np.uint64).view(np.int64)), _long_list(keys), _long_list(firsts), pa.array(bits, pa.binary()), pa.array(small, pa.binary())],
                names=["doc_id", "n", "f1", "f2", "keys", "firsts", "bits", "small"],
            )

    return texts.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n long, f1 long, f2 long, keys array<long>, firsts array<long>, bits binary, small binary")


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, n, tile, node, comp, small, firsts) sorted by the first four: pairs of tiles i and j.

    A pair is of different components, and sizes and bitmaps allow it.  Sets that share several of their
    first keys are paired at the smallest of these only.
    """
    held: list[np.ndarray] | None = None

    def allowed(n: np.ndarray, bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = min(map(len, (bits[0], bits[-1])))  # sizes rise, so do widths
        flat = np.stack([_folded(np.frombuffer(b, np.uint8), size) for b in bits]).view(np.uint64 if size % 8 == 0 else np.uint8)
        most = (n[i] + n[j] - np.bitwise_count(flat[i] ^ flat[j]).sum(axis=1, dtype=np.int64)) // 2
        return (100 + LINK) * most >= LINK * (n[i] + n[j])

    def pairs(key: int, same: bool, n: np.ndarray, tile: np.ndarray, node: np.ndarray, comp: np.ndarray, bits: np.ndarray, firsts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(n) < 2 or (comp == comp[0]).all():
            return
        smaller: dict[int, frozenset] = {}  # row -> those of its first keys that are under this one

        def earlier(r: int) -> frozenset:
            if r not in smaller:
                own = np.asarray(firsts[r]).view(np.uint64)
                smaller[r] = frozenset(own[own < np.int64(key).view(np.uint64)].tolist())
            return smaller[r]

        low = np.searchsorted(100 * n, LINK * n)
        for a in range(1, len(n), 128):
            b = min(len(n), a + 128)
            lo = int(low[a])
            near = (np.arange(lo, b)[None, :] < np.arange(a, b)[:, None]) & (np.arange(lo, b)[None, :] >= low[a:b, None]) & (comp[lo:b][None, :] != comp[a:b][:, None])
            if not same:
                near &= tile[lo:b][None, :] != tile[a:b][:, None]
            i, j = np.nonzero(near)
            step = min(1 << 16, max(1, COMPARED // len(bits[lo])))  # the smallest one, to which the others fold
            for k in range(0, len(i), step):
                at, to = i[k : k + step] + a - lo, j[k : k + step]
                good = np.flatnonzero(allowed(n[lo:b], bits[lo:b], at, to))
                fresh = [earlier(x).isdisjoint(earlier(y)) for x, y in zip((at[good] + lo).tolist(), (to[good] + lo).tolist())]
                good = good[np.array(fresh, bool)]
                x, y = node[lo:b][at[good]], node[lo:b][to[good]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    def group(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        return pairs(cols[0][0], cols[1][0] == cols[2][0], *cols[3:])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        new = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1])
        for s, e in zip(cuts[:-1], cuts[1:]):
            yield from group([c[s:e] for c in cols])
        held = [c[cuts[-1] :] for c in cols]
    if held is not None:
        yield from group(held)


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [may_link(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, fa, fb) -> the pairs that link, with their similarity."""
    for batch in batches:
        sets = list(zip(_lists(batch.column(2)), _lists(batch.column(3))))
        both = np.array([shared(x, y) for x, y in sets], np.int64)
        every = np.array([len(x) + len(y) for x, y in sets], np.int64) - both
        keep = (both > 0) & (100 * both >= LINK * every)
        found = batch.filter(pa.array(keep)).select(["a", "b"])
        yield pa.RecordBatch.from_arrays([*found.columns, pa.array(both[keep] / every[keep])], names=["a", "b", "like"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [s for _, s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), _long_list(found)], names=["node", "found"])


def verified(pairs: DataFrame, sizes: DataFrame, texts: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """The pairs (a, b) that link, and how alike they are; ``sizes`` has node, n, bits and ``texts`` doc_id, text."""
    of = lambda k: sizes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    bounded = scratch.table(
        pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(tidy(_bounded), "a long, b long"), f"{label}-bounded"
    )
    wanted = scratch.table(bounded.select(F.col("a").alias("doc_id")).union(bounded.select("b")).distinct(), f"{label}-wanted")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = scratch.table(texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tidy(_sets), "node long, found array<long>"), f"{label}-sets")
    both = bounded.join(sets.select(F.col("node").alias("a"), F.col("found").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b")
    found = scratch.table(both.select("a", "b", "fa", "fb").mapInArrow(tidy(_exact), "a long, b long, like double").distinct(), f"{label}-links")
    scratch.drop(f"{label}-sets", f"{label}-bounded", f"{label}-wanted")
    return found


def jaccard_components(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    spark.conf.set(CLEANUP, "true")
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sigs = scratch.table(signatures(texts, hot_shingles(texts)), "signatures")
    members = scratch.table(sigs.select("doc_id", "f1", "f2", "n"), "members")
    classes = members.where("n > 0 AND doc_id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows"))
    classes = scratch.table(classes, "classes")
    nodes = classes.select(F.col("node").alias("doc_id"))
    nodes = F.broadcast(nodes) if classes.count() <= BROADCAST_IDS else nodes
    own = scratch.table(sigs.where("n > 0").join(nodes, "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "n", "keys", "firsts", "bits", "small"), "own")
    scratch.drop("signatures")

    first = own.select(F.explode("firsts").alias("key"), "n", "node").repartition("key")
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n")).alias(f"c{k}") for k in range(CENTRES)]
    centres = first.groupBy("key").agg(F.count("*").alias("m"), *drawn).where("m > 1").select("key", F.array(*[F.struct(f"c{k}.node", f"c{k}.n") for k in range(CENTRES)]).alias("centres"))
    fits = (F.col("c.node") != F.col("node")) & (100 * F.least("n", "c.n") >= LINK * F.greatest("n", "c.n"))
    pair = lambda x, y: [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]
    spokes = first.join(centres, "key").select("n", "node", F.explode("centres").alias("c")).where(fits).select(F.col("c.node").alias("centre"), "node").distinct()
    spokes = scratch.table(spokes, "spokes")
    stars = scratch.table(spokes.select(*pair("centre", "node")).distinct(), "stars")
    sizes = own.select("node", "n", "bits")
    near = verified(stars, sizes, texts, scratch, "stars")

    # Copies of one text are more like it than like each other: the centre's nearest takes its place.
    merged = connected_components(near, scratch, "drawn")
    ends = near.select("a", "b", "like").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "like"))
    nearest = ends.groupBy(F.col("a").alias("centre")).agg(F.min(F.struct((-F.col("like")).alias("d"), F.col("b").alias("v")))["v"].alias("next"))
    nearest = spokes.groupBy("centre").agg(F.count("*").alias("m")).join(nearest, "centre")
    nearest = nearest.join(merged.select(F.col("node").alias("next"), F.col("comp").alias("there")), "next").select("centre", "next", "there", "m")
    moved = looked_up(spokes, scratch.table(nearest, "nearest"), ["centre"], "m").where("next IS NOT NULL AND next <> node").join(merged, "node", "left")
    moved = moved.where(F.coalesce("comp", "node") != F.col("there")).select(*pair("next", "node")).distinct().join(stars, ["a", "b"], "left_anti")
    moved = scratch.table(moved, "moved")
    near = near.unionByName(verified(moved, sizes, texts, scratch, "moved"))
    tried = stars.unionByName(moved)

    # every key of every set, dealt once; only keys with several components go on
    merged = connected_components(near, scratch, "merged")
    known = own.select("node", "n", "keys").join(merged, "node", "left").select(F.explode("keys").alias("key"), "n", "node", F.coalesce("comp", "node").alias("comp"))
    prints = [F.expr(f"bit_xor(xxhash64(node, {k}))").alias(f"p{k}") for k in (1, 2)]
    # the rows are smaller than partial aggregates, as most keys are in one place only
    mixed = known.select("key", "node", "comp").repartition("key").groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), *prints).where("x <> y")
    mixed = mixed.groupBy("m", "p1", "p2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / TILE).cast("int").alias("tiles"))
    mixed = scratch.table(mixed, "mixed")  # the shuffled keys go with this
    small = mixed.count() <= BROADCAST_IDS
    tiled = known.join(F.broadcast(mixed) if small else mixed, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "n", "tile", "node", "comp")
    crossing = (
        tiled.join(own.select("node", "small", "firsts"), "node")
        .repartition("key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "n", "node")
        .select("key", "i", "j", "n", "tile", "node", "comp", "small", "firsts")
        .mapInArrow(tidy(_crossing), "a long, b long")
        .distinct()
        .join(tried, ["a", "b"], "left_anti")
    )
    more = verified(scratch.table(crossing, "crossing"), sizes, texts, scratch, "crossing")
    comps = connected_components(near.unionByName(more), scratch, "all")
    of_class = classes.join(comps, "node", "left").select("f1", "f2", "n", "rows", F.coalesce("comp", "node").alias("comp"))
    of_class = scratch.table(of_class, "of-class")
    scratch.drop("spokes", "stars", "moved", "nearest", "mixed", "crossing", "own", "classes")
    spark.conf.unset(CLEANUP)
    found = looked_up(members, of_class, ["f1", "f2", "n"], "rows")
    # a null id stays null
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row of each group of linked texts (that with the smallest id), with all columns; rows with a null id stay.

    Of rows that share the id, the first by a hash of all their columns stays.
    """
    found = scratch.table(jaccard_components(docs, scratch), "groups")
    mark = free_name("other", docs)
    others = scratch.table(found.where("doc_id <> component_id").select(F.col("doc_id").alias(mark)).distinct(), "others")
    kept = without(docs, others, F.col("doc_id") == F.col(mark))
    again = scratch.table(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(mark)), "again")
    if again.isEmpty():
        return kept
    whole = F.struct(*docs.columns)
    few = kept.join(again, F.col("doc_id") == F.col(mark), "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return without(kept, again, F.col("doc_id") == F.col(mark)).unionByName(few.select("row.*"))
