"""Near-duplicate vectors by sorted projection passes.

Only vectors of one label are compared.  Equal vectors (bit for bit) are one class
with a count.  Each pass draws random hyperplanes, concatenates the sign bits of a
vector, taken from the mean of its label's unit vectors, to a key and sorts (label,
key); every class is compared in double precision, on the vectors themselves, with its
``WINDOW`` predecessors in that order, and links (cosine >= 0.98) of all passes are
united.  The keys of different passes are independent, so a pair that one order parts is
adjacent in another.  The number of passes of a label follows its size and its spread
(``passes_of``); they run ``TURN`` at a time.

Dense groups hold more partners than a window.  A row that links even with the last one of
its window is full; full rows that link form dense groups, inside which all pairs are tested
exactly, block against block.  That work is in proportion to the answer, as such groups
are dense.  All other links are those that the passes found, counted once.

Defined cases: a null label or vector, a null, infinite or NaN component and the zero
vector link with nothing and are their own component; vectors of different lengths
never link; rows sharing an id are counted each but are one node; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, looked_up, prepare
from .components import connected_components

COSINE = 0.98
#: Passes of a label at least, and passes in one job.
PASSES = TURN = 12
#: Chance with which a pair just at COSINE should come near in some pass.
RECALL = 0.99
WINDOW = 24
KEY_BITS = 62
#: Members of a component compared in one task at a time.
BLOCK = 512
SEED = 7919
#: Means of up to so many labels are broadcast.
BROADCAST_LABELS = 1 << 15
#: Classes per sorted partition.
PART_ROWS = 20_000


def _matrix(column: pa.Array) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b].astype(np.float64) for a, b in zip(offsets[:-1], offsets[1:])]


def _planes(dim: int, k: int) -> np.ndarray:
    return np.random.default_rng([SEED, k, dim]).standard_normal((dim, KEY_BITS))


def passes_of(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Passes for labels of ``n`` classes whose mean unit vector has the squared length ``mean``.

    A pair at COSINE has the cosine r about the mean, so each sign bit agrees with chance
    1 - acos(r) / pi; it should share the bits that leave WINDOW classes.  Where nearly all
    pairs link, or as many comparisons would make all pairs, there is no need for more.
    """
    n, spread = np.asarray(n, float), np.maximum(1 - np.asarray(mean, float), 1e-9)
    agree = 1 - np.arccos(np.clip(1 - (1 - COSINE) / spread, 0, 1)) / np.pi
    near = np.clip(agree ** np.maximum(0, np.log2(n / WINDOW)), 1e-9, 1 - 1e-9)
    want = np.where(spread <= 1 - COSINE, 0, np.log(1 - RECALL) / np.log(1 - near))
    return np.ceil(np.maximum(PASSES, np.minimum(want, n / (2 * WINDOW)))).astype(np.int64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, v) -> (label, dim, n, total of unit vectors) of a task."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for label, v in zip(batch.column(0).to_pylist(), _matrix(batch.column(1))):
            own = held.setdefault((label, len(v)), [0, np.zeros(len(v))])
            own[0] += 1
            own[1] += v / np.linalg.norm(v)
    yield _rows(held)


def _rows(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
    totals = pa.array([t.tolist() for _, t in held.values()], pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([d for _, d in held], pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), totals], names=["label", "dim", "n", "total"])


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, dim, n, total), all of a label -> (label, dim, mean, passes)."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for label, dim, n, total in zip(*(batch.column(i).to_pylist() for i in range(3)), _matrix(batch.column(3))):
            own = held.setdefault((label, dim), [0, np.zeros(dim)])
            own[0] += n
            own[1] += total
    for own in held.values():
        own[1] /= own[0]
        own[0] = int(passes_of(own[0], own[1] @ own[1]))
    out = _rows(held)
    yield pa.RecordBatch.from_arrays([out.column(0), out.column(1), out.column(3), out.column(2)], names=["label", "dim", "mean", "passes"])


def _keyed(turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, label, v, mean, passes) -> a row per pass of the turn with its key."""
        weights = 1 << np.arange(KEY_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            vectors, means = _matrix(batch.column(2)), _matrix(batch.column(3))
            passes = batch.column(4).to_numpy()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                m = np.stack([vectors[i] / np.linalg.norm(vectors[i]) - means[i] for i in rows])
                rows = np.array(rows)
                for k in range(turn * TURN, (turn + 1) * TURN):
                    own = np.flatnonzero(passes[rows] > k)
                    if not len(own):
                        break
                    key = ((m[own] @ _planes(dim, k)) > 0) @ weights
                    part = batch.take(pa.array(rows[own]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k, np.int32)), part.column(1), pa.array(key), part.column(0), part.column(2)], names=["pass", "label", "key", "node", "v"])

    return run


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pass, label, key, node, v) in order: links between a row and its WINDOW predecessors; full ones reach the last."""
    tail: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = _matrix(batch.column(4))
        dim = max(len(v) for v in vectors)
        if tail is not None:
            dim = max(dim, tail[3].shape[1])
        unit = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            unit[i, : len(v)] = v / np.linalg.norm(v)
        sizes = np.array([len(v) for v in vectors])
        group = batch.column(0).to_numpy().astype(np.int64) * (1 << 40) + batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        node = batch.column(3).to_numpy()
        if tail is not None:
            old = np.zeros((len(tail[0]), dim))
            old[:, : tail[3].shape[1]] = tail[3]
            group, node, sizes, unit = (np.concatenate(x) for x in ((tail[0], group), (tail[1], node), (tail[2], sizes), (old, unit)))
        new = len(node) - batch.num_rows
        xs, ys, full = [], [], []
        for d in range(1, min(WINDOW, len(node) - 1) + 1):
            lo = max(new, d)
            near = (group[lo:] == group[lo - d : -d]) & (sizes[lo:] == sizes[lo - d : -d]) & (node[lo:] != node[lo - d : -d])
            near &= np.einsum("ij,ij->i", unit[lo:], unit[lo - d : -d]) >= COSINE
            i = np.flatnonzero(near) + lo
            xs.append(node[i])
            ys.append(node[i - d])
            full.append(np.full(len(i), d == WINDOW))
        x, y = np.concatenate(xs or [node[:0]]), np.concatenate(ys or [node[:0]])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.concatenate(full or [np.empty(0, bool)]))], names=["a", "b", "full"])
        tail = [group[-WINDOW:], node[-WINDOW:], sizes[-WINDOW:], unit[-WINDOW:]]


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks: (node, n, v) lists x and y and whether they are one block -> (node, n_links)."""
    for batch in batches:
        for x, y, same in zip(*(batch.column(i).to_pylist() for i in range(3))):
            a, b = (np.array([r["v"] for r in s], dtype=np.float64) for s in (x, y))
            a /= np.linalg.norm(a, axis=1, keepdims=True)
            b /= np.linalg.norm(b, axis=1, keepdims=True)
            hit = a @ b.T >= COSINE
            na, nb = (np.array([r["n"] for r in s], dtype=np.int64) for s in (x, y))
            if same:
                np.fill_diagonal(hit, False)
                yield pa.RecordBatch.from_arrays([pa.array([r["node"] for r in x], pa.int64()), pa.array(hit @ nb)], names=["node", "links"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["node"] for r in x] + [r["node"] for r in y], pa.int64()), pa.array(np.concatenate([hit @ nb, na @ hit]))], names=["node", "links"]
                )


def near_vectors(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of ``vectors``."""
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col("v")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = "float" if dict(vectors.dtypes)[vector] == "array<float>" else "double"  # cosines are taken in double either way
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast(f"array<{kind}>").alias("v"))
    fit = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall(v, sound) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("fit", fit).withColumn("v", F.when(F.col("fit"), F.transform(v, lambda x: x + F.lit(0).cast(kind))))  # no negative zeros
    rows = scratch.table(rows.withColumns({"p1": F.xxhash64("v"), "p2": F.xxhash64("v", F.lit(1))}), "rows")
    same = ["label", "p1", "p2"]
    classes = scratch.table(rows.where("fit").groupBy(*same, "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "classes")
    shape = classes.select("label", "v").mapInArrow(_summed, "label long, dim int, n long, total array<double>").repartition("label", "dim")
    shape = scratch.table(shape.mapInArrow(_shaped, "label long, dim int, mean array<double>, passes long"), "shape")
    shape = F.broadcast(shape) if shape.count() <= BROADCAST_LABELS else shape
    most = shape.agg(F.max("passes")).first()[0] or 0
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # the shuffle files of one turn go before the next
    pairs = None
    for turn in range(-(-most // TURN)):
        wide = classes.withColumn("dim", F.size("v")).join(shape.where(F.col("passes") > turn * TURN), ["label", "dim"]).select("node", "label", "v", "mean", "passes")
        parts = max(1, wide.count() * TURN // PART_ROWS)
        keyed = wide.mapInArrow(_keyed(turn), f"pass int, label long, key long, node long, v array<{kind}>")
        found = keyed.repartitionByRange(parts, "pass", "label", "key").sortWithinPartitions("pass", "label", "key", "node").mapInArrow(_windowed, "a long, b long, full boolean")
        found = found if pairs is None else found.unionByName(pairs)
        pairs = scratch.table(found.groupBy("a", "b").agg(F.max("full").alias("full")), f"pairs-{turn}")
        scratch.drop(f"pairs-{turn - 1}")
    if pairs is None:
        pairs = spark.createDataFrame([], "a long, b long, full boolean")
    comps = scratch.table(connected_components(pairs.select("a", "b"), scratch), "components")

    # Links within dense groups, block by block.
    full = pairs.where("full")
    full = scratch.table(full.select(F.col("a").alias("node")).unionAll(full.select("b")).distinct(), "full")
    edges = pairs.join(full.withColumnRenamed("node", "a"), "a", "left_semi").join(full.withColumnRenamed("node", "b"), "b", "left_semi")
    groups = scratch.table(connected_components(edges.select("a", "b"), scratch, "dense").withColumnRenamed("comp", "dense"), "groups")
    inside = classes.join(groups, "node").select("dense", "label", F.size("v").alias("dim"), F.struct("node", "n", "v").alias("m"), "node")
    sized = groups.groupBy("dense").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    cut = inside.join(sized, "dense").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = scratch.table(cut.groupBy("dense", "label", "dim", "block").agg(F.collect_list("m").alias("ms"), F.first("blocks").alias("blocks")), "blocks")
    left = blocks.select("dense", "label", "dim", "block", F.col("ms").alias("x"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("other"))
    right = blocks.select("dense", "label", "dim", F.col("block").alias("other"), F.col("ms").alias("y"))
    tiles = left.join(right, ["dense", "label", "dim", "other"]).select("x", "y", (F.col("block") == F.col("other")).alias("same"))
    counts = tiles.mapInArrow(_blocked, "node long, links long")

    # All other links, one by one.
    in_group = lambda k: groups.select(F.col("node").alias(k), F.col("dense").alias(f"dense_{k}"))
    single = pairs.join(in_group("a"), "a", "left").join(in_group("b"), "b", "left").where("dense_a IS NULL OR dense_b IS NULL OR dense_a <> dense_b").select("a", "b")
    ends = single.unionAll(single.select("b", "a")).join(classes.select(F.col("node").alias("b"), "n"), "b").select(F.col("a").alias("node"), F.col("n").alias("links"))
    counts = scratch.table(counts.unionByName(ends).groupBy("node").agg(F.sum("links").alias("links")), "counts")
    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")

    of_class = classes.select("node", *same, "n").join(counts, "node", "left").join(comps, "node", "left")
    of_class = of_class.select(*same, "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("comp", "node").alias("component_id"))
    fitting = looked_up(rows.where("fit").select("vec_id", *same), scratch.table(of_class, "of-class"), same).select("vec_id", "n_links", "component_id")
    scratch.drop("blocks", "counts", "classes", "groups", "full", "components", f"pairs-{-(-most // TURN) - 1}")
    others = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return fitting.unionByName(others).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
