"""Word trigram model of the trusted texts: interpolated Kneser-Ney, sharded by its contexts.

A position of a text is a word c after the words a and b (case folded, split at white
space; a mark stands before the first word).  Every trigram of every trusted text is
counted, so the table grows with the corpus.  It is keyed by 32-bit hashes within a shard
of (a, b) and (b, c), which belong to the shard of b; a frequent b is dealt to several
shards by a, each of which takes the lower order from its own part.  The number of
shards follows the trusted words, so a shard's table has a bounded size.

The positions of all documents go to the same shards, packed per Arrow batch and shard;
partial sums go back to the batch.  A trusted text is scored without its own counts, at
both orders, so that trusted and other texts can be compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .shingles import mix64, string_buffers, word_hashes

#: Trusted words a shard should have.
SHARD_WORDS = 1_000_000
#: Share of a batch's words from which a word is looked at for being frequent.
FREQUENT = 0.0005
#: Smallest hashes kept to estimate the number of different words.
SKETCH = 1024
#: Words of mean trusted text added to every document, so that a few words prove little.
PRIOR = 16
#: Trusted ids up to this number are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: Bytes of text packed at once.
PIECE_BYTES = 1 << 22
#: Shards are scored in so many passes over the texts; the shuffle files of one go before the next.
PASSES = 2

_MARK = np.uint64(0x5851F42D4C957F2D)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (kind, word, n): 0 all words, 1 frequent words, 2 smallest hashes."""
    total, least = 0, np.empty(0, np.uint64)
    for batch in batches:
        for _, words, _ in word_hashes(batch.column(0)):
            different, counts = np.unique(words, return_counts=True)
            total += len(words)
            least = np.union1d(least, np.sort(mix64(different))[:SKETCH])[:SKETCH]
            often = counts >= max(2, FREQUENT * len(words))
            if often.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(int(often.sum()), np.int32)), pa.array(different[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["kind", "word", "n"])
    kinds = np.array([0] + [2] * len(least), np.int32)
    words = np.concatenate([[0], (least >> np.uint64(1)).astype(np.int64)])
    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(words), pa.array(np.array([total] + [0] * len(least), np.int64))], names=["kind", "word", "n"])


class Plan:
    """Shards, the parts of frequent words, and the log of the share of a word never seen."""

    def __init__(self, words: int, different: float, frequent: dict[int, int]):
        self.shards = max(1, -(-words // SHARD_WORDS))
        parts = {w: -(-4 * n * self.shards // words) for w, n in frequent.items()}
        hot = sorted((w % 2**64, p) for w, p in parts.items() if p > 1)
        self.hot = np.array([w for w, _ in hot], np.uint64)
        self.parts = np.array([p for _, p in hot], np.uint64)
        self.base = 1.0 / max(2.0, different)

    def shard(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = b
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, b), len(self.hot) - 1)
            parts = np.where(self.hot[at] == b, self.parts[at], np.uint64(1))
            key = b + mix64(a + _C) % parts * _B
        at = mix64(key + _A) % np.uint64(self.shards)
        return at.astype(np.int16 if self.shards < 1 << 15 else np.int32)


def plan_of(texts: DataFrame, scratch: Scratch) -> Plan | None:
    found = texts.mapInArrow(tidy(_surveyed), "kind int, word long, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))
    found = scratch.table(found, "survey")
    words = found.where("kind = 0").agg(F.sum("n")).first()[0] or 0
    if not words:
        return None
    # what is below a quarter of a shard is dealt to one shard anyway
    least = max(1, words // (4 * max(1, -(-words // SHARD_WORDS))))
    frequent = {r["word"]: r["n"] for r in found.where("kind = 1").where(F.col("n") > least).collect()}
    low = [r["word"] for r in found.where("kind = 2").select("word").orderBy("word").limit(SKETCH).collect()]
    return Plan(words, len(low) if len(low) < SKETCH else (SKETCH - 1) / (low[-1] / 2**63), frequent)


def positions(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, a, b, c of each position of a column of texts."""
    rows, words, starts = [], [], []
    for first, found, offsets in word_hashes(column):
        rows.append(np.repeat(np.arange(first, first + len(offsets) - 1), np.diff(offsets)))
        words.append(found)
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    c = np.concatenate(words) if words else np.empty(0, np.uint64)
    b, a = np.full(len(c), _MARK), np.full(len(c), _MARK)
    same = row[1:] == row[:-1]
    b[1:][same] = c[:-1][same]
    same = row[2:] == row[:-2]
    a[2:][same] = c[:-2][same]
    return row, a, b, c


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PIECE_BYTES of text."""
    _, at = string_buffers(batch.column(column))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def _packing(plan: Plan, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, h, trusted, text) -> (shard, kind, batch, grams) of the shards of a pass.

        Grams are row, ab, bc and for trusted texts (kind 0) their count in the text and b; negative shards hold the rows.
        """
        part = TaskContext.get().partitionId()
        for k, batch in enumerate(x for whole in batches for x in _pieces(whole, 3)):
            row, a, b, c = positions(batch.column(3))
            n = np.bincount(row, minlength=batch.num_rows) * (turn == 0)
            trusted = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            shard = plan.shard(a, b)
            at = np.flatnonzero(shard % PASSES == turn)
            row, a, b, c, shard = row[at], a[at], b[at], c[at], shard[at]
            ab, bc = mix64(a * _A + b), mix64(b * _B + c)
            number, ids, h = part << 32 | k, batch.column(0), batch.column(1)
            shards, kinds = [-1 - (31 * part + k) % plan.shards], [0]
            blobs = [
                np.array([batch.num_rows], np.int64).tobytes()
                + ids.fill_null(0).to_numpy().tobytes()
                + h.fill_null(0).to_numpy().tobytes()
                + n.astype(np.int64).tobytes()
                + np.stack([ids.is_valid().to_numpy(zero_copy_only=False), h.is_valid().to_numpy(zero_copy_only=False), trusted]).astype(np.uint8).tobytes()
            ]
            own = trusted[row]
            for kind in (0, 1):
                at, counts = np.flatnonzero(~own) if kind else np.flatnonzero(own), None
                if not kind and len(at):
                    _, first, counts = np.unique(mix64((ab[at] ^ bc[at] * _C) + row[at].astype(np.uint64) * _A), return_index=True, return_counts=True)
                    order = np.argsort(first)
                    at, counts = at[first[order]], counts[order]
                order = np.argsort(shard[at], kind="stable")
                at = at[order]
                cuts = np.flatnonzero(np.diff(shard[at])) + 1
                for lo, hi in zip([0, *cuts], [*cuts, len(at)]):
                    if lo == hi:
                        continue
                    i = at[lo:hi]
                    fields = [row[i], ab[i], bc[i]] + ([] if kind else [counts[order[lo:hi]], mix64(b[i])])
                    blobs.append(b"".join(f.astype(np.uint32).tobytes() for f in fields))
                    shards.append(int(shard[i[0]]))
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(kinds, pa.int32()), pa.array([number] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "kind", "batch", "grams"])

    return run


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(max(one / (one + 2 * two), 0.1), 0.9) if one else 0.5


class Table:
    """Kneser-Ney counts of a shard from the trusted grams (ab, bc, n, b)."""

    def __init__(self, ab: np.ndarray, bc: np.ndarray, n: np.ndarray, b: np.ndarray, base: float):
        self.base = base
        keys = ab.astype(np.uint64) << np.uint64(32) | bc
        order = np.argsort(keys, kind="stable")
        keys, n, b = keys[order], n[order].astype(np.int64), b[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.tri, self.count, b = keys[first], np.add.reduceat(n, first) if len(first) else n, b[first]
        own_ab, own_bc = (self.tri >> np.uint64(32)).astype(np.uint32), self.tri.astype(np.uint32)
        self.ab, start, self.types = np.unique(own_ab, return_index=True, return_counts=True)
        self.total = np.add.reduceat(self.count, start) if len(start) else self.count
        self.bc, at, self.before = np.unique(own_bc, return_index=True, return_counts=True)
        words, inverse = np.unique(b, return_inverse=True)
        self.of_ab, self.of_bc = inverse[start], inverse[at]
        self.word_total = np.bincount(inverse, minlength=len(words))
        self.word_types = np.bincount(self.of_bc, minlength=len(words))
        self.d3, self.d2 = _discount(self.count), _discount(self.before)

    def logs(self, ab: np.ndarray, bc: np.ndarray, own: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Log probabilities of positions; ``own`` (row, n) are the counts of trusted texts, taken off."""
        if not len(self.tri):
            return np.full(len(ab), np.log(self.base))
        i, in_ab = _find(self.ab, ab)
        j, in_bc = _find(self.bc, bc)
        k, in_tri = _find(self.tri, ab.astype(np.uint64) << np.uint64(32) | bc)
        word = np.where(in_ab, self.of_ab[i], self.of_bc[j])
        know = in_ab | in_bc
        count, total, types = np.where(in_tri, self.count[k], 0), np.where(in_ab, self.total[i], 0), np.where(in_ab, self.types[i], 0)
        before, word_total, word_types = np.where(in_bc, self.before[j], 0), np.where(know, self.word_total[word], 0), np.where(know, self.word_types[word], 0)
        if own is not None:
            row, n = own[0].astype(np.uint64) << np.uint64(32), own[1].astype(np.int64)
            gone = count == n  # trigrams that no other text has

            def summed(key: np.ndarray, values: np.ndarray) -> np.ndarray:
                _, group = np.unique(row | key.astype(np.uint64), return_inverse=True)
                return np.bincount(group, values)[group].astype(np.int64)

            total, types, before = total - summed(ab, n), types - summed(ab, gone), before - summed(bc, gone)
            # pairs that no other text has leave their word's types, once each
            _, first = np.unique(row | bc.astype(np.uint64), return_index=True)
            lost = np.zeros(len(n), bool)
            lost[first] = before[first] <= 0
            word_total, word_types = word_total - summed(word, gone), word_types - summed(word, lost)
            count = count - n
        low = np.where(word_total > 0, (np.maximum(before - self.d2, 0) + self.d2 * word_types * self.base) / np.maximum(word_total, 1), self.base)
        p = np.where(total > 0, (np.maximum(count - self.d3, 0) + self.d3 * types * low) / np.maximum(total, 1), low)
        return np.log(np.maximum(p, self.base * 1e-3))


def _scoring(base: float):
    def summed(batch: int, fields: np.ndarray, table: Table, trusted: bool) -> tuple[int, bool, bytes]:
        row, ab, bc = fields[:3]
        logs = table.logs(ab, bc, (row, fields[3])) * fields[3] if trusted else table.logs(ab, bc)
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        return batch, False, row[first].tobytes() + np.add.reduceat(logs, first).astype(np.float32).tobytes()

    def out(found: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.bool_(), pa.binary()))], names=["batch", "head", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, kind, batch, grams) in order, those of trusted texts first in a shard: partial sums."""
        shard, table, held = None, None, []

        def built() -> Table:
            parts = [np.concatenate([f[k] for _, f in held]) if held else np.empty(0, np.uint32) for k in (1, 2, 3, 4)]
            return Table(*parts, base)

        def close() -> Iterator[pa.RecordBatch]:
            for number, fields in held:
                yield out([summed(number, fields, table, True)])

        for batch in batches:
            found = []
            for s, kind, number, grams in zip(*(batch.column(i) for i in range(4))):
                s, kind, number, grams = s.as_py(), kind.as_py(), number.as_py(), grams.as_py()
                if s < 0:
                    found.append((number, True, grams))
                    continue
                if s != shard:
                    if held and table is None:
                        table = built()
                    yield from close()
                    shard, table, held = s, None, []
                fields = np.frombuffer(grams, np.uint32).reshape(3 if kind else 5, -1)
                if kind == 0:
                    held.append((number, fields))
                    continue
                if table is None:
                    table = built()
                found.append(summed(number, fields, table, False))
            yield out(found)
        if held and table is None:
            table = built()
        yield from close()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (batch, head, sums) in order, the batch's rows first: (doc_id, h, trusted, words, word_logp)."""
    head, total = None, None

    def close() -> pa.RecordBatch:
        size = int(np.frombuffer(head, np.int64, 1)[0])
        ids, h, n = np.frombuffer(head, np.int64, 3 * size, 8).reshape(3, size)
        known, sound, trusted = np.frombuffer(head, np.uint8, 3 * size, 8 + 24 * size).reshape(3, size).astype(bool)
        return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(h, mask=~sound), pa.array(trusted), pa.array(n), pa.array(total)], names=["doc_id", "h", "trusted", "words", "word_logp"])

    for batch in batches:
        for first, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if first:
                if head is not None:
                    yield close()
                head, total = blob, np.zeros(int(np.frombuffer(blob, np.int64, 1)[0]))
                continue
            half = len(blob) // 8
            total[np.frombuffer(blob, np.uint32, half)] += np.frombuffer(blob, np.float32, half, 4 * half)
    if head is not None:
        yield close()


def word_perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, h, word_perplexity of the rows of ``docs`` (doc_id, h, text); ``trusted`` has doc_id.

    Rows without words are not held; without a trusted word all perplexities are 1.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    plan = plan_of(docs.join(ids, "doc_id", "left_semi").select("text"), scratch)
    if plan is None:
        return docs.select("doc_id", "h", F.lit(1.0).alias("word_perplexity")).distinct()
    marked = docs.join(ids, "doc_id", "left").select("doc_id", "h", F.coalesce("trusted", F.lit(False)).alias("trusted"), "text")
    tasks, done = max(2, 2 * plan.shards), None
    for turn in range(min(PASSES, plan.shards)):
        grams = marked.mapInArrow(tidy(_packing(plan, turn)), "shard int, kind int, batch long, grams binary")
        parts = grams.repartition(tasks, "shard").sortWithinPartitions("shard", "kind", "batch").mapInArrow(tidy(_scoring(plan.base)), "batch long, head boolean, sums binary")
        whole = parts.repartition(tasks, "batch").sortWithinPartitions("batch", F.desc("head")).mapInArrow(tidy(_gathered), "doc_id long, h long, trusted boolean, words long, word_logp double")
        one = scratch.table(whole, f"word-sums-{turn}")
        done = one if done is None else done.unionByName(one)
    sums = done.groupBy("doc_id", "h").agg(F.max("trusted").alias("trusted"), F.sum("words").alias("words"), F.sum("word_logp").alias("word_logp")).where("words > 0")
    sums = scratch.table(sums, "word-sums")
    mean = sums.where("trusted").agg(F.sum("word_logp") / F.sum("words")).first()[0]
    return sums.select("doc_id", "h", F.exp(-(F.col("word_logp") + PRIOR * mean) / (F.col("words") + PRIOR)).alias("word_perplexity"))
