"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

Texts become symbols of a fixed alphabet of 64 (letters, common accents, classes for
capitals, digits and the rest, frequent punctuation, and one symbol for a word that
repeats the word before it, with the gap between them).  Trigram counts are gathered from every trusted text of
the corpus; the model is the table of the 64**3 interpolated probabilities, cut into
shards by the middle symbol.  Scoring is a sharded join: the distinct trigrams of each
document are cut the same way, packed, dealt to (shard, salt) and streamed past the
shard's part of the table; partial sums are added per document.  Symbols see spelling
only; words and their order are scored by a trigram model of words, whose table grows
with the trusted texts (``wordmodel``).  A document is rejected if either perplexity is
over a quantile of the trusted ones of its language, widened by a factor.

Defined cases: null, empty and white-space texts are rejected, with a null perplexity;
a language without trusted texts (null is one too) takes the quantile over all; without any trusted text
everything with words is kept; repeated rows are judged each, and those of one id and text share a verdict; texts are
scored whole, in pieces of bounded size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, prepare, tidy, without
from .shingles import mix64, run_hashes
from .wordmodel import word_perplexities

#: Quantile of the trusted perplexities of a language, and the factor over it.
QUANTILE, FACTOR = 0.98, 1.25
#: Factor over the quantile of the word model's perplexities, which spread more than those of symbols.
WORD_FACTOR = 2.0
#: Symbols of mean trusted text added to every document, so that a few words prove little.
PRIOR = 48
SHARDS = 4
#: Trusted ids up to this number are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
PIECE_CHARS = 1 << 20

# The alphabet; 0 is the text boundary, 1 everything else.
BOUNDARY, OTHER = 0, 1
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêàçñóíáúâîôûëï"
MARKS = " \n.,;:!?|*#$%-'\""
CAPITAL, DIGIT, REPEAT = 61, 62, 63
SIZE = 64

_SYMBOL = np.full(0x3000, OTHER, np.uint8)
for _c in range(0x3000):
    if chr(_c).isupper():
        _SYMBOL[_c] = CAPITAL
    elif chr(_c).isdigit():
        _SYMBOL[_c] = DIGIT
    elif chr(_c).isspace():
        _SYMBOL[_c] = 2 + len(LETTERS)
for _i, _ch in enumerate((LETTERS + MARKS)[: CAPITAL - 2]):
    _SYMBOL[ord(_ch)] = 2 + _i
_SYMBOL[0] = BOUNDARY
_SPACES = np.array([BOUNDARY, 2 + len(LETTERS), 3 + len(LETTERS)], np.uint8)


def symbols(text: str) -> np.ndarray:
    """Symbols of a text in which NUL marks boundaries; repeated words are one symbol."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = _SYMBOL[np.minimum(points, 0x2FFF)]
    gap = np.isin(found, _SPACES)
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) < 2:
        return found
    n = len(points)
    words = run_hashes(lambda a, b: mix64(points[a:b].astype(np.uint64) + np.uint64(7)), starts, ends)
    bounds = np.concatenate([[0], np.cumsum(found == BOUNDARY)])
    again = np.flatnonzero((words[1:] == words[:-1]) & (bounds[starts[1:]] == bounds[starts[:-1]])) + 1
    if not len(again):
        return found
    found = found.copy()
    drop = np.zeros(n + 1, np.int32)
    np.add.at(drop, ends[again - 1] + 1, 1)
    np.add.at(drop, ends[again], -1)
    found[ends[again - 1]] = REPEAT
    return found[np.cumsum(drop[:-1]) == 0]


def _trigrams(found: np.ndarray) -> np.ndarray:
    """Codes (middle, first, last) of the trigrams whose last symbol is no boundary."""
    s = found.astype(np.int32)
    codes = (s[1:-1] << 12) | (s[:-2] << 6) | s[2:]
    return codes[s[2:] != BOUNDARY]


def text_trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct trigram codes and counts of each text, sorted."""
    k = 0
    while k < len(texts):
        held, size = [], 0
        while k + len(held) < len(texts) and (not held or size + len(texts[k + len(held)] or "") <= PIECE_CHARS):
            held.append((texts[k + len(held)] or "").replace("\0", " "))
            size += len(held[-1])
        k += len(held)
        if len(held) == 1 and size > PIECE_CHARS:
            parts = [np.bincount(_trigrams(symbols("\0\0" * (at == 0) + held[0][max(0, at - 2) : at + PIECE_CHARS])), minlength=SIZE**3) for at in range(0, size, PIECE_CHARS)]
            total = np.sum(parts, axis=0)
            codes = np.flatnonzero(total)
            yield codes.astype(np.int32), total[codes]
            continue
        found = symbols("\0\0" + "\0\0".join(held) + "\0\0")
        s = found.astype(np.int32)
        codes = (s[1:-1] << 12) | (s[:-2] << 6) | s[2:]
        real = s[2:] != BOUNDARY
        # boundaries come in pairs; a text without symbols leaves two pairs side by side
        marks = np.flatnonzero((s[:-1] == BOUNDARY) & (s[1:] == BOUNDARY))
        if len(marks) != len(held) + 1:  # an empty text: fall back to one by one
            for x in held:
                yield np.unique(_trigrams(symbols("\0\0" + x)), return_counts=True) if x else (np.empty(0, np.int32), np.empty(0, np.int64))
            continue
        for a, b in zip(marks[:-1], marks[1:]):
            part = codes[a:b][real[a:b]]
            yield np.unique(part, return_counts=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SIZE**3, np.int64)
    for batch in batches:
        for codes, counts in text_trigrams(batch.column(0).to_pylist()):
            total[codes] += counts
    codes = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(total[codes])], names=["code", "n"])


def _discounted(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """One order of interpolated modified Kneser-Ney; contexts are rows, ``lower`` their lower-order probabilities."""
    n = [float((counts == k).sum()) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    d = [0.0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]
    take = np.take(np.array(d), np.minimum(counts, 3))
    total = counts.sum(axis=1, keepdims=True)
    seen = total > 0
    total = np.maximum(total, 1)
    return np.where(seen, (counts - take) / total + take.sum(axis=1, keepdims=True) / total * lower, lower)


def kneser_ney(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Log probabilities, indexed [middle, first, last], from trigram counts."""
    c3 = np.zeros(SIZE**3, np.int64)
    c3[codes] = counts
    c3 = c3.reshape(SIZE, SIZE, SIZE)
    c2 = (c3 > 0).sum(axis=1)  # continuation counts [middle, last]
    c1 = (c2 > 0).sum(axis=0)[None, :]
    p1 = _discounted(c1, np.full((1, SIZE), 1.0 / (SIZE - 1)))
    p2 = _discounted(c2, p1)
    p3 = _discounted(c3.reshape(SIZE * SIZE, SIZE), np.repeat(p2, SIZE, axis=0))
    return np.log(np.maximum(p3, 1e-12)).reshape(SIZE, SIZE, SIZE).astype(np.float32)


_STEP = SIZE**3 // SHARDS


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, h, text) -> (doc_id, h, shard, grams) with the grams of a shard packed."""
    for batch in batches:
        rows, shards, blobs = [], [], []
        for i, (codes, counts) in enumerate(text_trigrams(batch.column(2).to_pylist())):
            cuts = np.searchsorted(codes, np.arange(SHARDS + 1) * _STEP)
            for k in range(SHARDS):
                a, b = cuts[k], cuts[k + 1]
                if a < b:
                    gaps = np.diff(codes[a:b] - k * _STEP, prepend=0).astype(np.uint16)
                    small = np.minimum(counts[a:b], 255).astype(np.uint8)
                    more = np.flatnonzero(counts[a:b] >= 255)
                    blobs.append(np.array([b - a, len(more)], np.int32).tobytes() + gaps.tobytes() + small.tobytes() + more.astype(np.int32).tobytes() + counts[a:b][more].astype(np.int64).tobytes())
                    rows.append(i)
                    shards.append(k)
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], names=["doc_id", "h", "shard", "grams"])


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.frombuffer(blob, np.int32, 2)
    codes = np.cumsum(np.frombuffer(blob, np.uint16, n, 8).astype(np.int64))
    counts = np.frombuffer(blob, np.uint8, n, 8 + 2 * n).astype(np.int64)
    if m:
        at = 8 + 3 * int(n)
        counts[np.frombuffer(blob[at : at + 4 * m], np.int32)] = np.frombuffer(blob[at + 4 * m :], np.int64)
    return codes, counts


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a (shard, salt) in order, the shard's table first: partial sums."""
    table = None
    for batch in batches:
        kinds = batch.column(0).to_pylist()
        blobs = batch.column(3)
        rows, sums, sizes = [], [], []
        for i, kind in enumerate(kinds):
            if kind == 0:
                table = np.frombuffer(blobs[i].as_py(), np.float32)
                continue
            codes, counts = _unpacked(blobs[i].as_py())
            rows.append(i)
            sums.append(float((table[codes] * counts).sum(dtype=np.float64)))
            sizes.append(int(counts.sum()))
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(1).take(at), batch.column(2).take(at), pa.array(sums, pa.float64()), pa.array(sizes, pa.int64())], names=["doc_id", "h", "logp", "n"])


def perplexities(docs: DataFrame, trusted: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, h, perplexity of the rows of ``docs`` (doc_id, h, text); ``trusted`` has doc_id."""
    spark = docs.sparkSession
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    counted = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select("text").mapInArrow(tidy(_counted), "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = counted.toArrow()  # 64**3 rows at most
    if not counts.num_rows:
        return docs.select("doc_id", "h", F.when(F.length(F.trim("text")) > 0, F.lit(1.0)).alias("perplexity"))
    codes, n = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    table = kneser_ney(codes, n)
    mean = float((table.reshape(-1)[codes] * n).sum() / n.sum())
    table = table.reshape(SHARDS, _STEP)
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    model = spark.createDataFrame([(k, bytearray(table[k].tobytes())) for k in range(SHARDS)], "shard int, grams binary").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h"), "grams"
    )
    grams = docs.select("doc_id", "h", "text").mapInArrow(tidy(_packed), "doc_id long, h long, shard int, grams binary")
    dealt = grams.select("shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "doc_id", "h", "grams").unionByName(model)
    parts = dealt.repartition(SHARDS * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "kind").select("kind", "doc_id", "h", "grams")
    sums = parts.mapInArrow(tidy(_scored), "doc_id long, h long, logp double, n long").groupBy("doc_id", "h").agg(F.sum("logp").alias("logp"), F.sum("n").alias("n"))
    return sums.select("doc_id", "h", F.exp(-(F.col("logp") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("perplexity"))


def _keyed(scores: DataFrame) -> DataFrame:
    return scores.withColumnsRenamed({"doc_id": "sid", "h": "sh"})


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, quantile: float = QUANTILE, factor: float = FACTOR) -> DataFrame:
    """doc_id, h, lang, perplexity, threshold, word_perplexity, word_threshold, keep of each row of ``docs``.

    ``labels`` has doc_id and quality; 1 marks trusted text.
    """
    prepare(docs.sparkSession)
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    # Shuffle files go with the table they were made for, so that those of the two models do not add up.
    docs.sparkSession.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    scores = scratch.table(perplexities(rows, trusted, scratch), "scores")
    words = scratch.table(word_perplexities(rows, trusted, scratch), "words")
    docs.sparkSession.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    # Languages come without texts, so that no text moves.
    langs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "lang", (F.length(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))) > 0).alias("full"))
    scores = scratch.table(scores.join(_keyed(words), F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left").drop("sid", "sh"), "both")
    scored = scratch.table(langs.join(_keyed(scores), F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left").drop("sid", "sh"), "scored")
    known = scored.where("full").join(trusted, "doc_id", "left_semi")
    quantiles = [F.percentile_approx(x, quantile, 20_000) for x in ("perplexity", "word_perplexity")]
    by_lang = known.groupBy("lang").agg(quantiles[0].alias("q"), quantiles[1].alias("wq")).select(F.col("lang").alias("l"), "q", "wq")
    overall = known.agg(*quantiles).first()
    limit = lambda q, k, x: F.coalesce(q, F.lit(overall[k]).cast("double"), F.lit(float("inf"))) * x
    within = lambda x, top: F.coalesce(x, F.lit(0.0)) <= F.col(top)
    return (
        scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
        .withColumn("threshold", limit("q", 0, factor))
        .withColumn("word_threshold", limit("wq", 1, WORD_FACTOR))
        .select(
            "doc_id", "h", "lang", F.when(F.col("full"), F.col("perplexity")).alias("perplexity"), "threshold",
            F.when(F.col("full"), F.col("word_perplexity")).alias("word_perplexity"), "word_threshold",
            (F.col("full") & within("perplexity", "threshold") & within("word_perplexity", "word_threshold")).alias("keep"),
        )
    )


def keep_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    own, text = free_name("bad_id", docs), free_name("bad_text", docs)
    bad = scratch.table(judge(docs, labels, scratch).where("not keep").select("doc_id", "h").distinct(), "bad").withColumnsRenamed({"doc_id": own, "h": text})
    return without(docs, bad, F.col("doc_id").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(text)))
