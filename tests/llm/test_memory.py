"""What workers hold while they run a map, and after it."""

import gc
import random
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

from quarry.llm import jaccard, packing, shingles
from quarry.llm.common import tidy


def peak_mb(run):
    tracemalloc.start()
    try:
        out = run()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def sent(run):
    """A map as an executor gets it."""
    return cloudpickle.loads(cloudpickle.dumps(run))


def test_tokenizers_go_when_a_worker_runs_other_maps():
    path = packing.default_tokenizer()
    rows = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words of a text"]})
    held = weakref.ref(packing.tokenizer_for(path))
    list(sent(tidy(packing._tokenised(path), packing.TOKENIZERS))(iter([rows])))
    assert held() is packing.tokenizer_for(path)  # kept for the next task of its own stage
    list(sent(tidy(jaccard._hot_counts))(iter([rows.select(["text"])])))
    gc.collect()
    assert held() is None


def test_words_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(3)
    text = " ".join("x" * rng.randint(1, 9) + str(rng.randint(0, 999)) for _ in range(250_000)).encode()
    data = np.frombuffer(text[: shingles.PIECE_BYTES], np.uint8)
    monkeypatch.setattr(shingles, "_powers", {})
    (hashes, starts, ends), peak = peak_mb(lambda: shingles.piece_words(data, np.empty(0, np.int64)))
    assert peak < 40  # 79 MB when a piece's prefix sums were held at once
    assert sum(t.nbytes for t in shingles._powers.values()) <= 2 * 8 * shingles.BLOCK_BYTES
    for k in (0, 1, 1000, len(starts) - 1):  # whatever stands before a word, and whatever the block
        assert shingles.piece_words(data[starts[k] : ends[k]], np.empty(0, np.int64))[0].tolist() == [hashes[k]]
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 16)
    monkeypatch.setattr(shingles, "_powers", {})
    small = data[:5000]
    again, first, _ = shingles.piece_words(np.append(small, np.frombuffer(b" " + b"long" * 100, np.uint8)), np.empty(0, np.int64))
    assert again[: len(first) - 2].tolist() == hashes[: len(first) - 2].tolist()


def test_bitmaps_of_a_tile_are_compared_in_blocks():
    rng, rows = np.random.default_rng(4), 700
    zeros = np.zeros(rows, np.int64)
    bits = [rng.bytes(jaccard.SMALL_MOST) for _ in range(rows)]
    bits[-1] = bits[0]
    firsts = pa.array([[7]] * rows, pa.list_(pa.int64()))
    columns = [zeros + 7, zeros, zeros, zeros + 3000, zeros, np.arange(rows), np.arange(rows)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(bits, pa.binary()), firsts], names=["key", "i", "j", "n", "tile", "node", "comp", "small", "firsts"])
    found, peak = peak_mb(lambda: [b for b in jaccard._crossing(iter([batch])) if b.num_rows])
    assert [b.to_pylist() for b in found] == [[{"a": 0, "b": rows - 1}]]
    assert peak < 40  # 138 MB when 65536 pairs were compared at once
