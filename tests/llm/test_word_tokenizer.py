"""Ids made of parts of words against the tokenizer itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import packing

PIECES = (
    ["a", "b", "THE", "ing", "é", "É", "ß", "İ", "ǆ", "́", "̸", "'", "'s", "'re", "'ll", "'T", "’s", ".", ",", "!?", "&&", "###", "0", "12", "٣", "²", "½"]
    + ["<", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "…", "—"]
    + ["日本", "ไทย", "👍", "\x00", "\x7f", "×", "÷", "ö.", "K", "Å", "ﬁ", "ſ", "_", "-", "�", "ı", "Σ", "ΑΣ", "x" * 40]
)


@pytest.mark.parametrize("remembered", [1 << 20, 2000])
def test_ids_equal_the_tokenizers(remembered, monkeypatch):
    from tokenizers import Tokenizer

    if remembered == 2000:  # forgets, and cuts texts, all the time
        monkeypatch.setattr(packing, "PIECE_BYTES", 1000)
    rng = random.Random(5)
    texts = []
    for _ in range(6000):
        pool = PIECES if rng.random() < 0.3 else [p for p in PIECES if "|" not in p]
        texts.append("".join(rng.choice(pool) for _ in range(rng.randint(0, 14))))
    tokenizer, own = Tokenizer.from_file(packing.default_tokenizer()), packing.WordTokenizer(packing.default_tokenizer(), remembered)
    assert own.by_parts
    for k in range(0, len(texts), 50):
        some = texts[k : k + 50]
        got = [ids[a:b].tolist() for _, ids, bounds in own.column(pa.array(some)) for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    own.by_parts = False  # as for any other tokenizer
    got = [ids[a:b].tolist() for _, ids, bounds in own.column(pa.array([*texts[:50], None])) for a, b in zip(bounds[:-1], bounds[1:])]
    assert got == [*(e.ids for e in tokenizer.encode_batch(texts[:50], add_special_tokens=False)), []]


def test_neighbours_are_all_found():
    rng = np.random.default_rng(3)
    docs = []
    for k in range(200):
        term = np.unique(rng.integers(0, 70_000, 60) * (rng.random(60) < 0.9)).astype(np.uint32)
        docs.append((k, 100, b"", term.tobytes() + np.ones(len(term), np.uint16).tobytes()))
    df = np.zeros(70_000, np.int64)
    for d in docs:
        df[packing.terms_of(d[3])[0]] += 1
    index, pool = packing.ShardIndex.of(docs, packing.Corpus(200, 100.0, df)), np.ones(200, bool)
    pool[[0, 5]] = False
    sets = [set(packing.terms_of(d[3])[0].tolist()) for d in docs]
    found = list(index.neighbours(0, pool))
    seen = set()
    for j in found:
        seen.add(j)
    assert seen == {j for j in range(200) if pool[j] and sets[0] & sets[j]}
    small = index.kept(pool)
    assert small.alive == 198 and set(small.neighbours(0, pool)) == seen
