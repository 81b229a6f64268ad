"""Jaccard join, components, embeddings, packing and the pipeline against brute force."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import embed_dedup, jaccard, packing
from quarry.llm.common import Scratch
from quarry.llm.components import connected_components
from quarry.llm.shingles import shingle_sets

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def find_all(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_shingle_sets():
    rng = random.Random(0)
    texts = [None, "", " \t\n", "One", "a b c d", "A b C d e", "a b c d e f", "é ü É a b\x0bc", "x " * 1000, "x y z a b c"]
    texts += [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(40))) for _ in range(200)]
    texts.append("word " * 900_000 + "end of it all here")
    got = {i: s for i, s in shingle_sets(pa.array(texts))}
    for i, t in enumerate(texts):
        assert len(got[i]) == len(shingles(t)), i
    by = {}
    for i, t in enumerate(texts[:-1]):
        by.setdefault(frozenset(shingles(t)), set()).add(got[i].tobytes())
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def near_copies(rng, n=260):
    words = [f"w{k}" for k in range(400)]
    common = [rng.choice(words) for _ in range(60)]
    docs = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([4, 7, 30, 120, 300]))]
        for _ in range(rng.choice([1, 2, 9, 70])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    for _ in range(60):  # share a passage, alike in nothing else
        docs.append(" ".join([rng.choice(words) for _ in range(40)] + common + [rng.choice(words) for _ in range(rng.choice([3, 15, 90]))]))
    rng.shuffle(docs)
    return docs + [None, "", "  ", "x", "X", "One two", docs[0], docs[0].upper()]


@pytest.mark.parametrize(("seed", "tile", "first"), [(1, 4096, 8), (2, 5, 1)])
def test_jaccard_join(spark, seed, tile, first, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_TEXTS", 20)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "FIRST", first)  # so few centres that most links are found in the tiles
    texts = near_copies(random.Random(seed))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as n", "2 as node", "3 as key", "4 as other").repartition(3)
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = find_all(range(len(texts)), links)
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(df, Scratch(spark, "t")).collect()}
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(got[k]["n_shingles"] == len(sets[k]) for k in got)
    kept = jaccard.keep_one(df, Scratch(spark, "t"))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_jaccard_odd_rows(spark):
    long = " ".join(f"v{k % 5000}-{k // 7}" for k in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, long), (3, long + " x"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 2, 4: 4, None: None}
    kept = sorted(str(r["doc_id"]) for r in jaccard.keep_one(df, Scratch(spark, "t")).collect())
    assert kept == ["1", "2", "4", "None"]
    assert jaccard.jaccard_components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_key_and_bitmap_bounds():
    rng = np.random.default_rng(1)
    for n in (1, 3, 10, 60, 400):
        for _ in range(60):
            base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            keep = rng.random(len(base)) < rng.choice([0.8, 0.9, 1])
            a, b = base, np.unique(np.concatenate([base[keep], rng.integers(0, 2**63, int(n * 0.1), dtype=np.uint64)]))
            hot = np.sort(base[rng.random(len(base)) < rng.choice([0, 0.5, 0.95])])
            if len(b) and jaccard.links(a, b):
                assert jaccard.may_link(len(a), len(b), jaccard.bitmap_of(a), jaccard.bitmap_of(b))
                x, y = jaccard.keys_of(a, hot), jaccard.keys_of(b, hot)
                assert set(x[0].tolist()) & set(y[0].tolist()) and (np.diff(x[0].view(np.int64).astype(object) % 2**64) > 0).all()
                assert set(x[1].tolist()) <= set(x[0].tolist()) and len(x[0]) == jaccard.prefix_length(len(a))


@pytest.mark.parametrize("last", [0, 20, 1 << 20])
def test_components(spark, last):
    rng = random.Random(8)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    df = spark.createDataFrame([*edges, edges[0]], "a long, b long")
    want = find_all({n for e in edges for n in e}, edges)
    got = {r["node"]: r["comp"] for r in connected_components(df, Scratch(spark, "t"), last_edges=last).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(df.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("block", [512, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    vectors = []
    for g in range(30):
        base = rng.standard_normal(32)
        for _ in range([1, 2, 3, 40][g % 4]):
            vectors.append((base + rng.standard_normal(32) * rng.choice([0.01, 0.1])).astype(np.float32).tolist())
    rows = [(k, v, k % 2 if k > 400 else 0) for k, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, vectors[0], 0), (n + 1, vectors[0], None), (n + 2, None, 0), (n + 3, [0.0] * 32, 0), (n + 4, [float("nan")] * 32, 0), (n + 5, [None] * 32, 0), (n + 6, [float("inf")] + [1.0] * 31, 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0), (n + 9, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as node", "2 as v", "3 as n")
    fit = {}
    for k, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            fit[k] = (label, u / np.linalg.norm(u))
    links = [(a, b) for a, b in combinations(fit, 2) if fit[a][0] == fit[b][0] and len(fit[a][1]) == len(fit[b][1]) and fit[a][1] @ fit[b][1] >= 0.98]
    degree = dict.fromkeys(range(len(rows)), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, Scratch(spark, "t")).collect()}
    assert len(got) == len(rows)
    assert all(got[k]["n_links"] <= degree[k] for k in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * 2 * len(links)
    want = find_all(range(len(rows)), links)
    assert np.mean([got[k]["component_id"] == want[k] for k in got]) > 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert got[n + 8]["component_id"] == n + 7 and got[n + 2]["n_links"] == 0
    assert embed_dedup.near_vectors(df.limit(0), Scratch(spark, "t")).count() == 0


def test_embeddings_isolated_pairs_off_centre(spark):
    rng = np.random.default_rng(4)
    n, dim, pairs = 20_000, 64, 300
    x = rng.standard_normal(dim) * [1] / np.sqrt(dim) + rng.standard_normal((n, dim)) * 0.42 / np.sqrt(dim)
    for k in range(pairs):
        u = x[k] / np.linalg.norm(x[k])
        g = rng.standard_normal(dim)
        g -= g @ u * u
        x[n - 1 - k] = 0.982 * u + np.sqrt(1 - 0.982**2) * g / np.linalg.norm(g)
    df = spark.createDataFrame([(k, v, 0) for k, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_vectors(df, Scratch(spark, "t")).collect()}
    assert len(got) == n and np.mean([got[k] == got[n - 1 - k] for k in range(pairs)]) >= 0.99
    assert embed_dedup.passes_of(400_000, 0.85) > embed_dedup.passes_of(20_000, 0.85) > embed_dedup.passes_of(20_000, 0.0) == embed_dedup.PASSES


def test_piece_crc():
    rng = random.Random(1)
    data = rng.randbytes(70_000)
    cuts = [(rng.randrange(0, 500) * 128, rng.randrange(1, 5000)) for _ in range(50)]
    before = np.array([zlib.crc32(data[:a]) for a, _ in cuts], np.uint32)
    until = np.array([zlib.crc32(data[: a + n]) for a, n in cuts], np.uint32)
    assert packing.piece_crc(before, until, np.array([n for _, n in cuts])).tolist() == [zlib.crc32(data[a : a + n]) for a, n in cuts]


def test_packing_reaches_the_whole_shard(spark):
    rng = random.Random(9)
    words = "stone house river green walk light water small open night road paper glass music winter field".split()
    topics = [f"{a}{b}" for a in ("zor", "blix", "quam", "trel") for b in ("fa", "fil", "fum", "dax", "nop")]
    n, per = 3600, 30
    texts = [" ".join(rng.choice(words) for _ in range(30)) + f" {topics[k % len(topics)]}" * 30 for k in range(n)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    corpus = packing.corpus_of(df.select("doc_id", "text").mapInArrow(packing._tokenised(packing.default_tokenizer()), "doc_id long, key binary, tokens long, crcs binary, terms binary"))
    assert corpus.n == n and n // 2 < corpus.df.max() <= n and corpus.length > per
    got = packing.pack(df).toPandas()
    got["topic"] = got.doc_id % len(topics)
    kinds = got.groupby("sequence_id").topic.nunique()
    # documents of a topic fill windows together; blocks would each leave a rest of every topic
    assert (kinds > 1).sum() <= len(topics) + 2


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(6)
    odd = ["", None, " ", "It's 12'll <|endoftext|> <|ENDOFTEXT|> ÉCOLE é  x　y 漢字 🙂!?", "word " * 300_000, "A" * 30_000, "tab\tnew\nline\x0bx"]
    texts = odd + [" ".join(rng.choice("alpha beta Gamma delta's 42 naïve Straße ... (x)".split()) for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[7]), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as tokens")
    got = packing.pack(df).toPandas()
    ids = {k: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4") for k, t in enumerate(texts)}
    for r in got[got.doc_id.notna()].itertuples():
        a = ids[int(r.doc_id)]
        assert r.doc_tokens == len(a) and zlib.crc32(a[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    cover = got[got.doc_id.notna()].groupby("doc_id").length.sum()
    assert all(cover[k] == len(a) * (2 if k == 7 else 1) for k, a in ids.items())
    at = got.sort_values(["sequence_id", "offset"])
    assert ((at.groupby("sequence_id").length.cumsum() - at.length) == at.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= packing.WINDOW and (sizes <= packing.WINDOW - packing.GRAIN).sum() <= 1
    assert packing.pack(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch, now = Scratch(spark, "t"), docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        later = scratch.table(stage(spark, now, SF), str(k))
        assert later.columns == docs.columns and 0 < later.count() <= now.count()
        now = later
    texts = {r["doc_id"]: r["text"] for r in now.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    known = [labels[k] for k in texts if k in labels]
    assert sum(r["quality"] for r in known) >= 0.97 * len(known)
    sets = {k: shingles(t) for k, t in texts.items()}
    assert not [1 for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [1 for s in sets.values() for i in items if len(s & i) >= 0.75 * len(i)]
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts)
