"""Toxicity, quality, decontamination."""

import random

import numpy as np
import pytest

from quarry.llm import decontam, quality, toxicity, wordmodel
from quarry.llm.common import Scratch
from quarry.llm.shingles import shingle_sets, word_hashes

WORDS = "the of and river stone house green walk light water small open night road paper glass music winter".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def test_grammar():
    m = toxicity.Matcher({"moron": 4.0, "vequ*": 4.0})
    plain, aimed, negated, quoted, threat = (m.features(x) for x in ("a moron there", "you moron", "not a moron", "they of course said something odd about one moron", "I will kill you"))
    assert plain[0] == 4.0 and aimed[1] == 6.0 and negated[2] == 2.0 and quoted[3] == 2.0
    assert m.features("the vequille and VEQU") == [8.0, 0, 0, 0, 0]
    assert m.features("oxymoron moronic") == [0.0] * 5
    assert threat == [0.0] * 4 + [0.25]  # paid for once, as someone is threatened
    assert m.features("you I will kill")[4] == 1.5 and m.features("you moron I will kill")[1] == 6.0
    assert m.features("kill the lights") == m.features("kill the lights. You know") == [0.0] * 5
    assert m.features(None) == m.features("") == m.features("?! ...") == [0.0] * 5
    assert m.features("x " * 200_000 + "moron")[0] == 4.0


def test_learned_toxicity(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        text = prose(rng, 30)
        if toxic:
            words = text.split()
            for bad in rng.sample(["zorfa", "zorfil", "zorfum", "blix"], 3):
                words.insert(rng.randrange(len(words)), bad)
            text = " ".join(words)
        rows.append((k, text))
        if k < 400:
            labels.append((k, int(toxic)))
    rows += [(700, None), (701, ""), (None, "you idiot moron"), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5 as score", "'x' as lang")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as text")
    got = toxicity.score_held_out(docs, marks.drop("text")).collect()
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    right = [r["predicted"] == (r["doc_id"] % 4 == 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean(right) > 0.98
    assert {r["doc_id"]: r["predicted"] for r in got}[701] == 0
    kept = toxicity.keep_clean(docs, marks.drop("text"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if not r["predicted"]}
    assert toxicity.score_held_out(docs.limit(0), marks.limit(0)).count() == 0
    none = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, marks.limit(0)).collect()}
    assert none[None] == 1 and none[1] == 0


def test_symbols():
    s = quality.symbols("\0\0The the cat cat cat\0\0")
    assert list(s).count(quality.REPEAT) == 2
    got = list(quality.text_trigrams(["abc", "", None, "abc abc"]))
    assert len(got) == 4 and got[0][1].sum() == 3 and got[1][1].sum() == 0
    long = "word " * 400_000
    (codes, counts), = quality.text_trigrams([long])
    assert counts.sum() > 300_000


class KneserNey:
    """Interpolated modified Kneser-Ney over dictionaries, straight from the definition."""

    def __init__(self, counts, symbols):
        self.base = 1 / symbols
        self.tri, self.bi, self.uni = {}, {}, {}
        for (a, b, c), n in counts.items():
            self.tri.setdefault((a, b), {})[c] = n
            self.bi.setdefault(b, {}).setdefault(c, set()).add(a)
        self.bi = {b: {c: len(s) for c, s in row.items()} for b, row in self.bi.items()}
        for row in self.bi.values():
            for c in row:
                self.uni[c] = self.uni.get(c, 0) + 1
        self.d = [self.discounts([n for row in rows for n in row.values()]) for rows in ([self.uni], self.bi.values(), self.tri.values())]

    @staticmethod
    def discounts(values):
        n = [values.count(k) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]

    def of(self, row, d, c, lower):
        if not row:
            return lower
        total = sum(row.values())
        n = row.get(c, 0)
        return (n - d[min(n, 3)]) / total + sum(d[min(v, 3)] for v in row.values()) / total * lower

    def p(self, a, b, c):
        one = self.of(self.uni, self.d[0], c, self.base)
        two = self.of(self.bi.get(b), self.d[1], c, one)
        return self.of(self.tri.get((a, b)), self.d[2], c, two)


def test_kneser_ney_against_its_definition():
    rng = np.random.default_rng(0)
    # boundaries are contexts but never follow
    tri = {(int(a), int(b), int(c)): int(n) for a, b, c, n in zip(rng.integers(0, 20, 4000), rng.integers(0, 20, 4000), 1 + rng.integers(0, 30, 4000), rng.zipf(1.7, 4000).clip(max=90))}
    codes, counts = zip(*sorted(((b << 12) | (a << 6) | c, n) for (a, b, c), n in tri.items()))
    p = np.exp(quality.kneser_ney(np.array(codes), np.array(counts)).astype(float))
    model = KneserNey(tri, quality.SIZE - 1)
    for a, b, c in rng.integers(0, quality.SIZE, (3000, 3)).tolist() + [list(k) for k in list(tri)[:1000]]:
        if c:
            assert p[b, a, c] == pytest.approx(model.p(a, b, c), rel=1e-5)
    assert np.allclose(p[:, :, 1:].sum(axis=2), 1, atol=1e-5)


def test_word_table_against_its_definition():
    rng = np.random.default_rng(1)
    tri = {(int(a), int(b), int(c)): int(n) for a, b, c, n in zip(rng.integers(0, 9, 900), rng.integers(0, 9, 900), rng.integers(0, 25, 900), rng.integers(1, 6, 900))}
    ab, bc, n, b = (np.array(x, np.uint32) for x in zip(*((a * 100 + b, b * 100 + c, k, b) for (a, b, c), k in tri.items())))
    base = 1 / 500
    table = wordmodel.Table(ab, bc, n, b, base)
    rows, pairs, before = {}, {}, {}
    for (x, y, z), k in tri.items():
        rows.setdefault((x, y), {})[z] = k
        before[y, z] = before.get((y, z), 0) + 1
        pairs.setdefault(y, set()).add(z)

    def p(x, y, z):
        total = sum(before[y, w] for w in pairs[y]) if y in pairs else 0
        low = (max(before.get((y, z), 0) - table.d2, 0) + table.d2 * len(pairs[y]) * base) / total if total else base
        row = rows.get((x, y))
        return low if not row else (max(row.get(z, 0) - table.d3, 0) + table.d3 * len(row) * low) / sum(row.values())

    asked = list(tri)[:300] + rng.integers(0, 30, (600, 3)).tolist()
    # a pair (a, b) never seen is told by (b, c) alone, so the word must be known from one of them
    asked = [(x, y, z) for x, y, z in asked if (x, y) in rows or (y, z) in before]
    got = table.logs(np.array([x * 100 + y for x, y, _ in asked], np.uint32), np.array([y * 100 + z for _, y, z in asked], np.uint32))
    assert np.allclose(got, [np.log(max(p(*k), base * 1e-3)) for k in asked], atol=1e-9)


def brute_perplexity(text, trusted):
    total = np.zeros(quality.SIZE**3, np.int64)
    for c, n in quality.text_trigrams(trusted):
        np.add.at(total, c, n)
    codes = np.flatnonzero(total)
    table = quality.kneser_ney(codes, total[codes]).reshape(-1)
    mean = (table[codes] * total[codes]).sum() / total.sum()
    s = quality.symbols("\0\0" + text).astype(int)
    logs = [table[(b << 12) | (a << 6) | c] for a, b, c in zip(s, s[1:], s[2:])]
    return float(np.exp(-(sum(logs) + quality.PRIOR * mean) / (len(logs) + quality.PRIOR)))


def test_quality(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 60), "en" if k % 2 else "de") for k in range(200)]
    rows += [(300, "%$#@ " * 80, "en"), (301, "LOUD!! " * 60, "de"), (302, "same same " * 50, "en"), (303, None, "en"), (304, " \n", None), (305, prose(rng, 60), None), (None, prose(rng, 60), "en"), (306, rows[0][1] * 3000, "de")]
    rows.append(rows[5])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as perplexity", "2 as keep")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(160)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels, Scratch(spark, "t")).collect()}
    assert [got[k]["keep"] for k in (300, 301, 302, 303, 304)] == [False] * 5
    assert np.mean([got[k]["keep"] for k in range(200)]) > 0.97 and got[305]["keep"] and got[None]["keep"]
    trusted = [t for k, t, _ in rows[:150]]
    for k in (1, 170, 300):
        assert got[k]["perplexity"] == pytest.approx(brute_perplexity(rows[[r[0] for r in rows].index(k)][1], trusted), rel=1e-3)
    assert quality.judge(docs, labels, Scratch(spark, "t")).groupBy("doc_id").count().where("count > 1").collect() == [(5, 2)]
    docs = docs.selectExpr("*", "3 as bad_id", "4 as Bad_Text")
    kept = quality.keep_quality(docs, labels, Scratch(spark, "t"))
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 2 and kept.where("doc_id >= 300 and doc_id < 305").count() == 0
    assert quality.judge(docs.limit(0), labels, Scratch(spark, "t")).count() == 0
    assert quality.judge(docs, labels.limit(0), Scratch(spark, "t")).where("doc_id < 200 and not keep").count() == 0


def brute_leaks(docs, items):
    import pyarrow as pa

    def words(t):
        return next((w for _, w, _ in word_hashes(pa.array([t or ""]))), np.empty(0, np.uint64))

    sets = lambda texts: [set(s.tolist()) for _, s in shingle_sets(pa.array([t or "" for t in texts]))]
    found = set()
    for (d, dt), ds in zip(docs, sets([t for _, t in docs])):
        for (i, it), own in zip(items, sets([t for _, t in items])):
            n = len(words(it))
            if n >= 5 and len(own & ds) >= 0.75 * len(own):
                found.add((d, i))
            if 0 < n < 5:
                a, b = words(dt).tolist(), words(it).tolist()
                if any(a[k : k + n] == b for k in range(len(a) - n + 1)):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("block", [20_000, 4])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", block)
    monkeypatch.setattr(decontam, "FILTER_BITS", 28 if block > 4 else 20)
    rng = random.Random(4)
    items = [(k, prose(rng, 8 + 3 * k)) for k in range(15)] + [(50, "two words"), (51, ""), (52, None), (53, "Zebra"), (3, "two words")]
    docs = []
    for k in range(60):
        words = prose(rng, rng.randrange(3, 400)).split()
        if k % 3 == 0:
            part = items[k % 15][1].split()
            cut = part[: max(5, int(len(part) * rng.choice([0.5, 0.8, 1])))]
            words[1:1] = cut
        docs.append((k, " ".join(words)))
    docs += [(100, items[3][1].upper()), (101, None), (102, ""), (103, "a zebra"), (104, prose(rng, 90_000) + " two words"), (None, items[2][1]), (100, items[3][1].upper())]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as containment", "3 as leaked")
    i = spark.createDataFrame(items, "item_id long, text string")
    scratch = Scratch(spark, "t")
    got = decontam.leaks(d, i, scratch).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == brute_leaks(docs, items)
    assert sum(r["doc_id"] == 100 for r in got) >= 2
    kept = decontam.keep_uncontaminated(d, i, scratch)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in docs} - {r["doc_id"] for r in got}
    assert decontam.leaks(d.limit(0), i, scratch).count() == 0 and decontam.leaks(d, i.limit(0), scratch).count() == 0
    assert decontam.keep_uncontaminated(d, i.limit(0), scratch).count() == len(docs)


def test_signature_misses_no_leak():
    rng = np.random.default_rng(2)
    for n in [*range(1, 40), 100, 1000]:
        item = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        sig = decontam.signature(item)
        least = np.sort(decontam.mix64(item ^ decontam._SECOND))  # the worst document lacks the smallest values
        lacking = set(sig.tolist())
        assert len(item) - len(lacking) < decontam.needed(len(item)) and len(lacking) == len(sig) and len(least) == len(item)


def sentences(rng, n):
    chains = {w: random.Random(w).sample(WORDS, 2) for w in WORDS}
    words = [rng.choice(WORDS)]
    while len(words) < n:
        words.append(rng.choice(chains[words[-1]]))
    return words


def test_quality_word_order(spark):
    rng = random.Random(5)
    texts = [sentences(rng, 80) for _ in range(240)]
    shuffled = [rng.sample(t, len(t)) for t in texts[:40]]
    rows = [(k, " ".join(t), "en") for k, t in enumerate(texts)] + [(1000 + k, " ".join(t), "en") for k, t in enumerate(shuffled)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(160)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels, Scratch(spark, "t")).collect()}
    assert np.mean([got[k]["keep"] for k in range(160, 240)]) > 0.95
    assert np.mean([got[1000 + k]["keep"] for k in range(40)]) < 0.05


def test_word_model_shards(spark, monkeypatch):
    rng = random.Random(7)
    docs = spark.createDataFrame([(k, k, " ".join(sentences(rng, 60))) for k in range(120)], "doc_id long, h long, text string")
    trusted = docs.where("doc_id < 80").select("doc_id")
    one = {r["doc_id"]: r["word_perplexity"] for r in wordmodel.word_perplexities(docs, trusted, Scratch(spark, "t")).collect()}
    monkeypatch.setattr(wordmodel, "SHARD_WORDS", 600)
    many = {r["doc_id"]: r["word_perplexity"] for r in wordmodel.word_perplexities(docs, trusted, Scratch(spark, "t")).collect()}
    assert len(one) == len(many) == 120
    assert all(many[k] == pytest.approx(one[k], rel=0.2) for k in one)
    held, other = np.log([one[k] for k in range(80)]).mean(), np.log([one[k] for k in range(80, 120)]).mean()
    assert held == pytest.approx(other, rel=0.05)
