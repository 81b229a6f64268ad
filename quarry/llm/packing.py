"""Lexical retrieval packing into token windows.

Documents are tokenised (plus an end id) and cut freely: whole windows of a long
document are sequences of their own, the rest is packed.  Documents are sorted by the
least hashes of their token ids and cut into even shards, so that texts with common
vocabulary lie together and no key gathers a large part of them.  Each shard holds one
BM25 inverted index over all its documents; document frequencies, the number of documents
and their mean length are those of the whole corpus.  A seed document (the longest left)
queries the index; its unused neighbours fill the window in order of score, the last one
cut to fit, its rest going back to the pool.

Cuts inside documents lie at multiples of ``GRAIN`` ids, for which prefix checksums are
kept; the checksum of any piece follows from two of them (CRC-32 is linear), so ids never
move.  A window has at most ``GRAIN`` - 1 ids of padding, but for the last of a shard.

Defined cases: null and empty texts are the end id alone; equal rows are packed each;
texts have no length limit; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepare, remembered, tidy
from .shingles import CASED_VALUE, FOLDED_VALUE, mix64, piece_words, space_cuts, string_buffers

WINDOW = 4096
END_ID = 2
GRAIN = 32
#: Documents and index entries of a shard, whose index one task holds.
SHARD_DOCS, SHARD_TERMS = 32768, 8_000_000
#: Least token hashes of a document that order it among the others.
KEY_TERMS = 8
#: Heaviest terms by which a seed is looked up first; all others follow when these find no more.
QUERY_TERMS = 24
#: Postings added up at once.
POSTINGS = 1 << 20
K1, B = 1.2, 0.75
#: Parts of words whose ids a worker remembers in each of two generations.
REMEMBERED = 1 << 19
#: Bytes tokenised at once.
PIECE_BYTES = 1 << 19
#: New parts of words encoded in one call.
CHUNK = 4000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How a tokenizer must normalise and split for its ids to be made of those of parts of words.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SPECIAL = "<|startoftext|>"

BLANK, LETTER, DIGIT, MARK, APOSTROPHE, OTHER = range(6)
_KIND = np.full(256, MARK, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
_KIND[ord("0") : ord("9") + 1] = DIGIT
_KIND[ord("'")] = APOSTROPHE
_KIND[0x80:] = OTHER


def kinds_of(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; the two bytes of a Latin-1 letter are letters."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    return kind


def part_cuts(kind: np.ndarray) -> np.ndarray:
    """Places inside words where the tokenizer parts them whatever stands around.

    A run of letters ends at a mark or digit, a digit stands alone, and a run of marks
    ends at a letter or digit unless its last mark is an apostrophe (which may belong to
    a contraction).  Bytes of other characters are never cut off.
    """
    a, b = kind[:-1], kind[1:]
    mark = (b == MARK) | (b == APOSTROPHE)
    cut = (a == LETTER) & (mark | (b == DIGIT))
    cut |= (a == DIGIT) & ((b == LETTER) | (b == DIGIT) | mark)
    cut |= (a == MARK) & ((b == LETTER) | (b == DIGIT))
    cut |= (a == APOSTROPHE) & (b == DIGIT)
    return np.flatnonzero(cut) + 1


class Memory:
    """Ids by 64-bit hash: an open-addressing table over arrays."""

    def __init__(self, most: int):
        self.mask = np.uint64((1 << (2 * most - 1).bit_length()) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.number = np.zeros(int(self.mask) + 1, np.int32)
        self.first, self.size = np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.flat = np.empty(1 << 16, np.uint32)
        self.n = self.used = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it isn't held."""
        found = np.full(len(hashes), -1, np.int64)
        at = (hashes & self.mask).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            held = self.keys[at[todo]]
            hit = held == hashes[todo]
            found[todo[hit]] = self.number[at[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            at[todo] = (at[todo] + 1) & int(self.mask)
        return found

    def add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Hold new, distinct hashes with their ids."""
        n, used = len(hashes), len(flat)
        while self.used + used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + used] = flat
        self.first[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + n] = sizes
        at = (hashes & self.mask).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = hashes[free]
            won = free[self.keys[at[free]] == hashes[free]]
            self.number[at[won]] = self.n + won
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) & int(self.mask)
        self.n += n
        self.used += used

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``numbers`` in order and how many each has."""
        first, size = self.first[numbers], self.size[numbers].astype(np.int64)
        stop = np.cumsum(size)
        return self.flat[np.repeat(first - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)], size


class WordTokenizer:
    """Ids of whole texts.

    Where the tokenizer normalises and splits as stated above, its pieces never cross the
    cuts of :func:`part_cuts`: every part of a word is encoded once and remembered.  Plain
    lower-case letters need neither normalising nor the split, so they go to the model by
    themselves.  Any other tokenizer encodes whole texts.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        said = json.loads(self.tokenizer.to_str())
        steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_parts = (
            (said.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and steps[0].get("pattern") == {"Regex": SPLIT}
            and [s["type"] for s in steps[1:]] == ["ByteLevel"]
            and said["model"].get("end_of_word_suffix") == "</w>"
            and all(t["content"].startswith("<|") and t["special"] and not t["normalized"] for t in said["added_tokens"])
        )
        self.special = self.tokenizer.token_to_id(SPECIAL)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most = max(most, PIECE_BYTES)
        self.young, self.old = Memory(self.most), None

    def _encoded(self, words: list[bytes], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts in order and how many each has; ``letters`` marks those of letters only."""
        flats, sizes = [], []
        for k in range(0, len(words), CHUNK):
            some, easy = words[k : k + CHUNK], letters[k : k + CHUNK]
            size = np.zeros(len(some), np.int64)
            plain = self.plain.encode_batch_fast([b" ".join(compress(some, easy)).decode().lower()], add_special_tokens=False)[0]
            plain = np.array(plain.ids, np.uint32)
            rest = [w.decode("utf-8", "replace") for w in compress(some, ~easy)]
            rest, size[~easy] = self._joined(rest) if rest else (plain[:0], 0)
            size[easy] = np.diff(np.flatnonzero(self.ends[plain]), prepend=-1)  # the last id of a word says so
            flat = np.empty(int(size.sum()), np.uint32)
            of = np.repeat(easy, size)
            flat[of], flat[~of] = plain, rest
            flats.append(flat)
            sizes.append(size)
        return np.concatenate(flats), np.concatenate(sizes)

    def _joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts without the special token, encoded in one call with it in between."""
        if any("<|" in t for t in texts):
            ids = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(i) for i in ids], np.int64)
        ids = np.array(self.tokenizer.encode_batch_fast([SPECIAL.join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        bounds = np.concatenate([[-1], np.flatnonzero(ids == self.special), [len(ids)]])
        return ids[ids != self.special], np.diff(bounds) - 1

    def _piece(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a piece and, for each cut, how many lie before it."""
        raw = data.tobytes()
        special = b"<|" in raw  # special tokens count capitals and marks
        kind = kinds_of(data)
        inner = cuts if special else np.union1d(cuts, part_cuts(kind))
        hashes, starts, ends = piece_words(data, inner, CASED_VALUE if special else FOLDED_VALUE)
        if not len(hashes):
            return np.empty(0, np.uint32), np.zeros(len(cuts), np.int64)
        hashes |= np.uint64(1)
        if self.young.n + len(hashes) > self.most:
            self.young, self.old = Memory(self.most), self.young
        numbers = self.young.find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            where = missing[where]
            if self.old is not None:
                held = self.old.find(new)
                kept = held >= 0
                self.young.add(new[kept], *self.old.ids(held[kept]))
                new, where = new[~kept], where[~kept]
            if len(new):
                low, high = starts[where], ends[where]
                others = np.concatenate([[0], np.cumsum(kind != LETTER)])
                self.young.add(new, *self._encoded([raw[a:b] for a, b in zip(low.tolist(), high.tolist())], others[high] == others[low]))
            numbers[missing] = self.young.find(hashes[missing])
        ids, size = self.young.ids(numbers)
        before = np.concatenate([[0], np.cumsum(size)])
        return ids, before[np.searchsorted(starts, cuts)]

    def column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, n+1 bounds) for runs of whole rows of a column (uint32, without end ids)."""
        data, at = string_buffers(column)
        row, rows = 0, len(column)
        while row < rows:
            end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE_BYTES, "right")) - 1)
            lo, hi = int(at[row]), int(at[end])
            if not self.by_parts:
                ids = [e.ids for e in self.tokenizer.encode_batch([t or "" for t in column.slice(row, end - row).to_pylist()], add_special_tokens=False)]
                yield row, np.fromiter(chain.from_iterable(ids), np.uint32), np.concatenate([[0], np.cumsum([len(i) for i in ids])])
            elif hi - lo <= PIECE_BYTES:
                yield row, *self._piece(data[lo:hi], at[row : end + 1] - lo)
            else:
                whole = np.concatenate([self._piece(data[a:b], np.empty(0, np.int64))[0] for a, b in space_cuts(data, lo, hi, PIECE_BYTES)])
                yield row, whole, np.array([0, len(whole)])
            row = end


#: Name under which a process remembers its tokenizers.
TOKENIZERS = "tokenizers"


def tokenizer_for(path: str) -> WordTokenizer:
    """The tokenizer of this process; it outlives a task, until the process runs a map of another kind."""
    held = remembered(TOKENIZERS)
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, text) -> (doc_id, key, tokens, crcs, terms); terms are distinct ids and their counts."""
        tokenizer = tokenizer_for(path)
        for batch in batches:
            keys, sizes, crcs, terms = [], [], [], []
            for _, ids, bounds in tokenizer.column(batch.column(1)):
                n = np.diff(bounds)
                row = np.repeat(np.arange(len(n), dtype=np.int64) << 32, n)
                pairs = np.sort(row | ids)
                first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
                counts = np.minimum(np.diff(np.append(first, len(pairs))), 65535).astype(np.uint16)
                pairs = pairs[first]
                different = (pairs & 0xFFFFFFFF).astype(np.uint32)
                cuts = np.searchsorted(pairs, np.arange(len(n) + 1, dtype=np.int64) << 32)
                hashed = np.sort((pairs >> 32 << 32) | (mix64(different.astype(np.uint64) + np.uint64(99)) >> np.uint64(32)).astype(np.int64))
                least = (hashed & 0xFFFFFFFF).astype(">u4")
                for a, b, c, d in zip(bounds[:-1], bounds[1:], cuts[:-1], cuts[1:]):
                    raw = memoryview(np.append(ids[a:b], np.uint32(END_ID)).astype("<u4").tobytes())
                    crc, prefix = 0, []
                    for k in range(0, len(raw), 4 * GRAIN):
                        crc = zlib.crc32(raw[k : k + 4 * GRAIN], crc)
                        prefix.append(crc)
                    keys.append(least[c : min(d, c + KEY_TERMS)].tobytes())
                    crcs.append(np.array(prefix, np.uint32).tobytes())
                    terms.append(different[c:d].tobytes() + counts[c:d].tobytes())
                sizes.extend((n + 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.binary()), pa.array(terms, pa.binary())],
                names=["doc_id", "key", "tokens", "crcs", "terms"],
            )

    return run


def terms_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a document and their counts."""
    n = len(packed) // 6
    return np.frombuffer(packed, np.uint32, n), np.frombuffer(packed, np.uint16, n, 4 * n)


# CRC-32 of data followed by zero bytes: one set of tables per power of two of bytes.
def _zero_tables(powers: int = 40) -> list[np.ndarray]:
    # crc32(one zero byte, x) is affine in x; its difference to x = 0 is linear
    rows = np.array([zlib.crc32(b"\0", 0) ^ zlib.crc32(b"\0", 1 << k) for k in range(32)], np.uint32)
    v, tables = np.arange(256), []
    for _ in range(powers):
        table = np.zeros((4, 256), np.uint32)
        for k in range(32):
            table[k // 8] ^= np.where(v >> (k % 8) & 1, rows[k], 0).astype(np.uint32)
        tables.append(table)
        rows = _apply(table, rows)
    return tables


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0, x & 255] ^ table[1, x >> 8 & 255] ^ table[2, x >> 16 & 255] ^ table[3, x >> 24]


_tables: list[np.ndarray] = []


def piece_crc(before: np.ndarray, until: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the last ``size`` bytes of data from the checksums before them and until their end."""
    if not _tables:
        _tables.extend(_zero_tables())
    x, left = before.astype(np.uint32), size.astype(np.int64)
    for table in _tables:
        if not left.any():
            break
        x = np.where(left & 1, _apply(table, x), x)
        left >>= 1
    return until.astype(np.uint32) ^ x


@dataclass
class Corpus:
    """What BM25 needs of all documents: their number, mean length and, for each term, how many hold it."""

    n: int
    length: float
    df: np.ndarray


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tokens, terms) -> (term, df) of a task; term -1 has the documents, -2 their tokens."""
    df, n, size = np.zeros(1 << 16, np.int64), 0, 0
    for batch in batches:
        n, size = n + batch.num_rows, size + int(batch.column(0).to_numpy().sum())
        found = np.bincount(np.concatenate([terms_of(x)[0] for x in batch.column(1).to_pylist()] or [np.empty(0, np.uint32)]).astype(np.int64), minlength=len(df))
        df = found + np.pad(df, (0, len(found) - len(df)))
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], held]).astype(np.int64)), pa.array(np.concatenate([[n, size], df[held]]))], names=["term", "df"])


def corpus_of(tokenised: DataFrame) -> Corpus:
    # a row for each id of the vocabulary at most
    rows = tokenised.select("tokens", "terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    found = {r["term"]: r["df"] for r in rows}
    df = np.zeros(max([0, *found]) + 1, np.int64)
    for term, k in found.items():
        if term >= 0:
            df[term] = k
    n = found.get(-1, 0)
    return Corpus(n, found.get(-2, 0) / max(n, 1), df)


class Shard:
    """Packs the documents of a shard."""

    def __init__(self, number: int, corpus: Corpus):
        self.corpus = corpus
        self.last = number << 40
        self.current: int | None = None  # the unfinished window
        self.filled = 0
        self.rows: list[tuple] = []  # doc_id, start, length, crcs, tokens, sequence, offset

    def _new(self) -> int:
        self.last += 1
        return self.last

    def _put(self, doc: tuple, start: int, length: int) -> None:
        if self.current is None:
            self.current = self._new()
        self.rows.append((doc[0], start, length, doc[2], doc[1], self.current, self.filled))
        self.filled += length
        if WINDOW - self.filled < GRAIN:
            self.current, self.filled = None, 0

    def pack(self, docs: list[tuple]) -> None:
        """Place all of ``docs`` (doc_id, tokens, crcs, terms); the last window may stay open."""
        n = len(docs)
        start, left = np.zeros(n, np.int64), np.array([d[1] for d in docs], np.int64)
        for i in np.flatnonzero(left >= WINDOW):  # whole windows of long documents stand alone
            while left[i] >= WINDOW:
                self.rows.append((docs[i][0], int(start[i]), WINDOW, docs[i][2], docs[i][1], self._new(), 0))
                start[i] += WINDOW
                left[i] -= WINDOW
        order, at, seed = np.argsort(-left, kind="stable"), 0, -1
        pool = left > 0
        index = ShardIndex.of(docs, self.corpus) if pool.any() else None

        def place(j: int) -> bool:
            """Put what fits of a document; the rest opens the next window. True if that became the seed's window."""
            room = WINDOW - self.filled
            take = int(left[j]) if left[j] <= room else room // GRAIN * GRAIN
            before = self.current
            self._put(docs[j], int(start[j]), take)
            start[j] += take
            left[j] -= take
            pool[j] = False  # its rest, if any, is placed at once
            if left[j]:
                self._put(docs[j], int(start[j]), int(left[j]))
                left[j] = 0
                return True
            return before is None and self.current is not None

        while at < n:
            if not pool[order[at]] and (seed < 0 or self.current is None):
                at += 1
                continue
            if 2 * np.count_nonzero(pool) < index.alive:
                index = index.kept(pool)
            if seed < 0 or self.current is None:
                seed = int(order[at])
                place(seed)
                continue
            window = self.current
            for j in index.neighbours(seed, pool):
                if place(j):
                    seed = j
                if self.current != window:
                    if self.current is None:
                        seed = -1
                    break
            else:  # no document left shares a word with the seed: the next longest takes over
                seed = -1

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The rows of finished windows."""
        done = [r for r in self.rows if r[5] != self.current]
        self.rows = [r for r in self.rows if r[5] == self.current]
        if not done:
            return
        ids, start, length, crcs, tokens, sequence, offset = zip(*done)
        start, length, tokens = (np.array(x, np.int64) for x in (start, length, tokens))
        last = (start + length - 1) // GRAIN
        word = lambda c, k: int.from_bytes(c[4 * k : 4 * k + 4], "little")
        before = np.array([0 if a == 0 else word(c, a // GRAIN - 1) for c, a in zip(crcs, start)], np.uint32)
        until = np.array([word(c, k) for c, k in zip(crcs, last)], np.uint32)
        crc = np.where(start == 0, until, piece_crc(before, until, 4 * length))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(start), pa.array(length), pa.array(crc.astype(np.int64)), pa.array(tokens), pa.array(np.array(sequence, np.int64)), pa.array(np.array(offset, np.int64))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def close(self) -> None:
        self.current, self.filled = None, 0


class ShardIndex:
    """BM25 over the documents of a shard, with the figures of the corpus; terms are token ids."""

    def __init__(self, own: list[tuple[np.ndarray, np.ndarray]], of: np.ndarray, term: np.ndarray, weight: np.ndarray, alive: int):
        """``own`` has the terms and weights of each document; the postings are sorted by term."""
        self.own, self.of, self.term, self.weight, self.alive = own, of, term, weight, alive

    @classmethod
    def of(cls, docs: list[tuple], corpus: Corpus) -> ShardIndex:
        idf = np.log1p((corpus.n - corpus.df + 0.5) / (corpus.df + 0.5)).astype(np.float32)
        own = []
        for _, tokens, _, packed in docs:
            term, count = terms_of(packed)
            own.append((term, idf[term] * count * np.float32(K1 + 1) / (count + np.float32(K1 * (1 - B + B * tokens / corpus.length)))))
        of = np.repeat(np.arange(len(docs), dtype=np.int32), [len(t) for t, _ in own])
        term, weight = (np.concatenate([x[k] for x in own]) for k in (0, 1))
        by = np.argsort(term)
        return cls(own, of[by], term[by], weight[by], len(docs))

    def kept(self, pool: np.ndarray) -> ShardIndex:
        """The index without the postings of documents that are used."""
        keep = pool[self.of]
        return ShardIndex(self.own, self.of[keep], self.term[keep], self.weight[keep], int(np.count_nonzero(pool)))

    def _scored(self, terms: np.ndarray, pool: np.ndarray) -> Iterator[int]:
        """Documents of ``pool`` that hold one of ``terms``, best first; few are wanted mostly, so they are sorted by and by."""
        low, high = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        score, ends = np.zeros(len(pool)), np.cumsum(high - low)
        while len(low):  # so many postings at a time that memory does not follow the terms
            k = max(1, int(np.searchsorted(ends, POSTINGS, "right")))
            cuts = [slice(a, b) for a, b in zip(low[:k], high[:k])]
            score += np.bincount(np.concatenate([self.of[c] for c in cuts]), np.concatenate([self.weight[c] for c in cuts]), len(pool))
            low, high, ends = low[k:], high[k:], ends[k:] - ends[k - 1]
        score[~pool] = 0
        found, most = np.flatnonzero(score), 32
        while len(found):
            left = score[found]
            if len(found) > most:
                by = np.argpartition(-left, most - 1)
                best, found = found[by[:most]], found[by[most:]]
            else:
                best, found = found, found[:0]
            yield from best[np.lexsort((best, -score[best]))].tolist()
            most *= 8

    def neighbours(self, i: int, pool: np.ndarray) -> Iterator[int]:
        """Documents of ``pool`` that share a term with document ``i``: by its heaviest terms first, then by all."""
        term, weight = self.own[i]
        if len(term) > QUERY_TERMS:
            heaviest = np.sort(term[np.argpartition(-weight, QUERY_TERMS)[:QUERY_TERMS]])
            yield from (j for j in self._scored(heaviest, pool) if pool[j])
        if len(term):
            yield from (j for j in self._scored(term, pool) if pool[j])


def _packed(corpus: Corpus):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, tokens, crcs, terms), all of a shard -> pieces."""
        shard = Shard(TaskContext.get().partitionId(), corpus)
        held = [doc for batch in batches for doc in zip(*(c.to_pylist() for c in batch.columns))]
        if held:
            shard.pack(held)
        shard.close()
        yield from shard.batches()

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    tokenised = rows.mapInArrow(tidy(_tokenised(tokenizer_path or default_tokenizer()), TOKENIZERS), "doc_id long, key binary, tokens long, crcs binary, terms binary")
    tokenised = Scratch(docs.sparkSession, "packing").table(tokenised, "tokenised")
    corpus = corpus_of(tokenised)
    shards = max(1, -(-corpus.n // SHARD_DOCS), -(-int(corpus.df.sum()) // SHARD_TERMS))  # as few as their indexes allow
    dealt = tokenised.repartitionByRange(shards, "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "tokens", "crcs", "terms")
    return dealt.mapInArrow(tidy(_packed(corpus)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
