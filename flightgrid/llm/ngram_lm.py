"""N-gram language model in an Elias-Fano trie.

Level 1 holds the training words, as 64-bit hashes, with their exact counts.  Level k
holds the n-grams of k words as children of their context of k - 1 words.  All levels
are sharded: level 1 by the leading bits of the hash, the others by the hash of the
context, and contexts with more than a share of all tokens by the hash of context and
word.  In a shard, contexts are one monotone sequence, and the children of all of them
another: (position of the context) * words + (rank of the word).  Both are Elias-Fano
coded, with a directory of zeros for constant-time search, so that a child is looked
for among its context's successors alone.  Next to them lie quantised (16-bit)
log-probabilities of the discounted counts and of the mass left to shorter contexts.
Shards are files in the shared folder, mapped into memory by every Python worker.

Smoothing: interpolated absolute discounting, p(w | c) = (n(cw) - D) / n(c) +
left(c) * p(w | shorter c), with n-grams below ``least`` occurrences pruned into
left(c), and at level 1 (n(w) - D) / N with the mass D * V / N for the one unknown
word.  The default counts all n-grams (``least`` 1).  A k-gram can only be frequent if both its (k-1)-grams are, so those are checked
before anything of it is counted.

Every text is its words and then one end; the first word's context is a begin that is
no token.

Defined cases: a null or empty text is the end alone; a null id counts as training;
repeated rows count, and are scored, one by one; extra columns pass through ``score``,
but those named like its results, which are replaced; an empty table gives an empty one;
without a training row base and model scores are those of a uniform guess.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightgrid.llm._store import Files, cut, scratch_path
from flightgrid.llm._words import LOWER, SPACED, chunks, hash_spans, hash_text, mix, split, text_bytes

#: The end of a text: its spelling holds a line end, so no word is equal.
END = np.uint64(hash_text("</s>\n"))
#: Log10-probabilities from 0 to -LOWEST are stored in 16 bits.
LOWEST = 24.0
NONE = np.int64(-1)
#: Tokens of the corpus a shard of levels 2 and up; its n-grams are fewer.
SHARD = 4_000_000
#: Bytes of text that are counted together, which merges their repeated n-grams.
SLICE = 4 << 20


# ---------------------------------------------------------------- Elias-Fano


def ef_encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray | int]:
    """Of ascending distinct numbers below ``universe``."""
    n = len(values)
    low = max(0, (universe // max(n, 1)).bit_length() - 1)
    low = min(low, 56)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(low)).astype(np.int64)
    bits = np.zeros(((int(high[-1]) if n else 0) + n + 1 + 63) // 64 * 64 + 64, bool)
    bits[high + np.arange(n)] = True
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.bitwise_count(words).astype(np.int64)
    zeros = np.arange(len(words)) * 64 - (np.cumsum(ones) - ones)  # zeros before each word
    raw = np.zeros((n * low + 7) // 8 + 8, np.uint8)
    step = 1 << 16
    for at in range(0, n, step):  # step * low is a whole number of bytes
        part = values[at : at + step]
        flags = (part[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        packed = np.packbits(flags.astype(bool).ravel(), bitorder="little")
        raw[at * low // 8 : at * low // 8 + len(packed)] = packed
    return {"n": n, "low": low, "words": words, "zeros": zeros, "raw": raw}


class EliasFano:
    """Reader of the arrays that ef_encode makes."""

    def __init__(self, n: int, low: int, words: np.ndarray, zeros: np.ndarray, raw: np.ndarray):
        self.n, self.low, self.words, self.zeros = n, low, words, zeros
        self.lanes = np.ndarray(shape=(len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,))
        self.mask = np.uint64((1 << low) - 1)

    def lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.low
        return (self.lanes[bit >> 3] >> (bit & 7).astype(np.uint64)) & self.mask

    def find(self, values: np.ndarray) -> np.ndarray:
        """Positions of values in the sequence, -1 where they are not in it."""
        out = np.full(len(values), NONE)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low)).astype(np.int64)
        low = values & self.mask
        # A run of ones between two zeros is the elements with one high part; the lows
        # within it ascend, so they are halved (a frequent context makes long runs).
        last = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.words[-1]))
        live = np.flatnonzero(high < last)
        h, low = high[live], low[live]
        lo = np.zeros(len(live), np.int64)
        later = h > 0
        lo[later] = self._select_zero(h[later] - 1) - h[later] + 1
        hi = self._select_zero(h) - h
        on = lo < hi
        live, low, lo, hi = live[on], low[on], lo[on], hi[on]
        while len(live):
            mid = (lo + hi) >> 1
            got = self.lows(mid)
            hit = got == low
            out[live[hit]] = mid[hit]
            less = got < low
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            on = ~hit & (lo < hi)
            live, low, lo, hi = live[on], low[on], lo[on], hi[on]
        return out

    def _select_zero(self, j: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.zeros, j, side="right") - 1
        r = j - self.zeros[w]
        word = ~self.words[w]
        at = np.zeros(len(j), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = word & np.uint64((1 << width) - 1)
            n = np.bitwise_count(part).astype(np.int64)
            go = r >= n
            r = np.where(go, r - n, r)
            word = np.where(go, word >> np.uint64(width), part)
            at += np.where(go, width, 0)
        return w * 64 + at


def pack(**parts: Any) -> bytes:
    """Arrays and numbers in one file: a JSON head, then the arrays at multiples of 8."""
    head, blobs, at = {}, [], 0
    for name, x in parts.items():
        if isinstance(x, dict):
            x, sub = None, x
            for k, v in sub.items():
                parts_name = f"{name}.{k}"
                if isinstance(v, np.ndarray):
                    head[parts_name] = [v.dtype.str, len(v), at]
                    raw = v.tobytes() + bytes(-v.nbytes % 8)
                    blobs.append(raw)
                    at += len(raw)
                else:
                    head[parts_name] = v
        elif isinstance(x, np.ndarray):
            head[name] = [x.dtype.str, len(x), at]
            raw = x.tobytes() + bytes(-x.nbytes % 8)
            blobs.append(raw)
            at += len(raw)
        else:
            head[name] = x
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(blobs)


def unpack(raw: np.ndarray) -> dict[str, Any]:
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    base = 8 + n
    return {k: raw[base + v[2] : base + v[2] + v[1] * np.dtype(v[0]).itemsize].view(v[0]) if isinstance(v, list) else v for k, v in head.items()}


def _ef(found: dict[str, Any], name: str) -> EliasFano:
    return EliasFano(*(found[f"{name}.{k}"] for k in ("n", "low", "words", "zeros", "raw")))


def quantise(p: np.ndarray) -> np.ndarray:
    """Finer near one: the code is the root of the negative logarithm."""
    x = -np.log10(np.maximum(p, 10.0**-LOWEST))
    return np.round(np.sqrt(x / LOWEST) * 65535).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return 10.0 ** (-LOWEST * (code.astype(np.float64) / 65535) ** 2)


# --------------------------------------------------------------------- model


@dataclass
class Level:
    files: list[str]  # of each shard
    offsets: np.ndarray  # entries before each shard
    heavy: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # contexts dealt by word too
    heavy_left: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class Model:
    """What a worker needs to open the trie; its size is that of the lists of shards."""

    folder: str
    discount: float
    tokens: int = 0
    words: int = 0
    texts: int = 0
    levels: list[Level] = field(default_factory=list)

    @property
    def width(self) -> int:
        return self.words + 1  # the begin is the last "word"


@lru_cache(maxsize=4096)
def _opened(folder: str, name: str) -> dict[str, Any]:
    found = unpack(Files(folder).view(name))
    for k in [k.removesuffix(".n") for k in found if k.endswith(".n")]:
        found[k] = _ef(found, k)
    return found


class Trie:
    def __init__(self, model: Model):
        self.m = model

    def _each(self, level: Level, shard: np.ndarray) -> Iterator[tuple[dict[str, Any], np.ndarray, int]]:
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(level.files) + 1))
        for s, name in enumerate(level.files):
            if name and cuts[s] < cuts[s + 1]:
                yield _opened(self.m.folder, name), order[cuts[s] : cuts[s + 1]], int(level.offsets[s])

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (-1: unknown) and counts of word hashes."""
        rank, count = np.full(len(hashes), NONE), np.zeros(len(hashes), np.int64)
        level = self.m.levels[0]
        for found, who, offset in self._each(level, word_shard(hashes, len(level.files))):
            i = found["words"].find(hashes[who] - np.uint64(found["base"]))
            hit = i >= 0
            rank[who[hit]] = i[hit] + offset
            count[who[hit]] = found["counts"][i[hit]]
        return rank, count

    def children(self, k: int, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries (-1: none) of level ``k`` below contexts, and their probabilities."""
        level = self.m.levels[k - 1]
        entry, p = np.full(len(context), NONE), np.zeros(len(context))
        for found, who, offset in self._each(level, child_shard(context, word, level.heavy, len(level.files))):
            if not len(who):
                continue
            own = context[who]  # ascending, as the caller's keys are
            new = np.append(True, own[1:] != own[:-1])
            c = found["contexts"].find(own[new])[np.cumsum(new) - 1]
            who, c = who[c >= 0], c[c >= 0]
            i = found["children"].find(c.astype(np.uint64) * np.uint64(self.m.width) + word[who].astype(np.uint64))
            hit = i >= 0
            entry[who[hit]] = i[hit] + offset
            p[who[hit]] = restore(found["probability"][i[hit]])
        return entry, p

    def left(self, k: int, context: np.ndarray) -> np.ndarray:
        """The mass that contexts of level ``k`` leave to shorter ones."""
        level = self.m.levels[k - 1]
        out = np.ones(len(context))
        at = np.searchsorted(level.heavy, context)
        at[at == len(level.heavy)] = 0
        big = level.heavy[at] == context if len(level.heavy) else np.zeros(len(context), bool)
        out[big] = level.heavy_left[at[big]] if len(level.heavy) else 1.0
        rest = np.flatnonzero(~big)
        for found, who, _ in self._each(level, child_shard(context[rest], context[rest], level.heavy[:0], len(level.files))):
            c = found["contexts"].find(context[rest[who]])
            out[rest[who[c >= 0]]] = restore(found["left"][c[c >= 0]])
        return out


def word_shard(hashes: np.ndarray, n: int) -> np.ndarray:
    """By the leading bits; ``n`` is a power of two."""
    bits = n.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def child_shard(context: np.ndarray, word: np.ndarray, heavy: np.ndarray, n: int) -> np.ndarray:
    h = mix(context.astype(np.uint64) + np.uint64(0x51ED270B))
    if len(heavy):
        at = np.searchsorted(heavy, context)
        at[at == len(heavy)] = 0
        h = np.where(heavy[at] == context, mix(h ^ mix(word.astype(np.uint64))), h)
    return (h % np.uint64(n)).astype(np.int64)


# ------------------------------------------------------------------ training


@dataclass
class Tokens:
    hash: np.ndarray
    text: np.ndarray
    first: np.ndarray  # place of each text's first token


def tokens(col: pa.Array) -> Tokens:
    """Words and an end for each text, in order."""
    data, offsets = text_bytes(col)
    data = LOWER[data]
    starts, ends, doc = split(data, offsets, SPACED)
    n = len(offsets) - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts + 1) - counts - 1
    text = np.repeat(np.arange(n), counts + 1)
    h = np.full(len(starts) + n, END, np.uint64)
    h[np.arange(len(starts)) + doc] = hash_spans(data, starts, ends)
    return Tokens(h, text, first)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def _shrink(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys and their counts, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    raw = len(keys).to_bytes(8, "little") + gaps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _swell(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    gaps = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view("<u8").ravel()
    counts = np.frombuffer(raw, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T.copy().view("<u4").ravel()
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


def _entries(trie: Trie, t: Tokens, order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Ranks and counts of the tokens; then for levels 2 to ``order`` the context of
    each token (-1: none) and its entry there with its probability."""
    unique, inverse = np.unique(t.hash, return_inverse=True)
    rank, count = (x[inverse] for x in trie.words(unique))
    steps = []
    before = np.full(len(rank), NONE)
    before[1:] = rank[:-1]
    before[t.first] = trie.m.words
    for k in range(2, order + 1):
        context = before
        if k > len(trie.m.levels):
            steps.append((context, np.full(len(rank), NONE), np.zeros(len(rank))))
            break
        entry, p = np.full(len(rank), NONE), np.zeros(len(rank))
        live = (context >= 0) & (rank >= 0)
        if steps:  # a k-gram is kept only if what is left without its first word is
            live &= steps[-1][1] >= 0
        live = np.flatnonzero(live)
        keys, back = np.unique(context[live].astype(np.uint64) * np.uint64(trie.m.width) + rank[live].astype(np.uint64), return_inverse=True)
        e, q = trie.children(k, (keys // np.uint64(trie.m.width)).astype(np.int64), (keys % np.uint64(trie.m.width)).astype(np.int64))
        entry[live], p[live] = e[back], q[back]
        steps.append((context, entry, p))
        before = np.full(len(rank), NONE)
        before[1:] = entry[:-1]
        before[t.first] = NONE
    return rank, count, steps


def train(docs: DataFrame, text: str = "text", order: int = 3, least: int = 1, discount: float = 0.75, folder: str | None = None) -> Model:
    """Count ``docs`` and write the trie to ``folder`` (default: in the shared folder)."""
    spark = docs.sparkSession
    model = Model(folder or scratch_path(spark, "ngrams"), discount)
    docs = docs.select(text)

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text, SLICE):
                h, n = _counted(tokens(part.column(0)).hash)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    counts = cut(docs.mapInArrow(unigrams, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "unigrams")
    seen = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    model.words, model.tokens = seen.v, seen.n
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    model.levels = [_first_level(counts, model, parts)]
    end = counts.where(F.col("h") == int(END.astype(np.int64))).first()
    model.texts = end.n if end else 0
    share = max(1, model.tokens // (4 * parts))
    heavy = {int(r.h): int(r.n) for r in counts.where(F.col("n") > share).toLocalIterator()}  # under 4 * parts rows
    ranks = _ranks(model, list(heavy))
    hot = {int(r): n for r, n in zip(ranks, heavy.values(), strict=True)}
    hot[model.words] = model.texts  # the begin
    # A shard gets some ``SHARD`` n-grams at most, whatever the corpus.
    shards = max(parts, model.tokens // SHARD + 1)
    for k in range(2, order + 1):
        if not model.tokens:
            break
        level, hot = _next_level(docs, text, model, k, hot, least, shards, share, k == order)
        model.levels.append(level)
    return model


def _ranks(model: Model, hashes: list[int]) -> np.ndarray:
    return Trie(model).words(np.array(hashes, np.int64).view(np.uint64))[0]


def _first_level(counts: DataFrame, model: Model, parts: int) -> Level:
    n = 1 << max(0, max(parts - 1, model.words // 4_000_000).bit_length())
    bits = n.bit_length() - 1
    # The leading bits of the unsigned hash; one bit less than 64 keeps the shift native.
    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    folder = model.folder

    def build(key: tuple, t: pa.Table) -> pa.Table:
        s = key[0].as_py()
        h, c = t["h"].to_numpy().view(np.uint64), t["n"].to_numpy()
        order = np.argsort(h)
        base = s << 64 - bits if bits else 0
        name = f"words-{s:06d}"
        Files(folder).save(name, pack(words=ef_encode(h[order] - np.uint64(base), 1 << 64 - bits), counts=c[order].astype(np.uint32 if c.max() < 1 << 32 else np.uint64), base=base))
        return pa.table({"shard": pa.array([s], pa.int32()), "file": [name], "n": [len(h)]})

    made = counts.select(shard.alias("shard"), "h", "n").groupBy("shard").applyInArrow(build, "shard int, file string, n long").collect()
    return _level(made, n)


def _level(made: list, n: int, heavy: np.ndarray | None = None, left: np.ndarray | None = None) -> Level:
    files, sizes = [""] * n, np.zeros(n, np.int64)
    for r in made:
        files[r.shard], sizes[r.shard] = r.file, r.n
    return Level(files, np.cumsum(sizes) - sizes, *(() if heavy is None else (heavy, left)))


def _next_level(docs: DataFrame, text: str, model: Model, k: int, hot: dict[int, int], least: int, parts: int, share: int, last: bool) -> tuple[Level, dict[int, int]]:
    """Level ``k`` and the counts of its own heavy entries; the ``last`` level keeps no
    counts, as only the next one's training asks for them."""
    spark = docs.sparkSession
    heavy = np.array(sorted(hot), np.int64)
    totals = np.array([hot[c] for c in heavy.tolist()], np.int64)
    n, width, folder, discount = parts, model.width, model.folder, model.discount
    sent = spark.sparkContext.broadcast((model, heavy, totals))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value[0])
        for batch in batches:
            for part in chunks(batch, text, SLICE):
                t = tokens(part.column(0))
                rank, _, steps = _entries(trie, t, k)
                context = steps[-1][0]
                keep = (context >= 0) & (rank >= 0)
                if k > 2:
                    keep &= steps[-2][1] >= 0
                keys, c = _counted(context[keep].astype(np.uint64) * np.uint64(width) + rank[keep].astype(np.uint64))
                shard = child_shard((keys // np.uint64(width)).astype(np.int64), (keys % np.uint64(width)).astype(np.int64), heavy, n)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(n + 1))
                used = [s for s in range(n) if cuts[s] < cuts[s + 1]]
                blobs = [_shrink(keys[o := order[cuts[s] : cuts[s + 1]]], c[o]) for s in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def build(key: tuple, t: pa.Table) -> pa.Table:
        s = key[0].as_py()
        keys, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            a, b = np.concatenate([keys, *(x for x, _ in held)]), np.concatenate([c, *(x for _, x in held)])
            order = np.argsort(a, kind="stable")
            a, b = a[order], b[order]
            new = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
            return a[new], np.add.reduceat(b, new) if len(a) else b

        for chunk in t["blob"].chunks:
            for blob in chunk:
                held.append(_swell(blob.as_py()))
                size += len(held[-1][0])
                if size > 2_000_000:
                    keys, c = merge()
                    held, size = [], 0
        keys, c = merge()
        context = (keys // np.uint64(width)).astype(np.int64)
        new = np.flatnonzero(np.append(True, context[1:] != context[:-1])[: len(context)])
        names, total = context[new], np.add.reduceat(c, new)
        _, heavy, totals = sent.value
        at = np.searchsorted(heavy, names)
        at[at == len(heavy)] = 0
        big = heavy[at] == names if len(heavy) else np.zeros(len(names), bool)
        if k > 2:  # pre-checked keys leave some successors out: the context's own count
            own = names_count(sent.value[0], k - 1, names)
            total = np.maximum(total, own)
        total = np.where(big, totals[at], total) if len(heavy) else total
        of = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(keys))))
        kept = c >= least
        mass = np.bincount(of[kept], (c[kept] - discount), len(new))
        used = np.unique(of[kept])
        place = np.full(len(new), -1)
        place[used] = np.arange(len(used))
        word = keys % np.uint64(width)
        children = place[of[kept]].astype(np.uint64) * np.uint64(width) + word[kept]
        name = f"level{k}-{s:06d}"
        raw = pack(
            contexts=ef_encode(names[used].astype(np.uint64), int(names[used][-1]) + 1 if len(used) else 1),
            left=quantise(1 - mass[used] / total[used]),
            children=ef_encode(children, max(1, len(used)) * width),
            probability=quantise((c[kept] - discount) / total[of[kept]]),
            **({} if last else {"counts": c[kept].astype(np.uint32 if c.max(initial=0) < 1 << 32 else np.uint64)}),
        )
        Files(folder).save(name, raw)
        over = np.flatnonzero(c[kept] > share)
        return pa.table({"shard": pa.array([s], pa.int32()), "file": [name], "n": [int(kept.sum())], "hot": pa.array([over.tolist()], pa.list_(pa.int64())), "hot_n": pa.array([c[kept][over].tolist()], pa.list_(pa.int64())), "part": pa.array([names[big].tolist()], pa.list_(pa.int64())), "mass": pa.array([mass[big].tolist()], pa.list_(pa.float64()))})

    made = docs.mapInArrow(count, "shard int, blob binary").groupBy("shard").applyInArrow(build, "shard int, file string, n long, hot array<long>, hot_n array<long>, part array<long>, mass array<double>").collect()
    left = np.ones(len(heavy))
    for r in made:
        at = np.searchsorted(heavy, np.array(r.part, np.int64))
        np.subtract.at(left, at, np.array(r.mass) / totals[at])
    level = _level(made, n, heavy, left)
    return level, {int(level.offsets[r.shard]) + i: c for r in made for i, c in zip(r.hot, r.hot_n, strict=True)}


def names_count(model: Model, k: int, entries: np.ndarray) -> np.ndarray:
    """Counts of entries of level ``k`` >= 2 by their positions."""
    level, trie = model.levels[k - 1], Trie(model)
    out = np.zeros(len(entries), np.int64)
    for found, who, offset in trie._each(level, np.searchsorted(level.offsets, entries, side="right") - 1):
        out[who] = found["counts"][entries[who] - offset]
    return out


# ------------------------------------------------------------------- scoring

SCORES = "n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the numbers of tokens and known tokens, the
    base score and the model's log10 probability of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["n_tokens", "n_known", "base_score", "score"]
    kept = [c for c in docs.columns if c != text and c not in names]
    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(SCORES).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent.value)
        m = sent.value
        for batch in batches:
            for part in chunks(batch, text, SLICE):
                t = tokens(part.column(part.schema.get_field_index(text)))
                rank, count, steps = _entries(trie, t, len(m.levels))
                if m.tokens:
                    p = np.where(count > 0, count - m.discount, m.discount * m.words) / m.tokens
                else:
                    p = np.ones(len(rank))
                for k, (context, _, alpha) in enumerate(steps, 2):
                    if k > len(m.levels):
                        break
                    has = np.flatnonzero(context >= 0)
                    unique, back = np.unique(context[has], return_inverse=True)
                    p[has] = alpha[has] + trie.left(k, unique)[back] * p[has]
                n = part.num_rows
                sums = [np.bincount(t.text, minlength=n), np.bincount(t.text[count > 0], minlength=n), np.bincount(t.text, np.log10((count + 1) / (m.tokens + m.words + 1)), n), np.bincount(t.text, np.log10(p), n)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *(pa.array(x) for x in sums)], [*kept, *names])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, least: int = 1) -> DataFrame:
    """Learn from the rows that are not held out, with the n-grams of ``least``
    occurrences or more; score every row."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    model = train(rows.where("not held_out"), least=least)
    got = score(rows, model)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
