"""Benchmark decontamination with an FM-index per shard of the training text.

A window is ``width`` consecutive words of a test item; an item with fewer words,
but not none, is one window.  A shard is a slice of a partition of the training
documents of bounded size.  Its words become numbers in the vocabulary of the
tests; a word outside that vocabulary, or a run of known words too short for any
window, cannot be part of an occurrence and is left out of the shard's text, with
a separator in its place, so that the index holds only what can match.  The
suffix array of that text gives its Burrows-Wheeler transform, a wavelet matrix
over it gives ranks, and every fourth text position is kept as a sample.  All
windows are searched backwards at once, occurrences are located by walking to a
sample, and the words of each document that any occurrence covers are merged into
removal spans.

The tests are dealt into blocks of at most ``block_words`` words, each of which is
broadcast; all blocks are searched in one pass over the documents.  Nothing else
is gathered: the documents are neither shuffled nor joined.

Defined cases: a null or empty text has no words, no hits and is kept; a null or
empty item has no window; equal items and equal windows of several items all
count; repeated rows are judged one by one; extra columns pass through
``decontaminate`` and never clash, as results come in one struct until renamed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightgrid.llm._words import ALNUM, LOWER, chunks, hash_spans, split, text_bytes

SAMPLE = 4


class WaveletMatrix:
    """Ranks of numbers below 2 ** levels in a sequence."""

    def __init__(self, seq: np.ndarray, levels: int):
        self.n, self.levels, self.ones, self.zeros = len(seq), levels, [], []
        for level in range(levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbols >> level & 1).astype(bool)
            ones, zeros = self.ones[k], self.zeros[k]
            lo = np.where(bit, zeros + ones[lo], lo - ones[lo])
            hi = np.where(bit, zeros + ones[hi], hi - ones[hi])
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Of a sequence of non-negative numbers, by prefix doubling."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (np.diff(seq[order]) != 0).astype(np.int64)])) if n else []
    step = 1
    while n and rank.max() < n - 1:
        second = np.full(n, 0, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.concatenate([[0], (np.diff(key[order]) != 0).astype(np.int64)]))
        step *= 2
    return order


class FmIndex:
    """Over numbers; 0 and 1 are the end and the separator."""

    def __init__(self, seq: np.ndarray, top: int):
        seq = np.concatenate([seq, [0]]).astype(np.int64)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.matrix = WaveletMatrix(self.bwt, max(1, int(top).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top + 1))])
        kept = sa % SAMPLE == 0
        self.kept, self.samples = kept, sa[kept]
        self.sample_rank = np.concatenate([[0], np.cumsum(kept)])

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbols] + self.matrix.rank(symbols, at)

    def search(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of windows (rows, filled up on the right)."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for j in range(windows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((sizes > j) & (lo < hi))
            if len(live):
                c = windows[live, j]
                lo[live], hi[live] = self.step(c, lo[live]), self.step(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        out, walked, live = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.arange(len(rows))
        at = rows.copy()
        while len(live):
            ok = self.kept[at[live]]
            done = live[ok]
            out[done] = self.samples[self.sample_rank[at[done]]] + walked[done]
            live = live[~ok]
            at[live] = self.step(self.bwt[at[live]], at[live])
            walked[live] += 1
        return out


class Tests:
    """The windows of one block of test items."""

    def __init__(self, items: list[tuple[str | None, str]], width: int):
        self.width = width
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        data, offsets = text_bytes(texts)
        data = LOWER[data]
        starts, ends, item = split(data, offsets, ALNUM)
        hashes = hash_spans(data, starts, ends)
        self.vocabulary = np.unique(hashes)
        word = np.searchsorted(self.vocabulary, hashes) + 2
        bounds = np.searchsorted(item, np.arange(len(items) + 1))
        owners: dict[tuple[int, ...], set[str]] = {}
        for i, (name, _) in enumerate(items):
            own = word[bounds[i] : bounds[i + 1]].tolist()
            for at in range(max(1, len(own) - width + 1) if own else 0):
                owners.setdefault(tuple(own[at : at + width]), set()).update([name] if name is not None else [])
        self.owners = [sorted(x) for x in owners.values()]
        self.sizes = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), width), np.int64)
        for i, w in enumerate(owners):
            self.windows[i, : len(w)] = w
        self.shortest = int(self.sizes.min(initial=width))

    def find(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in the words of a shard: first word, words, window."""
        none = np.zeros(0, np.int64)
        if not len(self.sizes) or not len(hashes):
            return none, none, none
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == hashes
        # Runs of known words within a document, of enough words.
        first = known.copy()
        first[1:] &= ~(known[:-1] & (doc[1:] == doc[:-1]))
        run = np.cumsum(first) - 1
        place = np.flatnonzero(known)
        long = np.bincount(run[place], minlength=1) >= self.shortest if len(place) else np.zeros(1, bool)
        place = place[long[run[place]]]
        if not len(place):
            return none, none, none
        # The reduced text: the runs with a separator after each.
        ends = np.flatnonzero(np.diff(run[place], append=-1)) + 1
        seq = np.insert(at[place] + 2, ends, 1)
        origin = np.insert(place, ends, -1)
        index = FmIndex(seq, len(self.vocabulary) + 1)
        lo, hi = index.search(self.windows, self.sizes)
        hit = np.flatnonzero(lo < hi)
        count = (hi - lo)[hit]
        window = np.repeat(hit, count)
        rows = np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return origin[index.locate(rows)], self.sizes[window], window


RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def _blocks(benchmark: DataFrame, width: int, block_words: int) -> list:
    """Broadcasts of blocks of test items, each of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).distinct()
    out, held, size = [], [], 0

    def close() -> None:
        nonlocal held, size
        if held:
            out.append(spark.sparkContext.broadcast(pickle.dumps(Tests(held, width))))
        held, size = [], 0

    for row in items.toLocalIterator():  # a partition at a time
        words = len(row.text) // 2 + 1
        if size + words > block_words:
            close()
        held.append((row.item_id, row.text))
        size += words
    close()
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, block_words: int = 2_000_000, out: str = "found") -> DataFrame:
    """``docs`` with a struct column ``out``: the number of words, of words in an
    occurrence of a test window, the ids of those tests (sorted), and the byte
    spans [start, end) of the text that the merged runs of hit words cover."""
    blocks = _blocks(benchmark, width, block_words)
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, RESULT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests: list[Tests] = []
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
                data = LOWER[data]
                starts, ends, doc = split(data, offsets, ALNUM)
                hashes = hash_spans(data, starts, ends)
                covered, names = np.zeros(len(starts) + 1, np.int64), [set() for _ in range(part.num_rows)]
                for block in blocks:
                    if len(blocks) > 1 or not tests:
                        tests = [pickle.loads(block.value)]
                    first, size, window = tests[0].find(hashes, doc)
                    np.add.at(covered, first, 1)
                    np.add.at(covered, first + size, -1)
                    for d, w in set(zip(doc[first].tolist(), window.tolist(), strict=True)):
                        names[d].update(tests[0].owners[w])
                    if len(blocks) > 1:  # one block at a time stays in a worker's memory
                        block.__dict__.pop("_value", None)
                hit = np.cumsum(covered[:-1]) > 0
                spans: list[list] = [[] for _ in range(part.num_rows)]
                head = hit.copy()
                head[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
                tail = hit.copy()
                tail[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
                for a, b in zip(np.flatnonzero(head).tolist(), np.flatnonzero(tail).tolist(), strict=True):
                    spans[doc[a]].append([int(starts[a] - offsets[doc[a]]), int(ends[b] - offsets[doc[a]])])
                n = np.bincount(doc, minlength=part.num_rows)
                k = np.bincount(doc[hit], minlength=part.num_rows)
                found = pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array([sorted(x) for x in names], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["n_words", "n_hit", "item_ids", "spans"])
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), found], [*kept, out])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = find_contamination(docs.select("doc_id", "text"), benchmark)
    f = F.col("found")
    return got.select(
        "doc_id",
        f.n_words.alias("n_words"),
        f.n_hit.alias("n_hit"),
        F.size(f.item_ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f.item_ids), 256).alias("items_sha256"),
        ((f.n_hit > 0) & (20 * f.n_hit >= f.n_words)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """``docs`` without the documents of which at least one word in ``share`` is hit."""
    got = find_contamination(docs, benchmark, out="__found")
    f = F.col("__found")
    return got.where(~((f.n_hit > 0) & (share * f.n_hit >= f.n_words))).drop("__found")

