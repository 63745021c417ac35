"""Exact substring deduplication with suffix arrays made by external induced sorting.

A byte is removed if a string of ``width`` bytes that covers it also starts anywhere
else, in the same text or another.  Every such string (a window) has one anchor: the
leftmost of its ``gram``-byte strings with the least hash.  Equal windows have equal
anchors at the same offset, so:

1. Each text's anchors are listed with the stretch of bytes that their windows cover.
   Anchors that occur once in the corpus have no repeated window and go.
2. Equal stretches of an anchor are repeated as wholes; one of them stands for all.
3. Anchors that still have several different stretches are dealt by anchor into
   shards.  The stretches of a shard make one text, whose suffixes are sorted by
   external induced sorting (induced_sort); a window is repeated where its suffix
   shares at least ``width`` bytes with a neighbour.
4. The repeated windows of each text are merged into spans, which come back to it.

Texts that are repeated or nearly so thus never meet as wholes, and a passage in a
third of all texts is one stretch for the sorter.

Defined cases: a null or empty text has no bytes; texts of fewer bytes than a window
keep everything; repeated rows remove each other's bytes; extra columns pass through
``spans``; cut characters stay cut, as the kept bytes are binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightgrid.llm._store import cut
from flightgrid.llm._words import chunks, hash_spans, mix, text_bytes
from flightgrid.llm.induced_sort import suffix_order

#: Base of the rolling hash and its inverse modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each place."""
    n = len(data)
    if n < gram:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[data] * _powers(BASE, n), out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * _powers(INVERSE, n - gram + 1))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` consecutive values."""
    n = len(a) - w + 1
    if n <= 0:
        return a[:0]
    blocks = np.concatenate([a, np.full(-len(a) % w, np.iinfo(a.dtype).max, a.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def _places(h: np.ndarray, w: int, bits: int = 24) -> np.ndarray:
    """The place of the least (leftmost) of each ``w`` consecutive hashes.  Of a hash all
    but ``bits`` bits count, whatever the length, so that equal runs have equal places."""
    low, most = np.uint64(bits), np.uint64((1 << bits) - 1)
    out, step = [np.zeros(0, np.int64)], (1 << bits) - w
    for at in range(0, len(h) - w + 1, step):
        part = h[at : at + step + w - 1]
        least = sliding_min((part >> low << low) | np.arange(len(part), dtype=np.uint64), w)
        out.append((least & most).astype(np.int64) + at)
    return np.concatenate(out)


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts end to end: text, anchor hash, first byte and end of the stretch that
    the windows of each anchor cover, from the text's start, and the stretch's hash."""
    n = int(offsets[-1])
    h = grams(data[:n], gram)
    windows = n - width + 1
    none = np.zeros(0, np.int64)
    if windows <= 0:
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    place = _places(h, width - gram + 1)
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    fits = np.arange(windows) + width <= offsets[text + 1]
    at = np.flatnonzero(fits)
    if not len(at):
        return none, np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint64)
    new = np.append(True, (place[at][1:] != place[at][:-1]) | (text[at][1:] != text[at][:-1]))
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
    start, end, t = first, last + width, text[first]
    # Anchors have the same bytes whatever the slice: their full hash.
    key = h[place[first]]
    whole = hash_spans(data, start, end) ^ mix((place[first] - start).astype(np.uint64))
    return t, key, start - offsets[t], end - offsets[t], whole


def _row_key(key: str, text: str) -> Column:
    """The same for rows that are equal, which have equal spans."""
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def _stretches(rows: DataFrame, width: int, gram: int) -> DataFrame:
    """(row, anchor, a, b, whole) for every anchor of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            at = 0
            for part in chunks(batch, "text", 4 << 20):
                data, offsets = text_bytes(part.column(1))
                t, key, a, b, whole = anchors(data, offsets, width, gram)
                own = ids[at : at + part.num_rows]
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(own[t]), pa.array(key.view(np.int64)), pa.array(a), pa.array(b), pa.array(whole.view(np.int64))], ["row", "anchor", "a", "b", "whole"])

    return rows.mapInArrow(run, "row long, anchor long, a long, b long, whole long")


def _repeated_in_shard(width: int, memory: int):
    """Repeated windows among the stretches of a shard."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        raw = [x.as_py() for x in t["bytes"]]
        sizes = np.array([len(x) for x in raw], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        # 0 ends the text, 1 ends a stretch, bytes follow.
        text = np.ones(int(sizes.sum()) + len(raw) + 1, np.int64)
        text[-1] = 0
        inside = np.ones(len(text), bool)
        inside[np.append(starts + sizes, len(text) - 1)] = False
        text[inside] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64) + 2
        del raw
        sa, shared = suffix_order(text, width, memory)
        hit = shared >= width
        near = hit.copy()
        near[:-1] |= hit[1:]
        at = np.sort(sa[near])
        of = np.searchsorted(starts, at, side="right") - 1
        fine = at + width <= starts[of] + sizes[of]
        at, of = at[fine], of[fine]
        if not len(at):
            return pa.table({"row": pa.array([], pa.int64()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        new = np.append(True, (np.diff(at) != 1) | (np.diff(of) != 0))
        first, last = at[new], at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        o = of[new]
        base = t["a"].to_numpy()[o] - starts[o]
        return pa.table({"row": t["row"].to_numpy()[o], "a": first + base, "b": last + width + base})

    return run


def _among(rows: DataFrame, keys: DataFrame, on: list[str], share: int) -> DataFrame:
    """``rows`` whose ``on`` is in ``keys`` (one row a key; n: how many rows it has).
    Keys of more than ``share`` rows, of which there are few, are broadcast, so no
    task gets all rows of one of them; the others are joined by a shuffle."""
    hot = F.broadcast(keys.where(F.col("n") > share).select(*on))
    rest = rows.join(hot, on, "left_anti").join(keys.where(F.col("n") <= share).select(*on), on, "left_semi")
    return rows.join(hot, on, "left_semi").unionByName(rest)


def _attached(docs: DataFrame, small: DataFrame, values: str, most: int) -> DataFrame:
    """``docs`` with the columns of ``small`` (one row a key): by a broadcast where its
    rows and the entries of its array ``values`` are ``most`` at most (some 60 bytes
    each), else by a shuffled join."""
    size = small.agg(F.coalesce(F.sum(F.size(values) + 1), F.lit(0))).first()[0]
    return docs.join(F.broadcast(small) if size <= most else small.hint("merge"), "row", "left")


def repeated(rows: DataFrame, width: int = 200, gram: int = 100, block: int = 1_024, shard_bytes: int = 1 << 20, memory: int = 1_000_000, most: int = 100_000) -> DataFrame:
    """(row, a, b) of repeated stretches of the texts of (row, text)."""
    found = cut(_stretches(rows, width, gram), "stretches")
    share = max(1, found.count() // (4 * max(1, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    often = cut(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    some = cut(_among(found, often, ["anchor"], share), "stretches-repeated")
    kinds = cut(some.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct("row", "a", "b")).alias("r")), "stretches-kinds")
    whole = _among(some, kinds.where("n > 1"), ["anchor", "whole"], share).select("row", "a", "b")
    # Anchors go where their first stretch lies: those of copies of a text stay near
    # one another, a block of it at a time, so that their stretches join.
    home = F.xxhash64(F.col("low.row"), F.floor(F.col("low.a") / block))
    several = kinds.groupBy("anchor").agg(F.count("*").alias("k"), F.min("r").alias("low")).where("k > 1").select("anchor", home.alias("home"))
    sort = kinds.join(several, "anchor").select("home", "r.row", "r.a", "r.b")
    # The bytes of the stretches to sort, from their texts.
    asked = cut(sort.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("home", "a", "b"))).alias("asked")), "stretches-asked")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"home": [], "row": [], "a": [], "bytes": []}
            held = 0
            for row, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode()
                runs: list[list[int]] = []
                for x in asked:
                    if runs and runs[-1][0] == x["home"] and x["a"] == runs[-1][2] - width + 1:
                        runs[-1][2] = x["b"]  # its windows follow at once
                    else:
                        runs.append([x["home"], x["a"], x["b"]])
                for home, a, b in runs:
                    for c, v in (("home", home), ("row", row), ("a", a), ("bytes", raw[a:b])):
                        out[c].append(v)
                    held += b - a
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict(out, schema=schema)
                    out, held = {c: [] for c in out}, 0
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    schema = pa.schema([("home", pa.int64()), ("row", pa.int64()), ("a", pa.int64()), ("bytes", pa.binary())])
    texts = _attached(rows, asked, "asked", most).where("asked is not null").select("row", "text", "asked")
    got = texts.mapInArrow(fetch, "home long, row long, a long, bytes binary")
    # Equal rows each bring the same stretches: one of them is enough.
    got = cut(got.dropDuplicates(["home", "row", "a"]), "stretches-bytes")
    total = got.agg(F.coalesce(F.sum(F.length("bytes")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    dealt = got.withColumn("shard", F.pmod(F.col("home"), F.lit(shards)))
    parts = dealt.groupBy("shard").applyInArrow(_repeated_in_shard(width, memory), "row long, a long, b long")
    return whole.unionAll(parts)


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 200, most: int = 100_000, out: str = "spans", **how: int) -> DataFrame:
    """``docs`` with ``out`` (array of a, b): the maximal removed runs of bytes."""
    kept = [c for c in docs.columns if c != out]
    keyed = docs.select(F.struct(*kept).alias("doc"), _row_key(key, text).alias("row"))
    rows = docs.where(F.octet_length(text) >= width).select(_row_key(key, text).alias("row"), F.col(text).alias("text"))
    found = repeated(rows, width, most=most, **how)
    merged = cut(found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")
    return _attached(keyed, merged, "spans", most).select("doc.*", F.col("spans").alias(out))


def _merged(found: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in found or ():
        if out and x["a"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x["b"])
        else:
            out.append([x["a"], x["b"]])
    return [(a, b) for a, b in out]


RESULT = "n_bytes long, n_removed long, n_spans long, kept binary"


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, **how: int) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans and the kept bytes (``digest``: their
    SHA-256 as kept_sha256 instead, and without the text)."""
    got = spans(docs, key, text, out="__spans", **how)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
    kept = [c for c in docs.columns if c not in names and not (digest and c == text)]
    schema = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(RESULT.replace("kept binary", "kept_sha256 string") if digest else RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                rows = []
                for t, found in zip(part.column(part.schema.get_field_index(text)).to_pylist(), part.column(part.schema.get_field_index("__spans")).to_pylist(), strict=True):
                    raw, gone = (t or "").encode(), _merged(found)
                    at, left = 0, []
                    for a, b in gone:
                        left.append(raw[at:a])
                        at = b
                    left.append(raw[at:])
                    rest = b"".join(left)
                    rows.append((len(raw), len(raw) - len(rest), len(gone), hashlib.sha256(rest).hexdigest() if digest else rest))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string() if digest else pa.binary())], [*kept, *names])

    return got.mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"), digest=True)
