"""SimHash near-duplicates joined on fuzzy keys of the binary Golay code.

Fingerprints of 64 bits come from word shingles.  Equal fingerprints are one node,
so copies never meet in a join.  A fingerprint is cut into segments of 22, 21 and
21 bits, and each, filled up to 23 bits, is decoded with the perfect (23, 12)
Golay code: within distance 3 of a word lies exactly one codeword; a word at
distance 3 from it also gets the five codewords at distance 4.  Any two words at
distance 2 or less then share a codeword.  Of two errors over three segments at
least one segment has none, so two fingerprints that link agree exactly in one
segment and share a codeword of the next: those are the join keys, 33 bits or
more each, at most 18 a fingerprint.  Joined pairs are verified bit by bit and
connected components are found by repeated contraction to the least neighbour,
with every round written to the shared folder.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like
any other; fewer words than a shingle make one shingle; repeated rows stay rows of
their own in the same class; an empty table gives an empty table; extra columns
pass through ``components``, but ``simhash`` and ``component_id``, which are replaced;
null ids count for a class only if it has no others (its id is null then), and
``keep_one`` keeps of a class the rows with its id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightgrid.llm._store import cut, remove, scratch_path

#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))


@cache
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every 23-bit remainder class (syndrome): the error of weight <= 3, and
    the weight-4 errors of the class (five for those of weight 3, else -1)."""
    unit = np.array([_syndrome(1 << i) for i in range(23)])
    leader = np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    fours: list[list[int]] = [[] for _ in range(2048)]
    for w in range(1, 5):
        for places in combinations(range(23), w):
            s, e = int(np.bitwise_xor.reduce(unit[list(places)])), sum(1 << p for p in places)
            if w < 4:
                leader[s], weight[s] = e, w
            elif weight[s] == 3:
                fours[s].append(e)
    table = np.full((2048, 5), -1, np.int64)
    for s, es in enumerate(fours):
        table[s, : len(es)] = es
    return leader, table


def _syndrome(word: int) -> int:
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << i - 11
    return word


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Of the low 12 and the high 11 bits of a word; their sum is the word's."""
    return np.array([_syndrome(i) for i in range(1 << 12)]), np.array([_syndrome(i << 12) for i in range(1 << 11)])


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (top 12 bits of the codeword) of each word's near codewords: one
    column for the nearest, five more that are -1 where there are none."""
    leader, fours = golay_tables()
    low, high = _syndromes()
    s = low[words & 4095] ^ high[words >> 12]
    errors = np.concatenate([leader[s][:, None], fours[s]], axis=1)
    return np.where(errors < 0, -1, (words[:, None] ^ np.maximum(errors, 0)) >> 11)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    k = min(width, len(words))
    n = len(words) - k + 1
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, starts[:n], ends[k - 1 :].tolist())), repeat(seed))
    h = np.fromiter(hashes, np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "simhash", width: int = 3) -> DataFrame:
    """``docs`` without its text and with a column ``out`` (bigint) of fingerprints."""
    kept = [c for c in docs.columns if c not in (text, out)]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.array([fingerprint(t.as_py(), width) for t in batch.column(batch.schema.get_field_index(text))], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(f.view(np.int64))], [*kept, out])

    return docs.mapInArrow(run, schema)


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, f) for each fuzzy key of each fingerprint ``f``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(f), 1 << 15):
                part = f[at : at + (1 << 15)]
                cuts = [(part >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
                for i in range(3):
                    code = codewords(cuts[(i + 1) % 3])
                    key = (i << 60) | (cuts[i][:, None] << 12) | np.maximum(code, 0)
                    ok = code >= 0
                    yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(np.broadcast_to(part[:, None], code.shape)[ok].view(np.int64))], ["key", "f"])

    return nodes.select("f").mapInArrow(run, "key long, f long")


def links(nodes: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that differ in ``most`` bits
    (2 at most, as the keys promise no more)."""
    if not 0 <= most <= 2:
        raise ValueError("keys cover up to two differing bits")
    # One row a key and fingerprint; keys of a single fingerprint link nothing.
    k = keyed(nodes)
    a, b = k.select("key", F.col("f").alias("a")), k.select("key", F.col("f").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most
    return a.join(b, "key").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable.  Large-star and small-star rounds
    (each node hands its neighbours to the least of them), until nothing changes;
    the rounds grow with the logarithm of the longest path."""
    spark = nodes.sparkSession
    edges = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    seen, path = None, scratch_path(spark, "edges-0")
    edges.write.parquet(path)
    edges = spark.read.parquet(path)
    for round_ in range(1, 200):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, go to the least.
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.col("v").alias("x"), "m").where("x <> m").unionAll(least.select(F.col("u").alias("x"), "m"))
        after = small.select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        old, path = path, scratch_path(spark, f"edges-{round_}")
        after.write.parquet(path)
        edges = spark.read.parquet(path)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, old)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("the components have not settled")
    return nodes.select("f").join(edges.select(F.col("u").alias("f"), F.col("v").alias("root")), "f", "left").select(F.col("f").alias("node"), F.coalesce("root", "f").alias("root"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2, width: int = 3) -> DataFrame:
    """``docs`` without its text, with ``simhash`` and ``component_id``: the least
    ``key`` of all documents reachable over links."""
    prints = cut(fingerprints(docs.drop("component_id"), text, width=width), "simhash")
    nodes = cut(prints.groupBy(F.col("simhash").alias("f")).agg(F.min(key).alias("least")), "simhash-nodes")
    roots = connected(nodes, links(nodes, most))
    named = nodes.join(roots.withColumnRenamed("node", "f"), "f")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = cut(named.join(least, "root").select(F.col("f").alias("simhash"), "component_id"), "simhash-classes")
    # A print of very many copies is one key: its rows are dealt over several tasks
    # by the join itself (the other side has one row a print).
    return prints.join(by_print, "simhash", "left").select(*prints.columns, "component_id")


def digests(docs: DataFrame) -> DataFrame:
    got = components(docs.select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose id is their component's (one of each class; of repeated
    rows with that id, all)."""
    found = components(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__doc")))
    return found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("__doc.*")
