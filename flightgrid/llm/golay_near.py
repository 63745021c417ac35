"""Near copies (word shingles, Jaccard similarity) by Golay keys of long SimHashes.

The operator of golay_simhash links fingerprints of two differing bits at most; texts
whose shingle sets have a similarity of 0.8 differ in up to 0.152 of all bits, which is
ten of 64.  Here a fingerprint has 512 bits, from the distinct five-word shingles.
Each of ``tables`` tables draws 23 bits of it, which the Golay code decodes to nearby
codewords (golay_simhash.codewords), and as many bits that must agree as the number of
nodes has (13 at least), so that chance meetings grow with the nodes and not with their
square; the keys of both sides are joined.  Candidates are verified: first by the bits of
the whole fingerprint (``loose``), then exactly, by the Jaccard similarity of the shingles
of both whole texts.  This first path is probabilistic; it only has to join most of each
class cheaply.

The second path is complete.  Of a text's n shingles, in an order that is the same for
all texts, the first n - ceil(least * n) + 1 are its prefix; two texts of similarity
``least`` or more share a shingle of both prefixes.  All pairs of nodes that share one and
that the first path left in different classes are candidates, unless a proven bound
excludes them: the sizes; the places of a shared shingle; the number of shared prefix
shingles (of the prefix that ends first, only those can be missing on the other side that
the similarity lets be missing at all); or the parities of the counts of shingles in 512
cells (cells that differ are at most as many as shingles of one side only).  What is left
is verified exactly, so that the classes are those of all pairs.

The order is that of the hashes, but for hot shingles, which come last: those that are in
more than a 500,000th of all prefix rows (``hot`` at least) by the hashes alone.  There are
fewer than 500,000 of them at any size (4 MB), so they are sent to the executors, and
prefixes that hold one are made again.  So a passage that a third of all documents share is in
almost no prefix, and only documents that consist of hot passages meet by them.

Texts with equal fingerprints and equal shingles are one node (named by a hash of its
distinct shingles), so copies never meet.  In the first path, a bucket of at most
``small`` nodes pairs all; larger ones, which only groups of many different near copies
make, pair each node with the least one of its bucket in the table's own order.  In the
second, the rows of a bucket's largest class never meet each other, and a bucket with
more than ``small`` rows outside it takes new heads first: one of the largest class and
one of the others, until the pairs that are left over don't halve any more.  Those are
then all bounded or verified, so no pair depends on a head.

Defined cases: null, empty and blank texts have no shingles and are copies of each
other; fewer words than a shingle make one shingle; A-Z are lower-cased; repeated rows
stay together (all kept or none); ids are integers, or strings of digits; a null id comes after all others; extra columns pass
through; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightgrid.llm._store import cut
from flightgrid.llm._words import LOWER, SPACED, chunks, hash_spans, mix, split, text_bytes
from flightgrid.llm.golay_simhash import codewords, connected

LANES = 8
#: Bits of a key below the number of its table.
TABLE = 56
BITS = 64 * LANES
CODE, EXACT = 23, 13
#: Hot shingles are in more than this part of all prefix rows.
SHARE = 500_000
#: The bit of a prefix key that puts hot shingles last.
LAST = 1 << 62
SALTS = mix(np.arange(1, LANES + 1, dtype=np.uint64))
PLACES = mix(np.arange(101, 164, dtype=np.uint64)) | np.uint64(1)
PRINT = [f"p{i}" for i in range(LANES)]
CELLS = [f"q{i}" for i in range(LANES)]


def shingle_sets(col: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(col)
    data = LOWER[data]
    starts, ends, doc = split(data, offsets, SPACED)
    h = hash_spans(data, starts, ends)
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        k = min(width, b - a)
        n = b - a - k + 1 if k else 0
        s = np.full(n, k, np.uint64)
        for j in range(k):
            s += mix(h[a + j : a + j + n] * PLACES[j])
        out.append(np.unique(mix(s)))
    return out


def long_print(shingles: np.ndarray) -> np.ndarray:
    """Majority bits of ``LANES`` hashes of each shingle."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), 1 << 12):
        lanes = mix(shingles[at : at + (1 << 12), None] ^ SALTS[None, :])
        ones += np.unpackbits(lanes.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in ``BITS`` cells."""
    counts = np.bincount((shingles >> np.uint64(3)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((counts & 1).astype(bool), bitorder="little").view(np.int64)


def prefix(shingles: np.ndarray, least: float, hot: np.ndarray | None = None) -> np.ndarray:
    """The first shingles in the common order, of which two sets of similarity ``least``
    share one; ``hot`` is sorted."""
    n = len(shingles)
    keys = (shingles >> np.uint64(2)).view(np.int64)
    if hot is not None and len(hot):
        keys = np.sort(np.where(hot[np.searchsorted(hot[:-1], keys)] == keys, keys | LAST, keys))
    return keys[: n - int(np.ceil(least * n - 1e-6)) + 1]


def fewest(least: float, a: Column, b: Column) -> Column:
    """Prefix shingles that two sets of ``a`` and ``b`` shingles share at the least."""
    return F.ceil(least / (1 + least) * (a + b) - 1e-6) - F.ceil(least * F.greatest(a, b) - 1e-6) + 1


def prints(docs: DataFrame, width: int, least: float) -> DataFrame:
    """(id, row, f, n, p0..p7, q0..q7, keys): ``row`` names equal rows, ``f`` equal
    shingle sets; ``n`` shingles, their fingerprint, parities and prefix."""
    names = ["id", "row", "f", "n", *PRINT, *CELLS, "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                sets = shingle_sets(part.column(2), width)
                p = np.stack([np.concatenate([long_print(s), parities(s)]) for s in sets])
                n = np.array([len(s) for s in sets], np.int64)
                f = np.array([np.bitwise_xor.reduce(mix(s)) ^ mix(np.array([len(s)], np.uint64))[0] for s in sets], np.uint64)
                keys = pa.array([prefix(s, least) for s in sets], pa.list_(pa.int64()))
                lanes = (pa.array(p[:, i]) for i in range(2 * LANES))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(f.view(np.int64)), pa.array(n), *lanes, keys], names)

    return docs.select("id", "row", "text").mapInArrow(run, "id long, row long, f long, n long, " + "".join(f"{p} long, " for p in PRINT + CELLS) + "keys array<long>")


def keyed(nodes: DataFrame, tables: int, agree: int) -> DataFrame:
    """(key, f) for every table and near codeword of each node; ``agree`` exact bits."""
    draws = [np.random.default_rng(t).permutation(BITS)[: CODE + agree] for t in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 12):
                part = batch.slice(at, 1 << 12)
                p = np.stack([part.column(i + 1).to_numpy() for i in range(LANES)], axis=1)
                bits = np.unpackbits(np.ascontiguousarray(p).view(np.uint8), axis=1, bitorder="little")
                f = part.column(0).to_numpy()
                for t, draw in enumerate(draws):
                    code = codewords(bits[:, draw[:CODE]].astype(np.int64) @ (1 << np.arange(CODE)))
                    exact = bits[:, draw[CODE:]].astype(np.int64) @ (1 << np.arange(agree))
                    ok = code >= 0
                    key = (t << TABLE) | (exact[:, None] << 12) | np.maximum(code, 0)
                    yield pa.RecordBatch.from_arrays([pa.array(key[ok]), pa.array(np.broadcast_to(f[:, None], code.shape)[ok])], ["key", "f"])

    return nodes.select("f", *PRINT).mapInArrow(run, "key long, f long")


def candidates(nodes: DataFrame, tables: int, small: int, loose: int) -> DataFrame:
    """Distinct (a, b), a < b, of nodes that share a key and differ in ``loose`` bits
    at most."""
    agree = max(EXACT, nodes.count().bit_length())
    sizes = keyed(nodes, tables, agree).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut(keyed(nodes, tables, agree).join(sizes, "key"), "near-keys")
    few, many = rows.where(F.col("n") <= small), rows.where(F.col("n") > small)
    pairs = few.select("key", F.col("f").alias("a")).join(few.select("key", F.col("f").alias("b")), "key").where("a < b").select("a", "b")
    # The least node by an order of the table's own; counted before the shuffle.
    table = F.shiftright("key", TABLE)
    heads = many.groupBy("key").agg(F.min(F.struct(F.xxhash64("f", table).alias("o"), "f")).alias("h")).select("key", F.col("h.f").alias("head"))
    star = many.join(heads, "key").where("f <> head").select(F.least("f", "head").alias("a"), F.greatest("f", "head").alias("b"))
    pairs = pairs.unionAll(star).distinct()
    return with_both(pairs, nodes, PRINT).where(apart(PRINT) <= loose).select("a", "b")


def with_both(pairs: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """``pairs`` with the columns ``names`` of both nodes, as a_... and b_..."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("f").alias(side), *(F.col(x).alias(f"{side}_{x}") for x in names)), side)
    return pairs


def apart(names: list[str]) -> Column:
    """Bits in which the lanes ``names`` of a and b differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"a_{x}").bitwiseXOR(F.col(f"b_{x}"))) for x in names))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, least: float, counted: bool = False) -> DataFrame:
    """(a, b) of ``pairs`` whose texts have a similarity of ``least`` or more; shared
    prefix shingles have been ``counted`` before, or are here."""
    # Texts of that similarity differ in so many shingles at most.
    a, b = F.col("a_n"), F.col("b_n")
    most = (1 - least) / (1 + least) * (a + b) + 1e-6
    alike = (apart(CELLS) <= most) & (F.least(a, b) >= least * F.greatest(a, b) - 1e-6)
    found = with_both(pairs, nodes, ["n", *CELLS]).where(alike).select("a", "b", "a_n", "b_n")
    if not counted:
        found = with_both(found, nodes, ["keys"]).where(F.size(F.array_intersect("a_keys", "b_keys")) >= fewest(least, a, b))
    found = cut(found.select("a", "b"), "near-candidates")
    asked = found.select(F.col("a").alias("f")).unionAll(found.select(F.col("b").alias("f"))).distinct()
    texts = docs.join(nodes.select("f", "row").join(asked, "f"), "row").select("f", "text").dropDuplicates(["f"])
    texts = cut(texts, "near-texts")
    both = found.join(texts.select(F.col("f").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("f").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                x, y = shingle_sets(part.column(2), width), shingle_sets(part.column(3), width)
                same = np.array([len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y, strict=True)], np.int64)
                size = np.array([len(s) + len(t) for s, t in zip(x, y, strict=True)], np.int64)
                near = pa.array(same >= least * (size - same))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(near), part.column(1).filter(near)], ["a", "b"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def with_hot_last(docs: DataFrame, nodes: DataFrame, width: int, least: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with the prefixes in the common order, and the rows of each key."""
    counts = cut(nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "near-counts")
    rows = nodes.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    many = counts.where(F.col("m") > max(hot, rows // SHARE)).select("key")  # under SHARE rows
    keys = np.sort(many.toArrow().column("key").to_numpy())
    if not len(keys):
        return nodes, counts
    sent = nodes.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 4 << 20):
                new = [prefix(s, least, sent.value) for s in shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(new, pa.list_(pa.int64()))], ["row", "new"])

    hit = nodes.select("row", F.explode("keys").alias("key")).join(F.broadcast(many), "key").select("row").distinct()
    again = docs.join(hit, "row", "left_semi").dropDuplicates(["row"]).mapInArrow(run, "row long, new array<long>")
    nodes = cut(nodes.join(again, "row", "left").withColumn("keys", F.coalesce("new", "keys")).drop("new"), "near-nodes")
    return nodes, nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("m")).where("m > 1")


def shared_prefixes(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, f, n, at) of the shingles that are in the prefixes of several nodes."""
    rows = nodes.select("f", "n", F.posexplode("keys").alias("at", "key"))
    return cut(rows.join(counts.select("key"), "key").select("key", "f", "n", "at"), "near-prefixes")


def divided(shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``shared`` with their class, and (key, root, rows, of, main) of the keys
    of several classes: rows of the class and of the key, and whether it is the largest."""
    named = shared.join(roots.select(F.col("node").alias("f"), "root"), "f")
    each = named.groupBy("key", "root").agg(F.count("*").alias("rows"))
    whole = each.groupBy("key").agg(F.sum("rows").alias("of"), F.count("*").alias("classes"), F.max(F.struct("rows", "root")).alias("top")).where("classes > 1")
    parts = cut(each.join(whole, "key").select("key", "root", "rows", "of", (F.col("root") == F.col("top.root")).alias("main")), "near-parts")
    return cut(named.join(parts.select("key", "root", "main"), ["key", "root"]), "near-divided"), parts


def crossing(rows: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b), a < b, of different classes that share a key and that neither
    their sizes nor the places and the number of their shared keys exclude."""
    x, y = (rows.select("key", *(F.col(c).alias(f"{s}_{c}") for c in ("f", "n", "at", "root", "main"))) for s in "xy")
    once = F.col("y_main") | (F.col("x_f") < F.col("y_f"))
    low, high = F.least("x_n", "y_n"), F.greatest("x_n", "y_n")
    # Shared shingles: those before the key, the key and those after it, at most.
    most = F.least("x_at", "y_at") + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    near = (low >= least * high - 1e-6) & (most >= least / (1 + least) * (low + high) - 1e-6)
    both = x.where("not x_main").join(y, "key").where(once & (F.col("x_root") != F.col("y_root")) & near)
    # Rows of two similar texts pass at every shared key, so that their number is whole.
    pairs = both.groupBy(F.least("x_f", "y_f").alias("a"), F.greatest("x_f", "y_f").alias("b")).agg(F.count("*").alias("shared"), F.min(low).alias("low"), F.max(high).alias("high"))
    return pairs.where(F.col("shared") >= fewest(least, F.col("low"), F.col("high"))).select("a", "b")


def stars(rows: DataFrame, parts: DataFrame, small: int, turn: int) -> tuple[DataFrame, int]:
    """Pairs of the rows of wide keys with the heads of a turn, and the pairs that these
    keys would cost ``crossing``."""
    outside = parts.where("not main").groupBy("key").agg(F.sum("rows").alias("outside"), F.first("of").alias("of"))
    wide = outside.where(F.col("outside") > small)
    cost = wide.agg(F.sum(F.col("outside") * F.col("of"))).first()[0] or 0
    many = rows.join(wide.select("key"), "key")
    heads = many.groupBy("key", "main").agg(F.min(F.struct(F.xxhash64("f", "key", F.lit(turn)).alias("o"), "f", "root")).alias("h")).select("key", F.col("h.f").alias("head"), F.col("h.root").alias("of_root"))
    star = many.join(heads, "key").where("root <> of_root")
    return star.select(F.least("f", "head").alias("a"), F.greatest("f", "head").alias("b")).distinct(), cost


def classes(docs: DataFrame, nodes: DataFrame, width: int, least: float, tables: int, small: int, loose: int, hot: int) -> DataFrame:
    """(node, root) of the classes that all pairs of similarity ``least`` or more make."""
    nodes, counts = with_hot_last(docs, nodes, width, least, hot)
    links = cut(verified(docs, nodes, candidates(nodes, tables, small, loose), width, least), "near-links")
    shared = shared_prefixes(nodes, counts)
    rows, parts = divided(shared, cut(connected(nodes, links), "near-roots"))
    star, cost = stars(rows, parts, small, 0)
    for turn in count(1):
        if not cost:
            break
        links = links.unionAll(cut(verified(docs, nodes, star, width, least), "near-links"))
        rows, parts = divided(shared, cut(connected(nodes, links), "near-roots"))
        before = cost
        star, cost = stars(rows, parts, small, turn)
        if 2 * cost > before:
            break
    return connected(nodes, links.unionAll(verified(docs, nodes, crossing(rows, least), width, least, counted=True)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, least: float = 0.8, tables: int = 8, small: int = 64, loose: int = 104, hot: int = 50) -> DataFrame:
    """``docs`` with the rows of least ``key`` of each class of near copies."""
    name = F.xxhash64(F.col(key).isNull(), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text).isNull(), F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(key).cast("long").alias("id"), name.alias("row"), F.col(text).alias("text"))
    found = cut(prints(rows, width, least), "near-prints")
    same = ["n", *PRINT, *CELLS, "keys"]
    nodes = cut(found.groupBy("f").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("low"), *(F.first(x).alias(x) for x in same)).select("f", "low", F.col("low.row").alias("row"), *same), "near-nodes")
    roots = classes(rows.select("row", "text"), nodes, width, least, tables, small, loose, hot)
    chosen = roots.join(nodes.select(F.col("f").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.row").alias("__row"))
    return docs.select(F.struct(*docs.columns).alias("__doc"), name.alias("__row")).join(chosen.distinct(), "__row", "left_semi").select("__doc.*")
