"""Nearest neighbours by vantage-point trees, one tree a shard.

Vectors are compared by their cosine, in double precision.  On unit vectors the
chord is a metric that falls as the cosine rises, so a tree of chords prunes by the
triangle inequality.  A subtree is skipped where the query's distance to it must
exceed ``factor`` times the distance of the worst neighbour kept so far: factor one
is exact, a smaller one skips more and may miss some.

Vectors are dealt by the hash of their id into shards of about ``shard_rows``, and
queries into blocks of about ``block_rows``; a task gets one shard and one block, so
its memory is bounded, and the best of all shards are merged.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components
take no part, as query or candidate; vectors of other lengths are never compared;
equal scores are ordered by the smaller id; repeated rows are candidates of their own,
but a row with the query's id is never its candidate; an empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 256
#: Rounding allowance when subtrees are skipped.
SLACK = 1e-7


@dataclass
class Node:
    rows: np.ndarray
    vantage: np.ndarray | None = None
    radius: float = 0.0
    kids: list = field(default_factory=list)


class VpTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 0):
        self.ids, self.x = ids, vectors
        self.norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.unit = vectors / self.norm[:, None]
        self.root = self._build(np.arange(len(ids)), np.random.default_rng(seed))

    def _build(self, rows: np.ndarray, rng: np.random.Generator) -> Node:
        if len(rows) <= LEAF:
            return Node(rows)
        v = self.unit[rows[rng.integers(len(rows))]]
        d = chord(self.unit[rows] @ v)
        radius = float(np.median(d))
        near = d <= radius
        if near.all():  # over half of the rows lie at one distance
            near = d < radius
            if not near.any():
                return Node(rows)
        return Node(rows, v, radius, [self._build(rows[near], rng), self._build(rows[~near], rng)])

    def search(self, qid: np.ndarray, q: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k nearest of each query (-inf where there are fewer)."""
        qn = np.sqrt(np.einsum("ij,ij->i", q, q))
        unit = q / qn[:, None]
        score, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)

        def leaf(rows: np.ndarray, who: np.ndarray) -> None:
            for at in range(0, len(rows), 2048):  # a leaf of equal vectors can be large
                r = rows[at : at + 2048]
                s = np.einsum("qd,md->qm", q[who], self.x[r]) / (qn[who][:, None] * self.norm[r][None])
                s[self.ids[r][None] == qid[who][:, None]] = -np.inf
                s = np.concatenate([score[who], s], axis=1)
                i = np.concatenate([found[who], np.broadcast_to(self.ids[r], (len(who), len(r)))], axis=1)
                i[s == -np.inf] = np.iinfo(np.int64).max
                best = np.lexsort((i, -s), axis=1)[:, :k]
                score[who], found[who] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)

        def visit(node: Node, who: np.ndarray) -> None:
            if not len(who):
                return
            if not node.kids:
                return leaf(node.rows, who)
            d = chord(unit[who] @ node.vantage)
            inside = d <= node.radius
            for side in (True, False):
                mine, gap = who[inside == side], np.abs(d - node.radius)[inside == side]
                visit(node.kids[0 if side else 1], mine)
                worst = chord(np.maximum(score[mine, -1], -1.0))
                visit(node.kids[1 if side else 0], mine[gap <= factor * worst + SLACK])

        visit(self.root, np.arange(len(q)))
        return score, found


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosine, 0.0))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    flat = col.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy().reshape(len(flat), -1).astype(np.float64)


def valid(df: DataFrame, vector: str) -> DataFrame:
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return df.where(x.isNotNull() & F.coalesce(fine, F.lit(False)))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 32_768, block_rows: int = 4_096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of each query."""
    def take(df: DataFrame) -> DataFrame:
        df = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
        return valid(df.where("id is not null"), "x").withColumn("dim", F.size("x"))

    # Equal rows of a query are one; rows of one id with other vectors are searched apart.
    c, q = take(candidates), take(queries).dropDuplicates(["id", "x"]).withColumn("row", F.xxhash64("x"))
    shards = max(1, -(-c.count() // shard_rows))
    blocks = max(1, -(-q.count() // block_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = c.select("dim", deal(shards, 1).cast("int").alias("shard"), numbers(blocks).alias("block"), "id", "x")
    right = q.select("dim", numbers(shards).alias("shard"), deal(blocks, 2).cast("int").alias("block"), "id", "row", "x")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not (a.num_rows and b.num_rows):
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        a = a.sort_by("id")
        tree = VpTree(a["id"].to_numpy(), _matrix(a["x"]))
        qid = b["id"].to_numpy()
        score, found = tree.search(qid, _matrix(b["x"]), k, factor)
        ok = score > -np.inf
        return pa.table({"query_id": np.repeat(qid, k)[ok.ravel()], "row": np.repeat(b["row"].to_numpy(), k)[ok.ravel()], "vec_id": found[ok], "score": score[ok]})

    got = left.groupBy("dim", "shard", "block").cogroup(right.groupBy("dim", "shard", "block")).applyInArrow(run, "query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digests(embeddings: DataFrame, factor: float = 1.0) -> DataFrame:
    return nearest(embeddings, embeddings.where("vec_id % 50 = 0"), factor=factor)


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as x from embeddings
  where embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s as (
  select q.vec_id as query_id, q.x, c.vec_id, list_dot_product(q.x, c.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(c.x, c.x))) as score
  from (select distinct vec_id, x from v) q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x)
),
r as (select *, row_number() over (partition by query_id, x order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 5
"""
