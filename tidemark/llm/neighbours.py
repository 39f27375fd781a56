"""Operator 10: nearest neighbours by a block matrix join over int8 tiles."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table

K = 5
QUERY_EVERY = 50
QUERY_TILE = 1024  # queries that meet a stripe of candidates at once
STRIPE = 8192  # candidates of one stripe
_LEVELS = 127.0


def usable(vector: Column) -> Column:
    """True for a vector that is not null, not zero, and has only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Tile:
    """Vectors as rows: originals in double, unit vectors as int8 times a scale, and how far that is off."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        # by the largest component first: very large and very small vectors keep a finite norm
        self.top = np.abs(vectors).max(axis=1, keepdims=True)
        self.scaled = vectors / self.top
        self.norms = np.sqrt((self.scaled * self.scaled).sum(axis=1))
        unit = self.scaled / self.norms[:, None]
        self.scale = np.abs(unit).max(axis=1) / _LEVELS
        self.codes = np.rint(unit / self.scale[:, None]).astype(np.int8)
        rebuilt = self.codes * self.scale[:, None]
        self.error = np.sqrt(((unit - rebuilt) ** 2).sum(axis=1))
        self.length = np.sqrt((rebuilt * rebuilt).sum(axis=1))


def quantised_scores(queries: Tile, candidates: Tile) -> tuple[np.ndarray, np.ndarray]:
    """(score, error bound) of every pair from int8 products.

    Products of at most 512 dimensions are summed in float32, where they stay below 2^24 and so are exact.
    With u = u' + e and v = v' + f: |uv - u'v'| <= |e| |v| + |u'| |f|.
    """
    total = np.zeros((len(queries.ids), len(candidates.ids)))
    for a in range(0, queries.codes.shape[1], 512):
        total += queries.codes[:, a:a + 512].astype(np.float32) @ candidates.codes[:, a:a + 512].astype(np.float32).T
    total *= queries.scale[:, None] * candidates.scale[None, :]
    bound = queries.error[:, None] + queries.length[:, None] * candidates.error[None, :] + 1e-9
    return total, bound


def cosines(u: Tile, i: np.ndarray, v: Tile, j: np.ndarray) -> np.ndarray:
    """Cosine of pairs in double precision; a pair's value doesn't depend on the others."""
    dots = (u.scaled[i] * v.scaled[j]).sum(axis=1)
    return np.clip(dots / (u.norms[i] * v.norms[j]), -1.0, 1.0)


def search_tile(queries: Tile, candidates: Tile, k: int, heaps: dict[int, list]) -> None:
    """Merge a tile's nearest pairs into the queries' heaps of (score, -id)."""
    score, bound = quantised_scores(queries, candidates)
    low = score - bound
    if low.shape[1] > k:  # one place more, as the query itself may be among the candidates
        floor = np.partition(low, -min(k + 1, low.shape[1]), axis=1)[:, -min(k + 1, low.shape[1])]
    else:
        floor = np.full(len(queries.ids), -np.inf)
    held = np.array([heaps[q][0][0] if len(heaps.get(q, ())) == k else -np.inf for q in range(len(queries.ids))])
    i, j = np.nonzero(score + bound >= np.maximum(floor, held)[:, None])
    other = queries.ids[i] != candidates.ids[j]
    i, j = i[other], j[other]
    for at in range(0, len(i), 1 << 18):
        a, b = i[at:at + (1 << 18)], j[at:at + (1 << 18)]
        for q, value, vec in zip(a.tolist(), cosines(queries, a, candidates, b).tolist(), candidates.ids[b].tolist()):
            heap = heaps.setdefault(q, [])
            if len(heap) < k:
                heapq.heappush(heap, (value, -vec))
            elif (value, -vec) > heap[0]:
                heapq.heapreplace(heap, (value, -vec))


def _matrix(pdf: pd.DataFrame) -> Tile:
    return Tile(pdf["vec_id"].to_numpy(np.int64), np.stack(pdf["vector"].to_list()).astype(np.float64))


def _search(k: int, tile: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # tiles of one stripe and one block of queries; the sizes differ only by how evenly the ids hash
        rows = []
        asked, held = pdf[pdf["query"]], pdf[~pdf["query"]]
        if len(asked) and len(held):
            queries, heaps = _matrix(asked), {}
            for a in range(0, len(held), tile):
                search_tile(queries, _matrix(held.iloc[a:a + tile]), k, heaps)
            rows = [(int(queries.ids[q]), -v, s) for q, heap in heaps.items() for s, v in heap]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    return run


def _merge(k: int):
    """Rows sorted by query -> its k best, in order. One heap is held at a time."""

    def run(batches):
        query, heap = None, []

        def ranked():
            return [(query, rank, -v, s) for rank, (s, v) in enumerate(sorted(heap, reverse=True), 1)]

        for pdf in batches:
            out = []
            for q, vec, s in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist()):
                if q != query:
                    out += ranked()
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (s, -vec))
                elif (s, -vec) > heap[0]:
                    heapq.heapreplace(heap, (s, -vec))
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
        yield pd.DataFrame(ranked(), columns=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            query_tile: int = QUERY_TILE, stripe: int = STRIPE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where `queries` holds, its k nearest other rows by cosine.

    Candidates are dealt into stripes and queries into blocks by a hash of the id; every (stripe, block) pair is one
    group of at most about stripe + query_tile rows, so memory is bounded and the work is spread evenly however alike
    the vectors are. int8 products with an error bound rule out what cannot be among a query's k; the rest is computed
    in double on the original vectors. The result is exact. Ties go to the smaller id. Of many equal vectors only those
    of the smallest ids are candidates: the others can't be among any query's k nearest.

    Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without id.
    Of rows that repeat an id the smallest vector counts. Vectors of different length are compared with their like
    only. Other columns are ignored, whatever their names.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), F.coalesce(queries, F.lit(False)).alias("query"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))).groupBy("vec_id").agg(F.min("vector").alias("vector"), F.max("query").alias("query"))
    rows = rows.withColumn("size", F.size("vector"))
    counts = rows.agg(F.count(F.lit(1)), F.sum(F.col("query").cast("int"))).first()
    stripes, blocks = max(1, -(-counts[0] // stripe)), max(1, -(-(counts[1] or 0) // query_tile))

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    hashed = F.xxhash64("vec_id")
    # equal vectors tie for every query, so only the k + 1 smallest ids of one vector can be among the k nearest
    equal = Window.partitionBy("vector").orderBy("vec_id")
    first = rows.withColumn("n", F.row_number().over(equal)).filter(F.col("n") <= k + 1)
    held = first.select("vec_id", "vector", "size", F.lit(False).alias("query"), F.pmod(hashed, F.lit(stripes)).cast("int").alias("stripe"), numbers(blocks).alias("block"))
    asked = rows.filter("query").select("vec_id", "vector", "size", "query", numbers(stripes).alias("stripe"), F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"))
    found = held.unionByName(asked).groupBy("size", "stripe", "block").applyInPandas(_search(k, stripe // 4), "query_id long, vec_id long, score double")
    dealt = found.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInPandas(_merge(k), "query_id long, rank int, vec_id long, score double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
