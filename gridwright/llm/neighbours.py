"""Approximate nearest neighbours by cosine: an inverted file of coarse centroids with product-quantised residuals.

Vectors are scaled to unit length. A bounded sample fits the centroids and, on what is left after subtracting a vector's
centroid, one codebook for each subspace. Every row is then listed under its centroid, with its codes. A query visits its
nearest lists; there, a table of products of the query's parts with all codewords gives the distance to each listed row by
look-ups alone. The rows nearest by code, over all lists of a query, are ranked again by the exact cosine.

The index is dealt out in shards by hash, each with a part of every list, so that no list, however long, is one task; the
queries are dealt out in chunks, and a task scans one shard for one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.session import save


#: Rows that fit the index, drawn by hash, of which a list is fitted on SAMPLE_EACH at least; rounds of k-means.
SAMPLE, SAMPLE_EACH, ROUNDS = 32_768, 16, 12
#: Subspaces and codewords of each.
PARTS, WORDS = 16, 256
#: Rows of a shard and queries of a chunk at most; shards and chunks that even small inputs are dealt out in.
SHARD, CHUNK, SHARDS, CHUNKS = 262_144, 32_768, 8, 4
#: Queries that are scanned at a time.
STEP = 64
#: Share of the lists that a query visits, and lists at least.
PROBED, LEAST_PROBES = 0.5, 24


def reranked(n: int) -> int:
    """Rows that are ranked exactly for each query, of n: errors of codes grow slowly with the number of rows."""
    return max(20, round(4 * n ** (1 / 3)))


@dataclass
class Codec:
    centroids: np.ndarray  # (lists, dimension)
    books: list[np.ndarray]  # for each subspace (words, its dimension)
    cuts: np.ndarray

    def lists(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[lists]
        return np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)

    def bias(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What a row adds to its distance from any query: with centroid c and coded rest r, |q - c - r|^2 = |q|^2 + |c + r|^2 - 2 q.c - 2 q.r."""
        whole = self.centroids[lists] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return (whole**2).sum(axis=1)

    def probed(self, q: np.ndarray, probes: int) -> np.ndarray:
        """(queries, lists) booleans: the lists that each query visits."""
        far = (self.centroids**2).sum(axis=1) / 2 - q @ self.centroids.T
        out = np.ones(far.shape, bool)
        if probes < far.shape[1]:
            out[:] = False
            np.put_along_axis(out, np.argpartition(far, probes - 1, axis=1)[:, :probes], True, axis=1)
        return out

    def distances(self, q: np.ndarray, lists: np.ndarray, codes: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """(rows, queries): squared distances by look-ups in the queries' tables, less the queries' own squares."""
        out = (bias[:, None] - 2 * (self.centroids @ q.T)[lists]).astype(np.float32)
        for p, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out -= (2 * book @ q[:, a:b].T).astype(np.float32)[codes[:, p]]
        return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, c)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(count)
        c[full] = np.add.reduceat(x[order], np.r_[0, np.cumsum(count[full])[:-1]], axis=0) / count[full][:, None]
    return c


def fit(sample: np.ndarray, lists: int, seed: int = 0) -> Codec:
    """From unit vectors, one at least."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    centroids = kmeans(sample, lists, rng)
    rest = sample - centroids[nearest(sample, centroids)]
    cuts = np.linspace(0, sample.shape[1], min(PARTS, sample.shape[1]) + 1).round().astype(int)
    return Codec(centroids, [kmeans(rest[:, a:b], WORDS, rng) for a, b in zip(cuts, cuts[1:])], cuts)


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two that keeps its squares from overflowing; this rounds nothing."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of rows of x with q, both scaled(). Each row is summed in the same order, so equal rows have equal cosines."""
    return (x * q).sum(axis=1) / (np.sqrt((x**2).sum(axis=1)) * np.sqrt((q**2).sum()))


BASE = "list int, id long, q boolean, bias double, codes binary, vector array<double>"
FOUND = "query_id long, vec_id long, far float"
HITS = "query_id long, rank int, vec_id long, score double"


def scanned(codec: Codec, probes: int, keep: int, ids: np.ndarray, lists: np.ndarray, codes: np.ndarray, bias: np.ndarray, names: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance by code) of the `keep` ids nearest to each query among the rows of the lists that it visits."""
    order = np.argsort(ids, kind="stable")
    ids, lists, codes, bias = ids[order], lists[order], codes[order], bias[order]
    visited = codec.probed(q, probes)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    turn = np.argsort(codec.lists(q), kind="stable")  # queries of like lists go together
    for at in range(0, len(turn), STEP):
        some = turn[at : at + STEP]
        rows = np.flatnonzero(visited[some].any(axis=0)[lists])
        if not len(rows):
            continue
        far = codec.distances(q[some], lists[rows], codes[rows], bias[rows])
        far[~visited[some].T[lists[rows]]] = np.inf
        far[ids[rows][:, None] == names[some][None, :]] = np.inf
        first = np.flatnonzero(np.r_[True, ids[rows][1:] != ids[rows][:-1]])
        if len(first) < len(rows):  # an id counts once
            far = np.minimum.reduceat(far, first, axis=0)
        own, far = ids[rows][first], np.ascontiguousarray(far.T)
        near = np.argpartition(far, keep - 1, axis=1)[:, :keep] if keep < len(own) else np.tile(np.arange(len(own)), (len(some), 1))
        value = np.take_along_axis(far, near, axis=1)
        there = np.isfinite(value)
        out.append((np.repeat(names[some], there.sum(axis=1)), own[near][there], value[there]))
    return tuple(np.concatenate(c) for c in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED, seed: int = 0) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query holds, its own row left out.

    score: cosine in double precision; ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without an id. Vectors of another length have no cosine with each other: each length
    has an index of its own. Rows of one id count as that id's nearest; a query id with several vectors asks by the least of
    them. Fewer candidates than k: all. No vectors: no rows. Other columns are not read."""
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), vector.alias("vector"))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")).where("asked > 0").orderBy("size").collect()
    out = spark.createDataFrame([], HITS)
    for size, n, asked in sizes:
        found = _search(rows.where(F.size("vector") == size), n, asked, k, probed, seed)
        out = found if len(sizes) == 1 else out.union(found)
    return out


def _search(rows: DataFrame, n: int, asked: int, k: int, probed: float, seed: int) -> DataFrame:
    """search() on vectors of one length: n rows, of which `asked` are queries."""
    spark = rows.sparkSession
    drawn = rows.select(F.xxhash64("vector", "id").alias("h"), "vector").orderBy("h").limit(SAMPLE).select("vector").toArrow()
    sample = unit(matrix(drawn["vector"]))
    codec = fit(sample, max(1, min(round(2 * n**0.5), len(sample) // SAMPLE_EACH)), seed)
    shared = spark.sparkContext.broadcast(codec)
    probes = max(min(LEAST_PROBES, len(codec.centroids)), round(probed * len(codec.centroids)))
    shards, chunks = max(-(-n // SHARD), min(SHARDS, -(-n // 1024))), max(-(-asked // CHUNK), min(CHUNKS, -(-asked // 16)))
    most = max(k, reranked(n))
    keep = min(most, 2 * -(-most // shards) + 16)  # ids are dealt out by hash, so a shard has about 1 / shards of the nearest

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unit(matrix(b.column(2)))
                own = shared.value.lists(x)
                codes = shared.value.codes(x, own)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1), pa.array(shared.value.bias(own, codes)), pa.array([c.tobytes() for c in codes], pa.binary()), b.column(2)], ["list", "id", "q", "bias", "codes", "vector"])

    index = save(rows.dropDuplicates(["id", "vector"]).select("id", "q", "vector").mapInArrow(place, BASE), "ivf-index")
    queries = save(index.where("q").groupBy("id").agg(F.min("vector").alias("vector")), "ivf-queries")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = index.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), each(chunks).alias("chunk"), "list", "id", "bias", "codes")
    to = queries.select(each(shards).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), "id", "vector")

    def scan(base: pa.Table, asked: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        if base.num_rows and asked.num_rows:
            codes = np.frombuffer(b"".join(base["codes"].to_pylist()), np.uint8).reshape(base.num_rows, -1)
            found = scanned(shared.value, probes, keep, base["id"].to_numpy(), base["list"].to_numpy(), codes, base["bias"].to_numpy(), asked["id"].to_numpy(), unit(matrix(asked["vector"])))
        return pa.table([pa.array(c) for c in found], names=["query_id", "vec_id", "far"])

    groups = ["shard", "chunk"]
    near = base.groupBy(*groups).cogroup(to.groupBy(*groups)).applyInArrow(scan, FOUND)
    by_code = Window.partitionBy("query_id").orderBy("far", "vec_id")
    chosen = save(near.withColumn("place", F.row_number().over(by_code)).where(F.col("place") <= most).select("query_id", "vec_id"), "ivf-chosen")
    blocks = max(1, -(-asked // 128))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(blocks)).cast("int").alias("block")
    candidates = chosen.join(index.select(F.col("id").alias("vec_id"), "vector"), "vec_id").select(block("query_id"), "query_id", "vec_id", "vector")

    def rank(asked: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))]
        if found.num_rows:
            found = found.sort_by([("query_id", "ascending"), ("vec_id", "ascending")])
            names, ids, x = found["query_id"].to_numpy(), found["vec_id"].to_numpy(), scaled(matrix(found["vector"]))
            own = dict(zip(asked["id"].to_pylist(), scaled(matrix(asked["vector"]))))
            bounds = np.r_[np.flatnonzero(np.r_[True, names[1:] != names[:-1]]), len(names)]
            for a, b in zip(bounds, bounds[1:]):
                score = cosines(x[a:b], own[int(names[a])])
                best = np.lexsort((ids[a:b], -score))
                _, first = np.unique(ids[a:b][best], return_index=True)  # an id counts once
                best = best[np.sort(first)[:k]]
                out.append((names[a:b][best], np.arange(1, len(best) + 1, dtype=np.int32), ids[a:b][best], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "rank", "vec_id", "score"])

    return queries.select(block("id"), "id", "vector").groupBy("block").cogroup(candidates.groupBy("block")).applyInArrow(rank, HITS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the five nearest of every row whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
