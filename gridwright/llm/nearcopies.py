"""Near copies by exact similarity of shingle sets, with SimHash links and MinHash bands as candidates.

Texts with equal shingle sets are one class. Classes whose fingerprints are linked, or that agree in a band of MinHash
values, are candidates; the components of the candidates are compared set by set, so a link is never an estimate. A pair at
a similarity of exactly 0.8 shares none of the 40 bands with a chance of 5 in a million. Components above ROWS or VALUES are
dealt out as pairs of blocks, so none falls to one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators.distributed import components
from gridwright.session import save

from . import simhash
from .common import held, mix, slices, small_batches

#: Bands of a text, and MinHash values of each.
BANDS, EACH = 40, 6
#: Sets, and values in them, of one group that one task compares; larger groups are split into blocks of half of it.
ROWS, VALUES = 512, 1_000_000
_FACTOR = mix(np.arange(1, BANDS * EACH + 1, dtype=np.uint64)) | np.uint64(1)
_MASK = mix(np.arange(1001, BANDS * EACH + 1001, dtype=np.uint64))


def shingles(data: bytes, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Hashes of all shingles of one text in UTF-8, in order. No words: none; fewer words than a shingle: all of them as one."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends], ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[s : e - 1], seed) for s, e in zip(starts, stops)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """SimHash of the shingles, as simhash.simhash makes it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def bands(values: np.ndarray) -> np.ndarray:
    """One hash for each band of the set of values."""
    low = np.full(BANDS * EACH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 256):
        np.minimum(low, ((values[at : at + 256, None] ^ _MASK) * _FACTOR).min(axis=0), out=low)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(EACH):
        out = mix(out ^ low[k::EACH])
    return out.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(id, key of the shingle set, fp, bands) of every row. Null texts count as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nearcopies")
        for b in batches:
            keys, fps, all_bands = [], [], []
            for x in b.column(1).cast(pa.binary()):
                h = shingles(x.as_py() or b"", shingle, seed)
                values = np.unique(h)
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                fps.append(fingerprint(h))
                all_bands.append(bands(values))
            flat = np.concatenate(all_bands) if all_bands else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64)), listed], ["id", "key", "fp", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, key binary, fp long, bands array<long>")


def similar(sets: list[np.ndarray], node: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stars (smallest node, other node) of the components of sets whose similarity is 4/5 or more. No set is empty."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, node = size[order], node[order]
    off = np.r_[0, np.cumsum(size)]
    words, flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark, seen = np.zeros(len(words), np.int32), np.zeros(len(size), bool)
    for first in range(len(size)):
        if seen[first]:
            continue
        seen[first] = True
        found, left = [first], [first]
        while left:
            i = left.pop()
            lo, hi = int(np.searchsorted(size, -(-4 * size[i] // 5))), int(np.searchsorted(size, 5 * size[i] // 4, "right"))
            if seen[lo:hi].all():
                continue
            own = flat[off[i] : off[i + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[flat[off[lo] : off[hi]]], off[lo:hi] - off[lo])
            mark[own] = 0
            new = lo + np.flatnonzero((9 * common >= 4 * (size[i] + size[lo:hi])) & ~seen[lo:hi])
            seen[new] = True
            found += new.tolist()
            left += new.tolist()
        low = int(node[found].min())
        yield from ((low, int(v)) for v in node[found] if v != low)


def verified(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(u, v): stars that connect the nodes of each candidate component (node, root) as far as their sets are similar."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in slices(whole, "text")):
            sets = [np.unique(shingles(x.as_py() or b"", shingle, seed)) for x in b.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["root", "node", "n", "set"])

    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).join(found, "node")
    sets = save(texts.select("root", "node", "text").mapInArrow(read, "root long, node long, n long, set binary").where("n > 0"), "near-sets")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / (ROWS // 2)), F.ceil(F.sum("n") / (VALUES // 2))).cast("long")
    large = (F.count(F.lit(1)) > ROWS) | (F.sum("n") > VALUES)
    hot = save(sets.groupBy("root").agg(F.when(large, F.greatest(parts, F.lit(2))).alias("blocks")).where("blocks is not null"), "near-hot")
    block = F.pmod(F.xxhash64("set", F.lit(7)), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != block)
    dealt = F.when(F.col("blocks").isNull(), F.array(F.xxhash64("root"))).otherwise(F.transform(others, lambda j: F.xxhash64("root", F.least(j, block), F.greatest(j, block))))
    keyed = sets.join(hot, "root", "left").select(F.explode(dealt).alias("g"), "node", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("nearcopies")
        g, nodes, own = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            pairs = list(similar(own, np.array(nodes, np.int64))) if len(own) > 1 else []
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])

        for b in batches:
            for key, node, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if key != g:
                    yield from done()
                    g, nodes, own = key, [], []
                nodes.append(node)
                own.append(np.frombuffer(values.as_py(), np.uint64))
        yield from done()

    return keyed.repartition("g").sortWithinPartitions("g").mapInArrow(run, "u long, v long").where("u < v").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, component_id): one row for each row of docs, with the smallest id reachable over links of a shingle similarity of
    4/5 or more. Equal ids count as one document. A null text is an empty one; texts without words are copies of each other.
    Rows without an id are kept, link to nothing and have no component."""
    with small_batches(docs.sparkSession):
        return _near_copies(docs, id_col, text_col, shingle, radius, seed)


def _near_copies(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, seed: int) -> DataFrame:
    """near_copies(): all steps with Python in them are run here; the plan that is left has joins alone."""
    signed = save(signatures(docs, id_col, text_col, shingle, seed), "near-signatures")
    known = signed.where("id is not null")
    classes = save(known.groupBy("key").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "near-classes")
    by_fp = save(classes.groupBy("fp").agg(F.min("node").alias("node")), "near-fp")
    same_fp = classes.select("fp", F.col("node").alias("v")).join(by_fp.withColumnRenamed("node", "u"), "fp").select("u", "v")
    banded = save(classes.select("node", F.explode("bands").alias("g")), "near-bands")
    lows = save(banded.groupBy("g").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u < top").select("g", "u"), "near-lows")
    same_band = banded.join(lows, "g").select("u", F.col("node").alias("v"))
    stars = simhash.candidate_stars(by_fp, radius).union(same_fp).union(same_band).where("u < v").distinct()
    links = verified(docs, save(components(stars), "near-candidates"), id_col, text_col, shingle, seed)
    several = save(known.join(classes.select("key", "node"), "key").groupBy("id").agg(F.min("node").alias("u"), F.max("node").alias("top")).where("u < top").select("id", "u"), "near-repeated")
    if several.take(1):  # one id with several texts joins their classes
        links = links.union(known.join(several, "id").join(classes.select("key", "node"), "key").select("u", F.col("node").alias("v")).where("u < v").distinct())
    named = save(classes.select("key", "node").join(components(links), "node", "left").select("key", F.coalesce("root", "node").alias("component_id")), "near-named")
    return signed.join(named, "key", "left").select(F.col("id").alias("doc_id"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
