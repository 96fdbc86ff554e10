"""SimHash near-duplicates with exact linking, by bit-sliced comparison.

Fingerprints are made per document. Distinct fingerprints stand for all documents that have them. Two fingerprints that
differ in r bits at most agree in some m - r of m bands, so those bands are keys of candidate groups; within a group, bit
planes are stored vertically (bit i of a block of 64 fingerprints in one word). A block is compared with every later one, and
with itself above the diagonal: distances are kept by carry-save bitwise counters, and a pair of blocks is abandoned once
all distances in it exceed the radius. Each group gives a star for each of its local components, never all pairs. Groups
above GROUP are dealt out as pairs of parts, so none falls to one task, and each part is compared with itself in one pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators.distributed import components
from gridwright.session import save

from .common import held, small_batches

#: Fingerprints of one group that one task compares; larger groups are split into parts of half of it, compared by pairs.
GROUP = 4096
#: Pairs of blocks that are compared at a time; planes after which it is looked whether pairs can be abandoned.
STEP, LOOK = 512, (16, 24, 28, 32, 36, 40, 44, 48, 52, 56, 60)
ALL, U0, U1 = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0), np.uint64(1)


def simhash(data: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one text in UTF-8. Shingles count as often as they occur; no words: 0; fewer words than a shingle: all of them as one."""
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends], ends[shingle - 1 :] or ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(stops)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([digest(text[s : e - 1], seed) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp long) of every row. Null texts count as empty; their fingerprint is 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            out = [simhash(t or b"", shingle, seed) for t in (x.as_py() for x in texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def planes(fp: np.ndarray) -> np.ndarray:
    """(64, blocks) words of fp, (blocks, 64): bit j of word i is bit i of the block's fingerprint j."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, -1)


def within(plane: np.ndarray, query: np.ndarray, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(pairs of blocks that are not abandoned, their (pairs, 64) words whose bits say which slots lie within the radius of each
    query, planes that were read, summed over pairs). plane: (64, pairs); query: (pairs, 64); over: (pairs, 64) words of
    what does not count, such as empty slots."""
    places = (radius + 1).bit_length()
    pairs, read = np.arange(plane.shape[1]), 0
    counter = [np.zeros(query.shape, np.uint64) for _ in range(places)]
    limit = [i for i in range(places) if (radius + 1) >> i & 1]
    for bit in range(64):
        if bit in LOOK:
            alive = (over != ALL).any(axis=1)
            if not alive.all():
                pairs, over, query, plane = pairs[alive], over[alive], query[alive], plane[:, alive]
                counter = [c[alive] for c in counter]
            if not len(pairs):
                break
        read += len(pairs)
        asked = U0 - ((query >> np.uint64(bit)) & U1)  # all ones or none
        carry = plane[bit][:, None] ^ asked
        for c in counter:  # carry-save: each counter bit keeps the sum, the rest moves up
            carry, c[...] = carry & c, carry ^ c
        reached = counter[limit[0]].copy()
        for i in limit[1:]:
            reached &= counter[i]
        over = over | reached | carry
    return pairs, ~over, read


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Labels, each the smallest of its set so far, after i and j are joined."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


#: Above the diagonal: of a block with itself, slots after each query.
DIAGONAL = np.array([(1 << (q + 1)) - 1 for q in range(64)], np.uint64)


def links(fp: np.ndarray, node: np.ndarray, half: np.ndarray, own: np.ndarray, bounds: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stars (smallest node, other node) of the components of many groups, rows bounds[i]:bounds[i + 1] each.

    Rows of a group lie in two halves, 0 before 1; rows of different halves are compared, and those of one half if `own` holds."""
    if not len(fp):
        return
    # every half of every group in blocks of 64 of its own
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    new = np.r_[True, (group[1:] != group[:-1]) | (half[1:] != half[:-1])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(fp)])
    blocks = -(-size // 64)
    start = np.r_[0, np.cumsum(blocks)]  # of each half, its first block
    slot = np.arange(len(fp)) - np.repeat(first, size) + 64 * np.repeat(start[:-1], size)
    padded, row = np.zeros(64 * start[-1], np.uint64), np.full(64 * start[-1], -1)
    padded[slot], row[slot] = fp, np.arange(len(fp))
    padded, empty = padded.reshape(-1, 64), row.reshape(-1, 64) < 0
    plane = planes(padded)
    void = np.packbits(empty, axis=1, bitorder="little").view("<u8").ravel()
    # blocks of a group follow each other; each is paired with itself and all later ones of its group
    of_half = np.repeat(np.arange(len(first)), blocks)
    of_group = group[first][of_half]
    end = np.searchsorted(of_group, of_group, "right")
    many = end - np.arange(len(of_group))
    label = np.arange(len(fp))
    for at in _cuts(many):
        a = np.repeat(np.arange(at.start, at.stop), many[at])
        b = a + np.arange(len(a)) - np.repeat(np.cumsum(many[at]) - many[at], many[at])
        keep = (of_half[a] != of_half[b]) | own[first][of_half[a]]
        a, b = a[keep], b[keep]
        for s in range(0, len(a), STEP):
            x, y = a[s : s + STEP], b[s : s + STEP]
            over = np.where(empty[x], ALL, void[y][:, None])
            over |= np.where((x == y)[:, None], DIAGONAL[None, :], U0)
            pairs, near, _ = within(plane[:, y], padded[x], over, radius)
            k, q = np.nonzero(near)
            if len(k):
                hit, t = np.nonzero(np.unpackbits(near[k, q].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                merged(label, row[64 * x[pairs[k[hit]]] + q[hit]], row[64 * y[pairs[k[hit]]] + t])
    low = np.full(len(fp), np.iinfo(np.int64).max)
    np.minimum.at(low, label, node)
    root = low[label]
    other = root != node
    if other.any():
        yield root[other], node[other]


def _cuts(many: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Runs of blocks that have some `most` pairs together."""
    total, at = np.cumsum(many), 0
    while at < len(many):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def band_masks(count: int, radius: int) -> list[int]:
    """Masks of which one at least is untouched by any `radius` differing bits. More bands, so more bits to a key, for more fingerprints."""
    m = radius + 1
    while m < min(2 * radius, 64) and count >> (64 * (m - radius) // m) > 64:
        m += 1
    cuts = [round(64 * i / m) for i in range(m + 1)]
    band = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(band, m - radius)]


def candidate_stars(classes: DataFrame, radius: int) -> DataFrame:
    """(u, v) with u < v: stars that connect all of classes (fp, node) whose fingerprints are linked."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = band_masks(classes.count(), radius)
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)]))
    keyed = classes.select("fp", "node", key.alias("g"))
    hot = save(keyed.groupBy("g").count().where(F.col("count") > GROUP).select(F.col("g"), F.ceil(F.col("count") / (GROUP // 2)).cast("int").alias("parts")), "simhash-hot")
    keyed = keyed.select("g", "fp", "node", F.lit(0).alias("half"), F.lit(True).alias("own"))
    if hot.take(1):
        part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts"))
        # each part is compared with itself where it meets the next one; the last one meets the one before it
        next_part = F.when(part + 1 < F.col("parts"), part + 1).otherwise(part - 1)
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1), lambda j: j != part)
        meeting = lambda j: F.struct(F.xxhash64("g", F.least(j, part), F.greatest(j, part)).alias("g"), (part > j).cast("int").alias("half"), (j == next_part).alias("own"))
        alone = F.array(F.struct(F.col("g"), F.lit(0).alias("half"), F.lit(True).alias("own")))
        dealt = F.when(F.col("parts").isNull(), alone).otherwise(F.transform(others, meeting))
        keyed = keyed.select("g", "fp", "node").join(hot, "g", "left").select("fp", "node", F.explode(dealt).alias("d")).select("d.g", "fp", "node", "d.half", "d.own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash")
        waiting = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int32), np.zeros(0, bool)]

        def done(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            g = cols[0]
            bounds = np.r_[0, np.flatnonzero(g[1:] != g[:-1]) + 1, len(g)]
            for u, v in links(cols[1].view(np.uint64), cols[2], cols[3], cols[4], bounds, radius):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            waiting = [np.concatenate([h, b.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(waiting)]
            if len(waiting[0]):
                cut = int(np.searchsorted(waiting[0], waiting[0][-1]))  # the last group may go on in the next batch
                if cut:
                    yield from done([h[:cut] for h in waiting])
                    waiting = [h[cut:] for h in waiting]
        if len(waiting[0]):
            yield from done(waiting)

    return keyed.select("g", "fp", "node", "half", "own").repartition("g").sortWithinPartitions("g", "half").mapInArrow(run, "u long, v long").where("u < v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of docs, with the smallest id reachable over links of at most
    `radius` differing bits. Equal ids count as one document. A null text is an empty one. Rows without an id are kept, link to
    nothing and have no component. No rows in, none out. Other columns of docs are not read."""
    with small_batches(docs.sparkSession):
        fps = save(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp")
    classes = save(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "simhash-classes")
    ids = save(fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("id"), "simhash-repeated")
    stars = candidate_stars(classes, radius)
    if ids.take(1):  # one id with several texts joins their classes
        several = fps.join(ids, "id").join(classes, "fp").groupBy("id").agg(F.min("node").alias("u"))
        stars = stars.union(fps.join(ids, "id").join(classes, "fp").join(several, "id").select("u", F.col("node").alias("v")).where("u < v").distinct())
    found = components(stars)
    named = save(classes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")), "simhash-named")
    return fps.join(named, "fp", "left").select(F.col("id").alias("doc_id"), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: fingerprint in hexadecimal and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
