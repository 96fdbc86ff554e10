"""Benchmark decontamination by winnowing.

Every K-gram of words has a hash; in each run of W K-grams the least hash is kept. Two texts that share K + W - 1 = 13
words keep a common hash there, so joining the kept hashes of documents with those of the benchmark misses no shared
window. Each hit is extended: all windows around it are tested, by 128 bits of hash, and every word inside a shared window
counts.

The benchmark is taken in blocks of a bounded size. Each block is one narrow pass over the documents, which reads them from
where they lie; what passes find is written and, at the end, united by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.session import save

from .common import _BASE, ALNUM, LOWER, Words, held, mix, slices, strings, window_hashes

#: Words of a window, of a K-gram, and K-grams of which the least is kept.
WINDOW, K = 13, 7
W = WINDOW - K + 1
#: Benchmark bytes in one broadcast; a larger benchmark is taken in blocks, one narrow pass over the documents for each.
BLOCK_BYTES = 32_000_000
FOLD = LOWER
MEMBER = ALNUM[LOWER]


def at_positions(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the windows of `size` words that start at the given words."""
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * _BASE + h[at + k]
    return mix(total)


def kept(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: positions of the least K-gram hash of every W successive ones of one text (ties: all), and those hashes."""
    grams = window_hashes(words.hash, K)
    n = len(grams) - W + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = grams[:n].copy()
    for d in range(1, W):
        np.minimum(low, grams[d : d + n], out=low)
    whole = words.doc[:n] == words.doc[WINDOW - 1 : WINDOW - 1 + n]
    chosen = np.zeros(len(grams), bool)
    for d in range(W):
        chosen[d : d + n] |= (grams[d : d + n] == low) & whole
    at = np.flatnonzero(chosen)
    return at, grams[at]


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted table of each value, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1)
    i = np.searchsorted(table, values)
    i[i == len(table)] = 0
    return np.where(table[i] == values, i, -1)


class Index:
    """Windows of one block of benchmark items: by length, sorted hashes, 64 more bits of each, and the items that have each."""

    def __init__(self, ids: list[str | None], texts: list[str | None]) -> None:
        words = Words(strings(pa.array(texts, pa.string())), MEMBER, FOLD)
        count, second = np.diff(words.first), words.second(FOLD)
        self.ids = ids
        long = count >= WINDOW
        at, fp = kept(words)
        self.fingerprints = np.unique(fp[long[words.doc[at]]] if len(at) else fp)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        starts = {WINDOW: words.windows(WINDOW)[0]}
        for n in np.unique(count[(count > 0) & ~long]):
            starts[int(n)] = words.first[np.flatnonzero(count == n)]
        for n, at in starts.items():
            if len(at):
                rows = np.unique(np.stack([at_positions(words.hash, at, n), at_positions(second, at, n), words.doc[at].astype(np.uint64)], axis=1), axis=0)
                first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
                self.windows[n] = (rows[first, 0], rows[first, 1], np.r_[first, len(rows)], rows[:, 2].astype(np.int64))
        short = np.flatnonzero((count > 0) & ~long)
        self.openers = {n: np.unique(words.hash[words.first[short[count[short] == n]]]) for n in self.windows if n < WINDOW}

    def matches(self, words: Words) -> Iterator[tuple[int, np.ndarray]]:
        """(length, first words) of all windows whose first 64 bits are shared."""
        stop = words.first[words.doc + 1] if len(words.doc) else words.first[:0]
        if len(self.fingerprints):
            at, fp = kept(words)
            hit = at[member(fp, self.fingerprints) >= 0]
            if len(hit):  # extend: a window that holds the K-gram starts up to W - 1 words before it
                near = np.unique((hit[:, None] - np.arange(W)[None, :]).ravel())
                near = near[near >= 0]
                near = near[near + WINDOW <= stop[near]]
                yield WINDOW, near[member(at_positions(words.hash, near, WINDOW), self.windows[WINDOW][0]) >= 0]
        for n, openers in self.openers.items():
            at = np.flatnonzero(member(words.hash, openers) >= 0)
            at = at[at + n <= stop[at]]
            yield n, at[member(at_positions(words.hash, at, n), self.windows[n][0]) >= 0]

    def window(self, n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Index of each window of n words, given both of its hashes; -1 where absent."""
        table, second, _, _ = self.windows[n]
        at, out = np.searchsorted(table, low), np.full(len(low), -1)
        open_ = np.arange(len(low))
        while len(open_):  # windows with equal first bits follow each other
            open_ = open_[at[open_] < len(table)]
            open_ = open_[table[at[open_]] == low[open_]]
            same = second[at[open_]] == high[open_]
            out[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
        return out

    def items(self, doc: np.ndarray, n: int, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item) of matched windows."""
        _, _, first, item = self.windows[n]
        both = np.unique(np.stack([doc, window], axis=1), axis=0)
        many = first[both[:, 1] + 1] - first[both[:, 1]]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(both[:, 0], many), item[np.repeat(first[both[:, 1]], many) + within]


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
PASSED = "row long, id long, n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _pass(piece: pa.RecordBatch, index: Index) -> pa.RecordBatch:
    column = strings(piece.column("text"))
    words = Words(column, MEMBER, FOLD)
    depth = np.zeros(len(words.hash) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(piece.num_rows)]
    found = [(n, at) for n, at in index.matches(words) if len(at)]
    if found:
        # 64 more bits, of the texts that have a match
        some = np.unique(np.concatenate([words.doc[at] for _, at in found]))
        part = Words(column.take(pa.array(some)), MEMBER, FOLD)
        second = part.second(FOLD)
        moved = part.first[:-1] - words.first[some]
        for n, at in found:
            there = at + moved[np.searchsorted(some, words.doc[at])]
            window = index.window(n, at_positions(part.hash, there, n), at_positions(second, there, n))
            at, window = at[window >= 0], window[window >= 0]
            np.add.at(depth, at, 1)
            np.add.at(depth, at + n, -1)
            if len(at):
                for d, i in zip(*(x.tolist() for x in index.items(words.doc[at], n, window))):
                    if index.ids[i] is not None:
                        items[d].add(index.ids[i])
    spans: list[list[dict]] = [[] for _ in range(piece.num_rows)]
    covered = np.cumsum(depth)[:-1] > 0
    if covered.any():
        same = words.doc[1:] == words.doc[:-1]
        open_at = np.flatnonzero(covered & ~np.r_[False, covered[:-1] & same])
        shut = np.flatnonzero(covered & ~np.r_[covered[1:] & same, False]) + 1
        for d, a, b in zip(words.doc[open_at].tolist(), open_at.tolist(), shut.tolist()):
            base = int(words.first[d])
            spans[d].append({"start": a - base, "end": b - base})
    return pa.RecordBatch.from_arrays(
        [piece.column("row"), piece.column("id"), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        ["row", "id", "n_words", "spans", "items"],
    )


def united(spans: Column) -> Column:
    """Sorted spans, overlapping or touching ones joined."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = F.coalesce(last["end"] >= s["start"], F.lit(False))
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, step)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, spans of hit words, items, contaminated), one row for each row of docs.

    A window is 13 successive words, or all words of an item that has fewer. contaminated: some word is hit, and at least
    one in `share`. Repeated rows are judged each. Null texts have no words. Items without an id mark words, but are not listed; equal ids are one item. No
    documents, no rows; an empty benchmark hits nothing. Other columns are not read."""
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if blocks > 1:
        rows = save(rows.withColumn("row", F.monotonically_increasing_id()), "contamination-docs")  # rows are known by number from here on
    parts: list[DataFrame] = []
    for block in range(blocks):  # each holds about BLOCK_BYTES
        items = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        index = spark.sparkContext.broadcast(Index([r.item for r in items], [r.text for r in items]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            held("decontaminate")
            for b in batches:
                for piece in slices(b, "text"):
                    yield _pass(piece, index.value)

        found = rows.mapInArrow(run, PASSED)
        if blocks > 1:  # one broadcast lives at a time
            found = save(found if not block else found.where("size(spans) > 0"), "contamination-pass")
            index.unpersist()
        parts.append(found)
    df = parts[0]
    if blocks > 1:
        hits = reduce(DataFrame.union, [p.where("size(spans) > 0") for p in parts]).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        df = df.select("row", "id", "n_words").join(hits, "row", "left").select("id", "n_words", united(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    df = df.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), "spans", "items")
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: words of every document that lie in a benchmark window, and the items they come from."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


def _sql_words(table: str, key: str) -> str:
    return rf"SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}"


ORACLE = f"""WITH d AS ({_sql_words("documents", "doc_id")}), b AS ({_sql_words("benchmark", "item_id")}),
bw AS (SELECT id AS item, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 12) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS t FROM b WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT id, n, unnest(range(1, len(w) - n + 2)) AS p, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS t FROM d, lengths WHERE len(w) >= n),
m AS (SELECT dw.id, dw.n, dw.p, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
hit AS (SELECT id, count(DISTINCT q) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT id, n, p FROM m)) GROUP BY id),
it AS (SELECT id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT CAST(item AS VARCHAR), ',' ORDER BY CAST(item AS VARCHAR))) AS s FROM m GROUP BY id)
SELECT d.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (id) LEFT JOIN it USING (id)"""
