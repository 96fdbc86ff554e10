"""Substring dedup across documents, by level-wise doubling.

A level is a number of words; windows repeated at one level alone are candidates at the next. The first level is SEED words
and keeps, of all windows that one of WINDOW words holds, only the least hash (so a repeated long window always leaves a
repeated seed); the second is WINDOW words, about twice as many; then each level doubles, until no candidate survives.

Documents lie in units, ranges of their ids of about as many bytes, in a table bucketed by unit, so that passes over it need no
exchange. At each level a unit sends its distinct hashes, sorted, as differences, to the parts of the hash space; a part
answers one bit for "another unit has it" and one for "a unit of smaller ids has it". So a passage that is in a third
of all documents is sent once by each unit, and what goes back is two bits a hash.

There is a row for each unit and part. Units and parts both grow with the root of the input, so these rows grow in proportion
to it, until a unit reaches what a worker can hold (MOST_UNIT, at some 128 GB of text).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.session import save, scratch

from .common import NOT_SPACE, U64, Words, discard, mix, small_batches, strings, window_hashes

WINDOW = 13
SEED = (WINDOW + 1) // 2
#: Bytes of text in a unit, and of the text whose hashes go to one part, at an input of GIVEN bytes; both grow with its root.
UNIT_BYTES, PART_BYTES, GIVEN = 4_000_000, 8_000_000, 500_000_000
MOST_UNIT = 64_000_000
#: Ids that are drawn for each unit to place its bounds.
DRAWN = 200
LAST = np.iinfo(np.int64).max
SENT = "unit int, level int, part int, n int, data binary"
STATE = "unit int, words int, ids binary, doc binary, at binary, hash binary"


def coded(h: np.ndarray) -> bytes:
    """Sorted hashes as their first one, a width, and differences of that many bytes."""
    if not len(h):
        return b""
    step = np.diff(h)
    width = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
    return h[:1].tobytes() + bytes([width]) + np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def decoded(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    width = data[8]
    if n > 1 and width:
        out[1:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, 9).reshape(-1, width)
    out = out.view("<u8").ravel()
    out[0] = np.frombuffer(data, "<u8", 1)[0]
    return np.cumsum(out, dtype=np.uint64)


class Hashes:
    """Distinct hashes of a unit's windows: values, the index of each window's, and the smallest and largest id that has each."""

    def __init__(self, h: np.ndarray, ids: np.ndarray) -> None:
        order = np.argsort(h, kind="stable")
        s = h[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        self.value = s[first]
        self.index = np.empty(len(s), np.int64)
        self.index[order] = np.cumsum(new) - 1
        owner = ids[order]
        self.low = np.minimum.reduceat(owner, first) if len(s) else owner
        self.high = np.maximum.reduceat(owner, first) if len(s) else owner

    def sent(self, unit: int, level: int, parts: int) -> pa.Table:
        """One row for each part of the hash space that has hashes of this unit."""
        part = (self.value >> U64(64 - parts.bit_length() + 1)).astype(np.int64) if parts > 1 else np.zeros(len(self.value), np.int64)
        some, first = np.unique(part, return_index=True)
        ends = np.r_[first[1:], len(part)]
        rows = [(unit, level, int(p), int(b - a), coded(self.value[a:b])) for p, a, b in zip(some, first, ends)]
        return table(SENT, list(zip(*rows)) if rows else [[]] * 5)

    def answers(self, rows: pa.Table, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: whether another document has it, and whether one with a smaller id has."""
        mine = rows.filter(pa.compute.equal(rows["level"], level)).sort_by("part")
        shared, earlier = [np.zeros(0, bool)], [np.zeros(0, bool)]
        for n, data in zip(mine["n"].to_pylist(), mine["data"].to_pylist()):
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n).astype(bool)
            shared.append(bits[:n])
            earlier.append(bits[n:])
        shared, earlier = np.concatenate(shared), np.concatenate(earlier)
        if len(shared) != len(self.value):
            raise ValueError("answers and hashes do not belong together")
        return (shared | (self.low < self.high))[self.index], earlier[self.index]


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def table(schema: str, columns: list) -> pa.Table:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.table([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def judge(rows: pa.Table) -> pa.Table:
    """Answers for one part of the hash space at one level."""
    rows = rows.sort_by("unit")
    n = rows["n"].to_numpy()
    h = np.concatenate([decoded(d, k) for d, k in zip(rows["data"].to_pylist(), n.tolist())])
    order = np.argsort(h, kind="stable")  # equal hashes stay in the order of their units
    s = h[order]
    same = s[1:] == s[:-1]
    earlier, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    ends = np.cumsum(n)
    data = [np.packbits(np.r_[shared[b - k : b], earlier[b - k : b]]).tobytes() for b, k in zip(ends, n)]
    return rows.set_column(rows.column_names.index("data"), "data", pa.array(data, pa.binary()))


def answered(sent: DataFrame) -> DataFrame:
    return sent.groupBy("part").applyInArrow(judge, SENT)


class Unit:
    """The words of one unit, and its hashes at the first two levels."""

    def __init__(self, rows: pa.Table) -> None:
        self.unit = rows["unit"][0].as_py()
        ids = rows["id"].combine_chunks()
        self.ids = np.asarray(ids.fill_null(LAST))
        self.texts = strings(rows["text"])
        self.words = Words(self.texts, NOT_SPACE)
        h, doc = self.words.hash, self.words.doc
        m = max(0, len(h) - WINDOW + 1)
        self.at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :]) if m else np.zeros(0, np.int64)
        least = np.full(m, ~U64(0))
        seeds = window_hashes(h, SEED)
        for d in range(WINDOW - SEED + 1):
            np.minimum(least, seeds[d : d + m], out=least)
        # least hashes crowd at the low end, so they are spread again
        self.seeds = Hashes(mix(least[self.at]), self.ids[doc[self.at]])

    def extend(self, answers: pa.Table) -> None:
        """Windows whose seed is repeated, and their hashes."""
        repeated, _ = self.seeds.answers(answers, SEED)
        self.at = self.at[repeated]
        self.hash = window_hashes(self.words.hash, WINDOW)[self.at] if len(self.at) else np.zeros(0, np.uint64)
        self.windows = Hashes(self.hash, self.ids[self.words.doc[self.at]])

    def judged(self, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Of each window in `at`: repeated; also in a document with a smaller id."""
        shared, earlier = self.windows.answers(answers, WINDOW)
        return shared, earlier | (self.ids[self.words.doc[self.at]] > self.windows.low[self.windows.index])


def shares(size: int) -> tuple[int, int]:
    """(units, parts) for so many bytes of text."""
    scale = max(1.0, (size / GIVEN) ** 0.5)
    unit = min(MOST_UNIT, UNIT_BYTES * scale) if UNIT_BYTES < MOST_UNIT else UNIT_BYTES
    units = max(1, -(-size // int(unit)), min(24, size // 500_000))
    parts = 1
    while parts * PART_BYTES * scale < size:
        parts *= 2
    return units, parts


def placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """docs as (unit, id, text), in files bucketed by unit; parts of the hash space.

    Units are cut at ids drawn with a chance in proportion to the bytes of their rows, so long texts do not fill one."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, parts = shares(size)
    bounds: list[int] = []
    if units > 1:
        chance = F.octet_length("text") * (DRAWN * units / size)
        drawn = np.sort(rows.where(F.col("id").isNotNull() & (F.rand(42) < chance)).select("id").toArrow()["id"].to_numpy())
        if len(drawn):
            bounds = sorted(set(drawn[np.arange(1, units) * len(drawn) // units].tolist()))
    # two short searches instead of one through all bounds
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda values: F.size(F.filter(values, lambda b: b <= F.col("id")))
    number: Column = F.lit(0)
    if groups:
        lists = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
        head = F.greatest(below(F.array(*[F.lit(g[0]).cast("long") for g in groups])) - 1, F.lit(0))
        number = head * step + below(F.element_at(lists, head + 1))
    unit = F.when(F.col("id").isNull(), len(bounds)).otherwise(number).cast("int")
    name = f"gridwright_substrings_{uuid.uuid4().hex}"
    buckets = max(1, -(-units // 4))
    writer = rows.select(unit.alias("unit"), "id", "text").repartition(units, "unit").write.bucketBy(buckets, "unit").sortBy("unit").format("parquet")
    writer.option("path", scratch(spark, "substrings-units")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # the plan now knows files and buckets, so the catalog need not
    spark.sql(f"DROP TABLE {name}")
    return table, parts


def deeper(state: DataFrame, parts: int, level: int) -> tuple[DataFrame, DataFrame | None]:
    """From windows repeated at `level` words to those at twice that: (rows of documents that have any, new state)."""
    def hashes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Hashes]:
        ids, doc, at, h = (np.frombuffer(row[k], t) for k, t in (("ids", "<i8"), ("doc", "<u4"), ("at", "<u4"), ("hash", "<u8")))
        key = doc.astype(np.uint64) << U64(32) | at
        if not len(key):
            return ids, doc, at, h, Hashes(h, ids[doc.astype(np.int64)])
        other = np.searchsorted(key, key + U64(level))
        other[other == len(key)] = 0
        both = key[other] == key + U64(level)
        h2 = mix(h[both] * U64(0x9E3779B97F4A7C15) + h[other[both]])
        return ids, doc[both], at[both], h2, Hashes(h2, ids[doc[both].astype(np.int64)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one unit's state is in Python's memory at a time
                row = b.slice(i, 1).to_pylist()[0]
                yield from hashes(row)[4].sent(row["unit"], 2 * level, parts).to_batches()

    def receive(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        for row in left.to_pylist():
            ids, doc, at, h, own = hashes(row)
            repeated, _ = own.answers(right, 2 * level)
            if repeated.any():
                rows.append((row["unit"], 2 * level, row["ids"], doc[repeated].tobytes(), at[repeated].tobytes(), h[repeated].tobytes()))
        return table(STATE, list(zip(*rows)) if rows else [[]] * 6)

    answers = save(answered(state.mapInArrow(send, SENT)), "substrings-answers")
    new = save(state.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(receive, STATE), "substrings-state")
    discard(answers)
    return new, new if new.take(1) else None


def longest(state: DataFrame) -> DataFrame:
    """(unit, level, part, n, data) rows that tell units which of their documents hold a repeated window of that level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                has = np.frombuffer(row["ids"], "<i8")[np.unique(np.frombuffer(row["doc"], "<u4")).astype(np.int64)]
                yield from table(SENT, [[row["unit"]], [-row["words"]], [0], [len(has)], [has.tobytes()]]).to_batches()

    return state.mapInArrow(run, SENT)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, longest, kept): one row for each row of docs.

    Removed is each word inside a window of 13 words that also starts in a document with a smaller id; kept is what is left,
    joined by spaces. longest: words of the longest level at which a window of the document is repeated elsewhere, 0 if none.
    A null text has no words. Rows without an id come after all others; equal ids are one document and one task's work, as are
    all rows without an id. Windows with equal 64-bit hashes are taken for equal: of n different windows that repeat, about
    n^2 / 2^65 pairs are so by chance. No rows in, none out. Other columns of docs are not read."""
    units, parts = placed(docs, id_col, text_col)

    def seeds(rows: pa.Table) -> pa.Table:
        own = Unit(rows)
        return own.seeds.sent(own.unit, SEED, parts)

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table(SENT, [[]] * 5)
        own = Unit(left)
        own.extend(right)
        return own.windows.sent(own.unit, WINDOW, parts)

    def first_state(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table(STATE, [[]] * 6)
        own = Unit(left)
        own.extend(right)
        repeated, _ = own.judged(right)
        at = own.at[repeated]
        if not len(at):
            return table(STATE, [[]] * 6)
        some, doc = np.unique(own.words.doc[at], return_inverse=True)
        place = at - own.words.first[own.words.doc[at]]
        return table(STATE, [[own.unit], [WINDOW], [own.ids[some].astype("<i8").tobytes()], [doc.astype("<u4").tobytes()], [place.astype("<u4").tobytes()], [own.hash[repeated].astype("<u8").tobytes()]])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return table(RESULT, [[]] * 5)
        own = Unit(left)
        own.extend(right)
        _, earlier = own.judged(right)
        depth = np.zeros(len(own.words.hash) + 1, np.int64)
        np.add.at(depth, own.at[earlier], 1)
        np.add.at(depth, own.at[earlier] + WINDOW, -1)
        gone = np.cumsum(depth)[:-1] > 0
        count = np.diff(own.words.first)
        before = np.r_[0, np.cumsum(gone)]
        removed = before[own.words.first[1:]] - before[own.words.first[:-1]]
        deepest: dict[int, int] = {}
        for level, data in zip(right["level"].to_pylist(), right["data"].to_pylist()):
            if level < 0:
                for i in np.frombuffer(data, "<i8").tolist():
                    deepest[i] = max(deepest.get(i, 0), -level)
        kept = []
        for d, text in enumerate(own.texts):
            words = text.as_buffer().to_pybytes().split()  # bytes split at exactly these six characters
            if removed[d]:
                a = int(own.words.first[d])
                words = [w for w, g in zip(words, gone[a : a + len(words)].tolist()) if not g]
            kept.append(b" ".join(words))
        ids = own.ids.tolist()
        return table(RESULT, [left["id"].combine_chunks(), count, removed, [deepest.get(i, 0) for i in ids], pa.array(kept, pa.binary()).cast(pa.string())])

    by_unit = units.groupBy("unit")
    with small_batches(docs.sparkSession):
        told = save(answered(by_unit.applyInArrow(seeds, SENT)), "substrings-seeds")
        told = told.union(save(answered(by_unit.cogroup(told.groupBy("unit")).applyInArrow(windows, SENT)), "substrings-windows"))
        state: DataFrame | None = save(by_unit.cogroup(told.groupBy("unit")).applyInArrow(first_state, STATE), "substrings-state")
        level, found = WINDOW, told
        while state is not None and state.take(1):
            found = found.union(save(longest(state), "substrings-longest"))
            old = state
            _, state = deeper(old, parts, level)
            discard(old)
            level *= 2
    return by_unit.cogroup(found.groupBy("unit")).applyInArrow(final, RESULT)


RESULT = "doc_id long, n_words long, n_removed long, longest long, kept string"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: removed words of every document, and a digest of what is kept."""
    out = deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", "longest", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS t FROM d WHERE len(w) >= 13),
first AS (SELECT t, min(doc_id) AS low FROM win GROUP BY t),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM win JOIN first USING (t) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS word FROM d),
levels(doc_id, size, p, t) AS (SELECT win.doc_id, 13, p, t FROM win JOIN (SELECT t FROM win GROUP BY t HAVING count(DISTINCT doc_id) > 1) USING (t)
 UNION ALL SELECT doc_id, 2 * size, p, t FROM (SELECT *, min(doc_id) OVER (PARTITION BY t) <> max(doc_id) OVER (PARTITION BY t) AS again FROM (SELECT a.doc_id, a.size, a.p, a.t || ' ' || b.t AS t FROM levels a JOIN levels b ON a.doc_id = b.doc_id AND b.p = a.p + a.size)) WHERE again),
deepest AS (SELECT doc_id, max(size) AS longest FROM levels GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(longest, 0) AS BIGINT) AS longest, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN deepest USING (doc_id)"""
