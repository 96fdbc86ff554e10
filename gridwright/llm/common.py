"""What the operators share: scratch tables, Arrow batches of texts, vectorised words and hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step holds at most, unless a single text is longer.
SLICE_BYTES = 500_000
U64 = np.uint64


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that save() wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Within this, Arrow batches of plans that are run are small; the session has its own setting again afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_held: dict[str, dict] = {}


def held(owner: str) -> dict:
    """What a Python worker keeps for an operator from task to task. A worker keeps it for one operator at a time: whatever others
    left there is given back, so that stages which follow each other do not add up."""
    if _held.keys() - {owner}:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library keeps what numpy has freed
            trim(0)
    return _held.setdefault(owner, {})


def bucket_of(col: Column | str) -> Column:
    """CRC-32 of the id as text, modulo 4. The rows with 2 are held out."""
    return F.crc32(F.col(col).cast("string") if isinstance(col, str) else col.cast("string")) % 4


def strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One array with 64-bit offsets, without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def raw(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and each text's offset in them (one more at the end)."""
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch | pa.Table, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """The batch in pieces whose texts hold `most` bytes at most (a longer text stands alone)."""
    if not batch.num_rows:
        return
    _, off = raw(strings(batch.column(column)))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (two multiply-xorshift rounds)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = pow(int(_BASE), -1, 1 << 64)
        up, down = np.full(size, _BASE), np.full(size, U64(inverse))
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """The words of many texts at once: maximal runs of bytes of one class.

    start, end: byte positions of each word; doc: index of its text; first: index of each text's first word (one more
    at the end); hash: 64 bits of its bytes after `fold` (a table from byte to byte).
    """

    def __init__(self, column: pa.LargeStringArray, member: np.ndarray, fold: np.ndarray | None = None) -> None:
        self.buf, self.off = raw(column)
        inside = member[self.buf]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True  # a word never crosses from one text to the next
        before = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        if n:
            after[-1], after[:-1] = False, inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.doc = np.repeat(np.arange(len(column)), np.diff(self.first))
        self.hash = self._hashes(_BYTE if fold is None else _BYTE[fold])

    def second(self, fold: np.ndarray | None = None) -> np.ndarray:
        """64 more bits for each word, independent of `hash`: together they tell words apart at any size of corpus."""
        value = mix(_BYTE ^ U64(0x5851F42D4C957F2D))
        return mix(self._hashes(value if fold is None else value[fold]) ^ U64(0x2545F4914F6CDD1D))

    def _hashes(self, value: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        at = 0
        while at < len(out):  # by pieces of a bounded number of bytes, cut between words
            base = int(self.start[at])
            upto = max(at + 1, int(np.searchsorted(self.end, base + SLICE_BYTES, "right")))
            s, e = self.start[at:upto] - base, self.end[at:upto] - base
            size = int(e[-1])
            up, down = powers(size + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(value[self.buf[base : base + size]] * up[:size], out=total[1:])
            out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            at = upto
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each run of `size` words of one text."""
        m = len(self.hash) - size + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[size - 1 :])
        return at, window_hashes(self.hash, size)[at]


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` values."""
    m = len(h) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(size):
        total *= _BASE
        total += h[k : k + m]
    return mix(total)


def byte_class(pattern_excludes: list[tuple[int, int]]) -> np.ndarray:
    """Which of the 256 bytes belong to words, given the excluded ranges (ends included)."""
    member = np.ones(256, bool)
    for a, b in pattern_excludes:
        member[a : b + 1] = False
    return member


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased: digits, letters and every byte over 127
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
