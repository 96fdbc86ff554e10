"""Token ids of a corpus in files of patched frame-of-reference blocks.

Ids of all documents, in order of their doc_id, form one stream that is cut into blocks of BLOCK ids. From each id of a
block the block's minimum is subtracted; the rest is packed at the width that the PERCENTILE-th largest of them needs.
Ids that need more bits are outliers: the packed part keeps their low bits, and an exception list has their places and
high bits. A file is written front to back; its footer indexes where blocks and documents start, so one document can be
read without the rest:

    "GWPF0001" | blocks | footer | footer's place (u64) | ids in the file (u64) | documents (u64) | "GWPF0001"
    block:  minimum u32, width u8, exceptions u16, packed bits, places u16[], high bits u32[]
    footer: block starts u64[blocks + 1], first id of each document u64[documents + 1], doc_ids i64[], null flags u8[]
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.session import save, scratch

from .bpe import byte_symbols
from .common import held, slices

MAGIC = b"GWPF0001"
BLOCK = 1024
PERCENTILE = 0.95
#: Bytes that a generation of what a worker remembers takes, of words, first and later runs of text each.
REMEMBERED = 96_000_000
#: Longer runs are encoded whenever they occur.
LONG = 128
HEAD, TAIL = struct.Struct("<IBH"), struct.Struct("<QQQ8s")
#: A space between two characters that no notion of white space covers: byte-level words never cross it.
BORDER = re.compile("(?<=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff]) (?=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff])")

#: Where none of these is in a text, every space in it is such a border.
UNUSUAL = ("  ", " \n", "\n ", *map(chr, (0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """One encoded block for each row of ids (blocks, ids in a block)."""
    low = ids.min(axis=1)
    rest = (ids - low[:, None]).astype("<u4")
    n = ids.shape[1]
    place = min(n - 1, int(np.ceil(percentile * n)) - 1)
    typical = np.partition(rest, place, axis=1)[:, place]
    width = np.array([int(x).bit_length() for x in typical])
    out: list[bytes] = [b""] * len(ids)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        values = rest[rows]
        bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(rows), n, 4), axis=2, bitorder="little", count=int(w)) if w else np.zeros((len(rows), n, 0), np.uint8)
        packed = np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")
        high = values >> np.uint32(w) if w < 32 else np.zeros_like(values)
        for k, r in enumerate(rows):
            at = np.flatnonzero(high[k])
            out[r] = HEAD.pack(int(low[r]), int(w), len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + high[k][at].astype("<u4").tobytes()
    return out


def unpack(data: bytes, n: int) -> np.ndarray:
    """The n ids of one block."""
    low, w, many = HEAD.unpack_from(data)
    at = HEAD.size
    size = (n * w + 7) // 8
    ids = np.zeros((n, 4), np.uint8)
    if w:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=n * w).reshape(n, w)
        part = np.packbits(bits, axis=1, bitorder="little")
        ids[:, : part.shape[1]] = part
    ids = ids.view("<u4").ravel().copy()
    at += size
    if many:
        places = np.frombuffer(data, "<u2", many, at).astype(np.int64)
        ids[places] |= np.frombuffer(data, "<u4", many, at + 2 * many) << np.uint32(w)
    return ids + np.uint32(low)


class Writer:
    """One file; documents are added in order."""

    def __init__(self, out) -> None:
        self.out, self.at = out, len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.starts, self.first, self.doc_ids, self.null = [self.at], [0], [], []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        self.doc_ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.first.append(self.n_ids)
        if self.n_held >= 256 * BLOCK:
            self._flush(self.n_held // BLOCK * BLOCK)

    def _flush(self, upto: int) -> None:
        stream = np.concatenate(self.held) if self.held else np.zeros(0, "<u4")
        for at in range(0, upto, 256 * BLOCK):
            part = stream[at : min(upto, at + 256 * BLOCK)]
            for block in pack(part.reshape(-1, BLOCK) if len(part) % BLOCK == 0 else part.reshape(1, -1)):
                self.out.write(block)
                self.at += len(block)
                self.starts.append(self.at)
        self.held, self.n_held = [stream[upto:]], len(stream) - upto

    def close(self) -> None:
        self._flush(self.n_held // BLOCK * BLOCK)
        if self.n_held:
            self._flush(self.n_held)
        for values, kind in ((self.starts, "<u8"), (self.first, "<u8"), (self.doc_ids, "<i8"), (self.null, "u1")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(TAIL.pack(self.at, self.n_ids, len(self.doc_ids), MAGIC))


class Reader:
    """One file, read by document."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        place, self.n_ids, docs, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("this is no file of token ids")
        blocks = -(-self.n_ids // BLOCK)
        foot, at, parts = file.read_at(size - TAIL.size - place, place), 0, []
        for n, kind in ((blocks + 1, "<u8"), (docs + 1, "<u8"), (docs, "<i8"), (docs, "u1")):
            parts.append(np.frombuffer(foot, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        self.starts, self.first, self.doc_ids, self.null = parts

    def ids(self, first: int, end: int) -> np.ndarray:
        """Ids first to end of the file's stream."""
        if end <= first:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, -(-end // BLOCK)
        base = int(self.starts[a])
        data = self.file.read_at(int(self.starts[b]) - base, base)
        parts = [unpack(data[int(self.starts[k]) - base : int(self.starts[k + 1]) - base], min(BLOCK, self.n_ids - k * BLOCK)) for k in range(a, b)]
        return np.concatenate(parts)[first - a * BLOCK : end - a * BLOCK]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of its first id in the file, ids) of all documents, some `most` ids at a time."""
        at, n = 0, len(self.doc_ids)
        while at < n:
            upto = max(at + 1, int(np.searchsorted(self.first, self.first[at] + most, "right")) - 1)
            base = int(self.first[at])
            stream = self.ids(base, int(self.first[upto]))
            for d in range(at, upto):
                a, b = int(self.first[d]), int(self.first[d + 1])
                yield None if self.null[d] else int(self.doc_ids[d]), a, stream[a - base : b - base]
            at = upto

#: Text on which Python and the library agree about letters, digits and spaces, and the byte-level word pattern on it.
PLAIN = re.compile("[ !-~\nÀ-ÖØ-öø-ÿ]*")
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\\s+(?!\\S)|\\s+")


class Runs(dict):
    """Ids of runs of text, made when first asked for. Two generations, bounded in bytes: what is asked for again outlives the
    older one. Long runs are not kept."""

    def __init__(self, make) -> None:
        self.make, self.older, self.held = make, {}, 0

    def __missing__(self, run: str) -> bytes:
        if len(run) > LONG:
            return self.make(run)
        if self.held > REMEMBERED:
            self.older, self.held = dict(self), 0
            self.clear()
        out = self.older.get(run)
        if out is None:
            out = self.make(run)
        self[run] = out
        self.held += 220 + 2 * len(run) + len(out)
        return out


class Tokens:
    """Ids by the tokenizers library: its pre-tokeniser cuts a run of text into words, its model encodes each distinct one.

    A text is cut at spaces that no token crosses, so that a run is encoded once however often it occurs."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None or self.library.pre_tokenizer is None or self.library.post_processor is not None:
            raise ValueError(f"{path}: only byte-level vocabularies without a normaliser are supported")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.symbol, self.risky = byte_symbols(), True
        self.word = Runs(self.merged)
        self.first = Runs(self.one)
        self.later = Runs(lambda run: self.one(" " + run))

    def one(self, run: str) -> bytes:
        if self.risky and any(t in run for t in self.added):
            return array("I", self.library.encode(run, add_special_tokens=False).ids).tobytes()
        if PLAIN.fullmatch(run):
            words = WORD.findall(run)
            if len(words) > 1:
                return b"".join([self.word[w] for w in words])
            # a run that is one word is kept as a run
            return self.word.get(run) or self.merged(run) if words else b""
        return b"".join([self.ids(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(run)])

    def ids(self, symbols: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def merged(self, word: str) -> bytes:
        return self.ids(word.replace(" ", self.symbol[32]).replace("\n", self.symbol[10]) if word.isascii() else "".join([self.symbol[b] for b in word.encode()]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        self.risky = any(a in t for a in self.added for t in texts)
        for t in texts:
            plain = not any(x in t for x in UNUSUAL) and t[:1] != " " and t[-1:] != " "
            runs = t.split(" ") if plain else BORDER.split(t)
            out.append(np.frombuffer(self.first[runs[0]] + b"".join(map(self.later.__getitem__, runs[1:])), "<u4"))
        return out


def tokens(path: str) -> Tokens:
    kept = held("tokenids")
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        kept[path] = Tokens(path)
    return kept[path]


MANIFEST = "file string, part int, n_ids long, n_docs long"


def write_ids(docs: DataFrame, path: str, target: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Files of ids under `target`, one for each range of doc_ids, and their manifest (file, part, n_ids, n_docs, base).

    Each document's ids are followed by end_id. Order: doc_id, null first; equal ids by their text's hash. A null text is
    empty. No documents: no files. All rows of one doc_id are in one file, as are those without one. A file appears under its name when it is whole, so a task may run twice. Other columns
    are not read."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), None
        name = f"ids-{part:06d}.gwpf"
        fs, base = pa.fs.FileSystem.from_uri(target)
        for b in batches:
            for piece in slices(b, "text"):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    draft = f"{base}/.{name}.{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft, compression=None, buffer_size=1 << 20)
                    writer = Writer(out)
                for doc_id, ids in zip(piece.column("id").to_pylist(), tokens(path).encode([t or "" for t in piece.column("text").to_pylist()])):
                    writer.add(doc_id, np.append(ids, np.uint32(end_id)))
        if out is not None:
            writer.close()
            out.close()
            fs.move(draft, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": name, "part": part, "n_ids": writer.n_ids, "n_docs": len(writer.doc_ids)}], pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", F.xxhash64("text"))
    manifest = save(ordered.mapInArrow(run, MANIFEST), "ids-manifest")
    # one window over a row for each file, so over some 10,000 rows for each TB: little enough for one task
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_ids(manifest: DataFrame, target: str, most_files: int = 8) -> DataFrame:
    """(doc_id, start, ids) of every document, from the files; `most_files` go to one task, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pa.fs.FileSystem.from_uri(target)
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{folder}/{name}") as file:
                    rows: list[tuple] = []
                    size = 0
                    for doc_id, at, ids in Reader(file).documents():
                        rows.append((doc_id, base + at, ids.tobytes()))
                        size += len(ids)
                        if size > 1 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                    if rows:
                        yield _rows(rows)

    files = manifest.count()
    return manifest.select("file", F.col("base").cast("long")).repartition(max(1, -(-files // most_files))).mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["doc_id", "start", "ids"])


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """op2: place, number and checksum of every document's ids, read back from the files. path: the vocabulary file."""
    import public_tokenizers

    target = scratch(spark, "token-ids")
    manifest = save(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path or public_tokenizers.path("byte_bpe_50k.json"), target), "ids-bases")
    return read_ids(manifest, target).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
