"""Language identification with language-bitmask n-gram filters.

Each slot of the filter is a bit mask of languages; an n-gram's slots, and-ed, give all languages that hold it. Per
document the bits are counted by language, corrected for the false positives that the filter's fill makes likely, and
the language with most n-grams is decided on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from gridwright.session import save

from .common import bucket_of, held, raw, slices, strings

#: Bytes of an n-gram; slots are 2**SLOT_BITS; hash multipliers, one for each probe.
GRAM = 4
SLOT_BITS = 20
PROBES = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Texts of each language that the filter is learned from, about; they are drawn by hash of their id.
SAMPLE = 3000
#: An n-gram belongs to a language that has it at this rate at least (so at most 1 / LEAST_RATE of them), and at SHARE of its
#: rate in the language that has it most.
LEAST_RATE = 4e-6
SHARE = 0.2
#: N-grams from which on a text can be told to be of no learned language.
LEAST_GRAMS = 20
#: Bytes as n-grams see them: letters in lower case, all other ASCII as a space, other bytes as they are.
VIEW = np.full(256, 0x20, np.uint8)
VIEW[0x61:0x7B] = VIEW[0x41:0x5B] = np.arange(0x61, 0x7B)
VIEW[0x80:] = np.arange(0x80, 0x100)


def grams(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams, index of each one's text, viewed bytes, offsets). N-grams with more than one space are left out."""
    buf, off = raw(texts)
    seen = VIEW[buf]
    n = max(0, len(seen) - GRAM + 1)
    value = np.zeros(n, np.uint32)
    spaces = np.zeros(n, np.uint8)
    for k in range(GRAM):
        value |= seen[k : k + n].astype(np.uint32) << np.uint32(8 * k)
        spaces += seen[k : k + n] == 0x20
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
    good = (spaces < 2) & (doc[:n] == doc[GRAM - 1 :] if n else np.zeros(0, bool))
    return value[good], doc[:n][good], seen, off


def slots(value: np.ndarray, probe: int) -> np.ndarray:
    h = value * PROBES[probe]
    h ^= h >> np.uint32(15)
    return (h * PROBES[(probe + 1) % len(PROBES)]) >> np.uint32(32 - SLOT_BITS)


class Filter:
    """langs: learned languages, most frequent first; table: (slots, words of 64 languages)."""

    def __init__(self, langs: list[str], value: np.ndarray, member: np.ndarray) -> None:
        """member: (n-grams, languages) booleans."""
        self.langs = langs
        words = max(1, -(-len(langs) // 64))
        kind = np.uint64 if len(langs) > 32 else np.uint32 if len(langs) > 8 else np.uint8
        self.table = np.zeros((1 << SLOT_BITS, words), kind)
        for p in range(len(PROBES)):
            at = slots(value, p)
            for i in range(len(langs)):
                np.bitwise_or.at(self.table[:, i // 64], at[member[:, i]], kind(1 << i % 64))
        fill = np.array([np.mean((self.table[:, i // 64] >> kind(i % 64)) & kind(1)) for i in range(len(langs))])
        self.wrong = fill ** len(PROBES)

    def counts(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(corrected n-grams of each text by language, n-grams of each text, whether it has an ASCII letter)."""
        value, doc, seen, off = grams(texts)
        mask = self.table[slots(value, 0)]
        for p in range(1, len(PROBES)):
            mask &= self.table[slots(value, p)]
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        total = np.diff(bounds).astype(float)
        out = np.zeros((len(texts), len(self.langs)))
        run = np.zeros(len(value) + 1, np.int64)
        for i in range(len(self.langs)):
            np.cumsum((mask[:, i // 64] >> mask.dtype.type(i % 64)) & mask.dtype.type(1), out=run[1:])
            out[:, i] = np.diff(run[bounds])
        out = np.maximum(0, (out - total[:, None] * self.wrong) / (1 - np.minimum(self.wrong, 0.99)))
        run = np.zeros(len(seen) + 1, np.int64)
        np.cumsum((seen > 0x60) & (seen < 0x7B), out=run[1:])
        return out, total, np.diff(run[off]) > 0

    def predict(self, texts: pa.Array, least_known: float = 0.0) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. A text without a letter is `und` with score 0; one with letters but no known
        n-gram is of the most frequent language, with one part in the number of languages as score. So is `und` a text of
        LEAST_GRAMS n-grams or more of which its language holds less than `least_known`."""
        clean = strings(texts)
        out, total, letter = self.counts(clean)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        for i in np.flatnonzero(~letter):
            letter[i] = any(map(str.isalpha, clean[int(i)].as_py()))
        letter &= (total < LEAST_GRAMS) | (out.max(axis=1) >= least_known * total)
        best = out.argmax(axis=1)
        ordered = np.sort(out, axis=1)
        first, second = ordered[:, -1], ordered[:, -2] if out.shape[1] > 1 else np.zeros(len(out))
        with np.errstate(invalid="ignore"):
            score = np.where(first > 0, first / (first + second), 1 / len(self.langs))
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letter)], np.where(letter, score, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filter:
    """The filter of docs' languages; rows with a null language or text are left out. The caller leaves out what is held back."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    many = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(many, key=lambda k: (-many[k], k))
    if not langs:
        return Filter([], np.zeros(0, np.uint32), np.zeros((0, 0), bool))
    drawn = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / float(1 << 20)
    rate = F.lit(0.0)
    for k in langs:
        rate = F.when(F.col("lang") == k, min(1.0, sample / many[k])).otherwise(rate)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        for b in batches:
            for piece in slices(b, "text"):
                value, doc, _, _ = grams(strings(piece.column("text")))
                lang = np.array(piece.column("lang").to_pylist(), object)
                names, code = np.unique(lang.astype(str), return_inverse=True)
                both, n = np.unique(code[doc].astype(np.uint64) << np.uint64(32) | value, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names[(both >> np.uint64(32)).astype(int)].tolist(), pa.string()), pa.array((both & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = rows.where(drawn < rate).select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = save(counted, "langid-grams")
    total = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, F.col("n") / float(total.get(k) or 1)).otherwise(share)
    kept = counted.select("lang", "gram", share.alias("rate")).where(F.col("rate") >= LEAST_RATE)
    top = F.max("rate").over(Window.partitionBy("gram"))  # as many rows as there are languages
    chosen = kept.withColumn("top", top).where(F.col("rate") >= SHARE * F.col("top")).select("lang", "gram").toPandas()
    value, at = np.unique(chosen["gram"].to_numpy(np.uint32), return_inverse=True)
    member = np.zeros((len(value), len(langs)), bool)
    member[at, chosen["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(int)] = True
    return Filter(langs, value, member)


def identify(docs: DataFrame, model: Filter, text_col: str = "text", least_known: float = 0.0) -> DataFrame:
    """docs with lang_pred and lang_score (columns of these names are replaced). Any row may be null, empty or repeated."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "lang_score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("langid")
        for b in batches:
            for piece in slices(b, text_col):
                lang, score = shared.value.predict(piece.column(text_col), least_known)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang, pa.string()), pa.array(score)], [*names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: language of every document; every fourth bucket of ids is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(bucket_of("doc_id") != 2))
    found = identify(docs.select("doc_id", (bucket_of("doc_id") == 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
