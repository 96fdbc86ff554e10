"""Compression classifier: how much better does a text compress with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from labelled texts. The difference of the two compressed sizes, over the root of the
length, is the one measure of a text: the difference grows with the length, but more slowly, as a text soon refers to itself
and not to the dictionary. A logistic curve, fitted on labelled texts which built no dictionary, turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bucket_of

#: Labelled texts of each class at most, drawn by hash of their id; half build the dictionary, half fit the curve.
SAMPLE = 3000
#: Bytes of a labelled text at most; longer ones are not drawn. Together these bound the sample.
LONGEST = 32_000
DICTIONARY = 112_640
LEVEL = 15
#: Bytes added to every length, so that few letters are weak evidence.
PRIOR = 200
THRESHOLD = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for content in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(content) if content else None
            if known:
                known.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -500, 500)))


def measures(texts: list[bytes], pair: list[zstandard.ZstdCompressor]) -> np.ndarray:
    """Of each text: (bad - good) / sqrt(length + PRIOR) of the compressed sizes, over 0 if the good dictionary helps more; and 1."""
    good, bad = (np.array([len(c.compress(t)) for t in texts], float) for c in pair)
    size = np.array([len(t) for t in texts], float)
    return np.stack([(bad - good) / np.sqrt(size + PRIOR), np.ones(len(texts))], axis=1)


def dictionary(texts: list[bytes]) -> bytes:
    """Trained content; where there is too little text to train on, the texts themselves, up to a dictionary's size."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[-DICTIONARY:]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 100, ridge: float = 0.1) -> np.ndarray:
    """Weights that maximise the penalised likelihood: Newton's method, with steps halved until they help. The last column is 1."""
    mean, spread = np.r_[x[:, :-1].mean(axis=0), 0], np.r_[x[:, :-1].std(axis=0) + 1e-9, 1]
    z = (x - mean) / spread
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 0]

    def loss(w: np.ndarray) -> float:
        m = z @ w
        return float(weight @ (np.logaddexp(0, m) - y * m) + penalty @ w**2 / 2)

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (weight * (p - y)) + penalty * w
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step, now = np.linalg.solve(h, g), loss(w)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    own = w / spread
    own[-1] -= own[:-1] @ mean[:-1]
    return own


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """The model of the labelled rows of docs: at most `sample` texts of each class, of `longest` bytes at most each. Labels that
    are null, not 0 or 1, or that contradict each other are left out; repeated labels count once. Of several texts with one id
    the one that sorts first is taken. Empty and null texts teach nothing. Without two texts of both classes every text has the
    score 0.5."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("top")).where("y = top").select("_id", "y")
    order = F.xxhash64("_id")
    drawn = known.where("y = 1").orderBy(order, "_id").limit(sample).union(known.where("y = 0").orderBy(order, "_id").limit(sample))
    # 2 * sample rows of two numbers: the bound of this broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.octet_length("text").between(1, longest))
    got = rows.join(F.broadcast(drawn), "_id").groupBy("_id", "y").agg(F.min("text").alias("text")).withColumn("h", F.xxhash64("text")).toPandas().sort_values(["h", "_id"])
    texts = {y: [t.encode() for t in got[got.y == y].text] for y in (0, 1)}
    if min(map(len, texts.values())) < 2:
        return Model(b"", b"", np.zeros(2))
    model = Model(dictionary(texts[1][::2]), dictionary(texts[0][::2]), np.zeros(2))
    pair = model.compressors()
    x = [measures(texts[y][1::2], pair) for y in (0, 1)]
    # the drawn classes are of like size, the corpus's are not
    many = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = [np.full(len(x[y]), many[y] / sum(many.values()) * (len(x[0]) + len(x[1])) / len(x[y])) for y in (0, 1)]
    model.weights = logistic(np.concatenate(x), np.r_[np.zeros(len(x[0])), np.ones(len(x[1]))], np.concatenate(weight))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with quality_score (a column of that name is replaced), row by row, so repeated rows and ties get equal scores. A null
    text counts as empty. No rows in, none out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("quality_score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.compressors()
        for b in batches:
            texts = [t or b"" for t in b.column(names.index(text_col)).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.score(measures(texts, pair)))], [*names, "quality_score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: quality score of every document; every fourth bucket of ids is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (bucket_of("doc_id") == 2).alias("held_out"), "text")
    model = fit(docs.where("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet").where(bucket_of("doc_id") != 2))
    return scored(docs, model).select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
