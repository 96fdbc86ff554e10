"""Graphs as text: an optional line `#rs R cs C`, a line `n m`, `val sommets`, n lines `i value`, `arcs values`, m lines `a b value`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices id, v; arcs a, b, w). Lines of two and three numbers are told apart by their shape; the first line of two
    integers after the comment gives the sizes and is no vertex."""
    lines = spark.read.text(path).select(F.trim("value").alias("t"), F.monotonically_increasing_id().alias("nr"))
    head = lines.where(F.col("t").rlike(r"^\d+\s+\d+$")).agg(F.min("nr")).first()[0]
    pair, triple = rf"^(\d+)\s+{NUMBER}$", rf"^(\d+)\s+(\d+)\s+{NUMBER}$"
    part = lambda p, i, t: F.regexp_extract("t", p, i).cast(t)
    vertices = lines.where(F.col("t").rlike(pair) & (F.col("nr") != (head if head is not None else -1))).select(part(pair, 1, "int").alias("id"), part(pair, 2, "double").alias("v"))
    arcs = lines.where(F.col("t").rlike(triple)).select(part(triple, 1, "int").alias("a"), part(triple, 2, "int").alias("b"), part(triple, 3, "double").alias("w"))
    return vertices, arcs


def lines(vertices: DataFrame, arcs: DataFrame, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """(nr, line) in the order of the file."""
    spark = vertices.sparkSession
    n, m = vertices.count(), arcs.count()
    head = ([f"#rs {rows} cs {cols}"] if rows and cols else []) + [f"{n} {m}", "val sommets"]
    fixed = [(0, i, t) for i, t in enumerate(head)] + [(2, 0, "arcs values")]
    base = spark.createDataFrame(fixed, "part int, nr long, line string")
    v = vertices.select(F.lit(1).alias("part"), F.col("id").cast("long").alias("nr"), F.concat_ws(" ", "id", "v").alias("line"))
    a = arcs.select(F.lit(3).alias("part"), (F.col("a").cast("long") * F.lit(1 << 31) + F.col("b")).alias("nr"), F.concat_ws(" ", "a", "b", "w").alias("line"))
    return base.union(v).union(a)


def write(vertices: DataFrame, arcs: DataFrame, path: str, rows: int | None = None, cols: int | None = None) -> None:
    """One sorted set of part files; read together in order of their names they are the text."""
    lines(vertices, arcs, rows, cols).repartitionByRange("part", "nr").sortWithinPartitions("part", "nr").select("line").write.text(path)
