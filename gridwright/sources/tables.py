"""The driver's tables seen as images and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pixels in a row of the embedding image.
WIDTH = 25


def _embeddings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    place = [F.lit(0).cast("long").alias("image_id"), F.floor(F.col("vec_id") / WIDTH).cast("int").alias("y"), (F.col("vec_id") % WIDTH).cast("int").alias("x")]
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(*place, *columns)


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one image of 64 channels."""
    return _embeddings(spark, sf_dir, "embedding").withColumnRenamed("embedding", "f")


def scalar_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component, brought to [0, 1], as image_id, y, x, v."""
    return _embeddings(spark, sf_dir, "embedding").select("image_id", "y", "x", ((F.col("embedding")[0].cast("double") + 0.6) / 1.2).alias("v"))


def scalar_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar map cut into slices of five rows: image_id, z, y, x, v."""
    return scalar_map(spark, sf_dir).select("image_id", F.floor(F.col("y") / 5).cast("int").alias("z"), (F.col("y") % 5).alias("y"), "x", "v")


def scalar_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar_map(spark, sf_dir).select("image_id", "y", "x", F.array("v").alias("f"))


def label_segm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embeddings(spark, sf_dir, "label").withColumn("label", F.col("label").cast("long"))


def order_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers, numbered on from the parts, joined by their mean discount: graph_id, src, dst, w. Keys that begin below 1
    are moved up to it."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    first, top, other = lines.agg(F.min("l_partkey"), F.max("l_partkey"), F.min("l_suppkey")).first()
    part, supplier = (1 - min(1 if k is None else k, 1) for k in (first, other))
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(F.avg("l_discount").alias("w"))
    return pairs.select(F.lit(0).cast("long").alias("graph_id"), (F.col("l_partkey") + part).alias("src"), (F.col("l_suppkey") + supplier + (top or 0) + part).alias("dst"), "w")


def event_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by users: the sum of values of each event type is a channel; image_id, y, x, f."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = F.datediff(F.col("ts"), F.lit("1970-01-01")).cast("int")
    cells = events.groupBy(day.alias("y"), F.col("user_id").cast("int").alias("x")).pivot("event_type", sorted(r[0] for r in events.select("event_type").distinct().collect())).agg(F.sum("value"))
    channels = [F.coalesce(F.col(c), F.lit(0.0)) for c in cells.columns[2:]]
    return cells.select(F.lit(0).cast("long").alias("image_id"), "y", "x", F.array(*channels).alias("f"))
