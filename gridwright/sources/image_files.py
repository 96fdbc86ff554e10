"""Image files (PNG, JPEG, BMP, GIF) as pixel tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pixels in an Arrow batch: what one step of a worker holds beside the image itself.
BATCH = 65_536


def file_ids(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, origin): the files under path, numbered from 0 in the order of their names. Only names are read; the window
    is one partition with a row a file, good to some millions of files."""
    names = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("origin"))
    return names.select((F.row_number().over(Window.orderBy("origin")) - 1).cast("long").alias("image_id"), "origin")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, y, x, f) of every pixel of the images under path; f: grey, or red, green, blue, and alpha where there is one,
    from 0 to 1. A file that is no image has no pixels. An image is decoded in one task, its pixels leave in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                origin, width, channels, data = (b.column(c)[i] for c in range(4))
                n, step = width.as_py(), channels.as_py()
                if n <= 0 or step <= 0:
                    continue
                values = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, step)
                order = [2, 1, 0, 3][:step] if step > 1 else [0]  # files come as blue, green, red
                for start in range(0, len(values), BATCH):
                    part = values[start : start + BATCH, order] / 255.0
                    at = np.arange(start, start + len(part))
                    f = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * step), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([origin.as_py()] * len(part)), pa.array((at // n).astype(np.int32)), pa.array((at % n).astype(np.int32)), f], ["origin", "y", "x", "f"])

    pixels = spark.read.format("image").load(path).select("_metadata.file_path", "image.width", "image.nChannels", "image.data")
    pixels = pixels.mapInArrow(run, "origin string, y int, x int, f array<double>")
    return pixels.join(file_ids(spark, path), "origin").select("image_id", "y", "x", "f")
