"""Edge-weighted grid graphs of images, as DataFrame plans.

pixels: image_id, y, x, f (array of channels); edges: image_id, plane, y, x, src, dst, w. Plane 0 leads to (y, x + 1), 1 to
(y + 1, x), 2 to (y + 1, x + 1), 3 to (y - 1, x + 1); src and dst are y * width + x. Edges over a border or a hole are absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (dy, dx) of each plane.
PLANES = ((0, 1), (1, 0), (1, 1), (-1, 1))
#: Rows of an image that are shuffled together. A strip also gets the row below it, so no window leaves its strip.
STRIP = 64


def distance(a: Column, b: Column, metric: str) -> Column:
    """euclid, max, or angle between two channel arrays."""
    def total(x: Column, y: Column, f) -> Column:
        return F.aggregate(F.zip_with(x, y, f), F.lit(0.0), lambda s, v: s + v)

    if metric == "euclid":
        return F.sqrt(total(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "max":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if metric == "angle":
        norm = lambda x: F.sqrt(total(x, x, lambda u, v: u * v))
        cosine = total(a, b, lambda x, y: x * y) / (norm(a) * norm(b) + 1e-8)
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    raise ValueError(f"unknown distance: {metric}")


def with_width(pixels: DataFrame, width: int | None) -> DataFrame:
    """pixels with a column `width`; unknown widths are the largest x of each image, plus 1."""
    if width is not None:
        return pixels.withColumn("width", F.lit(width).cast("long"))
    return pixels.join(pixels.groupBy("image_id").agg((F.max("x") + 1).cast("long").alias("width")), "image_id")


def graph(pixels: DataFrame, connex: int = 4, metric: str = "euclid", width: int | None = None) -> DataFrame:
    """Weights between each pixel and its neighbours to the east, south and, for 8, south-east and north-east.

    One exchange by strips of rows; each plane then is a window within a strip, along its own direction."""
    if connex not in (4, 8):
        raise ValueError("connex must be 4 or 8")
    rows = with_width(pixels, width).select("image_id", F.col("y").cast("int"), F.col("x").cast("int"), F.col("f").cast("array<double>").alias("f"), "width")
    strip = F.floor(F.col("y") / STRIP).cast("int")
    above = F.when((F.col("y") % STRIP == 0) & (F.col("y") > 0), F.array(strip, strip - 1)).otherwise(F.array(strip))
    rows = rows.withColumn("strip", F.explode(above)).repartition("image_id", "strip")
    keys = ("image_id", "strip")
    along = {
        0: Window.partitionBy(*keys, "y").orderBy("x"),
        1: Window.partitionBy(*keys, "x").orderBy("y"),
        2: Window.partitionBy(*keys, F.col("x") - F.col("y")).orderBy("y"),
        3: Window.partitionBy(*keys, F.col("x") + F.col("y")).orderBy("x"),
    }
    found = []
    for plane in range(connex // 2):
        dy, dx = PLANES[plane]
        other = F.lead(F.struct("y", "x", "f")).over(along[plane])
        rows = rows.withColumn(f"p{plane}", other)
        p = F.col(f"p{plane}")
        # an edge belongs to the strip of its upper row
        upper = F.least(F.col("y"), p["y"])
        there = (p["y"] == F.col("y") + dy) & (p["x"] == F.col("x") + dx) & (F.floor(upper / STRIP) == F.col("strip"))
        found.append(F.when(there, F.struct(F.lit(plane).alias("plane"), (p["y"].cast("long") * F.col("width") + p["x"]).alias("dst"), distance(F.col("f"), p["f"], metric).alias("w"))))
    each = rows.select("image_id", "y", "x", (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("src"), F.explode(F.array_compact(F.array(*found))).alias("e"))
    return each.select("image_id", "e.plane", "y", "x", "src", "e.dst", "e.w")


def mat2graph(image: DataFrame, uheight: int, uwidth: int) -> DataFrame:
    """Decodes an image of (2h + 1) x (2w + 1) samples: cells at even places become both planes. image: image_id, y, x, v."""
    even = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0) & (F.col("y") < 2 * uheight) & (F.col("x") < 2 * uwidth)
    cells = image.where(even).select("image_id", (F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x"), F.col("v").cast("double").alias("w"))
    src = F.col("y").cast("long") * uwidth + F.col("x")
    return cells.select("image_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("plane"), "y", "x", src.alias("src"), "w").select("image_id", "plane", "y", "x", "src", (F.col("src") + F.when(F.col("plane") == 0, 1).otherwise(uwidth)).alias("dst"), "w")


def gradient(edges: DataFrame, width: int, pixels: DataFrame | None = None) -> DataFrame:
    """Largest weight of each pixel's edges, as (image_id, y, x, v); pixels without an edge have -1, if pixels are given."""
    ends = edges.select("image_id", F.explode(F.array("src", "dst")).alias("p"), "w").groupBy("image_id", "p").agg(F.max("w").alias("v"))
    out = ends.select("image_id", F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), "v")
    if pixels is None:
        return out
    return pixels.select("image_id", F.col("y").cast("int"), F.col("x").cast("int")).join(out, ["image_id", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(-1.0)))


def khalimsky(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """The graph drawn at twice the size: pixels at even places are 0, plane 0 lies to their right, plane 1 below, and the
    cell between four pixels has the largest of the edges around it. Planes 2 and 3 are not drawn."""
    cell = lambda y, x, v: F.struct((2 * F.col("y") + y).alias("y"), (2 * F.col("x") + x).alias("x"), v.alias("v"))
    w = F.col("w")
    dots = pixels.select("image_id", cell(0, 0, F.lit(0.0)).alias("c"))
    right, below = F.array(cell(0, 1, w), cell(1, 1, w), cell(-1, 1, w)), F.array(cell(1, 0, w), cell(1, 1, w), cell(1, -1, w))
    lines = edges.where("plane < 2").select("image_id", F.explode(F.when(F.col("plane") == 0, right).otherwise(below)).alias("c")).where("c.y >= 0 and c.x >= 0")
    return dots.union(lines).select("image_id", "c.*").groupBy("image_id", "y", "x").agg(F.max("v").alias("v"))
