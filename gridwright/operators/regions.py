"""Pooling, geometry, adjacency, overlap and colours of segmentations, as DataFrame plans.

segm: image_id, y, x, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distributed

PLACE = ["image_id", "y", "x"]


def hist_pooling(pixels: DataFrame, segm: DataFrame, histmax: bool = False, minconfidence: float = 0.0, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pooled pixels, regions). Each region's channels are summed over its pixels that are sure enough (largest channel less
    second largest) and divided by their number plus 1 (exact: by their number, null if none). pooled: that vector on each
    pixel, or 1 at its largest channel, the last of equals. regions: image_id, label, class (from 1), surface, centroid."""
    f = F.col("f").cast("array<double>")
    rows = pixels.select(*PLACE, f.alias("f")).join(segm.select(*PLACE, "label"), PLACE)
    ordered = F.sort_array("f", asc=False)
    sure = F.lit(True) if minconfidence <= 0 else F.coalesce(ordered[0] - F.get(ordered, F.lit(1)), F.lit(float("inf"))) >= minconfidence
    rows = rows.withColumn("sure", sure)
    key = ["image_id", "label"]
    shape = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("surface"), F.count(F.when(F.col("sure"), 1)).alias("n_sure"), F.avg(F.col("x") + 1).alias("centroid_x"), F.avg(F.col("y") + 1).alias("centroid_y"))
    sums = rows.select(*key, "sure", F.posexplode("f").alias("ch", "v")).groupBy(*key, "ch").agg(F.sum(F.when(F.col("sure"), F.col("v")).otherwise(0.0)).alias("s"))
    sums = sums.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "s"))), lambda p: p["s"]).alias("sums"))
    count = F.when(F.col("n_sure") > 0, F.col("n_sure")) if exact else F.col("n_sure") + 1
    mean = shape.join(sums, key).withColumn("mean", F.transform("sums", lambda v: v / count))
    top = F.array_max("mean")
    last = F.size("mean") - F.array_position(F.reverse("mean"), top) + 1
    mean = mean.withColumn("class", last.cast("int"))
    value = F.transform("mean", lambda v, i: (i + 1 == F.col("class")).cast("double")) if histmax else F.col("mean")
    pooled = segm.select(*PLACE, "label").join(mean.select(*key, value.alias("f")), key).select(*PLACE, "f")
    return pooled, mean.select(*key, "class", "surface", "centroid_x", "centroid_y")


def adjacency(segm: DataFrame) -> DataFrame:
    """(image_id, id, neighbor): labels that touch to the east or south, both ways, once each."""
    right, below = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    east, south = F.lead(F.struct("x", "label")).over(right), F.lead(F.struct("y", "label")).over(below)
    rows = segm.select("image_id", "y", "x", "label").withColumn("e", east).withColumn("s", south)
    near = F.array(F.when(F.col("e.x") == F.col("x") + 1, F.col("e.label")), F.when(F.col("s.y") == F.col("y") + 1, F.col("s.label")))
    pairs = rows.select("image_id", F.col("label").alias("a"), F.explode(F.array_compact(near)).alias("b")).where("a <> b")
    both = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbor")), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbor"))))
    return pairs.select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("image_id", both.alias("p")).select("image_id", "p.*")


def adjacency_lists(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("image_id", "id").agg(F.sort_array(F.collect_set("neighbor")).alias("neighbors"))


def with_neighbours(parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """A component list with `neighbors`: the sorted ids of those listed components that `pairs` (of segments or of a tree) join
    to each. Neighbours that the list lacks, as by minsize, are left out; a component without any has an empty list."""
    listed = pairs.select("image_id", F.col("id").cast("long").alias("id"), F.col("neighbor").cast("long").alias("neighbor"))
    listed = listed.join(parts.select("image_id", F.col("id").cast("long").alias("neighbor")), ["image_id", "neighbor"], "left_semi")
    return parts.join(adjacency_lists(listed), ["image_id", "id"], "left").withColumn("neighbors", F.coalesce("neighbors", F.array().cast("array<long>")))


def components(segm: DataFrame, minsize: int = 1) -> DataFrame:
    """Geometry of each label; coordinates from 1, bbox ends included."""
    x, y = F.col("x") + 1, F.col("y") + 1
    out = segm.groupBy("image_id", F.col("label").cast("long").alias("id")).agg(
        F.avg(x).alias("centroid_x"), F.avg(y).alias("centroid_y"), F.count(F.lit(1)).alias("surface"),
        F.min(x).cast("int").alias("bbox_left"), F.max(x).cast("int").alias("bbox_right"), F.min(y).cast("int").alias("bbox_top"), F.max(y).cast("int").alias("bbox_bottom"),
    ).where(F.col("surface") >= minsize)
    return out.withColumns({"bbox_width": F.expr("bbox_right - bbox_left + 1"), "bbox_height": F.expr("bbox_bottom - bbox_top + 1"), "bbox_x": F.expr("(bbox_right + bbox_left) / 2"), "bbox_y": F.expr("(bbox_bottom + bbox_top) / 2")})


def patches(pixels: DataFrame, segm: DataFrame, config: str = "bbox", minsize: int = 1) -> DataFrame:
    """Crops of regions of minsize pixels or more: image_id, id, y, x (from 0 within the bbox), f, inside. bbox: all pixels of
    the box; mask: inside alone, without channels; masked: channels are 0 outside."""
    if config not in ("bbox", "mask", "masked"):
        raise ValueError(f"unknown config: {config}")
    boxes = components(segm, minsize).select("image_id", "id", "bbox_left", "bbox_right", "bbox_top", "bbox_bottom")
    rows = pixels.join(segm.select(*PLACE, "label"), PLACE)
    # a box asks for its rows one by one, so this is an equi-join with a range left over, not a product
    lines = boxes.withColumn("y", F.explode(F.sequence(F.col("bbox_top") - 1, F.col("bbox_bottom") - 1)))
    hit = rows.join(lines, ["image_id", "y"]).where((F.col("x") >= F.col("bbox_left") - 1) & (F.col("x") <= F.col("bbox_right") - 1))
    inside = F.col("label") == F.col("id")
    f = F.col("f") if config == "bbox" else F.when(inside, F.col("f")).otherwise(F.transform("f", lambda v: v * 0))
    out = hit.select("image_id", "id", (F.col("y") - F.col("bbox_top") + 1).cast("int").alias("y"), (F.col("x") - F.col("bbox_left") + 1).cast("int").alias("x"), f.alias("f"), inside.alias("inside"))
    return out.drop("f") if config == "mask" else out


def overlap(segment: DataFrame, mask: DataFrame, nb_classes: int) -> DataFrame:
    """(image_id, class, ratio) for classes 1 to nb_classes: the share of the segment's pixels (v >= 1) that the mask (label)
    gives to the class; null for an empty segment."""
    inside = segment.where("v >= 1").select(*PLACE)
    size = inside.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"))
    images = segment.select("image_id").distinct().withColumn("class", F.explode(F.sequence(F.lit(1), F.lit(nb_classes))))
    hits = inside.join(mask.select(*PLACE, F.col("label").cast("int").alias("class")), PLACE).groupBy("image_id", "class").agg(F.count(F.lit(1)).alias("k"))
    return images.join(hits, ["image_id", "class"], "left").join(size, "image_id", "left").select("image_id", "class", F.when(F.col("n") > 0, F.coalesce("k", F.lit(0)) / F.col("n")).alias("ratio"))


def connected_overlap(overlaps: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, segment, label, iou) from pixel tables (image_id, y, x, label) of segments and of connected regions."""
    a, b = overlaps.select(*PLACE, F.col("label").alias("segment")), truth.select(*PLACE, "label")
    both = a.join(b, PLACE).groupBy("image_id", "segment", "label").agg(F.count(F.lit(1)).alias("i"))
    na, nb = a.groupBy("image_id", "segment").agg(F.count(F.lit(1)).alias("na")), b.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("nb"))
    return both.join(na, ["image_id", "segment"]).join(nb, ["image_id", "label"]).select("image_id", "segment", "label", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("iou"))


def equal_regions(segm: DataFrame, width: int) -> DataFrame:
    """(image_id, y, x, label, region): 4-connected pixels of one label are a region, numbered by its smallest pixel."""
    rows = segm.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "label")
    span = (rows.agg(F.max("y")).first()[0] or 0) * width + width
    rows = rows.withColumn("node", F.col("image_id") * span + F.col("y") * width + F.col("x"))
    moved = rows.withColumn("o", F.explode(F.array(F.struct(F.lit(0).alias("dy"), F.lit(1).alias("dx")), F.struct(F.lit(1).alias("dy"), F.lit(0).alias("dx")))))
    moved = moved.select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "label", F.col("node").alias("u"))
    found = distributed.components(moved.join(rows.withColumnRenamed("node", "v"), [*PLACE, "label"]).select("u", "v"))
    return rows.join(found, "node", "left").select(*PLACE, "label", (F.coalesce("root", "node") - F.col("image_id") * span).alias("region"))


def flooded_overlap(overlaps: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """(image_id, segment, label, iou) from pixel tables (image_id, y, x, label) of segments and of classes. The union is the
    segment and those 4-connected regions of the class that have a pixel in it."""
    a, b = overlaps.select(*PLACE, F.col("label").alias("segment")), equal_regions(truth, width)
    size = b.groupBy("image_id", "region").agg(F.count(F.lit(1)).alias("n"))
    met = a.join(b, PLACE).groupBy("image_id", "segment", "label", "region").agg(F.count(F.lit(1)).alias("i"))
    both = met.join(size, ["image_id", "region"]).groupBy("image_id", "segment", "label").agg(F.sum("i").alias("i"), F.sum("n").alias("nb"))
    na = a.groupBy("image_id", "segment").agg(F.count(F.lit(1)).alias("na"))
    return both.join(na, ["image_id", "segment"]).select("image_id", "segment", "label", (F.col("i") / (F.col("na") + F.col("nb") - F.col("i"))).alias("iou"))


def decision(proposals: DataFrame, scores: DataFrame, pixels: DataFrame, t1: float, t2: float, t3: float | None = None) -> DataFrame:
    """(image_id, y, x, class): fuses scored proposals. proposals: image_id, seg, y, x; scores: image_id, seg, class (from 0), f.

    The segment with the best score leads (ties: the smaller number); those whose intersection with it, over the smaller of the
    two, exceeds t1 vote along. Each pixel sums the votes by class and takes the best, the first of equals, plus 3, or 2
    (background) if that is below t2. t3 is accepted and has no effect."""
    best = scores.groupBy("image_id", "seg").agg(F.max("f").alias("m"))
    leader = best.groupBy("image_id").agg(F.min(F.struct((-F.col("m")).alias("m"), "seg"))["seg"].alias("lead"))
    size = proposals.groupBy("image_id", "seg").agg(F.count(F.lit(1)).alias("n"))
    lead = proposals.join(leader, "image_id").where("seg = lead").select(*PLACE)
    n_lead = lead.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_lead"))
    shared = proposals.join(lead, PLACE).groupBy("image_id", "seg").agg(F.count(F.lit(1)).alias("k"))
    voters = shared.join(size, ["image_id", "seg"]).join(n_lead, "image_id").where(F.col("k") / F.least("n", "n_lead") > t1).select("image_id", "seg")
    votes = proposals.join(voters, ["image_id", "seg"]).join(scores, ["image_id", "seg"]).groupBy(*PLACE, "class").agg(F.sum("f").alias("g"))
    top = votes.groupBy(*PLACE).agg(F.min(F.struct((-F.col("g")).alias("g"), "class")).alias("t"))
    value = F.when(F.coalesce(-F.col("t.g"), F.lit(0.0)) < t2, 2).otherwise(F.coalesce(F.col("t.class"), F.lit(0)) + 3)
    return pixels.select(*PLACE).join(top, PLACE, "left").select(*PLACE, value.cast("int").alias("class"))


def random_colour(label: Column, channels: int = 3) -> Column:
    """Deterministic stand-in for a random colour: the first 20 bits of MD5 of label:channel, in [0, 1)."""
    drawn = lambda c: F.conv(F.substring(F.md5(F.concat(label.cast("long").cast("string"), F.lit(f":{c}")).cast("binary")), 1, 5), 16, 10)
    return F.array(*[drawn(c).cast("double") / float(1 << 20) for c in range(channels)])


def colorize(segm: DataFrame, colormap: DataFrame | None = None, channels: int = 3) -> DataFrame:
    """(image_id, y, x, color): the colour of each label; one that is missing or -1 is drawn by hash."""
    fallback = random_colour(F.col("label"), channels)
    if colormap is None:
        return segm.select(*PLACE, fallback.alias("color"))
    known = colormap.select(F.col("id").cast("long").alias("label"), F.col("color").cast("array<double>").alias("known"))
    unset = F.col("known").isNull() | (F.col("known")[0] == -1)
    return segm.withColumn("label", F.col("label").cast("long")).join(known, "label", "left").select(*PLACE, F.when(unset, fallback).otherwise(F.col("known")).alias("color"))


def drawn_colormap(segm: DataFrame, colormap: DataFrame | None = None, channels: int = 3) -> DataFrame:
    """(id, color): the colour map that colorize() draws with, one row for each label of segm and of the given map."""
    ids = segm.select(F.col("label").cast("long").alias("label")).distinct()
    if colormap is not None:
        ids = ids.union(colormap.select(F.col("id").cast("long"))).distinct()
    return colorize(ids.select(F.lit(0).alias("image_id"), F.lit(0).alias("y"), F.col("label").alias("x"), "label"), colormap, channels).select(F.col("x").alias("id"), "color")


def colormap(colors: DataFrame, default: float = 0.0) -> DataFrame:
    """(id, color) for every id from 0 to the largest; those without a colour are filled with the default."""
    bounds = colors.agg(F.max("id").alias("top"), F.max(F.size("color")).alias("n"))
    ids = bounds.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias("id"), "n")
    return ids.join(colors.select(F.col("id").cast("long"), "color"), "id", "left").select("id", F.coalesce(F.col("color").cast("array<double>"), F.array_repeat(F.lit(float(default)), F.col("n").cast("int"))).alias("color"))
