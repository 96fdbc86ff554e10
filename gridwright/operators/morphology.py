"""Extrema, labelling, component trees and recursive filters of scalar maps (image_id, y, x, v). Images may have holes, or a last row
that ends early: absent pixels are no neighbours and hold nothing; to recursive filters they are 0, before and after every pass."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions import filters, kernels
from gridwright.operators import distributed
from gridwright.operators.grouped import per_group


def _image(c: dict, absent: float = 0, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pixels as a rectangle of that width at least, with a value for those that are absent, and which are there."""
    out = np.full((int(c["y"].max()) + 1, max(width, int(c["x"].max()) + 1)), absent, c["v"].dtype)
    there = np.zeros(out.shape, bool)
    out[c["y"], c["x"]], there[c["y"], c["x"]] = c["v"], True
    return out, there


def _mapped(maps: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], kind: str, absent: Callable[[np.ndarray], int]) -> DataFrame:
    """absent: what pixels that are not there count as, from the values of those that are."""

    def run(c: dict) -> dict:
        out = kernel(_image(c, absent(c["v"]))[0])
        return {"y": c["y"], "x": c["x"], "v": out[c["y"], c["x"]]}

    return per_group(maps.select("image_id", "y", "x", "v"), "image_id", run, f"y int, x int, v {kind}")


def _filtered(maps: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> DataFrame:
    """kernel gets the image with 0 for absent pixels, and which are there."""

    def run(c: dict) -> dict:
        image, there = _image(c, width=width)
        return {"y": c["y"], "x": c["x"], "v": kernel(image.astype(float), there)[c["y"], c["x"]]}

    return per_group(maps.select("image_id", "y", "x", "v"), "image_id", run, "y int, x int, v double")


def deriche(maps: DataFrame, alpha: float = 1.0, mode: str = "modulus", weight: float = 1.0, width: int = 0) -> DataFrame:
    """Recursive filter: modulus, direction, laplacian, sharpen, smooth, dx or dy. width: of the image, if its pixels may not show it."""
    return _filtered(maps, lambda f, there: filters.deriche(f, alpha, mode, weight, there), width)


def shen_castan(maps: DataFrame, beta: float = 0.5, width: int = 0) -> DataFrame:
    return _filtered(maps, lambda f, there: filters.shen_castan(f, beta, there), width)


def volume_filter(voxels: DataFrame, alpha: float = 1.0, mode: str = "smooth") -> DataFrame:
    """The same on volumes: image_id, z, y, x, v."""

    def run(c: dict) -> dict:
        f = np.zeros(tuple(int(c[k].max()) + 1 for k in "zyx"))
        there = np.zeros(f.shape, bool)
        f[c["z"], c["y"], c["x"]], there[c["z"], c["y"], c["x"]] = c["v"], True
        out = filters.deriche(f, alpha, mode, there=there)
        return {k: c[k] for k in "zyx"} | {"v": out[c["z"], c["y"], c["x"]]}

    return per_group(voxels, "image_id", run, "z int, y int, x int, v double")


def _over(height: int = 0) -> Callable[[np.ndarray], int]:
    """A level that no filling by `height` reaches, so that nothing sinks through absent pixels."""
    return lambda v: v.max() + height + 1


def _under(height: int = 0) -> Callable[[np.ndarray], int]:
    return lambda v: v.min() - height - 1


def h_minima(maps: DataFrame, height: int, connex: int = 4) -> DataFrame:
    """Integer maps with minima shallower than `height` filled."""
    return _mapped(maps, lambda f: kernels.reconstruct_by_erosion(f.astype(np.int64), height, connex), "long", _over(height))


def h_maxima(maps: DataFrame, height: int, connex: int = 4) -> DataFrame:
    return _mapped(maps, lambda f: -kernels.reconstruct_by_erosion(-f.astype(np.int64), height, connex), "long", _under(height))


def height_segments(maps: DataFrame, height: int, connex: int = 4, grown: bool = False) -> DataFrame:
    """Integer maps as the maxima that stay when peaks lower than `height` are cut off, numbered from 1 in raster order, 0 elsewhere;
    grown: each with the largest component around it that holds no other."""
    return _mapped(maps, lambda f: kernels.height_segments(f, height, connex, grown), "long", _under(height))


def height_opening(maps: DataFrame, height: int, connex: int = 4) -> DataFrame:
    """Integer maps without peaks lower than `height`, where what stays keeps its highest peak whole, unlike in h_maxima."""
    return _mapped(maps, lambda f: kernels.height_opening(f, height, connex), "long", _under(height))


def extrema(maps: DataFrame, kind: str = "minima", connex: int = 4) -> DataFrame:
    """Regional minima or maxima, numbered from 1 in raster order, 0 elsewhere."""
    if kind not in ("minima", "maxima"):
        raise ValueError(f"unknown extrema: {kind}")
    return _mapped(maps, lambda f: kernels.regional_minima(f if kind == "minima" else -f, connex)[0], "long", _over() if kind == "minima" else _under())


def _nodes(image: np.ndarray, there: np.ndarray, connex: int) -> dict:
    parent, area, volume = kernels.component_tree(image, connex, there)
    at = np.flatnonzero(there)
    return {"pixel": at, "parent": parent[at], "area": area[at], "volume": volume[at]}


def component_tree(maps: DataFrame, connex: int = 4) -> DataFrame:
    """(image_id, pixel, parent, area, volume) of the tree of components at or above each level; areas and volumes are whole at
    pixels that name a component."""

    def run(c: dict) -> dict:
        return _nodes(*_image(c), connex)

    return per_group(maps.select("image_id", "y", "x", "v"), "image_id", run, "pixel long, parent long, area long, volume double")


def volume_tree(voxels: DataFrame, connex: int = 6) -> DataFrame:
    """The same on volumes (image_id, z, y, x, v); pixel and parent are voxels by z, y, x."""

    def run(c: dict) -> dict:
        f = np.zeros(tuple(int(c[k].max()) + 1 for k in "zyx"), c["v"].dtype)
        there = np.zeros(f.shape, bool)
        f[c["z"], c["y"], c["x"]], there[c["z"], c["y"], c["x"]] = c["v"], True
        return _nodes(f, there, connex)

    return per_group(voxels.select("image_id", "z", "y", "x", "v"), "image_id", run, "pixel long, parent long, area long, volume double")


def strongest(maps: DataFrame, n: int, connex: int = 4) -> DataFrame:
    """(image_id, y, x, v): 1 on the n regional maxima whose peaks stand highest over the level at which they meet a
    higher one, 0 elsewhere; ties go by raster order."""

    def kernel(f: np.ndarray) -> np.ndarray:
        rise = kernels.peak_rises(f, connex)
        label, _ = kernels.regional_minima(-f, connex)
        best: dict[int, float] = {}
        for p, k in enumerate(label.ravel().tolist()):
            if k:
                best[k] = max(best.get(k, 0.0), rise[p])
        chosen = sorted(best, key=lambda k: (-best[k], k))[:n]
        return np.isin(label, chosen).astype(np.int64)

    return _mapped(maps, kernel, "long", _under())


def binary_labels(mask: DataFrame, width: int, offsets: tuple[tuple[int, int], ...] = ((0, 1), (1, 0))) -> DataFrame:
    """(image_id, y, x, label) of set pixels (v <> 0), joined over any (dy, dx) offsets; label is the smallest pixel. Spread over
    the cluster: the pixels are joined with their shifted selves, then contracted in rounds."""
    on = mask.where("v <> 0").select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    span = (on.agg(F.max("y")).first()[0] or 0) * width + width
    node = F.col("image_id") * span + F.col("y") * width + F.col("x")
    moved = on.withColumn("u", node).withColumn("o", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])))
    moved = moved.select("image_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "u")
    found = distributed.components(moved.join(on.withColumn("v", node), ["image_id", "y", "x"]).select("u", "v"))
    return on.withColumn("node", node).join(found, "node", "left").select("image_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), (F.coalesce("root", "node") - F.col("image_id") * span).alias("label"))
