"""Labelling and extrema of volumes (image_id, z, y, x, v), spread over the cluster: no image or volume is one task's work.

Coordinates count from 0; images are volumes with z = 0. Voxels that are absent or null are outside of the volume. Labels are the
smallest voxel, by z, y, x, of what they name. The neighbourhood is 4 or 8 (within a slice), 6, 18 or 26, or any list of offsets
(dz, dy, dx), of which one of each opposite two is enough.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.kernels import REACH
from gridwright.operators import distributed
from gridwright.session import save

PLACE = ["image_id", "z", "y", "x"]


def offsets(connex: int) -> list[tuple[int, int, int]]:
    """Half of a neighbourhood: the steps that lead to later voxels."""
    if connex not in REACH:
        raise ValueError(f"unknown neighbourhood: {connex}")
    steps = itertools.product((-1, 0, 1), repeat=3)
    return [o for o in steps if o > (0, 0, 0) and sum(map(abs, o)) <= REACH[connex] and (connex not in (4, 8) or not o[0])]


def _numbered(voxels: DataFrame) -> tuple[DataFrame, int]:
    """The voxels with a number each (node), and the count of numbers that a volume takes."""
    rows = voxels.where("v is not null").select(*[F.col(c).cast("long").alias(c) for c in PLACE], "v")
    depth, height, width = (int(n or 0) + 1 for n in rows.agg(F.max("z"), F.max("y"), F.max("x")).first())
    span = depth * height * width
    return save(rows.withColumn("node", F.col("image_id") * span + (F.col("z") * height + F.col("y")) * width + F.col("x")), "voxels"), span


def _pairs(rows: DataFrame, steps: Iterable[tuple[int, int, int]]) -> DataFrame:
    """(u, v, a, b): numbers and values of neighbours. Every voxel asks for the places that its steps lead to, an equi-join."""
    moves = F.array(*[F.struct(*[F.lit(d).alias(c) for c, d in zip("zyx", o)]) for o in steps])
    asked = rows.withColumn("o", F.explode(moves)).select("image_id", *[(F.col(c) + F.col(f"o.{c}")).alias(c) for c in "zyx"], F.col("node").alias("u"), F.col("v").alias("a"))
    return asked.join(rows.select(*PLACE, F.col("node").alias("other"), F.col("v").alias("b")), PLACE).select("u", F.col("other").alias("v"), "a", "b")


def _placed(rows: DataFrame, span: int) -> DataFrame:
    return rows.select("image_id", *[F.col(c).cast("int").alias(c) for c in "zyx"], (F.col("root") - F.col("image_id") * span).alias("label"))


def labels(voxels: DataFrame, connex: int | list[tuple[int, int, int]] = 6) -> DataFrame:
    """(image_id, z, y, x, label) of the set voxels (v <> 0) by connected part."""
    rows, span = _numbered(voxels.where("v <> 0"))
    found = distributed.components(_pairs(rows, offsets(connex) if isinstance(connex, int) else connex).select("u", "v"))
    return _placed(rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), span)


def extrema(voxels: DataFrame, kind: str = "minima", connex: int | list[tuple[int, int, int]] = 6) -> DataFrame:
    """(image_id, z, y, x, label) of the voxels in regional minima (maxima): plateaus of equal voxels without a lower (higher)
    neighbour. A volume of one value is one extremum."""
    if kind not in ("minima", "maxima"):
        raise ValueError(f"unknown extrema: {kind}")
    rows, span = _numbered(voxels)
    near = save(_pairs(rows, offsets(connex) if isinstance(connex, int) else connex), "voxel-pairs")
    found = distributed.components(near.where("a = b").select("u", "v"))
    plateau = save(rows.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "plateaus")
    above = F.col("a") > F.col("b") if kind == "minima" else F.col("a") < F.col("b")
    beaten = near.where("a <> b").select(F.when(above, F.col("u")).otherwise(F.col("v")).alias("node")).distinct()
    lost = plateau.select("node", "root").join(beaten, "node", "left_semi").select("root").distinct()
    return _placed(plateau.join(lost, "root", "left_anti"), span)
