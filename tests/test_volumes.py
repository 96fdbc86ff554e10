"""Volumes against brute force, component lists with neighbours, and image files."""

import struct

import numpy as np
import pytest

from gridwright.operators import regions, volumes
from gridwright.sources.image_files import read_images

VOXELS = "image_id long, z int, y int, x int, v int"


def around(place, connex):
    """All neighbours of a voxel, by distances."""
    most = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}[connex]
    for d in np.ndindex(3, 3, 3):
        d = tuple(i - 1 for i in d)
        if any(d) and sum(map(abs, d)) <= most and (connex > 8 or connex == 6 or not d[0]):
            yield tuple(a + b for a, b in zip(place, d))


def parts(values, connex):
    """Connected parts of equal values, each as the set of its voxels."""
    left, out = set(values), []
    while left:
        part = [min(left)]
        left.discard(part[0])
        for p in part:
            for q in around(p, connex):
                if q in left and values[q] == values[p]:
                    left.discard(q)
                    part.append(q)
        out.append(part)
    return out


@pytest.mark.parametrize("connex, kind", [(4, "labels"), (8, "minima"), (6, "maxima"), (18, "labels"), (26, "minima")])
def test_against_brute_force(spark, connex, kind):
    rng = np.random.default_rng(connex)
    shape = (3, 4, 5)
    grids = [rng.integers(0, 3, shape), rng.integers(0, 2, shape)]
    rows = [(i, *map(int, p), int(g[p])) for i, g in enumerate(grids) for p in np.ndindex(shape) if (sum(p) + i) % 11]  # some are absent
    df = spark.createDataFrame([*rows, (0, 0, 0, 0, None)], VOXELS)
    number = lambda p: int(np.ravel_multi_index(p, shape))
    wanted = set()
    for i in range(2):
        values = {tuple(r[1:4]): r[4] for r in rows if r[0] == i}
        if kind == "labels":
            values = {p: 1 for p, v in values.items() if v}
        for part in parts(values, connex):
            steps = [values[q] - values[p] for p in part for q in around(p, connex) if q in values]
            if kind == "labels" or all(d >= 0 if kind == "minima" else d <= 0 for d in steps):
                wanted |= {(i, *p, number(min(part))) for p in part}
    found = volumes.labels(df, connex) if kind == "labels" else volumes.extrema(df, kind, connex)
    assert {tuple(r) for r in found.collect()} == wanted


def test_edges_of_volumes(spark):
    none = spark.createDataFrame([], VOXELS)
    assert volumes.labels(none).count() == volumes.extrema(none).count() == 0
    one = spark.createDataFrame([(7, 0, 0, 0, 5)], VOXELS)
    assert [tuple(r) for r in volumes.extrema(one).collect()] == [tuple(r) for r in volumes.labels(one).collect()] == [(7, 0, 0, 0, 0)]
    diagonal = spark.createDataFrame([(0, 0, 0, 0, 1), (0, 1, 1, 0, 1)], VOXELS)
    assert {r.label for r in volumes.labels(diagonal, 6).collect()} == {0, 3}
    assert {r.label for r in volumes.labels(diagonal, [(1, 1, 0)]).collect()} == {0}
    for call in (lambda: volumes.offsets(5), lambda: volumes.extrema(one, "saddles")):
        with pytest.raises(ValueError):
            call()


def test_neighbours_in_lists(spark):
    segm = spark.createDataFrame([(0, 0, x, k) for x, k in enumerate([4, 4, 9, 2, 2, 4])] + [(1, 0, 0, 3)], "image_id long, y int, x int, label long")
    all_of = regions.with_neighbours(regions.components(segm), regions.adjacency(segm))
    assert {(r.image_id, r.id): r.neighbors for r in all_of.collect()} == {(0, 4): [2, 9], (0, 9): [2, 4], (0, 2): [4, 9], (1, 3): []}
    large = regions.with_neighbours(regions.components(segm, 2), regions.adjacency(segm))
    assert {(r.image_id, r.id): r.neighbors for r in large.collect()} == {(0, 4): [2], (0, 2): [4]}


def bitmap(image):
    """A 24-bit BMP file: rows from the bottom, blue first, padded to four bytes."""
    h, w, _ = image.shape
    body = b"".join(line[:, ::-1].tobytes().ljust((3 * w + 3) // 4 * 4, b"\0") for line in image[::-1])
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def test_image_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 256, (3, 5, 3), dtype=np.uint8), rng.integers(0, 256, (400, 300, 3), dtype=np.uint8)]
    for name, image in zip(("a b.bmp", "c.bmp"), images):
        (tmp_path / name).write_bytes(bitmap(image))
    (tmp_path / "b.bmp").write_bytes(b"no image")
    rows = read_images(spark, str(tmp_path)).collect()
    assert len(rows) == sum(i.shape[0] * i.shape[1] for i in images)
    assert {r.image_id for r in rows} == {0, 2}
    for r in rows:
        assert [round(255 * v) for v in r.f] == images[r.image_id // 2][r.y, r.x].tolist()
