"""Images whose last row ends early, against the SQL of their queries."""

import numpy as np
import pandas as pd
import pytest
from compare import same

from gridwright.functions import filters
from gridwright.operators import morphology
from gridwright.plans import catalog

DERICHE = [f"deriche_{m}" for m in ("modulus", "direction", "laplacian", "sharpen", "smooth", "dx", "dy")]


@pytest.fixture(scope="module", params=[7, 31, 60])
def ragged(request, tmp_path_factory):
    """So many vectors, 25 a row."""
    rng, n = np.random.default_rng(request.param), request.param
    base = tmp_path_factory.mktemp(f"ragged{n}")
    vectors = np.round(rng.uniform(-0.5, 0.5, (n, 4)), 1).astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(vectors), "label": rng.integers(0, 3, n).astype(np.int32)}).to_parquet(base / "embeddings.parquet")
    return str(base)


@pytest.mark.parametrize("name", [*DERICHE, "shen_castan"])
def test_filters(spark, ragged, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], ragged)


MAPS = ["h_minima", "h_maxima", "regional_minima", "regional_maxima", "height_segments", "height_segments_grown", "height_opening"]


@pytest.mark.parametrize("name", MAPS)
def test_extrema(spark, ragged, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], ragged)


@pytest.mark.parametrize("name", ["component_tree", "volume_tree6", "volume_tree26"])
def test_trees(spark, ragged, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], ragged)


def test_parts_of_a_map_are_trees_of_their_own(spark):
    maps = spark.createDataFrame([(0, 0, 0, -3), (0, 0, 2, 4), (0, 0, 3, 6)], "image_id long, y int, x int, v long")
    got = sorted((r.pixel, r.parent, r.area, r.volume) for r in morphology.component_tree(maps).collect())
    assert got == [(0, 0, 1, 0.0), (2, 2, 2, 2.0), (3, 2, 1, 2.0)]


def test_nothing_sinks_through_absent_pixels(spark):
    rows = [(0, 0, 0, 0), (0, 0, 2, 9), (0, 1, 2, 7)]
    maps = spark.createDataFrame(rows, "image_id long, y int, x int, v long")
    got = {(r.y, r.x): r.v for r in morphology.h_minima(maps, 5).collect()}
    assert got == {(0, 0): 5, (0, 2): 12, (1, 2): 12}
    got = {(r.y, r.x): r.v for r in morphology.extrema(maps).collect()}
    assert got == {(0, 0): 1, (0, 2): 0, (1, 2): 2}


def test_second_differences_skip_holes():
    there = np.array([[True, False, True, True, False]])
    f = np.where(there, 1.0 + np.arange(5.0), 0)[0:1]
    before, after, has, more = filters._near(there, 1)
    assert before[there].tolist() == [0, 0, 2] and after[there].tolist() == [2, 3, 3]
    assert has[there].tolist() == [False, True, True] and more[there].tolist() == [True, True, False]
    s = filters.smooth(f, 1, 1.0)[0]
    assert np.allclose(filters.second(f, 1, 1.0, there)[there], [s[2] - s[0], s[3] - 2 * s[2] + s[0], s[2] - s[3]])
