"""Every query of the catalog against its SQL, or against a naive version."""

import numpy as np
import pytest
from compare import DATA, same
from test_watershed import naive_segments

from gridwright.functions import kernels
from gridwright.plans import catalog
from gridwright.sources import tables


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_queries_without_sql(spark):
    """These two follow an order of steps that SQL cannot: naive versions here, properties in test_watershed.py."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"segment_sparse", "watershed"}
    edges = sorted((r.w, r.src, r.dst) for r in tables.order_graph(spark, DATA).collect())
    want = naive_segments(max(max(a, b) for _, a, b in edges), [(a - 1, b - 1, w) for w, a, b in edges], 0.2, 5, True)
    assert {r.node: r.label for r in catalog.QUERIES["segment_sparse"](spark, DATA).collect()} == {i + 1: s + 1 for i, s in enumerate(want)}
    image = {(r.y, r.x): r.v for r in tables.scalar_map(spark, DATA).collect()}
    h, w = (1 + max(k[i] for k in image) for i in (0, 1))
    levels = np.array([[int(np.floor(round(image[y, x], 9) * 255)) for x in range(w)] for y in range(h)])
    value, basin, n = kernels.watershed(levels, 12, 4)
    for r in catalog.QUERIES["watershed"](spark, DATA).collect():
        assert (r.v, r.basin, r.n_minima, r.n_labels) == (round(value[r.y, r.x] / 255, 6), basin[r.y, r.x], n, n + 1)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
