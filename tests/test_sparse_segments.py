"""Sparse graphs that pass through a worker in chunks of edges."""

import numpy as np
import pytest
from test_watershed import naive_segments

from gridwright.functions import kernels
from gridwright.operators import segment
from gridwright.operators.grouped import per_sorted
from gridwright.sources import tables


@pytest.mark.parametrize("adaptive", [True, False])
def test_chunks_make_the_segments_of_one_pass(adaptive):
    rng = np.random.default_rng(7)
    for _ in range(200):
        m, thres, minsize = int(rng.integers(1, 80)), float(rng.choice([0.2, 1.5, 3])), int(rng.integers(1, 7))
        u, v, w = rng.integers(0, 25, m), rng.integers(0, 25, m), np.sort(rng.integers(0, 12, m) / rng.choice([1, 10, 50]))
        n, chunk = int(max(u.max(), v.max())) + 1, int(rng.integers(1, 9))
        sets = kernels.Segments(thres, minsize, adaptive)
        for i in range(0, m, chunk):
            sets.add(u[i : i + chunk], v[i : i + chunk], w[i : i + chunk])
        assert sets.labels(3).tolist() == kernels.segment(n, u, v, w, thres, minsize, adaptive).tolist()


def test_a_graph_comes_in_pieces_and_in_order(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(a), int(b), float(w)) for g in (3, 5) for a, b, w in zip(rng.integers(1, 60, 150), rng.integers(1, 60, 150), rng.integers(0, 30, 150) / 10)]
    edges = spark.createDataFrame(rows, "graph_id long, src long, dst long, w double")

    def kernel(pieces):
        for e in pieces:
            yield {"n": np.full(len(e["w"]), len(e["w"])), **{k: e[k] for k in ("w", "src", "dst")}}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        seen = per_sorted(edges, "graph_id", ["w", "src", "dst"], kernel, "n long, w double, src long, dst long").collect()
        got = segment.segment_sparse(edges, 1.5, 4, chunk=40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(r.n for r in seen) <= 16
    for g in (3, 5):
        mine = sorted((w, a, b) for k, a, b, w in rows if k == g)
        assert [(r.w, r.src, r.dst) for r in seen if r.graph_id == g] == mine
        want = naive_segments(max(max(a, b) for _, a, b in mine), [(a - 1, b - 1, w) for w, a, b in mine], 1.5, 4, True)
        assert {r.node: r.label for r in got if r.graph_id == g} == {i + 1: s + 1 for i, s in enumerate(want)}


def test_keys_from_zero_are_nodes_of_their_own(spark, tmp_path):
    spark.createDataFrame([(0, 0, 0.0), (1, 1, 0.5), (2, 1, 0.5)], "l_partkey long, l_suppkey long, l_discount double").write.parquet(str(tmp_path / "lineitem.parquet"))
    edges = sorted((r.src, r.dst) for r in tables.order_graph(spark, str(tmp_path)).collect())
    assert edges == [(1, 4), (2, 5), (3, 5)]
    with pytest.raises(Exception, match="numbered from 1"):
        segment.segment_sparse(spark.createDataFrame([(0, 0, 1, 0.0)], "graph_id long, src long, dst long, w double")).collect()
