"""Near copies against all pairs of shingle sets."""

from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from helpers import DOCS, documents
from test_simhash import fingerprint

from gridwright.llm import nearcopies as N
from gridwright.llm.simhash import simhash

STAGES = dict(corpus_pipeline.STAGES)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def smallest(rows):
    """Smallest id reachable from each row (id, text) over pairs of a similarity of 4/5 or more."""
    sets, label = [shingle_set(t) for _, t in rows], [i for i, _ in rows]
    pairs = [(a, b) for a, b in combinations(range(len(rows)), 2) if rows[a][0] == rows[b][0] or similarity(sets[a], sets[b]) >= 0.8]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    return label


def near_copies_of(base, rng, changes):
    w = base.split()
    for at in rng.choice(len(w), changes, replace=False):
        w[at] = f"z{rng.integers(1 << 30)}"
    return " ".join(w)


def clusters():
    """Originals of 200 words, copies at 0.8 to 0.95 and below, and chains of copies of copies."""
    rng, rows = np.random.default_rng(3), []
    for n in range(12):
        text = " ".join(f"w{rng.integers(5000)}" for _ in range(200))
        rows.append((1000 * n, text))
        rows += [(1000 * n + k, near_copies_of(text, rng, k)) for k in range(1, 9)]
        for k in range(20, 26):
            text = near_copies_of(text, rng, 3)
            rows.append((1000 * n + k, text))
    return rows


def test_stage_drops_near_copies(spark):
    rows = clusters()
    base = shingle_set(rows[0][1])
    near = [(i, t) for i, t in rows[1:9] if 0.8 <= similarity(base, shingle_set(t)) <= 0.95]
    assert len(near) >= 3 and any((simhash(rows[0][1].encode()) ^ simhash(t.encode())).bit_count() > 4 for _, t in near)
    kept = {r.doc_id for r in STAGES["simhash_near_dedup"](spark, documents(spark, rows), "").collect()}
    assert kept == set(smallest(rows)) and not kept & {i for i, _ in near}


@pytest.mark.parametrize("limit", [512, 8])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(N, "ROWS", limit)
    rows = clusters()
    got = {r.doc_id: r.component_id for r in N.near_copies(documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == smallest(rows)


def test_driver_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(DOCS).collect()]
    got = {r.doc_id: r.component_id for r in N.near_copies(spark.read.parquet(DOCS)).collect()}
    assert [got[i] for i, _ in rows] == smallest(rows)


def test_odd_rows(spark):
    docs = documents(spark, [(5, None), (3, ""), (7, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (9, "x"), (7, "x"), (8, "y")])
    got = sorted({(r.doc_id, r.component_id) for r in N.near_copies(docs).collect()}, key=str)
    assert got == [(3, 3), (5, 3), (7, 7), (8, 8), (9, 7), (None, None)]
    assert N.near_copies(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "one", "a b c", "A b\tC\nd  e", "É é x y z", "w " * 70000])
def test_fingerprint(text):
    assert N.fingerprint(N.shingles(text.encode(), 4)) == fingerprint(text)
