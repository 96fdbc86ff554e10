"""SimHash against brute force; blocks, bands and edge cases."""

import re

import numpy as np
import pytest
import xxhash
from helpers import DOCS, documents

from gridwright.llm import simhash as S


def fingerprint(text):
    """By the definition, word by word."""
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(fps, ids, radius=4):
    """Smallest id reachable from each row."""
    x = np.array(fps, np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("text", ["", None, "one", "a b c", "A b\tC\nd  e", "É é x y z", "w " * 70000])
def test_fingerprint(text):
    assert S.simhash((text or "").encode()) == fingerprint(text)


def close(n, seed=0):
    """Random fingerprints, some of them copies with few bits flipped."""
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    for i in range(n // 2):
        fp[i + n // 2] = fp[i % (n // 4)] ^ np.uint64(sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 7))))
    return fp


def test_bit_sliced_distances():
    fp = close(192).reshape(3, 64)
    x, y = (np.array(i) for i in zip(*[(a, b) for a in range(3) for b in range(3)]))
    for radius in (0, 3, 4, 7):
        pairs, near, _ = S.within(S.planes(fp)[:, y], fp[x], np.zeros((9, 64), np.uint64), radius)
        got = np.zeros((9, 64, 64), bool)
        got[pairs] = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
        assert (got == (np.bitwise_count(fp[x][:, :, None] ^ fp[y][:, None, :]) <= radius)).all()


def test_pairs_of_blocks_are_abandoned():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, (40, 64), dtype=np.uint64) * 2 + rng.integers(0, 2, (40, 64), dtype=np.uint64)
    x, y = np.triu_indices(40)
    over = np.where((x == y)[:, None], S.DIAGONAL[None, :], np.uint64(0))
    pairs, near, read = S.within(S.planes(fp)[:, y], fp[x], over, 4)
    assert not len(pairs) and read < 0.65 * 64 * len(x)  # random texts: every pair is abandoned, a block with itself too
    fp[7, 3] = fp[20, 9] ^ np.uint64(0b1011)  # one link keeps one pair
    pairs, near, _ = S.within(S.planes(fp)[:, y], fp[x], over, 4)
    (kept,) = pairs.tolist()
    assert (x[kept], y[kept]) == (7, 20) and near[0, 3] == 1 << 9 and np.count_nonzero(near) == 1


def test_links_of_many_groups():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 63, 64, 65, 200, 1, 300]
    fp = np.concatenate([close(4 * max(1, n // 4 + 1), i)[:n] for i, n in enumerate(sizes)])
    node, bounds = rng.permutation(len(fp)), np.r_[0, np.cumsum(sizes)]
    found = {int(v): int(u) for us, vs in S.links(fp, node, np.zeros(len(fp), np.int32), np.ones(len(fp), bool), bounds, 4) for u, v in zip(us, vs)}
    for a, b in zip(bounds, bounds[1:]):
        assert [found.get(int(n), int(n)) for n in node[a:b]] == classes(fp[a:b].tolist(), node[a:b].tolist())


def test_bands_catch_every_pair():
    for count in (10, 1 << 19, 1 << 40):
        masks = S.band_masks(count, 4)
        rng = np.random.default_rng(1)
        for _ in range(300):
            flips = sum(1 << int(k) for k in rng.choice(64, 4, replace=False))
            assert any(m & flips == 0 for m in masks)


@pytest.mark.parametrize("group", [4096, 16])
def test_components_of_clusters(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(2)
    fps = []
    for _ in range(12):
        x = int(rng.integers(0, 1 << 62))
        for _ in range(rng.integers(1, 60)):  # a walk, so that chains are long
            x ^= sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.append(x)
    fps = sorted(set(fps))
    ids = rng.permutation(len(fps)).tolist()
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    stars = S.candidate_stars(spark.createDataFrame(list(zip(signed, ids)), "fp long, node long"), 4)
    root = {r.node: r.root for r in S.components(stars).collect()}
    assert [root.get(i, i) for i in ids] == classes(fps, ids)


def test_documents(spark):
    rows = S.near_duplicates(spark.read.parquet(DOCS)).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(DOCS).collect()}
    fps = [r.fp % (1 << 64) for r in rows]
    assert fps == [fingerprint(text[r.doc_id]) for r in rows]
    assert [r.component_id for r in rows] == classes(fps, [r.doc_id for r in rows])


def test_odd_rows(spark):
    docs = documents(spark, [(5, None), (3, ""), (7, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (9, "x")])
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (5, 3), (7, 7), (7, 7), (9, 9), (None, None)]
    assert S.near_duplicates(docs.limit(0)).count() == 0
