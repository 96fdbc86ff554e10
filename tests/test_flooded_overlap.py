"""Overlap with the connected regions that a segment meets, against a flood from its pixels."""

import numpy as np

from gridwright.operators import regions


def flood(segment, mask):
    """{class: ratio}: the flood starts at the segment's pixels of the class and goes over equal neighbours."""
    out = {}
    for c in np.unique(mask[segment]):
        seen = set(zip(*np.nonzero(segment & (mask == c))))
        inside, left = len(seen), list(seen)
        while left:
            y, x = left.pop()
            for p in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if p not in seen and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] == c:
                    seen.add(p)
                    left.append(p)
        out[int(c)] = inside / (segment.sum() + len(seen) - inside)
    return out


def test_union_takes_only_regions_that_the_segment_meets(spark):
    rng = np.random.default_rng(5)
    masks, segms = rng.integers(0, 3, (2, 9, 7)), rng.integers(0, 4, (2, 9, 7))
    table = lambda a: spark.createDataFrame([(int(i), int(y), int(x), int(a[i, y, x])) for i, y, x in np.ndindex(a.shape)], "image_id long, y int, x int, label long")
    got = {(r.image_id, r.segment, r.label): round(r.iou, 9) for r in regions.flooded_overlap(table(segms), table(masks), 7).collect()}
    want = {(i, s, c): round(v, 9) for i in range(2) for s in range(4) for c, v in flood(segms[i] == s, masks[i]).items()}
    assert got == want
    raw = {(r.image_id, r.segment, r.label): round(r.iou, 9) for r in regions.connected_overlap(table(segms), table(masks)).collect()}
    assert raw != want
