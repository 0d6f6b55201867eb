"""Descriptors against anchors: blocks of anchors, ties, nulls and few anchors, against plain pairs."""

import random

from drivespark.operators import joins as J


def test_blocks_of_anchors_give_what_all_pairs_give(spark):
    draw = random.Random(5)
    word = lambda: draw.choice([0, -1, 1, 2**62, -(2**63), draw.getrandbits(63)])
    some = lambda n: [(i, [word() for _ in range(4)]) for i in range(n)]
    q, a = some(150), some(70)
    q.append((500, [1, None, 2, 3]))
    a.append((-5, [1, 2, None, 3]))
    kind = "{} long, descriptor array<long>"
    apart = lambda x, y: 257 if None in x or None in y else sum(((m ^ n) & (2**64 - 1)).bit_count() for m, n in zip(x, y, strict=True))
    score = lambda d: None if d > 256 else 1 - d / 256
    for anchors in (a, a[:1]):
        want = []
        for i, x in q:
            best = sorted((apart(x, y), k) for k, y in anchors)[:2]
            want.append((i, best[0][1], score(best[0][0]), score(best[1][0]) if len(best) > 1 else None))
        for block in (100_000, 9):
            d = J.match_descriptors(spark.createDataFrame(q, kind.format("query_id")), spark.createDataFrame(anchors, kind.format("anchor_id")), block=block)
            assert sorted(tuple(r) for r in d.collect()) == sorted(want)
    assert J.match_descriptors(spark.createDataFrame(q, kind.format("query_id")), spark.createDataFrame([], kind.format("anchor_id"))).isEmpty()
