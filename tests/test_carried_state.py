"""State carried along many keys at once: null keys, pieces, keys with nothing beside them or only that."""

import numpy as np

from drivespark.operators.folds import carried


def test_keys_of_a_batch_are_done_together_and_apart(spark):
    rows = [(None if k == 7 else k, n, float(k + n)) for k in range(40) for n in range(k % 6 + 1)]
    weights = [(None if k == 7 else k, float(k)) for k in range(0, 45, 7)]
    d = spark.createDataFrame(rows, "k long, n long, v double")
    beside = spark.createDataFrame(weights, "k long, w double")

    def step(frame, starts, ends, states, held, first):
        out, v = np.zeros(len(frame)), frame["v"].to_numpy()
        left = []
        for a, b, state, row in zip(starts, ends, states, first, strict=True):
            sums = (state or 0.0) + np.cumsum(v[a:b])
            left.append(float(sums[-1]))
            out[a:b] = sums * (held["w"].iloc[row] if row >= 0 else 1.0)
        return {"s": out}, left

    def single(frame, state, held):
        made, (left,) = step(frame, [0], [len(frame)], [state], held, [-1 if held.empty else 0])
        return frame.assign(s=made["s"])[["s"]], left

    weight = dict(weights)
    want = sorted(((-1 if k is None else k), n, sum(x for j, m, x in rows if j == k and m <= n) * weight.get(k, 1.0)) for k, n, _ in rows)
    for piece in (50, 2):
        for run, many in ((step, True), (single, False)):
            got = carried(d, "k", ["n"], ["v"], run, "s double", piece, beside, many=many)
            assert got.columns == ["k", "n", "v", "s"]
            assert sorted((-1 if r.k is None else r.k, r.n, r.s) for r in got.collect()) == want
