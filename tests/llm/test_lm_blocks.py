"""Gradients made block by block are those of all windows at once."""

import numpy as np

from drivespark.llm import lm


def test_blocks_of_windows_add_up(monkeypatch):
    rng = np.random.default_rng(6)
    initial = np.arange(lm.IDS) < 500
    initial[lm.END] = True
    counts = rng.integers(1, 50, lm.IDS).astype(float)
    net = lm.make_network(counts, np.where(initial, counts, 0), np.where(initial, counts // 9, 0), initial)
    x, y = rng.integers(0, 900, (7, lm.WINDOW)), rng.integers(0, 900, (7, lm.WINDOW))
    live = rng.random(x.shape) < 0.8
    live[3] = False
    found = []
    for size in (1, 3, 7):
        monkeypatch.setattr(lm, "BLOCK_WINDOWS", size)
        loss, (ids, d_embed), rest = lm.gradients(net, x, y, live)
        assert (ids == np.unique(x)).all()
        found.append([np.array(loss), d_embed, *rest])
    for other in found[1:]:
        assert all(np.allclose(p, q, rtol=1e-3, atol=1e-6) for p, q in zip(found[0], other, strict=True))
    loss, _, rest = lm.gradients(net, x, y, np.zeros_like(live))
    assert loss == 0 and not any(p.any() for p in rest)
