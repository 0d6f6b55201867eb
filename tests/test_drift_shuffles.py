"""Drift windows: what is dealt out, and quantiles that no task holds whole."""

import random
from statistics import median

from drivespark.jobs import queries_outages as Q
from drivespark.operators import outages as O


def test_windows_deal_their_rows_out_by_drive_alone(spark):
    plan = Q.drift(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("Exchange hashpartitioning(l_suppkey") == plan.count("Exchange hashpartitioning") <= 2


def test_quantiles_are_exact_whatever_the_sketch_says(spark, monkeypatch):
    monkeypatch.setattr(O, "SKETCH", 2)
    draw = random.Random(6)
    rows = [("s", None, f"l{i % 3}", i % 10 == 0, None if i % 10 == 0 else draw.choice([1.5, 2.5, draw.uniform(0, 40)]), draw.uniform(50, 60), 3.0) for i in range(3000)]
    d = spark.createDataFrame(rows, "strategy string, heading_mode string, label string, skipped boolean, drift_pct double, distance_m double, duration_s double")
    plan = []
    monkeypatch.setattr(O, "staged", lambda x, f=O.staged: (plan.append(x._jdf.queryExecution().optimizedPlan().toString()), f(x))[1])
    got = {r.label: r for r in O.drift_window_summary(d).collect()}
    assert plan and not any("percentile(" in x or "median(" in x for x in plan)
    assert len(got) == 3
    for label, r in got.items():
        own = [x for x in rows if x[2] == label]
        kept = sorted(x[4] for x in own if not x[3])
        at = 0.9 * (len(kept) - 1)
        low = kept[int(at)]
        assert (r.n_windows, r.skipped, r.median_duration_s) == (len(kept), len(own) - len(kept), 3.0)
        assert abs(r.median_pct - median(kept)) < 1e-9 and abs(r.median_distance_m - median(x[5] for x in own if not x[3])) < 1e-9
        assert abs(r.p90_pct - (low + (at - int(at)) * (kept[min(int(at) + 1, len(kept) - 1)] - low))) < 1e-9
