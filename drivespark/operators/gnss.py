"""Gates for fixes and the health of a receiver, along drives."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import ECCENTRICITY_2, SEMI_MAJOR_M, angle_diff_deg, horizontal_distance_m
from .folds import PIECE, carried

#: Fixed values of the gates: metres, metres a second (squared), degrees (a second), rows.
EXCELLENT_M, GOOD_M, DEGRADED_M, USABLE_M = 8.0, 20.0, 50.0, 120.0
JUMP_MPS, ACCEL_MPS2, TURN_DEG_S, LATERAL_MPS2 = 90.0, 15.0, 120.0, 8.0
OSCILLATION_FIXES, OSCILLATION_M, HEADING_DEG = 8, 6.0, 60.0
STRIKE_FIXES, STRIKES = 5, 3
#: Fixed values of the receiver's health: seconds, dB-Hz, dB, counts, degrees, shares.
STALE_US, REJECTS_US, CLEAN_US = 6_000_000, 60_000_000, 10_000_000
FEW_USED, WEAK_DB, STRONG_DB, DROP_DB, DROP_KINDS, DROP_SATELLITES, GAIN_DB = 6, 22.0, 30.0, 8.0, 2, 6, 6.0
MANY_MULTIPATH, WIDE_DB, LOW_SHARE, JUMPS, HISTORY, ACCURACIES = 3, 36.0, 0.6, 2, 10, 5
SEVERITY = {"waiting": 0, "normal": 0, "degraded": 1, "multipath": 2, "interference": 2, "outage": 3}
JUMP_REASONS, TURN_REASONS = ("jump", "acceleration", "heading"), ("jump", "heading")


def _metres(lat0: float, lon0: float, lat1: float, lon1: float) -> float:
    s = math.sin(math.radians(lat0))
    w = 1 - ECCENTRICITY_2 * s * s
    north = math.radians(lat1 - lat0) * SEMI_MAJOR_M * (1 - ECCENTRICITY_2) / (w * math.sqrt(w))
    around = math.pi - (math.pi - math.radians(lon1 - lon0)) % (2 * math.pi)
    return math.hypot(north, around * SEMI_MAJOR_M / math.sqrt(w) * math.cos(math.radians(lat0)))


def _against_last(fix: tuple, last: list) -> tuple[str, float | None]:
    """The reason to refuse a fix, given the last accepted one with the speed it was reached at; and the speed between them."""
    t, lat, lon, acc, speed, bearing = fix
    t0, lat0, lon0, acc0, speed0, bearing0, reached = last
    dt = (t - t0) / 1e6
    if dt <= 0:
        return "stale", None
    implied, spread = _metres(lat0, lon0, lat, lon) / dt, (acc0 + acc) / dt
    if implied > JUMP_MPS + spread:
        return "jump", implied
    if reached is not None and abs(implied - reached) / dt > ACCEL_MPS2 + spread / max(dt, 0.2):
        return "acceleration", implied
    if None not in (bearing, bearing0, speed, speed0) and speed > 2 and speed0 > 2:
        turn = abs(180 - (180 - (bearing - bearing0)) % 360) / dt
        if turn > min(TURN_DEG_S, math.degrees(LATERAL_MPS2) / max(speed, 1.0)):
            return "heading", implied
    return "none", implied


def _gate_rows(frame: pd.DataFrame, last: list | None) -> tuple[pd.DataFrame, list | None]:
    reasons, speeds = [], []
    for *fix, own in zip(*(frame[c].astype(object).where(frame[c].notna(), None) for c in ("t_us", "lat", "lon", "accuracy_m", "speed_mps", "bearing_deg", "own_reason")), strict=True):
        reason, implied = (own, None) if own else ("none", None) if last is None else _against_last(tuple(fix), last)
        if reason == "none":
            last = [*(None if v is None else float(v) for v in fix), implied if implied is not None else fix[4]]
        reasons.append(reason)
        speeds.append(implied)
    return pd.DataFrame({"reason": reasons, "implied_mps": pd.Series(speeds, dtype="float64")}), last


def accuracy_score(m: Column) -> Column:
    """1 up to the excellent accuracy, falling in three straight lines to 0.1 at the worst usable one."""
    line = lambda a, b, x0, x1: F.lit(a) + (b - a) * (m - x0) / (x1 - x0)
    return F.when(m <= EXCELLENT_M, 1.0).when(m <= GOOD_M, line(1.0, 0.75, EXCELLENT_M, GOOD_M)).when(m <= DEGRADED_M, line(0.75, 0.45, GOOD_M, DEGRADED_M)).otherwise(F.greatest(F.lit(0.1), line(0.45, 0.1, DEGRADED_M, USABLE_M)))


def gnss_gates(fixes: DataFrame, key: str = "drive_id", piece: int = PIECE) -> DataFrame:
    """Adds ``reason, implied_mps, score, integrity, sigma_m`` to fixes (``t_us, lat, lon, accuracy_m, speed_mps, bearing_deg,
    mocked, inertial_mps, inertial_deg``), in the order of time (then place and accuracy).

    Reasons, the first that holds: ``non_finite``, ``out_of_bounds`` (0, 0), ``mocked``, ``accuracy``, then against the last
    *accepted* fix ``stale``, ``jump``, ``acceleration``, ``heading``; else ``none``. That chain is all that is gone through
    row by row, in pieces with carried state; scores, strikes of the last five fixes and sigmas are columns and windows.
    Nulls in the place, time or accuracy are not finite; other nulls leave their rule out.
    """
    c = F.col
    bad = lambda x: c(x).isNull() | F.isnan(c(x).cast("double")) | (F.abs(c(x).cast("double")) == float("inf"))
    own = F.when(bad("lat") | bad("lon") | bad("accuracy_m") | c("t_us").isNull(), "non_finite").when((c("lat") == 0) & (c("lon") == 0), "out_of_bounds").when(c("mocked"), "mocked").when((c("accuracy_m") <= 0) | (c("accuracy_m") > USABLE_M), "accuracy")
    order = ["t_us", "lat", "lon", "accuracy_m"]
    d = carried(fixes.withColumn("own_reason", own), key, order, ["t_us", "lat", "lon", "accuracy_m", "speed_mps", "bearing_deg", "own_reason"], _gate_rows, "reason string, implied_mps double", piece)
    d = d.withColumn("__in", c("reason") == "none")
    recent = Window.partitionBy(key, "__in").orderBy(*order).rowsBetween(-OSCILLATION_FIXES, -1)
    d = d.withColumns({"__r": F.collect_list(F.struct("lat", "lon")).over(recent), "__lat": F.avg("lat").over(recent), "__lon": F.avg("lon").over(recent)})
    near = F.forall("__r", lambda p: horizontal_distance_m(c("__lat"), c("__lon"), p["lat"], p["lon"]) <= OSCILLATION_M)
    swings = F.coalesce(c("__in") & (c("inertial_mps") >= 3) & (F.size("__r") == OSCILLATION_FIXES) & near, F.lit(False))
    turned = (F.abs(angle_diff_deg(c("bearing_deg"), c("inertial_deg"))) > HEADING_DEG) & (c("speed_mps") > 3) & (c("inertial_mps") > 3)
    parts = [(swings, 0.5), (turned, 0.6), (F.abs(c("speed_mps") - c("inertial_mps")) > 10, 0.7), ((c("inertial_mps") < 0.3) & (c("implied_mps") > 8), 0.4)]
    score = accuracy_score(c("accuracy_m"))
    for holds, factor in parts:
        score = score * F.when(F.coalesce(holds, F.lit(False)), factor).otherwise(1.0)
    d = d.withColumns({"score": F.when(c("__in"), score).otherwise(0.0), "__swings": swings})
    strike = ~c("__in") | (c("score") < 0.5) | c("__swings")
    n = F.sum(strike.cast("int")).over(Window.partitionBy(key).orderBy(*order).rowsBetween(1 - STRIKE_FIXES, 0))
    integrity = F.when(n >= STRIKES, "anomaly").when(n == 2, "unreliable").when(n == 1, "degraded").otherwise("healthy")
    sigma = F.when(c("__in"), c("accuracy_m") / F.greatest(c("score"), F.lit(0.2))).when(~bad("accuracy_m") & (c("accuracy_m") > 0), c("accuracy_m")).otherwise(0.0)
    return d.withColumns({"integrity": integrity, "sigma_m": sigma}).drop("own_reason", "__in", "__r", "__lat", "__lon", "__swings")


def receiver_columns(satellites: str = "satellites") -> list[Column]:
    """What the health rules read of a sample's satellites (an array of ``constellation, cn0, used, elevation``)."""
    s = F.col(satellites)
    n, cn0 = F.size(s), F.transform(s, lambda x: x["cn0"])
    mean = F.when(n > 0, F.aggregate(cn0, F.lit(0.0), lambda a, x: a + x) / n)
    low = F.size(F.filter(s, lambda x: x["elevation"] < 20.0))
    return [n.alias("visible"), F.size(F.filter(s, lambda x: x["used"])).alias("used"), mean.alias("mean_cn0"), (F.array_max(cn0) - F.array_min(cn0)).alias("cn0_range"), F.size(F.array_distinct(F.transform(s, lambda x: x["constellation"]))).alias("kinds"), F.when(n > 0, low / n).alias("low_share")]


SAMPLE = ("visible", "used", "mean_cn0", "cn0_range", "kinds", "low_share", "gain_db", "multipath", "clock_count")


def gnss_raw_states(events: DataFrame, key: str = "drive_id") -> DataFrame:
    """``key, t_us, raw, reasons``: what the evidence says at every event, and at the moment a fix has been missing too long.

    Events are samples of the receiver (``kind = 'sample'`` with the columns of ``SAMPLE``) and fixes (``kind = 'fix'`` with
    ``reject``, null or ``none`` if accepted, and ``accuracy_m``). Of events of a key at one time the least row counts; events
    without a time are left out. Before the first accepted fix a receiver is ``waiting``.
    """
    c = F.col
    cols = ["kind", "reject", "accuracy_m", *SAMPLE]
    e = events.where("t_us IS NOT NULL AND kind IN ('fix', 'sample')").groupBy(key, "t_us").agg(F.min(F.struct(*cols)).alias("e")).select(key, "t_us", "e.*")
    good = (c("kind") == "fix") & F.coalesce(c("reject") == "none", F.lit(True))
    e = e.withColumn("good", good)
    by = Window.partitionBy(key).orderBy("t_us")
    upto, past = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, -1)
    missing = e.where("good").withColumn("next", F.lead("t_us").over(by)).where(f"next IS NULL OR next > t_us + {STALE_US + 1}")
    late = missing.select(key, (c("t_us") + STALE_US + 1).alias("t_us"), F.lit("timer").alias("kind"), F.lit(False).alias("good"))
    both = e.unionByName(late, allowMissingColumns=True).groupBy(key, "t_us").agg(F.min_by(F.struct("kind", "good", "reject", "accuracy_m", *SAMPLE), "kind").alias("e"), F.max(F.col("kind") == "timer").alias("timer")).select(key, "t_us", "timer", "e.*")
    is_sample = c("kind") == "sample"
    # Histories hold samples with a value: their windows run over these rows, and each row sees what was there before it.
    for name, value in (("cn0", c("mean_cn0")), ("gain", c("gain_db"))):
        has = is_sample & value.isNotNull()
        own = Window.partitionBy(key, f"__{name}").orderBy("t_us").rowsBetween(1 - HISTORY, 0)
        both = both.withColumn(f"__{name}", has).withColumn(f"{name}_after", F.when(c(f"__{name}"), F.avg(value).over(own)))
    fine = c("good") & (F.abs("accuracy_m") < float("inf"))
    few = Window.partitionBy(key, "__fine").orderBy("t_us").rowsBetween(1 - ACCURACIES, -1)
    both = both.withColumn("__fine", F.coalesce(fine, F.lit(False))).withColumn("worse", F.when(c("__fine"), F.coalesce((F.count("*").over(few) >= 2) & (F.avg("accuracy_m").over(few) > 0) & (c("accuracy_m") > 1.5 * F.avg("accuracy_m").over(few)), F.lit(False))))
    window = by.rangeBetween(-REJECTS_US, 0)
    rejects = lambda names: F.count_if(F.coalesce((c("kind") == "fix") & c("reject").isin(*names), F.lit(False))).over(window)
    last = lambda x, w: F.last(x, True).over(w)
    d = both.withColumns({
        "__s": last(F.when(is_sample, F.struct(*SAMPLE)), upto), "fix_t": last(F.when(c("good"), c("t_us")), upto), "cn0_before": last("cn0_after", past), "gain_before": last("gain_after", past), "clock_before": last(F.when(is_sample, c("clock_count")), past),
        "worsening": F.coalesce(last("worse", upto), F.lit(False)), "rejects": rejects(JUMP_REASONS), "jumps": rejects(TURN_REASONS),
    })
    s = lambda x: c("__s")[x]
    hit = lambda x: F.coalesce(x, F.lit(False))
    rules = [
        ("interference", [("signal_drop", (c("cn0_before") - s("mean_cn0") >= DROP_DB) & (s("kinds") >= DROP_KINDS) & (s("visible") >= DROP_SATELLITES)), ("gain_drop", c("gain_before") - s("gain_db") >= GAIN_DB), ("clock_jump", (s("clock_count") > c("clock_before")) & (c("rejects") > 0))]),
        ("multipath", [("many_multipath", s("multipath") >= MANY_MULTIPATH), ("wide_and_low", (s("cn0_range") >= WIDE_DB) & (s("low_share") >= LOW_SHARE)), ("jumps_while_strong", (c("jumps") >= JUMPS) & (s("mean_cn0") >= STRONG_DB))]),
        ("degraded", [("few_used", (s("used") > 0) & (s("used") < FEW_USED)), ("weak_signal", s("mean_cn0") < WEAK_DB), ("accuracy_worsens", c("worsening")), ("rejected_fixes", c("rejects") > 0)]),
    ]
    raw, why = F.lit("normal"), F.array().cast("array<string>")
    for state, tests in reversed(rules):
        any_ = hit(tests[0][1]) | hit(tests[1][1]) | (hit(tests[2][1]) if len(tests) == 3 else hit(tests[2][1]) | hit(tests[3][1]))
        names = F.array_compact(F.array(*(F.when(hit(x), n) for n, x in tests)))
        raw, why = F.when(any_, state).otherwise(raw), F.when(any_, names).otherwise(why)
    out_ = c("t_us") - c("fix_t") > STALE_US
    raw = F.when(c("fix_t").isNull(), "waiting").when(out_, "outage").otherwise(raw)
    why = F.when(c("fix_t").isNull(), F.array(F.lit("no_fix_yet"))).when(out_, F.array(F.lit("no_accepted_fix"))).otherwise(why)
    return d.select(key, "t_us", raw.alias("raw"), why.alias("reasons"))


def settle(t_us: int, raw: str, state: list | None) -> list:
    """[reported state, since when the evidence has been better]: worse or equal is taken at once, better after 10 seconds."""
    shown, since = state or ["waiting", None]
    if SEVERITY[raw] >= SEVERITY[shown]:
        return [raw, None]
    since = t_us if since is None else since
    return [raw, None] if t_us - since >= CLEAN_US else [shown, since]


def _settle_rows(frame: pd.DataFrame, state: list | None) -> tuple[pd.DataFrame, list | None]:
    shown = []
    for t, raw in zip(frame["t_us"].tolist(), frame["raw"].tolist(), strict=True):
        state = settle(t, raw, state)
        shown.append(state[0])
    return pd.DataFrame({"state": shown}), state


def gnss_health(events: DataFrame, key: str = "drive_id", piece: int = PIECE) -> DataFrame:
    """``key, t_us, state, before, reasons``: a row whenever the reported state changes (``before`` is null at first).

    The evidence of ``gnss_raw_states`` is reported at once where it is as bad as what is reported or worse, and once it has
    been better for ten seconds otherwise; an outage begins six seconds after the last accepted fix, event or not.
    """
    d = carried(gnss_raw_states(events, key), key, ["t_us"], ["t_us", "raw"], _settle_rows, "state string", piece)
    before = F.lag("state").over(Window.partitionBy(key).orderBy("t_us"))
    return d.withColumn("before", before).where("before IS NULL OR before <> state").select(key, "t_us", "state", "before", "reasons")
