"""Checks of sensors, receivers and estimates along a drive: windows in time order, one shuffle by drive each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import horizontal_distance_m
from .joins import last_at_or_before


def stream_timing(samples: DataFrame, keys: Sequence[str] = ("drive", "sensor"), t_us: str = "t_us", alpha: float = 0.05, gap_factor: float = 3.0, piece: int = 10_000) -> DataFrame:
    """Per sensor: samples received, mean interval and its variance by exponential weights, jitter, drops, rate and class.

    The recursion runs over ordered arrays of at most ``piece`` intervals; the state of one is the start of the next.
    """
    w = Window.partitionBy(*keys).orderBy(t_us)
    d = samples.withColumn("__dt", (F.col(t_us) - F.lag(t_us).over(w)).cast("double")).withColumn("__p", F.floor((F.row_number().over(w) - 1) / piece))
    lists = d.groupBy(*keys, "__p").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("__dt").isNotNull(), F.struct(F.col(t_us).alias("t"), F.col("__dt").alias("dt"))))).alias("l"))
    zero = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0.0).alias("var"), F.lit(0).cast("long").alias("drops"))

    def step(s, x):
        delta = x.dt - s.mean
        lost = F.when(x.dt > s.mean * gap_factor, F.greatest(F.lit(1).cast("long"), F.round(x.dt / s.mean).cast("long") - 1)).otherwise(0)
        first = F.struct(x.dt.alias("mean"), F.lit(0.0).alias("var"), F.lit(0).cast("long").alias("drops"))
        return F.when(s.mean.isNull(), first).otherwise(F.struct((s.mean + alpha * delta).alias("mean"), ((1 - alpha) * (s["var"] + alpha * delta * delta)).alias("var"), (s.drops + lost).alias("drops")))

    parts = lists.groupBy(*keys).agg(F.sum("n").alias("received"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__p", "l"))), lambda p: p.l)).alias("l"))
    d = parts.select(*keys, "received", F.aggregate("l", zero, step).alias("s"))
    mean, n = F.col("s.mean"), F.col("received")
    jitter = F.when((n >= 5) & (mean > 0), F.sqrt("s.var") / mean)
    drops = F.col("s.drops") / (n + F.col("s.drops"))
    quality = F.when((n < 5) | jitter.isNull(), "good").when(drops > 0.2, "invalid").when(drops > 0.05, "degraded").when(jitter <= 0.15, "excellent").when(jitter <= 0.35, "good").otherwise("degraded")
    return d.select(*keys, "received", mean.alias("mean_us"), F.col("s.drops").alias("dropped"), jitter.alias("jitter"), F.when((n >= 3) & (mean > 0), F.lit(1e6) / mean).alias("hz"), quality.alias("quality"))


def signal_integrity(snapshots: DataFrame, keys: Sequence[str] = ("drive",), order: str = "t_us", mean: str = "mean_cn0", used: str = "used", visible: str = "visible", fall: float = -12.0, least_ratio: float = 0.35, least_cn0: float = 25.0) -> DataFrame:
    """Adds ``change_cn0, used_ratio, state``: mean C/N0 against that of the five snapshots with satellites before it."""
    seen = F.col(visible) > 0
    d = snapshots.withColumn("__seen", seen)
    w = Window.partitionBy(*keys, "__seen").orderBy(order).rowsBetween(-5, -1)
    change = F.when(seen, F.col(mean) - F.avg(mean).over(w))
    ratio = F.when(seen, F.col(used) / F.col(visible)).otherwise(0.0)
    d = d.withColumns({"change_cn0": change, "used_ratio": ratio}).drop("__seen")
    state = F.when(~seen, "degraded").when((F.col("change_cn0") <= fall) & (F.col("used_ratio") < least_ratio), "anomaly").when((F.col(mean) < least_cn0) | (F.col("used_ratio") < least_ratio), "degraded").otherwise("healthy")
    return d.withColumn("state", state)


def turn_speed(df: DataFrame, lateral: str, yaw: str, keys: Sequence[str] = ("trip_id",), t_us: str = "t_us", window_us: int = 1_000_000, every_us: int = 1_000_000) -> DataFrame:
    """Speed from steady turns, lateral acceleration over yaw rate of the last second: ``t_us, speed_ms, sigma_ms``.

    At most one a second: that is a fold over the few candidates of a drive, in order.
    """
    w = Window.partitionBy(*keys).orderBy(t_us).rangeBetween(-window_us, 0)
    d = df.select(*keys, t_us, F.avg(lateral).over(w).alias("a"), F.avg(yaw).over(w).alias("w"), F.stddev_pop(yaw).over(w).alias("sd"), F.count("*").over(w).alias("n"), (F.col(t_us) - F.min(t_us).over(w)).alias("span"))
    v, turn = F.col("a") / F.col("w"), F.abs("w")
    sigma = F.sqrt(F.pow(F.lit(0.35) / turn, 2) + F.pow(v * 0.012 / turn, 2))
    clear = (F.col("n") >= 3) & (F.col("span") >= 0.8 * window_us) & turn.between(0.10, 1.2) & (F.abs("a") >= 0.6) & (F.signum("a") == F.signum("w")) & (F.col("sd") / turn <= 0.35)
    d = d.where(clear).withColumns({"speed_ms": v, "sigma_ms": sigma}).where(F.col("speed_ms").between(2.0, 45.0) & (F.col("sigma_ms") <= 2.5))
    lists = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t_us).alias("t"), "speed_ms", "sigma_ms"))).alias("l"))
    keep = F.aggregate("l", F.slice("l", 1, 0), lambda acc, x: F.when((F.size(acc) == 0) | (x.t - F.try_element_at(acc, F.lit(-1)).t >= every_us), F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select(*keys, F.explode(keep).alias("o")).select(*keys, F.col("o.t").alias(t_us), "o.speed_ms", "o.sigma_ms")


def earned_trust(fixes: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us", window: int = 20, least: int = 10, ratio: float = 1.25, margin_m: float = 2.0, max_gap_s: float = 2.5) -> DataFrame:
    """Adds ``miss_m, hold_miss_m, trusted``: whether the estimate's recent one-step misses stay near those of holding velocity.

    ``fixes`` hold ``miss_m`` (the supplied estimate's distance to each fix) and metres ``x, y``; holding means the last
    step goes on. Medians run over the last ``window`` fixes at most ``max_gap_s`` after the one before.
    """
    w = Window.partitionBy(*keys).orderBy(t_us)
    lag = lambda c, n: F.lag(c, n).over(w)
    gap, before = F.col(t_us) - lag(t_us, 1), lag(t_us, 1) - lag(t_us, 2)
    held = lambda c: lag(c, 1) + (lag(c, 1) - lag(c, 2)) * gap / before
    miss = F.sqrt(F.pow(F.col("x") - held("x"), 2) + F.pow(F.col("y") - held("y"), 2))
    ok = (gap <= max_gap_s * 1e6) & (before <= max_gap_s * 1e6) & (before > 0)
    d = fixes.withColumns({"hold_miss_m": F.when(ok, miss), "__ok": F.coalesce(ok, F.lit(False))})
    last = Window.partitionBy(*keys, "__ok").orderBy(t_us).rowsBetween(1 - window, 0)
    fair = F.percentile("miss_m", 0.5).over(last) <= F.percentile("hold_miss_m", 0.5).over(last) * ratio + margin_m
    return d.withColumn("trusted", F.col("__ok") & (F.count("hold_miss_m").over(last) >= least) & F.coalesce(fair, F.lit(False))).drop("__ok")


def continuous_error(estimates: DataFrame, truth: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us", max_age_us: int = 1_000_000) -> DataFrame:
    """Per key: distance of each estimate to the last true position at most ``max_age_us`` old: mean, median, p95, max, final."""
    t = truth.select(*keys, t_us, F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    d = last_at_or_before(estimates.select(*keys, t_us, "lat", "lon"), t, keys, t_us, ["t_lat", "t_lon"], max_age_us)
    d = d.withColumn("e", horizontal_distance_m(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))).where("e IS NOT NULL")
    return d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("e").alias("mean_m"), F.median("e").alias("median_m"), F.percentile("e", 0.95).alias("p95_m"), F.max("e").alias("max_m"), F.max_by("e", t_us).alias("final_m"))


def log_profile(records: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us", max_truth_accuracy_m: float = 12.0) -> DataFrame:
    """Per drive: duration, rates (1e6 over the upper median gap of IMU and GNSS records), fixes, true ones and their median accuracy.

    ``records(kind, accuracy_m, mocked, has_mag, has_baro)``; kinds: ``i`` IMU, ``g`` GNSS.
    """
    w = Window.partitionBy(*keys, "kind").orderBy(t_us)
    d = records.withColumn("__gap", F.col(t_us) - F.lag(t_us).over(w))
    place, of = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.col("__gap").asc_nulls_last())), F.count("__gap").over(Window.partitionBy(*keys, "kind"))
    d = d.withColumns({"__n": place, "__m": of})
    upper = lambda kind: F.max(F.when((F.col("kind") == kind) & (F.col("__n") == F.floor(F.col("__m") / 2) + 1), F.col("__gap")))
    true = (F.col("kind") == "g") & ~F.coalesce("mocked", F.lit(False)) & (F.col("accuracy_m") <= max_truth_accuracy_m)
    return d.groupBy(*keys).agg(
        ((F.max(t_us) - F.min(t_us)) / 1e6).alias("duration_s"), F.try_divide(F.lit(1e6), upper("i")).alias("imu_hz"), F.try_divide(F.lit(1e6), upper("g")).alias("gnss_hz"), F.count_if(F.col("kind") == "g").alias("fixes"),
        F.count_if(true).alias("true_fixes"), F.median(F.when(true, F.col("accuracy_m"))).alias("median_accuracy_m"), F.bool_or("has_mag").alias("has_mag"), F.bool_or("has_baro").alias("has_baro"),
    )


def imu_noise_density(df: DataFrame, accel: str, yaw: str, speed: str, heading_rad: str, keys: Sequence[str] = ("trip_id",), order: str = "i", horizons_s: Sequence[float] = (5, 10, 30), min_speed: float = 3.0, dt: float = 0.1) -> DataFrame:
    """Per key and horizon: rms of integrated acceleration less change of speed, and of yaw less change of heading, over
    disjoint windows that keep ``min_speed``, divided by the root of the horizon."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    d = df.withColumn("__n", n).withColumn("horizon_s", F.explode(F.array(*(F.lit(float(h)) for h in horizons_s)))).withColumn("__b", F.floor(F.col("__n") / F.round(F.col("horizon_s") / dt)))
    ends = lambda c: F.max_by(c, "__n") - F.min_by(c, "__n")
    first = F.min("__n")
    b = d.groupBy(*keys, "horizon_s", "__b").agg(F.count("*").alias("c"), F.min(speed).alias("slowest"), (F.sum(accel) * dt - F.min_by(accel, "__n") * dt - ends(speed)).alias("dv"), (F.sum(yaw) * dt - F.min_by(yaw, "__n") * dt - ends(heading_rad)).alias("dh"), first.alias("f"))
    full = b.where((F.col("c") == F.round(F.col("horizon_s") / dt)) & (F.col("slowest") >= min_speed))
    turn = F.atan2(F.sin("dh"), F.cos("dh"))
    return full.groupBy(*keys, "horizon_s").agg(F.count("*").alias("windows"), (F.sqrt(F.avg(F.col("dv") * F.col("dv"))) / F.sqrt(F.first("horizon_s"))).alias("accel_density"), (F.sqrt(F.avg(turn * turn)) / F.sqrt(F.first("horizon_s"))).alias("yaw_density"))


def stream_signal_checks(df: DataFrame, keys: Sequence[str] = ("trip_id",), order: str = "i", speed: str = "speed_ms", heading: str = "heading_deg", ax: str = "ax", ay: str = "ay", az: str = "az", gz: str = "gz", dt: float = 0.1, moving: float = 1.0) -> DataFrame:
    """Per key: correlations that tell axes and signs (yaw and turning, acceleration and speed, lateral and speed x yaw), at-rest
    spread, and a warning where the mean acceleration isn't near gravity."""
    w = Window.partitionBy(*keys).orderBy(order)
    turn = F.col(heading) - F.lag(heading).over(w)
    turn = F.lit(180.0) - F.pmod(F.lit(180.0) - turn, F.lit(360.0))
    d = df.withColumns({"__turn": -F.radians(turn) / dt, "__dv": (F.col(speed) - F.lag(speed).over(w)) / dt, "__norm": F.sqrt(F.col(ax) * F.col(ax) + F.col(ay) * F.col(ay) + F.col(az) * F.col(az))})
    fast, rest = F.col(speed) > moving, F.col(speed) < 0.3
    on = lambda cond, x: F.when(cond, x)
    return d.groupBy(*keys).agg(
        F.corr(on(fast, F.col(gz)), on(fast, F.col("__turn"))).alias("yaw_corr"), F.corr(F.col(ax), F.col("__dv")).alias("accel_corr"), F.corr(on(fast, F.col(ay)), on(fast, F.col(speed) * F.col(gz))).alias("lateral_corr"),
        F.stddev_pop(on(rest, F.col("__norm"))).alias("rest_std"), (~F.avg("__norm").between(7.0, 12.0)).alias("units_warning"),
    )
