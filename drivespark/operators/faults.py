"""Faults of sensors, stops, courses over ground, outages and what injected faults do, along drives; and summaries of audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_diff_deg, horizontal_distance_m, wrap_360

#: Greatest magnitude and noise by sensor, and the bounds of the Earth's field in microtesla.
RANGES = {"accelerometer": 100.0, "gyroscope": 35.0}
NOISES = {"accelerometer": 12.0, "gyroscope": 6.0}
FIELD_UT = (15.0, 90.0)
#: Metres of one degree of latitude, as courses over ground take it.
DEGREE_M = 111_320.0


def _by_sensor(sensor: Column, values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for name, value in values.items():
        out = F.when(sensor == name, F.lit(value)).otherwise(out)
    return out


def sensor_faults(samples: DataFrame, keys: Sequence[str] = ("drive", "sensor"), t_us: str = "t_us", sensor: str = "sensor", window: int = 50, frozen: int = 50, stale_us: int = 500_000) -> DataFrame:
    """Adds ``magnitude, noise, fault, stalls`` to samples ``x, y, z``.

    Faults, the first that holds: ``out_of_range`` (null, not finite, or beyond the sensor's limit), ``magnetic_disturbance``,
    ``frozen`` (``frozen`` repetitions in a row, unless it is a sensor at rest), ``excessive_noise`` (over the last ``window``
    finite magnitudes, from half as many samples on); else ``none``. ``stalls``: the next sample is over ``stale_us`` later.
    """
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    by = Window.partitionBy(*keys).orderBy(t_us)
    d = samples.withColumns({"__ok": finite, "__n": F.row_number().over(by)}).withColumn("magnitude", F.when(F.col("__ok"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))))
    same = F.col("__ok") & F.lag("__ok").over(by)
    for c in "xyz":
        same = same & (F.col(c) == F.lag(c).over(by))
    d = d.withColumn("__run", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(by))
    held = F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(t_us)) - 1
    spread = F.stddev_pop("magnitude").over(Window.partitionBy(*keys, "__ok").orderBy(t_us).rowsBetween(1 - window, 0))
    noise = F.when(F.col("__ok") & (F.col("__n") >= window // 2), spread)
    s, m = F.col(sensor), F.col("magnitude")
    d = d.withColumns({"__held": held, "noise": noise})
    rest = F.when(s == "gyroscope", m < 1e-4).when(s == "accelerometer", F.abs(m - 9.81) < 0.25).when(s == "magnetometer", m.between(*FIELD_UT)).otherwise(False)
    fault = (
        F.when(~F.col("__ok") | (m > _by_sensor(s, RANGES)), "out_of_range").when((s == "magnetometer") & ~m.between(*FIELD_UT), "magnetic_disturbance").when((F.col("__held") >= frozen) & ~rest, "frozen")
        .when(F.col("noise") > _by_sensor(s, NOISES), "excessive_noise").otherwise("none")
    )
    stalls = F.coalesce(F.lead(t_us).over(by) - F.col(t_us) > stale_us, F.lit(False))
    return d.withColumns({"fault": fault, "stalls": stalls}).drop("__ok", "__n", "__run", "__held")


def _spread(values: Column) -> Column:
    """The population's standard deviation of an array, by running means in its order (Welford); null of none."""
    state = lambda n, mean, squares: F.struct(n.alias("n"), mean.alias("mean"), squares.alias("squares"))

    def add(s, x):
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return state(s["n"] + 1, mean, s["squares"] + (x - mean) * (x - s["mean"]))

    return F.aggregate(values, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), add, lambda s: F.sqrt(F.try_divide(s["squares"], s["n"])))


def stop_detection(imu: DataFrame, magnitude: str = "magnitude", keys: Sequence[str] = ("drive",), t_us: str = "t_us", limit: float = 0.6, enter_us: int = 800_000, exit_us: int = 250_000, window_us: int = 1_000_000) -> DataFrame:
    """Adds ``stationary``: on once the last second has been quiet for ``enter_us``, off once it has been loud for ``exit_us``.

    The hysteresis is no recursion: a row decides if its run of quiet or loud rows has lasted long enough, and any other
    row has the state of the last one that decided. Seconds of under three samples decide nothing. Samples of short decimals
    lie on the limit now and then: there the order of the sums decides, so it is laid down (``_spread``).
    """
    second = Window.partitionBy(*keys).orderBy(t_us).rangeBetween(-window_us, 0)
    d = imu.withColumns({"__spread": F.stddev_pop(magnitude).over(second), "__held": F.collect_list(magnitude).over(second), "__many": F.count(magnitude).over(second) >= 3})
    near = F.abs(F.col("__spread") - limit) <= 1e-9 * limit
    d = d.withColumn("__quiet", F.when(near, _spread(F.col("__held"))).otherwise(F.col("__spread")) < limit).drop("__spread", "__held")
    by = Window.partitionBy(*keys, "__many").orderBy(t_us)
    d = d.withColumn("__new", (~F.col("__quiet").eqNullSafe(F.lag("__quiet").over(by))).cast("int")).withColumn("__run", F.sum("__new").over(by))
    since = F.min(t_us).over(Window.partitionBy(*keys, "__many", "__run"))
    d = d.withColumn("__age", F.col(t_us) - since)
    decides = F.when(F.col("__many") & F.col("__quiet") & (F.col("__age") >= enter_us), True).when(F.col("__many") & ~F.col("__quiet") & (F.col("__age") >= exit_us), False)
    state = F.last(decides, True).over(Window.partitionBy(*keys).orderBy(t_us).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("stationary", F.coalesce(state, F.lit(False))).drop("__quiet", "__many", "__new", "__run", "__age")


def stop_intervals(stops: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us") -> DataFrame:
    """One row for each stop of ``stop_detection``: ``start_us, end_us, samples``."""
    by = Window.partitionBy(*keys).orderBy(t_us)
    d = stops.withColumn("__new", (~F.col("stationary").eqNullSafe(F.lag("stationary").over(by))).cast("int")).withColumn("__run", F.sum("__new").over(by))
    return d.where("stationary").groupBy(*keys, "__run").agg(F.min(t_us).alias("start_us"), F.max(t_us).alias("end_us"), F.count("*").alias("samples")).drop("__run")


def gnss_course(fixes: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us", baseline_m: float = 20.0, baseline_us: int = 6_000_000, min_speed: float = 3.0, max_accuracy_m: float = 30.0, max_bend_deg: float = 20.0, relative_error: float = 0.25, min_sigma_deg: float = 5.0) -> DataFrame:
    """``keys, t_us, course_deg, sigma_deg`` of every fix that a straight baseline of ``baseline_m`` leads to.

    The baseline starts at the newest fix of the last ``baseline_us`` that is far enough back; it is straight if both its
    halves are within ``max_bend_deg`` of it. Looks at the fixes of six seconds at a time.
    """
    point = F.struct(F.col(t_us).alias("t"), "lat", "lon", "accuracy_m")
    before = Window.partitionBy(*keys).orderBy(t_us).rangeBetween(-baseline_us, 0)
    d = fixes.where(F.col("accuracy_m") <= max_accuracy_m).select(*keys, t_us, point.alias("p"), F.array_sort(F.collect_list(point).over(before)).alias("l"))

    def step(a, b):
        return (b.lat - a.lat) * DEGREE_M, (b.lon - a.lon) * DEGREE_M * F.cos(F.radians(a.lat))

    def metres(a, b):
        north, east = step(a, b)
        return F.sqrt(north * north + east * east)

    def course(a, b):
        north, east = step(a, b)
        return wrap_360(F.degrees(F.atan2(east, north)))

    p = F.col("p")
    d = d.withColumn("a", F.try_element_at(F.filter("l", lambda q: metres(q, p) >= baseline_m), F.lit(-1))).where("a IS NOT NULL AND a.t < p.t")
    a = F.col("a")
    d = d.withColumn("m", F.try_element_at(F.filter("l", lambda q: q.t >= F.floor((a.t + p.t) / 2)), F.lit(1)))
    m = F.col("m")
    d = d.withColumns({"base": metres(a, p), "course_deg": course(a, p), "h1": metres(a, m), "h2": metres(m, p), "c1": course(a, m), "c2": course(m, p)})
    bend = F.greatest(F.abs(angle_diff_deg(F.col("c1"), F.col("course_deg"))), F.abs(angle_diff_deg(F.col("c2"), F.col("course_deg"))))
    straight = (F.col("h1") < baseline_m / 4) | (F.col("h2") < baseline_m / 4) | (bend <= max_bend_deg)
    sigma = F.greatest(F.lit(min_sigma_deg), F.degrees(F.atan2(relative_error * F.greatest(a.accuracy_m, p.accuracy_m) * F.sqrt(F.lit(2.0)), F.col("base"))))
    return d.where((F.col("base") / ((p.t - a.t) / 1e6) >= min_speed) & straight).select(*keys, t_us, "course_deg", sigma.alias("sigma_deg"))


def fault_effect(clean: DataFrame, faulted: DataFrame, specs: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us", grace_us: int = 8_000_000) -> DataFrame:
    """Per spec ``(keys, start_us, end_us)``: how far ``faulted(lat, lon, mechanism, leads)`` strays from ``clean(lat, lon)`` at equal
    times from the start on (``max_error_m, end_error_m``), the first ``mechanism`` or loss of lead until the end and its grace
    time (``detected, latency_s, mechanism``), and whether it ``kept_leading``. Nulls where tracks never meet."""
    c = clean.select(*keys, t_us, F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    d = faulted.join(specs, list(keys)).where(F.col(t_us) >= F.col("start_us")).join(c, [*keys, t_us], "left")
    d = d.withColumn("__e", horizontal_distance_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")))
    watched = F.col(t_us) <= F.col("end_us") + grace_us
    lost = watched & ~F.coalesce("leads", F.lit(False))
    sign = F.when(watched, F.coalesce("mechanism", F.when(lost, "lost lead")))
    g = d.withColumn("__sign", sign).groupBy(*keys, "start_us", "end_us")
    out = g.agg(F.max("__e").alias("max_error_m"), F.max_by("__e", F.when(F.col("__e").isNotNull(), F.col(t_us))).alias("end_error_m"), F.min(F.when(F.col("__sign").isNotNull(), F.col(t_us))).alias("__at"), F.min_by("__sign", F.when(F.col("__sign").isNotNull(), F.col(t_us))).alias("mechanism"), (~F.bool_or(lost)).alias("kept_leading"))
    return out.select(*keys, "start_us", "end_us", "max_error_m", "end_error_m", F.col("__at").isNotNull().alias("detected"), ((F.col("__at") - F.col("start_us")) / 1e6).alias("latency_s"), "mechanism", "kept_leading")


def outage_events(fixes: DataFrame, keys: Sequence[str] = ("session_id",), t_us: str = "t_us", accepted: str = "accepted", min_s: float = 5.0, min_m: float = 25.0) -> DataFrame:
    """Outages between two accepted fixes that follow each other: ``start_us, end_us, duration_s, distance_m``, at least ``min_s``
    and ``min_m``; with ``est_lat, est_lon`` (the estimate just before each fix) also ``error_m`` on return."""
    by = Window.partitionBy(*keys).orderBy(t_us)
    d = fixes.where(accepted).select(*keys, F.col(t_us).alias("start_us"), F.lead(t_us).over(by).alias("end_us"), *(F.col(c).alias(f"__{c}") for c in ("lat", "lon")), *(F.lead(c).over(by).alias(c) for c in ("lat", "lon", "est_lat", "est_lon")))
    d = d.select(*keys, "start_us", "end_us", ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_s"), horizontal_distance_m(F.col("__lat"), F.col("__lon"), F.col("lat"), F.col("lon")).alias("distance_m"), horizontal_distance_m(F.col("lat"), F.col("lon"), F.col("est_lat"), F.col("est_lon")).alias("error_m"))
    return d.where((F.col("duration_s") >= min_s) & (F.col("distance_m") >= min_m))


def receiver_evidence(records: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us", navic: int = 7) -> DataFrame:
    """Per drive, from snapshots ``raw, visible, raw_measurements, adr, satellites array<struct<constellation, cn0>>``: counts,
    maxima, whether a raw measurement or a ``navic`` satellite was seen, mean C/N0 of all satellites.

    Strengths are summed within each row first, so no row is exploded.
    """
    heard = F.filter("satellites", lambda s: F.coalesce(F.abs(s.cn0) < float("inf"), F.lit(False)))
    total = F.aggregate(heard, F.lit(0.0), lambda acc, s: acc + s.cn0)
    d = records.withColumns({"__sum": total, "__n": F.size(heard), "__navic": F.exists("satellites", lambda s: s.constellation == navic)})
    return d.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.coalesce(F.bool_or("raw"), F.lit(False)).alias("raw_seen"), F.coalesce(F.bool_or("__navic"), F.lit(False)).alias("navic_seen"), F.coalesce(F.max("visible"), F.lit(0)).alias("max_visible"),
        F.coalesce(F.max("raw_measurements"), F.lit(0)).alias("max_raw"), F.coalesce(F.max("adr"), F.lit(0)).alias("max_adr"), F.try_divide(F.sum("__sum"), F.sum("__n")).alias("mean_cn0"),
    )


def sampling_summary(audit: DataFrame, histogram: str = "histogram", width_ms: int = 5, band_ms: tuple[int, int] = (95, 105)) -> DataFrame:
    """One row over trips: medians, the share of intervals in ``band_ms`` from the trips' histograms (bins of ``width_ms``), gap and
    jump totals, fix intervals. ``audit(dt_ms, dt_std_ms, gaps, long_gaps, largest_gap_s, backward_jumps, fix_interval_s)``."""
    lo, hi = (x // width_ms for x in band_ms)
    inside = F.aggregate(F.slice(histogram, lo + 1, hi - lo), F.lit(0).cast("long"), lambda acc, x: acc + x)
    whole = F.aggregate(histogram, F.lit(0).cast("long"), lambda acc, x: acc + x)
    fix = F.col("fix_interval_s")
    return audit.agg(
        F.median("dt_ms").alias("dt_ms"), F.median("dt_std_ms").alias("dt_std_ms"), F.try_divide(F.sum(inside), F.sum(whole)).alias("share_in_band"), F.sum("gaps").alias("gaps"), F.sum("long_gaps").alias("long_gaps"), F.max("largest_gap_s").alias("largest_gap_s"),
        F.sum("backward_jumps").alias("backward_jumps"), F.median(fix).alias("fix_interval_s"), F.min(fix).alias("fix_min_s"), F.max(fix).alias("fix_max_s"), F.count_if(fix <= 1.5).alias("trips_1s_fixes"), F.count_if(fix >= 8.5).alias("trips_9s_fixes"),
    )


def sync_summary(audit: DataFrame, dt: float = 0.1) -> DataFrame:
    """One row over trips ``(rows_phone, rows_vbox, start_offset_s, row_lag, lag, lag_source, mode, gps_lag_s, gps_corr)``: row counts,
    lags of trips whose lag is their own before and after pairing by clock, sources, trips that fell back on row numbers."""
    own = F.col("lag_source") == "own"
    seconds = lambda c: F.when(own, F.abs(c) * dt)
    close = F.when(F.col("gps_corr") > 0.8, F.col("gps_lag_s"))
    source = lambda name: F.count_if(F.col("lag_source") == name).alias(f"lags_{name}")
    return audit.agg(
        F.count_if(F.col("rows_phone") == F.col("rows_vbox")).alias("equal_rows"), F.count_if(F.col("rows_phone") != F.col("rows_vbox")).alias("different_rows"), F.max(F.abs(F.col("rows_phone") - F.col("rows_vbox"))).alias("largest_row_difference"),
        F.median(F.abs("start_offset_s")).alias("start_offset_s"), F.max(F.abs("start_offset_s")).alias("max_start_offset_s"), F.median(seconds("row_lag")).alias("row_lag_s"), F.max(seconds("row_lag")).alias("max_row_lag_s"), F.median(seconds("lag")).alias("clock_lag_s"),
        F.max(seconds("lag")).alias("max_clock_lag_s"), F.count_if(F.col("mode") == "row").alias("row_fallbacks"), source("own"), source("session"), source("unverified"), F.median(close).alias("gps_lag_s"), F.min(close).alias("gps_lag_min_s"), F.max(close).alias("gps_lag_max_s"), F.count_if(F.col("gps_corr") >= 0.8).alias("gps_corr_high"),
    )


def score_windows(windows: DataFrame, predictor: Callable, features: str = "features", means: Sequence[float] = (), scales: Sequence[float] = ()) -> DataFrame:
    """Adds ``speed_ms, sigma_ms, z_max`` by ``predictor(array of windows) -> (speeds, log variances)``, called for each Arrow batch.

    ``features`` is an array of doubles; it is scaled by ``means`` and ``scales`` where given, and ``z_max`` is the greatest scaled
    magnitude. Windows with nulls, or of another length than the batch's most common one, get nulls.
    """
    import numpy as np
    import pandas as pd

    def run(frames):
        for f in frames:
            out = np.full((len(f), 3), np.nan)
            lens = f[features].map(lambda x: -1 if x is None or pd.isna(x).any() else len(x))
            usual = lens[lens >= 0].mode()
            rows = np.flatnonzero(lens == usual.iloc[0]) if len(usual) else np.zeros(0, int)
            if len(rows):
                x = np.stack([np.asarray(v, float) for v in f[features].iloc[rows]])
                if len(means):
                    x = (x - np.asarray(means)) / np.asarray(scales)
                speed, log_var = predictor(x)
                out[rows] = np.column_stack([speed, np.exp(np.asarray(log_var) / 2), np.abs(x).max(axis=1)])
            yield f.assign(speed_ms=out[:, 0], sigma_ms=out[:, 1], z_max=out[:, 2])

    clear = windows.drop("speed_ms", "sigma_ms", "z_max")
    schema = ", ".join(f"`{n}` {t}" for n, t in clear.dtypes) + ", speed_ms double, sigma_ms double, z_max double"
    scored = clear.mapInPandas(run, schema)
    return scored.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in ("speed_ms", "sigma_ms", "z_max")})


def simulated_outage_score(blackouts: DataFrame, withheld: DataFrame, sigmas: DataFrame, keys: Sequence[str] = ("drive",), t_us: str = "t_us") -> DataFrame:
    """Per planned blackout ``(keys, est_lat, est_lon, restored_lat, restored_lon)``: ``distance_m`` along its withheld fixes, the last
    estimate's ``endpoint_error_m`` with ``along_m, cross_m`` of the last two fixes' way, first, peak and last sigma, ``recovery_jump_m``.

    ``withheld(keys, lat, lon, accuracy_m)`` and ``sigmas(keys, sigma_m)`` carry the blackout's keys. Without a fix all but
    the sigmas are null.
    """
    by = Window.partitionBy(*keys).orderBy(t_us)
    f = withheld.select(*keys, t_us, "lat", "lon", "accuracy_m", F.first("lat").over(by).alias("lat0"), F.lag("lat").over(by).alias("plat"), F.lag("lon").over(by).alias("plon"))
    north = lambda a, b: (b - a) * DEGREE_M
    east = lambda a, b: (b - a) * DEGREE_M * F.cos(F.radians("lat0"))
    dn, de = north(F.col("plat"), F.col("lat")), east(F.col("plon"), F.col("lon"))
    end = F.struct("lat", "lon", "plat", "plon", "accuracy_m")
    track = f.groupBy(*keys).agg(F.coalesce(F.sum(F.sqrt(dn * dn + de * de)), F.lit(0.0)).alias("distance_m"), F.max_by(end, t_us).alias("e"), F.first("lat0").alias("lat0"))
    s = sigmas.groupBy(*keys).agg(F.min_by("sigma_m", t_us).alias("first_sigma_m"), F.max("sigma_m").alias("peak_sigma_m"), F.max_by("sigma_m", t_us).alias("last_sigma_m"))
    d = blackouts.join(track, list(keys), "left").join(s, list(keys), "left")
    e = F.col("e")
    d = d.withColumns({"n": north(e.lat, F.col("est_lat")), "w": east(e.lon, F.col("est_lon")), "wn": north(e.plat, e.lat), "we": east(e.plon, e.lon), "jn": north(F.col("est_lat"), F.col("restored_lat")), "je": east(F.col("est_lon"), F.col("restored_lon"))})
    way = F.sqrt(F.col("wn") * F.col("wn") + F.col("we") * F.col("we"))
    moved = F.when(way > 1e-6, way)
    return d.select(
        *keys, "distance_m", F.sqrt(F.col("n") * F.col("n") + F.col("w") * F.col("w")).alias("endpoint_error_m"), F.abs((F.col("n") * F.col("wn") + F.col("w") * F.col("we")) / moved).alias("along_m"), F.abs((F.col("n") * F.col("we") - F.col("w") * F.col("wn")) / moved).alias("cross_m"),
        "first_sigma_m", "peak_sigma_m", "last_sigma_m", F.sqrt(F.col("jn") * F.col("jn") + F.col("je") * F.col("je")).alias("recovery_jump_m"), e.accuracy_m.alias("fix_accuracy_m"),
    )
