"""Aggregations over drives, sessions, predictions and receivers. Groups are summed before the shuffle wherever they can be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND_EDGES_KMH = (0, 10, 30, 60, 90, 250)


def nearest_rank(values: Column, p: float) -> Column:
    """The sorted value at min(n - 1, floor(p * n)); for groups that are bounded by design."""
    ordered = F.sort_array(values)
    n = F.size(values)
    return F.when(n > 0, F.get(ordered, F.least(n - 1, F.floor(n * p).cast("int"))))


def upper_median(values: Column) -> Column:
    """The sorted value at n // 2."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def raw_trip_stats(df: DataFrame, clock: str, key: str = "trip_id", order: str = "i", checked: Sequence[str] = ()) -> DataFrame:
    """Facts about a recording before alignment: rows, interval median, its spread within the 1st and 99th percentile,
    backward clocks, gaps over 1 s, off-beat intervals, missing values."""
    d = df.withColumn("__dt", F.col(clock) - F.lag(clock).over(Window.partitionBy(key).orderBy(order)))
    cut = d.groupBy(key).agg(F.percentile("__dt", F.array(F.lit(0.01), F.lit(0.99))).alias("__c"))
    d = d.join(cut, key)
    inner = F.when((F.col("__dt") > F.col("__c")[0]) & (F.col("__dt") < F.col("__c")[1]), F.col("__dt"))
    return d.groupBy(key).agg(
        F.count("*").alias("rows"), F.percentile("__dt", 0.5).alias("dt_median"), F.stddev_pop(inner).alias("dt_std_trimmed"), F.count_if(F.col("__dt") <= 0).alias("backwards"),
        F.count_if(F.col("__dt") > 1.0).alias("gaps"), F.count_if(F.abs(F.col("__dt") - 0.1) > 0.011).alias("glitches"), *(F.count_if(F.col(c).isNull() | F.isnan(c)).alias(f"missing_{c}") for c in checked),
    )


def interval_histogram(df: DataFrame, clock: str, key: str, order: str, width: float, top: float) -> DataFrame:
    """``key, bin, n``: counts of clock intervals in bins of ``width``, clipped to [0, top]."""
    dt = F.col(clock) - F.lag(clock).over(Window.partitionBy(key).orderBy(order))
    d = df.select(key, dt.alias("dt")).where("dt IS NOT NULL")
    return d.groupBy(key, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(float(top)), F.col("dt"))) / width).alias("bin")).agg(F.count("*").alias("n"))


def speed_stats(df: DataFrame, key: str, speed: str = "speed_ms", dt: float = 0.1) -> DataFrame:
    """Distance, mean, 95th percentile, maximum and stationary share; missing speeds are left out."""
    d = df.where(F.col(speed).isNotNull() & ~F.isnan(speed))
    v = F.col(speed)
    return d.groupBy(key).agg((F.sum(v) * dt / 1000).alias("distance_km"), (F.avg(v) * 3.6).alias("mean_kmh"), (F.percentile(v, 0.95) * 3.6).alias("p95_kmh"), (F.max(v) * 3.6).alias("max_kmh"), F.avg((v < 0.3).cast("double")).alias("stationary_share"))


def group_table(trips: DataFrame, dims: Sequence[str] = ("driver", "category")) -> DataFrame:
    """Trips, rows, hours, kilometres and included trips by each dimension and in total; ``dim`` names the grouping."""
    sets = [[F.col(d)] for d in dims] + [[]]
    out = trips.groupingSets(sets, *(F.col(d) for d in dims)).agg(
        F.count("*").alias("trips"), F.sum("rows").alias("rows"), (F.sum("rows") / 36_000).alias("hours"), F.sum("km").alias("km"), F.count_if("included").alias("included_trips"),
        F.coalesce(F.sum(F.when(F.col("included"), F.col("km"))), F.lit(0.0)).alias("included_km"), F.grouping_id().alias("__g"),
    )
    n = len(dims)
    dim = F.lit("total")
    for i, d in enumerate(dims):
        dim = F.when(F.col("__g") == (1 << n) - 1 - (1 << (n - 1 - i)), d).otherwise(dim)
    return out.select(dim.alias("dim"), F.coalesce(*dims).alias("value"), "trips", "rows", "hours", "km", "included_trips", "included_km")


def speed_distribution(df: DataFrame, speed: str = "speed_ms", keys: Sequence[str] = (), edges: Sequence[float] = BAND_EDGES_KMH) -> DataFrame:
    """Percentiles, mean, maximum (km/h) and the share of rows in each band."""
    v = F.col(speed) * 3.6
    share = [F.avg(((v >= a) & (v < b)).cast("double")).alias(f"share_{a}_{b}") for a, b in zip(edges[:-1], edges[1:], strict=True)]
    p = F.percentile(v, F.array(*map(F.lit, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99))))
    out = df.groupBy(*keys).agg(p.alias("p"), F.avg(v).alias("mean"), F.max(v).alias("max"), *share)
    names = ("p1", "p5", "p25", "p50", "p75", "p95", "p99")
    return out.select(*keys, *(F.col("p")[i].alias(n) for i, n in enumerate(names)), "mean", "max", *(f"share_{a}_{b}" for a, b in zip(edges[:-1], edges[1:], strict=True)))


def speed_metrics(df: DataFrame, y: str, p: str, keys: Sequence[str] = ()) -> DataFrame:
    """Errors of a prediction: n, MAE, RMSE, R2 (null without variance), bias, median, 90th and 95th percentile."""
    e = F.col(p) - F.col(y)
    q = F.percentile(F.abs(e), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), F.var_pop(y).alias("__v"), F.avg(e * e).alias("__m"), q.alias("__q")
    )
    r2 = F.when(F.col("__v") > 0, F.lit(1.0) - F.try_divide("__m", "__v"))
    return out.select(*keys, "n", "mae", "rmse", (F.col("rmse") * 3.6).alias("rmse_kmh"), r2.alias("r2"), "bias", *(F.col("__q")[i].alias(c) for i, c in enumerate(("median_abs", "p90_abs", "p95_abs"))))


def speed_band_table(df: DataFrame, y: str, p: str, edges_kmh: Sequence[float] = BAND_EDGES_KMH, keys: Sequence[str] = ()) -> DataFrame:
    """``speed_metrics`` for each band of true speed; speeds outside all bands are left out."""
    v, band = F.col(y) * 3.6, F.lit(None).cast("string")
    for a, b in zip(edges_kmh[:-1], edges_kmh[1:], strict=True):
        band = F.when((v >= a) & (v < b), f"{a}-{b}").otherwise(band)
    return speed_metrics(df.withColumn("band", band).where("band IS NOT NULL"), y, p, [*keys, "band"])


def sigma_calibration(df: DataFrame, y: str, p: str, sigma: str, keys: Sequence[str]) -> DataFrame:
    """For each key: Spearman's correlation of |error| and sigma (average ranks), shares within 1 and 2 sigma, spread of
    error / sigma."""
    d = df.withColumn("__e", F.col(p) - F.col(y)).withColumn("__a", F.abs("__e"))

    def rank(c):
        w = Window.partitionBy(*keys)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2.0

    d = d.withColumns({"__ra": rank("__a"), "__rs": rank(sigma)})
    z = F.try_divide("__e", sigma)
    return d.groupBy(*keys).agg(F.corr("__ra", "__rs").alias("spearman"), F.avg((F.col("__a") <= F.col(sigma)).cast("double")).alias("within_1"), F.avg((F.col("__a") <= 2 * F.col(sigma)).cast("double")).alias("within_2"), F.stddev_pop(z).alias("z_std"))


def session_summary(sessions: DataFrame, telemetry: DataFrame, now: Column) -> DataFrame:
    """One row for each session: records, duration (an open one lasts until ``now``), RMSE and maximum of 1 - confidence,
    percent of rows in dead reckoning; a session without records has nulls there and 0 records."""
    miss = F.lit(1.0) - F.col("confidence")
    t = telemetry.groupBy("session_id").agg(F.count("*").alias("records"), F.sqrt(F.avg(miss * miss)).alias("rmse"), F.max(miss).alias("max_error"), (F.avg((F.col("mode") == "DEAD_RECKONING").cast("double")) * 100).alias("dr_share_pct"))
    end = F.coalesce("stopped_us", now)
    out = sessions.join(t, "session_id", "left")
    return out.select("session_id", F.coalesce("records", F.lit(0)).alias("records"), (F.greatest(F.lit(0), end - F.col("started_us")) / 1e6).alias("duration_s"), "rmse", "max_error", "dr_share_pct")


def dashboard(summaries: DataFrame) -> DataFrame:
    """One row of totals over session summaries."""
    return summaries.agg(F.count("*").alias("sessions"), F.sum("records").alias("records"), F.sum("duration_s").alias("duration_s"), F.round(F.lit(100.0) - F.avg("max_error") * 100).alias("mean_confidence"))


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("started_us"), "session_id").limit(n)


def outage_stats(windows: DataFrame, keys: Sequence[str] = ("duration_s",), target_pct: float = 10.0) -> DataFrame:
    """Per duration: scored outages, median, nearest-rank 95th percentile and worst error, median drift, how many the
    estimate won, whether the median drift meets the target. The rank is found over counts of values, not over a list."""
    drift = F.try_divide(F.col("est_error_m") * 100, "distance_m")
    scored = windows.where(F.col("est_error_m").isNotNull())
    values = scored.groupBy(*keys, "est_error_m").agg(F.count("*").alias("c"))
    upto, total = F.sum("c").over(Window.partitionBy(*keys).orderBy("est_error_m")), F.sum("c").over(Window.partitionBy(*keys))
    rank = values.withColumns({"upto": upto, "n": total}).where(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))).groupBy(*keys).agg(F.min("est_error_m").alias("p95_m"))
    stats = scored.groupBy(*keys).agg(
        F.count("*").alias("n"), F.median("est_error_m").alias("median_m"), F.max("est_error_m").alias("worst_m"),
        F.median(drift).alias("median_drift_pct"), F.count_if(F.col("est_error_m") < F.col("hold_error_m")).alias("wins"), (F.median(drift) < target_pct).alias("meets_target"),
    )
    return stats.join(rank, list(keys))


def median_over_drives(stats: DataFrame, keys: Sequence[str] = ("duration_s",), min_n: int = 3, target_pct: float = 10.0) -> DataFrame:
    """Median over drives of their median drift; drives with fewer than ``min_n`` scored outages don't count."""
    return stats.where(F.col("n") >= min_n).groupBy(*keys).agg(F.count("*").alias("drives"), F.median("median_drift_pct").alias("median_drift_pct"), F.count_if(F.col("median_drift_pct") < target_pct).alias("under_target"))


def satellite_breakdown(sats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Used satellites by constellation: count and mean SNR; shares of two systems by count x max(SNR, 1)."""
    b = sats.where("used").groupBy(*keys).agg(*(x for s in ("GPS", "NAVIC") for x in (F.count_if(F.col("constellation") == s).alias(f"{s.lower()}_n"), F.avg(F.when(F.col("constellation") == s, F.col("snr"))).alias(f"{s.lower()}_snr"))), F.count("*").alias("used"))
    score = lambda s: F.col(f"{s}_n") * F.greatest(F.coalesce(f"{s}_snr", F.lit(0.0)), F.lit(1.0))
    total = score("gps") + score("navic")
    return b.withColumns({f"{s}_weight": F.when(total > 0, F.try_divide(score(s), total)).otherwise(0.0) for s in ("gps", "navic")})


def risk_cells(samples: DataFrame, cell: Sequence[str] = ("mx", "my"), min_obs: int = 6, min_journeys: int = 3) -> DataFrame:
    """Cells with enough observations and journeys: the mean over journeys of their degraded share, so that one recorder
    with many rows weighs as much as any other."""
    j = samples.groupBy(*cell, "journey_id").agg(F.count("*").alias("n"), F.avg(F.col("degraded").cast("double")).alias("share"))
    return j.groupBy(*cell).agg(F.sum("n").alias("observations"), F.count("*").alias("journeys"), F.avg("share").alias("risk")).where((F.col("observations") >= min_obs) & (F.col("journeys") >= min_journeys))


def mount_stats(df: DataFrame, px: str, py: str, a_long: str, a_lat: str, key: str) -> DataFrame:
    """Additive sums on centred channels: along, across, both energies, rows."""
    d = df.where(" AND ".join(f"{c} IS NOT NULL" for c in (px, py, a_long, a_lat)))
    n = F.count("*")
    cov = lambda a, b: F.covar_pop(a, b) * n
    return d.groupBy(key).agg((cov(px, a_long) + cov(py, a_lat)).alias("a"), (cov(py, a_long) - cov(px, a_lat)).alias("b"), (cov(px, px) + cov(py, py)).alias("pp"), (cov(a_long, a_long) + cov(a_lat, a_lat)).alias("ee"), n.alias("n"))


def pool_mount(stats: DataFrame, key: str) -> DataFrame:
    return stats.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("a", "b", "pp", "ee", "n")))


def fit_mount(stats: DataFrame) -> DataFrame:
    """Adds the mount angle, its correlation and z; nothing is known under 50 rows."""
    rho = F.try_divide(F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b")), F.sqrt(F.col("pp") * F.col("ee")))
    enough = F.col("n") >= 50
    return stats.withColumns({"theta": F.when(enough, F.atan2("b", "a")).otherwise(0.0), "rho": F.when(enough, F.coalesce(rho, F.lit(0.0))).otherwise(0.0)}).withColumn("z", F.col("rho") * F.sqrt(F.col("n") / 50))


def choose_lags(lags: DataFrame, session: str = "session", min_z: float = 3.0) -> DataFrame:
    """Each trip's clock lag: its own if clear, else the weighted median of its session's clear trips, else 0."""
    clear = lags.where(F.col("z") >= min_z).withColumn("w", F.col("n") * F.col("corr") * F.col("corr"))
    by = Window.partitionBy(session)
    run = clear.withColumns({"upto": F.sum("w").over(by.orderBy("lag", "trip_id").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(by)})
    middle = run.where(F.col("upto") * 2 >= F.col("all")).groupBy(session).agg(F.min("lag").alias("__m"))
    own = F.col("z") >= min_z
    d = lags.join(middle, session, "left")
    return d.select("trip_id", F.when(own, F.col("lag")).otherwise(F.coalesce("__m", F.lit(0))).alias("lag"), F.when(own, "own").when(F.col("__m").isNotNull(), "session").otherwise("unverified").alias("source"))


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature, mean, std`` (population; 0 becomes 1), one row for each feature."""
    one = df.agg(*(F.avg(c).alias(f"m_{c}") for c in cols), *(F.stddev_pop(c).alias(f"s_{c}") for c in cols))
    rows = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") == 0, 1.0).otherwise(F.col(f"s_{c}")).alias("std")) for c in cols))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def feature_correlation(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``a, b, corr`` for each pair of features, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def gate_counts(outcomes: DataFrame, now_us: Column, window_s: int = 60) -> DataFrame:
    """Per source in the last ``window_s`` seconds: accepted, refused, last outcome."""
    d = outcomes.where((F.col("t_us") > now_us - window_s * 1_000_000) & (F.col("t_us") <= now_us))
    return d.groupBy("source").agg(F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"), F.max_by("reason", F.struct("t_us", "event_id")).alias("last_reason"), F.max("t_us").alias("last_us"))


def speed_calibration(pairs: DataFrame, key: str, order: str, model: str, gnss: str, last_n: int = 300) -> DataFrame:
    """gnss = scale x model + offset over a key's last pairs: a scale only if the model's speeds spread by 2 m/s or more,
    refused outside 0.7 to 1.4, ready from 30 pairs on."""
    d = pairs.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= last_n)
    s = d.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(gnss, model).alias("slope"), F.avg(gnss).alias("mg"), F.avg(model).alias("mm"), F.stddev_pop(model).alias("spread"))
    usable = (F.col("spread") >= 2) & (F.col("slope") >= 0.7) & (F.col("slope") <= 1.4)
    scale = F.when(usable, F.col("slope")).otherwise(1.0)
    return s.select(key, "n", scale.alias("scale"), (F.col("mg") - scale * F.col("mm")).alias("offset"), ((F.col("n") >= 30) & ~((F.col("spread") >= 2) & ~usable)).alias("ready"))
