"""Scores of GNSS outages: what a speed or a held velocity would have made of the time without fixes.

Nothing is replayed. Every track is a prefix sum over its drive, so an outage costs the difference of two rows: its first
and its last one, which a fixed ``lead`` or an ordered window finds. All windows share one shuffle by drive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import add_ned, horizontal_distance_m, ned_between, wrap_360
from ..staging import staged
from .joins import last_at_or_before

MODES = ("true_heading", "gyro_heading")
#: A quantile's sketch is off by at most one in so many of a group's rows.
SKETCH = 10_000


def _tracks(df: DataFrame, speeds: dict[str, str], held: str, keys: Sequence[str], order: str, speed: str, heading: str, gz: str, east: str, north: str, dt: float) -> DataFrame:
    """Rows with their number, the speed held from there (``v0``) and, in ``s``, the running sums that any window is a difference of."""
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(F.col(gz) * dt).over(upto)
    d = df.withColumn("__i", (F.row_number().over(w) - 1).cast("int")).withColumn("__g", turned)
    moved = F.when(F.col("__i") > 0, F.col(speed) * dt).otherwise(0.0)
    sums = [F.sum(moved).over(upto).alias("dist"), F.col("__g").alias("g"), F.col(heading).alias("h"), F.col(east).alias("east"), F.col(north).alias("north")]
    for name, column in [*speeds.items(), ("hold", None)]:
        v = F.lit(1.0) if column is None else F.coalesce(column, F.lit(0.0))
        for mode, angle in zip(MODES, (F.radians(heading), F.col("__g")), strict=True):
            sums += [F.sum(v * F.sin(angle) * dt).over(upto).alias(f"{name}_{mode}_s"), F.sum(v * F.cos(angle) * dt).over(upto).alias(f"{name}_{mode}_c")]
        if column is not None:
            sums.append(F.sum(F.when(F.col(column).isNull() | F.isnan(column), 1).otherwise(0)).over(upto).alias(f"{name}_missing"))
    return d.select(*keys, F.col("__i").alias("i"), F.col(held).cast("double").alias("v0"), F.struct(F.col("__i").alias("i"), *sums).alias("s"))


def drift_over_windows(df: DataFrame, speeds: dict[str, str], held: str, keys: Sequence[str] = ("trip_id", "seg_id"), order: str = "i", speed: str = "speed_ms", heading: str = "heading_deg", gz: str = "gz", east: str = "east", north: str = "north", horizons_s: Sequence[float] = (30, 60), distances_m: Sequence[float] = (1000.0,), stride_s: float = 10.0, first: int = 19, min_mean_speed: float = 3.0, dt: float = 0.1) -> DataFrame:
    """One row for each outage, strategy and heading mode: where dead reckoning ends, in per cent of the distance driven.

    ``speeds`` names the speed columns of the strategies; ``hold`` keeps ``held`` of the outage's first row. Outages start
    every ``stride_s`` from row ``first`` on and last a time, or until a distance is driven; those that don't fit are left
    out. ``skipped`` marks a mean speed under ``min_mean_speed`` or a missing prediction: no error then.
    """
    t = _tracks(df, speeds, held, keys, order, speed, heading, gz, east, north, dt)
    start = (F.col("i") >= first) & (F.pmod(F.col("i") - first, F.lit(round(stride_s / dt))) == 0)
    w = Window.partitionBy(*keys).orderBy("i")
    timed = [F.struct(F.lit(f"{h:g}s").alias("label"), F.lead("s", round(h / dt)).over(w).alias("e")) for h in horizons_s]
    rows = t.withColumn("ends", F.array(*timed) if timed else F.array()).where(start)
    found = rows.select(*keys, "s", "v0", F.explode("ends").alias("x")).select(*keys, "s", "v0", "x.label", "x.e")
    for metres in distances_m:
        # The first row at or past the distance, looked up from the far end: rows come before the starts that they end.
        # A start is a mark and a question, made in place: nothing is joined or dealt out again.
        ask = lambda side, at: F.struct(F.lit(side).alias("side"), at.alias("at"))
        mark, question = ask(0, F.col("s.dist")), ask(1, F.col("s.dist") + metres)
        both = t.withColumn("x", F.explode(F.when(start, F.array(mark, question)).otherwise(F.array(mark)))).select(*keys, "x.at", "x.side", F.col("i").alias("n"), "s", "v0")
        back = Window.partitionBy(*keys).orderBy(F.desc("at"), "side", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("e", F.last(F.when(F.col("side") == 0, F.col("s")), True).over(back)).where("side = 1")
        found = found.unionByName(both.select(*keys, "s", "v0", F.lit(f"{metres:g}m").alias("label"), "e"))
    found = found.where("e IS NOT NULL")
    s, e = F.col("s"), F.col("e")
    dist, took = e.dist - s.dist, (e.i - s.i) * dt
    results = []
    for name in [*speeds, "hold"]:
        missing = F.lit(False) if name == "hold" else e[f"{name}_missing"] > s[f"{name}_missing"]
        slow = F.coalesce(dist / took < min_mean_speed, F.lit(True)) | missing | ((F.col("v0").isNull()) if name == "hold" else F.lit(False))
        for mode in MODES:
            de, dn = e[f"{name}_{mode}_s"] - s[f"{name}_{mode}_s"], e[f"{name}_{mode}_c"] - s[f"{name}_{mode}_c"]
            if mode == "gyro_heading":  # the heading is the first one less the turn since: an addition theorem
                a = F.radians(s.h) + s.g
                de, dn = F.sin(a) * dn - F.cos(a) * de, F.cos(a) * dn + F.sin(a) * de
            if name == "hold":
                de, dn = de * F.col("v0"), dn * F.col("v0")
            x, y = de - (e.east - s.east), dn - (e.north - s.north)
            results.append(F.struct(F.lit(name).alias("strategy"), F.lit(mode).alias("heading_mode"), slow.alias("skipped"), F.when(~slow, F.sqrt(x * x + y * y)).alias("error_m")))
    out = found.select(*keys, "label", s.i.alias("i0"), dist.alias("distance_m"), took.alias("duration_s"), F.explode(F.array(*results)).alias("r"))
    return out.select(*keys, "label", "i0", "r.*", "distance_m", "duration_s", (F.col("r.error_m") * 100 / F.col("distance_m")).alias("drift_pct"))


def drift_window_summary(windows: DataFrame, keys: Sequence[str] = ("strategy", "heading_mode", "label")) -> DataFrame:
    """Per strategy, heading mode and kind of window: scored and skipped outages, and the drift's distribution.

    The windows are written once; of each quantile a sketch says between which values it lies, and only what is between them
    is counted value by value, so no task holds a group's values.
    """
    scored = ~F.col("skipped")
    asked = [("drift_pct", 0.5, "median_pct"), ("drift_pct", 0.9, "p90_pct"), ("distance_m", 0.5, "median_distance_m"), ("duration_s", 0.5, "median_duration_s")]
    d = staged(windows.select(*keys, "skipped", *dict.fromkeys(c for c, _, _ in asked)))
    k = F.struct(*keys)
    g = d.groupBy(k.alias("k")).agg(
        F.count_if(scored).alias("n_windows"), F.avg(F.when(scored, F.col("drift_pct"))).alias("mean_pct"), F.avg(F.when(scored, (F.col("drift_pct") < 10).cast("double"))).alias("share_under_10_pct"), F.count_if(~scored).alias("skipped"),
        *(F.percentile_approx(F.when(scored, F.col(c)), [max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH)], SKETCH).alias(f"s_{name}") for c, p, name in asked), *(F.count(F.when(scored, F.col(c))).alias(f"n_{name}") for c, _, name in asked),
    )
    g = staged(g)
    asks = g.select("k", F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), F.col(f"n_{name}").alias("n"), F.col(f"s_{name}")[0].alias("lo"), F.col(f"s_{name}")[1].alias("hi")) for _, p, name in asked))))
    at = F.col("p") * (F.col("n") - 1)
    asks = staged(asks.where("n > 0").withColumn("at", at))
    values = d.where(scored).select(k.alias("k"), F.inline(F.array(*(F.struct(F.lit(name).alias("name"), F.col(c).alias("v")) for c, _, name in asked)))).where("v IS NOT NULL")

    def found(asks: DataFrame) -> DataFrame:
        """The values at the whole places before and after ``at``, null where they aren't between ``lo`` and ``hi``."""
        met = values.join(F.broadcast(asks.select(F.col("k").alias("k2"), F.col("name").alias("name2"), "lo", "hi")), F.col("k").eqNullSafe(F.col("k2")) & (F.col("name") == F.col("name2"))).drop("k2", "name2")
        place = F.when(F.col("v") < F.col("lo"), F.lit(-1)).when(F.col("v") > F.col("hi"), F.lit(1)).otherwise(0)
        counts = met.select("k", "name", place.alias("place"), F.when(place == 0, F.col("v")).alias("v")).groupBy("k", "name", "place", "v").agg(F.count("*").alias("c")).where("place <= 0")
        upto = counts.withColumn("upto", F.sum("c").over(Window.partitionBy("k", "name").orderBy("place", "v"))).where("place = 0")
        own = upto.join(F.broadcast(asks.select(F.col("k").alias("k2"), F.col("name").alias("name2"), "at")), F.col("k").eqNullSafe(F.col("k2")) & (F.col("name") == F.col("name2"))).drop("k2", "name2")
        holds = lambda i: F.max(F.when((F.col("upto") - F.col("c") <= i) & (i < F.col("upto")), F.col("v")))
        return own.groupBy("k", "name").agg(F.first("at").alias("at"), holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"))

    near = staged(found(asks))
    done = near.where("a IS NOT NULL AND b IS NOT NULL")
    missed = asks.join(done.select(F.col("k").alias("k2"), F.col("name").alias("name2")), F.col("k").eqNullSafe(F.col("k2")) & (F.col("name") == F.col("name2")), "left_anti")
    if not missed.isEmpty():  # a sketch that was farther off than it says
        done = done.unionByName(found(missed.withColumns({"lo": F.lit(float("-inf")), "hi": F.lit(float("nan"))})))
    between = F.when(F.floor("at") == F.ceil("at"), F.col("a")).when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b"))
    quantiles = done.groupBy(F.col("k").alias("k2")).agg(*(F.max(F.when(F.col("name") == name, between)).alias(name) for _, _, name in asked))
    out = g.join(F.broadcast(quantiles), F.col("k").eqNullSafe(F.col("k2")), "left")
    return out.select(*(F.col(f"k.{c}").alias(c) for c in keys), "n_windows", "median_pct", "mean_pct", "p90_pct", "share_under_10_pct", "median_distance_m", "median_duration_s", "skipped")


def outage_starts(logs: DataFrame, durations_s: Sequence[int] = (10, 30, 60, 120), settle_s: int = 10, stride_s: int = 20, most: int = 16) -> DataFrame:
    """``drive, start_us, duration_s`` from ``logs(drive, lead_us, end_us[, floor_us])``: starts from ``settle_s`` after the
    lead (and not before the floor), at least ``stride_s`` apart and about ``most`` of them; durations that fit the log."""
    floor = F.col("floor_us") if "floor_us" in logs.columns else F.lit(None).cast("long")
    first = F.greatest(F.col("lead_us") + settle_s * 1_000_000, floor)
    last = F.col("end_us") - min(durations_s) * 1_000_000
    d = logs.withColumns({"a": first, "b": last}).where("a <= b").withColumn("step", F.greatest(F.lit(stride_s * 1_000_000).cast("long"), F.expr(f"(b - a) DIV {most}")))
    d = d.select("drive", "end_us", F.explode(F.sequence("a", "b", "step")).alias("start_us"))
    return d.select("drive", "start_us", "end_us", F.explode(F.array(*map(F.lit, durations_s))).alias("duration_s")).where(F.col("start_us") + F.col("duration_s") * 1_000_000 <= F.col("end_us")).drop("end_us")


def hold_velocity_outages(fixes: DataFrame, logs: DataFrame, max_accuracy_m: float = 12.0, max_fix_age_s: float = 3.0, min_distance_m: float = 20.0, **starts) -> DataFrame:
    """One row for each start and duration: how far holding the last velocity ends from the last withheld fix.

    ``fixes(drive, t_us, lat, lon, accuracy_m, speed, bearing, mocked)``; truth is what isn't mocked and accurate enough.
    ``reason`` says why an outage has no error: no recent fix at its start, no truth within 2 s of its end, too little
    travel. The distance is by speeds where every fix has one, else by positions; the error is split along and across
    the travel at the end.
    """
    w = Window.partitionBy("drive").orderBy("t_us")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    f = fixes.where(~F.coalesce("mocked", F.lit(False)) & (F.col("accuracy_m") <= max_accuracy_m)).select("drive", "t_us", "lat", "lon", "speed", "bearing")
    before = {c: F.lag(c).over(w) for c in ("t_us", "lat", "lon", "speed")}
    f = f.withColumns({f"p_{c}": x for c, x in before.items()})
    north, east = ned_between(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    f = f.withColumns({"step_n": north, "step_e": east}).withColumn("step", F.sqrt(F.col("step_n") * F.col("step_n") + F.col("step_e") * F.col("step_e")))
    gap = (F.col("t_us") - F.col("p_t_us")) / 1e6
    moved = F.when((gap > 0) & (gap <= 3), F.col("step"))
    course = wrap_360(F.degrees(F.atan2("step_e", "step_n")))
    speed = F.coalesce("speed", moved / gap, F.lit(0.0))
    bearing = F.coalesce("bearing", F.when(moved > 3, course))
    f = f.withColumns({
        "by_speed": F.sum(F.coalesce((F.col("speed") + F.col("p_speed")) * 0.5 * gap, F.lit(0.0))).over(upto), "by_step": F.sum(F.coalesce("step", F.lit(0.0))).over(upto),
        "no_speed": F.sum(F.col("speed").isNull().cast("int")).over(upto), "gone": F.col("speed").isNull().cast("int"),
        "v": F.when((speed > 1) & bearing.isNotNull(), speed).otherwise(0.0), "b": F.coalesce(bearing, F.lit(0.0)), "travel": F.when(F.col("step") > 3, course).otherwise(F.col("bearing")),
    })
    values = ["lat", "lon", "by_speed", "by_step", "no_speed", "gone", "v", "b", "travel"]
    o = outage_starts(logs, **starts).withColumn("t_us", F.col("start_us"))
    o = last_at_or_before(o, f, ["drive"], "t_us", values)
    o = o.select("drive", "start_us", "duration_s", (F.col("start_us") + F.col("duration_s") * 1_000_000).alias("t_us"), F.struct("at", *values).alias("o"))
    o = last_at_or_before(o, f, ["drive"], "t_us", values)
    a = F.col("o")
    doppler = F.col("no_speed") - a.no_speed + a.gone == 0
    dist = F.when(doppler, F.col("by_speed") - a.by_speed).otherwise(F.col("by_step") - a.by_step)
    seconds = (F.col("at") - a["at"]) / 1e6
    lat, lon = add_ned(a.lat, a.lon, a.v * F.cos(F.radians(a.b)) * seconds, a.v * F.sin(F.radians(a.b)) * seconds)
    o = o.withColumns({"distance_m": dist, "held_lat": F.when(a.v == 0, a.lat).otherwise(lat), "held_lon": F.when(a.v == 0, a.lon).otherwise(lon)})
    reason = (
        F.when(a["at"].isNull() | (F.col("start_us") - a["at"] > max_fix_age_s * 1e6), "noRecentFix")
        .when((F.col("at") <= F.col("start_us")) | (F.col("t_us") - F.col("at") > 2_000_000), "noTruthAtEnd").when(F.col("distance_m") < min_distance_m, "tooLittleTravel")
    )
    o = o.withColumn("reason", reason)
    n, e = ned_between(F.col("lat"), F.col("lon"), F.col("held_lat"), F.col("held_lon"))
    way = F.radians("travel")
    scored = F.col("reason").isNull()
    return o.select("drive", "start_us", "duration_s", "reason", F.when(scored, F.col("at")).alias("truth_us"), F.when(scored, F.col("lat")).alias("lat"), F.when(scored, F.col("lon")).alias("lon"), F.when(scored, F.col("distance_m")).alias("distance_m"),
                    F.when(scored, F.sqrt(n * n + e * e)).alias("hold_error_m"), F.when(scored, n * F.cos(way) + e * F.sin(way)).alias("along_m"), F.when(scored, e * F.cos(way) - n * F.sin(way)).alias("cross_m"))


def score_estimates(outages: DataFrame, estimates: DataFrame, bucket_us: int = 60_000_000) -> DataFrame:
    """``outages`` with the error of a track ``estimates(drive, t_us, lat, lon, sigma_m, leading)`` at the last withheld fix.

    ``engineNotLeading`` where the track wasn't leading at the start. ``max_sigma_m`` is the largest sigma during the
    outage, found by an equi-join on the minutes that it touches.
    """
    e = estimates.select("drive", "t_us", F.col("lat").alias("e_lat"), F.col("lon").alias("e_lon"), F.col("sigma_m").alias("est_sigma_m"), "leading")
    o = outages.withColumn("t_us", F.col("start_us"))
    o = last_at_or_before(o, e, ["drive"], "t_us", ["leading"]).withColumnRenamed("leading", "led").drop("at")
    o = last_at_or_before(o.withColumn("t_us", F.col("truth_us")), e, ["drive"], "t_us", ["e_lat", "e_lon", "est_sigma_m"]).drop("at", "t_us")
    reason = F.when(~F.coalesce("led", F.lit(False)), "engineNotLeading").otherwise(F.col("reason"))
    o = o.withColumn("reason", reason).withColumn("est_error_m", F.when(F.col("reason").isNull(), horizontal_distance_m(F.col("lat"), F.col("lon"), F.col("e_lat"), F.col("e_lon"))))
    end = F.col("start_us") + F.col("duration_s") * 1_000_000
    touched = o.select("drive", "start_us", "duration_s", end.alias("end_us"), F.explode(F.sequence(F.expr(f"start_us DIV {bucket_us}"), (end / bucket_us).cast("long"))).alias("b"))
    sigmas = e.select("drive", "t_us", "est_sigma_m", F.expr(f"t_us DIV {bucket_us}").alias("b"))
    most = touched.join(sigmas, ["drive", "b"]).where((F.col("t_us") >= F.col("start_us")) & (F.col("t_us") <= F.col("end_us"))).groupBy("drive", "start_us", "duration_s").agg(F.max("est_sigma_m").alias("max_sigma_m"))
    return o.join(most, ["drive", "start_us", "duration_s"], "left").drop("e_lat", "e_lon", "led")


def outage_log_summary(outages: DataFrame, keys: Sequence[str] = ("drive",), order: str = "start_us", target_pct: float = 10.0, capacity: int = 500) -> DataFrame:
    """Per key: outages without consecutive repeats, the last ``capacity`` of them: count, met target, median and worst drift.

    An outage repeats the one before if distance and error are the same.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    same = F.col("distance_m").eqNullSafe(F.lag("distance_m").over(w)) & F.col("error_m").eqNullSafe(F.lag("error_m").over(w)) & F.lag(order).over(w).isNotNull()
    kept = outages.withColumn("__same", same).where("NOT __same").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("__n") <= capacity)
    drift = F.when(F.col("distance_m") > 0, F.col("error_m") * 100 / F.col("distance_m"))
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(drift < target_pct).alias("met"), F.median(drift).alias("median_pct"), F.max(drift).alias("worst_pct"))
