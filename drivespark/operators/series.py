"""Time-series operators: a partition is a drive or a segment of one, in time order.

Every one is a window over its partition, so a job needs a single shuffle by the drive's key, which windows with the same
keys share. ``order`` must be unique within a partition for the result to be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def unwrap_day_clock(df: DataFrame, clock: str, keys: Sequence[str], order: str) -> DataFrame:
    """Adds 86,400 s after each drop of more than half a day."""
    w = _by(keys, order)
    drop = (F.lag(clock).over(w) - F.col(clock) > 43_200).cast("int")
    days = F.sum(F.coalesce(drop, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__days", days).withColumn(clock, F.col(clock) + F.col("__days") * 86_400).drop("__days")


def repair_time(df: DataFrame, clock: str, keys: Sequence[str], order: str) -> DataFrame:
    """Timestamps that repeat the one before are interpolated over row numbers; after the last good one they stay there."""
    w = _by(keys, order)
    d = df.withColumn("__n", F.row_number().over(w))
    good = F.when(F.coalesce(F.col(clock) != F.lag(clock).over(w), F.lit(True)), F.struct(F.col("__n").alias("n"), F.col(clock).cast("double").alias("t")))
    d = d.withColumn("__good", good)
    d = d.withColumn("__a", F.last("__good", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.last("__good", True).over(Window.partitionBy(*keys).orderBy(F.desc("__n")).rowsBetween(Window.unboundedPreceding, 0)))
    a, b, n = F.col("__a"), F.col("__b"), F.col("__n")
    made = F.when(b.isNull() | (a.n == b.n), a.t).otherwise(a.t + (b.t - a.t) * F.try_divide(n - a.n, b.n - a.n))
    return d.withColumn(clock, made).drop("__n", "__good", "__a", "__b")


def valid_segments(df: DataFrame, valid: str, keys: Sequence[str], order: str, min_len: int = 20) -> DataFrame:
    """Adds ``seg_id``: 0, 1, ... for runs of at least ``min_len`` valid rows, -1 elsewhere; a null isn't valid."""
    w = _by(keys, order)
    ok = F.coalesce(F.col(valid), F.lit(False))
    d = df.withColumn("__ok", ok)
    d = d.withColumn("__run", F.sum((F.col("__ok") != F.coalesce(F.lag("__ok").over(w), ~F.col("__ok"))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__keep", F.col("__ok") & (F.count("*").over(Window.partitionBy(*keys, "__run")) >= min_len))
    first = (F.col("__keep") & ~F.coalesce(F.lag("__keep").over(w), F.lit(False))).cast("int")
    d = d.withColumn("__no", F.sum(first).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.withColumn("seg_id", F.when(F.col("__keep"), F.col("__no")).otherwise(-1)).drop("__ok", "__run", "__keep", "__no")


def shift_channels(df: DataFrame, cols: Sequence[str], keys: Sequence[str], order: str, lag: str, max_lag: int | None = None) -> DataFrame:
    """Each of ``cols`` taken ``lag`` rows further on (a column, one value for a drive); null where there is no such row.

    With ``max_lag``, a bound of |lag|, the values come from a window of that many rows on both sides; without, from a join.
    """
    d = df.withColumn("__n", F.row_number().over(_by(keys, order)))
    if max_lag is None:
        right = d.select(*keys, F.col("__n"), *(F.col(c).alias(f"__{c}") for c in cols))
        d = d.withColumn("__n", F.col("__n") + F.col(lag)).join(right, [*keys, "__n"], "left")
    else:
        near = F.collect_list(F.struct(F.col("__n").alias("n"), *cols)).over(_by(keys, "__n").rowsBetween(-max_lag, max_lag))
        at = F.try_element_at("__l", (F.col("__n") + F.col(lag) - F.element_at("__l", 1).n + 1).cast("int"))
        inside = F.col("__n") + F.col(lag) >= F.element_at("__l", 1).n
        d = d.withColumn("__l", near).withColumns({f"__{c}": F.when(inside, at[c]) for c in cols}).drop("__l")
    return d.select(*(F.col(f"__{c}").alias(c) if c in cols else F.col(c) for c in df.columns))


def fix_age(df: DataFrame, lat: str, lon: str, keys: Sequence[str], order: str, dt: float = 0.1, out: str = "fix_age_s") -> DataFrame:
    """Seconds since the held position last changed; a missing position counts as a change."""
    w = _by(keys, order)
    d = df.withColumn("__n", F.row_number().over(w))
    same = (F.col(lat) == F.lag(lat).over(w)) & (F.col(lon) == F.lag(lon).over(w))
    last = F.max(F.when(~F.coalesce(same, F.lit(False)), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__last", last).withColumn(out, (F.col("__n") - F.col("__last")) * dt).drop("__n", "__last")


def clean_channels(df: DataFrame, clips: dict[str, float], keys: Sequence[str], order: str) -> DataFrame:
    """Median of three (zeros past a segment's ends), then clipped to plus or minus the channel's limit."""
    w = _by(keys, order)
    near = lambda c: F.array(F.coalesce(F.lag(c).over(w), F.lit(0.0)), F.col(c), F.coalesce(F.lead(c).over(w), F.lit(0.0)))
    d = df.withColumns({f"__{c}": near(c) for c in clips})
    median = lambda c: F.element_at(F.array_sort(F.col(f"__{c}")), 2)
    return d.withColumns({c: F.when(F.col(c).isNotNull(), F.greatest(F.lit(-m), F.least(F.lit(m), median(c)))) for c, m in clips.items()}).drop(*(f"__{c}" for c in clips))


def speed_jump_mask(df: DataFrame, speed: str, keys: Sequence[str], order: str, max_jump: float = 3.0, out: str = "valid") -> DataFrame:
    """False where the speed changed by more than ``max_jump`` since the row before."""
    return df.withColumn(out, F.coalesce(F.abs(F.col(speed) - F.lag(speed).over(_by(keys, order))) <= max_jump, F.lit(True)))


def savgol_weights(length: int = 11, order: int = 2, at: int | None = None) -> list[float]:
    """Weights of a least-squares polynomial over ``length`` points, taken at point ``at`` (the middle one)."""
    import numpy as np

    x = np.arange(length) - length // 2
    fit = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    return [float(v) for v in (np.vander([x[length // 2 if at is None else at]], order + 1, increasing=True) @ fit)[0]]


def truth_accels(df: DataFrame, speed: str, yaw_dps: str, keys: Sequence[str], order: str, dt: float = 0.1, length: int = 11) -> DataFrame:
    """Adds ``a_long`` (central difference of speed, smoothed by a quadratic over 11 rows; at the ends by the first or last
    11 rows' quadratic) and ``a_lat`` (speed times yaw rate). Drives shorter than 11 rows stay unsmoothed."""
    w, half = _by(keys, order), length // 2
    d = df.withColumns({"__n": F.row_number().over(w), "__m": F.count("*").over(Window.partitionBy(*keys)), "__p": F.lag(speed).over(w), "__x": F.lead(speed).over(w)})
    grad = F.when(F.col("__p").isNull(), (F.col("__x") - F.col(speed)) / dt).when(F.col("__x").isNull(), (F.col(speed) - F.col("__p")) / dt).otherwise((F.col("__x") - F.col("__p")) / (2 * dt))
    d = d.withColumn("__g", F.coalesce(grad, F.lit(0.0)))
    d = d.withColumns({f"__{k}": F.lead("__g", k).over(w) if k > 0 else F.lag("__g", -k).over(w) for k in range(1 - length, length)})

    def fitted(at: int):
        """The fit over the rows at - at ... at + (length - 1 - at), at this row."""
        terms = [F.col("__g" if k == at else f"__{k - at}") * weight for k, weight in enumerate(savgol_weights(length, 2, at))]
        return sum(terms[1:], terms[0])

    a = F.when(F.col("__m") < length, F.col("__g"))
    for k in range(half):
        a = a.when(F.col("__n") == k + 1, fitted(k)).when(F.col("__m") - F.col("__n") == k, fitted(length - 1 - k))
    d = d.withColumn("a_long", a.otherwise(fitted(half))).withColumn("a_lat", F.col(speed) * F.radians(yaw_dps))
    return d.drop("__n", "__m", "__p", "__x", "__g", *(f"__{k}" for k in range(1 - length, length)))


def make_windows(df: DataFrame, features: Sequence[str], label: str, keys: Sequence[str] = ("trip_id", "seg_id"), order: str = "t", win: int = 20, stride: int = 2, norm: str = "norm_a") -> DataFrame:
    """Windows of ``win`` rows within one segment: ``keys, start, stop, features`` (win x features), ``y`` (the last row's
    label), ``vib`` (mean distance of the acceleration from gravity, over 3, clipped to 1)."""
    w = _by(keys, order)
    rows = w.rowsBetween(1 - win, 0)
    d = df.withColumn("__n", F.row_number().over(w))
    d = d.withColumns({
        "features": F.collect_list(F.array(*(F.col(f).cast("float") for f in features))).over(rows),
        "vib": F.least(F.lit(1.0), F.avg(F.abs(F.col(norm) - 9.81)).over(rows) / 3).cast("float"),
    }).where((F.col("__n") >= win) & ((F.col("__n") - win) % stride == 0))
    return d.select(*keys, (F.col("__n") - win).alias("start"), F.col("__n").alias("stop"), "features", F.col(label).cast("float").alias("y"), "vib")


def stationary_flags(df: DataFrame, keys: Sequence[str], order: str, accel: Sequence[str] = ("ax", "ay", "az"), gz: str = "gz", win: int = 10, max_std: float = 0.15, max_yaw: float = 0.02, out: str = "quiet") -> DataFrame:
    """True where the last ``win`` rows of this segment vary little and turn little; false until there are as many."""
    rows = _by(keys, order).rowsBetween(1 - win, 0)
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in accel[1:]), F.col(accel[0]) * F.col(accel[0])))
    d = df.withColumn("__norm", norm)
    quiet = (F.count("__norm").over(rows) == win) & (F.stddev_samp("__norm").over(rows) < max_std) & (F.avg(F.abs(gz)).over(rows) < max_yaw)
    return d.withColumn(out, F.coalesce(quiet, F.lit(False))).drop("__norm")


def baseline_hold(df: DataFrame, speed: str, keys: Sequence[str], order: str, block: int = 300, out: str = "pred") -> DataFrame:
    """The value at the first row of each block of ``block`` rows of a segment."""
    d = df.withColumn("__b", F.floor((F.row_number().over(_by(keys, order)) - 1) / block))
    return d.withColumn(out, F.first(speed).over(_by([*keys, "__b"], order))).drop("__b")


def baseline_classical_dr(df: DataFrame, ax: str, quiet: str, v0: str, keys: Sequence[str], order: str, block: int = 300, dt: float = 0.1, out: str = "pred") -> DataFrame:
    """Speed by integrating ``ax`` from each block's first value: 0 where quiet and under 2 m/s, never below 0.

    A block is one ordered array of at most ``block`` rows, folded in the JVM.
    """
    d = df.withColumn("__n", F.row_number().over(_by(keys, order)) - 1).withColumn("__b", F.floor(F.col("__n") / block))
    step = F.struct("__n", F.col(ax).alias("a"), F.col(quiet).alias("q"), F.col(v0).alias("v"))
    arrays = d.groupBy(*keys, "__b").agg(F.array_sort(F.collect_list(step)).alias("rows"))
    zero = F.array(F.element_at("rows", 1).v.cast("double"))

    def fold(acc, r):
        v = F.element_at(acc, -1)
        new = F.when(r.q & (v < 2), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), v + r.a * dt))
        return F.concat(acc, F.array(new))

    speeds = F.aggregate(F.slice("rows", 2, block), zero, fold)
    flat = arrays.select(*keys, F.posexplode(F.arrays_zip(F.transform("rows", lambda r: r["__n"]).alias("n"), speeds.alias("s"))).alias("i", "z")).select(*keys, F.col("z.n").alias("__n"), F.col("z.s").alias(out))
    return d.join(flat, [*keys, "__n"]).drop("__n", "__b")


def dr_track(df: DataFrame, speed: str, keys: Sequence[str], order: str, heading_deg: str | None = None, gz: str | None = None, heading0: str | None = None, dt: float = 0.1) -> DataFrame:
    """Adds ``east, north``: speed along the true heading, or along the first heading less the integral of ``gz``."""
    w = _by(keys, order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    if heading_deg is None:
        turned = F.sum(F.col(gz) * dt).over(sofar)
        df = df.withColumn("__h", F.radians(F.first(heading0).over(w)) - turned)
    else:
        df = df.withColumn("__h", F.radians(heading_deg))
    return df.withColumn("east", F.sum(F.col(speed) * F.sin("__h") * dt).over(sofar)).withColumn("north", F.sum(F.col(speed) * F.cos("__h") * dt).over(sofar)).drop("__h")


def upsample_linear(df: DataFrame, channels: Sequence[str], keys: Sequence[str], order: str, factor: int = 2, nominal: float = 0.1) -> DataFrame:
    """``factor`` rows for each: linear to the next row, held at nominal spacing where there is no usable one."""
    w = _by(keys, order)
    nxt = {c: F.lead(c).over(w) for c in [order, *channels]}
    d = df.withColumns({f"__{c}": x for c, x in nxt.items()})
    usable = F.coalesce(F.col(f"__{order}") > F.col(order), F.lit(False))
    d = d.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(factor - 1)))).withColumn("__f", F.col("__s") / factor)
    line = lambda c: F.when(usable & F.col(f"__{c}").isNotNull(), F.col(c) + (F.col(f"__{c}") - F.col(c)) * F.col("__f")).otherwise(F.col(c))
    at = F.when(usable, F.col(order) + (F.col(f"__{order}") - F.col(order)) * F.col("__f")).otherwise(F.col(order) + F.col("__f") * nominal)
    return d.select(*keys, at.alias(order), *(line(c).alias(c) for c in channels))


def road_anomalies(df: DataFrame, accel: str, keys: Sequence[str], t_ms: str, win: int = 25, debounce_ms: int = 500) -> DataFrame:
    """Rows whose |acceleration| exceeds the mean of the last 25 by 2.5 (LOW), 4.5 (MEDIUM) or 7 (HIGH).

    An event within ``debounce_ms`` of the last emitted one is dropped: over the few candidates of a drive that is a fold
    of an ordered array.
    """
    d = df.withColumn("__d", F.abs(accel) - F.avg(F.abs(accel)).over(_by(keys, t_ms).rowsBetween(1 - win, 0)))
    severity = F.when(F.col("__d") >= 7, "HIGH").when(F.col("__d") >= 4.5, "MEDIUM").when(F.col("__d") >= 2.5, "LOW")
    hits = d.withColumn("severity", severity).where("severity IS NOT NULL")
    lists = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(t_ms).alias("t"), F.col(accel).alias("a"), "severity"))).alias("l"))
    keep = F.aggregate("l", F.slice("l", 1, 0), lambda acc, e: F.when((F.size(acc) == 0) | (e.t - F.try_element_at(acc, F.lit(-1)).t >= debounce_ms), F.concat(acc, F.array(e))).otherwise(acc))
    return lists.select(*keys, F.explode(keep).alias("e")).select(*keys, F.col("e.t").alias(t_ms), F.col("e.a").alias(accel), "e.severity")
