"""Speed from the line that the wheels leave in the vertical vibration: short spectra, and a scale learnt from steady fixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Microseconds, samples, hertz, segments, times the median.
WINDOW_US, EVERY_US, LEAST_FILL, LEAST_SAMPLES, LEAST_HZ = 4_000_000, 1_000_000, 0.9, 16, 30.0
LOW_HZ, HIGH_HZ, SEGMENTS, PROMINENCE = 2.0, 20.0, 3, 12.0
#: Metres a second, pairs, shares.
SPEEDS, PAIRS, LEAST_PAIRS, SPREAD, INLIERS, CHANGE, LEAST_FIXES, SIGMAS = (4.0, 45.0), 40, 12, 0.08, 0.8, 0.04, 3, (0.4, 2.5)


def strongest_line(z: np.ndarray, rate_hz: float) -> tuple[float, float, float] | None:
    """(hertz, prominence, hertz of a bin) of the strongest line from 2 to 20 Hz in evenly spaced samples, or None.

    The powers of three half-overlapping Hann segments are added; the place within the bin is that of a parabola through the
    logarithms of the three powers around the greatest.
    """
    length = 2 * len(z) // (SEGMENTS + 1)
    size = 1 << max(0, length - 1).bit_length()
    bin_hz = rate_hz / size
    lo, hi = max(1, int(np.ceil(LOW_HZ / bin_hz))), min(size // 2 - 1, int(np.floor(HIGH_HZ / bin_hz)))
    if hi - lo < 4:
        return None
    starts = np.arange(SEGMENTS) * length // 2
    parts = (z - z.mean())[starts[:, None] + np.arange(length)] * np.hanning(length)
    power = (np.abs(np.fft.rfft(parts, size, axis=1)[:, lo : hi + 1]) ** 2).sum(0)
    best, middle = int(power.argmax()), float(np.median(power))
    if middle <= 0 or power[best] < PROMINENCE * middle:
        return None
    shift = 0.0
    if 0 < best < len(power) - 1:
        a, b, c = np.log(power[best - 1 : best + 2] + 1e-12)
        bend = a - 2 * b + c
        shift = float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else 0.0
    return (lo + best + shift) * bin_hz, float(power[best] / middle), bin_hz


def vibration_lines(imu: DataFrame, key: str = "drive_id") -> DataFrame:
    """``key, t_us, peak_hz, prominence, bin_hz``: at whole seconds, the line in the last four seconds of ``t_us, z``; no row where
    there is none, or where samples are too few, too slow (30 Hz) or fill under 90 % of the window.

    Each sample goes to the windows it lies in, so a group is four seconds of one drive; null or infinite samples and null
    times are left out, of samples at one time the least counts.
    """
    ends = F.sequence(F.ceil(F.col("t_us") / EVERY_US).cast("long"), F.ceil((F.col("t_us") + WINDOW_US) / EVERY_US).cast("long") - 1)
    s = imu.where("t_us IS NOT NULL AND abs(z) < double('infinity')").groupBy(key, "t_us").agg(F.min("z").alias("z"))
    w = s.withColumn("end", F.explode(ends)).groupBy(key, "end").agg(F.sort_array(F.collect_list(F.struct("t_us", F.col("z").cast("double").alias("z")))).alias("l"))
    span = (F.element_at("l", -1)["t_us"] - F.element_at("l", 1)["t_us"]) / 1e6
    w = w.withColumn("span", span).where((F.size("l") >= LEAST_SAMPLES) & (F.col("span") >= LEAST_FILL * WINDOW_US / 1e6))
    w = w.withColumn("rate", (F.size("l") - 1) / F.col("span")).where(F.col("rate") >= LEAST_HZ).select(F.col(key), (F.col("end") * EVERY_US).alias("t_us"), F.transform("l", lambda x: x["z"]).alias("z"), "rate")

    @F.pandas_udf("peak_hz double, prominence double, bin_hz double")
    def line(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for zs, rates in batches:
            found = [strongest_line(np.asarray(z), r) or (None, None, None) for z, r in zip(zs, rates, strict=True)]
            yield pd.DataFrame(found, columns=["peak_hz", "prominence", "bin_hz"], dtype="float64")

    return w.select(key, "t_us", line("z", "rate").alias("p")).select(key, "t_us", "p.*").where("peak_hz IS NOT NULL")


def _fit(ratios: Column) -> Column:
    """Struct ``scale, spread, trusted`` of the ratios of speed and line: the mean of those within 8 % of their median."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    # A lambda over an array of one names a value, so that it is evaluated once.
    named = lambda x, then: F.get(F.transform(F.array(x), then), F.lit(0))
    half = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    close = lambda s: named(half(s), lambda m: F.struct(m.alias("m"), F.filter(s, lambda r: F.abs(r - m) <= SPREAD * m).alias("near"), F.size(s).alias("n")))
    mean = lambda v: F.struct(F.try_divide(total(v["near"]), F.size(v["near"])).alias("mean"), v["m"].alias("m"), v["near"].alias("near"), v["n"].alias("n"))
    square = lambda v: F.try_divide(total(F.transform(v["near"], lambda r: (r - v["mean"]) * (r - v["mean"]))), F.size(v["near"]))
    fit = lambda v: F.struct(F.coalesce(v["mean"], v["m"]).alias("scale"), F.coalesce(F.sqrt(square(v)) / v["mean"], F.lit(1.0)).alias("spread"), ((v["n"] >= LEAST_PAIRS) & (F.size(v["near"]) >= INLIERS * v["n"])).alias("trusted"))
    found = named(F.array_sort(ratios), lambda s: named(close(s), lambda v: named(mean(v), fit)))
    return F.when(F.size(ratios) > 0, found)


def vibration_scale(lines: DataFrame, fixes: DataFrame, key: str = "drive_id") -> DataFrame:
    """``lines`` with ``ratio`` (where a window's fixes ``t_us, speed_mps`` teach one) and, by the fit of up to 40 ratios before
    it, ``scale, trusted, speed_mps, sigma_mps``.

    A window teaches if it has three fixes whose mean is between 4 and 45 m/s and which differ by at most 4 % of it. A speed is
    given where the fit is trusted (12 ratios, 80 % of them within 8 % of the median) and the speed is in that range.
    """
    c = F.col
    seconds = F.sequence(F.ceil(c("t_us") / EVERY_US).cast("long"), F.floor((c("t_us") + WINDOW_US) / EVERY_US).cast("long"))
    f = fixes.where("t_us IS NOT NULL AND abs(speed_mps) < double('infinity')").withColumn("end", F.explode(seconds))
    f = f.groupBy(key, (c("end") * EVERY_US).alias("t_us")).agg(F.count("*").alias("n"), F.avg("speed_mps").alias("mean"), (F.max("speed_mps") - F.min("speed_mps")).alias("change"))
    f = f.where((c("n") >= LEAST_FIXES) & c("mean").between(*SPEEDS) & (c("change") <= CHANGE * c("mean"))).select(c(key).alias("__k"), c("t_us").alias("__t"), "mean")
    d = lines.join(f, lines[key].eqNullSafe(f["__k"]) & (c("t_us") == c("__t")), "left").drop("__k", "__t")
    d = d.withColumn("ratio", c("mean") / c("peak_hz")).drop("mean").withColumn("__taught", c("ratio").isNotNull())
    own = Window.partitionBy(key, "__taught").orderBy("t_us").rowsBetween(1 - PAIRS, 0)
    d = d.withColumn("__fit", F.when(c("__taught"), _fit(F.collect_list("ratio").over(own))))
    past = Window.partitionBy(key).orderBy("t_us").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__fit", F.last("__fit", True).over(past))
    speed = c("__fit.scale") * c("peak_hz")
    d = d.withColumns({"scale": c("__fit.scale"), "trusted": F.coalesce(c("__fit.trusted"), F.lit(False)), "speed_mps": F.when(c("__fit.trusted") & speed.between(*SPEEDS), speed)})
    sigma = F.sqrt(F.pow(c("speed_mps") * c("__fit.spread"), 2) + F.pow(c("scale") * c("bin_hz") / 2, 2))
    return d.withColumn("sigma_mps", F.when(c("speed_mps").isNotNull(), F.greatest(F.lit(SIGMAS[0]), F.least(F.lit(SIGMAS[1]), sigma)))).drop("__fit", "__taught")
