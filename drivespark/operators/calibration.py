"""Calibration from rest, and how the clocks of two recorders drift apart along a trip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .replay import xcorr_lag


def still_calibration(imu: DataFrame, keys: Sequence[str] = ("drive",), order: str = "i", rows: int = 50, accel_std: float = 0.08, gyro_std: float = 0.015, least: int = 200, max_bias: float = 0.2) -> DataFrame:
    """Per key, over samples whose last ``rows`` magnitudes ``ax, ay, az`` and ``gx, gy, gz`` are still: ``samples, bias_x, bias_y,
    bias_z`` of the gyroscope, ``gyro_noise, accel_noise, quality, refused``.

    Refused (``too_few`` still samples, ``moving``: a bias over ``max_bias``) keys have nulls; rows with nulls or values that
    aren't finite take no part. Accelerometer offsets, which need several orientations, aren't fitted.
    """
    fine = F.lit(True)
    for c in ("ax", "ay", "az", "gx", "gy", "gz"):
        fine = fine & (F.abs(c) < float("inf"))
    size = lambda s: F.sqrt(sum((F.col(f"{s}{x}") * F.col(f"{s}{x}") for x in "xyz"), F.lit(0.0)))
    d = imu.withColumns({"__a": size("a"), "__g": size("g"), "__fine": F.coalesce(fine, F.lit(False))})
    w = Window.partitionBy(*keys, "__fine").orderBy(order).rowsBetween(1 - rows, 0)
    still = F.col("__fine") & (F.count("*").over(w) >= rows) & (F.stddev_pop("__a").over(w) < accel_std) & (F.stddev_pop("__g").over(w) < gyro_std)
    d = d.withColumn("__still", still)
    on = lambda c: F.when(F.col("__still"), F.col(c))
    g = d.groupBy(*keys).agg(F.count_if("__still").alias("samples"), *(F.avg(on(f"g{x}")).alias(f"bias_{x}") for x in "xyz"), F.stddev_pop(on("__g")).alias("gyro_noise"), F.stddev_pop(on("__a")).alias("accel_noise"))
    bias = F.sqrt(sum((F.col(f"bias_{x}") * F.col(f"bias_{x}") for x in "xyz"), F.lit(0.0)))
    g = g.withColumn("refused", F.when(F.col("samples") < least, "too_few").when(bias > max_bias, "moving"))
    quality = F.least(F.lit(0.99), 0.55 + 0.45 * F.least(F.lit(1.0), F.col("samples") / (least * 3)) * F.greatest(F.lit(0.0), 1 - F.col("gyro_noise") / (gyro_std * 2)))
    g = g.withColumn("quality", quality)
    return g.select(*keys, "samples", *(F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in ("bias_x", "bias_y", "bias_z", "gyro_noise", "accel_noise", "quality")), "refused")


def coarse_lag_drift(df: DataFrame, ref: str, sig: str, keys: Sequence[str] = ("trip_id",), order: str = "i", block: int = 3000, search: int = 80, max_lag: int = 900, least_corr: float = 0.5, outlier: int = 30, least: int = 4) -> DataFrame:
    """Per key ``lag`` (of the whole trip), ``slope, offset`` (samples by sample) and ``blocks``: a straight line through the lags of blocks
    of ``block`` rows that overlap by half, each sought within ``search`` of the whole trip's.

    Blocks that correlate under ``least_corr``, that aren't full, or that lie over ``outlier`` from the median don't count; under
    ``least`` blocks the line is flat at the whole lag. Blocks are groups of their own, so only the whole lag takes a trip at once.
    """
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long")
    d = df.select(*keys, n.alias("__n"), ref, sig)
    whole = xcorr_lag(d, ref, sig, keys, "__n", max_lag).select(*keys, F.col("lag").alias("__lag"))
    late = d.select(*keys, "__n", sig).join(whole, list(keys)).select(*keys, "__lag", (F.col("__n") - F.col("__lag")).alias("__n"), sig)
    half = block // 2
    b = d.select(*keys, "__n", ref).join(late, [*keys, "__n"])
    last = F.floor(F.col("__n") / half)
    b = b.withColumn("__b", F.explode(F.array(last, last - 1))).where("__b >= 0")
    full = b.groupBy(*keys, "__b", "__lag").agg(F.count("*").alias("__c")).where(F.col("__c") == block).drop("__c")
    lags = xcorr_lag(b.drop("__lag"), ref, sig, [*keys, "__b"], "__n", search).join(full, [*keys, "__b"]).where(F.abs("corr") >= least_corr)
    lags = lags.select(*keys, (F.col("__b") * half + block / 2).alias("x"), (F.col("__lag") + F.col("lag")).cast("double").alias("y"))
    middle = lags.groupBy(*keys).agg(F.median("y").alias("m"))
    near = lags.join(middle, list(keys)).where(F.abs(F.col("y") - F.col("m")) <= outlier)
    line = near.groupBy(*keys).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("o"), F.count("*").alias("blocks"))
    enough = F.col("blocks") >= least
    return whole.join(line, list(keys), "left").select(*keys, F.col("__lag").alias("lag"), F.when(enough, F.col("s")).otherwise(0.0).alias("slope"), F.when(enough, F.col("o")).otherwise(F.col("__lag").cast("double")).alias("offset"), F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))
