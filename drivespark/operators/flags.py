"""Latched fault flags along drives, without a fold: each detector is a window over the rows that it looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_diff_deg, horizontal_distance_m, ned_between

#: Fixed values of the detectors: rows, degrees a second, metres a second squared, shares, sigmas, seconds.
COURSE_MPS, GYRO_ROWS, GYRO_DEG_S, ACCEL_ROWS, ACCEL_MPS2, SAME_SIGN = 3.0, 20, 0.35, 10, 0.15, 0.7
CUSUM_SLACK, CUSUM_LIMIT = 0.5, 15.0
DELAY_ROWS, DELAY_S, DELAY_MPS, DELAY_SHARE, CROSS_SHARE, ALONG_SIGMAS = 10, 0.3, 3.0, 0.7, 0.4, 3.0
BIAS_JUMP = 0.03


def yaw_between_fixes(imu: DataFrame, fixes: DataFrame, key: str = "drive_id") -> DataFrame:
    """``fixes`` with ``yaw_deg``: the yaw rate (``t_us, yaw_rad_s``) integrated since the last usable fix, by running sums.

    A step of over half a second, or of none, adds nothing; before the first usable fix the sum is from the beginning.
    """
    by = Window.partitionBy(key).orderBy("t_us")
    dt = (F.col("t_us") - F.lag("t_us").over(by)) / 1e6
    step = F.when((dt > 0) & (dt <= 0.5), F.coalesce(F.degrees("yaw_rad_s"), F.lit(0.0)) * dt).otherwise(0.0)
    a = imu.select(key, "t_us", step.alias("__d"), F.lit(0).alias("__side"), F.lit(False).alias("usable"))
    b = fixes.select(key, "t_us", F.lit(0.0).alias("__d"), F.lit(1).alias("__side"), "usable")
    total = F.sum("__d").over(Window.partitionBy(key).orderBy("t_us", "__side"))
    d = a.unionByName(b).withColumn("__total", total).where("__side = 1")
    before = F.last(F.when(F.col("usable"), F.col("__total")), True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    sums = d.select(F.col(key).alias("__k"), F.col("t_us").alias("__t"), (F.col("__total") - F.coalesce(before, F.lit(0.0))).alias("yaw_deg")).dropDuplicates(["__k", "__t"])
    return fixes.join(sums, fixes[key].eqNullSafe(sums["__k"]) & (fixes["t_us"] == sums["__t"]), "left").drop("__k", "__t")


def fault_flags(fixes: DataFrame, key: str = "drive_id") -> DataFrame:
    """``key, mechanism, t_us``: the first time each detector raised its flag on a drive; none, no row.

    Fixes have ``t_us, lat, lon, bearing_deg, speed_mps, sigma_m, usable, yaw_deg`` (see ``yaw_between_fixes``) and the state
    predicted before them: ``p_lat, p_lon, p_sigma_m, p_mps, p_deg, accel_bias`` (forward), ``bias_x, bias_y, bias_z``
    (gyroscope). ``gyro_bias``: yaw and course rates between usable fixes in motion differ by 0.35 degrees a second in the
    mean of 20, most to one side. ``accel_bias``: it has left its first value by 0.15 in the mean of 10. ``integrity``: the
    cumulated innovations, less half a sigma each, pass 15; a sum that restarts at 0 is a running sum less its least value
    so far. ``delay``: ten predictions lie ahead of their fixes along the course alone, by 0.3 seconds in the mean.
    ``bias_jump``: two estimates in a row differ by 0.03. Only usable fixes with a prediction count (any for ``bias_jump``);
    where a detector's inputs are null or not finite the row is none of its rows. Rows of one time are ordered by place.
    """
    c = F.col
    order = ["t_us", "lat", "lon"]
    by = Window.partitionBy(key).orderBy(*order)
    good = fixes.where("usable AND p_lat IS NOT NULL AND p_lon IS NOT NULL AND t_us IS NOT NULL")
    size = lambda n: by.rowsBetween(1 - n, 0)

    def one_sided(rows: DataFrame, n: int, bound: float, name: str) -> DataFrame:
        w = size(n)
        mean = F.avg("r").over(w)
        agree = F.when(mean > 0, F.count_if(c("r") > 0).over(w)).otherwise(F.count_if(c("r") < 0).over(w))
        d = rows.withColumns({"__n": F.count("*").over(w), "__mean": mean, "__agree": agree})
        return d.where((c("__n") == n) & (F.abs("__mean") >= bound) & (c("__agree") / n >= SAME_SIGN)).select(key, F.lit(name).alias("mechanism"), "t_us")

    last = lambda x: F.lag(x).over(by)
    dt = (c("t_us") - last("t_us")) / 1e6
    moving = (c("speed_mps") > COURSE_MPS) & (last("speed_mps") > COURSE_MPS)
    rate = (c("yaw_deg") - angle_diff_deg(c("bearing_deg"), last("bearing_deg"))) / dt
    gyro = good.withColumn("r", F.when((dt > 0) & moving, rate)).where("r IS NOT NULL AND NOT isnan(r)")
    accel = good.where("accel_bias IS NOT NULL AND NOT isnan(accel_bias)").withColumn("r", c("accel_bias") - F.first("accel_bias").over(by))

    sigma = F.sqrt(c("sigma_m") * c("sigma_m") + F.coalesce(c("p_sigma_m"), F.lit(0.0)) * F.coalesce(c("p_sigma_m"), F.lit(0.0)))
    z = good.withColumn("__s", sigma).where("__s > 0 AND abs(__s) < double('infinity')").withColumn("__z", horizontal_distance_m(c("p_lat"), c("p_lon"), c("lat"), c("lon")) / c("__s") - CUSUM_SLACK)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    z = z.where("__z IS NOT NULL AND NOT isnan(__z)").withColumn("__sum", F.sum("__z").over(upto))
    z = z.withColumn("__least", F.least(F.lit(0.0), F.min("__sum").over(upto)))
    integrity = z.where(c("__sum") - c("__least") > CUSUM_LIMIT).select(key, F.lit("integrity").alias("mechanism"), "t_us")

    north, east = ned_between(c("lat"), c("lon"), c("p_lat"), c("p_lon"))
    cos, sin = F.cos(F.radians("p_deg")), F.sin(F.radians("p_deg"))
    d = good.where(c("p_mps") >= DELAY_MPS).withColumns({"__along": north * cos + east * sin, "__cross": F.abs(east * cos - north * sin)})
    d = d.where((c("__along") > 0) & (c("__cross") <= c("__along") * CROSS_SHARE) & (c("p_sigma_m") > 0) & (c("__along") >= c("p_sigma_m") * ALONG_SIGMAS)).withColumn("r", c("__along") / c("p_mps"))
    w = size(DELAY_ROWS)
    d = d.withColumns({"__n": F.count("*").over(w), "__mean": F.avg("r").over(w), "__agree": F.count_if(c("r") > DELAY_S / 2).over(w)})
    delay = d.where((c("__n") == DELAY_ROWS) & (c("__agree") / DELAY_ROWS >= DELAY_SHARE) & (c("__mean") > DELAY_S)).select(key, F.lit("delay").alias("mechanism"), "t_us")

    jump = sum(((c(x) - last(x)) * (c(x) - last(x)) for x in ("bias_y", "bias_z")), (c("bias_x") - last("bias_x")) * (c("bias_x") - last("bias_x")))
    biases = fixes.where("bias_x IS NOT NULL AND bias_y IS NOT NULL AND bias_z IS NOT NULL AND t_us IS NOT NULL").withColumn("__j", F.sqrt(jump))
    jumps = biases.where(c("__j") > BIAS_JUMP).select(key, F.lit("bias_jump").alias("mechanism"), "t_us")
    raised = one_sided(gyro, GYRO_ROWS, GYRO_DEG_S, "gyro_bias").unionByName(one_sided(accel, ACCEL_ROWS, ACCEL_MPS2, "accel_bias")).unionByName(integrity).unionByName(delay).unionByName(jumps)
    return raised.groupBy(key, "mechanism").agg(F.min("t_us").alias("t_us"))
