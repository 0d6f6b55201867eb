"""The parts of lines that lie in a box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clip_to_box(lines: DataFrame, south: Column | float, west: Column | float, north: Column | float, east: Column | float, key: str = "line_id") -> DataFrame:
    """``key, piece, polyline``: the parts of flat [lat, lon, ...] polylines inside a box (its edges included).

    A line that leaves and comes back has a piece for each stay, numbered from 0 along it. Each straight part is clipped by
    its parameter (Liang-Barsky); a piece goes on as long as a part begins where the one before ended. The bounds may be
    columns of ``lines``. Lines with a null key or null values, under two points, or wholly outside have no row; rows that
    repeat a key are one line with the least polyline.
    """
    c = F.col
    bound = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    box = [bound(x).cast("double").alias(n) for x, n in zip((south, west, north, east), ("s", "w", "n", "e"), strict=True)]
    d = lines.where(f"{key} IS NOT NULL AND size(polyline) >= 4 AND NOT exists(polyline, v -> v IS NULL OR isnan(v))").select(key, "polyline", *box)
    d = d.groupBy(key).agg(F.min(F.struct("polyline", "s", "w", "n", "e")).alias("l")).select(key, "l.*")
    at = lambda i: F.element_at("polyline", i)
    parts = F.transform(F.sequence(F.lit(1), F.size("polyline") - 3, F.lit(2)), lambda i: F.struct(at(i).alias("y"), at(i + 1).alias("x"), (at(i + 2) - at(i)).alias("dy"), (at(i + 3) - at(i + 1)).alias("dx")))
    d = d.select(key, "s", "w", "n", "e", F.posexplode(parts).alias("k", "p")).select(key, "s", "w", "n", "e", "k", "p.*")
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-c("dx"), c("x") - c("w")), (c("dx"), c("e") - c("x")), (-c("dy"), c("y") - c("s")), (c("dy"), c("n") - c("y"))):
        r = F.try_divide(q, p)
        lo, hi, ok = F.when(p < 0, F.greatest(lo, r)).otherwise(lo), F.when(p > 0, F.least(hi, r)).otherwise(hi), ok & ((p != 0) | (q >= 0))
    d = d.withColumns({"t0": lo, "t1": hi}).where(ok & (c("t0") <= c("t1")))
    by = Window.partitionBy(key).orderBy("k")
    goes_on = (c("t0") == 0) & (F.lag("k").over(by) == c("k") - 1) & (F.lag("t1").over(by) == 1)
    d = d.withColumn("fresh", ~F.coalesce(goes_on, F.lit(False))).withColumn("piece", F.sum(c("fresh").cast("int")).over(by) - 1)
    point = lambda t: F.array(c("y") + t * c("dy"), c("x") + t * c("dx"))
    points = F.when(c("fresh"), F.concat(point(c("t0")), point(c("t1")))).otherwise(point(c("t1")))
    return d.groupBy(key, "piece").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", points.alias("v")))), lambda x: x["v"])).alias("polyline"))
