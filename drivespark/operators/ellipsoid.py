"""The axis-aligned ellipsoid on which a sensor's samples lie, by least squares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples at least, the greatest ratio of two radii, the least pivot of a solvable system.
LEAST_SAMPLES, MOST_RATIO, LEAST_PIVOT = 40, 4.0, 1e-12


def _solved(rows: list[list[Column]], scale: Column) -> Column:
    """An array of the unknowns of n equations (each n coefficients and the right side), by elimination with the greatest
    pivot; null if a pivot isn't above ``LEAST_PIVOT`` of ``scale``. A column expression over arrays, row by row of a matrix."""
    n, kind = len(rows), "array<array<double>>"
    start = F.array(*(F.array(*(x.cast("double") for x in row)) for row in rows)).cast(kind)

    def step(m: Column, k: Column) -> Column:
        # Rows that are done stay first; of the others the one with the greatest value in column k comes next.
        left = F.slice(m, k + 1, F.lit(n))
        best = F.array_max(F.transform(left, lambda r, i: F.struct(F.abs(F.get(r, k)).alias("v"), (-i).alias("i"))))
        p = F.get(left, -best["i"])
        others = F.filter(left, lambda r, i: i != -best["i"])
        swept = lambda rs: F.transform(rs, lambda r: F.zip_with(r, p, lambda a, b: a - b * (F.get(r, k) / F.get(p, k))))
        done = F.concat(swept(F.slice(m, F.lit(1), k)), F.array(F.transform(p, lambda x: x / F.get(p, k))), swept(others))
        return F.when(best["v"] > scale * LEAST_PIVOT, done.cast(kind))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step)
    return F.transform(solved, lambda r: F.element_at(r, -1))


def normal_sums(samples: DataFrame, key: str = "sensor_id") -> DataFrame:
    """``key, n`` and the sums of products ``s_<a><b>`` of (y2, z2, x, y, z, 1, -x2) over finite samples: additive, so one
    partial aggregate a task. Values are taken relative to the key's own scale by the caller if they are very large."""
    terms = {"p": "y * y", "q": "z * z", "x": "x", "y": "y", "z": "z", "o": "1.0D", "t": "-x * x"}
    finite = " AND ".join(f"abs({v}) < double('infinity')" for v in "xyz")
    names = list(terms)
    sums = [F.sum(F.expr(f"({terms[a]}) * ({terms[b]})")).alias(f"s_{a}{b}") for i, a in enumerate(names) for b in names[i:] if a != "t"]
    return samples.where(finite).select(key, *(F.col(v).cast("double").alias(v) for v in "xyz")).groupBy(key).agg(F.count("*").alias("n"), *sums)


def ellipsoid_fit(samples: DataFrame, key: str = "sensor_id") -> DataFrame:
    """``key, n, centre_x.., radius_x.., rms, coverage`` of each sensor's samples ``x, y, z``, one row for each key that fits.

    x2 = -(a y2 + b z2 + c x + d y + e z + f) is solved by normal equations. There is no row for under 40 finite samples, a
    system without a single solution (samples on a plane or a line), a surface that is no ellipsoid, or radii that differ by
    more than four times. ``rms`` is that of the corrected samples' lengths about the mean radius; ``coverage`` is the share
    of the eight octants about the centre that hold a sample. Null and infinite samples are left out; a null key is a key.
    """
    c = F.col
    s = normal_sums(samples, key).where(c("n") >= LEAST_SAMPLES)
    names = ["p", "q", "x", "y", "z", "o"]
    cell = lambda a, b: c(f"s_{a}{b}" if ([*names, "t"].index(a) <= [*names, "t"].index(b)) else f"s_{b}{a}")
    v = _solved([[cell(a, b) for b in [*names, "t"]] for a in names], F.greatest(*(cell(a, a) for a in names)))
    d = s.select(key, "n", v.alias("v")).where("v IS NOT NULL AND NOT exists(v, e -> isnan(e) OR abs(e) = double('infinity'))")
    u = lambda i: F.get("v", i)
    d = d.where((u(0) > 0) & (u(1) > 0)).select(key, "n", u(0).alias("a"), u(1).alias("b"), (-u(2) / 2).alias("centre_x"), (-u(3) / (2 * u(0))).alias("centre_y"), (-u(4) / (2 * u(1))).alias("centre_z"), u(5).alias("f"))
    square = c("centre_x") * c("centre_x") + c("a") * c("centre_y") * c("centre_y") + c("b") * c("centre_z") * c("centre_z") - c("f")
    d = d.withColumn("r2", square).where("r2 > 0").select(key, "n", "centre_x", "centre_y", "centre_z", F.sqrt("r2").alias("radius_x"), F.sqrt(c("r2") / c("a")).alias("radius_y"), F.sqrt(c("r2") / c("b")).alias("radius_z"))
    radii = [c(f"radius_{v}") for v in "xyz"]
    d = d.where(F.greatest(*radii) <= MOST_RATIO * F.least(*radii)).withColumn("mean", (radii[0] + radii[1] + radii[2]) / 3)
    f = d.withColumnRenamed(key, "__k")
    # One row for each sensor: small beside its samples, and joined by key.
    m = samples.where(" AND ".join(f"abs({x}) < double('infinity')" for x in "xyz")).select(key, "x", "y", "z").join(f, c(key).eqNullSafe(c("__k")))
    off = [c(x) - c(f"centre_{x}") for x in "xyz"]
    length = F.sqrt(sum((F.pow(o * c("mean") / r, 2) for o, r in zip(off[1:], radii[1:], strict=True)), F.pow(off[0] * c("mean") / radii[0], 2)))
    far = sum((o * o for o in off[1:]), off[0] * off[0]) >= 1e-12
    octant = sum((F.when(o >= 0, 2**i).otherwise(0) for i, o in enumerate(off[1:], 1)), F.when(off[0] >= 0, 1).otherwise(0))
    kept = ["n", *(f"{p}_{x}" for p in ("centre", "radius") for x in "xyz")]
    out = m.withColumns({"__e": length - c("mean"), "__o": F.when(far, octant)}).groupBy(key).agg(*(F.first(x).alias(x) for x in kept), F.sqrt(F.avg(c("__e") * c("__e"))).alias("rms"), (F.size(F.collect_set("__o")) / 8.0).alias("coverage"))
    return out.select(key, *kept, "rms", "coverage")
