"""Gates, splits, rule checks and set operations on drives, sessions and registries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trip_gate(audit: DataFrame, min_samples: int = 300, min_corr: float = 0.8, stationary_ms: float = 1.0) -> DataFrame:
    """Adds ``reasons``, ``included`` (no reason) and ``eval_eligible`` (included with its own clear lag)."""
    reasons = F.array_compact(F.array(
        F.when(F.col("valid_samples") < min_samples, "too short"), F.when(F.coalesce(F.col("speed_corr"), F.lit(0.0)) < min_corr, "not the same drive"),
        F.when(F.col("max_speed_ms") < stationary_ms, "stationary"), F.when(F.col("mount_source") == "none", "mount unknown"),
    ))
    d = audit.withColumn("reasons", reasons).withColumn("included", F.size("reasons") == 0)
    return d.withColumn("eval_eligible", F.col("included") & (F.col("lag_source") == "own"))


def closest_to_target(trips: DataFrame, fraction: float = 0.12) -> DataFrame:
    """Per category with two trips or more, the eligible one whose samples are nearest that share; ties by trip id."""
    by = Window.partitionBy("category")
    d = trips.withColumns({"__all": F.sum("valid_samples").over(by), "__n": F.count("*").over(by)}).where(F.col("eval_eligible") & (F.col("__n") >= 2))
    d = d.withColumn("__r", F.row_number().over(by.orderBy(F.abs(F.col("valid_samples") - F.col("__all") * fraction), "trip_id")))
    return d.where("__r = 1").drop("__all", "__n", "__r")


def assign_splits(trips: DataFrame, test_drivers: Sequence[str], test_categories: Sequence[str], val_fraction: float = 0.12) -> DataFrame:
    """``trip_id, split``: held-out drivers or categories are test if eligible, else dropped; one trip of each other
    category is val; the rest is train. Trips that aren't included are left out."""
    d = trips.where("included")
    held = F.col("driver").isin(*test_drivers) | F.col("category").isin(*test_categories)
    test = d.where(held).select("trip_id", F.when(F.col("eval_eligible"), "test").otherwise("dropped").alias("split"))
    rest = d.where(~held)
    val = closest_to_target(rest, val_fraction).select("trip_id", F.lit(True).alias("__val"))
    return test.unionByName(rest.join(val, "trip_id", "left").select("trip_id", F.when(F.col("__val"), "val").otherwise("train").alias("split")))


def leak_checks(splits: DataFrame, trips: DataFrame, test_drivers: Sequence[str]) -> DataFrame:
    """``rule, violations``: trips in two splits, held-out drivers that are trained on, trips without a split."""
    twice = splits.groupBy("trip_id").agg(F.countDistinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    held = splits.where(F.col("split").isin("train", "val")).join(trips.where(F.col("driver").isin(*test_drivers)), "trip_id", "left_semi").agg(F.count("*").alias("v"))
    missing = trips.where("included").select("trip_id").exceptAll(splits.select("trip_id").distinct()).agg(F.count("*").alias("v"))
    rows = [("in two splits", twice), ("held-out driver trained on", held), ("no split", missing)]
    out = None
    for rule, d in rows:
        d = d.select(F.lit(rule).alias("rule"), F.col("v").alias("violations"))
        out = d if out is None else out.unionByName(d)
    return out


def merge_records(*tables: DataFrame, order: Sequence[str] = ("drive_id", "u")) -> DataFrame:
    """The union of record tables of different columns; sort within a drive when writing, not here."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.repartition(order[0]).sortWithinPartitions(*order)


def distinct_lines(lines: DataFrame, ids: str = "place_ids", one_way: str = "one_way", line_id: str = "line_id") -> DataFrame:
    """Exact duplicates go; a two-way line equals its reverse. The smallest line id stays."""
    back = F.reverse(ids)
    key = F.when(F.col(one_way) | (F.col(ids) <= back), F.col(ids)).otherwise(back)
    d = lines.withColumns({"__k": key})
    keep = d.groupBy("__k", one_way).agg(F.min(line_id).alias(line_id)).select(line_id)
    return lines.join(keep, line_id, "left_semi")


def registry_violations(models: DataFrame) -> DataFrame:
    """``model_type, rule, n``: versions that occur twice, types with more than one active row."""
    twice = models.groupBy("model_type", "version").agg(F.count("*").alias("n")).where("n > 1").groupBy("model_type").agg(F.count("*").alias("n")).select("model_type", F.lit("duplicate version").alias("rule"), "n")
    active = models.groupBy("model_type").agg(F.count_if("is_active").alias("n")).where("n > 1").select("model_type", F.lit("several active").alias("rule"), "n")
    return twice.unionByName(active)


def storage_key(model_type: Column, version: Column) -> Column:
    """``models/type/version`` of sanitised parts."""
    clean = lambda x: F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9._-]+", "-")
    return F.concat_ws("/", F.lit("models"), clean(model_type), clean(version))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The last write of each key; an incoming row wins a tie."""
    both = existing.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)), allowMissingColumns=True)
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc("__in")))
    return both.withColumn("__r", r).where("__r = 1").drop("__r", "__in")


def last_seen(seen: DataFrame, key: str, ts: str) -> DataFrame:
    return seen.groupBy(key).agg(F.min(ts).alias("registered"), F.max(ts).alias("last_seen"))


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """``children`` without the rows of deleted parents."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def ordered_telemetry(telemetry: DataFrame, session_id) -> DataFrame:
    return telemetry.where(F.col("session_id") == session_id).orderBy("t_us", "event_id")


def place_search(features: DataFrame, queries: DataFrame, tier: Column, distance: Column, limit: int = 20) -> DataFrame:
    """The best ``limit`` features of each query by tier, distance and id; ``queries`` is a small table and is broadcast only
    if Spark finds it small."""
    d = features.crossJoin(queries) if not set(features.columns) & set(queries.columns) else features.join(queries, list(set(features.columns) & set(queries.columns)))
    d = d.withColumns({"tier": tier, "dist_m": distance}).where("tier IS NOT NULL")
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "dist_m", "place_id"))).where(F.col("rank") <= limit)


def latest_active(models: DataFrame) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("model_type").orderBy(F.desc("uploaded_at"), F.desc("id")))
    return models.where("is_active").withColumn("__r", r).where("__r = 1").drop("__r")


def longest_segment(table: DataFrame, key: str = "trip_id", seg: str = "seg_id") -> DataFrame:
    """Each drive's segment with the most rows; ties to the first."""
    n = table.groupBy(key, seg).agg(F.count("*").alias("rows"))
    return n.groupBy(key).agg(F.max_by(seg, F.struct("rows", (-F.col(seg)).alias("s"))).alias(seg), F.max("rows").alias("rows"))


def spread_busiest(tiles: DataFrame, min_gap: int = 6, n: int = 6, considered: int = 1000) -> DataFrame:
    """The busiest tiles that lie at least ``min_gap`` apart, at most ``n``: a greedy pick among the top ``considered``."""
    top = tiles.select("x", "y", "lines").orderBy(F.desc("lines"), "x", "y").limit(considered).collect()
    picked: list = []
    for t in top:
        if len(picked) < n and all(max(abs(t.x - p.x), abs(t.y - p.y)) >= min_gap for p in picked):
            picked.append(t)
    return tiles.sparkSession.createDataFrame([tuple(p) for p in picked], "x long, y long, lines long")
