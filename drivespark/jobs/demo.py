"""Drive data derived from the given tables by arithmetic that SQL shares, so every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import read_table


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One telemetry row for each event; the user is the session."""
    e = read_table(spark, sf_dir, "events").withColumn("k", F.regexp_extract("props", r"-?[0-9]+", 0).try_cast("int"))
    return e.select(
        "event_id", F.col("user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_type",
        F.col("value").alias("speed"), "k", (F.lit(12.0) + F.col("k") / 1000.0).alias("lat"), (F.lit(77.0) + F.col("event_id") % 100 / 1000.0).alias("lon"),
        (F.col("event_id") * 37 % 360).cast("double").alias("heading"), (F.lit(1.0) - F.col("k") / 100.0).alias("confidence"),
        F.when(F.col("event_type") == "error", "DEAD_RECKONING").otherwise("GNSS_LOCKED").alias("mode"),
    )


TEL = r"""tel AS (
  SELECT event_id, user_id AS session_id, epoch_us(ts) AS t_us, event_type, value AS speed, k, 12.0::DOUBLE + k / 1000.0::DOUBLE AS lat,
         77.0::DOUBLE + (event_id % 100) / 1000.0::DOUBLE AS lon, ((event_id * 37) % 360)::DOUBLE AS heading, 1.0::DOUBLE - k / 100.0::DOUBLE AS confidence,
         CASE WHEN event_type = 'error' THEN 'DEAD_RECKONING' ELSE 'GNSS_LOCKED' END AS mode
  FROM (SELECT *, regexp_extract(props, '-?[0-9]+')::INT AS k FROM events))"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 Hz rows of a drive for each supplier's order lines: ``trip_id, seg_id, i, t``, six axes, speeds."""
    li = read_table(spark, sf_dir, "lineitem")
    num = lambda c: F.col(c).cast("double")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    r = li.select("l_suppkey", "l_orderkey", "l_linenumber", num("l_quantity").alias("q"), num("l_discount").alias("d"), num("l_tax").alias("x"), num("l_extendedprice").alias("p"), (F.row_number().over(w) - 1).alias("i"))
    speed = F.col("p") / 5000.0
    return r.select(
        F.col("l_suppkey").alias("trip_id"), F.floor(F.col("i") / 100).alias("seg_id"), "i", (F.col("i") / 10.0).alias("t"),
        (F.col("q") / 10.0 - 2.5).alias("ax"), (F.col("d") * 20.0 - 1.0).alias("ay"), (F.lit(9.81) + F.col("x") * 10.0 - 0.4).alias("az"),
        (F.col("d") - 0.05).alias("gx"), (F.col("x") - 0.04).alias("gy"), (F.col("l_linenumber") / 100.0 - 0.03).alias("gz"),
        speed.alias("speed_ms"), (speed + F.col("d") * 10.0 - 0.5).alias("pred_ms"), (F.col("l_orderkey") % 360).cast("double").alias("heading_deg"),
    )


CHAN = """chan AS (
  SELECT l_suppkey AS trip_id, i // 100 AS seg_id, i, i / 10.0::DOUBLE AS t, q / 10.0::DOUBLE - 2.5::DOUBLE AS ax, d * 20.0::DOUBLE - 1.0::DOUBLE AS ay,
         9.81::DOUBLE + x * 10.0::DOUBLE - 0.4::DOUBLE AS az, d - 0.05::DOUBLE AS gx, x - 0.04::DOUBLE AS gy, l_linenumber / 100.0::DOUBLE - 0.03::DOUBLE AS gz,
         p / 5000.0::DOUBLE AS speed_ms, p / 5000.0::DOUBLE + d * 10.0::DOUBLE - 0.5::DOUBLE AS pred_ms, (l_orderkey % 360)::DOUBLE AS heading_deg
  FROM (SELECT *, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS d, l_tax::DOUBLE AS x, l_extendedprice::DOUBLE AS p,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS i FROM lineitem))"""


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A road network with a node for each part, 50 to a row: an edge to the next part of the row and one to the next row's."""
    part = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    at = lambda k: (F.lit(12.0) + F.floor(k / 50) / 1000.0, F.lit(77.0) + k % 50 / 1000.0)
    e = part.withColumn("step", F.explode(F.array(F.lit(1), F.lit(50)))).where("step = 50 OR k % 50 < 49").withColumn("to", F.col("k") + F.col("step"))
    e = e.join(part.select(F.col("k").alias("to")), "to")
    row_wise = F.col("step") == 1
    return e.select(
        (F.col("k") * 2 + F.when(row_wise, 0).otherwise(1)).alias("edge_id"), F.col("k").alias("from_node"), F.col("to").alias("to_node"), F.array(*at(F.col("k")), *at(F.col("to"))).alias("polyline"),
        (F.lit(100.0) + F.col("z")).alias("length_m"), (F.col("z") % 5 == 0).alias("one_way"), F.when(F.col("z") % 3 == 0, 6.0).alias("max_speed_mps"), F.when(F.col("z") % 11 == 0, F.array(F.lit("twoWheelers"))).otherwise(F.array(F.lit("cars"), F.lit("twoWheelers"))).alias("access"),
        (F.col("z") % 7 == 0).alias("tunnel"), F.when(row_wise, F.concat(F.lit("row "), F.floor(F.col("k") / 50).cast("string"))).alias("name"), F.when(row_wise, "primary").otherwise("residential").alias("class"),
    )


ROADS = """part2 AS (SELECT p_partkey AS k, p_size AS z FROM part),
road AS (
  SELECT a.k * 2 + CASE WHEN s = 1 THEN 0 ELSE 1 END AS edge_id, a.k AS from_node, b.k AS to_node, 12.0::DOUBLE + a.k // 50 / 1000.0::DOUBLE AS a_lat, 77.0::DOUBLE + a.k % 50 / 1000.0::DOUBLE AS a_lon,
         12.0::DOUBLE + b.k // 50 / 1000.0::DOUBLE AS b_lat, 77.0::DOUBLE + b.k % 50 / 1000.0::DOUBLE AS b_lon, 100.0::DOUBLE + a.z AS length_m, a.z % 5 = 0 AS one_way, CASE WHEN a.z % 3 = 0 THEN 6.0::DOUBLE END AS max_speed_mps,
         a.z % 11 <> 0 AS cars, a.z % 7 = 0 AS tunnel, CASE WHEN s = 1 THEN 'row ' || (a.k // 50) END AS name, CASE WHEN s = 1 THEN 'primary' ELSE 'residential' END AS class
  FROM part2 a CROSS JOIN (VALUES (1), (50)) v(s) JOIN part2 b ON b.k = a.k + s WHERE s = 50 OR a.k % 50 < 49)"""


def road_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drive for each customer along a row of ``roads``, with a position for each of the customer's orders."""
    rows = read_table(spark, sf_dir, "part").agg((F.floor(F.max("p_partkey") / 50) + 1).alias("rows"))
    o, k, u = read_table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    d = o.select(k, u, n.alias("seq")).crossJoin(F.broadcast(rows))  # one row
    return d.select(
        u.alias("drive_id"), "seq", (F.lit(12.0) + u % F.col("rows") / 1000.0 + (k * 31 % 17 - 8) * 0.00002).alias("lat"), (F.lit(77.0) + (u % 20 + F.col("seq") * 0.4) / 1000.0 + (k * 7 % 11 - 5) * 0.00001).alias("lon"),
        (F.lit(4.0) + k % 12).alias("sigma_m"), F.when(k % 6 > 0, F.lit(90.0) + k % 41 - 20).alias("heading_deg"), (F.lit(1.0) + k % 14).cast("double").alias("speed_mps"),
    )


ROAD_POSITIONS = """pos AS (
  SELECT o_custkey AS drive_id, seq, 12.0::DOUBLE + o_custkey % rows / 1000.0::DOUBLE + (o_orderkey * 31 % 17 - 8) * 0.00002::DOUBLE AS lat, 77.0::DOUBLE + (o_custkey % 20 + seq * 0.4::DOUBLE) / 1000.0::DOUBLE + (o_orderkey * 7 % 11 - 5) * 0.00001::DOUBLE AS lon,
         4.0::DOUBLE + o_orderkey % 12 AS sigma_m, CASE WHEN o_orderkey % 6 > 0 THEN 90.0::DOUBLE + o_orderkey % 41 - 20 END AS heading_deg, (1.0::DOUBLE + o_orderkey % 14) AS speed_mps
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders) o CROSS JOIN (SELECT max(p_partkey) // 50 + 1 AS rows FROM part))"""
