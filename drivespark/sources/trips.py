"""Recorded trips: phone and vehicle CSV files, their pairing, and the cleaned data set as Parquet."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tags import parse_wallclock

# How the recorders' headers begin (units after it are damaged in the files).
PHONE = {
    "gps_lat": "GPS LATITUDE", "gps_lon": "GPS LONGITUDE", "gps_alt": "GPS ALTITUDE", "gps_speed_ms": "GPS SPEED", "gps_acc_m": "GPS ACCURACY", "gps_heading": "GPS ORIENTATION",
    "gps_sats": "GPS SATELLITES", "t_ms": "TIME SINCE START", "wall": "DATE", "acc_x": "ACCELEROMETER X", "acc_y": "ACCELEROMETER Y", "acc_z": "ACCELEROMETER Z",
    "grav_x": "GRAVITY X", "grav_y": "GRAVITY Y", "grav_z": "GRAVITY Z", "gyro_yaw_col": "GYROSCOPE YAW", "gyro_pitch_col": "GYROSCOPE PITCH", "gyro_roll_col": "GYROSCOPE ROLL",
    "mag_x": "MAGNETIC FIELD X", "mag_y": "MAGNETIC FIELD Y", "mag_z": "MAGNETIC FIELD Z",
}
VEHICLE = {
    "v_time_s": "TIME SINCE START OF DAY", "v_lat": "LATITUDE", "v_lon": "LONGITUDE", "v_speed_kmh": "VELOCITY", "v_heading": "HEADING", "v_height_km": "HEIGHT", "v_yaw_dps": "YAW RATE",
    "v_long_g": "INDICATED LONGITUDINAL", "v_lat_g": "INDICATED LATERAL", "v_ind_speed_kmh": "INDICATED VEHICLE SPEED", "v_steer_deg": "STEERING ANGLE",
    "v_wheel_fl": "WHEEL SPEED FRONT LEFT", "v_wheel_fr": "WHEEL SPEED FRONT RIGHT", "v_wheel_rl": "WHEEL SPEED REAR LEFT", "v_wheel_rr": "WHEEL SPEED REAR RIGHT", "v_sats": "NO OF GPS SATELLITES",
}


def canonical(df: DataFrame, table: dict[str, str]) -> DataFrame:
    """Columns by the beginning of their header, as numbers (null where there is none); ``wall`` gives second and day.

    The first header that fits counts. A count of satellites such as "18 / 19" is its first number. Other columns go,
    but for those that begin with an underscore.
    """
    made = [F.col(f"`{c}`") for c in df.columns if c.startswith("_")]
    for name, start in table.items():
        hit = next((c for c in df.columns if c.strip().upper().startswith(start)), None)
        if hit is None:
            continue
        value = F.col("`" + hit.replace("`", "``") + "`").cast("string")
        if name == "wall":
            clock = parse_wallclock(value)
            made += [clock.sec_of_day.alias("wall_s"), clock.yyyymmdd.alias("wall_day")]
        else:
            made.append(F.trim(F.split(value, "/")[0] if name.endswith("sats") else value).try_cast("double").alias(name))
    return df.select(*made)


def read_trip_csvs(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Trips of one ``kind`` ("phone" or "vehicle") with ``_path`` and ``_row``, the line's number by its place in the file.

    Files may name their columns differently only in what follows the known beginnings.
    """
    raw = spark.read.csv(paths, header=True, encoding="ISO-8859-1", inferSchema=False).withColumns({"_path": F.col("_metadata.file_path"), "_row": F.monotonically_increasing_id()})
    return canonical(raw, PHONE if kind == "phone" else VEHICLE)


def discover_trip_pairs(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(pairs, errors) of file paths: each ``S-*`` with the one ``V-*`` of its folder; ``n`` partners are an error otherwise.

    The folder below the last but one of a trip is its category, with the driver in brackets: ``Vta (Driver A)``.
    """
    name, folder = F.element_at(F.split(path, "/"), -1), F.regexp_replace(path, "/[^/]*$", "")
    f = files.select(F.col(path).alias("path"), name.alias("name"), folder.alias("folder")).where(F.upper("name").endswith(".CSV"))
    vehicle = f.where(F.upper("name").startswith("V-")).groupBy("folder").agg(F.count("*").alias("n"), F.min("path").alias("v_path"))
    d = f.where(F.upper("name").startswith("S-")).join(vehicle, "folder", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    parts = F.split("folder", "/")
    below = F.regexp_like(F.element_at(parts, -1), F.lit(r"\(Driver [A-Z]\)\s*$"))
    group = F.when(below | (F.size(parts) < 2), F.element_at(parts, -1)).otherwise(F.try_element_at(parts, F.lit(-2)))
    trip = F.regexp_replace(F.when(below, F.regexp_replace(F.substr("name", F.lit(3)), r"\.[^.]*$", "")).otherwise(F.element_at(parts, -1)), "^V-", "")
    driver = F.regexp_extract(group, r"\(Driver ([A-Z])\)\s*$", 1)
    pairs = d.where("n = 1").select(trip.alias("trip_id"), F.trim(F.regexp_replace(group, r"\(Driver [A-Z]\)\s*$", "")).alias("category"), F.when(driver == "", "?").otherwise(driver).alias("driver"), F.col("path").alias("s_path"), "v_path")
    return pairs, d.where("n <> 1").select("path", "n")


def write_dataset(df: DataFrame, path: str, keys: list[str], split: str | None = None) -> None:
    """Parquet with the rows of a trip together and in order of the keys; a folder for each split."""
    d = df.repartition(*keys[:1]).sortWithinPartitions(*keys)
    (d.write.partitionBy(split) if split else d.write).mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def outage_csv_report(outages: DataFrame, keys: tuple[str, ...] = ("drive",), order: str = "start_us", target_pct: float = 10.0) -> DataFrame:
    """The evidence table of outages as text: number, seconds, metres and per cent with fixed decimals, blanks for nulls."""
    from pyspark.sql import Window

    text = lambda x, n: F.coalesce(F.format_string(f"%.{n}f", x), F.lit(""))
    drift = F.when(F.col("distance_m") > 0, F.col("error_m") * 100 / F.col("distance_m"))
    shown = lambda x, n: F.when(x.isNull(), "").otherwise(text(x, n))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return outages.select(*keys, number.alias("outage"), shown(F.col("duration_s").cast("double"), 1).alias("duration_s"), shown(F.col("distance_m"), 1).alias("distance_m"), shown(F.col("error_m"), 1).alias("error_m"), shown(drift, 2).alias("drift_pct"), F.when(drift.isNull(), "").when(drift < target_pct, "yes").otherwise("no").alias("met_target"))
