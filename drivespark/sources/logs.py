"""Readers of drive logs, map exports and manifests. Fixed schemas; what can't be read is kept as rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One record of any type: t = m header, i IMU, g fix, x lost, s receiver, r truth, k marker, a model.
RECORD = (
    "t string, u long, a array<double>, g array<double>, m array<double>, p double, c double, lat double, lon double, acc double, alt double, spd double, sac double, brg double, bac double, vac double, sat int, mock boolean, "
    "raw int, rm int, adr int, vis int, used int, hdg double, l string, sig double, vib double, mq double, gt string, it string, lms double, sid string, start long, dev string, veh string, mount string"
)


def read_drive_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON-lines logs, plain or gzipped; the file is the drive. A line that isn't JSON, has no clock
    or lacks what its type requires is a reject; the rest of its log still counts."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("drive_id"), "value").where(F.trim("value") != "")
    d = lines.withColumn("r", F.from_json("value", RECORD, {"mode": "PERMISSIVE"}))
    r = F.col("r")
    # Receiver records carry arrays of mixed type: kept as text beside the typed columns.
    satellites = F.get_json_object("value", "$.sv")
    three = lambda c: (F.size(c) == 3) & ~F.exists(c, lambda x: x.isNull())
    whole = (
        F.when(r.t == "i", three(r.a) & three(r.g)).when(r.t == "g", r.lat.isNotNull() & r.lon.isNotNull() & r.acc.isNotNull()).when(r.t == "r", r.lat.isNotNull() & r.lon.isNotNull()).when(r.t == "k", r.l.isNotNull())
        .when(r.t == "s", satellites.isNotNull()).when(r.t == "a", (r.spd.isNotNull() & r.sig.isNotNull()) | (r.vib.isNotNull() & r.mq.isNotNull()) | r.gt.isNotNull() | r["it"].isNotNull()).when(r.t.isin("m", "x"), F.lit(True))
    )
    d = d.withColumn("ok", F.coalesce(whole & r.u.isNotNull(), F.lit(False)))
    return d.where("ok").select("drive_id", "r.*", satellites.alias("satellites")), d.where("NOT ok").select("drive_id", "value")


def read_osm_elements(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of Overpass JSON documents; nodes without a finite position are left out."""
    schema = "elements array<struct<type: string, id: long, lat: double, lon: double, nodes: array<long>, tags: map<string, string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    nodes = e.where((F.col("type") == "node") & F.col("id").isNotNull() & finite("lat") & finite("lon")).select("id", "lat", "lon")
    return nodes, e.where("type = 'way'").select("id", F.col("nodes").alias("refs"), F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"))


def verify_manifest(spark: SparkSession, manifest: DataFrame, data_path: str) -> DataFrame:
    """``path, status`` of expected files (``path, sha256, size``): ok, missing, wrong size or wrong content. Paths are
    compared by their ends below ``data_path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(data_path)
    root = data_path.rstrip("/") + "/"
    found = files.select(F.element_at(F.split("path", root, 2), -1).alias("path"), F.col("length"), F.sha2("content", 256).alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("length") != F.col("size"), "wrong size").when(F.col("found") != F.lower("sha256"), "wrong content").otherwise("ok")
    return manifest.join(found, "path", "left").select("path", status.alias("status"))
