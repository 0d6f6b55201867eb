"""Telemetry streams. Each transformation takes and returns a (streaming or batch) DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sensing import failed_telemetry_fields

EVENT = "session_id string, timestamp timestamp, latitude double, longitude double, altitude double, speed double, heading double, confidence double, gnss_available boolean, mode string"


def read_telemetry(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Lines of a folder of JSON files, as they arrive: ``value``."""
    return spark.readStream.options(**options).text(path)


def parse_telemetry(lines: DataFrame) -> DataFrame:
    """Typed rows with ``failed``, the names of the fields out of range; a line that can't be read has ``failed = [json]``."""
    d = lines.select(F.from_json("value", EVENT).alias("e"))
    whole = F.col("e.session_id").isNotNull() & F.col("e.timestamp").isNotNull()
    failed = failed_telemetry_fields(*(F.col(f"e.{c}") for c in ("latitude", "longitude", "speed", "heading", "confidence")))
    return d.select("e.*", F.when(F.coalesce(whole, F.lit(False)), failed).otherwise(F.array(F.lit("json"))).alias("failed"))


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("failed") == 0).drop("failed")


def deduplicated(stream: DataFrame, keys: Sequence[str] = ("session_id", "timestamp"), ts: str = "timestamp", delay: str = "10 seconds") -> DataFrame:
    """One row for each key within the watermark; rows later than ``delay`` are dropped by the state that ends."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def live_session_metrics(stream: DataFrame, size: str = "60 seconds", slide: str = "10 seconds", ts: str = "timestamp") -> DataFrame:
    """Per session and sliding window: records, mean confidence, share of dead reckoning. Needs a watermark upstream."""
    return stream.groupBy(F.window(ts, size, slide), "session_id").agg(F.count("*").alias("records"), F.avg("confidence").alias("confidence"), F.avg((F.col("mode") == "DEAD_RECKONING").cast("double")).alias("dr_share"))


def session_windows(stream: DataFrame, gap: str = "30 seconds", ts: str = "timestamp") -> DataFrame:
    """Sessions that end when a device is silent for ``gap``."""
    return stream.groupBy(F.session_window(ts, gap), "session_id").agg(F.count("*").alias("records"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def write_and_publish(stream: DataFrame, table_path: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None, **trigger):
    """Appends each batch under the query's id and its batch id, then publishes the same rows: a batch that is replayed
    overwrites itself, so a failed publish neither loses nor repeats rows. The query's id is its checkpoint's, so another
    query (or a new checkpoint) that writes to the same table overwrites nothing."""
    known: list[str] = []

    def query_id(spark: SparkSession) -> str:
        if not known:
            known.append(spark.read.json(f"{checkpoint}/metadata").first()["id"])
        return known[0]

    def one(batch: DataFrame, batch_id: int) -> None:
        target = f"{table_path}/query_id={query_id(batch.sparkSession)}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        if publish is not None:
            publish(batch.sparkSession.read.parquet(target), batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
