"""Session builder with the settings every job of this library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "drivespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow switched on; ``conf`` adds or overrides settings."""
    builder = SparkSession.builder.appName(app).config(map={**SETTINGS, **conf})
    if master:
        builder = builder.master(master)
    return builder.getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str):
    """One of the given tables, with the columns that the file has."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
