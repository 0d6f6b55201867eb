"""What the training-data operators share: reading, staging in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of a word, as the contracts of the queries have it.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A table of at most this many rows and (estimated) bytes may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 250_000, 24_000_000
#: Bytes of an Arrow batch between Spark and Python; by rows alone (10,000) a batch of texts has no bound.
BATCH_BYTES = 2_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Where none is named, a local session gets one of its own; on a cluster that is an error, as no machine sees another's.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and lost executors cost a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``, whatever the rows' size: an executor and its Python
    workers keep the memory of the largest batch that they ever held. One longer row is a batch of its own."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that ``staged`` wrote in this application; for callers that have written what they need."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _width(value, kind):
    """Bytes of a column's value, about: strings by their length, also those within arrays and structs."""
    name, inner = kind.typeName(), getattr(kind, "elementType", None)
    if name in ("string", "binary"):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if name == "struct":
        return reduce(add, (_width(value[f.name], f.dataType) for f in kind), F.lit(16))
    if name == "array" and re.search("string|binary", inner.simpleString()):
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda held, x: held + _width(x, inner)), F.lit(16))
    if name == "array":
        return F.greatest(F.size(value), F.lit(0)) * 8 * (1 + len(getattr(inner, "fields", ()))) + 16
    return F.lit(16)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it holds at most ``rows`` rows and ``size`` bytes, else as it is (shuffled, skew joins split).

    ``df`` is measured here, so it should be a staged table.
    """
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(reduce(add, (_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_ascii(text):
    """A-Z lower-cased, all else unchanged; null gives the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def lower_words(text):
    """The words of ``text`` and empty strings between them, A-Z lower-cased; null gives none. White space is made one
    character first: splitting at a single one needs no regular expression."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + "\t\n\x0b\x0c\r", LOWER + "     "), " ")


def as_text(value):
    return F.coalesce(value.cast("string"), F.lit(""))


def row_key(*cols):
    """A 64-bit key of a row that is never null; rows that are equal in ``cols`` share it."""
    return F.xxhash64(*cols)
