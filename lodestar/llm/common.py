"""What the operators share: settings, the shared scratch folder, small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch handed to Python, so that very long texts cannot fill a worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of the plans built from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of this session's own where it is unset and everything runs on this machine (tests)."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.conf.get("lodestar.scratch.dir", "")
        if not at:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="lodestar-")
            spark.conf.set("lodestar.scratch.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later steps start from files, so a lost executor costs no recomputation.

    Spark drops the step's shuffle files when it is written, since nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    was = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(divisor)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores put before it as it takes to be no column of df, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without_columns(df: DataFrame, made: list[str]) -> DataFrame:
    """df without columns of those names, in any case."""
    low = {c.lower() for c in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
