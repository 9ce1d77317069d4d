"""Indexes that several queries share: each is written once a session to the shared folder, from files as they are now."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import clusters, grams, lexical
from lodestar.sources.sinks import scratch

_WRITTEN: dict[tuple, str] = {}


def state(spark: SparkSession, path: str) -> tuple:
    """Number of a table's files and a hash of their names, times and sizes; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")
    return tuple(files.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first())


def written(spark: SparkSession, table: str, kind: str, write: Callable[[DataFrame, str], None]) -> str:
    """The folder of an index of a table: written by `write` unless this session has one of the same files. A failed write leaves none."""
    key = (spark.sparkContext.applicationId, kind, table, state(spark, table))
    if key not in _WRITTEN:
        path = scratch(spark)
        write(spark.read.parquet(table), path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def bm25(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The documents' postings."""
    return lexical.Index.load(spark, written(spark, f"{sf_dir}/documents.parquet", "bm25", lambda docs, path: lexical.build(docs, "doc_id", "text", path=path)))


def gram_index(spark: SparkSession, sf_dir: str) -> grams.GramIndex:
    """The documents' q-grams."""
    return grams.GramIndex.load(spark, written(spark, f"{sf_dir}/documents.parquet", "grams", lambda docs, path: grams.build(docs, "doc_id", "text").save(path)))


def vector_lists(spark: SparkSession, sf_dir: str) -> clusters.Lists:
    """The embeddings' inverted file, with min(100, a tenth of the rows) lists."""

    def write(rows: DataFrame, path: str) -> None:
        vectors = rows.select("vec_id", F.col("embedding").alias("vec"))
        clusters.build(vectors, lists=max(1, min(100, vectors.where("size(vec) > 0").count() // 10))).save(path)

    return clusters.Lists.load(spark, written(spark, f"{sf_dir}/embeddings.parquet", "ivf", write))
