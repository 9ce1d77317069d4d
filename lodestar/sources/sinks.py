"""Sinks. Large results are written by Spark as folders; only metric rows (a few values) go through the driver."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.ranking import long_rows

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset and all runs here (tests), in a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{(at or tempfile.mkdtemp(prefix='lodestar-')).rstrip('/')}/files-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to a new scratch folder and read again: what follows starts from files, so Spark drops the step's shuffle files."""
    spark, at = df.sparkSession, scratch(df.sparkSession)
    was = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(DROP_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(at)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Columns in order of their names, null as empty."""
    kinds = dict(df.dtypes)
    df.select(*[F.col(f"`{c}`").cast("string").alias(c) if kinds[c] == "void" else F.col(f"`{c}`") for c in sorted(df.columns)]).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_json(value: object, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(value, indent=2, ensure_ascii=False), encoding="utf-8")


def write_metrics(wide: DataFrame, folder: str, name: str, dataset: str, run_id: str, split: str) -> DataFrame:
    """A one-row metrics frame as <name>_metrics.json and its long rows as the folder <name>_metrics.csv; returns the rows."""
    row = wide.first()
    write_json(row.asDict(recursive=True) if row else {}, f"{folder}/{name}_metrics.json")
    rows = long_rows(wide, dataset, run_id, split)
    write_csv(rows, f"{folder}/{name}_metrics.csv", mode="overwrite")
    return rows


def write_index(vectors: DataFrame, folder: str, **meta: object) -> None:
    """(pos, id, vec) rows and a metadata table of one row."""
    vectors.write.parquet(f"{folder}/vectors")
    vectors.sparkSession.createDataFrame([(json.dumps({"schema_version": 1, **meta}, sort_keys=True),)], "metadata string").write.parquet(f"{folder}/metadata")


def read_index(spark, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/vectors"), json.loads(spark.read.parquet(f"{folder}/metadata").first()["metadata"])


def retrieval_details(run: DataFrame, qrels: DataFrame, depth: int = 20) -> DataFrame:
    """(qid, results, hit@1, hit@5, hit@10): each query's first results in order with their scores."""
    marked = run.where(F.col("rank") <= depth).join(qrels.select("qid", "did", F.lit(True).alias("rel")).distinct(), ["qid", "did"], "left")
    hit = [F.coalesce(F.bool_or(F.col("rel") & (F.col("rank") <= k)), F.lit(False)).alias(f"hit@{k}") for k in (1, 5, 10)]
    return marked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "did", "score"))).alias("results"), *hit)


def history_rows(history: DataFrame, dataset: str, run_id: str) -> DataFrame:
    """History (step, epoch, values) as metric rows with split step_<n>."""
    values = [c for c in history.columns if c not in ("step", "epoch")]
    long = history.unpivot(["step"], [F.col(f"`{c}`").cast("double").alias(c) for c in values], "name", "value").where("value is not null")
    return long.select(F.lit(dataset).alias("dataset"), F.col("name").alias("metric"), F.lit(run_id).alias("run_id"), F.concat(F.lit("step_"), F.col("step").cast("string")).alias("split"), "value")


def scalars(history: DataFrame, tag: str) -> DataFrame:
    """(tag, value, step) rows of a history."""
    values = [c for c in history.columns if c not in ("step", "epoch")]
    long = history.unpivot(["step"], [F.col(f"`{c}`").cast("double").alias(c) for c in values], "name", "value").where("value is not null")
    return long.select(F.concat(F.lit(f"{tag}/"), F.col("name")).alias("tag"), "value", "step")


def run_layout(root: str, name: str) -> dict[str, str]:
    """Folders of a run: <root>/runs/<UTC time>_<slug>/{checkpoints, logs, metrics, plots}."""
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "run"
    base = Path(root) / "runs" / f"{datetime.now(timezone.utc):%Y%m%d_%H%M%S}_{slug}"
    out = {k: str(base / k) for k in ("checkpoints", "logs", "metrics", "plots")}
    for p in out.values():
        Path(p).mkdir(parents=True, exist_ok=True)
    return {"root": str(base), **out}
