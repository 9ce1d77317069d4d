"""Retrieval evaluated over several collections at once: rows of every data set, their average, and the details behind them."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import dense, lexical, models, ranking
from lodestar.sources.readers import fingerprint
from lodestar.sources.sinks import kept, retrieval_details

#: (corpus(did, text), queries(qid, text), depth) -> run(qid, did, score, rank).
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]
AVERAGE = "average"


def bm25(corpus: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
    return lexical.search(lexical.build(corpus, "did", "text"), queries, "qid", "text", depth)


def encoded(encoder: str, metric: str = "ip") -> Retriever:
    """A retriever by vectors of a registered encoder; ids of any type go along as hashes and come back by a join."""

    def retrieve(corpus: DataFrame, queries: DataFrame, depth: int) -> DataFrame:
        d, q = (kept(models.encode(x, "text", encoder).select(F.xxhash64(k).alias("vec_id"), "vec", k)) for x, k in ((corpus, "did"), (queries, "qid")))
        found = dense.search(d, q, depth, metric, skip_self=False).withColumnsRenamed({"qid": "q", "did": "d"})
        return found.join(q.select(F.col("vec_id").alias("q"), "qid"), "q").join(d.select(F.col("vec_id").alias("d"), "did"), "d").select("qid", "did", "score", "rank")

    return retrieve


def runs(collections: dict[str, tuple[DataFrame, DataFrame, DataFrame]], retrieve: Retriever, depth: int = 20) -> tuple[DataFrame, DataFrame]:
    """(dataset, qid, did, score, rank) and (dataset, qid, did) of all collections (corpus, queries, qrels); a collection's counts are its own.

    A corpus is read from its lines once and stored, since retrievers read it several times.
    """
    found, judged = [], []
    for name, (corpus, queries, qrels) in collections.items():
        found.append(retrieve(kept(corpus), queries, depth).select(F.lit(name).alias("dataset"), "qid", "did", "score", "rank"))
        judged.append(qrels.select(F.lit(name).alias("dataset"), "qid", "did"))
    return kept(reduce(DataFrame.unionByName, found)), reduce(DataFrame.unionByName, judged)


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("qid", F.struct("dataset", "qid"))


def report(run: DataFrame, qrels: DataFrame, run_id: str, split: str = "test", encoder: dict | None = None) -> DataFrame:
    """(dataset, metric, k, value, n, run_id, split, encoder_fingerprint): means over the queries with judgements of each data set, and
    their mean over the data sets as data set `average`, where n counts data sets (R7, A8)."""
    per = ranking.per_query(_keyed(run), _keyed(qrels))
    long = per.unpivot([F.col("qid.dataset").alias("dataset")], [F.col(f"`{m}`") for m in ranking.metric_names()], "name", "value")
    means = long.groupBy("dataset", "name").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    average = means.groupBy("name").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(F.lit(AVERAGE).alias("dataset"), "name", "value", "n")
    metric, k = ranking.metric_parts(F.col("name"))
    rows = means.unionByName(average)
    return rows.select("dataset", metric.alias("metric"), k.alias("k"), F.round("value", 6).alias("value"), "n", F.lit(run_id).alias("run_id"), F.lit(split).alias("split"), F.lit(fingerprint(encoder or {})).alias("encoder_fingerprint"))


def details(run: DataFrame, qrels: DataFrame, depth: int = 20) -> DataFrame:
    """(dataset, qid, results, hit@1, hit@5, hit@10) of every query that found something."""
    rows = retrieval_details(_keyed(run), _keyed(qrels), depth)
    return rows.select("qid.dataset", F.col("qid.qid").alias("qid"), *[F.col(f"`{c}`") for c in rows.columns if c != "qid"])


def summary(rows: DataFrame) -> dict:
    """The report as one nested mapping, data set by data set; a few dozen values."""
    out: dict = {}
    for r in rows.collect():
        name = r.metric if r.k is None else f"{r.metric}@{r.k}"
        out.setdefault(r.dataset, {})[name] = r.value
    return json.loads(json.dumps(out, sort_keys=True))
