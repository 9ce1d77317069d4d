"""In-batch evaluation: batches, similarities within a batch, ranks of the own partner, losses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vector import cosine, dot, unit


def batches(rows: DataFrame, pos: str, size: int, least: int = 2) -> DataFrame:
    """rows with batch_id and slot from the order of `pos` (0, 1, ... without gaps); batches under `least` rows go."""
    marked = rows.withColumn("batch_id", F.floor(F.col(pos) / size).cast("long")).withColumn("slot", F.pmod(F.col(pos), F.lit(size)).cast("int"))
    big = marked.groupBy("batch_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("batch_id")
    return marked.join(big, "batch_id", "left_semi")


def similarities(batched: DataFrame, query: str, document: str, extra: str | None = None) -> DataFrame:
    """(batch_id, q, d, sim): every query of a batch with every document of it, sides bounded by the batch's size.

    extra: a further vector column whose vectors (hard negatives) join the batch's pool as documents -1 - slot.
    """
    q = batched.select("batch_id", F.col("slot").alias("q"), F.col(query).alias("_q"))
    d = batched.select("batch_id", F.col("slot").alias("d"), F.col(document).alias("_d"))
    if extra:
        d = d.union(batched.where(F.col(extra).isNotNull()).select("batch_id", (-1 - F.col("slot")).alias("d"), F.col(extra)))
    return q.join(d, "batch_id").select("batch_id", "q", "d", F.round(dot(F.col("_q"), F.col("_d")), 6).alias("sim"))


def partner_ranks(sims: DataFrame, tie: str = "row_number") -> DataFrame:
    """(batch_id, q, rank, n): rank of document q for query q. tie: row_number (ties by document) or rank (optimistic)."""
    own = Window.partitionBy("batch_id", "q")
    if tie == "row_number":
        place = F.row_number().over(own.orderBy(F.desc("sim"), F.asc("d")))
    elif tie == "rank":
        place = F.rank().over(own.orderBy(F.desc("sim")))
    else:
        raise ValueError(f"unknown tie rule {tie}")
    return sims.withColumn("rank", place).withColumn("n", F.count("*").over(own)).where("q = d").select("batch_id", "q", "rank", "n")


def rank_metrics(rank: Column) -> list[Column]:
    return [
        (F.lit(1.0) / rank).alias("mrr"),
        F.when(rank <= 10, F.lit(1.0) / F.log2(rank + F.lit(1.0))).otherwise(0.0).alias("ndcg@10"),
        *[(rank <= k).cast("double").alias(f"recall@{k}") for k in (1, 5, 10)],
    ]


def mean_of_batch_means(ranks: DataFrame) -> DataFrame:
    """One row; every batch weighs the same, a short last one too."""
    names = ["mrr", "ndcg@10", "recall@1", "recall@5", "recall@10"]
    per = ranks.select("batch_id", *rank_metrics(F.col("rank"))).groupBy("batch_id").agg(*[F.avg(f"`{m}`").alias(m) for m in names])
    return per.agg(*[F.round(F.avg(f"`{m}`"), 6).alias(m) for m in names], F.count("*").alias("n_batches"))


def percentiles(ranks: DataFrame) -> DataFrame:
    return ranks.select("batch_id", "q", "rank", F.round(F.col("rank") * 100.0 / F.col("n"), 6).alias("rank_percentile"))


def in_batch_softmax_loss(sims: DataFrame, scale: float) -> DataFrame:
    """Mean over queries of cross entropy against the own document, of scale * sim (InfoNCE: 1 / temperature; MNR: its scale)."""
    s = F.col("sim") * F.lit(float(scale))
    per = sims.groupBy("batch_id", "q").agg(F.max(s).alias("top"), F.max(F.when(F.col("q") == F.col("d"), s)).alias("own"))
    z = sims.join(per, ["batch_id", "q"]).groupBy("batch_id", "q").agg(F.first("top").alias("top"), F.first("own").alias("own"), F.sum(F.exp(s - F.col("top"))).alias("z"))
    loss = z.select("batch_id", (F.log("z") + F.col("top") - F.col("own")).alias("loss"))
    return loss.groupBy("batch_id").agg(F.round(F.avg("loss"), 6).alias("loss"))


def two_way_loss(rows: DataFrame, query: str, positive: str, negative: str, temperature: float = 0.02) -> Column:
    """Softmax over the own positive and the own negative only."""
    p, n = (dot(unit(F.col(query)), unit(F.col(c))) / F.lit(temperature) for c in (positive, negative))
    top = F.greatest(p, n)
    return F.log(F.exp(p - top) + F.exp(n - top)) + top - p


def triplet_loss(query: str, positive: str, negative: str, margin: float = 0.5) -> Column:
    return F.greatest(F.lit(margin) - cosine(F.col(query), F.col(positive)) + cosine(F.col(query), F.col(negative)), F.lit(0.0))


def self_similarity_kl(student: DataFrame, teacher: DataFrame, temperature: float) -> DataFrame:
    """(batch_id, loss): KL of teacher to student softmax of similarities, batch mean, times temperature squared."""

    def logs(sims: DataFrame, name: str) -> DataFrame:
        s = F.col("sim") / F.lit(float(temperature))
        top = sims.groupBy("batch_id", "q").agg(F.max(s).alias("top"))
        z = sims.join(top, ["batch_id", "q"]).groupBy("batch_id", "q").agg((F.log(F.sum(F.exp(s - F.col("top")))) + F.first("top")).alias("z"))
        return sims.join(z, ["batch_id", "q"]).select("batch_id", "q", "d", (s - F.col("z")).alias(name))

    both = logs(teacher, "t").join(logs(student, "s"), ["batch_id", "q", "d"])
    per = both.groupBy("batch_id").agg(F.sum(F.exp("t") * (F.col("t") - F.col("s"))).alias("kl"), F.countDistinct("q").alias("n"))
    return per.select("batch_id", F.round(F.col("kl") / F.col("n") * F.lit(float(temperature) ** 2), 6).alias("loss"))


def stacked(batched: DataFrame, first: str, second: str, out: str = "vec") -> DataFrame:
    """(batch_id, slot, out): a batch's first vectors, then its second ones, as one batch of twice the size."""
    width = batched.groupBy("batch_id").agg((F.max("slot") + 1).alias("_w"))
    rows = batched.select("batch_id", "slot", F.col(first).alias("_a"), F.col(second).alias("_b")).join(width, "batch_id")
    both = F.array(F.struct(F.col("slot").alias("slot"), F.col("_a").alias("v")), F.struct((F.col("slot") + F.col("_w")).alias("slot"), F.col("_b").alias("v")))
    return rows.select("batch_id", F.explode(both).alias("_r")).select("batch_id", F.col("_r.slot").cast("int").alias("slot"), F.col("_r.v").alias(out))


def _products(a: pa.Array, b: pa.Array) -> np.ndarray:
    """[a, b] inner products rounded to 6 places; NaN where a vector is null, has a null, or the two differ in length."""
    sides = []
    for column in (a, b):
        rows = [None if v is None or any(x is None for x in v) else v for v in column.to_pylist()]
        size = np.array([-1 if v is None else len(v) for v in rows])
        sides.append((rows, size))
    width = max([1, *(int(size.max()) for _, size in sides if len(size))])
    one, two = (np.array([(v or []) + [0.0] * (width - len(v or [])) for v in rows], np.float64).reshape(-1, width) for rows, _ in sides)
    same = (sides[0][1][:, None] == sides[1][1][None, :]) & (sides[0][1][:, None] >= 0)
    return np.where(same, np.round(one @ two.T, 6), np.nan)


def _log_softmax(s: np.ndarray) -> np.ndarray:
    """By rows, NaN left out."""
    top = np.fmax.reduce(s, axis=1, keepdims=True)
    return s - top - np.log(np.nansum(np.exp(s - top), axis=1, keepdims=True))


def ranking_distilled_loss(batched: DataFrame, student: tuple[str, str], teacher: tuple[str, str], weight: float, scale: float = 20.0, temperature: float = 2.0) -> DataFrame:
    """(batch_id, mnr, kl, loss): multiple negatives ranking of (query, positive), and weight times the KL of the teacher's to the student's
    similarities among all queries and positives of the batch (X9).

    A batch is one group, so its similarities are matrix products where its rows are; no pair becomes a row.
    """

    def run(t: pa.Table) -> pa.Table:
        vectors = {c: t.column(c).combine_chunks() for c in {*student, *teacher}}
        vectors = {c: pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v for c, v in vectors.items()}
        own = -np.diagonal(_log_softmax(_products(vectors[student[0]], vectors[student[1]]) * scale))
        own = own[~np.isnan(own)]
        both = [pa.concat_arrays([vectors[x], vectors[y]]) for x, y in (student, teacher)]
        s, t_ = (_log_softmax(_products(v, v) / temperature) for v in both)
        each = np.exp(t_) * (t_ - s)
        kl = np.nansum(each) / len(each) * temperature**2 if not np.isnan(each).all() else None
        return pa.table({"batch_id": t.column("batch_id")[:1], "mnr": pa.array([own.mean() if len(own) else None], pa.float64()), "kl": pa.array([kl], pa.float64())})

    rows = batched.select("batch_id", *[F.col(c).cast("array<double>").alias(c) for c in sorted({*student, *teacher})])
    found = rows.groupBy("batch_id").applyInArrow(run, "batch_id long, mnr double, kl double").select("batch_id", F.round("mnr", 6).alias("mnr"), F.round("kl", 6).alias("kl"))
    return found.select("batch_id", "mnr", "kl", F.round(F.col("mnr") + F.lit(float(weight)) * F.col("kl"), 5).alias("loss"))
