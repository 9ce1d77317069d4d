"""Questions with a pool of candidate passages each: several retrievers scored inside the pool, in one pass, and fused.

A pool's own counts are all that BM25 may look at (the published evaluation indexes each question's pool by itself), so
document frequencies and lengths are grouped by question. Passages and questions meet once, as pairs (qid, did), which carry
a score column per retriever:

* bm25: lower-cased words, idf log(1 + (n - df + 0.5) / (df + 0.5)), each distinct question word once;
* okapi: pieces between white space, idf log((n - df + 0.5) / (df + 0.5)), a negative one replaced by EPSILON times the mean idf
  of the pool's words, a repeated question word counts each time;
* vector columns: cosine of given vectors (0 for a zero vector); a projector goes over both sides before.

Ranks go by score downwards, ties by id. A pool is never larger than what one question is asked against, so it is one group.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators.lexical import B, K1
from lodestar.sources.sinks import kept

EPSILON = 0.25
#: Reciprocal rank fusion: 1 / (FUSED + rank).
FUSED = 60
KS = (1, 2, 3, 5, 10, 20)


def _scores(asked: list[str], docs: list[list[str]], okapi: bool) -> np.ndarray:
    """BM25 of one question for its pool, with the pool's own counts."""
    n = len(docs)
    length = np.array([len(d) for d in docs], np.float64)
    mean = length.mean() if n and length.sum() else 1.0
    tf = [Counter(d) for d in docs]
    df = Counter(w for c in tf for w in c)
    out = np.zeros(n)
    floor = EPSILON * float(np.mean([np.log(n - c + 0.5) - np.log(c + 0.5) for c in df.values()])) if okapi and df else 0.0
    for w, times in Counter(asked).items():
        c = df.get(w, 0)
        if not c:
            continue
        if okapi:
            weight = np.log(n - c + 0.5) - np.log(c + 0.5)
            weight = times * (floor if weight < 0 else weight)
        else:
            weight = np.log(1 + (n - c + 0.5) / (c + 0.5))
        f = np.array([x[w] for x in tf], np.float64)
        out += weight * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
    return np.round(out, 6) + 0.0


def scored(pairs: DataFrame, vectors: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """pairs: one row per question and candidate, (qid, did, question, text, vector columns). (qid, did, bm25, okapi, and a column per
    entry of `vectors`); a pair without a common word scores 0.

    A pool is one group of one shuffle, which moves its texts once; cosines are computed before it.
    """
    made = {name: F.round(V.cosine(F.col(q), F.col(d)), 6) for name, (q, d) in (vectors or {}).items()}
    rows = pairs.select("qid", "did", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(f"v_{n}") for n, c in made.items()])
    # the question's tokens stand in its first row only
    first = F.row_number().over(Window.partitionBy("qid").orderBy("did")) == 1
    rows = rows.select("qid", "did", F.when(first, F.col("question")).alias("question"), "text", *[f"v_{n}" for n in made])
    rows = rows.select("qid", "did", T.word_tokens(F.col("question")).alias("q_words"), T.space_tokens(F.col("question")).alias("q_pieces"), T.word_tokens(F.col("text")).alias("words"), T.space_tokens(F.col("text")).alias("pieces"), *[f"v_{n}" for n in made])
    names = list(made)
    of = "".join(f", `{n}` double" for n in names)
    q, d = (rows.schema[c].dataType.simpleString() for c in ("qid", "did"))

    def run(t: pa.Table) -> pa.Table:
        asked = [max((x or [] for x in t.column(c).to_pylist()), key=len) for c in ("q_words", "q_pieces")]
        words, pieces = (t.column(c).to_pylist() for c in ("words", "pieces"))
        columns = {"qid": t.column("qid"), "did": t.column("did"), "bm25": pa.array(_scores(asked[0], words, False)), "okapi": pa.array(_scores(asked[1], pieces, True))}
        return pa.table(columns | {n: t.column(f"v_{n}") for n in names})

    return kept(rows.groupBy("qid").applyInArrow(run, f"qid {q}, did {d}, bm25 double, okapi double{of}"))


def ranked(scores: DataFrame, methods: list[str]) -> DataFrame:
    """(method, qid, did, score, rank) of every retriever, and of their fusion as `fused`."""
    ranks = scores.select("*", *[F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(m), F.asc("did"))).alias(f"rank_{m}") for m in methods])
    fused = F.round(reduce(lambda a, b: a + b, [F.lit(1.0) / (FUSED + F.col(f"rank_{m}")) for m in methods]), 9)
    ranks = ranks.withColumn("fused", fused).withColumn("rank_fused", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused"), F.asc("did"))))
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score"), F.col(f"rank_{m}").alias("rank")) for m in [*methods, "fused"]])
    return ranks.select("qid", "did", F.explode(rows).alias("r")).select("r.method", "qid", "did", "r.score", "r.rank")


def evaluated(run: DataFrame, gold: DataFrame, methods: list[str], ks: tuple[int, ...] = KS, least_gold: int = 2) -> DataFrame:
    """Per method over the questions with least_gold gold passages or more: n_valid, `recall@k` (share with any gold among the first
    k), `all@k` (with every gold), mrr of the first gold. A question without a run counts as 0."""
    gold = gold.select("qid", "did").distinct()
    valid = gold.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= least_gold)
    hits = run.join(gold, ["qid", "did"]).groupBy("method", "qid").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("found"))
    per = valid.withColumn("method", F.explode(F.array(*[F.lit(m) for m in methods]))).join(hits, ["method", "qid"], "left")
    any_ = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"recall@{k}") for k in ks]
    all_ = [F.round(F.avg(F.coalesce(((F.col("last") <= k) & (F.col("found") == F.col("n"))).cast("int"), F.lit(0))), 6).alias(f"all@{k}") for k in ks]
    return per.groupBy("method").agg(F.count("*").alias("n_valid"), *any_, *all_, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
