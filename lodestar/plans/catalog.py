"""The registered queries and their oracle SQL.

Roles of the tables: documents is the corpus, benchmark the queries, a document that contains an item's text
is relevant to it; embeddings are vectors with labels; conversations are chat turns; labels are verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import align, answers, batch_eval, clusters, dense, grams, lexical, mixing, models, multihop, negatives, ranking, report
from lodestar.plans import shared
from lodestar.sources.sinks import scratch
from lodestar.streaming.runs import RunBoard

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DEPTH = 20


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- lexical retrieval ---------------------------------------------------------------------

_TOKENS = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
_BM25 = f"""
tok AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
st AS (SELECT count(*) AS n, CASE WHEN sum(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS avgdl FROM tok),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
te AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
idf AS (SELECT term, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM te, st)"""


def _bm25_sql(queries: str) -> str:
    return f"""{_BM25},
q AS (SELECT DISTINCT qid, unnest(t) AS term FROM (SELECT qid, {_TOKENS.format("qt")} AS t FROM ({queries}))),
sc AS (SELECT qid, doc_id AS did, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY 1, 2),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM sc)"""


_ITEMS = "SELECT item_id AS qid, text AS qt FROM benchmark"
_QRELS = "qrels AS (SELECT b.item_id AS qid, d.doc_id AS did FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)))"
_HEAD = r"SELECT doc_id AS qid, array_to_string(list_filter(string_split_regex(text, '[\s\x0B]+'), lambda x: x <> '')[4:9], ' ') AS qt FROM documents WHERE doc_id % 20 = 0"


def index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    """The documents' index, written once a session and state of the table."""
    return shared.bm25(spark, sf_dir)


def contains_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, did): the document contains the item's text, in any case."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return grams.containing(shared.gram_index(spark, sf_dir), docs, "doc_id", "text", items, "item_id", "text").withColumnRenamed("item", "qid")


@query(f"WITH {_bm25_sql(_ITEMS)} SELECT qid, did, score, rank FROM run WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical.search(index(spark, sf_dir), _table(spark, sf_dir, "benchmark"), "item_id", "text", 10).select("qid", "did", "score", "rank")


@query(f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark, sf_dir):
    return index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def bm25_corpus_stats(spark, sf_dir):
    return index(spark, sf_dir).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_QRELS} SELECT * FROM qrels")
def qrels_contains(spark, sf_dir):
    return contains_qrels(spark, sf_dir)


@query(f"WITH {_QRELS} SELECT qid, min(did) AS did FROM qrels GROUP BY 1")
def qrels_first_positive(spark, sf_dir):
    return contains_qrels(spark, sf_dir).groupBy("qid").agg(F.min("did").alias("did"))


# -- ranking metrics -----------------------------------------------------------------------


def _metric_sql(run: str, qrels: str, cases: str | None = None) -> str:
    """CTE `per`: metrics of each query, from CTEs named run and qrels."""
    ks = ranking.KS
    cols = ", ".join(
        f"""CASE WHEN n_rel > 0 THEN h{k} / n_rel::DOUBLE ELSE 0 END AS "recall@{k}", h{k} / {k}::DOUBLE AS "precision@{k}",
  CASE WHEN f BETWEEN 1 AND {k} THEN 1 / f::DOUBLE ELSE 0 END AS "mrr@{k}",
  CASE WHEN h{k} > 0 THEN d{k} / list_sum(list_transform(range(1, least(n_rel, {k}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS "ndcg@{k}",
  CASE WHEN h{k} > 0 THEN 1.0::DOUBLE ELSE 0 END AS "hit@{k}\""""
        for k in ks
    )
    sums = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS d{k}" for k in ks)
    zero = ", ".join(f"coalesce(h{k}, 0) AS h{k}, coalesce(d{k}, 0) AS d{k}" for k in ks)
    return f"""nr AS (SELECT qid, count(DISTINCT did) AS n FROM {qrels} GROUP BY 1),
ca AS ({f"SELECT qid, coalesce(n, 0) AS n_rel FROM ({cases}) LEFT JOIN nr USING (qid)" if cases else "SELECT qid, n AS n_rel FROM nr"}),
hi AS (SELECT r.qid, r.did, r.rank FROM {run} r WHERE (r.qid, r.did) IN (SELECT qid, did FROM {qrels})),
su AS (SELECT qid, min(rank) AS f, {sums} FROM hi GROUP BY 1),
al AS (SELECT qid, n_rel, coalesce(f, 0) AS f, {zero} FROM ca LEFT JOIN su USING (qid)),
per AS (SELECT qid, n_rel, CASE WHEN f > 0 THEN 1 / f::DOUBLE ELSE 0 END AS mrr, {cols} FROM al)"""


_NAMES = ranking.metric_names()
_MEANS = ", ".join(f'round(coalesce(avg("{m}"), 0), 6) AS "{m}"' for m in _NAMES)
_LONG = "lo AS (SELECT qid, metric, value FROM (UNPIVOT (SELECT qid, " + ", ".join(f'"{m}"' for m in _NAMES) + " FROM per) ON COLUMNS(* EXCLUDE (qid)) INTO NAME metric VALUE value))"


def _self_queries(spark, sf_dir) -> DataFrame:
    """Words 4 to 9 of every document whose id is divisible by 20; its own document is relevant."""
    docs = _table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    words = F.filter(F.split("text", r"[\s\x0B]+"), lambda x: x != "")
    return docs.select(F.col("doc_id").alias("qid"), F.array_join(F.slice(words, 4, 6), " ").alias("qt"))


def _self_run(spark, sf_dir) -> DataFrame:
    return lexical.search(index(spark, sf_dir), _self_queries(spark, sf_dir), "qid", "qt", DEPTH)


_SELF = f"{_bm25_sql(_HEAD)}, deep AS (SELECT * FROM run WHERE rank <= {DEPTH}), own AS (SELECT qid, qid AS did FROM ({_HEAD}))"


@query(f"WITH {_bm25_sql(_ITEMS)}, deep AS (SELECT * FROM run WHERE rank <= {DEPTH}), {_QRELS}, {_metric_sql('deep', 'qrels')} SELECT {_MEANS} FROM per")
def bm25_metrics(spark, sf_dir):
    run = lexical.search(index(spark, sf_dir), _table(spark, sf_dir, "benchmark"), "item_id", "text", DEPTH)
    return ranking.means(ranking.per_query(run, contains_qrels(spark, sf_dir)))


@query(f"WITH {_bm25_sql(_ITEMS)}, deep AS (SELECT * FROM run WHERE rank <= {DEPTH}), {_QRELS}, {_metric_sql('deep', 'qrels', 'SELECT item_id AS qid FROM benchmark')} SELECT {_MEANS} FROM per")
def bm25_metrics_counting_empty(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark")
    run = lexical.search(index(spark, sf_dir), items, "item_id", "text", DEPTH)
    return ranking.means(ranking.per_query(run, contains_qrels(spark, sf_dir), items.select(F.col("item_id").alias("qid"))))


@query(f"WITH {_SELF}, {_metric_sql('deep', 'own')} SELECT {_MEANS} FROM per")
def self_retrieval_metrics(spark, sf_dir):
    qrels = _self_queries(spark, sf_dir).select("qid", F.col("qid").alias("did"))
    return ranking.means(ranking.per_query(_self_run(spark, sf_dir), qrels))


@query(f"WITH {_SELF}, {_metric_sql('deep', 'own')}, {_LONG} SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM lo GROUP BY 1")
def metrics_std_bundle(spark, sf_dir):
    qrels = _self_queries(spark, sf_dir).select("qid", F.col("qid").alias("did"))
    return ranking.bundle(ranking.per_query(_self_run(spark, sf_dir), qrels))


_PARTS = "CASE WHEN metric LIKE '%@%' THEN split_part(metric, '@', 1) ELSE metric END AS metric, try_cast(split_part(metric, '@', 2) AS INTEGER) AS k"


@query(f"WITH {_SELF}, {_metric_sql('deep', 'own')}, {_LONG} SELECT 'documents' AS dataset, {_PARTS}, 'self' AS run_id, 'test' AS split, round(avg(value), 6) AS value FROM lo GROUP BY lo.metric")
def metrics_long(spark, sf_dir):
    return ranking.long_rows(self_retrieval_metrics(spark, sf_dir), "documents", "self", "test")


@query(
    f"WITH {_SELF}, {_metric_sql('deep', 'own')}, {_LONG}, dm AS (SELECT lang, metric, avg(value) AS value FROM lo JOIN documents ON doc_id = qid GROUP BY 1, 2) "
    "SELECT metric, round(avg(value), 6) AS value, count(*) AS n FROM dm GROUP BY 1"
)
def metrics_macro_avg(spark, sf_dir):
    long = _per_lang_long(spark, sf_dir).groupBy("lang", "metric").agg(F.avg("value").alias("value"))
    return ranking.macro_average(long, ("metric",))


def _per_lang_long(spark, sf_dir) -> DataFrame:
    qrels = _self_queries(spark, sf_dir).select("qid", F.col("qid").alias("did"))
    per = ranking.per_query(_self_run(spark, sf_dir), qrels).join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "lang"), "qid")
    return per.unpivot(["qid", "lang"], [F.col(f"`{m}`") for m in ranking.metric_names()], "metric", "value")


@query(
    f"WITH {_SELF}, {_metric_sql('deep', 'own')} SELECT CASE WHEN lower(lang) IN ('en', 'fr', 'de') THEN lower(lang) ELSE 'unknown' END AS domain, count(*) AS n, round(avg(mrr), 6) AS mrr, "
    + ", ".join(f'round(avg("recall@{k}"), 6) AS "recall@{k}"' for k in (1, 5, 10))
    + " FROM per JOIN documents ON doc_id = qid GROUP BY 1"
)
def per_domain_metrics(spark, sf_dir):
    qrels = _self_queries(spark, sf_dir).select("qid", F.col("qid").alias("did"))
    per = ranking.per_query(_self_run(spark, sf_dir), qrels).join(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("qid"), "lang"), "qid")
    domain = F.when(F.lower("lang").isin("en", "fr", "de"), F.lower("lang")).otherwise("unknown")
    return per.groupBy(domain.alias("domain")).agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), *[F.round(F.avg(f"`recall@{k}`"), 6).alias(f"recall@{k}") for k in (1, 5, 10)])


# -- dense retrieval -----------------------------------------------------------------------

_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings)"
_L2 = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _dense_sql(score: str, k: int) -> str:
    return f"""WITH {_VEC}, s AS (SELECT a.vec_id AS qid, b.vec_id AS did, round({score}, 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM s), deep AS (SELECT * FROM run WHERE rank <= {k})"""


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def _dense(spark, sf_dir, k: int, metric: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return dense.search(v, v.where("vec_id % 20 = 0"), k, metric)


@query(_dense_sql("list_dot_product(a.e, b.e)", 10) + " SELECT qid, did, score, rank FROM deep")
def dense_ip_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10, "ip").select("qid", "did", "score", "rank")


@query(_dense_sql("list_dot_product(a.e, b.e)", 10) + " SELECT qid, did, score, rank FROM deep")
def ivf_topk(spark, sf_dir):
    """The inverted file with every list probed is exact."""
    lists = shared.vector_lists(spark, sf_dir)
    asked = _vectors(spark, sf_dir).where("vec_id % 20 = 0")
    return clusters.probe(lists, asked, 10, len(lists.centres)).select("qid", "did", "score", "rank")


@query(_dense_sql(f"-{_L2}", 10) + " SELECT qid, did, score + 0.0 AS score, rank FROM deep")
def dense_l2_topk(spark, sf_dir):
    return _dense(spark, sf_dir, 10, "l2").select("qid", "did", "score", "rank")


_OWN_LABEL = "own AS (SELECT a.vec_id AS qid, b.vec_id AS did FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


@query(_dense_sql("list_dot_product(a.e, b.e)", DEPTH) + f", {_OWN_LABEL}, {_metric_sql('deep', 'own')} SELECT {_MEANS} FROM per")
def dense_metrics(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return ranking.means(ranking.per_query_by_label(_dense(spark, sf_dir, DEPTH, "ip"), v, v.where("vec_id % 20 = 0"), "vec_id", "label"))


_GOLD = ", ".join(f"round(coalesce(avg(any_{k}), 0), 6) AS any_gold_at_{k}, round(coalesce(avg(all_{k}), 0), 6) AS all_gold_at_{k}" for k in (2, 5, 10))
_GOLD_SQL = ", ".join(f"max(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS any_{k}, min(CASE WHEN rank <= {k} THEN 1 ELSE 0 END) AS all_{k}" for k in (2, 5, 10))


@query(
    _dense_sql("list_dot_product(a.e, b.e)", DEPTH)
    + f""", {_OWN_LABEL}, near AS (SELECT qid, did FROM (SELECT own.*, row_number() OVER (PARTITION BY qid ORDER BY did) AS r FROM own) WHERE r <= 3),
many AS (SELECT qid FROM near GROUP BY 1 HAVING count(*) >= 2),
pr AS (SELECT n.qid, {_GOLD_SQL} FROM near n LEFT JOIN deep d ON n.qid = d.qid AND n.did = d.did WHERE n.qid IN (SELECT qid FROM many) GROUP BY 1)
SELECT count(*) AS n_queries, {_GOLD} FROM pr"""
)
def gold_at_k(spark, sf_dir):
    """Any and all of up to three gold vectors (the first of the same label) among the first k."""
    v = _vectors(spark, sf_dir)
    gold = ranking.first_of_label(v, v.where("vec_id % 20 = 0"), "vec_id", "label", 3)
    return ranking.all_gold(_dense(spark, sf_dir, DEPTH, "ip"), gold)


@query(
    f"WITH {_VEC}, c AS (SELECT a.vec_id AS qid, round(list_dot_product(a.e, b.e) / (greatest(sqrt(list_dot_product(a.e, a.e)), 1e-12) * greatest(sqrt(list_dot_product(b.e, b.e)), 1e-12)), 6) AS cosine, "
    f"round({_L2}, 6) AS l2 FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT * FROM c"
)
def cosine_pairs(spark, sf_dir):
    """Each vector with the next one."""
    v = _vectors(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("other"))
    return v.join(nxt, "vec_id").select(F.col("vec_id").alias("qid"), F.round(V.cosine(F.col("vec"), F.col("other")), 6).alias("cosine"), F.round(V.squared_l2(F.col("vec"), F.col("other")), 6).alias("l2"))


@query(
    _dense_sql("list_dot_product(a.e, b.e)", 10)
    + """, x AS (SELECT score, a.label = b.label AS pos FROM deep JOIN v a ON a.vec_id = qid JOIN v b ON b.vec_id = did)
SELECT round(avg(score) FILTER (pos), 6) AS pos_mean, round(stddev_pop(score) FILTER (pos), 6) AS pos_std, round(avg(score) FILTER (NOT pos), 6) AS neg_mean,
round(avg(score) FILTER (pos) - avg(score) FILTER (NOT pos), 6) AS margin, count(*) AS n FROM x"""
)
def pos_neg_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    run = _dense(spark, sf_dir, 10, "ip")
    x = run.join(v.select(F.col("vec_id").alias("qid"), F.col("label").alias("a")), "qid").join(v.select(F.col("vec_id").alias("did"), F.col("label").alias("b")), "did")
    pos, neg = F.when(F.col("a") == F.col("b"), F.col("score")), F.when(F.col("a") != F.col("b"), F.col("score"))
    return x.agg(
        F.round(F.avg(pos), 6).alias("pos_mean"), F.round(F.stddev_pop(pos), 6).alias("pos_std"), F.round(F.avg(neg), 6).alias("neg_mean"), F.round(F.avg(pos) - F.avg(neg), 6).alias("margin"), F.count("*").alias("n")
    )


@query(
    f"""WITH {_VEC}, p AS (SELECT a.vec_id, list_dot_product(a.e, b.e) AS pos, list_dot_product(a.e, c.e) AS neg FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2)
SELECT round(avg(pos), 6) AS pos_mean, round(avg(neg), 6) AS neg_mean, round(avg(pos - neg), 6) AS margin_mean, round(stddev_pop(pos - neg), 6) AS margin_std, count(*) AS n FROM p"""
)
def embedding_diagnostics(spark, sf_dir):
    """Margins of triplets (vector, next, the one after)."""
    p = _triplets(spark, sf_dir).select(V.dot(F.col("vec"), F.col("pos")).alias("p"), V.dot(F.col("vec"), F.col("neg")).alias("n"))
    d = F.col("p") - F.col("n")
    return p.agg(F.round(F.avg("p"), 6).alias("pos_mean"), F.round(F.avg("n"), 6).alias("neg_mean"), F.round(F.avg(d), 6).alias("margin_mean"), F.round(F.stddev_pop(d), 6).alias("margin_std"), F.count("*").alias("n"))


def _triplets(spark, sf_dir) -> DataFrame:
    v = _vectors(spark, sf_dir).select("vec_id", "vec")
    one, two = (v.select((F.col("vec_id") - i).alias("vec_id"), F.col("vec").alias(n)) for i, n in ((1, "pos"), (2, "neg")))
    return v.join(one, "vec_id").join(two, "vec_id")


# -- in-batch evaluation and losses --------------------------------------------------------

_BATCH = 64
_SIM = f"""WITH {_VEC}, p AS (SELECT vec_id // {_BATCH} AS batch_id, vec_id % {_BATCH} AS slot, e, (SELECT b.e FROM v b WHERE b.vec_id = a.vec_id + 1) AS o,
  (SELECT b.e FROM v b WHERE b.vec_id = a.vec_id + 2) AS g FROM v a WHERE vec_id + 2 IN (SELECT vec_id FROM v)),
ok AS (SELECT batch_id FROM p GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT q.batch_id, q.slot AS q, d.slot AS d, round(list_dot_product(q.e, d.o), 6) AS sim FROM p q JOIN p d USING (batch_id) WHERE q.batch_id IN (SELECT batch_id FROM ok))"""
_RANK_MEANS = """, m AS (SELECT batch_id, 1 / rank::DOUBLE AS mrr, CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END AS "ndcg@10", (rank <= 1)::INT::DOUBLE AS "recall@1", (rank <= 5)::INT::DOUBLE AS "recall@5", (rank <= 10)::INT::DOUBLE AS "recall@10" FROM r),
bm AS (SELECT batch_id, avg(mrr) AS mrr, avg("ndcg@10") AS "ndcg@10", avg("recall@1") AS "recall@1", avg("recall@5") AS "recall@5", avg("recall@10") AS "recall@10" FROM m GROUP BY 1)
SELECT round(avg(mrr), 6) AS mrr, round(avg("ndcg@10"), 6) AS "ndcg@10", round(avg("recall@1"), 6) AS "recall@1", round(avg("recall@5"), 6) AS "recall@5", round(avg("recall@10"), 6) AS "recall@10", count(*) AS n_batches FROM bm"""


def _batched(spark, sf_dir) -> DataFrame:
    return batch_eval.batches(_triplets(spark, sf_dir), "vec_id", _BATCH)


@query(_SIM + ", r AS (SELECT batch_id, q, d, row_number() OVER (PARTITION BY batch_id, q ORDER BY sim DESC, d) AS rank FROM s QUALIFY q = d)" + _RANK_MEANS)
def inbatch_row_number_metrics(spark, sf_dir):
    return batch_eval.mean_of_batch_means(batch_eval.partner_ranks(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"), "row_number"))


@query(_SIM + ", r AS (SELECT batch_id, q, d, rank() OVER (PARTITION BY batch_id, q ORDER BY sim DESC) AS rank FROM s QUALIFY q = d)" + _RANK_MEANS)
def inbatch_rank_metrics(spark, sf_dir):
    return batch_eval.mean_of_batch_means(batch_eval.partner_ranks(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"), "rank"))


@query(
    _SIM
    + ", s2 AS (SELECT * FROM s UNION ALL SELECT q.batch_id, q.slot, -1 - d.slot, round(list_dot_product(q.e, d.g), 6) FROM p q JOIN p d USING (batch_id) WHERE q.batch_id IN (SELECT batch_id FROM ok))"
    + ", r AS (SELECT batch_id, q, d, rank() OVER (PARTITION BY batch_id, q ORDER BY sim DESC) AS rank FROM s2 QUALIFY q = d)"
    + _RANK_MEANS
)
def inbatch_with_negatives(spark, sf_dir):
    return batch_eval.mean_of_batch_means(batch_eval.partner_ranks(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos", "neg"), "rank"))


@query(_SIM + ", r AS (SELECT batch_id, q, d, rank() OVER (PARTITION BY batch_id, q ORDER BY sim DESC) AS rank, count(*) OVER (PARTITION BY batch_id, q) AS n FROM s QUALIFY q = d) SELECT batch_id, q, rank, round(rank * 100.0::DOUBLE / n, 6) AS rank_percentile FROM r")
def rank_percentiles(spark, sf_dir):
    return batch_eval.percentiles(batch_eval.partner_ranks(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"), "rank"))


def _softmax_sql(scale: float) -> str:
    return _SIM + f""", t AS (SELECT *, max(sim * {scale}::DOUBLE) OVER (PARTITION BY batch_id, q) AS top FROM s),
l AS (SELECT batch_id, q, ln(sum(exp(sim * {scale}::DOUBLE - top))) + max(top) - max(CASE WHEN q = d THEN sim * {scale}::DOUBLE END) AS loss FROM t GROUP BY 1, 2)
SELECT batch_id, round(avg(loss), 6) AS loss FROM l GROUP BY 1"""


@query(_softmax_sql(50.0))
def loss_infonce(spark, sf_dir):
    return batch_eval.in_batch_softmax_loss(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"), 50.0)


@query(_softmax_sql(20.0))
def loss_mnr(spark, sf_dir):
    return batch_eval.in_batch_softmax_loss(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"), 20.0)


_TRI = f"WITH {_VEC}, t AS (SELECT a.vec_id, list_cosine_similarity(a.e, b.e) AS p, list_cosine_similarity(a.e, c.e) AS n FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2)"


@query(_TRI + " SELECT vec_id, round(greatest(0.5::DOUBLE - p + n, 0), 6) AS loss FROM t")
def loss_triplet(spark, sf_dir):
    return _triplets(spark, sf_dir).select("vec_id", F.round(batch_eval.triplet_loss("vec", "pos", "neg"), 6).alias("loss"))


@query(_TRI + " SELECT vec_id, round(ln(exp(p / 0.02::DOUBLE - greatest(p, n) / 0.02::DOUBLE) + exp(n / 0.02::DOUBLE - greatest(p, n) / 0.02::DOUBLE)) + greatest(p, n) / 0.02::DOUBLE - p / 0.02::DOUBLE, 4) AS loss FROM t")
def loss_infonce_explicit(spark, sf_dir):
    t = _triplets(spark, sf_dir)
    return t.select("vec_id", F.round(batch_eval.two_way_loss(t, "vec", "pos", "neg"), 4).alias("loss"))


@query(
    _SIM
    + """, ss AS (SELECT q.batch_id, q.slot AS q, d.slot AS d, round(list_dot_product(q.e, d.e), 6) / 2.0::DOUBLE AS s, round(list_dot_product(q.o, d.o), 6) / 2.0::DOUBLE AS t FROM p q JOIN p d USING (batch_id) WHERE q.batch_id IN (SELECT batch_id FROM ok)),
z AS (SELECT *, s - ln(sum(exp(s)) OVER w) AS ls, t - ln(sum(exp(t)) OVER w) AS lt FROM ss WINDOW w AS (PARTITION BY batch_id, q))
SELECT batch_id, round(sum(exp(lt) * (lt - ls)) / count(DISTINCT q) * 4.0::DOUBLE, 6) AS loss FROM z GROUP BY 1"""
)
def loss_kl(spark, sf_dir):
    b = _batched(spark, sf_dir)
    return batch_eval.self_similarity_kl(batch_eval.similarities(b, "vec", "vec"), batch_eval.similarities(b, "pos", "pos"), 2.0)


# -- answers -------------------------------------------------------------------------------

_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\p{{M}}_\s\x0B]', '', 'g'), '[\s\x0B]+', ' ', 'g'), ' ')"
_SPACE = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[\s\x0B]+'), lambda x: x <> '')"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalized("text")).alias("digest"))


@query(
    f"""WITH x AS (SELECT d.doc_id, {_NORM.format("d.text")} AS p, [substr(d.text, 11, 30), coalesce(l.text, 'no answer')] AS refs FROM documents d LEFT JOIN benchmark l ON l.item_id = d.doc_id)
SELECT doc_id, len(list_filter(refs, lambda r: contains(p, {_NORM.format("r")}))) > 0 AS correct FROM x"""
)
def in_accuracy(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item")), "doc_id", "left")
    rows = docs.select("doc_id", "text", F.array(F.substring("text", 11, 30), F.coalesce("item", F.lit("no answer"))).alias("possible_answers"))
    return answers.in_accuracy(rows, "text").select("doc_id", "correct")


_PAIR = f"""WITH x AS (SELECT a.doc_id, {_SPACE.format("a.text")} AS r, {_SPACE.format("b.text")} AS c FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
y AS (SELECT doc_id, CASE WHEN len(r) > 0 AND len(c) > 0 THEN len(list_intersect(r, c)) / len(list_distinct(r || c))::DOUBLE END AS jaccard,
  CASE WHEN len(r) > 0 AND len(c) > 0 THEN len(list_intersect(r, c)) / greatest(len(list_distinct(r)), 1)::DOUBLE END AS word_overlap,
  CASE WHEN len(r) > 0 AND len(c) > 0 THEN len(c) / greatest(len(r), 1)::DOUBLE END AS length_ratio FROM x)"""


def _neighbours(spark, sf_dir) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("candidate")), "doc_id")


@query(_PAIR + " SELECT doc_id, round(jaccard, 6) AS jaccard, round(word_overlap, 6) AS word_overlap, round(length_ratio, 6) AS length_ratio FROM y")
def simple_text_metrics(spark, sf_dir):
    rows = answers.simple_metrics(_neighbours(spark, sf_dir), "text", "candidate")
    return rows.select("doc_id", *[F.round(m, 6).alias(m) for m in ("jaccard", "word_overlap", "length_ratio")])


@query(_PAIR + " SELECT round(avg(jaccard), 6) AS avg_jaccard, round(avg(word_overlap), 6) AS avg_word_overlap, round(avg(length_ratio), 6) AS avg_length_ratio, count(*) AS n FROM y")
def simple_text_means(spark, sf_dir):
    return answers.simple_means(answers.simple_metrics(_neighbours(spark, sf_dir), "text", "candidate"))


@query()
def char_similarity(spark, sf_dir):
    """Each item's text with every document that contains it."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("item"))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), "text")
    rows = contains_qrels(spark, sf_dir).join(items, "qid").join(docs, "did")
    return rows.select("qid", "did", F.round(answers.char_similarity("item", "text"), 6).alias("char_similarity"))


@query(f"SELECT doc_id, len({_TOKENS.format('text')}) AS n_tokens FROM documents WHERE len({_TOKENS.format('text')}) <= 70")
def token_length_filter(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens("text")).cast("long").alias("n_tokens"))
    return rows.where("n_tokens <= 70")


@query("SELECT quality::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1")
def label_counts(spark, sf_dir):
    return answers.label_counts(_table(spark, sf_dir, "labels"), "quality")


@query("SELECT round(avg(s) FILTER (s >= 0), 6) AS mean, count(*) FILTER (s >= 0) AS n_valid, count(*) AS n FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN -1 ELSE quality END AS s FROM labels)")
def valid_score_mean(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").withColumn("s", F.when(F.col("doc_id") % 7 == 0, -1).otherwise(F.col("quality")))
    return answers.valid_mean(rows, "s")


@query("WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fn FROM labels) SELECT *, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1 FROM c")
def binary_f1(spark, sf_dir):
    return answers.binary_f1(_table(spark, sf_dir, "labels"), "quality", "toxic")


# -- negatives -----------------------------------------------------------------------------


@query(f"WITH {_bm25_sql(_ITEMS)}, {_QRELS}, n AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM sc WHERE (qid, did) NOT IN (SELECT qid, did FROM qrels)) SELECT * FROM n WHERE rank <= 5")
def bm25_negatives(spark, sf_dir):
    return negatives.mined_from(index(spark, sf_dir), _table(spark, sf_dir, "benchmark"), "item_id", "text", contains_qrels(spark, sf_dir), 5)


@query(_dense_sql("list_dot_product(a.e, b.e)", 5) + " SELECT qid, array_to_string(list(did ORDER BY rank), ',') AS negatives FROM deep GROUP BY 1")
def dense_negatives(spark, sf_dir):
    got = negatives.collected(_dense(spark, sf_dir, 5, "ip"), 5)
    return got.select("qid", F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives"))


_RANDOM = f"""WITH {_QRELS}, c AS (SELECT greatest(1, count(*) // 64) AS nb FROM documents),
e AS (SELECT coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM qrels GROUP BY qid)),
r AS (SELECT nb, least(nb, 2 + (2 * (5 + most)) // 64) AS reach FROM c, e),
d AS (SELECT doc_id AS did, ('0x' || substr(md5('negd:' || doc_id), 1, 8))::BIGINT % nb AS bucket FROM documents, r),
a AS (SELECT qid, (('0x' || substr(md5('negq:' || qid), 1, 8))::BIGINT % nb + i) % nb AS bucket FROM (SELECT item_id AS qid, nb, unnest(range(reach)) AS i FROM benchmark, r)),
random AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY md5('neg:' || qid || ':' || did), did) AS rank FROM a JOIN d USING (bucket) WHERE (qid, did) NOT IN (SELECT qid, did FROM qrels) QUALIFY rank <= 5)"""


@query(_RANDOM + " SELECT * FROM random")
def random_negatives(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"))
    corpus = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"))
    return negatives.hashed(items, corpus, contains_qrels(spark, sf_dir), 5)


@query(
    _RANDOM
    + f""", {_bm25_sql(_ITEMS)}, mined AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM sc WHERE (qid, did) NOT IN (SELECT qid, did FROM qrels) QUALIFY rank <= 3),
rest AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY rank, did) AS rank FROM random WHERE (qid, did) NOT IN (SELECT qid, did FROM mined) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, did) <= 2)
SELECT qid, did, 'mined' AS kind, rank FROM mined UNION ALL SELECT qid, did, 'random' AS kind, rank FROM rest"""
)
def mixed_negatives(spark, sf_dir):
    return negatives.mixed(bm25_negatives(spark, sf_dir), random_negatives(spark, sf_dir), 3, 2)


@query(
    """WITH t AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') AS sel, list(text ORDER BY turn) FILTER (role <> 'assistant') AS oth FROM conversations GROUP BY 1)
SELECT conv_id::VARCHAR AS query, sel[1] AS positive, CASE WHEN len(coalesce(oth, []) || sel[2:]) > 0 THEN len(coalesce(oth, [])) ELSE 1 END AS n_negatives FROM t WHERE len(coalesce(sel, [])) = 1"""
)
def passage_groups(spark, sf_dir):
    """A conversation with one assistant turn as a passage group: that turn is selected."""
    turns = _table(spark, sf_dir, "conversations")
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("s"))
    rows = rows.where(F.size(F.filter("s", lambda x: x["role"] == "assistant")) == 1)
    passages = F.struct(F.transform("s", lambda x: x["text"]).alias("passage_text"), F.transform("s", lambda x: (x["role"] == "assistant").cast("int")).alias("is_selected"))
    made = negatives.passage_groups(rows.select(F.col("conv_id").cast("string").alias("query"), passages.alias("passages")))
    return made.select("query", "positive", F.size("negatives").cast("long").alias("n_negatives"))


# -- mixing --------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ':' || coalesce(text, ''), '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def chat_messages(spark, sf_dir):
    made = mixing.conversations(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return made.select("conv_id", "n_turns", F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("digest"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(spark, sf_dir):
    return mixing.first_by(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "doc_id").select("doc_id", "lang")


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= CASE lang WHEN 'en' THEN 150 WHEN 'fr' THEN 90 ELSE 60 END")
def quota_mix(spark, sf_dir):
    return mixing.quota_mix(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 5, "fr": 3, "de": 2}, 300)


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) <= 20")
def proportional_sample(spark, sf_dir):
    return mixing.hash_sample(_table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", 7, 20, "source")


@query("SELECT coalesce(lang, 'unknown') AS domain, count(*) AS n FROM documents GROUP BY 1")
def domain_counts(spark, sf_dir):
    return mixing.domain_counts(_table(spark, sf_dir, "documents"), "lang")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('13:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r <= floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r")
def split_hash(spark, sf_dir):
    return mixing.hash_split(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 13, 0.1)


@query("SELECT source, doc_id, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY doc_id) > count(*) OVER (PARTITION BY source) - floor(count(*) OVER (PARTITION BY source) * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_tail(spark, sf_dir):
    return mixing.tail_split(_table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 0.1)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE len(text) > 1000")
def renumbered(spark, sf_dir):
    return mixing.numbered(_table(spark, sf_dir, "documents").where(F.length("text") > 1000).select("doc_id"), "doc_id").select("doc_id", "pos")


# -- vectors -------------------------------------------------------------------------------

_TOK4 = f"WITH {_VEC}, t AS (SELECT vec_id, [e[1:16], e[17:32], e[33:48], e[49:64]] AS m FROM v)"


def _tokens4(spark, sf_dir) -> DataFrame:
    parts = F.array(*[F.slice("vec", 1 + 16 * i, 16) for i in range(4)])
    return _vectors(spark, sf_dir).select("vec_id", parts.alias("m"))


def _sql_sum(expr: str) -> str:
    return f"round(list_sum({expr}), 6)"


@query(
    _TOK4
    + f""", p AS (SELECT vec_id, m[1] AS f, m[4] AS l, flatten(m) AS fl, list_transform(range(1, 17), lambda i: (m[1][i] + m[2][i] + m[3][i] + m[4][i]) / 4) AS me,
list_transform(range(1, 17), lambda i: greatest(m[1][i], m[2][i], m[3][i], m[4][i])) AS mx FROM t)
SELECT vec_id, {_sql_sum("f")} AS first, {_sql_sum("l")} AS last, {_sql_sum("fl")} AS flatten, {_sql_sum("me")} AS mean, {_sql_sum("mx")} AS max, round(list_sum(me) + list_sum(mx), 6) AS mean_max FROM p"""
)
def pooling_variants(spark, sf_dir):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = _tokens4(spark, sf_dir)
    return rows.select("vec_id", *[F.round(total(V.pooled(F.col("m"), how)), 6).alias(how) for how in ("first", "last", "flatten", "mean", "max", "mean_max")])


@query(_TOK4 + ", p AS (SELECT vec_id, list_transform(range(1, 17), lambda i: (m[1][i] + CASE WHEN vec_id % 3 > 0 THEN m[2][i] ELSE 0 END) / (1 + CASE WHEN vec_id % 3 > 0 THEN 1 ELSE 0 END)) AS me FROM t) SELECT vec_id, round(list_sum(me), 6) AS masked_mean, round(me[1], 6) AS head FROM p")
def masked_mean_pool(spark, sf_dir):
    mask = F.array(F.lit(1), F.when(F.col("vec_id") % 3 > 0, 1).otherwise(0), F.lit(0), F.lit(0))
    pooled = _tokens4(spark, sf_dir).select("vec_id", V.masked_mean(F.col("m"), mask).alias("p"))
    return pooled.select("vec_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 6).alias("masked_mean"), F.round(F.element_at("p", 1), 6).alias("head"))


@query(f"WITH {_VEC} SELECT vec_id, round(list_dot_product(e, e), 6) AS squared_norm, round(e[1] / CASE WHEN list_dot_product(e, e) = 0 THEN 1 ELSE sqrt(list_dot_product(e, e)) END, 6) AS head FROM v")
def l2_normalised(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.dot(F.col("vec"), F.col("vec")), 6).alias("squared_norm"), F.round(F.element_at(V.unit(F.col("vec")), 1), 6).alias("head"))


@query()
def encode_hashing(spark, sf_dir):
    made = models.encode(_table(spark, sf_dir, "benchmark"), "text", "hashing", dim=32)
    return made.select("item_id", F.round(V.dot(F.col("vec"), F.col("vec")), 4).alias("squared_norm"))


@query()
def generate_stub(spark, sf_dir):
    return models.generate(_table(spark, sf_dir, "benchmark"), "text", lambda docs, asks: [d.split()[0] if d.split() else "" for d in docs], samples=2).select("item_id", "sample", "answer")


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT vec_id, list_transform(range(1, 65), lambda i: e[65 - i]) AS r FROM v) SELECT vec_id, round(r[1] / sqrt(list_dot_product(r, r)), 6) AS head FROM p")
def project_linear(spark, sf_dir):
    """A one-layer projector that reverses the vector."""
    made = models.project(_vectors(spark, sf_dir), "vec", [(np.eye(64)[::-1], np.zeros(64))])
    return made.select("vec_id", F.round(F.element_at("projected", 1), 6).alias("head"))


# -- questions with pools of candidates -----------------------------------------------------

_HOP_METHODS = ["bm25", "okapi", "cosine", "projected"]


def _pools(spark, sf_dir) -> DataFrame:
    """Every twentieth document that has a vector asks the 15 documents after it; gold are those with its label."""
    both = _table(spark, sf_dir, "documents").select("doc_id", "text").join(_vectors(spark, sf_dir), F.col("doc_id") == F.col("vec_id"))
    half = F.slice("vec", 1, 32)  # a projector that keeps half of the elements
    asked = both.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), F.col("text").alias("question"), F.col("vec").alias("q_vec"), half.alias("q_half"), F.col("label").alias("q_label"))
    asked = asked.withColumn("did", F.explode(F.sequence(F.col("qid") + 1, F.col("qid") + 15)))
    pool = both.select(F.col("doc_id").alias("did"), "text", F.col("vec").alias("d_vec"), half.alias("d_half"), F.col("label").alias("d_label"))
    return asked.join(pool, "did")


def _hop_run(spark, sf_dir) -> DataFrame:
    scores = multihop.scored(_pools(spark, sf_dir), {"cosine": ("q_vec", "d_vec"), "projected": ("q_half", "d_half")})
    return multihop.ranked(scores, _HOP_METHODS)


def _hop_bm25(name: str, tokens: str, times: str, weight: str) -> str:
    """CTEs of one lexical retriever with the pool's own counts; `name` holds its score."""
    return f"""{name}_t AS (SELECT qid, did, {tokens.format("text")} AS t FROM pairs),
{name}_n AS (SELECT qid, count(*) AS n, CASE WHEN sum(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS avgdl FROM {name}_t GROUP BY 1),
{name}_f AS (SELECT qid, did, dl, term, count(*) AS tf FROM (SELECT qid, did, len(t) AS dl, unnest(t) AS term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT qid, term, n, avgdl, count(*) AS df FROM {name}_f JOIN {name}_n USING (qid) GROUP BY ALL),
{name}_i AS (SELECT *, {weight} AS idf FROM {name}_d),
{name}_q AS (SELECT qid, term, {times} AS times FROM (SELECT qid, unnest({tokens.format("question")}) AS term FROM (SELECT qid, any_value(question) AS question FROM pairs GROUP BY 1)) GROUP BY ALL),
{name} AS (SELECT qid, did, round(sum(times * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS s FROM {name}_f JOIN {name}_q USING (qid, term) JOIN {name}_i USING (qid, term) GROUP BY 1, 2)"""


_RAW_IDF = "(ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE))"
_COS = "round(list_dot_product({0}, {1}) / (greatest(sqrt(list_dot_product({0}, {0})), 1e-12) * greatest(sqrt(list_dot_product({1}, {1})), 1e-12)), 6)"
_HOP = f"""WITH {_VEC}, x AS (SELECT doc_id, text, e, label FROM documents JOIN v ON doc_id = vec_id),
pairs AS (SELECT q.doc_id AS qid, d.doc_id AS did, coalesce(q.text, '') AS question, d.text, q.e AS qe, d.e AS de, q.label = d.label AS gold FROM x q JOIN x d ON d.doc_id BETWEEN q.doc_id + 1 AND q.doc_id + 15 WHERE q.doc_id % 20 = 0),
{_hop_bm25("bm25", _TOKENS, "1", "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))")},
{_hop_bm25("okapi", _SPACE, "count(*)", f"CASE WHEN {_RAW_IDF} < 0 THEN 0.25::DOUBLE * avg({_RAW_IDF}) OVER (PARTITION BY qid) ELSE {_RAW_IDF} END")},
c AS (SELECT p.qid, p.did, coalesce(b.s, 0) AS bm25, coalesce(o.s, 0) AS okapi, {_COS.format("qe", "de")} AS cosine, {_COS.format("qe[1:32]", "de[1:32]")} AS projected
  FROM pairs p LEFT JOIN bm25 b ON p.qid = b.qid AND p.did = b.did LEFT JOIN okapi o ON p.qid = o.qid AND p.did = o.did),
k AS (SELECT *, {", ".join(f"row_number() OVER (PARTITION BY qid ORDER BY {m} DESC, did) AS r_{m}" for m in _HOP_METHODS)} FROM c),
u AS (SELECT *, round({" + ".join(f"1 / (60 + r_{m})::DOUBLE" for m in _HOP_METHODS)}, 9) AS fused FROM k),
w AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, did) AS r_fused FROM u),
run AS ({" UNION ALL ".join(f"SELECT '{m}' AS method, qid, did, {m} AS score, r_{m} AS rank FROM w" for m in [*_HOP_METHODS, "fused"])})"""
_HOP_AT = ", ".join([f'round(avg(CASE WHEN "first" <= {k} THEN 1 ELSE 0 END), 6) AS "recall@{k}"' for k in multihop.KS] + [f'round(avg(CASE WHEN "last" <= {k} AND found = n THEN 1 ELSE 0 END), 6) AS "all@{k}"' for k in multihop.KS])


@query(_HOP + " SELECT method, qid, did, score, rank FROM run")
def multihop_ranks(spark, sf_dir):
    return _hop_run(spark, sf_dir)


@query(
    _HOP
    + f""", g AS (SELECT qid, did FROM pairs WHERE gold), n AS (SELECT qid, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2),
h AS (SELECT method, qid, min(rank) AS "first", max(rank) AS "last", count(*) AS found FROM run JOIN g USING (qid, did) GROUP BY 1, 2)
SELECT method, count(*) AS n_valid, {_HOP_AT}, round(avg(coalesce(1 / "first"::DOUBLE, 0)), 6) AS mrr FROM h JOIN n USING (qid) GROUP BY 1"""
)
def multihop_retrievers(spark, sf_dir):
    """Four retrievers inside each question's pool, and their fusion."""
    gold = _pools(spark, sf_dir).where("q_label = d_label").select("qid", "did")
    return multihop.evaluated(_hop_run(spark, sf_dir), gold, [*_HOP_METHODS, "fused"])


# -- alignment -----------------------------------------------------------------------------


def _sentence_pairs(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("premise"))
    nxt = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("premise").alias("hypothesis"))
    made = align.pairs(rows.join(nxt, "item_id"), "item_id", "premise", "hypothesis", words=20)
    return made.withColumn("score", align.token_overlap(F.col("premise"), F.col("hypothesis")))


_SENT = r"list_filter(string_split(regexp_replace(coalesce({0}, ''), '([.!?])[\s\x0B]+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_ALIGN = f"""WITH b AS (SELECT a.item_id, a.text AS prem, {_SENT.format("a.text")} AS ps, {_SENT.format("n.text")} AS hs FROM benchmark a JOIN benchmark n ON n.item_id = a.item_id + 1),
k AS (SELECT *, greatest(len(ps) // (len({_SPACE.format("prem")}) // 20 + 1), 1) AS each FROM b),
c AS (SELECT item_id, hs, list_transform(range(0, len(ps), each), lambda i: array_to_string(ps[i + 1:i + each], ' ')) AS cs FROM k),
x AS (SELECT item_id, h, cs[p] AS prem, hs[h] AS hyp, p FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS h FROM c), LATERAL (SELECT unnest(range(1, len(cs) + 1)) AS p)),
s AS (SELECT item_id, h, p, len(list_intersect({_SPACE.format("hyp")}, {_SPACE.format("prem")})) / greatest(len(list_distinct({_SPACE.format("hyp")})), 1)::DOUBLE AS score FROM x)"""


@query(_ALIGN + " SELECT item_id, round(avg(m), 6) AS score FROM (SELECT item_id, h, max(score) AS m FROM s GROUP BY 1, 2) GROUP BY 1")
def alignment_score(spark, sf_dir):
    return align.alignment(_sentence_pairs(spark, sf_dir), "item_id")


@query(
    _ALIGN
    + """, pr AS (SELECT item_id, avg(m) AS precision FROM (SELECT item_id, h, max(score) AS m FROM s GROUP BY 1, 2) GROUP BY 1),
re AS (SELECT item_id, avg(m) AS recall FROM (SELECT item_id, p, max(score) AS m FROM s GROUP BY 1, 2) GROUP BY 1)
SELECT item_id, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM pr JOIN re USING (item_id)"""
)
def smart_n(spark, sf_dir):
    made = align.smart_n(_sentence_pairs(spark, sf_dir), "item_id")
    return made.select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    _ALIGN.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, z AS (SELECT item_id, max(p) AS np, max(h) AS nh FROM s GROUP BY 1),
r(item_id, np, nh, i, j, above, here, one, above1, here1) AS (
  SELECT item_id, np, nh, 1, 1, list_transform(range(0, nh + 1), lambda x: 0::DOUBLE), [0::DOUBLE], list_transform(range(0, nh + 1), lambda x: 0::DOUBLE), list_transform(range(0, nh + 1), lambda x: 0::DOUBLE), [0::DOUBLE] FROM z
  UNION ALL
  SELECT item_id, np, nh, CASE WHEN last THEN i + 1 ELSE i END, CASE WHEN last THEN 1 ELSE j + 1 END, CASE WHEN last THEN n ELSE above END, CASE WHEN last THEN [0::DOUBLE] ELSE n END, o, CASE WHEN last THEN n1 ELSE above1 END, CASE WHEN last THEN [0::DOUBLE] ELSE n1 END
  FROM (SELECT r.*, j = nh AS last, list_append(here, greatest(above[j] + m, above[j + 1] + m, here[j])) AS n, list_append(here1, greatest(above1[j] + m, above1[j + 1], here1[j])) AS n1,
    list_concat(list_concat(one[1:j], [greatest(one[j] + m, one[j + 1] + m)]), one[j + 2:]) AS o
    FROM (SELECT r.*, s.score AS m FROM r JOIN s ON s.item_id = r.item_id AND s.p = r.i AND s.h = r.j) r)
), e AS (SELECT item_id, np, nh, above[nh + 1] AS soft, one[nh + 1] AS shared, above1[nh + 1] AS t FROM r WHERE i = np + 1)
SELECT item_id, round(t / nh, 6) AS precision, round(t / np, 6) AS recall, round(CASE WHEN t > 0 THEN 2 * (t / nh) * (t / np) / (t / nh + t / np) ELSE 0 END, 6) AS f1, round(soft / np, 6) AS soft, round(shared / np, 6) AS soft_shared FROM e"""
)
def smart_l(spark, sf_dir):
    made = align.smart_l(_sentence_pairs(spark, sf_dir), "item_id")
    return made.select("item_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "soft", "soft_shared")])


# -- reports -------------------------------------------------------------------------------

_HIST = "h AS (SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL)"


def _history(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")


@query(f"WITH {_HIST} SELECT user_id, event_id, value FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def best_run(spark, sf_dir):
    return report.best_run(_history(spark, sf_dir), "value", "event_id", "user_id")


@query(
    f"""WITH {_HIST}, b AS (SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best FROM h),
i AS (SELECT *, before IS NULL OR value < before AS is_best FROM b), g AS (SELECT *, count(*) FILTER (is_best) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM i)
SELECT user_id, event_id, value, best, is_best, row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS stale FROM g"""
)
def running_best(spark, sf_dir):
    return report.curve_marks(_history(spark, sf_dir), "user_id", "event_id", "value")


@query(
    f"""WITH {_HIST}, b AS (SELECT user_id, event_id AS best_step, value AS best FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1)
SELECT user_id, best_step, best, max(event_id) AS last_step, count(*) AS n, count(*) FILTER (event_id > best_step) AS stale FROM h JOIN b USING (user_id) GROUP BY ALL"""
)
def followed_runs(spark, sf_dir):
    """The table as a stream of files of run records, eight a batch."""
    path = f"{sf_dir}/events.parquet"
    board = RunBoard(spark, scratch(spark), "user_id", "event_id")
    board.follow(spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/[e]vents.parquet"))  # a pattern may name a file or a folder
    return board.best()


@query(f"WITH {_HIST}, e AS (SELECT user_id, arg_min(value, event_id) AS f, arg_max(value, event_id) AS l FROM h GROUP BY 1) SELECT user_id, round(f, 6) AS first, round(l, 6) AS last, round(l - f, 6) AS gain, round(CASE WHEN f <> 0 THEN l / f END, 6) AS ratio FROM e")
def curve_deltas(spark, sf_dir):
    return report.curve_deltas(_history(spark, sf_dir), "user_id", "event_id", "value")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from lodestar.plans import extended, records  # noqa: F401  register more

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from lodestar.plans import extended, records  # noqa: F401  register more

    return dict(ORACLES)
