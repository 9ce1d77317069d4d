"""Further registered queries: record rules, statistics, losses, negatives, and files written and read again."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import batch_eval, chat, mixing, negatives, records, stats
from lodestar.plans.catalog import _BATCH, _SIM, _TOKENS, _VEC, _batched, _table, _triplets, _vectors, query
from lodestar.sources import readers, sinks
from lodestar.sources.sinks import scratch


# -- records -------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) AS n FROM documents WHERE text IS NOT NULL AND text <> ''")
def valid_texts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").where(records.valid_text(F.col("text"))).select("doc_id", F.length("text").alias("n"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang <> '' AND source <> '' ORDER BY doc_id LIMIT 150")
def both_present_first(spark, sf_dir):
    return records.both_present(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 150)


@query("SELECT doc_id, coalesce(lang, '') AS lang, '' AS title FROM documents")
def defaulted_columns(spark, sf_dir):
    return records.defaulted(_table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang", "title"])


_VERDICTS = "SELECT doc_id, CASE WHEN toxic = 1 THEN 'incorrect' ELSE 'correct' END AS label, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality * 0.5::DOUBLE END AS score FROM labels"


@query(f"SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE label END AS label, score FROM ({_VERDICTS})")
def judge_verdicts(spark, sf_dir):
    """Judges' answers with words around nested or flat JSON; every seventh has none."""
    rows = _table(spark, sf_dir, "labels").withColumn("label", F.when(F.col("toxic") == 1, "INCORRECT").otherwise("Correct"))
    flat = F.to_json(F.struct("label", (F.col("quality") * 0.5).alias("score")))
    nested = F.to_json(F.struct(F.struct("label").alias("verdict"), (F.col("quality") * 0.5).alias("score")))
    payload = F.when(F.col("doc_id") % 7 == 0, "I can't tell.").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Here it is:\n"), flat)).otherwise(F.concat(nested, F.lit("\nDone.")))
    return rows.select("doc_id", records.verdict(payload).alias("v")).select("doc_id", "v.label", "v.score")


@query("SELECT conv_id, string_agg(text, ' OR ' ORDER BY turn) AS golden FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def golden_answers(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("s"))
    return c.select("conv_id", records.golden(F.transform("s", lambda x: x["text"])).alias("golden"))


@query("SELECT item_id, text[:100] AS head, regexp_replace('))' || text, '^\\)+', '') AS question FROM benchmark WHERE text IS NOT NULL")
def plain_queries(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").where("text is not null")
    return b.select("item_id", F.substring("text", 1, 100).alias("head"), records.plain_query(F.concat(F.lit("))"), F.col("text"))).alias("question"))


@query("SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct FROM documents GROUP BY 1")
def source_counts(spark, sf_dir):
    return records.source_counts(_table(spark, sf_dir, "documents"), "source", "text")


@query("SELECT label, string_agg(DISTINCT vec_id::VARCHAR, ',' ORDER BY vec_id::VARCHAR) AS items FROM embeddings GROUP BY 1")
def grouped_ids(spark, sf_dir):
    return records.grouped_ids(_vectors(spark, sf_dir).withColumn("item", F.col("vec_id").cast("string")), "label", "item").select("label", F.array_join("items", ",").alias("items"))


@query("SELECT event_id, event_id % 12 AS epoch, round(0.2::DOUBLE + 0.6::DOUBLE * least((event_id % 12) / 8.0::DOUBLE, 1), 6) AS weight FROM events")
def curriculum_weights(spark, sf_dir):
    """Every event's weight in the epoch it falls into."""
    e = _table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 12).alias("epoch"))
    return e.select("event_id", "epoch", F.round(records.curriculum(F.col("epoch"), 0.2, 0.8, 8), 6).alias("weight"))


_GROUPS = "SELECT conv_id, list(text ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '') AS p, list(text ORDER BY turn) FILTER (trim(coalesce(text, '')) <> '' AND role = 'assistant') AS s FROM conversations GROUP BY 1"


@query(
    f"WITH g AS ({_GROUPS}), h AS (SELECT conv_id, p, coalesce(s[1], p[1]) AS positive FROM g WHERE p IS NOT NULL) "
    "SELECT conv_id::VARCHAR AS query, positive, coalesce(list_filter(p, lambda x: x <> positive)[1], positive) AS negative FROM h"
)
def passage_fallback(spark, sf_dir):
    """A conversation's turns as raw passages; those of the assistant are selected."""
    c = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", F.when(F.col("role") == "assistant", 1).otherwise(0).alias("s")))).alias("t"))
    rows = c.select(F.col("conv_id").cast("string").alias("query"), F.struct(F.transform("t", lambda x: x["text"]).alias("passage_text"), F.transform("t", lambda x: x["s"]).alias("is_selected")).alias("passages"))
    return records.passage_fallback(rows)


# -- statistics ------------------------------------------------------------------------------

_NEXT = f"WITH {_VEC}, x AS (SELECT a.vec_id, a.label, list_dot_product(a.e, b.e) AS sim FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2)"


def _sims(spark, sf_dir) -> DataFrame:
    return _triplets(spark, sf_dir).join(_vectors(spark, sf_dir).select("vec_id", "label"), "vec_id").withColumn("sim", V.dot(F.col("vec"), F.col("pos")))


@query(_NEXT + " SELECT label, round(avg(sim), 6) AS mean, round(stddev_pop(sim), 6) AS std, count(*) AS n FROM x GROUP BY 1")
def domain_similarity_stats(spark, sf_dir):
    return stats.similarity_stats(_sims(spark, sf_dir), "label", "sim")


@query(_NEXT + f" SELECT vec_id // {_BATCH} AS batch_id, round(avg(sim), 6) AS mean, round(coalesce(stddev_samp(sim), 0), 6) AS std, count(*) AS n FROM x GROUP BY 1")
def batch_similarity_stats(spark, sf_dir):
    return stats.similarity_stats(_sims(spark, sf_dir).withColumn("batch_id", F.floor(F.col("vec_id") / _BATCH)), "batch_id", "sim", sample=True)


@query("SELECT round(avg(n), 6) AS avg, min(n) AS min, max(n) AS max FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def list_sizes(spark, sf_dir):
    return stats.list_sizes(_table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("turns")), "turns")


@query("SELECT round(avg(length(text)), 6) AS mean, median(length(text)) AS median, count(*) AS n FROM documents WHERE length(text) > 0")
def text_lengths(spark, sf_dir):
    return stats.text_lengths(_table(spark, sf_dir, "documents"), "text")


@query("SELECT round(avg((quality = 1)::INT), 6) AS mean, count(*) AS n FROM labels")
def share_of_good(spark, sf_dir):
    return stats.share_true(_table(spark, sf_dir, "labels"), F.col("quality") == 1)


@query(
    f"""WITH {_VEC}, r AS (SELECT e[1:3] AS l, CASE WHEN vec_id % 5 = 0 THEN NULL ELSE (vec_id % 3)::INT END AS y, (e[4] - e[5]) * (e[4] - e[5]) AS reg, vec_id % 4 = 0 AS has FROM v),
c AS (SELECT CASE WHEN y IS NOT NULL THEN ln(exp(l[1]) + exp(l[2]) + exp(l[3])) - l[y + 1] END AS ce, CASE WHEN has THEN reg END AS reg FROM r),
h AS (SELECT sum(ce / ln(3::DOUBLE)) / count(ce) AS tri, sum(reg) / count(reg) AS reg FROM c) SELECT round(tri, 6) AS tri, 0.0::DOUBLE AS bin, round(reg, 6) AS reg, round(tri + 2 * reg, 6) AS total FROM h"""
)
def head_losses(spark, sf_dir):
    """Three-way, two-way (no row has a label) and regression losses of vectors' components."""
    v = _vectors(spark, sf_dir).select("vec_id", F.transform("vec", lambda x: x.cast("double")).alias("e"))
    y = F.when(F.col("vec_id") % 5 == 0, F.lit(-100)).otherwise(F.col("vec_id") % 3)
    tri = stats.cross_entropy(F.slice("e", 1, 3), y)
    d = F.get("e", F.lit(3)) - F.get("e", F.lit(4))
    return stats.head_losses(v, {"tri": (tri, math.log(3), 1.0), "bin": (stats.cross_entropy(F.slice("e", 1, 2), F.lit(-100)), math.log(2), 1.0), "reg": (F.when(F.col("vec_id") % 4 == 0, d * d), 1.0, 2.0)})


_MARGINS = _SIM + """, o AS (SELECT batch_id, q, sim AS own FROM s WHERE q = d),
m AS (SELECT batch_id, q, own, max(sim) AS other, count(*) FILTER (sim > own) + 1 AS rank FROM s JOIN o USING (batch_id, q) WHERE q <> d GROUP BY 1, 2, 3)"""


@query(
    _MARGINS
    + """ SELECT round(avg(own), 6) AS pos_mean, round(avg(other), 6) AS neg_mean, round(avg(own - other), 6) AS margin_mean, round(stddev_pop(own - other), 6) AS margin_std,
round(avg((rank <= 1)::INT), 6) AS "hit@1", round(avg((rank <= 5)::INT), 6) AS "hit@5", round(avg((rank <= 10)::INT), 6) AS "hit@10", round(avg(1 / rank::DOUBLE), 6) AS mrr, count(*) AS n FROM m"""
)
def margin_diagnostics(spark, sf_dir):
    return stats.margins(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"))


@query(_SIM + ", b AS (SELECT batch_id, q, list(sim ORDER BY sim DESC) AS l FROM s GROUP BY 1, 2) SELECT batch_id, q, l[1] AS s1, l[2] AS s2, l[3] AS s3 FROM b")
def best_similarities(spark, sf_dir):
    return stats.best_similarities(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"))


@query(
    _SIM
    + """, o AS (SELECT batch_id, q, sim AS own FROM s WHERE q = d), b AS (SELECT batch_id, q, own, count(*) FILTER (sim > own) + 1 AS rank, list(sim ORDER BY sim DESC) AS l
FROM s JOIN o USING (batch_id, q) WHERE batch_id < 3 AND q < 8 GROUP BY 1, 2, 3) SELECT batch_id, q, own, rank, l[1] AS s1, l[2] AS s2, l[3] AS s3 FROM b"""
)
def validation_examples(spark, sf_dir):
    b = _batched(spark, sf_dir)
    return stats.examples(b, batch_eval.similarities(b, "vec", "pos"))


_DIST = "list_sum(list_transform(list_zip(e, o), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(e)"


@query(
    f"""WITH {_VEC}, p AS (SELECT a.e, b.e AS o FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2)
SELECT round(avg({_DIST}), 6) AS mse, round(avg(list_cosine_similarity(e, o)), 6) AS cosine, round(avg(1 - list_cosine_similarity(e, o)), 6) AS cosine_loss,
round(avg(sqrt(list_dot_product(e, e))), 6) AS student_norm, round(avg(sqrt(list_dot_product(o, o))), 6) AS teacher_norm, count(*) AS n FROM p"""
)
def distillation_metrics(spark, sf_dir):
    return stats.distillation(_triplets(spark, sf_dir), "vec", "pos")


@query(
    _SIM
    + """, t AS (SELECT *, max(sim * 20.0::DOUBLE) OVER (PARTITION BY batch_id, q) AS top FROM s),
l AS (SELECT batch_id, q, ln(sum(exp(sim * 20.0::DOUBLE - top))) + max(top) - max(CASE WHEN q = d THEN sim * 20.0::DOUBLE END) AS loss FROM t GROUP BY 1, 2),
a AS (SELECT batch_id, round(avg(loss), 6) AS loss FROM l GROUP BY 1), k AS (SELECT batch_id, avg(greatest(0.5::DOUBLE - list_cosine_similarity(e, o) + list_cosine_similarity(e, g), 0)) AS loss FROM p WHERE batch_id IN (SELECT batch_id FROM ok) GROUP BY 1)
SELECT batch_id, round(0.7::DOUBLE * a.loss + 0.3::DOUBLE * k.loss, 5) AS loss FROM a JOIN k USING (batch_id)"""
)
def loss_combined(spark, sf_dir):
    b = _batched(spark, sf_dir)
    triplet = b.groupBy("batch_id").agg(F.avg(batch_eval.triplet_loss("vec", "pos", "neg")).alias("loss"))
    return stats.combined_loss({"softmax": (batch_eval.in_batch_softmax_loss(batch_eval.similarities(b, "vec", "pos"), 20.0), 0.7), "triplet": (triplet, 0.3)})


@query(
    _NEXT
    + f" SELECT round(avg(v), 6) AS mean, count(*) AS n_sets FROM (SELECT name, avg(v) AS v FROM (SELECT label % 3 AS name, vec_id // {_BATCH} AS b, avg(sim) AS v FROM x GROUP BY 1, 2) GROUP BY 1)"
)
def mean_over_sets(spark, sf_dir):
    rows = _sims(spark, sf_dir).withColumn("name", F.col("label") % 3).withColumn("b", F.floor(F.col("vec_id") / _BATCH))
    return stats.mean_over_sets(rows, "name", "b", "sim")


_BATCH_BM25 = rf"""WITH p AS (SELECT doc_id // 400 AS batch_id, doc_id % 400 // 20 AS slot, {_TOKENS.format("text")} AS t FROM documents WHERE doc_id % 20 = 0),
ok AS (SELECT batch_id FROM p GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT batch_id, count(*) AS n, CASE WHEN sum(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS avgdl FROM p GROUP BY 1),
tf AS (SELECT batch_id, slot AS d, dl, term, count(*) AS tf FROM (SELECT batch_id, slot, len(t) AS dl, unnest(t) AS term FROM p) GROUP BY ALL),
te AS (SELECT batch_id, term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf, avgdl FROM tf JOIN w USING (batch_id) GROUP BY batch_id, term, n, avgdl),
q AS (SELECT DISTINCT batch_id, slot AS q, unnest(t[1:8]) AS term FROM p),
h AS (SELECT batch_id, q, d, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS sim FROM q JOIN tf USING (batch_id, term) JOIN te USING (batch_id, term) GROUP BY 1, 2, 3),
s AS (SELECT a.batch_id, a.slot AS q, b.slot AS d, coalesce(sim, 0) AS sim FROM p a JOIN p b USING (batch_id) LEFT JOIN h ON h.batch_id = a.batch_id AND h.q = a.slot AND h.d = b.slot WHERE a.batch_id IN (SELECT batch_id FROM ok)),
r AS (SELECT batch_id, q, d, row_number() OVER (PARTITION BY batch_id, q ORDER BY sim DESC, d) AS rank FROM s QUALIFY q = d)"""


@query(_BATCH_BM25 + " SELECT batch_id, q, rank FROM r")
def inbatch_bm25(spark, sf_dir):
    """The first eight words of every twentieth document against its batch's documents, by the batch's own BM25."""
    d = _table(spark, sf_dir, "documents").where("doc_id % 20 = 0").select((F.col("doc_id") / 20).cast("long").alias("pos"), "text")
    b = batch_eval.batches(d.withColumn("head", F.array_join(F.slice(T.word_tokens(F.col("text")), 1, 8), " ")), "pos", 20)
    return batch_eval.partner_ranks(stats.batch_bm25(b, "head", "text"), "row_number").select("batch_id", "q", "rank")


@query(
    _SIM
    + """, r AS (SELECT batch_id, q, d, rank() OVER (PARTITION BY batch_id, q ORDER BY sim DESC) AS rank FROM s QUALIFY q = d), m AS (SELECT batch_id, avg(1 / rank::DOUBLE) AS mrr, avg((rank <= 1)::INT) AS r1 FROM r GROUP BY 1)
SELECT 'dense' AS method, format('{:.4f}', round(avg(mrr), 6)) AS mrr, format('{:.4f}', round(avg(r1), 6)) AS "recall@1", '' AS other, '' AS error FROM m
UNION ALL SELECT 'broken', '', '', '', 'no index' """
)
def method_comparison(spark, sf_dir):
    dense = batch_eval.mean_of_batch_means(batch_eval.partner_ranks(batch_eval.similarities(_batched(spark, sf_dir), "vec", "pos"), "rank"))
    return stats.method_rows({"dense": dense, "broken": ValueError("no index")}, ["mrr", "recall@1", "other"])


# -- negatives -------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT DISTINCT text FROM benchmark WHERE text IS NOT NULL), p AS (SELECT text, row_number() OVER (ORDER BY md5('pos:' || text), text) - 1 AS at FROM d), m AS (SELECT count(*) AS m FROM d)
SELECT item_id, string_agg(o.text, '|' ORDER BY k) AS negatives FROM benchmark b JOIN p USING (text), m, range(1, 4) t(k) JOIN p o ON o.at = (p.at + k) % m.m WHERE k < m.m GROUP BY 1"""
)
def negatives_from_positives(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").where("text is not null")
    return negatives.from_positives(b, "item_id", "text", 3).select("item_id", F.array_join("negatives", "|").alias("negatives"))


@query(
    """WITH b AS (SELECT vec_id AS key, (label % 4)::VARCHAR AS domain, 'n' || (vec_id // 2) AS old, md5('fill:' || vec_id) AS h FROM embeddings),
p AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY h, key) AS near, count(*) OVER (PARTITION BY domain) AS nn, row_number() OVER (ORDER BY h, key) AS far, count(*) OVER () AS nf FROM b),
g AS (SELECT key, 0 AS kind, 0 AS k, old FROM p
UNION ALL SELECT a.key, 1, k, o.old FROM p a, range(1, 6) t(k) JOIN p o ON o.domain = a.domain AND o.near = (a.near - 1 + k) % a.nn + 1 WHERE k < a.nn
UNION ALL SELECT a.key, 2, k, o.old FROM p a, range(1, 6) t(k) JOIN p o ON o.far = (a.far - 1 + k) % a.nf + 1 WHERE k < a.nf),
u AS (SELECT key, old, min(kind * 100 + k) AS o FROM g GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o) AS r FROM u)
SELECT key AS vec_id, string_agg(old, '|' ORDER BY r) FILTER (r <= 5) AS negatives FROM w GROUP BY 1"""
)
def filled_negatives(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", (F.col("label") % 4).cast("string").alias("domain"), F.concat(F.lit("n"), F.floor(F.col("vec_id") / 2).cast("string")).alias("old"))
    return negatives.filled(rows, "vec_id", "domain", "old", 5).select("vec_id", F.array_join("negatives", "|").alias("negatives"))


# -- files written and read again ----------------------------------------------------------------

_DOCS = "SELECT doc_id, text, lang FROM documents"


def _docs(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


@query(_DOCS)
def jsonl_round_trip(spark, sf_dir):
    at = scratch(spark)
    sinks.write_jsonl(_docs(spark, sf_dir), at)
    return readers.read_jsonl(spark, at, "doc_id BIGINT, text STRING, lang STRING")


@query(_DOCS)
def parquet_round_trip(spark, sf_dir):
    at = f"{scratch(spark)}.parquet"
    sinks.write_parquet(_docs(spark, sf_dir), at)
    return readers.read_records(spark, at)


@query("SELECT vec_id, label FROM embeddings")
def csv_round_trip(spark, sf_dir):
    at = f"{scratch(spark)}.csv"
    sinks.write_csv(_vectors(spark, sf_dir).select("vec_id", "label"), at)
    return readers.read_records(spark, at, "label BIGINT, vec_id BIGINT")


@query("SELECT event_id::DOUBLE AS step, CASE WHEN event_id % 10 <> 0 THEN value END AS loss FROM events")
def curve_round_trip(spark, sf_dir):
    """The events' values as a curve in a CSV, some of them missing."""
    at = scratch(spark)
    sinks.write_csv(_table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("loss")), at)
    return readers.read_curve(spark, at)


def _collection(spark, sf_dir) -> str:
    """A folder with corpus, queries and judgements: documents, items, and each item's first three ids as judgements, one of score 0."""
    at = scratch(spark)
    d = _table(spark, sf_dir, "documents")
    d.select(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("title"), "text").write.json(f"{at}/corpus.jsonl")
    b = _table(spark, sf_dir, "benchmark")
    b.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{at}/queries.jsonl")
    judged = b.select("item_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    lines = judged.select(F.concat_ws("\t", "item_id", (F.col("item_id") * 3 + F.col("k")).cast("string"), F.when(F.col("k") == 1, "0").otherwise("1")).alias("value"))
    lines.union(spark.range(1).select(F.lit("query-id\tcorpus-id\tscore"))).write.text(f"{at}/qrels/test.tsv")
    return at


@query("SELECT doc_id::VARCHAR AS did, trim(concat_ws(' ', nullif(trim(coalesce(lang, '')), ''), nullif(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), ''))) AS text FROM documents")
def collection_corpus(spark, sf_dir):
    return readers.read_collection(spark, _collection(spark, sf_dir))[0]


@query("SELECT item_id::VARCHAR AS qid, text FROM benchmark")
def collection_queries(spark, sf_dir):
    return readers.read_collection(spark, _collection(spark, sf_dir))[1]


@query("SELECT item_id::VARCHAR AS qid, (item_id * 3 + k)::VARCHAR AS did FROM benchmark, (VALUES (0), (2)) t(k)")
def collection_qrels(spark, sf_dir):
    return readers.read_collection(spark, _collection(spark, sf_dir))[2]


@query("SELECT vec_id AS pos, label % 2 AS file_no, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def teacher_round_trip(spark, sf_dir):
    """Teacher vectors in two files, read one after the other."""
    v = _vectors(spark, sf_dir)
    paths = [scratch(spark) for _ in range(2)]
    for i, p in enumerate(paths):
        sinks.write_parquet(v.where(F.col("label") % 2 == i).select(F.lit("train").alias("split"), F.lit("text").alias("kind"), F.col("vec_id").alias("pos"), F.lit("").alias("text"), F.col("vec").cast("array<float>").alias("embedding")), p)
    got = readers.read_teacher(spark, paths)
    return got.select("pos", "file_no", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT 'a' AS dataset_name, doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 ORDER BY 1 LIMIT 30) UNION ALL SELECT 'b', doc_id FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 1 ORDER BY 1 LIMIT 30)")
def sized_union(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id")
    return readers.sized_union({"a": d.where("doc_id % 2 = 0"), "b": d.where("doc_id % 2 = 1")}, 30, "doc_id")


@query("SELECT doc_id FROM documents")
def tolerant_union(spark, sf_dir):
    """A source that can't be read is passed over, and one that is skipped by name."""
    d = _table(spark, sf_dir, "documents").select("doc_id")
    sources = records.without_sources({"even": d.where("doc_id % 2 = 0"), "odd": d.where("doc_id % 2 = 1"), "Twice": d}, ["twice"])
    loaders = {n: (lambda x=x: x) for n, x in sources.items()} | {"gone": lambda: spark.read.parquet(f"{sf_dir}/no-such-table.parquet")}
    return readers.tolerant_union(loaders, "skip")[0]


_PARAGRAPHS = "SELECT item_id, unnest([0, 1, 2]) AS local FROM benchmark"


@query(f"SELECT item_id::VARCHAR AS qid, local, 't' || local AS title, 't' || local || ' ' || 'one. ' || 'two ' || item_id AS text, local <> 1 AS is_gold FROM ({_PARAGRAPHS})")
def multi_paragraph_corpus(spark, sf_dir):
    return readers.paragraphs(_paragraphs(spark, sf_dir))[0]


@query("SELECT item_id::VARCHAR AS qid, text AS question, 'yes' AS answer FROM benchmark WHERE item_id % 2 = 0")
def multi_paragraph_questions(spark, sf_dir):
    odd = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("t0"), F.lit("t2"))).otherwise(F.array(F.lit("t0")))
    return readers.paragraphs(_paragraphs(spark, sf_dir, odd))[1]


def _paragraphs(spark, sf_dir, gold=None) -> DataFrame:
    """Items as questions with three paragraphs of two sentences each."""
    b = _table(spark, sf_dir, "benchmark")
    titles = F.array(*[F.lit(f"t{i}") for i in range(3)])
    sentences = F.array(*[F.array(F.lit("one."), F.concat(F.lit("two "), F.col("item_id").cast("string")))] * 3)
    facts = F.array(F.lit("t0"), F.lit("t2")) if gold is None else gold
    return b.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), F.lit("yes").alias("answer"), F.struct(titles.alias("title"), sentences.alias("sentences")).alias("context"), F.struct(facts.alias("title")).alias("supporting_facts"))


# -- chat records ---------------------------------------------------------------------------------


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "task_type", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"), F.coalesce("background", F.lit("")).alias("background"))


@query("SELECT 'w_' || item_id AS id, 'fact_checking' AS task_type, 'user=Is the following claim true or false? ' || text || '|assistant=' || CASE WHEN item_id % 2 = 0 THEN 'True' ELSE 'False' END AS messages, 'e' || item_id AS background FROM benchmark")
def chat_claims(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("claim"), F.when(F.col("item_id") % 2 == 0, "Supports").otherwise("refutes").alias("label"), F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("evidence"))
    return _flat(chat.claims(b, "w"))


_FORMS = ", ".join(repr(f) for f in chat.QUESTION_FORMS).replace("\\n", "' || chr(10) || '")
_FORM = f"list_value({_FORMS})[(('0x' || substr(md5('0:' || item_id), 1, 8))::BIGINT % {len(chat.QUESTION_FORMS)} + 1)::INT]"


@query(f"SELECT 's_' || item_id AS id, 'open_qa' AS task_type, 'user=' || trim(replace({_FORM}, '{{question}}', 'why ' || item_id)) || '|assistant=a' || item_id AS messages, '' AS background FROM benchmark")
def chat_short_answers(spark, sf_dir):
    b = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.concat(F.lit("why "), F.col("item_id").cast("string")).alias("question"), F.array(F.concat(F.lit("a"), F.col("item_id").cast("string")), F.lit("other")).alias("answers"))
    return _flat(chat.short_answer(b, "s"))


@query(f"SELECT 'm_' || item_id AS id, 'open_qa' AS task_type, 'user=' || trim(replace({_FORM}, '{{question}}', 'which' || chr(10) || 'A. x' || chr(10) || 'B. y')) || '|assistant=B' AS messages, '' AS background FROM benchmark")
def chat_multiple_choice(spark, sf_dir):
    choices = F.struct(F.array(F.lit("A"), F.lit("B")).alias("label"), F.array(F.lit("x"), F.lit("y")).alias("text")).alias("choices")
    return _flat(chat.multiple_choice(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("pos"), F.lit("which").alias("question"), choices, F.lit("B").alias("answerKey")), "m"))


@query("SELECT conv_id, string_agg(role || '=' || coalesce(text, ''), '|' ORDER BY turn) AS messages, count(*) AS n_turns FROM conversations GROUP BY 1")
def chat_conversations(spark, sf_dir):
    c = mixing.conversations(_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return c.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"), "n_turns")


@query("SELECT item_id, regexp_extract('http://x/entity/Q' || item_id || '/y', 'entity/(Q[0-9]+)', 1) AS entity, 'a-b-' || item_id AS slug, 'Say: ' || text AS prompt, 'T' || item_id || ': one two' AS titled FROM benchmark WHERE text IS NOT NULL")
def text_rules(spark, sf_dir):
    """Entity ids, slugs, prompts and titled documents."""
    b, n = _table(spark, sf_dir, "benchmark").where("text is not null"), F.col("item_id").cast("string")
    return b.select(
        "item_id", T.entity_id(F.concat(F.lit("http://x/entity/Q"), n, F.lit("/y"))).alias("entity"), T.slug(F.concat(F.lit(" A & B--"), n)).alias("slug"),
        T.prompt("Say: {document}", F.col("text")).alias("prompt"), T.titled_document(F.concat(F.lit("T"), n), F.array(F.lit("one"), F.lit("two"))).alias("titled"),
    )


@query(
    "SELECT 'd' AS dataset, metric, 'r' AS run_id, 'step_' || event_id AS split, value FROM (SELECT event_id, 'loss' AS metric, value FROM events UNION ALL SELECT event_id, 'gain', CASE WHEN value > 1 THEN -value END FROM events) WHERE value IS NOT NULL"
)
def history_rows(spark, sf_dir):
    """The events as a history of two values; one of them is often missing."""
    h = _table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), F.lit(0).alias("epoch"), F.col("value").alias("loss"), F.when(F.col("value") > 1, -F.col("value")).alias("gain"))
    return sinks.history_rows(h, "d", "r")


@query("SELECT item_id::VARCHAR AS qid, (item_id * 3 + k)::VARCHAR AS did FROM benchmark, (VALUES (0), (0), (2)) t(k) WHERE item_id % 5 <> 0 OR k <> 2")
def ordered_qrels(spark, sf_dir):
    """Judgements with a repeated line, one of score 0, and for some items a line of two fields."""
    at = scratch(spark)
    judged = _table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(*[F.lit(k) for k in (0, 0, 1, 2)])).alias("k"))
    score = F.when(F.col("k") == 1, "0").when((F.col("k") == 2) & (F.col("item_id") % 5 == 0), F.lit(None)).otherwise("1")
    lines = judged.select(F.concat_ws("\t", "item_id", (F.col("item_id") * 3 + F.col("k")).cast("string"), score).alias("value"))
    lines.union(spark.range(1).select(F.lit("query-id\tcorpus-id\tscore"))).write.text(at)
    return readers.read_ordered_qrels(spark, at).select("qid", "did")


_TEACH = "WITH q AS (SELECT *, row_number() OVER (ORDER BY item_id) AS r FROM benchmark), f AS (SELECT *, count(*) OVER () AS n FROM q WHERE r <= 30), s AS (SELECT *, CASE WHEN r > n - floor(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM f)"


@query(f"{_TEACH} SELECT split, 'query' AS kind, text FROM s UNION ALL SELECT DISTINCT split, 'document', 't' || k || ' one. two ' || item_id FROM s, range(2) t(k)")
def teacher_texts(spark, sf_dir):
    rows = _paragraphs(spark, sf_dir).withColumn("pos", F.col("id").cast("long"))
    return records.teacher_texts(rows.select(F.col("id").alias("qid"), "question", "pos"), readers.paragraphs(rows)[0], "pos", 30, 0.2, 2)


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(n * 0.3::DOUBLE)")
def head_shares(spark, sf_dir):
    return mixing.head_share(_table(spark, sf_dir, "documents").select("lang", "doc_id"), "doc_id", 0.3, "lang")


@query("SELECT doc_id, substr(coalesce(text, ''), 1, 100) AS short, CASE WHEN lang IS NULL THEN coalesce(text, '') ELSE 'Q: ' || lang || chr(10) || 'D: ' || coalesce(text, '') END AS conditioned FROM documents")
def prompt_texts(spark, sf_dir):
    """Texts cut for a table of examples, and as an encoder that knows the query reads them."""
    return _table(spark, sf_dir, "documents").select("doc_id", T.shortened("text", 100).alias("short"), T.conditioned(F.col("text"), F.col("lang")).alias("conditioned"))
