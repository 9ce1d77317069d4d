"""Registered queries of samples, the teacher store and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import align, batch_eval, dense, evaluation, ranking, records, sampling, stats
from lodestar.plans.catalog import _LONG, _QRELS, _SIM, _SPACE, _TOKENS, _VEC, _batched, _metric_sql, _table, _triplets, _vectors, contains_qrels, query
from lodestar.sources import readers
from lodestar.sources.sinks import scratch
from lodestar.sources.teacher import TeacherStore, concatenated, write_store

# -- samples -------------------------------------------------------------------------------

_MD5 = "md5('{0}:' || {1})"


@query(f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_MD5.format('s', 'doc_id')}, doc_id) <= 15")
def sampled_per_source(spark, sf_dir):
    return sampling.least(_table(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", "s", 15, "source")


@query(
    f"""WITH q AS (SELECT coalesce(text, '') AS query, row_number() OVER (ORDER BY {_MD5.format('7q', 'item_id')}, item_id) AS nth FROM benchmark),
d AS (SELECT coalesce(text, '') AS document, row_number() OVER (ORDER BY {_MD5.format('7d', 'doc_id')}, doc_id) AS nth FROM documents)
SELECT nth, md5(query) AS query, md5(document) AS document FROM q JOIN d USING (nth) WHERE nth <= 500"""
)
def sampled_pairs(spark, sf_dir):
    items, docs = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text"), _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sampling.paired(items, docs, "id", "text", 7, 500).select("nth", F.md5("query").alias("query"), F.md5("document").alias("document"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_MD5.format('3', 'doc_id')}, doc_id) - 1 AS place FROM documents")
def shuffled_documents(spark, sf_dir):
    return sampling.shuffled(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 3)


@query(
    f"""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_MD5.format('i', 'doc_id')}, doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY (r - 0.5::DOUBLE) / n, source NULLS FIRST, r) - 1 AS place FROM r"""
)
def interleaved_sources(spark, sf_dir):
    return sampling.interleaved(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", "i").select("doc_id", "source", "place")


@query(
    f"""WITH p AS (SELECT 'all' AS dataset_name, item_id AS id FROM benchmark UNION ALL SELECT 'half', doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.5::DOUBLE)
UNION ALL SELECT 'few', page_id FROM (SELECT page_id, row_number() OVER (ORDER BY page_id) AS r FROM pages) WHERE r <= 25)
SELECT dataset_name, id, row_number() OVER (ORDER BY {_MD5.format('m', "dataset_name || ':' || id")}, dataset_name || ':' || id) - 1 AS place FROM p"""
)
def mixed_datasets(spark, sf_dir):
    """Three data sets under one another: one whole, half of one, the first rows of one."""
    of = lambda table, key: _table(spark, sf_dir, table).select(F.col(key).alias("id"))
    parts = {"all": of("benchmark", "item_id"), "half": of("documents", "doc_id"), "few": of("pages", "page_id")}
    return sampling.mixed_datasets(parts, "id", "m", {"half": 0.5, "few": 25}, "id").select("dataset_name", "id", "place")


# -- the teacher store -----------------------------------------------------------------------


def _store(spark, sf_dir) -> TeacherStore:
    v = _vectors(spark, sf_dir)
    path = scratch(spark)
    rows = v.select(F.concat(F.lit("g"), F.col("label") % 3).alias("group"), F.col("vec_id").alias("pos"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"), F.col("vec").alias("embedding"))
    write_store(rows, path, {"teacher_model_name": "given vectors", "pooling": "mean"}, 20_000)
    return TeacherStore(spark, path)


_TOTAL = "round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4)"


def _total(c: str):
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)


@query(f"SELECT 'g' || (label % 3) AS \"group\", vec_id AS pos, 'text ' || vec_id AS text, {_TOTAL} AS total, 'mean' AS pooling FROM embeddings WHERE label % 3 <> 1")
def teacher_groups(spark, sf_dir):
    """Two groups of a store and an attribute beside them."""
    store = _store(spark, sf_dir)
    return store.rows("g0", "g2").select("group", "pos", "text", _total("embedding").alias("total"), F.lit(store.attributes()["pooling"]).alias("pooling"))


@query(f"SELECT 'g' || (label % 3) AS \"group\", vec_id AS pos, {_TOTAL} AS total FROM embeddings JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') ON vec_id = doc_id WHERE label % 3 = 2")
def teacher_lookup(spark, sf_dir):
    """The vectors of group g2 that English documents ask for."""
    wanted = _table(spark, sf_dir, "documents").where("lang = 'en'").select(F.lit("g2").alias("group"), F.col("doc_id").alias("pos"))
    return _store(spark, sf_dir).lookup(wanted).select("group", "pos", _total("embedding").alias("total"))


@query(
    """WITH g AS (SELECT vec_id AS pos, row_number() OVER (ORDER BY vec_id) - 1 AS nth, count(*) OVER () AS n FROM embeddings WHERE label % 3 = 0)
SELECT f AS file_no, pos, CASE WHEN nth >= n - floor(n * 0.05::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM g, (VALUES (0), (1)) t(f)"""
)
def teacher_concat(spark, sf_dir):
    """A group of two stores one after the other, each with its own tail as validation rows."""
    store = _store(spark, sf_dir)
    return concatenated([store, store], "g0").select("file_no", "pos", "split")


# -- augmentation ------------------------------------------------------------------------------

_TASKS = list(align.TASKS)
_U = "(('0x' || substr(md5('align{0}:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_PICK = "{0}[floor({1} * len({0}))::INT + 1]"


def _case(values: dict[str, str], what: str) -> str:
    return "CASE " + " ".join(f"WHEN {what} = '{k}' THEN '{v}'" for k, v in values.items()) + " END"


_AUGMENTED = f"""WITH t AS (SELECT list_value({", ".join(f"'{t}'" for t in _TASKS)}) AS t),
x AS (SELECT doc_id AS id, t[doc_id % {len(_TASKS)} + 1] AS task, coalesce(text, '') AS a, [source || ' ' || doc_id, coalesce(text, '') || '.'] AS b,
  CASE WHEN doc_id % 3 = 0 THEN NULL ELSE [lang || doc_id, 'c' || doc_id] END AS c, (doc_id % 4 - 1)::DOUBLE AS y FROM documents, t),
k AS (SELECT *, {_case({t: k for t, (k, _) in align.TASKS.items()}, "task")} AS kind, {_case({t: h for t, (_, h) in align.TASKS.items()}, "task")} AS how, {_U.format("self")} AS u_self, {_U.format("swap")} AS u_swap, {_U.format("half")} < 0.5 AS positive,
  coalesce(lead(b[1]) OVER w, first_value(b[1]) OVER w) AS other FROM x WINDOW w AS (PARTITION BY task ORDER BY md5('alignnext:' || id), id)),
l AS (SELECT *, CASE WHEN kind = 'tri' AND y = -1 THEN 1 ELSE y END AS label, task IN ('nli', 'fact_checking', 'paraphrase') AS self, {_PICK.format("b", _U.format("pos"))} AS b_pos, coalesce({_PICK.format("c", _U.format("neg"))}, other) AS neg FROM k),
s AS (SELECT *, self AND u_self < 0.05 AS same FROM l), w AS (SELECT *, self AND NOT same AND u_swap < 0.05 AND (kind = 'bin' OR label = 2) AS swap,
  CASE how WHEN 'with_c' THEN concat_ws(' ', b[1], c[1]) WHEN 'any' THEN b_pos WHEN 'sampled' THEN CASE WHEN positive THEN b_pos ELSE neg END WHEN 'first_or_sampled' THEN CASE WHEN positive THEN b[1] ELSE neg END ELSE b[1] END AS bb,
  CASE WHEN same THEN CASE WHEN kind = 'tri' THEN 0 ELSE 1 END WHEN how IN ('sampled', 'first_or_sampled') THEN positive::INT ELSE label END AS yy FROM s)
SELECT id, task, md5(CASE WHEN swap THEN bb ELSE a END) AS text_a, md5(CASE WHEN same OR swap THEN a ELSE bb END) AS text_b, {", ".join(f"CASE WHEN kind = '{k}' THEN yy::DOUBLE ELSE -100 END AS {k}" for k in ("tri", "bin", "reg"))} FROM w"""


@query(_AUGMENTED)
def augmented_tasks(spark, sf_dir):
    """Every document as an example of one of the 13 tasks."""
    d = _table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = d.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(*[F.lit(t) for t in _TASKS]), (F.col("doc_id") % len(_TASKS) + 1).cast("int")).alias("task"),
        text.alias("text_a"),
        F.array(F.concat("source", F.lit(" "), F.col("doc_id")), F.concat(text, F.lit("."))).alias("text_b"),
        F.when(F.col("doc_id") % 3 != 0, F.array(F.concat("lang", F.col("doc_id")), F.concat(F.lit("c"), F.col("doc_id")))).alias("text_c"),
        (F.col("doc_id") % 4 - 1).cast("double").alias("orig_label"),
    )
    made = align.augmented(rows)
    return made.select("id", "task", F.md5("text_a").alias("text_a"), F.md5("text_b").alias("text_b"), "tri", "bin", "reg")


# -- short passages ------------------------------------------------------------------------------

_UNIT = "list_transform({0}, lambda x: x / CASE WHEN list_dot_product({0}, {0}) = 0 THEN 1 ELSE sqrt(list_dot_product({0}, {0})) END)"


def _short_pairs(spark, sf_dir):
    """Documents of 1 to 70 pieces with their own vector, asked for by the vector after it."""
    d = _table(spark, sf_dir, "documents").where(F.size(T.space_tokens(F.col("text"))).between(1, 70)).select("doc_id")
    v = _vectors(spark, sf_dir).select("vec_id", V.unit(F.col("vec")).alias("vec"))
    asked = v.select((F.col("vec_id") - 1).alias("doc_id"), F.col("vec").alias("q_vec"))
    return d.join(v.select(F.col("vec_id").alias("doc_id"), F.col("vec").alias("d_vec")), "doc_id").join(asked, "doc_id")


@query(
    f"""WITH {_VEC}, x AS (SELECT doc_id, {_UNIT.format("a.e")} AS de, {_UNIT.format("b.e")} AS qe FROM documents JOIN v a ON a.vec_id = doc_id JOIN v b ON b.vec_id = doc_id + 1 WHERE len({_SPACE.format("text")}) BETWEEN 1 AND 70),
s AS (SELECT q.doc_id AS qid, d.doc_id AS did, round(list_dot_product(q.qe, d.de), 6) AS score FROM x q, x d),
run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM s), deep AS (SELECT * FROM run WHERE rank <= 20), own AS (SELECT doc_id AS qid, doc_id AS did FROM x),
{_metric_sql("deep", "own")}, {_LONG},
n AS (SELECT qid, avg(score) AS neg FROM deep WHERE rank <= 10 AND qid <> did GROUP BY 1), p AS (SELECT score AS pos, neg FROM s LEFT JOIN n USING (qid) WHERE s.qid = s.did)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM lo GROUP BY 1
UNION ALL SELECT 'positive_similarity', round(avg(pos), 6), round(stddev_pop(pos), 6) FROM p UNION ALL SELECT 'negative_similarity', round(avg(neg), 6), round(stddev_pop(neg), 6) FROM p
UNION ALL SELECT 'similarity_diff', round(avg(pos) - avg(neg), 6), NULL FROM p"""
)
def short_passages(spark, sf_dir):
    """Retrieval of short passages by their own queries, with similarity statistics."""
    pairs = _short_pairs(spark, sf_dir)
    run = dense.search(pairs.select(F.col("doc_id").alias("vec_id"), F.col("d_vec").alias("vec")), pairs.select(F.col("doc_id").alias("vec_id"), F.col("q_vec").alias("vec")), 20, skip_self=False)
    return ranking.self_retrieval_report(run, pairs, "doc_id", "q_vec", "d_vec")


# -- judgements, losses, files --------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'incorrect' ELSE 'correct' END AS label, quality * 0.5::DOUBLE AS score FROM labels")
def judge_verdicts_in_words(spark, sf_dir):
    """Answers with other braces, and braces inside strings, around the object."""
    body = F.to_json(F.struct(F.when(F.col("toxic") == 1, "INCORRECT").otherwise("Correct").alias("label"), (F.col("quality") * 0.5).alias("score"), F.lit('as {asked} in "}" or {').alias("reason")))
    payload = F.concat(F.lit('Use {this} and { that: {"note": 1} '), body, F.lit(' {"label": "later"}} or }'))
    return _table(spark, sf_dir, "labels").select("doc_id", records.verdict(payload).alias("v")).select("doc_id", "v.label", "v.score")


@query("SELECT item_id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'a' || item_id || ' OR b' WHEN item_id % 3 = 1 THEN 'only ' || item_id ELSE '' END AS golden FROM benchmark WHERE text IS NOT NULL")
def qa_payloads(spark, sf_dir):
    """Questions with several reference answers, a single one, or none."""
    b = _table(spark, sf_dir, "benchmark").where("text is not null")
    number = F.col("item_id").cast("string")
    several = F.when(F.col("item_id") % 3 == 0, F.array(F.concat(F.lit("a"), number), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    payload = F.to_json(F.struct(F.col("text").alias("question"), several.alias("reference_answers"), F.when(F.col("item_id") % 3 == 1, F.concat(F.lit("only "), number)).alias("reference_answer")))
    return b.select("item_id", records.qa_payload(payload).alias("p")).select("item_id", "p.question", "p.golden")


@query(
    f"""WITH {_VEC}, r AS (SELECT a.e, b.e AS o, row_number() OVER (ORDER BY {_MD5.format('0', 'a.vec_id')}, a.vec_id) AS at, count(*) OVER () AS n FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 JOIN v c ON c.vec_id = a.vec_id + 2)
SELECT round(avg(list_cosine_similarity(x.e, x.o)), 6) AS cosine, round(avg(list_cosine_similarity(x.e, y.o)), 6) AS cosine_shuffled, count(*) AS n FROM r x JOIN r y ON y.at = x.at % x.n + 1"""
)
def distillation_shuffled(spark, sf_dir):
    return stats.shuffled_cosine(_triplets(spark, sf_dir), "vec_id", "vec", "pos", 0)


@query(
    _SIM
    + """, t AS (SELECT *, max(sim * 20.0::DOUBLE) OVER (PARTITION BY batch_id, q) AS top FROM s),
l AS (SELECT batch_id, q, ln(sum(exp(sim * 20.0::DOUBLE - top))) + max(top) - max(CASE WHEN q = d THEN sim * 20.0::DOUBLE END) AS loss FROM t GROUP BY 1, 2),
m AS (SELECT batch_id, round(avg(loss), 6) AS mnr FROM l GROUP BY 1), u AS (SELECT batch_id, max(slot) + 1 AS w FROM p WHERE batch_id IN (SELECT batch_id FROM ok) GROUP BY 1),
k AS (SELECT batch_id, slot, e AS st, o AS te FROM p JOIN u USING (batch_id) UNION ALL SELECT batch_id, slot + w, o, g FROM p JOIN u USING (batch_id)),
ss AS (SELECT q.batch_id, q.slot AS q, d.slot AS d, round(list_dot_product(q.st, d.st), 6) / 2.0::DOUBLE AS s, round(list_dot_product(q.te, d.te), 6) / 2.0::DOUBLE AS t FROM k q JOIN k d USING (batch_id)),
z AS (SELECT *, s - ln(sum(exp(s)) OVER w) AS ls, t - ln(sum(exp(t)) OVER w) AS lt FROM ss WINDOW w AS (PARTITION BY batch_id, q)),
y AS (SELECT batch_id, round(sum(exp(lt) * (lt - ls)) / count(DISTINCT q) * 4.0::DOUBLE, 6) AS kl FROM z GROUP BY 1)
SELECT batch_id, mnr, kl, round(mnr + 0.5::DOUBLE * kl, 5) AS loss FROM m JOIN y USING (batch_id)"""
)
def loss_ranking_distilled(spark, sf_dir):
    """Ranking loss of (vector, next one) and half the KL to a teacher that is one vector ahead."""
    return batch_eval.ranking_distilled_loss(_batched(spark, sf_dir), ("vec", "pos"), ("pos", "neg"), 0.5)


@query("SELECT doc_id::VARCHAR AS did, md5(trim(coalesce(lang, '') || ' ' || coalesce(text, ''))) AS text FROM documents")
def corpus_gz(spark, sf_dir):
    """A corpus in compressed lines."""
    at = f"{scratch(spark)}/corpus.jsonl.gz"
    _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("title"), "text").write.option("compression", "gzip").json(at)
    return readers.read_corpus(spark, at).select("did", F.md5("text").alias("text"))


# -- collections ------------------------------------------------------------------------------------


def _collections(spark, sf_dir) -> dict:
    """Documents in two folders by the parity of their ids, each with all items as queries; a document that contains an item is relevant."""
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    judged = contains_qrels(spark, sf_dir).join(docs.select(F.col("doc_id").alias("did"), (F.col("doc_id") % 2).alias("part")), "did")
    judged.write.partitionBy("part").parquet(at := scratch(spark))
    judged = spark.read.parquet(at)
    out = {}
    for part, name in enumerate(("even", "odd")):
        folder = scratch(spark)
        docs.where(F.col("doc_id") % 2 == part).select(F.col("doc_id").cast("string").alias("_id"), F.col("lang").alias("title"), "text").write.json(f"{folder}/corpus.jsonl")
        items.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{folder}/queries.jsonl")
        lines = judged.where(F.col("part") == part).select(F.concat_ws("\t", "qid", "did", F.lit("1")).alias("value"))
        lines.unionByName(spark.range(1).select(F.lit("query-id\tcorpus-id\tscore").alias("value"))).write.text(f"{folder}/qrels/test.tsv")
        out[name] = readers.read_collection(spark, folder)
    return out


_TEXT = "trim(concat_ws(' ', nullif(trim(coalesce(lang, '')), ''), nullif(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')))"
_TWO = f"""WITH tok AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS ds, doc_id::VARCHAR AS did, {_TOKENS.format(_TEXT)} AS t FROM documents),
st AS (SELECT ds, count(*) AS n, CASE WHEN sum(len(t)) > 0 THEN avg(len(t)) ELSE 1 END AS avgdl FROM tok GROUP BY 1),
tf AS (SELECT ds, did, dl, term, count(*) AS tf FROM (SELECT ds, did, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT ds, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, avgdl FROM (SELECT ds, term, count(*) AS df FROM tf GROUP BY 1, 2) JOIN st USING (ds)),
q AS (SELECT DISTINCT qid, unnest(t) AS term FROM (SELECT item_id::VARCHAR AS qid, {_TOKENS.format("text")} AS t FROM benchmark)),
sc AS (SELECT ds, qid, did, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (ds, term) GROUP BY 1, 2, 3),
deep AS (SELECT ds || ':' || qid AS qid, did, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY ds, qid ORDER BY score DESC, did) AS rank FROM sc) WHERE rank <= 20),
{_QRELS}, judged AS (SELECT CASE WHEN did % 2 = 0 THEN 'even:' ELSE 'odd:' END || qid AS qid, did::VARCHAR AS did FROM qrels)"""


@query(
    f"""{_TWO}, {_metric_sql("deep", "judged")}, {_LONG}, m AS (SELECT split_part(qid, ':', 1) AS dataset, metric AS name, avg(value) AS value, count(*) AS n FROM lo GROUP BY 1, 2),
u AS (SELECT * FROM m UNION ALL SELECT 'average', name, avg(value), count(*) FROM m GROUP BY name)
SELECT dataset, split_part(name, '@', 1) AS metric, try_cast(nullif(split_part(name, '@', 2), '') AS INTEGER) AS k, round(value, 6) AS value, n, 'bm25' AS run_id, 'test' AS split, 'bf21a9e8fb' AS encoder_fingerprint FROM u"""
)
def collections_report(spark, sf_dir):
    """BM25 over two collections with counts of their own: every metric of each, and the average."""
    run, qrels = evaluation.runs(_collections(spark, sf_dir), evaluation.bm25)
    return evaluation.report(run, qrels, "bm25")


@query(
    f"""{_TWO} SELECT split_part(qid, ':', 1) AS dataset, split_part(qid, ':', 2) AS qid, string_agg(did, ',' ORDER BY rank) AS results,
{", ".join(f'bool_or(rank <= {k} AND (qid, did) IN (SELECT qid, did FROM judged)) AS hit_{k}' for k in (1, 5, 10))} FROM deep d GROUP BY d.qid"""
)
def collections_details(spark, sf_dir):
    """The first documents of every query in each collection, and whether a relevant one is among them."""
    run, qrels = evaluation.runs(_collections(spark, sf_dir), evaluation.bm25)
    rows = evaluation.details(run, qrels)
    return rows.select("dataset", "qid", F.array_join(F.transform("results", lambda r: r["did"]), ",").alias("results"), *[F.col(f"`hit@{k}`").alias(f"hit_{k}") for k in (1, 5, 10)])
