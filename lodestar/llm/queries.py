"""The operators' queries over the whole documents table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import exact, fingerprints, funnels, jaccard, licenses, lm, packing, pieces, quality, substrings, tokens, toxicity, variants
from lodestar.llm.common import crc_remainder, documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(documents(spark, sf_dir))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(documents(spark, sf_dir).select("doc_id", "text"), _vocabulary("byte_bpe_50k.json"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    carry = {"doc_id": F.col("doc_id").cast("long"), "n_bytes": F.octet_length(F.coalesce("text", F.lit(""))).cast("long")}
    counted = tokens.count_tokens(documents(spark, sf_dir).select("doc_id", "text"), _vocabulary("word_bpe_49k.json"), carry=carry)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), docs)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), toxicity.FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, sf_dir), _vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_classes(documents(spark, sf_dir))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


def op13_funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.funnel_counts(spark.read.parquet(f"{sf_dir}/clicks.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_license_scan, op2_document_fingerprints, op3_lm_scoring, op4_substring_dedup, op5_token_counts, op6_sentencepiece, op7_ngram_jaccard_join, op8_toxicity, op9_quality_rules, op10_best_fit_packing, op11_exact_dedup, op12_spelling_variants, op13_funnel_counts]
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


#: Links and their components from the definition: all five-word shingles, joined.
_JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id <> b.doc_id
), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS class_id,
  (SELECT count(*) FROM l WHERE l.a = doc_id) AS n_links FROM documents
"""


_EXACT = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""


def _next_step(k: int) -> str:
    """CTE s<k>: the attempts that reach step k, from those of the step before."""
    kinds = "".join(f", a.k{i}" for i in range(2, 5))
    return f"""n{k} AS (SELECT a.funnel, a.client_id, a.begun, a.t AS was, e.t AS t{kinds}, a.x FROM s{k - 1} a ASOF JOIN e ON a.client_id = e.client_id AND a.k{k} = e.kind AND a.t < e.t),
x{k} AS (SELECT a.*, e.t AS stop FROM n{k} a ASOF LEFT JOIN e ON a.client_id = e.client_id AND a.x = e.kind AND a.was < e.t),
s{k} AS (SELECT * EXCLUDE (stop) FROM x{k} WHERE t - begun <= 1800000000 AND (stop IS NULL OR stop > t))"""


_FUNNELS = f"""
WITH e AS (SELECT DISTINCT client_id, kind, epoch_us(arrived_at) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND arrived_at IS NOT NULL),
f(funnel, k1, k2, k3, k4, x) AS (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
s1 AS (SELECT funnel, client_id, t AS begun, t AS was, t, k2, k3, k4, x FROM e JOIN f ON kind = k1),
{_next_step(2)},
{_next_step(3)},
{_next_step(4)},
r AS (SELECT funnel, client_id, 1 AS step, 0 AS dt FROM s1 {" ".join(f"UNION ALL SELECT funnel, client_id, {k}, t - was FROM s{k}" for k in (2, 3, 4))}),
p AS (SELECT funnel, client_id, step, count(*) AS n, list_sort(list(dt))[(90 * count(*) + 99) // 100] AS p FROM r GROUP BY ALL),
c AS (SELECT funnel, client_id, {", ".join(f"coalesce(max(n) FILTER (step = {k}), 0) AS n{k}" for k in (1, 2, 3, 4))}, max(step) AS deepest,
  {", ".join(f"max(p) FILTER (step = {k}) AS t{k}" for k in (2, 3, 4))} FROM p GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_ngram_jaccard_join": _JACCARD, "op11_exact_dedup": _EXACT, "op13_funnel_counts": _FUNNELS}
