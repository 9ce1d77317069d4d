"""Command line: python -m lodestar.cli COMMAND --help."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar.operators import answers, clusters, dense, evaluation, lexical, mixing, models, negatives, ranking, sampling
from lodestar.sources import readers, sinks
from lodestar.sources.teacher import encoded_store
from lodestar.streaming.runs import RunBoard


def session(name: str = "lodestar") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def evaluate(spark, a) -> None:
    rows = readers.read_records(spark, a.input)
    if a.task == "qa":
        sinks.write_json(answers.in_accuracy(rows, a.prediction, a.answer).agg(F.avg(F.col("correct").cast("int")).alias("in_accuracy"), F.count("*").alias("count")).first().asDict(), a.output)
        return
    measured = answers.simple_metrics(rows, a.original, a.candidate).withColumn("char_sim", F.when(F.col("jaccard").isNotNull(), answers.char_similarity(a.original, a.candidate)))
    sinks.write_json(answers.simple_means(measured, ("char_sim",)).first().asDict(), a.output)


def build_index(spark, a) -> None:
    rows = readers.read_records(spark, a.input).where(F.col(a.text).isNotNull() & (F.col(a.text) != ""))
    if a.kind == "bm25":
        lexical.build(rows, a.id, a.text, path=a.output)
        return
    vectors = models.encode(rows.select(a.id, a.text), a.text, a.encoder).select(F.col(a.id).alias("id"), "vec")
    if a.kind == "ivf":
        numbered = vectors.select(F.col("id").cast("long").alias("vec_id"), "vec")
        clusters.build(numbered, lists=a.lists or max(1, min(100, numbered.count() // 10))).save(a.output)
        return
    sinks.write_index(mixing.numbered(vectors, "id"), a.output, encoder=a.encoder, text_col=a.text, id_col=a.id)


def evaluate_collection(spark, a) -> None:
    corpus, queries, qrels = readers.read_collection(spark, a.folder, a.split)
    if a.kind == "bm25":
        run = lexical.search(lexical.build(corpus, "did", "text"), queries, "qid", "text", a.depth)
    else:
        enc = lambda d, k: models.encode(d, "text", a.encoder).select(F.xxhash64(k).alias("vec_id"), "vec", k)
        d, q = enc(corpus, "did"), enc(queries, "qid")
        found = dense.search(d, q, a.depth, skip_self=False).withColumnsRenamed({"qid": "q", "did": "d"})
        run = found.join(q.select(F.col("vec_id").alias("q"), "qid"), "q").join(d.select(F.col("vec_id").alias("d"), "did"), "d").select("qid", "did", "rank", "score")
    sinks.write_metrics(ranking.means(ranking.per_query(run, qrels)), a.output, a.kind, a.folder.rstrip("/").rpartition("/")[2], a.kind, a.split)


def evaluate_collections(spark, a) -> None:
    """Rows of every collection and their average as CSV, each query's details as JSON lines beside them."""
    found = {f.rstrip("/").rpartition("/")[2]: readers.read_collection(spark, f, a.split) for f in a.folders}
    run, qrels = evaluation.runs(found, evaluation.bm25 if a.kind == "bm25" else evaluation.encoded(a.encoder), a.depth)
    sinks.write_csv(evaluation.report(run, qrels, a.run_id, a.split, None if a.kind == "bm25" else {"encoder": a.encoder}), f"{a.output}/metrics")
    sinks.write_jsonl(evaluation.details(run, qrels), f"{a.output}/details")


def follow_runs(spark, a) -> None:
    """Takes in what is new in a folder of run records, and writes the board."""
    board = RunBoard(spark, a.board, higher=not a.lower)
    board.follow(spark.readStream.schema("run string, step long, value double").json(a.records))
    if board.best() is not None:
        board.best().write.mode("overwrite").json(a.output)


def teacher_store(spark, a) -> None:
    rows = mixing.numbered(readers.read_records(spark, a.input).where(F.col(a.text).isNotNull() & (F.col(a.text) != "")), a.id)
    encoded_store(rows, a.text, lambda d: models.encode(d, "text", a.encoder), a.output, {"teacher_model_name": a.encoder})


def mix(spark, a) -> None:
    parts = {p.rstrip("/").rpartition("/")[2].split(".")[0]: readers.read_records(spark, p) for p in a.inputs}
    if a.keep_proportions:
        every = sampling.mixed_datasets(parts, a.key, a.seed).drop("place")
        mixed = sampling.interleaved(every, "dataset_name", a.key, a.seed)
    else:
        mixed = sampling.mixed_datasets(parts, a.key, a.seed, {n: a.size for n in parts} if a.size else None, a.key)
    sinks.write_parquet(mixed, a.output)


def mine(spark, a) -> None:
    corpus, queries, qrels = readers.read_corpus(spark, a.corpus), readers.read_queries(spark, a.queries), readers.read_qrels(spark, a.qrels)
    asked = queries.join(qrels.select("qid").distinct(), "qid", "left_semi")
    best = negatives.mined_from(lexical.build(corpus, "did", "text"), asked, "qid", "text", qrels, a.n)
    fill = negatives.hashed(asked.select("qid"), corpus.select("did"), qrels, a.random, a.seed)
    chosen = negatives.mixed(best, fill, a.n, a.random).join(corpus, "did").groupBy("qid").agg(F.collect_list("text").alias("negatives"))
    sinks.write_jsonl(readers.first_positive(asked, qrels, corpus).join(chosen, "qid", "left"), a.output)


def split(spark, a) -> None:
    sinks.write_parquet(mixing.hash_split(readers.read_records(spark, a.input), a.key, a.seed, a.share), a.output)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestar", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, f, *args: tuple[str, dict]) -> None:
        s = sub.add_parser(name)
        for flag, options in args:
            s.add_argument(flag, **options)
        s.set_defaults(run=f)

    need = {"required": True}
    add("evaluate", evaluate, ("--task", {"choices": ["qa", "paraphrase"], **need}), ("--input", need), ("--output", need), ("--prediction", {"default": "answer"}), ("--answer", {}), ("--original", {"default": "s_wiki_content"}), ("--candidate", {"default": "paraphrase"}))
    add("build-index", build_index, ("--input", need), ("--output", need), ("--kind", {"choices": ["bm25", "dense", "ivf"], "default": "dense"}), ("--lists", {"type": int}), ("--encoder", {"default": "hashing"}), ("--text", {"default": "s_wiki_content"}), ("--id", {"default": "id"}))
    add("evaluate-collection", evaluate_collection, ("--folder", need), ("--output", need), ("--split", {"default": "test"}), ("--kind", {"choices": ["bm25", "dense"], "default": "bm25"}), ("--encoder", {"default": "hashing"}), ("--depth", {"type": int, "default": 100}))
    add("evaluate-collections", evaluate_collections, ("--folders", {"nargs": "+", **need}), ("--output", need), ("--split", {"default": "test"}), ("--kind", {"choices": ["bm25", "dense"], "default": "bm25"}), ("--encoder", {"default": "hashing"}), ("--depth", {"type": int, "default": 20}), ("--run-id", {"default": "run"}))
    add("follow-runs", follow_runs, ("--records", need), ("--board", need), ("--output", need), ("--lower", {"action": "store_true"}))
    add("teacher-store", teacher_store, ("--input", need), ("--output", need), ("--encoder", {"default": "hashing"}), ("--text", {"default": "text"}), ("--id", {"default": "id"}))
    add("mix", mix, ("--inputs", {"nargs": "+", **need}), ("--output", need), ("--key", need), ("--seed", {"default": "42"}), ("--size", {"type": int}), ("--keep-proportions", {"action": "store_true"}))
    add("mine-negatives", mine, ("--corpus", need), ("--queries", need), ("--qrels", need), ("--output", need), ("--n", {"type": int, "default": 3}), ("--random", {"type": int, "default": 2}), ("--seed", {"default": "42"}))
    add("split", split, ("--input", need), ("--output", need), ("--key", need), ("--share", {"type": float, "default": 0.1}), ("--seed", {"default": "42"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    a.run(session(), a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
