"""Sources with declared schemas."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce
from pathlib import PurePosixPath

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import entity_id

#: Declared shapes (DDL) by kind of record.
SCHEMAS = {
    "qa": "id BIGINT, subj STRING, question STRING, obj STRING, possible_answers ARRAY<STRING>, s_wiki_title STRING, o_wiki_title STRING, s_uri STRING, o_uri STRING, s_pop BIGINT, s_wiki_content STRING, o_wiki_content STRING",
    "corpus": "_id STRING, title STRING, text STRING",
    "queries": "_id STRING, text STRING",
    "triplet": "query STRING, positive STRING, negative STRING",
    "multi_negative": "query STRING, positive STRING, negatives ARRAY<STRING>, domain STRING",
    "passage_group": "query STRING, passages STRUCT<passage_text: ARRAY<STRING>, is_selected: ARRAY<INT>>",
    "multi_paragraph": "id STRING, question STRING, answer STRING, context STRUCT<title: ARRAY<STRING>, sentences: ARRAY<ARRAY<STRING>>>, supporting_facts STRUCT<title: ARRAY<STRING>>",
    "chat": "id STRING, task_type STRING, messages ARRAY<STRUCT<role: STRING, content: STRING>>, background STRING, meta MAP<STRING, STRING>",
    "alignment": "task STRING, dataset_name STRING, text_a STRING, text_b ARRAY<STRING>, text_c ARRAY<STRING>, orig_label DOUBLE",
    "teacher": "split STRING, kind STRING, pos BIGINT, text STRING, embedding ARRAY<FLOAT>",
}


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One JSON object a line, .gz too; blank lines are skipped."""
    reader = spark.read.option("mode", mode)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that holds one JSON list; anything else is an error."""
    head = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", "^\\s+", "")), 1, 1).alias("c")).distinct().collect()  # a character per file
    if any(r["c"] != "[" for r in head):
        raise ValueError(f"{path} doesn't hold a list")
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By suffix: .jsonl, .jsonl.gz, .json, .parquet, .csv, .tsv; any other is an error."""
    suffixes = PurePosixPath(path).suffixes
    kind = suffixes[-2] if suffixes[-1:] == [".gz"] and len(suffixes) > 1 else (suffixes[-1] if suffixes else "")
    if kind == ".jsonl":
        return read_jsonl(spark, path, schema)
    if kind == ".json":
        return read_json(spark, path, schema)
    if kind == ".parquet":
        return read_parquet(spark, path)
    if kind in (".csv", ".tsv"):
        reader = spark.read.option("header", True).option("sep", "\t" if kind == ".tsv" else ",")
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unsupported records file {path}")


def last_wins(df: DataFrame, key: str, pos: str) -> DataFrame:
    """Of rows with the same key the last by position, without pos."""
    cols = [c for c in df.columns if c != pos]
    return df.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*cols), F.col(pos)).alias("r")).select("r.*")


def document_text(title: Column, text: Column) -> Column:
    """Title and text, those that aren't blank, joined by a space."""
    parts = [F.regexp_replace(F.coalesce(c, F.lit("")), r"^(?U)\s+|(?U)\s+$", "") for c in (title, text)]
    return F.concat_ws(" ", *[F.when(p != "", p) for p in parts])


def in_file_order(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): lines with a number that grows in file order within a file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


def read_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(did, text) of a corpus file; its id is _id, docid or id, the last of equal ids wins. With a limit the first rows count."""
    lines = in_file_order(spark, path).where("trim(value) <> ''")
    if limit is not None:
        lines = lines.orderBy("pos").limit(limit)
    get = lambda k: F.get_json_object("value", f"$.{k}")
    rows = lines.select("pos", F.coalesce(get("_id"), get("docid"), get("id")).alias("did"), document_text(get("title"), get("text")).alias("text"))
    return last_wins(rows, "did", "pos")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = in_file_order(spark, path).where("trim(value) <> ''").select("pos", F.get_json_object("value", "$._id").alias("qid"), F.get_json_object("value", "$.text").alias("text"))
    return last_wins(rows, "qid", "pos")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, did, pos) of judgements above 0, duplicates kept; a missing score is 1, lines of fewer than two fields and the head line go."""
    f = F.split("value", "\t")
    rows = in_file_order(spark, path).where(F.size(f) >= 2).select("pos", f[0].alias("qid"), f[1].alias("did"), F.coalesce(F.try_to_number(F.get(f, F.lit(2)), F.lit("S999999999")).cast("double"), F.when(F.size(f) < 3, 1.0)).alias("score"))
    return rows.where("score > 0").select("qid", "did", "pos")


def read_ordered_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, did, pos) of judgements above 0 in their order, duplicates kept; the head line and lines of fewer than three fields go."""
    f = F.split("value", "\t")
    rows = in_file_order(spark, path).where(F.size(f) >= 3).select("pos", f[0].alias("qid"), f[1].alias("did"), F.expr("try_cast(split(value, '\t')[2] AS double)").alias("score"))
    return rows.where("score > 0").select("qid", "did", "pos")


def read_collection(spark: SparkSession, folder: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(corpus, queries, qrels) of a folder with corpus.jsonl, queries.jsonl, qrels/<split>.tsv; qrels are distinct."""
    return read_corpus(spark, f"{folder}/corpus.jsonl"), read_queries(spark, f"{folder}/queries.jsonl"), read_qrels(spark, f"{folder}/qrels/{split}.tsv").select("qid", "did").distinct()


def first_positive(queries: DataFrame, qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(qid, query, did, positive): each query with its first relevant document; a query whose first isn't in the corpus goes."""
    first = qrels.groupBy("qid").agg(F.min_by("did", "pos").alias("did"))
    return queries.withColumnRenamed("text", "query").join(first, "qid").join(corpus.withColumnRenamed("text", "positive"), "did").select("qid", "query", "did", "positive")


def paragraphs(df: DataFrame, least_gold: int = 2) -> tuple[DataFrame, DataFrame]:
    """Multi-paragraph questions as (corpus, questions): corpus(qid, local, title, text, is_gold), questions(qid, question, answer) with least_gold gold paragraphs."""
    zipped = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    rows = df.select(F.col("id").alias("qid"), F.posexplode(zipped).alias("local", "p"), F.col("supporting_facts.title").alias("gold"))
    corpus = rows.select("qid", "local", F.col("p.title").alias("title"), F.concat_ws(" ", F.col("p.title"), F.array_join("p.sentences", " ")).alias("text"), F.array_contains("gold", F.col("p.title")).alias("is_gold"))
    enough = corpus.where("is_gold").groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= least_gold)
    return corpus, df.select(F.col("id").alias("qid"), "question", "answer").join(enough.select("qid"), "qid", "left_semi")


def read_teacher(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Teacher tables one after the other with file_no."""
    parts = [spark.read.schema(SCHEMAS["teacher"]).parquet(p).withColumn("file_no", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of numbers, all as doubles; a table without columns or rows if there is no such file."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "struct<>")
    return raw.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns])


def sized_union(parts: dict[str, DataFrame], size: int | None = None, pos: str = "pos") -> DataFrame:
    """Data sets one after the other with dataset_name, the first `size` of each."""
    got = [p.orderBy(pos).limit(size) if size is not None else p for p in parts.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [g.withColumn("dataset_name", F.lit(n)) for n, g in zip(parts, got, strict=True)])


def tolerant_union(loaders: dict[str, Callable[[], DataFrame]], on_error: str = "raise") -> tuple[DataFrame, dict[str, str]]:
    """Union of what the loaders give, and why others failed; on_error 'skip' goes on without them."""
    got, failed = [], {}
    for name, load in loaders.items():
        try:
            got.append(load())
        except Exception as e:
            if on_error != "skip":
                raise
            failed[name] = str(e).split("\n")[0]
    if not got:
        raise ValueError("no source could be read")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), got), failed


def enriched(qa: DataFrame, titles: DataFrame, fetch: Callable[[list[str]], list[str]], batch: int = 50) -> DataFrame:
    """qa with subject and object titles (by Q-number of s_uri, o_uri) and page texts of distinct titles by `fetch`, an injected batch function."""
    t = titles.select(F.col("qid").alias("_q"), F.col("title").alias("_t"))
    out = qa
    for side in ("s", "o"):
        key = entity_id(F.col(f"{side}_uri"))
        out = out.withColumn("_k", key).join(t, F.col("_k") == F.col("_q"), "left").withColumn(f"{side}_wiki_title", F.coalesce("_t", F.col(f"{side}_wiki_title"))).drop("_k", "_q", "_t")
    wanted = out.select(F.explode(F.array("s_wiki_title", "o_wiki_title")).alias("title")).where("title is not null").distinct()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = f["title"].tolist()
            pages = [p for lo in range(0, len(names), batch) for p in fetch(names[lo : lo + batch])]
            yield pd.DataFrame({"title": names, "page": pages})

    pages = wanted.mapInPandas(run, "title string, page string")
    for side in ("s", "o"):
        p = pages.select(F.col("title").alias("_t"), F.col("page").alias("_p"))
        out = out.join(p, F.col(f"{side}_wiki_title") == F.col("_t"), "left").withColumn(f"{side}_wiki_content", F.col("_p")).drop("_t", "_p")
    return out


def load_yaml(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one, anything else an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        got = yaml.safe_load(f)
    if got is None:
        return {}
    if not isinstance(got, dict):
        raise ValueError(f"{path} isn't a mapping")
    return got


def fingerprint(config: dict) -> str:
    import hashlib

    return hashlib.sha1(json.dumps(config, sort_keys=True).encode()).hexdigest()[:10]
