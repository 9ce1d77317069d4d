"""Record filters, defaults, parsing of judgements, and the small rules around runs and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import is_blank
from lodestar.operators.mixing import ranked_within, tail_split


def valid_text(c: Column) -> Column:
    """Text that isn't empty; white space counts as text."""
    return c.isNotNull() & (c != "")


def both_present(df: DataFrame, one: str, two: str, pos: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows with both texts not empty (P6); with a limit the first by `pos`."""
    kept = df.where(valid_text(F.col(one)) & valid_text(F.col(two)))
    if limit is None:
        return kept
    return ranked_within(kept, None, [F.col(pos)], "nth_kept").where(F.col("nth_kept") <= limit).drop("nth_kept")


def defaulted(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with those columns as text: null and a column that isn't there are empty."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("") for c in columns})


def row_format(df: DataFrame) -> str:
    """'triplet' or 'passages' by the columns that are there."""
    have = set(df.columns)
    if {"query", "positive"} <= have and have & {"negative", "negatives"}:
        return "triplet"
    if {"query", "passages"} <= have:
        return "passages"
    raise ValueError(f"neither triplets nor passages: {sorted(have)}")


def passage_fallback(df: DataFrame, query: str = "query", passages: str = "passages") -> DataFrame:
    """(query, positive, negative) of raw passages (D2): the first selected that isn't blank, else the first that isn't blank; the negative is the
    first other one, else the positive. Rows with a blank query or without a passage go."""
    pairs = F.arrays_zip(F.col(f"{passages}.passage_text").alias("t"), F.col(f"{passages}.is_selected").alias("s"))
    rows = df.where(~is_blank(query)).select(F.col(query).alias("query"), F.filter(pairs, lambda x: ~is_blank(x["t"])).alias("p"))
    rows = rows.withColumn("positive", F.coalesce(F.get(F.filter("p", lambda x: x["s"] == 1), F.lit(0))["t"], F.get("p", F.lit(0))["t"])).where("positive is not null")
    other = F.get(F.filter("p", lambda x: x["t"] != F.col("positive")), F.lit(0))["t"]
    return rows.select("query", "positive", F.coalesce(other, "positive").alias("negative"))


def as_list(df: DataFrame, c: str) -> Column:
    """A cell of text or of a list of texts as a list (V1)."""
    return F.col(c).cast("array<string>") if df.schema[c].dataType.typeName() == "array" else F.array(F.col(c).cast("string"))


def without_sources(sources: dict[str, DataFrame], skipped: list[str]) -> dict[str, DataFrame]:
    """The sources that aren't skipped, in any case of their names."""
    low = {s.strip().lower() for s in skipped}
    return {n: d for n, d in sources.items() if n.lower() not in low}


def source_counts(df: DataFrame, source: str, key: str) -> DataFrame:
    """(source, n, n_distinct): rows of each source and distinct keys among them."""
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"))


def grouped_ids(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items): the distinct items of each key, sorted."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"))


# -- judgements --------------------------------------------------------------------------


_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _object(depth: int) -> str:
    """A pattern whose group is each balanced JSON object with so many levels of objects inside; braces within strings don't count."""
    inner = rf"[^{{}}\"]++|{_STRING}"
    for _ in range(depth):
        inner = rf'[^{{}}\"]++|{_STRING}|\{{(?:{inner})*+\}}'
    return rf"(?s)(?=(\{{(?:{inner})*+\}}))\{{"  # what is inside an object is looked at as well


def _objects(payload: Column, schema: str) -> Column:
    """All balanced objects of a text, parsed."""
    return F.transform(F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(_object(3)), F.lit(1)), lambda x: F.from_json(x, schema))


def verdict(payload: Column) -> Column:
    """struct(label, score, reason) of a judge's answer, which may have words and other braces around its JSON object; nulls where there is none.

    The first balanced object with a label, a score or a reason counts.
    """
    found = F.transform(
        _objects(payload, "verdict struct<label: string, reason: string>, label string, score double, reason string"),
        lambda got: F.struct(F.lower(F.coalesce(got["verdict"]["label"], got["label"])).alias("label"), got["score"].alias("score"), F.coalesce(got["verdict"]["reason"], got["reason"]).alias("reason")),
    )
    some = F.filter(found, lambda x: x["label"].isNotNull() | x["score"].isNotNull() | x["reason"].isNotNull())
    none = F.struct(F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("reason"))
    return F.coalesce(F.get(some, F.lit(0)), none)


def golden(references: Column, single: Column | None = None) -> Column:
    """All reference answers as one text; without any, the single one, or the empty text."""
    joined = F.array_join(references, " OR ")
    if single is None:
        return joined
    return F.when(F.coalesce(F.size(references), F.lit(0)) > 0, joined).otherwise(F.coalesce(single, F.lit("")))


def qa_payload(payload: Column) -> Column:
    """struct(question, golden) of a JSON text with question and reference_answers or reference_answer; empty where there is none."""
    got = F.from_json(F.coalesce(payload, F.lit("")), "question string, reference_answers array<string>, reference_answer string")
    return F.struct(F.coalesce(got["question"], F.lit("")).alias("question"), golden(F.coalesce(got["reference_answers"], F.array().cast("array<string>")), got["reference_answer"]).alias("golden"))


def plain_query(c: Column) -> Column:
    """Without leading closing brackets."""
    return F.regexp_replace(c, r"^\)+", "")


def curriculum(epoch: Column, first: float, last: float, epochs: int) -> Column:
    """Linear from first to last over `epochs`, last from then on."""
    return F.lit(first) + F.lit(last - first) * F.least(epoch / F.lit(float(max(1, epochs))), F.lit(1.0))


# -- rules of the driver ---------------------------------------------------------------------


def judge_settings(given: dict, config: dict) -> dict | None:
    """Address, key and model of a judge: given, else the configuration's, else its llm_ ones; None unless all three are there.

    A configured temperature comes along; a judge without one is asked at 0.
    """
    out = {k: given.get(k) or config.get(k) or config.get(f"llm_{k}") for k in ("base_url", "api_key", "model")}
    if not all(out.values()):
        return None
    return out | ({"temperature": float(config["temperature"])} if config.get("temperature") is not None else {})


def template_of(config: dict, task: dict, model: str) -> str:
    """The configured template, else the task's, else the model's."""
    return config.get("template") or task.get("template") or model


def chosen_configs(paths: list[str], part: str = "") -> list[str]:
    """Sorted paths whose file name holds `part`."""
    return [p for p in sorted(paths) if part in p.replace("\\", "/").rsplit("/", 1)[-1]]


def arguments(config: dict) -> list[str]:
    """A mapping as command-line arguments: true is a flag alone, false and null are left out, lists follow their flag."""
    out: list[str] = []
    for k, v in config.items():
        flag = "--" + re.sub("_", "-", k)
        if v is None or v is False:
            continue
        out += [flag] if v is True else [flag, *map(str, v)] if isinstance(v, (list, tuple)) else [flag, str(v)]
    return out


def renamed_class(path: str, prefixes: dict[str, str]) -> str:
    """A dotted path with its longest known prefix replaced."""
    for old in sorted(prefixes, key=len, reverse=True):
        if path == old or path.startswith(f"{old}."):
            return prefixes[old] + path[len(old) :]
    return path


def teacher_texts(questions: DataFrame, corpus: DataFrame, pos: str, limit: int, share: float, docs: int = 5) -> DataFrame:
    """(split, kind, text) that a teacher has to encode (D14): of the first `limit` questions by `pos`, with `share` of them from the end as split
    val, each question's text, and the distinct texts of each split's first `docs` paragraphs. corpus(qid, local, text): the paragraphs by their place.
    """
    first = ranked_within(questions, None, [F.col(pos)], "nth_question").where(F.col("nth_question") <= limit)
    parts = tail_split(first.select("qid", "question", "nth_question"), None, "nth_question", share)
    texts = corpus.where(F.col("local") < docs).join(parts.select("qid", "split"), "qid").select("split", F.lit("document").alias("kind"), "text").distinct()
    return parts.select("split", F.lit("query").alias("kind"), F.col("question").alias("text")).unionByName(texts)
