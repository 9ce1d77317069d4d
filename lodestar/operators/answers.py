"""Answer and paraphrase evaluation."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodestar.functions import text as T
from lodestar.operators.mixing import _names

ERROR = "error"


def references(df: DataFrame, answer_col: str | None = None) -> Column:
    """Reference answers as an array: answer_col, else possible_answers, answers, obj, else one empty answer (P20)."""
    found = []
    for c in [answer_col, "possible_answers", "answers", "obj"]:
        if c and c in df.columns:
            is_list = df.schema[c].dataType.typeName() == "array"
            found.append(F.col(c).cast("array<string>") if is_list else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))))
    return F.coalesce(*found, F.array(F.lit("")))


def in_accuracy(df: DataFrame, prediction: str, answer_col: str | None = None) -> DataFrame:
    """df with `correct`."""
    return df.withColumn("correct", T.contains_any(F.coalesce(F.col(prediction), F.lit("")), references(df, answer_col)))


@F.pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def simple_metrics(df: DataFrame, reference: str, candidate: str) -> DataFrame:
    """Per row jaccard, word_overlap, length_ratio; null where either text is blank. Each text is cut into tokens once."""
    r_, c_, n_, rd_, cd_ = _names(df, "tokens_r", "tokens_c", "common", "distinct_r", "distinct_c", made=("jaccard", "word_overlap", "length_ratio"))
    rows = df.withColumns({r_: T.space_tokens(reference), c_: T.space_tokens(candidate)})  # a text without a token is blank
    rows = rows.withColumns({rd_: F.array_distinct(r_), cd_: F.array_distinct(c_)}).withColumn(n_, F.size(F.array_intersect(rd_, cd_)))
    both = (F.size(r_) > 0) & (F.size(c_) > 0)
    common, r, c = F.col(n_), F.size(rd_), F.size(cd_)
    made = {"jaccard": common / (r + c - common), "word_overlap": common / r, "length_ratio": F.size(c_) / F.size(r_)}
    return rows.withColumns({k: F.when(both, v) for k, v in made.items()}).drop(r_, c_, n_, rd_, cd_)


def simple_means(rows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row: means over the non-blank pairs, count over all rows."""
    return rows.agg(*[F.round(F.avg(m), 6).alias(f"avg_{m}") for m in ("jaccard", "word_overlap", "length_ratio", *extra)], F.count("*").alias("n"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))


def valid_mean(df: DataFrame, score: str) -> DataFrame:
    """Mean of scores of 0 or more; a negative one marks a failed judgement."""
    return df.agg(F.round(F.avg(F.when(F.col(score) >= 0, F.col(score))), 6).alias("mean"), F.count_if(F.col(score) >= 0).alias("n_valid"), F.count("*").alias("n"))


def judged(df: DataFrame, key: str, judge: Callable[[list[dict]], list[dict]], batch: int = 10) -> DataFrame:
    """(key, score, label, rationale) per row; a batch whose judge fails gets score -1 and label error.

    judge: from a list of rows (dicts) to verdict dicts with the key; verdicts are matched by key, a missing one is an error.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            rows = f.to_dict("records")
            for lo in range(0, len(rows), batch):
                part = rows[lo : lo + batch]
                try:
                    got = {v[key]: v for v in judge(part)}
                    why = "no verdict"
                except Exception as e:  # a judge is foreign code: its failure is a result
                    got, why = {}, str(e)
                for r in part:
                    v = got.get(r[key])
                    out.append((r[key], float(v["score"]), v["label"], v.get("rationale", "")) if v else (r[key], -1.0, ERROR, why))
            yield pd.DataFrame(out, columns=[key, "score", "label", "rationale"])

    return df.mapInPandas(run, f"{key} {kind}, score double, label string, rationale string")


def binary_f1(df: DataFrame, probability: str, label: str, threshold: float = 0.5) -> DataFrame:
    p, y = F.col(probability) > threshold, F.col(label) == 1
    counts = df.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    under = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.select("tp", "fp", "fn", F.round(F.when(under > 0, 2 * F.col("tp") / under).otherwise(0.0), 6).alias("f1"))
