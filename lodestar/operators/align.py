"""Alignment scores over sentence pairs, SMART scores, and augmented alignment examples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.mixing import ranked_within


def pairs(df: DataFrame, key: str, premise: str, hypothesis: str, words: int = 350) -> DataFrame:
    """(key, h, p, hypothesis, premise): each hypothesis sentence with each premise chunk of its row."""
    sents = F.filter(F.split(F.coalesce(F.col(hypothesis), F.lit("")), r"(?<=[.!?])(?U)\s+"), lambda s: s != "")
    left = df.select(key, T.sentence_chunks(F.col(premise), words).alias("_p"), F.posexplode(sents).alias("h", "hypothesis"))
    return left.select(key, "h", "hypothesis", F.posexplode("_p").alias("p", "premise"))


def token_overlap(premise: Column, hypothesis: Column) -> Column:
    """A stand-in scorer without a model: share of the hypothesis's words that the premise has."""
    return T.overlap(T.space_tokens(hypothesis), T.space_tokens(premise))


def alignment(scored: DataFrame, key: str) -> DataFrame:
    """(key, score): best premise of each hypothesis sentence, averaged."""
    return scored.groupBy(key, "h").agg(F.max("score").alias("best")).groupBy(key).agg(F.round(F.avg("best"), 6).alias("score"))


def smart_n(scored: DataFrame, key: str) -> DataFrame:
    """Precision, recall and F1 of sentence matches (A23); scored: (key, h, p, score). Recall goes over premises."""
    prec = scored.groupBy(key, "h").agg(F.max("score").alias("m")).groupBy(key).agg(F.avg("m").alias("precision"))
    rec = scored.groupBy(key, "p").agg(F.max("score").alias("m")).groupBy(key).agg(F.avg("m").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return prec.join(rec, key).select(key, "precision", "recall", F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0).alias("f1"))


def soft_lcs(m: np.ndarray, shared: bool = False) -> np.ndarray:
    """Soft longest common subsequences of many pairs at once; m: [pairs, premises, hypotheses] scores.

    L[i, j] = max(L[i-1, j-1] + m, L[i-1, j] + m, L[i, j-1]), one anti-diagonal of all pairs at a time. `shared`: all rows are one,
    so L[i-1, j-1] is what was written last (the published scores come from such a table).
    """
    n, rows, cols = m.shape
    best = np.zeros((n, rows + 1, cols + 1))
    for d in range(2, rows + cols + 1):
        i = np.arange(max(1, d - cols), min(rows, d - 1) + 1)
        j = d - i
        s = m[:, i - 1, j - 1]
        corner = best[:, i, j - 1] if shared else best[:, i - 1, j - 1]
        best[:, i, j] = np.maximum(np.maximum(corner, best[:, i - 1, j]) + s, best[:, i, j - 1])
    return best[:, -1, -1]


def in_order(m: np.ndarray) -> np.ndarray:
    """The best total of matches in order, each sentence once; m: [pairs, premises, hypotheses]."""
    best = np.zeros((len(m), m.shape[1] + 1))
    for j in range(m.shape[2]):
        one = np.maximum(best[:, 1:], best[:, :-1] + m[:, :, j])
        best[:, 1:] = np.maximum.accumulate(one, axis=1)
    return best[:, -1]


def smart_l(scored: DataFrame, key: str) -> DataFrame:
    """Sentences matched in order (R20); scored: (key, h, p, score), a missing pair scores 0.

    (key, precision, recall, f1) of the matches in order with each sentence once, `soft` = soft_lcs / premises, and `soft_shared`,
    the same with one row for all. A key is one row with its matrix; rows are sorted by the matrix's size, and pairs of
    equal size are computed together.
    """
    cell = F.struct("p", "h", F.coalesce("score", F.lit(0.0)).alias("score"))
    cells = scored.groupBy(key, "p", "h").agg(F.max("score").alias("score")).groupBy(key).agg(F.collect_list(cell).alias("m"), F.countDistinct("p").alias("rows"), F.countDistinct("h").alias("cols"))
    of = f"{key} {scored.schema[key].dataType.simpleString()}, precision double, recall double, f1 double, soft double, soft_shared double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (rows, cols), g in f.groupby(["rows", "cols"]):
                step = max(1, (1 << 22) // ((rows + 1) * (cols + 1)))
                for lo in range(0, len(g), step):
                    part = g.iloc[lo : lo + step]
                    m = np.zeros((len(part), rows, cols))
                    for n, cells_ in enumerate(part["m"]):
                        p, h, s = (np.array([c[k] for c in cells_]) for k in ("p", "h", "score"))
                        m[n, np.unique(p, return_inverse=True)[1], np.unique(h, return_inverse=True)[1]] = s
                    total = in_order(m)
                    p, r = total / cols, total / rows
                    f1 = np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0)
                    yield pd.DataFrame({key: part[key].to_numpy(), "precision": p, "recall": r, "f1": f1, "soft": soft_lcs(m) / rows, "soft_shared": soft_lcs(m, True) / rows})

    return cells.sortWithinPartitions("rows", "cols").mapInPandas(run, of)


def scored_by(pairs_: DataFrame, score: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    """pairs with `score` from an injected batch scorer (premises, hypotheses)."""
    cols = pairs_.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(score=[float(x) for x in score(f["premise"].tolist(), f["hypothesis"].tolist())])

    return pairs_.mapInPandas(run, pairs_.select(*cols, F.lit(0.0).alias("score")).schema)


#: Task: (label kind, how the second text is chosen). See `augmented`.
TASKS = {
    "nli": ("tri", "first"), "fact_checking": ("tri", "first"), "paraphrase": ("bin", "first"), "qa": ("bin", "with_c"), "coreference": ("bin", "with_c"),
    "bin_nli": ("bin", "first"), "summarization": ("bin", "sampled"), "extractive_qa": ("bin", "sampled"), "multiple_choice_qa": ("bin", "first_or_sampled"),
    "ir": ("bin", "any"), "wmt": ("reg", "first"), "sts": ("reg", "first"), "ctc": ("reg", "first"),
}
IGNORED = -100.0


def augmented(df: DataFrame, key: str = "id", seed: str = "align") -> DataFrame:
    """(key, task, text_a, text_b, tri, bin, reg): one training pair per example (D17), random choices by hash of the key.

    A sampled negative without a text_c is the text_b of another row of the task: the next one in hash order, the first after the last.
    Rows find their place in that ring by ranges, so a task may have any number of rows.
    """

    def u(salt: str) -> Column:
        return F.conv(F.substring(T.hash_order(F.col(key), seed + salt), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    def pick(a: Column, salt: str) -> Column:
        return F.get(a, F.floor(u(salt) * F.size(a)).cast("int"))

    first = F.get(F.col("text_b"), F.lit(0))
    kind = F.create_map(*[F.lit(x) for t, (k, _) in TASKS.items() for x in (t, k)])[F.col("task")]
    how = F.create_map(*[F.lit(x) for t, (_, h) in TASKS.items() for x in (t, h)])[F.col("task")]
    # only rows that may need another row's text look for it; the ring itself holds keys alone
    lone = how.isin("sampled", "first_or_sampled") & (F.coalesce(F.size("text_c"), F.lit(0)) <= 0)
    ring = ranked_within(df.select("task", key), "task", [T.hash_order(F.col(key), seed + "next"), F.col(key)], "_at", "_of")
    after = ring.select(F.col("task").alias("_t"), F.col("_at").alias("_n"), F.col(key).alias("_next"))
    wanted = ring.join(df.where(lone).select("task", key).distinct(), ["task", key], "left_semi")
    wanted = wanted.join(after, (F.col("task") == F.col("_t")) & (F.col("_n") == F.col("_at") % F.col("_of") + 1)).select("task", F.col(key).alias("_k0"), "_next")
    texts = df.join(wanted.select("task", F.col("_next").alias(key)).distinct(), ["task", key], "left_semi").groupBy("task", F.col(key).alias("_next")).agg(F.min(first).alias("_other"))
    found = wanted.join(texts, ["task", "_next"]).groupBy(F.col("task").alias("_t"), "_k0").agg(F.min("_other").alias("_other"))
    rows = df.join(found, (F.col("task") == F.col("_t")) & (F.col(key) == F.col("_k0")), "left").drop("_t", "_k0")
    label = F.when((kind == "tri") & (F.col("orig_label") == -1), F.lit(1.0)).otherwise(F.col("orig_label"))
    can_self = F.col("task").isin("nli", "fact_checking", "paraphrase")
    same = can_self & (u("self") < 0.05)
    swap = can_self & ~same & (u("swap") < 0.05) & ((kind == "bin") | (label == 2))
    positive = u("half") < 0.5
    negative = F.coalesce(pick(F.coalesce("text_c", F.array().cast("array<string>")), "neg"), F.col("_other"))
    b = (
        F.when(how == "with_c", F.concat_ws(" ", first, F.get(F.col("text_c"), F.lit(0))))
        .when(how == "any", pick(F.col("text_b"), "pos"))
        .when(how == "sampled", F.when(positive, pick(F.col("text_b"), "pos")).otherwise(negative))
        .when(how == "first_or_sampled", F.when(positive, first).otherwise(negative))
        .otherwise(first)
    )
    y = F.when(same, F.when(kind == "tri", 0.0).otherwise(1.0)).when(how.isin("sampled", "first_or_sampled"), positive.cast("double")).otherwise(label)
    rows = rows.select("*", b.alias("_b"), y.alias("_y"), kind.alias("_k"), same.alias("_same"), swap.alias("_swap"))
    a_out = F.when(F.col("_swap"), F.col("_b")).otherwise(F.col("text_a"))
    b_out = F.when(F.col("_same") | F.col("_swap"), F.col("text_a")).otherwise(F.col("_b"))
    return rows.select(key, "task", a_out.alias("text_a"), b_out.alias("text_b"), *[F.when(F.col("_k") == k, F.col("_y")).otherwise(F.lit(IGNORED)).alias(k) for k in ("tri", "bin", "reg")])
