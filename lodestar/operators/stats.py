"""Statistics of similarities, lengths and losses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import hash_order, word_tokens
from lodestar.functions.vector import cosine, dot
from lodestar.operators.lexical import B, K1, idf
from lodestar.operators.mixing import ranked_within


def similarity_stats(df: DataFrame, group: str, sim: str, sample: bool = False) -> DataFrame:
    """(group, mean, std, n); std of the population (A11) or of a sample."""
    std = F.stddev_samp(sim) if sample else F.stddev_pop(sim)
    return df.groupBy(group).agg(F.round(F.avg(sim), 6).alias("mean"), F.round(F.coalesce(std, F.lit(0.0)), 6).alias("std"), F.count("*").alias("n"))


def list_sizes(df: DataFrame, c: str) -> DataFrame:
    """One row: average, least and greatest size of a list column."""
    n = F.size(c)
    return df.agg(F.round(F.avg(n), 6).alias("avg"), F.min(n).cast("long").alias("min"), F.max(n).cast("long").alias("max"))


def text_lengths(df: DataFrame, c: str) -> DataFrame:
    """One row: mean and median length of the texts that aren't empty."""
    n = F.length(c)
    return df.where(n > 0).agg(F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.count("*").alias("n"))


def share_true(df: DataFrame, c: Column) -> DataFrame:
    """One row: mean of a condition."""
    return df.agg(F.round(F.avg(c.cast("int")), 6).alias("mean"), F.count("*").alias("n"))


def cross_entropy(logits: Column, label: Column, ignored: float = -100.0) -> Column:
    """Of one row, null where its label is ignored (V18); logits is an array, label an index."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.when(label != ignored, F.log(z) + top - F.get(logits, label.cast("int")))


def head_losses(df: DataFrame, heads: dict[str, tuple[Column, float, float]]) -> DataFrame:
    """One row: for each head its loss over its rows that aren't null, 0 without any, and `total`, weighted.

    heads: name to (loss of a row, divisor such as ln(classes), weight).
    """
    rows = df.agg(*[F.coalesce(F.sum(loss / F.lit(by)) / F.count(loss), F.lit(0.0)).alias(h) for h, (loss, by, _) in heads.items()])
    total = reduce(lambda a, b: a + b, [F.col(h) * w for h, (_, _, w) in heads.items()])
    return rows.select(*[F.round(h, 6).alias(h) for h in heads], F.round(total, 6).alias("total"))


def margins(sims: DataFrame) -> DataFrame:
    """(batch_id, q, d, sim) to one row: own and best other similarity, their margin, hits and reciprocal rank."""
    own = sims.where("q = d").select("batch_id", "q", F.col("sim").alias("own"))
    rest = sims.where("q <> d").join(own, ["batch_id", "q"]).groupBy("batch_id", "q", "own").agg(F.max("sim").alias("other"), (F.count_if(F.col("sim") > F.col("own")) + 1).alias("rank"))
    m = F.col("own") - F.col("other")
    return rest.agg(
        F.round(F.avg("own"), 6).alias("pos_mean"), F.round(F.avg("other"), 6).alias("neg_mean"), F.round(F.avg(m), 6).alias("margin_mean"), F.round(F.stddev_pop(m), 6).alias("margin_std"),
        *[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"hit@{k}") for k in (1, 5, 10)], F.round(F.avg(F.lit(1.0) / F.col("rank")), 6).alias("mrr"), F.count("*").alias("n"),
    )


def best_similarities(sims: DataFrame, k: int = 3) -> DataFrame:
    """(batch_id, q, s1..sk): the greatest similarities of each query."""
    got = sims.groupBy("batch_id", "q").agg(F.slice(F.sort_array(F.collect_list("sim"), False), 1, k).alias("s"))
    return got.select("batch_id", "q", *[F.get("s", F.lit(i)).alias(f"s{i + 1}") for i in range(k)])


def examples(batched: DataFrame, sims: DataFrame, batches: int = 3, rows: int = 8) -> DataFrame:
    """(batch_id, q, own, rank, s1..s3) of the first rows of the first batches."""
    some = sims.where((F.col("batch_id") < batches) & (F.col("q") < rows))
    own = some.where("q = d").select("batch_id", "q", F.col("sim").alias("own"))
    ranks = some.join(own, ["batch_id", "q"]).groupBy("batch_id", "q", "own").agg((F.count_if(F.col("sim") > F.col("own")) + 1).alias("rank"))
    return ranks.join(best_similarities(some), ["batch_id", "q"])


def mse(a: str, b: str) -> Column:
    """Mean squared difference of two vectors."""
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def distillation(df: DataFrame, student: str, teacher: str) -> DataFrame:
    """One row: mse, cosine, cosine loss and norms of student and teacher vectors."""
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    cos = cosine(F.col(student), F.col(teacher))
    return df.agg(
        F.round(F.avg(mse(student, teacher)), 6).alias("mse"), F.round(F.avg(cos), 6).alias("cosine"), F.round(F.avg(1 - cos), 6).alias("cosine_loss"),
        F.round(F.avg(norm(student)), 6).alias("student_norm"), F.round(F.avg(norm(teacher)), 6).alias("teacher_norm"), F.count("*").alias("n"),
    )


def shuffled_cosine(df: DataFrame, key: str, student: str, teacher: str, seed: str | int = 0) -> DataFrame:
    """One row: the mean cosine of each student vector with the teacher vector of another row, the next one in hash order, the first after the last.

    What a student that tells no two texts apart would reach; next to the mean cosine of the own vectors it shows what was learnt.
    """
    rows = ranked_within(df.select(F.col(key).alias("k"), F.col(student).alias("s"), F.col(teacher).alias("t")), None, [hash_order(F.col("k"), seed), F.col("k")], "at", "of")
    other = rows.select((F.pmod(F.col("at") - 2, F.col("of")) + 1).alias("at"), F.col("t").alias("o"))
    return rows.join(other, "at").agg(F.round(F.avg(cosine(F.col("s"), F.col("t"))), 6).alias("cosine"), F.round(F.avg(cosine(F.col("s"), F.col("o"))), 6).alias("cosine_shuffled"), F.count("*").alias("n"))


def combined_loss(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """(batch_id, loss): weighted sum of batch losses."""
    rows = [df.select("batch_id", (F.col("loss") * F.lit(w)).alias("loss")) for df, w in parts.values()]
    return reduce(DataFrame.unionByName, rows).groupBy("batch_id").agg(F.round(F.sum("loss"), 5).alias("loss"))


def mean_over_sets(df: DataFrame, name: str, batch: str, value: str) -> DataFrame:
    """One row: the mean over data sets of the mean over their batches of the batch means."""
    per = df.groupBy(name, batch).agg(F.avg(value).alias("v")).groupBy(name).agg(F.avg("v").alias("v"))
    return per.agg(F.round(F.avg("v"), 6).alias("mean"), F.count("*").alias("n_sets"))


def batch_bm25(batched: DataFrame, query: str, document: str) -> DataFrame:
    """(batch_id, q, d, sim): BM25 of every query of a batch on every document of it; counts and average length are the batch's own."""
    docs = batched.select("batch_id", F.col("slot").alias("d"), word_tokens(F.col(document)).alias("t")).withColumn("dl", F.size("t"))
    whole = docs.groupBy("batch_id").agg(F.count("*").alias("n"), F.when(F.sum("dl") > 0, F.avg("dl")).otherwise(F.lit(1.0)).alias("avgdl"))
    tf = docs.select("batch_id", "d", "dl", F.explode("t").alias("term")).groupBy("batch_id", "d", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("batch_id", "term").agg(F.count("*").alias("df")).join(whole, "batch_id").withColumn("idf", idf(F.col("n"), F.col("df")))
    asked = batched.select("batch_id", F.col("slot").alias("q"), F.explode(F.array_distinct(word_tokens(F.col(query)))).alias("term"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    hits = asked.join(tf, ["batch_id", "term"]).join(df, ["batch_id", "term"]).groupBy("batch_id", "q", "d").agg(F.round(F.sum(weight), 6).alias("sim"))
    pairs = batched.select("batch_id", F.col("slot").alias("q")).join(docs.select("batch_id", "d"), "batch_id")
    return pairs.join(hits, ["batch_id", "q", "d"], "left").fillna(0.0, ["sim"])


def method_rows(methods: dict[str, DataFrame | Exception], columns: list[str]) -> DataFrame:
    """One-row metric frames under their names, `columns` in that order; a failed method has its error and empty values."""
    good = {n: d for n, d in methods.items() if isinstance(d, DataFrame)}
    if not good:
        raise ValueError("no method succeeded")
    spark = next(iter(good.values())).sparkSession
    rows = [d.select(F.lit(n).alias("method"), *[(F.format_number(c, 4) if c in d.columns else F.lit("")).alias(c) for c in columns], F.lit("").alias("error")) for n, d in good.items()]
    rows += [spark.range(1).select(F.lit(n).alias("method"), *[F.lit("").alias(c) for c in columns], F.lit(str(e)).alias("error")) for n, e in methods.items() if isinstance(e, Exception)]
    return reduce(DataFrame.unionByName, rows)
