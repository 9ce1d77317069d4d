"""Training groups: passages to triplets, and negatives mined by BM25, vectors or hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import hash_order
from lodestar.operators.lexical import Index, search, top_k
from lodestar.operators.mixing import ranked_within


def passage_groups(df: DataFrame, query: str = "query", passages: str = "passages") -> DataFrame:
    """(query, positive, negatives): the first selected passage, and the others or, without any, the positive itself. Groups without a selected passage go."""
    pairs = F.arrays_zip(F.col(f"{passages}.passage_text").alias("t"), F.col(f"{passages}.is_selected").alias("s"))
    rows = df.select(F.col(query).alias("query"), pairs.alias("p"))
    rows = rows.select("query", F.get(F.filter("p", lambda x: x["s"] == 1), F.lit(0))["t"].alias("positive"), F.transform(F.filter("p", lambda x: x["s"] != 1), lambda x: x["t"]).alias("negatives"))
    return rows.where("positive is not null").withColumn("negatives", F.when(F.size("negatives") > 0, F.col("negatives")).otherwise(F.array("positive")))


def first_or_positive(negatives: Column, positive: Column) -> Column:
    return F.coalesce(F.get(negatives, F.lit(0)), positive)


def mined(scored: DataFrame, qrels: DataFrame, n: int) -> DataFrame:
    """(qid, did, rank): the n best scored documents that aren't relevant. They are left out before ranking, so no overshoot is needed."""
    return top_k(scored.join(qrels.select("qid", "did").distinct(), ["qid", "did"], "left_anti"), n).select("qid", "did", "rank")


def mined_from(index: Index, queries: DataFrame, qid: str, text: str, qrels: DataFrame, n: int) -> DataFrame:
    """As `mined`, by a search that reads only the blocks that can hold one of the n best."""
    return search(index, queries, qid, text, n, without=qrels).select("qid", "did", "rank")


def hashed(queries: DataFrame, corpus: DataFrame, excluded: DataFrame, n: int, seed: str = "neg", spread: int = 64) -> DataFrame:
    """(qid, did, rank): n documents per query in an order that depends on the seed, without those excluded (qid, did).

    Documents fall into buckets of about `spread` by hash. A query reads its own bucket and the next
    ones, as many as hold n + its excluded documents at least, so the work per query doesn't grow with the corpus.
    """
    total = corpus.count()
    most = (excluded.groupBy("qid").agg(F.count("*").alias("n")).agg(F.max("n")).first() or [0])[0] or 0
    buckets = max(1, total // spread)
    reach = min(buckets, 2 + 2 * (n + most) // spread)

    def place(key: Column, salt: str) -> Column:
        return F.pmod(F.conv(F.substring(hash_order(key, f"{seed}{salt}"), 1, 8), 16, 10).cast("long"), F.lit(buckets))

    docs = corpus.select(F.col("did"), place(F.col("did"), "d").alias("bucket"))
    asked = queries.select("qid").distinct().select("qid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach - 1)), lambda i: F.pmod(place(F.col("qid"), "q") + i, F.lit(buckets)))).alias("bucket"))
    pool = asked.join(docs, "bucket").join(excluded.select("qid", "did").distinct(), ["qid", "did"], "left_anti")
    order = Window.partitionBy("qid").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("qid").cast("string"), F.col("did").cast("string"))), "did")
    return pool.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("qid", "did", "rank")


def mixed(best: DataFrame, filler: DataFrame, n_best: int, n_fill: int) -> DataFrame:
    """(qid, did, kind, rank): n_best mined and n_fill others, each document once."""
    first = best.where(F.col("rank") <= n_best).select("qid", "did", F.lit("mined").alias("kind"), "rank")
    rest = filler.join(first.select("qid", "did"), ["qid", "did"], "left_anti")
    order = Window.partitionBy("qid").orderBy("rank", "did")
    rest = rest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_fill)
    return first.unionByName(rest.select("qid", "did", F.lit("random").alias("kind"), "rank"))


def collected(negatives: DataFrame, n: int) -> DataFrame:
    """(qid, negatives): ids in order of rank, n at most."""
    return negatives.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "did"))).alias("s")).select("qid", F.transform(F.slice("s", 1, n), lambda x: x["did"]).alias("negatives"))


def from_positives(rows: DataFrame, key: str, positive: str, n: int, seed: str = "pos") -> DataFrame:
    """(key, negatives): the n distinct positives that follow the own one in hash order, from the first again after the last."""
    pool = rows.where(F.col(positive).isNotNull()).select(F.col(positive).alias("other")).distinct().withColumn("h", F.md5(F.concat_ws(":", F.lit(seed), F.col("other"))))
    placed = ranked_within(pool, None, [F.col("h"), F.col("other")], "at").select("other", (F.col("at") - 1).alias("at"))
    m = placed.count()
    if m < 2:
        return rows.select(key, F.array().cast("array<string>").alias("negatives"))
    own = rows.select(F.col(key).alias("row"), F.col(positive).alias("mine")).join(placed, F.col("mine") == F.col("other"))
    wanted = own.select("row", "at", F.explode(F.sequence(F.lit(1), F.lit(min(n, m - 1)))).alias("k"))
    found = wanted.select("row", "k", F.pmod(F.col("at") + F.col("k"), F.lit(m)).alias("at")).join(placed, "at")
    return found.groupBy(F.col("row").alias(key)).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]).alias("negatives"))


def filled(rows: DataFrame, key: str, domain: str, old: str, most: int, seed: str = "fill") -> DataFrame:
    """(key, negatives): the old negative, then other rows' old negatives, of the same domain first, then of all, up to `most` (D3).

    Others are the rows that follow in hash order, `most` in the domain and `most` overall, so the work per row is fixed.
    """
    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    base = rows.select(F.col(key).alias("key"), F.coalesce(F.col(domain), F.lit("")).alias("domain"), F.col(old).alias("old"), h.alias("h"))
    placed = ranked_within(ranked_within(base, "domain", [F.col("h"), F.col("key")], "near", "n_near"), None, [F.col("h"), F.col("key")], "far", "n_far")
    steps = F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")
    near = placed.select("key", "domain", "n_near", "near", steps).where("k < n_near").select("key", "k", "domain", (F.pmod(F.col("near") - 1 + F.col("k"), F.col("n_near")) + 1).alias("near"))
    far = placed.select("key", "n_far", "far", steps).where("k < n_far").select("key", "k", (F.pmod(F.col("far") - 1 + F.col("k"), F.col("n_far")) + 1).alias("far"))
    first = placed.select("key", F.lit(0).alias("kind"), F.lit(0).alias("k"), "old")
    got = first.union(near.join(placed.select("domain", "near", "old"), ["domain", "near"]).select("key", F.lit(1), "k", "old")).union(far.join(placed.select("far", "old"), "far").select("key", F.lit(2), "k", "old"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("kind", "k", "old"))), lambda x: x["old"])
    return got.where("old is not null").groupBy("key").agg(F.slice(F.array_distinct(listed), 1, most).alias("negatives")).withColumnRenamed("key", key)
