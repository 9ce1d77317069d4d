"""Search without comparing everything: inverted file, bounded exact search, blocked BM25, q-grams; the session's indexes."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import clusters, dense, grams, lexical, negatives
from lodestar.plans import shared


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def no_product(df) -> bool:
    return not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Join Cross", plan(df))


# -- vectors -------------------------------------------------------------------------------


def around(n: int, centres: int, dim: int, spread: float, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).round(4)


def vectors(spark, v, parts: int = 5):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(10**6, None), (10**6 + 1, [])], "vec_id long, vec array<double>").repartition(parts)


def best(v: np.ndarray, q: int, k: int, metric: str) -> list[int]:
    s = np.round(v @ v[q], 6) if metric == "ip" else np.round(-((v - v[q]) ** 2).sum(1), 6)
    return sorted((j for j in range(len(v)) if j != q), key=lambda j: (-s[j], j))[:k]


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_bounded_search_is_exact_and_skips_lists(spark, metric, monkeypatch):
    v = around(1500, 12, 8, 0.05)
    v[100:600] = v[7]  # a third of all rows is one vector
    rows = vectors(spark, v)
    asked = rows.where("vec_id % 13 = 0")
    index = clusters.build(rows, block=64)
    assert index.sizes.sum() == len(v)
    assert index.parts.max() > 1
    assert max(len(r["ids"]) // 8 for r in index.blocks.select("ids").collect()) <= 64
    seen = []
    plain = clusters._products
    monkeypatch.setattr(clusters, "_products", lambda blocks, q, *a: (seen.append((blocks, q)), plain(blocks, q, *a))[1])
    found = clusters.search(index, asked, 6, metric)
    assert no_product(found)
    got = collections.defaultdict(list)
    for r in found.orderBy("qid", "rank").collect():
        got[r.qid].append(r.did)
    assert dict(got) == {q: best(v, q, 6, metric) for q in range(0, 1500, 13)}
    products = sum(q.join(b, ["list", "part"]).agg(F.sum(F.length("q_ids") * F.length("ids") / 64)).first()[0] or 0 for b, q in seen)
    assert 0 < products < 0.7 * len(v) * len(got)


def test_best_of_a_block_are_parted_not_sorted(monkeypatch):
    rng = np.random.default_rng(2)
    s = rng.integers(0, 6, (40, 50)).astype(float)  # many ties
    s[3], s[4, :48] = -np.inf, -np.inf
    s[5] = 1.0
    least = np.where(np.arange(40) % 3 == 0, 4.0, -np.inf)
    want = {(q, int(j)) for q in range(40) for j in np.argsort(-s[q], kind="stable")[:7] if np.isfinite(s[q, j]) and s[q, j] >= least[q]}
    monkeypatch.setattr(clusters.np, "argsort", None)
    at, best = clusters._best(s, least, 7)
    assert sorted(zip(at.tolist(), best.tolist(), strict=True)) == sorted(want)


def test_inverted_file(spark, tmp_path):
    v = around(1200, 30, 6, 0.2, seed=3)
    rows = vectors(spark, v)
    asked = rows.where("vec_id % 20 = 0")
    clusters.build(rows, lists=24).save(str(tmp_path / "ivf"))
    index = clusters.Lists.load(spark, str(tmp_path / "ivf"))
    want = {(q, j) for q in range(0, 1200, 20) for j in best(v, q, 10, "l2")}
    every = clusters.probe(index, asked, 10, len(index.centres), "l2")
    assert {(r.qid, r.did) for r in every.collect()} == want
    some = clusters.probe(index, asked, 10, 4, "l2")
    assert len({(r.qid, r.did) for r in some.collect()} & want) >= 0.9 * len(want)
    one = clusters.probe(index, asked.where("vec_id = 40"), 10, 1, "l2")
    assert no_product(one)
    assert re.search(r"PartitionFilters: \[[^]]*list", plan(one))
    assert len(one.collect()) == 10


def test_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, vec array<float>")
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "vec_id long, vec array<float>")
    assert dense.search(none, few, 3).count() == 0
    assert dense.search(few, none, 3).count() == 0
    assert [(r.qid, r.did, r.score) for r in dense.search(few, few, 3, block=1).orderBy("qid").collect()] == [(1, 2, 0.0), (2, 1, 0.0)]
    with pytest.raises(ValueError, match="unknown metric"):
        dense.search(few, few, 3, "cosine")


# -- BM25 ----------------------------------------------------------------------------------


def zipf_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [" ".join(rng.choices(words, weights, k=rng.randint(3, 60))) for _ in range(n)]


def by_hand(texts: dict, query: str, k: int, without: set) -> list:
    n = len(texts)
    counts = {d: collections.Counter(t.split()) for d, t in texts.items()}
    avg = sum(sum(c.values()) for c in counts.values()) / n
    df = collections.Counter(w for c in counts.values() for w in c)
    out = []
    for d, c in counts.items():
        dl = sum(c.values())
        s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * dl / avg)) for w in set(query.split()) if c[w])
        if s > 0 and d not in without:
            out.append((-round(s, 6), d))
    return [d for _, d in sorted(out)[:k]]


@pytest.mark.parametrize("small", [lexical.SMALL, 0])
def test_bm25_search_reads_few_postings(spark, monkeypatch, small):
    monkeypatch.setattr(lexical, "SMALL", small)
    monkeypatch.setattr(lexical, "FIRST", 10)
    monkeypatch.setattr(lexical, "QUERIES", 9)
    texts = dict(enumerate(zipf_texts(900, 1)))
    docs = spark.createDataFrame([(d, t) for d, t in texts.items()] + [(5000, ""), (5001, None)], "d long, text string").repartition(4)
    texts |= {5000: "", 5001: ""}
    asked = [(i, " ".join(t.split()[:12])) for i, t in enumerate(zipf_texts(12, 2))] + [(90, "w0 w0 w1"), (91, "w399"), (92, "nowhere"), (93, None), (94, "w0 " + texts[3])]
    queries = spark.createDataFrame(asked, "q long, text string")
    without = spark.createDataFrame([(94, 3), (94, 4), (90, 3)], "qid long, did long")
    index = lexical.build(docs, "d", "text", block=8)
    assert index.blocks.agg(F.max("n")).first()[0] <= 8  # no row holds a common term's whole list
    for left_out in (None, without):
        found = lexical.search(index, queries, "q", "text", 5, left_out)
        got = collections.defaultdict(list)
        for r in found.orderBy("qid", "rank").collect():
            got[r.qid].append(r.did)
        skip = collections.defaultdict(set)
        for r in without.collect() if left_out is not None else []:
            skip[r.qid].add(r.did)
        want = {q: by_hand(texts, t or "", 5, skip[q]) for q, t in asked}
        assert dict(got) == {q: d for q, d in want.items() if d}
    assert no_product(found)
    # the entries that the blocks look at, with the floors that the search has
    every = index.postings.join(lexical.asked_terms(index, queries, "q", "text"), "term").count()
    looked = []
    plain = lexical.scored_block
    monkeypatch.setattr(lexical, "scored_block", lambda t, avgdl: (looked.append(plain(t, avgdl)[1]), plain(t, avgdl))[1])
    groups = []
    monkeypatch.setattr(type(spark.range(1).groupBy("id")), "applyInArrow", lambda g, f, schema: (groups.append((g._df, f)), spark.createDataFrame([], schema))[1])
    lexical.search(index, queries, "q", "text", 5)
    df, run = groups[0]
    for block, chunk in {(r.block, r.chunk) for r in df.select("block", "chunk").distinct().collect()}:
        run(df.where(f"block = {block} and chunk = {chunk}").coalesce(1).toArrow())
    assert 0 < sum(looked) < 0.8 * every


def test_bm25_search_broadcasts_the_terms_of_some_queries_at_once(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(zipf_texts(300, 5))), "d long, text string").repartition(3)
    queries = spark.createDataFrame([(i, " ".join(t.split()[:6])) for i, t in enumerate(zipf_texts(60, 6))], "q long, text string")
    index = lexical.build(docs, "d", "text", block=50)
    want = sorted((r.qid, r["rank"], r.did, r.score) for r in lexical.top_k(lexical.scores(index, queries, "q", "text"), 4).collect())
    monkeypatch.setattr(lexical, "QUERIES", 15)
    monkeypatch.setattr(lexical, "SMALL", 150)
    sent, plain = [], F.broadcast
    monkeypatch.setattr(lexical.F, "broadcast", lambda df: (sent.append(df.select(F.sum(F.size("qid")) if "late" in df.columns else F.count("*")).first()[0] or 0), plain(df))[1])
    assert sorted((r.qid, r["rank"], r.did, r.score) for r in lexical.search(index, queries, "q", "text", 4).collect()) == want
    assert lexical.asked_terms(index, queries, "q", "text").count() > 200
    assert 0 < max(sent) <= 150


@pytest.mark.parametrize("cells", [lexical.CELLS, 500])
def test_a_block_scores_its_queries_together(spark, monkeypatch, cells):
    """As tables of a bounded number of scores, not query by query; the best are those of all hits."""
    docs = spark.createDataFrame(list(enumerate(zipf_texts(100, 7))), "d long, text string").coalesce(1)
    queries = spark.createDataFrame([(i, " ".join(t.split()[:6])) for i, t in enumerate(zipf_texts(300, 8))], "q long, text string")
    index = lexical.build(docs, "d", "text")
    avgdl = index.stats.first()["avgdl"]
    tail = F.sum("up").over(Window.partitionBy("qid").orderBy("up", "term"))
    asked = lexical.asked_terms(index, queries, "q", "text").withColumn("late", tail < 2).withColumn("rest", F.lit(2.0)).withColumn("least", F.lit(2.0))
    asks = asked.groupBy("term").agg(F.first("idf").alias("idf"), *[F.collect_list(c).alias(c) for c in ("qid", "late", "least", "rest")], F.collect_list(F.lit(4)).alias("want"))
    block = index.blocks.select("term", "most", *[F.col(f"entries.{c}").alias(c) for c in ("did", "tf", "dl")]).join(asks, "term").toArrow()
    rounded, plain = [], np.round
    monkeypatch.setattr(lexical.np, "round", lambda *x: (rounded.append(1), plain(*x))[1])
    monkeypatch.setattr(lexical, "CELLS", cells)
    got = sorted((r["qid"], -r["score"], r["did"]) for r in lexical.scored_block(block, avgdl)[0].to_pylist())
    assert len(rounded) <= 300 * 100 / cells + 1
    want = sorted((r.qid, -r.score, r.did) for r in lexical.top_k(lexical.scores(index, queries, "q", "text"), 4).collect())
    assert [(q, d) for q, _, d in got] == [(q, d) for q, s, d in want if s <= -2] and len(got) > 500


def test_bm25_search_equals_scoring_all_hits(spark, sf):
    index = shared.bm25(spark, sf)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    scored = lexical.scores(index, items, "item_id", "text")
    rows = lambda d: sorted((r.qid, r["rank"], r.did, r.score) for r in d.collect())
    assert rows(lexical.search(index, items, "item_id", "text", 20)) == rows(lexical.top_k(scored, 20))
    qrels = scored.where("did % 3 = 0").select("qid", "did")
    pairs = lambda d: sorted((r.qid, r["rank"], r.did) for r in d.collect())
    assert pairs(negatives.mined_from(index, items, "item_id", "text", qrels, 4)) == pairs(negatives.mined(scored, qrels, 4))


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([], "d long, text string")
    q = spark.createDataFrame([(1, "a")], "q long, text string")
    assert lexical.search(lexical.build(docs, "d", "text"), q, "q", "text", 3).count() == 0
    some = spark.createDataFrame([(1, "a a"), (1, "a b"), (2, "b")], "d long, text string")  # an id twice
    index = lexical.build(some, "d", "text")
    rows = lambda d: sorted((r.did, r.score) for r in d.collect())
    assert rows(lexical.search(index, q, "q", "text", 3)) == rows(lexical.scores(index, q, "q", "text"))


# -- q-grams -------------------------------------------------------------------------------


def test_anchors_are_the_same_in_any_surroundings():
    rng = random.Random(0)
    for _ in range(200):
        inner = bytes(rng.choices(b"ab c", k=rng.randint(31, 90)))
        left, right = bytes(rng.choices(b"ab c", k=rng.randint(0, 50))), bytes(rng.choices(b"ab c", k=rng.randint(0, 50)))
        code, at = grams.anchors(inner)
        assert len(code)
        around_ = set(zip(*(x.tolist() for x in grams.anchors(left + inner + right)), strict=True))
        assert {(c, p + len(left)) for c, p in zip(code.tolist(), at.tolist(), strict=True)} <= around_
        rank = grams._order(grams._codes(np.frombuffer(inner, np.uint8), grams.LONG))
        assert at.tolist() == sorted({i + int(rank[i : i + grams.WINDOW].argmin()) for i in range(len(rank) - grams.WINDOW + 1)})
    assert len(grams.anchors(b"x" * 30)[0]) == 0


@pytest.mark.parametrize(("entries", "short"), [(grams.ENTRIES, True), (20, False)])
def test_containing_equals_comparing_all(spark, entries, short, monkeypatch, tmp_path):
    monkeypatch.setattr(grams, "ENTRIES", entries)
    rng = random.Random(4)
    words = ["Aé", "b", "cd", "日本", "ÉCOLE", "x y", ".", "longerword"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(150)] + [None, "", " ", "İstanbul", "a" * 200, "a" * 199 + "b"]
    items = [t[i : i + n] for t in texts[:40] for i, n in [(rng.randrange(len(t)), rng.choice([1, 2, 3, 5, 20, 31, 60]))]]
    items += ["", " ", "a", "aa", "A" * 40, "absent", "b" * 50, None, "école", "日", texts[0], texts[0] + "!", "istanbul"]
    items += items[:3]  # equal strings under further ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([*enumerate(items), (0, "b")], "item_id long, text string")  # an id with two strings
    grams.build(docs, "doc_id", "text", short).save(str(tmp_path / "g"))
    index = grams.GramIndex.load(spark, str(tmp_path / "g"), short)
    found = grams.containing(index, docs, "doc_id", "text", asked, "item_id", "text")
    assert no_product(found)
    low = {(r.k, r.low) for r in docs.select(F.col("doc_id").alias("k"), F.lower("text").alias("low")).collect()}
    ask = {(r.k, r.low) for r in asked.select(F.col("item_id").alias("k"), F.lower("text").alias("low")).collect()}
    want = collections.Counter((i, d) for i, s in ask for d, t in low if s is not None and t is not None and s in t)
    assert {(r.item, r.did) for r in found.collect()} == set(want)


# -- the session's indexes -----------------------------------------------------------------


def test_session_index_follows_its_table(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    docs = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    docs("a b").write.parquet(at)
    calls = []

    def broken(df, path):
        calls.append(path)
        if len(calls) == 1:
            raise OSError("disk full")
        df.write.parquet(path)

    with pytest.raises(OSError, match="disk full"):
        shared.written(spark, at, "try", broken)
    first = shared.written(spark, at, "try", broken)
    assert shared.written(spark, at, "try", broken) == first
    assert len(calls) == 2
    docs("a b", "c").write.mode("overwrite").parquet(at)
    assert spark.read.parquet(shared.written(spark, at, "try", broken)).count() == 2
    assert shared.bm25(spark, str(tmp_path)).stats.first()["n"] == 2


def test_a_block_is_full_by_tokens():
    """Long documents don't make a block of any size: it ends with the document that fills it, wherever a batch ends."""
    dl = np.full(4096, 20_000)
    assert lexical._room(dl, lexical.DOCS, lexical.TOKENS) == 50
    assert lexical._room(dl, lexical.DOCS, lexical.TOKENS - 990_000) == 1
    assert lexical._room(dl[:3], lexical.DOCS, lexical.TOKENS) == 3 and lexical._room(dl, 7, lexical.TOKENS) == 7
    assert lexical._room(np.zeros(9, int), 20, 100) == 9
