"""Operators on small tables worked out by hand."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.functions import text as T
from lodestar.functions import vector as V
from lodestar.operators import align, answers, batch_eval, chat, dense, lexical, mixing, models, negatives, ranking, report
from lodestar.sources import readers, sinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_text_functions(spark):
    r = one(
        spark,
        T.word_tokens(F.lit("Straße, a-b 4")),
        T.normalized(F.lit("  Don't\tSTOP. ")),
        T.slug(F.lit("--A b!!")),
        T.slug(F.lit("!!")),
        T.entity_id(F.lit("http://x/entity/Q42")),
        T.entity_id(F.lit("x")),
        T.prompt("D: {document} Q: {question}", F.lit("d"), F.lit(None)),
        T.titled_document(F.lit("t"), F.array(F.lit("a"), F.lit("b"))),
        T.unix_lines(F.lit("a\r\nb")),
        T.word_tokens(F.lit(None)),
    )
    assert list(r) == [["straße", "a", "b", "4"], "dont stop", "a-b", "run", "Q42", None, "D: d Q: ", "t: a b", "a\nb", []]


def test_answer_functions(spark):
    rows = spark.createDataFrame(
        [("It is Paris!", ["paris"], None), ("x", [""], None), ("x", [], None), (None, ["y"], None), ("Oslo", None, "oslo")], "answer string, possible_answers array<string>, obj string"
    )
    assert [r.correct for r in answers.in_accuracy(rows, "answer").collect()] == [True, True, False, False, True]
    pairs = spark.createDataFrame([("a b b", "b c"), ("", "a"), (None, None)], "r string, c string")
    got = answers.simple_metrics(pairs, "r", "c").collect()
    assert (got[0].jaccard, got[0].word_overlap, got[0].length_ratio) == (pytest.approx(1 / 3), 0.5, pytest.approx(2 / 3))
    assert got[1].jaccard is None and got[2].jaccard is None
    assert answers.simple_means(answers.simple_metrics(pairs, "r", "c")).first().n == 3
    assert one(spark, answers.char_similarity(F.lit("abcd"), F.lit("bcde")).alias("x")).x == 0.75


def test_judges_are_matched_by_key(spark):
    rows = spark.createDataFrame([(i,) for i in range(6)], "id long").coalesce(1)

    def judge(batch):
        if any(r["id"] == 4 for r in batch):
            raise RuntimeError("down")
        return [{"id": r["id"], "score": 1.0, "label": "ok"} for r in reversed(batch) if r["id"] != 1]

    got = {r.id: (r.score, r.label, r.rationale) for r in answers.judged(rows, "id", judge, 2).collect()}
    assert got[0] == (1.0, "ok", "") and got[1] == (-1.0, "error", "no verdict") and got[4] == (-1.0, "error", "down")
    assert answers.valid_mean(answers.judged(rows, "id", judge, 2), "score").first().n_valid == 3


@pytest.mark.parametrize(
    ("relevant", "retrieved", "k", "recall", "precision", "mrr", "ndcg"),
    [
        ("a", "abc", 3, 1, 1 / 3, 1, 1),
        ("c", "abc", 3, 1, 1 / 3, 1 / 3, 0.5),
        ("c", "abc", 2, 0, 0, 0, 0),
        ("ac", "abc", 3, 1, 2 / 3, 1, 1.5 / (1 + 1 / math.log2(3))),
        ("a", "a", 5, 1, 1 / 5, 1, 1),
    ],
)
def test_ranking_cases(spark, relevant, retrieved, k, recall, precision, mrr, ndcg):
    qrels = spark.createDataFrame([(1, d) for d in relevant], "qid int, did string")
    run = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate(retrieved)], "qid int, did string, rank int")
    r = ranking.per_query(run, qrels, ks=(k,)).first()
    assert [r[f"{m}@{k}"] for m in ("recall", "precision", "mrr", "ndcg")] == pytest.approx([recall, precision, mrr, ndcg])


def test_queries_without_qrels(spark):
    qrels = spark.createDataFrame([(1, "a")], "qid int, did string")
    run = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "qid int, did string, rank int")
    both = spark.createDataFrame([(1,), (2,)], "qid int")
    assert ranking.means(ranking.per_query(run, qrels)).first().mrr == 1
    assert ranking.means(ranking.per_query(run, qrels, both)).first().mrr == 0.5
    assert ranking.means(ranking.per_query(run.limit(0), qrels.limit(0))).first().mrr == 0


def test_metric_rows(spark):
    wide = spark.sql("SELECT 0.5D AS mrr, 0.25D AS `recall@10`, 1D AS `x@abc`, named_struct('a@2', 1D) AS s")
    got = {(r.metric, r.k): r.value for r in ranking.long_rows(wide, "d", "r", "s").collect()}
    assert got == {("mrr", None): 0.5, ("recall", 10): 0.25, ("x@abc", None): 1.0, ("s.a", 2): 1.0}
    with pytest.raises(ValueError):
        ranking.long_rows(spark.sql("SELECT named_struct('a', named_struct('b', 1)) AS s"), "d", "r", "s")


def test_tie_rules(spark):
    sims = spark.createDataFrame([(0, 1, 0, 0.5), (0, 1, 1, 0.5), (0, 0, 0, 0.1), (0, 0, 1, 0.9)], "batch_id long, q int, d int, sim double")
    rank = lambda tie: {r.q: r["rank"] for r in batch_eval.partner_ranks(sims, tie).collect()}
    assert rank("rank") == {0: 2, 1: 1} and rank("row_number") == {0: 2, 1: 2}


def test_short_batches_go(spark):
    rows = spark.range(5).withColumnRenamed("id", "pos")
    assert batch_eval.batches(rows, "pos", 2).count() == 4


def test_bm25(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, ""), (4, None)], "d int, text string")
    index = lexical.build(docs, "d", "text")
    assert tuple(index.stats.first()) == (4, 1.25)
    q = spark.createDataFrame([(9, "a A zzz")], "q int, text string")
    (hit,) = lexical.search(index, q, "q", "text", 5).collect()
    idf = math.log(1 + 3.5 / 1.5)
    assert hit.did == 1 and hit.score == pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 1.25)), abs=1e-6)


def test_index_is_stored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "d int, text string")
    lexical.build(docs, "d", "text").save(str(tmp_path / "i"))
    back = lexical.Index.load(spark, str(tmp_path / "i"))
    assert back.terms.count() == 2


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_dense_search_in_blocks(spark, metric):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(120, 4)), 1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "vec_id long, vec array<double>").repartition(3)
    got = dense.search(rows, rows.where("vec_id % 7 = 0"), 5, metric, block=16).collect()
    want = set()
    for i in range(0, 120, 7):
        s = np.round(v @ v[i], 6) if metric == "ip" else np.round(-((v - v[i]) ** 2).sum(1), 6)
        order = sorted((j for j in range(120) if j != i), key=lambda j: (-s[j], j))[:5]
        want |= {(i, j, r + 1) for r, j in enumerate(order)}
    assert {(r.qid, r.did, r["rank"]) for r in got} == want


def test_pooling(spark):
    m = F.array(F.array(F.lit(1.0), F.lit(-4.0)), F.array(F.lit(3.0), F.lit(-2.0)))
    r = one(spark, *[V.pooled(m, h).alias(h) for h in ("mean", "first", "last", "max", "mean_max", "flatten")], V.masked_mean(m, F.array(F.lit(0), F.lit(1))).alias("mm"), V.last_token(m, F.array(F.lit(1), F.lit(0))).alias("lt"), V.unit(F.array(F.lit(0.0))).alias("z"))
    assert r.asDict() == {"mean": [2, -3], "first": [1, -4], "last": [3, -2], "max": [3, -2], "mean_max": [2, -3, 3, -2], "flatten": [1, -4, 3, -2], "mm": [3, -2], "lt": [1, -4], "z": [0]}


def test_passage_groups(spark):
    rows = spark.createDataFrame(
        [("q1", (["a", "b", "c"], [0, 1, 1])), ("q2", (["a"], [0])), ("q3", (["a"], [1]))], "query string, passages struct<passage_text: array<string>, is_selected: array<int>>"
    )
    assert {r["query"]: (r.positive, r.negatives) for r in negatives.passage_groups(rows).collect()} == {"q1": ("b", ["a"]), "q3": ("a", ["a"])}


def test_random_negatives(spark):
    q, d = spark.range(20).withColumnRenamed("id", "qid"), spark.range(3000).withColumnRenamed("id", "did")
    qrels = q.select("qid", F.col("qid").alias("did"))
    rows = negatives.hashed(q, d, qrels, 7).collect()
    per = {}
    for r in rows:
        per.setdefault(r.qid, set()).add(r.did)
    assert all(len(per[i]) == 7 and i not in per[i] for i in range(20))
    assert sorted(map(str, rows)) == sorted(map(str, negatives.hashed(q, d.repartition(5), qrels, 7).collect()))
    best = negatives.mixed(spark.createDataFrame([(0, 5, 1), (0, 6, 2)], "qid long, did long, rank int"), spark.createDataFrame([(0, 5, 1), (0, 8, 2), (0, 9, 3)], "qid long, did long, rank int"), 1, 2)
    assert sorted((r.did, r.kind, r["rank"]) for r in best.collect()) == [(5, "mined", 1), (8, "random", 1), (9, "random", 2)]


def test_splits(spark):
    rows = spark.range(101).withColumnRenamed("id", "k")
    got = mixing.hash_split(rows, "k", 1, 0.1)
    assert got.where("split = 'val'").count() == 10 and got.count() == 101
    assert mixing.hash_split(rows, "k", 1, 0.001, least=1).where("split = 'val'").count() == 1
    assert mixing.hash_split(rows, "k", 1, 1.0).where("split = 'val'").count() == 101
    with pytest.raises(ValueError):
        mixing.hash_split(rows.limit(1), "k", 1, 0.5, least=1)
    assert mixing.hash_split(rows.limit(0), "k", 1, 0.0).count() == 0


def test_numbering_and_first(spark):
    rows = spark.createDataFrame([(i * 3 % 50, f"t{i % 7}") for i in range(50)], "k long, t string").repartition(7)
    assert [r.pos for r in mixing.numbered(rows, "k").orderBy("k").collect()] == list(range(50))
    assert {r.t: r.k for r in mixing.first_by(rows, "t", "k").collect()} == {r.t: r.m for r in rows.groupBy("t").agg(F.min("k").alias("m")).collect()}
    assert mixing.quotas({"a": 3, "b": 1}, 10) == {"a": 7, "b": 2}


def test_chat_records(spark):
    s = spark.createDataFrame([(0, "story", ["q1", "q2"], (["a1", "a2"],)), (1, "s", ["q"], ([],))], "pos long, story string, questions array<string>, answers struct<input_text: array<string>>")
    (r,) = chat.conversational(s, "coqa").collect()
    assert [m.role for m in r.messages] == ["user", "assistant"] * 2 and "q1" in r.messages[0].content and r.messages[2].content == "q2" and r.background == "story"
    c = spark.createDataFrame([(0, "q?", ["a", "b", "c", "d", "e"], 7, "ctx"), (1, "q?", ["a", "b"], 1, None)], "pos long, question string, answers array<string>, correct_answer_id int, context string")
    rows = {r.id: r for r in chat.index_choice(c, "quail").collect()}
    assert rows["quail_0"].messages[1].content == "A" and rows["quail_1"].messages[1].content == "B" and "D. d" in rows["quail_0"].messages[0].content and "e" not in rows["quail_0"].messages[0].content.split("\n")[-1]
    e = spark.createDataFrame([(0, "q", [])], "pos long, question string, answers array<string>")
    assert chat.short_answer(e, "squad", no_answer="I don't know.").first().messages[1].content == "I don't know."
    d = spark.createDataFrame([(0, "a\r\nb", "s"), (1, " ", "s")], "pos long, dialogue string, summary string")
    (r,) = chat.summaries(d, "sum").collect()
    assert r.background == "a\nb"
    w = spark.createDataFrame([(0, "q", "n", 0), (1, "q", "y", 1), (2, "q", "y2", 1)], "pos long, question string, answer string, label int")
    assert [r.id for r in chat.labelled_pairs(w, "wiki", limit=1).collect()] == ["wiki_1"]
    both = chat.mix([chat.labelled_pairs(w, "wiki"), chat.labelled_pairs(w, "wiki")])
    assert both.count() == 2 and len({r.order for r in both.collect()}) == 2
    m = spark.createDataFrame([(0, None, (["A", "B"], ["x", "y"]), "B")], "pos long, question string, choices struct<label: array<string>, text: array<string>>, answerKey string")
    assert "A. x\nB. y" in chat.multiple_choice(m, "csqa").first().messages[0].content
    f = spark.createDataFrame([(0, "c", "SUPPORTS", "e")], "pos long, claim string, label string, evidence string")
    assert chat.claims(f, "fm2").first().messages[1].content == "True"


def test_alignment(spark):
    scored = spark.createDataFrame([(1, 0, 0, 0.2), (1, 0, 1, 0.8), (1, 1, 0, 0.4), (1, 1, 1, 0.1)], "id int, h int, p int, score double")
    assert align.alignment(scored, "id").first().score == 0.6
    n = align.smart_n(scored, "id").first()
    assert (n.precision, n.recall) == pytest.approx((0.6, 0.6))
    assert align.smart_l(scored, "id").first().precision == pytest.approx(0.4)  # in order: 0.8, or 0.2 + 0.1, or 0.4
    rows = spark.createDataFrame(
        [(i, t, "A", ["b0", "b1"], ["c0"] if i % 2 else [], 1.0) for i, t in enumerate(list(align.TASKS) * 3)], "id long, task string, text_a string, text_b array<string>, text_c array<string>, orig_label double"
    )
    out = align.augmented(rows).collect()
    assert len(out) == 39
    for r in out:
        kind = align.TASKS[r.task][0]
        assert sum(r[k] != -100 for k in ("tri", "bin", "reg")) == 1 and r[kind] != -100
        if r.task in ("qa", "coreference"):
            assert r.text_b == ("b0 c0" if r.id % 2 else "b0")


def test_reports(spark):
    runs = spark.createDataFrame([("a", 0.5, 1), ("b", 0.9, 2), ("c", 0.9, 3), ("d", None, 4)], "run string, m double, o int")
    assert report.best_run(runs, "m", "o").first().run == "b"
    h = spark.createDataFrame([(1, i, v) for i, v in enumerate([3.0, 2.0, 2.0, 2.5, 1.0, 1.0])], "c int, s int, v double")
    marks = report.curve_marks(h, "c", "s", "v")
    assert [(r.is_best, r.stale) for r in marks.orderBy("s").collect()] == [(True, 0), (True, 0), (False, 1), (False, 2), (True, 0), (False, 1)]
    assert report.stop_step(marks, "c", "s", 2).first().stop == 3
    d = report.curve_deltas(h, "c", "s", "v").first()
    assert (d.gain, d.ratio) == (-2.0, 0.333333)
    u = report.combined({"x": runs.select("run"), "y": runs.select("m")})
    assert u.count() == 8 and set(u.columns) == {"run", "m", "report"}
    flat = spark.createDataFrame([("a", "mrr", 0.2), ("a", "x.mrr", 0.9), ("b", "loss", 3.0)], "run string, key string, value double")
    assert {r.run: r.value for r in report.deepest_metric(flat, "run", ["mrr", "x.mrr"]).collect()} == {"a": 0.9, "b": 0.0}


def test_models(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id long, t string")
    v = {r.id: r.vec for r in models.encode(rows, "t", "hashing", dim=8).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1, abs=1e-6) and v[2] == v[3] == [0] * 8
    with pytest.raises(ValueError):
        models.build_encoder("nope")

    def flaky(docs, asks):
        if len(docs) > 1 or docs[0] == "bad":
            raise RuntimeError
        return [f"{docs[0]}!"]

    some = spark.createDataFrame([("x",), ("bad",), ("",), ("y",)], "d string").coalesce(1)
    got = models.generate(some, "d", flaky, samples=2).collect()
    assert sorted((r.d, r["sample"], r.answer) for r in got) == sorted((d, s, a) for s in (1, 2) for d, a in (("x", "x!"), ("bad", ""), ("", ""), ("y", "y!")))


def test_sources_and_sinks(spark, tmp_path):
    c = tmp_path / "coll"
    (c / "qrels").mkdir(parents=True)
    (c / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": " x "}\n\n{"_id": "2", "title": "", "text": ""}\n{"_id": "1", "text": "last"}\n')
    (c / "queries.jsonl").write_text('{"_id": "q", "text": "last"}\n')
    (c / "qrels/test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t1\nq\t2\t0\nq\t1\t1\nq\t9\t\n")
    corpus, queries, qrels = readers.read_collection(spark, str(c))
    assert {r.did: r.text for r in corpus.collect()} == {"1": "last", "2": ""}
    assert [(r.qid, r.did) for r in qrels.collect()] == [("q", "1")]
    cli.main(["evaluate-collection", "--folder", str(c), "--output", str(tmp_path / "out")])
    assert json.loads((tmp_path / "out/bm25_metrics.json").read_text())["mrr"] == 1
    (tmp_path / "l.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_records(spark, str(tmp_path / "l.json")).count() == 2
    (tmp_path / "o.json").write_text('{"a": 1}')
    with pytest.raises(ValueError):
        readers.read_records(spark, str(tmp_path / "o.json"))
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.bin")
    sinks.write_csv(spark.sql("SELECT 1 AS b, null AS a"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"]
    got, failed = readers.tolerant_union({"ok": lambda: spark.range(2), "bad": lambda: 1 / 0}, on_error="skip")
    assert got.count() == 2 and "division" in failed["bad"]
    layout = sinks.run_layout(str(tmp_path), "My Run!")
    assert layout["root"].endswith("_my-run")
    vec = spark.createDataFrame([(0, "a", [1.0])], "pos long, id string, vec array<float>")
    sinks.write_index(vec, str(tmp_path / "ix"), encoder="e")
    assert sinks.read_index(spark, str(tmp_path / "ix"))[1] == {"encoder": "e", "schema_version": 1}


def test_enrichment(spark):
    qa = spark.createDataFrame([(1, "http://e/entity/Q1", "x", None, "old")], "id long, s_uri string, o_uri string, s_wiki_title string, o_wiki_title string").withColumn("s_wiki_content", F.lit(None).cast("string")).withColumn("o_wiki_content", F.lit(None).cast("string"))
    titles = spark.createDataFrame([("Q1", "One")], "qid string, title string")
    r = readers.enriched(qa, titles, lambda names: [f"page of {n}" for n in names]).first()
    assert (r.s_wiki_title, r.o_wiki_title, r.s_wiki_content, r.o_wiki_content) == ("One", "old", "page of One", "page of old")


def test_paragraphs(spark):
    rows = spark.createDataFrame(
        [("a", "q", "x", (["t", "u"], [["s1", "s2"], []]), (["t", "u"],)), ("b", "q", "x", (["t", "u"], [["s"], ["s"]]), (["t"],))], readers.SCHEMAS["multi_paragraph"]
    )
    corpus, questions = readers.paragraphs(rows)
    assert [r.qid for r in questions.collect()] == ["a"] and corpus.first().text == "t s1 s2" and corpus.count() == 4


def test_numbered_keeps_every_row(spark, tmp_path):
    """With further columns, over files and many partitions: positions 0..n-1 in the key's order, no row lost."""
    from lodestar.operators import mixing

    n = 1_000_000
    df = spark.range(n).selectExpr("(id * 7919) % 1000003 AS k", "concat('x', id) AS more", "id AS slice").repartition(16)
    mixing.numbered(df, "k").write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == ["k", "more", "slice", "pos"] and got.count() == n
    assert got.selectExpr("count(distinct pos)", "min(pos)", "max(pos)", "count(distinct more)").first()[0:] == (n, 0, n - 1, n)
    wrong = got.selectExpr("k", "pos", "lag(k) OVER (PARTITION BY pos div 10000 ORDER BY pos) AS was").where("was > k").count()
    assert wrong == 0


def test_ranks_over_slices(spark, monkeypatch):
    """Positions within groups don't depend on how many slices the rows are cut into."""
    from lodestar.operators import mixing

    rows = [(i, ("a", "b", None)[i % 3], (i * 37) % 500) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, g string, pos long").repartition(5)
    key = lambda out: sorted((r.id, r.r, r.n) for r in out.collect())
    from pyspark.sql import functions as F

    one = key(mixing.ranked_within(df, "g", [F.col("pos"), F.col("id")], "r", "n"))
    split = {r.id: r.split for r in mixing.hash_split(df, "id", 3, 0.1).collect()}
    tail = {r.id: r.split for r in mixing.tail_split(df, "g", "pos", 0.1).collect()}
    monkeypatch.setattr(mixing, "SLICE", 20)
    assert key(mixing.ranked_within(df, "g", [F.col("pos"), F.col("id")], "r", "n")) == one
    assert {r.id: r.split for r in mixing.tail_split(df, "g", "pos", 0.1).collect()}.keys() == tail.keys()
    assert sum(v == "val" for v in split.values()) == 60 and sum(v == "val" for v in tail.values()) == 60
    for g in ("a", "b", None):
        own = sorted(((r[2], r[0]) for r in rows if r[1] == g))
        want = {i: (k + 1, len(own)) for k, (_, i) in enumerate(own)}
        assert {i: (r, n) for i, r, n in one if i in want} == want
    assert mixing.numbered(df, "id").where("pos != id").count() == 0
    assert mixing.hash_sample(df, "id", 1, 7).count() == 7 and mixing.hash_sample(df, "id", 1, 7, "g").count() == 21


def test_driver_rules():
    from lodestar.operators import records

    assert records.arguments({"a_b": True, "c": [1, 2], "d": None, "e": False, "f": "x"}) == ["--a-b", "--c", "1", "2", "--f", "x"]
    assert records.chosen_configs(["x/b.yaml", "a/z.yaml", "x/ab.yaml"], "a") == ["a/z.yaml", "x/ab.yaml", "x/b.yaml"] and records.chosen_configs(["q/b", "a/c"], "b") == ["q/b"]
    assert records.renamed_class("old.models.X", {"old": "new", "old.models": "new.core"}) == "new.core.X" and records.renamed_class("older.X", {"old": "new"}) == "older.X"
    assert records.judge_settings({"api_key": "k"}, {"llm_base_url": "u", "model": "m"}) == {"base_url": "u", "api_key": "k", "model": "m"} and records.judge_settings({}, {"model": "m"}) is None
    assert records.template_of({}, {"template": "t"}, "m") == "t" and records.template_of({}, {}, "m") == "m"


def test_row_formats(spark):
    from lodestar.operators import records

    assert records.row_format(spark.createDataFrame([], "query string, positive string, negatives array<string>")) == "triplet"
    assert records.row_format(spark.createDataFrame([], "query string, passages string")) == "passages"
    with pytest.raises(ValueError):
        records.row_format(spark.createDataFrame([], "query string"))
    one = spark.createDataFrame([("a", ["b", "c"])], "x string, y array<string>")
    assert one.select(records.as_list(one, "x"), records.as_list(one, "y")).first()[0:] == (["a"], ["b", "c"])


def test_missing_curve_and_first_token(spark, tmp_path):
    assert readers.read_curve(spark, str(tmp_path / "none.csv")).collect() == []
    rows = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],), ([],), (None,)], "t array<array<double>>")
    assert [r.c for r in rows.select(V.cls_token(F.col("t")).alias("c")).collect()] == [[1.0, 2.0], None, None]


def test_relevance_by_label_equals_its_pairs(spark, monkeypatch):
    rows = [(i, "abc"[i % 3]) for i in range(40)] + [(40, None), (None, "a"), (41, "alone"), (0, "b"), (3, "a"), (3, "a"), (1, "b")]
    v = spark.createDataFrame(rows, "vec_id long, label string")
    asked = v.where("vec_id % 4 = 0 or vec_id in (1, 3, 41)")
    pairs = asked.select(F.col("vec_id").alias("qid"), "label").join(v.select(F.col("vec_id").alias("did"), "label"), "label").where("qid <> did").select("qid", "did")
    run = spark.createDataFrame([(q, d, r) for q in range(0, 42) for r, d in enumerate([q, (q * 7) % 40, (q + 3) % 40, 40, 41], 1)], "qid long, did long, rank int")
    want, gold = sorted(map(tuple, ranking.per_query(run, pairs).collect())), pairs.collect()
    tops = sorted((q, d) for q in {r.qid for r in gold} for d in sorted(r.did for r in gold if r.qid == q)[:3])
    monkeypatch.setattr(ranking, "per_query", None)
    assert sorted(map(tuple, ranking.per_query_by_label(run, v, asked, "vec_id", "label").collect())) == want
    found = ranking.first_of_label(v, asked, "vec_id", "label", 3)
    assert sorted(map(tuple, found.collect())) == tops


def test_distilled_loss_makes_no_row_of_a_pair(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i // 4, i % 4, *[None if i == 6 and c == 2 else rng.normal(size=5).round(3).tolist() for c in range(3)]) for i in range(11)]
    b = spark.createDataFrame(rows, "batch_id long, slot int, vec array<float>, pos array<float>, neg array<float>")
    mnr = {r.batch_id: r.loss for r in batch_eval.in_batch_softmax_loss(batch_eval.similarities(b, "vec", "pos"), 20.0).collect()}
    sims = [batch_eval.similarities(batch_eval.stacked(b, *p), "vec", "vec") for p in (("vec", "pos"), ("pos", "neg"))]
    kl = {r.batch_id: r.loss for r in batch_eval.self_similarity_kl(*sims, 2.0).collect()}
    monkeypatch.setattr(batch_eval, "similarities", None)
    got = batch_eval.ranking_distilled_loss(b, ("vec", "pos"), ("pos", "neg"), 0.5).collect()
    assert {r.batch_id: pytest.approx((mnr[r.batch_id], kl[r.batch_id]), abs=2e-6) for r in got} == {r.batch_id: (r.mnr, r.kl) for r in got} and len(got) == 3
