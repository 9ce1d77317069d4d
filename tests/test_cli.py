"""Commands end to end over small folders."""

from __future__ import annotations

import json

from lodestar import cli
from lodestar.operators import clusters
from lodestar.sources.teacher import TeacherStore


def folder(at, shift: int):
    at.mkdir()
    (at / "qrels").mkdir()
    docs = ["red fox runs", "blue bird sings", "green frog jumps", "old dog sleeps"]
    (at / "corpus.jsonl").write_text("".join(json.dumps({"_id": f"d{i + shift}", "title": "", "text": t}) + "\n" for i, t in enumerate(docs)))
    (at / "queries.jsonl").write_text("".join(json.dumps({"_id": f"q{i}", "text": q}) + "\n" for i, q in enumerate(["fox", "frog jumps"])))
    (at / "qrels" / "test.tsv").write_text(f"query-id\tcorpus-id\tscore\nq0\td{shift}\t1\nq1\td{2 + shift}\t1\n")
    return str(at)


def test_collections(spark, tmp_path):
    folders = [folder(tmp_path / "one", 0), folder(tmp_path / "two", 7)]
    for kind in ("bm25", "dense"):
        out = str(tmp_path / kind)
        cli.main(["evaluate-collections", "--folders", *folders, "--output", out, "--kind", kind, "--depth", "4"])
        rows = {(r.dataset, r.metric, r.k): float(r.value) for r in spark.read.option("header", True).csv(f"{out}/metrics").collect()}
        k = "1" if kind == "bm25" else "5"  # the hashing encoder stands in for a model: all four documents are found, in an order of its own
        assert rows["one", "recall", k] == rows["two", "recall", k] == rows["average", "recall", k] == 1.0
        details = spark.read.json(f"{out}/details")
        assert details.count() == 4
        assert all(r[f"hit@{k}"] for r in details.collect())


def test_runs_index_store_and_mix(spark, tmp_path):
    records = tmp_path / "records"
    records.mkdir()
    (records / "a.json").write_text('{"run": "r", "step": 1, "value": 0.5}\n{"run": "r", "step": 2, "value": 0.25}\n')
    call = ["follow-runs", "--records", str(records), "--board", str(tmp_path / "board"), "--output", str(tmp_path / "best"), "--lower"]
    cli.main(call)
    (records / "b.json").write_text('{"run": "r", "step": 3, "value": 0.75}\n')
    cli.main(call)
    (row,) = spark.read.json(str(tmp_path / "best")).collect()
    assert (row.best_step, row.best, row.n, row.stale) == (2, 0.25, 3, 1)
    texts = str(tmp_path / "texts.jsonl")
    spark.createDataFrame([(i, f"word{i} word{i % 5}") for i in range(60)], "id long, text string").coalesce(1).write.json(texts)
    cli.main(["build-index", "--input", texts, "--output", str(tmp_path / "ivf"), "--kind", "ivf", "--lists", "4", "--text", "text"])
    assert clusters.Lists.load(spark, str(tmp_path / "ivf")).sizes.sum() == 60
    cli.main(["teacher-store", "--input", texts, "--output", str(tmp_path / "store")])
    assert TeacherStore(spark, str(tmp_path / "store")).row("all", 7).first().text == "word7 word2"
    for more, n in ((["--size", "10"], 10), (["--keep-proportions"], 60)):
        out = str(tmp_path / f"mix{n}")
        cli.main(["mix", "--inputs", texts, "--output", out, "--key", "id", *more])
        assert sorted(r.place for r in spark.read.parquet(out).collect()) == list(range(n))
