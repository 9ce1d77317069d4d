"""Samples, shuffles and interleaving; the teacher store."""

from __future__ import annotations

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from lodestar.operators import mixing, models, sampling
from lodestar.sources.teacher import TeacherStore, concatenated, encoded_store, write_store


def order(seed, keys):
    return sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), str(k)))


@pytest.fixture(scope="module")
def rows(spark):
    """A hot group, small ones, a null one; columns with the names of helpers."""
    return spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 7}" if i % 5 else None, 1, 2, "x") for i in range(500)], "id long, g string, nth int, way int, hash string").repartition(6)


def test_least_of_each_group(spark, rows):
    groups = collections.defaultdict(list)
    for r in rows.collect():
        groups[r.g].append(r.id)
    got = sampling.least(rows, "id", "s", 4, "g", rank="place")
    assert got.columns == [*rows.columns, "place"]
    want = {(g, k, i + 1) for g, ids in groups.items() for i, k in enumerate(order("s", ids)[:4])}
    assert {(r.g, r.id, r.place) for r in got.collect()} == want
    assert [r.id for r in sampling.least(rows, "id", "s", 6, rank="place").orderBy("place").collect()] == order("s", range(500))[:6]
    assert sampling.least(rows.where("id < 0"), "id", "s", 3).count() == 0


def test_sample_by_ranks_is_the_same(rows, monkeypatch):
    few = {r.id for r in sampling.sample(rows, "id", 9, 30, "g").collect()}
    monkeypatch.setattr(sampling, "MANY", 0)
    assert {r.id for r in sampling.sample(rows, "id", 9, 30, "g").collect()} == few


def test_every_prefix_keeps_proportions(rows, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 60)
    got = sampling.interleaved(rows, "g", "id", 1).orderBy("place").collect()
    assert [r.place for r in got] == list(range(500))
    sizes = collections.Counter(r.g for r in got)
    seen = collections.Counter()
    for r in got:
        seen[r.g] += 1
        share = (seen[r.g] - 0.5) / sizes[r.g]  # how far this row's own part has come: all others have come as far
        assert all(abs(seen[g] - n * share) <= 1 for g, n in sizes.items())


def test_shuffle_and_mix(spark, rows):
    assert [r.id for r in sampling.shuffled(rows, "id", 5).orderBy("place").collect()] == order(5, range(500))
    a, b = (spark.createDataFrame([(i,) for i in range(n)], "id int") for n in (10, 7))
    mixed = sampling.mixed_datasets({"a": a, "b": b}, "id", 0, {"a": 3, "b": 0.5}, "id").collect()
    assert sorted((r.dataset_name, r.id) for r in mixed) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2)]
    assert sorted(r.place for r in mixed) == list(range(6))
    assert sampling.mixed_datasets({"a": a, "b": b}, "id", 0).count() == 17


def test_pairs_go_as_far_as_the_shorter_side(spark, rows):
    q = spark.createDataFrame([(1, "a"), (2, None)], "id long, text string")
    d = rows.select("id", F.col("g").alias("text"))
    assert sorted(r.nth for r in sampling.paired(q, d, "id", "text", 0, 5).collect()) == [1, 2]


# -- the teacher store -----------------------------------------------------------------------


def vectors(spark, n: int):
    return spark.createDataFrame([("train" if i % 4 else "val/1", i, f"t{i}" if i % 9 else None, [float(i), -1.0]) for i in range(n)], "group string, pos long, text string, embedding array<double>")


def test_store_reads_one_file_for_a_row(spark, tmp_path):
    at = str(tmp_path / "store")
    with pytest.raises(ValueError, match="complete"):
        TeacherStore(spark, at).attributes()
    write_store(vectors(spark, 400).repartition(5), at, {"pooling": "last_token", "n": 400}, rows=50)
    store = TeacherStore(spark, at)
    assert store.attributes() == {"pooling": "last_token", "n": "400"}
    assert store.index().agg(F.sum("n")).first()[0] == 400
    assert store.index().count() >= 8
    one = store.row("train", 77)
    assert len(one.inputFiles()) == 1
    assert [(r.pos, r.text, r.embedding) for r in one.collect()] == [(77, "t77", [77.0, -1.0])]
    assert store.row("train", 76).count() == 0  # a position of the other group
    assert store.row("nowhere", 1).count() == 0
    val = store.rows("val/1")
    assert sorted(r.pos for r in val.collect()) == list(range(0, 400, 4))
    wanted = spark.createDataFrame([("train", 5), ("train", 5), ("val/1", 8), ("val/1", 9)], "group string, pos long")
    assert sorted((r.group, r.pos, r.text) for r in store.lookup(wanted).collect()) == [("train", 5, "t5"), ("val/1", 8, "t8")]
    both = concatenated([store, store], "train", 0.1).groupBy("file_no", "split").agg(F.count("*").alias("n"), F.min("pos").alias("low")).collect()
    assert {(r.file_no, r.split): r.n for r in both} == {(f, s): n for f in (0, 1) for s, n in (("train", 270), ("val", 30))}
    assert all(r.low == 361 for r in both if r.split == "val")


def test_texts_are_encoded_into_a_store(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a b"), (1, None), (2, "c")], "pos long, text string")
    store = encoded_store(docs, "text", lambda d: models.encode(d, "text", "hashing", dim=8), str(tmp_path / "s"), {"teacher_model_name": "hashing"})
    assert sorted((r.pos, r.text, len(r.embedding)) for r in store.rows().collect()) == [(0, "a b", 8), (1, "", 8), (2, "c", 8)]
