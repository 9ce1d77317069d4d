"""Retrievers inside pools, against a plain computation per question."""

from __future__ import annotations

import collections
import math

import pytest

from lodestar.operators import multihop


def by_hand(question: str, texts: list[str], okapi: bool) -> list[float]:
    docs = [t.lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs) or 1
    df = collections.Counter(w for d in docs for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) if okapi else math.log(1 + (n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    if okapi and idf:
        mean = sum(idf.values()) / len(idf)
        idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    asked = question.lower().split()
    asked = asked if okapi else list(dict.fromkeys(asked))
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in asked) for d in docs]


def test_pools_have_their_own_counts(spark):
    pools = {1: ("a b a", ["a a c", "b d", "a b c d", "e"]), 2: ("a z", ["a", "a b", "a c"]), 3: ("", ["a", ""])}
    rows = [(q, 10 * q + i, question, t, [1.0, float(i)], [float(i), 1.0]) for q, (question, texts) in pools.items() for i, t in enumerate(texts)]
    rows.append((3, 39, "", None, [0.0, 0.0], [1.0, 1.0]))
    pairs = spark.createDataFrame(rows, "qid int, did int, question string, text string, qv array<double>, dv array<double>").repartition(3)
    got = {(r.qid, r.did): r for r in multihop.scored(pairs, {"cos": ("qv", "dv")}).collect()}
    assert len(got) == len(rows)
    for q, (question, texts) in pools.items():
        if q != 3:
            for name, okapi in (("bm25", False), ("okapi", True)):
                assert [got[q, 10 * q + i][name] for i in range(len(texts))] == pytest.approx(by_hand(question, texts, okapi), abs=2e-6)
    assert got[3, 39].cos == 0.0
    assert got[1, 11].cos == 1.0
    run = multihop.ranked(multihop.scored(pairs, {"cos": ("qv", "dv")}), ["bm25", "okapi", "cos"])
    ranks = {(r.method, r.qid, r.did): r["rank"] for r in run.collect()}
    fused = {d: sum(1 / (60 + ranks[m, 1, d]) for m in ("bm25", "okapi", "cos")) for d in range(10, 14)}
    assert [ranks["fused", 1, d] for d in sorted(fused, key=lambda d: (-round(fused[d], 9), d))] == [1, 2, 3, 4]
    gold = spark.createDataFrame([(1, 10), (1, 12), (2, 20), (7, 1), (7, 2)], "qid int, did int")
    rows_ = {r.method: r for r in multihop.evaluated(run, gold, ["bm25", "fused"], ks=(1, 4)).collect()}
    assert rows_["bm25"].n_valid == 2  # question 2 has one gold, question 7 no run
    assert rows_["bm25"]["recall@4"] == rows_["bm25"]["all@4"] == 0.5
    assert rows_["bm25"].mrr == 0.5


def test_pools_of_nothing(spark):
    none = spark.createDataFrame([], "qid int, did int, question string, text string")
    assert multihop.scored(none).count() == 0
