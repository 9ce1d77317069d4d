"""The board of runs: batches as one, repeated files and batches, late records, the matrix."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lodestar.streaming.runs import RunBoard, matrix, summary

SCHEMA = "run string, step long, value double, note string"


def by_hand(rows: list[tuple], higher: bool = True) -> dict:
    out = {}
    for run in {r[0] for r in rows if None not in r[:3]}:
        mine = {s: v for r, s, v, _ in rows if r == run and s is not None and v is not None}
        sign = 1 if higher else -1
        step = min(mine, key=lambda s: (-sign * mine[s], s))
        out[run] = (step, mine[step], max(mine), len(mine), sum(s > step for s in mine))
    return out


def board_rows(board) -> dict:
    return {r.run: (r.best_step, r.best, r.last_step, r.n, r.stale) for r in board.best().collect()}


def test_batches_give_the_same_board_as_one(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abcd"), s, round(rng.random(), 2), "x") for s in range(200)]
    rows += [("e", 1, 0.5, None), ("e", 2, 0.5, None), (None, 1, 1.0, None), ("f", None, 1.0, None), ("g", 3, None, None)]
    rng.shuffle(rows)  # later files have earlier steps
    files = [rows[i::5] for i in range(5)]
    at = str(tmp_path / "in")
    put = lambda part, n: spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(at)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    board = RunBoard(spark, str(tmp_path / "board"))
    assert board.best() is None
    for i, part in enumerate(files[:3]):
        put(part, i)
    board.follow(stream())
    assert board_rows(board) == by_hand([r for f in files[:3] for r in f])
    put(files[3], 3)
    put(files[4], 4)
    put(files[0], 5)  # a file that arrives twice
    board.follow(stream())
    assert board_rows(board) == by_hand(rows)
    read = spark.read.parquet(str(tmp_path / "board" / "records")).groupBy("batch").count().collect()
    assert sum(r["count"] for r in read) == len({r[:2] for r in rows if None not in r[:3]})
    board.follow(stream())  # nothing new
    assert board_rows(board) == by_hand(rows)
    once = RunBoard(spark, str(tmp_path / "once"), higher=False)
    once.absorb(spark.createDataFrame(rows, SCHEMA), 0)
    once.absorb(spark.createDataFrame(rows, SCHEMA), 0)  # the batch again
    assert board_rows(once) == by_hand(rows, higher=False)
    assert {r.run for r in once.stopped(20).collect()} == {k for k, v in by_hand(rows, higher=False).items() if v[4] >= 20}


def test_matrix(spark, tmp_path):
    planned = matrix(spark, {"model": ["m", "n"], "rate": [0.1, 0.2]})
    assert {r.run for r in planned.collect()} == {"model=m,rate=0.1", "model=m,rate=0.2", "model=n,rate=0.1", "model=n,rate=0.2"}
    board = RunBoard(spark, str(tmp_path / "b"))
    assert summary(planned, board.best()).where("state = 'pending'").count() == 4
    board.absorb(spark.createDataFrame([("model=m,rate=0.1", 1, 0.25, None), ("other", 1, 0.5, None)], SCHEMA), 0)
    rows = {r.run: (r.state, r.primary, r.best_step) for r in summary(planned, board.best()).collect()}
    assert rows["model=m,rate=0.1"] == ("done", 0.25, 1)
    assert rows["model=n,rate=0.2"] == ("pending", 0.0, None)
    assert len(rows) == 4
    assert board.best().where(F.col("run") == "other").count() == 1
