"""Vectors in lists: distributed k-means, an inverted-file index, exact search that skips lists by a bound.

A list is a cluster of rows with its centre and radius; it is cut into parts of about BLOCK rows by a hash of the id, so a
list that holds a third of all rows is many parts. Queries meet rows by an equi-join on (list, part) of packed blocks, one
matrix product each; there is no join of all blocks with all. What every task needs to know of the lists (a centre, a
radius and a count each) is at most MAX_LISTS rows.

`search` is exact, in two passes. The first looks into the list nearest to each query and yields its k-th score so far. The second
visits only the lists whose bound reaches that score: q.c + |q| r for inner products, |q - c| - r for distances.
`probe` looks into the nprobe nearest lists only; of a saved index, only their folders are read.

Null and empty vectors are left out. Scores are rounded to 6 places before they are ranked, ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.lexical import top_k
from lodestar.sources.sinks import kept

#: Rows of a part, lists at most, rows per list that k-means is fitted on (about), rounds of k-means.
BLOCK, MAX_LISTS, SAMPLE, ROUNDS = 2048, 4096, 256, 4
#: Scores are compared after rounding to 6 places; bounds give way by more than that.
SLACK = 1e-5
METRICS = ("ip", "l2")
_BLOCKS = "list int, part int, ids binary, vecs binary, dim int, bytes int"
_HITS = "qid long, did long, score double"


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """[rows, lists] squared distances."""
    v = v.astype(np.float64)
    return np.maximum((v * v).sum(1)[:, None] - 2 * (v @ centres.T) + (centres * centres).sum(1)[None, :], 0)


def _present(rows: DataFrame) -> DataFrame:
    return rows.where("vec is not null and size(vec) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), "vec")


def _share(key: str, share: float) -> Column:
    """Whether a row is among about so many of all rows, by its id alone."""
    return F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 20)) < int(share * (1 << 20))


def kmeans(rows: DataFrame, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """[k, dim] centres of (vec_id, vec) by Lloyd's rounds from the k rows first in hash order.

    A round sends one row per partition and list (count and sum) to the lists' groups and k centres to the driver.
    """
    first = rows.orderBy(F.xxhash64(F.lit(29), "vec_id"), "vec_id").limit(k)
    centres = np.array([r["vec"] for r in first.select("vec").collect()], np.float64)

    def sums(centres: np.ndarray) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros_like(centres)
            for b in batches:
                v = _matrix(b.column(1))
                if len(v):
                    at = _distances(v, centres).argmin(1)
                    np.add.at(n, at, 1)
                    np.add.at(total, at, v)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.float64()))], ["list", "n", "total"])

        return run

    def mean(t: pa.Table) -> pa.Table:
        total = _matrix(t.column("total").combine_chunks())
        return pa.table({"list": pa.array([t.column("list")[0].as_py()], pa.int32()), "centre": pa.array([total.sum(0) / t.column("n").to_numpy().sum()], pa.list_(pa.float64()))})

    for _ in range(rounds if len(centres) > 1 else 0):
        part = rows.mapInArrow(sums(centres), "list int, n long, total array<double>")
        moved = part.groupBy("list").applyInArrow(mean, "list int, centre array<double>").collect()  # k rows
        centres = centres.copy()
        for r in moved:
            centres[r["list"]] = r["centre"]
    return centres


@dataclass
class Lists:
    """blocks: (list, part, ids, vecs, dim, bytes); centres [lists, dim]; radii, sizes and parts of each list."""

    blocks: DataFrame
    centres: np.ndarray
    radii: np.ndarray
    parts: np.ndarray
    sizes: np.ndarray

    def save(self, path: str) -> None:
        """Blocks in a folder per list, and a small table of the lists."""
        spark = self.blocks.sparkSession
        self.blocks.write.partitionBy("list").parquet(f"{path}/blocks")
        rows = [(i, c.tolist(), float(r), int(p), int(n)) for i, (c, r, p, n) in enumerate(zip(self.centres, self.radii, self.parts, self.sizes, strict=True))]
        spark.createDataFrame(rows, "list int, centre array<double>, radius double, parts int, n long").coalesce(1).write.parquet(f"{path}/lists")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Lists:
        rows = sorted(spark.read.parquet(f"{path}/lists").collect(), key=lambda r: r["list"])  # MAX_LISTS at most
        blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
        arrays = (np.array([r[c] for r in rows]) for c in ("centre", "radius", "parts", "n"))
        return Lists(blocks, *arrays)


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(block: int) -> Callable:
    """(list, part, vec_id, vec), sorted by list and part, as blocks of at most `block` rows in the order of their ids."""

    def out(key: tuple[int, int], ids: list, vecs: list) -> pa.RecordBatch:
        i, v = np.concatenate(ids), np.concatenate(vecs)
        order = np.argsort(i, kind="stable")
        i, v = i[order], v[order]
        wide = v.dtype.itemsize
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([i.astype("<i8").tobytes()]), pa.array([v.tobytes()]), pa.array([v.shape[1]], pa.int32()), pa.array([wide], pa.int32())],
            ["list", "part", "ids", "vecs", "dim", "bytes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vecs, n = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            lists, parts = b.column(0).to_numpy(), b.column(1).to_numpy()
            i, v = b.column(2).to_numpy(zero_copy_only=False), _matrix(b.column(3))
            cuts = np.flatnonzero((np.diff(lists) != 0) | (np.diff(parts) != 0)) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(i)], strict=True):
                here = int(lists[lo]), int(parts[lo])
                while lo < hi:
                    if n and (here != key or n >= block):
                        yield out(key, ids, vecs)
                        ids, vecs, n = [], [], 0
                    upto = min(hi, lo + block - n)
                    key = here
                    ids.append(i[lo:upto])
                    vecs.append(v[lo:upto])
                    n, lo = n + upto - lo, upto
        if n:
            yield out(key, ids, vecs)

    return run


def build(rows: DataFrame, lists: int | None = None, block: int = BLOCK, rounds: int = ROUNDS) -> Lists:
    """rows: (vec_id long, vec). lists: how many; by default one per block of rows, and MAX_LISTS at most.

    Centres are fitted on about SAMPLE rows per list, drawn by a hash of the id; every row is put into its nearest list.
    """
    rows = _present(rows)
    n = rows.count()
    k = max(1, min(MAX_LISTS, n, -(-n // block) if lists is None else lists))
    if k == 1:
        centres = np.zeros((1, 1))
    else:
        share = 2.0 * SAMPLE * k / n
        centres = kmeans(kept(rows.where(_share("vec_id", share))) if share < 1 else rows, k, rounds)
        k = len(centres)

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far = np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            v = _matrix(b.column(1))
            if len(v) and k > 1:
                d = _distances(v, centres)
                at = d.argmin(1)
                np.add.at(n, at, 1)
                np.maximum.at(far, at, np.sqrt(d[np.arange(len(at)), at]))
            else:
                n[0] += len(v)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(far[some])], ["list", "n", "radius"])

    sizes, radii = np.zeros(k, np.int64), np.zeros(k)
    for r in rows.mapInArrow(stats, "list int, n long, radius double").groupBy("list").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect():  # k rows
        sizes[r["list"]], radii[r["list"]] = r["n"], r["radius"]
    radii = radii * (1 + 1e-9) + 1e-9 if k > 1 else np.full(1, np.inf)
    parts = np.maximum(1, -(-sizes // block))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(1))
            at = _distances(v, centres).argmin(1) if k > 1 and len(v) else np.zeros(len(v), np.int64)
            part = _mixed(b.column(0).to_numpy(zero_copy_only=False)) % parts[at].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(part.astype(np.int32)), *b.columns], ["list", "part", "vec_id", "vec"])

    of = f"list int, part int, vec_id long, vec {rows.schema['vec'].dataType.simpleString()}"
    blocks = rows.mapInArrow(placed, of).repartition("list", "part").sortWithinPartitions("list", "part").mapInArrow(_pack(block), _BLOCKS)
    return Lists(blocks, centres, radii, parts, sizes)


def _ask(index: Lists, queries: DataFrame, choose: Callable) -> DataFrame:
    """Queries (vec_id, vec, least) packed per batch and list that `choose` gives them, once for each part of the list."""
    parts = index.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, v, least = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False)
            wanted = choose(v.astype(np.float64), least)
            for at in np.flatnonzero(wanted.any(0)):
                q = wanted[:, at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int32()), pa.array([parts[at]], pa.int32()), pa.array([ids[q].astype("<i8").tobytes()]), pa.array([v[q].tobytes()]), pa.array([least[q].tobytes()])], ["list", "parts", "q_ids", "q_vecs", "q_least"]
                )

    asked = queries.mapInArrow(run, "list int, parts int, q_ids binary, q_vecs binary, q_least binary")
    return asked.select("list", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "q_ids", "q_vecs", "q_least")


def _best(s: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k greatest finite values, none below the row's least; of equal ones those of the first columns.

    Only rows with more than k such values are parted, and no row is sorted.
    """
    may = np.isfinite(s) & (s >= least[:, None])
    many = np.flatnonzero(may.sum(1) > k)
    if len(many):
        part = np.where(may[many], s[many], -np.inf)
        floor = np.partition(part, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        over, tie = part > floor[:, None], part == floor[:, None]
        may[many] = over | (tie & (np.cumsum(tie, axis=1) <= (k - over.sum(1))[:, None]))
    return np.nonzero(may)


def _products(blocks: DataFrame, asked: DataFrame, k: int, metric: str, skip_self: bool) -> DataFrame:
    """(qid, did, score): of each block at most k rows a query, none below the query's least score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {n: c[i].as_py() for n, c in zip(b.schema.names, b.columns, strict=True)}
                real = "<f4" if r["bytes"] == 4 else "<f8"
                qi, di, least = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_least"], "<f8")
                dv = np.frombuffer(r["vecs"], real).reshape(-1, r["dim"]).astype(np.float64)
                qv = np.frombuffer(r["q_vecs"], "<f4" if len(r["q_vecs"]) == 4 * r["dim"] * len(qi) else "<f8").reshape(-1, r["dim"]).astype(np.float64)
                s = qv @ dv.T
                if metric == "l2":
                    s = -((qv * qv).sum(1)[:, None] - 2 * s + (dv * dv).sum(1)[None, :])
                s = np.round(s, 6) + 0.0
                if skip_self:
                    s[qi[:, None] == di[None, :]] = -np.inf
                at, best = _best(s, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(di[best]), pa.array(s[at, best])], ["qid", "did", "score"])

    return asked.join(blocks, ["list", "part"]).mapInArrow(run, _HITS)


def _own(index: Lists) -> Callable:
    centres = index.centres

    def choose(v: np.ndarray, least: np.ndarray) -> np.ndarray:
        if len(centres) == 1:
            return np.ones((len(v), 1), bool)
        return _distances(v, centres).argmin(1)[:, None] == np.arange(len(centres))[None, :]

    return choose


def bounds(index: Lists, metric: str) -> Callable:
    """[queries, lists]: no row of the list scores more."""
    centres, radii = index.centres, index.radii

    def bound(v: np.ndarray) -> np.ndarray:
        if metric == "ip":
            return v @ centres.T + np.sqrt((v * v).sum(1))[:, None] * radii[None, :]
        return -(np.maximum(0, np.sqrt(_distances(v, centres)) - radii[None, :]) ** 2)

    return bound


def search(index: Lists, queries: DataFrame, k: int, metric: str = "ip", skip_self: bool = True) -> DataFrame:
    """Exact: (qid, did, score, rank) for queries (vec_id long, vec)."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    asked = _present(queries)
    own = _own(index)
    near = _products(index.blocks, _ask(index, asked.withColumn("least", F.lit(-np.inf)), own), k, metric, skip_self)
    if len(index.centres) == 1:
        return top_k(near, k)
    near = kept(near)
    so_far = top_k(near, k).where(F.col("rank") == k).select(F.col("qid").alias("vec_id"), F.col("score").alias("least"))
    bound = bounds(index, metric)

    def others(v: np.ndarray, least: np.ndarray) -> np.ndarray:
        return (bound(v) >= least[:, None] - SLACK) & ~own(v, least)

    after = asked.join(so_far, "vec_id", "left").select("vec_id", "vec", F.coalesce("least", F.lit(-np.inf)).alias("least"))
    return top_k(near.union(_products(index.blocks, _ask(index, after, others), k, metric, skip_self)), k)


def probe(index: Lists, queries: DataFrame, k: int, nprobe: int, metric: str = "ip", skip_self: bool = True) -> DataFrame:
    """(qid, did, score, rank) from the nprobe lists best for each query: by inner product with the centre, or nearest. Of an index that
    was loaded, only the folders of lists that a query asks for are read."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    centres, filled = index.centres, index.sizes > 0

    def choose(v: np.ndarray, least: np.ndarray) -> np.ndarray:
        if len(centres) == 1:
            return np.ones((len(v), 1), bool)
        s = v @ centres.T if metric == "ip" else -_distances(v, centres)
        s = np.where(filled[None, :], s, -np.inf)
        best = np.argsort(-s, axis=1, kind="stable")[:, :nprobe]
        out = np.zeros(s.shape, bool)
        np.put_along_axis(out, best, True, 1)
        return out & filled[None, :]

    asked = _ask(index, _present(queries).withColumn("least", F.lit(-np.inf)), choose)
    lists = [r["list"] for r in asked.select("list").distinct().collect()] if nprobe < len(centres) else None  # MAX_LISTS at most
    blocks = index.blocks if lists is None else index.blocks.where(F.col("list").isin(lists))
    return top_k(_products(blocks, asked, k, metric, skip_self), k)
