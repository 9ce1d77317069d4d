"""Seeded samples, shuffles and interleaving that sort no more than they must.

A row's random number is the MD5 of the seed and its key, so every sample is the same everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import hash_order
from lodestar.operators.mixing import _names, ranked_within

#: A group's rows are dealt in so many ways by hash, each keeps its n least: a task gets WAYS * n rows of a group at most in the end.
WAYS = 64
#: Up to so many rows of a group, a sample is found by keeping the least; beyond, by ranks over all rows.
MANY = 10_000


def least(df: DataFrame, key: str, seed: str | int, n: int, by: str | None = None, rank: str | None = None) -> DataFrame:
    """The n rows (of each group) least in hash order, ties by key; `rank` names a column for their place, from 1.

    Two rounds of "the n least", of a way and of a group. Spark cuts each round's groups before it shuffles them, so
    what moves is n rows per task and way, then n per way.
    """
    h_, w_, r_ = _names(df, "hash", "way", "nth", made=(rank,))
    group = [] if by is None else [F.col(f"`{by}`")]
    order = [F.col(h_), F.col(f"`{key}`")]
    rows = df.withColumn(h_, hash_order(F.col(f"`{key}`"), seed)).withColumn(w_, F.pmod(F.xxhash64(h_), F.lit(WAYS)))
    rows = rows.withColumn(r_, F.row_number().over(Window.partitionBy(*group, w_).orderBy(*order))).where(F.col(r_) <= n)
    rows = rows.withColumn(r_, F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order))).where(F.col(r_) <= n)
    return (rows.withColumn(rank, F.col(r_)) if rank else rows).drop(h_, w_, r_)


def sample(df: DataFrame, key: str, seed: str | int, n: int, by: str | None = None) -> DataFrame:
    """n rows (of each group) without replacement."""
    if n <= MANY:
        return least(df, key, seed, n, by)
    h_, r_ = _names(df, "hash", "nth")
    rows = df.withColumn(h_, hash_order(F.col(f"`{key}`"), seed))
    return ranked_within(rows, by, [F.col(h_), F.col(f"`{key}`")], r_).where(F.col(r_) <= n).drop(h_, r_)


def paired(queries: DataFrame, documents: DataFrame, key: str, text: str, seed: str | int, n: int) -> DataFrame:
    """(nth, query, document): n texts of each side drawn alone, side by side as far as the shorter goes (R16's samplers)."""
    a = least(queries, key, f"{seed}q", n, rank="nth").select("nth", F.coalesce(F.col(text), F.lit("")).alias("query"))
    b = least(documents, key, f"{seed}d", n, rank="nth").select("nth", F.coalesce(F.col(text), F.lit("")).alias("document"))
    return a.join(b, "nth")


def shuffled(df: DataFrame, key: str, seed: str | int, out: str = "place") -> DataFrame:
    """df with each row's place, from 0, in a random order (T9); the order is a column, as rows of a table have none."""
    h_ = _names(df, "hash", made=(out,))[0]
    rows = ranked_within(df.withColumn(h_, hash_order(F.col(f"`{key}`"), seed)), None, [F.col(h_), F.col(f"`{key}`")], out)
    return rows.withColumn(out, F.col(out) - 1).drop(h_)


def interleaved(df: DataFrame, part: str, key: str, seed: str | int, out: str = "place") -> DataFrame:
    """df with each row's place, from 0, in an order that keeps the parts' proportions in every prefix.

    Within its part a row has a random rank r of n; rows go by (r - 1/2) / n, so where one part has come
    to a share of its rows, every other part has come to that share of its own, to within one row.
    """
    h_, r_, n_, f_ = _names(df, "hash", "nth", "size", "share", made=(out,))
    rows = df.withColumn(h_, hash_order(F.col(f"`{key}`"), seed))
    rows = ranked_within(rows, part, [F.col(h_), F.col(f"`{key}`")], r_, n_).withColumn(f_, (F.col(r_) - 0.5) / F.col(n_))
    rows = ranked_within(rows, None, [F.col(f_), F.col(f"`{part}`"), F.col(r_)], out)
    return rows.withColumn(out, F.col(out) - 1).drop(h_, r_, n_, f_)


def mixed_datasets(parts: dict[str, DataFrame], key: str, seed: str | int, sizes: dict[str, int | float] | None = None, pos: str | None = None, tag: str = "dataset_name", out: str = "place") -> DataFrame:
    """Data sets under one another with their names, then shuffled.

    sizes: of each the first so many rows by `pos`, or the first share of them; without, every row of all (the proportion mode).
    """
    got = []
    for name, df in parts.items():
        size = (sizes or {}).get(name)
        if size is not None:
            r_, n_ = _names(df, "nth", "size")
            ranked = ranked_within(df, None, [F.col(f"`{pos}`")], r_, n_)
            df = ranked.where(F.col(r_) <= (F.lit(size) if isinstance(size, int) else F.floor(F.col(n_) * F.lit(size)))).drop(r_, n_)
        got.append(df.withColumn(tag, F.lit(name)))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), got)
    k_ = _names(every, "key", made=(out,))[0]
    every = every.withColumn(k_, F.concat_ws(":", F.col(tag), F.col(f"`{key}`").cast("string")))
    return shuffled(every, k_, seed, out).drop(k_)
