"""Run reports: best runs, curves, first available metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_run(runs: DataFrame, metric: str, order: str, by: str | None = None) -> DataFrame:
    """The row with the greatest metric (null counts as least), the first by order of equals; one per group."""
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in runs.columns]), F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))), -F.col(order)))
    grouped = runs.groupBy(by) if by else runs.groupBy()
    return grouped.agg(best.alias("r")).select("r.*")


def first_available(*candidates: Column) -> Column:
    return F.coalesce(*candidates, F.lit(0.0))


def curve_marks(history: DataFrame, curve: str, step: str, value: str, lower_is_better: bool = True) -> DataFrame:
    """history with `best` (so far), is_best and `stale`, the number of steps since the last improvement."""
    w = Window.partitionBy(curve).orderBy(step)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = (F.min if lower_is_better else F.max)(value)
    better = F.col("_before").isNull() | ((F.col(value) < F.col("_before")) if lower_is_better else (F.col(value) > F.col("_before")))
    rows = history.withColumn("_before", so_far.over(before)).withColumn("best", so_far.over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("is_best", better)
    island = F.sum(F.col("is_best").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_i", island)
    return rows.withColumn("stale", (F.row_number().over(Window.partitionBy(curve, "_i").orderBy(step)) - 1).cast("long")).drop("_before", "_i")


def stop_step(marks: DataFrame, curve: str, step: str, patience: int) -> DataFrame:
    """(curve, stop): the first step with `patience` steps without improvement, null if there is none."""
    return marks.groupBy(curve).agg(F.min(F.when(F.col("stale") >= patience, F.col(step))).alias("stop"))


def curve_deltas(history: DataFrame, curve: str, step: str, value: str) -> DataFrame:
    """First and last value, their difference and their ratio."""
    ends = history.groupBy(curve).agg(F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"))
    return ends.select(curve, F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round(F.col("last") - F.col("first"), 6).alias("gain"), F.round(F.try_divide("last", "first"), 6).alias("ratio"))


def combined(frames: dict[str, DataFrame], tag: str = "report") -> DataFrame:
    """Union of reports with a tag; missing columns are null."""
    out = None
    for name, f in frames.items():
        part = f.select("*", F.lit(name).alias(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no reports")
    return out


def deepest_metric(rows: DataFrame, run: str, keys: list[str]) -> DataFrame:
    """(run, value): the greatest value of any of the keys among flattened (run, key, value) rows, 0 without one."""
    return rows.groupBy(run).agg(F.coalesce(F.max(F.when(F.col("key").isin(keys), F.col("value"))), F.lit(0.0)).alias("value"))
