"""Evaluation runs followed as a stream of record files: a board of the best step of each run, kept up to date.

A record is (run, step, value). Files arrive in a folder; `follow` reads those it hasn't read (its checkpoint knows) and
stops, so calling it again costs what is new. A batch does two things in the board's folder, both named by the batch, so that a batch
that is repeated after a failure writes the same again:

* records/batch=b: the batch's records that no earlier batch had, by (run, step). A file that arrives twice changes nothing;
* best/batch=b: the board with the rows of the runs that the batch touched made anew from all their records.

Only touched runs are computed again. Of records with one (run, step) the first batch's stays, within a batch the greatest
value. Records with a null run, step or value are left out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEST = ["best_step", "best", "last_step", "n", "stale"]


@dataclass
class RunBoard:
    """path: the board's folder, shared by all executors. higher: whether a greater value is better."""

    spark: SparkSession
    path: str
    run: str = "run"
    step: str = "step"
    value: str = "value"
    higher: bool = True

    def _before(self, what: str, batch: int | None) -> DataFrame | None:
        """The table's rows of earlier batches, or of all."""
        try:
            table = self.spark.read.parquet(f"{self.path}/{what}")
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return table if batch is None else table.where(F.col("batch") < batch)

    def _latest(self, batch: int | None) -> DataFrame | None:
        """The board as the last batch (before `batch`) left it."""
        table = self._before("best", batch)
        last = None if table is None else table.agg(F.max("batch")).first()[0]
        return None if last is None else table.where(F.col("batch") == last).drop("batch")

    def marks(self, records: DataFrame) -> DataFrame:
        """(run, best_step, best, last_step, n, stale): the first of the best steps; stale counts the records behind it."""
        value = F.col(self.value) if self.higher else -F.col(self.value)
        per = records.groupBy(self.run).agg(F.max_by(F.struct(self.step, self.value), F.struct(value, -F.col(self.step))).alias("b"), F.max(self.step).alias("last_step"), F.count("*").alias("n"))
        per = per.select(self.run, F.col(f"b.{self.step}").alias("best_step"), F.col(f"b.{self.value}").alias("best"), "last_step", "n")
        behind = records.join(per.select(self.run, "best_step"), self.run).where(F.col(self.step) > F.col("best_step")).groupBy(self.run).agg(F.count("*").alias("stale"))
        return per.join(behind, self.run, "left").select(self.run, "best_step", "best", "last_step", "n", F.coalesce("stale", F.lit(0)).cast("long").alias("stale"))

    def absorb(self, batch: DataFrame, number: int) -> None:
        """Takes one batch in. The same batch again, under its number, gives the same tables."""
        key = [self.run, self.step]
        rows = batch.select(*key, self.value).dropna().groupBy(*key).agg(F.max(self.value).alias(self.value))
        known = self._before("records", number)
        if known is not None:
            rows = rows.join(known.select(*key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{self.path}/records/batch={number}")
        new = self.spark.read.schema(rows.schema).parquet(f"{self.path}/records/batch={number}")
        touched = new.select(self.run).distinct()
        every = new if known is None else new.unionByName(known.drop("batch").join(touched, self.run, "left_semi"))
        board = self.marks(every)
        before = self._latest(number)
        if before is not None:
            board = board.unionByName(before.join(touched, self.run, "left_anti"))
        board.write.mode("overwrite").parquet(f"{self.path}/best/batch={number}")

    def follow(self, records: DataFrame) -> None:
        """Reads what is new of a streaming DataFrame of records, and returns."""
        query = records.select(self.run, self.step, self.value).writeStream.foreachBatch(self.absorb).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    def best(self) -> DataFrame | None:
        """The board, or None before the first batch."""
        return self._latest(None)

    def stopped(self, patience: int) -> DataFrame | None:
        """The runs with `patience` records or more since their best."""
        board = self.best()
        return None if board is None else board.where(F.col("stale") >= patience)


def matrix(spark: SparkSession, axes: dict[str, list], name: str = "run") -> DataFrame:
    """Every combination of the axes' values, one row each, with a run name `axis=value,...`."""
    rows = reduce(lambda df, axis: df.withColumn(axis, F.explode(F.array(*[F.lit(v) for v in axes[axis]]))), axes, spark.range(1).drop("id"))
    return rows.withColumn(name, F.concat_ws(",", *[F.concat(F.lit(f"{a}="), F.col(a).cast("string")) for a in axes]))


def summary(planned: DataFrame, board: DataFrame | None, run: str = "run") -> DataFrame:
    """planned with the board's columns and `state`: done, or pending for a run without a record (primary value 0, as in a report)."""
    if board is None:
        return planned.select("*", F.lit("pending").alias("state"), F.lit(0.0).alias("primary"))
    both = planned.join(board, run, "left")
    return both.select(*planned.columns, *BEST, F.when(F.col("n").isNull(), "pending").otherwise("done").alias("state"), F.coalesce("best", F.lit(0.0)).alias("primary"))
