"""Ordered funnel counting: time buckets of every client, attempts followed by as-of merges.

A row belongs to the bucket of its time, its home, and is copied into every earlier bucket whose attempts may still
look at it: those of the preceding `horizon`, the longest a whole funnel may take. So a bucket holds all that the
attempts which begin in it need, and clients, hot ones too, are spread over their buckets; a task never holds more of
one client than `width + horizon` of its time. Many buckets form a chunk, in which each step of all attempts is two
pandas merge_asof (forward, no exact matches): to the next row of the step's kind and to the next excluded row.

A funnel's times are counted per value before anything is ranked, and the wanted one is found in two steps, by the
high bits of the time and then among the times with those bits: at most 2 ** 15 rows a client and step in the second
window, horizon / 2 ** 15 in the first.

Defined cases: rows with a null client, kind or time are left out, repeated ones count once; an empty table and
clients without a first step give no rows; two rows of one time don't follow each other; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from lodestar.llm.common import stored

#: Microseconds that a funnel may take, and of a bucket.
HORIZON, WIDTH = 30 * 60 * 1_000_000, 2 * 60 * 60 * 1_000_000
#: Rows of a chunk of buckets, about.
CHUNK = 200_000
#: Bits of a time that the second step of the ranking looks at.
LOW = 15
#: The step times reported: the ceil(SHARE * n / 100)-th smallest.
SHARE = 90


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[str, str, str, str]
    excluded: str


#: The three funnels of the shop.
FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), "error"),
    Funnel("B", ("signup", "view", "click", "purchase"), "error"),
    Funnel("C", ("click", "click", "purchase", "view"), "signup"),
)


def micros(df: DataFrame, column: str) -> Column:
    """A time as microseconds; one without a zone is read as it is written, whatever the session's zone."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, Ty.TimestampNTZType):
        return ((c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).cast("decimal(20,6)") * 1_000_000).cast("long")
    return F.unix_micros(c.cast("timestamp"))


def _follow(of: pd.DataFrame, kinds: dict[str, pd.DataFrame], funnel: Funnel, horizon: int) -> list[pd.DataFrame]:
    """Per step the attempts that reach it: (g, dt). `of`: a chunk's first-step rows at home, (g, t) sorted by t."""
    none = pd.DataFrame({"g": np.zeros(0, np.int64), "t": np.zeros(0, np.int64), "at": np.zeros(0, np.int64)})
    stop = kinds.get(funnel.excluded, none)
    now = of.assign(begun=of["t"])
    out = [pd.DataFrame({"g": now["g"], "dt": 0})]
    for kind in funnel.steps[1:]:
        rows = kinds.get(kind, none)
        if not len(now) or not len(rows):
            break
        now = pd.merge_asof(now, rows, on="t", by="g", direction="forward", allow_exact_matches=False)
        now = now[now["at"].notna()]
        at = rows["t"].to_numpy()[now.pop("at").to_numpy().astype(np.int64)]
        now = pd.merge_asof(now, stop, on="t", by="g", direction="forward", allow_exact_matches=False)
        blocked = now.pop("at")
        there = blocked.notna().to_numpy()
        hit = np.zeros(len(now), bool)
        hit[there] = stop["t"].to_numpy()[blocked.to_numpy()[there].astype(np.int64)] <= at[there]
        ok = ~hit & (at - now["begun"].to_numpy() <= horizon)
        now = now[ok].assign(dt=(at - now["t"].to_numpy())[ok], t=at[ok])
        out.append(now[["g", "dt"]])
        now = now[["g", "t", "begun"]].sort_values("t", kind="stable")
    return out


def step_times(df: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, client: str = "client_id", kind: str = "kind", at: str = "arrived_at", horizon: int = HORIZON, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(funnel, client, step, dt, n): how many attempts of a client reach a step dt microseconds after the one before (step 1: 0)."""
    used = sorted({k for f in funnels for k in (*f.steps, f.excluded)})
    rows = df.select(F.col(f"`{client}`").alias("client"), F.col(f"`{kind}`").alias("kind"), micros(df, at).alias("t"))
    rows = rows.where("client is not null and t is not null").where(F.col("kind").isin(used)).distinct()
    home = F.expr(f"(t - pmod(t, {width}L)) div {width}L")
    first = F.expr(f"(t - {horizon}L - pmod(t - {horizon}L, {width}L)) div {width}L")
    rows = rows.withColumn("home", home).withColumn("bucket", F.explode(F.sequence(first, home)))
    n = max(1, -(-df.count() // chunk))
    rows = rows.select("client", "kind", "t", "bucket", (F.col("bucket") == F.col("home")).alias("own"), F.pmod(F.xxhash64("client", "bucket"), F.lit(n)).alias("chunk"))
    named = {f.name: f for f in funnels}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        part["g"] = part.groupby(["client", "bucket"], sort=False).ngroup().astype(np.int64)
        clients = part.drop_duplicates("g").set_index("g")["client"]
        kinds = {k: p[["g", "t"]].assign(at=np.arange(len(p))) for k, p in part.groupby("kind")}
        begin = {k: p[["g", "t"]] for k, p in part[part["own"]].groupby("kind")}
        out = []
        for name, f in named.items():
            if f.steps[0] not in begin:
                continue
            for step, reached in enumerate(_follow(begin[f.steps[0]], kinds, f, horizon), 1):
                who = clients.loc[reached["g"]].to_numpy()
                counted = pd.DataFrame({"client": who, "dt": reached["dt"].to_numpy()}).groupby(["client", "dt"]).size().reset_index(name="n")
                out.append(counted.assign(funnel=name, step=step))
        if not out:
            return pd.DataFrame({"funnel": [], "client": [], "step": [], "dt": [], "n": []})
        return pd.concat(out)[["funnel", "client", "step", "dt", "n"]]

    of = Ty.StructType([Ty.StructField("funnel", Ty.StringType()), Ty.StructField("client", df.schema[client].dataType), Ty.StructField("step", Ty.IntegerType()), Ty.StructField("dt", Ty.LongType()), Ty.StructField("n", Ty.LongType())])
    return rows.groupBy("chunk").applyInPandas(run, of).groupBy("funnel", "client", "step", "dt").agg(F.sum("n").alias("n"))


def _ranked(times: DataFrame, keys: list[str], share: int, low: int = LOW) -> DataFrame:
    """keys and t: the ceil(share * n / 100)-th smallest dt of each key."""
    high = F.shiftright("dt", low)
    per = Window.partitionBy(*keys)
    coarse = times.groupBy(*keys, high.alias("high")).agg(F.sum("n").alias("n"))
    coarse = coarse.withColumn("upto", F.sum("n").over(per.orderBy("high"))).withColumn("want", F.expr(f"({share} * sum(n) over (partition by {', '.join(keys)}) + 99) div 100"))
    coarse = coarse.where("upto >= want and upto - n < want").select(*keys, "high", (F.col("want") - F.col("upto") + F.col("n")).alias("want"))
    fine = times.withColumn("high", high).join(coarse, [*keys, "high"])
    fine = fine.withColumn("upto", F.sum("n").over(per.orderBy("dt")))
    return fine.where("upto >= want and upto - n < want").select(*keys, F.col("dt").alias("t"))


def funnel_counts(df: DataFrame, funnels: tuple[Funnel, ...] = FUNNELS, client: str = "client_id", kind: str = "kind", at: str = "arrived_at", horizon: int = HORIZON, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Per funnel and client with attempts: funnel, client_id, n1 to n4 (attempts that reach a step), deepest, t2 to t4
    (SHARE-th percentile of the step's times, null without one), same_depth (clients of equal funnel and deepest)."""
    times = stored(step_times(df, funnels, client, kind, at, horizon, width, chunk), "step-times")
    counts = times.groupBy("funnel", "client").agg(
        *[F.sum(F.when(F.col("step") == k, F.col("n")).otherwise(0)).cast("long").alias(f"n{k}") for k in (1, 2, 3, 4)],
        F.max("step").cast("int").alias("deepest"),
    )
    late = _ranked(times.where("step > 1"), ["funnel", "client", "step"], SHARE)
    late = late.groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == k, F.col("t"))).alias(f"t{k}") for k in (2, 3, 4)])
    depth = times.groupBy("funnel", "client").agg(F.max("step").alias("deepest")).groupBy("funnel", F.col("deepest").cast("int").alias("deepest")).agg(F.count("*").alias("same_depth"))
    both = counts.join(late, ["funnel", "client"], "left").join(F.broadcast(depth), ["funnel", "deepest"])  # four rows a funnel at most
    return both.select("funnel", F.col("client").alias("client_id"), "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth")
