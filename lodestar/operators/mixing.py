"""Data set mixing: positions, dedup, samples, quotas, splits, chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import hash_order
from lodestar.sources.sinks import kept


#: Rows of one range of sorted rows, about.
SLICE = 200_000
HEX = 4  # digits of a hash that are counted first
_LOW = (1 << 33) - 1  # the bits of a row's number within its partition


def _names(df: DataFrame, *wanted: str, made: tuple = ()) -> list[str]:
    """The wanted names, with underscores before those that df has or that are made for the user."""
    taken = {c.lower() for c in [*df.columns, *made] if c}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        out.append(w)
    return out


def _placed(df: DataFrame, order: list[Column], part: str, at: str) -> DataFrame:
    """df sorted in ranges of about SLICE rows by `order`, with each row's range and place in it.

    There are as many ranges as the rows need, found by Spark's own sample. It is written and read again, so a row keeps its place whatever is computed from it. Rows that are equal in `order` are
    told apart by a hash of their columns, so that many of them are no single partition.
    """
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    keys = [*order, F.xxhash64(*plain)]
    rows = df.repartitionByRange(max(1, -(-df.count() // SLICE)), *keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = kept(rows)
    return rows.withColumn(part, F.shiftright(at, 33)).withColumn(at, F.col(at).bitwiseAND(_LOW))


def numbered(df: DataFrame, key: str, out: str = "pos") -> DataFrame:
    """df with positions 0, 1, ... in the order of `key` (nulls first), without one task that sees every row; equal keys in any order.

    Rows are sorted by ranges; counts per range give each its first position.
    """
    p_, a_, b_ = _names(df, "part", "place", "before", made=(out,))
    rows = _placed(df, [F.col(f"`{key}`")], p_, a_)
    per = rows.groupBy(p_).agg(F.count("*").alias("n"))
    before = per.select(p_, (F.sum("n").over(Window.orderBy(p_)) - F.col("n")).alias(b_))  # a row per range
    return rows.join(F.broadcast(before), p_).withColumn(out, (F.col(b_) + F.col(a_)).cast("long")).drop(p_, a_, b_)


def ranked_within(df: DataFrame, group: str | None, order: list[Column], out: str, total: str | None = None) -> DataFrame:
    """df with the 1-based position of each row in its group (null: all rows) by `order`, and the group's size as `total`, without one task per group.

    Rows are sorted by ranges of group and order; a large group lies in many partitions, and a row's position is the group's rows in
    earlier ones and its place among those of its own.
    """
    g_, p_, a_, f_, b_, t_, j_, k_ = _names(df, "of", "part", "place", "first", "before", "size", "j", "k", made=(out, total))
    rows = _placed(df.withColumn(g_, F.lit(0) if group is None else F.col(f"`{group}`")), [F.col(g_), *order], p_, a_)
    per = rows.groupBy(g_, p_).agg(F.count("*").alias("n"), F.min(a_).alias(f_))
    w = Window.partitionBy(g_)
    before = per.select(F.col(g_).alias(j_), F.col(p_).alias(k_), f_, (F.sum("n").over(w.orderBy(p_)) - F.col("n")).alias(b_), F.sum("n").over(w).alias(t_))  # a row per group and range
    done = rows.join(before, F.col(g_).eqNullSafe(F.col(j_)) & (F.col(p_) == F.col(k_))).withColumn(out, (F.col(b_) + F.col(a_) - F.col(f_) + 1).cast("long"))
    if total:
        done = done.withColumn(total, F.col(t_))
    return done.drop(g_, p_, a_, f_, b_, t_, j_, k_)


def first_by(df: DataFrame, key: str | list[str], pos: str) -> DataFrame:
    """The first row of each key by position, all columns."""
    keys = [key] if isinstance(key, str) else key
    rows = F.struct(F.col(pos).alias("_o"), *[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(rows, F.col(pos)).alias("_r")).select(*[F.col(f"_r.`{c}`") for c in df.columns])


def hash_sample(df: DataFrame, key: str, seed: str | int, n: int, by: str | None = None) -> DataFrame:
    """n rows (of each group) without replacement, the same for the same seed."""
    r_, h_ = _names(df, "r", "h")
    rows = df.withColumn(h_, hash_order(F.col(key), seed))
    return ranked_within(rows, by, [F.col(h_), F.col(f"`{key}`")], r_).where(F.col(r_) <= n).drop(r_, h_)


def quotas(ratios: dict[str, float], total: int) -> dict[str, int]:
    whole = sum(ratios.values())
    return {k: int(total * r / whole) for k, r in ratios.items()}


def quota_mix(df: DataFrame, domain: str, pos: str, ratios: dict[str, float], total: int) -> DataFrame:
    """The first rows of each domain up to its quota."""
    own = quotas(ratios, total)
    limit = F.create_map(*[x for k, n in own.items() for x in (F.lit(k), F.lit(n))])
    r_ = _names(df, "r")[0]
    return ranked_within(df.where(F.col(domain).isin(list(own))), domain, [F.col(pos)], r_).where(F.col(r_) <= limit[F.col(domain)]).drop(r_)


def domain_counts(df: DataFrame, domain: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(domain), F.lit("unknown")).alias("domain")).agg(F.count("*").alias("n"))


def hash_split(df: DataFrame, key: str, seed: str | int, share: float, least: int = 0) -> DataFrame:
    """df with `split`: val for max(least, int(n * share)) rows first in hash order, train for the others.

    The cut is found by counting hashes by their first HEX digits, then in the one group of equal digits that holds it. A share of 1 or more makes all rows val.
    """
    n = df.count()
    want = n if share >= 1 else max(least, int(n * share))
    if n and want >= n and share < 1:
        raise ValueError("the split leaves no training rows")
    if want == 0:
        return df.withColumn("split", F.lit("train"))
    order = hash_order(F.col(key), seed)
    digits = F.substring(order, 1, HEX)
    per = df.select(order.alias("h"), F.col(key).alias("k"), digits.alias("d"))
    counts = per.groupBy("d").agg(F.count("*").alias("n"))  # 16 ** HEX rows at most
    cut = counts.withColumn("before", F.sum("n").over(Window.orderBy("d")) - F.col("n")).where(f"before < {want} and before + n >= {want}").first()
    last = per.where(F.col("d") == cut["d"]).orderBy("h", "k").limit(want - cut["before"]).agg(F.max(F.struct("h", "k")).alias("c")).first()["c"]
    inside = (order < last["h"]) | ((order == last["h"]) & (F.col(key) <= F.lit(last["k"])))
    return df.withColumn("split", F.when(inside, "val").otherwise("train"))


def tail_split(df: DataFrame, group: str | None, pos: str, share: float) -> DataFrame:
    """df with `split`: val for the last int(n * share) rows of each group."""
    r_, n_ = _names(df, "r", "n")
    done = ranked_within(df, group, [F.col(pos)], r_, n_)
    return done.withColumn("split", F.when(F.col(r_) > F.col(n_) - F.floor(F.col(n_) * F.lit(share)), "val").otherwise("train")).drop(r_, n_)


def head_share(df: DataFrame, pos: str, share: float, group: str | None = None) -> DataFrame:
    """The first floor(n * share) rows (of each group) by position."""
    r_, n_ = _names(df, "r", "n")
    done = ranked_within(df, group, [F.col(pos)], r_, n_)
    return done.where(F.col(r_) <= F.floor(F.col(n_) * F.lit(share))).drop(r_, n_)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def pair_messages(user: Column, assistant: Column) -> Column:
    return F.array(message("user", user), message("assistant", assistant))


def turn_messages(questions: Column, answers: Column) -> Column:
    """Alternating user and assistant turns; null if the arrays differ in length."""
    return F.when(F.size(questions) == F.size(answers), F.flatten(F.zip_with(questions, answers, lambda q, a: pair_messages(q, a))))


def conversations(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, messages, n_turns): the turns of a conversation in order."""
    s = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))))
    return turns.groupBy(conv).agg(s.alias("s")).select(conv, F.transform("s", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.size("s").cast("long").alias("n_turns"))


def random_masks(tokens: Column, key: Column, mask: str, vocabulary: list[str], seed: str = "mask", share: float = 0.15) -> Column:
    """Array of (token, label): `share` of the places are chosen, of those 80 % masked, 10 % replaced, 10 % kept; label null elsewhere."""

    def uniform(i: Column, salt: str) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed + salt), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)

    words = F.array(*[F.lit(v) for v in vocabulary])

    def one(t: Column, i: Column) -> Column:
        u = uniform(i, "b")
        other = F.element_at(words, (F.floor(uniform(i, "c") * len(vocabulary)) + 1).cast("int"))
        chosen = uniform(i, "a") < share
        new = F.when(~chosen, t).when(u < 0.8, F.lit(mask)).when(u < 0.9, other).otherwise(t)
        return F.struct(new.alias("token"), F.when(chosen, t).alias("label"))

    return F.transform(tokens, one)
