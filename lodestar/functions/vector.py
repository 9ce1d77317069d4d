"""Vector functions on arrays of floats; arithmetic is in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its norm; a zero vector stays."""
    n = norm(v)
    return F.transform(doubles(v), lambda x: x / F.when(n == 0, F.lit(1.0)).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _fold(tokens: Column, f) -> Column:
    rest = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.aggregate(rest, doubles(F.get(tokens, F.lit(0))), lambda s, v: F.zip_with(s, doubles(v), f))


def pooled(tokens: Column, how: str) -> Column:
    """Memory tokens (array of vectors) as one vector (F14): mean, first, last, max, mean_max, flatten."""
    if how == "first":
        return doubles(F.element_at(tokens, 1))
    if how == "last":
        return doubles(F.element_at(tokens, -1))
    if how == "flatten":
        return doubles(F.flatten(tokens))
    if how == "max":
        return _fold(tokens, lambda a, b: F.greatest(a, b))
    if how == "mean":
        n = F.size(tokens)
        return F.transform(_fold(tokens, lambda a, b: a + b), lambda x: x / n)
    if how == "mean_max":
        return F.concat(pooled(tokens, "mean"), pooled(tokens, "max"))
    raise ValueError(f"unknown pooling {how}")


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the tokens whose mask is 1 (F15); null if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda z: z["m"] == 1), lambda z: z["t"])
    return F.when(F.size(kept) > 0, pooled(kept, "mean"))


def last_token(tokens: Column, mask: Column) -> Column:
    """The token at the mask's sum (right padding)."""
    n = F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))
    return F.when(n > 0, doubles(F.get(tokens, n - 1)))


def cls_token(tokens: Column) -> Column:
    """The first token, whatever the mask (F15); null if there is none."""
    return F.when(F.size(tokens) > 0, doubles(F.get(tokens, F.lit(0))))
