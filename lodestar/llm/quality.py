"""Quality rules with adaptive thresholds.

Each text's counts become rates; mergeable KLL quantile sketches of the rates are built per
(lang, source), merged per lang and over everything. A rate's fence is u + SPREAD * (u - l), from the
quartiles l and u of its own group's sketch; where those coincide, from the median and the UPPER quantile. A
group's fence is shrunk towards its lang's as if PRIOR more rows had that, and a lang's likewise towards that of all rows, so
a small group is judged by little more than its lang, without a switch.

A text passes if its word length lies within the fences (l - SPREAD * (u - l) is the lower one), and if its other
rates don't exceed theirs by more than chance: where the fence lets a text of its size have e events, up to
e + SIGMA * (sqrt(e) + 1). An event is a symbol, a duplicate line, or a three-word window found twice, which is REPEATED words.

Defined cases: null text has no words and fails the base rule; null lang or source is a group of
its own; texts that fail the base rule don't shape fences; repeated rows count each time; COUNTS, RATES, base_failed and kept replace columns of
those names; further columns stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches, stored, unused, without_columns

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Rate: numerator, denominator, how much of the numerator an event is (None: fenced on both sides, by the rate itself).
REPEATED = 6
RATES = {
    "symbol_rate": ("n_symbols", "n_words", 1),
    "dup_line_rate": ("n_dup_lines", "n_lines", 1),
    "repeat_rate": ("n_repeat_words", "n_words", REPEATED),
    "word_length": ("word_chars", "n_words", None),
}
SPREAD, UPPER, SIGMA, PRIOR, SKETCH_K = 3.0, 0.9, 3.0, 200, 400
#: Fence rows are broadcast up to this many; beyond, the join is left to the planner.
BROADCAST_GROUPS = 20_000

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _repeated(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash elsewhere in the same text, and which have one earlier."""
    order = np.lexsort((h, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    later[order[1:][same]] = True  # lexsort is stable: the first of equals stands first
    twice[order[:-1][same]] = True
    return np.stack([twice, later])


def counts(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of every text of a chunk."""
    n = len(offs) - 1
    starts, ends, first = kernel.words(data, offs)
    n_words = np.diff(first)
    h = kernel.running_hash(data)
    doc = np.repeat(np.arange(n), n_words)
    inside = ~kernel._SPACE[data] & ((data & 0xC0) != 0x80)
    # three-word windows: only texts of three words have any
    wh = kernel.span_hash(h, starts, ends)
    win, at, before = kernel.windows(wh, first, 3)
    w_doc = np.repeat(np.arange(n), np.diff(before))
    real = n_words[w_doc] >= 3
    win, at, w_doc = win[real], at[real], w_doc[real]
    covered = np.zeros(len(starts) + 3, np.int64)
    hit = at[_repeated(w_doc, win)[0]] if len(at) else at
    for k in range(3):
        covered[hit + k] = 1
    # lines that hold a word
    cut = data == 0x0A
    l_start, l_end = kernel.runs(~cut, offs)
    has = np.searchsorted(starts, l_end) > np.searchsorted(starts, l_start)
    l_start, l_end = l_start[has], l_end[has]
    l_doc = np.searchsorted(offs, l_start, "right") - 1
    again = _repeated(l_doc, kernel.span_hash(h, l_start, l_end))[1] if len(l_start) else np.zeros(0, bool)
    return {
        "n_words": n_words,
        "word_chars": _sums(inside.astype(np.int64), offs),
        "n_symbols": _sums(_SYMBOL[data], offs),
        "n_dup_lines": np.bincount(l_doc[again], minlength=n),
        "n_repeat_words": np.bincount(doc[covered[: len(starts)] > 0], minlength=n),
        "n_lines": np.bincount(l_doc, minlength=n),
    }


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with COUNTS as long columns (replaced if there)."""
    bounded_batches(df.sparkSession)
    rows = without_columns(df, COUNTS)
    names = rows.columns
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = kernel.flat(b.column(place))
            parts = [counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in kernel.chunks(offs)]
            found = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*names, *COUNTS])

    return rows.mapInArrow(run, rows.select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rate(name: str) -> Column:
    over, under, _ = RATES[name]
    return F.when(F.col(under) > 0, F.col(over).cast("double") / F.col(under)).otherwise(F.lit(0.0))


def _group(name: str) -> Column:
    """Null as a value of its own, so that groups join by plain equality."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{name}`").cast("string")), F.lit("null"))


def _quantile(sketch: Column, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def fences(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source), each null or "=" and its text, with n rows and lo_ and hi_ fences of each rate. Rows that fail the base rule don't shape them."""
    rows = counted.where(~base_failed()).select(_group(lang).alias("lang"), _group(source).alias("source"), *[rate(r).alias(r) for r in RATES])
    fine = stored(rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATES]), "sketches")  # a row per group
    merged = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATES]]

    def own(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        cols = [*keys, F.col("n").alias(f"n{tag}")]
        for r in RATES:
            l, m, u, top = (_quantile(F.col(r), q) for q in (0.25, 0.5, 0.75, UPPER))
            cols.append(F.when(u > l, u + SPREAD * (u - l)).otherwise(top + SPREAD * (top - m)).alias(f"hi_{r}{tag}"))
            cols.append((l - SPREAD * (u - l)).alias(f"lo_{r}{tag}"))
        return df.select(*cols)

    every = own(fine.agg(*merged).where("n > 0"), [], "_all")  # one row
    wide = own(fine.groupBy("lang").agg(*merged), ["lang"], "_lang")
    out = own(fine, ["lang", "source"], "").join(wide, "lang").crossJoin(F.broadcast(every))
    shrunk = lambda own_, n, to: (F.col(n) * F.col(own_) + PRIOR * to) / (F.col(n) + PRIOR)
    cols = [shrunk(f"{side}_{r}", "n", shrunk(f"{side}_{r}_lang", "n_lang", F.col(f"{side}_{r}_all"))).alias(f"{side}_{r}") for r in RATES for side in ("lo", "hi")]
    return out.select("lang", "source", "n", *cols)


def within(r: str, lo: Column, hi: Column) -> Column:
    over, under, event = RATES[r]
    if event is None:
        return rate(r).between(lo, hi)
    allowed = hi * F.col(under) / event
    return F.col(over) / F.lit(event) <= allowed + SIGMA * (F.sqrt(allowed) + 1)


def quality_rules(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """df with COUNTS, RATES, base_failed and kept. Two passes over the texts, one for the sketches and one for the verdicts; texts are not shuffled."""
    df = without_columns(df, [*COUNTS, *RATES, "base_failed", "kept"])
    names = df.columns
    lines = stored(fences(with_counts(df.select(F.col(f"`{text}`"), F.col(f"`{lang}`"), F.col(f"`{source}`")), text), lang, source), "fences")
    mine = unused(df, "line_lang", "line_source", "line")
    lines = lines.select(F.col("lang").alias(mine[0]), F.col("source").alias(mine[1]), F.struct("*").alias(mine[2]))
    if lines.count() <= BROADCAST_GROUPS:
        lines = F.broadcast(lines)
    rows = with_counts(df, text).select("*", base_failed().alias("base_failed"), *[rate(r).alias(r) for r in RATES])
    line = lambda side, r: F.col(f"{mine[2]}.{side}_{r}")
    fine = F.lit(True)
    for r in RATES:
        fine &= F.coalesce(within(r, line("lo", r), line("hi", r)), F.lit(True))
    joined = rows.join(lines, (_group(lang) == F.col(mine[0])) & (_group(source) == F.col(mine[1])), "left")
    return joined.select(*[f"`{c}`" for c in names], *COUNTS, *RATES, "base_failed", (~F.col("base_failed") & fine).alias("kept"))
