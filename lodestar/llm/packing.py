"""Best-fit packing after Martello-Toth dominance reduction.

Every document becomes token ids plus an end id 0; only documents longer than a sequence are
cut, into whole sequences after a shorter first piece. Packing needs lengths alone, and there
are at most `size` of those, so the plan is made on the histogram of lengths, whatever the number
of pieces:

1. Reduction: from the longest length L down, sets that dominate every other set with L are fixed
   for good, all their copies at once: L alone if nothing fits beside it; L with an item of exactly
   size - L; L with the largest item k that fits, if three more never fit and any two that fit
   together are no longer than k.
2. Best fit decreasing of what is left, again in bulk: sequences of equal filling are one class,
   and a length goes to the class with the least room that holds it.

The plan says for every length which of its pieces (by rank) stand where. Ranks are counted per
(length, slice of documents), so no length, however common, has to meet in one task.

Defined cases: null text is empty (one piece, the end id); repeated doc_ids are separate documents
in the result, equal rows in no particular order; an empty table packs into nothing.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_batches, partitions, stored, unused, without_columns
from lodestar.llm.tokens import SAFE, library

SIZE, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(maxsize=1)
def _fast(path: str):
    """The same byte-level vocabulary for tiktoken, several times as fast; None if the file is of another kind."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    pre = rules.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or rules.get("normalizer"):
        return None
    # the printable stand-ins for bytes: themselves where printable, the rest from U+0100 on in order
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    stand = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in rules["added_tokens"]}
    ranks = {bytes(stand[c] for c in t): i for t, i in rules["model"]["vocab"].items() if t not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


def encode(texts: list[str], tokenizer: str) -> list[bytes]:
    """Little-endian 32-bit ids of each text, the end id last."""
    fast = _fast(tokenizer) if tokenizer.endswith(".json") else None
    out: list[bytes | None] = [None] * len(texts)
    if fast:
        enc, special = fast
        for i, t in enumerate(texts):
            if SAFE.fullmatch(t) and not any(s in t for s in special):
                ids = array("I", enc.encode_ordinary(t))
                ids.append(END)
                out[i] = ids.tobytes()
    rest = [i for i, o in enumerate(out) if o is None]
    if rest:
        lib = library(tokenizer)
        found = lib.encode([texts[i] for i in rest], num_threads=1) if tokenizer.endswith(".model") else [e.ids for e in lib.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)]
        for i, ids in zip(rest, found, strict=True):
            out[i] = array("I", [*ids, END]).tobytes()
    return out  # type: ignore[return-value]


def pieces(df: DataFrame, tokenizer: str, size: int = SIZE, text: str = "text") -> DataFrame:
    """One row per piece of each document; texts are not shuffled."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()], tokenizer), strict=True):
                n = len(ids) // 4
                start, length = 0, (n - 1) % size + 1
                for k in range(-(-n // size)):
                    for c, v in zip(cols, (doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        c.append(v)
                    start, length = start + length, size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return df.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, PIECES)


def reduce_and_fit(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths that share a sequence) and how often each is used; at most a few for every length."""
    left = {n: c for n, c in histogram.items() if c > 0}
    have = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        """Fixes the set as often as its items last."""
        need: dict[int, int] = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
                have.pop(bisect_left(have, n))
        fixed.append((lengths, times))

    def largest(limit: int, but: int = 0) -> int:
        """The largest length up to limit; `but` counts one less. 0 if there is none."""
        i = bisect_left(have, limit + 1) - 1
        if i >= 0 and have[i] == but and left[but] == 1:
            i -= 1
        return have[i] if i >= 0 else 0

    def dominating(long: int) -> tuple[int, ...] | None:
        """A set with `long` that dominates every other set with it, all unfixed items considered; None if no rule gives one."""
        room = size - long
        k = largest(room, long)
        if not k:
            return (long,)
        if k == room:
            return (long, k)
        small: list[int] = []  # the three smallest items besides one `long`
        for n in have:
            small += [n] * min(3, left[n] - (n == long))
            if len(small) >= 3:
                break
        if sum(small[:3]) <= room and len(small) >= 3:
            return None  # three may join: no set of two is known to be best
        if len(small) < 2 or small[0] + small[1] > room or _pairs_reach(have, left, long, room) <= k:
            return (long, k)
        return None

    again = True
    while again:
        again = False
        for long in reversed(list(have)):
            while long in left and (found := dominating(long)):
                take(*found)
                again = True
    return fixed + _best_fit(left, size)


def _pairs_reach(have: list[int], left: dict[int, int], long: int, room: int) -> int:
    """The most that two items (other than one `long`) fill of the room; 0 if no two fit."""
    best, i, j = 0, 0, bisect_left(have, room + 1) - 1
    while i <= j:
        a, b = have[i], have[j]
        if a == b and left[a] < 2 + (a == long):
            j -= 1
        elif a + b <= room:
            best = max(best, a + b)
            i += 1
        else:
            j -= 1
    return best


def _best_fit(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    classes: dict[tuple[int, ...], int] = {}
    by_room: dict[int, list[tuple[int, ...]]] = defaultdict(list)
    rooms: list[int] = []

    def add(pattern: tuple[int, ...], times: int) -> None:
        if pattern in classes:
            classes[pattern] += times
            return
        classes[pattern] = times
        r = size - sum(pattern)
        if r not in by_room or not by_room[r]:
            rooms.insert(bisect_left(rooms, r), r)
        by_room[r].append(pattern)

    def drop(pattern: tuple[int, ...], times: int) -> None:
        classes[pattern] -= times
        if not classes[pattern]:
            del classes[pattern]
            r = size - sum(pattern)
            by_room[r].remove(pattern)
            if not by_room[r]:
                rooms.pop(bisect_left(rooms, r))

    for n in sorted(histogram, reverse=True):
        count = histogram[n]
        while count:
            i = bisect_left(rooms, n)
            if i == len(rooms):
                each = size // n
                if count >= each:
                    add((n,) * each, count // each)
                    count %= each
                else:
                    add((n,) * count, 1)
                    count = 0
                continue
            pattern = by_room[rooms[i]][0]
            fit = rooms[i] // n
            times = min(classes[pattern], count // fit)
            if times:
                drop(pattern, times)
                add(pattern + (n,) * fit, times)
                count -= times * fit
            else:
                drop(pattern, 1)
                add(pattern + (n,) * count, 1)
                count = 0
    return sorted(classes.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length its runs of ranks: [first rank, first sequence, offset], by rank."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for n in pattern:
            out[n].append((used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    return {n: np.array(v, np.int64) for n, v in out.items()}


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows with a `length` of 1..size, each with sequence_id and offset; other columns stay. `cut` is read more than once, so give a stored table."""
    spark = cut.sparkSession
    bounded_batches(spark)
    cut = without_columns(cut, ["sequence_id", "offset"])
    s_, r_, n_, before_, rank_ = unused(cut, "slice", "nth", "n", "before", "rank")
    slices = partitions(spark) * 4
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in cut.columns if c in ("doc_id", "piece")]), F.lit(slices)).cast("int")
    per = cut.select("length", part.alias(s_)).groupBy("length", s_).agg(F.count("*").alias(n_))
    histogram = {int(r["length"]): int(r["n"]) for r in per.groupBy("length").agg(F.sum(n_).alias("n")).collect()}  # at most `size` rows
    plan = slots(reduce_and_fit(histogram, size))
    from pyspark.sql import Window

    before = per.select("length", s_, (F.sum(n_).over(Window.partitionBy("length").orderBy(s_)) - F.col(n_)).alias(before_))
    within = F.row_number().over(Window.partitionBy("length", s_).orderBy("doc_id", *(["piece"] if "piece" in cut.columns else []))) - 1
    ranked = cut.withColumn(s_, part).withColumn(r_, within).join(before, ["length", s_])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in cut.columns], (F.col(before_) + F.col(r_)).cast("long").alias(rank_))
    names = list(cut.columns)
    place, rank_at = names.index("length"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ranks = b.column(place).to_numpy(zero_copy_only=False), b.column(rank_at).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                table = plan[int(n)]
                i = np.searchsorted(table[:, 0], ranks[at], "right") - 1
                seq[at], off[at] = table[i, 1] + ranks[at] - table[i, 0], table[i, 2]
            yield pa.RecordBatch.from_arrays([*b.columns[:rank_at], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, ranked.select(*[F.col(f"`{c}`") for c in cut.columns], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema)


def pack_documents(df: DataFrame, tokenizer: str, size: int = SIZE, text: str = "text") -> DataFrame:
    return pack(stored(pieces(df, tokenizer, size, text), "pieces"), size)
