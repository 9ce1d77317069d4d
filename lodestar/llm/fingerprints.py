"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed.

The set of a text is its shingles of five words (a shorter text with words: one shingle of
them all). Every shingle hash falls into one bin once; the fingerprint keeps the low BITS
bits of each bin as hexadecimal text. Likeness counts equal bins and takes out the matches
that chance gives: (p - c) / (1 - c) with c = 2 ** -BITS, cut to 0..1.

Defined cases: null text is empty; a text without words has the fingerprint "" and likeness 1
to another such text, 0 to any other; equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches, partitions

BINS, BITS = 512, 4


def codes(texts: list[bytes], bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """[texts, bins] low bits, and which texts have words."""
    data, offs = kernel.joined(texts)
    out, some = np.zeros((len(texts), bins), np.uint8), np.zeros(len(texts), bool)
    for i, j in kernel.chunks(offs):
        sh, before = kernel.shingles(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        out[i:j] = kernel.one_permutation(sh, before, bins).astype(np.uint8) & ((1 << BITS) - 1)
        some[i:j] = np.diff(before) > 0
    out[~some] = 0
    return out, some


def packed(code: np.ndarray, some: np.ndarray) -> list[str]:
    both = (code[:, 0::2] << 4 | code[:, 1::2]).astype(np.uint8)
    return [row.tobytes().hex() if ok else "" for row, ok in zip(both, some, strict=True)]


def unpacked(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    some = np.array([bool(f) for f in fingerprints], bool)
    width = next((len(f) for f in fingerprints if f), 0)
    out = np.zeros((len(fingerprints), width), np.uint8)
    for i, f in enumerate(fingerprints):
        if f:
            b = np.frombuffer(bytes.fromhex(f), np.uint8)
            out[i, 0::2], out[i, 1::2] = b >> 4, b & 15
    return out, some


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    chance = 2.0**-BITS
    p = (a == b).mean(1) if a.shape[1] else np.zeros(len(a))
    est = np.clip((p - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, est, np.where(a_some == b_some, 1.0, 0.0))


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the column `out` (replaced if there): the packed fingerprint of `text`. Every other column stays."""
    bounded_batches(df.sparkSession)
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() if t else b"" for t in b.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed(*codes(texts)), pa.string())], [*names, out])

    rows = df.select(*names)
    return rows.mapInArrow(run, rows.select("*", F.lit("").alias(out)).schema)


def bucket_of(key: Column, splits: list[int], wide: int = 128) -> Column:
    """How many of the sorted splits are below key, found in two steps so that the cost per row grows with the root."""
    if not splits:
        return F.lit(0)
    every = F.array(*[F.lit(int(s)).cast("long") for s in splits])
    heads = F.array(*[F.lit(int(s)).cast("long") for s in splits[::wide]])
    full = F.greatest(F.size(F.filter(heads, lambda s: s < key)) - 1, F.lit(0)) * wide
    return (full + F.size(F.filter(F.slice(every, full + 1, wide), lambda s: s < key))).cast("int")


def edited(df: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text (see the query's contract).

    Rows are cut into ranges of doc_id at ids that occur, so the row that follows a range's lowest
    id is known beforehand: that one row is sent to the range as well, and no order over all rows
    is ever needed in one task. Rows with equal doc_id stand in the order of their texts; a null
    doc_id is the lowest.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    low = -(1 << 63)
    n = partitions(spark)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low))
    ends = df.agg(F.max(key).alias("top"), F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000).alias("cuts")).first()
    if ends is None or ends["top"] is None:
        return spark.createDataFrame([], SCHEMA)
    splits = sorted({int(s) for s in (ends["cuts"] or []) if s < ends["top"]}) if n > 1 else []
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), key.alias("k"))
    rows = rows.withColumn("b", bucket_of(F.col("k"), splits))
    # the highest id of a range also stands behind the lowest of the range above; the highest of all, behind the lowest of all
    is_split = F.col("k").isin(splits) if splits else F.lit(False)
    sent = F.array_compact(
        F.array(
            F.struct(F.col("b").alias("b"), F.lit(0).alias("donor")),
            F.when(is_split, F.struct((F.col("b") + 1).alias("b"), F.lit(1).alias("donor"))),
            F.when(F.col("k") == int(ends["top"]), F.struct(F.lit(0).alias("b"), F.lit(2).alias("donor"))),
        )
    )
    rows = rows.select("doc_id", "text", "k", F.explode(sent).alias("at")).select("doc_id", "text", "k", "at.b", "at.donor")
    rows = rows.repartitionById(len(splits) + 1, "b").sortWithinPartitions("b", "donor", F.desc("k"), "text")

    def batch(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
        shown = [t.encode() for t in texts]
        nxt = [*texts[1:], following]
        lens = [len(t) for t in texts]
        edits = [(t[: m - m // 2] + x[: m // 2]).encode() for t, x, m in zip(texts, nxt, lens, strict=True)]
        code, some = codes([*shown, following.encode()])
        e_code, e_some = codes(edits)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(lens, pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
                pa.array(packed(code[:-1], some[:-1]), pa.string()),
                pa.array(packed(e_code, e_some), pa.string()),
                pa.array(likeness(code[:-1], some[:-1], e_code, e_some), pa.float64()),
                pa.array(likeness(code[:-1], some[:-1], code[1:], some[1:]), pa.float64()),
            ],
            NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        for b in batches:
            for i, t, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if ids and (d or len(ids) >= 256):
                    yield batch(ids, texts, t or "")
                    ids, texts = [], []
                if not d:  # else it was only the row behind its range's last own one
                    ids.append(i)
                    texts.append(t or "")

    return rows.select("doc_id", "text", "donor").mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
