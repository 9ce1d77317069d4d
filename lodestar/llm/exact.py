"""Exact dedup: a tree-merge of sorted digest runs.

Every input partition writes one run of (digest, identifier), sorted by digest. Nodes then exchange runs in binomial
rounds: a node's number is a string of bits, and a round replaces STEP of them by the digest's own bits, so that each
node receives one run from each of 2 ** STEP nodes, merges them in one pass and keeps, of equal digests, the smallest
identifier and the sum of the counts. After the last round the node's number is the digest's leading bits: each digest
has met all its copies, and no node ever held more than its share of the digests plus one row of a digest per sender,
however many copies a text has.

"Verified": rows are merged only if SHA-256, xxhash64 and the number of bytes of the normalised text all agree, at
every level. The result goes back by (first node, digest), where a hot text has no more rows than one partition gave.

Defined cases: null text is empty; runs of white space count as one space; the smallest identifier stays, a null one
only if there is no other; of repeated rows (equal text and identifier) one stays; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import partitions, stored, unused

#: Bits of a node's number that one round replaces: 2 ** STEP runs are merged at once.
STEP = 3
_KEY, _ORDER = ["digest", "check", "n_bytes"], ["no_id", "id", "row"]


def normalised(text: Column) -> Column:
    """Text as it is compared: null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _same_as_before(columns: list[pa.Array]) -> np.ndarray:
    """For all rows but the first: whether every column equals that of the row before."""
    n = len(columns[0])
    out = np.ones(max(0, n - 1), bool)
    for c in columns:
        if pa.types.is_binary(c.type):  # SHA-256: 32 bytes each
            begin = np.frombuffer(c.buffers()[1], np.int32)[c.offset]
            v = np.frombuffer(c.buffers()[2], np.uint8)[begin : begin + 32 * n].reshape(n, 32)
            out &= (v[1:] == v[:-1]).all(1)
        else:
            v = c.to_numpy(zero_copy_only=False)
            out &= v[1:] == v[:-1]
    return out


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, sorted by keys and identifier within their partition: the first row of each key, with the sum of n."""
    names = rows.columns
    n_at, key_at = names.index("n"), [names.index(k) for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] | None = None  # the last key's row: the next batch may go on with it
        for b in batches:
            if not b.num_rows:
                continue
            cols = b.columns if held is None else [pa.concat_arrays([h, c]) for h, c in zip(held, b.columns, strict=True)]
            first = np.flatnonzero(np.r_[True, ~_same_as_before([cols[i] for i in key_at])])
            total = pa.array(np.add.reduceat(cols[n_at].to_numpy(), first), pa.int64())
            done = [total if i == n_at else c.take(pa.array(first)) for i, c in enumerate(cols)]
            held = [c.slice(len(first) - 1) for c in done]
            if len(first) > 1:
                yield pa.RecordBatch.from_arrays([c.slice(0, len(first) - 1) for c in done], names)
        if held is not None:
            yield pa.RecordBatch.from_arrays(held, names)

    return rows.mapInArrow(run, rows.schema)


def tree_merged(runs: DataFrame, bits: int, step: int = STEP) -> DataFrame:
    """runs: (node, digest, check, n_bytes, no_id, id, row, n), merged within a node. One row per text, after bits / step rounds.

    Each round is one exchange between nodes; of the digest, its first 4 bytes name the node.
    """
    lead = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    for low in range(0, bits, step):
        mask = ((1 << min(step, bits - low)) - 1) << low
        runs = runs.withColumn("node", (F.col("node").bitwiseAND(~mask)).bitwiseOR(lead.bitwiseAND(mask)).cast("int"))
        runs = _merged(runs.repartitionById(1 << bits, "node").sortWithinPartitions(*_KEY, *_ORDER), _KEY)
    return runs


def exact_classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", bits: int | None = None, step: int = STEP) -> DataFrame:
    """One row per row of df: doc_id, keep_id (the identifier that stays), group_size, kept, text_sha256 of the normalised text.

    bits: there are 2 ** bits nodes; by default the largest power of two within the session's shuffle partitions.
    """
    spark = df.sparkSession
    bits = max(1, partitions(spark).bit_length() - 1) if bits is None else bits
    body = normalised(F.col(f"`{text}`"))
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), body.alias("t"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("part"))
    rows = rows.select(
        F.col("part").bitwiseAND((1 << bits) - 1).cast("int").alias("node"),
        "part",
        F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        F.xxhash64("t").alias("check"),
        F.octet_length("t").cast("long").alias("n_bytes"),
        F.col("id").isNull().alias("no_id"),
        "id",
        "row",
        F.lit(1).cast("long").alias("n"),
    )
    rows = stored(rows, "digests")  # texts are read once, and rows keep their places and partitions
    runs = _merged(rows.sortWithinPartitions("part", *_KEY, *_ORDER), ["part", *_KEY])
    found = tree_merged(runs.drop("part"), bits, step).where("n > 1")
    found = found.select(*_KEY, F.struct(F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("size")).alias("found"))
    back = rows.select("part", *_KEY).distinct().join(found, _KEY)  # a row per text and partition that has it
    both = rows.select("part", *_KEY, "id", "row").join(back, ["part", *_KEY], "left")
    single = F.col("found").isNull()
    return both.select(
        F.col("id").alias("doc_id"),
        F.when(single, F.col("id")).otherwise(F.col("found.keep_id")).alias("keep_id"),
        F.when(single, F.lit(1)).otherwise(F.col("found.size")).cast("long").alias("group_size"),
        (single | (F.col("row") == F.col("found.keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_exact(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows whose text an earlier identifier has, all columns; df is stored once, so that a row's place is fixed."""
    row_ = unused(df, "row")[0]
    placed = stored(df.withColumn(row_, F.monotonically_increasing_id()), "placed")
    first = exact_classes(placed.select(F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.col(row_).alias("row")).alias("id"), F.col(f"`{text}`").alias("text")), "id", "text")
    return placed.join(first.where("kept").select(F.col("doc_id.row").alias(row_)), row_, "left_semi").select(*[f"`{c}`" for c in df.columns])
