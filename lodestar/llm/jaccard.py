"""N-gram Jaccard join with Bayesian candidate pruning.

Links are pairs of texts whose sets of five-word shingles have Jaccard similarity of THRESHOLD or
more; equal texts are always linked. Steps:

1. One-permutation MinHash of every text; BANDS bands of ROWS values are the buckets. A pair at the
   threshold shares no bucket with probability (1 - t**ROWS)**BANDS, 1e-7 here.
2. Within a bucket MinHash values (8 bits each) are compared 32 at a time; a pair is dropped as soon
   as the posterior probability of reaching the threshold falls below TOLERANCE. What survives is
   reduced to a spanning forest, so a bucket sends at most one row per member. A bucket with more than
   WIDE different texts skips the comparison and is a star (a superset: nothing is lost).
3. The forests' connected components hold every link. The texts of a component meet once, in blocks
   of BLOCK texts for a larger one; there every pair is pruned in the same way and what survives is
   verified exactly. A block pair returns one row per text: its number of links and the least text it
   is connected to.

The result is one row per document: class_id, the least doc_id of its class (component of links), and
n_links, how many other documents it is linked to, copies included.

Defined cases: null text is empty; a text without words is linked to equal texts only; repeated rows
are copies; rows with a null doc_id take part, and class_id is the least non-null id of the class;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches, partitions, stored, unused
from lodestar.llm.components import components

THRESHOLD, TOLERANCE = 0.8, 1e-7
BINS, BANDS, ROWS, COMPARED, STEP = 256, 40, 5, 128, 32
WIDE, BLOCK = 2048, 256


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For STEP, 2 STEP, ... compared values, the least number of equal ones with which a pair goes on.

    With a uniform prior the posterior probability of reaching the threshold after m of n matches is that of a
    binomial (n + 1, u) being at most m, where u is the chance that two values' low 8 bits agree at the threshold.
    """
    u = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, COMPARED + 1, STEP):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * u**m * (1 - u) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def survivors(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Which pairs (i, j) of signature rows pass the incremental comparison."""
    left = np.arange(len(i))
    same = np.zeros(len(i), np.int32)
    for k, m in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        same = same + (sig[i[left], part] == sig[j[left], part]).sum(1, dtype=np.int32)
        go = same >= m
        left, same = left[go], same[go]
    return left


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each index's component."""
    lab = np.arange(n)
    while len(i):
        low = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, lab[i], low)
        np.minimum.at(new, lab[j], low)
        new = new[new]
        while not np.array_equal(new, nxt := new[new]):
            new = nxt
        if np.array_equal(new, lab):
            break
        lab = new
    return lab


def _signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands, sig): node is the text's 64-bit hash; bands is empty for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = kernel.flat(b.column(2))
            bands, sigs, some = [], [], []
            for x, y in kernel.chunks(offs):
                sh, before = kernel.shingles(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
                v = kernel.one_permutation(sh, before, BINS)
                h = np.zeros((y - x, BANDS), np.uint64)
                for r in range(ROWS):
                    h += v[:, r * BANDS : (r + 1) * BANDS] * kernel._STEP[r + 1]
                bands.append(kernel.mix(h + np.arange(BANDS, dtype=np.uint64)))
                sigs.append(v[:, BINS - COMPARED :].astype(np.uint8))
                some.append(np.diff(before) > 0)
            if not bands:
                continue
            has = np.concatenate(some)
            ends = np.zeros(len(has) + 1, np.int32)
            np.cumsum(np.where(has, BANDS, 0), out=ends[1:])
            band = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)[has].ravel().view(np.int64)))
            raw = np.ascontiguousarray(np.concatenate(sigs))
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COMPARED), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), band, sig], ["doc_id", "node", "bands", "sig"])

    return docs.mapInArrow(run, "doc_id long, node long, bands array<long>, sig binary")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[int], at_least: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a key ends, of at least so many rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < at_least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(t.num_rows, bool)
        for k in keys:
            c = t.column(k).to_numpy()
            same &= c == c[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks()
        held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _starts(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _pairs(first: np.ndarray, sizes: np.ndarray, limit: int = 100_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within runs of rows, about limit at a time."""
    for s in np.unique(sizes[sizes > 1]).tolist():
        i, j = np.triu_indices(s, 1)
        own = first[sizes == s]
        step = max(1, limit // len(i))
        for lo in range(0, len(own), step):
            base = own[lo : lo + step, None]
            a, b = (base + i).ravel(), (base + j).ravel()
            for x in range(0, len(a), limit):
                yield a[x : x + limit], b[x : x + limit]


def _forest(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, [0], 20_000):
            bucket, node = t.column(0).to_numpy(), t.column(1).to_numpy()
            sig = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(-1, COMPARED)
            first = _starts(bucket)
            sizes = np.diff(np.r_[first, len(bucket)])
            ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in _pairs(first, sizes):
                go = survivors(sig, i, j, least)
                ii.append(i[go])
                jj.append(j[go])
            lab = labels(len(node), np.concatenate(ii), np.concatenate(jj))
            other = np.flatnonzero(lab != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[lab[other]])], ["a", "b"])

    return run


def _linked(texts: list[str], side: np.ndarray, weight: np.ndarray, threshold: float, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Of one block pair: weighted links of each text, and its component's least index. side: the texts' blocks, pairs
    within one block are only looked at if there is one."""
    data, offs = kernel.joined([t.encode() for t in texts])
    sets, sigs = [], []
    for x, y in kernel.chunks(offs):
        sh, before = kernel.shingles(data[offs[x] : offs[y]], offs[x : y + 1] - offs[x])
        sigs.append(kernel.one_permutation(sh, before, BINS)[:, BINS - COMPARED :].astype(np.uint8))
        sets += [np.unique(sh[before[k] : before[k + 1]]) for k in range(y - x)]
    sig, sizes = np.concatenate(sigs), np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=start[1:])
    n = len(texts)
    links = np.zeros(n, np.int64)
    ii, jj = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    mark = np.zeros(len(vocabulary), bool)
    one = len(np.unique(side)) == 1
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(np.minimum(sizes[i], sizes[j]) >= threshold * np.maximum(sizes[i], sizes[j]) - 1e-9) & (one | (side[j] != side[i]))]
        j = j[survivors(sig, np.full(len(j), i), j, least)]
        if not len(j):
            continue
        mark[ids[start[i] : start[i + 1]]] = True
        where = np.concatenate([np.arange(start[k], start[k + 1]) for k in j])
        bounds = np.r_[0, np.cumsum(sizes[j])[:-1]]
        both = np.add.reduceat(mark[ids[where]].astype(np.int64), bounds)
        mark[ids[start[i] : start[i + 1]]] = False
        j = j[both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9]
        links[i] += weight[j].sum()
        links[j] += weight[i]
        ii.append(np.full(len(j), i))
        jj.append(j)
    return links, labels(n, np.concatenate(ii), np.concatenate(jj))


def _verify(threshold: float, least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, [0, 1, 2], 500):
            comp, i, j, blk, node, weight = (t.column(k).to_numpy() for k in range(6))
            texts = t.column(6).to_pylist()
            first = _starts(comp, i, j)
            links, root = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
            for x, y in zip(first, np.r_[first[1:], len(node)], strict=True):
                got, lab = _linked(texts[x:y], blk[x:y], weight[x:y], threshold, least)
                links[x:y], root[x:y] = got, node[x:y][lab]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root), pa.array(links)], ["node", "leader", "links"])

    return run


def _buckets(exploded: DataFrame) -> DataFrame:
    """Of distinct (node, bucket): one bucket (and its least node) for each set of two members or more, told apart by a sum of hashes."""
    hashed = F.xxhash64("node")
    halves = [F.sum(F.shiftrightunsigned(hashed, 32)).alias("x"), F.sum(hashed.bitwiseAND(F.lit((1 << 32) - 1))).alias("y")]  # no overflow
    per = exploded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"), *halves).where("lo < hi")
    return per.groupBy("lo", "hi", "n", "x", "y").agg(F.min("bucket").alias("bucket"))


def jaccard_classes(df: DataFrame, text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links), one row per row of df."""
    spark = df.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    least = least_matches(threshold, tolerance)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(body).alias("node"), body.alias("text"))
    rows = stored(_signatures(docs), "signatures")

    # buckets with two different texts or more; of buckets with the same members one is enough
    exploded = rows.groupBy("node").agg(F.any_value("bands").alias("bands")).select("node", F.explode("bands").alias("bucket"))
    per = _buckets(exploded)
    members = stored(exploded.select("node", "bucket").join(per.select("bucket", "lo"), "bucket").select("bucket", "node", "lo").distinct(), "members")
    width = members.groupBy("bucket").agg(F.count("*").alias("width"))
    narrow, wide = width.where(F.col("width") <= WIDE).select("bucket"), width.where(F.col("width") > WIDE).select("bucket")
    one = rows.groupBy("node").agg(F.any_value("sig").alias("sig"))
    close = members.join(narrow, "bucket").select("bucket", "node").join(one, "node").select("bucket", "node", "sig").repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_forest(least), "a long, b long")
    stars = members.join(wide, "bucket").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    comps = stored(components(close.union(stars)), "components")

    # texts meet once in their component's blocks
    sizes = comps.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    weights = rows.groupBy("node").agg(F.count("*").alias("weight"))
    placed = comps.join(sizes, "root").join(weights, "node").select("node", "weight", F.col("root").alias("comp"), "nb", F.pmod(F.xxhash64("node", F.lit(7)), F.col("nb")).cast("int").alias("blk"))
    texts = docs.select("node", "text").join(placed, "node").groupBy("node", "weight", "comp", "nb", "blk").agg(F.any_value("text").alias("text"))
    tasks = texts.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select("comp", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "node", "weight", "text")
    found = stored(tasks.repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_verify(threshold, least), "node long, leader long, links long"), "links")

    roots = components(found.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")
    known = rows.groupBy("node").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least")).join(linked, "node", "left")
    known = known.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"), "least")
    classes = known.groupBy("root").agg(F.min("least").alias("class_id"))
    return rows.select("doc_id", "node").join(known.join(classes, "root").select("node", "n_links", "class_id"), "node").select("doc_id", "class_id", "n_links")


def keep_one(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df whose doc_id is their class's least; every column stays.

    Of rows with equal doc_id and text one stays. Rows without a doc_id stay unless their class has a document with one.
    """
    found = jaccard_classes(df, text)
    kept = found.where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct()
    rows = df.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", text])
    body = F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    nameless = df.where(F.col("doc_id").isNull())
    if nameless.isEmpty():
        return rows
    known = df.where(F.col("doc_id").isNotNull())
    copy = unused(df, "copy")[0]
    return rows.unionByName(nameless.join(known.select(body.alias(copy)).distinct(), body == F.col(copy), "left_anti").dropDuplicates([text]))
