"""Which texts contain a string, in any case: a positional q-gram index, without comparing all texts with all strings.

Texts and strings are lower-cased and read as UTF-8 bytes, so containment of bytes is containment of characters. Of every
text the index keeps

* anchors: the LONG-byte grams that are least, by a fixed hash, in some window of WINDOW consecutive ones, with their
  positions. A string of at least LONG + WINDOW - 1 bytes has an anchor of its own wherever it stands, since what is least in
  a window inside the string is so in any text around it. About one position in WINDOW / 2 is kept;
* short grams, if wanted: the distinct grams of 1, 2 and 3 bytes, and the empty one, for shorter strings. They take about
  as much room as the texts, so by default they are made from the texts when a search has shorter strings.

A string asks for its RAREST grams by the number of entries they have. Entries vote for (text, place at which the string
would begin); only those with all votes are candidates, and each is verified by `contains`. Grams that very many texts share
are dealt by text, so no task holds one gram's entries alone.

Null texts contain nothing, null strings are left out, the empty string is in every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.sinks import kept

LONG, WINDOW, SHORT = 8, 24, 3
#: Grams of a string that are asked for.
RAREST = 3
#: Entries of a gram in one task, about.
ENTRIES = 1_000_000
#: Most rows of the grams asked for that are broadcast.
ASKED = 200_000
#: Bytes of text that a task looks at once.
CHUNK = 4 << 20


@dataclass
class GramIndex:
    """anchors(gram, did, pos), short(gram, did) or None."""

    anchors: DataFrame
    short: DataFrame | None = None

    def save(self, path: str) -> None:
        """Sorted by gram within each file, so that a search for few grams skips row groups."""
        self.anchors.sortWithinPartitions("gram").write.parquet(f"{path}/anchors")
        if self.short is not None:
            self.short.sortWithinPartitions("gram").write.parquet(f"{path}/short")

    @staticmethod
    def load(spark: SparkSession, path: str, short: bool = False) -> GramIndex:
        return GramIndex(*(spark.read.parquet(f"{path}/{t}") for t in (("anchors", "short") if short else ("anchors",))))


def _codes(data: np.ndarray, size: int) -> np.ndarray:
    """The grams of `size` bytes at every place as whole numbers."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out << np.uint64(8)) | data[i : i + n]
    return out


def _order(code: np.ndarray) -> np.ndarray:
    """A fixed random order of grams."""
    x = (code ^ (code >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Grams and places: the first least gram of every window of WINDOW grams. A text of fewer than LONG + WINDOW - 1 bytes has none."""
    code = _codes(np.frombuffer(text, np.uint8), LONG)
    n = len(code) - WINDOW + 1
    if n <= 0:
        return code[:0], np.zeros(0, np.int64)
    rank = _order(code)
    step = 1
    at = np.arange(len(code))  # where the least gram of the window that begins here stands, and its rank: halves of windows are joined

    def joined(far: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        later = rank[far : far + size] < rank[:size]
        return np.where(later, rank[far : far + size], rank[:size]), np.where(later, at[far : far + size], at[:size])

    while 2 * step <= WINDOW:
        rank, at = joined(step, len(at) - step)
        step *= 2
    _, least = joined(WINDOW - step, n)
    least = least[np.r_[True, least[1:] > least[:-1]]]  # a later window's first least gram never stands before
    return code[least], least


def short_grams(text: bytes) -> np.ndarray:
    """The distinct grams of 0 to SHORT bytes; a gram of n bytes has n in its top byte."""
    data = np.frombuffer(text, np.uint8)
    every = [np.zeros(1, np.uint64)]
    every += [np.unique(_codes(data, n)) | np.uint64(n << 56) for n in range(1, SHORT + 1)]
    return np.concatenate(every)


def _grams(rows: DataFrame, long: bool) -> DataFrame:
    """(key, low-cased text) as (gram, key, pos)."""
    key_type = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, code, pos, owner, size = b.column(0), [], [], [], 0

            def out() -> pa.RecordBatch:
                of = keys.take(pa.array(np.concatenate(owner)))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(code).view(np.int64)), of, pa.array(np.concatenate(pos).astype(np.int64))], ["gram", "key", "pos"])

            for i, t in enumerate(b.column(1)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                g, p = anchors(text) if long else ((s := short_grams(text)), np.zeros(len(s), np.int64))
                code.append(g)
                pos.append(p)
                owner.append(np.full(len(g), i))
                size += len(text)
                if size > CHUNK:
                    yield out()
                    code, pos, owner, size = [], [], [], 0
            if code:
                yield out()

    return rows.mapInArrow(run, f"gram long, key {key_type}, pos long")


def _low(docs: DataFrame, did: str, text: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(did).alias("did"), F.lower(text).alias("low"))


def _short(docs: DataFrame, did: str, text: str) -> DataFrame:
    return _grams(_low(docs, did, text), False).select("gram", F.col("key").alias("did"))


def build(docs: DataFrame, did: str, text: str, short: bool = False) -> GramIndex:
    anchors_ = _grams(_low(docs, did, text), True).select("gram", F.col("key").alias("did"), "pos")
    return GramIndex(anchors_, _short(docs, did, text) if short else None)


def _voted(entries: DataFrame, asked: DataFrame, begin: Column) -> DataFrame:
    """(key, did) with an entry for each of the key's RAREST grams at one beginning.

    entries: (gram, did, ...), asked: (gram, key, pos) distinct. How many entries a gram has is counted once; the greatest
    count of a chosen gram says how many ways its entries are dealt.
    """
    few = asked.limit(ASKED + 1).count() <= ASKED
    sent = F.broadcast if few else lambda x: x
    df = entries.join(sent(asked.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df"))
    counted = asked.join(df, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    best = counted.groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct("df", "gram", "pos"))), 1, RAREST).alias("best"))
    chosen = kept(best.where(F.col("best")[0]["df"] > 0).select("key", F.size("best").alias("votes"), F.explode("best").alias("b")).select("key", "votes", F.col("b.gram").alias("gram"), F.col("b.pos").alias("off"), F.col("b.df").alias("df")))
    most = chosen.agg(F.max("df").alias("m")).first()["m"] or 0
    ways = max(1, min(1024, -(-most // ENTRIES)))
    spread = chosen.withColumn("way", F.explode(F.sequence(F.lit(0), F.lit(ways - 1)))).drop("df")
    hits = entries.withColumn("way", F.pmod(F.xxhash64("did"), F.lit(ways)).cast("int")).join(sent(spread) if ways == 1 else spread, ["gram", "way"])
    return hits.groupBy("key", "did", begin.alias("begin")).agg(F.count("*").alias("n"), F.first("votes").alias("votes")).where("n = votes").select("key", "did").distinct()


def candidates(index: GramIndex, items: DataFrame, item: str, text: str, docs: DataFrame, did: str, doc_text: str) -> DataFrame:
    """(item, did): all texts that may contain the item's string, and few others. docs, did, doc_text: where short grams come from if the index has none."""
    strings = items.where(F.col(text).isNotNull()).select(F.col(item).alias("item"), F.lower(text).alias("low")).withColumn("key", F.sha2("low", 256))
    rows = strings.groupBy("key").agg(F.first("low").alias("low"))  # equal strings are asked for once
    size = F.octet_length("low")
    longer, shorter = rows.where(size >= LONG + WINDOW - 1), rows.where(size < LONG + WINDOW - 1)
    by_place = _voted(index.anchors, _grams(longer, True).distinct(), F.col("pos") - F.col("off"))
    by_item = strings.select("key", "item").distinct()
    if not shorter.limit(1).count():
        return by_place.join(by_item, "key").select("item", "did")
    # of a short string only its longest grams are asked for: the others are in any text that has those
    grams_ = _grams(shorter, False).withColumn("size", F.shiftright("gram", 56))
    top = shorter.select("key", F.least(F.octet_length("low"), F.lit(SHORT)).alias("size"))
    asked = grams_.join(top.distinct(), ["key", "size"]).select("gram", "key", F.lit(0).cast("long").alias("pos")).distinct()
    by_set = _voted(_short(docs, did, doc_text) if index.short is None else index.short, asked, F.lit(0))
    return by_place.union(by_set).join(by_item, "key").select("item", "did")


def containing(index: GramIndex, docs: DataFrame, did: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, did): the document's text contains the item's string, in any case."""
    may = candidates(index, items, item, item_text, docs, did, text)
    strings = items.where(F.col(item_text).isNotNull()).select(F.col(item).alias("item"), F.lower(item_text).alias("wanted"))
    texts = docs.where(F.col(text).isNotNull()).select(F.col(did).alias("did"), F.col(text).alias("text"))
    both = may.join(strings, "item").join(texts, "did")
    return both.where(F.contains(F.lower("text"), F.col("wanted"))).select("item", "did")
