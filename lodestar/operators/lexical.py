"""BM25: blocked postings, statistics, top-k search that reads few of them.

Postings are inverted where the documents are: a block is the index of some DOCS documents of one input partition, a row per
term with its entries and the greatest weight among them. Building shuffles nothing, and no row or task holds the whole
list of a common term. `search` works in two steps:

* a floor for every query: its rarest terms (of common ones, a few blocks) give partial scores, whose k-th greatest is one;
* each asked term's row of a block goes to the block's task once for up to QUERIES queries of ASKS terms in all, whose terms are all that is broadcast
  at once; more queries are searched in turn, and a turn's shuffle files go when its result is written. There a query is skipped if
  the greatest weights of its terms stay below its floor; else its documents come from the terms that can lift one over
  half of the floor, and the other terms are added only if one of those can still reach it. A block answers with k documents
  a query at most, none below the floor.

The result equals scoring every hit (`scores`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import word_tokens
from lodestar.sources.sinks import kept, scratch

K1, B = 1.5, 0.75
#: Documents and tokens of a block at most, about; entries that a query's floor is taken from, per wanted row.
DOCS, TOKENS, FIRST = 4096, 1_000_000, 16
#: What a worker gets at once, so that its memory doesn't depend on the rows of a file.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
#: Ways in which the blocks of common terms are dealt; queries that are scored together, and their terms.
SLOTS, SALT, QUERIES, ASKS = 4096, 64, 20_000, 100_000
#: Terms that together add less than this share of the floor are left for later.
LATE = 0.5
#: Scores are rounded to 6 places before they are ranked; bounds give way by more than that.
SLACK = 1e-5
#: Scores of a block that are added up at once.
CELLS = 1 << 20
#: Most rows of a broadcast side: a query's terms, its floors.
SMALL = 100_000


@dataclass
class Index:
    """blocks(term, block, most, n, entries of (did, tf, dl)), terms(term, df, idf, most), the corpus statistics, and whether ids are
    distinct. `save` it once and search often."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame  # one row: n, avgdl
    distinct: bool = True

    @property
    def postings(self) -> DataFrame:
        """(did, term, tf, dl)"""
        return self.blocks.select("term", F.explode("entries").alias("e")).select("e.did", "term", F.col("e.tf").cast("long").alias("tf"), F.col("e.dl").cast("long").alias("dl"))

    def save(self, path: str) -> None:
        spark = self.blocks.sparkSession
        self.blocks.write.parquet(f"{path}/blocks")
        self.terms.write.parquet(f"{path}/terms")
        self.stats.write.parquet(f"{path}/stats")
        spark.createDataFrame([(self.distinct,)], "ids boolean").coalesce(1).write.parquet(f"{path}/distinct")

    @staticmethod
    def load(spark, path: str) -> Index:
        tables = [spark.read.parquet(f"{path}/{t}") for t in ("blocks", "terms", "stats")]
        return Index(*tables, spark.read.parquet(f"{path}/distinct").first()["ids"])


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _weight(tf: Column, dl: Column, avgdl: Column) -> Column:
    """A posting's weight without its term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _inverted(ids: pa.Array, lists: pa.ListArray, avgdl: float, block: int) -> pa.RecordBatch:
    """Some documents' words as (term, block, most, n, entries)."""
    dl = np.diff(lists.offsets.to_numpy())
    words = lists.flatten().dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), dl)
    code, tf = np.unique(code, return_counts=True)
    term, doc = np.divmod(code, max(1, len(ids)))
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / avgdl))
    offsets = np.r_[first, len(term)].astype(np.int32)
    entries = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf.astype(np.int32)), pa.array(dl[doc].astype(np.int32))], ["did", "tf", "dl"])
    most = np.maximum.reduceat(weight, first) if len(first) else np.zeros(0)
    columns = [words.dictionary.take(pa.array(term[first])), pa.array(np.full(len(first), block, np.int64)), pa.array(most), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), entries)]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "most", "n", "entries"])


def _room(dl: np.ndarray, docs: int, tokens: int) -> int:
    """How many of the next documents a block takes that has room for so many documents and tokens: at least one, and the first that fills it."""
    return max(1, min(docs, len(dl), int(np.searchsorted(np.cumsum(dl), tokens)) + 1))


def _blocks(tokens: DataFrame, avgdl: float, docs: int) -> DataFrame:
    did = tokens.schema["did"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids: list[pa.Array] = []
        lists: list[pa.Array] = []
        rows = size = 0

        def out() -> Iterator[pa.RecordBatch]:
            made = _inverted(pa.concat_arrays(ids), pa.concat_arrays(lists), avgdl, number)
            for lo in range(0, made.num_rows, 20_000):
                yield made.slice(lo, 20_000)

        for b in batches:
            lo = 0
            while lo < b.num_rows:
                dl = np.diff(b.column(1).offsets.to_numpy())[lo:]
                part = b.slice(lo, _room(dl, docs - rows, TOKENS - size))
                ids.append(part.column(0))
                lists.append(part.column(1))
                rows, size, lo = rows + part.num_rows, size + len(part.column(1).flatten()), lo + part.num_rows
                if rows >= docs or size >= TOKENS:
                    yield from out()
                    ids, lists, rows, size, number = [], [], 0, 0, number + 1
        if ids:
            yield from out()

    return tokens.select("did", "t").mapInArrow(run, f"term string, block long, most double, n long, entries array<struct<did: {did}, tf: int, dl: int>>")


def build(docs: DataFrame, did: str, text: str, block: int = DOCS, path: str | None = None) -> Index:
    """Documents without a token have no posting but count in n and avgdl. Of equal ids each row counts as a document; their weights add up.

    Texts are read for the statistics and for the blocks, which are written: to `path`, or to a scratch folder.
    """
    spark = docs.sparkSession
    path = path or scratch(spark)
    tokens = docs.select(F.col(did).alias("did"), word_tokens(F.col(text)).alias("t"))
    per = tokens.groupBy("did").agg(F.count("*").alias("rows"), F.sum(F.size("t").cast("long")).alias("dl"))
    n, avgdl, most = per.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.when(F.sum("dl") > 0, F.sum("dl") / F.sum("rows")).otherwise(F.lit(1.0)), F.max("rows")).first()
    stats = spark.createDataFrame([(n, avgdl)], "n long, avgdl double")
    stats.coalesce(1).write.parquet(f"{path}/stats")
    was = {c: spark.conf.get(c) for c in BATCHES}
    try:
        for c, limit in BATCHES.items():
            spark.conf.set(c, limit)
        _blocks(tokens, avgdl, block).write.parquet(f"{path}/blocks")
    finally:
        for c, own in was.items():
            spark.conf.set(c, own)
    _terms(spark.read.parquet(f"{path}/blocks"), stats).write.parquet(f"{path}/terms")
    spark.createDataFrame([((most or 0) <= 1,)], "ids boolean").coalesce(1).write.parquet(f"{path}/distinct")
    return Index.load(spark, path)


def _terms(blocks: DataFrame, stats: DataFrame) -> DataFrame:
    per = blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most"))
    return per.crossJoin(F.broadcast(stats)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"), "most")  # stats: one row


def scores(index: Index, queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, did, score) of all documents that share a term with the query. Each distinct query term counts once."""
    asked = queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term"))
    hits = index.postings.join(asked, "term").join(index.terms, "term").crossJoin(F.broadcast(index.stats))  # stats: one row
    weight = F.col("idf") * _weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return hits.groupBy("qid", "did").agg(F.round(F.sum(weight), 6).alias("score"))


def top_k(scored: DataFrame, k: int, group: str = "qid", item: str = "did", score: str = "score", keep: bool = True) -> DataFrame:
    """Rows with `rank` up to k: score downwards, ties by id."""
    order = Window.partitionBy(group).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def _some_entries(index: Index, wanted: DataFrame, avgdl: float) -> DataFrame:
    """(qid, did, s): an entry's weight times idf, for wanted (qid, term, idf, slots): blocks of the term's first so many slots, or all of them.

    How many slots depends on the term alone, so blocks are picked by the distinct terms before queries multiply them.
    """
    wanted = kept(wanted)
    terms = wanted.groupBy("term").agg(F.max("slots").alias("slots"))
    blocks = index.blocks.select("term", F.pmod(F.xxhash64("block"), F.lit(SLOTS)).alias("slot"), "entries")
    picked = blocks.join(_small(terms), "term").where("slot < slots").select("term", "entries")
    hits = picked.join(_small(wanted.select("qid", "term", "idf")), "term").select("qid", "idf", F.explode("entries").alias("e"))
    return hits.select("qid", "e.did", (F.col("idf") * _weight(F.col("e.tf"), F.col("e.dl"), F.lit(avgdl))).alias("s"))


def asked_terms(index: Index, queries: DataFrame, qid: str, text: str) -> DataFrame:
    """(qid, term, idf, df, up): the distinct terms of each query that some document has; up = the most one can add to a score."""
    rows = queries.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("term")).distinct()
    return index.terms.join(_small(rows), "term").select("qid", "term", "idf", "df", (F.col("idf") * F.col("most")).alias("up"))


def floors(index: Index, asked: DataFrame, k: int, avgdl: float, without: DataFrame | None = None) -> DataFrame:
    """(qid, least): k documents of the query score so much at least; no row for a query with fewer."""
    upto = Window.partitionBy("qid").orderBy("df", "term")
    rare = asked.withColumn("before", F.sum("df").over(upto) - F.col("df")).where(F.col("before") < FIRST * k)
    # of a common term so many blocks as hold about FIRST * k entries: any part of a score is less than all of it
    slots = F.least(F.lit(SLOTS), F.ceil(F.lit(2.0 * FIRST * k * SLOTS) / F.col("df"))).cast("int")
    part = _some_entries(index, rare.select("qid", "term", "idf", slots.alias("slots")), avgdl).groupBy("qid", "did").agg(F.sum("s").alias("score"))
    if without is not None:
        part = part.join(without, ["qid", "did"], "left_anti")
    return top_k(part, k).where(F.col("rank") == k).select("qid", (F.col("score") - SLACK).alias("least"))


def _order(values: pa.Array) -> np.ndarray:
    """Each value's place among all of them in ascending order."""
    out = np.empty(len(values), np.int64)
    out[pc.sort_indices(values).to_numpy()] = np.arange(len(values))
    return out


def _lists(t: pa.Table, name: str) -> tuple[np.ndarray, pa.Array]:
    """A column of lists: where each begins, and all values."""
    whole = t.column(name).combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    at = whole.offsets.to_numpy()
    return at - at[0] if len(at) else np.zeros(1, np.int64), whole.flatten()


def scored_block(t: pa.Table, avgdl: float) -> tuple[pa.Table, int]:
    """(qid, did, score) of one block for some queries, `want` a query at most and none below `least`; and the entries looked at.

    t: a row per term: most, idf, its entries (did, tf, dl) and the queries that have it (qid, late, least, rest, want) as lists.
    """
    (at, did), (asked, qid) = _lists(t, "did"), _lists(t, "qid")
    did, qid, n_asks = did.dictionary_encode(), qid.dictionary_encode(), np.diff(asked)
    doc, rank = did.indices.to_numpy(zero_copy_only=False), _order(did.dictionary)
    tf, dl = (_lists(t, c)[1].to_numpy(zero_copy_only=False) for c in ("tf", "dl"))
    weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    most, idf = t.column("most").to_numpy(), np.repeat(t.column("idf").to_numpy(), n_asks)
    code = qid.indices.to_numpy(zero_copy_only=False)
    term = np.repeat(np.arange(t.num_rows), n_asks)
    late, least, rest, want = (_lists(t, c)[1].to_numpy(zero_copy_only=False) for c in ("late", "least", "rest", "want"))
    order = np.argsort(code, kind="stable")
    n_queries, n_docs = len(qid.dictionary), len(rank)
    first = order[np.searchsorted(code[order], np.arange(n_queries))]
    up = np.bincount(code, np.where(late, 0.0, idf * most[term]), n_queries) + rest[first]  # the most that a document of this block can have
    may_reach = (np.bincount(code[~late], minlength=n_queries) > 0) & (up >= least[first])
    order = order[may_reach[code[order]]]
    early, after = order[~late[order]], order[late[order]]
    place = np.arange(len(after)) - np.searchsorted(code[after], code[after])  # of a query's terms that are left for later
    weighed = _Weights(np.repeat(np.arange(t.num_rows), np.diff(at)) * n_docs + doc, weight)
    q_out, d_out, s_out, looked = [], [], [], 0
    reached = np.flatnonzero(may_reach)
    step = max(1, CELLS // max(1, n_docs))
    for lo in range(0, len(reached), step):  # some queries at a time, whose scores are a table of a bounded size
        some = reached[lo : lo + step]
        mine = early[slice(*np.searchsorted(code[early], (some[0], some[-1] + 1)))]
        count = np.diff(at)[term[mine]]
        row = np.repeat(np.searchsorted(some, code[mine]), count)
        entry = np.repeat(at[term[mine]] - (np.cumsum(count) - count), count) + np.arange(len(row))
        total = np.bincount(row * n_docs + doc[entry], np.repeat(idf[mine], count) * weight[entry], len(some) * n_docs).reshape(len(some), -1)
        looked += len(entry)
        floor, more, k = least[first[some]], rest[first[some]], want[first[some]]
        q, d = np.nonzero((total > 0) & (total + more[:, None] >= floor[:, None]))
        score = total[q, d]
        best = np.lexsort((-score, q))  # k documents of this block may have more than the floor without the other terms
        at_k = np.searchsorted(q, np.arange(len(some))) + k - 1
        full = np.flatnonzero(np.bincount(q, minlength=len(some)) > k)
        floor[full] = np.maximum(floor[full], score[best[at_k[full]]] - SLACK)
        go = score + more[q] >= floor[q]
        q, d, score = q[go], d[go], score[go]
        own = slice(*np.searchsorted(code[after], (some[0], some[-1] + 1)))
        for n in range(int(place[own].max(initial=-1)) + 1):
            terms = np.full(len(some), -1)
            nth = after[own][place[own] == n]
            terms[np.searchsorted(some, code[nth])] = nth
            has = np.flatnonzero(terms[q] >= 0)
            a = terms[q[has]]
            found, got = weighed(term[a] * n_docs + d[has])
            score[has] += np.where(found, idf[a] * got, 0.0)
            looked += int(found.sum())
        score = np.round(score, 6)
        best = np.lexsort((rank[d], -score, q))
        q, d, score = q[best], d[best], score[best]
        go = (np.arange(len(q)) - np.searchsorted(q, q) < k[q]) & (score >= floor[q])
        q_out.append(some[q[go]])
        d_out.append(d[go])
        s_out.append(score[go])
    whole = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    out = pa.table({"qid": qid.dictionary.take(pa.array(whole(q_out, np.int64))), "did": did.dictionary.take(pa.array(whole(d_out, np.int64))), "score": pa.array(whole(s_out, np.float64))})
    return out, looked


class _Weights:
    """Looks up the weights of entries by distinct numbers."""

    def __init__(self, number: np.ndarray, weight: np.ndarray):
        order = np.argsort(number, kind="stable")
        self.number, self.weight = number[order], weight[order]

    def __call__(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which there are, and their weights."""
        at = np.minimum(np.searchsorted(self.number, number), max(0, len(self.number) - 1))
        return self.number[at] == number, self.weight[at]


def search(index: Index, queries: DataFrame, qid: str, text: str, k: int, without: DataFrame | None = None) -> DataFrame:
    """(qid, did, score, rank) of the k best documents with a term of the query; pairs (qid, did) of `without` are left out before ranking."""
    avgdl = index.stats.first()["avgdl"]
    without = None if without is None else without.select("qid", "did").distinct()
    if not index.distinct:  # a block's greatest weight bounds a row, not all rows of an id
        every = scores(index, queries, qid, text)
        return top_k(every if without is None else every.join(without, ["qid", "did"], "left_anti"), k)
    asked = kept(asked_terms(index, queries, qid, text))
    least = kept(floors(index, asked, k, avgdl, without))
    # terms by what they can add: a tail that stays well below the floor as a whole is left for later
    tail = F.sum("up").over(Window.partitionBy("qid").orderBy("up", F.desc("term")))
    parted = asked.join(_small(least), "qid", "left").withColumn("least", F.coalesce("least", F.lit(-1.0))).withColumn("late", tail < LATE * F.col("least"))
    parted = parted.withColumn("rest", F.coalesce(F.sum(F.when(F.col("late"), F.col("up"))).over(Window.partitionBy("qid")), F.lit(0.0)))
    want = F.lit(k)
    if without is not None:  # as many more as may be taken away
        parted = parted.join(_small(without.groupBy("qid").agg(F.count("*").alias("gone"))), "qid", "left")
        want = F.lit(k) + F.coalesce("gone", F.lit(0))
    n_asked, n_queries = asked.agg(F.count("*"), F.count_distinct("qid")).first()
    turns = max(1, -(-n_asked // ASKS), -(-n_queries // QUERIES))
    chunk = F.pmod(F.xxhash64("qid"), F.lit(turns)).cast("int")
    asks = parted.groupBy(chunk.alias("chunk"), "term").agg(F.first("idf").alias("idf"), F.collect_list(F.struct("qid", "late", "least", "rest", want.cast("int").alias("want"))).alias("asks"))
    asks = asks.select("chunk", "term", "idf", *[F.col(f"asks.{c}").alias(c) for c in ("qid", "late", "least", "rest", "want")])
    asks = kept(asks) if turns > 1 else asks
    q, d = asked.schema["qid"].dataType.simpleString(), index.blocks.schema["entries"].dataType.elementType["did"].dataType.simpleString()
    found = None
    for turn in range(turns):
        some = _turn(index, asks.where(F.col("chunk") == turn) if turns > 1 else asks, n_asked <= SMALL * turns, avgdl, f"qid {q}, did {d}, score double")
        some = kept(top_k(some, k).drop("rank")) if turns > 1 and without is None else kept(some) if turns > 1 else some
        found = some if found is None else found.unionByName(some)
    if without is not None:
        found = found.join(without, ["qid", "did"], "left_anti")
    return top_k(found, k)


def _turn(index: Index, asks: DataFrame, few: bool, avgdl: float, schema: str) -> DataFrame:
    """(qid, did, score) that the blocks answer to some queries. Lists travel as columns of their own, since a list of structs takes more than twice as much."""
    rows = index.blocks.select("term", "block", "most", *[F.col(f"entries.{c}").alias(c) for c in ("did", "tf", "dl")])
    if few:
        rows = rows.join(F.broadcast(asks), "term")
    else:
        salted = asks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALT)).cast("int")).join(salted, ["term", "salt"])

    def run(t: pa.Table) -> pa.Table:
        return scored_block(t, avgdl)[0]

    columns = ("block", "chunk", "most", "idf", "did", "tf", "dl", "qid", "late", "least", "rest", "want")
    return rows.select(*columns).groupBy("block", "chunk").applyInArrow(run, schema)
