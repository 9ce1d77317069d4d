"""Spelling variant grouping: words one edit apart, by an errata trie whose light subtrees are merged with one character skipped or replaced.

The trie of all words isn't built as one structure: its nodes are rows, named by the hash of a prefix, with the number
of words below each child. At every node the child with most words is heavy (heavy-path decomposition); a word has at most
log2(words) light children on its way. Only words that leave a node by a light child, or end at it, are merged there,
small-to-large, with the character at the node

* replaced: words that agree before and behind it fall into one group; the heavy child's word is looked up, not moved;
* skipped: the word without its light character, and the word with the heavy character put in, are looked up.

Looked-up strings are whole words, joined by equality, so terminals that coincide are exactly the pairs one edit apart.
Every pair is found once: a deletion inside a run of equal characters is taken at the run's end. A wrong heavy child (two
prefixes with one hash) costs rows, not results.

A group has one word per character of the alphabet at most, and a looked-up word one row per word near it. Nodes with very
many words are joined by a broadcast of at most HOT rows: their number is bounded, as all nodes' words together are the rows of the trie.

Defined cases: null and empty texts have no words; a null identifier is written as the empty text before the colon; repeated
rows count each; a misspelling that is deleted to nothing is dropped; words of any length are whole words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches, stored

#: Words shorter or rarer than this are left out; a form has at least TIMES the occurrences of its variant.
SHORTEST, RAREST, TIMES = 6, 5, 5
#: One run in ERRORS has a character deleted before it is counted.
ERRORS = 199
#: Most rows of the broadcast of hot nodes; a node with fewer than COLD words is never hot.
HOT, COLD = 50_000, 10_000
#: Distinct words that a counting task holds before it hands them on, and rows of one Arrow batch of trie rows.
HELD, ROWS = 400_000, 50_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 0xC3]] = True


def _crc_table() -> np.ndarray:
    """What a byte does to a CRC-32 register."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def letter_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all maximal runs of letters one after the other, A-Z lower-cased, where each begins, and its text.

    In UTF-8 the letters beyond ASCII are the byte C3 and any byte behind it.
    """
    member = _LETTER[data]
    if len(data):
        member[1:] |= data[:-1] == 0xC3
    starts, ends = kernel.runs(member, offs)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    return kernel.fold(data[member]), at, np.searchsorted(offs, starts, "right") - 1


def crc32s(letters: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """CRC-32 of every run, continued from the given CRC-32 of what stands before it."""
    reg = begin.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    reg, first, size = reg[order], at[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(1, min(64, size[0] if len(size) else 0) + 1), "right")  # runs with so many bytes
    for i, n in enumerate(live):
        r = reg[:n]
        reg[:n] = _CRC[(r ^ letters[first[:n] + i]) & np.uint32(255)] ^ (r >> np.uint32(8))
    for i in np.flatnonzero(size > 64):
        reg[i] = zlib.crc32(letters[first[i] + 64 : first[i] + size[i]].tobytes(), int(reg[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(reg)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    return out


def _counted(data: np.ndarray, offs: np.ndarray, ids: list[str]) -> pa.Table:
    """(word, n) of some texts."""
    letters, at, text = letter_runs(data, offs)
    begin = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    crc = crc32s(letters, at, begin[text])
    size = np.diff(at)
    marks = np.zeros(len(letters) + 1, np.int64)
    np.cumsum((letters & 0xC0) == 0x80, out=marks[1:])
    size -= marks[at[1:]] - marks[at[:-1]]  # code points
    edit = crc % ERRORS == 0
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters)))
    edited = []
    for w, h in zip(words.filter(pa.array(edit)).to_pylist(), crc[edit].tolist(), strict=True):
        k = h % len(w)
        if len(w) > SHORTEST:
            edited.append(w[:k] + w[k + 1 :])
    plain = words.filter(pa.array(~edit & (size >= SHORTEST)))
    both = pa.chunked_array([plain, pa.array(edited, pa.large_string())])
    seen = pc.value_counts(both)
    return pa.table({"word": seen.field("values").cast(pa.large_string()), "n": seen.field("counts").cast(pa.int64())})


def word_counts(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): all words of at least SHORTEST code points with their occurrences, misspellings made as the contract says."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for b in batches:
            ids = ["" if i is None else i for i in b.column(0).to_pylist()]
            data, offs = kernel.flat(b.column(1))
            for i, j in kernel.chunks(offs):
                held.append(_counted(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ids[i:j]))
                rows += held[-1].num_rows
                if rows > 2 * HELD:
                    held = [pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                    rows = held[0].num_rows
                    if rows > HELD:
                        yield from _sent(held[0])
                        held, rows = [], 0
        if held:
            yield from _sent(pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]))

    def _sent(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = pa.table({"word": t.column("word").cast(pa.string()), "n": t.column("n")})
        yield from t.to_batches(max_chunksize=ROWS)

    part = df.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string")).mapInArrow(run, "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def trie_rows(words: DataFrame) -> DataFrame:
    """words (id long, word string) as (node, child, id, d): the word leaves the node of its first d characters by `child` ('' at its end)."""
    bounded_batches(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            data, offs = kernel.flat(b.column(1))
            for i, j in kernel.chunks(offs):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                h = kernel.running_hash(part)
                lead = np.flatnonzero((part & 0xC0) != 0x80)  # where a character begins
                per = np.searchsorted(lead, o)
                n = np.diff(per) + 1
                owner = np.repeat(np.arange(j - i), n)
                d = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                last = d == np.repeat(n - 1, n)
                here = np.where(last, o[owner + 1], lead[np.minimum(per[owner] + d, max(0, len(lead) - 1))] if len(lead) else 0)
                node = kernel.span_hash(h, o[owner], here).view(np.int64)
                nxt = np.r_[lead, len(part)]
                end = np.where(last, here, nxt[np.minimum(per[owner] + d + 1, len(nxt) - 1)])
                chars = np.zeros(len(owner) + 1, np.int32)
                np.cumsum(end - here, out=chars[1:])
                # children stand one after the other in the text itself: a word's characters in order, then nothing
                child = pa.StringArray.from_buffers(len(owner), pa.py_buffer(chars), pa.py_buffer(np.ascontiguousarray(part)))
                out = pa.RecordBatch.from_arrays([pa.array(node), child, pa.array(ids[i:j][owner]), pa.array(d.astype(np.int32))], ["node", "child", "id", "d"])
                for k in range(0, out.num_rows, ROWS):
                    yield out.slice(k, ROWS)

    return words.select("id", "word").mapInArrow(run, "node long, child string, id long, d int")


def light_rows(words: DataFrame, hot: int = HOT, cold: int = COLD) -> DataFrame:
    """(id, d, heavy): the words that leave a branching node by a light child, or end at it, and the node's heavy child."""
    rows = stored(trie_rows(words), "trie")
    total = rows.count()
    child = rows.groupBy("node", "child").agg(F.count("*").alias("n"))
    node = child.groupBy("node").agg(
        F.max_by("child", F.when(F.col("child") != "", F.struct("n", "child"))).alias("heavy"),
        F.sum("n").alias("words"),
        F.count("*").alias("children"),
    )
    node = stored(node.where("children > 1").select("node", "heavy", "words"), "nodes")
    limit = max(cold, total // hot)  # at most total / limit <= hot nodes have so many words
    many = node.where(F.col("words") >= limit).select("node", "heavy")
    few = node.where(F.col("words") < limit).select("node", "heavy")
    light = F.col("child") != F.col("heavy")
    at_many = rows.join(F.broadcast(many), "node").where(light)
    at_few = rows.join(F.broadcast(many), "node", "left_anti").join(few, "node").where(light)
    return at_many.union(at_few).select("id", "d", "heavy")


def _best(n: Column, word: Column) -> Column:
    """Least for the most frequent word, then the smallest."""
    return F.struct((-n).alias("less"), word.alias("word"))


def near_words(words: DataFrame, hot: int = HOT, cold: int = COLD) -> DataFrame:
    """words (id, word, n), each word once. Per word with a near one: (word, n_near, best), best = (less: minus its n, word) of the most frequent near word."""
    light = light_rows(words, hot, cold).join(words, "id")
    before = F.expr("left(word, d)")
    rest = F.expr("substring(word, d + 1)")
    after = F.expr("substring(word, d + 2)")
    child = F.expr("substring(word, d + 1, 1)")
    light = light.select("word", "n", "heavy", before.alias("before"), child.alias("child"), rest.alias("rest"), after.alias("after"))
    has = F.col("child") != ""
    group = F.concat("before", F.lit("*"), "after")  # no letter is an asterisk
    asked = F.array_compact(
        F.array(
            F.when(has & ~F.startswith("after", "child"), F.struct(F.concat("before", "after").alias("find"), F.lit(None).cast("string").alias("group"))),
            F.struct(F.concat("before", "heavy", "rest").alias("find"), F.lit(None).cast("string").alias("group")),
            F.when(has, F.struct(F.concat("before", "heavy", "after").alias("find"), group.alias("group"))),
        )
    )
    light = stored(light.select("word", "n", F.when(has, group).alias("own"), asked.alias("asked")), "light")
    probes = light.select("word", "n", F.explode("asked").alias("p")).select("word", "n", F.col("p.find").alias("find"), F.col("p.group").alias("group"))
    found = stored(probes.join(words.select(F.col("word").alias("find"), F.col("n").alias("m")), "find"), "found")
    # one character skipped: a pair per row, told to both
    pair = found.where("group is null").select(F.explode(F.array(F.struct("word", _best(F.col("m"), F.col("find")).alias("near")), F.struct(F.col("find").alias("word"), _best(F.col("n"), F.col("word")).alias("near")))).alias("p"))
    skipped = pair.select("p.word", F.lit(1).cast("long").alias("n_near"), F.col("p.near").alias("best"))
    # one character replaced: the group's own best and second best tell each member its best
    members = light.where("own is not null").select(F.col("own").alias("group"), "word", "n").union(found.where("group is not null").select("group", F.col("find").alias("word"), F.col("m").alias("n")).distinct())
    order = Window.partitionBy("group").orderBy("rank")
    whole = Window.partitionBy("group")
    ranked = members.withColumn("rank", _best(F.col("n"), F.col("word"))).select("group", "word", "rank", F.count("*").over(whole).alias("size"), F.min("rank").over(whole).alias("first"), F.lead("rank").over(order).alias("next"))
    replaced = ranked.where("size > 1").select("word", (F.col("size") - 1).alias("n_near"), F.when(F.col("rank") == F.col("first"), F.col("next")).otherwise(F.col("first")).alias("best"))
    return skipped.union(replaced).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """forms (word, form): each word's last form, by doubling: a round's steps are twice as long. Occurrences grow TIMES-fold with
    each form, so no chain has more than log(all words) forms; each round is stored."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", hot: int = HOT, cold: int = COLD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for all words with at least RAREST occurrences; see the query's contract."""
    counts = word_counts(df, doc_id, text).where(F.col("n") >= RAREST)
    words = stored(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    near = near_words(words, hot, cold)
    best = -F.col("best.less")
    taken = best >= TIMES * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.word")).alias("form"), F.when(taken, best).alias("form_n")
    )
    found = stored(found, "forms")
    last = roots(found.where("form is not null").select("word", "form"))
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
