"""Toxicity scores of texts whose words may be disguised.

A disguised word is a noisy channel's output: letters become look-alikes (LEET), letters repeat,
and separators or spaces stand between them. Each token that holds anything but plain letters, has a
letter three times or more in a row, or is one of a run of single characters, becomes a lattice of
character readings; Viterbi finds the path with the least cost under the channel and a character
bigram model, over its whole length. Plain words have one path and stay. A run of single characters is cut at the gaps
that are wider than its narrowest. Between the letters of what is left, and of tokens longer than WORD, words may begin (`pieces`):
where the bigram model has a boundary nearly as cheap as none, neighbouring pieces count joined and apart, up to WORD letters. Restored words and their prefixes are the features
of a logistic regression.

Training: the character model counts letters over all texts given to `fit` (not only labelled ones). The
classifier is fitted on at most SAMPLE labelled rows whose crc32(id) mod FOLDS is not 0 (the first by the id's hash).

Defined cases: null and empty texts have no features and get the prior's score; a null id counts as
empty text in the fold; without both classes among the labels every score is 0 (no evidence);
repeated rows score alike; a document labelled twice counts with each label.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches, crc_remainder, stored, unused

FOLDS, SAMPLE, FEATURES, MIN_TOXIC = 5, 20_000, 1000, 6
#: Prefixes of restored words, in letters, that are features beside the whole words.
PREFIXES = (4, 5, 6, 7)
#: So many different words with one prefix are features of their own.
SEVERAL = (2, 4)
#: What a character may stand for, beside itself if it is a letter.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Costs in nats: a look-alike read; a look-alike or a separator left out; a letter collapsed into the one before, in a run of three or more and else.
READ, DROP, SEPARATOR, REPEAT, TWICE = 1.0, 9.0, 0.3, 0.4, 3.0
LETTERS = 27  # word boundary, a to z
#: Letters of the longest word looked for in a reading of several words, and the cost in nats up to which a boundary in it is looked at.
WORD, LOOSE = 16, 1.5
MEMO = 200_000
_PLAIN = re.compile(r"(?!.*(.)\1\1)[^\W\d_]+")
_EDGES = re.compile(r"^(?:[^\w@$!|+(€£¡]|([@$!|+(€£¡])\1\1+)+|(?:[^\w@$!|+(€£¡]|([@$!|+(€£¡])\2\2+)+$")  # three equal signs are no letters
_BARE = re.compile(r"^[\W_]+|[\W_]+$")


def bare(word: str) -> str:
    """Lower case, accents taken off ASCII-based letters only for the lattice's alphabet."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def letter_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Counts of neighbouring letters (boundary included) in a chunk; other bytes count as boundary."""
    code = np.zeros(len(data) + 2, np.int64)
    low = kernel.fold(data)
    is_letter = (low >= 97) & (low <= 122)
    code[1:-1] = np.where(is_letter, low.astype(np.int64) - 96, 0)
    return np.bincount(code[:-1] * LETTERS + code[1:], minlength=LETTERS * LETTERS)


def letter_model(df: DataFrame, text: str = "text") -> np.ndarray:
    """[27, 27] negative log probabilities of the next letter, from all texts: each task sends one row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for b in batches:
            data, offs = kernel.flat(b.column(0))
            for i, j in kernel.chunks(offs):
                total += letter_counts(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LETTERS * LETTERS)), pa.array(total)], ["pair", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.ones((LETTERS, LETTERS))
    for r in rows:
        counts[divmod(r["pair"], LETTERS)] += r["n"]
    counts[0, 0] = 1
    return -np.log(0.9 * counts / counts.sum(1, keepdims=True) + 0.1 / LETTERS)  # no pair is out of the question


def restore(tokens: list[str], cost: np.ndarray) -> list[str]:
    """The least costly reading of each token.

    All tokens step through their lattices together. State: the letter read last (0: none yet).
    Readings of a character: its letter, its look-alikes, nothing (a separator or a repetition).
    """
    out = [""] * len(tokens)
    by_len: dict[int, list[int]] = {}
    plain = [bare(t) for t in tokens]
    for i, t in enumerate(plain):
        by_len.setdefault(1 << max(2, (len(t) - 1).bit_length()), []).append(i)
    for width, members in by_len.items():
        step = max(1, 4096 * 64 // max(64, width))  # the way back is kept for so many
        for lo in range(0, len(members), step):
            rows = members[lo : lo + step]
            _viterbi([plain[i] for i in rows], rows, width, cost, out)
    return out


def pieces(reading: str, cost: np.ndarray) -> list[str]:
    """The words that a reading of several words may hold: its pieces between likely boundaries, and neighbouring ones joined."""
    code = np.array([ord(c) - 96 for c in reading], np.int64)
    apart = cost[code[:-1], 0] + cost[0, code[1:]] < cost[code[:-1], code[1:]] + LOOSE
    ends = [0, *(np.flatnonzero(apart) + 1).tolist(), len(reading)]
    out = {reading: None}
    for i, lo in enumerate(ends[:-1]):
        for n, hi in enumerate(ends[i + 1 :]):
            if n and hi - lo > WORD:
                break
            out[reading[lo:hi]] = None
    return list(out)


def _readings(c: str) -> list[int]:
    return [ord(x) - 96 for x in ([c] if "a" <= c <= "z" else []) + list(LEET.get(c, ""))]


def _viterbi(texts: list[str], rows: list[int], width: int, cost: np.ndarray, out: list[str]) -> None:
    n = len(texts)
    best = np.full((n, LETTERS), np.inf)
    best[:, 0] = 0
    backs: list[np.ndarray] = []
    steps: list[np.ndarray] = []
    seen: dict[str, tuple[np.ndarray, float]] = {}
    alone = np.arange(n)
    for p in range(min(width, max(map(len, texts)))):
        emit, skip = np.full((n, LETTERS), np.inf), np.full(n, np.inf)
        collapse = np.full(n, TWICE)
        for i, t in enumerate(texts):
            if p >= len(t):
                skip[i] = 0.0
                continue
            c = t[p]
            if c not in seen:
                e = np.full(LETTERS, np.inf)
                letters = _readings(c)
                for k in letters:
                    e[k] = 0.0 if "a" <= c <= "z" else READ
                s = np.inf if c.isalpha() and c.isascii() else (DROP if letters else SEPARATOR)
                seen[c] = e, s
            emit[i], skip[i] = seen[c]
            if p and t[p - 1] == c and (t[p - 2 : p - 1] == c or t[p + 1 : p + 2] == c):
                collapse[i] = REPEAT
        # a letter that only repeats the state's letter may be dropped for little
        reads = np.isfinite(emit)
        same = np.where(reads, collapse[:, None] + np.where(reads, emit, 0), np.inf)
        same[:, 0] = np.inf
        # from any state to a new letter
        move = best[:, :, None] + cost[None, :, :]
        prev = move.argmin(1)
        arrive = np.take_along_axis(move, prev[:, None, :], 1)[:, 0, :] + emit
        stay = best + np.minimum(skip[:, None], same)
        take = arrive < stay
        best = np.where(take, arrive, stay)
        backs.append(np.where(take, prev, -1).astype(np.int8))
    steps.append(best + cost[:, 0][None, :])
    state = steps[0].argmin(1)
    read: list[list[int]] = [[] for _ in range(n)]
    for back in reversed(backs):
        b = back[alone, state]
        for i in np.flatnonzero(b >= 0):
            read[i].append(int(state[i]))
        state = np.where(b >= 0, b, state)
    for i, r in zip(rows, read, strict=True):
        out[i] = "".join(chr(96 + k) for k in reversed(r))


@dataclass
class Reader:
    """Restored words of texts, with a bounded memory of tokens. meaning: what a word is worth; '' tokens are worth None."""

    cost: np.ndarray
    memo: dict[str, str | None] = field(default_factory=dict)
    several: set[str] = field(default_factory=set)  # tokens whose reading is longer than a word

    def learn(self, tokens: set[str]) -> None:
        if len(self.memo) + len(tokens) > MEMO:
            self.memo.clear()
            self.several.clear()
        odd: list[str] = []
        for t in tokens:
            core = _EDGES.sub("", t)
            simple = _BARE.sub("", core)
            if len(simple) <= 1:
                self.memo[t] = None if simple else ""  # None: one of a possible run of single characters
            elif _PLAIN.fullmatch(simple) and (simple == core or not core.strip("!|+(")[len(simple) :]):
                self.memo[t] = simple.lower()
            else:
                odd.append(t)
        for t, w in zip(odd, restore([_EDGES.sub("", t).rstrip("!|") for t in odd], self.cost), strict=True):
            simple = _BARE.sub("", t)
            own = _PLAIN.fullmatch(simple) and not any(c.isascii() for c in simple if c.isalpha())
            self.memo[t] = simple.lower() if own else w
            if not own and len(w) > WORD:
                self.several.add(t)

    def words(self, texts: list[str]) -> list[list[str]]:
        cut = [t.split() for t in texts]
        memo = self.memo
        new = set().union(*cut).difference(memo)
        if new:
            if len(memo) + len(new) > MEMO:
                new = set().union(*cut)
            self.learn(new)
        out = []
        for text, tokens in zip(texts, cut, strict=True):
            got = [memo[t] for t in tokens]
            if None in got:
                got = self._spaced(text, tokens, got)
            if self.several:
                for t in sorted(self.several.intersection(tokens)):
                    got = [*got, *pieces(memo[t] or "", self.cost)]
            out.append(got)
        return out

    def _spaced(self, text: str, tokens: list[str], got: list[str | None]) -> list[str]:
        """Runs of three single characters or more are words, cut at wider gaps; shorter runs are words of one letter."""
        gaps: list[int] = []  # before each token
        at = 0
        for t in tokens:
            start = text.index(t, at)
            gaps.append(start - at)
            at = start + len(t)
        done: list[str] = []
        i = 0
        while i < len(got):
            if got[i] is not None:
                done.append(got[i])  # type: ignore[arg-type]
                i += 1
                continue
            j = i
            while j < len(got) and got[j] is None:
                j += 1
            if j - i >= 3:
                least = min(gaps[i + 1 : j])
                cuts = [i, *(k for k in range(i + 1, j) if gaps[k] > least), j]
                for w in restore(["".join(_EDGES.sub("", t) for t in tokens[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], self.cost):
                    done += pieces(w, self.cost) if len(w) > 3 else [w]
            else:
                done += [bare(t) for t in tokens[i:j]]
            i = j
        return done


def features(words: list[str]) -> set[str]:
    """The words, their prefixes ("p-") and prefixes that several different words share ("p-2", "p-4")."""
    kinds = set(words)
    seen = Counter(w[:k] for w in kinds for k in PREFIXES if len(w) > k)
    out = kinds | {f"{p}-" for p in seen} | {f"{p}-{n}" for p, c in seen.items() for n in SEVERAL if c >= n}
    out.discard("")
    return out


@dataclass
class Model:
    cost: np.ndarray
    weight: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.prefixes = {f.rpartition("-")[0] for f in self.weight if "-" in f}

    def value(self, words: list[str], memo: dict[str, tuple[str, ...]]) -> float:
        hit: list[str] = []
        seen: Counter[str] = Counter()
        for w in set(words):
            f = memo.get(w)
            if f is None:
                f = memo[w] = tuple(p for p in (w[:k] for k in PREFIXES if len(w) > k) if p in self.prefixes)
            if f:
                seen.update(f)
            if w in self.weight:
                hit.append(w)
        for p, c in seen.items():
            hit += [x for x in (f"{p}-", *[f"{p}-{n}" for n in SEVERAL if c >= n]) if x in self.weight]
        return self.bias + sum(self.weight[x] for x in sorted(hit))


def fit(labelled: DataFrame, corpus: DataFrame, text: str = "text") -> Model:
    """labelled: doc_id, text and a 0/1 column `toxic`, training rows only. corpus: all texts, for the character model."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    cost = letter_model(corpus, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(cost)
        for b in batches:
            found = [sorted(features(w)) for w in reader.words([t or "" for t in b.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.string())), b.column(2)], ["doc_id", "features", "toxic"])

    rows = labelled.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string"), F.col("toxic").cast("int"))
    rows = stored(rows.where("toxic in (0, 1)").mapInArrow(run, "doc_id long, features array<string>, toxic int"), "toxic-features")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if sum(totals.values()) > SAMPLE:
        raise ValueError(f"the model is fitted on at most {SAMPLE} labelled rows; training_rows chooses them")
    if len(totals) < 2:
        return Model(cost, {}, -30.0 if 1 not in totals else 30.0)
    share = totals[1] / totals[0]
    per = rows.select(F.explode("features").alias("f"), "toxic").groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    z = (F.col("t") - F.col("c") * share) / F.sqrt(F.col("t") + F.col("c") * share * share + 4)
    chosen = [r["f"] for r in per.where(F.col("t") >= MIN_TOXIC).where(z > 2.5).orderBy(F.desc(z), "f").limit(FEATURES).collect()]  # bounded by FEATURES
    place = {f: i for i, f in enumerate(chosen)}
    some = rows.withColumn("features", F.array_intersect("features", F.array(*[F.lit(f) for f in chosen]) if chosen else F.array().cast("array<string>")))
    seen = some.groupBy("features", "toxic").agg(F.count("*").alias("n")).collect()  # at most a row for each labelled row
    hits = [[*(place[f] for f in r["features"]), len(chosen)] for r in seen]  # the last is the bias
    beta = _regress(hits, np.array([r["toxic"] for r in seen], float), np.array([r["n"] for r in seen], float), len(chosen) + 1)
    return Model(cost, dict(zip(chosen, beta[:-1].tolist(), strict=True)), float(beta[-1]))


def _regress(hits: list[list[int]], y: np.ndarray, w: np.ndarray, width: int, ridge: float = 0.2, rounds: int = 800) -> np.ndarray:
    """Ridge logistic regression with non-negative feature weights, by projected accelerated gradient steps.

    hits: the features of each row, its bias (the last feature) included; y: 0 or 1; w: how often the row stands.
    """
    lens = np.array([len(h) for h in hits])
    flat = np.fromiter((i for h in hits for i in h), np.int64, int(lens.sum()))
    start = np.cumsum(lens) - lens
    beta, look, t = np.zeros(width), np.zeros(width), 1.0
    total = w.sum()
    penal = np.r_[np.full(width - 1, ridge / total), 0.0]
    step = 1.0 / (0.25 * np.bincount(flat, np.repeat(w, lens), width).max() / total * max(1, np.sqrt(width)) + ridge / total)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(look[flat], start), -30, 30)))
        new = look - step * (np.bincount(flat, np.repeat(w * (p - y), lens), width) / total + penal * look)
        new[:-1] = np.maximum(new[:-1], 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, beta, t = new + (t - 1) / t2 * (new - beta), new, t2
    return beta


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the column `out` (0 to 1); every other column stays."""
    bounded_batches(df.sparkSession)
    names = [c for c in df.columns if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    place = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, memo = Reader(model.cost), {}
        for b in batches:
            if len(memo) > MEMO:
                memo.clear()
            texts = [t or "" for t in b.column(place).to_pylist()]
            found = []
            for lo in range(0, len(texts), 200):
                found += [1 / (1 + np.exp(-max(-30.0, min(30.0, model.value(w, memo))))) for w in reader.words(texts[lo : lo + 200])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], [*names, out])

    return rows.mapInArrow(run, rows.select("*", F.lit(0.0).alias(out)).schema)


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, toxic) of at most `sample` labelled documents outside the held-out fold, the first by the id's hash.

    The sample's ids are few by its bound, so they go to the texts and no text moves.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where((crc_remainder(F.col("doc_id"), FOLDS) != 0) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).collect()
    few = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those scored at threshold or above."""
    model = fit(training_rows(docs, labels), docs)
    own = unused(docs, "toxicity")[0]
    return score(docs, model, out=own).where(F.col(own) < threshold).drop(own)
