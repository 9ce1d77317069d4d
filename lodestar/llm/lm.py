"""LM scoring: a causal self-attention model over subword ids, trained in numpy.

Tokens are the lower-cased words of a text and one end. A word is the chain of subword ids of the public
byte-level vocabulary, closed by a stop. The attention model (one layer, relative positions) predicts a word's first
id, or the end, from the first ids of the words before it in overlapping context windows, of which each scores
its last half once; the same kind of layer predicts the rest of the chain from the chain so far, once
for each distinct word. Ids fall into ROWS rows by a fixed hash and rows into CLASSES classes. The layer gives the class,
on top of the training tokens' counts of a class after a row; the row given its class and the row before, and the id
given its row, are shares of those counts. After its first id a word is as frequent as in the training
tokens, backed off to the chain:
P(word) = P(first | context) * (c + g * P(rest | first)) / (c_first + g). An id of a chain longer than CHAIN is predicted in
overlapping windows of the chain, as first ids are in those of the text: whether the chain stops there has the stop's plain share, and
if it doesn't, attention gives the id. So a text without white space, which is one word, is read whole. Kinds of words grow as a power of the
tokens (Heaps), so g is FEW and a share of c_first ** HEAPS that sums to BACK_OFF * V over the first ids.

Training: word counts and id counts cover every training text. The layers are trained on every word of
every training text, in the windows that score it: each task deals the windows of some texts at random into steps of STEP, and
the tasks' weights are averaged, ROUNDS times (more rounds fit better and cost as much again). The rows are summed in Spark; the driver gets one set of weights.

Counts travel by block (SPLIT bytes of an input file's split, by a hash of the id): a task sends one row per distinct word and block, and gets back one
row for each of its words that other blocks have too.

Defined cases: null text is empty (its only token is the end); without training texts the counts
are 0 and the model is its uniform start; repeated rows are scored alike and count each time;
extra columns are ignored. A DataFrame that isn't a plain scan of files is stored first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lodestar.llm import kernel
from lodestar.llm.common import bounded_batches, partitions, stored
from lodestar.llm.packing import _fast

FOLDS, HELD = 7, 2
DIM, ROWS, CLASSES, OWN, HALF = 16, 512, 96, 64, 16
CHAIN = 8  # ids of a word that one window sees; those after them are seen by further windows
REMEMBERED = 200_000  # words whose ids a worker remembers
SPLIT = 8 << 20  # bytes of an input file's split that make a block of their own
ROUNDS, RATE, STEP, WORDS_STEP = 1, 0.02, 512, 2048
BACK_OFF, HEAPS, FEW = 0.7, 0.8, 2.0
STOP, END, START = 0, 1, 2  # ids beside the vocabulary's, which is moved up by SPECIAL
SPECIAL = 3
END_KEY = -7046029254386353131  # the end's key among word hashes; fixed


def _shapes() -> list[tuple[int, ...]]:
    return [(ROWS, DIM), (DIM, DIM), (DIM, DIM), (DIM, DIM), (2 * HALF,), (DIM, CLASSES), (CLASSES,)]


class Layer:
    """One causal attention layer over id rows, with classes as output. Parameters are one flat array."""

    def __init__(self, flat: np.ndarray | None = None, seed: int = 0):
        sizes = [int(np.prod(s)) for s in _shapes()]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([rng.normal(0, 0.3 if k < 4 else 0.01, n) if k not in (4, 6) else np.zeros(n) for k, n in enumerate(sizes)])
        self.flat = flat.astype(np.float32).copy()
        cuts = np.cumsum(sizes)[:-1]
        self.e, self.wq, self.wk, self.wv, self.bias, self.u, self.b = (p.reshape(s) for p, s in zip(np.split(self.flat, cuts), _shapes(), strict=True))

    @staticmethod
    def mask(width: int, asked: int) -> tuple[np.ndarray, np.ndarray]:
        """Distance of each asked (last) place to each place, and whether it is seen."""
        i, j = np.arange(width - asked, width)[:, None], np.arange(width)[None, :]
        return np.where(j <= i, i - j, 0), j <= i

    @staticmethod
    def size() -> int:
        return sum(int(np.prod(s)) for s in _shapes())

    def prepare(self, prior: np.ndarray) -> None:
        """prior: [ROWS, CLASSES] log probabilities of a class after a row, which the layer starts from."""
        self.prior = prior
        self.q, self.k, self.v = self.e @ self.wq / np.float32(np.sqrt(DIM)), self.e @ self.wk, self.e @ self.wv

    def forward(self, x: np.ndarray, pad: np.ndarray | None, asked: int, stable: bool = True) -> tuple:
        """x: [n, up to 2 HALF] rows; the last `asked` are asked for. pad: bool of the same shape, or None.

        stable: the greatest score is taken off before exponents are; without it large scores overflow.
        """
        ask = x[:, x.shape[1] - asked :]
        q, k, v = self.q[ask], self.k[x], self.v[x]
        s = q @ k.transpose(0, 2, 1)
        distance, seen = self.mask(x.shape[1], asked)
        s += np.where(seen, self.bias[distance], np.float32(-1e9))
        if pad is not None and pad.any():
            s += np.where(pad, np.float32(-1e9), np.float32(0))[:, None, :]
        if stable:
            s -= s.max(2, keepdims=True)
        np.exp(s, out=s)
        if stable:
            s /= s.sum(2, keepdims=True)
            h = s @ v
        else:
            h = s @ v
            h /= s.sum(2, keepdims=True)
        h += self.e[ask]
        logit = h.reshape(-1, DIM) @ self.u
        logit += self.b
        logit += self.prior[ask.ravel()]
        return q, k, v, s, h, logit

    def class_log(self, x: np.ndarray, pad: np.ndarray | None, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each asked target class; of target's shape."""
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            logit = self.forward(x, pad, target.shape[1], stable=False)[-1]
            own = logit[np.arange(len(logit)), target.ravel()]
            np.exp(logit, out=logit)
            out = own - np.log(logit.sum(1))
        if not np.isfinite(out).all():
            logit = self.forward(x, pad, target.shape[1])[-1]
            top = logit.max(1)
            own = logit[np.arange(len(logit)), target.ravel()]
            out = own - top - np.log(np.exp(logit - top[:, None]).sum(1))
        return out.reshape(target.shape)

    def gradient(self, x: np.ndarray, pad: np.ndarray | None, target: np.ndarray, live: np.ndarray, prior: np.ndarray) -> np.ndarray:
        """Of the mean cross entropy over asked places, weighted by live."""
        self.prepare(prior)
        asked = target.shape[1]
        q, k, v, s, h, p = self.forward(x, pad, asked)
        ask = x[:, x.shape[1] - asked :]
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        weight = live.reshape(-1) / np.float32(max(1, live.sum()))
        p *= (weight / p.sum(1))[:, None]
        p[np.arange(len(p)), target.ravel()] -= weight
        du, db = h.reshape(-1, DIM).T @ p, p.sum(0)
        dh = (p @ self.u.T).reshape(h.shape)
        dv = s.transpose(0, 2, 1) @ dh
        ds = dh @ v.transpose(0, 2, 1)
        ds -= (ds * s).sum(2, keepdims=True)
        ds *= s
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        distance, seen = self.mask(x.shape[1], asked)
        dbias = np.bincount(distance.ravel(), (ds.sum(0) * seen).ravel(), 2 * HALF)
        both = []
        for at, d in ((ask, np.concatenate([dq, dh], 2)), (x, np.concatenate([dk, dv], 2))):
            at = at.ravel().astype(np.int16)  # ROWS fits, and short numbers are sorted by radix
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
            g = np.zeros((ROWS, 2 * DIM), np.float32)
            g[at[order][first]] = np.add.reduceat(d.reshape(-1, 2 * DIM)[order], first, axis=0)
            both += [g[:, :DIM], g[:, DIM:]]
        gq, ge, gk, gv = both
        gq = gq / np.float32(np.sqrt(DIM))
        ge = ge + gq @ self.wq.T + gk @ self.wk.T + gv @ self.wv.T
        return np.concatenate([a.ravel() for a in (ge, self.e.T @ gq, self.e.T @ gk, self.e.T @ gv, dbias, du, db)]).astype(np.float32)


class Adam:
    def __init__(self, layer: Layer):
        self.layer, self.m, self.v, self.t = layer, np.zeros_like(layer.flat), np.zeros_like(layer.flat), 0

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.01 * (g * g - self.v)
        self.layer.flat -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def row_of(ids: np.ndarray) -> np.ndarray:
    """The fixed row of an id."""
    return (kernel.mix(ids.astype(np.uint64) + np.uint64(77)) % np.uint64(ROWS)).astype(np.int64)


@dataclass
class Vocabulary:
    """Natural logs of the shares that make an id of a class, from counts of the training tokens."""

    row: np.ndarray  # of each id
    cls: np.ndarray  # of each id
    share: np.ndarray  # of each id in its row
    after: np.ndarray  # [row before, row]: of a row in its class
    prior: np.ndarray  # [row before, class]

    @staticmethod
    def of(counts: np.ndarray, pairs: np.ndarray) -> Vocabulary:
        row = row_of(np.arange(len(counts)))
        smooth = counts + 0.05
        rows = np.bincount(row, smooth, ROWS) + 1e-3  # a row may have no id
        rank = np.empty(ROWS, np.int64)
        rank[np.argsort(-rows, kind="stable")] = np.arange(ROWS)
        of_row = np.where(rank < OWN, rank, OWN + rank % (CLASSES - OWN))
        joint = pairs + 8 * rows / rows.sum()
        by_class = np.zeros((ROWS, CLASSES))
        np.add.at(by_class.T, of_row, joint.T)
        return Vocabulary(
            row,
            of_row[row],
            np.log(smooth / np.bincount(row, smooth, ROWS)[row]).astype(np.float32),
            np.log(joint / by_class[:, of_row]).astype(np.float32),
            np.log(by_class / joint.sum(1, keepdims=True)).astype(np.float32),
        )

    def log(self, layer: Layer, x: np.ndarray, pad: np.ndarray | None, target: np.ndarray) -> np.ndarray:
        """Natural log probability of the target ids at the asked places; x: input ids."""
        rows = self.row[x]
        return layer.class_log(rows, pad, self.cls[target]) + self.after[rows[:, rows.shape[1] - target.shape[1] :], self.row[target]] + self.share[target]

    def going_on(self, layer: Layer, x: np.ndarray, pad: np.ndarray | None, target: np.ndarray) -> np.ndarray:
        """As `log`, given that the target isn't STOP: shares of all ids but that one."""
        rows, own = self.row[x], self.row[target].ravel()
        logit = layer.forward(rows, pad, target.shape[1])[-1]
        logit = logit - logit.max(1, keepdims=True)
        logit -= np.log(np.exp(logit).sum(1, keepdims=True))
        some, first = np.unique(self.row, return_index=True)  # rows that have an id
        each = logit[:, self.cls[first]] + self.after[rows[:, rows.shape[1] - target.shape[1] :].ravel()][:, some]
        share = np.ones(len(some))
        share[np.searchsorted(some, self.row[STOP])] = -np.expm1(min(float(self.share[STOP]), -1e-6))
        out = each[np.arange(len(own)), np.searchsorted(some, own)] - np.log(np.exp(each.astype(np.float64)) @ share)
        return out.reshape(target.shape) + self.share[target]


def ids_of(words: list[bytes], tokenizer: str) -> list[list[int]]:
    """Subword ids of each word, moved up by SPECIAL."""
    fast = _fast(tokenizer)
    if fast is None:
        raise ValueError("the model's subwords need a byte-level vocabulary")
    enc = fast[0]
    piece = enc._core_bpe.encode_single_piece  # a word of ASCII letters is one piece of the pattern
    return [[i + SPECIAL for i in (piece(w) if w.isalpha() else enc.encode_ordinary(w.decode("utf-8", "replace")))] for w in words]


def _vocabulary_size(tokenizer: str) -> int:
    return _fast(tokenizer)[0].max_token_value + 1 + SPECIAL


class Block:
    """The words of some texts: distinct hashes, and each token's place among them."""

    def __init__(self, column: pa.Array):
        data, self.offs = kernel.flat(column)
        n = len(self.offs) - 1
        hashes, firsts, spans = [], [np.zeros(1, np.int64)], []
        small = np.int32 if len(data) < 1 << 31 else np.int64
        total = 0
        for x, y in kernel.chunks(self.offs):
            part = kernel.fold(data[self.offs[x] : self.offs[y]])
            starts, ends, first = kernel.words(part, self.offs[x : y + 1] - self.offs[x])
            hashes.append(kernel.span_hash(kernel.running_hash(part), starts, ends).view(np.int64))
            firsts.append(first[1:] + total)
            spans.append(((starts + self.offs[x]).astype(small), (ends + self.offs[x]).astype(small)))
            total += len(starts)
        self.first = np.concatenate(firsts) if n else np.zeros(1, np.int64)
        self.data = data
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        del hashes
        self.key, sample, token = np.unique(every, return_index=True, return_inverse=True)
        self.token = token.astype(small)
        del every, token
        # where one of each distinct word stands
        self.starts, self.ends = (np.concatenate([p[k] for p in spans])[sample] if spans else np.zeros(0, small) for k in range(2))

    def words(self) -> list[bytes]:
        low = kernel.fold(self.data)
        return [low[s:e].tobytes() for s, e in zip(self.starts, self.ends, strict=True)]

    def ids(self, tokenizer: str, memo: dict[int, list[int]]) -> list[list[int]]:
        """Subword ids of the distinct words; memo: those of words met before, by hash, REMEMBERED at most."""
        keys = self.key.tolist()
        fresh = np.flatnonzero([k not in memo for k in keys])
        if len(memo) + len(fresh) > REMEMBERED:
            memo.clear()
            fresh = np.arange(len(keys))
        low = kernel.fold(self.data)
        new = [low[s:e].tobytes() for s, e in zip(self.starts[fresh].tolist(), self.ends[fresh].tolist(), strict=True)]
        memo.update(zip(self.key[fresh].tolist(), ids_of(new, tokenizer), strict=True))
        return [memo[k] for k in keys]

    def counts(self, train: np.ndarray) -> np.ndarray:
        """Of each distinct word in the texts marked."""
        return np.bincount(self.token, np.repeat(train, np.diff(self.first)), len(self.key)).astype(np.int64)


def _chains(ids: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chains of equal length together: (their places, input ids, target ids). Of a chain longer than CHAIN the first window, which has no stop; `_further` has the others."""
    lens = np.array([min(len(i), CHAIN + 1) for i in ids], np.int64)
    order = np.argsort(lens, kind="stable")
    for n in np.unique(lens).tolist():
        at = order[np.searchsorted(lens[order], n) : np.searchsorted(lens[order], n, "right")]
        x = np.array([ids[k][:n] for k in at], np.int64)
        yield (at, x, np.concatenate([x[:, 1:], np.full((len(x), 1), STOP)], 1)) if n <= CHAIN else (at, x[:, :CHAIN], x[:, 1:])


def _windows(seq: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts' sequences as overlapping windows. seq: ids to predict, text after text; first: where each begins.

    Returns the input ids [n, 2 HALF] (before each asked place stands what precedes it), padding, target ids [n, HALF]
    and the place of each target in seq (-1: none).
    """
    counts = np.diff(first)
    per = -(-counts // HALF)
    total = int(per.sum())
    text = np.repeat(np.arange(len(counts)), per)
    k = np.arange(total) - np.repeat(np.cumsum(per) - per, per)
    at = k[:, None] * HALF + np.arange(-HALF, HALF)[None, :]  # place in the text of what is predicted after this input
    pad = (at < 0) | (at >= counts[text][:, None])
    place = np.where(pad, 0, first[text][:, None] + at)
    before = np.r_[START, seq[:-1]] if len(seq) else seq
    x = np.where(at == 0, START, before[place] if len(seq) else 0)
    pad_in = at < 0
    target = np.where(pad, 0, seq[place] if len(seq) else 0)[:, HALF:]
    return x, pad_in, target, np.where(pad, -1, place)[:, HALF:]


def _further(ids: list[list[int]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The ids of chains after the first CHAIN + 1 in overlapping windows, `most` at a time: (the window's chain, input ids [n, 2 HALF], padding, target
    ids [n, HALF], which are real)."""
    at, begin = [], []
    for k, chain in enumerate(ids):
        if len(chain) > CHAIN + 1:
            some = np.arange(CHAIN + 1, len(chain), HALF)
            at.append(np.full(len(some), k))
            begin.append(some)
    if not at:
        return
    at, begin = np.concatenate(at), np.concatenate(begin)
    for lo in range(0, len(at), most):
        own, first = at[lo : lo + most], begin[lo : lo + most]
        chains, which = np.unique(own, return_inverse=True)
        size = np.array([len(ids[k]) for k in chains], np.int64)
        flat = np.concatenate([np.asarray(ids[k], np.int64) for k in chains])
        base = (np.cumsum(size) - size)[which][:, None]
        place = first[:, None] + np.arange(-HALF - 1, HALF - 1)[None, :]  # of the inputs: the ids before the targets
        target = first[:, None] + np.arange(HALF)[None, :]
        live = target < size[which][:, None]
        yield own, flat[base + np.clip(place, 0, size[which][:, None] - 1)], place < 0, np.where(live, flat[base + np.where(live, target, 0)], 0), live


@dataclass
class Model:
    tokenizer: str
    first: Vocabulary
    rest: Vocabulary
    across: np.ndarray
    within: np.ndarray
    tokens: int
    kinds: int
    heads: np.ndarray  # counts of first ids
    plain: np.ndarray  # natural log of a further id's plain share; of STOP's past the first window
    spare: np.ndarray  # g of each first id

    def rest_log(self, ids: list[list[int]], layer: Layer) -> np.ndarray:
        """Natural log probability of each chain after its first id."""
        out = np.zeros(len(ids))
        for at, x, target in _chains(ids):
            for lo in range(0, len(at), 4096):
                s = slice(lo, lo + 4096)
                out[at[s]] = self.rest.log(layer, x[s], None, target[s]).sum(1)
        on = np.log1p(-np.exp(self.plain[STOP]))  # past the first window a chain stops by the plain share
        for own, x, pad, target, live in _further(ids, 512):
            np.add.at(out, own, np.where(live, self.rest.going_on(layer, x, pad, target) + on, 0.0).sum(1))
        out[[k for k, chain in enumerate(ids) if len(chain) > CHAIN]] += self.plain[STOP]
        return out


def _prepared(df: DataFrame, text: str) -> DataFrame:
    if not _scan_only(df):
        df = stored(df, "lm-input")
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    share = F.pmod(F.xxhash64(id_, F.length(body)), F.greatest(F.lit(1), F.ceil(F.input_file_block_length() / F.lit(SPLIT))))
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        body.alias("text"),
        (F.crc32(id_.cast("binary")) % FOLDS == HELD).alias("held"),
        F.xxhash64(F.input_file_name(), F.input_file_block_start(), share).alias("block"),
    )


def _scan_only(df: DataFrame) -> bool:
    """Whether df is read from one source with nothing but projections and filters, so that a row knows its split and always meets the same ones."""
    plan = df._jdf.queryExecution().optimizedPlan()
    lines = [x.strip(" +-:") for x in plan.toString().splitlines()]
    return all(x.startswith(("Project", "Filter", "Relation", "LogicalRelation")) for x in lines if x) and sum(x.startswith(("Relation", "LogicalRelation")) for x in lines) == 1


def _count_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(kind, key, block, c): kind 0 words of a block with their count in training texts, 1 first ids, 2 further ids,
    3 pairs of rows of neighbouring first ids, 4 pairs of rows within words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = _vocabulary_size(tokenizer)
        heads, tails = np.zeros(size, np.int64), np.zeros(size, np.int64)
        across, within = np.zeros(ROWS * ROWS, np.int64), np.zeros(ROWS * ROWS, np.int64)
        start, end, stop = row_of(np.array([START, END, STOP]))
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        chains: dict[int, list[int]] = {}

        def rows(kind: int, key: np.ndarray, block: int, c: np.ndarray) -> pa.RecordBatch:
            n = len(key)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), pa.array(np.full(n, block, np.int64)), pa.array(c)], ["kind", "key", "block", "c"])

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            key, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return key, np.bincount(inv, np.concatenate([p[1] for p in parts]), len(key)).astype(np.int64)

        for b in batches:
            owner, out = b.column(3).to_numpy(), ~b.column(2).to_numpy(zero_copy_only=False)
            for own in np.unique(owner):
                rows_ = np.flatnonzero(owner == own)
                part = Block(b.column(1).take(pa.array(rows_)))
                c = part.counts(out[rows_])
                have = part.ids(tokenizer, chains)
                lens = np.array([len(i) for i in have], np.int64)
                flat = np.fromiter((i for ids in have for i in ids), np.int64, int(lens.sum()))
                at = np.cumsum(lens) - lens
                is_first = np.zeros(len(flat), bool)
                is_first[at] = True
                each = np.repeat(c, lens)
                heads += np.bincount(flat[is_first], each[is_first], size).astype(np.int64)
                tails += np.bincount(flat[~is_first], each[~is_first], size).astype(np.int64)
                tails[STOP] += c.sum()
                rows_of = row_of(flat)
                follows = np.flatnonzero(~is_first)
                within += np.bincount(rows_of[follows - 1] * ROWS + rows_of[follows], each[follows], ROWS * ROWS).astype(np.int64)
                last = at + lens - 1
                within += np.bincount(rows_of[last] * ROWS + stop, c, ROWS * ROWS).astype(np.int64)
                mine = np.flatnonzero(out[rows_])
                n_words = np.diff(part.first)[mine]
                begin = np.r_[0, np.cumsum(n_words + 1)]
                seq = np.full(int(begin[-1]), end)
                inside = np.ones(len(seq), bool)
                inside[begin[1:] - 1] = False
                seq[inside] = rows_of[at][part.token[np.repeat(out[rows_], np.diff(part.first))]]
                before = np.r_[0, seq[:-1]] if len(seq) else seq
                before[begin[:-1]] = start
                across += np.bincount(before * ROWS + seq, minlength=ROWS * ROWS)
                heads[END] += int(out[rows_].sum())
                keys, counts = np.r_[part.key, END_KEY], np.r_[c, int(out[rows_].sum())]
                held.setdefault(int(own), []).append((keys, counts))
                if len(held[int(own)]) > 24:
                    held[int(own)] = [merged(held[int(own)])]
        for own, parts in held.items():
            key, c = merged(parts)
            for lo in range(0, len(key), 100_000):
                yield rows(0, key[lo : lo + 100_000], own, c[lo : lo + 100_000])
        for kind, counts in ((1, heads), (2, tails), (3, across), (4, within)):
            some = np.flatnonzero(counts)
            yield rows(kind, some, 0, counts[some])

    return docs.mapInArrow(run, "kind int, key long, block long, c long")


def _trained(docs: DataFrame, model: Model) -> Model:
    """One round: every task trains copies of both layers on its own training texts, and the copies are averaged."""
    tokenizer, size = model.tokenizer, Layer.size()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = Layer(model.across), Layer(model.within)
        optimisers = [Adam(x) for x in layers]
        weight = 0
        memo: dict[int, list[int]] = {}
        for b in batches:
            _, offs = kernel.flat(b.column(1))
            for lo, hi in kernel.chunks(offs):
                part = Block(b.column(1).slice(lo, hi - lo))
                ids = part.ids(tokenizer, memo)
                begin = np.r_[0, np.cumsum(np.diff(part.first) + 1)]
                token = np.full(int(begin[-1]), len(ids), np.int64)
                inside = np.ones(len(token), bool)
                inside[begin[1:] - 1] = False
                token[inside] = part.token
                x, pad, target, place = _windows(np.r_[np.array([i[0] for i in ids], np.int64), END][token], begin)
                order = np.random.default_rng(len(x)).permutation(len(x))
                for at in range(0, len(order), STEP):
                    own = order[at : at + STEP]
                    live = place[own] >= 0
                    optimisers[0].step(layers[0].gradient(model.first.row[x[own]], pad[own], model.first.cls[target[own]], live.astype(np.float32), model.first.prior))
                    weight += int(live.sum())
                times = np.bincount(part.token, minlength=len(ids)).astype(np.float32)  # a chain is the same wherever its word stands
                for some, chain, follows in _chains(ids):
                    mixed = np.random.default_rng(len(some)).permutation(len(some))
                    for at in range(0, len(some), WORDS_STEP):
                        own = mixed[at : at + WORDS_STEP]
                        lives = np.broadcast_to(times[some[own]][:, None], follows[own].shape)
                        optimisers[1].step(layers[1].gradient(model.rest.row[chain[own]], None, model.rest.cls[follows[own]], lives, model.rest.prior))
                for own, chain, pad_, follows, real in _further(ids, STEP):
                    optimisers[1].step(layers[1].gradient(model.rest.row[chain], pad_, model.rest.cls[follows], real * times[own][:, None], model.rest.prior))
        if weight:
            flat = np.concatenate([x.flat for x in layers]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * size)), pa.array(flat * weight), pa.array(np.full(2 * size, float(weight)))], ["i", "x", "w"])

    rows = docs.where("not held").select("doc_id", "text").mapInArrow(run, "i long, x double, w double").groupBy("i").agg((F.sum("x") / F.sum("w")).alias("x")).collect()  # one row per weight
    if rows:
        flat = np.zeros(2 * size)
        for r in rows:
            flat[r["i"]] = r["x"]
        model.across, model.within = flat[:size].astype(np.float32), flat[size:].astype(np.float32)
    return model


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(model: Model):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        across, within = Layer(model.across), Layer(model.within)
        across.prepare(model.first.prior)
        within.prepare(model.rest.prior)
        held = left.column("held").to_numpy(zero_copy_only=False)
        n = left.num_rows
        part = Block(left.column("text"))
        c = part.counts(~held)
        have, total = right.column("key").to_numpy(), right.column("total").to_numpy()
        order = np.argsort(have)
        have, total = have[order], total[order]
        if len(have):
            at = np.minimum(np.searchsorted(have, part.key), len(have) - 1)
            c = np.where(have[at] == part.key, total[at], c)
        ends = int(total[have == END_KEY][0]) if (have == END_KEY).any() else int((~held).sum())
        ids = ids_of(part.words(), model.tokenizer)
        first = np.array([i[0] for i in ids], np.int64) if ids else np.zeros(0, np.int64)
        rest = model.rest_log(ids, within)
        del ids
        counts = np.diff(part.first)
        base = np.log10((np.r_[c, ends] + 1.0) / (model.tokens + model.kinds + 1.0))
        sums, known, score = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
        heads = model.heads[first]
        spare = model.spare[first]
        given = np.log((np.where(heads > 0, c, 0) + spare * np.exp(rest)) / (heads + spare))
        given = np.r_[given, 0.0]  # the end is known by its first id
        ahead = np.r_[part.first[:-1], part.first[-1:]]
        # some texts at a time
        row = 0
        while row < n:
            stop = max(row + 1, int(np.searchsorted(ahead, ahead[row] + 60_000, "right")) - 1)
            stop = min(stop, n)
            lens = counts[row:stop]
            begin = np.r_[0, np.cumsum(lens + 1)]
            token = np.full(int(begin[-1]), len(c), np.int64)
            inside = np.ones(len(token), bool)
            inside[begin[1:] - 1] = False
            token[inside] = part.token[part.first[row] : part.first[stop]]
            seq = np.r_[first, END][token]
            logs = np.zeros(len(seq))
            x, pad, target, place = _windows(seq, begin)
            for lo in range(0, len(x), 512):
                s = slice(lo, lo + 512)
                got = model.first.log(across, x[s], pad[s], target[s])
                live = place[s] >= 0
                logs[place[s][live]] = got[live]
            score[row:stop] = np.add.reduceat((logs + given[token]) / np.log(10), begin[:-1])
            sums[row:stop] = np.add.reduceat(base[token], begin[:-1])
            known[row:stop] = np.add.reduceat((np.r_[c, ends][token] > 0).astype(np.int64), begin[:-1])
            row = stop
        cols = [left.column("doc_id"), pa.array(held), pa.array(counts + 1), pa.array(known), pa.array(np.full(n, model.tokens)), pa.array(sums), pa.array(score)]
        return pa.table(cols, names=names)

    return run


def fit(df: DataFrame, tokenizer: str, text: str = "text") -> tuple[DataFrame, DataFrame, Model]:
    """The prepared texts, the counts of words that several blocks have, and the model."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = _prepared(df, text)
    rows = stored(_count_rows(docs, tokenizer), "lm-counts")
    size = _vocabulary_size(tokenizer)
    counts = [np.zeros(size), np.zeros(size), np.zeros(ROWS * ROWS), np.zeros(ROWS * ROWS)]
    summed = rows.where("kind > 0").groupBy("kind", "key").agg(F.sum("c").alias("c")).toArrow()  # at most twice the vocabulary and twice ROWS * ROWS
    kind, key, c = (summed.column(k).to_numpy() for k in range(3))
    for k, own in enumerate(counts):
        own[key[kind == k + 1]] = c[kind == k + 1]
    # a block holds a word once, so a word's rows are as many as the blocks that have it
    per = Window.partitionBy("key")
    seen = Observation()
    words = rows.where("kind = 0").select("key", "block", "c").withColumn("total", F.sum("c").over(per)).withColumn("blocks", F.count("*").over(per)).withColumn("first", F.col("block") == F.min("block").over(per))
    words = words.observe(seen, F.sum("c").alias("tokens"), F.sum(F.when(F.col("first") & (F.col("total") > 0), 1).otherwise(0)).alias("kinds"))
    words = stored(words.where("blocks > 1").select("block", "key", "total"), "lm-words")
    totals = seen.get
    start = Layer(seed=5).flat, Layer(seed=6).flat
    first, rest = (Vocabulary.of(counts[k], counts[k + 2].reshape(ROWS, ROWS)) for k in range(2))
    plain = np.log((counts[1] + 0.05) / (counts[1] + 0.05).sum())
    kinds = int(totals["kinds"] or 0)
    power = counts[0] ** HEAPS
    spare = FEW + BACK_OFF * kinds * power / max(1.0, power.sum())
    model = Model(tokenizer, first, rest, *start, int(totals["tokens"] or 0), kinds, counts[0], plain, spare)
    for _ in range(ROUNDS):
        model = _trained(docs, model)
    return docs, words, model


def lm_scores(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """SCHEMA rows, one per row of df."""
    docs, words, model = fit(df, tokenizer, text)
    return docs.select("block", "doc_id", "text", "held").groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_scores(model), SCHEMA)
