"""SentencePiece (BPE with byte fallback) encoding and decoding by suffix-array matching.

A batch's new units (a run of word marks and what follows up to the next mark; no piece but runs of
marks crosses into one) are laid end to end. Their suffixes are sorted by as many characters as the
longest piece has, every piece is found by binary search as one range of the sorted suffixes, and
the occurrences are the edges of one graph over all units. Edges are sorted by where they end and
relaxed in that order. BPE asks for merges, not for the least cost: an edge relaxes its end if it
starts a unit, or if its piece and the piece that ends at its start keep apart when merged together;
exactly one edge does so at each end, and the chain back from a unit's end is its BPE encoding.
Units with three marks or more in a row, where equal scores are broken by position, go to the
library.

Characters that no piece holds become their UTF-8 bytes' pieces. Decoding concatenates the pieces'
bytes, marks as spaces, without the leading one.

Defined cases: null text is empty and has no ids; the mark itself (U+2581) in a text decodes as a
space, as in the library; further columns stay; repeated rows are encoded alike.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import bounded_batches
from lodestar.llm.tokens import library

MARK = "▁"
MEMO, WORK = 250_000, 400_000  # units remembered; characters matched at once
_UNIT = regex.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    def __init__(self, path: str):
        lib = self.lib = library(path)
        n = lib.get_piece_size()
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        usable = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.score = {self.piece[i]: (lib.get_score(i), i) for i in usable}
        self.longest = max(map(len, self.score))
        if any(MARK in p[1:] and p.strip(MARK) for p in self.score):
            raise ValueError("a piece crosses from one unit to the next")
        letters = sorted(set("".join(self.score)))
        self.code = {c: k + 2 for k, c in enumerate(letters)}  # 0 ends a unit, 1 is in no piece
        self.point = np.array([ord(c) for c in letters], np.uint32)
        real = [i for i in usable if self.merged(self.piece[i]) == [self.piece[i]]]
        self.width = -(-self.longest // 8) * 8
        self.codes = np.zeros((len(real), self.width), np.int64)
        for r, i in enumerate(real):
            self.codes[r, : len(self.piece[i])] = [self.code[c] for c in self.piece[i]]
        self.ids = np.array(real, np.int64)
        self.lens = np.array([len(self.piece[i]) for i in real], np.int64)
        self.len_of = np.ones(n, np.int64)
        self.len_of[self.ids] = self.lens
        self.pairs, self.apart = np.zeros(0, np.int64), np.zeros(0, bool)
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by the definition: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[a + b][0], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def keep_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * len(self.piece) + right
        at = np.searchsorted(self.pairs, key)
        miss = (at >= len(self.pairs)) | (self.pairs[np.minimum(at, len(self.pairs) - 1)] != key) if len(self.pairs) else np.ones(len(key), bool)
        if miss.any():
            new = np.unique(key[miss])
            a, b = np.divmod(new, len(self.piece))
            ok = np.array([self.merged(self.piece[x] + self.piece[y]) == [self.piece[x], self.piece[y]] for x, y in zip(a.tolist(), b.tolist(), strict=True)])
            if len(self.pairs) > 4_000_000:
                self.pairs, self.apart = new, ok
                at = np.searchsorted(new, key)
                back = (at >= len(new)) | (new[np.minimum(at, len(new) - 1)] != key)
                return self.keep_apart(left, right) if back.any() and not miss.all() else ok[at]
            both = np.concatenate([self.pairs, new])
            order = np.argsort(both, kind="stable")
            self.pairs, self.apart = both[order], np.concatenate([self.apart, ok])[order]
            at = np.searchsorted(self.pairs, key)
        return self.apart[at]

    def match(self, units: list[str]) -> list[bytes]:
        """Ids of units as bytes, by the suffix array of their concatenation."""
        lens = np.array([len(u) for u in units], np.int64)
        text = np.frombuffer("\0".join(units).encode("utf-32-le") + bytes(4), np.uint32)
        begin = np.zeros(len(units), np.int64)
        begin[1:] = np.cumsum(lens[:-1] + 1)
        n = len(text)
        spot = np.minimum(np.searchsorted(self.point, text), len(self.point) - 1)
        code = np.where(self.point[spot] == text, spot + 2, 1)
        stops = begin + lens
        code[stops] = 0
        # characters get dense codes, in one byte if the batch has few kinds; pieces with other characters cannot occur
        kinds = np.unique(code)
        kinds = np.r_[0, 1, kinds[kinds > 1]]
        wide = 1 if len(kinds) < 255 else 2
        dense = np.full(len(self.point) + 2, -1, np.int64)
        dense[kinds] = np.arange(len(kinds))
        per = 8 // wide
        padded = np.zeros(n + self.width, np.uint64)
        padded[:n] = dense[code]
        word = np.zeros(n + self.width - per + 1, np.uint64)
        for k in range(per):
            word = word << np.uint64(8 * wide) | padded[k : k + len(word)]
        keys = [word[k : k + n] for k in range(0, self.width, per)]
        suffixes = np.lexsort(keys[::-1])
        kind = f"S{self.width * wide}"
        table = np.ascontiguousarray(np.stack([k[suffixes] for k in keys], 1).astype(">u8")).view(kind).ravel()
        own = dense[self.codes]
        here = np.flatnonzero((own >= 0).all(1))
        own = own[here]
        code_kind, top = (np.uint8, 0xFF) if wide == 1 else (">u2", 0xFFFF)
        past = np.arange(self.width)[None, :] >= self.lens[here][:, None]
        lo = np.searchsorted(table, np.ascontiguousarray(own.astype(code_kind)).view(kind).ravel(), "left")
        hi = np.searchsorted(table, np.ascontiguousarray(np.where(past, top, own).astype(code_kind)).view(kind).ravel(), "right")
        many = hi - lo
        total = int(many.sum())
        which = np.repeat(here, many)
        start = suffixes[np.arange(total) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        piece, length = self.ids[which], self.lens[which]
        odd = np.flatnonzero(code == 1)  # characters of no piece are edges that go with anything
        start, piece, length = np.r_[start, odd], np.r_[piece, np.full(len(odd), -1)], np.r_[length, np.ones(len(odd), np.int64)]
        end = start + length
        unit_begin = np.repeat(begin, lens + 1)
        depth = end - unit_begin[start]
        order = np.argsort(depth.astype(np.int16) if int(depth.max(initial=0)) < 1 << 15 else depth, kind="stable")  # by where they end
        start, piece, end, depth = start[order], piece[order], end[order], depth[order]
        last = np.full(n + 1, -2, np.int64)  # the piece that ends here; -2 none, -1 a character of no piece
        cuts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2 if len(depth) else 1))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            s, p = start[x:y], piece[x:y]
            before = last[s]
            good = (s == unit_begin[s]) | (before == -1) | (p == -1)
            ask = np.flatnonzero(~good & (before >= 0))
            if len(ask):
                good[ask] = self.keep_apart(before[ask], p[ask])
            last[end[x:y][good]] = p[good]
        at = stops.copy()
        owner = np.arange(len(units))
        out_owner, out_piece = [], []
        alive = at > begin
        owner, at = owner[alive], at[alive]
        while len(at):
            p = last[at]
            out_owner.append(owner)
            out_piece.append(np.where(p == -1, -1 - at, p))  # below -1: the place of a character of no piece
            at = at - np.where(p < 0, 1, self.len_of[p])
            go = at > begin[owner]
            owner, at = owner[go], at[go]
        owners, pieces = np.concatenate(out_owner or [owner])[::-1], np.concatenate(out_piece or [owner])[::-1]
        order = np.argsort(owners, kind="stable")
        pieces = pieces[order]
        bound = np.searchsorted(owners[order], np.arange(len(units) + 1))
        raw = pieces.astype("<u4").tobytes()
        cut = (4 * bound).tolist()
        out = [raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        for u in np.unique(owners[order][pieces < 0]).tolist():
            ids: list[int] = []
            for p in pieces[bound[u] : bound[u + 1]].tolist():
                ids += [p] if p >= 0 else [self.byte[x] for x in chr(int(text[-p - 2])).encode()]
            out[u] = np.array(ids, "<u4").tobytes()
        return out

    def learn(self, words: list[str]) -> None:
        """Remembers the ids of words, each as if a mark stood before it."""
        memo = self.memo
        hard = [w for w in words if w.startswith(MARK * 2) or "\0" in w]
        for w in hard:
            memo[w] = np.array(self.lib.encode(w), "<u4").tobytes()  # the library itself puts a mark before a text
        if not words or len(hard) == len(words):
            return
        easy = [w for w in words if not (w.startswith(MARK * 2) or "\0" in w)] if hard else words
        i = 0
        while i < len(easy):
            j, size = i, 0
            while j < len(easy) and (j == i or size + len(easy[j]) <= WORK):
                size += len(easy[j]) + 2
                j += 1
            memo.update(zip(easy[i:j], self.match([MARK + w for w in easy[i:j]]), strict=True))
            i = j

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        cut: list[list[str]] = []
        for t in texts:
            if not t:
                cut.append([])
            elif t[0] != " " and "  " not in t and MARK not in t:
                cut.append(t.split(" "))  # units without their marks
            else:
                cut.append([u[1:] for u in _UNIT.findall(MARK + t.replace(" ", MARK))])
        new = set().union(*cut).difference(self.memo)
        if len(self.memo) > MEMO:  # what was used since the last time stays known
            self.memo, self.old = {}, self.memo
            new = set().union(*cut)
        known = new & self.old.keys()
        self.memo.update((w, self.old[w]) for w in known)
        self.learn(list(new - known))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: bytes) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return (out[1:] if out[:1] == b" " else out).decode("utf-8", "replace")


@functools.lru_cache(maxsize=1)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the column `out`, the ids as an array of ints; every other column stays."""
    return _mapped(df, text, out, "array<int>", lambda texts: pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in pieces_of(model).encode(texts)], pa.list_(pa.int32())))


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """df with the column `out`, the text of the ids in `ids`; null ids give null."""
    return _mapped(df, ids, out, "string", lambda rows: pa.array([pieces_of(model).decode(np.array(r, "<u4").tobytes()) if r is not None else None for r in rows], pa.string()), keep_null=True)


def digests(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_ids, ids_crc32 (little-endian 32-bit ids) and whether decoding gives the text back."""
    names = ["doc_id", "n_bytes", "n_ids", "ids_crc32", "round_trip"]
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces_of(model)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = own.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array([own.decode(i) == t for i, t in zip(ids, texts, strict=True)], pa.bool_()),
                ],
                names,
            )

    return df.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_ids long, ids_crc32 long, round_trip boolean")


def _mapped(df: DataFrame, source: str, out: str, kind: str, f, keep_null: bool = False) -> DataFrame:
    bounded_batches(df.sparkSession)
    names = [c for c in df.columns if c != out or c == source]
    kept = [c for c in names if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in names])
    place = names.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(place).to_pylist()
            made = f(values if keep_null else [v or "" for v in values])
            yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in kept], made], [*kept, out])

    return rows.mapInArrow(run, rows.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast(kind).alias(out)).schema)
