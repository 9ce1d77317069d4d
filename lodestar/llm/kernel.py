"""Vectorised text primitives over the raw bytes of an Arrow string column.

A chunk is `data` (uint8, the texts one after the other) and `offs` (int64, where each
text starts, plus the end). Words are runs of bytes outside 0x20 and 0x09-0x0D. Word and
line hashes are differences of one running polynomial hash, so their cost does not
depend on how many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts are worked on in chunks of about so many bytes (a longer single text is a chunk of its own).
CHUNK = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + (1 << 16))
        out = []
        for b in (_BASE, _BASE_INV):
            p = np.full(size, b, U)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offs[0] : offs[-1]], offs - offs[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offs


def chunks(offs: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z."""
    return _FOLD[data]


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of marked bytes; a run never crosses from one text to the next."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = member[:-1], member[1:]
    inner = offs[1:-1]
    inner = inner[inner < n]
    before[inner] = False
    inner = inner[inner > 0]
    after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (length n + 1)."""
    starts, ends = runs(~_SPACE[data], offs)
    return starts, ends, np.searchsorted(starts, offs)


def running_hash(data: np.ndarray) -> np.ndarray:
    h = np.zeros(len(data) + 1, U)
    p, _ = _power(len(data) + 1)
    np.cumsum(_BYTE[data] * p[: len(data)], out=h[1:])
    return h


def span_hash(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    _, inverse = _power(len(h))
    return mix((h[ends] - h[starts]) * inverse[starts] + (ends - starts).astype(U))


_STEP = [U(pow(0xD1342543DE82EF95, i, 1 << 64)) for i in range(64)]


def windows(wh: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's windows of `size` words, the word each begins with, and windows before each text.

    first: words before each text. A text of fewer words, but at least one, has one window of all its words.
    """
    counts = np.diff(first)
    n = len(wh)
    left = np.repeat(first[1:], counts) - np.arange(n)  # words from here to the end of the text
    begin = (left >= size) | ((left < size) & (np.repeat(counts, counts) == left) & (left > 0))
    at = np.flatnonzero(begin)
    total = np.zeros(len(at), U)
    room = left[at]
    for k in range(size):
        if n:
            w = wh[np.minimum(at + k, n - 1)]
            total += np.where(room > k, w, U(0)) * _STEP[k + 1]
    return mix(total + np.minimum(room, size).astype(U)), at, np.searchsorted(at, first)


def shingles(data: np.ndarray, offs: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every text, and the shingles before each text."""
    starts, ends, first = words(data, offs)
    out, _, before = windows(span_hash(running_hash(data), starts, ends), first, size)
    return out, before


# -- one-permutation MinHash ------------------------------------------------------------

_order: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _donors(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a fixed random order of all bins, and each bin's rank in it."""
    if bins not in _order:
        perm = np.argsort(np.random.default_rng(911 + bins).random((bins, bins), np.float32), axis=1).astype(np.int16)
        rank = np.empty_like(perm)
        np.put_along_axis(rank, perm.astype(np.int64), np.broadcast_to(np.arange(bins, dtype=np.int16), perm.shape), 1)
        _order[bins] = perm, rank
    return _order[bins]


def one_permutation(sh: np.ndarray, before: np.ndarray, bins: int) -> np.ndarray:
    """[texts, bins] MinHash values: each shingle hash is binned once by its high bits and the least of a bin is kept;
    an empty bin copies from the first filled bin of its own fixed random order (optimal densification).
    Rows of texts without shingles are all ones.
    """
    n, shift = len(before) - 1, 64 - int(bins).bit_length() + 1
    empty = ~U(0)
    flat_ = np.full(n * bins, empty, U)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(before))
    np.minimum.at(flat_, doc * bins + (sh >> U(shift)).astype(np.int64), sh)
    out = flat_.reshape(n, bins)
    perm, rank = _donors(bins)
    filled = out != empty
    source = out.copy()
    r, c = np.nonzero(~filled & filled.any(1)[:, None])
    for a in range(24):
        if not len(r):
            break
        d = perm[c, a].astype(np.int64)
        ok = filled[r, d]
        out[r[ok], c[ok]] = source[r[ok], d[ok]]
        r, c = r[~ok], c[~ok]
    if len(r):  # sparse rows: the same order, looked up by rank among the few filled bins
        cut = np.flatnonzero(np.diff(r)) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(r)], strict=True):
            have = np.flatnonzero(filled[r[lo]])
            cc = c[lo:hi]
            out[r[lo], cc] = source[r[lo], have[rank[cc][:, have].argmin(1)]]
    return mix(out ^ (np.arange(bins, dtype=U) * U(0xA24BAED4963EE407)))
