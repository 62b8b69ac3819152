"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

The corpus operators need hashes of every word, word n-gram or character
shingle. No Spark expression yields them without exploding each document into
rows, so they run in ``mapInArrow`` workers, where numpy works on the bytes of
whole batches: no Python object is made for a word or a line.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim
except (OSError, AttributeError):  # another C library
    _LIBC = None

U64 = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93 | 1
#: Bytes of text handled at once; a single longer document is handled alone.
CHUNK_BYTES = 1 << 19

#: ASCII white space, as ``[ \t\n\x0b\f\r]`` in SQL patterns.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: ASCII bytes that are neither letter nor digit; bytes of longer characters count as letters.
IS_BREAK = np.zeros(256, bool)
IS_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True

_pows: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown between calls."""
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = max(n, 1024, 2 * len(have) if have is not None and n < 1 << 22 else 0)
        p = np.full(size, base, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            _pows[base] = have = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (every input bit reaches every output bit)."""
    with np.errstate(over="ignore"):
        t = h >> U64(33)
        t ^= h
        t *= U64(0xFF51AFD7ED558CCD)
        u = t >> U64(33)
        t ^= u
        t *= U64(0xC4CEB9FE1A85EC53)
        u = t >> U64(33)
        t ^= u
        return t


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about ``limit`` bytes of text (always one row at least); unused memory goes back at the end."""
    try:
        yield from _slices(batches, column, limit)
    finally:
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system: workers live on between tasks, and what they keep is lost to their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + limit, "right"))
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string column; a null is an empty text."""
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.large_string())
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight bytes a step; spans of any length."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, U64, padded, strides=(1,))
    length = end - start
    with np.errstate(over="ignore"):
        h = (eight[start] & _MASK[np.minimum(length, 8)]) * U64(_BYTE_BASE) + length.astype(U64)
        h = mix(h)
        live = np.flatnonzero(length > 8)
        at = 8
        while len(live):
            h[live] = mix((h[live] ^ (eight[start[live] + at] & _MASK[np.minimum(length[live] - at, 8)])) * U64(_BYTE_BASE))
            at += 8
            live = live[length[live] > at]
    return h


def poly_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of the bytes of each span from prefix sums: a few operations a byte, however long the spans."""
    draw = np.random.default_rng(seed).integers(0, 1 << 64, 257, dtype=np.uint64)
    base = int(draw[256]) | 1
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(draw[data] * powers(base, len(data)))])
        inverse = powers(pow(base, -1, 1 << 64), len(data) + 1)
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


def row_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of 64-bit values."""
    base = 0xB5026F5AA96619E9
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(values) * powers(base, len(values)))])
        inverse = powers(pow(base, -1, 1 << 64), len(values) + 1)
        return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))


class Words:
    """Maximal runs of bytes outside ``breaks``; no run crosses two documents.

    ``start``/``end`` are byte positions in the chunk, ``doc`` the row of each
    word, ``first`` the index of each row's first word (with the total at the
    end), ``hash`` a 64-bit hash of each word's bytes.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray, breaks: np.ndarray = IS_SPACE):
        n = len(data)
        inside = ~breaks[data] if n else np.zeros(0, bool)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        heads = offsets[:-1]
        heads = heads[heads < n]
        before[heads] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        tails = offsets[1:] - 1
        after[tails[tails >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        m = len(self.start)
        if not m:
            self.hash = np.zeros(0, U64)
            return
        self.hash = hash_spans(data, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word of each window of k words in one document, and its hash."""
        m = len(self)
        if m < k:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(self.doc[: m - k + 1] == self.doc[k - 1 :])
        if k <= 12:
            with np.errstate(over="ignore"):
                h = np.zeros(m - k + 1, U64)
                for j in range(k):
                    h = h * U64(_WORD_BASE) + self.hash[j : m - k + 1 + j]
            return at, mix(h[at])
        return at, self.span_hash(at, at + k)

    def span_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the words a..b-1 (arrays); equal words give equal hashes wherever they stand."""
        if getattr(self, "_sum", None) is None:
            with np.errstate(over="ignore"):
                self._sum = np.concatenate([np.zeros(1, U64), np.cumsum(self.hash * powers(_WORD_BASE, len(self)))])
            self._inv = powers(pow(_WORD_BASE, -1, 1 << 64), len(self) + 1)
        with np.errstate(over="ignore"):
            return mix((self._sum[b] - self._sum[a]) * self._inv[a] + (b - a).astype(U64))


def line_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number in the row, start and end of every line (split on ``\\n``); each row has one line at least."""
    n = len(data)
    cuts = np.flatnonzero(data == 10)
    per = np.searchsorted(cuts, offsets)
    counts = np.diff(per) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), counts)
    first = np.cumsum(counts) - counts
    number = np.arange(len(doc)) - np.repeat(first, counts)
    start = np.empty(len(doc), np.int64)
    end = np.empty(len(doc), np.int64)
    head = number == 0
    start[head] = offsets[:-1]
    start[~head] = cuts + 1
    last = np.zeros(len(doc), bool)
    last[first + counts - 1] = True
    end[last] = offsets[1:]
    end[~last] = cuts
    assert n == 0 or end[-1] == n
    return doc, number, start, end


def characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of valid UTF-8, and the index of the character that each byte position (and the end) belongs to."""
    lead = (data & 0xC0) != 0x80
    index = np.concatenate([np.zeros(1, np.int64), np.cumsum(lead)])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), index


def hash_params(n: int, seed: int) -> np.ndarray:
    """n random odd 32-bit multipliers."""
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def min_hashes(values: np.ndarray, starts: np.ndarray, mults: np.ndarray) -> np.ndarray:
    """For each group of 32-bit values (beginning at ``starts``, none empty) its minimum under each multiplier's hash.

    ``h(x) = (x * m mod 2**32) ^ (that >> 15)`` on values that are already
    mixed; the order it gives to distinct values is what MinHash needs.
    """
    out = np.empty((len(mults), len(starts)), np.uint32)
    step = 1 << 16  # values a block, so that a block stays in cache
    bounds = np.searchsorted(starts, np.arange(0, len(values) + step, step))
    bounds = np.unique(np.concatenate([bounds, [0, len(starts)]]))
    ends = np.append(starts, len(values))
    room = int((ends[bounds[1:]] - ends[bounds[:-1]]).max()) if len(starts) else 0
    one, two = np.empty(room, np.uint32), np.empty(room, np.uint32)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        lo, hi = ends[a], ends[b]
        block, at = values[lo:hi], starts[a:b] - lo
        h, t = one[: hi - lo], two[: hi - lo]
        for j, m in enumerate(mults):
            np.multiply(block, m, out=h)
            np.right_shift(h, np.uint32(15), out=t)
            np.bitwise_xor(h, t, out=h)
            np.minimum.reduceat(h, at, out=out[j, a:b])
    return out.T


class PartCache:
    """Ids of parts of text by hash, kept between batches: each distinct part is encoded once while it is kept.

    A direct-address table finds most parts in one step; only those it lacks are
    sorted out and encoded. Parts whose places collide displace each other, and
    all are forgotten beyond ``limit``: both cost time alone.
    """

    BITS = 21

    def __init__(self, encode, limit: int = 800_000):
        self.encode, self.limit = encode, limit
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(1 << self.BITS, U64)
        self.slot = np.zeros(1 << self.BITS, np.int32)
        self.flat = np.zeros(1 << 20, np.int32)
        self.offset = np.zeros(1 << 18, np.int64)
        self.n = 0

    def ids(self, h: np.ndarray, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, where each part's begin, with the end). texts(indices) gives the parts there."""
        h = np.maximum(h, U64(1))
        if self.n > self.limit:
            self.reset()
        place = (h >> U64(64 - self.BITS)).astype(np.int64)
        slot = self.slot[place]
        lost = np.flatnonzero(self.key[place] != h)
        if len(lost):
            _, first, back = np.unique(h[lost], return_index=True, return_inverse=True)
            first = lost[first]
            new = np.arange(self.n, self.n + len(first), dtype=np.int32)
            self._add(self.encode(texts(first)))
            slot[lost] = new[back]
            self.key[place[first]], self.slot[place[first]] = h[first], new
        at = self.offset[slot]
        count = self.offset[slot + 1] - at
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(at - (ends - count), count)]
        return ids, np.concatenate([np.zeros(1, np.int64), ends])

    def _add(self, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        had, more = int(self.offset[self.n]), int(size.sum())
        if had + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(had + more, np.int32)])
        if self.n + len(ids) + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros(self.n + len(ids) + 1, np.int64)])
        self.flat[had : had + more] = np.fromiter((x for one in ids for x in one), np.int32, more)
        self.offset[self.n + 1 : self.n + len(ids) + 1] = had + np.cumsum(size)
        self.n += len(ids)


def zipped(texts: pa.Array) -> pa.Array:
    """Each text as zstandard frame: a third less than what the shuffle's own codec leaves of it."""
    compress = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
    offsets, data = buffers(texts)
    raw = memoryview(data)
    out = [compress(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return pa.array(out, pa.binary(), mask=np.asarray(pc.is_null(texts)))


def unzipped(col: pa.Array) -> pa.Array:
    """The texts again."""
    expand = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else expand(x) for x in col.to_pylist()], pa.binary()).cast(pa.string())


def zip_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: the string column ``text`` becomes the binary column ``z``."""
    for part in chunks(batches):
        names = [n for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(part[n] for n in names), zipped(part["text"])], [*names, "z"])


def unzip_column(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with ``text`` in place of ``z``, some hundred kilobytes at once."""
    for part in chunks(batches, "z", CHUNK_BYTES // 2):
        names = [n for n in part.schema.names if n != "z"]
        yield pa.RecordBatch.from_arrays([*(part[n] for n in names), unzipped(part["z"])], [*names, "text"])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
