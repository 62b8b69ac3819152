"""SentencePiece encoding and decoding of merge-type (BPE) models, exact, by backtracking.

A text is normalised as the model says, cut where no piece could ever join two
characters (no merge crosses such a place, so the parts encode independently),
and each distinct part is encoded once:

* one Aho-Corasick pass over the reversed parts gives the longest piece that
  begins at every position; shorter ones follow by a table of each piece's
  longest proper prefix that is a piece;
* from the left, the longest piece is taken that may follow the last one: two
  neighbours are compatible if re-merging their last merges, in rank order,
  never joins characters across the border;
* a position from which no piece fits is marked in a bitfield and never tried
  again, and the last piece is taken back.

This yields what merging the best pair again and again yields, in time linear
in the length of the part. Characters the model lacks become byte pieces.
Decoding gathers the bytes of the pieces in one numpy step and is compared with
the text of every document.

Defined results: a null text has null ids; an empty text has none; pieces for
control symbols never come from text; rows are encoded one by one, so repeated
rows, null doc_ids and ties need no rule; a very long text is handled alone.
A text that holds U+2581 decodes to a space there (as the model defines), so
``exact`` is false for it. An empty table gives an empty result. In
:func:`encode` extra columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm import textkernel as tk
from sigloom.llm.columns import rest, unpacked
from sigloom.llm.graph import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
META = "▁"
#: Bytes of text encoded at once.
CHUNK_BYTES = 1 << 18
#: Pairs of pieces of which a worker remembers whether one may follow the other; beyond it, all are forgotten.
FITS_KEPT = 1 << 18
_TABLE = 0x3000  # characters below have a place in the table of joinable pairs
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Model:
    """Pieces, ranks and tables of a BPE model file."""

    def __init__(self, path: str = MODEL):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or proto.trainer_spec.treat_whitespace_as_suffix or len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError(f"{path}: only BPE models with the identity normaliser are supported")
        self.dummy_prefix = norm.add_dummy_prefix
        self.pieces = [p.piece for p in proto.pieces]
        kind = [p.type for p in proto.pieces]
        self.unk = kind.index(UNKNOWN)
        self.byte_id = np.full(256, self.unk, np.int32)
        for i, p in enumerate(self.pieces):
            if kind[i] == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
        self.user = {p for i, p in enumerate(self.pieces) if kind[i] == USER}
        self.user_max = max(map(len, self.user), default=0)
        usable = [i for i, k in enumerate(kind) if k in (NORMAL, UNUSED)]
        self.id_of = {self.pieces[i]: i for i in usable} | {p: i for i, p in enumerate(self.pieces) if kind[i] == USER}
        # ranks: characters first, then merges from the best score down
        score = {self.pieces[i]: proto.pieces[i].score for i in usable}
        single = [p for p in score if len(p) == 1]
        many = sorted((p for p in score if len(p) > 1), key=lambda p: (-score[p], self.id_of[p]))
        self.rank = {p: r for r, p in enumerate(single + many)}
        self.order = {p: -score[p] for p in many}
        tied = {x for x, n in Counter(self.order.values()).items() if n > 1}
        #: pieces whose score others share too: parts that hold one are merged by the definition
        self.tied = [p for p in many if self.order[p] in tied]
        self.text = single + many
        self.first_merge = len(single)
        self.split: list[tuple[int, int]] = [(r, r) for r in range(len(single))]
        self.join: dict[tuple[int, int], int] = {}
        reachable = set(range(len(single)))
        for p in many:
            r, parts = self.rank[p], [self.rank.get(c, -1) for c in p]
            while len(parts) > 2 or (len(parts) == 2 and -1 in parts):
                if -1 in parts:
                    break
                best = min(((self.join[x], k) for k, x in enumerate(zip(parts[:-1], parts[1:])) if x in self.join), default=None)
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [best[0]]
            if len(parts) == 2 and -1 not in parts:
                self.split.append((parts[0], parts[1]))
                self.join[parts[0], parts[1]] = r
                reachable.add(r)
            else:
                self.split.append((r, r))  # no merges lead to it
        self.piece_id = np.array([self.id_of[p] for p in self.text], np.int32)
        self.shorter = [-1] * len(self.text)
        for r in reachable:
            p = self.text[r]
            for n in range(len(p) - 1, 0, -1):
                s = self.rank.get(p[:n], -1)
                if s in reachable:
                    self.shorter[r] = s
                    break
        self.plain = frozenset(single)
        self.odd = [p for p in [*self.user, *self.tied] if META + META not in p]
        self.automaton = ahocorasick.Automaton()
        for r in reachable:
            self.automaton.add_word(self.text[r][::-1], r)
        self.automaton.make_automaton()
        self.size = [len(p) for p in self.text]
        self.fits: dict[int, bool] = {}
        # pairs of characters that some piece holds side by side
        self.joinable = np.zeros((_TABLE >> 3, _TABLE), np.uint8)  # bits: 8 first characters a byte
        for p in score | dict.fromkeys(self.user):
            codes = [ord(c) for c in p]
            for a, b in zip(codes[:-1], codes[1:]):
                if a < _TABLE and b < _TABLE:
                    self.joinable[a >> 3, b] |= 1 << (a & 7)
        # of characters beyond the table, only whether they stand in pieces of several
        self.joins_high = np.zeros(0x110000, bool)
        for p in score:
            if len(p) > 1:
                for c in p:
                    self.joins_high[ord(c)] |= ord(c) >= _TABLE
        out = [bytes([int(p[3:5], 16)]) if kind[i] == BYTE else b"" if kind[i] == CONTROL else b" \xe2\x81\x87 " if kind[i] == UNKNOWN else p.replace(META, " ").encode() for i, p in enumerate(self.pieces)]
        self.out_len = np.array([len(b) for b in out], np.int64)
        self.out_at = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.out_len)])
        self.out = np.frombuffer(b"".join(out), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """May piece b follow piece a: undoing their last merges, from the later one on, meets no pair that would have merged first."""
        key = a << 20 | b
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= FITS_KEPT:
                self.fits.clear()
            known = self.fits[key] = self._remerge(a, b)
        return known

    def _remerge(self, a: int, b: int) -> bool:
        limit, merges = 1 << 30, self.first_merge
        while True:
            if self.join.get((a, b), 1 << 30) < limit:
                return False
            if a < merges and b < merges:
                return True
            if a > b:
                limit = a
                a = self.split[a][1]
            else:  # of equal ranks the left one merges first, so one across the border would have come before b
                limit = b + 1
                b = self.split[b][0]

    def longest(self, joined: str) -> list[int]:
        """For each position, the rank of the longest piece that begins there (-1 if none)."""
        n = len(joined)
        out = [-1] * n
        size = self.size
        # a match ends, in reversed text, at the position where the piece begins; of several the longest wins
        for end, r in self.automaton.iter(joined[::-1]):
            at = n - 1 - end
            if out[at] < 0 or size[r] > size[out[at]]:
                out[at] = r
        return out

    def backtrack(self, n: int, longest: list[int], base: int) -> list[int]:
        """Ranks of the pieces of the n characters from base on."""
        size, shorter, compatible = self.size, self.shorter, self.compatible
        taken: list[int] = []
        alive = (1 << (n + 1)) - 1  # bit i: position i isn't known to fail
        at, r = 0, longest[base]
        while at < n:
            last = taken[-1] if taken else -1
            while True:
                end = at + size[r]
                if end <= n and alive >> end & 1 and (last < 0 or compatible(last, r)):
                    taken.append(r)
                    at = end
                    if at < n:
                        r = longest[base + at]
                    break
                r = shorter[r]
                if r < 0:
                    alive &= ~(1 << at)
                    r = taken.pop()
                    at -= size[r]
                    break
        return taken

    def merge(self, text: str) -> list[int]:
        """Ids by merging the best pair again and again, user-defined pieces first: the definition, for rare parts and tests."""
        parts: list[str] = []
        frozen: list[bool] = []
        at = 0
        while at < len(text):
            n = next((k for k in range(min(self.user_max, len(text) - at), 0, -1) if text[at : at + k] in self.user), 0)
            parts.append(text[at : at + (n or 1)])
            frozen.append(n > 0)
            at += n or 1
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, str]] = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else n
            if j < n and not frozen[i] and not frozen[j]:
                both = parts[i] + parts[j]
                order = self.order.get(both)
                if order is not None:
                    heapq.heappush(heap, (order, i, both))

        for i in range(n):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        ids: list[int] = []
        for p in filter(None, parts):
            i = self.id_of.get(p)
            ids += [i] if i is not None else self.byte_id[np.frombuffer(p.encode(), np.uint8)].tolist()
        return ids

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part (a part has no place to cut)."""
        out: list[list[int]] = []
        plain: list[str] = []
        for p in parts:
            if len(p) == 1 or (META + META in p) or not self.plain.issuperset(p) or any(u in p for u in self.odd):
                out.append(self.merge(p))
            else:
                out.append([])
                plain.append(p)
        if plain:
            longest = self.longest("\U0010ffff".join(plain))
            base, ids = 0, self.piece_id
            for i, p in enumerate(parts):
                if not out[i]:
                    out[i] = ids[self.backtrack(len(p), longest, base)].tolist()
                    base += len(p) + 1
        return out


@functools.lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


class Encoder:
    """Encodes Arrow string columns, keeping the ids of parts met before."""

    def __init__(self, model: Model):
        self.model = model
        self.cache = tk.PartCache(model.encode_parts)

    def cuts(self, points: np.ndarray) -> np.ndarray:
        """Indices i such that nothing joins characters i - 1 and i."""
        m = self.model
        a, b = points[:-1], points[1:]
        low = (a < _TABLE) & (b < _TABLE)
        x, y = np.where(low, a, 0), np.where(low, b, 0)
        may = (m.joinable[x >> 3, y] >> (x & 7).astype(np.uint8) & 1).astype(bool)
        return np.flatnonzero(~np.where(low, may, m.joins_high[a] | m.joins_high[b])) + 1

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each row in them)."""
        m = self.model
        offsets, data = tk.buffers(texts)
        size = np.diff(offsets)
        text = data.tobytes().decode()
        # a dummy prefix for each text that isn't empty, then white space as U+2581
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
        heads = lead[offsets[:-1]][size > 0]
        if m.dummy_prefix:
            points = np.insert(points, heads, ord(META))
            heads = heads + np.arange(len(heads))
        points[points == 32] = ord(META)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = self.cuts(points)
        starts = np.union1d(cut, heads)
        ends = np.append(starts[1:], len(points))
        raw = np.ascontiguousarray(points.astype("<u4")).view(np.uint8)
        h = tk.hash_spans(raw, starts * 4, ends * 4)
        joined = raw.tobytes()
        ids, bound = self.cache.ids(h, lambda pick: [joined[4 * a : 4 * b].decode("utf-32-le") for a, b in zip(starts[pick].tolist(), ends[pick].tolist())])
        part_of = np.searchsorted(starts, heads)
        row_at = np.zeros(len(offsets) - 1, np.int64)
        row_at[size > 0] = bound[part_of]
        full = np.append(row_at, len(ids))
        for_empty = np.flatnonzero(size == 0)
        for i in for_empty[::-1]:
            full[i] = full[i + 1]
        return ids, full


def decode_bytes(model: Model, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of the rows; the dummy prefix is dropped."""
    n = model.out_len[ids]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    data = model.out[np.arange(total) + np.repeat(model.out_at[ids] - (ends - n), n)]
    bound = np.concatenate([np.zeros(1, np.int64), ends])[offsets]
    if model.dummy_prefix:
        full = np.flatnonzero(np.diff(bound) > 0)
        full = full[data[bound[full]] == 32]
        data = np.delete(data, bound[full])
        drop = np.zeros(len(bound), np.int64)
        drop[full + 1] = 1
        bound = bound - np.cumsum(drop)
    return data, bound


def decode(model: Model, ids: list[int]) -> str:
    data, _ = decode_bytes(model, np.array(ids, np.int64), np.array([0, len(ids)]))
    return data.tobytes().decode("utf-8", "replace")


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        encoder = _kept.setdefault(path, Encoder(model))
        for part in tk.chunks(batches, limit=CHUNK_BYTES):
            texts = part["text"]
            ids, offsets = encoder(texts)
            data, bound = decode_bytes(model, ids, offsets)
            at, raw = tk.buffers(texts)
            exact = np.diff(bound) == np.diff(at)
            if len(data) == len(raw) and exact.all():
                wrong = np.flatnonzero(data != raw)
                exact[np.searchsorted(bound, wrong, "right") - 1] = False
            else:
                for i in np.flatnonzero(exact):
                    exact[i] = bool((data[bound[i] : bound[i + 1]] == raw[at[i] : at[i + 1]]).all())
            gone = np.asarray(pc.is_null(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.where(np.append(gone, False), 0, offsets).astype(np.int32), mask=np.append(gone, False)), pa.array(ids, pa.int32()))
            names = part.schema.names
            yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(exact, mask=gone)], [*names, "ids", "exact"])

    return run


_kept: dict[str, Encoder] = {}


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs with ``piece_ids`` and ``exact`` (whether decoding gives the text back).

    Columns that have these names already are kept as ``piece_ids_in`` and ``exact_in`` (with further ``_in`` if those exist too).
    """
    small_batches(docs.sparkSession)
    taken = set(docs.columns)
    for name in ("piece_ids", "exact"):
        if name in taken:
            other = name
            while other in taken:
                other += "_in"
            docs = docs.withColumnRenamed(name, other)
            taken.add(other)
    plain = docs.select(rest(docs), "text")
    schema = T.StructType([*plain.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    out = plain.mapInArrow(_encoder(path), schema)
    return out.select(*unpacked(docs), F.col("ids").alias("piece_ids"), "exact")


def encoded(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, piece_ids, n_pieces, exact) of every document."""
    out = encode(docs.select("doc_id", "text"), path)
    return out.select("doc_id", "piece_ids", F.when(F.col("piece_ids").isNotNull(), F.size("piece_ids")).alias("n_pieces"), "exact")
