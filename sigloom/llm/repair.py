"""Token ids in binary shards, compressed by a Re-Pair grammar.

Texts become ids of a byte-level BPE vocabulary; a shard holds the ids of about
``SHARD_BYTES`` of text. In each shard, frequent pairs of neighbouring ids are
replaced by new ids (nonterminals) again and again, the most frequent first, and
never across two documents. Pairs are replaced level by level: all of at least
half the greatest count (where two overlap, the more frequent one wins), then all
of a quarter, and so on, the pairs that new ids form among them. It ends when no
pair is replaced ``MIN_COUNT`` times, the least that pays for its rule: a rule
takes 8 bytes (two ids of three, a length of two), two uses save 6 and three 9.

A pair's count is an upper bound from then on, since only pairs with a new id can
become more frequent: so a round sorts the places whose bound reaches its level,
and those beside a new id, not the whole shard.

A shard stores its rules, the expansion length of each, the shortened ids and
where each document begins in them, so ids a..b of any document are decoded
without the rest: :func:`decode` skips whole nonterminals by their lengths.

Shards are made where the rows are read, without a shuffle; which documents share
one depends on the file splits, what they decode to doesn't.

Defined results: a null text has the length null and no ids, an empty one has
none; doc_ids are stored as they are, so nulls, repeats and ties need no rule; a
very long text makes a long shard (it is never cut); special tokens in text are
ordinary text. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sigloom.llm import textkernel as tk
from sigloom.llm.graph import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD_BYTES = 1 << 22
#: A rule of fewer uses takes more bytes than it saves.
MIN_COUNT = 3
#: Share of the shard below which what a round replaces lets the next level begin; what is left is met there.
LOW_GAIN = 0.01
_OPEN = np.uint32(0xFFFFFFFF)


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Tokenizer:
    """Ids of Arrow string columns; each distinct part between cuts is encoded once.

    A text is cut before a space that a plain visible character follows: the
    pattern never joins what stands on its two sides.
    """

    def __init__(self, path: str):
        self.encoding = vocabulary(path)
        self.first_new = self.encoding.n_vocab
        encode = self.encoding.encode_ordinary
        self.cache = tk.PartCache(lambda parts: [encode(p) for p in parts])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of each row in them)."""
        offsets, data = tk.buffers(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        after = np.append(data[1:], 32)
        cut = (data == 32) & (((after > 32) & (after < 127)) | (after == 0xC3))
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        h = tk.hash_spans(data, starts, ends)
        raw = data.tobytes()
        ids, bound = self.cache.ids(h, lambda pick: [raw[a:b].decode() for a, b in zip(starts[pick].tolist(), ends[pick].tolist())])
        return ids, bound[np.searchsorted(starts, offsets)]


def _replaced(at: np.ndarray, key: np.ndarray, count: np.ndarray, pick: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, rank of the pair at each, the pairs by rank) to replace: of pairs that overlap the more frequent wins."""
    chosen, often = key[head[pick]], count[pick]
    order = np.lexsort((chosen, -often))
    place = np.empty(len(chosen), np.uint64)
    place[order] = np.arange(len(chosen), dtype=np.uint64)
    both = np.sort((at[np.repeat(pick, count)].astype(np.uint64) << np.uint64(32)) | np.repeat(place, often))
    at, rank = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    touch, same = np.diff(at) == 1, np.diff(rank) == 0
    # in a run of one pair, every other place
    run = np.flatnonzero(np.concatenate([[True], ~(touch & same)]))
    even = (np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0
    beyond = len(chosen)
    before = np.concatenate([[beyond], np.where(touch & ~same, rank[:-1], beyond)])
    after = np.concatenate([np.where(touch & ~same, rank[1:], beyond), [beyond]])
    win = even & (rank < before) & (rank < after)
    return at[win], rank[win], chosen[order]


def compress(ids: np.ndarray, offsets: np.ndarray, first_new: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rules as pairs, expansion lengths, shortened ids, offsets of the documents in them)."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)  # ends a document: joins nothing on its right
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    most = np.where(last, np.uint32(0), _OPEN)  # at each place, how frequent its pair is at most
    rules: list[np.ndarray] = []
    n_rules, level = 0, None
    while len(seq) > 1:
        at = np.flatnonzero(most >= (level or MIN_COUNT))
        gain = 0
        if len(at):
            # pairs in order, each with its places: sorted as one number, if both fit in it
            wide, far = (first_new + n_rules).bit_length(), len(seq).bit_length()
            wide = wide if 2 * wide + far <= 64 else 32
            key = (seq[at].astype(np.uint64) << np.uint64(wide)) | seq[at + 1]
            if wide < 32:
                key = np.sort((key << np.uint64(far)) | at.astype(np.uint64))
                key, at = key >> np.uint64(far), (key & np.uint64((1 << far) - 1)).astype(np.int64)
            else:
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            count = np.diff(np.append(head, len(key)))
            most[at] = np.repeat(count, count)
            level = level or max(MIN_COUNT, int(count.max()) // 2)
            pick = count >= level
            if pick.any():
                at, rank, chosen = _replaced(at, key, count, pick, head)
                keep = np.bincount(rank, minlength=len(chosen)) >= MIN_COUNT
                number = np.cumsum(keep) - 1
                at, rank = at[keep[rank]], rank[keep[rank]]
                gain = len(at)
        if gain:
            chosen = chosen[keep]
            rules.append(((chosen >> np.uint64(wide)) << np.uint64(32)) | (chosen & np.uint64((1 << wide) - 1)))
            seq[at] = (first_new + n_rules + number[rank]).astype(np.uint32)
            n_rules += len(chosen)
            last[at] = last[at + 1]
            most[at] = np.where(last[at], np.uint32(0), _OPEN)
            left = at[at > 0] - 1
            most[left[~last[left]]] = _OPEN
            stay = np.ones(len(seq), bool)
            stay[at + 1] = False
            seq, last, most = seq[stay], last[stay], most[stay]
        elif level is None or level == MIN_COUNT:
            break
        if gain < LOW_GAIN * len(seq):
            level = max(MIN_COUNT, level // 2)
    flat = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    pairs = np.stack([(flat >> np.uint64(32)).astype(np.uint32), (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)], axis=1)
    length = np.ones(first_new + n_rules, np.int64)
    done = first_new
    for r in rules:
        part = pairs[done - first_new : done - first_new + len(r)]
        length[done : done + len(r)] = length[part[:, 0]] + length[part[:, 1]]
        done += len(r)
    tails = np.flatnonzero(last) + 1
    at = np.zeros(len(offsets), np.int64)
    full = offsets[1:] > offsets[:-1]
    at[1:][full] = tails
    at = np.maximum.accumulate(at)
    return pairs, length[first_new:].astype(np.uint32), seq, at


def pack(values: np.ndarray) -> bytes:
    """As many bytes each as the greatest needs, least first (the first byte says how many)."""
    flat = np.ascontiguousarray(values, dtype="<u4").ravel()
    width = max(1, (int(flat.max()).bit_length() + 7) // 8) if len(flat) else 1
    return bytes([width]) + flat.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(raw), 4), np.uint8)
    out[:, :width] = raw
    return out.view("<u4").ravel()


def expand(symbols: np.ndarray, pairs: np.ndarray, first_new: int) -> np.ndarray:
    """All ids that the symbols stand for."""
    out = symbols.astype(np.int64)
    while True:
        deep = out >= first_new
        if not deep.any():
            return out.astype(np.int32)
        wide = np.where(deep, 2, 1)
        at = np.cumsum(wide) - wide
        new = np.empty(int(wide.sum()), np.int64)
        new[at] = out
        rule = pairs[out[deep] - first_new]
        new[at[deep]], new[at[deep] + 1] = rule[:, 0], rule[:, 1]
        out = new


def decode(shard: dict, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray | None:
    """Ids start..stop of the doc-th document of a shard; only symbols that hold some of them are expanded."""
    if shard["n_ids"][doc] is None:
        return None
    pairs, lengths, seq = unpack(shard["rules"]).reshape(-1, 2), unpack(shard["lengths"]), unpack(shard["symbols"])
    a, b = shard["starts"][doc], shard["starts"][doc + 1]
    stop = shard["n_ids"][doc] if stop is None else min(stop, shard["n_ids"][doc])
    part, first_new = seq[a:b].astype(np.int64), shard["first_new"]
    size = np.ones(len(part), np.int64)
    deep = part >= first_new
    size[deep] = lengths[part[deep] - first_new]
    ends = np.cumsum(size)
    i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = start - (ends[i - 1] if i > 0 else 0)
    return expand(part[i:j], pairs, first_new)[skip : skip + max(0, stop - start)]


_FIELDS = [
    ("shard", pa.int64(), "long"),
    ("doc_ids", pa.list_(pa.int64()), "array<long>"),
    ("n_ids", pa.list_(pa.int32()), "array<int>"),
    ("starts", pa.list_(pa.int32()), "array<int>"),
    ("first_new", pa.int32(), "int"),
    ("rules", pa.binary(), "binary"),
    ("lengths", pa.binary(), "binary"),
    ("symbols", pa.binary(), "binary"),
]
_kept: dict[str, Tokenizer] = {}


def shards(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row a shard: its documents, how many ids each has, and the grammar that gives them."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _kept:
            _kept[path] = Tokenizer(path)
        tokenizer = _kept[path]
        context = TaskContext.get()
        base, number = (context.partitionId() if context else 0) << 32, 0
        for part in tk.chunks(batches, limit=SHARD_BYTES):
            ids, offsets = tokenizer(part["text"])
            pairs, lengths, seq, at = compress(ids, offsets, tokenizer.first_new)
            size = pa.array(np.diff(offsets).astype(np.int32), mask=np.asarray(pc.is_null(part["text"])))
            row = [base + number, part["doc_id"].to_pylist(), size.to_pylist(), at.tolist(), tokenizer.first_new, pack(pairs), pack(lengths), pack(seq)]
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind, _) in zip(row, _FIELDS)], [n for n, _, _ in _FIELDS])
            number += 1

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {k}" for n, _, k in _FIELDS))
