"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's signature holds ``N_HASH`` symbols of ``BITS`` bits: the low bits
of MinHash values over its word pairs (lower case, punctuation dropped). The
distance of two signatures is the number of symbols that differ; documents are
near duplicates if it is at most ``MAX_DIST``.

Pigeonhole: the symbols are split into ``CHUNKS`` chunks, each with one error
allowed. Two signatures within ``MAX_DIST = 2 * CHUNKS - 2`` must agree in some
chunk but for one symbol, since otherwise all chunks would differ twice. Errors
are enumerated by leaving each symbol of a chunk out in turn: equal rests give
equal keys. So each pair under the threshold meets under one key at least (no
recall is lost to the index), and every meeting is checked in full.

Scale: only (key, node) pairs are shuffled, 16 bytes each, and counted before
the shuffle; keys seen once end there; equal signatures are one entry. A key of
more than ``HOT`` entries is split: each of its entries gets the keys of another
chunking, to which the pigeonhole applies as well, so that all its pairs meet
again in smaller buckets. A key's entries are joined by breadth-first search
over full distances, so thousands of copies cost one pass and yield one
edge each, and nothing is capped. Groups are the connected components.

Defined results: a null or wordless text has no signature and is no one's
duplicate; rows with equal doc_id and text are one document and share its fate,
rows with equal doc_id and other texts are different documents; rows with a null
doc_id belong to no group and stay; of a group the least doc_id stays (where it
has several texts in the group, that of the least hash); extra columns are ignored or, in :func:`filter_near`,
passed through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import textkernel as tk
from sigloom.llm.columns import rest, rest_field, unpacked
from sigloom.llm.graph import checkpoint, connected_components, small_batches

N_HASH = 64
BITS = 16
CHUNKS = 13
MAX_DIST = 2 * CHUNKS - 2
SHINGLE = 2
_MULTS = tk.hash_params(N_HASH, 1)
#: First symbol of each chunk.
CUTS = [round(i * N_HASH / CHUNKS) for i in range(CHUNKS + 1)]
#: Signatures under one key beyond which it is split; the symbols in the order of the other chunking.
HOT = 50_000
_OTHER = np.random.default_rng(7).permutation(N_HASH)


def signature_matrix(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have words, and their signatures (uint16, rows x N_HASH)."""
    offsets, data = tk.buffers(pc.utf8_lower(texts))
    words = tk.Words(offsets, data, tk.IS_BREAK)
    counts = np.diff(words.first)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return rows, np.zeros((0, N_HASH), np.uint16)
    at, pair = words.windows(SHINGLE)
    single = rows[counts[rows] < SHINGLE]  # shorter texts: the words themselves
    lone = np.isin(words.doc, single)
    doc = np.concatenate([words.doc[at], words.doc[lone]])
    value = np.concatenate([pair, words.hash[lone]])
    order = np.argsort(doc, kind="stable") if len(single) else slice(None)
    doc, value = doc[order], value[order]
    starts = np.searchsorted(doc, rows)
    low = tk.min_hashes((value >> np.uint64(16)).astype(np.uint32), starts, _MULTS)
    return rows, (low * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.chunks(batches):
        rows, sig = signature_matrix(part["text"])
        ids = part["doc_id"].take(pa.array(rows))
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * N_HASH), len(rows), [None, pa.py_buffer(np.ascontiguousarray(sig).tobytes())])
        yield pa.RecordBatch.from_arrays([ids, part["th"].take(pa.array(rows)), raw.cast(pa.binary())], ["doc_id", "th", "sig"])


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, sig) of the documents that have words; th is xxhash64 of the text."""
    need = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter("doc_id is not null and text is not null")
    return need.mapInArrow(_sign, "doc_id long, th long, sig binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """The N_HASH keys of each signature: for each symbol, a hash of the rest of its chunk and its place."""
    n = len(sig)
    out = np.empty((n, N_HASH), np.uint64)
    base = tk.powers(0xA24BAED4963EE407 | 1, N_HASH + 1)
    with np.errstate(over="ignore"):
        part = (sig.astype(np.uint64) + np.uint64(1)) * base[1 : N_HASH + 1]
        for a, b in zip(CUTS[:-1], CUTS[1:]):
            whole = part[:, a:b].sum(axis=1, dtype=np.uint64)
            for j in range(a, b):
                out[:, j] = tk.mix(whole - part[:, j] + np.uint64(j + 1) * np.uint64(0xD1B54A32D192ED03))
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            keys = chunk_keys(_matrix(part["sig"]))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(keys.ravel())), pa.array(np.repeat(part["node"].to_numpy(), N_HASH))], ["key", "node"])


def _split_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of rows (key, node, sig) under another chunking, each with the key it splits."""
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            keys = chunk_keys(np.ascontiguousarray(_matrix(part["sig"])[:, _OTHER]))
            with np.errstate(over="ignore"):
                keys = tk.mix(keys + part["key"].to_numpy().view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15))
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(keys.ravel())), pa.array(np.repeat(part["node"].to_numpy(), N_HASH))], ["key", "node"])


def _matrix(col: pa.Array) -> np.ndarray:
    _, data = tk.buffers(col)
    return data.view(np.uint16).reshape(-1, N_HASH) if data.size else np.zeros((0, N_HASH), np.uint16)


def spanning_edges(ids: np.ndarray, sig: np.ndarray, limit: int = MAX_DIST) -> tuple[np.ndarray, np.ndarray]:
    """Edges between signatures within ``limit`` that connect exactly what all such edges connect."""
    left = np.arange(len(ids))
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (sig[left] != sig[x]).sum(axis=1) <= limit
            hit = left[near]
            if len(hit):
                a.append(np.full(len(hit), ids[x]))
                b.append(ids[hit])
                queue.extend(hit)
                left = left[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


#: Groups up to this size are compared all with all in one numpy call; larger ones by search.
_SMALL = 8


def _group_edges(keys: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(cut, len(keys)))
    xs, ys = [], []
    for n in range(2, _SMALL + 1):
        heads = cut[sizes == n]
        for i in range(n):
            for j in range(i + 1, n):
                for at in range(0, len(heads), 1 << 15):
                    p, q = heads[at : at + (1 << 15)] + i, heads[at : at + (1 << 15)] + j
                    ok = (sig[p] != sig[q]).sum(axis=1) <= MAX_DIST
                    xs.append(ids[p[ok]])
                    ys.append(ids[q[ok]])
    for c, n in zip(cut[sizes > _SMALL], sizes[sizes > _SMALL]):
        x, y = spanning_edges(ids[c : c + n], sig[c : c + n])
        xs.append(x)
        ys.append(y)
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(xs), np.concatenate(ys)
    pair = np.unique(np.stack([np.maximum(x, y), np.minimum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pair[:, 0], pair[:, 1]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows may run over several batches."""
    held: list[pa.RecordBatch] = []

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        x, y = _group_edges(t["key"].to_numpy(), t["node"].to_numpy(), _matrix(t["sig"]))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch["key"].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last == 0:
            held.append(batch)
            continue
        yield flush([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield flush(held)
    del held
    tk.give_back()


def _members(docs: DataFrame) -> DataFrame:
    """(doc_id, th, group_id, keep_th) of each document, by doc_id and hash of its text, in a group of two or more; the one of (group_id, keep_th) stays."""
    small_batches(docs.sparkSession)
    signed = checkpoint(signatures(docs).distinct())
    # equal signatures are one node, known by a number, since a doc_id may have several texts
    first = signed.groupBy("sig").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count(F.lit(1)).alias("n"))
    first = checkpoint(first.withColumn("node", F.monotonically_increasing_id()))
    nodes = first.select("node", "sig")
    keys = nodes.mapInArrow(_keys, "key long, node long")
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = keys.join(often, "key")
    hot = often.filter(F.col("c") > HOT)
    if not hot.isEmpty():
        # a bucket of that many is split under another chunking, which meets all its pairs again
        split = keys.join(hot.select("key"), "key").join(nodes, "node").mapInArrow(_split_keys, "key long, node long")
        again = split.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
        met = met.filter(F.col("c") <= HOT).select("key", "node").unionByName(split.join(again.select("key"), "key"))
    rows = met.select("key", "node").join(nodes, "node").select("key", "node", "sig").repartition("key").sortWithinPartitions("key", "node")
    edges = rows.mapInArrow(_verify, "a long, b long")
    groups = connected_components(edges)
    known = first.join(groups, "node", "left").filter("root is not null or n > 1").select("sig", F.coalesce("root", "node").alias("root"), "rep")
    keep = known.groupBy("root").agg(F.min("rep").alias("keep"))
    of = known.join(keep, "root").select("sig", F.col("keep.doc_id").alias("group_id"), F.col("keep.th").alias("keep_th"))
    return signed.join(of, "sig").select("doc_id", "th", "group_id", "keep_th")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, group_id) of each document in a group of two or more; group_id is the least doc_id of the group, the one to keep."""
    return _members(docs).select("doc_id", "group_id").distinct()


def filter_near(docs: DataFrame) -> DataFrame:
    """The documents without all but the first of each group; columns as given."""
    drop = _members(docs).filter("doc_id != group_id or th != keep_th").select(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"))
    plain = docs.select(rest(docs), "text")
    left = plain.join(drop, (rest_field(docs, "doc_id") == F.col("d_id")) & (F.xxhash64("text") == F.col("d_th")), "left_anti")
    return left.select(*unpacked(docs))
