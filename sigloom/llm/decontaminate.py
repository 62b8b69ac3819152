"""Benchmark decontamination: test n-grams against every token window of the corpus.

Words are maximal runs of letters and digits in lower case (ASCII punctuation,
U+0080-U+00BF and U+2000-U+206F separate them). Every window of ``N`` words of
a benchmark text is a test n-gram; a text shorter than that is one n-gram of its
own length if it has ``MIN_WORDS`` words. A document's word is contaminated if it
lies in a window that equals a test n-gram, word by word.

The test n-grams are broadcast, as sorted hashes with their words in one buffer,
while they take at most ``BROADCAST_BYTES`` (measured first). Beyond, a Bloom
filter of their hashes is broadcast, ``BLOOM_BITS`` bits however many they are,
and only windows that pass it are joined with the n-grams by a shuffle. Either
way a hit is verified on the words themselves, and the rows are the same. Texts
of fewer than ``MIN_WORDS`` words are no n-gram: they would match ordinary prose. Contaminated spans are cut out; a document of which
``DOC_SHARE`` or more is contaminated goes as a whole.

Defined results: null and empty texts have no windows and stay; null doc_ids
are a value like others; equal n-grams of several items count for the least
item_id; repeated rows are handled alike, each for itself; an empty benchmark
changes nothing. Columns other than text pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import textkernel as tk
from sigloom.llm.columns import rest, unpacked
from sigloom.llm.graph import checkpoint, small_batches

N = 8
MIN_WORDS = 4
DOC_SHARE = 0.5
BROADCAST_BYTES = 32 << 20
#: 32 MB of bits: 16 for each of 16 million n-grams; with more, more windows pass for nothing.
BLOOM_BITS = 28


def word_breaks(data: np.ndarray) -> np.ndarray:
    """Which bytes separate words."""
    out = tk.IS_BREAK[data]
    two = np.flatnonzero(data[:-1] == 0xC2)
    out[two] = out[two + 1] = True
    three = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, int)
    nxt = data[three + 1] if len(three) else three
    three = three[(nxt == 0x80) | ((nxt == 0x81) & (data[three + 2] < 0xB0))] if len(three) else three
    out[three] = out[three + 1] = out[three + 2] = True
    return out


class NormWords(tk.Words):
    """Normalised words of a column."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.offsets, self.data = tk.buffers(pc.utf8_lower(texts) if lower else texts)
        breaks = word_breaks(self.data)
        flags = np.zeros(256, bool)
        flags[0] = True  # separators become byte 0, all else is inside
        data = np.where(breaks, np.uint8(0), np.maximum(self.data, 1))
        super().__init__(self.offsets, data, flags)

    def words_at(self, i: int, k: int) -> tuple[bytes, ...]:
        return tuple(self.data[self.start[j] : self.end[j]].tobytes() for j in range(i, i + k))


def item_grams(texts: pa.Array) -> list[tuple[int, int, int, tuple[bytes, ...]]]:
    """(hash, row, length, words) of the test n-grams of benchmark texts."""
    words = NormWords(texts)
    counts = np.diff(words.first)
    found = []
    at, h = words.windows(N)
    found += [(int(x), int(words.doc[i]), N, words.words_at(i, N)) for i, x in zip(at, tk.signed(h))]
    for k in range(MIN_WORDS, N):
        rows = np.flatnonzero(counts == k)
        if len(rows):
            x = tk.signed(words.windows(k)[1])
            at = words.windows(k)[0]
            only = np.isin(at, words.first[rows])
            found += [(int(v), int(words.doc[i]), k, words.words_at(i, k)) for i, v in zip(at[only], x[only])]
    return found


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.chunks(batches):
        found = item_grams(part["text"])
        items = part["item_id"].to_pylist()
        cols = [pa.array([g[0] for g in found], pa.int64()), pa.array([items[g[1]] for g in found], pa.int64()), pa.array([g[2] for g in found], pa.int32()), pa.array([b" ".join(g[3]).decode() for g in found], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["h", "item_id", "k", "words"])


def test_grams(benchmark: DataFrame) -> DataFrame:
    """One row for each distinct test n-gram: (h, item_id, k, words), item_id the least that has it."""
    need = benchmark.select("item_id", "text").filter("text is not null")
    grams = need.mapInArrow(_grams, "h long, item_id long, k int, words string")
    return grams.groupBy("h", "k", "words").agg(F.min("item_id").alias("item_id"))


def _spans(hits: np.ndarray, lengths: np.ndarray, items: list) -> list[tuple[int, int, int | None]]:
    """Hits (window starts in a document, sorted) merged to (first word, words, least item)."""
    out: list[list] = []
    for at, k, item in zip(hits.tolist(), lengths.tolist(), items):
        if out and at <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], at + k - out[-1][0])
            out[-1][2] = item if out[-1][2] is None else out[-1][2] if item is None else min(out[-1][2], item)
        else:
            out.append([at, k, item])
    return [tuple(x) for x in out]


_SPAN_TYPE = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("item_id", pa.int64())]))


class Grams:
    """Test n-grams by length: sorted hashes, and the words and item of each."""

    def __init__(self, table: pa.Table):
        self.by: dict[int, tuple[np.ndarray, np.ndarray, bytes, list]] = {}
        k, h = table["k"].to_numpy(), table["h"].to_numpy()
        for n in np.unique(k).tolist():
            rows = np.flatnonzero(k == n)
            part = table.take(pa.array(rows[np.argsort(h[rows], kind="stable")]))
            offsets, data = tk.buffers(part["words"].combine_chunks())
            self.by[n] = (part["h"].to_numpy(), offsets, data.tobytes(), part["item_id"].to_pylist())

    def items(self, k: int, at: int, h: int, words: bytes) -> list:
        """The item of the n-gram of these words, if it is one; ``at`` is where its hash begins."""
        known, offsets, data, items = self.by[k]
        while at < len(known) and known[at] == h:
            if data[offsets[at] : offsets[at + 1]] == words:
                return [items[at]]
            at += 1
        return []


def find_spans(texts: pa.Array, grams: Grams) -> tuple[pa.Array, pa.Array]:
    """Contaminated spans of each text, and its number of words."""
    w = NormWords(texts)
    per: dict[int, list] = {}
    for k, (known, *_) in grams.by.items():
        at, h = w.windows(k)
        if not len(at):
            continue
        h = tk.signed(h)
        pos = np.searchsorted(known, h)
        hit = np.flatnonzero(known[np.minimum(pos, len(known) - 1)] == h)
        for i, p, x in zip(at[hit].tolist(), pos[hit].tolist(), h[hit].tolist()):
            for item in grams.items(k, p, x, b" ".join(w.words_at(i, k))):
                d = int(w.doc[i])
                per.setdefault(d, []).append((i - int(w.first[d]), k, item))
    rows = [None] * len(texts)
    for d, found in per.items():
        found.sort(key=lambda x: x[:2])
        spans = _spans(np.array([x[0] for x in found]), np.array([x[1] for x in found]), [x[2] for x in found])
        rows[d] = [{"first_word": a, "n_words": n, "item_id": item} for a, n, item in spans]
    return pa.array(rows, _SPAN_TYPE), pa.array(np.diff(w.first).astype(np.int32))


def _scanner(bc) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches):
            spans, total = find_spans(part["text"], bc.value)
            yield pa.RecordBatch.from_arrays([*part.columns, spans, total], [*part.schema.names, "spans", "total_words"])

    return run


def _bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The four places of each hash in a Bloom filter."""
    h = h.view(np.uint64)
    step = tk.mix(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([tk.mix(h + np.uint64(j) * step) >> np.uint64(64 - bits) for j in range(4)], axis=1).astype(np.int64)


def _bloom_words(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _bits(batch["h"].to_numpy(), bits).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array(np.left_shift(np.int64(1), at & 63))], ["word", "mask"])

    return run


def bloom(grams: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the hashes: masks are joined before and after the shuffle, so it has at most 2**bits bits anywhere."""
    words = grams.select("h").mapInArrow(_bloom_words(bits), "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out


def _window_rows(bc, lengths: list[int], bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = bc.value
        for part in tk.chunks(batches):
            w = NormWords(part["text"])
            for k in lengths:
                at, h = w.windows(k)
                places = _bits(h, bits)
                hit = np.flatnonzero(((may[places >> 6] >> (places & 63)) & 1).all(axis=1))
                at, h = at[hit], h[hit]
                doc = w.doc[at]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays([part["r1"].take(rows), part["r2"].take(rows), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(np.full(len(at), k, np.int32)), pa.array(tk.signed(h))], ["r1", "r2", "at", "k", "h"])

    return run


def _check_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.chunks(batches):
        w = NormWords(part["text"])
        rows = []
        for d, hits in enumerate(part["__hits"].to_pylist()):
            ok = [h for h in hits or [] if b" ".join(w.words_at(w.first[d] + h["at"], h["k"])).decode() == h["words"]]
            ok.sort(key=lambda x: (x["at"], x["k"]))
            spans = _spans(np.array([x["at"] for x in ok]), np.array([x["k"] for x in ok]), [x["item_id"] for x in ok])
            rows.append([{"first_word": a, "n_words": n, "item_id": i} for a, n, i in spans] or None)
        names = [n for n in part.schema.names if n != "__hits"]
        yield pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(rows, _SPAN_TYPE), pa.array(np.diff(w.first).astype(np.int32))], [*names, "spans", "total_words"])


_ADDED = ", spans array<struct<first_word:int,n_words:int,item_id:long>>, total_words int"


def _with(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + _ADDED


def scan(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """docs with ``spans`` (null if clean) and ``total_words``; docs needs the column text only, and none of these names."""
    return _scan(docs, benchmark, limit, iter, _with(docs))


def _scan(docs: DataFrame, benchmark: DataFrame, limit: int, then: Callable, schema) -> DataFrame:
    """``then`` over the batches of :func:`scan`, in the same Python worker.

    As a mapInArrow of its own it would take a second worker for each running
    task; workers live on, and an executor would hold twice as many from then on.
    """
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    grams = checkpoint(test_grams(benchmark))
    size = grams.agg(F.coalesce(F.sum(F.octet_length("words") + 24), F.lit(0))).first()[0]
    if size <= limit:
        found_by = _scanner(context.broadcast(Grams(grams.toArrow())))
        return docs.mapInArrow(lambda batches: then(found_by(batches)), schema)
    lengths = sorted(r.k for r in grams.select("k").distinct().collect())  # MIN_WORDS..N at most
    may = context.broadcast(bloom(grams, BLOOM_BITS))
    # equal texts share their hits; those without words have none, and none of their own keys
    two = (F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))
    texts = docs.select(two[0].alias("r1"), two[1].alias("r2"), "text").filter("text != ''")
    windows = texts.mapInArrow(_window_rows(may, lengths, BLOOM_BITS), "r1 long, r2 long, at int, k int, h long")
    found = windows.join(grams, ["h", "k"]).groupBy("r1", "r2").agg(F.collect_set(F.struct("at", "k", "item_id", "words")).alias("__hits"))
    found = found.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), "__hits")
    alone = F.xxhash64(F.monotonically_increasing_id())
    keyed = docs.withColumn("__k1", F.when(F.col("text") != "", two[0]).otherwise(alone)).withColumn("__k2", two[1])
    joined = keyed.join(found, (F.col("__k1") == F.col("__r1")) & (F.col("__k2") == F.col("__r2")), "left")
    return joined.select(*docs.columns, "__hits").mapInArrow(lambda batches: then(_check_hits(batches)), schema)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each contaminated span: doc_id, item_id, first_word, n_words, total_words, action (span or document)."""
    found = scan(docs.select("doc_id", "text"), benchmark).filter("spans is not null").select("doc_id", "spans", "total_words")
    share = F.aggregate("spans", F.lit(0), lambda a, s: a + s["n_words"]) / F.col("total_words")
    rows = found.select("doc_id", "total_words", F.when(share >= DOC_SHARE, "document").otherwise("span").alias("action"), F.explode("spans").alias("s"))
    return rows.select("doc_id", "s.item_id", "s.first_word", "s.n_words", "total_words", "action")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.chunks(batches):
        spans = part["spans"]
        hit = np.flatnonzero(pc.is_valid(spans).to_numpy(zero_copy_only=False))
        new = part["text"]
        keep = np.ones(part.num_rows, bool)
        if len(hit):
            texts = new.take(pa.array(hit))
            w = NormWords(texts, lower=False)
            out = new.to_pylist()
            for d, (row, found) in enumerate(zip(hit, spans.take(pa.array(hit)).to_pylist())):
                first, last = w.first[d], w.first[d + 1]
                if sum(s["n_words"] for s in found) >= DOC_SHARE * (last - first):
                    keep[row] = False
                    continue
                at, pieces = w.offsets[d], []
                for s in found:
                    a = first + s["first_word"]
                    pieces.append(w.data[at : w.start[a]])
                    at = w.end[a + s["n_words"] - 1]
                    # white space stood on both sides: one side is enough
                    if at < w.offsets[d + 1] and tk.IS_SPACE[w.data[at]] and (w.start[a] == w.offsets[d] or tk.IS_SPACE[w.data[w.start[a] - 1]]):
                        at += 1
                pieces.append(w.data[at : w.offsets[d + 1]])
                out[row] = np.concatenate(pieces).tobytes().decode()
            new = pa.array(out, pa.string())
        batch = pa.RecordBatch.from_arrays([part["rest"], new.cast(pa.string())], ["rest", "text"])
        yield batch.filter(pa.array(keep))


def decontaminate(docs: DataFrame, benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The documents with contaminated spans cut out and contaminated documents removed; columns as given."""
    plain = docs.select(rest(docs), "text")
    return _scan(plain, benchmark, limit, _cut, plain.schema).select(*unpacked(docs))
