"""Suffix-array dedup: passages of ``MIN_WORDS`` words or more that occurred before are removed.

Words are runs of characters other than ASCII white space. The corpus is read in
order of (doc_id, text); a word goes if it lies in a window of ``MIN_WORDS``
words that occurs earlier, in another document or in the same one. So the first
copy of each passage stays whole and every later one goes.

A suffix array of the whole corpus can't be built by shards, but it needn't be:

1. Documents with the same words as an earlier one are found by one aggregate on
   a fingerprint; they are later copies as a whole.
2. Winnowing picks anchors: the ``GRAM``-word windows whose hash is least within
   ``MIN_WORDS - GRAM + 1`` neighbouring ones. Every passage of ``MIN_WORDS``
   words holds one, at the same place in each copy. Only 20-byte anchors are
   shuffled, about one for 20 words, and those seen once end there.
3. Around the anchors that repeat, snippets (word hashes, ``MIN_WORDS`` to the
   right and what a passage may reach to the left) are grouped by anchor.
4. In each group of snippets a suffix array is built by prefix doubling; for each
   suffix the previous and the next smaller position in suffix order are its
   only candidates for the longest earlier match, and the longer of the two
   common prefixes is its entry of the longest-previous-factor array. Following
   the sources of entries of ``MIN_WORDS`` or more from one to the next leads to
   the first place of the suffix's first ``MIN_WORDS`` words: that is the source
   a span is given, so it depends on the corpus alone.
5. An anchor with more than ``HOT`` snippets is split by its longest grams, the
   ``MIN_WORDS``-word windows around it: equal ones are collapsed to the first by
   an aggregate with map-side combine, and what that leaves of each is a single
   snippet without any earlier match. So no task holds more than ``HOT`` snippets
   of a group, and the spans and their sources are the same by either way. A
   document lists each window once, however many such anchors it holds, and the
   equal windows of a run of one word in one row.
6. Entries of ``MIN_WORDS`` or more are spans to remove; they are merged by
   document.

Defined results: null and empty texts have no passages and stay; a document of
fewer than ``MIN_WORDS`` words is never touched, even if repeated; among equal
texts the least doc_id is the first (a null doc_id comes before all), and rows
that agree in doc_id and text are one document and share its fate; a document
whose every word goes is removed; very long texts are read whole. Extra columns
pass through, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigloom.llm import textkernel as tk
from sigloom.llm.columns import rest, rest_field, unpacked
from sigloom.llm.graph import checkpoint, release, small_batches

MIN_WORDS = 50
GRAM = 10
#: Windows of anchors: any MIN_WORDS words hold this many grams.
REACH = MIN_WORDS - GRAM + 1
#: Words a kernel call handles at once, whole groups at least.
_BLOCK = 1 << 17
#: Snippets of an anchor beyond which it is split by its windows.
HOT = 8192
#: Suffixes that are compared at once, and snippets that are hashed at once.
_STEP = 1 << 16
_NULL_ID = -(1 << 63)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and hash of each anchor; none in documents of fewer than MIN_WORDS words."""
    at, h = words.windows(GRAM)
    if len(at) < REACH:
        return at[:0], h[:0]
    doc = words.doc[at]
    # the least 64-bit hash of a window is one gram's, except where grams repeat: then each copy counts
    least = sliding_min(h, REACH)
    whole = doc[: len(least)] == doc[REACH - 1 :]
    least = np.where(whole, least, np.uint64(0xFFFFFFFFFFFFFFFF))
    # a gram is picked if it equals the least of any window that holds it
    pad = np.full(REACH - 1, 0, np.uint64)
    best = np.where(whole, least, 0)
    top = _sliding_max(np.concatenate([pad, best, pad]), REACH)
    pick = np.flatnonzero(top == h)
    at, h, doc = at[pick], h[pick], doc[pick]
    if not len(at):
        return at, h
    # Where a gram repeats at a distance below its length, the text is periodic and each period has an anchor. In the
    # depth of such a run one place stands for another, so there one for REACH - GRAM words is enough.
    gap = np.diff(at)
    goes_on = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (gap <= GRAM)
    run = np.concatenate([[0], np.cumsum(~goes_on)])
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    start, end = at[heads][run], at[np.append(heads[1:], len(at)) - 1][run]
    mark = (at - start) // (REACH - GRAM)
    keep = (at - start < REACH) | (end - at < REACH)
    keep[1:] |= mark[1:] != mark[:-1]
    return at[keep], h[keep]


def _sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return ~sliding_min(~values, width)


def _fingerprint(words: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    a, b = words.first[:-1], words.first[1:]
    if not len(words):
        return np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    one = words.span_hash(a, b)
    with np.errstate(over="ignore"):
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(words.hash ^ np.uint64(0x5851F42D4C957F2D)) * tk.powers(0x9FB21C651E98DF25, len(words)))])
        inverse = tk.powers(pow(0x9FB21C651E98DF25, -1, 1 << 64), len(words) + 1)
        two = tk.mix((other[b] - other[a]) * inverse[a])
    return one, two


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of MIN_WORDS words or more: fingerprints and number of words."""
    for part in tk.chunks(batches):
        words = tk.Words(*tk.buffers(part["text"]))
        n = np.diff(words.first)
        rows = np.flatnonzero(n >= MIN_WORDS)
        one, two = _fingerprint(words)
        pick = pa.array(rows)
        cols = [part["doc_id"].take(pick), part["th"].take(pick), pa.array(tk.signed(one[rows])), pa.array(tk.signed(two[rows])), pa.array(n[rows].astype(np.int32))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "f1", "f2", "n"])


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of MIN_WORDS words or more: fingerprints, anchors as (hash, word) pairs."""
    for part in tk.chunks(batches):
        words = tk.Words(*tk.buffers(part["text"]))
        n = np.diff(words.first)
        rows = np.flatnonzero(n >= MIN_WORDS)
        one, two = _fingerprint(words)
        at, h = anchors(words)
        bound = np.searchsorted(words.doc[at], np.append(rows, len(n)))
        place = (at - words.first[words.doc[at]]).astype(np.int32)
        pick = pa.array(rows)
        off = pa.array(bound.astype(np.int32))
        cols = [part["doc_id"].take(pick), part["th"].take(pick), pa.array(tk.signed(one[rows])), pa.array(tk.signed(two[rows]))]
        yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(off, pa.array(tk.signed(h))), pa.ListArray.from_arrays(off, pa.array(place))], ["doc_id", "th", "f1", "f2", "h", "at"])


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around each wanted anchor of a document, as 64-bit hashes."""
    for part in tk.chunks(batches):
        words = tk.Words(*tk.buffers(part["text"]))
        want = part["want"]
        counts = pc.list_value_length(want).to_numpy(zero_copy_only=False)
        flat = want.flatten()
        row = np.repeat(np.arange(part.num_rows), counts)
        at = flat.field("at").to_numpy().astype(np.int64)
        total = np.diff(words.first)[row]
        lo = np.maximum(at - (REACH - 1), 0)
        hi = np.minimum(at + MIN_WORDS, total)
        size = hi - lo
        step = max(1, (1 << 20) // (MIN_WORDS + REACH))
        for a in range(0, len(at), step):
            b = min(len(at), a + step)
            ends = np.cumsum(size[a:b])
            from_ = words.first[row[a:b]] + lo[a:b]
            values = words.hash[np.arange(ends[-1]) + np.repeat(from_ - (ends - size[a:b]), size[a:b])]
            raw = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(np.concatenate([[0], ends * 8]).astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])
            pick = pa.array(row[a:b])
            yield pa.RecordBatch.from_arrays([flat.field("h").slice(a, b - a), part["did"].take(pick), part["th"].take(pick), pa.array(lo[a:b].astype(np.int32)), pa.array(total[a:b].astype(np.int32)), raw], ["h", "did", "th", "lo", "total", "words"])


def suffix_levels(symbols: np.ndarray, depth: int) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4 .. >= depth symbols (prefix doubling); beyond the end is less than all."""
    _, rank = np.unique(symbols, return_inverse=True)
    levels, width = [rank.astype(np.int32) + np.int32(1)], 1
    while width < depth:
        r = levels[-1]
        key = r.astype(np.uint64) << np.uint64(32)
        if width < len(r):
            key[: len(r) - width] |= r[width:].astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.empty(len(r), np.int32)
        new[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]]), dtype=np.int32)
        levels.append(new)
        width *= 2
    return levels


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the last smaller value before each (-1 if none), by jumping over what is known not to be smaller."""
    n = len(values)
    out = np.arange(-1, n - 1, dtype=np.int32)
    live = np.flatnonzero(out >= 0)
    while len(live):
        live = live[values[out[live]] >= values[live]]
        out[live] = out[out[live]]
        live = live[out[live] >= 0]
    return out


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of the suffixes a and b, no further than their snippets' ends."""
    most = np.minimum(ends[a] - a, ends[b] - b)
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        for _ in range(2 if k == len(levels) - 1 else 1):
            fits = got + (1 << k) <= most
            x, y = np.where(fits, a + got, 0), np.where(fits, b + got, 0)
            got += np.where(fits & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return got


def longest_previous(symbols: np.ndarray, position: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, index) of the longest earlier match of each suffix, lengths up to the snippets' ends.

    ``position`` is the order of the suffixes in the corpus; one place may stand
    in several snippets. ``ends`` is the end of each suffix's snippet.
    """
    levels = suffix_levels(symbols, depth)
    order = np.lexsort((position, levels[-1]))
    p = position[order]
    length, source = np.zeros(len(p), np.int32), np.full(len(p), -1, np.int32)
    for back in (False, True):
        other = len(p) - 1 - nearest_smaller(p[::-1])[::-1] if back else nearest_smaller(p)
        at = np.flatnonzero((other >= 0) & (other < len(p)))
        for some in (at[i : i + _STEP] for i in range(0, len(at), _STEP)):
            a, b = order[some], order[other[some]]
            n = common_prefix(levels, a, b, ends)
            better = n > length[a]
            length[a[better]], source[a[better]] = n[better], b[better]
    return length, source


def first_places(length: np.ndarray, source: np.ndarray, least: int) -> np.ndarray:
    """For each suffix the first one with its first ``least`` symbols: sources are followed while entries reach that length."""
    root = np.where(length >= least, source, np.arange(len(length), dtype=source.dtype))
    while True:
        further = root[root]
        if (further == root).all():
            return root
        root = further


_FOUND = ["did", "th", "total", "start", "n", "src", "src_at"]


def _flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The spans of whole groups of snippets."""
    t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    offsets, data = tk.buffers(t["words"])
    h = data.view(np.uint64)
    bound = offsets // 8
    did, th, total = (t[c].to_numpy() for c in ("did", "th", "total"))
    lo, size = t["lo"].to_numpy().astype(np.int64), np.diff(bound)
    _, rank = np.unique(np.stack([did, th], axis=1), axis=0, return_inverse=True)
    # of equal snippets the first speaks for all: the others are matches from end to end
    one = np.concatenate([tk.row_hash(h[b[0] : b[-1]], b[:-1] - b[0], b[1:] - b[0]) for b in (bound[i : i + _STEP // MIN_WORDS + 1] for i in range(0, len(size), _STEP // MIN_WORDS))])
    order = np.lexsort((lo, rank, one))
    new = np.concatenate([[True], one[order][1:] != one[order][:-1]])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (rank[order] != rank[lead]) | (lo[order] != lo[lead])
    later &= size[order] >= MIN_WORDS
    copies, firsts = order[later], lead[later]
    rows = np.sort(order[new])
    n = len(rows)
    size_ = size[rows]
    at = np.cumsum(size_) - size_
    picked = h[np.arange(size_.sum()) + np.repeat(bound[rows] - at, size_)]
    # a separator after each snippet, unlike all else, ends every match
    dense = np.unique(picked, return_inverse=True)[1].astype(np.int32)
    del picked
    begin = at + np.arange(n)
    symbols = np.empty(len(dense) + n, np.int32)
    symbols[np.arange(len(dense)) + np.repeat(np.arange(n), size_)] = dense + np.int32(n)
    symbols[begin + size_] = np.arange(n)
    del dense
    owner = np.repeat(np.arange(n, dtype=np.int32), size_ + 1)
    place = np.repeat(lo[rows] - begin, size_ + 1) + np.arange(len(symbols))
    position = np.repeat(rank[rows] * (int(place.max()) + 1), size_ + 1) + place
    place = place.astype(np.int32)
    length, source = longest_previous(symbols, position, np.repeat((begin + size_).astype(np.int32), size_ + 1), MIN_WORDS)
    del symbols, position
    root = first_places(length, source, MIN_WORDS)
    hit = np.flatnonzero(length >= MIN_WORDS)
    del length, source
    from_, to = rows[owner[hit]], rows[owner[root[hit]]]
    a, b = place[hit], place[root[hit]]
    order = np.lexsort((a, rank[from_]))
    from_, to, a, b = (c[order] for c in (from_, to, a, b))
    d, s = rank[from_], rank[to]
    once = np.ones(len(d), bool)
    once[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1])
    from_, to, a, b, d, s = (c[once] for c in (from_, to, a, b, d, s))
    # neighbouring starts with one source are one match
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (a[1:] != a[:-1] + 1) | (b[1:] != b[:-1] + 1)
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(d))) + MIN_WORDS - 1
    # a copy's source is that of the first words of the snippet it repeats
    where = np.zeros(len(size), np.int64)
    where[rows] = begin
    origin = root[where[firsts]]
    from_, to = np.concatenate([from_[heads], copies]), np.concatenate([to[heads], rows[owner[origin]]])
    start, source_at = np.concatenate([a[heads], lo[copies]]), np.concatenate([b[heads], place[origin]])
    span = np.concatenate([runs, size[copies]])
    cols = (did[from_], th[from_], total[from_], start.astype(np.int32), span.astype(np.int32), did[to], source_at.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], _FOUND)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor hash; spans (did, start, n, src, src_at) with an earlier match of MIN_WORDS or more.

    Whole groups are handled together, as many as fill a block.
    """
    held: list[pa.RecordBatch] = []
    words = 0
    for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
        held.append(batch)
        words += batch["words"].nbytes // 8
        if words < _BLOCK:
            continue
        keys = batch["h"].to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (len(held) > 1 and held[-2]["h"][-1].as_py() != int(keys[0])):
            yield _flush([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
            words = held[0]["words"].nbytes // 8
    if held:
        yield _flush(held)
    del held
    tk.give_back()


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of MIN_WORDS words around the wanted anchors of a document, each once, by least gram and hash.

    A row stands for the ``k`` windows from ``start`` on, which are equal: the text is one word there.
    """
    for part in tk.chunks(batches):
        words = tk.Words(*tk.buffers(part["text"]))
        want = part["want"]
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(want).to_numpy(zero_copy_only=False))
        at = want.flatten().field("at").to_numpy().astype(np.int64)
        lo = np.maximum(at - (REACH - 1), 0)
        hi = np.minimum(at, np.diff(words.first)[row] - MIN_WORDS)
        some = hi >= lo
        lo, hi = (words.first[row] + lo)[some], (words.first[row] + hi)[some]
        cover = np.bincount(lo, minlength=len(words) + 1) - np.bincount(hi + 1, minlength=len(words) + 1)
        start = np.flatnonzero(np.cumsum(cover) > 0)
        grams = np.full(len(words), 0xFFFFFFFFFFFFFFFF, np.uint64)
        first, h = words.windows(GRAM)
        grams[first] = h
        least = sliding_min(grams, REACH)
        for a in range(0, len(start), 1 << 17):
            at = start[a : a + (1 << 17)]
            w, doc = words.span_hash(at, at + MIN_WORDS), words.doc[at]
            new = np.ones(len(at), bool)
            new[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(new)
            k = np.diff(np.append(heads, len(at)))
            at, pick = at[heads], pa.array(doc[heads])
            place = at - words.first[doc[heads]]
            cols = [pa.array(tk.signed(least[at])), *(part[c].take(pick) for c in ("did", "th")), pa.array(np.diff(words.first)[doc[heads]].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(place.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(tk.signed(w[heads]))], ["h", "did", "th", "total", "start", "k", "w"])


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter("text is not null")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start_word, n_words, src_doc_id, src_word, total_words): matches with earlier copies; they may overlap.

    th is xxhash64 of the text. A document whose words all stand in an earlier
    one is one span, its source the first such document; the source of any other
    span is the first place of its first MIN_WORDS words.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    need = _numbered(docs)
    # of documents with the same words the first speaks for all; equal ones meet before the shuffle
    lone = need.mapInArrow(_survey, "doc_id long, th long, f1 long, f2 long, h array<long>, at array<int>").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "th", "h", "at")).alias("m"))
    lone = checkpoint(lone.select("f1", "f2", "m.doc_id", "m.th", "m.h", "m.at"))
    first = lone.select("f1", "f2", F.struct("doc_id", "th").alias("first"))
    again = need.mapInArrow(_prints, "doc_id long, th long, f1 long, f2 long, n int").join(first, ["f1", "f2"]).filter(F.col("first") != F.struct("doc_id", "th"))
    whole = again.select("doc_id", "th", F.lit(0).alias("start_word"), F.col("n").alias("n_words"), F.col("first.doc_id").alias("src_doc_id"), F.lit(0).alias("src_word"), F.col("n").alias("total_words")).distinct()
    each = lone.select("doc_id", "th", F.explode(F.arrays_zip("h", "at")).alias("a")).select("doc_id", "th", "a.h", "a.at")
    often = checkpoint(each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    release(spark)

    met = each.join(often, "h").select("doc_id", "th", F.struct("h", "at", (F.col("c") > HOT).alias("hot")).alias("a"))
    want = met.groupBy("doc_id", "th").agg(F.collect_list("a").alias("want"))
    ids = want.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "want")
    joined = need.join(ids, need["doc_id"].eqNullSafe(ids["w_id"]) & (need["th"] == ids["w_th"]))

    def around(hot: bool) -> DataFrame:
        """The texts with some of the anchors of one kind, and which; both kinds read one shuffle."""
        wanted = F.filter("want", lambda a: a["hot"] == F.lit(hot))
        return joined.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("did"), "th", "text", wanted.alias("want")).filter(F.size("want") > 0)

    snip = around(False).mapInArrow(_snippets, "h long, did long, th long, lo int, total int, words binary")
    found = snip.repartition("h").sortWithinPartitions("h", "did", "th", "lo").mapInArrow(_repeats, "did long, th long, total int, start int, n int, src long, src_at int")
    if not often.filter(F.col("c") > HOT).isEmpty():
        near = around(True).mapInArrow(_windows, "h long, did long, th long, total int, start int, k int, w long")
        place = F.struct("did", "th", "start")
        least = near.groupBy("h", "w").agg(F.min(place).alias("first"), F.sum("k").alias("c")).filter("c > 1")
        # of the first row only the first window stays
        listed = near.join(least.drop("c"), ["h", "w"]).withColumn("skip", (place == F.col("first")).cast("int"))
        later = listed.filter("k > skip").select("did", "th", "total", (F.col("start") + F.col("skip")).alias("start"), (F.col("k") - F.col("skip") + F.lit(MIN_WORDS - 1)).alias("n"), F.col("first.did").alias("src"), F.col("first.start").alias("src_at"))
        found = found.unionByName(later)
    found = checkpoint(found)
    release(spark)
    real = lambda c: F.when(F.col(c) != F.lit(_NULL_ID), F.col(c))
    near = found.select(real("did").alias("doc_id"), "th", F.col("start").alias("start_word"), F.col("n").alias("n_words"), real("src").alias("src_doc_id"), F.col("src_at").alias("src_word"), F.col("total").alias("total_words"))
    return whole.unionByName(near)


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, n_words, src_doc_id, src_word, total_words): the spans to remove, merged where they touch.

    src is the source of a span's first words; if it has several, the least.
    """
    found = spans(docs).withColumn("end", F.col("start_word") + F.col("n_words"))
    per = Window.partitionBy("doc_id", "th").orderBy("start_word", F.desc("end"))
    reach = F.max("end").over(per.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", F.when(reach >= F.col("start_word"), 0).otherwise(1))
    found = found.withColumn("island", F.sum("new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    first = lambda c: F.min_by(c, F.struct("start_word", "src_doc_id", "src_word"))
    out = found.groupBy("doc_id", "th", "island").agg(F.min("start_word").alias("start_word"), F.max("end").alias("end"), first("src_doc_id").alias("src_doc_id"), first("src_word").alias("src_word"), F.max("total_words").alias("total_words"))
    return out.select("doc_id", "th", "start_word", (F.col("end") - F.col("start_word")).cast("int").alias("n_words"), "src_doc_id", "src_word", "total_words")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.chunks(batches):
        gone = part["gone"]
        hit = np.flatnonzero(np.asarray(pc.is_valid(gone)))
        new, keep = part["text"], np.ones(part.num_rows, bool)
        if len(hit):
            offsets, data = tk.buffers(new.take(pa.array(hit)))
            words = tk.Words(offsets, data)
            out = new.to_pylist()
            for d, (row, found) in enumerate(zip(hit, gone.take(pa.array(hit)).to_pylist())):
                first, last = words.first[d], words.first[d + 1]
                if sum(s["n_words"] for s in found) == last - first:
                    keep[row] = False
                    continue
                at, pieces = offsets[d], []
                for s in sorted(found, key=lambda x: x["start_word"]):
                    a, b = first + s["start_word"], first + s["start_word"] + s["n_words"]
                    pieces.append(data[at : words.start[a]])
                    at = words.start[b] if b < last else offsets[d + 1]
                pieces.append(data[at : offsets[d + 1]])
                out[row] = np.concatenate(pieces).tobytes().decode()
            new = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([part["rest"], new.cast(pa.string())], ["rest", "text"]).filter(pa.array(keep))


def dedup(docs: DataFrame) -> DataFrame:
    """The documents without the words of :func:`repeats`; columns as given."""
    gone = repeats(docs).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start_word", "n_words")).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th"), "gone")
    plain = docs.select(rest(docs), "text")
    joined = plain.join(gone, rest_field(docs, "doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("g_th")), "left").select("rest", "text", "gone")
    out = joined.mapInArrow(_cut, plain.schema)
    return out.select(*unpacked(docs))
