"""Fuzzy line dedup: one line of each group of similar lines stays in the corpus.

1. Every line that is not blank gets two 64-bit hashes and ``BANDS`` band
   hashes of a MinHash signature over its ``SHINGLE``-character shingles (lower
   case). A task that meets a line again knows it for a repeat; one shuffle of
   the others on the line hashes finds all exact repeats. The first occurrence by
   (doc_id, line number) speaks for all.
2. Lines that share a band are candidates (``BANDS`` bands of ``ROWS`` rows: a
   pair at the threshold is met with probability 0.96, at 0.8 with 0.997).
   Buckets with the same members are looked at once.
3. In each bucket the exact Jaccard similarity of shingle sets decides, by
   breadth-first search, so that the edges connect exactly what all pairs at or
   over ``THRESHOLD`` in the bucket connect; there is no cap on its size. One of
   more than ``HOT`` lines is split first, by the shingles that lines so similar
   must share (a prefix filter, the rarest shingles first): no pair is lost.
4. Distributed union-find joins the edges; the first occurrence in each
   component stays, its other lines go.

Only hashes cross the network for lines without a candidate; texts cross it as
zstandard frames, and documents without a removed line are not rebuilt.

Defined results: null and empty texts stay as they are; blank lines are never
removed; lines shorter than a shingle are one shingle; a document that loses
its every line that is not blank is removed; rows with equal doc_id and text
are one document and share its fate (a null doc_id is a value like others; as
first occurrence it comes before numbers); equal texts tie by doc_id, then line
number. Columns other than text pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigloom.llm import textkernel as tk
from sigloom.llm.columns import rest, rest_field, unpacked
from sigloom.llm.graph import checkpoint, connected_components, release, small_batches

SHINGLE = 8
BANDS = 8
ROWS = 3
THRESHOLD = 0.7
_MULTS = tk.hash_params(BANDS * ROWS, 2)
#: Lines of a bucket beyond which it is split by the shingles its lines may share.
HOT = 50_000
#: Buckets up to this size are compared all with all at once; larger ones by search.
_SMALL = 8
#: Bytes of lines whose small buckets are compared at once.
_BLOCK_BYTES = 1 << 19
#: Bytes of lines of hot buckets whose shingles are listed at once.
CHUNK_HOT = 1 << 17
_TAG = 20  # bits for the number of a line or pair beside its shingle hashes


def _mask_blank(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which lines aren't blank; lines are in order."""
    out = np.zeros(len(start), bool)
    some = np.flatnonzero(end > start)
    if len(some):
        # line breaks between the lines count as white space
        out[some] = np.logical_or.reduceat(~tk.IS_SPACE[data], start[some])
    return out


def shingles(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each span's character shingles (repeats included), and where each span's begin."""
    points, index = tk.characters(data)
    a, b = index[start], index[end]
    n = len(points)
    with np.errstate(over="ignore"):
        h = points.astype(np.uint64) + np.uint64(1)
        base, width = np.uint64(0xC2B2AE3D27D4EB4F), 1
        while width < SHINGLE:
            wider = h * base
            if width < n:
                wider[:-width] += h[width:]
            h = wider
            base = base * base
            width *= 2
    counts = np.maximum(b - a - SHINGLE + 1, 1)
    starts = np.cumsum(counts) - counts
    at = np.arange(counts.sum()) + np.repeat(a - starts, counts)
    values = h[np.minimum(at, max(n - 1, 0))]
    with np.errstate(over="ignore"):
        values *= np.uint64(0xFF51AFD7ED558CCD)  # the upper bits are used, and those depend on all
        values ^= values >> np.uint64(32)
    short = np.flatnonzero(b - a < SHINGLE)
    if len(short):
        values[starts[short]] = tk.hash_spans(data, start[short], end[short])
    return values, starts


class _Seen:
    """First places of the lines that a task has met, as far as its table holds them.

    A line that stands after a known place of the same line is a repeat for
    certain and needs no shuffle to find that out. So a line that a third of all
    documents hold goes to its group once a task, not once a document.
    """

    BITS = 17

    def __init__(self):
        n = 1 << self.BITS
        self.h = np.zeros((n, 2), np.uint64)
        self.place = np.zeros((n, 3), np.int64)

    def repeats(self, h1: np.ndarray, h2: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which lines go to their groups, which are repeats for certain); a place met twice is in neither."""
        n = len(h1)
        order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], h2, h1))
        a, b, p = h1[order], h2[order], place[order]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        again = ~new
        again[1:] &= (p[1:] != p[:-1]).any(axis=1)
        heads = np.flatnonzero(new)
        slot = (a[heads] >> np.uint64(64 - self.BITS)).astype(np.int64)
        known = (self.h[slot, 0] == a[heads]) & (self.h[slot, 1] == b[heads])
        had, mine = self.place[slot], p[heads]
        differ = had != mine
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), 0)
        row = np.arange(len(heads))
        same = known & ~differ.any(axis=1)
        later = known & (had[row, first] < mine[row, first])
        keep = ~later
        self.h[slot[keep], 0], self.h[slot[keep], 1], self.place[slot[keep]] = a[heads][keep], b[heads][keep], mine[keep]
        lead = np.zeros(n, bool)
        lead[order[heads[~same & ~later]]] = True
        sure = np.zeros(n, bool)
        sure[order[np.flatnonzero(again)]] = True
        sure[order[heads[later]]] = True
        return lead, sure


_NULL_ID = -(1 << 63)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a task: those that go to their groups, with bands, and repeats for certain, without and under keys of their own."""
    seen = _Seen()
    for part in tk.chunks(batches):
        raw = part["text"]
        offsets, data = tk.buffers(raw)
        doc, number, start, end = tk.line_spans(offsets, data)
        full = _mask_blank(data, start, end)
        doc, number, start, end = doc[full], number[full], start[full], end[full]
        h1 = tk.poly_spans(data, start, end, 11)
        h2 = np.zeros(len(h1), np.uint64)
        low_off, low = tk.buffers(pc.utf8_lower(raw))
        _, _, ls, le = tk.line_spans(low_off, low)
        bands = np.zeros((len(h1), BANDS), np.uint64)
        if len(h1):
            values, starts = shingles(low, ls[full], le[full])
            # a second hash beside the first, which tells places and capitals: the sum of the mixed shingles
            with np.errstate(over="ignore"):
                h2 = tk.mix(np.add.reduceat(values, starts) * np.uint64(0x9FB21C651E98DF25))
            sig = tk.min_hashes((values >> np.uint64(32)).astype(np.uint32), starts, _MULTS).reshape(-1, BANDS, ROWS)
            with np.errstate(over="ignore"):
                bands[:] = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for r in range(ROWS):
                    bands = tk.mix(bands * np.uint64(31) + sig[:, :, r])
        ids = pc.fill_null(part["doc_id"], _NULL_ID).to_numpy()
        th = part["th"].to_numpy()
        lead, sure = seen.repeats(h1, h2, np.stack([ids[doc], th[doc], number], axis=1))
        # a repeat's key is its place, so that equal lines don't meet in one task
        own = tk.mix(th[doc].view(np.uint64) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h1[sure] = own[sure]
        pick = np.flatnonzero(lead | sure)
        if not len(pick):
            continue
        sizes = np.where(lead[pick], 8 * BANDS, 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        held = np.flatnonzero(lead[pick])
        packed = pa.Array.from_buffers(pa.binary(), len(pick), [pa.py_buffer(np.packbits(lead[pick], bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(bands[pick[held]]).tobytes())])
        rows = pa.array(doc[pick])
        yield pa.RecordBatch.from_arrays(
            [pa.array(tk.signed(h1[pick])), pa.array(tk.signed(h2[pick])), part["doc_id"].take(rows), part["th"].take(rows), pa.array(number[pick].astype(np.int32)), packed],
            ["h1", "h2", "doc_id", "th", "line", "bands"],
        )


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, data = tk.buffers(batch["bands"])
        keys = data.view(np.int64)
        ids = np.repeat(batch["lid"].to_numpy(), BANDS)
        for at in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)]), pa.array(ids[at : at + (1 << 17)])], ["key", "lid"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wanted lines of each document, in lower case; ``want`` holds (line, lid) pairs."""
    for part in tk.unzip_column(batches):
        offsets, data = tk.buffers(part["text"])
        doc, number, start, end = tk.line_spans(offsets, data)
        want = part["want"]
        counts = pc.list_value_length(want).to_numpy(zero_copy_only=False)
        flat = want.flatten()
        row = np.repeat(np.arange(len(offsets) - 1), counts)
        at = np.searchsorted(doc, row) + flat.field("line").to_numpy()
        texts = [data[a:b].tobytes() for a, b in zip(start[at], end[at])]
        yield pa.RecordBatch.from_arrays([flat.field("lid"), pc.utf8_lower(pa.array(texts, pa.binary()).cast(pa.string()))], ["lid", "line"])


_CACHE_BYTES = 1 << 25


class _Sets:
    """Distinct shingles of the lines of a bucket; kept if small, else made again for each use."""

    def __init__(self, texts: pa.Array):
        self.offsets, self.data = tk.buffers(texts)
        small = len(self.data) <= _CACHE_BYTES
        self.kept = self._make(np.arange(len(texts))) if small else None

    def _make(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, end = self.offsets[rows], self.offsets[rows + 1]
        total = int((end - start).sum())
        if total == len(self.data):
            data, s, e = self.data, start, end
        else:
            data = np.concatenate([self.data[a:b] for a, b in zip(start, end)]) if total else self.data[:0]
            e = np.cumsum(end - start)
            s = e - (end - start)
        values, starts = shingles(data, s, e)
        group = np.repeat(np.arange(len(rows)), np.diff(np.append(starts, len(values))))
        values >>= np.uint64(_TAG)  # 44 bits tell the shingles of two lines apart
        if len(rows) < 1 << _TAG:
            both = np.sort((group.astype(np.uint64) << np.uint64(64 - _TAG)) | values)
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
            values, group = both & np.uint64((1 << (64 - _TAG)) - 1), (both >> np.uint64(64 - _TAG)).astype(np.int64)
        else:
            order = np.lexsort((values, group))
            values, group = values[order], group[order]
            new = np.concatenate([[True], (values[1:] != values[:-1]) | (group[1:] != group[:-1])])
            values, group = values[new], group[new]
        return values, np.searchsorted(group, np.arange(len(rows) + 1))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sets of some rows, at once."""
        if self.kept:
            return next(self.blocks(rows))
        return (rows, *self._make(rows))

    def blocks(self, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if self.kept:
            values, bounds = self.kept
            if len(rows) == len(bounds) - 1:
                yield rows, values, bounds
                return
            counts = bounds[rows + 1] - bounds[rows]
            ends = np.cumsum(counts)
            at = np.arange(ends[-1]) + np.repeat(bounds[rows] - (ends - counts), counts)
            yield rows, values[at], np.concatenate([[0], ends])
            return
        size = np.cumsum(self.offsets[rows + 1] - self.offsets[rows])
        cut = np.unique(np.concatenate([[0], np.searchsorted(size, np.arange(0, size[-1], 1 << 22), "right"), [len(rows)]]))
        for a, b in zip(cut[:-1], cut[1:]):
            yield (rows[a:b], *self._make(rows[a:b]))


def bucket_edges(ids: np.ndarray, texts: pa.Array, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges at or over the Jaccard threshold that connect exactly what all such edges of the bucket connect."""
    sets = _Sets(texts)
    left, a, b = np.arange(len(ids)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            _, mine, _ = next(sets.blocks(np.array([x])))
            near = []
            for _, values, bounds in sets.blocks(left):
                at = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                common = np.add.reduceat((mine[at] == values).astype(np.int64), bounds[:-1])
                near.append(common >= threshold * (np.diff(bounds) + len(mine) - common) - 1e-9)
            near = np.concatenate(near)
            hit = left[near]
            if len(hit):
                a.append(np.full(len(hit), ids[x]))
                b.append(ids[hit])
                queue.extend(hit)
                left = left[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def small_edges(sizes: np.ndarray, cut: np.ndarray, ids: np.ndarray, texts: pa.Array, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """All edges of the buckets of up to _SMALL lines, each pair of lines compared once."""
    xs, ys = [], []
    for n in range(2, _SMALL + 1):
        heads = cut[sizes == n]
        for i in range(n):
            for j in range(i + 1, n):
                xs.append(heads + i)
                ys.append(heads + j)
    x, y = np.concatenate(xs), np.concatenate(ys)
    if not len(x):
        return ids[:0], ids[:0]
    one, two = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
    _, pick = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True)
    x, y = x[pick], y[pick]
    lines, back = np.unique(ids[np.concatenate([x, y])], return_inverse=True)
    row = np.empty(len(lines), np.int64)
    row[back] = np.concatenate([x, y])
    sets = _Sets(texts.take(pa.array(row)))
    p, q = back[: len(x)], back[len(x) :]
    near = np.zeros(len(x), bool)
    size = np.diff(sets.offsets)
    weight = np.cumsum(size[p] + size[q])
    block = np.unique(np.concatenate([[0], np.searchsorted(weight, np.arange(0, weight[-1], 1 << 19), "right"), np.arange(0, len(x), 1 << (_TAG - 1)), [len(x)]]))
    for a, b in zip(block[:-1], block[1:]):
        tag = np.arange(b - a)
        both, count = [], []
        for rows in (p[a:b], q[a:b]):
            used, at = np.unique(rows, return_inverse=True)
            _, values, bounds = sets.gather(used)
            n = np.diff(bounds)[at]
            ends = np.cumsum(n)
            both.append((values[np.arange(ends[-1]) + np.repeat(bounds[at] - (ends - n), n)]) | (np.repeat(tag, n).astype(np.uint64) << np.uint64(64 - _TAG)))
            count.append(n)
        joined = np.sort(np.concatenate(both))
        again = joined[1:][joined[1:] == joined[:-1]] >> np.uint64(64 - _TAG)
        common = np.bincount(again.astype(np.int64), minlength=b - a)
        near[a:b] = common >= threshold * (count[0] + count[1] - common) - 1e-9
    return ids[x[near]], ids[y[near]]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key's rows may run over several batches."""
    held: list[pa.RecordBatch] = []

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        keys, ids = t["key"].to_numpy(), t["lid"].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(cut, len(keys)))
        found = []
        ends = np.cumsum(pc.binary_length(t["line"]).to_numpy(zero_copy_only=False).astype(np.int64))
        block = ends[cut + sizes - 1] // _BLOCK_BYTES
        for b in np.unique(block):
            own = block == b
            found.append(small_edges(sizes[own], cut[own], ids, t["line"]))
        big = sizes > _SMALL
        found += [bucket_edges(ids[i : i + n], t["line"].slice(i, n)) for i, n in zip(cut[big], sizes[big])]
        pair = np.concatenate([np.stack(p, axis=1) for p in found])
        pair = np.unique(np.sort(pair, axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

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


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lid, size, s): the distinct shingles of rows (key, lid, line), and how many each line has."""
    for part in tk.chunks(batches, "line", CHUNK_HOT):
        values, bounds = _Sets(part["line"]).gather(np.arange(part.num_rows))[1:]
        n = np.diff(bounds)
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([part["key"].take(row), part["lid"].take(row), pa.array(np.repeat(n, n).astype(np.int32)), pa.array(tk.signed(values))], ["key", "lid", "size", "s"])


def _split(hot: DataFrame, line_text: DataFrame) -> DataFrame:
    """(key, lid): the rows of hot buckets in buckets of the shingles that similar lines must share.

    If the shingles of a bucket are put in one order, the rarest first, two sets
    with a Jaccard similarity of the threshold share one of their first
    n - ceil(threshold * n) + 1. So no pair is lost, and what all lines of the
    bucket have in common makes no bucket unless a line consists of it.
    """
    tokens = checkpoint(hot.select("key", "lid").join(line_text, "lid").select("key", "lid", "line").mapInArrow(_tokens, "key long, lid long, size int, s long"))
    often = tokens.groupBy("key", "s").agg(F.count(F.lit(1)).alias("c"))
    rank = F.row_number().over(Window.partitionBy("key", "lid").orderBy("c", "s"))
    first = tokens.join(often, ["key", "s"]).withColumn("rank", rank)
    first = first.filter((F.col("rank") <= F.col("size") - F.ceil(F.col("size") * F.lit(THRESHOLD) - F.lit(1e-9)) + 1) & (F.col("c") > 1))
    rows = first.select(F.xxhash64("key", "s").alias("key"), "lid")
    marks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("lid").alias("lo"), F.max("lid").alias("hi"), _sum_of_ids().alias("s")).filter("n > 1")
    one = marks.groupBy("n", "lo", "hi", "s").agg(F.min("key").alias("key")).select("key")
    return rows.join(one, "key")


def _sum_of_ids() -> Column:
    return F.sum(F.xxhash64("lid").bitwiseAND(F.lit((1 << 40) - 1)))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line) of every line to remove; th is xxhash64 of the document's text."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    need = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter("text is not null")
    lines = need.mapInArrow(_lines, "h1 long, h2 long, doc_id long, th long, line int, bands binary")
    place = F.struct("doc_id", "th", "line")
    same = Window.partitionBy("h1", "h2", F.isnull("bands")).orderBy("doc_id", "th", "line")  # one sort for both
    marked = lines.withColumn("first", F.first(place).over(same)).withColumn("is_first", F.col("first") == place)
    marked = marked.withColumn("lead", F.col("bands").isNotNull() & (F.row_number().over(same) == 1))
    marked = checkpoint(
        marked.filter("lead or bands is null or not is_first").select("doc_id", "th", "line", F.when(F.col("lead"), F.col("bands")).alias("bands"), F.monotonically_increasing_id().alias("lid"))
    )
    release(spark)
    exact = marked.filter("bands is null").select("doc_id", "th", "line")
    heads = marked.filter("bands is not null")
    keys = heads.select("lid", "bands").mapInArrow(_explode_bands, "key long, lid long")
    per = Window.partitionBy("key")
    met = keys.withColumn("n", F.count(F.lit(1)).over(per)).filter("n > 1")
    # buckets with the same members need one look: they agree in number, least, greatest and the sum of mixed ids
    met = met.select("key", "lid", F.struct("n", F.min("lid").over(per).alias("lo"), F.max("lid").over(per).alias("hi"), _sum_of_ids().over(per).alias("s")).alias("mark"))
    met = checkpoint(met.groupBy("mark", "lid").agg(F.min("key").alias("key")).select("key", "lid", F.col("mark.n").alias("n")))
    release(spark)
    wanted = met.select("lid").distinct().join(heads.select("lid", "doc_id", "th", "line"), "lid")
    per_doc = wanted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("line", "lid")).alias("want"))
    at = per_doc.select(F.col("doc_id").alias("w_id"), F.col("th").alias("w_th"), "want")
    packed = need.mapInArrow(tk.zip_column, "doc_id long, th long, z binary")
    # the side of wanted lines is the small one of each partition: no sort of the texts
    joined = packed.join(at.hint("shuffle_hash"), packed["doc_id"].eqNullSafe(at["w_id"]) & (packed["th"] == at["w_th"])).select("z", "want")
    line_text = joined.mapInArrow(_fetch, "lid long, line string").dropDuplicates(["lid"])
    if not met.filter(F.col("n") > HOT).isEmpty():
        line_text = checkpoint(line_text)
        met = met.filter(F.col("n") <= HOT).select("key", "lid").unionByName(_split(met.filter(F.col("n") > HOT), line_text))
    rows = met.select("key", "lid").join(line_text, "lid").select("key", "lid", "line").repartition("key").sortWithinPartitions("key", "lid")
    edges = checkpoint(rows.mapInArrow(_verify, "a long, b long"))
    release(spark)
    groups = connected_components(edges).join(heads.select(F.col("lid").alias("node"), "doc_id", "th", "line"), "node")
    first = groups.groupBy("root").agg(F.min(place).alias("keep"))
    fuzzy = groups.join(first, "root").filter(place != F.col("keep")).select("doc_id", "th", "line")
    # a line of a group goes with all its exact repeats, which are in ``exact`` already
    return exact.unionByName(fuzzy)


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.unzip_column(batches):
        offsets, data = tk.buffers(part["text"])
        doc, number, start, end = tk.line_spans(offsets, data)
        full = _mask_blank(data, start, end)
        gone = np.zeros(len(doc), bool)
        lists = part["gone"]
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        if counts.sum():
            row = np.repeat(np.arange(len(offsets) - 1), counts)
            gone[np.searchsorted(doc, row) + lists.flatten().to_numpy()] = True
        left = np.bincount(doc[full & ~gone], minlength=len(offsets) - 1) > 0
        new = part["text"].to_pylist()
        for d in np.flatnonzero(counts):
            a, b = np.searchsorted(doc, [d, d + 1])
            new[d] = b"\n".join(data[start[i] : end[i]].tobytes() for i in range(a, b) if not gone[i]).decode()
        keep = pa.array(left | (counts == 0))
        names = [n for n in part.schema.names if n not in ("text", "gone")]
        out = pa.RecordBatch.from_arrays([*(part[n] for n in names), pa.array(new, pa.string())], [*names, "text"])
        yield out.filter(keep)


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without the lines that :func:`dropped_lines` gives; columns as given."""
    gone = dropped_lines(docs).groupBy("doc_id", "th").agg(F.collect_set("line").alias("__gone"))
    gone = gone.select(F.col("doc_id").alias("__g_id"), F.col("th").alias("__g_th"), "__gone")
    plain = docs.select(rest(docs), "text")
    schema = plain.schema
    keyed = plain.withColumn("th", F.xxhash64("text"))
    packed = keyed.mapInArrow(tk.zip_column, T.StructType([schema["rest"], T.StructField("th", T.LongType()), T.StructField("z", T.BinaryType())]))
    on = rest_field(docs, "doc_id").eqNullSafe(F.col("__g_id")) & (F.col("th") == F.col("__g_th"))
    joined = packed.join(gone.hint("shuffle_hash"), on, "left").select("rest", "z", F.col("__gone").alias("gone"))
    out = joined.mapInArrow(_rebuild, schema)
    return out.select(*unpacked(docs))
