"""Terms of documents counted document by document, in Arrow batches.

What a query's terms weigh in a document is found without a shuffle: a document's
counts are one sparse row, a block of rows times the queries' weights gives all
scores of the block. Documents that share an id are brought together first.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from sigloom.functions import text as tx
from sigloom.session import checkpoint

#: Cells of a dense block of documents x terms or terms x queries.
CELLS = 1 << 22
#: Terms counted in a task before the counts are passed on; terms whose frequency every worker holds.
COUNTED, HELD = 300_000, 200_000


@lru_cache
def _odd() -> re.Pattern:
    """Characters that are in tx.WORD and not in "\\w", or the other way."""
    return re.compile(f"[{_ranges(lambda c: _is_word(c) != (c.isalnum() or c == '_'))}]")


@lru_cache
def _exact(least: int) -> re.Pattern:
    return re.compile(f"[{_ranges(_is_word)}]{{{least},}}")


@lru_cache
def _usual(least: int) -> re.Pattern:
    return re.compile(rf"\w{{{least},}}")


def _is_word(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind in ("Mn", "Nd", "Pc")


def _ranges(of: Callable[[str], bool]) -> str:
    edge = np.flatnonzero(np.diff(np.array([0, *(of(chr(c)) for c in range(sys.maxunicode + 1)), 0], np.int8)))
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(edge[::2], edge[1::2]))


def words(text: str, least: int = 2, stop: frozenset[str] = frozenset()) -> list[str]:
    """What tx.tokens (or, with stop words, tx.content_tokens) gives of a text that is in lower case already; \\w is three times as fast where it is the same."""
    pattern = _usual if text.isascii() or not _odd().search(text) else _exact
    found = pattern(least).findall(text)
    return [w for w in found if w not in stop] if stop else found


STOP = frozenset(tx.STOP_WORDS)


def gathered(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, bool]:
    """(doc_id, texts in lower case, keep) and whether each row of docs has an id of its own; if not, the texts of an id are one row."""
    own = docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    lower = F.lower(F.col(text))
    if own:
        return docs.select(F.col(doc_id).alias("doc_id"), F.array(lower).alias("texts"), *keep), True
    return docs.groupBy(F.col(doc_id).alias("doc_id")).agg(F.collect_list(lower).alias("texts")), False


def _counted(texts: list[str | None], least: int, stop: frozenset[str]) -> dict[int, tuple[int, Counter]]:
    """By number of words: how many of the texts have it, and the counts of their words."""
    out: dict[int, tuple[int, Counter]] = {}
    for t in texts or ():
        if t is not None:
            w = words(t, least, stop)
            k, c = out.get(len(w), (0, Counter()))
            c.update(w)
            out[len(w)] = (k + 1, c)
    return out


def _kind(schema: StructType, name: str, to: str | None = None) -> StructField:
    return StructField(to or name, schema[name].dataType)


@dataclass
class Hits:
    """Documents' counts of the queries' terms: rows (doc_id, len, k, most, terms, tfs, keep), and what they are to be weighed by."""

    rows: DataFrame
    own: bool
    n: int
    average: float
    frequency: np.ndarray
    queries: list
    query_field: StructField
    #: query, term and count, in order of the queries
    wanted: np.ndarray
    keep: tuple[str, ...]

    def scores(self, weigh: Callable, names: list[str], k: int | None = None, slack: float = 0.0, among: DataFrame | None = None) -> DataFrame:
        """(query_id, doc_id, names, keep): scores of each document for each query that shares a term with it.

        ``weigh`` makes the scores of a block, see :func:`blocks`. With ``k``, only
        what may be among a query's k best by the first score is passed on, with
        all that come within ``slack`` of them. ``among`` limits the documents.
        """
        rows = self.rows if among is None else self.rows.join(F.broadcast(among), "doc_id", "left_semi")
        schema = StructType([self.query_field, _kind(self.rows.schema, "doc_id"), *(StructField(x, DoubleType()) for x in names), *(_kind(self.rows.schema, x) for x in self.keep)])
        bc = self.rows.sparkSession.sparkContext.broadcast((self.frequency, self.queries, self.wanted, self.n, self.average))
        kinds, keep, alone = [pa.from_numpy_dtype(float)] * len(names), self.keep, self.own

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, ids, wanted, n, average = bc.value
            ids, bar = pa.array(ids), np.full(len(ids), -np.inf)
            for rows, q, scores, take in blocks(batches, df, len(ids), wanted, n, average, weigh):
                if k and alone:
                    val = np.where(take, scores[0], -np.inf)
                    if len(val) > k:
                        bar[q] = np.maximum(bar[q], np.partition(val, -k, 0)[-k])
                    take = take & (val >= bar[q] - slack)
                d, at = np.nonzero(take)
                if len(d):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q[at])), rows.column("doc_id").take(pa.array(d)), *(pa.array(s[d, at], t) for s, t in zip(scores, kinds)), *(rows.column(x).take(pa.array(d)) for x in keep)], [f.name for f in schema])

        out = rows.mapInArrow(run, schema)
        return out if alone else out.groupBy("query_id", "doc_id").agg(*(F.sum(x).alias(x) for x in names))

    def ranks(self, weigh: Callable, pairs: DataFrame, digits: int) -> DataFrame:
        """(query_id, doc_id, rank) of given pairs in the list of all documents with a positive rounded score for the query, ties by doc_id.

        A rank is one more than the number of documents before it, which every
        task counts for its own. Pairs are collected: a bounded number a query
        is meant. Each row must have an id of its own.
        """
        unit = 10.0**digits
        some = self.scores(weigh, ["score"], among=pairs.select("doc_id").distinct()).join(F.broadcast(pairs), ["query_id", "doc_id"], "left_semi")
        number = {q: i for i, q in enumerate(self.queries)}
        want: dict[int, list] = {}
        for r in some.collect():
            if (key := int(np.rint(r["score"] * unit))) > 0:
                want.setdefault(number[r["query_id"]], []).append((-key, r["doc_id"]))
        schema = StructType([self.query_field, _kind(self.rows.schema, "doc_id"), StructField("n", LongType())])
        bc = self.rows.sparkSession.sparkContext.broadcast((self.frequency, self.queries, self.wanted, self.n, self.average, {q: sorted(p) for q, p in want.items()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            df, ids, wanted, n, average, want = bc.value
            keys = {q: np.array([k for k, _ in p]) for q, p in want.items()}
            before = {q: np.zeros(len(p) + 1, np.int64) for q, p in want.items()}
            for rows, qs, (score,), _ in blocks(batches, df, len(ids), wanted, n, average, weigh):
                docs = rows.column("doc_id").to_pylist()
                key = -np.rint(score * unit).astype(np.int64)
                for j, q in enumerate(qs):
                    if q not in want:
                        continue
                    own, at = keys[q], np.flatnonzero(key[:, j] < 0)
                    # the first pair that comes after the document; of equal scores the ids decide
                    first = np.searchsorted(own, key[at, j], "left")
                    for x in np.flatnonzero(own[np.minimum(first, len(own) - 1)] == key[at, j]):
                        while first[x] < len(own) and want[q][first[x]] <= (key[at[x], j], docs[at[x]]):
                            first[x] += 1
                    before[q] += np.bincount(first, minlength=len(own) + 1)
            out = [(ids[q], d, int(m)) for q, p in want.items() for (_, d), m in zip(p, np.cumsum(before[q]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["query_id", "doc_id", "n"])

        kinds = [to_arrow_type(f.dataType) for f in schema]
        counts = self.rows.mapInArrow(run, schema)
        return counts.groupBy("query_id", "doc_id").agg((F.sum("n") + 1).cast("int").alias("rank"))


def blocks(batches, df, n_queries, wanted, n, average, weigh):
    """(rows, query numbers, scores, touched) of blocks of documents and queries, both so small that a dense matrix of either fits.

    ``weigh(times, tf, row, len, most, df, n, average)`` gives the list of scores
    and which pairs share a term: ``times(values, by_term)`` multiplies values of the
    postings by those of their terms and sums them by document and query.
    """
    n_terms = max(1, len(df))
    # queries in blocks, each with its own terms only
    width = max(1, CELLS // n_terms)
    plans = []
    for begin in range(0, n_queries, width):
        part = wanted[(wanted[:, 0] >= begin) & (wanted[:, 0] < begin + width)]
        terms, inside = np.unique(part[:, 1], return_inverse=True)
        q = np.arange(begin, min(begin + width, n_queries))
        m = np.zeros((len(terms), len(q)))
        m[inside, part[:, 0] - begin] = part[:, 2]
        local = np.full(n_terms, -1)
        local[terms] = np.arange(len(terms))
        if len(terms):
            plans.append((q, local, m, df[terms].astype(float)))
    for batch in batches:
        height = max(1, CELLS // max([1, *(len(m) for _, _, m, _ in plans)]))
        for at in range(0, batch.num_rows, height):
            rows = batch.slice(at, height)
            size = rows.column("len").to_numpy(zero_copy_only=False).astype(float)
            most = rows.column("most").to_numpy(zero_copy_only=False).astype(float)
            each = rows.column("terms")
            counts = np.diff(each.offsets.to_numpy())
            row = np.repeat(np.arange(rows.num_rows), counts)
            term = each.flatten().to_numpy(zero_copy_only=False)
            tf = rows.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(float)
            for q, local, m, own_df in plans:
                here = local[term] >= 0
                r, c, f = row[here], local[term[here]], tf[here]
                dense = np.zeros((rows.num_rows, len(m)))

                def times(values: np.ndarray, by_term: np.ndarray, r=r, c=c, m=m, dense=dense) -> np.ndarray:
                    dense[r, c] = values
                    return dense @ (m * by_term[:, None])

                yield rows, q, *weigh(times, f, r, size, most, own_df, n, average)


def hits(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, content: bool = False, keep: tuple[str, ...] = ()) -> Hits:
    """Counts of the queries' terms in every document, written once; the documents are read and cut into words once."""
    tokens, least, stop = (tx.content_tokens, 3, STOP) if content else (tx.tokens, 2, frozenset())
    found = queries.select("query_id", F.explode(tokens("text")).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")).collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in found}))}
    ids = sorted({r["query_id"] for r in found})
    number = {q: i for i, q in enumerate(ids)}
    wanted = np.array(sorted((number[r["query_id"]], terms[r["term"]], 1 if content else r["qtf"]) for r in found), np.int64).reshape(-1, 3)
    rows, own = gathered(docs, doc_id, text, keep)
    keep = keep if own else ()
    bc = docs.sparkSession.sparkContext.broadcast(terms)
    schema = StructType([_kind(rows.schema, "doc_id"), *(StructField(x, IntegerType()) for x in ("len", "k", "most")), *(StructField(x, ArrayType(IntegerType())) for x in ("terms", "tfs")), *(_kind(rows.schema, x) for x in keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = bc.value
        for batch in batches:
            at, size, many, most, ts, fs, ends = [], [], [], [], [], [], [0]
            for i, texts in enumerate(batch.column("texts").to_pylist()):
                groups = _counted(texts, least, stop)
                top = max((max(c.values(), default=0) for _, c in groups.values()), default=0)
                for n, (k, c) in groups.items():
                    at.append(i)
                    size.append(n)
                    many.append(k)
                    most.append(top)
                    for t in c.keys() & terms.keys():
                        ts.append(terms[t])
                        fs.append(c[t])
                    ends.append(len(ts))
            ints = lambda x: pa.array(x, pa.int32())
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(where), ints(size), ints(many), ints(most), *(pa.ListArray.from_arrays(ints(ends), ints(x)) for x in (ts, fs)), *(batch.column(x).take(where) for x in keep)], [f.name for f in schema])

    made = checkpoint(rows.mapInArrow(run, schema))
    total, many = made.agg(F.sum(F.col("len").cast("double") * F.col("k")), F.sum("k")).first()
    frequency = np.zeros(len(terms), np.int64)
    for r in made.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():
        frequency[r["t"]] = r["n"]
    return Hits(made, own, docs.count(), (total or 0.0) / (many or 1), frequency, ids, _kind(queries.schema, "query_id"), wanted, keep)


def frequencies(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, bool]:
    """(term, df) of all content terms, written once; the gathered documents; and whether each row has an id of its own."""
    rows, own = gathered(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            both = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
            total.clear()
            return both

        for batch in batches:
            for texts in batch.column("texts").to_pylist():
                for _, c in _counted(texts, 3, STOP).values():
                    total.update(c.keys())
            if len(total) > COUNTED:
                yield out()
        yield out()

    schema = StructType([StructField("term", StringType()), StructField("n", LongType())])
    return checkpoint(rows.mapInArrow(run, schema).groupBy("term").agg(F.sum("n").alias("df"))), rows, own


def best_terms(docs: DataFrame, k: int, doc_id: str, text: str, plus_one: bool, slack: float) -> DataFrame:
    """(doc_id, len, term, tf, df, n): all that may be among the k content terms of a document with the greatest tf / len * ln(n / (df + plus_one)).

    The commonest terms' frequencies go to every worker, which leaves out what
    k others of its document exceed by more than ``slack``; a rarer term's is
    joined, and it is left out if it couldn't do so were it in one document only.
    """
    freq, rows, own = frequencies(docs, doc_id, text)
    n, more = docs.count(), int(plus_one)
    least, seen = 1, 0
    for r in freq.groupBy("df").agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("df").desc()).limit(HELD + 1).collect():
        seen += r["c"]
        if seen > HELD:
            least = r["df"] + 1
            break
    bc = docs.sparkSession.sparkContext.broadcast({r["term"]: r["df"] for r in freq.filter(F.col("df") >= least).collect()})
    schema = StructType([_kind(rows.schema, "doc_id"), StructField("len", IntegerType()), StructField("term", StringType()), StructField("tf", IntegerType()), StructField("held", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bc.value
        for batch in batches:
            at, size, terms, tfs, dfs = [], [], [], [], []
            for i, texts in enumerate(batch.column("texts").to_pylist()):
                for length, (_, c) in _counted(texts, 3, STOP).items():
                    own_terms = list(c)
                    tf = np.fromiter(c.values(), float, len(c))
                    df = np.array([held.get(t, 0) for t in own_terms], float)
                    high = tf / max(length, 1) * np.log(n / (np.maximum(df, 1) + more))
                    stay = range(len(own_terms))
                    if len(own_terms) > k:
                        low = np.where(df > 0, high, tf / max(length, 1) * np.log(n / (least - 1 + more)) if least > 1 else high)
                        stay = np.flatnonzero(high >= np.partition(low, -k)[-k] - slack)
                    for j in stay:
                        at.append(i)
                        size.append(length)
                        terms.append(own_terms[j])
                        tfs.append(int(tf[j]))
                        dfs.append(int(df[j]) or None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(size, pa.int32()), pa.array(terms, pa.string()), pa.array(tfs, pa.int32()), pa.array(dfs, pa.int64())], [f.name for f in schema])

    found = rows.mapInArrow(run, schema)
    if least > 1:
        found = found.join(freq.filter(F.col("df") < least), "term", "left").withColumn("df", F.coalesce("held", "df"))
    else:
        found = found.withColumnRenamed("held", "df")
    return found.withColumn("n", F.lit(float(n)))
