"""Retrieval: BM25, TF-IDF, vector search, rank fusion, hybrid search and diversity re-ranking.

Documents' counts of the queries' terms are made in one pass and weighed in a
second (see terms.py), so no posting is shuffled. Queries come as a table
(query_id, text), all of them answered by one plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions import text as tx
from sigloom.functions import vectors as vec
from sigloom.operators.terms import best_terms
from sigloom.operators.terms import hits as term_hits
from sigloom.session import checkpoint


def _bm25_weights(k1: float, b: float):
    def weigh(times, tf, row, size, most, df, n, average):
        score = times(tf * (k1 + 1) / (tf + k1 * (1 - b + b * size[row] / (average or 1.0))), np.log((n - df + 0.5) / (df + 0.5) + 1))
        return [score], score > 0

    return weigh


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, k: int | None = None, slack: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, doc_id, score > 0, keep) of every document that holds a term of the query; a term that a query repeats counts as often.

    With ``k``, of those only what may be among a query's k best, and what comes
    within ``slack`` of the k-th, for rounding to follow. Columns to keep are left
    out if several rows share an id.
    """
    return term_hits(docs, queries, doc_id, text, keep=keep).scores(_bm25_weights(k1, b), ["score"], k, slack).filter("score > 0")


def rank_by(df: DataFrame, group: str, score: str, tie: str, k: int | None = None) -> DataFrame:
    """df with ``rank`` in each group, best first; the k best if given."""
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))))
    return out if k is None else out.filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, **how) -> DataFrame:
    return rank_by(bm25_scores(docs, queries, k=k, **how), "query_id", "score", "doc_id", k)


_TF = ("raw", "boolean", "log", "augmented", "double_norm")
_IDF = {
    "standard": lambda n, d: np.log(n / (d + 1)),
    "smooth": lambda n, d: np.log(1 + n / (d + 1)),
    "probabilistic": lambda n, d: np.maximum(0.0, np.log(np.maximum(n - d, 1e-300) / (d + 1))),
}


def _tfidf_weights(variants: list[tuple[str, str]]):
    """The TF of (double) norm is half one and half tf / m, so its sums are those of two others."""

    def weigh(times, tf, row, size, most, df, n, average):
        one, raw, idf = {}, {}, {i: f(n, df) for i, f in _IDF.items()}
        for i in dict.fromkeys(["smooth", *(i for _, i in variants)]):
            one[i] = times(np.ones(len(tf)), idf[i])
            raw[i] = times(tf, idf[i])
        made = {
            "raw": lambda i: raw[i],
            "boolean": lambda i: one[i],
            "log": lambda i: times(1 + np.log(tf), idf[i]),
            "augmented": lambda i: 0.5 * one[i] + 0.5 * raw[i] / np.maximum(most, 1)[:, None],
        }
        return [made["augmented" if t == "double_norm" else t](i) for t, i in variants], one["smooth"] > 0

    return weigh


def tfidf_scores(docs: DataFrame, queries: DataFrame, tf: str = "raw", idf: str = "smooth", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, doc_id, score): sums over the query's distinct terms, in any of the five TF and three IDF variants."""
    return term_hits(docs, queries, doc_id, text, content=True).scores(_tfidf_weights([(tf, idf)]), ["score"])


def tfidf_all(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", digits: int | None = None) -> DataFrame:
    """(tf_kind, idf_kind, query_id, doc_id, score): all fifteen variants from one pass over the documents' counts."""
    variants = [(t, i) for t in _TF for i in _IDF]
    own = [v for v in variants if v[0] != "double_norm"]
    wide = term_hits(docs, queries, doc_id, text, content=True).scores(_tfidf_weights(own), [f"{t}|{i}" for t, i in own])
    name = lambda t, i: f"{'augmented' if t == 'double_norm' else t}|{i}"
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("tf_kind"), F.lit(i).alias("idf_kind"), F.col(name(t, i)).alias("score")) for t, i in variants])).alias("v")
    score = F.col("v.score") if digits is None else F.round("v.score", digits)
    return wide.select("query_id", "doc_id", pairs).select("v.tf_kind", "v.idf_kind", "query_id", "doc_id", score.alias("score"))


def distinctive_terms(docs: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", plus_one: bool = True, digits: int | None = None) -> DataFrame:
    """(doc_id, term, score, rank): the k content terms of each document with the highest (tf / len) ln(N / (df + 1)) (or ln(N / df)).

    Scores are rounded to ``digits`` before they are ranked, if given.
    """
    rows = best_terms(docs, k, doc_id, text, plus_one, 1e-12 if digits is None else 2 * 10.0**-digits)
    df = F.col("df") + 1 if plus_one else F.col("df")
    score = F.col("tf") / F.col("len") * F.log(F.col("n") / df)
    scored = rows.withColumn("score", score if digits is None else F.round(score, digits))
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "term")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("doc_id", "term", "score", "rank")


def rrf(lists: DataFrame, by: list[str], item: str = "doc_id", rank: str = "rank", k: float = 60) -> DataFrame:
    """(by, item, score): the sum of 1 / (k + rank) over all lists; an item that a list repeats counts as often."""
    return lists.filter(F.col(rank) > 0).groupBy(*by, item).agg(F.sum(1.0 / (k + F.col(rank))).alias("score"))


def vector_search(base: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", positive: bool = False, base_id: str = "vec_id", base_vec: str = "embedding") -> DataFrame:
    """(query_id, base id, score, rank): exact search of each query (query_id, vector) over all vectors.

    The queries are broadcast in blocks of bounded size; each partition of the
    base computes matrix products of bounded size and passes on what reaches the
    k-th best of the query so far: some k rows a query and partition are shuffled.
    """
    queries = checkpoint(queries.select("query_id", "vector"))
    n_queries = queries.count()
    blocks = max(1, -(-n_queries // _QUERY_BLOCK))
    out = None
    numbered = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        found = _search_block(base, part, k, metric, positive, base_id, base_vec)
        out = found if out is None else out.unionByName(found)
    return rank_by(out, "query_id", "score", base_id, k)


#: Queries broadcast at once.
_QUERY_BLOCK = 20_000
#: Cells of a block of queries x vectors.
_CELLS = 1 << 22


def _search_block(base, queries, k, metric, positive, base_id, base_vec):
    spark = base.sparkSession
    rows = queries.collect()
    ids = np.array([r["query_id"] for r in rows], np.int64)
    vectors = [np.asarray(r["vector"], float) for r in rows]
    bc = spark.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors = bc.value
        bar = np.full(len(ids), -np.inf)  # the k-th best of each query so far: what is held doesn't grow with the base
        lengths = np.array([len(v) for v in vectors])
        for pdf in batches:
            own = [np.asarray(v, float) if v is not None else np.zeros(0) for v in pdf[base_vec]]
            size = np.array([len(v) for v in own])
            for n in np.unique(lengths):
                q = np.flatnonzero(lengths == n)
                d = np.flatnonzero(size == n)
                if not n or not len(d):
                    continue
                m, bid = np.stack([own[i] for i in d]), pdf[base_id].to_numpy()[d]
                nm = np.sqrt((m * m).sum(1))
                for part in np.array_split(q, -(-len(q) * len(d) // _CELLS)):
                    a = np.stack([vectors[i] for i in part])
                    na = np.sqrt((a * a).sum(1))
                    score = a @ m.T
                    if metric == "cosine":
                        norm = na[:, None] * nm[None, :]
                        score = np.divide(score, norm, out=np.zeros_like(score), where=norm > 0)
                    else:
                        score = 2 * score - nm[None, :] ** 2 - na[:, None] ** 2  # the same order; distances of those that stay are taken anew
                    if len(d) > k:
                        bar[part] = np.maximum(bar[part], np.partition(score, -k, 1)[:, -k])
                    # all that about tie with the k-th stay, so that ties are settled by id in the end
                    edge = bar[part] - 3e-9 * np.where(np.isinf(bar[part]), 0.0, np.maximum(1.0, np.abs(bar[part])))
                    at, pick = np.nonzero((score >= edge[:, None]) & ((score > 0) if positive else True))
                    if len(at):
                        own_score = score[at, pick] if metric == "cosine" else -np.sqrt(((m[pick] - a[at]) ** 2).sum(1))
                        yield pd.DataFrame({"query_id": ids[part[at]], base_id: bid[pick], "score": own_score})

    return base.select(base_id, base_vec).mapInPandas(run, f"query_id long, {base_id} long, score double")


def vector_ranks(base: DataFrame, queries: DataFrame, pairs: DataFrame, digits: int = 9, base_id: str = "doc_id", base_vec: str = "embedding") -> DataFrame:
    """(query_id, base id, rank) of given pairs in the list of all vectors with a positive cosine to the query, best first.

    A rank is one more than the number of vectors before it: each partition of
    the base counts them for the pairs of a query at once, and only the counts
    are shuffled. Pairs are broadcast: a bounded number a query is meant.
    """
    scored = pairs.select("query_id", base_id).join(base.select(base_id, base_vec), base_id).join(queries.select("query_id", "vector"), "query_id")
    scored = scored.select("query_id", base_id, F.round(vec.cosine(base_vec, "vector"), digits).alias("score")).filter("score > 0")
    rows = scored.join(queries.select("query_id", "vector"), "query_id").collect()
    groups: dict[int, tuple[np.ndarray, list[tuple[float, int]]]] = {}
    for r in rows:
        groups.setdefault(r["query_id"], (np.asarray(r["vector"], float), []))[1].append((-r["score"], r[base_id]))
    bc = base.sparkSession.sparkContext.broadcast([(q, v, sorted(p)) for q, (v, p) in groups.items()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros(len(p), np.int64) for _, _, p in bc.value]
        for pdf in batches:
            ids = pdf[base_id].to_numpy()
            vectors = [np.asarray(v, float) if v is not None else np.zeros(0) for v in pdf[base_vec]]
            size = np.array([len(v) for v in vectors])
            for i, (_, q, wanted) in enumerate(bc.value):
                rows = np.flatnonzero(size == len(q))
                if not len(rows) or not len(q):
                    continue
                m = np.stack([vectors[r] for r in rows])
                norm = np.sqrt((m * m).sum(1)) * np.sqrt((q * q).sum())
                score = np.round(np.divide(m @ q, norm, out=np.zeros(len(m)), where=norm > 0), digits)
                own = ids[rows][score > 0]
                score = -score[score > 0]
                order = np.lexsort((own, score))
                score, own = score[order], own[order]
                for j, (s, d) in enumerate(wanted):
                    lo, hi = np.searchsorted(score, s - 10.0 ** -(digits + 1)), np.searchsorted(score, s + 10.0 ** -(digits + 1))
                    total[i][j] += lo + np.searchsorted(own[lo:hi], d)
        yield pd.DataFrame([(q, d, int(n)) for (q, _, p), t in zip(bc.value, total) for (_, d), n in zip(p, t)], columns=["query_id", base_id, "n"])

    counts = base.select(base_id, base_vec).mapInPandas(run, f"query_id long, {base_id} long, n long")
    return counts.groupBy("query_id", base_id).agg((F.sum("n") + 1).cast("int").alias("rank"))


def hybrid_search(docs: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 10, rrf_k: int = 60, digits: tuple[int, int, int] = (6, 9, 9)) -> DataFrame:
    """(query_id, doc_id, score, rank): BM25 and cosine ranks fused; queries without a vector get BM25 alone.

    docs (doc_id, text), vectors (doc_id, embedding), queries (query_id, text, vector).
    Both lists are of all documents with a positive score (rounded to ``digits``
    of BM25, cosine and fused score, ties by doc_id), but only their heads can
    win: an item beyond place 2 (rrf_k + k) - rrf_k of both scores less than the
    k best of either list. So the heads of both lists are candidates, and the
    ranks of those in the other list are counted; neither list is ever sorted whole.
    """
    deep = rrf_k + 2 * k + 1
    found, weigh = term_hits(docs, queries, "doc_id", "text"), _bm25_weights(1.5, 0.75)
    scores = found.scores(weigh, ["score"], deep, 2 * 10.0 ** -digits[0]).withColumn("score", F.round("score", digits[0])).filter("score > 0")
    lexical = checkpoint(rank_by(scores, "query_id", "score", "doc_id", deep).select("query_id", "doc_id", "rank"))
    have = queries.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).select("query_id", "vector")
    near = vector_search(vectors, have, deep + k, positive=True, base_id="doc_id").withColumn("score", F.round("score", digits[1])).filter("score > 0").drop("rank")
    head = checkpoint(rank_by(near, "query_id", "score", "doc_id", deep).select("query_id", "doc_id", "rank"))
    pairs = checkpoint(lexical.select("query_id", "doc_id").unionByName(head.select("query_id", "doc_id")).distinct())
    if found.own:
        ranks = lexical.unionByName(found.ranks(weigh, head.join(lexical, ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id"), digits[0]))
    else:
        every = found.scores(weigh, ["score"]).withColumn("score", F.round("score", digits[0])).filter("score > 0")
        ranks = rank_by(every, "query_id", "score", "doc_id").select("query_id", "doc_id", "rank").join(pairs, ["query_id", "doc_id"], "left_semi")
    of_both = ranks.unionByName(vector_ranks(vectors, have, pairs, digits[1]))
    fused = rrf(of_both, ["query_id"], k=rrf_k).withColumn("score", F.round("score", digits[2]))
    return rank_by(fused, "query_id", "score", "doc_id", k)


def mmr_select(relevance: np.ndarray, vectors: np.ndarray, k: int, lam: float = 0.7) -> tuple[list[int], list[float]]:
    """Greedy: each pick has the greatest lam * relevance - (1 - lam) * similarity to what is picked; the first of equals wins."""
    n = len(relevance)
    norm = np.sqrt((vectors * vectors).sum(1))
    unit = np.divide(vectors, norm[:, None], out=np.zeros_like(vectors), where=norm[:, None] > 0)
    worst, left = np.full(n, -np.inf), np.ones(n, bool)
    picks, scores = [], []
    for _ in range(min(k, n)):
        s = lam * relevance - (1 - lam) * np.where(np.isinf(worst), 0.0, worst)
        s[~left] = -np.inf
        i = int(np.argmax(s))
        picks.append(i)
        scores.append(float(s[i]))
        left[i] = False
        worst = np.maximum(worst, unit @ unit[i])
    return picks, scores


def mmr(pool: DataFrame, k: int = 10, lam: float = 0.7, group: str = "query_id", item: str = "doc_id", relevance: str = "relevance", vector: str = "vector") -> DataFrame:
    """(group, item, rank, mmr, relevance): each group's pool re-ranked; cut the pool by top-k first, it is one task's work."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, item], ascending=[False, True], kind="stable")
        picks, scores = mmr_select(pdf[relevance].to_numpy(float), np.stack([np.asarray(v, float) for v in pdf[vector]]), k, lam)
        out = pdf.iloc[picks]
        return pd.DataFrame({group: out[group].to_numpy(), item: out[item].to_numpy(), "rank": np.arange(1, len(picks) + 1, dtype="int32"), "mmr": scores, "relevance": out[relevance].to_numpy(float)})

    return pool.select(group, item, relevance, vector).groupBy(group).applyInPandas(run, f"{group} long, {item} long, rank int, mmr double, relevance double")


def mmr_by(pool: DataFrame, relevance, similarity, k: int = 10, lam: float = 0.7, group: str = "query_id", item: str = "doc_id") -> DataFrame:
    """(group, item, rank, mmr): :func:`mmr` with scorers of the caller's own.

    ``relevance(row)`` and ``similarity(row, row)`` take rows of the pool as
    dicts. Cut the pool by top-k first; each is called once for a row, and once
    for a row and a pick. Equal scores are settled by the order of the items.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(item, kind="stable").to_dict("records")
        own = [float(relevance(r)) for r in rows]
        worst, left, out = [None] * len(rows), list(range(len(rows))), []
        while left and len(out) < k:
            score = {i: lam * own[i] - (1 - lam) * (worst[i] or 0.0) for i in left}
            best = max(left, key=lambda i: (score[i], -i))
            out.append((rows[best][group], rows[best][item], len(out) + 1, score[best]))
            left.remove(best)
            for i in left:
                near = float(similarity(rows[i], rows[best]))
                worst[i] = near if worst[i] is None else max(worst[i], near)
        return pd.DataFrame(out, columns=[group, item, "rank", "mmr"]).astype({"rank": "int32"})

    return pool.groupBy(group).applyInPandas(run, f"{group} long, {item} long, rank int, mmr double")


def diversity(df: DataFrame, group: str = "query_id", vector: str = "vector") -> DataFrame:
    """(group, diversity): mean pairwise 1 - cosine; 1 for fewer than two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, float) for x in pdf[vector]])
        norm = np.sqrt((v * v).sum(1))
        u = np.divide(v, norm[:, None], out=np.zeros_like(v), where=norm[:, None] > 0)
        n = len(u)
        total = float((u.sum(0) ** 2).sum() - (u * u).sum()) / 2
        return pd.DataFrame({group: [pdf[group].iloc[0]], "diversity": [1.0 if n < 2 else 1 - total / (n * (n - 1) / 2)]})

    return df.select(group, vector).groupBy(group).applyInPandas(run, f"{group} long, diversity double")


def centroid(df: DataFrame, by: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(by, centroid): the element-wise mean, or the weighted one (undivided where the weights sum to 0)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(by, w.alias("w"), F.posexplode(vector).alias("i", "x"))
    per = rows.groupBy(by, "i").agg(F.sum(F.col("x").cast("double") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    value = F.when(F.col("w") != 0, F.col("s") / F.col("w")).otherwise(F.col("s"))
    return per.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", value.alias("v")))), lambda e: e["v"]).alias("centroid"))
