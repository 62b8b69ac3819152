"""HTML extraction by maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive and tags
negative, with weights from labelled pages, and one linear scan finds the
contiguous region of the greatest sum: the content. Its text is returned, with
line breaks at block tags and entities decoded.

Labels come from the pages themselves: one that marks its content with an
``<article>`` or ``<main>`` element is a labelled page. From a bounded sample of
those (``SAMPLE_PAGES``; a deterministic one, by hash of the page) the weights
are fitted: the log-odds that a token of a kind stands in content rather than
outside, words by the block they stand in, tags by name, moved to the side of
zero that their sort requires. The labelling tags themselves have no weight, so
that pages without them are scored alike.

Scripts, styles, comments and the head's other raw text are no tokens.

Defined results: null html gives null text; html without words gives an empty
text; of regions with equal sums the first, and of those the shortest, is taken;
rows are extracted one by one, so repeated rows and null ids need no rule; very
long pages are read whole. Without labelled pages the weights are ``DEFAULTS``.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are fitted on, at most.
SAMPLE_PAGES = 2000
#: Weights of kinds that no labelled page showed: a word, and a tag.
DEFAULTS = {"word": 0.5, "tag": -2.0}
#: Least distance of a weight from zero.
LEAST = 0.05
LABELS = ("article", "main")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
_BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def tokens(page: str) -> list[tuple[str, str]]:
    """("", text) runs and (tag name, "open" or "close") in order; text runs aren't empty."""
    out: list[tuple[str, str]] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            run = page[at : m.start()]
            if not run.isspace():
                out.append(("", run))
        at = m.end()
        if m.group(3):
            out.append((m.group(3).lower(), "close" if m.group(2) else "open"))
    rest = page[at:]
    if rest and not rest.isspace():
        out.append(("", rest))
    return out


def kinds(toks: list[tuple[str, str]]) -> list[tuple[str, int]]:
    """(kind, words) of each token: text by the tag it stands in, tags by name; labelling tags have no kind."""
    out, stack, depth = [], [], {}
    for name, what in toks:
        if not name:
            out.append(("word:" + (stack[-1] if stack else ""), len(what.split())))
            continue
        out.append(("" if name in LABELS else "tag:" + name, 0))
        if name in LABELS or name in _VOID:
            continue
        if what == "open":
            if name in ("p", "li", "b") and stack and stack[-1] == name:
                continue  # closed by the next of its kind
            stack.append(name)
            depth[name] = depth.get(name, 0) + 1
        elif depth.get(name):
            while True:
                gone = stack.pop()
                depth[gone] -= 1
                if gone == name:
                    break
    return out


def count_page(page: str) -> dict[tuple[str, bool], int] | None:
    """How many tokens of each kind stand in and out of the marked content; None for a page without a mark."""
    toks = tokens(page)
    label = next((n for n in LABELS if (n, "open") in toks), None)
    if label is None:
        return None
    a = toks.index((label, "open"))
    b = len(toks) - 1 - toks[::-1].index((label, "close")) if (label, "close") in toks else len(toks)
    found: Counter = Counter()
    for i, (kind, words) in enumerate(kinds(toks)):
        if kind:
            found[kind, a < i < b] += words or 1
    return dict(found)


def weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each kind, words positive and tags negative."""
    names = {k for k, _ in counts}
    total = {s: sum(n for (_, t), n in counts.items() if t == s) + 1.0 for s in (True, False)}
    out = {}
    for k in sorted(names):
        odds = math.log((counts.get((k, True), 0) + 1) / total[True]) - math.log((counts.get((k, False), 0) + 1) / total[False])
        out[k] = max(odds, LEAST) if k.startswith("word:") else min(odds, -LEAST)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: Counter = Counter()
        for page in batch["html"].to_pylist():
            total.update(count_page(page) or {})
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], ["kind", "inside", "n"])


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from a sample of the labelled pages: those of the least hashes.

    The hashes alone are sorted; the pages at or under the last one that counts
    are then read where they are.
    """
    marked = pages.select("html", F.xxhash64("page_id", "html").alias("h")).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    last = marked.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    chosen = marked.filter(F.col("h") <= last if last is not None else F.lit(False)).select("html")
    rows = chosen.mapInArrow(_count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    return weights({(r["kind"], r["inside"]): r["n"] for r in rows})


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """(first, end, sum) of the contiguous region of the greatest sum, in one pass; (0, 0, 0) if none is positive."""
    best = (0, 0, 0.0)
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best[2] + 1e-12:
            best = (start, i + 1, total)
    return best


def extract(page: str, model: dict[str, float]) -> tuple[str, int, float]:
    """(text, words, score) of the content of a page."""
    toks = tokens(page)
    scores = []
    for kind, words in kinds(toks):
        if not kind:
            scores.append(0.0)
        elif kind.startswith("word:"):
            scores.append(model.get(kind, DEFAULTS["word"]) * words)
        else:
            scores.append(model.get(kind, DEFAULTS["tag"]))
    a, b, total = best_region(scores)
    parts, words = [], 0
    for name, what in toks[a:b]:
        if not name:
            parts.append(html_lib.unescape(what))
            words += len(what.split())
        elif name in _BLOCK:
            parts.append("\n")
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), words, total


def extract_pages(pages: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """(page_id, text, n_words, score) of every page."""
    model = fit(pages) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [None if p is None else extract(p, model) for p in part["html"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["page_id"],
                        pa.array([f and f[0] for f in found], pa.string()),
                        pa.array([f and f[1] for f in found], pa.int32()),
                        pa.array([f and round(f[2], 6) for f in found], pa.float64()),
                    ],
                    ["page_id", "text", "n_words", "score"],
                )

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string, n_words int, score double")
