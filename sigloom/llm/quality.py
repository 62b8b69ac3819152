"""Quality rules as weak supervision: rules vote or abstain, EM finds their accuracies, the posterior decides.

Each rule reads whole-text measures of a document and votes good (1), bad (-1)
or abstains (0). The votes of a document form one of 3**len(RULES) patterns at
most, so one aggregate over all documents gives a table whose size has that
bound however large the corpus; expectation-maximisation on the pattern counts
is then exact, as if it had seen every row. Its model has, for each rule and
each class, the chance of each vote where it votes (the accuracies of its good
and of its bad votes may differ); an abstention says nothing. Documents whose posterior quality is ``KEEP`` or more stay,
even if some rule voted against them.

The measures come from one numpy pass over the bytes of Arrow batches; only a
vote code leaves it, and no text is shuffled.

Defined results: a text without words (null, empty, blank or punctuation only)
has posterior 0 and goes; rows are judged one by one, so repeated rows share
their fate and null doc_ids are values like others; a posterior of exactly
``KEEP`` stays; an empty table gives an empty result. Extra columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import textkernel as tk
from sigloom.llm.columns import rest, unpacked
from sigloom.llm.graph import checkpoint, small_batches

KEEP = 0.5
ROUNDS = 100
PRIOR = 0.02
#: Code of texts without words.
NO_WORDS = -1

_STOP = (
    "the of and to in is it that for on with as be by this was are from at or an not but have has "
    "der die das und ist von den zu mit ein eine nicht im auf für des dem sich als auch "
    "de la le les des et en un une du que qui est pour dans sur par pas au avec "
    "el los las y una por con para del se su al lo como más"
).split()
LETTER, UPPER, SYMBOL, PIPE, BANG, STOPMARK, SPACE, OTHER, FOREIGN = range(9)
_CLASS = np.full(256, OTHER, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = SPACE if _c.isspace() else UPPER if _c.isupper() else LETTER if _c.isalpha() else PIPE if _c == "|" else BANG if _c == "!" else STOPMARK if _c in ".?" else SYMBOL if _c in "#$%&*~^=+{}<>[]\\_@`" else OTHER
_CLASS[128:] = LETTER
#: Bytes that begin a character beyond the Latin letters.
_CLASS[0xC8:] = FOREIGN
#: Share of such bytes from which on rules that know words and marks of Latin scripts abstain.
OTHER_SCRIPT = 0.15


def _stop_hashes() -> np.ndarray:
    offsets, data = tk.buffers(pa.array(_STOP))
    return np.unique(tk.hash_spans(data, offsets[:-1], offsets[1:]))


STOP = _stop_hashes()


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """Whole-text measures of each row."""
    offsets, data = tk.buffers(texts)
    rows = len(offsets) - 1
    size = np.diff(offsets)
    at = np.repeat(np.arange(rows) * 9, size)
    at += _CLASS[data]
    per = np.bincount(at, minlength=rows * 9).reshape(rows, 9)
    words = tk.Words(*tk.buffers(pc.utf8_lower(texts)), tk.IS_BREAK)
    n = np.diff(words.first)
    known = STOP[np.minimum(np.searchsorted(STOP, words.hash), len(STOP) - 1)] == words.hash
    same = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    first, gram = words.windows(3)
    tagged = np.sort((words.doc[first].astype(np.uint64) << np.uint64(40)) | (gram >> np.uint64(24)))
    again = tagged[1:] == tagged[:-1]
    count = lambda where: np.bincount(where, minlength=rows)
    full = np.maximum(n, 1)
    visible = np.maximum(size - per[:, SPACE], 1)
    letters = per[:, LETTER] + per[:, UPPER] + per[:, FOREIGN]
    return {
        "words": n,
        "foreign": per[:, FOREIGN] / np.maximum(letters, 1),
        "letters": letters / visible,
        "upper": per[:, UPPER] / np.maximum(letters, 1),
        "symbols": (per[:, SYMBOL] + per[:, PIPE]) / full,
        "pipes": per[:, PIPE] / full,
        "bangs": per[:, BANG] / full,
        "repeats": count(words.doc[1:][same]) / full,
        "grams": count((tagged[1:][again] >> np.uint64(40)).astype(np.int64)) / np.maximum(n - 2, 1),
        "stops": count(words.doc[known]) / full,
        "length": letters / full,
        "marks": (per[:, STOPMARK] + per[:, BANG]) / full,
    }


def _rule(value: np.ndarray, good: np.ndarray, bad: np.ndarray, able: np.ndarray) -> np.ndarray:
    return np.where(able & bad, -1, np.where(able & good, 1, 0))


def _latin(m: dict[str, np.ndarray], least: int) -> np.ndarray:
    return (m["words"] >= least) & (m["foreign"] < OTHER_SCRIPT)


#: name -> votes of a batch, from its measures. A rule may know one side only: shortness alone speaks against no text.
RULES = {
    "long_enough": lambda m: _rule(m["words"], m["words"] >= 50, np.zeros(len(m["words"]), bool), m["words"] >= 0),
    "letters": lambda m: _rule(m["letters"], m["letters"] >= 0.9, m["letters"] < 0.75, m["words"] >= 3),
    "few_capitals": lambda m: _rule(m["upper"], m["upper"] <= 0.2, m["upper"] >= 0.5, m["words"] >= 5),
    "few_symbols": lambda m: _rule(m["symbols"], m["symbols"] <= 0.05, m["symbols"] >= 0.5, m["words"] >= 3),
    "few_pipes": lambda m: _rule(m["pipes"], m["pipes"] <= 0.02, m["pipes"] >= 0.3, m["words"] >= 3),
    "few_bangs": lambda m: _rule(m["bangs"], m["bangs"] <= 0.02, m["bangs"] >= 0.3, m["words"] >= 5),
    "few_repeats": lambda m: _rule(m["repeats"], m["repeats"] <= 0.05, m["repeats"] >= 0.3, m["words"] >= 10),
    "few_grams_again": lambda m: _rule(m["grams"], m["grams"] <= 0.1, m["grams"] >= 0.5, m["words"] >= 20),
    "function_words": lambda m: _rule(m["stops"], m["stops"] >= 0.1, m["stops"] < 0.02, _latin(m, 30)),
    "word_length": lambda m: _rule(m["length"], (m["length"] >= 3) & (m["length"] <= 10), (m["length"] < 1.5) | (m["length"] > 15), _latin(m, 10)),
    "sentences": lambda m: _rule(m["marks"], (m["marks"] >= 0.012) & (m["marks"] <= 0.3), (m["marks"] < 0.002) | (m["marks"] >= 0.5), _latin(m, 60)),
}


def vote_codes(texts: pa.Array) -> np.ndarray:
    """The votes of each row as one number in base 3 (abstention 1); NO_WORDS for a text without words."""
    m = measures(texts)
    code = np.zeros(len(texts), np.int32)
    for vote in RULES.values():
        code = code * 3 + vote(m).astype(np.int32) + 1
    return np.where(m["words"] > 0, code, NO_WORDS).astype(np.int32)


def votes_of(codes: np.ndarray) -> np.ndarray:
    """(codes, rules) votes -1, 0 or 1."""
    k = len(RULES)
    return np.stack([codes // 3 ** (k - 1 - j) % 3 for j in range(k)], axis=1).astype(np.int64) - 1


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Posterior probability of good quality for each vote pattern, by EM over the pattern counts.

    It starts from the all-must-pass rule (a pattern with a bad vote is likely
    bad). The prior of each chance is that of a rule better than a guess, with
    the weight of ``PRIOR`` of the documents: without it, a rule that alone
    sees one kind of bad text would be taken for an erring one.
    """
    if not len(codes):
        return np.zeros(0)
    votes = votes_of(codes) + 1
    onehot = votes[:, :, None] == np.arange(3)
    onehot[:, :, 1] = False
    post = np.where((votes == 0).any(axis=1), 0.1, 0.9)
    prior = PRIOR * counts.sum() * np.array([[0.02, 0.0, 0.98], [0.6, 0.0, 0.4]])
    for _ in range(rounds):
        logs = []
        for q, base in zip((post, 1 - post), prior):
            w = counts * q
            chance = np.tensordot(w, onehot, (0, 0)) + base
            chance /= chance.sum(axis=1, keepdims=True)
            chance[:, 1] = 1.0
            logs.append(np.log(w.sum() + 1.0) + np.log(chance)[np.arange(votes.shape[1]), votes].sum(axis=1))
        new = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            post = new
            break
        post = new
    return post


def _code_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in tk.chunks(batches):
        yield pa.RecordBatch.from_arrays([*(part[n] for n in part.schema.names if n != "text"), pa.array(vote_codes(part["text"]))], [*(n for n in part.schema.names if n != "text"), "code"])


def posteriors(docs: DataFrame) -> dict[int, float]:
    """Posterior of each vote pattern in the corpus; from the counts over all documents."""
    small_batches(docs.sparkSession)
    return _posteriors(docs.select("text").filter("text is not null").mapInArrow(_code_batches, "code int"))


def _posteriors(codes: DataFrame) -> dict[int, float]:
    rows = sorted((r["code"], r["n"]) for r in codes.filter(F.col("code") != NO_WORDS).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect())
    seen = np.array([c for c, _ in rows], np.int64)
    return dict(zip(seen.tolist(), fit(seen, np.array([n for _, n in rows], float)).tolist()))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, posterior, good_votes, bad_votes) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    # the texts are read once: what is left of each is its code
    codes = checkpoint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_code_batches, "doc_id long, code int"))
    by = _posteriors(codes)
    seen = np.array(sorted(by), np.int64)
    votes = votes_of(seen) if len(seen) else np.zeros((0, len(RULES)), np.int64)
    rows = [(int(c), float(round(by[c], 6)), int((v > 0).sum()), int((v < 0).sum())) for c, v in zip(seen.tolist(), votes)]
    table = spark.createDataFrame(rows, "code int, posterior double, good_votes int, bad_votes int")
    # the table has 3**len(RULES) rows at most
    out = codes.join(F.broadcast(table), "code", "left")
    return out.select("doc_id", F.coalesce("posterior", F.lit(0.0)).alias("posterior"), F.coalesce("good_votes", F.lit(0)).alias("good_votes"), F.coalesce("bad_votes", F.lit(0)).alias("bad_votes"))


def kept(docs: DataFrame) -> DataFrame:
    """:func:`score` of the documents that stay."""
    return score(docs).filter(F.col("posterior") >= KEEP)


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that stay; columns as given."""
    good = np.array(sorted(c for c, p in posteriors(docs).items() if round(p, 6) >= KEEP), np.int32)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches):
            yield part.filter(pa.array(np.isin(vote_codes(part["text"]), good)))

    plain = docs.select(rest(docs), "text")
    return plain.mapInArrow(keep, plain.schema).select(*unpacked(docs))
