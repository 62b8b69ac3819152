"""License scan by conditional compression.

1. Every licence word (``CUES``, which may be wrapped over two lines) is looked at
   with each template's own number of words on its two sides (and ``MAX_DIFF`` more),
   whatever the lines and paragraphs: so a notice and a full text are met whole
   however they are wrapped. The cue test runs on whole texts in the JVM first, so
   other documents never leave it. A template that lacks too many words in the block
   to be confirmed isn't tried.
2. The block is compressed alone and with the template as zstandard raw dictionary.
   The reduction, 1 - (size with it) / (size alone), is the share of the block that
   the template explains; templates are ranked by it, and those under
   ``MIN_REDUCTION`` are out.
3. In the order of their ranks they are confirmed on words: the template's words
   must occur in order in a stretch of the block that holds the cue, the words that
   tell a licence from its neighbours among them, and the exact wording differences
   (words missing from, and put into, the stretch) may be ``MAX_DIFF`` of its words.
   The first one confirmed and all within ``NEAR_BEST`` of its reduction are the
   winners; the one with the most words in common, less its differences, is
   reported. What it covers is done with; later cues are looked at without it.

Defined results: null and empty texts have no block; of winners equally good the one
with fewer differences wins, then the greater reduction, then the name; each word
belongs to one licence; lines with cues at most ``GAP`` apart are a group, which
reports a licence once, with its first line (or the licence's, if that is earlier);
the reduction reported is that of the lines that the licence stands on; rows are
scanned one by one, so repeated rows repeat; null doc_ids are values like others;
very long texts are read whole. Extra columns are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.llm import license_texts

#: Cues as an expression that Java and Python read alike; every template holds one.
_S = r"[\s#*/;%-]+"  # between words, also over the end of a line and a comment's marker
CUES = rf"(?i)\b(licen[sc]e[sd]?|unlicense|copyright|permission{_S}is{_S}hereby|redistribution{_S}and{_S}use|public{_S}domain|creative{_S}commons|spdx-license-identifier|warrant(?:y|ies))\b|\bCC[\s-](BY|0)\b|\bCC0\b|\bGNU{_S}[AL]?GPL\b"
GAP = 2
MIN_REDUCTION = 0.1
NEAR_BEST = 0.25
MAX_DIFF = 0.2
LEVEL = 19
#: Templates of more words are aligned by what occurs once in both sides.
LONG = 400
_CUE = re.compile(CUES)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words(text: str) -> list[str]:
    """Words in lower case; points and hyphens inside a word belong to it (so versions and suffixes count)."""
    return [w.lower() for w in _WORD.findall(text)]


class Template:
    """A licence text with what the scan needs of it."""

    def __init__(self, name: str, license: str, text: str, must: frozenset[str]):
        self.name, self.license, self.text, self.must = name, license, text, must
        self.words = words(text)
        self.counts = Counter(self.words)
        self.slack = int(MAX_DIFF * len(self.words))
        self.reach = len(self.words) + self.slack
        known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def may_be_in(self, have: Counter, size: int) -> bool:
        """Whether so many of the words are there that the template could be confirmed."""
        least = len(self.words) - self.slack
        if size < least or not self.must <= have.keys():
            return False
        return sum(min(n, have[w]) for w, n in self.counts.items() if w in have) >= least


@functools.lru_cache(maxsize=1)
def templates() -> list[Template]:
    return [Template(*one) for one in license_texts.templates(words)]


_plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False).compress


def reduction(template: Template, block: str) -> float:
    """The share of the block that the template explains."""
    raw = block.encode()
    return 1 - len(template.compress(raw)) / len(_plain(raw))


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (in order of the first number) that rises in the second one."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        at = bisect.bisect_left(tops, b)
        back[i] = ends[at - 1] if at else -1
        if at == len(tops):
            tops.append(b)
            ends.append(i)
        else:
            tops[at], ends[at] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _all_runs(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]]


def matching(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Runs (place in a, place in b, words) that both have, in order.

    Long texts are first split where four words occur once on either side, which
    keeps the work near to their length.
    """
    if len(a) <= LONG:
        return _all_runs(a, b)
    one, two = ({g: 0 for g, n in Counter(zip(x, x[1:], x[2:], x[3:])).items() if n == 1} for x in (a, b))
    for side, known in ((a, one), (b, two)):
        for i, g in enumerate(zip(side, side[1:], side[2:], side[3:])):
            if g in known:
                known[g] = i
    found, i, j = [], 0, 0
    for x, y in [*_rising(sorted((p, two[g]) for g, p in one.items() if g in two)), (len(a), len(b))]:
        if x < i or y < j:
            continue  # inside what the last one covers
        if i < x and j < y:
            split = x - i < len(a)  # else nothing was found to split at
            found += [(i + p, j + q, n) for p, q, n in (matching if split else _all_runs)(a[i:x], b[j:y])]
        if x < len(a):
            n = 4
            while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n]:
                n += 1
            found.append((x, y, n))
            i, j = x + n, y + n
    return found


def stretch(template: list[str], block: list[str]) -> tuple[int, int]:
    """Where in the block the template stands: about the longest match, as far as it saves differences."""
    first, end_ = 0, len(block)
    if len(template) <= LONG:
        whole = difflib.SequenceMatcher(None, template, block, autojunk=False).find_longest_match()
        if not whole.size:
            return 0, 0
        # no stretch that can be confirmed goes further
        slack = int(MAX_DIFF * len(template))
        first, end_ = max(0, whole.b - whole.a - slack), whole.b + len(template) - whole.a + slack
    best, lo, hi = 0, 0, 0
    gain, start, end = 0, 0, 0
    for _, b, size in matching(template, block[first:end_]):
        # a match saves its words twice, as missing and as added ones; the words before it are added
        if gain <= b - end:
            gain, start = 0, b
        else:
            gain -= b - end
        gain, end = gain + 2 * size, b + size
        if gain > best:
            best, lo, hi = gain, start, end
    return first + lo, first + hi


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str], str]:
    """(words missing, words added, exact differences) between a template and a stretch of a block."""
    missing, added, notes, i, j = [], [], [], 0, 0
    for a, b, n in [*matching(template, block), (len(template), len(block), 0)]:
        if i < a or j < b:
            missing += template[i:a]
            added += block[j:b]
            notes.append(f"-[{' '.join(template[i:a])}] +[{' '.join(block[j:b])}]")
        i, j = a + n, b + n
    return missing, added, "; ".join(notes)


class _Text:
    """The words of a text and what of them is done with."""

    def __init__(self, text: str):
        self.text = text
        found = list(_WORD.finditer(text))
        self.start, self.end = [m.start() for m in found], [m.end() for m in found]
        self.words = [m.group().lower() for m in found]
        self.used: list[tuple[int, int]] = []
        # of cues near one another long templates see the same words
        self.counted = functools.lru_cache(maxsize=64)(lambda lo, hi: Counter(self.words[lo:hi]))
        self.alone = functools.lru_cache(maxsize=64)(lambda lo, hi: len(_plain(self.raw(lo, hi))))
        self.share = functools.lru_cache(maxsize=1024)(lambda t, lo, hi: 1 - len(t.compress(self.raw(lo, hi))) / self.alone(lo, hi))
        self.fit = functools.lru_cache(maxsize=1024)(self._fit)

    def raw(self, lo: int, hi: int) -> bytes:
        return self.text[self.start[lo] : self.end[hi - 1]].encode()

    def _fit(self, t: Template, lo: int, hi: int) -> tuple[int, int, tuple | None]:
        """Where in lo..hi the template's best stretch is, and its differences if they are few enough."""
        a, b = stretch(t.words, self.words[lo:hi])
        a, b = lo + a, lo + b
        # a stretch far too short or long needs no look at its words
        if abs(b - a - len(t.words)) > t.slack:
            return a, b, None
        missing, added, notes = differences(t.words, self.words[a:b])
        few = len(missing) + len(added) <= t.slack and not t.must & set(missing)
        return a, b, (len(missing), len(added), notes) if few else None

    def free(self, first: int, last: int) -> tuple[int, int] | None:
        """The words around first..last that no licence has; None if one has some of these."""
        lo, hi = 0, len(self.words)
        for a, b in self.used:
            if b <= first:
                lo = max(lo, b)
            elif a >= last:
                hi = min(hi, a)
            else:
                return None
        return lo, hi

    def confirm(self, t: Template, lo: int, hi: int, first: int, last: int) -> tuple | None:
        """The best stretch of lo..hi that holds some of the words first..last, if it is the template's."""
        while hi - lo >= len(t.words) - t.slack:
            a, b, found = self.fit(t, lo, hi)
            if b <= a:
                return None
            if b <= first:
                lo = b
            elif a >= last:
                hi = a
            else:
                return found and (*found, a, b)
        return None

    def best(self, able: list[Template], first: int, last: int) -> tuple | None:
        """(template, missing, added, differences, words) of the licence at the words first..last, and all words of winners there."""
        room = self.free(first, last)
        if room is None:
            return None
        ranked = []
        for t in able:
            lo, hi = max(room[0], first - t.reach), min(room[1], last + t.reach)
            if not t.may_be_in(self.counted(lo, hi), hi - lo):
                continue
            share = self.share(t, lo, hi)
            if share >= MIN_REDUCTION:
                ranked.append((-share, t.name, t, lo, hi))
        winners, least = [], -1.0
        for share, name, t, lo, hi in sorted(ranked, key=lambda x: x[:2]):
            if -share < least:
                break
            found = self.confirm(t, lo, hi, first, last)
            if found:
                missing, added, notes, a, b = found
                if not winners:
                    least = -share - NEAR_BEST
                winners.append((-(len(t.words) - 2 * missing - added), missing + added, share, name, t, missing, added, notes, a, b))
        if not winners:
            return None
        _, _, _, _, t, missing, added, notes, a, b = min(winners, key=lambda x: x[:4])
        over = [w[-2:] for w in winners if w[-2] < b and w[-1] > a]
        return t, missing, added, notes, a, b, min(x for x, _ in over), max(y for _, y in over)


def identify_all(text: str) -> list[tuple[int, str, str, float, int, int, str]]:
    """(line, license, template, reduction, missing, added, differences) of every licence of a text."""
    out: list[tuple] = []
    cues = [m.span() for m in _CUE.finditer(text)]
    if not cues:
        return out
    doc = _Text(text)
    have = Counter(doc.words)
    able = [t for t in templates() if t.may_be_in(have, len(doc.words))]
    names: set[str] = set()  # of the group
    group = last = None
    line = at = 0
    for begin, end in cues if able else ():
        line += text.count("\n", at, begin)
        at = begin
        if last is None or line - last > GAP:
            group, names = line, set()
        last = line + text.count("\n", begin, end)
        i, j = bisect.bisect_right(doc.end, begin), bisect.bisect_left(doc.start, end)
        found = doc.best(able, i, max(j, i + 1))
        if not found:
            continue
        t, missing, added, notes, a, b, lo, hi = found
        doc.used.append((lo, hi))
        if t.license in names:
            continue
        names.add(t.license)
        from_, to = doc.start[a], doc.end[b - 1]
        stop = text.find("\n", to)
        own = text[text.rfind("\n", 0, from_) + 1 : stop if stop >= 0 else len(text)]
        here = line - text.count("\n", from_, begin) if from_ < begin else line
        out.append((min(group, here), t.license, t.name, round(reduction(t, own), 4), missing, added, notes))
    return out


_FIELDS = {"doc_id": pa.int64(), "line": pa.int32(), "license": pa.string(), "template": pa.string(), "reduction": pa.float64(), "missing": pa.int32(), "added": pa.int32(), "differences": pa.string()}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
            rows += [(doc, *one) for one in identify_all(text)]
        cols = list(zip(*rows)) if rows else [[]] * len(_FIELDS)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, _FIELDS.values())], list(_FIELDS))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, line, license, template, reduction, missing, added, differences) of every licence; license is its SPDX identifier."""
    some = docs.select("doc_id", "text").filter(F.col("text").rlike(CUES))
    return some.mapInArrow(_scan, "doc_id long, line int, license string, template string, reduction double, missing int, added int, differences string")
