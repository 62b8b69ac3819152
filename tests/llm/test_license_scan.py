import random
import textwrap

import pytest

from sigloom.llm import license_scan as ls
from sigloom.llm import license_texts as lt

BY = {t.name: t for t in ls.templates()}
PROSE = "the river runs by a quiet town where people meet on market days and talk about rain bread and old songs while children play near bridges".split()


def wrapped(text, mark="", width=80):
    return "\n".join(mark + x for x in textwrap.wrap(" ".join(text.split()), width, break_on_hyphens=False))


def found(text):
    return [(line, spdx) for line, spdx, *_ in ls.identify_all(text)]


def test_every_template_names_itself():
    for t in ls.templates():
        assert ls._CUE.search(t.text), t.name
        (line, spdx, name, reduction, missing, added, notes), *more = ls.identify_all(t.text.strip())
        assert (line, spdx, missing, added, notes) == (0, t.license, 0, 0, "") and reduction > 0.4 and not more


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_in_prose(mark):
    """Statements, notices and full texts as they stand in files: wrapped, behind comment marks, among other words."""
    r = random.Random(1)
    for t in ls.templates():
        if mark and len(t.words) > ls.LONG:
            continue
        around = [" ".join(r.choice(PROSE) for _ in range(60)) for _ in range(2)]
        got = ls.identify_all(f"{around[0]}\n{wrapped(t.text, mark)}\n{around[1]}")
        assert [(x[0], x[1], x[4], x[5]) for x in got] == [(1, t.license, 0, 0)], t.name


def test_compression_ranks_the_right_template_first():
    for t in ls.templates():
        if len(t.words) > 8 and not t.name.startswith(tuple(f"{spdx}-" for spdx in lt.NAMES)):
            size = {o.name: len(o.compress(t.text.encode())) for o in ls.templates()}
            assert size[t.name] == min(size.values()), t.name


def test_licences_that_differ_by_a_clause_or_a_number():
    two, three = BY["BSD-2-Clause-text"].text, BY["BSD-3-Clause-text"].text
    assert found(wrapped(two)) == [(0, "BSD-2-Clause")] and found(wrapped(three)) == [(0, "BSD-3-Clause")]
    regents = three.replace("copyright holder nor", "University nor").replace("COPYRIGHT HOLDERS AND", "REGENTS AND")
    assert found(wrapped("Copyright (c) The Regents. All rights reserved. " + regents))[-1][1] == "BSD-3-Clause"
    assert found("This work is licensed under the GNU General Public License, version 2.") == [(0, "GPL-2.0")]
    assert found("Licensed under the GNU General Public License v3.0") == [(0, "GPL-3.0")]
    assert found("Licensed under CC BY-NC 4.0.") == [(0, "CC-BY-NC-4.0")]
    assert found(wrapped(BY["GPL-3.0-or-later-notice"].text.replace("free software;", "free software:"), "// ")) == [(0, "GPL-3.0-or-later")]
    assert found("SPDX-License-Identifier: LGPL-2.1") == [(0, "LGPL-2.1")]
    assert found(wrapped(BY["ISC-text"].text)) == [(0, "ISC")] and found(wrapped(BY["0BSD-text"].text)) == [(0, "0BSD")]


def test_what_is_no_licence():
    for text in ("my driver's licence is lost", "Licensed under the Foo License.", "limitations under the License.", "a warranty of two years", "Licensed under the License", "the public domain of thought"):
        assert found(text) == [], text


def test_a_file_as_found_in_real_code():
    text = "#!/usr/bin/env python\n# Copyright (c) 2021 Some One\n#\n" + wrapped(BY["MIT-grant"].text.replace("conditions: ", "conditions:\n\n"), "# ") + "\n#\n# THE SOFTWARE IS PROVIDED AS IS.\n\nimport os\n"
    assert [x[1] for x in ls.identify_all(text)] == ["MIT"]


def test_wording_differences():
    notice = BY["MIT-text"].text.replace("free of charge", "at no charge")
    (_, spdx, name, _, missing, added, notes), *more = ls.identify_all(notice)
    assert (spdx, name, missing, added, notes) == ("MIT", "MIT-text", 2, 2, "-[free of] +[at no]") and not more
    (_, spdx, _, _, missing, added, notes), *_ = ls.identify_all("Licensed under the very permissive MIT License.".replace("permissive ", ""))
    assert (spdx, missing, added, notes) == ("MIT", 0, 1, "-[] +[very]")
    long = BY["GPL-2.0-text"].words
    missing, added, notes = ls.differences(long, long[:700] + ["new", "words"] + long[704:])
    assert (missing, added) == (long[700:704], ["new", "words"]) and notes.count("-[") == 1


def alignment(a, b):
    """Length of the longest common subsequence: brute force."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_winner_equals_brute_force(seed):
    """Altered notices in prose: the licence is that of the template which fits some stretch best, every stretch tried."""
    r = random.Random(seed)
    some = [t for t in ls.templates() if len(t.words) <= 60 and not t.name.endswith("-spdx")]
    for t in r.sample(some, 12):
        w = t.text.split()
        for _ in range(r.randint(0, t.slack)):
            w[r.randrange(len(w))] = r.choice(PROSE)
        block = " ".join([r.choice(PROSE) for _ in range(30)] + w + [r.choice(PROSE) for _ in range(30)])
        words = ls.words(block)
        best = {}
        for o in some:
            for size in range(len(o.words) - o.slack, len(o.words) + o.slack + 1):
                for a in range(len(words) - size + 1):
                    part = words[a : a + size]
                    if part[0] in o.counts and part[-1] in o.counts and o.must <= set(part):
                        common = alignment(o.words, part)
                        wrong = len(o.words) + size - 2 * common
                        if wrong <= o.slack:
                            best[o.license] = max(best.get(o.license, -99), common - wrong)
        got = [x[1] for x in ls.identify_all(block)]
        if not best:
            assert got == []
        elif got:
            assert best[got[0]] >= max(best.values()) - 1
        else:  # only the cue itself may have gone
            assert not ls._CUE.search(block) or max(best.values()) <= 3


def test_rows_of_all_sorts(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "Released under the MIT License."
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, None, "a"),
        (2, "", "b"),
        (3, f"some prose\n{apache}\nmore", "c"),
        (3, f"some prose\n{apache}\nmore", "c"),
        (None, mit, "d"),
        (5, "word " * 200_000 + "\n" + gpl, "e"),
        (6, f"{apache}\nand\nLicensed under CC BY 4.0.", "f"),
        (7, "a licence to read", "g"),
        (8, "prose " * 40 + mit.lower() + " prose" * 40, "h"),
        (9, f"{mit}\n{mit}\n\n\n\n\n{mit}", "i"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = sorted(((r.doc_id, r.line, r.license) for r in ls.scan_licenses(df).collect()), key=str)
    want = [(3, 1, "Apache-2.0")] * 2 + [(None, 0, "MIT"), (5, 1, "GPL-3.0"), (6, 0, "Apache-2.0"), (6, 0, "CC-BY-4.0"), (8, 0, "MIT"), (9, 0, "MIT"), (9, 6, "MIT")]
    assert got == sorted(want, key=str)
    assert ls.scan_licenses(df.limit(0)).count() == 0


def test_notices_one_after_another():
    both = "\n\n".join(wrapped(BY[n].text) for n in ("MIT-text", "GPL-3.0-or-later-notice", "BSD-3-Clause-text", "Apache-2.0-notice"))
    assert [x[1] for x in ls.identify_all(both)] == ["MIT", "GPL-3.0-or-later", "BSD-3-Clause", "Apache-2.0"]
    assert [x[1] for x in ls.identify_all("Released into the public domain.\nThis is free and unencumbered software released into the public\ndomain.")] == ["Unlicense"]


def test_many_different_words_may_be_missing():
    t = BY["MIT-text"]
    once = [w for w in t.words if t.counts[w] == 1][: t.slack]
    assert len(once) == t.slack
    (_, spdx, name, _, missing, added, _), *_ = ls.identify_all(" ".join(w for w in t.words if w not in once))
    assert spdx == "MIT" and (name, missing, added) in {("MIT-text", len(once), 0)} or name == "MIT-grant"
