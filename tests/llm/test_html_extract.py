import html
import random
import re
from collections import Counter

import pytest

from sigloom.llm import html_extract as he

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("seed", range(20))
def test_best_region_equals_all_regions(seed):
    r = random.Random(seed)
    s = [r.randint(-5, 5) for _ in range(r.randint(0, 40))]
    a, b, total = he.best_region([float(x) for x in s])
    best = max((sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0)
    assert total == max(best, 0) and (sum(s[a:b]) == total)


def test_held_out_pages(spark):
    """Weights fitted on some pages find the content of others, whose labelling tags are taken out."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    model = he.fit(pages.filter("page_id % 2 = 0"))
    rest = pages.filter("page_id % 2 = 1").collect()
    plain = spark.createDataFrame([(r.page_id, re.sub("</?article>", "", r.html)) for r in rest], "page_id long, html string")
    got = {r.page_id: r.text.split() for r in he.extract_pages(plain, model).collect()}
    scores = []
    for r in rest:
        truth = html.unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*)</article>", r.html, re.S)[1])).split()
        common = sum((Counter(truth) & Counter(got[r.page_id])).values())
        scores.append(2 * common / max(1, len(truth) + len(got[r.page_id])))
    assert sum(scores) / len(scores) > 0.97


def test_sorts_of_weights():
    w = he.weights({("word:p", True): 90, ("word:a", False): 50, ("tag:a", False): 9, ("tag:p", True): 9})
    assert all((v > 0) == k.startswith("word:") for k, v in w.items())


def test_pages_of_all_sorts(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    rows = [(1, None, "a"), (2, "", "b"), (3, "<div><br></div>", "c"), (4, "no tags &amp; all words", "d"), (5, "<p>cut <b", "e"), (None, "<script>x()</script><!-- c --><p>one<br>two", "f"), (4, "no tags &amp; all words", "d"), (7, long, "g"), (8, "<article>", "h")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = he.extract_pages(df, {}).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    assert by[1].text is None and by[1].n_words is None
    assert by[2].text == by[3].text == by[8].text == ""
    assert by[4].text == "no tags & all words" and by[None].n_words == 1
    assert by[7].n_words == 200_000
    assert he.extract_pages(df.limit(0)).count() == 0
