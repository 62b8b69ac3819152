import math

import numpy as np
import pyarrow as pa
import pytest

from sigloom.llm import quality as q

DATA = "/root/testdata/sf0.01"


def row_em(codes):
    """The same EM on rows one by one, in plain Python."""
    rows = [[c // 3 ** (len(q.RULES) - 1 - j) % 3 - 1 for j in range(len(q.RULES))] for c in codes]
    post = [0.1 if -1 in r else 0.9 for r in rows]
    for _ in range(q.ROUNDS):
        logs = []
        for side, prior in ((post, (0.02, 0.98)), ([1 - p for p in post], (0.6, 0.4))):
            chance = []
            for j in range(len(q.RULES)):
                bad = sum(w for r, w in zip(rows, side) if r[j] == -1) + q.PRIOR * len(rows) * prior[0]
                good = sum(w for r, w in zip(rows, side) if r[j] == 1) + q.PRIOR * len(rows) * prior[1]
                chance.append({-1: bad / (bad + good), 0: 1.0, 1: good / (bad + good)})
            logs.append([math.log(sum(side) + 1) + sum(math.log(chance[j][v]) for j, v in enumerate(r)) for r in rows])
        new = [1 / (1 + math.exp(min(700, b - a))) for a, b in zip(*logs)]
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return post


def test_pattern_counts_equal_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    codes = [int(q.vote_codes(__import__("pyarrow").array([r.text]))[0]) for r in rows]
    want = dict(zip([r.doc_id for r, c in zip(rows, codes) if c >= 0], row_em([c for c in codes if c >= 0])))
    got = {r.doc_id: r.posterior for r in q.score(docs).collect()}
    assert all(got[d] == pytest.approx(p, abs=2e-6) for d, p in want.items())


def test_labels_agree(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    stay = {r.doc_id for r in q.kept(docs).collect()}
    right = sum((d in stay) == bool(y) for d, y in labels.items())
    good = sum(d in stay for d, y in labels.items() if y)
    assert right / len(labels) > 0.97 and good / sum(labels.values()) > 0.98


def test_filter_agrees_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumnRenamed("n_chars", "code")
    out = q.filter_quality(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in q.kept(docs).collect()}


def test_rows_of_all_sorts(spark):
    good = "This is the text of a page that tells of the sea and of the land. It was written by hand, and it is good. " * 4
    rows = [(i, good + str(i), "en") for i in range(30)] + [(100, None, "a"), (101, "", "b"), (102, " \n!!", "c"), (None, good, "d"), (103, good, "e"), (103, good, "e"), (104, "###@@@ $$$ %%% ^^^ " * 40, "f"), (105, good * 2000, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, posterior string")
    stay = [r.doc_id for r in q.kept(df).collect()]
    assert stay.count(103) == 2 and None in stay and 105 in stay
    assert not {100, 101, 102, 104} & set(stay)
    by = {r.doc_id: r for r in q.score(df).collect()}
    assert by[100].posterior == by[101].posterior == by[102].posterior == 0
    assert q.filter_quality(df).count() == len(stay)
    assert q.kept(df.limit(0)).count() == 0 and q.filter_quality(df.limit(0)).count() == 0
    assert q.kept(df.filter("doc_id = 101")).count() == 0


def test_fit_of_nothing():
    assert len(q.fit(np.zeros(0, np.int64), np.zeros(0))) == 0


def test_rules_abstain_on_scripts_they_do_not_know():
    russian = "Утром жители города шли к реке и говорили о хлебе который они испекли ночью. День был похож на другие и никто не спешил домой до темноты. Старик рассказывал детям о море и кораблях которые он видел в молодости далеко на юге. Потом они пели песни и смотрели на огни в окнах домов за рекой. Ветер нёс листья по улице и пахло дождём яблоками и дымом. Вечером все собрались за столом и долго слушали рассказы гостей о других странах и людях."
    chinese = "早晨城里的人走到河边谈论他们做的面包。那一天和平常一样没有人急着回家。老人给孩子们讲大海和他年轻时见过的船的故事。" * 3
    names = list(q.RULES)
    for text in (russian, chinese):
        votes = q.votes_of(q.vote_codes(pa.array([text])))[0]
        assert [votes[names.index(n)] for n in ("function_words", "word_length", "sentences")] == [0, 0, 0]
        assert (votes >= 0).all()
