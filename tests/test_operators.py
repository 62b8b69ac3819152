"""Literal cases and small models of the operators that have no SQL."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigloom.functions import patterns as pt
from sigloom.functions import shapers as sh
from sigloom.functions import text as tx
from sigloom.functions import vectors as vec
from sigloom.operators import chunking as ch
from sigloom.operators import dedup as dd
from sigloom.operators import media as md
from sigloom.operators import profile as pf
from sigloom.operators import reduce as rd
from sigloom.operators import retrieval as rt
from sigloom.operators import windows as wn


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_shapers(spark):
    r = one(spark, sh.clamp(F.lit(2.0)), sh.clamp(F.lit(None).cast("double")), sh.quantize(F.lit(0.37), 4), sh.quantize(F.lit(0.5), 2), sh.attenuvert(F.lit(1.0), 3.0), sh.route_range(F.lit(1.0), [("a", 0, 1), ("b", 1, 2)]), sh.all_of([]), sh.any_of([]), sh.fingerprint({}))
    assert r[0] == 1.0 and r[1] is None and r[2] == pytest.approx(1 / 3) and r[3] == 0.0
    assert r[4] == 1.0 and r[5] == "a" and r[6] is True and r[7] is False and r[8] == "default"


def test_globs(spark):
    names = ["a/B.CS", "a/b.txt", "src/x/test/y.py", "a.cs.bak"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    hits = lambda g: [r.p for r in df.filter(sh.glob_match("p", g)).collect()]
    assert hits("*") == names and hits("*.cs") == ["a/B.CS"] and hits("**/*.txt") == ["a/b.txt"]
    assert hits("src**test") == ["src/x/test/y.py"] and hits("A/b.cs") == ["a/B.CS"]


def test_text_similarity_identities(spark):
    rows = [("same", "same"), ("", ""), ("abc", ""), ("abc", "xyz"), ("MARTHA", "marhta"), ("hello world", "hello world!"), ("élan", "elan")]
    df = spark.createDataFrame(rows, "a string, b string")
    fs = [tx.jaro, tx.jaro_winkler, tx.levenshtein_similarity, tx.ngram_cosine, tx.jaccard, tx.combined_similarity]
    for f in fs:
        x = [r[0] for r in df.select(f("a", "b")).collect()]
        y = [r[0] for r in df.select(f("b", "a")).collect()]
        assert x == pytest.approx(y, abs=1e-3)
        assert x[0] == pytest.approx(1) and x[3] == pytest.approx(0)
    assert df.select(tx.jaro("a", "b")).collect()[4][0] == pytest.approx(0.944444, abs=1e-5)
    assert df.select(tx.jaro_winkler("a", "b")).collect()[4][0] == pytest.approx(0.961111, abs=1e-5)
    got = [r[0] for r in df.select(tx.combined_similarity("a", "b", norm=False)).collect()]
    assert got[5] == 0.9


def test_vectors(spark):
    a, b, z, e = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0)), F.array().cast("array<double>")
    r = one(spark, vec.cosine(a, a), vec.cosine(a, b), vec.cosine(a, z), vec.cosine(e, e), vec.cosine(a, F.array(F.lit(1.0))), vec.euclidean(a, b), vec.euclidean(a, e), vec.dot(a, e), vec.normalize(z), vec.hamming_hex(F.lit("00000000"), F.lit("FFFFFFFF")), vec.hamming_hex(F.lit("0" * 40), F.lit("F" * 40)), vec.char_similarity(F.lit("AB"), F.lit("ABCD")))
    assert tuple(r[:5]) == (1, 0, 0, 0, 0) and r[5] == pytest.approx(5**0.5) and r[6] == vec.MAX_DOUBLE and r[7] == 0
    assert r[8] == [0, 0] and r[9] == 32 and r[10] == 160 and r[11] == 1.0


def test_pii_and_redaction(spark):
    values = {"123-45-6789": "SSN", "123456789": "SSN", "4111111111111111": "CreditCard", "4111 1111 1111 1111": "CreditCard", "a.b@c.org": "Email", "(555) 123-4567": "PhoneNumber", "10.0.0.255": "IPAddress", "00:1b:44:11:3a:b7": "MACAddress", "https://x.org/a": "URL", "12/31/1999": "DateOfBirth", "12345-6789": "SSN", "12345": "ZipCode", "hello": None, "300.1.1.1": None}
    df = spark.createDataFrame(list(values.items()), "v string, want string")
    assert all(r.got == r.want for r in df.select("v", "want", pt.pii_type("v").alias("got")).collect())
    r = one(spark, *[pt.redact(F.lit(v), F.lit(k)) for v, k in (("123-45-6789", "SSN"), ("4111111111111111", "CreditCard"), ("someone@mail.org", "Email"), ("abc", "X"), ("abcdefgh", "X"))])
    assert tuple(r) == ("***-**-6789", "**** **** **** 1111", "so***@***.org", "****", "ab****gh")
    assert pt.pii_from_name("ip_address") == "Address" and pt.pii_from_name("Customer_Email") == "Email"


def test_reducers_on_mixed_values(spark):
    rows = [(1, "g", "10"), (2, "g", "1,000"), (3, "g", None), (4, "g", "x"), (5, None, " 5 "), (6, "g", "NaN")]
    df = spark.createDataFrame(rows, "seq long, k string, v string")
    got = {r.group_key: r for r in rd.reduce_groups(df, "k", "v", ["sum", "count", "distinct", "first", "last", "concat", "median", "nonsense"]).collect()}
    g = got["g"]
    assert (g.sum_value, g.count_value, g.distinct_value, g.first_value, g.last_value, g.median_value, g.nonsense_value) == (1010, 5, 5, "10", "NaN", 505, 5)
    assert g.concat_value == "10, 1,000, , x, NaN" and got["default"].sum_value == 5
    empty = rd.reduce_groups(df.filter("false"), "k", "v", ["sum"])
    assert empty.count() == 0
    assert rd.top_k(df.limit(0), 3, "v").count() == 0


def test_topk_ties_and_missing(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.9), (3, 0.9), (4, None)], "seq long, score double")
    assert [r.seq for r in rd.top_k(df, 3, "score").collect()] == [2, 3, 1]
    assert [r.seq for r in rd.top_k(df, 2, "score", descending=False).collect()] == [4, 1]


def test_iterative_reduce_rounds(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 121)], "seq long, v double")
    got = rd.iterative_reduce(df, "v", "seq").collect()
    assert rd.round_count(120) == 2 and len(got) == 2
    assert sum(r.score for r in got) == 7260 and {r.best_key for r in got} == {"100", "120"} and sum(r.merged for r in got) == 120


def test_signal_aggregates(spark):
    df = spark.createDataFrame([("k", 1.0, "a", 0.8, 1), ("k", 2.0, "b", 0.9, 2), ("k", 3.0, "b", 0.1, 3), ("t", None, "x", 0.5, 4)], "key string, value_num double, value_str string, confidence double, seq long")
    assert {r.key: r.value_num for r in rd.highest_confidence(df).collect()}["k"] == 2
    w = {r.key: r for r in rd.weighted_average(df).collect()}
    assert w["k"].value == pytest.approx((0.8 + 1.8 + 0.3) / 1.8) and w["t"].value is None and w["t"].confidence == 0.5
    m = {r.key: r for r in rd.majority_vote(df).collect()}
    assert m["k"].value == "b" and m["k"].confidence == pytest.approx(1.0 / 1.8)


def ts(s):
    return F.timestamp_seconds(F.lit(s))


def events(spark, seconds):
    df = spark.createDataFrame([(i, "u", float(s)) for i, s in enumerate(seconds)], "seq long, u string, s double")
    return df.select("seq", "u", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"))


def test_bursts_with_tied_times(spark):
    got = {r.seq: r.n for r in wn.bursts(events(spark, [0, 0, 0, 0, 0, 0]), "u", "ts", "seq").collect()}
    assert got == {0: 6, 1: 5}
    assert wn.bursts(events(spark, range(0, 200, 20)), "u", "ts", "seq").count() == 0


def test_periodic_and_anomalies(spark):
    r = wn.periodic(events(spark, range(0, 1200, 60)), "u", "ts", "seq").collect()
    assert len(r) == 1 and r[0].cv == 0 and r[0].confidence == 1 and r[0].mean_s == 60
    assert wn.periodic(events(spark, [5] * 10), "u", "ts", "seq").count() == 0
    a = wn.interval_anomalies(events(spark, [*range(0, 1200, 60), 9000]), "u", "ts", "seq").collect()
    assert len(a) == 1 and a[0].confidence is None


def test_window_retention(spark):
    df = events(spark, [0, 1, 2, 3]).withColumn("key", F.concat(F.lit("k"), F.col("seq")))
    got = wn.retain(df, "key", "ts", "seq", F.timestamp_seconds(F.lit(3)), 600, 3).collect()
    assert {r.key for r in got} == {"k1", "k2", "k3"}


def test_constant_series_has_no_trend(spark):
    df = spark.createDataFrame([("a", i, 5.0) for i in range(5)] + [("b", i, 2.0 * i) for i in range(5)], "k string, i long, y double")
    got = wn.trend(df, "k", "y", "i").collect()
    assert [(r.k, r.direction) for r in got] == [("b", "increasing")]


def test_jaccard_and_levenshtein_pairs_equal_all_pairs(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abcd") for _ in range(r.randint(0, 12))) for _ in range(120)]
    texts += [t[:-1] + "z" for t in texts[:40] if t]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")

    def sets(t):
        return {t[i : i + 2] for i in range(len(t) - 1)}

    def lev(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            p, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
        return d[-1]

    for f, sim in ((dd.jaccard_pairs, lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b)) if sets(a) | sets(b) else 1.0), (dd.levenshtein_pairs, lambda a, b: 1 - lev(a, b) / max(len(a), len(b)) if a or b else 1.0)):
        want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sim(texts[i], texts[j]) >= 0.7 - 1e-12}
        assert {(x.a, x.b) for x in f(df, 0.7).collect()} == want


def test_leaders_follow_the_order(spark):
    nodes = spark.createDataFrame([(i,) for i in range(6)], "seq long")
    pairs = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.9), (2, 3, 0.95), (0, 4, 0.9), (2, 4, 0.99)], "a long, b long, similarity double")
    assert {r.seq: r.leader for r in dd.leaders(nodes, pairs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5}


def test_hamming_pairs_equal_all_pairs(spark):
    r = random.Random(1)
    h = [r.getrandbits(60) for _ in range(60)]
    h += [x ^ (1 << r.randrange(60)) ^ (1 << r.randrange(60)) for x in h[:20]]
    got = {(x.a, x.b) for x in dd.hamming_pairs(spark.createDataFrame(list(enumerate(h)), "seq long, hash long"), 4, 60).collect()}
    assert got == {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if bin(h[i] ^ h[j]).count("1") <= 4}


def test_mmr(spark):
    assert rt.mmr_select(np.zeros(0), np.zeros((0, 2)), 5) == ([], [])
    rel, v = np.array([0.9, 0.9, 0.5]), np.array([[1.0, 0], [1, 0], [0, 1]])
    assert rt.mmr_select(rel, v, 3, 0.5)[0] == [0, 2, 1]
    assert rt.mmr_select(rel, v, 0)[0] == []


def test_rrf_symmetry(spark):
    rows = [("q", x, i + 1) for i, x in enumerate("ABCDE")] + [("q", x, i + 1) for i, x in enumerate("EDCBA")]
    got = {r.doc_id: r.score for r in rt.rrf(spark.createDataFrame(rows, "query_id string, doc_id string, rank int"), ["query_id"]).collect()}
    assert got["A"] == pytest.approx(got["E"], abs=1e-9) and got["B"] == pytest.approx(got["D"])


def test_bm25_keeps_what_matches(spark):
    docs = spark.createDataFrame([(0, "cat sat on mat"), (1, "dog ran in park"), (2, "cat and dog are pets"), (3, None), (4, "")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "cat"), (8, "zebra"), (9, "")], "query_id long, text string")
    assert {(r.query_id, r.doc_id) for r in rt.bm25(docs, q).collect()} == {(7, 0), (7, 2)}


def test_vector_search_ties_and_lengths(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id long, vector array<double>")
    assert [(r.vec_id, r.rank) for r in rt.vector_search(base, q, 1).collect()] == [(1, 1)]


def chunks(spark, text, c):
    return spark.createDataFrame([(0, text)], "doc_id long, text string").select(c.alias("c")).first().c


def test_chunkers(spark):
    assert [(c.start, c.end, c.text) for c in chunks(spark, "Hello world test", ch.sliding("text", 10, 2))] == [(0, 3, "Hello world test")]
    words = " ".join(map(str, range(25)))
    assert [(c.start, c.end) for c in chunks(spark, words, ch.sliding("text", 10, 4))] == [(0, 10), (6, 16), (12, 22), (18, 25)]
    assert chunks(spark, "", ch.sliding("text")) == []
    s = "One sentence here. " * 20
    got = chunks(spark, s, ch.by_sentence("text", 30, 60))
    assert all(len(c.text) <= 60 for c in got) and " ".join(c.text for c in got).count("One") == 20 - (len(got) * 3 < 20) * (20 - len(got) * 3)
    md_ = "intro that goes\n# A\nalpha\n## B\nbeta\n### C\nstays in B\n"
    got = chunks(spark, md_, ch.by_section("text"))
    assert [(c.heading, c.level) for c in got] == [("A", 1), ("B", 2)] and "stays" in got[1].text
    assert [c.heading for c in chunks(spark, "no heading " * 20, ch.by_section("text"))] == [None]
    assert chunks(spark, "short", ch.recursive("text")) == ["short"]


def test_position_weights(spark):
    df = spark.range(1)
    w = lambda i, n, k: df.select(ch.position_weight(F.lit(i), F.lit(n), k)).first()[0]
    assert [w(0, 10, "expository"), w(9, 10, "expository"), w(5, 10, "expository")] == [1.5, 1.4, 1.0]
    assert [w(0, 10, "narrative"), w(9, 10, "unknown"), w(5, 10, "unknown")] == [1.1, 1.2, 1.0]


def test_image_hashes(spark):
    g16 = [[float((x * 7 + y * 3) % 11) for y in range(16)] for x in range(16)]
    a = np.array(g16)
    d = np.zeros((16, 16))
    for u in range(16):
        for v in range(16):
            d[u, v] = 0.25 * (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) * sum(a[x, y] * np.cos((2 * x + 1) * u * np.pi / 32) * np.cos((2 * y + 1) * v * np.pi / 32) for x in range(16) for y in range(16))
    m = sorted(d.ravel())[128]
    bits = "".join("1" if d[x, y] > m else "0" for y in range(16) for x in range(16))[1:] + "0"
    want = "".join(f"{int(bits[i : i + 4], 2):X}" for i in range(0, 256, 4))
    g8 = [[float(x * 8 + y) for y in range(8)] for x in range(8)]
    df = spark.createDataFrame([(g16, g8)], "a array<array<double>>, b array<array<double>>")
    r = df.select(md.dct_hash("a"), md.block_hash("b")).first()
    assert r[0] == want and len(r[0]) == 64
    bits = "".join("1" if g8[x][y] > 32 else "0" for y in range(8) for x in range(8))
    assert r[1] == "".join(f"{int(bits[i : i + 4], 2):X}" for i in range(0, 64, 4))


def test_audio_and_video(spark):
    pcm = [0.5] * 1000 + [0.0] * 1000 + [0.5] * 1000
    df = spark.createDataFrame([(pcm, ["0F", "F0", "FF"], [0.0, 0.5, 0.1, 0.05])], "p array<double>, h array<string>, d array<double>")
    r = df.select(md.speech_segments("p", F.lit(1000)), md.xor_hex("h"), md.scenes_fixed("d"), md.keyframes_novel("d", 10), md.keyframes_uniform(F.lit(10), 4), md.motion_class("d"), md.energy_fingerprint("p", 500)).first()
    assert [(round(s.start, 2), round(s.end, 2)) for s in r[0]] == [(0.0, 1.0), (2.0, 3.0)] or len(r[0]) == 2
    assert r[1] == "00" and r[2] == [1] and r[3] == [0, 1, 2, 4] and r[4] == [0, 2, 5, 7] and r[5] == "medium" and len(r[6]) == 2


def test_colors(spark):
    r = one(spark, md.rgb_to_hsl(F.lit(255), F.lit(0), F.lit(0)), md.rgb_hex(F.lit(255), F.lit(1), F.lit(16)))
    assert tuple(r[0]) == (0, 1, 0.5) and r[1] == "#FF0110"
    p = np.array([[255, 0, 0]] * 70 + [[0, 0, 255]] * 30, float)
    got = md.dominant_colors_of(p, 2)
    assert got[0][:3] == (255, 0, 0) and got[0][3] == pytest.approx(0.7) and md.dominant_colors_of(p[:0]) == []


def test_profile_and_types(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else float(i), "c", str(i % 3 == 0).lower(), f"2024-01-{i % 9 + 1:02d}") for i in range(40)], "id long, x double, c string, b string, d string")
    p = {r.column: r for r in pf.column_profile(df, ["id", "x", "c"]).collect()}
    assert p["x"].null_percent == 25 and p["c"].unique_count == 1 and p["id"].is_identifier and p["id"].unique_percent == 100
    s = pf.anomaly_scores(pf.column_profile(df, ["id", "x", "c"])).first()
    assert 0 < s.overall < 0.5 and "drop constant columns" in s.advice
    t = {r.column: r.type for r in pf.infer_types(pf.long_values(df, ["id", "x", "c", "b", "d"])).collect()}
    assert t == {"id": "Integer", "x": "Double", "c": "String", "b": "Boolean", "d": "DateTime"}
    assert sum(pf.WEIGHTS.values()) == pytest.approx(1)


def test_table_from_boxes(spark):
    rows = [(1, "Name", 0.0, 100.0), (1, "Qty", 50.0, 101.0), (1, "apple", 0.0, 80.0), (1, "3", 50.0, 79.0), (1, "pear", 0.0, 60.0), (1, "4", 50.0, 60.0), (1, "alone", 0.0, 20.0)]
    cells = pf.table_cells(spark.createDataFrame(rows, "page int, text string, left double, bottom double"))
    assert {(r.row, r.col): r.text for r in cells.collect()} == {(0, 0): "Name", (0, 1): "Qty", (1, 0): "apple", (1, 1): "3", (2, 0): "pear", (2, 1): "4"}
    assert pf.table_header(cells).first().has_header
    r = one(spark, *[pf.column_name(F.lit(x)) for x in ("Unit price", "2nd-col", "%%", "_x_")])
    assert tuple(r) == ("Unit_price", "Col_2nd_col", "Column", "x")
    assert one(spark, pf.to_csv_line(F.lit('a"b'), F.lit(None), F.lit("c,d"), F.lit("e")))[0] == '"a""b",,"c,d",e'


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return 1 - row[-1] / max(len(a), len(b))


def _jaro_winkler(a, b):
    reach, used, hits = max(max(len(a), len(b)) // 2 - 1, 0), set(), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == x:
                used.add(j)
                hits.append(x)
                break
    m = len(hits)
    if not m:
        j = 0.0
    else:
        j = (m / len(a) + m / len(b) + (m - sum(x != b[k] for x, k in zip(hits, sorted(used))) // 2) / m) / 3
    p = next((i for i in range(min(4, len(a), len(b))) if a[i] != b[i]), min(4, len(a), len(b)))
    return j + 0.1 * p * (1 - j)


def _cosine(a, b):
    if min(len(a), len(b)) < 2:
        return float(a == b)
    x, y = (Counter(t[i : i + 2] for i in range(len(t) - 1)) for t in (a, b))
    return sum(x[g] * y[g] for g in x) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def _combined(a, b):
    if a == b:
        return 1.0
    return 0.9 if a in b or b in a else 0.5 * _jaro_winkler(a, b) + 0.3 * _lev(a, b) + 0.2 * _cosine(a, b)


@pytest.mark.parametrize("algorithm, sim", [("combined", _combined), ("jaro-winkler", _jaro_winkler), ("ngram", _cosine), ("levenshtein", _lev)])
def test_leader_dedup_equals_the_sequential_pass(spark, algorithm, sim):
    r = random.Random(7)
    words = ["large", "ring", "blue", "bolt", "widget", "small", "red", "hot", "gear", "a"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 4))) for _ in range(60)]
    for _ in range(90):
        t = r.choice(texts)
        i = r.randrange(len(t))
        texts.append(r.choice([t, t[:i] + r.choice("abcde ") + t[i + 1 :], t[:i] + t[i + 1 :], t + " " + r.choice(words), t[::-1]]).strip())
    r.shuffle(texts)
    texts += ["", "  ", "a", "b", "A", "ring"]
    lead, want = [], {}
    for seq, raw in enumerate(texts):
        t = raw.lower().strip()
        if not t:
            continue
        near = [(sim(t, u), -s) for s, u in lead if sim(t, u) >= 0.85 - 1e-12]
        want[seq] = -max(near, key=lambda x: (round(x[0], 12), x[1]))[1] if near else seq
        if not near:
            lead.append((seq, t))
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    assert {x.seq: x.leader for x in dd.leader_dedup(df, algorithm=algorithm).collect()} == want
    if algorithm == "combined":
        assert {x.seq: x.leader for x in dd.leader_dedup(df).collect()} == want


def test_tfidf_variants_one_by_one_equal_all_at_once(spark):
    from sigloom.operators import retrieval as rt

    docs = spark.createDataFrame([(1, "river bread river town"), (2, "bread and songs"), (3, "river songs songs songs"), (4, ""), (5, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "river songs"), (2, "bread")], "query_id long, text string")
    every = {(r.tf_kind, r.idf_kind, r.query_id, r.doc_id): r.score for r in rt.tfidf_all(docs, queries).collect()}
    for t in rt._TF:
        for i in rt._IDF:
            one = {(t, i, r.query_id, r.doc_id): r.score for r in rt.tfidf_scores(docs, queries, t, i).collect()}
            assert one == pytest.approx({k: v for k, v in every.items() if k[:2] == (t, i)})
    n, f = 5.0, {"river": (2, {1: 2, 3: 1}), "songs": (2, {2: 1, 3: 3})}
    want = sum(tf.get(3, 0) * math.log(1 + n / (df + 1)) for df, tf in f.values())
    assert every["raw", "smooth", 1, 3] == pytest.approx(want)
    top = {(r.doc_id, r.term): r["rank"] for r in rt.distinctive_terms(docs, 1).collect()}
    assert top[3, "songs"] == 1 and {d for d, _ in top} == {1, 2, 3}


def test_hybrid_search_equals_the_full_lists(spark):
    """Heads and counted ranks give what fusing the whole lists gives."""
    import random

    from sigloom.operators import retrieval as rt

    r = random.Random(3)
    words = "river bread town song market child bridge rain".split()
    docs = [(d, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for d in range(300)]
    vecs = [(d, [r.gauss(0, 1) for _ in range(4)]) for d in range(300)]
    queries = [(q, " ".join(r.sample(words, 2)), [r.gauss(0, 1) for _ in range(4)] if q else None) for q in range(4)]
    d, v = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(vecs, "doc_id long, embedding array<double>")
    qs = spark.createDataFrame(queries, "query_id long, text string, vector array<double>")
    got = {(x.query_id, x["rank"]): (x.doc_id, x.score) for x in rt.hybrid_search(d, v, qs, k=5, rrf_k=10).collect()}
    lexical = {}
    for x in rt.bm25_scores(d, qs).collect():
        lexical.setdefault(x.query_id, []).append((-round(x.score, 6), x.doc_id))
    for q, _, vector in queries:
        score = {}
        cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        dense = sorted((-round(cosine(vector, e), 9), i) for i, e in vecs if cosine(vector, e) > 0) if vector else []
        for ranked in (sorted(lexical.get(q, [])), dense):
            for n, (_, i) in enumerate(ranked, 1):
                score[i] = score.get(i, 0) + 1 / (10 + n)
        best = sorted(((-round(s, 9), i) for i, s in score.items()))[:5]
        assert [got[q, n][0] for n in range(1, 6)] == [i for _, i in best]


def test_scanned_pages(spark):
    from sigloom.operators import scans

    good = "The people of the town walked to the river and talked about bread. " * 3
    rows = [
        (1, 0, 0, 1, 10.0, 10.0, 0.95, None, True, 1.0),
        (1, 5, 20, 1, 10.0, 10.0, 0.85, "a few words", True, 0.9),
        (1, 60, 300, 1, 10.0, 10.0, 0.6, "XKCD BCDF GHJK LMNP QRST", True, 0.5),
        (1, 60, 300, 1, 10.0, 10.0, 0.6, good, False, 0.0),
        (2, 36, 160, 0, 10.0, 10.0, None, good, False, 0.0),
        (3, None, None, None, 0.0, None, None, None, False, 0.0),
        (4, 12, 40, 2, 1000.0, 1000.0, 0.1, good, True, 0.5),
    ]
    names = "doc_id long, words int, letters int, images int, width double, height double, coverage double, text string"
    df = spark.createDataFrame([r[:8] for r in rows], names)
    got = sorted(((r.doc_id, r.words, r.coverage, r.scanned, r.scan_confidence) for r in scans.scanned_pages(df).collect()), key=str)
    assert got == sorted(((r[0], r[1], r[6], r[8], r[9]) for r in rows), key=str)
    docs = {r.doc_id: (r.kind, r.needs_ocr, r.confidence) for r in scans.scanned_documents(df).collect()}
    assert docs == {1: ("Mixed", True, 0.8), 2: ("Searchable", False, 1.0), 3: ("Searchable", False, 1.0), 4: ("Scanned", True, 0.5)}
    assert scans.scanned_documents(df.limit(0)).count() == 0


def test_mmr_with_own_scorers(spark):
    from sigloom.operators import retrieval as rt

    rows = [(1, 1, "a b", 0.9), (1, 2, "a b", 0.88), (1, 3, "c d", 0.5), (1, 4, "a c", 0.6), (2, 5, "x", 0.1)]
    pool = spark.createDataFrame(rows, "query_id long, doc_id long, text string, score double")
    same = lambda a, b: len(set(a["text"].split()) & set(b["text"].split())) / len(set(a["text"].split()) | set(b["text"].split()))
    out = {(r.query_id, r["rank"]): r.doc_id for r in rt.mmr_by(pool, lambda r: r["score"], same, 3, 0.5).collect()}
    assert out == {(1, 1): 1, (1, 2): 3, (1, 3): 4, (2, 1): 5}
    assert rt.mmr_by(pool.limit(0), lambda r: 0, same).count() == 0


def test_pair_similarities_equal_their_models(spark):
    """The batch kernels against one pair at a time, with long texts, characters beyond the BMP, and nulls."""
    r = random.Random(11)
    texts = ["".join(r.choice("abé 😀z") for _ in range(r.choice([0, 1, 2, 3, 5, 9, 40, 400]))) for _ in range(120)]
    rows = [(a, b) for a, b in zip(texts, texts[1:])] + [(a, a[: len(a) // 2] + "x" + a[len(a) // 2 :]) for a in texts] + [(None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", "b", tx.jaro_winkler("a", "b").alias("jw"), tx.ngram_cosine("a", "b").alias("g"), tx.combined_similarity("a", "b", norm=False).alias("c")).collect()
    for x in got:
        if x.a is None or x.b is None:
            assert (x.jw, x.g, x.c) == (None, None, None)
            continue
        assert x.jw == pytest.approx(_jaro_winkler(x.a, x.b) if x.a and x.b else float(x.a == x.b))
        assert x.g == pytest.approx(_cosine(x.a, x.b))
        s, t = x.a.strip(" "), x.b.strip(" ")
        assert x.c == pytest.approx(1 if s == t else _combined(s, t) if s and t else 0)


def test_combined_similarity_takes_each_text_once(spark):
    """The normalized texts stand in the plan twice at most (as the name of the result, too); they stood wherever a character was looked at."""
    df = spark.createDataFrame([("Hot bolt", "hot  BOLTS")], "a string, b string")
    plan = df.select(tx.combined_similarity("a", "b"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 8


@pytest.mark.parametrize("name", ["jaccard", "levenshtein"])
def test_copies_are_paired_in_blocks(spark, monkeypatch, name):
    """Texts meet once however many copies they have; the copies' pairs are all there, once each."""
    monkeypatch.setattr(dd, "MEMBERS", 7)
    texts = (["large blue ring", "Large blue ring", "large blue rings", "hot bolt", "", None] * 9)[:50]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    met = []
    find = getattr(dd, f"_{name}_pairs")
    monkeypatch.setattr(dd, f"_{name}_pairs", lambda d, *how: met.append(d.count()) or find(d, *how))
    got = [(x.a, x.b) for x in dd.PAIRS[name](df, 0.85).collect()]
    same = lambda t: t and t.lower().rstrip("s")
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if texts[i] is not None and texts[j] is not None and same(texts[i]) == same(texts[j])}
    assert len(got) == len(set(got)) and set(got) == want and met == [4]


def test_iterative_reduce_that_runs_out_of_rounds(spark):
    """What the rounds leave beyond the target stays where no cut is asked for; equal batches rank by place."""
    df = spark.createDataFrame([(i, 0.1 * (i % 10)) for i in range(600)], "seq long, v double")
    got = rd.iterative_reduce(df, "v", "seq", rounds=2, cut=False).collect()
    assert [(r["rank"], r.batch_index, r.merged) for r in got] == [(i + 1, i, 100) for i in range(6)]
    assert len(rd.iterative_reduce(df, "v", "seq", rounds=2).collect()) == 5
    assert [r.merged for r in rd.iterative_reduce(df, "v", "seq").collect()] == [600]


def test_words_are_the_tokens_of_the_expression(spark):
    from sigloom.operators import terms as tm

    texts = ["Élan naïve_1 x 42 ñ ab", "ascii_only The word-list 7 it's", "٣٤ ⅷ² 日本語 áb‿ c \U0001d4d0\U0001d4d1 😀😀", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(F.lower("t").alias("low"), tx.tokens("t").alias("a"), tx.content_tokens("t").alias("b")).collect():
        assert tm.words(r.low) == r.a and tm.words(r.low, 3, tm.STOP) == r.b


def test_scores_by_blocks_and_of_shared_ids(spark, monkeypatch):
    """Small blocks of documents and queries give the same; documents of one id count together as the SQL groups them."""
    from sigloom.operators import terms as tm

    r = random.Random(2)
    vocabulary = "river bread town song market child bridge rain".split()
    docs = [(d, " ".join(r.choices(vocabulary, k=r.randint(0, 12)))) for d in range(60)]
    queries = spark.createDataFrame([(q, " ".join(r.choices(vocabulary, k=4))) for q in range(9)], "query_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lambda f: {tuple(x)[:-1]: round(x[-1], 9) for x in f.collect()}
    bm, tf = got(rt.bm25_scores(df, queries)), got(rt.tfidf_all(df, queries))
    top = {(x.query_id, x["rank"]): x.doc_id for x in rt.bm25(df, queries, 3).collect()}
    monkeypatch.setattr(tm, "CELLS", 20)
    assert got(rt.bm25_scores(df, queries)) == bm and got(rt.tfidf_all(df, queries)) == tf
    assert {(x.query_id, x["rank"]): x.doc_id for x in rt.bm25(df, queries, 3).collect()} == top
    for q in range(9):
        assert [d for _, d in sorted((-s, d) for (p, d), s in bm.items() if p == q)[:3]] == [top[q, i] for i in (1, 2, 3)]
    # two documents of one id and length: their counts are one posting
    twice = spark.createDataFrame([(1, "river town"), (1, "river song"), (2, "rain rain rain rain")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "river")], "query_id long, text string")
    idf = math.log((3 - 1 + 0.5) / (1 + 0.5) + 1)
    assert got(rt.bm25_scores(twice, q)) == {(1, 1): pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / (8 / 3))))}


def test_rare_terms_are_joined(spark, monkeypatch):
    from sigloom.operators import terms as tm

    r = random.Random(4)
    docs = spark.createDataFrame([(d, " ".join(r.choice(["river", "bread", "market", f"word{r.randint(0, 40)}", f"once{d}"]) for _ in range(25))) for d in range(80)], "doc_id long, text string")
    want = sorted(map(tuple, rt.distinctive_terms(docs, 4, digits=9).collect()))
    monkeypatch.setattr(tm, "HELD", 10)
    monkeypatch.setattr(tm, "COUNTED", 5)
    assert sorted(map(tuple, rt.distinctive_terms(docs, 4, digits=9).collect())) == want


def test_vector_search_holds_no_batch_back(spark):
    """What a task passes on falls off as its batches go by; it passed on k rows a query of each."""
    r = np.random.default_rng(1)
    base = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(r.normal(size=(4000, 4)))], "vec_id long, embedding array<double>").coalesce(1)
    queries = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert rt._search_block(base, queries, 5, "cosine", False, "vec_id", "embedding").count() < 120  # of 40 batches
        assert rt.vector_search(base, queries, 5).count() == 5
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_quantiles_gather_no_column(spark):
    """Exact by a sketch and counts, with ties, nulls and a sketch that errs; no task gets a column's values."""
    r = random.Random(9)
    rows = [(r.gauss(0, 1), r.choice([1, 1, 1, 2, 9]), None if r.random() < 0.3 else r.randint(0, 999)) for _ in range(3001)]
    df = spark.createDataFrame(rows, "a double, b int, c int").withColumn("d", F.lit(None).cast("double"))
    got = pf.quantiles(df, ["a", "b", "c", "d"])
    for i, c in enumerate("abc"):
        assert got[c] == pytest.approx(np.percentile([x[i] for x in rows if x[i] is not None], [25, 75]))
    assert got["d"] == [None, None]
    plan = pf.column_profile(df, ["a", "b", "c"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "generator" not in plan.split("Join")[-1]


def test_text_quality_counts_what_stays(spark):
    """Shares are those of the matches one by one; matches are no longer gathered."""
    r = random.Random(3)
    texts = ["".join(r.choice("aeiouAEIOU bcdXYZ éÉß1\n\U0001d400") for _ in range(r.randint(0, 200))) for _ in range(80)] + ["one two\tthree " * 7, "  word" * 19, " word" * 20 + " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = [F.regexp_count("t", F.lit(p)) for p in (r"\p{L}", r"\p{Lu}", "[aeiouAEIOU]", r"[^ \t\n\r]+")]

    def grade(t, a, u, v, w):
        if t is None or a < 10:
            return "Empty"
        if (u / a > 0.4 or v / a < 0.15) and a > 50:
            return "Garbage"
        return "Low" if v / a < 0.25 or u / a > 0.25 else "Medium" if w < 20 else "High"

    made = df.select(tx.text_quality("t").alias("g"), "t", *counted)
    for row in made.collect():
        assert row.g == grade(*row[1:])
    assert "regexp_extract_all" not in df.select(tx.text_quality("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_no_pattern_fits_what_cannot_be_pii(spark):
    """What the first look leaves out fits no pattern, and it is looked at before them."""
    import re

    r = random.Random(8)
    some = ["a1@b.com", "aa:bb:cc:dd:ee:ff", "ab-cd-ef-ab-cd-ef", "https://x.org", "WVWZZZJZZWWABCDEF", "abcdefgh", "x.y", "(", "1.2.3.4"]
    texts = some + ["".join(r.choice("aA1@:-./$F") for _ in range(r.randint(1, 18))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for x in df.select("t", pt.pii_type("t").alias("kind"), pt.may_be_pii("t").alias("may")).collect():
        want = next((n for n, p in pt.PII if re.match(pt.whole(p), x.t, re.ASCII)), None)
        assert x.kind == want and (x.may or want is None)


def test_autocorrelation_across_blocks(spark, monkeypatch):
    """Blocks and ranges of a few values give the sums of the whole series, with a null in it."""
    monkeypatch.setattr(wn, "_BLOCK", 16)
    monkeypatch.setattr(wn, "_RANGES", 5)
    r = random.Random(6)
    rows = [(k, 10 * i + i % 3, None if i == 7 else r.random()) for k, n in (("a", 97), ("b", 10), ("c", 9)) for i in range(n)]
    got = {(x.k, x.lag): x.acf for x in wn.autocorrelation(spark.createDataFrame(rows, "k string, seq long, y double"), "k", "y", "seq", 5).collect()}
    want = {}
    for k in "ab":
        y = [v for key, _, v in rows if key == k]
        mean = sum(v for v in y if v is not None) / sum(v is not None for v in y)
        d = [None if v is None else v - mean for v in y]
        total = lambda lag: sum(p * q for p, q in zip(d, d[lag:]) if p is not None and q is not None)
        want |= {(k, lag): total(lag) / total(0) for lag in range(1, 6) if lag < len(y) // 2}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("by", [[], ["k"]])
def test_meter_sums_no_frame_anew(spark, by):
    """Windows across blocks, before 1970 too, by running sums: the plan has no sliding frame."""
    r = random.Random(1)
    rows = [(r.choice("ab"), s, None if s % 17 == 0 else r.random()) for s in r.sample(range(-300, 900), 400)]
    df = spark.createDataFrame(rows, "k string, s long, units double").withColumn("ts", F.timestamp_seconds("s"))
    out = wn.meter(df, "ts", F.col("units"), 10.0, 60, by)
    for x in out.collect():
        own = [u for k, s, u in rows if x.second - 59 <= s <= x.second and u is not None and (not by or k == x.k)]
        assert x.used == (pytest.approx(sum(own)) if own else None)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "-59" not in plan
