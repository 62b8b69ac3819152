import random

import pyarrow as pa
import pytest
import sentencepiece

from sigloom.llm import spm

BITS = ["a", "b", " ", "  ", "é", "ß", "日", "本", "\n", "\t", "😀", "the", "ing", "</s>", "<s>", "<0x0A>", "th", "e", ",", ".", "0", "1", "    ", "\x00", "ﬁ", "ت", "ı", "▁"]


@pytest.fixture(scope="module")
def both():
    return spm.load(spm.MODEL), sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)


def texts(seed, n=1500):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_the_library(both, seed):
    model, lib = both
    some = texts(seed) + ["", " " * 3000, "a" * 9000, "thethe" * 3000, "e" * 500 + " " * 77]
    ids, at = spm.Encoder(model)(pa.array(some))
    for i, (t, want) in enumerate(zip(some, lib.encode(some))):
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert spm.decode(model, want) == t.replace("▁", " ")


def test_backtracking_equals_merging(both):
    """On parts that the definition, best pair first, takes apart too."""
    model, _ = both
    r = random.Random(3)
    parts = ["".join(r.choice("etaoinshrdlu▁") for _ in range(r.randint(2, 25))) for _ in range(2000)]
    parts = [p for p in parts if "▁▁" not in p]
    assert model.encode_parts(parts) == [model.merge(p) for p in parts]


def test_cache_collisions_and_reset(both, monkeypatch):
    model, lib = both
    monkeypatch.setattr(spm.tk.PartCache, "BITS", 4)
    encoder = spm.Encoder(model)
    encoder.cache.limit = 50
    for seed in range(5):
        some = texts(seed, 60)
        ids, at = encoder(pa.array(some))
        assert [ids[at[i] : at[i + 1]].tolist() for i in range(60)] == lib.encode(some)


def test_remembered_pairs_are_bounded(both, monkeypatch):
    """Else they grow with the corpus, in workers that live on."""
    model, lib = both
    monkeypatch.setattr(spm, "FITS_KEPT", 40)
    model.fits.clear()
    r = random.Random(5)
    some = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(12)) for _ in range(20)) for _ in range(100)]
    ids, at = spm.Encoder(model)(pa.array(some))
    assert len(model.fits) <= 40
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(100)] == lib.encode(some)


def test_rows_of_all_sorts(spark, both):
    _, lib = both
    long = "word and other " * 30_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "some text", "c"), (4, long, "d"), (4, long, "d"), (5, "a ▁ b", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = spm.encode(df)
    assert out.columns == ["doc_id", "text", "ids", "piece_ids", "exact"]
    got = out.collect()
    assert sorted([tuple(r)[:3] for r in got], key=str) == sorted(rows, key=str)
    for r in got:
        assert r.piece_ids == (None if r.text is None else lib.encode(r.text))
        assert r.exact == (None if r.text is None else "▁" not in r.text)
    assert spm.encoded(df.limit(0)).count() == 0
    assert spm.encode(out).columns == ["doc_id", "text", "ids", "piece_ids_in", "exact_in", "piece_ids", "exact"]
