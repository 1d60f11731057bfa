import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagekg.functions import lookalike
from passagekg.functions import text as tx
from passagekg.operators import extract

PAIRS = [
    ("chem", "Copper(II) nitrate trihydrate", "copper(ii) nitrate"), ("chem", "Cu(NO3)2·3H2O", "copper nitrate"), ("chem", "Cu(NO3)2.3H2O", "copper nitrate"), ("chem", "H3BTC", "trimesic acid"),
    ("chem", "dimethylformamide (DMF)", "n,n-dimethylformamide"), ("chem", "(DMF)", "n,n-dimethylformamide"), ("chem", "H₂O", "water"), ("chem", "zinc nitrate hexahydrate", "zinc nitrate"), ("chem", "", ""),
    ("mof", "UiO 66", "uio-66"), ("mof", "ZIF8", "zif-8"), ("mof", "UiO-67", "uio-67"), ("mof", "ZIF–8", "zif–8"), ("mof", "Cu3(BTC)2", "cu-3(btc)2"), ("mof", "HKUST-1 ", "hkust-1"),
    ("cond", "24 hours", "24 h"), ("cond", "120 °C", "120 c"), ("cond", "120 degrees C", "120 c"), ("cond", "24h", "24h"), ("cond", "393 K", "393 k"), ("cond", "30 mins", "30 min"), ("cond", "2 days", "2 d"),
]


def test_identity(spark):
    df = spark.createDataFrame([(i, k, n) for i, (k, n, _) in enumerate(PAIRS)], "i int, k string, n string")
    kind = F.when(F.col("k") == "mof", "MOF").when(F.col("k") == "cond", "Condition").otherwise("Solvent")
    got = {r.i: r.key for r in df.select("i", tx.normalize_by_type(kind, F.col("n")).alias("key")).collect()}
    assert {PAIRS[i][1]: (got[i], w) for i, (_, _, w) in enumerate(PAIRS) if got[i] != w} == {}


def test_column_and_local_rule_agree(spark, sf):
    t = spark.read.parquet(f"{sf}/results.parquet").select(F.explode("triples").alias("t")).select(F.inline(F.array("t.subject", "t.object"))).where("name IS NOT NULL").distinct()
    for r in tx.with_key(t, "type", "name", "key").collect():
        if r.type != "SynthesisMethod":
            assert extract.identity(r.type, r.name) == r.key, r


def test_nulls(spark):
    df = spark.createDataFrame([(None, None, None)], "n string, v array<string>, s array<int>")
    row = df.select(tx.fold(F.col("n")), tx.clean_values(F.col("v")), tx.elements_in(F.col("n")), tx.span_of(F.col("s")), tx.normalize_mof(F.col("n"))).first()
    assert list(row) == ["", [], [], None, ""]


def test_tokens_and_similarity(spark):
    names = [("UiO-66", "UiO-67", 0.0), ("room-temperature stirring", "room temperature stirring", 1.0), ("solvothermal synthesis", "solvothermal", 1.0), ("copper(ii) nitrate", "copper nitrate", 2 / 3), ("synthesis", "method", 0.0)]
    df = spark.createDataFrame([(a.lower(), b.lower(), w) for a, b, w in names], "a string, b string, w double")
    a, b = F.col("a"), F.col("b")
    sim = tx.name_similarity(a, b, tx.tokens(a), tx.tokens(b), tx.numbers(a), tx.numbers(b), "relaxed")
    for r in df.withColumn("s", sim).collect():
        assert abs(r.s - r.w) < 1e-9, r
    exact = tx.name_similarity(a, b, tx.tokens(a), tx.tokens(b), tx.numbers(a), tx.numbers(b), "exact")
    assert df.select(F.sum(exact)).first()[0] == 0


def test_small_helpers(spark):
    df = spark.createDataFrame([("Materials & Methods!", "CuBa", "alpha:m:zero"), ("!!", "0", "rule_based_v1"), (None, "nan", "x")], "a string, m string, e string")
    rows = df.select(tx.slug(F.col("a")).alias("s"), tx.elements_in(F.col("m")).alias("m"), tx.extractor_family(F.col("e")).alias("f")).collect()
    assert [r.s for r in rows] == ["materials-methods", "section", None] and [r.m for r in rows] == [["Cu", "Ba"], [], []] and [r.f for r in rows] == ["m", "rule", "x"]


def test_phrases(spark):
    texts = ["added, ADDED and readded; fig. 2", "h2bdc-nh2 BDC", "addedé", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = F.lower("t")
    rows = df.select(F.regexp_count(low, F.lit(tx.phrase_regex(("added", "fig.")))), F.regexp_count(low, F.lit(tx.phrase_regex(("bdc",), False, False)))).collect()
    assert [tuple(r) for r in rows] == [(3, 0), (0, 2), (0, 0), (0, 0)]


@settings(max_examples=200)
@given(st.text(max_size=60))
def test_fold_text_is_stable(text):
    once = tx.fold_text(text)
    assert once == " ".join(once.split()) and not any(unicodedata.category(c) == "Mn" for c in unicodedata.normalize("NFD", once) if c.isascii())


LOOKS = [("ＺＩＦ-８", "ZIF-8"), ("К", "K"), ("Å", "Å"), ("Å", "Å"), ("vapour diﬀusion", "vapour diffusion"), ("Ⅲ", "III"), ("a​b\xadc", "abc"), ("a\xa0b c", "a b c"), ("MOF‑5", "MOF-5"), ("℃", "°C"), ("μm", "µm")]


@pytest.mark.parametrize(("a", "b"), LOOKS)
def test_lookalikes(a, b):
    assert lookalike.fold_lookalikes(a) == lookalike.fold_lookalikes(b)


@pytest.mark.parametrize(("a", "b"), [("H₂O", "H2O"), ("m²", "m2"), ("ZIF", "zif"), ("naïve", "naive"), ("a–b", "a-b")])
def test_different_looks_stay_different(a, b):
    assert lookalike.fold_lookalikes(a) != lookalike.fold_lookalikes(b)


@given(st.text(max_size=60))
def test_lookalike_fold_is_idempotent_on_plain(text):
    plain = re.sub(r"[^ -~]", "", text)
    assert lookalike.fold_lookalikes(plain) == plain
