from __future__ import annotations

import numpy as np
import pytest

from ledgerlens.llm import langid

SEEDS = {"en": "the thing and with that of over there was ", "fr": "les eaux qui sont dans une pas école été ", "de": "der und schön ist nicht ein über große "}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []
    for i in range(300):
        lang = list(SEEDS)[i % 3]
        words = SEEDS[lang].split()
        out.append((i, " ".join(rng.choice(words, int(rng.integers(2, 200)))), lang))
    return out


def test_learns_and_handles_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df.where("doc_id % 4 <> 2"))
    edge = [(1000, None, None), (1001, "", None), (1002, "12 34 !?", None), (1003, SEEDS["de"] * 4000, None), (1004, "ß", None), (1005, "\u0000a", None)]
    found = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(rows + edge, "doc_id long, text string, lang string").repartition(3), net).collect()}
    held = [r for r in rows if r[0] % 4 == 2]
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert [found[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert found[1003]["lang_pred"] == "de" and 0 <= found[1003]["score"] <= 1
    assert found[1004]["lang_pred"] in SEEDS and found[1005]["lang_pred"] in SEEDS


def test_prediction_does_not_depend_on_neighbours(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.train(df)
    one = {r["doc_id"]: r["score"] for r in langid.predict(df.coalesce(1), net).collect()}
    two = {r["doc_id"]: r["score"] for r in langid.predict(df.repartition(13), net).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-5 for k in one)


def test_packed_tables_equal_the_convolution():
    rng = np.random.default_rng(1)
    net = langid.ByteNet(["a", "b"])
    x = rng.integers(0, 256, (9, langid.WINDOW)).astype(np.uint8)
    top, _ = net.pooled(x)
    z = np.maximum(top + net.bias, 0) @ net.out + net.out_bias
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    assert np.allclose(langid.log_probabilities(net.packed(), x), z, atol=0.01)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.train(df) is None
    assert langid.predict(df, None).first()["lang_pred"] == "und"


def test_extra_columns_with_clashing_names(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", 9) for r in rows], "doc_id long, text string, lang string, _letters string, lang_pred string, score int")
    plain = df.select("doc_id", "text", "lang")
    net = langid.train(df)
    found = langid.predict(df, net)
    assert found.columns == ["doc_id", "text", "lang", "_letters", "lang_pred", "score"]
    kept = lambda d: {r["doc_id"]: (r["lang_pred"], round(r["score"], 5)) for r in d.collect()}
    assert kept(found) == kept(langid.predict(plain, langid.train(plain))) and {r["_letters"] for r in found.collect()} == {"x"}
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"} and langid.predict(df.limit(0), net).count() == 0
