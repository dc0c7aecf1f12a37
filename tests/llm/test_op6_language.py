import numpy as np
from pyspark.sql import functions as F

from textloom.llm import op6_language as L

SAMPLES = {"en": "the cat and the dog are in the house with their friend", "de": "der hund und die katze sind in dem haus mit ihrem freund", "fr": "le chat et le chien sont dans la maison avec leur ami"}


def frame(spark):
    rows = [(i * 3 + k, " ".join(np.random.default_rng(i * 3 + k).permutation(t.split())), lang, "s") for i in range(40) for k, (lang, t) in enumerate(SAMPLES.items())]
    odd = [(1000, None, "en", "s"), (1001, "", "de", "s"), (1002, "123 !! \n", "fr", "s"), (1003, "x" * 600_000, "en", "s"), (None, "le chat et le chien", None, "s"), (1004, "The Cat", None, "s")]
    return spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score string")


def test_held_out_accuracy_and_odd_texts(spark):
    df = frame(spark)
    got = {r.doc_id: r for r in L.identified(df).collect()}
    assert len(got) == df.count()
    held = df.where("lang is not null and doc_id < 1000").where(L.held_out(F.col("doc_id"))).select("doc_id", "lang").collect()
    assert held and all(got[r.doc_id].lang_pred == r.lang for r in held)
    for i in (1000, 1001, 1002):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[None].lang_pred == "fr" and got[1004].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())


def test_held_out_documents_teach_nothing(spark):
    df = frame(spark)
    a = L.learn(df, ~L.held_out(F.col("doc_id")))
    changed = df.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("fr")).otherwise(F.col("lang")))
    b = L.learn(changed, ~L.held_out(F.col("doc_id")))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_pieces_give_the_same_vectors(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["abc def  ghi " * 50, "é è 1 2 x", None, "zz"])
    whole = np.concatenate([v for _, _, v, _ in L.bundles(texts)])
    monkeypatch.setattr(L, "PIECE", 17)
    cut = np.concatenate([v for _, _, v, _ in L.bundles(texts)])
    assert np.array_equal(whole, cut)


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    assert L.identified(df).first().lang_pred == "und"
    assert L.identified(df.limit(0)).count() == 0
