import zlib

import numpy as np
from pyspark.sql import functions as F

from playframe.llm import langid as L


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r for r in docs.collect()}
    out = L.predict_all(docs).collect()
    assert len(out) == len(truth)
    right = total = 0
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        if r["held_out"] and len(truth[r["doc_id"]]["text"].split()) >= 5:
            total += 1
            right += r["lang_pred"] == truth[r["doc_id"]]["lang"]
    assert total > 100 and right / total > 0.98


def test_only_training_rows_teach(spark, docs_of):
    """Held-out rows with a language of their own leave no trace."""
    teach = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    hold = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "der die und nicht ein " * 5, "de") if i % 2 else (i, "the and of with that " * 5, "en") for i in teach]
    rows += [(i, "qwx zzy xxq " * 5, "zz") for i in hold] + [(300, "the and of", None)]
    out = {r["doc_id"]: r["lang_pred"] for r in L.predict_all(docs_of(rows)).collect()}
    assert "zz" not in out.values() and out[300] == "en"
    assert all(out[i] == ("de" if i % 2 else "en") for i in teach)


def test_rejection_by_distance(docs_of):
    rows = [(i, "the and of with that there " * 9, "en") for i in range(60)] + [(1000, "ωψχφ υτσρ πξνμ " * 9, None)]
    out = {r["doc_id"]: r for r in L.predict_all(docs_of(rows)).collect()}
    assert out[1000]["rejected"] and not out[0]["rejected"]


def test_odd_rows(docs_of):
    rows = [(i, "one two three", "en") for i in range(8)] + [(20, None, "en"), (21, "", "en"), (22, "12 .. 34", "en"), (23, "a", None), (None, "one", "en"),
                                                           (24, "one two " * 100000, None), (5, "one two three", "en"), (25, "😀", None)]
    out = L.predict_all(docs_of(rows).withColumn("lang_pred", F.lit("no"))).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert [by[i]["lang_pred"] for i in (20, 21, 22, 25)] == ["und"] * 4 and by[20]["score"] == 0
    assert by[24]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert L.predict_all(docs_of([])).count() == 0
    assert {r["lang_pred"] for r in L.predict_all(docs_of([(1, "text", None)])).collect()} == {"und"}


def test_grams_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["Abc  dEf", "", "x", "...", "abc def ghi", "é1é"]
    together = L.vectors(texts, 512)
    for i, t in enumerate(texts):
        assert np.array_equal(together[i], L.vectors([t], 512)[0])
    assert np.array_equal(L.vectors(["ABC"], 512), L.vectors(["abc"], 512))
    assert L.vectors(["a b"], 512).sum() > 0 and not L.vectors(["1 2"], 512).any()


def test_every_language_is_learned(docs_of):
    """600 languages of letters of their own, each of a few short texts."""
    def text(k, n):
        own = chr(0x4E00 + 7 * k) + chr(0x4E01 + 7 * k) + chr(0x4E02 + 7 * k)
        return " ".join(own[(n + i) % 3] + own[(n + i * i) % 3] for i in range(8))

    rows = [(4 * k + n, text(k, n), f"l{k}") for k in range(600) for n in range(3)]
    docs = docs_of(rows).withColumnRenamed("doc_id", "id")
    model = L.fit(docs, L.LangId())
    assert len(model.languages) == 600
    got = {r["id"]: r["lang_pred"] for r in L.identify(docs, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_one_id_of_many_rows_stays_a_bounded_sample(docs_of):
    docs = docs_of([(7, f"some words {i}", "en") for i in range(300)]).withColumnRenamed("doc_id", "id")
    assert L.fit(docs, L.LangId(per_language=5)) is not None
