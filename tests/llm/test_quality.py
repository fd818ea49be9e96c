import re
from collections import Counter

from playframe.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update((i, i + 1, i + 2))
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def check(out):
    for r in out:
        want = brute(r["text"])
        assert {k: r[k] for k in want} == want, r["doc_id"]


def test_base_counts_of_all_documents(spark, sf):
    check(quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).collect())


def test_odd_texts(docs_of):
    texts = [None, "", " \t\n", "a", "a b", "a b c a b c a", "x y z\nx y z\n\n x y z", " a b \x0bc\x0cd\re", "é# *$\n|<>&% &", "w " * 30000, "😀 a 😀"]
    out = quality.judge(docs_of([(i, t, None) for i, t in enumerate(texts)] + [(0, None, "en"), (None, "a b", "en")])).collect()
    assert len(out) == len(texts) + 2
    check(out)
    assert not any(r["kept"] for r in out)


def test_empty_table_and_clashing_columns(docs_of):
    assert quality.judge(docs_of([])).count() == 0
    from pyspark.sql import functions as F

    docs = docs_of([(1, "word " * 60, "en")]).withColumns({"kept": F.lit("mine"), "words": F.lit(1), "n_words": F.lit(-1)})
    row = quality.judge(docs).first()
    assert row["n_words"] == 60 and row["words"] == 1 and row["kept"] is False
    assert quality.keep_good(docs).columns == docs.columns


def test_distance_against_a_plain_version(spark):
    import math

    from pyspark.sql import functions as F

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        return math.sqrt(sum((a * math.log2(2 * a / (a + b)) if a else 0) / 2 + (b * math.log2(2 * b / (a + b)) if b else 0) / 2
                             for a, b in zip(p, q)))

    cases = [([1.0, 2.0, 3.0], [3.0, 2.0, 1.0]), ([1.0, 0.0], [0.0, 5.0]), ([4.0, 4.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(cases, "p array<double>, q array<double>").select(
        quality.shares(F.col("p")).alias("p"), quality.shares(F.col("q")).alias("q"))
    got = [r[0] for r in df.select(quality.distance(F.col("p"), F.col("q"))).collect()]
    for g, (p, q) in zip(got[:3], cases):
        assert abs(g - js(p, q)) < 1e-9
    assert got[3] is None


def test_junk_goes_and_prose_stays(docs_of):
    import random

    rng = random.Random(1)
    common, rare = "the of and to in that is was for on with as it".split(), ["w" + "".join(rng.choices("aeioulnrst", k=6)) for _ in range(400)]

    def prose(n, mark=""):
        return ". ".join(" ".join((rng.choice(common) if rng.random() < .5 else rng.choice(rare)) + mark for _ in range(12)).capitalize() for _ in range(n))

    docs = [(i, prose(25), "en") for i in range(60)] + [(100, prose(25, "$$%"), "en")]
    out = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(docs)).collect()}
    assert out.pop(100) is False
    assert all(out.values())


def test_repeated_rows_and_broadcast_limit(docs_of, monkeypatch):
    rows = [(1, "a b c " * 30, "en")] * 3
    want = quality.judge(docs_of(rows)).collect()
    monkeypatch.setattr(quality, "BROADCAST_LANGUAGES", 0)
    assert quality.judge(docs_of(rows)).collect() == want and len(want) == 3


def test_a_filter_on_the_verdict_gives_the_same_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = quality.judge(docs).collect()
    kept = quality.judge(docs).filter("kept AND n_words > 60").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in out if r["kept"] and r["n_words"] > 60)


def test_short_junk_goes_and_good_documents_stay(spark):
    """Documents labelled bad that pass the base rules and are compared go, of 60 to 190 words as well; those labelled good stay."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judge(docs.select("doc_id", "text", "lang")).filter("NOT base_failed").join(labels, "doc_id").select("quality", "kept", "n_words").collect()
    bad = [r for r in out if r["quality"] == 0]
    assert len(bad) > 20 and not any(r["kept"] for r in bad) and any(60 <= r["n_words"] <= 190 for r in bad)
    assert all(r["kept"] for r in out if r["quality"] == 1)
