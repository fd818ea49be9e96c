import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.llm import minhash
from playframe.llm.common import Scratch
from playframe.llm.components import components
from playframe.llm.wordhash import shingles, word_hashes


def grams(text, n=5):
    w = text.lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(pairs, ids):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def test_all_documents_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {i: grams(t or "") for i, t in docs.items()}
    pairs = [(a, b) for a, b in combinations(docs, 2) if sets[a] and sets[b]
             and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert got == classes(pairs, docs) and pairs


def test_hashes_follow_words():
    texts = ["a b c d e f", "A\tb\nc d  e f ", "", " ", "a b", "x" * 3_000_000 + " y", "é ü"]
    h, off = word_hashes(texts)
    words = [t.lower().split(" ") for t in texts]
    assert np.diff(off).tolist() == [6, 6, 0, 0, 2, 2, 2] and words
    assert h[:6].tolist() == h[6:12].tolist() and len(set(h[:6].tolist())) == 6
    assert h[12:14].tolist() == h[:2].tolist()
    s, so = shingles(h, off, 5)
    assert np.diff(so).tolist() == [2, 2, 0, 0, 1, 1, 1]
    assert s[0] == s[2] and s[0] != s[1]


def test_samples_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    u = np.sort(rng.integers(1, 1 << 63, 400).astype(np.uint64))
    a, b = np.full(400, 3.0), np.full(400, 3.0)
    a[:60], b[:60] = 9.0, 3.0
    b[300:] = 1.0
    sig = minhash.signatures(np.concatenate((u, u)), np.concatenate((a, b)), np.array([0, 400, 800]), 3.0, 3000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03


def test_chains_and_groups(spark, docs_of):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base = [word() for _ in range(200)]
    chain, items, now = [], [], list(base)
    for i in range(12):  # neighbours are similar, the ends are not
        chain.append(" ".join(now))
        now[i * 15] = word()
    items += [(100 + i, t, None) for i, t in enumerate(chain)]
    items += [(i, " ".join(word() for _ in range(80)), None) for i in range(20)]
    items += [(200 + i, "the same text again and again", None) for i in range(30)]
    out = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(items)).collect()}
    assert {out[100 + i]["class_id"] for i in range(12)} == {100}
    assert all(out[i]["class_id"] == i and out[i]["n_links"] == 0 for i in range(20))
    assert {out[200 + i]["class_id"] for i in range(30)} == {200}
    kept = {r["doc_id"] for r in minhash.keep_one(docs_of(items)).collect()}
    assert kept == {100, 200, *range(20)}


def test_odd_rows(docs_of):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", "a"), (4, "a b", "a"), (5, "A  b", "a"), (6, text, "a"), (6, text, "b"),
            (7, text + " end", "a"), (None, text, "a"), (8, "solo " * 300000, "a")]
    out = minhash.near_duplicates(docs_of(rows).withColumn("node", F.lit("x"))).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert by == {1: {1}, 2: {2}, 3: {3}, 4: {4}, 5: {4}, 6: {6}, 7: {6}, None: {6}, 8: {8}}
    kept = minhash.keep_one(docs_of(rows).withColumn("node", F.lit("x")))
    assert kept.columns == [*docs_of(rows).columns, "node"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6, 8]
    assert minhash.near_duplicates(docs_of([])).count() == 0
    assert minhash.keep_one(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(25)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "cc")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == classes([e for e in edges if e[0] != e[1]], ids)
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "cc")).count() == 0
