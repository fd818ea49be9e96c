import random

import numpy as np
from pyspark.sql import functions as F

from playframe.llm import contamination as C


def smith_waterman(q, w):
    best, row = 0, [0] * (len(w) + 1)
    for a in q:
        new = [0]
        for j, b in enumerate(w):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
            best = max(best, new[-1])
        row = new
    return best


def test_alignment_against_a_plain_version():
    rng = random.Random(2)
    items = [np.array([rng.randint(1, 6) for _ in range(rng.randint(1, 12))]) for _ in range(60)]
    windows = [np.array([rng.randint(0, 6) for _ in range(rng.randint(1, 25))]) for _ in range(60)]
    want = [smith_waterman(q.tolist(), w.tolist()) for q, w in zip(items, windows)]
    assert C.align(items, windows).tolist() == want


def test_copies_edits_and_clean_texts(spark, docs_of):
    rng = random.Random(4)
    words = ["w" + "".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)]
    bench = [[rng.choice(words) for _ in range(30)] for _ in range(40)]
    table = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bench)], "item_id long, text string")
    docs, want = [], set()
    for i, b in enumerate(bench):
        edited = list(b)
        kind = i % 4
        if kind == 1:
            for k in range(0, 30, 6):
                edited[k] = "zz"
        elif kind == 2:
            del edited[10:13]
            edited.insert(20, "zz")
        elif kind == 3:
            edited = edited[:20]
        text = [rng.choice(words) for _ in range(50)] + edited + [rng.choice(words) for _ in range(50)]
        docs.append((i, " ".join(text).upper() + ".", None))
        want.add((i, i))
    docs += [(100 + i, " ".join(rng.choice(words) for _ in range(300)), None) for i in range(30)]
    out = C.find_leaks(docs_of(docs), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == want
    assert all(r["score"] == 1.0 for r in out if r["item_id"] % 4 == 0)
    small = C.find_leaks(docs_of(docs), table, C.Leaks(block_chars=900, cells=2000)).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, out))  # blocks and batches change nothing
    assert {r["doc_id"] for r in C.drop_leaks(docs_of(docs), table).collect()} == {100 + i for i in range(30)}


def test_documents_hold_what_exact_search_finds(spark, sf, rows):
    items = {r["item_id"]: " ".join(C.words_of(r["text"])) for r in rows("benchmark")}
    texts = {r["doc_id"]: " ".join(C.words_of(r["text"] or "")) for r in rows("documents")}
    exact = {(d, i) for d, t in texts.items() for i, q in items.items() if q in t}
    out = C.find_leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in out}
    assert exact <= got and exact
    by_words = {}
    for r in out:  # whatever is more has the score by a plain alignment
        if (r["doc_id"], r["item_id"]) not in exact:
            q = items[r["item_id"]].split()
            by_words[r["doc_id"], r["item_id"]] = smith_waterman(q, texts[r["doc_id"]].split()) / (2 * len(q))
    assert all(s >= 0.5 for s in by_words.values())


def test_odd_rows(spark, docs_of):
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "?!"), (5, "alpha beta gamma delta"), (6, "alpha beta gamma delta"),
                                   (7, "solo")], "item_id long, text string")
    rows = [(1, None, None), (2, "", None), (3, "say one two now", None), (4, "alpha beta gamma delta", None), (4, "alpha beta gamma delta", None),
            (None, "so Alpha, beta gamma: delta", None), (5, "x " * 200000 + "solo", None), (6, "clean text here", None)]
    out = {(r["doc_id"], r["item_id"]) for r in C.find_leaks(docs_of(rows).withColumn("item_id", F.lit(9)), bench).collect()}
    assert out == {(3, 1), (4, 5), (4, 6), (None, 5), (None, 6), (5, 7)}
    assert sorted(r["doc_id"] for r in C.drop_leaks(docs_of(rows), bench).collect()) == [1, 2, 6]
    assert C.find_leaks(docs_of([]), bench).count() == 0
    assert C.find_leaks(docs_of(rows), bench.limit(0)).count() == 0
    assert C.drop_leaks(docs_of(rows), bench.limit(0)).count() == len(rows)


def halves(items):
    """Documents that hold one half of an item: (doc_id, item_id, text)."""
    out = []
    for i, words in items:
        half = -(-len(words) // 2)
        out += [(10 * i + k, i, " ".join(words[a:a + half])) for k, a in enumerate(range(0, len(words) - half + 1, 5))]
    return out


def test_an_item_that_is_a_third_of_the_benchmark(spark, docs_of):
    rng = random.Random(8)
    words = ["w" + "".join(rng.choices("abcdefghij", k=4)) for _ in range(3000)]
    bench = [(i, [rng.choice(words) for _ in range(40)]) for i in range(1, 61)]
    common = [(i, bench[0][1]) for i in range(100, 130)]
    near = [(i, [*bench[1][1][:-1], f"end{i}"]) for i in range(200, 230)]
    docs = halves(bench[:6])
    want = {(d, i) for d, i, _ in docs} | {(d, j) for d, i, _ in docs if i == 1 for j, _ in common}
    rows = docs_of([(d, f"so it is {t} in short", None) for d, _, t in docs])
    table = spark.createDataFrame([(i, " ".join(w).upper() + "!" * (i % 3)) for i, w in bench + common + near], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in C.find_leaks(rows, table).collect()}
    assert want <= got and {i for _, i in got} <= {*range(1, 7), *range(100, 130), *range(200, 230)}
    small = C.find_leaks(rows, table, C.Leaks(block_chars=9000)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in small} == got
    once, every = (C.Block([(i, " ".join(w)) for i, w in t], C.Leaks()) for t in (bench, bench + common))
    seeds = [{i for k in b.places for j, i in k if j == 0} for b in (once, every)]
    assert seeds[0] == seeds[1]  # copies of an item cost it no seed


def test_a_benchmark_of_five_items(spark, docs_of):
    rng = random.Random(9)
    bench = [(i, [f"w{rng.randint(0, 60)}" for _ in range(40)]) for i in range(1, 6)]
    docs = halves(bench)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in bench], "item_id long, text string")
    got = C.find_leaks(docs_of([(d, t, None) for d, _, t in docs]), table).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} >= {(d, i) for d, i, _ in docs}
    block = C.Block([(i, " ".join(w)) for i, w in bench], C.Leaks())
    for j in range(5):
        at = {i for k in block.places for item, i in k if item == j}
        assert all(at & {a, a + 1, a + 2} for a in range(36))
