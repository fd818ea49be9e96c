import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from playframe.llm import runs as R
from playframe.llm.queries import RUNS


def plain(words):
    """(start, end, period) of all runs, period by period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in out.items())


def random_words(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(200))]
    if kind == 1:
        a, b = [0], [0, 1]
        while len(b) < 250:
            a, b = b, b + a
        return b[:rng.randrange(250)]
    if kind == 2:  # touching regions of one period
        r = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        return r * rng.randrange(5, 40) + r[:rng.randrange(len(r) + 1)] + [7] * rng.randrange(2) + r * rng.randrange(5, 40) + [9] * rng.randrange(3) + r * 9
    if kind == 3:
        x = [rng.randrange(50) for _ in range(rng.randrange(1, 60))]
        return [60, 61, 62] + x * rng.randrange(1, 5) + x[:rng.randrange(len(x))] + [63, 64]
    if kind == 4:
        return [bin(i).count("1") & 1 for i in range(rng.randrange(300))]
    x = [0]
    while len(x) < 300:
        x = x + (x if rng.random() < .4 else [rng.randrange(3)] if rng.random() < .5 else x[rng.randrange(len(x)):])
    return x[:500]


def test_all_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(500):
        words = random_words(rng)
        assert [tuple(x) for x in R.all_runs(np.array(words, dtype=np.int64)).tolist()] == plain(words), words


def test_selected_positions_depend_on_their_context_and_are_dense():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, 5000)
    codes[2000:2600] = 1  # highly periodic
    names = R.Names(codes)
    for level in (2, 3, 4):
        t = 1 << level
        last = len(codes) - t + 1
        periodic = np.array([any((codes[i:i + t - p] == codes[i + p:i + t]).all() for p in range(1, t // 3 + 1)) for i in range(last)])
        at = R.synchronising(names.levels[level], periodic, t)
        chosen = {codes[i:i + 2 * t].tobytes() for i in at.tolist()}
        picked = set(at.tolist())
        for i in range(len(codes) - 2 * t + 1):
            assert (i in picked) == (codes[i:i + 2 * t].tobytes() in chosen)
        for i in range(len(codes) - 3 * t + 2):
            if not picked & set(range(i, i + t)):
                w = codes[i:i + 3 * t - 1]
                assert any((w[p:] == w[:-p]).all() for p in range(1, t // 3 + 1))


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and words:
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = [(s, e - s, q) for s, e, q in plain(words) if e - s >= 12]
    found.sort(key=lambda x: (x[0], x[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_a_plain_version(spark, sf, rows):
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in RUNS["op12_runs"](spark, sf).collect()}
    docs = [r for r in rows("documents") if len(r["text"] or "") < 12000]
    assert len(out) == len(rows("documents")) and len(docs) > 150
    for r in docs:
        assert out[r["doc_id"]] == expected(r["doc_id"], r["text"]), r["doc_id"]


def test_odd_texts(docs_of):
    texts = [None, "", " \n\t", "a", "a " * 11, "a " * 12, "a b " * 6, "a b c d e f " * 2, "é x \x1cy " * 20 + "z", "A a " * 40,
             ("w%d " * 50) % tuple(range(50)) * 3, "x y z " * 30 + "x y y z " * 30, "a " * 30000, " ".join(map(str, range(3000))) + " 1 2 3 4 5 6"]
    docs = [(i, t, "en") for i, t in enumerate(texts)] + [(3, "b " * 20, None), (3, "b " * 20, None), (None, "c d " * 9, "en")]
    out = R.digests(R.find_runs(R.with_repeats(docs_of(docs)))).collect()
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in out), key=repr)
    short = [d for d in docs if len(d[1] or "") < 20000]
    want = sorted(((i, *expected(i, t)) for i, t, _ in short), key=repr)
    assert [x for x in got if x[0] != 12] == want
    long = next(r for r in out if r["doc_id"] == 12)
    assert (long["n_runs"], long["start"], long["length"], long["period"]) == (1, 0, 30000, 1)


def test_output_columns(spark, docs_of):
    docs = docs_of([(1, "a b c d e f g h i " * 3, "en")]).withColumns({"runs": F.lit("mine"), "start": F.lit(4), "collapsed": F.lit(1)})
    row = R.find_runs(docs).first()
    assert row["start"] == 4 and [tuple(x) for x in row["runs"]] == [(0, 27, 9)] and row["collapsed"] == "a b c d e f g h i"
    assert row["n_words"] == 27 and R.find_runs(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        R.find_runs(docs, R.Runs(least_length=5))
