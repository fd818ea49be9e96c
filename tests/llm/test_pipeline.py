import json
from collections import Counter
from itertools import combinations

import corpus_pipeline as C
from playframe.llm import contamination, quality
from playframe.llm.common import Scratch, table


def test_stages_against_brute_force(spark, sf):
    """Each stage is compared with a plain version that reads its own input."""
    from test_contamination import smith_waterman
    from test_minhash import classes, grams
    from test_packing import check
    from test_secrets import base, brute
    import public_tokenizers
    from tokenizers import Tokenizer

    scratch = Scratch(spark, "pipeline-test")
    docs, seen = table(spark, sf, "documents"), []
    for name, stage in C.STAGES:
        before = docs.collect()
        docs = scratch.keep(stage(spark, docs, sf))
        seen.append((name, before, docs.collect()))
    names = [n for n, _ in C.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontaminate", "secret_scan", "best_fit_packing"]
    by = {n: ({r["doc_id"]: r for r in a}, b) for n, a, b in seen}
    for n in names[:-1]:
        assert all(r.asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars"} for r in by[n][1])

    start, out = by["quality_rules"]
    kept = {r["doc_id"] for r in quality.judge(table(spark, sf, "documents")).filter("kept").collect()}
    assert {r["doc_id"] for r in out} == kept and all(start[r["doc_id"]] == r for r in out)

    start, out = by["near_dedup"]
    sets = {i: grams(r["text"]) for i, r in start.items()}
    pairs = [(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert {r["doc_id"] for r in out} == set(classes(pairs, start).values())

    start, out = by["decontaminate"]
    items = [contamination.words_of(r["text"]) for r in table(spark, sf, "benchmark").collect()]
    gone = set()
    for i, r in start.items():
        w = contamination.words_of(r["text"])
        grams3 = {tuple(w[k:k + 3]) for k in range(len(w) - 2)}
        for q in items:
            if any(tuple(q[k:k + 3]) in grams3 for k in range(len(q) - 2)) and smith_waterman(q, w) >= len(q):
                gone.add(i)
    assert {r["doc_id"] for r in out} == start.keys() - gone and gone

    start, out = by["secret_scan"]
    assert {r["doc_id"] for r in out} == start.keys()
    for r in out:
        assert not brute(r["text"]) and r["n_chars"] == len(r["text"])
        if not brute(start[r["doc_id"]]["text"]):
            assert r["text"] == start[r["doc_id"]]["text"]

    start, out = by["best_fit_packing"]
    used, bound = check(out, [(i, r["text"]) for i, r in start.items()], Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))))
    assert used <= bound + 1

    whole = Counter(json.dumps([r["doc_id"], r["piece"], r["length"], r["ids_crc32"]]) for r in C.run(spark, sf).collect())
    assert whole == Counter(json.dumps([r["doc_id"], r["piece"], r["length"], r["ids_crc32"]]) for r in out)
