import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from playframe.llm import packing as K


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def check(out, docs, tokenizer, size=4096):
    want = Counter()
    for d, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, s in enumerate(range(0, len(ids), size)):
            part = ids[s:s + size]
            want[d, k, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r["length"] for r in out)
    return len(by), -(-total // size)


def test_all_documents(spark, sf, rows, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in rows("documents")]
    used, bound = check(K.pack(spark.read.parquet(f"{sf}/documents.parquet")).collect(), docs, tokenizer)
    assert used <= bound + 1


def test_odd_rows(docs_of, tokenizer):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello world"), (4, "Hello world"), (4, "other"), (None, "x"), (5, "a b c d " * 5000),
            (6, "<|endoftext|> É́ ﬁ 😀\x85"), (7, "word " * 4095), (8, "word " * 4096), (9, "word " * 8191)]
    check(K.pack(docs_of([(i, t, None) for i, t in rows])).collect(), rows, tokenizer)
    few = K.pack(docs_of([(i, t, None) for i, t in rows]), K.Packing(size=7, slices=3)).collect()
    check(few, rows, tokenizer, 7)
    assert K.pack(docs_of([])).count() == 0


def test_ids_are_the_tokenizers(tokenizer):
    own = K.Tokens(K.tokenizer_path(K.Packing()))
    texts = ["I'M it's 'll x'S !'s ''re can't've 12a4", "ÀÖ×÷ ÿß ŸÉ ªº", "Σίσυφος ΣΑΣ", "a\x85b c d\x1ce", "x<|startoftext|>y",
             "".join(map(chr, range(1, 1500))), *("".join(chr(c) + "a" for c in range(k, k + 100)) for k in range(33, 0x2FF, 100))]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    own.MOST = 3  # a full table begins anew
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(5, 60))
    counts = {int(k): int(rng.integers(1, 400)) for k in rng.choice(np.arange(1, size + 1), min(size, 12), replace=False)}
    plans, used = K.plan(counts, size), Counter()
    for uses, lengths in plans:
        assert uses > 0 and sum(lengths) <= size
        for x in lengths:
            used[x] += uses
    assert used == Counter(counts)
    assert len(plans) <= sum(1 + size // x for x in counts)  # each leaves fewer of a length than it takes


def test_two_fit_beats_the_greedy_bin():
    # greedy fills 6 + 3 of 10; 6 + (2 + 2) is tighter
    assert (1, [6, 2, 2]) in K.plan({6: 1, 3: 1, 2: 2}, 10)


def test_one_length_for_a_third_of_all(docs_of, tokenizer):
    rows = [(i, "same words here") for i in range(2000)] + [(10000 + i, "word " * (i % 700)) for i in range(1000)]
    used, bound = check(K.pack(docs_of([(i, t, None) for i, t in rows])).collect(), rows, tokenizer)
    assert used <= bound + 1
