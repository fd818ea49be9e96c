import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playframe.llm import bytebpe, lexicon as X
from playframe.llm.queries import RUNS

PATH = bytebpe.public_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def random_texts():
    rng = random.Random(3)
    marks = list("ab '\n\tsté1²😀日՘ A\x85\x1c 　") + ["<|endoftext|>", "  ", " the", "ing", "'s", "'ll", "\r\n", " 0", "<|endof"]
    odd = ["", " ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>  x", "  \n\n a  ", "x" * 5000 + "é😀" * 50, "日本語 テスト", "a₏1", "\U0001e6c0 x"]
    return odd + ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(2000)]


def in_memory(words, tmp_path):
    path = tmp_path / "lexicon.bin"
    path.write_bytes(X.packed(words))
    return X.Lexicon(str(path))


def test_the_automaton_is_minimal_and_numbers_its_words(tmp_path):
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(8))) for _ in range(300)})
    made = X.minimal(words)
    arcs = {}
    for k, t in zip(made["key"].tolist(), made["target"].tolist()):
        arcs.setdefault(k // 256, []).append((k % 256, t))

    def right(state, prefix=b""):
        out = {prefix} if made["final"][state] else set()
        for b, t in arcs.get(state, []):
            out |= right(t, prefix + bytes([b]))
        return frozenset(out)

    languages = [right(s) for s in range(len(made["final"]))]
    assert languages[0] == set(words)
    assert len(set(languages)) == len(languages) and all(languages)  # no two states alike, none dead
    lexicon = in_memory({w: [len(w)] for w in words}, tmp_path)
    asked = words + [b"d", b"abcd", b"aaaaaaaaa", b"\xff"]
    want = {w: k for k, w in enumerate(words)}
    assert lexicon.numbers(asked).tolist() == [want.get(w, -1) for w in asked]
    assert isinstance(lexicon.key, np.memmap)
    assert in_memory({}, tmp_path / "..").numbers([b"a", b""]).tolist() == [-1, -1]


def test_ids_are_the_tokenizers(tokenizer, tmp_path):
    own, texts = bytebpe.loaded(PATH), random_texts()
    lexicon = in_memory({w.encode(): own.merge(w) for w in (" the", "ing", "a", "   ", "'s", " aing")}, tmp_path)
    encoder = X.Encoder(own, lexicon)
    encoder.MOST = 50  # a full table begins anew
    for k in range(0, len(texts), 300):
        part = texts[k:k + 300]
        assert [x.tolist() for x in encoder.encode(part)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in part]
    assert encoder.encode([]) == []
    for t in texts:
        assert own.words(own.chunks(t))[1] == own.split(t)


def check(out, docs, tokenizer):
    want = []
    for i, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_against_the_library(spark, sf, rows, tokenizer):
    check(RUNS["op13_bpe"](spark, sf).collect(), [(r["doc_id"], r["text"]) for r in rows("documents")], tokenizer)


def test_odd_rows_and_small_lexicons(docs_of, tokenizer):
    docs = list(enumerate(random_texts()[:300])) + [(1, None), (None, "a b"), (2, "a b"), (2, "a b"), (9, "word " * 40000)]
    for opt in (X.Bpe(words=5, held_chunks=3), X.Bpe(words=0), X.Bpe(longest_word=1)):
        check(X.digests(docs_of([(i, t, None) for i, t in docs]), opt).collect(), docs, tokenizer)
    assert X.digests(docs_of([])).count() == 0


def test_word_counts_and_columns(docs_of):
    docs = docs_of([(1, "a b<|endoftext|> b  b\n a", None), (2, "a b", None), (3, None, None)])
    counts = {bytes(r["word"]): r["n"] for r in X.word_counts(docs).collect()}
    assert counts == {b"a": 2, b" b": 4, b" ": 1, b"\n": 1, b" a": 1}
    wide = docs.withColumns({"ids": F.lit(1), "word": F.lit("w")})
    out = X.encode(wide, X.compile_lexicon(wide))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "word", "ids"]
    assert X.decode(out).columns == [*out.columns, "text"]
    back = {r["doc_id"]: r["text"] for r in X.decode(out.withColumn("text", F.lit(0))).collect()}
    assert back == {1: "a b<|endoftext|> b  b\n a", 2: "a b", 3: ""}
    broken = out.limit(1).withColumn("ids", F.unhex(F.lit("b9000000")))
    assert X.decode(broken).first()["text"] == "�"
