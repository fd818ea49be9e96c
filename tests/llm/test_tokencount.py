import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from playframe.llm import tokencount as U


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer(models.Unigram(U.vocabulary(U.Unigram()), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


ODD = ["", " ", "  a", "a  b ", "▁", "▁▁x", "\n", "a\nb\tc", "日本語 テスト", "😀😀 x", "<s> </s> <0x41>", "\x00\x01", "é́", "aaaaaaaaaaaaaaaaaaaa", " x", "x" * 300]


def test_counts_are_the_tokenizers(spark, sf, rows, tokenizer, docs_of):
    docs = rows("documents")
    want = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs}
    got = {r["doc_id"]: r["n_tokens"] for r in U.count_tokens(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()}
    assert got == want
    out = U.count_tokens(docs_of([(i, t, None) for i, t in enumerate(ODD)] + [(None, None, None), (3, "a  b ", None)]).withColumn("n_tokens", F.lit("x")))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens"]
    odd = [(r["doc_id"], r["n_tokens"]) for r in out.collect()]
    assert odd[:-2] == [(i, len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in enumerate(ODD)]
    assert odd[-2:] == [(None, 0), odd[3]]
    assert U.count_tokens(docs_of([])).count() == 0


def test_ties_go_to_the_piece_that_begins_first():
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -2.0), ("b", -2.0), ("c", -2.0), ("ab", -4.0), ("bc", -4.0), ("abc", -6.0), ("▁a", -3.0), ("▁ab", -5.0)]
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    own = U.Counter.__new__(U.Counter)
    import ahocorasick

    own.automaton = ahocorasick.Automaton()
    for p, s in vocab:
        own.automaton.add_word(p, (len(p), s))
    own.automaton.make_automaton()
    own.single, own.unknown = {p for p, _ in vocab if len(p) == 1}, -16.0
    for w in ("▁abc", "▁abcabc", "▁cab", "▁bcabab", "▁aabbcc"):
        assert own.word(w) == len(t.encode(w).ids), w


def test_a_small_table_begins_anew(tokenizer):
    own = U.Counter(U.Unigram(most_words=3))
    for t in ("one two three four five six", "one two seven", "six five four one"):
        assert own.text(t) == len(tokenizer.encode(t, add_special_tokens=False).ids)
