import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playframe.llm import alignment as A
from playframe.llm.queries import RUNS


@pytest.fixture(scope="module")
def sides():
    """Both tokenizers as functions of a text to (ids, bytes of the tokens)."""
    one = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in kept)}

    def first(text):
        ids = one.encode(" " + text, add_special_tokens=False).ids
        return ids, [bytes(byte[c] for c in one.id_to_token(i)) for i in ids]

    def second(text):
        ids = two.encode(text)
        return ids, [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in ids]

    return first, second


def plain(text, sides):
    """groups and links of one text, token by token."""
    (ia, ba), (ib, bb) = (s(text or "") for s in sides)
    whole = (" " + (text or "")).encode()
    if not text or b"".join(ba) != whole or b"".join(bb) != whole:
        return [], [], 0, 0

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    ra, rb = ranges(ba), ranges(bb)
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, low = [], 0
    for c in cuts:
        groups.append(([i for i, (s, e) in zip(ia, ra) if low <= s and e <= c], [i for i, (s, e) in zip(ib, rb) if low <= s and e <= c]))
        low = c
    links, at = [], 0
    for i, (s, e) in zip(ia, ra):
        while rb[at][1] <= s:
            at += 1
        k = at
        while k < len(rb) and rb[k][0] < e:
            links.append((i, ib[k]))
            k += 1
    return groups, links, len(ia), len(ib)


def expected(docs, sides):
    made = [(i, *plain(t, sides)) for i, t in docs]
    n = Counter(p for _, _, links, _, _ in made for p in set(links))
    top = {}
    for (a, _), c in n.items():
        top[a] = max(top.get(a, 0), c)
    out = []
    for i, groups, links, n_a, n_b in made:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, n_a, n_b, len(groups), len(links), sum(n[p] == top[p[0]] for p in links), sum(n[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=repr)


def got(df):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_query_against_a_plain_version(spark, sf, rows, sides):
    assert got(RUNS["op11_alignment"](spark, sf)) == expected([(r["doc_id"], r["text"]) for r in rows("documents")], sides)


def odd():
    rng = random.Random(4)
    marks = list("ab '\n\tsté1²😀日▁ A\x85\x1c 　") + ["<|endoftext|>", "<s>", "</s>", "<0x41>", "  ", "    ", " the", "ing", "'s", "\r\n", "\x00"]
    texts = [None, "", " ", "a", "  a", "a  ", "▁", "x" * 3000, "<|endoftext|> <s>", "日本語 テスト", "word " * 3000]
    return texts + ["".join(rng.choice(marks) for _ in range(rng.randrange(50))) for _ in range(400)]


def test_odd_texts_and_few_frequent_pairs(docs_of, sides):
    docs = list(enumerate(odd())) + [(1, "same text"), (1, "same text"), (None, "same text")]
    want = expected(docs, sides)
    for opt in (A.Alignment(), A.Alignment(frequent=0), A.Alignment(frequent=20)):
        assert got(A.digests(docs_of([(i, t, None) for i, t in docs]), opt)) == want
    assert A.digests(docs_of([])).count() == 0


def test_chunks_give_the_ids_of_whole_texts(sides):
    own = A.Aligner(A.Alignment())
    own.pieces.MOST = 40
    texts = [t for t in odd() if t]
    for some in (texts, *([t] for t in texts[:60])):
        for side, (doc, ids) in zip(sides, own.tokens(some)):
            for k, t in enumerate(some):
                assert ids[doc == k].tolist() == ([] if "▁" in t else side(t)[0]), t


def test_output_columns(docs_of, sides):
    docs = docs_of([(1, "an unbelievable token", "en")]).withColumns({"links": F.lit("mine"), "token": F.lit(3), "n_a": F.lit("x")})
    row = A.align(docs).first()
    groups, links, n_a, n_b = plain("an unbelievable token", sides)
    assert row["token"] == 3 and (row["n_a"], row["n_b"], row["n_groups"], row["n_links"]) == (n_a, n_b, len(groups), len(links))
    assert {(x["a"], x["b"]): x["times"] for x in row["links"]} == Counter(links)
    assert row["groups"] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
