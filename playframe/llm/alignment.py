"""Tokens of two tokenizers over one text, aligned by their bytes.

Side A is a byte-level BPE file, side B a piece model; both see a space and then
the text, and strings of special tokens are plain text. The byte offsets where
tokens of both sides end cut them into groups. Tokens are linked where their bytes
overlap: for a batch of texts, ``pandas.merge_asof`` keyed by document gives for
each start of an A token the B token that covers it, and the same the other way
round; the union of both is every overlap, as of two overlapping tokens the one
that starts later starts inside the other.

``pair_counts`` counts for each pair of ids in how many documents it is linked;
``scores`` sums those counts over the links of a document. The pairs of a document
go through one table of the shared folder. The ``frequent`` pairs most common in
the corpus, a table of bounded size, are broadcast; links of all other pairs,
none of which is common, are joined by shuffle.

Defined results: a null or empty text, and one whose tokens of either side do not
give back its bytes (it holds U+2581, which side B reads as a space), has no
tokens: counts are 0, groups and links empty; a very long text is aligned whole,
in memory that grows with it; of pairs with equal counts all are the best of
their A id, and which of them are broadcast does not matter; repeated rows are
aligned each and count as documents of their own; an empty table gives no rows;
other columns pass through ``align``, those of its own names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from playframe.llm import bytebpe
from playframe.llm.common import Scratch, most_frequent
from playframe.llm.lexicon import Encoder, Lexicon, gather
from playframe.llm.wordhash import blocks

MARK = "▁"
_ODD, _BOTH = re.compile(r" (?:\s|\Z)"), re.compile(r"(?<=[^ ]) (?=\S)")
LINK = T.StructType([T.StructField(k, T.IntegerType()) for k in ("a", "b", "times")])
OUT = ("n_a", "n_b", "n_groups", "n_links", "groups", "links")


@dataclass(frozen=True)
class Alignment:
    tokenizer: str = ""       # side A, a byte-level BPE file; empty: byte_bpe_50k.json
    pieces: str = ""          # side B, a piece model; empty: piece_bpe_32k.model
    frequent: int = 1 << 18   # most rows of the broadcast table of pairs

    @property
    def a(self) -> str:
        return self.tokenizer or bytebpe.public_path("byte_bpe_50k.json")

    @property
    def b(self) -> str:
        return self.pieces or bytebpe.public_path("piece_bpe_32k.model")


class Pieces:
    """Ids of a piece model. No piece holds the mark of a space after another
    character, so what begins with a space after something else is encoded apart
    and looked up again; the table begins anew when full."""

    MOST = 300_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece of the model reaches past the begin of a word")
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(names)]
        self.space = np.array([self.model.piece_to_id(MARK)], dtype=np.int32).tobytes()
        self.known: dict[str, bytes] = {}

    def ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks without the mark; the model puts a space before each."""
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        new = [c for c in chunks if c not in known]
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1) if new else [], strict=True):
            known[chunk] = np.array(ids, dtype=np.int32).tobytes() if chunk else self.space
        out = [known[c] for c in chunks]
        for chunk in new:
            if len(chunk) > 256:
                del known[chunk]
        return out


class Side:
    """The bytes of all tokens of one side, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.first[ids], self.size[ids])[0]


def chunks(text: str) -> list[str]:
    """A space and the text cut where both sides always cut: before a space with
    no space before it and no white space after it. The space that each chunk
    begins with is left out."""
    whole = " " + text
    if not _ODD.search(whole):
        return text.split(" ")
    first, *rest = _BOTH.split(whole)
    return [first[1:], *rest]


class Aligner:
    def __init__(self, opt: Alignment):
        self.own, self.pieces = bytebpe.loaded(opt.a), Pieces(opt.b)
        self.encoder = Encoder(self.own, Lexicon(), specials=False)
        self.sides = Side(self.own.bytes), Side(self.pieces.bytes)
        self.most = max(len(self.own.bytes), len(self.pieces.bytes))
        self.written = Side([f"{i}{mark}".encode() for mark in ",|;" for i in range(self.most)])

    def _of_chunks(self, kinds: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """The chunks in another order, and for both sides their ids one after
        the other and where each begins."""
        plain, words, n = self.own.words([c for c in kinds if c[:1] != " "])
        for c in kinds:
            if c[:1] == " ":
                own = self.own.split(" " + c)
                plain.append(c)
                words += own
                n = np.append(n, len(own))
        word_of = {w: k for k, w in enumerate(dict.fromkeys(words))}
        table, first, count = self.encoder._words(list(word_of))
        codes = np.fromiter(map(word_of.__getitem__, words), dtype=np.int64, count=len(words))
        flat, edge = gather(table, first[codes], count[codes])
        made = self.pieces.ids(plain)
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        return plain, [(flat, edge[np.concatenate(([0], np.cumsum(n)))]), (np.frombuffer(b"".join(made), dtype=np.int32), np.concatenate(([0], np.cumsum(size))))]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both sides the text of each token and its id; texts that a side
        does not give back have none."""
        parts = [chunks(t) if t and MARK not in t else [] for t in texts]
        every = [c for p in parts for c in p]
        kinds, sides = self._of_chunks(list(dict.fromkeys(every)))
        kind_of = dict(zip(kinds, range(len(kinds)), strict=True))
        codes = np.fromiter(map(kind_of.__getitem__, every), dtype=np.int64, count=len(every))
        edge = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
        out, good = [], np.ones(len(texts), dtype=bool)
        raw = b"".join([b" " + t.encode("utf-8") for t, p in zip(texts, parts, strict=True) if p])
        whole = np.frombuffer(raw, dtype=np.uint8)
        for side, (flat, begin) in zip(self.sides, sides, strict=True):
            ids, at = gather(flat, begin[codes], begin[codes + 1] - begin[codes])
            at = at[edge]
            if not np.array_equal(side.bytes(ids), whole):
                good &= [side.bytes(ids[x:y]).tobytes() == (b" " + t.encode("utf-8") if p else b"")
                         for x, y, t, p in zip(at[:-1], at[1:], texts, parts, strict=True)]
            out.append((np.repeat(np.arange(len(texts)), np.diff(at)), ids))
        return out if good.all() else [(doc[good[doc]], ids[good[doc]]) for doc, ids in out]

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """The columns OUT; links as (offsets, a, b, times)."""
        n = len(texts)
        (doc_a, ids_a), (doc_b, ids_b) = self.tokens(texts)
        size_a, size_b = self.sides[0].size[ids_a], self.sides[1].size[ids_b]
        end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)  # equal bytes on both sides, so one offset for both
        a, b = _overlaps(doc_a, end_a - size_a, doc_b, end_b - size_b)
        ends = np.zeros((2, int(size_a.sum()) + 1), dtype=bool)
        ends[0, end_a] = ends[1, end_b] = True
        last_a, last_b = ends[1, end_a], ends[0, end_b]  # where both sides end
        out = {"n_a": np.bincount(doc_a, minlength=n), "n_b": np.bincount(doc_b, minlength=n),
               "n_groups": np.bincount(doc_a[last_a], minlength=n), "n_links": np.bincount(doc_a[a], minlength=n),
               "groups": self._written(doc_a, ids_a, last_a, doc_b, ids_b, last_b, n)}
        # per text its distinct pairs of ids
        key = doc_a[a] * self.most ** 2 + ids_a[a].astype(np.int64) * self.most + ids_b[b]
        key, times = np.unique(key, return_counts=True)
        edge, pair = np.searchsorted(key, np.arange(n + 1) * self.most ** 2), key % self.most ** 2
        out["links"] = (edge, pair // self.most, pair % self.most, times)
        return out

    def _written(self, doc_a, ids_a, last_a, doc_b, ids_b, last_b, n: int) -> list[str]:
        """a1,a2|b1;a3|b2 per text: of each group its A tokens, then its B tokens."""
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_a = np.cumsum(np.bincount(group_a, minlength=int(last_a.sum())))  # A tokens up to each group
        before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b))))
        code, owner = np.empty(len(ids_a) + len(ids_b), dtype=np.int64), np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        for doc, ids, last, mark, at in ((doc_a, ids_a, last_a, 1, np.arange(len(ids_a)) + before_b[group_a]),
                                         (doc_b, ids_b, last_b, 2, np.arange(len(ids_b)) + before_a[group_b])):
            code[at] = ids + self.most * mark * last
            owner[at] = doc
        size = np.bincount(owner, weights=self.written.size[code], minlength=n).astype(np.int64)
        raw, stop = self.written.bytes(code).tobytes(), np.cumsum(size).tolist()
        return [raw[x:y - 1].decode() if y > x else "" for x, y in zip([0, *stop[:-1]], stop, strict=True)]


def _overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of numbers of A and B tokens that overlap."""
    import pandas as pd

    one = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(doc_a))}, copy=False)
    two = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(doc_b))}, copy=False)
    cover_b = pd.merge_asof(one, two, on="at", by="doc")  # for each A token
    cover_a = pd.merge_asof(two, one, on="at", by="doc")  # for each B token
    a = cover_a["a"].to_numpy(dtype=np.int64)
    inner = start_a[a] != start_b  # equal starts are in both
    return np.concatenate([one["a"].to_numpy(), a[inner]]), np.concatenate([cover_b["b"].to_numpy(dtype=np.int64), two["b"].to_numpy()[inner]])


@cache
def aligner(opt: Alignment) -> Aligner:
    return Aligner(opt)


def align(docs: DataFrame, opt: Alignment = Alignment(), column: str = "text") -> DataFrame:
    """``docs`` without the text and with the numbers of tokens, groups and links,
    the groups as text (``a1,a2|b1;a3|b2,b3``) and the distinct linked pairs of
    ids with how often each is linked."""
    keep = [c for c in docs.columns if c not in (column, *OUT)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(opt)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for x, y in blocks(texts):
                made = own.align(texts[x:y])
                edge, *parts = made["links"]
                items = pa.StructArray.from_arrays([pa.array(p.astype(np.int32)) for p in parts], names=LINK.names)
                links = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(x, y - x).columns[:len(keep)], *[pa.array(made[c].astype(np.int64)) for c in OUT[:4]],
                     pa.array(made["groups"], pa.string()), links], names=[*keep, *OUT])

    fields = [docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in OUT[:4]]
    return docs.select(*keep, F.col(column)).mapInArrow(
        run, T.StructType([*fields, T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(LINK))]))


def _pair():
    return F.shiftleft(F.col("link.a").cast("long"), 32) + F.col("link.b")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair (the A id times 2**32 plus the B id), n_docs, best (no pair of the A
    id is linked in more documents)."""
    counted = aligned.select(F.explode("links").alias("link")).groupBy(_pair().alias("pair")).agg(F.count("*").alias("n_docs"))
    of_a = Window.partitionBy(F.shiftright("pair", 32))  # at most as many rows as B has ids
    return counted.withColumn("best", F.col("n_docs") == F.max("n_docs").over(of_a))


def scores(aligned: DataFrame, key: str, scratch: Scratch, opt: Alignment = Alignment()) -> DataFrame:
    """Per ``key`` of a kept table of ``align``: n_best, links whose pair is the
    best of its A id, and count_sum, the counts of the pairs of all links."""
    counts = scratch.keep(pair_counts(aligned))
    frequent = F.broadcast(most_frequent(counts, "n_docs", opt.frequent))
    links = aligned.select(key, F.explode("links").alias("link")).select(key, _pair().alias("pair"), F.col("link.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum")]
    common = links.join(frequent, "pair").groupBy(key).agg(*sums)
    others = links.join(frequent, "pair", "left_anti").join(counts, "pair").groupBy(key).agg(*sums)
    return common.unionByName(others).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digests(docs: DataFrame, opt: Alignment = Alignment()) -> DataFrame:
    """Per document the counts, the check sum of the groups and the scores."""
    scratch = Scratch(docs.sparkSession, "alignment")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = align(numbered, opt)
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    kept = scratch.keep(made.select("row", "doc_id", *OUT[:4], groups, "links"))
    return kept.drop("links").join(scores(kept, "row", scratch, opt), "row", "left").select(
        "doc_id", *OUT[:4], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
