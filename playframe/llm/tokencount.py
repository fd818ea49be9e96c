"""Token counts by a count-only Viterbi pass.

The tokenizer is a unigram model over the pieces and scores of a public
vocabulary file, cut at spaces (each word begins with the mark U+2581), with
byte fallback. An Aho-Corasick automaton lists the pieces that end at each
character; per end only the best score and the number of pieces on its path are
kept. Of equal scores the piece that begins first wins, as in the tokenizer. A
character that is no piece costs the lowest score less 10 and counts its UTF-8
bytes. Words are counted once and looked up again; the table is bounded.

Defined results: a null or empty text has 0 tokens; repeated rows are counted
each; other columns pass through, one named n_tokens is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizer


@dataclass(frozen=True)
class Unigram:
    vocabulary: str = ""  # path of a piece model; empty: piece_bpe_32k.model
    most_words: int = 500_000


def vocabulary(opt: Unigram) -> list[tuple[str, float]]:
    """Pieces with their scores, in the order of their ids."""
    import sentencepiece

    path = opt.vocabulary
    if not path:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    def __init__(self, opt: Unigram):
        import ahocorasick

        pieces = vocabulary(opt)
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.most, self.known = opt.most_words, {}

    def word(self, word: str) -> int:
        """Pieces of the best path over one word, mark included."""
        ends: list[list[tuple[int, float]]] = [[] for _ in word]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        scores, counts = [0.0], [0]
        for end, char in enumerate(word):
            best, best_size, n = None, 0, 0
            for size, score in ends[end]:
                total = scores[end + 1 - size] + score
                if best is None or total > best or (total == best and size > best_size):
                    best, best_size, n = total, size, counts[end + 1 - size] + 1
            if char not in self.single:
                total = scores[end] + self.unknown
                if best is None or total > best:
                    best, n = total, counts[end] + len(char.encode("utf-8", "surrogatepass"))
            scores.append(best)
            counts.append(n)
        return counts[-1]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(" ", MARK).split(MARK)
        if words[0] == "":
            del words[0]
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(MARK + w)
        return sum(map(known.__getitem__, words))


_counters: dict[Unigram, Counter] = {}


def counter(opt: Unigram) -> Counter:
    if opt not in _counters:
        _counters[opt] = Counter(opt)
    return _counters[opt]


def count_tokens(docs: DataFrame, opt: Unigram = Unigram(), column: str = "text") -> DataFrame:
    """``docs`` without the text and with n_tokens."""
    keep = [c for c in docs.columns if c not in (column, "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(opt)
        for batch in batches:
            n = [own.text(t.as_py()) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    fields = [docs.schema[c] for c in keep]
    return docs.select(*keep, F.col(column)).mapInArrow(count, T.StructType([*fields, T.StructField("n_tokens", T.LongType())]))
