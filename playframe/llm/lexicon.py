"""Byte-level BPE with a transducer of frequent words.

The words of all texts are counted; the most frequent ones, with the ids that the
merges give them, are compiled into a minimal acyclic automaton: words share their
suffixes as well as their prefixes. An arc carries how many words of the lexicon
come before those that take it, so the outputs on a word's path add up to its
number, and a table holds the ids of each number. The automaton is one file under
the shared folder; Spark hands it to the executors (``addFile``), and their
workers map it into memory, so those of one machine share the pages.

The distinct words of a block of texts walk the automaton together, a byte at a
time. A word outside it is merged by rank, so the lexicon never changes a result.

Defined results: a null or empty text has no ids; the string of a special token
becomes its id and is decoded to the same string; a very long text or word is
encoded whole (words over ``longest_word`` bytes stay out of the lexicon); of
words about equally frequent all or none enter the lexicon; repeated
rows are encoded each; an empty table gives an empty lexicon and no rows; other
columns pass through, one named ids is replaced. ``decode`` gives bytes that are
no UTF-8 as U+FFFD; a null ids column decodes to an empty text.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from playframe.llm.bytebpe import ByteBpe, loaded, public_path
from playframe.llm.common import Scratch, most_frequent, shared_root
from playframe.llm.wordhash import blocks


@dataclass(frozen=True)
class Bpe:
    tokenizer: str = ""         # path of a tokenizer file; empty: byte_bpe_50k.json
    words: int = 1 << 17        # most words of the lexicon; all others are merged
    longest_word: int = 64      # bytes of a word of the lexicon
    held_chunks: int = 200_000  # distinct chunks a task counts before it passes their words on

    @property
    def path(self) -> str:
        return self.tokenizer or public_path("byte_bpe_50k.json")


# The automaton

def minimal(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal automaton of distinct words in byte order: per arc ``key``
    (256 * state + byte, ascending), ``target`` and ``output``; per state
    ``final``. State 0 is the start."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []     # of finished states
    final_of: list[bool] = []
    count_of: list[int] = []
    path: list[tuple[bool, list]] = [(False, [])]

    def finish(depth: int) -> None:
        """Replace the open states below ``depth`` by equal finished ones."""
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, *arcs)
            if key not in register:
                register[key] = len(arcs_of)
                arcs_of.append(tuple(arcs))
                final_of.append(final)
                count_of.append(final + sum(count_of[t] for _, t in arcs))
            last, _ = path[-1][1][-1]
            path[-1][1][-1] = (last, register[key])

    before = b""
    for word in words:
        same = 0
        for a, b in zip(before, word):
            if a != b:
                break
            same += 1
        finish(same)
        for b in word[same:]:
            path[-1][1].append((b, -1))
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        before = word
    finish(0)
    start = path[0]
    states = [*zip(arcs_of, final_of), (tuple(start[1]), start[0])][::-1]  # the start becomes 0
    n = len(states)
    key, target, output = [], [], []
    for s, (arcs, final) in enumerate(states):
        passed = int(final)
        for b, t in arcs:
            key.append(256 * s + b)
            target.append(n - 1 - t)
            output.append(passed)
            passed += count_of[t]
    # a finished state t of n - 1 stands at n - 1 - t
    return {"key": np.array(key, dtype=np.int64), "target": np.array(target, dtype=np.int32),
            "output": np.array(output, dtype=np.int32), "final": np.array([f for _, f in states], dtype=np.uint8)}


_PARTS = (("key", np.int64), ("target", np.int32), ("output", np.int32), ("first", np.int32), ("ids", np.int32), ("final", np.uint8))


def packed(words: dict[bytes, list[int]]) -> bytes:
    """The lexicon as one file: sizes, then the arrays."""
    order = sorted(words)
    made = minimal(order)
    ids = [words[w] for w in order]
    made["first"] = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
    made["ids"] = np.array([i for x in ids for i in x])
    arrays = [made[k].astype(d) for k, d in _PARTS]
    return b"".join([np.array([len(a) for a in arrays], dtype=np.int64).tobytes(), *[a.tobytes() for a in arrays]])


class Lexicon:
    """A packed lexicon, mapped into memory; without a path one of no words."""

    def __init__(self, path: str | None = None):
        if path is None:
            for name, kind in _PARTS:
                setattr(self, name, np.zeros(int(name == "final"), dtype=kind))
            return
        size, at = np.fromfile(path, dtype=np.int64, count=len(_PARTS)).tolist(), 8 * len(_PARTS)
        for (name, kind), n in zip(_PARTS, size, strict=True):
            part = np.memmap(path, dtype=kind, mode="r", offset=at, shape=(n,)) if n else np.empty(0, dtype=kind)
            setattr(self, name, part)
            at += n * np.dtype(kind).itemsize

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word in the lexicon, -1 for others."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        start = np.concatenate(([0], np.cumsum(size)[:-1])) if len(words) else size
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, number = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        left, at = np.arange(len(words)), 0
        while True:
            left = left[size[left] > at]
            if not len(left):
                break
            if not len(self.key):
                state[left] = -1
                break
            key = 256 * state[left] + flat[start[left] + at]
            arc = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            on = self.key[arc] == key
            state[left[~on]] = -1
            left, arc = left[on], arc[on]
            state[left] = self.target[arc]
            number[left] += self.output[arc]
            at += 1
        return np.where((state >= 0) & (self.final[state] > 0), number, -1)


_mapped: dict[str, Lexicon] = {}


def mapped(name: str) -> Lexicon:
    """The lexicon of a file that Spark handed out."""
    if name not in _mapped:
        _mapped[name] = Lexicon(SparkFiles.get(name))
    return _mapped[name]


# The jobs

def word_counts(docs: DataFrame, opt: Bpe = Bpe(), column: str = "text") -> DataFrame:
    """word (bytes) and n, how often it occurs in all texts."""
    path, longest, most = opt.path, opt.longest_word, opt.held_chunks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = loaded(path), Counter()

        def passed_on() -> pa.RecordBatch:
            kinds, words, size = own.words(held)
            code = {w: k for k, w in enumerate(dict.fromkeys(words))}
            n = np.zeros(len(code), dtype=np.int64)
            np.add.at(n, np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words)),
                      np.repeat(np.fromiter(map(held.__getitem__, kinds), dtype=np.int64, count=len(kinds)), size))
            held.clear()
            raw = [w.encode("utf-8") for w in code]
            short = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) <= longest
            return pa.RecordBatch.from_arrays([pa.array(raw, pa.binary()), pa.array(n)], names=["word", "n"]).filter(pa.array(short))

        for batch in batches:
            for text in batch.column(0):
                for k, part in enumerate(own.parts(text.as_py() or "")):
                    if k % 2 == 0:
                        held.update(own.chunks(part))
                if len(held) > most:
                    yield passed_on()
        yield passed_on()

    return docs.select(column).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, opt: Bpe = Bpe(), column: str = "text") -> str:
    """Count, compile and hand out the lexicon of ``docs``; the name of its file.
    The driver sees at most ``opt.words`` words."""
    spark, own = docs.sparkSession, loaded(opt.path)
    scratch = Scratch(spark, "lexicon")
    counts = scratch.keep(word_counts(docs, opt, column))
    words = most_frequent(counts, "n", opt.words).select("word").toArrow().column("word").to_pylist()
    scratch.drop(counts)
    return hand_out(spark, packed({w: own.merge(w.decode("utf-8")) for w in words}))


def hand_out(spark: SparkSession, content: bytes) -> str:
    """Write a file under the shared folder and give it to all executors."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(target)
    out.write(bytearray(content))
    out.close()
    spark.sparkContext.addFile(system.makeQualified(target).toString())
    return name


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` one after the other, and where each begins (one more at the end)."""
    edge = np.concatenate(([0], np.cumsum(count)))
    return flat[np.arange(int(edge[-1])) + np.repeat(first - edge[:-1], count)], edge


class Encoder:
    """Ids of blocks of texts: words in the lexicon by the automaton, others merged."""

    MOST = 300_000  # merged words kept for the next blocks

    def __init__(self, own: ByteBpe, lexicon: Lexicon, specials: bool = True):
        """Without ``specials`` their strings are plain text."""
        self.own, self.lexicon, self.merged = own, lexicon, {}
        self.parts = own.parts if specials else lambda text: [text]

    def _merged(self, word: str) -> bytes:
        ids = self.merged.get(word)
        if ids is None:
            ids = np.array(self.own.merge(word), dtype=np.int32).tobytes()
            if len(self.merged) > self.MOST:
                self.merged.clear()
            if len(word) <= 256:
                self.merged[word] = ids
        return ids

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of ids, and where in it each word has its own."""
        lexicon = self.lexicon
        number = lexicon.numbers([w.encode("utf-8") for w in words])
        known = number >= 0
        first, count = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        first[known] = lexicon.first[number[known]]
        count[known] = lexicon.first[number[known] + 1] - first[known]
        unseen = np.flatnonzero(~known)
        made = [self._merged(words[k]) for k in unseen.tolist()]
        size = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        first[unseen], count[unseen] = len(lexicon.ids) + np.cumsum(size) - size, size
        return np.concatenate([lexicon.ids, np.frombuffer(b"".join(made), dtype=np.int32)]), first, count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        own, chunks, size, special = self.own, [], [], {}
        for text in texts:
            before = len(chunks)
            for k, part in enumerate(self.parts(text)):
                if k % 2:
                    special[len(chunks)] = own.specials[part]
                    chunks.append(" ")
                else:
                    chunks += own.chunks(part)
            size.append(len(chunks) - before)
        kinds, words, n = own.words(dict.fromkeys(chunks))
        word_of = {w: k for k, w in enumerate(dict.fromkeys(words))}
        table, first, count = self._words(list(word_of))
        codes = np.fromiter(map(word_of.__getitem__, words), dtype=np.int64, count=len(words))
        flat, edge = gather(table, first[codes], count[codes])
        edge = edge[np.concatenate(([0], np.cumsum(n)))]  # now of the chunks
        kind_of = dict(zip(kinds, range(len(kinds)), strict=True))
        codes = np.fromiter(map(kind_of.__getitem__, chunks), dtype=np.int64, count=len(chunks))
        first, count = edge[codes], edge[codes + 1] - edge[codes]
        if special:
            at = np.fromiter(special, dtype=np.int64)
            first[at], count[at] = len(flat) + np.arange(len(at)), 1
            flat = np.concatenate([flat, np.fromiter(special.values(), dtype=np.int32)])
        out, edge = gather(flat, first, count)
        edge = edge[np.concatenate(([0], np.cumsum(size, dtype=np.int64)))].tolist()
        return [out[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def encode(docs: DataFrame, lexicon: str, opt: Bpe = Bpe(), column: str = "text") -> DataFrame:
    """``docs`` without the text and with ids, little-endian unsigned 32-bit
    integers; ``lexicon`` is the name that ``compile_lexicon`` gave."""
    keep, path = [c for c in docs.columns if c not in (column, "ids")], opt.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(loaded(path), mapped(lexicon))
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            for a, b in blocks(texts):
                made = [i.astype("<u4").tobytes() for i in own.encode(texts[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(made, pa.binary())], names=[*keep, "ids"])

    fields = [docs.schema[c] for c in keep]
    return docs.select(*keep, F.col(column)).mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.BinaryType())]))


def decode(rows: DataFrame, opt: Bpe = Bpe(), column: str = "text") -> DataFrame:
    """``rows`` with the text of their ids; a column of its name is replaced."""
    keep, path = [c for c in rows.columns if c != column], opt.path
    at = keep.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = loaded(path).bytes.__getitem__
        for batch in batches:
            texts = [b"".join(map(piece, np.frombuffer(i.as_py() or b"", dtype="<u4").tolist())).decode("utf-8", "replace") for i in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, column])

    fields = [rows.schema[c] for c in keep]
    return rows.select(*keep).mapInArrow(run, T.StructType([*fields, T.StructField(column, T.StringType())]))


def digests(docs: DataFrame, opt: Bpe = Bpe()) -> DataFrame:
    """doc_id, number of ids, check sums of the ids and of the text they give."""
    out = decode(encode(docs.select("doc_id", "text"), compile_lexicon(docs, opt), opt), opt)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))
