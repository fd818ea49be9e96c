"""Best-two-fit packing of token sequences.

Documents are tokenized once; only those longer than a sequence are cut. The
plan is made from how many pieces have each length, a table of at most ``size``
rows whatever the corpus: a bin takes the longest piece left and then, again and
again, the longest that fits; then its smallest piece gives way to two unpacked
pieces that fill the widened gap better, if there are two. A plan found once is
used as often as the counts allow: then of one length fewer pieces are left than
the bin takes of it. So a length takes part in that at most 1 + size / length
times, and there are at most size x (2 + ln size) plans whatever the corpus.

Pieces find their place by rank among those of their length: counted per
(hash slice, length), summed over the slices, then numbered inside each slice.

Defined results: a null or empty text is one piece of the end mark alone;
repeated rows are packed each; ties in rank are broken by doc_id, piece and
content, and equal pieces may take each other's place; an empty table gives no
pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from playframe.llm.common import Scratch, batch_of, text_of

_loaded: dict[str, Tokens] = {}


@dataclass(frozen=True)
class Packing:
    tokenizer: str = ""      # path of a tokenizer file; empty: word_bpe_49k.json
    size: int = 4096
    end_id: int = 1
    slices: int = 0          # hash slices that are numbered apart; 0: shuffle partitions


def tokenizer_path(opt: Packing) -> str:
    if opt.tokenizer:
        return opt.tokenizer
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Tokens:
    """Ids of whole texts. The tokenizer lower-cases, cuts a text into runs of
    letters, single digits and runs of marks, drops white space, and merges inside
    a run only. A text of ASCII and Latin-1 letters is cut here by the same
    expression and its runs are looked up; any other text, or one with a special
    token, goes through the whole tokenizer. The table begins anew when full."""

    MOST = 500_000
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ \n\t\r]*")
    # fixed value: the tokenizer's own expression on such text
    RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = "".join(chr(c) for c in (*range(33, 127), *range(0xDF, 0x100)))
        cut = self.tokenizer.pre_tokenizer
        self.bytes = {ord(c): "".join(p for p, _ in cut.pre_tokenize_str(c)) for c in plain}
        self.runs: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a text."""
        if not self.PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        runs = self.RUN.findall(text.lower())
        if len(self.runs) > self.MOST:
            self.runs = {}
        for run in set(runs).difference(self.runs):
            self.runs[run] = np.array([t.id for t in self.model.tokenize(run.translate(self.bytes))], dtype="<u4").tobytes()
        return b"".join(map(self.runs.__getitem__, runs))


def tokens(path: str) -> Tokens:
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def pieces(docs: DataFrame, opt: Packing) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    path, size, end = tokenizer_path(opt), opt.size, np.array([opt.end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        for batch in batches:
            at, starts, lengths, sums = [], [], [], []
            for k, text in enumerate(batch.column(1)):
                raw = own.ids(text.as_py()) + end
                for s in range(0, len(raw), 4 * size):
                    part = raw[s:s + 4 * size]
                    at.append(k)
                    starts.append(s // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            starts = np.array(starts, dtype=np.int64)
            yield batch_of(doc_id=batch.column(0).take(pa.array(at, pa.int64())), piece=(starts // size).astype(np.int32), start=starts,
                           length=np.array(lengths, dtype=np.int64), ids_crc32=np.array(sums, dtype=np.int64))

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(uses, lengths) of each bin plan for so many pieces of each length."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    out = []
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        own: dict[int, int] = {}
        bin_, gap = [], size

        def longest(most: int) -> int:
            """The longest length of at most ``most`` with a piece left, or 0."""
            k = np.searchsorted(some, most, side="right") - 1
            while k >= 0 and left[some[k]] <= own.get(int(some[k]), 0):
                k -= 1
            return int(some[k]) if k >= 0 else 0

        while length := longest(gap):
            # take as many of one length as fit at once
            n = min(gap // length, int(left[length]) - own.get(length, 0))
            own[length] = own.get(length, 0) + n
            bin_ += [length] * n
            gap -= length * n
        smallest = bin_[-1]
        room = gap + smallest
        if gap and room > 1:
            best, pair = smallest, None
            own[smallest] -= 1
            spare = left[some]
            for x, n in own.items():
                spare[np.searchsorted(some, x)] -= n
            free = some[(spare > 0) & (some < room)]
            if len(free):
                # partner of each: the longest that fits beside it; a length alone needs two of itself
                at = np.searchsorted(free, room - free, side="right") - 1
                for k in np.argsort(-(free + free[np.maximum(at, 0)]) * (at >= 0), kind="stable")[:4]:
                    a, j = int(free[k]), int(at[k])
                    if j >= 0 and int(free[j]) == a and left[a] - own.get(a, 0) < 2:
                        j -= 1
                    if j >= 0 and a + int(free[j]) > best:
                        best, pair = a + int(free[j]), (a, int(free[j]))
            if pair:
                bin_.pop()
            else:
                pair = (smallest,)
            for x in pair:
                own[x] = own.get(x, 0) + 1
            bin_ += pair if len(pair) == 2 else ()
        uses = min(int(left[x]) // n for x, n in own.items() if n)
        for x, n in own.items():
            left[x] -= n * uses
        out.append((uses, sorted(bin_, reverse=True)))


def slots(plans: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, places per bin, first sequence, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for uses, lengths in plans:
        offset, k = 0, 0
        while k < len(lengths):
            length, n = lengths[k], lengths.count(lengths[k])
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * uses
            offset += n * length
            k += n
        sequence += uses
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def pack(docs: DataFrame, opt: Packing = Packing()) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    slices = opt.slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slice_ = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slices)).cast("int")
    cut = scratch.keep(pieces(docs, opt).withColumn("slice", slice_))
    counted = scratch.keep(cut.groupBy("length", "slice").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(counts, opt.size))
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n"))
    within = Window.partitionBy("slice", "length").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = cut.withColumn("rank", F.row_number().over(within) - 1).join(before.select("slice", "length", "before"), ["slice", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                own = int(length[part[0]])
                rows = table[own]
                row = rows[np.searchsorted(rows[:, 0], rank[part], side="right") - 1]
                use, spot = np.divmod(rank[part] - row[:, 0], row[:, 1])
                sequence[part], offset[part] = row[:, 2] + use, row[:, 3] + spot * own
            keep = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
