"""Benchmark decontamination: rare n-gram seeds, then local alignment.

A test item's seeds are its three-word runs (letters and digits, lower case)
that are rare: whose words, drawn one by one at their rates in the test items,
would come together less than once in ``1 / rarity`` places; an item with fewer
than ``least_seeds`` of them takes its rarest ones up to that number. The rarest
of any ``stretch`` runs that follow each other is a seed too, however common, so
five words of an item in a row always hold one, whatever the size or skew of
the benchmark. Rarity is a matter of the test items alone, so that a leak copied
many times cannot make its own seeds common, and rates count items of equal
words once, so that an item given many times cannot either. Every place of a document that has a seed is aligned with
the item: the words around the diagonal of the seed, by Smith-Waterman (match 2,
mismatch and gap -1). An item is in a document where the best score reaches
``threshold`` of that of an exact copy, so edited, shortened and reordered
copies count by what is left of them. No place and no item is capped.

Test items are taken in blocks of bounded text (``block_chars``); one block's
seeds go to all tasks, and the documents are read once per block. Word rates are
those of all items, so blocks change no result.

Defined results: a null or empty text has no leaks; an item without words is in
no document; items of fewer than three words have one seed, all their words;
equal items are reported each; repeated documents are reported once per id;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playframe.llm.common import Scratch, batch_of, text_of

WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Leaks:
    n: int = 3
    rarity: float = 1e-8
    least_seeds: int = 8
    stretch: int = 3         # runs in a row that hold a seed
    threshold: float = 0.5
    slack: int = 8           # words of the document beyond the item's ends
    block_chars: int = 4 << 20
    cells: int = 1 << 21     # cells of one batch of alignments


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Block:
    """Seeds and word ids of some test items."""

    def __init__(self, items: list[tuple[int, str]], opt: Leaks, counted: dict[str, int] | None = None, total: int | None = None):
        """``counted`` and ``total``: the words of all test items, equal ones
        counted once, where these are a part of them."""
        self.opt = opt
        texts = [words_of(t) for _, t in items]
        self.ids = np.array([i for (i, _), w in zip(items, texts, strict=True) if w], dtype=np.int64)
        texts = [w for w in texts if w]
        counts = counted or Counter(w for t in set(map(tuple, texts)) for w in t)
        self.vocabulary = {w: i for i, w in enumerate(counts, 1)}
        self.items = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for t in texts]
        total = total or sum(counts.values())
        rate = np.ones(len(counts) + 1)
        for w, i in self.vocabulary.items():
            rate[i] = counts[w] / total
        self.base = len(counts) + 1
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for j, t in enumerate(self.items):
            n = min(opt.n, len(t))
            chance = np.array([np.log(rate[t[i:i + n]]).sum() for i in range(len(t) - n + 1)])
            order = np.argsort(chance, kind="stable")
            seed = chance < np.log(opt.rarity)
            seed[order[:opt.least_seeds]] = True
            for i in range(max(1, len(chance) - opt.stretch + 1)):
                seed[i + np.argmin(chance[i:i + opt.stretch])] = True
            for i in order[seed[order]]:
                found[self.key(t[i:i + n])].append((j, int(i)))
        self.keys = np.array(sorted(found), dtype=np.uint64)
        self.places = [found[int(k)] for k in self.keys]
        self.sizes = sorted({min(opt.n, len(t)) for t in self.items})

    def key(self, run: np.ndarray) -> int:
        k = len(run)
        for x in run:
            k = (k * self.base + int(x)) & 0xFFFFFFFFFFFFFFFF
        return k

    def windows(self, text: str) -> list[tuple[int, int, int, np.ndarray]]:
        """(item, first word, end word, word ids) of the places to align."""
        ids = np.fromiter(map(self._id, words_of(text)), dtype=np.int64)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n in self.sizes:
            if len(ids) < n:
                continue
            known = np.ones(len(ids) - n + 1, dtype=bool)
            for i in range(n):
                known &= ids[i:len(ids) - n + 1 + i] > 0
            at = np.flatnonzero(known)
            key = np.full(len(at), n, dtype=np.uint64)
            for i in range(n):
                key = key * np.uint64(self.base) + ids[at + i].astype(np.uint64)
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[slot] == key
            for p, s in zip(at[hit], slot[hit], strict=True):
                for j, i in self.places[s]:
                    start = p - i - self.opt.slack
                    spans[j].append((max(0, start), min(len(ids), p - i + len(self.items[j]) + self.opt.slack)))
        out = []
        for j, found in spans.items():
            found.sort()
            a, b = found[0]
            for x, y in found[1:]:
                if x <= b:
                    b = max(b, y)
                else:
                    out.append((j, a, b, ids[a:b]))
                    a, b = x, y
            out.append((j, a, b, ids[a:b]))
        return out

    def _id(self, word: str) -> int:
        return self.vocabulary.get(word, 0)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each item with its window. One row of all
    the tables at a time; gaps along a row are a running maximum."""
    wide, high = max(map(len, windows)), max(map(len, items))
    text = np.zeros((len(items), wide), dtype=np.int32)
    query = np.full((len(items), high), -1, dtype=np.int32)
    for k, (q, w) in enumerate(zip(items, windows, strict=True)):
        query[k, : len(q)], text[k, : len(w)] = q, w
    ramp = np.arange(wide, dtype=np.int32)
    row = np.zeros((len(items), wide + 1), dtype=np.int32)
    best = np.zeros(len(items), dtype=np.int32)
    for i in range(high):
        step = np.where(text == query[:, i:i + 1], 2, -1)
        cell = np.maximum(np.maximum(row[:, :-1] + step, row[:, 1:] - 1), 0)
        cell = np.maximum(cell, np.maximum.accumulate(cell + ramp, axis=1) - ramp)
        row[:, 1:] = cell
        best = np.maximum(best, np.where(query[:, i] >= 0, cell.max(axis=1), 0))
    return best


def _scan(block: Block):
    opt = block.opt

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs: list[int] = []
            places: list[tuple[int, int, int, np.ndarray]] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = block.windows(text)
                places += found
                docs += [k] * len(found)
            if not places:
                continue
            order = sorted(range(len(places)), key=lambda k: (len(places[k][3]), len(block.items[places[k][0]])))
            scores = np.zeros(len(places), dtype=np.int64)
            at = 0
            while at < len(order):
                end = at + 1
                while end < len(order) and (end - at + 1) * (len(places[order[end]][3]) + 1) <= opt.cells:
                    end += 1
                part = order[at:end]
                scores[part] = align([block.items[places[k][0]] for k in part], [places[k][3] for k in part])
                at = end
            size = np.array([2 * len(block.items[p[0]]) for p in places])
            good = np.flatnonzero(scores >= opt.threshold * size)
            yield batch_of(
                doc_id=batch.column(0).take(pa.array([docs[k] for k in good], pa.int64())),
                item_id=pa.array([int(block.ids[places[k][0]]) for k in good], pa.int64()),
                score=pa.array(scores[good] / size[good], pa.float64()),
                first_word=pa.array([int(places[k][1]) for k in good], pa.int64()),
                end_word=pa.array([int(places[k][2]) for k in good], pa.int64()))

    return scan


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch_of(text=pa.array([" ".join(words_of(t)) for t in batch.column(0).to_pylist()], pa.string()))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(w for t in batch.column(0).to_pylist() for w in words_of(t))
        yield batch_of(word=pa.array(list(counts), pa.string()), n=pa.array(list(counts.values()), pa.int64()))


def find_leaks(docs: DataFrame, benchmark: DataFrame, opt: Leaks = Leaks()) -> DataFrame:
    """doc_id, item_id, score (share of an exact copy's score) and the words
    aligned (first_word, end_word): the best place per document and item."""
    items = benchmark.select(F.col("item_id").cast("long"), text_of().alias("text"))
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n_blocks = -(-chars // opt.block_chars) or 1
    plain = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    found, counts, total = None, None, None
    if n_blocks > 1:
        counts = Scratch(docs.sparkSession, "leaks").keep(
            items.select("text").mapInArrow(_spelled, "text string").distinct()
            .mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
        total = counts.agg(F.sum("n")).first()[0]
    for k in range(n_blocks):
        own = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        own, part = own.distinct(), None
        if counts is not None:
            mine = own.select("text").mapInArrow(_words, "word string, n long").select("word").distinct()
            part = {r["word"]: r["n"] for r in counts.join(mine, "word").collect()}
        block = Block([(r["item_id"] if r["item_id"] is not None else -1, r["text"]) for r in own.collect()], opt, part, total)
        if not len(block.ids):
            continue
        part = plain.mapInArrow(_scan(block), "doc_id long, item_id long, score double, first_word long, end_word long")
        found = part if found is None else found.union(part)
    if found is None:
        return plain.select("doc_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("first_word"),
                            F.lit(0).cast("long").alias("end_word")).limit(0)
    best = F.max(F.struct("score", (-F.col("first_word")).alias("before"), "end_word"))
    return found.groupBy("doc_id", "item_id").agg(best.alias("m")).select(
        "doc_id", "item_id", F.col("m.score").alias("score"), (-F.col("m.before")).alias("first_word"), F.col("m.end_word").alias("end_word"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, opt: Leaks = Leaks()) -> DataFrame:
    """The documents that hold no test item, with their own columns. A null id
    cannot be told apart from another, so if one leaks all rows with it go."""
    leaked = find_leaks(docs, benchmark, opt).select(F.col("doc_id").alias("leak__id")).distinct()
    return docs.join(leaked, F.col("doc_id").cast("long").eqNullSafe(F.col("leak__id")), "left_anti")
