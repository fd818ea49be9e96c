"""Periodic runs of words, found by string synchronising sets.

A run is a stretch of words with smallest period q, at least twice as long as q,
that no neighbouring word extends. The words of a block of texts become codes,
and stretches of 2**k words get exact names level by level (equal stretches,
equal names), as far as a level has a name that occurs twice.

* Periods below ``SMALL`` are read off by comparing the codes with themselves,
  shifted.
* For a scale t = 4, 8, 16, ... a position is selected if the hashed name of its
  own stretch of t words, or of the one t words on, is the smallest among the
  t + 1 stretches that begin there. Stretches of period <= t / 3 take no part.
  Whether a position is selected depends on the 2t words from it alone, and among
  any t positions one is selected, unless the 3t - 1 words there have a period
  <= t / 3. So of a run with a period q in [3t, 6t) some selected position i and
  i + q have the same context of 2t words: equal contexts 3t to 6t apart propose
  a period each. One context occurs at most every t / 3 words, so there are few.
* What is left are runs whose first and last words, q apart, lie in two
  neighbouring highly periodic regions of one period p <= t / 3 that touch. The
  regions are runs of a lower scale; one shift modulo p brings their words over
  one another, and every q of that class that fits is proposed.
* Each proposal is extended by longest common extensions over the names; of one
  stretch the smallest period stays. Names are compared, never hashes, so the
  result is exact.

Texts without six words that occur twice hold no run of twelve words and are
passed over; others are worked on whole, together in blocks of bounded size.

Defined results: a null or empty text, or one of white space, has no words and
no runs; ties between runs do not arise (a stretch has one smallest period);
repeated rows are worked on each; a very long text stands alone in its block and
takes memory in proportion to its length; an empty table gives no rows; other
columns pass through, those named n_words, runs or collapsed are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from playframe.llm.common import batch_of
from playframe.llm.wordhash import U, blocks, mix

#: periods below it are found by shifting; 3 * the smallest scale
SMALL = 12
RUN = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "length", "period")])


@dataclass(frozen=True)
class Runs:
    least_length: int = 12  # at least 12: texts are passed over by six words that occur twice


class Names:
    """levels[k][i] tells stretches of 2**k codes from one another; the last
    level is the first without a stretch that occurs twice."""

    def __init__(self, codes: np.ndarray):
        self.levels, repeats, half = [codes.astype(np.int64)], True, 1
        while repeats and len(last := self.levels[-1]) > half:
            kinds, name = np.unique(last[:-half] << 32 | last[half:], return_inverse=True)
            self.levels.append(name)
            repeats, half = len(kinds) < len(name), 2 * half
        self.repeating = len(self.levels) - (not repeats)  # levels with a stretch that occurs twice

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from i and from j on are equal, i < j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name = self.levels[k]
            fits = j + done < len(name)
            a, b = np.where(fits, i + done, 0), np.where(fits, j + done, 0)
            done += (fits & (name[a] == name[b])).astype(np.int64) << k
        return done

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes before i and before j are equal, i < j."""
        done = np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name, size = self.levels[k], 1 << k
            fits = i - done >= size
            a, b = np.where(fits, i - done - size, 0), np.where(fits, j - done - size, 0)
            done += (fits & (name[a] == name[b])).astype(np.int64) << k
        return done


def _shifted(codes: np.ndarray, q: int) -> np.ndarray:
    """Rows (start, end, q) of stretches of period ``q``, at least 2q long."""
    same = np.concatenate(([False], codes[:-q] == codes[q:], [False])) if len(codes) > q else np.zeros(2, dtype=bool)
    edge = np.flatnonzero(same[1:] != same[:-1])
    first, last = edge[0::2], edge[1::2]
    long = last - first >= q
    return np.stack([first[long], last[long] + q, np.full(long.sum(), q)], axis=1)


def _distinct(runs: np.ndarray) -> np.ndarray:
    """One row per stretch, that of the smallest period, in order of the starts."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[fresh]


def _extended(names: Names, i: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The stretches of period q around i and i + q, where 2q words long."""
    start, end = i - names.behind(i, i + q), i + q + names.ahead(i, i + q)
    long = end - start >= 2 * q
    return np.stack([start[long], end[long], q[long]], axis=1)


def synchronising(name: np.ndarray, periodic: np.ndarray, t: int) -> np.ndarray:
    """Selected positions; ``name`` tells stretches of t codes apart and
    ``periodic`` marks those that take no part."""
    void = np.iinfo(np.uint64).max
    rank = np.where(periodic, U(void), mix(name.astype(U) + U(t)))
    if len(rank) <= t:
        return np.empty(0, dtype=np.int64)
    least, width = rank, 1
    while width < t:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[:-1], rank[t:])
    first, second = rank[:len(least)], rank[t:]
    return np.flatnonzero((least != U(void)) & ((first == least) | (second == least)))


def _of_contexts(names: Names, level: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proposals (position, period) of equal contexts at the scale 2**level."""
    t = 1 << level
    name, context = names.levels[level], names.levels[level + 1]
    edge = np.zeros(len(name) + 1, dtype=np.int64)
    short = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= t)]
    np.add.at(edge, short[:, 0], 1)
    np.add.at(edge, short[:, 1] - t + 1, -1)
    at = synchronising(name, np.cumsum(edge[:-1]) > 0, t)
    at = at[at < len(context)]
    own = context[at]
    order = np.argsort(own, kind="stable")
    at, own = at[order], own[order]
    found_i, found_q, lag = [], [], 1
    while lag < len(at):
        gap = at[lag:] - at[:-lag]
        near = (own[lag:] == own[:-lag]) & (gap < 6 * t)
        if not near.any():
            break
        take = near & (gap >= 3 * t)
        found_i.append(at[:-lag][take])
        found_q.append(gap[take])
        lag += 1
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(found_i or none), np.concatenate(found_q or none)


def _of_regions(codes: np.ndarray, level: int, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proposals from neighbouring regions of one small period that touch."""
    t = 1 << level
    part = runs[(3 * runs[:, 2] <= t) & (runs[:, 1] - runs[:, 0] >= 3 * t)]
    part = part[np.lexsort((part[:, 0], part[:, 2]))]
    a, b = part[:-1], part[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    found_i, found_q = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for (s1, e1, p), (s2, e2, _) in zip(a[touch].tolist(), b[touch].tolist(), strict=True):
        word, room = codes[e1 - p:e1].tobytes(), codes[s2:s2 + 2 * p - 1].tobytes()
        at = room.find(word)
        while at % codes.itemsize and at > 0:
            at = room.find(word, at + 1)
        if at < 0:
            continue
        shift = (s2 + at // codes.itemsize - (e1 - p)) % p
        low, high = max(3 * t, p + 1), min(6 * t - 1, e1 - s1, e2 - s2, (e2 - s1) // 2)
        q = np.arange(low + (shift - low) % p, high + 1, p, dtype=np.int64)
        found_i.append(np.maximum(s1, s2 - q))
        found_q.append(q)
    return np.concatenate(found_i), np.concatenate(found_q)


def all_runs(codes: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of every run of the codes, by start and end.
    Codes below 2**31; a code that occurs once keeps texts apart."""
    codes = np.ascontiguousarray(codes, dtype=np.int64)
    runs = _distinct(np.concatenate([_shifted(codes, q) for q in range(1, SMALL)]))
    names, level = Names(codes), 2
    while level + 1 < names.repeating:
        for i, q in (_of_contexts(names, level, runs), _of_regions(codes, level, runs)):
            if len(i):
                runs = _distinct(np.concatenate([runs, _extended(names, i, q)]))
        level += 1
    return runs


def _six_twice(codes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Marks the texts of which six words in a row may occur twice (equal hashes)."""
    found = np.zeros(n, dtype=bool)
    if len(codes) < 7:
        return found
    key = codes.astype(U)
    acc = mix(doc.astype(U) + U(1))[: len(codes) - 5]
    for j in range(6):
        acc = mix(acc + key[j:len(codes) - 5 + j] * U(2) + U(1))
    whole = doc[:-5] == doc[5:]
    acc, doc = acc[whole], doc[:-5][whole]
    order = np.sort(acc)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, acc), len(twice) - 1)
        found[doc[twice[at] == acc]] = True
    return found


def runs_of(texts: list[str | None], opt: Runs = Runs()) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Per text the number of words, the runs as rows (start, length, period) by
    start and period, and the words that stay, joined by one space."""
    texts = [t or "" for t in texts]
    for low, high in blocks(texts):
        words = [t.encode("utf-8").split() for t in texts[low:high]]
        size = np.array([len(w) for w in words], dtype=np.int64)
        code: dict[bytes, int] = {}
        for w in words:
            code.update(dict.fromkeys(w))
        code = dict(zip(code, range(len(code)), strict=True))
        codes = np.fromiter((c for w in words for c in map(code.__getitem__, w)), dtype=np.int64, count=int(size.sum()))
        hit = _six_twice(codes, np.repeat(np.arange(len(words)), size), len(words))
        first = np.concatenate(([0], np.cumsum(size)))
        picked = np.flatnonzero(hit)
        parts = []
        for n, k in enumerate(picked.tolist()):
            parts += [codes[first[k]:first[k + 1]], [len(code) + n]]
        if len(picked):
            found = all_runs(np.concatenate(parts))
            found = found[found[:, 1] - found[:, 0] >= opt.least_length]
            begin = np.concatenate(([0], np.cumsum(size[picked] + 1)))
            owner = np.searchsorted(begin, found[:, 0], side="right") - 1
            edge = np.zeros(begin[-1] + 1, dtype=np.int64)
            np.add.at(edge, found[:, 0] + found[:, 2], 1)
            np.add.at(edge, found[:, 1], -1)
            dropped = np.cumsum(edge) > 0
            rows = np.stack([found[:, 0] - begin[owner], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
            rows = rows[np.lexsort((rows[:, 2], rows[:, 0], owner))]
            cut = np.searchsorted(owner, np.arange(len(picked) + 1))  # owners ascend with the starts
        at = {k: n for n, k in enumerate(picked.tolist())}
        for k, w in enumerate(words):
            own = np.empty((0, 3), dtype=np.int64)
            if k in at:
                n = at[k]
                own = rows[cut[n]:cut[n + 1]]
                if len(own):
                    gone = dropped[begin[n]:begin[n] + len(w)].tolist()
                    yield len(w), own, b" ".join([x for x, g in zip(w, gone, strict=True) if not g])
                    continue
            yield len(w), own, b" ".join(w)


def find_runs(docs: DataFrame, opt: Runs = Runs(), column: str = "text") -> DataFrame:
    """``docs`` without the text and with n_words, runs (array of start, length,
    period) and collapsed, the text without the repeats of its runs."""
    if opt.least_length < 12:
        raise ValueError("least_length must be 12 or more")
    keep = [c for c in docs.columns if c not in (column, "n_words", "runs", "collapsed")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, rows, texts = [], [], []
            for n, own, text in runs_of(batch.column(len(keep)).to_pylist(), opt):
                n_words.append(n)
                rows.append(own)
                texts.append(text)
            flat = np.concatenate([np.empty((0, 3), dtype=np.int64), *rows])
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=RUN.names)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items),
                 pa.array(texts, pa.binary()).cast(pa.string())], names=[*keep, "n_words", "runs", "collapsed"])

    fields = [docs.schema[c] for c in keep]
    out = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(*keep, F.col(column)).mapInArrow(find, out)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a tenth of the texts, by the check sum of the id, made
    periodic from some word on; a null id leaves its text as it is."""
    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k, key in enumerate(batch.column(0).to_pylist()):
                h = 1 if key is None else zlib.crc32(str(key).encode())
                if h % 10 == 0 and (words := (texts[k] or "").encode("utf-8").split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    whole = words[a:a + p] * ((n - a) // p + 1)
                    texts[k] = b" ".join([*words[:a], *whole[:n - a]]).decode("utf-8")
            yield batch_of(doc_id=batch.column(0), text=pa.array(texts, pa.string()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(change, "doc_id long, text string")


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and check sums of what ``find_runs`` gives."""
    runs = F.col("runs")
    best = F.array_max(F.transform(runs, lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    top = found.select("doc_id", F.size(runs).cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return top.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
