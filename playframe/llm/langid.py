"""Language identification by nearest centroid.

A text is the vector of its letter 1- to 3-grams (lower case, a run of anything
else is one gap), hashed into ``cells`` and weighted by count times log(N / df).
Each language has several centroids, found by spherical k-means over the
normalised vectors of its training texts. A text gets the language of the
centroid with the largest cosine; it is rejected where the cosine is below what
nearly all training texts of that centroid reach.

Document frequencies are counted over all training texts, the centroids of each
language are fitted on at most ``per_language`` of its texts, drawn by hash;
prediction and the fit read whole texts.

Defined results: a null text or one without letters gets ``und`` and score 0;
rows are predicted one by one, repeated rows alike; ties go to the language
first in order; without training rows every text gets ``und``; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from playframe.llm.common import Scratch, batch_of

UNKNOWN = "und"
#: most languages whose shares are broadcast
BROADCAST_LANGUAGES = 100_000


@dataclass(frozen=True)
class LangId:
    cells: int = 4096
    centroids: int = 4
    per_language: int = 500
    rounds: int = 8
    margin: float = 0.8       # of the smallest cosine of the nearest 99 % of a centroid's texts
    block: int = 1 << 19      # code points handled together


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code of every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def vectors(texts: list[str], cells: int) -> np.ndarray:
    """texts x cells: counts of hashed grams."""
    sizes = np.array([len(t) + 1 for t in texts])
    raw = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    code = _letters()[raw]
    row = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] > 0) | (code[:-1] > 0)  # a gap is one place
    code, row = code[keep].astype(np.uint64), row[keep]
    out = np.zeros(len(texts) * cells)
    h = np.zeros(len(code), dtype=np.uint64)
    for n in range(3):
        if n >= len(code):
            break
        h = h[: len(code) - n] * np.uint64(0x9E3779B97F4A7C15) + code[n:] + np.uint64(n + 1)
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        cell = (x >> np.uint64(40)).astype(np.int64) % cells
        first, last = code[: len(code) - n] > 0, code[n:] > 0
        good = (first if n == 0 else first | last) & (row[: len(code) - n] == row[n:])
        out += np.bincount(row[n:][good] * cells + cell[good], minlength=len(out))
    return out.reshape(len(texts), cells)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray   # centroids x cells, unit length
    owner: np.ndarray     # language of each centroid
    least: np.ndarray     # rejection limit of each centroid

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts = vectors([t or "" for t in texts], len(self.idf))
        v = counts * self.idf
        norm = np.linalg.norm(v, axis=1)
        cosine = np.clip(v @ self.centres.T / np.where(norm > 0, norm, 1.0)[:, None], 0.0, 1.0)
        best = cosine.argmax(axis=1)
        score = cosine[np.arange(len(texts)), best]
        empty = counts.sum(axis=1) == 0
        names = [UNKNOWN if e else self.languages[self.owner[b]] for e, b in zip(empty, best, strict=True)]
        score = np.where(empty, 0.0, score)
        return names, score, empty | (score < self.least[best])


def _blocks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and (size + n > most or i - start >= 256):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


def _cluster(v: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; the first centre is the mean, each next the text
    farthest from those there are."""
    centres = [_unit(v.mean(axis=0))]
    while len(centres) < min(k, len(v)):
        far = (v @ np.array(centres).T).max(axis=1).argmin()
        centres.append(v[far])
    c = np.array(centres)
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        c = np.array([_unit(v[own == j].mean(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
    return c, v @ c.T


def fit(train: DataFrame, opt: LangId) -> Model | None:
    """A model from rows (id, text, lang) of all languages there are; null
    languages are left out. Document frequencies are counted over all rows, the
    centroids fitted on at most ``per_language`` rows of each language."""
    rows = train.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("id", "text").alias("ticket"))

    def counted(texts: list[str]) -> np.ndarray:
        v = [vectors(texts[a:b], opt.cells) for a, b in _blocks(texts, opt.block)]
        v = np.concatenate(v) if v else np.empty((0, opt.cells))
        return v[v.sum(axis=1) > 0]

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(opt.cells + 1)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _blocks(texts, opt.block):
                v = counted(texts[a:b])
                found += np.concatenate([(v > 0).sum(axis=0), [len(v)]])
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.list_(pa.float64()))], names=["found"])

    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    parts = rows.select("text").mapInArrow(frequency, "found array<double>")
    total = parts.groupBy(F.lit("all")).agg(Summarizer.sum(array_to_vector("found")).alias("found")).first()
    if total is None or not total["found"][opt.cells]:
        return None
    total = total["found"]
    idf = np.log1p(total[opt.cells] / np.maximum(total.toArray()[:-1], 1))
    # a share of the tickets leaves some rows more than wanted, whatever the number of tasks
    scratch = Scratch(train.sparkSession, "langid")
    rates = scratch.keep(rows.groupBy("lang").agg((4.0 * opt.per_language / F.count("*")).alias("rate")))
    if rates.count() <= BROADCAST_LANGUAGES:  # else by shuffle
        rates = F.broadcast(rates)
    drawn = rows.join(rates, "lang").filter(F.col("ticket").bitwiseAND(F.lit((1 << 30) - 1)) < F.col("rate") * float(1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("ticket"))
    sample = scratch.keep(drawn.withColumn("place", place).filter(F.col("place") <= opt.per_language).select("lang", "text"))

    def cluster(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v = _unit(counted(table.column("text").to_pylist()) * idf)
        c, cosine = _cluster(v, opt.centroids, opt.rounds) if len(v) else (np.empty((0, opt.cells)), np.empty((0, 0)))
        own = cosine.argmax(axis=1) if len(v) else np.empty(0)
        used = [j for j in range(len(c)) if (own == j).any()]
        least = [opt.margin * float(np.quantile(cosine[own == j, j], 0.01)) for j in used]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(used), pa.string()),
                         "centre": pa.array([c[j].astype(np.float32).tobytes() for j in used], pa.binary()),
                         "least": pa.array(least, pa.float64())})

    learned = sample.groupBy("lang").applyInArrow(cluster, "lang string, centre binary, least double").orderBy("lang", "centre").collect()
    scratch.drop(sample)
    names = sorted({r["lang"] for r in learned})
    centres = np.array([np.frombuffer(r["centre"], dtype=np.float32) for r in learned], dtype=np.float64)
    return Model(names, idf, centres, np.array([names.index(r["lang"]) for r in learned]), np.array([r["least"] for r in learned]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None, opt: LangId = LangId()) -> DataFrame:
    """id, lang_pred, score and rejected for every row (id, text)."""
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _blocks(texts, opt.block):
                if model is None:
                    names, score, rejected = [UNKNOWN] * (b - a), np.zeros(b - a), np.ones(b - a, dtype=bool)
                else:
                    names, score, rejected = model.predict(texts[a:b])
                yield batch_of(id=batch.column(0).slice(a, b - a), lang_pred=pa.array(names, pa.string()),
                               score=pa.array(score, pa.float64()), rejected=pa.array(rejected))

    return docs.select(F.col("id").cast("long"), "text").mapInArrow(predict, "id long, lang_pred string, score double, rejected boolean")


def predict_all(docs: DataFrame, opt: LangId = LangId()) -> DataFrame:
    """Fit on the documents that are not held out, predict all: doc_id,
    held_out, lang_pred, score, rejected."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang")
    model = fit(rows.filter(~held_out(F.col("id"))), opt)
    return identify(rows, model, opt).select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "rejected")
