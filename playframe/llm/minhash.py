"""Near-duplicate classes by improved consistent weighted sampling.

A text is the multiset of its five-word shingles (lower case, words between
ASCII white space). The weight of a shingle is its count in the text times
log(1 + N / df). The document frequencies df are counted over all documents in
2**18 hashed cells and never taken below 5 % of N: so weights depend on shares
of the corpus alone, only what really is everywhere is weighted down, and the
table of cells above the floor is bounded (shingles of a document / 5 %).

Each of 120 samples draws (r, c, beta) per shingle from a fixed table of triples
sorted by the value they give an ordinary weight. A hash of the shingle picks the
triple, so for ordinary weights the smallest hash is the sample, and other weights
are placed among them by their own value. Equal samples mean equal (shingle, step).

24 bands of 5 samples propose candidates: pairs at 0.8 are missed with odds of
7e-5. A text can share no more than what it shares with any text of any bucket, so
texts with too much of their own leave a bucket whose lightest text they cannot
reach, and pairs that cannot reach 0.8 are not proposed; both bounds are exact. In
a bucket, texts are compared with a few pivots, first the one with least of its
own; whatever is then still in different classes is compared with the rest of its
bucket, so no proposed pair in different classes goes unverified, but for those with so few
equal samples that they reach 0.8 with odds of 6e-5. Verification is the exact weighted Jaccard similarity of the two texts.

Defined results: exact copies (equal words) are one node; texts without words
are alone in their class; null doc_id rows form classes like others, with a null
id if no member has one; repeated rows give repeated rows; other columns of the
input are ignored. Nodes are 64-bit digests of the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from playframe.llm.common import Scratch, batch_of, spread_join, text_of
from playframe.llm.components import components
from playframe.llm.wordhash import U, blocks, distinct, mix, shingles, word_hashes

CELLS = 1 << 18
ATOM_BITS = 18


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 5
    floor: float = 0.05  # least share of documents a frequency counts as
    pivots: tuple[int, ...] = (1, 8)
    estimate: float = 0.66  # share of equal samples below which a pair left over is not verified


def _uniforms(n: int, stream: int) -> np.ndarray:
    x = mix(np.arange(1, n + 1, dtype=U) * U(0xD1342543DE82EF95) + U(stream * 0xA0761D6478BD642F % (1 << 64)))
    return ((x >> U(11)).astype(np.float64) + 0.5) / float(1 << 53)


@lru_cache(maxsize=4)
def _atoms(weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triples (r, log c, beta) in the order of log a at the ordinary weight."""
    n = 1 << ATOM_BITS
    r = -np.log(_uniforms(n, 1) * _uniforms(n, 2))
    c = np.log(-np.log(_uniforms(n, 3) * _uniforms(n, 4)))
    beta = _uniforms(n, 5)
    a = _log_a(r, c, beta, math.log(weight))
    order = np.argsort(a, kind="stable")
    return r[order], c[order], beta[order], a[order]


def _log_a(r, c, beta, log_weight):
    step = np.floor(log_weight / r + beta)
    return c - r * (step - beta) - r


def _idf(df, n_docs: int, floor: float):
    return np.log1p(n_docs / np.maximum(df, floor * n_docs))


def text_weights(texts: list[str], opt: NearDup, n_docs: int, heavy: tuple[np.ndarray, np.ndarray]):
    """Distinct shingles, weights and offsets of some texts."""
    values, offsets = shingles(*word_hashes(texts), opt.words)
    u, counts, offsets = distinct(values, offsets)
    usual = float(np.log1p(1.0 / opt.floor))
    w = counts * usual
    cells, df = heavy
    if len(cells) and len(u):
        own = (u >> U(64 - 18)).astype(np.int64)
        at = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
        hit = cells[at] == own
        w[hit] = counts[hit] * _idf(df[at[hit]], n_docs, opt.floor)
    return u, w, offsets, usual


def signatures(u: np.ndarray, w: np.ndarray, offsets: np.ndarray, usual: float, samples: int) -> np.ndarray:
    """(texts with shingles) x samples; equal entries are equal samples."""
    r, c, beta, ranked = _atoms(usual)
    odd = np.flatnonzero(w != usual)
    log_w = np.log(w[odd])
    seeds = mix(np.arange(1, 2 * samples + 1, dtype=U) * U(0x9FB21C651E98DF25))
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), samples), dtype=U)
    low = U((1 << (64 - ATOM_BITS)) - 1)
    for k in range(samples):
        h = (u ^ seeds[2 * k]) * (seeds[2 * k + 1] | U(1))
        if len(odd):
            atom = (h[odd] >> U(64 - ATOM_BITS)).astype(np.int64)
            place = np.searchsorted(ranked, _log_a(r[atom], c[atom], beta[atom], log_w))
            place = np.minimum(place, len(ranked) - 1).astype(U)
            h[odd] = (place << U(64 - ATOM_BITS)) | (h[odd] & low)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A digest of the word sequence of each text with words."""
    counts = np.diff(offsets)
    starts = offsets[:-1][counts > 0]
    position = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
    return mix(np.add.reduceat(mix(hashes ^ mix(position.astype(U) + U(77))), starts) + counts[counts > 0].astype(U))


def cell_counts(docs: DataFrame, opt: NearDup, scratch: Scratch) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
    """Number of documents, and the cells above the floor with their frequency."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(CELLS, dtype=np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for a, b in blocks(texts):
                values, offsets = shingles(*word_hashes(texts[a:b]), opt.words)
                cell = (values >> U(64 - 18)).astype(np.int64)
                doc = np.repeat(np.arange(b - a), np.diff(offsets))
                table += np.bincount(np.unique(doc * CELLS + cell) % CELLS, minlength=CELLS)
        some = np.flatnonzero(table)
        yield batch_of(cell=np.append(some, -1), df=np.append(table[some], n))

    counted = scratch.keep(docs.select(text_of().alias("text")).mapInArrow(count, "cell long, df long")
                           .groupBy("cell").agg(F.sum("df").alias("df")))
    n_docs = counted.filter("cell = -1").first()
    n_docs = int(n_docs["df"]) if n_docs else 0
    top = counted.filter((F.col("cell") >= 0) & (F.col("df") > opt.floor * n_docs)).orderBy("cell").toPandas()
    scratch.drop(counted)
    return n_docs, (top["cell"].to_numpy(np.int64), top["df"].to_numpy(np.float64))


def _candidates(docs: DataFrame, opt: NearDup, n_docs: int, heavy) -> DataFrame:
    samples = opt.bands * opt.rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, samples + 1, dtype=U)).reshape(opt.bands, opt.rows)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                part = texts[a:b]
                hashes, words = word_hashes(part)
                full = np.diff(words) > 0
                node, sizes = np.zeros(len(part), dtype=np.int64), np.where(full, opt.bands, 0)
                keys, prints = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int8)
                if full.any():
                    node[full] = _digests(hashes, words).view(np.int64)
                    sig = signatures(*text_weights(part, opt, n_docs, heavy), samples)
                    prints = mix(sig).astype(np.uint8).view(np.int8).ravel()
                    sig = sig.reshape(-1, opt.bands, opt.rows)
                    keys = mix((mix(sig ^ salt) * salt).sum(axis=2) + np.arange(opt.bands, dtype=U)).view(np.int64).ravel()
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(keys))
                own = pa.array(np.concatenate(([0], np.cumsum(sizes * opt.rows))), pa.int32())
                yield batch_of(doc_id=batch.column(0).slice(a, b - a), node=pa.array(node, mask=~full), bands=bands,
                               prints=pa.ListArray.from_arrays(own, pa.array(prints)))

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        sign, "doc_id long, node long, bands array<long>, prints array<tinyint>")


def _with_node(name: str):
    """Batches whose last column is a text, with the text's node appended."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in blocks([t or "" for t in texts]):
                hashes, words = word_hashes([t or "" for t in texts[a:b]])
                full = np.diff(words) > 0
                node = np.zeros(b - a, dtype=np.int64)
                if full.any():
                    node[full] = _digests(hashes, words).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(node, mask=~full)],
                                                 names=[*batch.schema.names, name])
    return mark


def _verified(pairs: DataFrame, texts: DataFrame, opt: NearDup, n_docs: int, heavy, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            first, second = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            left, right = batch.column("text_a").to_pylist(), batch.column("text_b")
            good = np.zeros(len(first), dtype=bool)
            for x, y in blocks(left):
                u, w, off, _ = text_weights(left[x:y], opt, n_docs, heavy)
                for i in range(x, y):
                    if second[i] != last:
                        last, held = second[i], text_weights([right[i].as_py()], opt, n_docs, heavy)
                    s = slice(off[i - x], off[i - x + 1])
                    at = np.minimum(np.searchsorted(held[0], u[s]), len(held[0]) - 1)
                    hit = held[0][at] == u[s]
                    both = np.minimum(held[1][at[hit]], w[s][hit]).sum()
                    good[i] = both >= opt.similarity * (held[1].sum() + w[s].sum() - both) * (1 - 1e-12)
            yield batch_of(a=first[good], b=second[good])

    named = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
             .join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))
    return scratch.keep(named.mapInArrow(verify, "a long, b long"))


def near_duplicates(docs: DataFrame, opt: NearDup = NearDup()) -> DataFrame:
    """One row per document: doc_id, node (its distinct text, null without words),
    class_id (smallest doc_id of the class) and n_links (verified links of its
    text to other texts)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    n_docs, heavy = cell_counts(docs, opt, scratch)
    rows = scratch.keep(_candidates(docs, opt, n_docs, heavy))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("bands", "prints")).alias("s"))
    keys = scratch.keep(nodes.select("node", F.explode("s.bands").alias("key")))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    buckets = scratch.keep(keys.join(shared, "key").select("key", "node"))
    scratch.drop(keys)

    # the texts of nodes that share a bucket, one row each
    wanted = buckets.select("node").distinct()
    owner = nodes.select("node", "doc_id").join(wanted, "node").select(F.col("doc_id").alias("own")).distinct()
    texts = scratch.keep(
        docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
        .join(owner, F.col("doc_id").eqNullSafe(F.col("own")), "left_semi").select("text")
        .mapInArrow(_with_node("node"), "text string, node long").filter("node is not null")
        .join(wanted, "node", "left_semi").dropDuplicates(["node"]))

    buckets = _possible(buckets, texts, opt, n_docs, heavy, scratch)

    links, labels, checked = None, None, None
    for turn, n_pivots in enumerate(opt.pivots):
        here = buckets.withColumn("root", F.col("node")) if labels is None else _labelled(buckets, labels)
        odd = (F.lit(1.0) - F.col("shared") / F.col("weight")) if turn == 0 else F.lit(0.0)
        chosen = [F.min(F.struct(odd.alias("odd"), F.xxhash64("node", F.lit(turn), F.lit(k)).alias("h"), "node", "weight", "shared", "root"))
                  for k in range(n_pivots)]
        pivots = here.groupBy("key").agg(F.array_distinct(F.array(*chosen)).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        pivots = pivots.filter("lo <> hi").select("key", F.explode("p").alias("p"))
        pairs = here.join(pivots, "key").filter(F.col("root") != F.col("p.root")).filter(_reach(
            F.col("weight"), F.col("shared"), F.col("p.weight"), F.col("p.shared"), opt))
        links, labels, checked, more = _extend(pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")),
                                               links, labels, checked, texts, opt, n_docs, heavy, scratch)
        if not more:
            break
    here = scratch.keep(_labelled(buckets, labels))
    mixed = here.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = mixed.groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1")
    here_left = here.join(top.select("key", F.col("m.root").alias("largest")), "key")
    signs = nodes.select("node", "s.bands", "s.prints").join(here_left.select("node").distinct(), "node")
    left = scratch.keep(here_left.join(signs, "node"))
    few = left.filter("root <> largest").select(*[F.col(c).alias(f"x_{c}") for c in ("key", "node", "root", "weight", "shared", "bands", "prints")])
    same = F.zip_with("x_bands", "bands", lambda x, y: x == y)
    alike = F.aggregate(F.zip_with("x_prints", "prints", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    pairs = few.join(left, (F.col("x_key") == F.col("key")) & (F.col("x_root") != F.col("root")) & _reach(
        F.col("weight"), F.col("shared"), F.col("x_weight"), F.col("x_shared"), opt)
        & (F.element_at("bands", F.array_position(same, True).cast("int")) == F.col("key"))  # once, at the first band they share
        & (alike >= int(opt.estimate * opt.bands * opt.rows)))
    pairs = pairs.select(F.col("x_node").alias("x"), "node")
    links, labels, _, _ = _extend(pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")),
                                  links, labels, checked, texts, opt, n_docs, heavy, scratch)
    scratch.drop(here, left)
    scratch.drop(buckets, texts)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    first = rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = first.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = named.groupBy("root").agg(F.min("least").alias("class_id"))
    per_node = spread_join(named, classes, "root", ["node"]).join(degree, "node", "left").select("node", "class_id", "n_links")
    # copies of one text share a node, members of a class a root
    return spread_join(rows.select("doc_id", "node"), per_node, "node", ["doc_id"]).select(
        "doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _reach(weight, shared, other_weight, other_shared, opt: NearDup):
    """Whether two texts can be similar enough: they share at most what each of
    them shares with any text at all."""
    both = F.least(shared, other_shared)
    return both >= F.lit(opt.similarity * (1 - 1e-9)) * (weight + other_weight - both)


def _possible(buckets: DataFrame, texts: DataFrame, opt: NearDup, n_docs: int, heavy, scratch: Scratch) -> DataFrame:
    """The buckets with the weight of each text and the weight of its shingles
    that another text of any bucket has too; without the texts that cannot be
    similar enough to any text as heavy as the lightest of their bucket."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, source = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in blocks(source):
                u, w, offsets, _ = text_weights(source[a:b], opt, n_docs, heavy)
                yield batch_of(shingle=u.view(np.int64), node=np.repeat(node[a:b], np.diff(offsets)), weight=w)

    each = texts.select("node", "text").mapInArrow(spread, "shingle long, node long, weight double")
    per = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight"))
    alone = per.filter("n = 1").groupBy("node").agg(F.sum("weight").alias("alone"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.column(1).to_pylist()
            for a, b in blocks(source):
                _, w, offsets, _ = text_weights(source[a:b], opt, n_docs, heavy)
                yield batch_of(node=batch.column(0).slice(a, b - a), weight=np.add.reduceat(w, offsets[:-1]))

    weights = texts.select("node", "text").mapInArrow(weigh, "node long, weight double")
    info = scratch.keep(weights.join(alone, "node", "left").select(
        "node", "weight", (F.col("weight") - F.coalesce("alone", F.lit(0.0))).alias("shared")))
    told = scratch.keep(buckets.join(info, "node"))
    least = told.groupBy("key").agg(F.min("weight").alias("lightest"))
    able = F.col("shared") >= F.lit(opt.similarity * (1 - 1e-9)) * (
        F.col("weight") + F.greatest("lightest", "shared") - F.col("shared"))
    out = scratch.keep(told.join(least, "key").filter(able).select("key", "node", "weight", "shared"))
    scratch.drop(buckets, told, info)
    return out


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    return buckets.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _extend(pairs, links, labels, checked, texts, opt, n_docs, heavy, scratch):
    """Verify the pairs that were not verified before. Gives the links and labels
    with what they add, the pairs verified so far, and whether there were new ones.
    New links join whole classes, so only links between classes are followed."""
    pairs = pairs.distinct()
    if checked is not None:
        pairs = pairs.join(checked, ["a", "b"], "left_anti")
    pairs = scratch.keep(pairs)
    if links is not None and pairs.isEmpty():
        return links, labels, checked, False
    found = _verified(pairs, texts, opt, n_docs, heavy, scratch)
    if links is None:
        return found, components(found, scratch), pairs, True
    one = labels.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    two = labels.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    between = found.join(one, "a", "left").join(two, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = components(between, scratch)
    up = joined.select(F.col("node").alias("root"), F.col("root").alias("next"))
    old = labels.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    new = scratch.keep(old.union(joined.join(labels.select("node"), "node", "left_anti").select("node", "root")))
    both, done = scratch.keep(links.union(found)), scratch.keep(checked.union(pairs))
    scratch.drop(links, found, labels, joined, checked, pairs)
    return both, new, done, True


def keep_one(docs: DataFrame, opt: NearDup = NearDup()) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all its
    columns; documents without words all stay. Where an id occurs several times,
    one row per id and text of those kept stays."""
    scratch = Scratch(docs.sparkSession, "neardup-keep")
    marks = near_duplicates(docs, opt)
    worded = F.col("node").isNotNull()
    kept = scratch.keep(marks.filter(~worded | F.col("doc_id").eqNullSafe(F.col("class_id")))
                        .groupBy(F.col("doc_id").alias("keep__id"), F.col("node").alias("keep__node")).agg(F.count("*").alias("n")))
    seen = marks.groupBy(F.col("doc_id").alias("keep__id")).agg(F.count("*").alias("n")).filter("n > 1").select("keep__id")
    seen = scratch.keep(seen)
    same = F.col("doc_id").eqNullSafe(F.col("keep__id"))
    ids = kept.select("keep__id").distinct()
    if seen.isEmpty():
        return docs.join(ids, same, "left_semi")
    single = docs.join(_without(ids, seen), same, "left_semi")
    again = docs.join(seen, same, "left_semi").withColumn("keep__text", F.col("text"))
    schema = T.StructType([*again.schema.fields, T.StructField("row__node", T.LongType())])
    own = F.col("row__node")
    both = again.mapInArrow(_with_node("row__node"), schema).join(
        kept.select("keep__id", "keep__node"), same & own.eqNullSafe(F.col("keep__node")), "left_semi")
    worded_rows = both.filter(own.isNotNull()).dropDuplicates(["doc_id", "row__node"])
    # of a class whose smallest id occurs with several of its texts, one stays
    cls = marks.filter(worded).select(F.col("node").alias("keep__node"), "class_id").distinct()
    least = kept.filter("keep__node is not null").join(cls, "keep__node").groupBy("class_id").agg(F.min("keep__node").alias("one")).select("one")
    worded_rows = worded_rows.join(least, own == F.col("one"), "left_semi")
    return single.union(worded_rows.union(both.filter(own.isNull())).select(*docs.columns))


def _without(ids: DataFrame, seen: DataFrame) -> DataFrame:
    gone = seen.select(F.col("keep__id").alias("gone__id"))
    return ids.join(gone, F.col("keep__id").eqNullSafe(F.col("gone__id")), "left_anti")
