"""Quality rules by distribution divergence, in built-in functions only.

A document's histogram of character classes and its histogram of common words
are compared with those of its language by Jensen-Shannon distance (base 2,
0 to 1). The references are counts over all documents of the language: sums of
the character classes, and the words of the language that occur most often. The
limit of the word distance depends on the length of a text, by the distance that
a sample of so many words has by chance.

Defined results: a null text has no words and fails the base rules; a null
language is a language of its own; a language whose reference holds fewer than
``min_reference_words`` words gives no verdict, so the document is kept; a very
long text is judged whole; words that are equally common enter a reference in
order; an empty table gives no rows; repeated rows are judged one by one; other columns pass through ``judge``
untouched, and helper columns carry a prefix no table uses.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from playframe.llm.common import SPACES, Scratch, text_of

#: most languages whose references are broadcast; beyond it they are joined
BROADCAST_LANGUAGES = 2000
P = "_q_"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50             # base rule
    max_repeat_percent: int = 50    # base rule
    common_words: int = 30          # words of a language's reference
    max_class_distance: float = 0.30
    max_word_distance: float = 0.28  # of an endless text; see word_limit
    min_words_classes: int = 50     # guard of the class comparison
    min_words_common: int = 50      # guard of the word comparison
    min_reference_words: int = 5000  # guard of a reference


def words_of(text: Column) -> Column:
    """Runs of anything but ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def _count_of(text: Column, keep: str) -> Column:
    """Code points of ``text`` in the class ``keep``."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def _classes(text: Column) -> dict[str, Column]:
    """Counts of the character classes that are cut out of a text."""
    return {"upper": _count_of(text, r"\p{Lu}"), "digits": _count_of(text, "0-9"),
            "n_symbols": _count_of(text, "#*$%&|<>"), "marks": _count_of(text, ".,;:!?")}


def _histogram(word_chars: Column, chars: Column, upper: Column, digits: Column, symbols: Column, marks: Column) -> Column:
    return F.array(upper, digits, symbols, marks, chars - word_chars,
                   word_chars - upper - digits - symbols - marks).cast("array<double>")


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, the class histogram and the words, all in
    prefixed columns."""
    text, w = F.col(f"{P}text"), F.col(f"{P}words")
    df = docs.withColumn(f"{P}text", text_of())
    df = df.withColumn(f"{P}words", words_of(text))
    grams = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    df = df.withColumns({
        f"{P}n_words": F.size(w).cast("long"), f"{P}word_chars": F.length(F.array_join(w, "")).cast("long"),
        f"{P}grams": grams, f"{P}lines": lines,
    })
    g, ln = F.col(f"{P}grams"), F.col(f"{P}lines")
    df = df.withColumns({
        f"{P}sorted": F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        f"{P}n_dup_lines": (F.size(ln) - F.size(F.array_distinct(ln))).cast("long"),
        **{f"{P}{k}": v for k, v in _classes(text).items()},
    }).drop(f"{P}grams", f"{P}lines")
    s, c = F.col(f"{P}sorted"), lambda x: F.col(f"{P}{x}")
    twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
    covered = F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    return df.withColumns({
        f"{P}n_repeat_words": F.size(covered).cast("long"),
        f"{P}classes": _histogram(c("word_chars"), F.length(text).cast("long"), c("upper"), c("digits"), c("n_symbols"), c("marks")),
    }).drop(f"{P}sorted")


def _language(column: str = "lang") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def references(docs: DataFrame, rules: QualityRules, scratch: Scratch) -> DataFrame:
    """One row per language: summed character classes, its most frequent words
    with their counts (ties by word) and its number of words. The classes are
    summed over the counted words, so the texts are cut once."""
    per = docs.select(_language().alias(f"{P}lang"), text_of().alias("t"))
    counted = scratch.keep(
        per.select(f"{P}lang", F.explode(words_of(F.col("t"))).alias("word")).groupBy(f"{P}lang", "word").agg(F.count("*").alias("n")))
    parts = counted.select(f"{P}lang", "n", F.length("word").alias("word_chars"),
                           *[v.alias(k) for k, v in _classes(F.col("word")).items()])
    sums = parts.groupBy(f"{P}lang").agg(
        F.sum("n").alias(f"{P}ref_words"),
        *[F.sum(F.col("n") * F.col(k)).alias(k) for k in ("word_chars", "upper", "digits", "n_symbols", "marks")])
    chars = per.groupBy(f"{P}lang").agg(F.sum(F.length("t").cast("long")).alias("chars"))
    rank = F.row_number().over(Window.partitionBy(f"{P}lang").orderBy(F.desc("n"), F.asc("word")))
    top = (counted.withColumn("rank", rank).filter(F.col("rank") <= rules.common_words)
           .groupBy(f"{P}lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top")))
    rest = F.col(f"{P}ref_words") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    kept = scratch.keep(sums.join(chars, f"{P}lang").join(top, f"{P}lang").select(
        f"{P}lang", f"{P}ref_words",
        _histogram(*[F.col(x) for x in ("word_chars", "chars", "upper", "digits", "n_symbols", "marks")]).alias(f"{P}ref_classes"),
        F.transform("top", lambda x: x["word"]).alias(f"{P}common"),
        F.concat(F.transform("top", lambda x: x["n"].cast("double")), F.array(rest.cast("double"))).alias(f"{P}ref_common")))
    scratch.drop(counted)
    return kept


def shares(a: Column) -> Column:
    """A count array as shares; null where its sum is 0."""
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.zip_with(a, F.array_repeat(total, F.size(a)), lambda x, t: x / t))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; null where one is."""
    def part(x, y):
        m = (x + y) / 2
        return (F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)) / 2

    found = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x)))
    return F.when(p.isNotNull() & q.isNotNull(), found)


def word_limit(n_words: Column, rules: QualityRules) -> Column:
    """Largest word distance of a good text. The squared distance of a sample of
    n words from its own distribution over c + 1 words is c / (8 n ln 2) on
    average, to first order; it comes on top of the square of the limit."""
    return F.sqrt(F.lit(rules.max_word_distance ** 2) + rules.common_words / (8 * math.log(2)) / F.greatest(n_words, F.lit(1)))


OUT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def _judged(docs: DataFrame, rules: QualityRules, refs: DataFrame | None) -> DataFrame:
    """``docs`` with the columns OUT in one struct column. The struct comes from a
    generator, below which no filter is pushed: a filter on a result would be
    evaluated with the steps that lead to it inside each other."""
    if refs is None:
        refs = references(docs, rules, Scratch(docs.sparkSession, "quality"))
    if refs.count() <= BROADCAST_LANGUAGES:
        refs = F.broadcast(refs)
    df = base_counts(docs).withColumn(f"{P}lang", _language()).join(refs, f"{P}lang", "left")
    words, common, n_words = F.col(f"{P}words"), F.col(f"{P}common"), F.col(f"{P}n_words")
    long_enough = n_words >= rules.min_words_common
    df = df.withColumn(f"{P}hits", F.when(long_enough, F.filter(words, lambda x: F.array_contains(common, x)))).drop(f"{P}words")
    hits = F.col(f"{P}hits")
    histogram = F.concat(
        F.transform(common, lambda c: (F.size(hits) - F.size(F.array_remove(hits, c))).cast("double")),
        F.array((n_words - F.size(hits)).cast("double")))
    df = df.withColumn(f"{P}histogram", histogram).drop(f"{P}hits")
    df = df.withColumns({f"{P}{k}_share": shares(F.col(f"{P}{k}")) for k in ("classes", "ref_classes", "histogram", "ref_common")})
    known = F.col(f"{P}ref_words") >= rules.min_reference_words
    failed = (n_words < rules.min_words) | (100 * F.col(f"{P}n_repeat_words") > rules.max_repeat_percent * n_words)
    df = df.withColumns({
        f"{P}class_distance": F.when(known & (n_words >= rules.min_words_classes),
                                     distance(F.col(f"{P}classes_share"), F.col(f"{P}ref_classes_share"))),
        f"{P}word_distance": F.when(known & long_enough, distance(F.col(f"{P}histogram_share"), F.col(f"{P}ref_common_share"))),
        f"{P}base_failed": failed,
    })
    near = (F.coalesce(F.col(f"{P}class_distance"), F.lit(0.0)) <= rules.max_class_distance) & (
        F.coalesce(F.col(f"{P}word_distance"), F.lit(0.0)) <= word_limit(n_words, rules))
    df = df.withColumn(f"{P}kept", ~F.col(f"{P}base_failed") & near)
    once = F.array(F.struct(*[F.col(f"{P}{c}").alias(c) for c in OUT]))
    return df.select(*docs.columns, F.explode(once).alias(f"{P}out"))


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), refs: DataFrame | None = None) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed and kept; a column of the same
    name in ``docs`` is replaced."""
    own = [c for c in docs.columns if c not in OUT]
    return _judged(docs, rules, refs).select(*own, *[F.col(f"{P}out.{c}").alias(c) for c in OUT])


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return _judged(docs, rules, None).filter(F.col(f"{P}out.kept")).select(*docs.columns)
