"""Joins on ranges and on time. Every plan has a real equi-key (entity plus a
bucket of the range column), so no nested-loop join appears and a hot entity is
spread over its buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from playframe.operators.ordered import ordered, top_per_key
from playframe.session import materialize

BUCKET = "__bucket"


def _bucket(c: str | Column, width: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") / F.lit(float(width)))


def spread(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    """One row per bucket an interval touches."""
    ordered_ends = intervals.filter(F.col(start) <= F.col(end))
    return ordered_ends.withColumn(
        BUCKET, F.explode(F.sequence(_bucket(start, width), _bucket(end, width)))
    )


def points_in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], point: str,
                        start: str, end: str, width: float, how: str = "inner") -> DataFrame:
    """Join points to the closed intervals that hold them. The two sides must
    share the key names only. A point has one bucket, so no pair repeats."""
    left = points.withColumn(BUCKET, _bucket(point, width))
    right = spread(intervals, start, end, width)
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") if k in keys + [BUCKET] else F.col(k) for k in right.columns]
    )
    on = [F.col(k) == F.col(f"__r_{k}") for k in keys + [BUCKET]]
    on.append(F.col(point).between(F.col(start), F.col(end)))
    joined = left.join(renamed, on, how)
    return joined.drop(BUCKET, *[f"__r_{k}" for k in keys + [BUCKET]])


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str],
                 right_span: tuple[str, str], left_id: list[str], carry: list[str], width: float, few: int = 32) -> DataFrame:
    """For every left interval the right one with the largest open overlap;
    the earliest right interval wins ties. Left rows without an overlap are
    absent from the result.

    Keys with at most ``few`` intervals on either side are paired, so that a row
    meets a bounded number of others. All other keys make no pairs, see
    ``_best_of_many``.
    """
    (ls, le), (rs, re) = left_span, right_span
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    a = materialize(left.filter(known & (F.col(ls) <= F.col(le))).select(
        *keys, F.struct(*left_id).alias("__id"), F.col(ls).alias("__s"), F.col(le).alias("__e")))
    b = materialize(right.filter(known & (F.col(rs) <= F.col(re))).select(
        *keys, F.col(rs).alias("__s"), F.col(re).alias("__e"), F.struct(*carry).alias("__carry")))
    sides = a.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(b.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    many = sides.groupBy(*keys).agg(F.sum("l").alias("l"), F.sum("r").alias("r")).filter((F.col("l") > few) | (F.col("r") > few))
    many = materialize(many.select(*keys))
    crowded = not many.isEmpty()

    def picked(df: DataFrame) -> DataFrame:
        return df.select(*keys, *[F.col(f"__id.{c}").alias(c) for c in left_id], *[F.col(f"__carry.{c}").alias(c) for c in carry], "overlap")

    x, y = (a.join(many, keys, "left_anti"), b.join(many, keys, "left_anti")) if crowded else (a, b)
    y = y.withColumnsRenamed({"__s": "__rs", "__e": "__re"})
    pairs = x.join(y, keys).filter((F.col("__rs") < F.col("__e")) & (F.col("__re") > F.col("__s")))
    pairs = pairs.withColumn("overlap", F.least("__re", "__e") - F.greatest("__rs", "__s"))
    best = picked(top_per_key(pairs, keys + ["__id"], [F.desc("overlap"), F.col("__rs"), F.col("__re"), F.col("__carry")], 1))
    if not crowded:
        return best
    return best.unionByName(picked(_best_of_many(a.join(many, keys, "left_semi"), b.join(many, keys, "left_semi"), keys, width)))


def _best_of_many(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """No pairs are made. Right intervals are numbered by their start; the best
    of a left interval is one of three:

    * the first that reaches its end, found among those that end later than all
      before them;
    * of those that begin no later than it, the one that ends last;
    * of those that lie inside it, the longest. They are a range of numbers,
      cut into aligned blocks of 1, 2, 4, ... numbers; per block, a running
      maximum of the lengths in the order of the ends gives the answer.

    So a key of n intervals costs n times the logarithm of the longest range,
    however many lie over one another.
    """
    b = materialize(ordered(b, keys, ["__s", "__e", "__carry"], width, index="__i"))

    # starts and ends of the left intervals among the right ones
    own = F.struct(F.col("__e").alias("e"), (-F.col("__i")).alias("ni"), F.col("__s").alias("s"))
    some = F.col("__s") < F.col("__e")
    marks = F.explode(F.array(
        F.struct(F.lit(True).alias("first"), F.col("__s").alias("p"), F.when(some, F.col("__s")).alias("q")),
        F.struct(F.lit(False).alias("first"), F.col("__e").alias("p"), F.lit(None).cast(a.schema["__s"].dataType).alias("q"))))
    asked = a.select(*keys, F.struct("__id", "__s", "__e").alias("__ask"), marks.alias("m")).select(
        *keys, "__ask", F.col("m.first").alias("__first"), F.col("m.p").alias("__p"), F.col("m.q").alias("__q"), F.lit(1).alias("__side"))
    given = b.select(*keys, F.col("__s").alias("__p"), F.col("__e").alias("__q"), F.lit(0).alias("__side"), "__i", own.alias("__own"))
    seen = materialize(ordered(
        given.unionByName(asked, allowMissingColumns=True), keys, ["__p", "__q", "__side", "__i"], width,
        cumsum={"__n": F.when(F.col("__side") == 0, 1).otherwise(0)}, cummax={"__top": F.col("__own")}))
    places = seen.filter("__side = 1").groupBy(*keys, "__ask").agg(
        F.max(F.when(F.col("__first"), F.col("__n"))).alias("__lo"), F.max(F.when(~F.col("__first"), F.col("__n"))).alias("__hi"),
        F.max(F.when(F.col("__first"), F.col("__top"))).alias("__top"))

    # the first right interval that reaches the end of a left one
    reach = seen.filter((F.col("__side") == 0) & (F.col("__top") == F.col("__own"))).select(
        *keys, F.col("__own.e").alias("__p"), F.lit(1).alias("__side"), "__i", "__own")
    late = places.select(*keys, F.col("__ask.__e").alias("__p"),
                         F.when(F.col("__ask.__s") < F.col("__ask.__e"), 0).otherwise(2).alias("__side"),
                         F.struct("__ask", "__lo", "__hi", "__top").alias("__place"))
    met = ordered(reach.unionByName(late, allowMissingColumns=True), keys, ["__p", "__side", "__i"], width,
                  fill_backward={"__hit": F.col("__own")})
    met = materialize(met.filter(F.col("__place").isNotNull()).select(*keys, "__place.*", "__hit"))

    def overlap(x: str) -> Column:
        return F.least(F.col(f"{x}.e"), F.col("__ask.__e")) - F.greatest(F.col(f"{x}.s"), F.col("__ask.__s"))

    def found(df: DataFrame, x: str) -> DataFrame:
        return df.select(*keys, "__ask.__id", overlap(x).alias("__o"), F.col(f"{x}.ni").alias("__ni"))

    reached = F.col("__hit.s") < F.col("__ask.__e")
    whole = F.coalesce(reached & (F.col("__hit.s") <= F.col("__ask.__s")), F.lit(False))

    # the longest right interval inside a left one
    lo, hi = F.col("__lo"), F.col("__hi")
    levels = F.sequence(F.lit(0), F.floor(F.log2(hi - lo)).cast("int"))

    def blocks(p: Column) -> Column:
        size = F.pow(F.lit(2), p)
        x, y = F.ceil(lo / size), F.floor(hi / size)
        return F.array(F.when((x < y) & (x % 2 == 1), F.struct(p.alias("level"), x.alias("block"))),
                       F.when((x < y) & (y % 2 == 1), F.struct(p.alias("level"), (y - 1).alias("block"))))

    cuts = met.filter((lo < hi) & ~whole).select(*keys, "__ask", F.explode(F.flatten(F.transform(levels, blocks))).alias("__b"))
    cuts = materialize(cuts.filter(F.col("__b").isNotNull()).select(*keys, "__ask", "__b.level", "__b.block")
                       .withColumnsRenamed({"level": "__level", "block": "__blk"}))
    deepest = cuts.agg(F.max("__level")).first()[0]
    parts = found(met.filter(reached), "__hit").union(found(met.filter(F.col("__top.e") > F.col("__ask.__s")), "__top"))
    if deepest is not None:
        cell = keys + ["__level", "__blk"]
        each = b.select(*keys, "__i", F.col("__e").alias("__p"), F.struct((F.col("__e") - F.col("__s")).alias("len"), (-F.col("__i")).alias("ni"),
                        F.col("__s").alias("s"), F.col("__e").alias("e")).alias("__own"), F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("__level"))
        each = each.withColumn("__blk", F.floor(F.col("__i") / F.pow(F.lit(2), F.col("__level"))).cast("bigint"))
        each = each.join(cuts.select(*cell).distinct(), cell, "left_semi").withColumn("__side", F.lit(0))
        inside = cuts.select(*cell, F.col("__ask.__e").alias("__p"), "__ask", F.lit(1).alias("__side"))
        longest = ordered(each.unionByName(inside, allowMissingColumns=True), cell, ["__p", "__side", "__i"], width,
                          cummax={"__long": F.col("__own")})
        parts = parts.union(found(longest.filter((F.col("__side") == 1) & F.col("__long").isNotNull()), "__long"))
    best = parts.groupBy(*keys, "__id").agg(F.max(F.struct("__o", "__ni")).alias("__m")).select(
        *keys, "__id", F.col("__m.__o").alias("overlap"), (-F.col("__m.__ni")).alias("__i"))
    return best.join(b.select(*keys, "__i", "__carry"), keys + ["__i"])


def stamp_last(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str,
               end: str, ordinal: str, value: str, width: float) -> DataFrame:
    """Value of the interval written last among those that hold a point; null
    for points in no interval. ``points`` must be unique on (keys, point)."""
    held = points_in_intervals(points.select(*keys, point), intervals.select(*keys, start, end, ordinal, value),
                               keys, point, start, end, width)
    stamped = held.groupBy(*keys, point).agg(F.max_by(value, ordinal).alias(value))
    return points.join(stamped, keys + [point], "left")


def asof_forward(targets: DataFrame, series: DataFrame, keys: list[str], target: str, time: str,
                 rank: str, carry: list[str], width: float) -> DataFrame:
    """First series row at or after each target, the last row of the key for
    targets past the end, nothing for keys without a series.

    ``rank`` orders series rows of equal time. ``targets`` may repeat; columns
    of ``carry`` must not exist in it.
    """
    payload = F.struct(*[F.col(c) for c in carry])
    t = targets.filter(F.col(target).isNotNull()).select(
        *keys, F.col(target).cast("double").alias("__t"), F.lit(0).alias("__side"),
        F.lit(None).cast("bigint").alias("__rank"), F.struct(*targets.columns).alias("__target"),
    )
    s = series.filter(F.col(time).isNotNull()).select(
        *keys, F.col(time).cast("double").alias("__t"), F.lit(1).alias("__side"),
        F.col(rank).cast("bigint").alias("__rank"), payload.alias("__row"),
    )
    both = t.unionByName(s, allowMissingColumns=True)
    filled = ordered(both, keys, ["__t", "__side", "__rank"], width, fill_backward={"__hit": F.col("__row")})
    hits = filled.filter(F.col("__side") == 0).select(*keys, "__target", "__hit")
    last = s.groupBy(*keys).agg(F.max_by("__row", F.struct(F.col("__t"), -F.col("__rank"))).alias("__last"))
    found = hits.join(last, keys, "inner")
    row = F.coalesce(F.col("__hit"), F.col("__last"))
    return found.select(
        *[F.col(f"__target.{c}").alias(c) for c in targets.columns],
        *[row[c].alias(c) for c in carry],
    )
