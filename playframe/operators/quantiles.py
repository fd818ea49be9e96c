"""Exact interpolated quantiles without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from playframe.session import materialize

#: accuracy of the sketch: its ranks are off by at most one in so many
ACCURACY = 10_000
#: keys of at most so many rows are ranked whole
SMALL = 50_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float], out: str = "q") -> DataFrame:
    """Quantiles by linear interpolation, one array per key.

    A bounded sketch of every key gives a bracket of values around each rank, two
    sketch errors to either side. A second pass counts the rows below each bracket
    and, by value, those inside; only the inside is ranked, at most a thousandth of
    a key's rows. The sketch only says where to look; the result is exact, and a
    rank outside its bracket would raise an error.
    """
    if not keys:
        return exact_quantiles(df.withColumn("__all", F.lit(1)), ["__all"], value, qs, out).drop("__all")
    # written once, as three passes read it
    rows = materialize(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v")))
    shares = [min(max(q + d * 2 / ACCURACY, 0.0), 1.0) for q in qs for d in (-1, 1)]
    shape = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", shares, ACCURACY).alias("__b")))
    j = rows.join(shape, keys)
    v, small = F.col("__v"), F.col("__n") <= SMALL
    held = F.filter(F.sequence(F.lit(0), F.lit(len(qs) - 1)), lambda i: (v >= F.get("__b", 2 * i)) & (v <= F.get("__b", 2 * i + 1)))
    inside = j.select(*keys, "__v", "__n", F.explode(F.when(small, F.array(F.lit(-1))).otherwise(held)).alias("__i"))
    counts = inside.groupBy(*keys, "__n", "__i", "__v").agg(F.count(F.lit(1)).alias("__c"))
    last = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)) - 1
    ranked = counts.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__c") + 1)
    below = j.filter(~small).groupBy(*keys).agg(F.array(*[F.count_if(v < F.get("__b", F.lit(2 * i))) for i in range(len(qs))]).alias("__below"))
    ranked = ranked.join(below, keys, "left")

    def pick(i: int, rank):
        own = rank - F.when(F.col("__i") >= 0, F.get("__below", F.lit(i))).otherwise(0)
        return F.max(F.when(F.col("__i").isin(-1, i) & own.between(F.col("__first"), F.col("__last")), v))

    aggs = []
    for i, q in enumerate(qs):
        pos = F.lit(q) * (F.col("__n") - 1)
        aggs += [pick(i, F.floor(pos)).alias(f"__lo{i}"), pick(i, F.ceil(pos)).alias(f"__hi{i}")]
    g = ranked.groupBy(*keys, "__n").agg(*aggs)
    missed = F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")
    parts = []
    for i, q in enumerate(qs):
        pos = F.lit(q) * (F.col("__n") - 1)
        low, high = (F.coalesce(f"__{side}{i}", missed) for side in ("lo", "hi"))
        parts.append(low + (high - low) * (pos - F.floor(pos)))
    return g.select(*keys, F.array(*parts).alias(out))


def column_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median of many columns; the result has one number per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e")).select("e.*")
    rows = exact_quantiles(long, ["name"], "v", [0.5]).collect()  # one row per column name
    found = {r.name: r.q[0] for r in rows}
    return {c: found.get(c) for c in columns}
