"""Maps per label: sums, similarity and the subsampling test of roughness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from playframe.functions.nulls import ratio
from playframe.operators import grids

# Labels of the reduced display set, and the label pairs (many
# against few phases) of the subsampling test.
DISPLAY_LABELS = (
    "1423", "1234", "3511flat", "3511", "1432", "pyramid", "wm", "32221", "3421flat", "541", "42211",
)
SUBSAMPLE_PAIRS = (
    ("1234", "pyramid"), ("3511flat", "wm"), ("1432", "32221"), ("3511", "3421flat"), ("541", "42211"),
)


def label_sums(cells: DataFrame, labels: DataFrame, keys: list[str], value: str, min_phases: int) -> DataFrame:
    """Summed cells per label and block. ``labels`` has one row per phase; a
    label counts with all of its phases, also those without cells."""
    kept = labels.filter(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n_phases")).filter(
        F.col("n_phases") >= min_phases)
    # labels meet their counts before the cells: there are few, so all cells of a
    # label would go to one task
    tagged = cells.join(labels.join(kept, "label"), keys)
    v = F.col(value)
    return tagged.groupBy("label", "n_phases", "row", "col").agg(
        F.sum(F.when(F.col("block") == "in", v).otherwise(0.0)).alias("in_possession_sum"),
        F.sum(F.when(F.col("block") == "out", v).otherwise(0.0)).alias("out_of_possession_sum"))


def display_labels(sums: DataFrame) -> DataFrame:
    """Sums of the display set, in its order."""
    order = F.array_position(F.array(*[F.lit(x) for x in DISPLAY_LABELS]), F.col("label"))
    return sums.withColumn("position", order).filter(F.col("position") > 0)


def common_grid_cells(recurrence: DataFrame, n_rows: int, n_cols: int, length: float) -> DataFrame:
    """Phase cells of all matches on one grid, oriented by attack.

    The native shape of a match is the extent of its cells, as the maps carry
    no other record of it.
    """
    from playframe.plans.maps import attack_oriented

    extent = recurrence.groupBy("match_id").agg((F.max("row") + 1).alias("__nr"), (F.max("col") + 1).alias("__nc"))
    native = recurrence.join(extent, "match_id")
    cells = grids.regrid(native, ["match_id", "window_id", "team", "period", "side"], "recurrence_frac",
                         F.col("__nr"), F.col("__nc"), n_rows, n_cols)
    return attack_oriented(cells, "recurrence_frac", n_rows, n_cols, length)


def formation_similarity(sums: DataFrame, labels: list[str], n_rows: int, n_cols: int, block: str = "combined") -> DataFrame:
    """Correlation of the mean maps of formations: in possession, out of
    possession, or both one after the other."""
    size = n_rows * n_cols
    at = F.col("row") * n_cols + F.col("col")
    parts = []
    if block in ("in", "combined"):
        parts.append(sums.select("label", at.alias("cell"), (F.col("in_possession_sum") / F.col("n_phases")).alias("v")))
    if block in ("out", "combined"):
        shift = size if block == "combined" else 0
        parts.append(sums.select("label", (at + shift).alias("cell"), (F.col("out_of_possession_sum") / F.col("n_phases")).alias("v")))
    cells = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return grids.label_correlation(cells, "label", "v", size * len(parts), labels)


def subsample_roughness(cells: DataFrame, labels: DataFrame, keys: list[str], value: str, pairs, n_rows: int, n_cols: int,
                        draws: int = 20, seed: int = 0) -> DataFrame:
    """Is roughness only a matter of sample size?

    For every pair, the label with many phases is drawn down to the size of the
    other one ``draws`` times and its roughness compared. A draw takes the
    phases with the smallest hash of (phase, draw), which any cluster repeats. A
    pair of which a label has no phases stays, with the reason.
    """
    spark = cells.sparkSession
    one = cells.filter(F.col("block") == "in") if "block" in cells.columns else cells
    named = labels.filter(F.col("label").isNotNull())
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    pair = spark.createDataFrame([(a, b) for a, b in pairs], "high string, low string")
    pair = (pair.join(sizes.withColumnRenamed("label", "high").withColumnRenamed("n", "n_high"), "high", "left")
            .join(sizes.withColumnRenamed("label", "low").withColumnRenamed("n", "n_low"), "low", "left"))

    def score(members: DataFrame, by: list[str], out: str) -> DataFrame:
        d = grids.densify(one.join(members, keys), by, value, n_rows, n_cols)
        return d.select(*by, grids.total_variation(F.col("cells"), n_rows, n_cols).alias(out))

    whole = score(named, ["label"], "score")
    drawn = named.withColumnRenamed("label", "high").join(pair.filter("n_low is not null"), "high").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    ticket = F.xxhash64(*[F.col(k).cast("string") for k in keys], F.col("draw"), F.lit(seed))
    take = _smallest(drawn.withColumn("__t", ticket), ["high", "low", "draw"], F.least("n_low", "n_high"))
    per_draw = score(take.select(*keys, "high", "low", "draw"), ["high", "low", "draw"], "score")
    sub = per_draw.groupBy("high", "low").agg(F.avg("score").alias("score_high_subsampled_mean"), F.stddev_pop("score").alias("score_high_subsampled_std"))
    out = (pair.join(whole.select(F.col("label").alias("high"), F.col("score").alias("score_high_full")), "high", "left")
           .join(whole.select(F.col("label").alias("low"), F.col("score").alias("score_low_real")), "low", "left").join(sub, ["high", "low"], "left"))
    return out.select(
        F.col("high").alias("high_n_formation"), "n_high", "score_high_full", F.col("low").alias("low_n_formation"), "n_low", "score_low_real",
        "score_high_subsampled_mean", "score_high_subsampled_std",
        ratio("score_high_subsampled_mean", "score_low_real").alias("pct_patchiness_explained_by_n"),
        F.when(F.col("n_high").isNull() | F.col("n_low").isNull(), "label absent").alias("reason"))


def _smallest(rows: DataFrame, by: list[str], n) -> DataFrame:
    """The ``n`` smallest tickets of every group, found from ticket counts so
    that no group is sorted in one task.

    Tickets are cut into 4096 hash ranges. Ranges below the one in which the
    quota runs out are taken whole; only that range is ranked.
    """
    from pyspark.sql import Window

    ranged = rows.withColumn("__r", F.floor(F.pmod(F.shiftrightunsigned("__t", 20), F.lit(4096)))).withColumn("__n", n)
    ranged = ranged.withColumn("__t2", F.struct("__r", "__t"))
    counts = ranged.groupBy(*by, "__r").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    j = ranged.join(counts, by + ["__r"])
    rank = F.row_number().over(Window.partitionBy(*by, "__r").orderBy("__t"))
    return j.withColumn("__rank", rank + F.col("__before")).filter(F.col("__rank") <= F.col("__n"))
