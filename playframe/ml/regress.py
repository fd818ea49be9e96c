"""Prediction of map components and scalar targets with boosted trees."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from playframe.functions.nulls import ratio
from playframe.ml import boosting
from playframe.ml.boosting import Boosting


def model_kinds(cfg: Boosting) -> dict[str, Boosting]:
    """The two kinds of model: trees that see all rows and features, and trees
    that each see nine tenths of both."""
    return {"histogram": cfg, "sampled": replace(cfg, row_share=0.9, column_share=0.9)}


def group_split(df: DataFrame, group: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows split by whole groups: those whose hash lies in the
    lower ``share`` of all values are the test set, one group at least."""
    from playframe.ml.clusters import below_share

    ids = df.select(group).distinct()
    tagged = ids.withColumn("__test", below_share(ids, F.xxhash64(F.col(group).cast("string"), F.lit(seed)), share))
    j = df.join(tagged, group)
    return j.filter("NOT __test").drop("__test"), j.filter("__test").drop("__test")


def scores(predicted: DataFrame, truth: str, guess: str, keys: list[str] | None = None) -> DataFrame:
    """R squared, root mean squared error and mean absolute error."""
    t, p = F.col(truth), F.col(guess)
    err = t - p
    known = predicted.filter(t.isNotNull() & p.isNotNull())
    g = known.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(err * err).alias("__sq"), F.sum(F.abs(err)).alias("__ab"), (F.var_pop(t) * F.count(t)).alias("__ss"))
    return g.select(*(keys or []), "n", (1 - ratio("__sq", "__ss")).alias("r2"), F.sqrt(F.col("__sq") / F.col("n")).alias("rmse"),
                    (F.col("__ab") / F.col("n")).alias("mae"))


def map_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Scores of predicted maps in one row: over all cells, of the mean of each
    map, and the mean and median of the scores per cell. Cells that hardly vary
    have no score."""
    from playframe.operators.quantiles import exact_quantiles

    cells = df.select(F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(guess).alias("p"))).alias("cell", "z")).select("cell", "z.t", "z.p")
    overall = scores(cells, "t", "p").select(F.col("r2").alias("overall_r2"), F.col("rmse").alias("overall_rmse"), F.col("mae").alias("overall_mae"))
    def mean(c: str):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    means = scores(df.select(mean(truth).alias("t"), mean(guess).alias("p")), "t", "p").select(F.col("r2").alias("mean_r2"), F.col("rmse").alias("mean_rmse"))
    flat = cells.groupBy("cell").agg(F.stddev_pop("t").alias("sd"))
    per = scores(cells, "t", "p", ["cell"]).join(flat.filter(F.col("sd") >= 1e-6), "cell")
    cell = per.agg(F.avg("r2").alias("cell_r2_mean")).withColumn("__k", F.lit(1))
    median = exact_quantiles(per.withColumn("__k", F.lit(1)), ["__k"], "r2", [0.5]).select("__k", F.get("q", F.lit(0)).alias("cell_r2_median"))
    one = overall.withColumn("__k", F.lit(1)).join(means.withColumn("__k", F.lit(1)), "__k")
    return one.join(cell, "__k").join(median, "__k", "left").drop("__k")


def predict_map(train: DataFrame, test: DataFrame, vector: str, maps: str, n_components: int, cfg: Boosting, group: str = "match_id",
                out: str = "predicted") -> DataFrame:
    """Predict maps through their principal scores, with one booster for all
    components. ``{out}_scores`` are the predicted scores and ``{out}_truth``
    those of the true maps. If the fit fails, every component is its training
    mean and ``{out}_errors`` holds the error; else that column is null."""
    from playframe.ml.linear import fit_components

    comps = fit_components(train, maps, n_components)
    try:
        model = boosting.fit(comps.scores(train, maps, "__s"), "__s", vector, cfg, group if group in train.columns else None)
        guess, error = model.predict(test, vector, f"{out}_scores"), None
    except Exception as ex:  # noqa: BLE001 - reported in the result
        zeros = F.lit([0.0] * len(comps.loadings)).cast("array<double>")  # scores are centred
        guess, error = test.withColumn(f"{out}_scores", zeros), f"{type(ex).__name__}: {ex}"
    both = comps.scores(comps.restore(guess, f"{out}_scores", out), maps, f"{out}_truth")
    return both.withColumn(f"{out}_errors", F.lit(error).cast("string"))


def component_scores(predicted: DataFrame, out: str = "predicted") -> DataFrame:
    """Scores per component of what ``predict_map`` gives."""
    pair = F.arrays_zip(F.col(f"{out}_truth").alias("t"), F.col(f"{out}_scores").alias("p"))
    return scores(predicted.select(F.posexplode(pair).alias("i", "z")).select((F.col("i") + 1).alias("pc"), "z.t", "z.p"), "t", "p", ["pc"])


def predict_scalars(train: DataFrame, test: DataFrame, targets: list[str], feature_sets: dict[str, str], cfg: Boosting, threads: int = 6,
                    group: str = "match_id") -> DataFrame:
    """Scores per target, kind of model and feature set; ``feature_sets`` maps a
    set to its column of feature arrays. Failures are reported as rows with an error."""
    own = group if group in train.columns else None

    def one(job):
        target, kind, settings, name = job
        try:
            known = train.withColumn("__y", F.array(F.col(target).cast("double")))
            model = boosting.fit(known, "__y", feature_sets[name], settings, own)
            guess = model.predict(test, feature_sets[name], "__p").withColumn("prediction", F.get("__p", F.lit(0)))
            s = scores(guess, target, "prediction").first()
            n_train = train.filter(F.col(target).isNotNull()).count()
            return target, kind, name, n_train, s.n, s.r2, s.rmse, s.mae, None
        except Exception as ex:  # noqa: BLE001 - reported in the result
            return target, kind, name, None, None, None, None, None, f"{type(ex).__name__}: {ex}"

    jobs = [(t, kind, settings, n) for t in targets for kind, settings in model_kinds(cfg).items() for n in feature_sets]
    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(one, jobs))
    return train.sparkSession.createDataFrame(
        rows, "target string, model string, cat string, n_train long, n_test long, r2 double, rmse double, mae double, error string")


def score_table(results: DataFrame, value: str = "r2") -> DataFrame:
    """Targets by (model, set)."""
    tagged = results.withColumn("key", F.concat_ws(" ", "cat", "model"))
    return tagged.groupBy("target").pivot("key").agg(F.first(value))


def mean_map_baseline(train: DataFrame, test: DataFrame, maps: str, out: str = "predicted") -> DataFrame:
    """The mean training map as the guess for every test row."""
    from playframe.ml.prepare import array_moments

    mean, _ = array_moments(train, maps)
    return test.withColumn(out, F.lit(mean.tolist()))


def filled_maps(df: DataFrame, maps: str, size: int) -> DataFrame:
    """Maps with missing cells at one half; rows whose map has no value at all
    or a wrong length are flagged invalid."""
    m = F.col(maps).cast("array<double>")
    clean = F.transform(m, lambda v: F.when(~F.isnan(v), v))
    valid = (F.size(m) == size) & F.exists(clean, lambda v: v.isNotNull())
    half = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.lit(0.5))
    filled = F.when(F.size(m) == size, F.transform(clean, lambda v: F.coalesce(v, F.lit(0.5)))).otherwise(half)
    return df.withColumns({maps: filled, "map_valid": F.coalesce(valid, F.lit(False))})
