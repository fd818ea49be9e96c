"""Analysis queries: scaling, components, clusters, importance, prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.catalog import Catalog
from playframe.catalog.views import VEC, r
from playframe.functions.nulls import rounded
from playframe.ml import clusters, linear, prepare, regress
from playframe.sources import tables

catalog = Catalog()
DIM = 64
_LONG = "l AS (SELECT id, label, i - 1 AS i, f[i] AS v FROM vec, (SELECT unnest(generate_series(1, 64)) AS i))"


@catalog.query("eta_squared", f"""
WITH {VEC}, {_LONG}, m AS (SELECT i, avg(v) AS mu FROM l GROUP BY 1),
g AS (SELECT i, label, count(*) AS n, avg(v) AS gm FROM l GROUP BY 1, 2),
b AS (SELECT i, sum(n * (gm - mu) ** 2) AS ssb FROM g JOIN m USING (i) GROUP BY 1),
t AS (SELECT i, sum((v - mu) ** 2) AS sst FROM l JOIN m USING (i) GROUP BY 1)
SELECT i::INT AS i, {r('ssb / sst', 'eta_squared')} FROM b JOIN t USING (i)""")
def eta_squared(spark, folder):
    e = clusters.eta_squared(tables.vectors(spark, folder), "label", "features")
    return e.select("i", rounded("eta_squared").alias("eta_squared"))


@catalog.query("group_importance", f"""
WITH {VEC}, {_LONG}, m AS (SELECT i, avg(v) AS mu FROM l GROUP BY 1),
g AS (SELECT i, label, count(*) AS n, avg(v) AS gm FROM l GROUP BY 1, 2),
b AS (SELECT i, sum(n * (gm - mu) ** 2) AS ssb FROM g JOIN m USING (i) GROUP BY 1),
t AS (SELECT i, sum((v - mu) ** 2) AS sst FROM l JOIN m USING (i) GROUP BY 1)
SELECT CASE WHEN i % 3 = 0 THEN 'width' WHEN i % 3 = 1 THEN 'depth' ELSE 'other' END AS "group", {r('avg(ssb / sst)', 'eta_squared')} FROM b JOIN t USING (i) GROUP BY 1""")
def group_importance(spark, folder):
    names = [f"f{i}" for i in range(DIM)]
    groups = {n: ("width", "depth", "other")[i % 3] for i, n in enumerate(names)}
    e = clusters.eta_squared(tables.vectors(spark, folder), "label", "features", names)
    return clusters.group_importance(e, groups).withColumn("eta_squared", rounded("eta_squared"))


@catalog.query("adjusted_rand", f"""
WITH c AS (SELECT quality, toxic, count(*)::DOUBLE AS n FROM labels GROUP BY 1, 2),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS pairs, (SELECT sum(n) FROM c) AS n,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY quality)) AS sa, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY toxic)) AS sb)
SELECT {r('(pairs - sa * sb / (n * (n - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (n * (n - 1) / 2))', 'ari')} FROM s""")
def adjusted_rand(spark, folder):
    a = clusters.contingency_ari(tables.table(spark, folder, "labels"), "quality", "toxic")
    return a.select(rounded("ari").alias("ari"))


@catalog.query("standard_scores", f"""
WITH {VEC}, {_LONG} SELECT id, i::INT AS i, {r('(v - avg(v) OVER (PARTITION BY i)) / stddev_pop(v) OVER (PARTITION BY i)', 'z')} FROM l""")
def standard_scores(spark, folder):
    names = [f"f{i}" for i in range(DIM)]
    v = tables.vectors(spark, folder).select("id", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])
    s = prepare.scaled_vector(v, prepare.fit_scaling(v, names), names)
    return s.select("id", F.posexplode("features").alias("i", "z")).withColumn("z", rounded("z"))


@catalog.query("peak_scaled_map", f"""
WITH {VEC}, {_LONG}, s AS (SELECT max(sd) AS peak FROM (SELECT stddev_pop(v) AS sd FROM l GROUP BY i))
SELECT id, i::INT AS i, {r('(v - avg(v) OVER (PARTITION BY i)) / (SELECT peak FROM s)', 'z')} FROM l""")
def peak_scaled_map(spark, folder):
    """Map blocks share one divisor: the deviation of the busiest cell."""
    v = tables.vectors(spark, folder).select("id", F.col("features").alias("rec"))
    s = prepare.scaled_vector(v, prepare.fit_scaling(v, [], {"rec": "recurrence_map"}), [])
    return s.select("id", F.posexplode("features").alias("i", "z")).withColumn("z", rounded("z"))


@catalog.query("group_weights", f"""
WITH {VEC}, {_LONG}, z AS (SELECT id, i, (v - avg(v) OVER (PARTITION BY i)) / stddev_pop(v) OVER (PARTITION BY i) AS z FROM l),
g AS (SELECT CASE WHEN i < 40 THEN 40 ELSE 24 END AS n, * FROM z)
SELECT id, i::INT AS i, {r('z * sqrt(n ** 0.5 / n)', 'w')} FROM g""")
def group_weights(spark, folder):
    """Two groups of 40 and 24 features, each brought to the square root
    of its total variance."""
    names = [f"width_{i}" for i in range(40)] + [f"depth_{i}" for i in range(24)]
    v = tables.vectors(spark, folder).select("id", *[F.get("features", F.lit(i)).alias(n) for i, n in enumerate(names)])
    scaling = prepare.fit_scaling(v, names)
    s = prepare.scaled_vector(v, scaling, names, scaling.group_weights(0.5, set()))
    return s.select("id", F.posexplode("features").alias("i", "w")).withColumn("w", rounded("w"))


@catalog.query("median_imputation", f"""
WITH v AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT event_id, {r('coalesce(value, (SELECT quantile_cont(value, 0.5) FROM v))', 'value')} FROM v""")
def median_imputation(spark, folder):
    e = tables.table(spark, folder, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    return prepare.impute_medians(e, ["value"]).withColumn("value", rounded("value"))


@catalog.query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, avg(({c} IS NULL)::INT) + 0.0 AS null_share, count(DISTINCT {c}) AS n_distinct FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")))
def null_profile(spark, folder):
    return prepare.null_profile(tables.table(spark, folder, "orders"))


@catalog.query("usable_features", """
SELECT * FROM (SELECT 'value' AS feature, avg((CASE WHEN event_type <> 'error' THEN value END IS NULL)::INT) < 0.6 AS ok FROM events
UNION ALL SELECT 'rare', avg((CASE WHEN event_type = 'error' THEN value END IS NULL)::INT) < 0.6 FROM events) WHERE ok""")
def usable_features(spark, folder):
    """Columns with too many nulls or without variation drop out."""
    e = tables.table(spark, folder, "events").select(
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"), F.when(F.col("event_type") == "error", F.col("value")).alias("rare"),
        F.lit(1.0).alias("constant"))
    kept = prepare.usable_columns(e, e.columns)
    return spark.createDataFrame([(c, True) for c in kept], "feature string, ok boolean")


@catalog.query("one_hot", """
SELECT o_orderkey, (o_orderpriority = '2-HIGH')::TINYINT AS "fmt_o_orderpriority_2-HIGH", (o_orderpriority = '3-MEDIUM')::TINYINT AS "fmt_o_orderpriority_3-MEDIUM",
  (o_orderpriority = '4-NOT SPECIFIED')::TINYINT AS "fmt_o_orderpriority_4-NOT SPECIFIED", (o_orderpriority = '5-LOW')::TINYINT AS "fmt_o_orderpriority_5-LOW" FROM orders""")
def one_hot(spark, folder):
    o = tables.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    d, names = prepare.one_hot(o, "o_orderpriority")
    return d.select("o_orderkey", *[F.col(f"`{n}`") for n in names])


@catalog.query("cluster_profile", f"""
WITH {VEC} SELECT label, {', '.join(f'round(avg(f[{i + 1}]) * 100, 6) + 0.0 AS f{i}' for i in range(DIM))}, count(*) AS n_phases FROM vec GROUP BY 1""")
def cluster_profile(spark, folder):
    names = [f"f{i}" for i in range(DIM)]
    v = tables.vectors(spark, folder).select("label", *[(F.get("features", F.lit(i)) * 100).alias(n) for i, n in enumerate(names)])
    return clusters.profile(v, "label", names, 6).select("label", *[rounded(n).alias(n) for n in names], "n_phases")


@catalog.query("regression_scores", f"""
WITH m AS (SELECT event_type, avg(value) AS guess FROM events GROUP BY 1), e AS (SELECT user_id % 10 AS grp, value, guess FROM events JOIN m USING (event_type)),
a AS (SELECT grp, count(*) AS n, sum((value - guess) ** 2) AS sq, sum(abs(value - guess)) AS ab, var_pop(value) * count(*) AS ss FROM e GROUP BY 1)
SELECT grp, n, {r('1 - sq / ss', 'r2')}, {r('sqrt(sq / n)', 'rmse')}, {r('ab / n', 'mae')} FROM a""")
def regression_scores(spark, folder):
    e = tables.table(spark, folder, "events").select("event_type", (F.col("user_id") % 10).alias("grp"), "value")
    m = e.groupBy("event_type").agg(F.avg("value").alias("guess"))
    s = regress.scores(e.join(m, "event_type"), "value", "guess", ["grp"])
    return s.select("grp", "n", *[rounded(c).alias(c) for c in ("r2", "rmse", "mae")])


@catalog.query("territory_residual", f"""
WITH {VEC}, {_LONG}, j AS (SELECT l.id, l.i, l.v, a.v AS x FROM l JOIN l a ON l.id = a.id AND a.i = 0),
b AS (SELECT i, regr_slope(v, x) AS slope, regr_intercept(v, x) AS icept FROM j GROUP BY 1)
SELECT id, i::INT AS i, {r('v - icept - slope * x', 'v')} FROM j JOIN b USING (i)""")
def territory_residual(spark, folder):
    v = tables.vectors(spark, folder).select("id", F.col("features").alias("f"))
    res = prepare.residual_on(v, "f", [0], "f")
    return res.select("id", F.posexplode("f").alias("i", "v")).withColumn("v", rounded("v"))


@catalog.query("component_variance")
def component_variance(spark, folder):
    v = tables.vectors(spark, folder)
    t = linear.fit_components(v, "features").table(v)
    return t.select("pc", *[rounded(c).alias(c) for c in ("variance", "ratio", "cumulative")])


@catalog.query("component_moments", f"""
WITH {VEC}, x AS (SELECT id, unnest(f) AS v, unnest(range(len(f))) AS i FROM vec), m AS (SELECT i, avg(v) AS m FROM x GROUP BY 1),
d AS (SELECT id, i, v - m AS v FROM x JOIN m USING (i)),
c AS (SELECT a.i, b.i AS j, sum(a.v * b.v) / (SELECT count(*) - 1 FROM vec) AS c FROM d a JOIN d b USING (id) GROUP BY 1, 2)
SELECT count(*) FILTER (WHERE i = j) AS n, {r('sum(c) FILTER (WHERE i = j)', 'trace')}, {r('sum(c * c)', 'squares')}, {r('1.0::DOUBLE', 'total_ratio')} FROM c""")
def component_moments(spark, folder):
    """The variances of all components add up to the trace of the covariance,
    their squares to its sum of squares, their shares to one."""
    v = tables.vectors(spark, folder)
    t = linear.fit_components(v, "features").table(v)
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum("variance").alias("trace"), F.sum(F.col("variance") * F.col("variance")).alias("squares"),
                 F.sum("ratio").alias("total_ratio")).select("n", *[rounded(c).alias(c) for c in ("trace", "squares", "total_ratio")])


@catalog.query("component_scores")
def component_scores(spark, folder):
    """First four principal scores, from square roots of shifted values."""
    v = tables.vectors(spark, folder).withColumn("root", F.transform("features", lambda x: F.sqrt(F.abs(x))))
    s = linear.fit_components(v, "root", 4).scores(v, "root", "s")
    return s.select("id", *[rounded(F.get("s", F.lit(i))).alias(f"PC{i + 1}") for i in range(4)])


@catalog.query("restored_error", f"""
WITH {VEC}, {_LONG} SELECT count(DISTINCT id) AS n, 0.0::DOUBLE AS error FROM l""")
def restored_error(spark, folder):
    """All components together restore the vectors."""
    v = tables.vectors(spark, folder)
    c = linear.fit_components(v, "features")
    back = c.restore(c.scores(v, "features", "s"), "s", "b")
    gap = F.aggregate(F.zip_with("features", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, d: F.greatest(a, d))
    return back.agg(F.count(F.lit(1)).alias("n"), rounded(F.max(gap)).alias("error"))


@catalog.query("kmeans_sweep")
def kmeans_sweep(spark, folder):
    v = tables.vectors(spark, folder)
    _, t = clusters.sweep(v, [2, 3], "features", ["id"], n_init=1, repeats=1)
    return t.select("k", *[rounded(c).alias(c) for c in ("silhouette", "inertia", "stability_ari_mean", "stability_ari_std")])


@catalog.query("cluster_assignments")
def cluster_assignments(spark, folder):
    v = tables.vectors(spark, folder)
    return clusters.best_kmeans(v, 4, 2).assign(v, "features", "cluster_k4").select("id", "cluster_k4")


@catalog.query("label_silhouette", f"""
WITH {VEC}, d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.f, b.f) ** 2) AS s, count(*) AS n FROM vec a, vec b GROUP BY 1, 2, 3),
i AS (SELECT id, s / (n - 1) AS inside FROM d WHERE label = other), o AS (SELECT id, min(s / n) AS outside FROM d WHERE label <> other GROUP BY 1)
SELECT round(avg((outside - inside) / greatest(outside, inside)), 6) + 0.0 AS silhouette FROM i JOIN o USING (id)""")
def label_silhouette(spark, folder):
    """Silhouette of the given labels over all rows."""
    s = clusters.silhouette(tables.vectors(spark, folder), "label", "features")
    return spark.createDataFrame([(s,)], "silhouette double").select(rounded("silhouette").alias("silhouette"))


@catalog.query("grouped_split", f"WITH {VEC} SELECT true AS disjoint, count(*) AS n, count(DISTINCT id % 20) AS groups FROM vec")
def grouped_split(spark, folder):
    """Train and test rows together are all rows and share no match."""
    a, b = regress.group_split(tables.vectors(spark, folder), "match_id", 0.2)
    both = a.select("id", "match_id", F.lit(0).alias("t")).union(b.select("id", "match_id", F.lit(1).alias("t")))
    per = both.groupBy("match_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("sides"))
    return per.agg((F.max("sides") == 1).alias("disjoint"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))


_BOOST = regress.Boosting(rounds=5, depth=3, min_leaf=10)


@catalog.query("scalar_prediction")
def scalar_prediction(spark, folder):
    v = tables.vectors(spark, folder).select("id", "match_id", F.col("label").cast("double").alias("target"), F.col("features").alias("vec"))
    train, test = regress.group_split(v, "match_id", 0.2)
    t = regress.predict_scalars(train, test, ["target"], {"Cat 1": "vec"}, _BOOST)
    return t.select("target", "model", "cat", "n_train", "n_test", rounded("r2", 4).alias("r2"), rounded("rmse", 4).alias("rmse"))


@catalog.query("map_prediction")
def map_prediction(spark, folder):
    """Maps predicted through two components, next to the mean-map baseline."""
    v = tables.vectors(spark, folder).select("id", "match_id", F.slice("features", 1, 32).alias("map"), F.slice("features", 33, 32).alias("vec"))
    train, test = regress.group_split(v, "match_id", 0.2)
    guess = regress.map_scores(regress.predict_map(train, test, "vec", "map", 2, _BOOST), "map", "predicted")
    base = regress.map_scores(regress.mean_map_baseline(train, test, "map"), "map", "predicted")
    both = guess.withColumn("model", F.lit("boosted")).unionByName(base.withColumn("model", F.lit("baseline")))
    return both.select("model", *[rounded(c, 4).alias(c) for c in ("overall_r2", "overall_rmse", "overall_mae", "mean_r2", "cell_r2_median")])


@catalog.query("filled_maps", f"""
WITH {VEC}, {_LONG} SELECT id, i::INT AS i, {r('CASE WHEN v > 0 THEN v ELSE 0.5 END', 'v')} FROM l""")
def filled_maps(spark, folder):
    """Missing cells of a map become one half."""
    holes = F.transform("features", lambda x: F.when(x > 0, x).otherwise(F.lit(float("nan"))))
    v = tables.vectors(spark, folder).select("id", holes.alias("map"))
    f = regress.filled_maps(v, "map", DIM)
    return f.select("id", F.posexplode("map").alias("i", "v")).withColumn("v", rounded("v"))


_PRIORITIES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}


@catalog.query("score_table", "SELECT o_orderstatus AS target, " + ", ".join(
    f"round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '{k}'), 4) + 0.0 AS {v}" for k, v in _PRIORITIES.items()) + " FROM orders GROUP BY 1")
def score_table(spark, folder):
    o = tables.table(spark, folder, "orders").groupBy(F.col("o_orderstatus").alias("target"), "o_orderpriority").agg(rounded(F.avg("o_totalprice"), 4).alias("r2"))
    cat = F.lit(None).cast("string")
    for k, v in _PRIORITIES.items():
        cat = F.when(F.col("o_orderpriority") == k, v).otherwise(cat)
    t = regress.score_table(o.select("target", F.lit("m").alias("model"), cat.alias("cat"), "r2"))
    return t.select("target", *[F.col(f"{v} m").alias(v) for v in _PRIORITIES.values()])
