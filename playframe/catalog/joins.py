"""Join queries: as-of, range, overlap, stamping, lookups, semi and anti."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.catalog import Catalog
from playframe.catalog.views import BALL, BALL_POINTS, EV, ORDER_SPANS, OWNED, PLAYERS, SPANS, r
from playframe.functions import stats
from playframe.functions.nulls import rounded
from playframe.operators import ordered as od
from playframe.operators import ranges
from playframe.plans import formations as fm
from playframe.session import materialize
from playframe.sources import tables

catalog = Catalog()
DAY = 86400.0
FRAME_BLOCK = 64.0


def closed_spans(spark, folder):
    """Order intervals with their end."""
    os = tables.order_spans(spark, folder)
    nxt = od.ordered(os, ["entity"], ["day", "ordinal"], 365.0, lead={"end_day": F.col("day")})
    return nxt.withColumn("end_day", F.coalesce("end_day", F.col("day") + 1))


@catalog.query("asof_forward", f"""
WITH {EV}, s AS (SELECT match_id, t, ordinal, value FROM ev WHERE is_shot),
g AS (SELECT match_id, ordinal, t FROM ev WHERE event_type = 'error'),
n AS (SELECT g.match_id, g.ordinal, min_by(s.ordinal, s.t) FILTER (WHERE s.t >= g.t) AS nxt, max_by(s.ordinal, s.t) AS last
  FROM g JOIN s ON g.match_id = s.match_id GROUP BY 1, 2)
SELECT match_id, ordinal, coalesce(nxt, last) AS hit FROM n""")
def asof_forward(spark, folder):
    """First shot at or after each error, the last shot past the end."""
    ev = tables.event_log(spark, folder)
    errors = ev.filter(F.col("event_type") == "error").select("match_id", "ordinal", "t")
    shots = ev.filter("is_shot").select("match_id", F.col("ordinal").alias("hit"), F.col("t").alias("shot_t"))
    return ranges.asof_forward(errors, shots, ["match_id"], "t", "shot_t", "hit", ["hit"], 5 * DAY).drop("t")


@catalog.query("range_join_statistics", f"""
WITH {BALL}, {SPANS}, j AS (SELECT s.match_id, s.poss_id, b.frame_idx, b.ball_x FROM spans s JOIN ball b
  ON s.match_id = b.match_id AND b.frame_idx BETWEEN s.start_frame AND s.end_frame),
g AS (SELECT match_id, poss_id, count(*) AS n_frames, avg(ball_x) AS mean, stddev_pop(ball_x) AS std, min(ball_x) AS lo, max(ball_x) AS hi,
  arg_min(ball_x, frame_idx) FILTER (WHERE ball_x IS NOT NULL) AS s, arg_max(ball_x, frame_idx) FILTER (WHERE ball_x IS NOT NULL) AS e
  FROM j GROUP BY 1, 2)
SELECT match_id, poss_id, n_frames, {r('mean', 'ball_x_mean')}, {r('std', 'ball_x_std')}, {r('lo', 'ball_x_min')}, {r('hi', 'ball_x_max')},
  {r('hi - lo', 'ball_x_range')}, {r('s', 'ball_x_start')}, {r('e', 'ball_x_end')}, {r('e - s', 'ball_x_change')} FROM g""")
def range_join_statistics(spark, folder):
    ball = tables.ball_track(spark, folder).select("match_id", "frame_idx", "ball_x")
    held = ranges.points_in_intervals(ball, tables.possession_spans(spark, folder), ["match_id"], "frame_idx",
                                      "start_frame", "end_frame", FRAME_BLOCK)
    g = held.groupBy("match_id", "poss_id").agg(F.count(F.lit(1)).alias("n_frames"), *stats.series_stats("ball_x", "ball_x", "frame_idx"))
    return g.select("match_id", "poss_id", "n_frames", *[rounded(f"ball_x_{s}").alias(f"ball_x_{s}") for s in stats.SUFFIXES])


@catalog.query("overlap_pick", f"""
WITH {ORDER_SPANS}, a AS (SELECT entity, ordinal, day - 30 AS s, end_day + 5 AS e FROM os WHERE status = 'F'),
b AS (SELECT entity, ordinal AS seg, day AS s, end_day AS e, label FROM os WHERE status <> 'F'),
p AS (SELECT a.entity, a.ordinal, b.seg, b.label, b.s, least(a.e, b.e) - greatest(a.s, b.s) AS overlap FROM a JOIN b
  ON a.entity = b.entity AND b.s < a.e AND b.e > a.s),
k AS (SELECT *, row_number() OVER (PARTITION BY entity, ordinal ORDER BY overlap DESC, s) AS rn FROM p)
SELECT entity, ordinal, label, {r('overlap', 'overlap')} FROM k WHERE rn = 1""")
def overlap_pick(spark, folder):
    os = materialize(closed_spans(spark, folder))
    a = os.filter(F.col("status") == "F").select("entity", "ordinal", (F.col("day") - 30).alias("a0"), (F.col("end_day") + 5).alias("a1"))
    b = os.filter(F.col("status") != "F").select("entity", F.col("day").alias("b0"), F.col("end_day").alias("b1"), "label")
    best = ranges.best_overlap(a, b, ["entity"], ("a0", "a1"), ("b0", "b1"), ["ordinal"], ["label"], 180.0)
    return best.withColumn("overlap", rounded("overlap"))


@catalog.query("owner_stamp", f"WITH {OWNED} SELECT match_id, frame_idx, team FROM own")
def owner_stamp(spark, folder):
    ball = tables.ball_track(spark, folder).select("match_id", "frame_idx")
    return ranges.stamp_last(ball, tables.possession_spans(spark, folder), ["match_id"], "frame_idx", "start_frame", "end_frame",
                             "poss_id", "team", FRAME_BLOCK)


@catalog.query("peak_value", f"""
WITH {OWNED}, v AS (SELECT *, CASE WHEN team = 'home' THEN ball_x ELSE -ball_x END / 100 AS signed FROM own WHERE team IS NOT NULL AND ball_x IS NOT NULL),
j AS (SELECT s.match_id, s.poss_id, s.team, max(CASE WHEN s.team = 'home' THEN v.signed ELSE -v.signed END) AS peak
  FROM spans s LEFT JOIN v ON s.match_id = v.match_id AND v.frame_idx BETWEEN s.start_frame AND s.end_frame
  WHERE s.end_frame - s.start_frame >= 6 GROUP BY 1, 2, 3)
SELECT match_id, poss_id, team, {r('coalesce(peak, 0.0)', 'peak_value')}, coalesce(peak, 0.0) >= 0.5 AS is_das FROM j""")
def peak_value(spark, folder):
    from playframe.plans.series import possession_peaks

    owned = owner_stamp_frames(spark, folder).filter(F.col("team").isNotNull() & F.col("ball_x").isNotNull())
    signed = owned.select("match_id", "frame_idx", (F.when(F.col("team") == "home", F.col("ball_x")).otherwise(-F.col("ball_x")) / 100).alias("signed"))
    spans = tables.possession_spans(spark, folder).withColumn("duration", F.col("end_frame") - F.col("start_frame"))
    peaks = possession_peaks(spans, signed, ["match_id"], "frame_idx", "start_frame", "end_frame", "signed", 0.5, 6, FRAME_BLOCK, ["poss_id"])
    return peaks.select("match_id", "poss_id", "team", rounded("peak_value").alias("peak_value"), "is_das")


def owner_stamp_frames(spark, folder):
    return ranges.stamp_last(tables.ball_track(spark, folder), tables.possession_spans(spark, folder), ["match_id"], "frame_idx",
                             "start_frame", "end_frame", "poss_id", "team", FRAME_BLOCK)


@catalog.query("left_merge", f"""
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), o AS (
SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY 1),
n AS (SELECT n_nationkey, n_name FROM nation)
SELECT c_custkey, n_name, coalesce(n_orders, 0) AS n_orders, {r('mean_price', 'touch_mean_price')} FROM c
LEFT JOIN o ON c_custkey = o_custkey LEFT JOIN n ON c_nationkey = n_nationkey""")
def left_merge(spark, folder):
    from playframe.plans.merge import means_by_key

    c = tables.table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    o = tables.table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey").withColumnRenamed("o_totalprice", "mean_price")
    agg = means_by_key(o, ["c_custkey"], ["mean_price"], "touch_").join(
        o.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n_orders")), "c_custkey")
    n = tables.table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = c.join(agg, "c_custkey", "left").join(n, "c_nationkey", "left")
    return j.select("c_custkey", "n_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), rounded("touch_mean_price").alias("touch_mean_price"))


@catalog.query("semi_join", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_join(spark, folder):
    o = tables.table(spark, folder, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey"))
    return tables.table(spark, folder, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left_semi")


@catalog.query("not_completed", f"""
WITH {EV} SELECT match_id, count(*) AS n_failed FROM ev WHERE is_pass AND NOT is_stop AND (CASE WHEN completed THEN 'C' END IS DISTINCT FROM 'C') GROUP BY 1""")
def not_completed(spark, folder):
    ev = tables.event_log(spark, folder).filter("is_pass AND NOT is_stop")
    outcome = F.when(F.col("completed"), "C")
    return ev.filter(~outcome.eqNullSafe(F.lit("C"))).groupBy("match_id").agg(F.count(F.lit(1)).alias("n_failed"))


@catalog.query("fallback_lookup", """
WITH a AS (SELECT l_orderkey AS k, min(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_orderkey AS k, min(l_shipdate) AS d FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey, coalesce(epoch_us(coalesce(a.d, b.d)), -1) AS first_us FROM orders LEFT JOIN a ON o_orderkey = a.k LEFT JOIN b ON o_orderkey = b.k""")
def fallback_lookup(spark, folder):
    """First key with a match wins: returned lines, else fulfilled lines."""
    li = tables.table(spark, folder, "lineitem")
    us = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    best = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min(F.when(F.col("l_returnflag") == "R", us)).alias("a"), F.min(F.when(F.col("l_linestatus") == "F", us)).alias("b"))
    o = tables.table(spark, folder, "orders").select("o_orderkey")
    return o.join(best, "o_orderkey", "left").select("o_orderkey", F.coalesce("a", "b", F.lit(-1)).alias("first_us"))


@catalog.query("score_lookup", f"""
WITH {EV} SELECT e.match_id, e.ordinal, coalesce(s.mean_disp > 2.0, false) AS over_mean FROM ev e
LEFT JOIN (SELECT match_id, ordinal, mean_disp FROM ev WHERE completed AND value < 200) s
ON e.match_id = s.match_id AND e.ordinal = s.ordinal WHERE e.is_pass""")
def score_lookup(spark, folder):
    ev = tables.event_log(spark, folder)
    scores = ev.filter(F.col("completed") & (F.col("value") < 200)).select("match_id", "ordinal", F.col("mean_disp").alias("score"))
    j = ev.filter("is_pass").select("match_id", "ordinal").join(scores, ["match_id", "ordinal"], "left")
    return j.select("match_id", "ordinal", F.coalesce(F.col("score") > 2.0, F.lit(False)).alias("over_mean"))


@catalog.query("decay_weights", f"""
WITH {EV}, d AS (SELECT match_id, t AS s, t + 86400 AS e FROM ev WHERE event_type = 'error'),
j AS (SELECT v.match_id, v.ordinal, greatest(least((v.t - d.s) / (d.e - d.s), 1.0), 0.0) AS w FROM ev v JOIN d
  ON v.match_id = d.match_id AND v.t BETWEEN d.s AND d.e)
SELECT match_id, ordinal, {r('product(w)', 'weight')} FROM j GROUP BY 1, 2""")
def decay_weights(spark, folder):
    ev = tables.event_log(spark, folder)
    breaks = ev.filter(F.col("event_type") == "error").select("match_id", F.col("t").alias("s"), (F.col("t") + 86400).alias("e"))
    held = ranges.points_in_intervals(ev.select("match_id", "ordinal", "t"), breaks, ["match_id"], "t", "s", "e", DAY)
    w = fm.ramp(F.col("t"), F.col("s"), F.col("e"))
    return held.groupBy("match_id", "ordinal").agg(rounded(fm.product(w)).alias("weight"))


@catalog.query("window_confidence", f"""
WITH {ORDER_SPANS}, f AS (SELECT *, CASE WHEN lag(status) OVER w <> status THEN 1 ELSE 0 END AS chg FROM os WINDOW w AS (PARTITION BY entity ORDER BY day, ordinal)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY entity ORDER BY day, ordinal ROWS UNBOUNDED PRECEDING) AS island FROM f),
g AS (SELECT entity, island, min(day) AS s, arg_max(end_day, (day, ordinal)) AS e FROM i GROUP BY 1, 2)
SELECT g.entity, g.island::BIGINT AS island, {r('avg(o.price)', 'mean_confidence')} FROM g JOIN os o ON g.entity = o.entity AND o.day >= g.s AND o.end_day <= g.e
GROUP BY 1, 2""")
def window_confidence(spark, folder):
    """Mean of the intervals that lie inside a run."""
    os = closed_spans(spark, folder)
    runs = od.islands(os, ["entity"], ["day", "ordinal"], "status", 365.0)
    g = runs.groupBy("entity", "island").agg(F.min("day").alias("s"), F.max_by("end_day", F.struct("day", "ordinal")).alias("e"))
    inside = ranges.points_in_intervals(os.select("entity", "day", "end_day", "price"), g, ["entity"], "day", "s", "e", 365.0)
    return inside.filter(F.col("end_day") <= F.col("e")).groupBy("entity", "island").agg(rounded(F.avg("price")).alias("mean_confidence"))


@catalog.query("snapshot_moves", f"""
WITH {PLAYERS}, p AS (SELECT match_id, frame_idx, side, player_rank, x * 1.0137 AS x, y * 1.0137 AS y FROM pl WHERE x IS NOT NULL),
j AS (SELECT a.match_id, a.frame_idx, a.side, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM p a JOIN p b
  ON a.match_id = b.match_id AND b.frame_idx = a.frame_idx + 1 AND a.side = b.side AND a.player_rank = b.player_rank)
SELECT match_id, frame_idx, side, count(*) AS n_valid, {r('avg(d)', 'mean_disp')}, {r('quantile_cont(d, 0.5)', 'median_disp')}, {r('max(d)', 'max_disp')},
  {r('min(d)', 'min_disp')}, {r('stddev_pop(d)', 'std_disp')}, count(*) FILTER (WHERE d > 5) AS n_above_5m
FROM j GROUP BY 1, 2, 3 HAVING count(*) >= 4""")
def snapshot_moves(spark, folder):
    """Displacement of the players of a side seen in both of two consecutive frames."""
    from playframe.plans.movement import displacement_stats

    # the factor keeps distances off the whole metres that the counts compare with
    def scaled(side):
        return F.transform(side, lambda p: F.struct(p["pid"].alias("pid"), (p["x"] * 1.0137).alias("x"), (p["y"] * 1.0137).alias("y")))

    sides = F.array(*[F.struct(F.lit(s).alias("side"), scaled(s).alias("before")) for s in ("home", "away")])
    f = tables.frames(spark, folder).select("match_id", "frame_idx", F.explode(sides).alias("e")).select("match_id", "frame_idx", "e.*")
    nxt = f.select("match_id", (F.col("frame_idx") - 1).alias("frame_idx"), "side", F.col("before").alias("after"))
    j = f.join(nxt, ["match_id", "frame_idx", "side"])
    s = displacement_stats(F.col("before"), F.col("after"), "pid")
    out = j.withColumn("s", s).filter(F.col("s.n_valid") >= 4)
    return out.select("match_id", "frame_idx", "side", F.col("s.n_valid").cast("bigint").alias("n_valid"),
                      *[rounded(F.col(f"s.{c}")).alias(c) for c in ("mean_disp", "median_disp", "max_disp", "min_disp", "std_disp")],
                      F.col("s.n_above_5m").cast("bigint").alias("n_above_5m"))


@catalog.query("union_by_name", """
SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL BY NAME SELECT 'supplier' AS source, s_suppkey AS key, s_acctbal AS balance FROM supplier""")
def union_by_name(spark, folder):
    c = tables.table(spark, folder, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("key"),
                                                       F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = tables.table(spark, folder, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@catalog.query("common_ids", """
SELECT c.c_nationkey AS nation, count(*) AS n_common FROM (SELECT DISTINCT c_nationkey, c_custkey % 50 AS k FROM customer) c
JOIN (SELECT DISTINCT s_nationkey, s_suppkey % 50 AS k FROM supplier) s ON c_nationkey = s_nationkey AND c.k = s.k GROUP BY 1""")
def common_ids(spark, folder):
    """Size of the intersection of two id sets per key."""
    c = tables.table(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 50).alias("k")).distinct()
    s = tables.table(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 50).alias("k")).distinct()
    return c.join(s, ["nation", "k"]).groupBy("nation").agg(F.count(F.lit(1)).alias("n_common"))


@catalog.query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_rows(spark, folder):
    return tables.table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@catalog.query("nearest_valid_frame", f"""
WITH {BALL}, t AS (SELECT match_id, frame_idx FROM ball WHERE ball_x IS NULL),
j AS (SELECT t.match_id, t.frame_idx, b.frame_idx - t.frame_idx AS off FROM t JOIN ball b ON t.match_id = b.match_id
  AND b.frame_idx BETWEEN t.frame_idx - 25 AND t.frame_idx + 25 AND b.ball_x IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, frame_idx ORDER BY abs(off), off < 0) AS rn FROM j)
SELECT match_id, frame_idx, frame_idx + off AS hit FROM k WHERE rn = 1""")
def nearest_valid_frame(spark, folder):
    """Closest frame with a ball around frames without one, later frames
    first."""
    from playframe.plans.resolve import nearest_ball_frame

    ball = tables.ball_track(spark, folder)
    anchors = ball.filter(F.col("ball_x").isNull()).select("match_id", "frame_idx")
    return nearest_ball_frame(anchors, ball, ["match_id", "frame_idx"], "frame_idx", 25)
