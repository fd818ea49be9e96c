"""Event-log queries: segmentation, votes, counts and ordered statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.catalog import Catalog
from playframe.catalog.views import BALL_POINTS, EV, ORDER_SPANS, r
from playframe.functions import stats
from playframe.functions.nulls import ratio, rounded
from playframe.operators import ordered as od
from playframe.operators import segments
from playframe.operators.quantiles import exact_quantiles
from playframe.sources import tables

catalog = Catalog()
DAY = 86400.0
MAX_PASSES, MAX_SECONDS = 3, 172800.0
MATCH, SEQ = ["match_id"], ["sequence_id"]

_SEGMENTS = f"""
WITH RECURSIVE {EV},
marked AS (
  SELECT *, count(*) FILTER (WHERE is_stop) OVER (PARTITION BY match_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS stops,
    CASE WHEN completed AND mean_disp > 2.0 AND max_disp > 4.0 THEN 'threshold_both'
         WHEN completed AND mean_disp > 2.0 THEN 'threshold_mean'
         WHEN completed AND max_disp > 4.0 THEN 'threshold_max'
         WHEN is_pass AND NOT completed THEN 'failed_pass'
         WHEN is_shot THEN 'shot' END AS reason
  FROM ev),
play AS (
  SELECT *, row_number() OVER w AS rn, stops > lag(stops) OVER w AS brk, count(*) OVER (PARTITION BY match_id) AS n_rows
  FROM marked WHERE NOT is_stop WINDOW w AS (PARTITION BY match_id ORDER BY t, ordinal)),
walk AS (
  SELECT match_id, rn, ordinal, t, ordinal AS wfirst, t AS wstart, completed::INT AS passes, completed, n_rows,
         coalesce(reason, CASE WHEN completed::INT >= {MAX_PASSES} THEN 'max_passes' END) AS why
  FROM play WHERE rn = 1
  UNION ALL
  SELECT p.match_id, p.rn, p.ordinal, p.t,
    CASE WHEN p.brk OR w.why IS NOT NULL THEN p.ordinal ELSE w.wfirst END,
    CASE WHEN p.brk OR w.why IS NOT NULL THEN p.t ELSE w.wstart END,
    CASE WHEN p.brk OR w.why IS NOT NULL THEN 0 ELSE w.passes END + p.completed::INT, p.completed, p.n_rows,
    coalesce(p.reason,
      CASE WHEN CASE WHEN p.brk OR w.why IS NOT NULL THEN 0 ELSE w.passes END + p.completed::INT >= {MAX_PASSES} THEN 'max_passes'
           WHEN p.t - CASE WHEN p.brk OR w.why IS NOT NULL THEN p.t ELSE w.wstart END > {MAX_SECONDS} THEN 'max_time' END)
  FROM walk w JOIN play p ON p.match_id = w.match_id AND p.rn = w.rn + 1),
phases AS (
  SELECT match_id, wfirst AS first_ordinal, count(*) AS n_events, count(*) FILTER (WHERE completed) AS n_passes,
    max(t) - min(t) AS duration,
    coalesce(arg_max(why, rn) FILTER (WHERE why IS NOT NULL),
             CASE WHEN max(rn) < max(n_rows) THEN 'stoppage_break' ELSE 'sequence_end' END) AS reason_closed
  FROM walk GROUP BY 1, 2)
"""


def _phases(spark, folder, **kw):
    ev = tables.event_log(spark, folder)
    reason = segments.local_reason(
        F.col("is_pass"), F.col("completed"), F.col("is_shot"), F.col("mean_disp"), F.col("max_disp"), 2.0, 4.0
    )
    shared = dict(time="t", ordinal="ordinal", reason="reason", counted="completed",
                  max_passes=MAX_PASSES, max_seconds=MAX_SECONDS)
    assigned = segments.assign_windows(
        ev.select("match_id", "sequence_id", "ordinal", "t", "is_stop", "completed", reason.alias("reason")),
        MATCH, SEQ, stop="is_stop", width=5 * DAY, **shared, **kw,
    )
    return segments.summarise_windows(assigned, MATCH, SEQ, **shared)


@catalog.query("phase_segments", _SEGMENTS + f"""
SELECT match_id, first_ordinal, n_events, n_passes, {r('duration', 'duration')}, reason_closed FROM phases""")
def phase_segments(spark, folder):
    return _phases(spark, folder).select(
        "match_id", "first_ordinal", "n_events", F.col("n_passes_in_window").alias("n_passes"),
        rounded("duration").alias("duration"), "reason_closed",
    )


@catalog.query("phase_reasons", _SEGMENTS + f"""
SELECT reason_closed, count(*) AS n_phases, {r('avg(duration)', 'mean_duration')}, {r('avg(n_events)', 'mean_events')}
FROM phases GROUP BY 1""")
def phase_reasons(spark, folder):
    return _phases(spark, folder).groupBy("reason_closed").agg(
        F.count(F.lit(1)).alias("n_phases"), rounded(F.avg("duration")).alias("mean_duration"),
        rounded(F.avg("n_events")).alias("mean_events"),
    )


@catalog.query("phase_numbers", _SEGMENTS + """
SELECT match_id, first_ordinal, match_id || '_' || row_number() OVER (PARTITION BY match_id ORDER BY first_ordinal) AS window_id
FROM phases""")
def phase_numbers(spark, folder):
    """Running phase number of a match."""
    phases = _phases(spark, folder).select("match_id", "sequence_id", "first_ordinal")
    numbered = od.ordered(phases, MATCH, ["first_ordinal"], 4096.0, index="n")
    label = F.concat_ws("_", F.col("sequence_id").cast("string"), (F.col("n") + 1).cast("string"))
    return numbered.select("match_id", "first_ordinal", label.alias("window_id"))


@catalog.query("next_event_move", f"""
WITH {BALL_POINTS},
s AS (SELECT match_id, sqrt((lead(x) OVER w - x) ** 2 + (lead(y) OVER w - y) ** 2) AS d FROM fr
      WINDOW w AS (PARTITION BY match_id ORDER BY elapsed, frame_idx))
SELECT match_id, count(d) AS n_valid, {r('avg(d)', 'mean_disp')}, {r('quantile_cont(d, 0.5)', 'median_disp')},
  {r('max(d)', 'max_disp')}, {r('min(d)', 'min_disp')}, {r('stddev_pop(d)', 'std_disp')},
  count(*) FILTER (WHERE d > 20) AS n_above FROM s GROUP BY 1""")
def next_event_move(spark, folder):
    fr = tables.ball_points(spark, folder)
    nxt = od.ordered(fr.select("match_id", "elapsed", "frame_idx", "x", "y"), MATCH, ["elapsed", "frame_idx"], 5 * DAY,
                     lead={"n": F.struct("x", "y")})
    moved = nxt.withColumn("d", F.hypot(F.col("n.x") - F.col("x"), F.col("n.y") - F.col("y")))
    g = moved.groupBy("match_id").agg(
        F.count("d").alias("n_valid"), rounded(F.avg("d")).alias("mean_disp"), rounded(F.max("d")).alias("max_disp"),
        rounded(F.min("d")).alias("min_disp"), rounded(F.stddev_pop("d")).alias("std_disp"),
        F.count_if(F.col("d") > 20).alias("n_above"),
    )
    median = exact_quantiles(moved.select("match_id", "d"), MATCH, "d", [0.5])
    return g.join(median, "match_id", "left").select(*g.columns, rounded(F.get("q", F.lit(0))).alias("median_disp"))


@catalog.query("series_statistics", f"""
WITH {BALL_POINTS}, g AS (
SELECT match_id, period, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi,
  arg_min(x, frame_idx) AS s, arg_max(x, frame_idx) AS e FROM fr GROUP BY 1, 2)
SELECT match_id, period, {r('mean', 'x_mean')}, {r('std', 'x_std')}, {r('lo', 'x_min')}, {r('hi', 'x_max')},
  {r('hi - lo', 'x_range')}, {r('s', 'x_start')}, {r('e', 'x_end')}, {r('e - s', 'x_change')} FROM g""")
def series_statistics(spark, folder):
    fr = tables.ball_points(spark, folder)
    g = fr.groupBy("match_id", "period").agg(*stats.series_stats("x", "x", "frame_idx"))
    return g.select("match_id", "period", *[rounded(f"x_{s}").alias(f"x_{s}") for s in stats.SUFFIXES])


@catalog.query("weighted_statistics", f"""
WITH {BALL_POINTS}, g AS (
SELECT match_id, x, CASE WHEN value > 20 THEN value ELSE 0 END AS w FROM fr),
m AS (SELECT match_id, sum(w) AS sw, sum(w * x) / nullif(sum(w), 0) AS wm, avg(x) AS am, stddev_pop(x) AS asd FROM g GROUP BY 1)
SELECT g.match_id, {r('any_value(CASE WHEN sw > 0 THEN wm ELSE am END)', 'x_mean')},
  {r('CASE WHEN any_value(sw) > 0 THEN sqrt(sum(w * (x - wm) ** 2) / any_value(sw)) ELSE any_value(asd) END', 'x_std')}
FROM g JOIN m ON g.match_id = m.match_id GROUP BY 1""")
def weighted_statistics(spark, folder):
    fr = tables.ball_points(spark, folder)
    mean, std = stats.weighted_mean_std(F.col("x"), F.when(F.col("value") > 20, F.col("value")).otherwise(0.0))
    return fr.groupBy("match_id").agg(rounded(mean).alias("x_mean"), rounded(std).alias("x_std"))


@catalog.query("team_vote", f"""
WITH {EV}, v AS (
SELECT match_id, CASE WHEN event_type <> 'signup' THEN ordinal % 2 = 0 END AS a, value > 25 AS b FROM ev WHERE NOT is_stop)
SELECT match_id, CASE WHEN count(a) > 0 THEN CASE WHEN count(*) FILTER (WHERE a) >= count(*) FILTER (WHERE NOT a) THEN 'home' ELSE 'away' END
  WHEN count(b) > 0 THEN CASE WHEN count(*) FILTER (WHERE b) >= count(*) FILTER (WHERE NOT b) THEN 'home' ELSE 'away' END END AS team
FROM v GROUP BY 1""")
def team_vote(spark, folder):
    ev = tables.event_log(spark, folder).filter(~F.col("is_stop"))
    first = F.when(F.col("event_type") != "signup", F.col("ordinal") % 2 == 0)
    return ev.select("match_id", first.alias("a"), (F.col("value") > 25).alias("b")).groupBy("match_id").agg(
        stats.majority_home("a", "b").alias("team")
    )


@catalog.query("event_counts", f"""
WITH {EV}
SELECT match_id, count(*) AS n_events, count(*) FILTER (WHERE is_pass) AS n_pass_attempts,
  count(*) FILTER (WHERE completed) AS n_completed_passes, count(*) FILTER (WHERE is_shot) AS n_shots,
  {r("count(*) FILTER (WHERE completed) / nullif(count(*) FILTER (WHERE is_pass), 0)", 'pass_completion_rate')},
  count(*) FILTER (WHERE is_shot AND value > 150) AS goals,
  {r("count(*) FILTER (WHERE event_type IN ('click', 'signup')) / count(*)", 'pressure_rate')}
FROM ev WHERE NOT is_stop GROUP BY 1""")
def event_counts(spark, folder):
    ev = tables.event_log(spark, folder).filter(~F.col("is_stop"))
    g = ev.groupBy("match_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("is_pass")).alias("n_pass_attempts"),
        F.count_if(F.col("completed")).alias("n_completed_passes"), F.count_if(F.col("is_shot")).alias("n_shots"),
        F.count_if(F.col("is_shot") & (F.col("value") > 150)).alias("goals"),
        F.count_if(F.col("event_type").isin("click", "signup")).alias("__pressed"),
    )
    return g.select(
        "match_id", "n_events", "n_pass_attempts", "n_completed_passes", "n_shots",
        rounded(ratio("n_completed_passes", "n_pass_attempts")).alias("pass_completion_rate"), "goals",
        rounded(ratio("__pressed", "n_events")).alias("pressure_rate"),
    )


@catalog.query("value_counts_json", """
WITH c AS (SELECT o_custkey % 100 AS grp, o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT grp, '{' || string_agg('"' || k || '":' || n, ',' ORDER BY n DESC, k) || '}' AS counts FROM c GROUP BY 1""")
def value_counts_json(spark, folder):
    o = tables.table(spark, folder, "orders")
    c = o.groupBy((F.col("o_custkey") % 100).alias("grp"), F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("grp").agg(stats.counts_as_json(F.collect_list(F.struct("k", "n"))).alias("counts"))


@catalog.query("sequence_extent", f"""
WITH {EV}, g AS (SELECT match_id, min(t) AS s, max(t) AS e, min(ordinal) AS first_frame, max(ordinal) AS last_frame,
  bool_or(is_shot) AS any_shot FROM ev WHERE NOT is_stop GROUP BY 1)
SELECT match_id, {r('s', 'start_sec')}, {r('e', 'end_sec')}, {r('e - s', 'duration')}, first_frame, last_frame, any_shot FROM g""")
def sequence_extent(spark, folder):
    g = tables.event_log(spark, folder).filter(~F.col("is_stop")).groupBy("match_id").agg(
        F.min("t").alias("s"), F.max("t").alias("e"), F.min("ordinal").alias("first_frame"),
        F.max("ordinal").alias("last_frame"), F.bool_or("is_shot").alias("any_shot"),
    )
    return g.select("match_id", rounded("s").alias("start_sec"), rounded("e").alias("end_sec"),
                    rounded(F.col("e") - F.col("s")).alias("duration"), "first_frame", "last_frame", "any_shot")


@catalog.query("quantiles", "SELECT l_returnflag AS grp, " + ", ".join(
    r(f"quantile_cont(l_extendedprice, {q})", f"p{int(q * 100)}") for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
) + " FROM lineitem GROUP BY 1")
def quantiles(spark, folder):
    qs = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
    li = tables.table(spark, folder, "lineitem")
    g = exact_quantiles(li.select(F.col("l_returnflag").alias("grp"), "l_extendedprice"), ["grp"], "l_extendedprice", list(qs), "p")
    return g.select("grp", *[rounded(F.col("p")[i]).alias(f"p{int(q * 100)}") for i, q in enumerate(qs)])


@catalog.query("mean_per_second", f"""
WITH {BALL_POINTS}
SELECT match_id, period, floor(elapsed / 3600)::BIGINT AS bucket,
  {r("avg(CASE WHEN team = 'home' THEN value ELSE -value END)", 'mean_signed')} FROM fr GROUP BY 1, 2, 3""")
def mean_per_second(spark, folder):
    fr = tables.ball_points(spark, folder)
    signed = F.when(F.col("team") == "home", F.col("value")).otherwise(-F.col("value"))
    return fr.groupBy("match_id", "period", F.floor(F.col("elapsed") / 3600).alias("bucket")).agg(
        rounded(F.avg(signed)).alias("mean_signed")
    )


@catalog.query("status_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, folder):
    e = tables.table(spark, folder, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@catalog.query("sticky_owner_changes", f"""
WITH {EV}, k AS (SELECT match_id, ordinal, t, CASE WHEN value > 80 THEN 'home' WHEN value < 20 THEN 'away' END AS owner FROM ev),
s AS (SELECT *, lag(owner) OVER (PARTITION BY match_id ORDER BY t, ordinal) AS previous FROM k WHERE owner IS NOT NULL)
SELECT match_id, ordinal, previous, owner FROM s WHERE owner <> previous""")
def sticky_owner_changes(spark, folder):
    owner = F.when(F.col("value") > 80, "home").when(F.col("value") < 20, "away")
    ev = tables.event_log(spark, folder).select("match_id", "ordinal", "t", owner.alias("owner"))
    return od.changes(ev, MATCH, ["t", "ordinal"], "owner", 5 * DAY).select("match_id", "ordinal", "previous", "owner")


@catalog.query("path_length", f"""
WITH {BALL_POINTS}, s AS (
SELECT match_id, frame_idx, x, y, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM fr
WINDOW w AS (PARTITION BY match_id ORDER BY frame_idx)),
g AS (SELECT match_id, count(*) AS n_points, coalesce(sum(d), 0) AS len,
  sqrt((arg_max(x, frame_idx) - arg_min(x, frame_idx)) ** 2 + (arg_max(y, frame_idx) - arg_min(y, frame_idx)) ** 2) AS net
  FROM s GROUP BY 1)
SELECT match_id, n_points, {r('len', 'path_length_m')}, {r('net', 'net_displacement_m')},
  {r('CASE WHEN len > 0 THEN net / len END', 'straightness')} FROM g""")
def path_length(spark, folder):
    from playframe.plans.maps import path_summary

    fr = tables.ball_points(spark, folder).select("match_id", "frame_idx", "x", "y")
    return path_summary(fr, MATCH, "frame_idx", "x", "y", 4096.0).select(
        "match_id", "n_points", *[rounded(c).alias(c) for c in ("path_length_m", "net_displacement_m", "straightness")]
    )


@catalog.query("label_runs", f"""
WITH {ORDER_SPANS}, f AS (
SELECT *, CASE WHEN lag(label) OVER w <> label THEN 1 ELSE 0 END AS chg FROM os WINDOW w AS (PARTITION BY entity ORDER BY day, ordinal)),
i AS (SELECT *, sum(chg) OVER (PARTITION BY entity ORDER BY day, ordinal ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT entity, island::BIGINT AS island, any_value(label) AS label, count(*) AS n, {r('min(day)', 'start_day')}, {r('max(day)', 'end_day')}
FROM i GROUP BY 1, 2""")
def label_runs(spark, folder):
    os = tables.order_spans(spark, folder)
    runs = od.islands(os, ["entity"], ["day", "ordinal"], "label", 365.0)
    return runs.groupBy("entity", "island").agg(
        F.first("label").alias("label"), F.count(F.lit(1)).alias("n"),
        rounded(F.min("day")).alias("start_day"), rounded(F.max("day")).alias("end_day"),
    )


@catalog.query("sliding_windows", f"""
WITH {EV}, w AS (
SELECT match_id, unnest(generate_series(greatest(0, ceil((t - 1704067200 - 259200) / 86400.0::DOUBLE)::BIGINT), floor((t - 1704067200) / 86400.0::DOUBLE)::BIGINT)) AS k, value FROM ev)
SELECT match_id, k, count(*) AS n, {r('avg(value)', 'mean_value')} FROM w GROUP BY 1, 2""")
def sliding_windows(spark, folder):
    """Windows of three days every day, closed at both ends."""
    from playframe.plans.formations import sliding_windows as windows

    ev = tables.event_log(spark, folder).withColumn("sec", F.col("t") - F.lit(1704067200.0))
    return ev.withColumn("k", F.explode(windows("sec", 86400, 259200))).groupBy("match_id", "k").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("value")).alias("mean_value")
    )


@catalog.query("top_per_group", """
WITH c AS (SELECT l_returnflag AS grp, l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, item::VARCHAR) AS rank FROM c)
SELECT grp, item, n, rank::INT AS rank FROM k WHERE rank <= 10""")
def top_per_group(spark, folder):
    li = tables.table(spark, folder, "lineitem")
    c = li.groupBy(F.col("l_returnflag").alias("grp"), F.col("l_partkey").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return od.top_per_key(c, ["grp"], [F.desc("n"), F.col("item").cast("string")], 10)


@catalog.query("every_nth_row", f"""
WITH {EV}, n AS (SELECT match_id, ordinal, row_number() OVER (PARTITION BY match_id ORDER BY ordinal) - 1 AS pos FROM ev)
SELECT match_id, ordinal FROM n WHERE pos % 5 = 0""")
def every_nth_row(spark, folder):
    ev = tables.event_log(spark, folder).select("match_id", "ordinal")
    return od.every_nth(ev, MATCH, ["ordinal"], 5, 4096.0)


@catalog.query("longest_phases", _SEGMENTS + f"""
SELECT match_id, first_ordinal, n_events, {r('duration', 'duration')}, reason_closed FROM phases
ORDER BY phases.duration DESC, first_ordinal LIMIT 5""")
def longest_phases(spark, folder):
    top = _phases(spark, folder).orderBy(F.desc("duration"), "first_ordinal").limit(5)
    return top.select("match_id", "first_ordinal", "n_events", rounded("duration").alias("duration"), "reason_closed")
