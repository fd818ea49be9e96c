"""Cell map queries: histograms, shares, dense maps, rotation, regridding,
roughness, similarity, and the three phase-level map products."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.catalog import Catalog
from playframe.catalog.views import BALL, BALL_POINTS, CELLS, PLAYERS, SPANS, r
from playframe.config import EngineConfig
from playframe.functions.nulls import rounded
from playframe.operators import grids
from playframe.operators.quantiles import exact_quantiles
from playframe.operators.ranges import points_in_intervals
from playframe.plans import maps
from playframe.sources import tables

catalog = Catalog()
L, W = tables.LENGTH, tables.WIDTH
N_ROWS, N_COLS = 11, 50
_BIN = "least(greatest(floor({v} / ({extent}::DOUBLE / {n})), 0), {n} - 1)::INT"
_XBIN, _YBIN = _BIN.format(v="x", extent=105, n=105), _BIN.format(v="y", extent=68, n=68)


@catalog.query("occupancy_histogram", f"""
WITH {BALL_POINTS} SELECT match_id, {_YBIN} AS row, {_XBIN} AS col, count(*) AS n FROM fr GROUP BY 1, 2, 3""")
def occupancy_histogram(spark, folder):
    return grids.histogram2d(tables.ball_points(spark, folder), ["match_id"], "x", "y", L, W, 105, 68)


@catalog.query("occupancy_share", f"""
WITH {BALL_POINTS}, c AS (SELECT match_id, team, {_YBIN} AS row, {_XBIN} AS col, count(*) AS n FROM fr GROUP BY 1, 2, 3, 4)
SELECT match_id, team, row, col, {r('n / sum(n) OVER (PARTITION BY match_id, team)', 'frac')} FROM c""")
def occupancy_share(spark, folder):
    c = grids.histogram2d(tables.ball_points(spark, folder), ["match_id", "team"], "x", "y", L, W, 105, 68)
    s = grids.with_share(c, ["match_id", "team"], "n", "frac")
    return s.select("match_id", "team", "row", "col", rounded("frac").alias("frac"))


def _unit_cells(spark, folder, keys=("map_id",)):
    """Cells with amounts in units of a thousand."""
    return tables.cells(spark, folder).groupBy(*keys, "row", "col").agg((F.sum("amount") / 1000).alias("v"))


_UNIT = "u AS (SELECT map_id, row, col, sum(amount) / 1000 AS v FROM cell GROUP BY 1, 2, 3)"
_SPINE = f"""
spine AS (SELECT i // {N_COLS} AS row, i % {N_COLS} AS col FROM (SELECT unnest(generate_series(0, {N_ROWS * N_COLS - 1})) AS i)),
dense AS (SELECT m.map_id, s.row::INT AS row, s.col::INT AS col, coalesce(u.v, 0) AS v FROM (SELECT DISTINCT map_id FROM u) m CROSS JOIN spine s
  LEFT JOIN u ON u.map_id = m.map_id AND u.row = s.row AND u.col = s.col)"""


@catalog.query("dense_grid", f"WITH {CELLS}, {_UNIT}, {_SPINE} SELECT map_id, row, col, {r('v', 'v')} FROM dense")
def dense_grid(spark, folder):
    d = grids.densify(_unit_cells(spark, folder), ["map_id"], "v", N_ROWS, N_COLS)
    o = d.select("map_id", F.posexplode("cells").alias("i", "v"))
    return o.select("map_id", F.expr(f"i div {N_COLS}").cast("int").alias("row"), (F.col("i") % N_COLS).alias("col"), rounded("v").alias("v"))


@catalog.query("sparse_grid", f"WITH {CELLS}, {_UNIT} SELECT map_id, row, col, {r('v', 'v')} FROM u WHERE v <> 0")
def sparse_grid(spark, folder):
    d = grids.densify(_unit_cells(spark, folder), ["map_id"], "v", N_ROWS, N_COLS)
    return grids.sparsify(d, ["map_id"], "cells", N_COLS, "v").withColumn("v", rounded("v"))


@catalog.query("map_centroid_x", f"""
WITH {CELLS}, {_UNIT} SELECT map_id, {r('sum(v * (col + 0.5) * 105 / 50) / sum(v)', 'centroid_x')} FROM u GROUP BY 1""")
def map_centroid_x(spark, folder):
    return grids.centroid_x(_unit_cells(spark, folder), ["map_id"], "v", N_COLS, L, "centroid_x").withColumn("centroid_x", rounded("centroid_x"))


@catalog.query("regrid", f"""
WITH {CELLS}, {_UNIT},
wr AS (SELECT o.i AS o, c.i AS c, least(CASE WHEN o.i = 3 THEN 11.0 ELSE (o.i + 1) * (11.0::DOUBLE / 4) END, c.i + 1) - greatest(o.i * (11.0::DOUBLE / 4), c.i) AS w
  FROM (SELECT unnest(generate_series(0, 3)) AS i) o, (SELECT unnest(generate_series(0, 10)) AS i) c),
wc AS (SELECT o.i AS o, c.i AS c, least(CASE WHEN o.i = 11 THEN 50.0 ELSE (o.i + 1) * (50.0::DOUBLE / 12) END, c.i + 1) - greatest(o.i * (50.0::DOUBLE / 12), c.i) AS w
  FROM (SELECT unnest(generate_series(0, 11)) AS i) o, (SELECT unnest(generate_series(0, 49)) AS i) c)
SELECT map_id, wr.o::INT AS row, wc.o::INT AS col, {r('sum(wr.w * wc.w * v) * 0.7310585', 'v')} FROM u JOIN wr ON u.row = wr.c AND wr.w > 0 JOIN wc ON u.col = wc.c AND wc.w > 0
GROUP BY 1, 2, 3""")
def regrid(spark, folder):
    return grids.regrid(_unit_cells(spark, folder), ["map_id"], "v", N_ROWS, N_COLS, 4, 12).withColumn("v", rounded(F.col("v") * 0.7310585))


@catalog.query("roughness", f"""
WITH {CELLS}, {_UNIT}, {_SPINE},
d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY map_id, row ORDER BY col)) AS h, abs(v - lag(v) OVER (PARTITION BY map_id, col ORDER BY row)) AS w FROM dense)
SELECT map_id, {r('(coalesce(sum(h), 0) + coalesce(sum(w), 0)) / sum(v)', 'patchiness')} FROM d GROUP BY 1""")
def roughness(spark, folder):
    d = grids.densify(_unit_cells(spark, folder), ["map_id"], "v", N_ROWS, N_COLS)
    return d.select("map_id", rounded(grids.total_variation(F.col("cells"), N_ROWS, N_COLS)).alias("patchiness"))


@catalog.query("isolated_cells", f"""
WITH {CELLS}, {_UNIT}, n AS (SELECT u.map_id, u.row, u.col, u.v, EXISTS (SELECT 1 FROM u o WHERE o.map_id = u.map_id AND o.v > 0
  AND abs(o.row - u.row) + abs(o.col - u.col) = 1) AS near FROM u)
SELECT map_id, {r('coalesce(sum(v) FILTER (WHERE NOT near), 0) / sum(v)', 'patchiness')} FROM n GROUP BY 1""")
def isolated_cells(spark, folder):
    d = grids.densify(_unit_cells(spark, folder), ["map_id"], "v", N_ROWS, N_COLS)
    return d.select("map_id", rounded(grids.isolated_share(F.col("cells"), N_ROWS, N_COLS)).alias("patchiness"))




@catalog.query("map_correlation", f"""
WITH {CELLS}, s AS (SELECT side || '-' || state AS label, row, col, sum(amount) AS v FROM cell GROUP BY 1, 2, 3),
spine AS (SELECT i // 50 AS row, i % 50 AS col FROM (SELECT unnest(generate_series(0, 549)) AS i)),
d AS (SELECT l.label, p.row, p.col, coalesce(s.v, 0) AS v FROM (SELECT DISTINCT label FROM s) l CROSS JOIN spine p LEFT JOIN s ON s.label = l.label AND s.row = p.row AND s.col = p.col)
SELECT a.label AS label_a, b.label AS label_b, {r('corr(a.v, b.v)', 'corr')} FROM d a JOIN d b ON a.row = b.row AND a.col = b.col GROUP BY 1, 2""")
def map_correlation(spark, folder):
    c = tables.cells(spark, folder)
    c = c.select(F.concat_ws("-", "side", "state").alias("label"), (F.col("row") * N_COLS + F.col("col")).alias("cell"), "amount")
    m = grids.label_correlation(c, "label", "amount", N_ROWS * N_COLS)
    return m.withColumn("corr", rounded("corr"))


@catalog.query("similar_pairs", catalog.checks["map_correlation"].replace("SELECT a.label AS label_a", "SELECT * FROM (SELECT a.label AS label_a")
               + ") WHERE label_a < label_b ORDER BY corr DESC, label_a, label_b LIMIT 10")
def similar_pairs(spark, folder):
    m = map_correlation(spark, folder)
    return m.filter(F.col("label_a") < F.col("label_b")).orderBy(F.desc("corr"), "label_a", "label_b").limit(10)


@catalog.query("label_map_sums", f"""
WITH {CELLS}, m AS (SELECT map_id, arg_max(side, (c, side)) AS label FROM (SELECT map_id, side, count(*) AS c FROM cell GROUP BY 1, 2) GROUP BY 1),
k AS (SELECT label, count(*) AS n_phases FROM m GROUP BY 1 HAVING count(*) >= 3)
SELECT label, row, col, n_phases, {r("coalesce(sum(amount) FILTER (WHERE state = 'F'), 0)", 'in_possession_sum')}, {r("coalesce(sum(amount) FILTER (WHERE state = 'O'), 0)", 'out_of_possession_sum')}
FROM cell JOIN m USING (map_id) JOIN k USING (label) GROUP BY 1, 2, 3, 4""")
def label_map_sums(spark, folder):
    from playframe.plans.similarity import label_sums

    c = tables.cells(spark, folder)
    n = c.groupBy("map_id", "side").agg(F.count(F.lit(1)).alias("c"))
    labels = n.groupBy("map_id").agg(F.max_by("side", F.struct("c", "side")).alias("label"))
    blocks = c.select("map_id", "row", "col", F.when(F.col("state") == "F", "in").otherwise("out").alias("block"), "amount")
    s = label_sums(blocks, labels, ["map_id"], "amount", 3)
    return s.select("label", "row", "col", "n_phases", rounded("in_possession_sum").alias("in_possession_sum"),
                    rounded("out_of_possession_sum").alias("out_of_possession_sum"))


_ORIENTED = f"""
{PLAYERS}, c AS (SELECT match_id, frame_idx AS window_id, period, side, {_BIN.format(v='x', extent=105, n=16)} AS col, {_BIN.format(v='y', extent=68, n=12)} AS row, count(*) AS n
  FROM pl WHERE x IS NOT NULL GROUP BY ALL),
f AS (SELECT *, CASE WHEN window_id % 3 = 0 THEN 'home' ELSE 'away' END AS team, n / sum(n) OVER (PARTITION BY match_id, window_id, side) AS frac FROM c),
s AS (SELECT match_id, window_id, team, period, side, sum(frac * (col + 0.5) * 105 / 16) / sum(frac) AS cx FROM f GROUP BY ALL),
m AS (SELECT match_id, window_id, team, period, 0.5 * (max(cx) FILTER (WHERE side = 'home') + max(cx) FILTER (WHERE side = 'away')) AS mid FROM s GROUP BY ALL),
g AS (SELECT match_id, period, avg(mid) FILTER (WHERE team = 'home') - avg(mid) FILTER (WHERE team = 'away') AS margin FROM m GROUP BY ALL),
d AS (SELECT *, CASE WHEN margin > 0 THEN 1 WHEN margin < 0 THEN -1 WHEN period = 1 THEN 1 ELSE -1 END AS home_dir FROM g)"""


def _frame_maps(spark, folder):
    """Every frame as a phase with a 12 x 16 occupancy map per side."""
    p = tables.player_points(spark, folder).withColumn("window_id", F.col("frame_idx"))
    team = F.when(F.col("window_id") % 3 == 0, "home").otherwise("away")
    c = grids.histogram2d(p, ["match_id", "window_id", "period", "side"], "x", "y", L, W, 16, 12)
    return grids.with_share(c, ["match_id", "window_id", "side"], "n", "frac").withColumn("team", team)


@catalog.query("attack_direction_detection", f"""
WITH {_ORIENTED} SELECT match_id, period::INT AS period, {r('margin', 'margin')}, home_dir::INT AS home_dir FROM d""")
def attack_direction_detection(spark, folder):
    c = grids.centroid_x(_frame_maps(spark, folder), ["match_id", "window_id", "team", "period", "side"], "frac", 16, L, "cx")
    mid = c.groupBy("match_id", "window_id", "team", "period").agg(
        (0.5 * (F.max(F.when(F.col("side") == "home", F.col("cx"))) + F.max(F.when(F.col("side") == "away", F.col("cx"))))).alias("mid_x"))
    d = maps.home_attack_direction(mid)
    return d.select("match_id", "period", rounded("margin").alias("margin"), "home_dir")


@catalog.query("attack_oriented_maps", f"""
WITH {_ORIENTED}, t AS (SELECT f.*, CASE WHEN team = 'home' THEN home_dir ELSE -home_dir END AS ad FROM f JOIN d USING (match_id, period))
SELECT match_id, window_id, CASE WHEN team = side THEN 'in' ELSE 'out' END AS block, CASE WHEN ad = -1 THEN 11 - row ELSE row END AS row,
  CASE WHEN ad = -1 THEN 15 - col ELSE col END AS col, {r('frac', 'frac')} FROM t""")
def attack_oriented_maps(spark, folder):
    o = maps.attack_oriented(_frame_maps(spark, folder), "frac", 12, 16, L)
    return o.select("match_id", "window_id", "block", "row", "col", rounded("frac").alias("frac"))


def _phase_frames(spark, folder):
    spans = tables.possession_spans(spark, folder).select(
        "match_id", F.col("poss_id").alias("window_id"), F.col("poss_id").alias("sequence_id"), "team",
        (1 + F.floor(F.col("start_frame") / tables.FRAMES_PER_PERIOD)).cast("int").alias("period"), "start_frame", "end_frame")
    f = tables.frames(spark, folder).drop("period").withColumns({"pitch_length": F.lit(L), "pitch_width": F.lit(W)})
    return points_in_intervals(f, spans, ["match_id"], "frame_num", "start_frame", "end_frame", 64.0).drop("start_frame", "end_frame")


@catalog.query("phase_occupancy", f"""
WITH {PLAYERS}, {SPANS}, ok AS (SELECT match_id, frame_idx FROM (SELECT (o_orderkey // 5) // 500 AS match_id, (o_orderkey // 5) % 500 AS frame_idx FROM orders WHERE o_orderkey % 5 = 0)),
j AS (SELECT s.match_id, s.poss_id, s.team, p.side, p.player_rank, p.x, p.y FROM spans s JOIN pl p ON s.match_id = p.match_id AND p.frame_idx BETWEEN s.start_frame AND s.end_frame
  JOIN ok ON ok.match_id = p.match_id AND ok.frame_idx = p.frame_idx WHERE p.x IS NOT NULL AND NOT (p.side = 'home' AND p.player_rank = 0)),
c AS (SELECT match_id, poss_id, side, player_rank, count(*) AS n FROM j GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY match_id, poss_id, side ORDER BY n DESC, player_rank::VARCHAR) AS rk FROM c),
h AS (SELECT match_id, poss_id, team, side, {_YBIN} AS row, {_XBIN} AS col, count(*) AS recurrence_count FROM j JOIN k USING (match_id, poss_id, side, player_rank) WHERE rk <= 10 GROUP BY ALL)
SELECT match_id, poss_id AS window_id, side, row, col, recurrence_count::BIGINT AS recurrence_count,
  {r('recurrence_count / sum(recurrence_count) OVER (PARTITION BY match_id, poss_id, side)', 'recurrence_frac')},
  {r('recurrence_count / sum(recurrence_count) OVER (PARTITION BY match_id, poss_id)', 'recurrence_frac_combined')} FROM h""")
def phase_occupancy(spark, folder):
    pf = _phase_frames(spark, folder)
    keeper = tables.possession_spans(spark, folder).select("match_id").distinct().select("match_id", F.lit("home").alias("side"), F.lit("0").alias("pid"))
    o = maps.occupancy(pf, keeper, 10)
    return o.select("match_id", "window_id", "side", "row", "col", "recurrence_count", rounded("recurrence_frac").alias("recurrence_frac"),
                    rounded("recurrence_frac_combined").alias("recurrence_frac_combined"))


@catalog.query("phase_ball_cells", f"""
WITH {BALL}, {SPANS}, j AS (SELECT s.match_id, s.poss_id, s.team, b.ball_x AS x, b.ball_y AS y FROM spans s JOIN ball b
  ON s.match_id = b.match_id AND b.frame_idx BETWEEN s.start_frame AND s.end_frame),
h AS (SELECT match_id, poss_id, {_YBIN} AS row, {_XBIN} AS col, count(*) AS recurrence_count FROM j WHERE x IS NOT NULL GROUP BY ALL)
SELECT match_id, poss_id AS window_id, row, col, recurrence_count, {r('recurrence_count / sum(recurrence_count) OVER (PARTITION BY match_id, poss_id)', 'recurrence_frac')} FROM h""")
def phase_ball_cells(spark, folder):
    b = maps.ball_occupancy(_phase_frames(spark, folder))
    return b.select("match_id", "window_id", "row", "col", "recurrence_count", rounded("recurrence_frac").alias("recurrence_frac"))


@catalog.query("phase_ball_paths", f"""
WITH {BALL}, {SPANS}, j AS (SELECT s.match_id, s.poss_id, b.frame_idx, b.ball_x AS x, b.ball_y AS y FROM spans s JOIN ball b
  ON s.match_id = b.match_id AND b.frame_idx BETWEEN s.start_frame AND s.end_frame WHERE b.ball_x IS NOT NULL),
d AS (SELECT *, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM j WINDOW w AS (PARTITION BY match_id, poss_id ORDER BY frame_idx)),
g AS (SELECT match_id, poss_id, count(*) AS n_points, coalesce(sum(d), 0) AS len, string_agg(x::VARCHAR, ' ' ORDER BY frame_idx) AS path_x,
  sqrt((arg_max(x, frame_idx) - arg_min(x, frame_idx)) ** 2 + (arg_max(y, frame_idx) - arg_min(y, frame_idx)) ** 2) AS net FROM d GROUP BY ALL)
SELECT match_id, poss_id AS window_id, n_points, path_x, {r('len', 'path_length_m')}, {r('net', 'net_displacement_m')}, {r('CASE WHEN len > 0 THEN net / len END', 'straightness')} FROM g""")
def phase_ball_paths(spark, folder):
    p = maps.ball_paths(_phase_frames(spark, folder))
    return p.select("match_id", "window_id", "n_points", F.array_join(F.col("path_x").cast("array<string>"), " ").alias("path_x"),
                    *[rounded(c).alias(c) for c in ("path_length_m", "net_displacement_m", "straightness")])


@catalog.query("phase_control")
def phase_control(spark, folder):
    """Controlled cells of a metre per phase, summed up: too many frame and
    cell pairs for SQL on whole tables; brute force checks it in the tests."""
    cfg = EngineConfig.clustering_preset()
    c = maps.phase_control(_phase_frames(spark, folder), cfg.phase_control_stride, cfg.control_min_players)
    return c.groupBy("match_id", "window_id", "team", "valid_pitch_control_frame_count").agg(
        F.count(F.lit(1)).alias("n_cells"), rounded(F.sum("pitch_control_frac"), 4).alias("controlled_cells"))


@catalog.query("share_violations", f"""
WITH {CELLS}, s AS (SELECT map_id, side, amount / sum(amount) OVER (PARTITION BY map_id) AS f FROM cell)
SELECT map_id, side, {r('sum(f)', 'total')} FROM s GROUP BY 1, 2 HAVING abs(sum(f) - 1) > 1.1e-5 AND sum(f) <> 0""")
def share_violations(spark, folder):
    """Maps whose shares do not add up to one."""
    c = tables.cells(spark, folder)
    t = c.groupBy("map_id").agg(F.sum("amount").alias("t"))
    s = c.join(t, "map_id").withColumn("f", F.col("amount") / F.col("t"))
    return maps.sum_violations(s, ["map_id", "side"], "f").withColumn("total", rounded("total"))


@catalog.query("positive_peak", f"""
WITH {CELLS}, {_UNIT}, {_SPINE} SELECT map_id, {r('quantile_cont(v, 0.995)', 'vmax')} FROM dense WHERE v > 0 GROUP BY 1""")
def positive_peak(spark, folder):
    """Display scale: a high quantile of the positive cells."""
    c = _unit_cells(spark, folder).filter(F.col("v") > 0)
    return exact_quantiles(c, ["map_id"], "v", [0.995]).select("map_id", rounded(F.get("q", F.lit(0))).alias("vmax"))


@catalog.query("grid_extents", f"""
WITH {CELLS} SELECT map_id, max(row) AS max_row, max(col) AS max_col FROM cell GROUP BY 1""")
def grid_extents(spark, folder):
    return tables.cells(spark, folder).groupBy("map_id").agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


_TAPS = """
k AS (SELECT o, exp(-0.5 * o * o) / (SELECT sum(exp(-0.5 * p * p)) FROM (SELECT unnest(generate_series(-4, 4)) AS p)) AS w FROM (SELECT unnest(generate_series(-4, 4)) AS o)),
mr AS (SELECT i AS at, CASE WHEN m < 11 THEN m ELSE 21 - m END AS src, w FROM (SELECT i, (i + o + 22) % 22 AS m, w FROM (SELECT unnest(generate_series(0, 10)) AS i), k)),
mc AS (SELECT i AS at, CASE WHEN m < 50 THEN m ELSE 99 - m END AS src, w FROM (SELECT i, (i + o + 100) % 100 AS m, w FROM (SELECT unnest(generate_series(0, 49)) AS i), k)),
a AS (SELECT map_id, mr.at AS row, col, sum(v * w) AS v FROM u JOIN mr ON u.row = mr.src GROUP BY 1, 2, 3),
b AS (SELECT map_id, row, mc.at AS col, sum(v * w) AS v FROM a JOIN mc ON a.col = mc.src GROUP BY 1, 2, 3)"""


@catalog.query("smoothed_grid", f"""
WITH {CELLS}, {_UNIT}, {_TAPS} SELECT map_id, round(sum(v) * 0.7310585, 4) + 0.0 AS mass, round(max(v) * 0.7310585, 4) + 0.0 AS peak FROM b GROUP BY 1""")
def smoothed_grid(spark, folder):
    """Gaussian smoothing of dense maps; mass is kept by mirrored borders."""
    s = grids.densify(_unit_cells(spark, folder), ["map_id"], "v", N_ROWS, N_COLS, then=grids.smoother(N_ROWS, N_COLS, 1.0))
    return s.select("map_id", rounded(F.aggregate("cells", F.lit(0.0), lambda a, v: a + v) * 0.7310585, 4).alias("mass"),
                    rounded(F.array_max("cells") * 0.7310585, 4).alias("peak"))
