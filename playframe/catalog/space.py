"""Frame geometry queries: shapes, neighbours, ownership and value surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from playframe.catalog import Catalog
from playframe.catalog.joins import owner_stamp_frames
from playframe.catalog.views import BALL, OWNED, PLAYERS, r
from playframe.config import EngineConfig
from playframe.functions import direction as dr
from playframe.functions import frames as fx
from playframe.functions.gridding import surface_lookup
from playframe.functions.nulls import rounded
from playframe.operators import kernels
from playframe.operators import ordered as od
from playframe.plans import formations as fm
from playframe.plans import series
from playframe.sources import tables

catalog = Catalog()
L, W = tables.LENGTH, tables.WIDTH
KEY = ["match_id", "frame_idx"]
# a value surface by rule, as a stand-in for a file
SURFACE = [[((row * 7 + cell * 13) % 97) / 97.0 for cell in range(16)] for row in range(12)]
_VAL = "((least(greatest(trunc({y} / 68.0 * 12)::INT, 0), 11) * 7 + least(greatest(trunc({x} / 105.0 * 16)::INT, 0), 15) * 13) % 97) / 97.0::DOUBLE"
_DIR = "CASE WHEN (period % 2 = 1) = (team = 'home') THEN 1 ELSE -1 END"

_SHAPES = f"""
WITH {PLAYERS}, p AS (SELECT * FROM pl WHERE x IS NOT NULL AND y IS NOT NULL),
c AS (SELECT match_id, frame_idx, side, avg(x) AS cx, avg(y) AS cy, max(y) - min(y) AS width, max(x) - min(x) AS depth FROM p GROUP BY 1, 2, 3),
d AS (SELECT c.match_id, c.frame_idx, c.side, avg(sqrt((p.x - c.cx) ** 2 + (p.y - c.cy) ** 2)) AS compactness FROM p JOIN c USING (match_id, frame_idx, side) GROUP BY 1, 2, 3),
q AS (SELECT a.match_id, a.frame_idx, a.side, a.player_rank AS i, b.player_rank AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d
  FROM p a JOIN p b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.side = b.side AND a.player_rank <> b.player_rank),
n AS (SELECT match_id, frame_idx, side, avg(m) AS nearest FROM (SELECT match_id, frame_idx, side, i, min(d) AS m FROM q GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
w AS (SELECT match_id, frame_idx, side, avg(d) AS pairwise FROM q WHERE i < j GROUP BY 1, 2, 3),
s AS (SELECT c.*, compactness, CASE WHEN width > 1e-6 THEN depth / width END AS elongation, nearest, pairwise
  FROM c JOIN d USING (match_id, frame_idx, side) LEFT JOIN n USING (match_id, frame_idx, side) LEFT JOIN w USING (match_id, frame_idx, side))"""


def _geometry(spark, folder):
    return kernels.frame_geometry(tables.frames(spark, folder))


def _by_side(g, names):
    """A row per frame and side with players."""
    def side(s):
        return F.struct(F.lit(s).alias("side"), F.size(s).alias("n"), *[rounded(f"{s}_{c}").alias(c) for c in names])

    both = g.select(*KEY, F.explode(F.array(side("home"), side("away"))).alias("e"))
    return both.filter(F.col("e.n") > 0).select(*KEY, "e.side", *[F.col(f"e.{c}") for c in names])


@catalog.query("team_shape", _SHAPES + f"""
SELECT match_id, frame_idx, side, {r('cx', 'centroid_x')}, {r('cy', 'centroid_y')}, {r('compactness', 'compactness')}, {r('width', 'width')},
  {r('depth', 'depth')}, {r('elongation', 'elongation')} FROM s""")
def team_shape(spark, folder):
    return _by_side(_geometry(spark, folder), ("centroid_x", "centroid_y", "compactness", "width", "depth", "elongation"))


@catalog.query("team_distances", _SHAPES + f"""
SELECT match_id, frame_idx, side, {r('nearest', 'nearest_teammate_distance')}, {r('pairwise', 'pairwise_distance')} FROM s""")
def team_distances(spark, folder):
    return _by_side(_geometry(spark, folder).filter(F.size("home") + F.size("away") > 0), ("nearest_teammate_distance", "pairwise_distance"))


@catalog.query("nearest_opponent", f"""
WITH {PLAYERS}, p AS (SELECT * FROM pl WHERE x IS NOT NULL),
m AS (SELECT a.match_id, a.frame_idx, a.side, a.player_rank, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM p a JOIN p b
  ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.side <> b.side GROUP BY 1, 2, 3, 4)
SELECT match_id, frame_idx, side, {r('avg(d)', 'nearest_opponent_distance')} FROM m GROUP BY 1, 2, 3""")
def nearest_opponent(spark, folder):
    g = _geometry(spark, folder).filter((F.size("home") > 0) & (F.size("away") > 0))
    return _by_side(g, ("nearest_opponent",)).withColumnRenamed("nearest_opponent", "nearest_opponent_distance")


@catalog.query("team_interactions", _SHAPES + f""",
j AS (SELECT h.match_id, h.frame_idx, h.cx AS hx, h.cy AS hy, a.cx AS ax, a.cy AS ay, h.width AS hw, a.width AS aw, h.depth AS hd, a.depth AS ad,
  h.compactness AS hc, a.compactness AS ac FROM s h JOIN s a ON h.match_id = a.match_id AND h.frame_idx = a.frame_idx AND h.side = 'home' AND a.side = 'away')
SELECT match_id, frame_idx, {r('sqrt((hx - ax) ** 2 + (hy - ay) ** 2)', 'centroid_distance')}, {r('hx - ax', 'longitudinal_centroid_difference')},
  {r('hy - ay', 'lateral_centroid_difference')}, {r('hw - aw', 'width_difference')}, {r('CASE WHEN aw > 1e-6 THEN hw / aw END', 'width_ratio')},
  {r('hd - ad', 'depth_difference')}, {r('CASE WHEN ad > 1e-6 THEN hd / ad END', 'depth_ratio')},
  {r('hc - ac', 'compactness_difference')}, {r('CASE WHEN ac > 1e-6 THEN hc / ac END', 'compactness_ratio')} FROM j""")
def team_interactions(spark, folder):
    g = _geometry(spark, folder).filter((F.size("home") > 0) & (F.size("away") > 0))

    def side(s):
        return F.struct(*[F.col(f"{s}_{c}").alias(c) for c in kernels.SHAPE_FIELDS])

    s = g.withColumn("i", fx.interactions(side("home"), side("away"), F.col("home_nearest_opponent")))
    names = [n for n in fx.INTERACTION_FIELDS if "area" not in n and n != "nearest_opponent_distance"]
    return s.select(*KEY, *[rounded(F.col(f"i.{c}")).alias(c) for c in names])


@catalog.query("ahead_behind", f"""
WITH {PLAYERS}, {BALL}
SELECT p.match_id, p.frame_idx, p.side, {r('count(*) FILTER (WHERE p.x > b.ball_x)', 'players_ahead_of_ball')},
  {r('count(*) FILTER (WHERE p.x <= b.ball_x)', 'players_behind_ball')},
  {r('sqrt((avg(p.x) - any_value(b.ball_x)) ** 2 + (avg(p.y) - any_value(b.ball_y)) ** 2)', 'centroid_to_ball_distance')}
FROM pl p JOIN ball b ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx
WHERE p.x IS NOT NULL AND b.ball_x IS NOT NULL GROUP BY 1, 2, 3""")
def ahead_behind(spark, folder):
    g = _geometry(spark, folder).filter(F.col("ball_x").isNotNull())

    def side(s):
        return F.struct(F.lit(s).alias("side"), F.size(s).alias("n"), rounded(f"{s}_ahead_right").alias("players_ahead_of_ball"),
                        rounded(f"{s}_behind_right").alias("players_behind_ball"),
                        rounded(f"{s}_centroid_to_ball_distance").alias("centroid_to_ball_distance"))

    e = g.select(*KEY, F.explode(F.array(side("home"), side("away"))).alias("e")).filter(F.col("e.n") > 0)
    return e.select(*KEY, "e.side", *[F.col(f"e.{c}") for c in ("players_ahead_of_ball", "players_behind_ball", "centroid_to_ball_distance")])


@catalog.query("reliability", f"""
WITH {PLAYERS}, {BALL}, n AS (SELECT match_id, frame_idx, count(*) FILTER (WHERE x IS NOT NULL) AS present,
  count(*) FILTER (WHERE x IS NOT NULL AND reliable) AS ok FROM pl GROUP BY 1, 2)
SELECT b.match_id, b.frame_idx, {r('ok / nullif(present, 0)', 'reliability_ratio')} FROM ball b LEFT JOIN n ON b.match_id = n.match_id AND b.frame_idx = n.frame_idx""")
def reliability(spark, folder):
    from playframe.plans.features import frame_reliability

    return tables.frames(spark, folder).select(*KEY, rounded(frame_reliability()["ratio"]).alias("reliability_ratio"))


@catalog.query("ball_owner_changes", f"""
WITH {PLAYERS}, {BALL}, d AS (SELECT b.match_id, b.frame_idx, p.side, min(sqrt((p.x - b.ball_x) ** 2 + (p.y - b.ball_y) ** 2)) AS d
  FROM ball b JOIN pl p ON p.match_id = b.match_id AND p.frame_idx = b.frame_idx WHERE b.ball_x IS NOT NULL AND p.x IS NOT NULL AND b.frame_idx % 5 = 0 GROUP BY 1, 2, 3),
o AS (SELECT match_id, frame_idx, arg_min(side, (d, side = 'away')) AS owner FROM d WHERE d < 10 GROUP BY 1, 2),
s AS (SELECT *, lag(owner) OVER (PARTITION BY match_id ORDER BY frame_idx) AS previous FROM o)
SELECT match_id, frame_idx, owner FROM s WHERE owner <> previous""")
def ball_owner_changes(spark, folder):
    """Turnovers: the closest side changes among sampled frames."""
    f = tables.frames(spark, folder).filter((F.col("frame_idx") % 5 == 0) & F.col("ball_x").isNotNull())
    owner = fx.ball_owner("home", "away", F.col("ball_x"), F.col("ball_y"), 10.0)
    return od.changes(f.select(*KEY, owner.alias("owner")), ["match_id"], ["frame_idx"], "owner", 4096.0).select(*KEY, "owner")


@catalog.query("player_speed", f"""
WITH {PLAYERS}, s AS (SELECT match_id, side, player_rank, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) * 25 AS v FROM pl WHERE x IS NOT NULL
  WINDOW w AS (PARTITION BY match_id, side, player_rank ORDER BY frame_idx))
SELECT match_id, side, {r('avg(v)', 'mean_player_speed')}, {r('stddev_pop(v)', 'std_player_speed')}, {r('max(v)', 'max_player_speed')} FROM s GROUP BY 1, 2""")
def player_speed(spark, folder):
    p = tables.player_points(spark, folder).select("match_id", "side", "player_rank", "frame_idx", "x", "y")
    s = od.steps(p, ["match_id", "side", "player_rank"], ["frame_idx"], "x", "y", 256.0)
    v = F.col("step") * 25
    return s.groupBy("match_id", "side").agg(rounded(F.avg(v)).alias("mean_player_speed"), rounded(F.stddev_pop(v)).alias("std_player_speed"),
                                             rounded(F.max(v)).alias("max_player_speed"))


@catalog.query("quiet_player", f"""
WITH {PLAYERS}, s AS (SELECT match_id, side, player_rank, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS v FROM pl WHERE x IS NOT NULL
  WINDOW w AS (PARTITION BY match_id, side, player_rank ORDER BY frame_idx)),
g AS (SELECT match_id, side, player_rank, count(*) AS n, coalesce(sum(v), 0) / count(*) AS d FROM s GROUP BY 1, 2, 3)
SELECT match_id, side, arg_min(player_rank, (CASE WHEN n >= 200 THEN 0 ELSE 1 END, d, player_rank))::VARCHAR AS pid FROM g GROUP BY 1, 2""")
def quiet_player(spark, folder):
    """Goalkeeper by least movement."""
    f = tables.frames(spark, folder)
    none = F.lit(None).cast("string")
    meta = f.select("match_id").distinct().select("match_id", none.alias("home_keeper"), none.alias("away_keeper"))
    return fm.keepers(f, meta, 200, 256.0)


@catalog.query("attack_directions", f"""
WITH {OWNED} SELECT match_id, frame_idx, {_DIR} AS direction, {r(f'CASE WHEN {_DIR} < 0 THEN 105.0 - ball_x ELSE ball_x END', 'ball_x')}
FROM own WHERE team IS NOT NULL AND ball_x IS NOT NULL""")
def attack_directions(spark, folder):
    o = _directed(spark, folder)
    return o.select(*KEY, "direction", rounded(dr.relative_x("ball_x", "direction", L)).alias("ball_x"))


def _directed(spark, folder):
    """Owned frames with a ball, direction and pitch size."""
    o = owner_stamp_frames(spark, folder).filter(F.col("team").isNotNull() & F.col("ball_x").isNotNull())
    d = dr.attack_direction("team", "period", F.lit(True), F.lit(None).cast("boolean"))
    return o.withColumns({"direction": d, "pitch_length": F.lit(L), "pitch_width": F.lit(W)})


@catalog.query("surface_values", f"""
WITH {OWNED}, d AS (SELECT *, {_DIR} AS dir FROM own WHERE team IS NOT NULL AND ball_x IS NOT NULL),
g AS (SELECT *, CASE WHEN dir = 1 THEN ball_x ELSE 105.0 - ball_x END AS gx FROM d), v AS (SELECT *, {_VAL.format(x='gx', y='ball_y')} AS v FROM g)
SELECT match_id, frame_idx, {r('v', 'xt')}, {r("CASE WHEN team = 'home' THEN v ELSE -v END", 'signed_xt')} FROM v""")
def surface_values(spark, folder):
    v = series.signed_values(_directed(spark, folder), SURFACE, "xt")
    return v.select(*KEY, rounded("xt").alias("xt"), rounded("signed_xt").alias("signed_xt"))


@catalog.query("best_value_nearby", f"""
WITH {OWNED}, d AS (SELECT *, {_DIR} AS dir FROM own WHERE team IS NOT NULL AND ball_x IS NOT NULL AND frame_idx % 5 = 0),
o AS (SELECT dx, dy FROM (SELECT unnest(generate_series(-5, 5)) AS dx) a, (SELECT unnest(generate_series(-5, 5)) AS dy) b WHERE dx * dx + dy * dy <= 25),
g AS (SELECT match_id, frame_idx, CASE WHEN dir = 1 THEN ball_x + dx ELSE 105.0 - (ball_x + dx) END AS gx, ball_y + dy AS gy FROM d, o
  WHERE ball_x + dx BETWEEN 0 AND 105 AND ball_y + dy BETWEEN 0 AND 68)
SELECT match_id, frame_idx, {r(f"max({_VAL.format(x='gx', y='gy')})", 'obso')} FROM g GROUP BY 1, 2""")
def best_value_nearby(spark, folder):
    f = _directed(spark, folder).filter(F.col("frame_idx") % 5 == 0)
    return series.obso(f, SURFACE, 5.0).select(*KEY, rounded("obso").alias("obso"))


_NEAR = """
cells AS (SELECT i, j, i * (105.0::DOUBLE / {n}) AS gx, j * (68.0::DOUBLE / {n}) AS gy FROM (SELECT unnest(generate_series(0, {n})) AS i) a, (SELECT unnest(generate_series(0, {n})) AS j) b),
p AS (SELECT match_id, frame_idx, side, player_rank, x, y FROM pl WHERE x IS NOT NULL AND {where}),
near AS (SELECT match_id, frame_idx, i, j, arg_min(side, (d, side = 'away', player_rank)) AS owner, arg_min(player_rank, (d, side = 'away', player_rank)) AS who
  FROM (SELECT p.*, i, j, sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) AS d FROM p, cells) GROUP BY 1, 2, 3, 4),
players AS (SELECT match_id, frame_idx, count(*) AS n FROM p GROUP BY 1, 2)"""


_OWN = """
cells AS (SELECT i, j, i * (105.0::DOUBLE / {nx}) AS gx, j * (68.0::DOUBLE / {ny}) AS gy FROM (SELECT unnest(generate_series(0, {nx})) AS i) a, (SELECT unnest(generate_series(0, {ny})) AS j) b),
p AS (SELECT match_id, frame_idx, side, x, y FROM pl WHERE x IS NOT NULL AND frame_idx % {stride} = 0),
players AS (SELECT match_id, frame_idx, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) >= 4),
near AS (SELECT match_id, frame_idx, i, j, coalesce(min(d) FILTER (WHERE side = 'home'), 'inf'::DOUBLE) <= coalesce(min(d) FILTER (WHERE side = 'away'), 'inf'::DOUBLE) AS home
  FROM (SELECT match_id, frame_idx, side, i, j, sqrt((x - gx) * (x - gx) + (y - gy) * (y - gy)) AS d FROM p JOIN players USING (match_id, frame_idx), cells) GROUP BY 1, 2, 3, 4)"""


@catalog.query("control_share", f"""
WITH {PLAYERS}, {BALL}, {_OWN.format(nx=59, ny=59, stride=2)},
s AS (SELECT match_id, frame_idx, avg(home::INT) AS home_control FROM near GROUP BY 1, 2)
SELECT match_id, frame_idx, {r("coalesce(home_control, 0.5)", 'home_control')} FROM ball LEFT JOIN s USING (match_id, frame_idx) WHERE frame_idx % 2 = 0""")
def control_share(spark, folder):
    """Home share on 60 x 60 nodes; the stride of two is the operator's own."""
    cfg = EngineConfig.clustering_preset()
    f = tables.frames(spark, folder).filter(F.col("frame_idx") % cfg.control_stride == 0)
    s = kernels.control_share(f.withColumns({"pitch_length": F.lit(L), "pitch_width": F.lit(W)}), cfg.control_share_nodes, cfg.control_min_players)
    return s.select(*KEY, rounded("home_control").alias("home_control"))


@catalog.query("control_map", f"""
WITH {PLAYERS}, {_OWN.format(nx=74, ny=44, stride=3)}
SELECT match_id, (i * 45 + j)::INT AS cell, count(*) AS frames, {r("avg(home::INT)", 'home_frac')} FROM near GROUP BY 1, 2""")
def control_map(spark, folder):
    """Mean ownership map per match on 75 x 45 nodes; the stride of three is
    the operator's own."""
    cfg = EngineConfig.possession_preset()
    f = tables.frames(spark, folder).filter(F.col("frame_idx") % cfg.control_stride == 0)
    t = kernels.control_totals(f.withColumns({"pitch_length": F.lit(L), "pitch_width": F.lit(W)}), ["match_id"], "nodes",
                               cfg.control_min_players, cfg.control_nodes_x, cfg.control_nodes_y)
    return t.select("match_id", "cell", "frames", rounded(F.col("home_frames") / F.col("frames")).alias("home_frac"))


@catalog.query("dangerous_space", f"""
WITH {PLAYERS}, {OWNED}, {_NEAR.format(n=29, where='frame_idx % 5 = 0')},
f AS (SELECT o.*, {_DIR} AS dir FROM own o JOIN players USING (match_id, frame_idx) WHERE team IS NOT NULL AND ball_x IS NOT NULL AND n >= 2),
dist AS (SELECT f.match_id, f.frame_idx, p.player_rank, sqrt((p.x - f.ball_x) ** 2 + (p.y - f.ball_y) ** 2) AS d FROM f JOIN p
  ON f.match_id = p.match_id AND f.frame_idx = p.frame_idx AND p.side = f.team),
car AS (SELECT match_id, frame_idx, arg_min(player_rank, (d, player_rank)) AS carrier, min(d) AS d FROM dist GROUP BY 1, 2 HAVING min(d) <= 12.0),
v AS (SELECT f.match_id, f.frame_idx, near.owner = f.team AS mine, near.who = car.carrier AS by_carrier, car.carrier IS NOT NULL AS has_carrier,
  {_VAL.format(x="(CASE WHEN f.dir = 1 THEN gx ELSE 105.0 - gx END)", y='gy')} AS val
  FROM f JOIN near ON f.match_id = near.match_id AND f.frame_idx = near.frame_idx JOIN cells USING (i, j)
  LEFT JOIN car ON f.match_id = car.match_id AND f.frame_idx = car.frame_idx),
a AS (SELECT (105.0::DOUBLE / 30) * (68.0::DOUBLE / 30) AS area)
SELECT match_id, frame_idx, {r('coalesce(sum(val) FILTER (WHERE mine), 0) * any_value(area)', 'das_score')}, {r('count(*) FILTER (WHERE mine) * any_value(area)', 'das_area_m2')},
  {r('coalesce(sum(val) FILTER (WHERE mine AND NOT coalesce(by_carrier, false)), 0) * any_value(area)', 'off_ball_xt')},
  {r('CASE WHEN bool_or(has_carrier) THEN coalesce(sum(val) FILTER (WHERE mine AND by_carrier), 0) * any_value(area) END', 'ball_carrier_xt')}
FROM v, a GROUP BY 1, 2""")
def dangerous_space(spark, folder):
    f = tables.frames(spark, folder).select(*KEY, "home", "away")
    owned = _directed(spark, folder).filter(F.col("frame_idx") % 5 == 0)
    j = owned.join(f, KEY).filter(F.size("home") + F.size("away") >= 2)
    d = kernels.dangerous_space(j, SURFACE, None, nodes=30, carrier_radius=12.0)
    return d.select(*KEY, *[rounded(c).alias(c) for c in kernels.DAS_FIELDS])


@catalog.query("hull_areas", f"""
WITH {PLAYERS}, p AS (SELECT DISTINCT match_id, frame_idx, side, x, y FROM pl WHERE x IS NOT NULL),
e AS (SELECT a.match_id, a.frame_idx, a.side, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.match_id = b.match_id AND a.frame_idx = b.frame_idx AND a.side = b.side AND (a.x, a.y) <> (b.x, b.y)),
h AS (SELECT e.match_id, e.frame_idx, e.side, ax, ay, bx, b_y FROM e JOIN p c ON e.match_id = c.match_id AND e.frame_idx = c.frame_idx AND e.side = c.side GROUP BY ALL
  HAVING bool_and((round((bx - ax) * 10) * round((c.y - ay) * 10) - round((b_y - ay) * 10) * round((c.x - ax) * 10)) > 0
    OR ((round((bx - ax) * 10) * round((c.y - ay) * 10) - round((b_y - ay) * 10) * round((c.x - ax) * 10)) = 0
        AND (c.x - ax) * (c.x - bx) + (c.y - ay) * (c.y - b_y) <= 1e-9))),
s AS (SELECT match_id, frame_idx, side, sum(ax * b_y - bx * ay) / 2 AS area, count(*) AS n FROM h GROUP BY 1, 2, 3)
SELECT match_id, frame_idx, side, {r('area', 'area')} FROM s WHERE n >= 3""")
def hull_areas(spark, folder):
    return _by_side(_geometry(spark, folder), ("area",)).filter(F.col("area").isNotNull())


@catalog.query("formation_fit")
def formation_fit(spark, folder):
    """Cheapest template per frame and side with eight players."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("players")) for s in ("home", "away")])
    f = tables.frames(spark, folder).select(*KEY, F.explode(sides).alias("e")).filter(F.size("e.players") >= 8)
    p = f.select(*KEY, "e.side", F.transform("e.players", lambda q: q["x"]).alias("xs"), F.transform("e.players", lambda q: q["y"]).alias("ys"),
                 F.lit(L).alias("pl"), F.lit(W).alias("pw"))
    m = fm.match_templates(p, "xs", "ys", F.col("side") == "away", "pl", "pw", fm.default_templates())
    return m.select(*KEY, "side", "formation", fm.variant("formation").alias("variant"), fm.family("formation").alias("family"), rounded("cost").alias("cost"))


@catalog.query("surface_lookup_events", f"""
SELECT event_id, {r(_VAL.format(x="(((event_id * 37) % 1200) / 10.0::DOUBLE - 5)", y="(((event_id * 53) % 800) / 10.0::DOUBLE - 5)"), 'value')} FROM events""")
def surface_lookup_events(spark, folder):
    """Lookup with clipping of points off the pitch."""
    e = tables.table(spark, folder, "events")
    x = F.col("event_id") * 37 % 1200 / 10.0 - 5
    y = F.col("event_id") * 53 % 800 / 10.0 - 5
    return e.select("event_id", rounded(surface_lookup(SURFACE, x, y, L, W)).alias("value"))
