"""Possessions, phases and their event aggregates, from an event feed with frames.

The feed is the event log again, five users to a match and one sequence to a user;
an event has a frame of its own. Units of every other user have no frame ids, so
their bounds come from the clock.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from playframe.catalog import Catalog
from playframe.catalog.views import PLAYERS, r
from playframe.config import EngineConfig
from playframe.functions.nulls import rounded
from playframe.plans import movement, possessions as ps
from playframe.sources import tables

catalog = Catalog()
DAY = 86400.0
CFG = replace(EngineConfig(), threshold_mean=2.0, threshold_max=4.0, max_window_passes=3, max_window_seconds=2 * DAY, block_seconds=5 * DAY)

_FEED = """
fd AS (
  SELECT user_id // 5 AS match_id, event_id AS ordinal, CASE WHEN event_type <> 'error' THEN user_id END AS sequence, epoch_us(ts) / 1e6 AS t, event_type, value,
    CASE event_type WHEN 'view' THEN 'PA' WHEN 'click' THEN 'CR' WHEN 'purchase' THEN CASE WHEN value > 60 THEN 'SH' ELSE 'BC' END WHEN 'signup' THEN 'BC' END AS kind,
    CASE WHEN event_type = 'view' OR event_type = 'click' AND value <= 60 THEN 'C' ELSE 'I' END AS outcome,
    user_id % 2 = 0 AS home, CASE WHEN event_type <> 'signup' THEN value > 25 END AS home_ball, CASE WHEN dayofmonth(ts) <= 15 THEN 1 ELSE 2 END AS period,
    event_id // 3 AS game_event, CASE WHEN user_id % 2 = 0 THEN event_id END AS id, value > 150 AS video_missing,
    ((event_id * 37) % 1050) / 10.0::DOUBLE AS x, ((event_id * 53) % 680) / 10.0::DOUBLE AS y FROM events)"""
_PASS = "kind IN ('PA', 'CR')"

#: bounds, direction and first game event of units ``u`` (match, unit, team, period, clocks, ids) with members ``mem``
_UNITS = """
f1 AS (SELECT match_id, unit, game_event, arg_min(event_type, (t, ordinal)) AS s, arg_min(video_missing, (t, ordinal)) AS v, min(t) AS t, arg_min(ordinal, (t, ordinal)) AS o
  FROM mem GROUP BY 1, 2, 3),
f2 AS (SELECT match_id, unit, arg_min(s, (t, o)) AS setpiece_type, bool_or(v) AS video_missing FROM f1 GROUP BY 1, 2),
b AS (SELECT u.*,
  coalesce(lo, (SELECT arg_min(ordinal, (t, ordinal)) FROM fd WHERE fd.match_id = u.match_id AND fd.t >= u.min_clock)) * 2 AS start_frame,
  coalesce(hi, (SELECT arg_min(ordinal, (t, ordinal)) FROM fd WHERE fd.match_id = u.match_id AND fd.t >= u.max_clock)) * 2 AS end_frame,
  CASE WHEN ((match_id % 2 = 0) = (period % 2 = 1)) = (team = 'home') THEN 1 ELSE -1 END AS direction FROM u)"""

_POSSESSIONS = f"""
WITH {_FEED}, mem AS (SELECT *, sequence::VARCHAR AS unit FROM fd WHERE sequence IS NOT NULL),
u AS (SELECT match_id, unit, any_value(sequence) AS sequence_id,
  CASE WHEN count(home_ball) > 0 THEN CASE WHEN count(*) FILTER (WHERE home_ball) >= count(*) FILTER (WHERE NOT home_ball) THEN 'home' ELSE 'away' END
       ELSE CASE WHEN count(*) FILTER (WHERE home) >= count(*) FILTER (WHERE NOT home) THEN 'home' ELSE 'away' END END AS team,
  min(t) AS start_sec, max(t + 1) AS end_sec, arg_min(period, ordinal) AS period, min(t) AS min_clock, max(t) AS max_clock, min(id) AS lo, max(id) AS hi FROM mem GROUP BY 1, 2),
{_UNITS.replace("(t, ordinal)) AS s", "ordinal) AS s").replace("(t, ordinal)) AS v, min(t) AS t, arg_min(ordinal, (t, ordinal)) AS o", "ordinal) AS v, arg_min(t, ordinal) AS t, min(ordinal) AS o")}"""

_PHASES = f"""
WITH RECURSIVE {_FEED},
marked AS (
  SELECT *, event_type = 'error' AS is_stop, {_PASS} AND outcome = 'C' AS completed, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY match_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS stops,
    CASE WHEN {_PASS} AND outcome = 'C' AND ordinal % 11 <> 0 AND value / 50 > 2.0 AND ((ordinal * 37) % 100) / 20.0::DOUBLE > 4.0 THEN 'threshold_both'
         WHEN {_PASS} AND outcome = 'C' AND ordinal % 11 <> 0 AND value / 50 > 2.0 THEN 'threshold_mean'
         WHEN {_PASS} AND outcome = 'C' AND ordinal % 11 <> 0 AND ((ordinal * 37) % 100) / 20.0::DOUBLE > 4.0 THEN 'threshold_max'
         WHEN {_PASS} AND outcome <> 'C' THEN 'failed_pass' WHEN kind = 'SH' THEN 'shot' END AS reason FROM fd),
play AS (SELECT *, row_number() OVER w AS rn, stops > lag(stops) OVER w AS brk, count(*) OVER (PARTITION BY match_id, sequence) AS n_rows,
  min(ordinal) OVER (PARTITION BY match_id, sequence) AS seq_first FROM marked WHERE sequence IS NOT NULL WINDOW w AS (PARTITION BY match_id, sequence ORDER BY t, ordinal)),
walk AS (
  SELECT match_id, sequence, rn, ordinal, ordinal AS wfirst, t AS wstart, completed::INT AS passes,
    coalesce(reason, CASE WHEN completed::INT >= {CFG.max_window_passes} THEN 'max_passes' END) AS why FROM play WHERE rn = 1
  UNION ALL
  SELECT p.match_id, p.sequence, p.rn, p.ordinal, CASE WHEN p.brk OR w.why IS NOT NULL THEN p.ordinal ELSE w.wfirst END,
    CASE WHEN p.brk OR w.why IS NOT NULL THEN p.t ELSE w.wstart END, CASE WHEN p.brk OR w.why IS NOT NULL THEN 0 ELSE w.passes END + p.completed::INT,
    coalesce(p.reason, CASE WHEN CASE WHEN p.brk OR w.why IS NOT NULL THEN 0 ELSE w.passes END + p.completed::INT >= {CFG.max_window_passes} THEN 'max_passes'
      WHEN p.t - CASE WHEN p.brk OR w.why IS NOT NULL THEN p.t ELSE w.wstart END > {CFG.max_window_seconds} THEN 'max_time' END)
  FROM walk w JOIN play p ON p.match_id = w.match_id AND p.sequence = w.sequence AND p.rn = w.rn + 1),
mem AS (SELECT p.*, w.wfirst AS unit, w.why FROM play p JOIN walk w USING (match_id, sequence, rn)),
u AS (SELECT match_id, unit, any_value(sequence) AS sequence_id, CASE WHEN any_value(home) THEN 'home' ELSE 'away' END AS team, min(t) AS start_sec, max(t) AS end_sec,
  arg_min(period, (t, ordinal)) AS period, min(t) AS min_clock, max(t) AS max_clock, min(id) AS lo, max(id) AS hi, count(*) FILTER (WHERE completed) AS n_passes,
  coalesce(arg_max(why, rn) FILTER (WHERE why IS NOT NULL), CASE WHEN max(rn) < max(n_rows) THEN 'stoppage_break' ELSE 'sequence_end' END) AS reason_closed,
  row_number() OVER (PARTITION BY match_id ORDER BY min(seq_first), min(t), min(ordinal)) AS number FROM mem GROUP BY 1, 2),
{_UNITS}"""


def _feed(spark, folder):
    e = tables.event_log(spark, folder)
    kind, value, user = F.col("event_type"), F.col("value"), F.col("match_id")
    code = F.when(kind == "view", "PA").when(kind == "click", "CR").when(F.col("is_shot"), "SH").when(kind.isin("purchase", "signup"), "BC")
    number = F.col("ordinal")

    def named(letter, n):
        return F.concat(F.lit(letter), (number % n).cast("string"))

    return e.select(
        F.floor(user / 5).cast("bigint").alias("match_id"), number, F.when(~F.col("is_stop"), user).alias("sequence"),
        F.col("t").alias("event_time"), F.col("t").alias("start_time"), (F.col("t") + 1).alias("end_time"), F.col("t").alias("game_clock"),
        F.when(F.dayofmonth(F.timestamp_micros((F.col("t") * 1e6).cast("bigint"))) <= 15, 1).otherwise(2).alias("period"),
        F.when(F.col("is_stop"), "OUT").otherwise("OTB").alias("game_event_type"), code.alias("possession_event_type"),
        F.when(F.col("completed"), "C").otherwise("I").alias("outcome"), (user % 2 == 0).alias("home_team"),
        F.when(kind != "signup", value > 25).alias("home_ball"), number.alias("possession_event_id"), F.floor(number / 3).cast("bigint").alias("game_event_id"),
        F.when(user % 2 == 0, number).alias("id_lo"), F.when(user % 2 == 0, number).alias("id_hi"), kind.alias("setpiece_type"), (value > 150).alias("video_missing"),
        F.when(value > 40, "M").alias("lines_broken"), (value > 10).alias("carry_successful"), F.when(value > 150, "G").when(value > 100, "S").otherwise("O").alias("shot_outcome"),
        F.when(kind == "click", "A").otherwise("N").alias("pressure_type"), F.when(number % 5 == 0, "C").when(number % 5 == 1, "D").alias("opportunity_type"),
        named("t", 3).alias("pass_type"), named("a", 2).alias("accuracy_type"), named("r", 4).alias("incompletion_reason"), named("i", 2).alias("carry_intent"),
        named("c", 3).alias("carry_type"), "value")


def _frames(spark, folder):
    b = tables.ball_points(spark, folder)
    return b.select(F.floor(F.col("match_id") / 5).cast("bigint").alias("match_id"), "frame_idx", (F.col("frame_idx") * 2).alias("frame_num"), "elapsed",
                    F.col("elapsed").alias("game_clock"), "period", F.col("x").alias("ball_x"), F.col("y").alias("ball_y"))


def _matches(feed):
    m = feed.select("match_id").distinct()
    return m.select("match_id", (F.col("match_id") % 2 == 0).alias("start_left"), F.lit(None).cast("boolean").alias("start_left_extra"))


@catalog.query("possession_rows", _POSSESSIONS + f"""
SELECT match_id, sequence_id, team, period, {r('start_sec', 'start_sec')}, {r('end_sec', 'end_sec')}, start_frame, end_frame, direction, setpiece_type, video_missing
FROM b JOIN f2 USING (match_id, unit)""")
def possession_rows(spark, folder):
    feed = _feed(spark, folder)
    units, _ = ps.possessions(feed, _frames(spark, folder), _matches(feed), CFG)
    return units.select("match_id", "sequence_id", "team", "period", rounded("start_sec").alias("start_sec"), rounded("end_sec").alias("end_sec"),
                        "start_frame", "end_frame", "direction", "setpiece_type", "video_missing")


@catalog.query("phase_rows", _PHASES + f"""
SELECT match_id, sequence_id || '_' || number AS window_id, sequence_id, team, period, {r('start_sec', 'start_sec')}, {r('end_sec', 'end_sec')}, start_frame, end_frame, direction,
  n_passes, reason_closed, setpiece_type, video_missing FROM b JOIN f2 USING (match_id, unit)""")
def phase_rows(spark, folder):
    feed = _feed(spark, folder)
    scores = feed.select("match_id", "possession_event_id", "event_time", F.when(F.col("ordinal") % 11 == 0, "few_valid").otherwise("ok").alias("status"),
                         (F.col("value") / 50).alias("mean_disp"), (F.pmod(F.col("ordinal") * 37, F.lit(100)) / 20.0).alias("max_disp"))
    units, _ = ps.phases(feed, _frames(spark, folder), _matches(feed), scores, CFG)
    return units.select("match_id", "window_id", "sequence_id", "team", "period", rounded("start_sec").alias("start_sec"), rounded("end_sec").alias("end_sec"),
                        "start_frame", "end_frame", "direction", F.col("n_passes_in_window").alias("n_passes"), "reason_closed", "setpiece_type", "video_missing")


_COUNTS = {"n_events": "true", "n_carrys": "kind = 'BC'", "n_crosss": "kind = 'CR'", "n_passs": "kind = 'PA'", "n_shots": "kind = 'SH'", "n_pass_attempts": _PASS,
           "n_completed_passes": f"{_PASS} AND outcome = 'C'", "lines_broken_count": f"{_PASS} AND value > 40", "successful_carries": "kind = 'BC' AND value > 10",
           "goals": "kind = 'SH' AND value > 150", "shots_on_target": "kind = 'SH' AND value > 100", "n_pressured_actions": "event_type = 'click'",
           "n_chances_created": "ordinal % 5 = 0", "n_dangerous_positions": "ordinal % 5 = 1"}
_RATES = {"pass_completion_rate": ("n_completed_passes", "n_pass_attempts"), "carry_success_rate": ("successful_carries", "n_carrys"), "pressure_rate": ("n_pressured_actions", "n_events")}
_SHARES = {"pass_type": (_PASS, "'t' || ordinal % 3"), "accuracy_type": (f"{_PASS} AND outcome = 'C'", "'a' || ordinal % 2"),
           "incompletion_reason": (f"{_PASS} AND outcome <> 'C'", "'r' || ordinal % 4"), "carry_intent": ("kind = 'BC'", "'i' || ordinal % 2"), "carry_type": ("kind = 'BC'", "'c' || ordinal % 3")}
_PROGRESS = ("mean_progression_distance", "total_progression_distance", "mean_forward_progression", "total_forward_progression")


@catalog.query("possession_events", _POSSESSIONS + f""",
n AS (SELECT match_id, unit, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in _COUNTS.items())} FROM mem GROUP BY 1, 2),
s AS (SELECT match_id, unit, d, '{{' || string_agg('"' || k || '":' || c, ',' ORDER BY c DESC, k) || '}}' AS j FROM (SELECT match_id, unit, d, k, count(*) AS c FROM ("""
               + " UNION ALL ".join(f"SELECT match_id, unit, '{d}' AS d, {k} AS k FROM mem WHERE {c}" for d, (c, k) in _SHARES.items()) + f""") GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
m AS (SELECT match_id, unit, t, ordinal, CASE WHEN ordinal % 7 <> 0 THEN x END AS x, CASE WHEN ordinal % 7 <> 0 THEN y END AS y FROM mem WHERE {_PASS} OR kind = 'BC'),
l AS (SELECT match_id, unit, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM m WINDOW w AS (PARTITION BY match_id, unit ORDER BY t, ordinal)),
g AS (SELECT match_id, unit, avg(sqrt(dx * dx + dy * dy)) AS p0, sum(sqrt(dx * dx + dy * dy)) AS p1, avg(direction * dx) AS p2, sum(direction * dx) AS p3 FROM l JOIN b USING (match_id, unit) GROUP BY 1, 2)
SELECT match_id, sequence_id, {', '.join(_COUNTS)}, {', '.join(r(f'{a} / nullif({c}, 0)', k) for k, (a, c) in _RATES.items())},
  {', '.join(f"coalesce((SELECT j FROM s WHERE s.match_id = n.match_id AND s.unit = n.unit AND d = '{d}'), '{{}}') AS {d}_distribution" for d in _SHARES)},
  {', '.join(r(f'p{i}', k) for i, k in enumerate(_PROGRESS))}
FROM n JOIN b USING (match_id, unit) LEFT JOIN g USING (match_id, unit)""")
def possession_events(spark, folder):
    feed, frames = _feed(spark, folder), _frames(spark, folder)
    units, members = ps.possessions(feed, frames, _matches(feed), CFG)
    located = feed.select("match_id", "ordinal", F.when(F.col("ordinal") % 7 != 0, F.col("ordinal")).alias("frame"))
    out = ps.event_aggregates(members, located, units, frames, CFG)
    return out.select("match_id", F.col("unit").cast("bigint").alias("sequence_id"), *_COUNTS, *[rounded(c).alias(c) for c in _RATES],
                      *[f"{d}_distribution" for d in _SHARES], *[rounded(c).alias(c) for c in _PROGRESS])


_MEASURES = ("mean_disp", "median_disp", "max_disp", "min_disp", "std_disp")


@catalog.query("movement_scores", f"""
WITH {PLAYERS}, p AS (SELECT match_id, frame_idx, side, player_rank, x * 1.0137 AS x, y * 1.0137 AS y FROM pl WHERE x IS NOT NULL),
ev AS (SELECT *, lead(frame_idx) OVER (PARTITION BY match_id, frame_idx // 10 ORDER BY frame_idx) AS nxt, CASE WHEN frame_idx % 2 = 0 THEN 'home' ELSE 'away' END AS team
  FROM (SELECT DISTINCT match_id, frame_idx FROM p)),
c AS (SELECT * FROM ev WHERE frame_idx % 3 <> 0 AND frame_idx % 5 <> 0),
n AS (SELECT match_id, frame_idx, side, count(*) AS n FROM p WHERE player_rank <> 0 GROUP BY 1, 2, 3),
j AS (SELECT c.match_id, c.frame_idx, sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) AS d FROM c
  JOIN p a ON a.match_id = c.match_id AND a.frame_idx = c.frame_idx AND a.side = c.team AND a.player_rank <> 0
  JOIN p b ON b.match_id = c.match_id AND b.frame_idx = c.nxt AND b.side = c.team AND b.player_rank = a.player_rank),
d AS (SELECT match_id, frame_idx, count(*) AS n_valid, avg(d) AS mean_disp, quantile_cont(d, 0.5) AS median_disp, max(d) AS max_disp, min(d) AS min_disp, stddev_pop(d) AS std_disp,
  count(*) FILTER (WHERE d > 1) AS a1, count(*) FILTER (WHERE d > 2) AS a2, count(*) FILTER (WHERE d > 5) AS a5 FROM j GROUP BY 1, 2),
s AS (SELECT c.*, coalesce(d.n_valid, 0) AS nv, d.*, CASE WHEN nxt IS NULL THEN 'no_next_event' WHEN b.n IS NULL OR a.n IS NULL THEN 'empty_snapshot'
    WHEN coalesce(d.n_valid, 0) < {CFG.min_common_players} THEN 'few_valid' ELSE 'ok' END AS status
  FROM c LEFT JOIN d ON d.match_id = c.match_id AND d.frame_idx = c.frame_idx LEFT JOIN n b ON b.match_id = c.match_id AND b.frame_idx = c.frame_idx AND b.side = team
  LEFT JOIN n a ON a.match_id = c.match_id AND a.frame_idx = nxt AND a.side = team)
SELECT match_id, frame_idx AS possession_event_id, frame_idx // 10 AS sequence_id, team, status,
  CASE WHEN status = 'ok' THEN CASE WHEN nxt % 3 <> 0 THEN 'PA' ELSE 'BC' END END AS next_event_type, CASE WHEN status IN ('ok', 'few_valid') THEN nv::DOUBLE END AS n_valid,
  CASE WHEN status = 'ok' AND frame_idx % 4 * 4 <= {CFG.max_touch_seconds} THEN frame_idx % 4 * 4.0::DOUBLE END AS touch_duration,
  CASE WHEN status = 'ok' THEN (nxt - frame_idx)::DOUBLE END AS time_to_next, {', '.join(r(f"CASE WHEN status = 'ok' THEN {m} END", m) for m in _MEASURES)},
  {', '.join(f"CASE WHEN status = 'ok' THEN a{t}::DOUBLE END AS n_above_{t}m" for t in (1, 2, 5))} FROM s""")
def movement_scores(spark, folder):
    """Frames as events, ten to a sequence: two of three are passes, one of five of them fails; each squad's first player keeps goal."""
    f = tables.frames(spark, folder).filter(F.size("home") + F.size("away") > 0)
    n = F.col("frame_idx")

    def players(side):
        return F.transform(side, lambda p: F.struct(p["pid"].alias("playerId"), F.when(p["pid"] == 0, "GK").otherwise("M").alias("positionGroupType"),
                                                    (p["x"] * 1.0137).alias("x"), (p["y"] * 1.0137).alias("y")))

    events = f.select(
        "match_id", n.alias("ordinal"), F.floor(n / 10).alias("sequence"), n.cast("double").alias("event_time"), n.cast("double").alias("start_time"),
        (n + n % 4 * 4).cast("double").alias("end_time"), n.alias("game_event_id"), n.alias("possession_event_id"), F.lit(1).alias("period"), (n % 2 == 0).alias("home_team"),
        F.lit("O").alias("setpiece_type"), F.when(n % 3 != 0, "PA").otherwise("BC").alias("possession_event_type"), F.lit("OTB").alias("game_event_type"),
        F.when(n % 5 != 0, "C").otherwise("I").alias("outcome"), players("home").alias("homePlayers"), players("away").alias("awayPlayers"))
    s = movement.movement_scores(events, replace(CFG, block_seconds=64.0))
    return s.select("match_id", "possession_event_id", "sequence_id", "team", "status", "next_event_type", F.col("n_valid").cast("double").alias("n_valid"), "touch_duration",
                    "time_to_next", *[rounded(m).alias(m) for m in _MEASURES], *[F.col(f"n_above_{t}m").cast("double").alias(f"n_above_{t}m") for t in (1, 2, 5)])
