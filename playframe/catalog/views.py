"""The sample views of ``sources.tables`` again, as SQL for the checks."""

EV = """
ev AS (
  SELECT user_id AS match_id, user_id AS sequence_id, event_id AS ordinal, epoch_us(ts) / 1e6 AS t,
         event_type, value, event_type = 'error' AS is_stop,
         event_type IN ('view', 'click') AS is_pass,
         event_type = 'purchase' AND value > 60 AS is_shot,
         event_type IN ('view', 'click') AND NOT (event_type = 'click' AND value > 60) AS completed,
         value / 50 AS mean_disp, ((event_id * 37) % 100) / 20.0::DOUBLE AS max_disp,
         CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS team
  FROM events)"""

BALL_POINTS = """
fr AS (
  SELECT user_id AS match_id, event_id AS frame_idx, epoch_us(ts) / 1e6 AS elapsed,
         CASE WHEN dayofmonth(ts) <= 15 THEN 1 ELSE 2 END AS period,
         ((event_id * 37) % 1050) / 10.0::DOUBLE AS x, ((event_id * 53) % 680) / 10.0::DOUBLE AS y,
         CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'away' END AS team, value
  FROM events)"""

PLAYERS = """
raw_pl AS (
  SELECT l_orderkey // 5 AS frame, ((l_orderkey % 5) * 7 + l_linenumber - 1) AS slot,
         max(l_partkey * 1000 + l_suppkey % 1000) AS code
  FROM lineitem GROUP BY 1, 2),
pl AS (
  SELECT frame // 500 AS match_id, frame % 500 AS frame_idx, 1 + (frame % 500) // 250 AS period,
         ((frame % 500) % 250)::DOUBLE AS elapsed,
         CASE WHEN slot < 18 THEN 'home' ELSE 'away' END AS side, slot % 18 AS player_rank,
         CASE WHEN code % 97 <> 0 THEN (code * 37 % 1051) / 10.0::DOUBLE END AS x,
         CASE WHEN code % 97 <> 0 THEN (code * 53 % 681) / 10.0::DOUBLE END AS y,
         code % 10 <> 0 AS reliable
  FROM raw_pl)"""

BALL = """
raw_ball AS (SELECT o_orderkey // 5 AS frame, sum(o_custkey)::BIGINT AS code FROM orders GROUP BY 1),
ball AS (
  SELECT frame // 500 AS match_id, frame % 500 AS frame_idx, 1 + (frame % 500) // 250 AS period,
         ((frame % 500) % 250)::DOUBLE AS elapsed,
         CASE WHEN code % 11 <> 0 THEN (code * 37 % 1051) / 10.0::DOUBLE END AS ball_x,
         CASE WHEN code % 11 <> 0 THEN (code * 53 % 681) / 10.0::DOUBLE END AS ball_y
  FROM raw_ball)"""

SPANS = """
raw_spans AS (SELECT o_orderkey // 50 AS poss_id, sum(o_custkey)::BIGINT AS code FROM orders GROUP BY 1),
spans AS (
  SELECT poss_id // 50 AS match_id, poss_id, (poss_id % 50) * 10 + code % 5 AS start_frame,
         (poss_id % 50) * 10 + code % 5 + 3 + code % 15 AS end_frame,
         CASE WHEN code % 2 = 0 THEN 'home' ELSE 'away' END AS team
  FROM raw_spans)"""

OWNED = BALL + "," + SPANS + """,
own AS (
  SELECT b.*, s.team FROM ball b LEFT JOIN (
    SELECT match_id, frame_idx, arg_max(team, poss_id) AS team FROM (
      SELECT b.match_id, b.frame_idx, s.poss_id, s.team FROM ball b JOIN spans s
      ON b.match_id = s.match_id AND b.frame_idx BETWEEN s.start_frame AND s.end_frame) GROUP BY 1, 2) s
  ON b.match_id = s.match_id AND b.frame_idx = s.frame_idx)"""

ORDER_SPANS = """
os AS (
  SELECT o_custkey AS entity, o_orderkey AS ordinal, (epoch_us(o_orderdate) / 1e6) / 86400.0::DOUBLE AS day,
         o_orderpriority AS label, o_totalprice AS price, o_orderstatus AS status,
         coalesce(lead((epoch_us(o_orderdate) / 1e6) / 86400.0::DOUBLE) OVER w, (epoch_us(o_orderdate) / 1e6) / 86400.0::DOUBLE + 1) AS end_day
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""

CELLS = """
cell AS (
  SELECT l_suppkey AS map_id, round(l_discount * 100)::INT AS row, l_quantity::INT - 1 AS col,
         l_extendedprice AS amount, l_returnflag AS side, l_linestatus AS state
  FROM lineitem)"""

VEC = """
vec AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS f FROM embeddings)"""


def r(expr: str, name: str) -> str:
    """Rounded output column."""
    return f"round({expr}, 6) + 0.0 AS {name}"
