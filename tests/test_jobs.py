"""Readers and both jobs on two synthetic matches, against plain Python."""

import bz2
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from match_data import PITCHES
from playframe.config import STOPPAGE_TYPES, EngineConfig
from playframe.plans import jobs, maps, movement
from playframe.sources import events as ev
from playframe.sources import files
from playframe.sources.tracking import quality_report
from test_segments import plain_fold

GRID = [[((r * 7 + c * 13) % 97) / 97.0 for c in range(16)] for r in range(12)]


@pytest.fixture(scope="module")
def cfg():
    return EngineConfig.clustering_preset(max_window_passes=4, max_window_seconds=6.0, window_min_observations=50, keeper_min_frames=50)


@pytest.fixture(scope="module")
def inputs(spark, match_folder, cfg):
    inp = jobs.load_inputs(spark, str(match_folder), cfg)
    inp.danger = inp.threat = GRID
    return inp


@pytest.fixture(scope="module")
def phases(inputs, cfg):
    return jobs.build_phases(inputs, cfg)


@pytest.fixture(scope="module")
def phase_rows(phases):
    return phases.phases.toPandas()


def raw_frames(folder, match):
    out = []
    with bz2.open(folder / match / "tracking.jsonl.bz2", "rt") as f:
        for line in f:
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return out


def side_positions(row, side, pl, pw):
    ps = row.get(f"{side}PlayersSmoothed") or row.get(f"{side}Players") or []
    return {p["jerseyNum"]: (np.float32(p["x"] + pl / 2), np.float32(p["y"] + pw / 2)) for p in ps if p["jerseyNum"]}


def flat_events(folder, match):
    raw = json.loads((folder / match / "events.json").read_text())
    raw = raw.get("data") if isinstance(raw, dict) else raw
    out = []
    for r in raw:
        flat = dict(r)
        for k in ev.SUB_RECORDS:
            if isinstance(r.get(k), dict):
                flat.update(r[k])
        out.append(flat)
    return out


def test_discovery_skips_incomplete_folders(spark, match_folder):
    assert [r.match_id for r in files.discover(spark, str(match_folder)).collect()] == ["m1", "m2"]
    assert [r.match_id for r in files.discover(spark, str(match_folder), 1).collect()] == ["m1"]


def test_metadata_shapes(inputs):
    got = {r.match_id: r for r in inputs.matches.collect()}
    assert (got["m1"].pitch_length, got["m1"].pitch_width) == PITCHES["m1"]
    assert (got["m2"].pitch_length, got["m2"].pitch_width) == PITCHES["m2"]
    assert got["m1"].fps == 5 and got["m1"].home_keeper is None and got["m2"].home_keeper == "1"


def test_frames_match_the_files(inputs, match_folder):
    for match, (pl, pw) in PITCHES.items():
        raw = raw_frames(match_folder, match)
        rows = inputs.frames.filter(F.col("match_id") == match).orderBy("frame_idx").collect()
        assert [r.frame_idx for r in rows] == list(range(len(raw)))
        assert [r.frame_num for r in rows] == [f["frameNum"] for f in raw]
        for r, f in list(zip(rows, raw))[::29]:
            want = side_positions(f, "home", pl, pw)
            assert [p.pid for p in r.home] == sorted(want, key=int)
            assert [p.rank for p in r.home] == list(range(len(want)))
            assert all((p.x, p.y) == (float(want[p.pid][0]), float(want[p.pid][1])) for p in r.home)
            b = f["balls"]
            b = b[0] if isinstance(b, list) and b else (b or None)
            assert (r.ball_x is None) == (b is None)
            if b:
                assert r.ball_x == float(np.float32(b["x"] + pl / 2))


def test_events_are_overlaid(inputs, match_folder):
    rows = inputs.events.filter(F.col("match_id") == "m1").orderBy("ordinal").collect()
    raw = flat_events(match_folder, "m1")
    assert len(rows) == len(raw)
    for r, e in zip(rows, raw):
        assert r.sequence == (int(e["sequence"]) if e["sequence"] is not None else None)
        assert r.possession_event_type == e.get("possessionEventType")
        assert r.outcome == (e.get("passOutcomeType") or e.get("crossOutcomeType"))
        assert r.event_time == e["eventTime"] and r.home_team == e["homeTeam"]


def test_explicit_null_hides_an_outer_value(spark, tmp_path):
    d = tmp_path / "x"
    d.mkdir()
    (d / "events.json").write_text(json.dumps({"sequence": 4, "gameEvents": {"sequence": None, "startTime": 1.5}, "fouls": [1]}))
    r = ev.read_events(spark, str(tmp_path)).first()
    assert r.sequence is None and r.start_time == 1.5 and r.match_id == "x"


def test_quality_report(inputs):
    for r in quality_report(inputs.frames).collect():
        assert r.n_frames == 900 and r.frames_with_home == 900 and r.frames_with_ball < 900


def test_movement_scores(spark, inputs, match_folder, cfg):
    got = {(r.match_id, r.event_time): r for r in movement.movement_scores(inputs.events, cfg).collect()}
    for match in PITCHES:
        seqs = {}
        for i, e in enumerate(flat_events(match_folder, match)):
            if e["sequence"] is not None:
                seqs.setdefault(int(e["sequence"]), []).append((e["eventTime"], i, e))
        for rows in seqs.values():
            rows.sort(key=lambda r: r[:2])
            for k, (t, _, e) in enumerate(rows):
                done = e.get("possessionEventType") in ("PA", "CR") and (e.get("passOutcomeType") or e.get("crossOutcomeType")) == "C"
                if not done:
                    assert (match, t) not in got
                    continue
                r = got[(match, t)]
                if k + 1 == len(rows):
                    assert r.status == "no_next_event"
                    continue
                nxt, side = rows[k + 1][2], "homePlayers" if e["homeTeam"] else "awayPlayers"
                if not e.get(side) or not nxt.get(side):
                    assert r.status == "missing_snapshot"
                    continue
                pos = [{p["playerId"]: (p["x"], p["y"]) for p in s[side] if p["positionGroupType"] != "GK"} for s in (e, nxt)]
                d = [math.hypot(pos[1][i][0] - pos[0][i][0], pos[1][i][1] - pos[0][i][1]) for i in pos[0] if i in pos[1]]
                assert r.status == "ok" and r.n_valid == len(d)
                assert (r.mean_disp, r.median_disp, r.max_disp) == pytest.approx((np.mean(d), np.median(d), max(d)))
                assert r.std_disp == pytest.approx(np.std(d)) and r.n_above_2m == sum(x > 2 for x in d)


def test_phases_match_the_fold(inputs, phases, phase_rows, match_folder, cfg):
    scores = {(r.match_id, r.possession_event_id): (r.mean_disp, r.max_disp) for r in phases.movement.collect()}
    for match in PITCHES:
        rows = []
        for i, e in enumerate(flat_events(match_folder, match)):
            stop = e["sequence"] is None
            if stop and e.get("gameEventType") not in STOPPAGE_TYPES:
                continue
            kind, out = e.get("possessionEventType"), e.get("passOutcomeType") or e.get("crossOutcomeType")
            is_pass = kind in ("PA", "CR")
            reason = None
            if is_pass and out == "C":
                m = scores.get((match, e.get("possessionEventId")))
                if m and e.get("possessionEventId"):
                    a, b = m[0] > 2, m[1] > 4
                    reason = "threshold_both" if a and b else "threshold_mean" if a else "threshold_max" if b else None
            elif is_pass:
                reason = "failed_pass"
            elif kind == "SH":
                reason = "shot"
            rows.append((i, e["eventTime"], None if stop else int(e["sequence"]), stop, is_pass and out == "C", reason))
        want = {}
        t = {r[0]: r[1] for r in rows}
        for members, why in plain_fold(rows, cfg.max_window_passes, cfg.max_window_seconds):
            want[(t[members[0]], t[members[-1]], len(members))] = why
        mine = phase_rows[phase_rows.match_id == match]
        got = {(r.start_sec, r.end_sec, r.n_events): r.reason_closed for r in mine.itertuples()}
        assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
        assert len(got) >= 10


def test_phase_ids_count_over_the_match(phase_rows):
    for _, g in phase_rows.groupby("match_id"):
        n = [int(w.split("_")[1]) for w in g.window_id]
        assert len(set(n)) == len(n) and min(n) >= 1
        first = g.assign(n=n).sort_values("n")
        assert (first.groupby("sequence_id").start_sec.diff().dropna() >= 0).all()


def unit_frames(inputs, row):
    return inputs.frames.filter((F.col("match_id") == row.match_id) & F.col("frame_num").between(int(row.start_frame), int(row.end_frame))).orderBy("frame_idx").collect()


def direction(row):
    return 1 if (row.team == "home") == (row.period % 2 == 1) else -1


def test_wide_rows_match_numpy(inputs, phase_rows):
    for row in phase_rows.iloc[::11].itertuples():
        fr, pl = unit_frames(inputs, row), PITCHES[row.match_id][0]
        d = direction(row)
        own = [f.home if row.team == "home" else f.away for f in fr]
        opp = [f.away if row.team == "home" else f.home for f in fr]
        cx = np.array([np.mean([p.x for p in o]) for o in own])
        cx = cx if d > 0 else pl - cx
        assert row.n_unique_frames == len(fr)
        assert row.attacking_centroid_x_mean == pytest.approx(cx.mean())
        assert row.attacking_centroid_x_std == pytest.approx(cx.std(), abs=1e-6)
        assert row.attacking_centroid_x_change == pytest.approx(cx[-1] - cx[0])
        dx = np.array([np.mean([p.x for p in o]) for o in opp])
        dx = dx if d > 0 else pl - dx
        assert row.longitudinal_centroid_difference_mean == pytest.approx((cx - dx).mean())
        bx = np.array([np.nan if f.ball_x is None else f.ball_x for f in fr])
        assert row.ball_x_max == pytest.approx(np.nanmax(bx if d > 0 else pl - bx))
        ahead = [sum((p.x > f.ball_x) if d > 0 else (p.x < f.ball_x) for p in o) for f, o in zip(fr, opp) if f.ball_x is not None]
        assert row.defending_players_ahead_of_ball_mean == pytest.approx(np.mean(ahead))
        slots = [p.reliable for f in fr for p in list(f.home) + list(f.away)]
        assert row.reliability_ratio == pytest.approx(np.mean(slots))
        speeds = []
        for pid in {p.pid for o in own for p in o}:
            xy = np.array([(p.x, p.y) for o in own for p in o if p.pid == pid])
            speeds += (np.linalg.norm(np.diff(xy, axis=0), axis=1) * 5).tolist()
        assert row.mean_player_speed == pytest.approx(np.mean(speeds)) and row.max_player_speed == pytest.approx(max(speeds))


def test_value_series_match_numpy(inputs, phase_rows):
    row = phase_rows[phase_rows.obso_mean.notna()].iloc[0]
    fr, (pl, pw) = unit_frames(inputs, row), PITCHES[row.match_id]
    d = direction(row)

    def value(x, y):
        x = x if d > 0 else pl - x
        return GRID[min(max(int(y / pw * 12), 0), 11)][min(max(int(x / pl * 16), 0), 15)]

    xt = [value(f.ball_x, f.ball_y) for f in fr if f.ball_x is not None]
    assert row.xt_max <= max(xt) + 1e-12 and row.xt_min >= min(xt) - 1e-12
    best = []
    for f in fr:
        if f.frame_idx % 5 or f.ball_x is None:
            continue
        near = [value(f.ball_x + a, f.ball_y + b) for a in range(-5, 6) for b in range(-5, 6)
                if a * a + b * b <= 25 and 0 <= f.ball_x + a <= pl and 0 <= f.ball_y + b <= pw]
        best.append(max(near + [value(f.ball_x, f.ball_y)]))
    assert row.obso_max <= max(best) + 1e-12


def test_occupancy_sums_and_counts(inputs, phases, phase_rows):
    rec = phases.recurrence.toPandas()
    assert np.allclose(rec.groupby(["match_id", "window_id", "side"]).recurrence_frac.sum(), 1)
    assert np.allclose(rec.groupby(["match_id", "window_id"]).recurrence_frac_combined.sum(), 1)
    assert set(rec.groupby(["match_id", "window_id"]).ngroups for _ in [0]) == {len(phase_rows)}
    row = phase_rows.iloc[3]
    mine = rec[(rec.match_id == row.match_id) & (rec.window_id == row.window_id) & (rec.side == "away")]
    counts = {}
    for f in unit_frames(inputs, row):
        for p in f.away:
            if p.pid != "1":
                counts.setdefault(p.pid, []).append((int(min(p.y, 1e9)), int(p.x)))
    keep = sorted(counts, key=lambda k: (-len(counts[k]), k))[:10]
    want = {}
    for k in keep:
        for c in counts[k]:
            want[c] = want.get(c, 0) + 1
    assert {(r.row, r.col): r.recurrence_count for r in mine.itertuples()} == want


def test_occupancy_is_dealt_by_frames(spark, monkeypatch):
    """A hot phase, players without a position, more players than are kept, ties by id as text, two sizes of pitch."""
    monkeypatch.setattr(maps, "TASK_FRAMES", 50, raising=False)
    rng = np.random.default_rng(3)
    rows, want, total, frames = [], {}, {}, {}
    for f in range(900):
        w = 0 if f < 300 else f % 60
        m = w % 3
        sides = {s: [(str(p), float(rng.integers(0, 5)) if rng.random() < 0.9 else None, float(rng.integers(0, 70)))
                     for p in range(12) if rng.random() < 0.7] for s in ("home", "away")}
        rows.append((m, w, w + 7, "home", 1, 90.0 if m else 105.0, 68.0, sides["home"], sides["away"]))
        frames[m, w] = frames.get((m, w), 0) + 1
        for s, ps in sides.items():
            for p, x, y in ps:
                if (s, p) != ("away", "3") or m == 2:
                    want.setdefault((m, w, s), {}).setdefault(p, []).append(None if x is None else (min(int(y), 67), int(x)))
    player = "array<struct<pid:string,x:double,y:double>>"
    df = spark.createDataFrame(rows, f"match_id int, window_id int, sequence_id int, team string, period int, pitch_length double, pitch_width double, home {player}, away {player}")
    keepers = spark.createDataFrame([(0, "away", "3"), (1, "away", "3"), (2, "away", None)], "match_id int, side string, pid string")
    out = maps.occupancy(df, keepers, 4, block=100)
    assert out.rdd.getNumPartitions() >= 600 / 50
    got, cells = {}, {}
    for r in out.collect():
        assert (r.match_id, r.window_id, r.side, r.row, r.col) not in got
        got[r.match_id, r.window_id, r.side, r.row, r.col] = (r.recurrence_count, r.side_valid_player_frame_count, r.n_side_outfielders, r.frame_count)
        total.setdefault((r.match_id, r.window_id), set()).add((r.valid_player_frame_count, r.n_outfielders))
    for (m, w, s), by in want.items():
        keep = sorted(by, key=lambda p: (-len(by[p]), p))[:4]
        n = sum(len(by[p]) for p in keep)
        for c in (c for p in keep for c in by[p] if c):
            had = cells.get((m, w, s, *c), (0,))[0]
            cells[m, w, s, *c] = (had + 1, n, len(keep), frames[m, w])
        want[m, w, s] = (n, len(keep))
    assert got == cells
    assert total == {k: {tuple(np.sum([want.get((*k, s), (0, 0)) for s in ("home", "away")], axis=0))} for k in total}


def test_phase_control_matches_brute_force(inputs, phases, phase_rows):
    row = phase_rows.iloc[5]
    pl, pw = PITCHES[row.match_id]
    nc, nr = round(pl), round(pw)
    fr = unit_frames(inputs, row)[::2]
    total = np.zeros((nr, nc))
    gx, gy = np.meshgrid((np.arange(nc) + 0.5) * pl / nc, (np.arange(nr) + 0.5) * pw / nr)
    for f in fr:
        def near(ps):
            return np.min([np.sqrt((gx - p.x) ** 2 + (gy - p.y) ** 2) for p in ps], axis=0)
        home = near(f.home) <= near(f.away)
        total += home if row.team == "home" else ~home
    got = phases.control.filter((F.col("match_id") == row.match_id) & (F.col("window_id") == row.window_id)).toPandas()
    dense = np.zeros((nr, nc))
    dense[got.row, got.col] = got.pitch_control_frac
    np.testing.assert_allclose(dense, total / len(fr))
    assert set(got.valid_pitch_control_frame_count) == {len(fr)}


def test_ball_paths(inputs, phases, phase_rows):
    row = phase_rows.iloc[2]
    p = phases.ball_paths.filter((F.col("match_id") == row.match_id) & (F.col("window_id") == row.window_id)).first()
    xy = np.array([(f.ball_x, f.ball_y) for f in unit_frames(inputs, row) if f.ball_x is not None])
    np.testing.assert_allclose(p.path_x, xy[:, 0])
    length = np.linalg.norm(np.diff(xy, axis=0), axis=1).sum()
    assert p.path_length_m == pytest.approx(length) and p.straightness == pytest.approx(np.linalg.norm(xy[-1] - xy[0]) / length)


def test_possessions_and_control_maps(spark, inputs, match_folder):
    cfg = EngineConfig.possession_preset(window_min_observations=50, keeper_min_frames=50)
    inp = jobs.Inputs(inputs.matches, inputs.frames, inputs.events, GRID, GRID)
    out = jobs.build_possessions(inp, cfg)
    rows = out.possessions.toPandas()
    for match in PITCHES:
        groups = {}
        for e in flat_events(match_folder, match):
            if e["sequence"] is not None:
                groups.setdefault(int(e["sequence"]), []).append(e)
        mine = rows[rows.match_id == match].set_index("sequence_id")
        assert set(mine.index) == set(groups)
        for seq, es in groups.items():
            r = mine.loc[seq]
            votes = [e["homeTeam"] for e in es]
            assert r.team == ("home" if sum(votes) * 2 >= len(votes) else "away")
            assert r.start_sec == pytest.approx(min(e["startTime"] for e in es)) and r.end_sec == pytest.approx(max(e["endTime"] for e in es))
            passes = [e for e in es if e.get("possessionEventType") in ("PA", "CR")]
            assert r.n_pass_attempts == len(passes) and r.n_events == len(es)
            kinds = {}
            for e in passes:
                kinds[e["passType"]] = kinds.get(e["passType"], 0) + 1
            assert json.loads(r.pass_type_distribution) == kinds
            firsts = {}
            for e in es:
                firsts.setdefault(e.get("gameEventId"), e)
            assert bool(r.video_missing) == any(e.get("videoMissing") for e in firsts.values())
    row = rows[rows.pc_map.notna()].iloc[4]
    fr = [f for f in inputs.frames.filter((F.col("match_id") == row.match_id) & (F.col("period") == int(row.period))).collect()
          if f.frame_idx % 3 == 0 and row.start_sec_period <= f.elapsed <= row.end_sec_period]
    pl, pw = PITCHES[row.match_id]
    gx, gy = np.meshgrid(np.linspace(0, pl, 75), np.linspace(0, pw, 45), indexing="ij")
    total = np.zeros((75, 45))
    for f in fr:
        def near(ps):
            return np.min([np.sqrt((gx - p.x) ** 2 + (gy - p.y) ** 2) for p in ps], axis=0)
        total += near(f.home) <= near(f.away)
    mean = total / len(fr)
    mean = mean if row.team == "home" else 1 - mean
    mean = mean if direction(row) > 0 else mean[::-1]
    np.testing.assert_allclose(np.array(row.pc_map), mean.ravel(), atol=1e-6)
    seg = out.segments.toPandas()
    assert (seg.duration == seg.end_sec - seg.start_sec).all() and set(rows.dominant_formation.dropna()) <= set(seg.formation)


def test_keepers_by_name_or_stillness(inputs, cfg):
    from playframe.plans.formations import keepers

    got = {(r.match_id, r.side): r.pid for r in keepers(inputs.frames, inputs.matches, 50, 256.0).collect()}
    assert got == {(m, s): "1" for m in PITCHES for s in ("home", "away")}
