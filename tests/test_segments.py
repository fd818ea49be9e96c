"""Segmentation against a plain fold, over blocks of several sizes."""

import random

import pytest
from pyspark.sql import functions as F

from playframe.operators import segments


def plain_fold(events, max_passes, max_seconds):
    """Windows of one match by walking its events."""
    out, stops = [], sorted(t for _, t, _, stop, _, _ in events if stop)
    by_seq = {}
    for e in events:
        if not e[3] and e[1] is not None:
            by_seq.setdefault(e[2], []).append(e)
    for rows in by_seq.values():
        window, prev, passes = [], None, 0
        for ordinal, t, seq, _, counted, reason in sorted(rows, key=lambda e: (e[1], e[0])):
            if window and any(prev < s <= t for s in stops):
                out.append((tuple(window), "stoppage_break"))
                window, passes = [], 0
            if not window:
                start = t
            window.append(ordinal)
            prev, passes = t, passes + counted
            why = reason or ("max_passes" if passes >= max_passes else "max_time" if t - start > max_seconds else None)
            if why:
                out.append((tuple(window), why))
                window, passes = [], 0
        if window:
            out.append((tuple(window), "sequence_end"))
    return sorted(out)


def make_events(seed, n, local_share, stop_share, hot):
    rng = random.Random(seed)
    events, t = [], 0.0
    for i in range(n):
        t = round(t + rng.choice([0.0, 0.5, 1.0, 7.0]), 1)
        stop = rng.random() < stop_share
        reason = rng.choice(["shot", "failed_pass"]) if rng.random() < local_share else None
        seq = 0 if rng.random() < hot else rng.randint(1, 5)
        counted = reason != "failed_pass" and rng.random() < 0.4
        events.append((i, t, seq, stop, counted and not stop, None if stop else reason))
    return events


@pytest.mark.parametrize("block_rows", [4096, 7])
@pytest.mark.parametrize("seed,local,stops,hot", [(1, 0.15, 0.05, 0.4), (2, 0.0, 0.0, 0.9)])
def test_matches_the_fold(spark, seed, local, stops, hot, block_rows):
    events = make_events(seed, 260, local, stops, hot)
    df = spark.createDataFrame([("m", *e) for e in events],
                               "match_id string, ordinal long, t double, seq int, is_stop boolean, counted boolean, reason string")
    shared = dict(time="t", ordinal="ordinal", reason="reason", counted="counted", max_passes=4, max_seconds=9.0)
    a = segments.assign_windows(df, ["match_id"], ["seq"], stop="is_stop", width=20.0, block_rows=block_rows, **shared)
    got = segments.summarise_windows(a, ["match_id"], ["seq"], extra=[F.sort_array(F.collect_list(F.struct("t", "ordinal"))).alias("m")], **shared)
    got = sorted((tuple(x.ordinal for x in r.m), r.reason_closed) for r in got.collect())
    assert got == plain_fold(events, 4, 9.0)


def test_windows_partition_the_events(spark):
    events = make_events(5, 200, 0.2, 0.1, 0.5)
    df = spark.createDataFrame([("m", *e) for e in events],
                               "match_id string, ordinal long, t double, seq int, is_stop boolean, counted boolean, reason string")
    a = segments.assign_windows(df, ["match_id"], ["seq"], time="t", ordinal="ordinal", stop="is_stop", reason="reason",
                                counted="counted", max_passes=4, max_seconds=9.0, width=20.0)
    assert sorted(r.ordinal for r in a.collect()) == [e[0] for e in events if not e[3]]


def test_thresholds_are_strict(spark):
    df = spark.createDataFrame([(2.0, 4.0), (2.1, 4.0), (2.0, 4.1), (2.1, 4.1), (None, None)], "a double, b double")
    r = segments.local_reason(F.lit(True), F.lit(True), F.lit(False), F.col("a"), F.col("b"), 2.0, 4.0)
    assert [x.r for x in df.select(r.alias("r")).collect()] == [None, "threshold_mean", "threshold_max", "threshold_both", None]


def numpy_windows(t, passed, max_passes, max_seconds):
    """Window numbers of one run by walking its events."""
    out, win, start, n = [], 0, None, 0
    for x, p in zip(t, passed):
        start = x if start is None else start
        n += p
        out.append(win)
        if n >= max_passes or x - start > max_seconds:
            win, start, n = win + 1, None, 0
    return out


def windows_of(spark, t, passed, block_rows, max_passes=4, max_seconds=9.0):
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"ordinal": range(len(t)), "t": t, "counted": [bool(p) for p in passed]}))
    df = df.select(F.lit("m").alias("match_id"), F.lit(None).cast("string").alias("seq"), "ordinal", "t", "counted",
                   F.lit(False).alias("is_stop"), F.lit(None).cast("string").alias("reason"))
    a = segments.assign_windows(df, ["match_id"], ["seq"], time="t", ordinal="ordinal", stop="is_stop", reason="reason", counted="counted",
                                max_passes=max_passes, max_seconds=max_seconds, width=20.0, block_rows=block_rows)
    return [r.win for r in a.select("ordinal", "win").orderBy("ordinal").collect()]


@pytest.mark.parametrize("seed,block_rows", [(0, 5), (1, 1), (2, 16), (3, 5)])
def test_long_runs_and_times_at_the_cap(spark, seed, block_rows):
    """Times that differ by 1e-10 around the cap, a null sequence, blocks that windows end with, blocks inside one window."""
    rng = random.Random(seed)
    t, now = [], 1000.0
    for _ in range(300):
        now += rng.choice([0.0, 1e-10, 3.0, 9.0 - 1e-10, 9.0, 4.5, 0.1])
        t.append(now)
    if seed == 3:
        t = sorted([1000.0] * 200 + [1009.0 + k * 1e-12 for k in range(100)])
    passed = [rng.random() < (0.05, 0.5, 0.9, 0.0)[seed] for _ in t]
    want = numpy_windows(t, passed, 4, 9.0)
    assert windows_of(spark, t, passed, block_rows) == want


def test_least_time_past_the_cap():
    import numpy as np

    start = np.array([0.0, 1e-9, 0.1, 1000.3, 1.7e9, 123456.789])
    for cap in (0.0, 0.1, 9.0, 29.999999):
        late = segments._least_late(start, cap)
        assert (late - start > cap).all() and (np.nextafter(late, -np.inf) - start <= cap).all()


def test_a_run_of_a_million_events(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    t = np.cumsum(rng.choice([0.25, 0.5, 1.0], 1_000_000))
    passed = rng.random(1_000_000) < 0.3
    assert windows_of(spark, t, passed, 4096) == numpy_windows(t.tolist(), passed.tolist(), 4, 9.0)


def test_short_runs_share_their_batches(spark):
    """Most runs have a few rows; a Python call for each costs more than its rows."""
    df = spark.createDataFrame([("m", *e) for e in make_events(5, 120, 0.2, 0.1, 0.5)],
                               "match_id string, ordinal long, t double, seq int, is_stop boolean, counted boolean, reason string")
    a = segments.assign_windows(df, ["match_id"], ["seq"], time="t", ordinal="ordinal", stop="is_stop", reason="reason",
                                counted="counted", max_passes=2, max_seconds=1.0, width=50.0)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize("seed", range(4))
def test_windows_of_many_blocks_at_once(seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, 300)
    head = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    time = np.concatenate([np.sort(rng.integers(0, 20, n)) / 2.0 for n in sizes])
    passed = rng.integers(0, 2, len(time))
    entry = np.where(rng.random(len(sizes)) < 0.2, np.nan, np.floor(rng.random(len(sizes)) * sizes))
    got = segments._window_numbers(head, time, passed, entry, 2, 3.0)
    for h, n, e in zip(head, sizes, entry):
        close, _, _ = segments._closings(time[h:h + n], passed[h:h + n], 2, 3.0)
        mark, at = np.zeros(n, dtype=int), n if np.isnan(e) else int(e)
        while at < n:
            mark[at] = 1
            at = int(close[at]) + 1
        assert got[h:h + n].tolist() == np.cumsum(mark).tolist()
