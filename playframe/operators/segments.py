"""Cutting ordered events into phases with a stated close reason.

Rules that look at one event (failed pass, shot, movement threshold) or at the
gap to the next one (stoppage) are boundary flags, and running sums over them
name independent runs. Only the two caps (passes and time) depend on where a
window started. A run that can meet neither cap is one window.

The windows of all other runs are found as a prefix composition over blocks of
rows. Inside a block, where the window that starts at a row closes follows from
two searches; a table gives for every row the last window start that is reached
from it inside the block. Few starts are left per block. Each is carried to the
block and row where its window closes, which composes the tables of two blocks,
and doubling the steps composes those of two, four, eight, ... blocks. So a run of
any length takes rounds that grow with the logarithm of its blocks, and no list
is longer than a block.

A window is full by the time cap at the first event with time - start > cap, as
the rule says, difference of two doubles included: the least such time is found
exactly before it is searched for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from playframe.operators.ordered import ordered
from playframe.operators.ranges import asof_forward
from playframe.session import cut_lineage, materialize

LOCAL_REASONS = ("threshold_both", "threshold_mean", "threshold_max", "failed_pass", "shot")


def local_reason(is_pass: Column, completed: Column, is_shot: Column, mean_disp: Column,
                 max_disp: Column, threshold_mean: float, threshold_max: float) -> Column:
    """Close reason that an event carries by itself, null when it has none."""
    done = is_pass & completed
    over_mean = F.coalesce(mean_disp > threshold_mean, F.lit(False))
    over_max = F.coalesce(max_disp > threshold_max, F.lit(False))
    return (
        F.when(done & over_mean & over_max, "threshold_both")
        .when(done & over_mean, "threshold_mean")
        .when(done & over_max, "threshold_max")
        .when(is_pass & ~completed, "failed_pass")
        .when(is_shot, "shot")
    )


def assign_windows(events: DataFrame, match: list[str], sequence: list[str], *, time: str, ordinal: str,
                   stop: str, reason: str, counted: str, max_passes: int, max_seconds: float,
                   width: float, block_rows: int = 4096) -> DataFrame:
    """Give every open-play event its run and window.

    ``stop`` marks stoppage rows (they belong to no sequence and are dropped),
    ``reason`` is the local close reason, ``counted`` marks completed passes.
    Adds ``run_stops``, ``run_closes`` and ``win``, which together with the
    sequence key name a phase, and ``has_next``, which tells whether the
    sequence goes on after the event.
    """
    # every ordered pass reads its input twice (rows and block summaries), so
    # stacked passes would repeat the work below them; each result is written
    # once instead
    timed = events.filter(F.col(time).isNotNull())
    after_stops = materialize(ordered(
        timed.withColumn("__play", (~F.col(stop)).cast("int")), match, [time, "__play", ordinal], width,
        cumsum={"run_stops": F.col(stop).cast("bigint")},
    ).filter(~F.col(stop)).drop("__play", stop))

    seq = match + [k for k in sequence if k not in match]
    closing = F.col(reason).isNotNull().cast("bigint")
    runs = ordered(
        after_stops, seq, [time, ordinal], width,
        cumsum={"__closes": closing}, lead={"has_next": F.lit(True)},
    )
    runs = runs.withColumn("run_closes", F.col("__closes") - closing).withColumn(
        "has_next", F.coalesce("has_next", F.lit(False))
    ).drop("__closes")
    runs = materialize(runs)

    run = seq + ["run_stops", "run_closes"]
    sizes = runs.groupBy(*run).agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col(counted)).alias("__passes"),
        (F.max(time) - F.min(time)).alias("__span"),
    )
    capped = cut_lineage(sizes.filter(~((F.col("__passes") < max_passes) & (F.col("__span") <= max_seconds))).select(*run))
    # keys may be null, which the joins take for equal
    whole = _by(runs, capped, run, "left_anti").withColumn("win", F.lit(0).cast("bigint"))
    return whole.unionByName(_capped(_by(runs, capped, run, "left_semi"), run, time, ordinal, counted, max_passes, max_seconds, width, block_rows))


def _by(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; of the right side only what is new."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def _least_late(start: np.ndarray, cap: float) -> np.ndarray:
    """The least double t with t - start > cap, for each start."""
    late = start + cap
    while (low := late - start <= cap).any():
        late = np.where(low, np.nextafter(late, np.inf), late)
    while (high := (before := np.nextafter(late, -np.inf)) - start > cap).any():
        late = np.where(high, before, late)
    return late


def _closings(time: np.ndarray, passed: np.ndarray, max_passes: int, max_seconds: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the window that starts at each row of a block: the row that closes it
    (the number of rows if none does), the passes before the row, and the least
    time past the cap."""
    upto, late = np.cumsum(passed), _least_late(time, max_seconds)
    before = upto - passed
    return np.minimum(np.searchsorted(upto, before + max_passes), np.searchsorted(time, late)), before, late


def _window_numbers(head: np.ndarray, time: np.ndarray, passed: np.ndarray, entry: np.ndarray, max_passes: int, max_seconds: float) -> np.ndarray:
    """Windows begun up to each row of its block, over many blocks one after
    another. ``head`` is the first row of each block, ``entry`` the place of its
    first window start after the head, NaN where it has none."""
    n = len(time)
    size = np.diff(np.append(head, n))
    block, end = np.repeat(np.arange(len(head)), size), np.append(head[1:], n)
    upto, late = np.cumsum(passed), _least_late(time, max_seconds)
    # rows of the block before the time cap, counted in one order of times and caps
    order = np.lexsort((np.repeat([0, 1], n), np.concatenate([late, time]), np.concatenate([block, block])))
    is_row = order >= n
    by_time = np.empty(n, dtype=np.int64)
    by_time[order[~is_row]] = np.cumsum(is_row)[~is_row]
    by_pass = np.searchsorted(upto, upto - passed + max_passes)
    follow = np.minimum(np.minimum(by_pass, by_time), end[block]) + 1
    mark, known = np.zeros(n, dtype=np.int64), ~np.isnan(entry)
    at, stop = head[known] + entry[known].astype(np.int64), end[known]
    while len(at):
        inside = at < stop
        at, stop = at[inside], stop[inside]
        mark[at] = 1
        at = follow[at]
    total = np.cumsum(mark)
    return total - np.repeat(total[head] - mark[head], size)


def _leaves(close: np.ndarray) -> np.ndarray:
    """The last window start reached from each row inside the block; the number
    of rows where the next window starts with the next block."""
    n = len(close)
    go = np.append(np.where(close >= n, np.arange(n), np.minimum(close + 1, n)), n)
    while not np.array_equal(step := go[go], go):
        go = step
    return go[:n]


def _placed(table: pa.Table, time: str, counted: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of a block in order, their times and pass flags."""
    table = table.take(np.argsort(table.column("__pos").to_numpy()))
    return table, table.column(time).cast(pa.float64()).to_numpy(), table.column(counted).cast(pa.int64()).to_numpy()


def _capped(rows: DataFrame, run: list[str], time: str, ordinal: str, counted: str, max_passes: int, max_seconds: float,
            width: float, block_rows: int) -> DataFrame:
    """Windows of the runs that may meet a cap."""
    placed = ordered(rows, run, [time, ordinal], width, index="__pos").withColumn(counted, F.coalesce(counted, F.lit(False)))
    placed = materialize(placed.withColumn("__block", F.floor(F.col("__pos") / block_rows)))
    many = placed.filter((F.col("__pos") == block_rows)).select(*run)
    known = placed.withColumn("__entry", F.when(F.col("__block") == 0, F.lit(0).cast("bigint")))
    if not many.isEmpty():
        entries = _entries(_by(placed, cut_lineage(many), run, "left_semi"), run, time, counted, max_passes, max_seconds)
        later = entries.filter("__block > 0").withColumnRenamed("__entry", "__later")
        known = _by(known, later, run + ["__block"], "left").withColumn("__entry", F.coalesce("__entry", "__later")).drop("__later")

    # a block begins where the place of a row is a multiple of its length; the rows
    # of many blocks are numbered together, since most runs have a few rows only
    names = [*placed.columns, "__entry"]
    schema = T.StructType([*placed.schema.fields, T.StructField("__start", T.LongType())])

    def starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Numbers the windows of blocks whose first start is known. The last
        block of a batch waits for the next one."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]).select(names)
            table = pa.concat_tables([held, table]) if held is not None else table
            heads = np.flatnonzero(table.column("__pos").to_numpy() % block_rows == 0)
            last = int(heads[-1]) if len(heads) else 0
            held = table.slice(last)
            if last:
                yield from numbered_windows(table.slice(0, last))
        if held is not None and held.num_rows:
            yield from numbered_windows(held)

    def numbered_windows(table: pa.Table) -> list[pa.RecordBatch]:
        table = table.combine_chunks()
        pos = table.column("__pos").to_numpy()
        head = np.flatnonzero(pos % block_rows == 0)
        passed, times = table.column(counted).cast(pa.int64()).to_numpy(), table.column(time).cast(pa.float64()).to_numpy()
        entry = table.column("__entry").take(pa.array(head)).to_numpy(zero_copy_only=False).astype(float)
        number = _window_numbers(head, times, passed, entry - pos[head], max_passes, max_seconds)
        return table.drop_columns(["__entry"]).append_column("__start", pa.array(number)).to_batches()

    dealt = known.repartition(*run, "__block").sortWithinPartitions(*run, "__pos")
    marked = dealt.mapInArrow(starts, schema)
    if many.isEmpty():
        return marked.select(*rows.columns, (F.col("__start") - 1).alias("win"))
    marked = materialize(marked)
    sums = marked.groupBy(*run, "__block").agg(F.max("__start").alias("__n"))  # one row per block
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*run).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = _by(marked, sums.select(*run, "__block", before.alias("__before")), run + ["__block"], "inner")
    return numbered.select(*rows.columns, (F.col("__before") + F.col("__start") - 1).alias("win"))


def _entries(placed: DataFrame, run: list[str], time: str, counted: str, max_passes: int, max_seconds: float) -> DataFrame:
    """First window start of every later block of long runs, where it has one."""
    keys = [f for f in placed.schema.fields if f.name in run]
    key_names = [f.name for f in keys]
    long, real = T.LongType(), T.DoubleType()

    def of_keys(table: pa.Table, n: int) -> list[pa.Array]:
        return [pa.repeat(table.column(k)[0], n) for k in key_names]

    def leaving(table: pa.Table) -> pa.Table:
        """The starts left per block (-1: the next block's first row), what their
        windows wait for, and the start left from the first row."""
        table, times, passed = _placed(table, time, counted)
        close, before, late = _closings(times, passed, max_passes, max_seconds)
        leaf, first = _leaves(close), table.column("__pos")[0].as_py()
        left = np.unique(leaf)
        inner = np.minimum(left, len(close) - 1)
        aligned = left == len(close)
        n, left_first = len(left), leaf[0] + first if leaf[0] < len(close) else -1
        return pa.Table.from_arrays(
            [*of_keys(table, n), pa.array(np.full(n, table.column("__block")[0].as_py())), pa.array(np.where(aligned, -1, left + first)),
             pa.array(passed.sum() - before[inner]), pa.array(late[inner]), pa.array(np.full(n, left_first)),
             pa.array(np.full(n, passed.sum())), pa.array(np.full(n, times[-1])), pa.array(np.full(n, first + len(close)))],
            names=[*key_names, "__block", "__node", "__since", "__late", "__first", "__passes", "__last", "__end"])

    fields = [("__block", long), ("__node", long), ("__since", long), ("__late", real), ("__first", long), ("__passes", long), ("__last", real), ("__end", long)]
    nodes = materialize(placed.groupBy(*run, "__block").applyInArrow(leaving, T.StructType([*keys, *[T.StructField(k, t) for k, t in fields]])))
    blocks = nodes.groupBy(*run, "__block").agg(*[F.first(c).alias(c) for c in ("__first", "__passes", "__last", "__end")])
    upto = F.sum("__passes").over(Window.partitionBy(*run).orderBy("__block"))  # one row per block
    blocks = materialize(blocks.withColumn("__upto", upto))

    # the block in which the window of each open start closes
    one = placed.select(*run).distinct().withColumn("__run", F.monotonically_increasing_id())
    one = materialize(one)  # a name without nulls for the lookups
    blocks = materialize(_by(blocks, one, run, "inner"))
    open_ = _by(nodes.filter("__node >= 0").select(*run, "__block", "__node", "__since", "__late"), blocks.select(*run, "__block", "__run", "__upto"), run + ["__block"], "inner")
    open_ = materialize(open_.select(*run, "__run", "__block", "__node", "__late", (F.col("__upto") - F.col("__since") + max_passes).alias("__full")))
    series = blocks.select("__run", F.col("__upto").cast("double").alias("__u"), F.col("__last").alias("__l"), F.col("__block").alias("__to"))
    targets = open_.select("__run", "__node", "__late", F.col("__full").cast("double").alias("__full"))
    by_pass = asof_forward(targets, series.withColumn("__up", F.col("__u")), ["__run"], "__full", "__u", "__to", ["__to", "__up"], 65536.0).filter("__up >= __full")
    by_time = asof_forward(targets, series.withColumn("__lt", F.col("__l")), ["__run"], "__late", "__l", "__to", ["__to", "__lt"], 65536.0).filter("__lt >= __late")
    landing = by_pass.select("__run", "__node", "__to").union(by_time.select("__run", "__node", "__to")).groupBy("__run", "__node").agg(F.min("__to").alias("__to"))
    waiting = materialize(open_.join(landing, ["__run", "__node"]).join(blocks.select("__run", F.col("__block").alias("__to"), (F.col("__upto") - F.col("__passes")).alias("__had")), ["__run", "__to"])
                          .select(*run, F.col("__to").alias("__block"), "__node", (F.col("__full") - F.col("__had")).alias("__need"), "__late"))

    def land(left: pa.Table, right: pa.Table) -> pa.Table:
        """For the starts whose windows close in a block: the row after, and the
        start that is left from there."""
        if not left.num_rows:
            return pa.Table.from_arrays([*[pa.array([], right.schema.field(k).type) for k in key_names], *[pa.array([], pa.int64())] * 4],
                                        names=[*key_names, "__node", "__block", "__entry", "__left"])
        right, times, passed = _placed(right, time, counted)
        close, _, _ = _closings(times, passed, max_passes, max_seconds)
        leaf, first = _leaves(close), right.column("__pos")[0].as_py()
        at = np.minimum(np.searchsorted(np.cumsum(passed), left.column("__need").to_numpy()), np.searchsorted(times, left.column("__late").to_numpy())) + 1
        gone = np.append(leaf, len(leaf))[at]
        return pa.Table.from_arrays(
            [*[left.column(k) for k in key_names], left.column("__node"), left.column("__block"), pa.array(np.where(at < len(leaf), at + first, -1)),
             pa.array(np.where(gone < len(leaf), gone + first, -1))], names=[*key_names, "__node", "__block", "__entry", "__left"])

    schema = T.StructType([*keys, *[T.StructField(c, long) for c in ("__node", "__block", "__entry", "__left")]])
    cut = run + ["__block"]
    closed = waiting.groupBy(*cut).cogroup(_by(placed, waiting.select(*cut).distinct(), cut, "left_semi").groupBy(*cut)).applyInArrow(land, schema)
    # a step goes from a start to the one left in the block where its window closes,
    # and brings that block its first start; "the first row of the next block" is
    # named by the end of the block, below zero
    def place(node: str) -> Column:
        return F.when(F.col(node) >= 0, F.col(node)).otherwise(-1 - F.col("__end"))

    steps = _by(closed, blocks.select(*run, "__block", "__end"), cut, "inner")
    steps = steps.select(*run, F.col("__node").alias("__from"), "__block", "__entry", place("__left").alias("__to"))
    edge = blocks.select(*run, "__block", "__end", "__first")
    before = edge.select(*run, (F.col("__block") + 1).alias("__block"), F.col("__end").alias("__entry"))
    aligned = _by(edge, before, cut, "inner").select(*run, (-1 - F.col("__entry")).alias("__from"), "__block", "__entry", place("__first").alias("__to"))
    steps = materialize(steps.unionByName(aligned))
    root = edge.filter(F.col("__block") == 0).select(*run, place("__first").alias("__at"))
    reached = _reach(root, steps.select(*run, "__from", "__to"), run)
    taken = _by(steps, reached.withColumnRenamed("__at", "__from"), run + ["__from"], "left_semi")
    return taken.filter("__entry >= 0").select(*run, "__block", "__entry").distinct()


def _reach(root: DataFrame, steps: DataFrame, run: list[str]) -> DataFrame:
    """All places reached from the root of each run; the steps double in length."""
    reached, jumps = cut_lineage(root), steps
    while True:
        more = _by(reached.withColumnRenamed("__at", "__from"), jumps, run + ["__from"], "inner").select(*run, F.col("__to").alias("__at"))
        reached = cut_lineage(reached.unionByName(more).distinct())
        far = _by(jumps.withColumnRenamed("__from", "__origin").withColumnRenamed("__to", "__from"), jumps, run + ["__from"], "inner")
        jumps = cut_lineage(far.select(*run, F.col("__origin").alias("__from"), "__to"))
        if jumps.isEmpty():
            return reached


def close_reason(last_local: Column, passes: Column, span: Column, has_next: Column,
                 max_passes: int, max_seconds: float) -> Column:
    """Reason of a whole window, from its last event and its totals."""
    return (
        F.when(last_local.isNotNull(), last_local)
        .when(passes >= max_passes, "max_passes")
        .when(span > max_seconds, "max_time")
        .when(has_next, "stoppage_break")
        .otherwise("sequence_end")
    )


def window_keys(match: list[str], sequence: list[str]) -> list[str]:
    return match + [k for k in sequence if k not in match] + ["run_stops", "run_closes", "win"]


def summarise_windows(assigned: DataFrame, match: list[str], sequence: list[str], *, time: str, ordinal: str,
                      reason: str, counted: str, max_passes: int, max_seconds: float,
                      extra: list[Column] | None = None) -> DataFrame:
    """One row per window: bounds, counts and close reason."""
    order = F.struct(time, ordinal)
    grouped = assigned.groupBy(*window_keys(match, sequence)).agg(
        F.min(time).alias("start_sec"), F.max(time).alias("end_sec"),
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col(counted)).alias("n_passes_in_window"),
        F.max_by(reason, order).alias("__reason"), F.max_by("has_next", order).alias("__next"),
        F.min(ordinal).alias("first_ordinal"), *(extra or []),
    )
    span = F.col("end_sec") - F.col("start_sec")
    named = close_reason(F.col("__reason"), F.col("n_passes_in_window"), span, F.col("__next"), max_passes, max_seconds)
    return grouped.withColumn("reason_closed", named).withColumn("duration", span).drop("__reason", "__next")
