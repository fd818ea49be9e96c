"""Ordered analytics that do not put a whole key into one task.

A plain window ``partitionBy(key)`` sends every row of a key to one task. Here
a key is cut into blocks of its order column. Each block is a window partition
of its own; one summary row per block (edge rows, totals) carries what a block
needs to know about its neighbours. The number of summary rows of a key is its
time span over the block width, whatever the number of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from playframe.session import materialize

BLOCK = "__block"


def block_of(order: Column | str, width: float) -> Column:
    o = F.col(order) if isinstance(order, str) else order
    return F.floor(o.cast("double") / F.lit(float(width)))


def ordered(df: DataFrame, keys: list[str], order: list[str], width: float, *,
            lag: dict[str, Column] | None = None,
            lead: dict[str, Column] | None = None,
            cumsum: dict[str, Column] | None = None,
            cummax: dict[str, Column] | None = None,
            fill_forward: dict[str, Column] | None = None,
            fill_backward: dict[str, Column] | None = None,
            index: str | None = None,
            on_block: Column | None = None) -> DataFrame:
    """Add ordered columns to ``df``.

    ``order`` must be total within a key, and its first column (or
    ``on_block``) numeric. ``lag`` and ``lead`` look one row back or ahead,
    ``cumsum``, ``cummax`` and the two fills include the current row, ``index`` numbers
    the rows from zero.
    """
    lag, lead, cumsum, cummax = lag or {}, lead or {}, cumsum or {}, cummax or {}
    forward, backward = fill_forward or {}, fill_backward or {}
    names = df.columns
    base = df.withColumn(BLOCK, F.coalesce(block_of(on_block if on_block is not None else order[0], width),
                                           F.lit(-1).cast("bigint")))
    inputs = {}
    for group, exprs in (("lag", lag), ("lead", lead), ("sum", cumsum), ("max", cummax), ("ff", forward), ("bf", backward)):
        for alias, e in exprs.items():
            inputs[f"__{group}_{alias}"] = e
    base = base.withColumns(inputs) if inputs else base

    cut = keys + [BLOCK]
    key = F.struct(*order)
    aggs = [F.count(F.lit(1)).alias("__n")]
    # the values are wrapped in a struct, so that a null value of an edge row
    # is told apart from a missing row
    aggs += [F.max_by(F.struct(F.col(f"__lag_{a}").alias("v")), key).alias(f"__tail_{a}") for a in lag]
    aggs += [F.min_by(F.struct(F.col(f"__lead_{a}").alias("v")), key).alias(f"__head_{a}") for a in lead]
    aggs += [F.sum(f"__sum_{a}").alias(f"__total_{a}") for a in cumsum]
    aggs += [F.max(f"__max_{a}").alias(f"__most_{a}") for a in cummax]
    aggs += [F.max_by(f"__ff_{a}", F.when(F.col(f"__ff_{a}").isNotNull(), key)).alias(f"__fflast_{a}") for a in forward]
    aggs += [F.min_by(f"__bf_{a}", F.when(F.col(f"__bf_{a}").isNotNull(), key)).alias(f"__bffirst_{a}") for a in backward]
    summary = base.groupBy(*cut).agg(*aggs)

    across = Window.partitionBy(*keys).orderBy(BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    # looking ahead is looking back in the opposite order: a frame that ends with
    # the partition is read anew for every row
    after = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.col(c) for c in cut]
    carried += [F.lag(f"__tail_{a}").over(across).alias(f"__prev_{a}") for a in lag]
    carried += [F.lead(f"__head_{a}").over(across).alias(f"__next_{a}") for a in lead]
    carried += [F.coalesce(F.sum(f"__total_{a}").over(before), F.lit(0)).alias(f"__upto_{a}") for a in cumsum]
    carried += [F.max(f"__most_{a}").over(before).alias(f"__mostupto_{a}") for a in cummax]
    carried += [F.last(f"__fflast_{a}", ignorenulls=True).over(before).alias(f"__ffprev_{a}") for a in forward]
    carried += [F.last(f"__bffirst_{a}", ignorenulls=True).over(after).alias(f"__bfnext_{a}") for a in backward]
    if index:
        carried.append(F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__upto_n"))
    summary = summary.select(*carried)

    inside = Window.partitionBy(*cut).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rest = Window.partitionBy(*cut).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for a in lag:
        local[f"__loc_lag_{a}"] = F.lag(F.struct(F.col(f"__lag_{a}").alias("v"))).over(inside)
    for a in lead:
        local[f"__loc_lead_{a}"] = F.lead(F.struct(F.col(f"__lead_{a}").alias("v"))).over(inside)
    for a in cumsum:
        local[f"__loc_sum_{a}"] = F.sum(f"__sum_{a}").over(upto)
    for a in cummax:
        local[f"__loc_max_{a}"] = F.max(f"__max_{a}").over(upto)
    for a in forward:
        local[f"__loc_ff_{a}"] = F.last(f"__ff_{a}", ignorenulls=True).over(upto)
    for a in backward:
        local[f"__loc_bf_{a}"] = F.last(f"__bf_{a}", ignorenulls=True).over(rest)
    if index:
        local["__loc_n"] = F.row_number().over(inside)

    # keys may be null, so the join back is null-safe; this also keeps it an
    # equi-join on (key, block), which the window above already satisfies
    left, right = base.withColumns(local).alias("l"), summary.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cut]
    out = [F.col(f"l.{c}").alias(c) for c in names]
    out += [F.coalesce(F.col(f"__loc_lag_{a}"), F.col(f"__prev_{a}"))["v"].alias(a) for a in lag]
    out += [F.coalesce(F.col(f"__loc_lead_{a}"), F.col(f"__next_{a}"))["v"].alias(a) for a in lead]
    out += [(F.coalesce(F.col(f"__loc_sum_{a}"), F.lit(0)) + F.col(f"__upto_{a}")).alias(a) for a in cumsum]
    out += [F.greatest(f"__loc_max_{a}", f"__mostupto_{a}").alias(a) for a in cummax]
    out += [F.coalesce(F.col(f"__loc_ff_{a}"), F.col(f"__ffprev_{a}")).alias(a) for a in forward]
    out += [F.coalesce(F.col(f"__loc_bf_{a}"), F.col(f"__bfnext_{a}")).alias(a) for a in backward]
    if index:
        out.append((F.col("__loc_n") - 1 + F.col("__upto_n")).cast("bigint").alias(index))
    return left.join(right, on).select(*out)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. Spark keeps only n rows per key and map task
    before the shuffle (window group limit), so hot keys stay cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def every_nth(df: DataFrame, keys: list[str], order: list[str], n: int, width: float) -> DataFrame:
    """Rows 0, n, 2n, ... of every key; the first row is always kept."""
    numbered = ordered(df, keys, order, width, index="__pos")
    return numbered.filter(F.col("__pos") % n == 0).drop("__pos")


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, width: float,
            out: str = "island") -> DataFrame:
    """Number the runs of equal consecutive values of every key from zero."""
    # written once: the second pass reads it twice
    seen = materialize(ordered(df, keys, order, width, lag={"__before": F.struct(F.col(value).alias("x"))}))
    starts = F.when(F.col("__before").isNotNull() & ~F.col("__before.x").eqNullSafe(F.col(value)), 1).otherwise(0)
    return ordered(seen, keys, order, width, cumsum={out: starts}).drop("__before")


def changes(df: DataFrame, keys: list[str], order: list[str], value: str, width: float) -> DataFrame:
    """Rows whose value differs from the last known one; rows without a value
    neither report a change nor forget the known value."""
    known = df.filter(F.col(value).isNotNull())
    seen = ordered(known, keys, order, width, lag={"previous": F.col(value)})
    return seen.filter(F.col("previous") != F.col(value))


def steps(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, width: float,
          out: str = "step") -> DataFrame:
    """Distance to the previous row of the key that has a position."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    seen = ordered(known, keys, order, width, lag={"__p": F.struct(F.col(x).alias("x"), F.col(y).alias("y"))})
    dx, dy = F.col(x) - F.col("__p.x"), F.col(y) - F.col("__p.y")
    return seen.withColumn(out, F.sqrt(dx * dx + dy * dy)).drop("__p")
