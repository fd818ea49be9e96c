"""Cell arithmetic for the grid geometries: truncating bins (value surfaces),
edge bins (occupancy), nodes that include both borders, and cell centres."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from playframe.functions.nulls import col


def _num(v) -> Column:
    return F.lit(v) if isinstance(v, (int, float)) else v


def truncated_bin(v: Column | str, extent, n) -> Column:
    """trunc(v / extent * n), clipped to the grid."""
    n = _num(n)
    raw = (col(v) / _num(extent) * n).cast("int")
    return F.greatest(F.least(raw, (n - 1).cast("int")), F.lit(0))


def edge_bin(v: Column | str, extent, n) -> Column:
    """Index of the last edge not above v, clipped to the grid. Edge k sits at
    k * (extent / n), as an evenly spaced edge vector has it."""
    n, step = _num(n), _num(extent) / _num(n)
    x = col(v)
    guess = F.floor(x / step)
    # one comparison on either side undoes the rounding of the division
    fixed = (
        F.when(guess * step > x, guess - 1)
        .when((guess + 1) * step <= x, guess + 1)
        .otherwise(guess)
    )
    return F.greatest(F.least(fixed, n.cast("bigint") - 1), F.lit(0)).cast("int")


def metre_cells(extent: Column | str) -> Column:
    """Cell count for cells of about one metre; halves round to even."""
    return F.greatest(F.bround(col(extent)).cast("int"), F.lit(1))


def surface_lookup(values: list[list[float]], x: Column | str, y: Column | str, length, width,
                   direction: Column | str | None = None) -> Column:
    """Value of a small matrix at a point. Only x is mirrored by direction. The
    matrix travels as one array literal, so no join is needed."""
    n_rows, n_cols = len(values), len(values[0])
    gx = col(x)
    if direction is not None:
        gx = F.when(col(direction) == 1, gx).otherwise(_num(length) - gx)
    row, cell = truncated_bin(y, width, n_rows), truncated_bin(gx, length, n_cols)
    flat = F.lit([float(v) for line in values for v in line])
    return F.get(flat, row * F.lit(n_cols) + cell)


def rotate_cell(row: Column | str, cell: Column | str, n_rows, n_cols,
                flip: Column) -> tuple[Column, Column]:
    """Half turn of the pitch where ``flip`` holds."""
    r, c = col(row), col(cell)
    return (
        F.when(flip, _num(n_rows) - 1 - r).otherwise(r),
        F.when(flip, _num(n_cols) - 1 - c).otherwise(c),
    )


def cell_centre(cell: Column | str, extent, n) -> Column:
    return (col(cell) + F.lit(0.5)) * _num(extent) / _num(n)


def overlap_weights(n_in: int, n_out: int) -> list[tuple[int, int, float]]:
    """(out, in, weight) triples: length of the overlap of an output bin with a
    unit input bin, so that the weights of an input bin add up to one."""
    step = n_in / n_out
    triples = []
    for out in range(n_out):
        lo = out * step
        hi = float(n_in) if out == n_out - 1 else (out + 1) * step
        cell = int(lo)
        while cell < n_in and cell < hi:
            shared = min(hi, cell + 1) - max(lo, cell)
            if shared > 0:
                triples.append((out, cell, shared))
            cell += 1
    return triples
