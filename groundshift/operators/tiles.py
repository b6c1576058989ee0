"""Raster tiles with a halo: the unit in which pixels that need their neighbours are shuffled.

A tile is a square of pixels with as many lines of its neighbours around it as the work reaches. One exchange
deals an area's pixels to tiles, numpy works on each as arrays, and the tile's own pixels come back as rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: Side of a tile; with all columns some megabytes.
TILE = 256
SSIM_SIDE, SSIM_C1, SSIM_C2 = 7, 1e4, 9e4


class Grid:
    """The rows of a tile and its halo as arrays over the box that they fill."""

    def __init__(self, part: pa.Table):
        self.part = part
        row, col = (part.column(c).to_numpy().astype(np.int64) for c in ("row", "col"))
        self.shape = (int(row.max() - row.min()) + 1, int(col.max() - col.min()) + 1)
        self.at = (row - row.min()) * self.shape[1] + col - col.min()

    def of(self, column: str, missing, dtype) -> np.ndarray:
        """A column as an array; ``missing`` where it is null or there is no pixel."""
        values = self.part.column(column)
        values = (values.fill_null(missing) if values.null_count else values).to_numpy().astype(dtype)
        out = np.full(self.shape, missing, dtype=dtype)
        out.ravel()[self.at] = values
        return out


def over_tiles(pixels: DataFrame, made: dict[str, str], work: Callable[[Grid], dict[str, np.ndarray]], halo: int, keys=("aoi_id",), side: int = TILE) -> DataFrame:
    """``pixels`` with the columns ``made`` (name: type) that ``work`` makes of each tile's arrays.

    What ``work`` gives of a pixel may depend on pixels at most ``halo`` lines away. A line beyond the box that the rows
    fill is outside of the grid: there is no pixel on it in any tile. Rows and columns are not negative.
    """
    if 2 * halo >= side:
        raise ValueError("the halo is wider than half a tile")

    def tiles(c: str) -> Column:
        ends = F.array(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
        return F.explode(F.array_distinct(F.filter(ends, lambda t: t >= 0)))

    names = [c for c in pixels.columns if c not in made]
    fields = [pixels.schema[c] for c in names] + [StructField(c, _parse_datatype_string(t)) for c, t in made.items()]

    def run(part: pa.Table) -> pa.Table:
        tr, tc = part.column("_tr")[0].as_py(), part.column("_tc")[0].as_py()
        row, col = (part.column(c).to_numpy() for c in ("row", "col"))
        own = np.flatnonzero((row // side == tr) & (col // side == tc))
        if not len(own):  # a halo beyond the grid
            return _nothing(part, names, made)
        grid = Grid(part)
        found = work(grid)
        out = part.select(names).take(pa.array(own))
        for c, t in made.items():
            values = found[c].ravel()[grid.at[own]]
            out = out.append_column(c, pa.array(values, from_pandas=values.dtype.kind == "f", type=_ARROW[t]))
        return out

    dealt = pixels.withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col"))
    return dealt.groupBy(*keys, "_tr", "_tc").applyInArrow(run, StructType(fields))


_ARROW = {"double": pa.float64(), "boolean": pa.bool_()}


def _nothing(part: pa.Table, names: list[str], made: dict[str, str]) -> pa.Table:
    out = part.select(names).slice(0, 0)
    for c, t in made.items():
        out = out.append_column(c, pa.array([], _ARROW[t]))
    return out


def _moving_sum(values: np.ndarray, reach: int) -> np.ndarray:
    """Sums over squares, with the border mirrored."""
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach + 1, reach)
        total = np.cumsum(np.pad(values, pad, mode="symmetric"), axis=axis)
        n = values.shape[axis]
        values = np.take(total, np.arange(2 * reach + 1, 2 * reach + 1 + n), axis=axis) - np.take(total, np.arange(n), axis=axis)
    return values


def ssim_dissimilarity(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One minus the local SSIM of two integer arrays; window sums are exact."""
    reach, n = SSIM_SIDE // 2, float(SSIM_SIDE * SSIM_SIDE)
    mx, my, mxx, myy, mxy = (_moving_sum(v, reach) / n for v in (x, y, x * x, y * y, x * y))
    fix = n / (n - 1)
    vx, vy, vxy = fix * (mxx - mx * mx), fix * (myy - my * my), fix * (mxy - mx * my)
    return 1.0 - ((2 * mx * my + SSIM_C1) * (2 * vxy + SSIM_C2)) / ((mx * mx + my * my + SSIM_C1) * (vx + vy + SSIM_C2))


def _window(values: np.ndarray, size: int, grow: bool):
    """Greatest or least value of each size x size square; outside of the grid is the least value of all."""
    reach = size // 2
    outside = False if values.dtype == bool else -np.inf
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (reach, reach)
        wide, n = np.pad(values, pad, constant_values=outside), values.shape[axis]
        for k in range(2 * reach + 1):
            part = wide[k : k + n] if axis == 0 else wide[:, k : k + n]
            values = part.copy() if k == 0 else np.maximum(values, part) if grow else np.minimum(values, part)
    return values


def open_close(values: np.ndarray, open_size: int, close_size: int) -> np.ndarray:
    """Opening, then closing, of a mask or, flat, of levels; a size of 1 or less skips its step.

    Flat openings and closings commute with thresholds: the levels that stay give the mask at any threshold.
    """
    for size, grow in [(open_size, False), (open_size, True)] * (open_size > 1) + [(close_size, True), (close_size, False)] * (close_size > 1):
        values = _window(values, size, grow)
    return values


def reach_of(open_size: int, close_size: int) -> int:
    """How far a pixel's cleaned value depends on others."""
    return sum(2 * (size // 2) for size in (open_size, close_size) if size > 1)
