"""Voxel sets as tiles: one exchange with a halo, then array operations inside each tile.

Space is cut into cubes of ``side`` cells.  A voxel goes to its own tile and to those whose halo of ``halo`` cells it lies in: with 32
cells and a halo of 2 that is 1.4 copies of it, and any chain of operations that looks no farther than the halo needs nothing else.  A
task works on one tile at a time, a dense block of (side + 2 halo)^3 cells, so its memory depends on the side alone, whatever the size of a scene.  Tiles
without a voxel in reach have no rows and cost nothing.  Cells outside a block count as empty; only the part inside the tile, which the block's edge cannot reach, is returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.scalar import CELL

SIDE = 32
TILE = ("tx", "ty", "tz")
Kernel = Callable[[np.ndarray], np.ndarray]


def tiles_of(cell: Column, halo: int, side: int) -> Column:
    """Tiles along one axis whose halo the cell lies in."""
    return F.sequence(F.floor((cell - halo) / side).cast("int"), F.floor((cell + halo) / side).cast("int"))


def dealt(vox: DataFrame, halo: int, side: int = SIDE) -> DataFrame:
    """``scene_id, tx, ty, tz, at``: each voxel at every tile that it concerns, with its place in the tile's block."""
    if side < 1 or halo < 0:
        raise ValueError("a tile has a side of one cell at least, and a halo of none at least")
    width = side + 2 * halo
    for axis, tile in zip(CELL, TILE):
        vox = vox.select("*", F.explode(tiles_of(F.col(axis), halo, side)).alias(tile))
    at = F.lit(0)
    for axis, tile in zip(CELL, TILE):
        at = at * width + (F.col(axis) - F.col(tile) * side + halo)
    return vox.select("scene_id", *TILE, at.cast("int").alias("at"))


def dilated(block: np.ndarray, r: int = 1) -> np.ndarray:
    """Dilation by a box of half-width r, one axis at a time."""
    for axis in range(3):
        source = np.moveaxis(block, axis, 0)
        out = source.copy()
        for k in range(1, r + 1):
            out[k:] |= source[:-k]
            out[:-k] |= source[k:]
        block = np.moveaxis(out, 0, axis)
    return block


def eroded(block: np.ndarray, r: int = 1) -> np.ndarray:
    padded = np.pad(block, r)  # what is beyond the block counts as empty
    return ~dilated(~padded, r)[r:-r, r:-r, r:-r] if r else block


def counted(block: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """How many of a cell's neighbours at these offsets are set."""
    padded, out = np.pad(block, 1).astype(np.int8), np.zeros(block.shape, np.int8)
    for offset in offsets:
        out += padded[tuple(slice(1 - o, 1 - o + n) for o, n in zip(offset, block.shape))]
    return out


def doubled(block: np.ndarray) -> np.ndarray:
    for axis in range(3):
        block = np.repeat(block, 2, axis)
    return block


def core(block: np.ndarray, halo: int, scale: int = 1) -> np.ndarray:
    h = halo * scale
    return block[h:-h, h:-h, h:-h] if h else block


def on_tiles(vox: DataFrame, kernel: Kernel, halo: int, side: int = SIDE, scale: int = 1) -> DataFrame:
    """The cells that ``kernel`` leaves of each tile's block; it may return ``scale`` times as many cells an axis.

    ``vox`` has distinct rows.  The kernel must not look farther than ``halo`` cells of the input.
    """
    width = side + 2 * halo
    schema = {"scene_id": vox.schema["scene_id"].dataType.simpleString()} | dict.fromkeys(CELL, "int")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        block = np.zeros(width**3, bool)
        block[table.column("at").to_numpy()] = True
        found = np.nonzero(core(kernel(block.reshape(width, width, width)), halo, scale))
        low = [k.as_py() * side * scale for k in key[1:]]
        cells = [pa.array((found[k] + low[k]).astype(np.int32)) for k in range(3)]
        scene = pa.repeat(key[0], len(found[0]))
        return pa.table([scene, *cells], names=list(schema))

    return dealt(vox, halo, side).groupBy("scene_id", *TILE).applyInArrow(run, ", ".join(f"{n} {t}" for n, t in schema.items()))
