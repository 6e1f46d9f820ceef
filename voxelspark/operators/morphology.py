"""Morphology of voxel sets.

A voxel set has distinct rows ``scene_id, ix, iy, iz``.  Operators that look a few cells far run on tiles with a halo (:mod:`tiles`): one
exchange for a whole chain of them.  What has no bound of its reach runs as joins and components.  Every shuffle is by scene and tile or cell, never by
scene alone, so a large scene is spread like many small ones.  Cells outside a set count as empty.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.scalar import CELL, XYZ, quantize, voxel_center
from voxelspark.operators.components import checkpoint, components
from voxelspark.operators.tiles import counted, dilated, eroded, doubled, on_tiles

KEY = ("scene_id", *CELL)
FACES = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]
AROUND = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) != (0, 0, 0)]


def voxelize(points: DataFrame, res: float = 1.0) -> DataFrame:
    return points.select("scene_id", *quantize(res)).distinct()


def dilate(vox: DataFrame, r: int = 1) -> DataFrame:
    return on_tiles(vox, lambda b: dilated(b, r), r)


def erode(vox: DataFrame, r: int = 1) -> DataFrame:
    return on_tiles(vox, lambda b: eroded(b, r), r)


def closing_radius(cavity_fill_diameter: float, voxel_size: float) -> int:
    return int(cavity_fill_diameter // (2 * voxel_size))


def close(vox: DataFrame, r: int) -> DataFrame:
    """Cells that closing adds to the set: one exchange, as a cell's closing depends on what is within 2r of it."""
    return on_tiles(vox, lambda b: eroded(dilated(b, r), r) & ~b, 2 * r)


def fill_cavities(points: DataFrame, r: int, res: float = 1.0) -> DataFrame:
    """Observed points keep their places; cells that closing adds become filled points at their centres."""
    vox = voxelize(points, res)
    filled = close(vox, r).select("scene_id", *voxel_center(res), F.lit(False).alias("observed"))
    return points.select("scene_id", *XYZ, F.lit(True).alias("observed")).unionByName(filled)


def upsample2(vox: DataFrame) -> DataFrame:
    """Eight children a voxel; they are distinct, so nothing is shuffled."""
    for axis in CELL:
        child = F.explode(F.array(2 * F.col(axis), 2 * F.col(axis) + 1)).alias(axis)
        vox = vox.select("scene_id", *[child if c == axis else F.col(c) for c in CELL])
    return vox


def erode_26(vox: DataFrame, threshold: int = 26) -> DataFrame:
    """Voxels of which at least ``threshold`` of 26 neighbours are set."""
    return on_tiles(vox, lambda b: b & (counted(b, AROUND) >= threshold), 1)


def _grown(block: np.ndarray) -> np.ndarray:
    return block | (counted(block, FACES) >= 2)


def dilate_6_selective(vox: DataFrame) -> DataFrame:
    """Adds an empty cell if two of its faces at least touch the input."""
    return on_tiles(vox, _grown, 1)


def _shell(block: np.ndarray) -> np.ndarray:
    return block & ~eroded(block)


def shell_26(vox: DataFrame) -> DataFrame:
    return on_tiles(vox, _shell, 1)


#: Cells a side of a finest block that one task of the refinement holds; coarser tiles are as much smaller.
FINE = 96


def refine_shell(points: DataFrame, res: float = 1.0, cycles: int = 2) -> DataFrame:
    """Centres of the shell after ``cycles`` halvings of the voxel size.

    The whole chain runs inside tiles after one exchange.  The first cycle looks one of its cells far, each later one two, the last two more, and the
    shell one: in cells of the input that is under three for any number of cycles.
    """

    def kernel(block: np.ndarray) -> np.ndarray:
        for n in range(1, cycles + 1):
            block = doubled(block)
            block = _grown(block) if n <= 1 else dilated(eroded(block))
            if n == cycles:
                block = _grown(eroded(block))
        return _shell(block)

    scale = 2**cycles
    # distances in the finest cells: one cell of cycle n is 2 ** (cycles - n) of them
    far = 1 + sum(2 ** (cycles - n) * ((1 if n <= 1 else 2) + (2 if n == cycles else 0)) for n in range(1, cycles + 1))
    shell = on_tiles(voxelize(points, res), kernel, -(-far // scale), max(1, FINE // scale), scale)
    return shell.select("scene_id", *voxel_center(res / scale))


def dilate_points(points: DataFrame, d: int, res: float = 1.0) -> DataFrame:
    """Each point with copies of it at all offsets of up to d steps; exact duplicates once."""
    for axis in XYZ:
        copies = F.explode(F.array(*[F.col(axis) + k * res for k in range(-d, d + 1)])).alias(axis)
        points = points.select("scene_id", *[copies if c == axis else F.col(c) for c in XYZ])
    return points.distinct()


def layer_histogram(vox: DataFrame) -> DataFrame:
    return vox.groupBy("scene_id", "iz").agg(F.count("*").alias("n"))


def occupied_count(vox: DataFrame) -> DataFrame:
    return vox.select(*KEY).distinct().groupBy("scene_id").agg(F.count("*").alias("n"))


def bounds(table: DataFrame, names: tuple[str, ...] = XYZ) -> DataFrame:
    return table.groupBy("scene_id").agg(*[f(n).alias(f"{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])


_SIDES = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def occupied_columns(vox: DataFrame) -> DataFrame:
    """Columns with a voxel: ``scene_id, ix, iy``, its lowest and highest voxel ``low, high`` and the ``gaps`` (z0, z1) between voxels."""
    zs = vox.groupBy("scene_id", "ix", "iy").agg(F.sort_array(F.collect_set("iz")).alias("zs"))
    pairs = F.zip_with(F.slice("zs", 1, F.size("zs") - 1), F.slice("zs", 2, F.size("zs") - 1), lambda a, b: F.struct((a + 1).alias("z0"), (b - 1).alias("z1")))
    return zs.select("scene_id", "ix", "iy", F.array_min("zs").alias("low"), F.array_max("zs").alias("high"), F.filter(pairs, lambda g: g["z0"] <= g["z1"]).alias("gaps"))


def _beside(df: DataFrame, *more: str) -> DataFrame:
    """Each row at the four columns beside its own, ``nx, ny``."""
    way = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in _SIDES])).alias("way")
    return df.select("scene_id", "ix", "iy", *more, way).select("scene_id", "ix", "iy", *more, (F.col("ix") + F.col("way.x")).alias("nx"), (F.col("iy") + F.col("way.y")).alias("ny"))


def exterior_gaps(columns: DataFrame) -> DataFrame:
    """Gaps between voxels of a column that are connected by faces to the outside: ``scene_id, ix, iy, z0, z1``.

    All space above and below a column's voxels, and all of a column without any, is outside.  So only gaps are nodes: a gap is
    outside if one beside it is, or if it lies beside such space.  Nothing is ever expanded to the box.
    """
    gaps = columns.select("scene_id", "ix", "iy", F.explode("gaps").alias("g")).select("scene_id", "ix", "iy", "g.z0", "g.z1")
    gaps = checkpoint(gaps.withColumn("node", F.struct("scene_id", "ix", "iy", "z0")))
    other = columns.select("scene_id", F.col("ix").alias("nx"), F.col("iy").alias("ny"), "low", "high", "gaps")
    met = checkpoint(_beside(gaps, "z0", "z1", "node").join(other, ["scene_id", "nx", "ny"], "left"))
    opens = met.filter("low IS NULL OR z0 < low OR z1 > high").select("node").distinct()
    touching = F.filter("gaps", lambda g: (g["z0"] <= F.col("z1")) & (g["z1"] >= F.col("z0")))
    edges = met.select("node", "scene_id", "nx", "ny", F.explode(touching).alias("g")).select(F.col("node").alias("src"), F.struct("scene_id", F.col("nx").alias("ix"), F.col("ny").alias("iy"), "g.z0").alias("dst"))
    found = components(edges)
    named = gaps.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    outside = named.join(opens, "node", "left_semi").select("component").distinct()
    return named.join(outside, "component", "left_semi").select("scene_id", "ix", "iy", "z0", "z1")


def exterior_air(vox: DataFrame) -> DataFrame:
    """Free cells of the bounding box, padded by one, that are connected by faces to its border."""
    columns = checkpoint(occupied_columns(vox))
    box = bounds(vox, CELL)
    every = box.select("scene_id", F.explode(F.sequence(F.col("min_ix") - 1, F.col("max_ix") + 1)).alias("ix"), "min_iy", "max_iy", (F.col("min_iz") - 1).alias("z0"), (F.col("max_iz") + 1).alias("z1"))
    every = every.repartition("scene_id", "ix")  # so that no task expands a whole box
    every = every.select("scene_id", "ix", F.explode(F.sequence(F.col("min_iy") - 1, F.col("max_iy") + 1)).alias("iy"), "z0", "z1")
    ends = every.join(columns.drop("gaps"), ["scene_id", "ix", "iy"], "left")
    ends = ends.select("scene_id", "ix", "iy", F.explode(F.when(F.col("low").isNull(), F.array(F.struct("z0", "z1"))).otherwise(F.array(F.struct("z0", (F.col("low") - 1).alias("z1")), F.struct((F.col("high") + 1).alias("z0"), "z1")))).alias("g"))
    runs = ends.select("scene_id", "ix", "iy", "g.z0", "g.z1").unionByName(exterior_gaps(columns))
    return runs.select("scene_id", "ix", "iy", F.explode(F.sequence("z0", "z1")).alias("iz"))


def outer_shell(vox: DataFrame) -> DataFrame:
    """Occupied voxels with a face to the exterior; cavities inside do not count."""
    columns = checkpoint(occupied_columns(vox))
    gaps = exterior_gaps(columns).select("scene_id", F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.struct("z0", "z1").alias("g")).groupBy("scene_id", "nx", "ny").agg(F.collect_list("g").alias("open"))
    known = columns.select("scene_id", F.col("ix").alias("nx"), F.col("iy").alias("ny"), "low", "high").join(gaps, ["scene_id", "nx", "ny"], "left")
    own = vox.select("scene_id", "ix", "iy", "iz", F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.explode(F.array(F.col("iz") - 1, F.col("iz") + 1)).alias("nz"))
    near = _beside(vox, "iz").withColumn("nz", F.col("iz")).unionByName(own)
    free = F.exists("open", lambda g: F.col("nz").between(g["z0"], g["z1"]))
    met = near.join(known, ["scene_id", "nx", "ny"], "left").filter(F.col("low").isNull() | (F.col("nz") < F.col("low")) | (F.col("nz") > F.col("high")) | free)
    return met.select(*KEY).distinct()
