"""Triangle meshes to surface samples, voxels and reference shells."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.scalar import CELL, XYZ, quantize, triangle_area
from voxelspark.operators.morphology import bounds, outer_shell

#: Samples that one row may make; larger triangles are cut into several rows first.
CHUNK = 100_000


def allocate_samples(triangles: DataFrame, total: int) -> DataFrame:
    """Samples of each triangle by its share of its mesh's area; triangles without any go."""
    sized = triangles.withColumn("area", triangle_area())
    sums = sized.groupBy("mesh_id").agg(F.sum("area").alias("all"))
    return sized.join(sums, "mesh_id").withColumn("n", F.round(total * F.col("area") / F.col("all")).cast("long")).filter("n > 0").drop("all")


def sample_triangles(allocated: DataFrame, seed: int = 42) -> DataFrame:
    """Uniform points of triangles, the same ones on any partitioning: numbers come from hashes of face and sample."""
    chunks = allocated.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    spread = chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("n"), (F.col("chunk") + 1) * CHUNK) - 1)))
    draw = lambda k: F.md5(F.concat_ws("/", F.col("mesh_id").cast("string"), F.col("face_id").cast("string"), F.col("i").cast("string"), F.lit(f"{seed}/{k}")))
    unit = lambda k: F.conv(F.substring(draw(k), 1, 13), 16, 10).cast("long") / float(1 << 52)
    drawn = spread.withColumns({"r1": F.sqrt(unit(1)), "r2": unit(2)})
    a, b, c = 1 - F.col("r1"), F.col("r1") * (1 - F.col("r2")), F.col("r1") * F.col("r2")
    return drawn.select("mesh_id", "face_id", *[(a * F.col(f"{n}0") + b * F.col(f"{n}1") + c * F.col(f"{n}2")).alias(n) for n in XYZ])


def voxelize_triangles(triangles: DataFrame, res: float = 1.0) -> DataFrame:
    """Voxels that a triangle touches: cells of its box that no separating axis parts from it."""
    low = [F.least(*[F.col(f"{n}{i}") for i in range(3)]) for n in XYZ]
    high = [F.greatest(*[F.col(f"{n}{i}") for i in range(3)]) for n in XYZ]
    t = triangles
    for c, a, b in zip(("ix", "iy", "iz"), low, high):
        t = t.withColumn(c, F.explode(F.sequence(F.floor(a / res).cast("int"), F.floor(b / res).cast("int"))))
    half = res / 2
    corners = F.struct(*[(F.col(f"{n}{i}") - (F.col(c) + 0.5) * res).alias(f"{n}{i}") for i in range(3) for n, c in zip(XYZ, ("ix", "iy", "iz"))])

    def meets(p: Column) -> Column:
        """Whether no separating axis parts the corners, relative to the cell's centre, from the cell."""
        v = [[p[f"{n}{i}"] for n in XYZ] for i in range(3)]
        edges = [[v[(i + 1) % 3][k] - v[i][k] for k in range(3)] for i in range(3)]
        zero = F.lit(0.0)
        (ax, ay, az), (bx, by, bz) = edges[0], edges[1]
        axes = [a for e in edges for a in ([zero, -e[2], e[1]], [e[2], zero, -e[0]], [-e[1], e[0], zero])]
        axes.append([ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx])

        def touches(axis: list[Column]) -> Column:
            spots = [sum((axis[k] * v[i][k] for k in range(3)), zero) for i in range(3)]
            reach = sum((F.abs(axis[k]) * half for k in range(3)), zero)
            return (F.least(*spots) <= reach) & (F.greatest(*spots) >= -reach)

        return reduce(and_, [touches(a) for a in axes])

    # the corners are bound to a name once, or each axis would compute them anew
    hit = F.exists(F.array(corners), meets)
    return t.filter(hit).select(F.col("mesh_id").alias("scene_id"), "ix", "iy", "iz").distinct()


def mesh_to_outer_shell(triangles: DataFrame, total: int, res: float) -> DataFrame:
    """Centres of the voxels of a mesh's samples that face the outside."""
    samples = sample_triangles(allocate_samples(triangles, total)).withColumnRenamed("mesh_id", "scene_id")
    origin = bounds(samples)
    vox = samples.join(origin, "scene_id").select("scene_id", *quantize(res, origin=[F.col(f"min_{n}") for n in XYZ])).distinct()
    return outer_shell(vox).join(origin, "scene_id").select("scene_id", *[((F.col(c) + 0.5) * res + F.col(f"min_{n}")).alias(n) for c, n in zip(CELL, XYZ)])


def shell_output_name(stem: str, size: float, one_digit: bool = True) -> str:
    """File name of a shell cloud; one writer gives one digit of the size, the other all."""
    return f"{stem}_outer_shell_voxels_{size:.1f}.pcd" if one_digit else f"{stem}_outer_shell_voxels_{size}.pcd"


def shell_names(paths: DataFrame, size: float) -> DataFrame:
    """Names for many meshes; the size is one number, so it is written once, halves to even as in C."""
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), "[.][^.]*$", "")
    return paths.select("path", F.concat(stem, F.lit(shell_output_name("", size))).alias("name"))
