"""Column functions on points, voxels, poses and colours; all are JVM expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ, CELL = ("x", "y", "z"), ("ix", "iy", "iz")
#: Fixed values of the packed key: bits an axis and their bias.
BITS, BIAS, MASK = 21, 1 << 20, (1 << 21) - 1
#: Fixed values of the stable colours.
GOLDEN, SATURATION = 0.61803398875, 0.92


def quantize(res: float, names: Sequence[str] = XYZ, origin: Sequence[Column] | None = None) -> list[Column]:
    """Cells of points: floor, so negative coordinates go down; relative to an origin if one is given."""
    place = [F.col(n) - o for n, o in zip(names, origin)] if origin else [F.col(n) for n in names]
    return [F.floor(p / res).cast("int").alias(c) for p, c in zip(place, CELL)]


def voxel_center(res: float, origin: Sequence[float] = (0.0, 0.0, 0.0)) -> list[Column]:
    return [((F.col(c) + 0.5) * res + o).alias(n) for c, n, o in zip(CELL, XYZ, origin)]


def pack_voxel(ix: str = "ix", iy: str = "iy", iz: str = "iz") -> Column:
    """Three cells in one bigint that sorts by ix, iy, iz."""
    part = lambda c, n: F.shiftleft((F.col(c).cast("long") + BIAS).bitwiseAND(MASK), n)
    return part(ix, 2 * BITS).bitwiseOR(part(iy, BITS)).bitwiseOR(part(iz, 0))


def unpack_voxel(key: str = "vkey") -> list[Column]:
    return [(F.shiftright(key, n).bitwiseAND(MASK) - BIAS).cast("int").alias(c) for c, n in zip(CELL, (2 * BITS, BITS, 0))]


def drop_nan_points(points: DataFrame, names: Sequence[str] = XYZ) -> DataFrame:
    for n in names:
        points = points.filter(F.col(n).isNotNull() & ~F.isnan(n))
    return points


def yaw_from_quaternion() -> Column:
    x, y, z, w = (F.col(f"q{n}") for n in "xyzw")
    return F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))


def yaw_toward(cx: float, cy: float) -> Column:
    return F.atan2(F.lit(cy) - F.col("y"), F.lit(cx) - F.col("x"))


def quaternion_from_yaw(yaw: Column) -> list[Column]:
    return [F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(yaw / 2).alias("qz"), F.cos(yaw / 2).alias("qw")]


def stamp_to_seconds(sec: Column, nanosec: Column) -> Column:
    return sec + nanosec * 1e-9


def in_range(dx: Column, dy: Column, dz: Column, reach: float) -> Column:
    return dx * dx + dy * dy + dz * dz <= reach * reach


def in_frustum(dx: Column, dy: Column, dz: Column, yaw: Column, length: float, width: float, height: float) -> Column:
    """Inside the pyramid ahead of a pose; only its yaw counts."""
    c, s = F.cos(-yaw), F.sin(-yaw)
    ahead, side = c * dx - s * dy, s * dx + c * dy
    return (ahead >= 0) & (ahead <= length) & (F.abs(side) <= width / 2 * (ahead / length)) & (F.abs(dz) <= height / 2 * (ahead / length))


def frustum_edges(poses: DataFrame, length: float, width: float, height: float) -> DataFrame:
    """Eight segments a pose: from the apex to four corners, and around them; turned by the whole quaternion."""
    w, h = width / 2, height / 2
    corners = [(0.0, 0.0, 0.0), (length, w, h), (length, -w, h), (length, -w, -h), (length, w, -h)]
    ends = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3), (3, 4), (4, 1)]
    rows = [F.struct(F.lit(e).alias("edge"), F.lit(k).alias("tip"), *[F.lit(v).alias(n) for v, n in zip(corners[c], ("px", "py", "pz"))]) for e, pair in enumerate(ends) for k, c in enumerate(pair)]
    t = poses.select("scene_id", "seq", *[F.col(n) for n in (*XYZ, "qx", "qy", "qz", "qw")], F.explode(F.array(*rows)).alias("c"))
    px, py, pz = (F.col(f"c.{n}") for n in ("px", "py", "pz"))
    qx, qy, qz, qw = (F.col(n) for n in ("qx", "qy", "qz", "qw"))
    tx, ty, tz = 2 * (qy * pz - qz * py), 2 * (qz * px - qx * pz), 2 * (qx * py - qy * px)
    return t.select(
        "scene_id", "seq", F.col("c.edge").alias("edge"), F.col("c.tip").alias("tip"),
        (F.col("x") + px + qw * tx + (qy * tz - qz * ty)).alias("x"),
        (F.col("y") + py + qw * ty + (qz * tx - qx * tz)).alias("y"),
        (F.col("z") + pz + qw * tz + (qx * ty - qy * tx)).alias("z"),
    )


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def stable_color(ident: Column) -> list[Column]:
    """A colour that depends on the id alone, as r, g, b of 0 to 255."""
    hue = (ident * GOLDEN) % 1
    value = 0.98 - 0.08 * (((ident * 97) % 5) / 4.0)
    sextant = F.floor(hue * 6)
    f = hue * 6 - sextant
    p, q, t = value * (1 - SATURATION), value * (1 - SATURATION * f), value * (1 - SATURATION * (1 - f))
    table = [(value, t, p), (q, value, p), (p, value, t), (p, q, value), (t, p, value), (value, p, q)]

    def channel(k: int) -> Column:
        out = F.when(sextant == 0, table[0][k])
        for i in range(1, 6):
            out = out.when(sextant == i, table[i][k])
        return F.floor(out * 255).cast("int")

    return [channel(k).alias(n) for k, n in enumerate("rgb")]


def triangle_area() -> Column:
    (ax, ay, az), (bx, by, bz) = ([F.col(f"{n}{i}") - F.col(f"{n}0") for n in XYZ] for i in (1, 2))
    cx, cy, cz = ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx
    return 0.5 * F.sqrt(cx * cx + cy * cy + cz * cz)


def crop_points(points: DataFrame, min_h: float, max_h: float, r_min: float, r_max: float) -> DataFrame:
    """Points in a band of heights and a band of distances from the origin."""
    d2 = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return points.filter(F.col("z").between(min_h, max_h) & d2.between(r_min * r_min, r_max * r_max))


def recolor_seen(first_seen: Column) -> Column:
    """Green for a point that was seen, red for one that was not."""
    return F.when(first_seen.isNotNull(), pack_rgb(F.lit(0), F.lit(255), F.lit(0))).otherwise(pack_rgb(F.lit(255), F.lit(0), F.lit(0)))
