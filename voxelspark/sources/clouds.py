"""Point clouds (PCD) and meshes (STL) as files: decoded one file a row, in parallel over files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.functions.scalar import XYZ, drop_nan_points

_TRIANGLE = [f"{n}{i}" for i in range(3) for n in XYZ]


def decode_pcd(data: bytes) -> np.ndarray:
    """x, y, z of an ASCII or binary PCD file, by the public format."""
    head, at = {}, 0
    while True:
        end = data.index(b"\n", at)
        line, at = data[at:end].decode("ascii", "replace").strip(), end + 1
        if line and not line.startswith("#"):
            key, *values = line.split()
            head[key] = values
            if key == "DATA":
                break
    names = head["FIELDS"]
    place = [names.index(n) for n in XYZ]
    if head["DATA"][0] == "ascii":
        rows = [line.split() for line in data[at:].decode("ascii", "replace").splitlines() if line.strip()]
        return np.array([[float(r[i]) for i in place] for r in rows], float).reshape(-1, 3)
    kinds = {"F": "f", "I": "i", "U": "u"}
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(names))]
    row = np.dtype([(f"f{i}", f"<{kinds[t]}{s}", (c,) if c > 1 else ()) for i, (t, s, c) in enumerate(zip(head["TYPE"], head["SIZE"], counts))])
    table = np.frombuffer(data, row, int(head["POINTS"][0]), at)
    return np.stack([table[f"f{i}"].astype(float) for i in place], 1)


def decode_stl(data: bytes) -> np.ndarray:
    """Triangles of an ASCII or binary STL file, nine numbers a row."""
    if len(data) >= 84 and len(data) == 84 + 50 * (n := struct.unpack_from("<I", data, 80)[0]):
        return np.frombuffer(data, np.dtype([("v", "<f4", 12), ("a", "<u2")]), n, 84)["v"][:, 3:].astype(float)
    words = data.decode("ascii", "replace").split()
    at = [i for i, w in enumerate(words) if w == "vertex"]
    return np.array([[float(x) for x in words[i + 1 : i + 4]] for i in at], float).reshape(-1, 9)


def _decoded(files: DataFrame, decode, names: list[str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                table = pd.DataFrame(decode(bytes(content)), columns=names)
                table.insert(0, "path", path)
                table.insert(1, "row", np.arange(len(table), dtype="int64"))
                yield table

    return files.select("path", "content").mapInPandas(run, f"path string, row long, {', '.join(f'{n} double' for n in names)}")


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def read_cloud_pcd(spark: SparkSession, folder: str, pattern: str = "*.pcd") -> DataFrame:
    return _decoded(_files(spark, folder, pattern), decode_pcd, list(XYZ))


def read_mesh_stl(spark: SparkSession, folder: str, any_case: bool = False, pattern: str | None = None) -> DataFrame:
    """Triangles of the meshes of a folder; files without triangles give no rows."""
    return _decoded(_files(spark, folder, pattern or ("*.[sS][tT][lL]" if any_case else "*.stl")), decode_stl, _TRIANGLE)


#: Rows of one text file.
FILE_ROWS = 200_000


def _written(rows: DataFrame, key: str, names: list[str], text, folder: str) -> None:
    """A text file for every ``FILE_ROWS`` rows of a key, in folders by key and part."""
    sized = rows.groupBy(key).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("parts"))
    dealt = rows.join(sized, key).withColumn("part", F.pmod(F.xxhash64(*names), F.col("parts")).cast("int"))

    def run(group: tuple, table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [group[0]], "part": [group[1]], "value": [text(table[names].to_numpy(float))]})

    files = dealt.select(key, "part", *names).groupBy(key, "part").applyInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, part int, value string")
    files.write.mode("overwrite").partitionBy(key, "part").text(folder)


def encode_pcd(points: np.ndarray) -> str:
    n = len(points)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z\nSIZE 8 8 8\nTYPE F F F\nCOUNT 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA ascii"
    return "\n".join([head, *(" ".join(map(repr, row)) for row in points.tolist())])


def encode_stl(triangles: np.ndarray) -> str:
    corner = lambda v: "vertex " + " ".join(map(repr, v))
    faces = [f"facet normal 0 0 0\nouter loop\n{corner(t[0:3])}\n{corner(t[3:6])}\n{corner(t[6:9])}\nendloop\nendfacet" for t in triangles.tolist()]
    return "\n".join(["solid mesh", *faces, "endsolid mesh"])


def write_cloud_pcd(points: DataFrame, folder: str) -> None:
    """ASCII PCD files of each scene's points that have all three coordinates."""
    _written(drop_nan_points(points).select("scene_id", *XYZ), "scene_id", list(XYZ), encode_pcd, folder)


def write_mesh_stl(triangles: DataFrame, folder: str) -> None:
    """ASCII STL files of each mesh."""
    _written(triangles, "mesh_id", _TRIANGLE, encode_stl, folder)


def write_cloud(points: DataFrame, path: str) -> None:
    """x, y, z of the points that have all three, one folder a scene."""
    if not path.endswith(".pcd"):
        raise ValueError("a cloud's name ends with .pcd")
    drop_nan_points(points).select("scene_id", *XYZ).write.mode("overwrite").partitionBy("scene_id").parquet(path)
