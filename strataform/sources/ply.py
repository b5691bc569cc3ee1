"""PLY scans as a Spark data source, ASCII and binary of both byte orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# fixed values: property types of the format
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
ORDERS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
SCHEMA = "cloud_id string, point_id bigint, x float, y float, z float"


def parse(content: bytes) -> np.ndarray:
    """Vertices of a scan as an n x 3 array of 32-bit floats; ValueError with the reason for anything else."""
    if not content.startswith(b"ply"):
        raise ValueError("not a PLY file (a pointer to one, perhaps): it does not begin with 'ply'")
    end = content.find(b"end_header")
    if end < 0:
        raise ValueError("the PLY header has no end")
    body = content[content.index(b"\n", end) + 1 :]
    form, count, columns, element = None, None, [], None
    for line in content[:end].decode("ascii", "replace").splitlines():
        part = line.split()
        if part[:1] == ["format"]:
            form = part[1]
        elif part[:1] == ["element"]:
            if count is None and part[1] != "vertex":
                raise ValueError("elements before the vertices are not supported")
            element = part[1]
            count = int(part[2]) if element == "vertex" else count
        elif part[:1] == ["property"] and element == "vertex":
            if part[1] not in TYPES:
                raise ValueError(f"vertices with a property of type {part[1]} are not supported")
            columns.append((part[2], TYPES[part[1]]))
    names = [name for name, _ in columns]
    if form not in ORDERS or count is None or not {"x", "y", "z"} <= set(names):
        raise ValueError("the PLY header gives no format, or no vertices with x, y and z")
    if form == "ascii":
        flat = np.array(body.split()[: count * len(names)], np.float64)
        if len(flat) < count * len(names):
            raise ValueError("the PLY body is too short")
        table = flat.reshape(count, len(names))
        return np.stack([table[:, names.index(c)] for c in "xyz"], axis=1).astype(np.float32)
    kind = np.dtype([(name, ORDERS[form] + t) for name, t in columns])
    if len(body) < count * kind.itemsize:
        raise ValueError("the PLY body is too short")
    table = np.frombuffer(body, kind, count)
    return np.stack([table[c] for c in "xyz"], axis=1).astype(np.float32)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Points of all scans under ``path`` (a glob is fine), and a row with ``error`` for each file that could not be read.

    A scan is named by its file. Files are read by Spark's own reader, so any store
    it knows will do, and each is parsed once. A file is held whole: the format
    gives no way into its middle.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["cloud_id", "point_id", "x", "y", "z", "error"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    xyz = parse(content.as_py())
                except ValueError as reason:
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.float32())] * 3, pa.array([str(reason)])], names)
                    continue
                for at in range(0, len(xyz), 100_000):
                    part = xyz[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), *(pa.array(part[:, k]) for k in range(3)), pa.nulls(len(part), pa.string())], names)

    return files.mapInArrow(rows, SCHEMA + ", error string")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``scan`` as points, and as the files that could not be read with the reason."""
    rows = scan(spark, path)
    return rows.filter("error IS NULL").drop("error"), rows.filter("error IS NOT NULL").select("cloud_id", "error")
