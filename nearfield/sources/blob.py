"""Tile blobs: a fixed binary form of one tile's mesh, titles and weights; written as a binary column, read with checks."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.mesh import TRIANGLES, hull

#: Fixed values of the format: magic, version and header (magic, version, V, T, offset and length of the articles).
MAGIC, VERSION, HEADER = b"WKRD", 2, struct.Struct("<4sIIIII")
BLOB = "tile_id string, bytes long, hash string, data binary"
ROWS = "tile_id string, v int, title string, weight int, x double, y double, z double"


class BlobError(ValueError):
    """The bytes are no tile blob."""


def encode(points: np.ndarray, faces: np.ndarray, neighbours: np.ndarray, titles: list[str], weights: np.ndarray) -> bytes:
    incident = np.zeros(len(points), "<u4")
    incident[faces[::-1].ravel()] = np.repeat(np.arange(len(faces))[::-1], 3)
    body = b"".join([points.astype("<f4").tobytes(), incident.tobytes(), faces.astype("<u4").tobytes(), neighbours.astype("<u4").tobytes(), weights.astype(np.uint8).tobytes()])
    text = json.dumps(titles, ensure_ascii=False, separators=(",", ":")).encode()
    body += b"\0" * (-len(body) % 4)
    return HEADER.pack(MAGIC, VERSION, len(points), len(faces), HEADER.size + len(body), len(text)) + body + text


def decode(data: bytes) -> dict:
    """Points, incident, faces, neighbours, weights and titles; BlobError for any damage."""
    if len(data) < HEADER.size:
        raise BlobError("the blob is shorter than its header")
    magic, version, n, t, start, size = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise BlobError("wrong magic")
    if version != VERSION:
        raise BlobError(f"unsupported version {version}")
    counts = ((3 * n, "<f4"), (n, "<u4"), (3 * t, "<u4"), (3 * t, "<u4"), (n, "u1"))
    end = HEADER.size + sum(c * np.dtype(k).itemsize for c, k in counts)
    if end > len(data):
        raise BlobError("the counts exceed the blob")
    if start < end or start + size > len(data):
        raise BlobError("the articles lie outside of the blob")
    parts, at = [], HEADER.size
    for c, k in counts:
        parts.append(np.frombuffer(data, k, c, at))
        at += c * np.dtype(k).itemsize
    try:
        titles = json.loads(data[start : start + size])
    except ValueError as error:
        raise BlobError("the articles are no JSON") from error
    if not isinstance(titles, list) or len(titles) != n:
        raise BlobError("one title a vertex is expected")
    titles = [x[0] if isinstance(x, list) else x for x in titles]
    return {"points": parts[0].reshape(-1, 3), "incident": parts[1], "faces": parts[2].reshape(-1, 3), "neighbours": parts[3].reshape(-1, 3), "weights": parts[4], "titles": titles}


def _blob(tile: pd.DataFrame) -> pd.DataFrame:
    import hashlib

    rows = tile.sort_values(["seq", "title"])
    points = rows[["x", "y", "z"]].to_numpy()
    try:
        faces, neighbours = hull(points)
    except ValueError:
        return pd.DataFrame({"tile_id": [], "bytes": [], "hash": [], "data": []})
    data = encode(points, faces, neighbours, rows["title"].tolist(), rows["weight"].to_numpy())
    return pd.DataFrame({"tile_id": [rows["tile_id"].iloc[0]], "bytes": [len(data)], "hash": [hashlib.sha256(data).hexdigest()[:8]], "data": [data]})


def blobs(members: DataFrame) -> DataFrame:
    """One blob a tile of ``members(tile_id, seq, title, weight, x, y, z)``; a tile without a hull has none."""
    return members.select("tile_id", "seq", "title", "weight", "x", "y", "z").groupBy("tile_id").applyInPandas(_blob, BLOB)


def exported(tiles: DataFrame, folder: str) -> DataFrame:
    """Write each of ``tiles(tile_id, data)`` as <tile_id>.bin in ``folder``, which driver and executors must share; the paths. A
    file appears whole: it is written beside its place and moved there."""

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            paths = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target, part = Path(folder, f"{name}.bin"), Path(folder, f".{name}.{uuid.uuid4().hex}")
                part.write_bytes(data.as_py())
                part.replace(target)
                paths.append(str(target))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return tiles.select("tile_id", "data").mapInArrow(files, "path string")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(tile_id, data) of the .bin files in a folder of any file system that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("tile_id"), F.col("content").alias("data"))


def graph(tile: dict) -> dict:
    """The arrays of ``decode`` as vertices (point and one triangle) and triangles (vertices and neighbours)."""
    points = [{"point": tuple(map(float, p)), "triangle": int(t)} for p, t in zip(tile["points"], tile["incident"], strict=True)]
    return {"vertices": points, "triangles": [{"vertices": tuple(map(int, v)), "neighbours": tuple(map(int, n))} for v, n in zip(tile["faces"], tile["neighbours"], strict=True)]}


def arrays(found: dict) -> dict:
    """The inverse of ``graph``; points are single precision, as kept."""
    return {
        "points": np.array([v["point"] for v in found["vertices"]], "<f4").reshape(-1, 3), "incident": np.array([v["triangle"] for v in found["vertices"]], "<u4"),
        "faces": np.array([t["vertices"] for t in found["triangles"]], "<u4").reshape(-1, 3), "neighbours": np.array([t["neighbours"] for t in found["triangles"]], "<u4").reshape(-1, 3),
    }


def vertices(tiles: DataFrame) -> DataFrame:
    """The vertices of ``tiles(tile_id, data)``, one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tile = decode(data)
                n, p = len(tile["titles"]), tile["points"].astype(float)
                columns = [[name] * n, np.arange(n, dtype=np.int32), tile["titles"], tile["weights"].astype(np.int32), p[:, 0], p[:, 1], p[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ROWS.replace(",", "").split()[::2])

    return tiles.select("tile_id", "data").mapInArrow(rows, ROWS)


def triangles(tiles: DataFrame) -> DataFrame:
    """The triangles of ``tiles(tile_id, data)``, one row each, as ``mesh.triangles`` has them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tile = decode(data)
                n = len(tile["faces"])
                lists = [pa.ListArray.from_arrays(np.arange(0, 3 * n + 1, 3, dtype=np.int32), tile[k].astype(np.int32).ravel()) for k in ("faces", "neighbours")]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), *lists], ["tile_id", "t", "v", "n"])

    return tiles.select("tile_id", "data").mapInArrow(rows, TRIANGLES)
