"""Media columns: GIF files as binary columns, their timed frames, colour histograms, and texts kept as pixels.

``frames`` decodes any GIF column into one row a frame. ``stored`` keeps bytes as the palette indices of a GIF, 192
samples a row and ``ROWS`` rows a frame, with the unpadded length in a comment; the palette is grey, so a pixel's colour is
its sample. Files are written once as a Parquet table in the shared folder and features come from the bytes read back.
Every row is independent: no shuffle. Memory is bounded by one Arrow batch and one decoded picture.

Defined cases: a null or empty text is 192 blanks; null GIF bytes have no frames; equal texts have equal files; repeated
rows repeat; an empty table gives no rows; other columns are not read; a damaged file is an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import gif
from nearfield.llm.common import table, written

UNIT, ROWS, DELAY_MS, BINS = 192, 256, 100, 16
GREYS = np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(256, 3)
FRAMES = "id long, frame int, start_ms long, delay_ms int, width int, height int, rgba binary, red array<int>, green array<int>, blue array<int>"
MEDIA = "doc_id long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def as_gif(data: bytes) -> bytes:
    """``data`` padded with blanks to a positive multiple of ``UNIT``, as a GIF."""
    padded = data + b" " * (-len(data) % UNIT if data else UNIT)
    samples = np.frombuffer(padded, np.uint8).reshape(-1, UNIT)
    frames = [gif.Frame(0, 0, UNIT, len(part), part, GREYS, DELAY_MS, 1) for part in (samples[k : k + ROWS] for k in range(0, len(samples), ROWS))]
    return gif.write(UNIT, min(ROWS, len(samples)), frames, GREYS, b"bytes=%d" % len(data))


def from_gif(media: bytes) -> tuple[bytes, int]:
    """The padded bytes that a file of ``as_gif`` shows, and the unpadded length."""
    picture = gif.read(media)
    if not picture.comments:
        raise ValueError("the file doesn't tell how many bytes it holds")
    samples = b"".join([np.ascontiguousarray(f.rgb()[:, :, 0]).tobytes() for f in picture.frames])
    return samples, int(picture.comments[0].removeprefix(b"bytes="))


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, files, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            files.append(as_gif((text.as_py() or "").encode()))
            held += len(files[-1])
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])
                ids, files, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            file = media.as_py()
            payload, size = from_gif(file)
            shades = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).reshape(BINS, -1).sum(axis=1)
            row = (doc_id, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), ",".join(map(str, shades.tolist())))
            rows.append(row)
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], FEATURES.replace(",", "").split()[::2])


def stored(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as GIF files: doc_id, media. Lazy; write it where it shall stay."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_media, MEDIA)


def features(media: DataFrame) -> DataFrame:
    return media.select("doc_id", "media").mapInArrow(_features, FEATURES)


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "frame", "start_ms", "delay_ms", "width", "height", "rgba", "red", "green", "blue"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.list_(pa.int32())] * 3]
    for batch in batches:
        for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not data.is_valid:
                continue
            picture, start = gif.read(data.as_py()), 0
            for k, (frame, canvas) in enumerate(zip(picture.frames, gif.composed(picture), strict=True)):
                shown = canvas[canvas[:, :, 3] > 0]
                colours = [np.bincount(shown[:, c] // (256 // BINS), minlength=BINS).tolist() for c in range(3)]
                row = [key, k, start, frame.delay_ms, picture.width, picture.height, canvas.tobytes(), *colours]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)
                start += frame.delay_ms


def frames(files: DataFrame, key: str = "id", media: str = "media") -> DataFrame:
    """One row a frame: when it begins and how long it shows, the composed canvas, and histograms of visible pixels."""
    return files.select(F.col(key).cast("long").alias("id"), F.col(media).alias("media")).mapInArrow(_frames, FRAMES)


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored as GIF and read back."""
    return features(written(stored(table(spark, sf_dir, "documents")), "media", "none"))
