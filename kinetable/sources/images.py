"""A store of analysis frames as PNG images in Parquet.

One file per frame would be a file too many, and a video file is one task.  Here a row is a frame: keys, frame index and the
PNG bytes, sorted by key and frame, so that the scan skips row groups by session and frame range before any image is
decoded, and a long session is many tasks.  Any store that Spark reads will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col

# Fixed values of the PNG format: signature, and samples a pixel by color type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png(pixels: np.ndarray) -> bytes:
    """A gray image (rows x columns) of 8- or 16-bit values as PNG."""
    deep = 16 if pixels.dtype == np.uint16 else 8
    rows = pixels.astype(">u2" if deep == 16 else np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], deep, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def _unfiltered(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Undo the row filters; sums are modulo 256."""
    rows = raw.reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + step), np.uint8)  # a row above and a pixel to the left, both zero
    for y in range(height):
        kind, line, above, here = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            here[step:] = line
        elif kind == 1:
            here[step:] = np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            here[step:] = line + above[step:]
        elif kind == 3:
            for x in range(stride):
                here[step + x] = (int(line[x]) + (int(here[x]) + int(above[step + x])) // 2) & 255
        elif kind == 4:
            for x in range(stride):
                a, b, k = int(here[x]), int(above[step + x]), int(above[x])
                near = min((abs(b - k), 0, a), (abs(a - k), 1, b), (abs(a + b - 2 * k), 2, k))[2]
                here[step + x] = (int(line[x]) + near) & 255
        else:
            raise ValueError("unknown row filter")
    return out[1:, step:]


def gray(data: bytes) -> np.ndarray:
    """A PNG of 8 or 16 bits a sample, not interlaced, as gray values: the mean of its color samples."""
    if not data or data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, colors, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            colors = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
        at += size + 12
    if head is None:
        raise ValueError("no image header")
    width, height, deep, color, _, _, interlaced = head
    if deep not in (8, 16) or color not in SAMPLES or interlaced:
        raise ValueError("unsupported kind of PNG")
    n = SAMPLES[color]
    step = n * deep // 8
    flat = _unfiltered(np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8), height, width * step, step)
    samples = np.ascontiguousarray(flat).view(">u2" if deep == 16 else np.uint8).reshape(height, width, n)
    if color == 3:
        samples = colors[samples[:, :, 0]]
    return samples[:, :, : {2: 1, 4: 3}.get(n, n) if color != 3 else 3].astype(np.float64).mean(axis=2)


def shrunk(pixels: np.ndarray, factor: int) -> np.ndarray:
    """Means of ``factor`` x ``factor`` squares; incomplete ones at the right and lower edge go."""
    h, w = (n // factor * factor for n in pixels.shape)
    return pixels[:h, :w].reshape(h // factor, factor, w // factor, factor).mean(axis=(1, 3))


def write_frames(frames: DataFrame, path: str, keys: Sequence[str] = ("sid",), values: str = "gray", width: str = "width", partitions: int | None = None) -> None:
    """``keys, frame_index, timestamp_sec`` and an array of 16-bit gray values in row order, as PNG."""
    head = [*keys, "frame_index", "timestamp_sec"]
    schema = ", ".join(f"{n} {frames.schema[n].dataType.simpleString()}" for n in head) + ", image binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(len(head)), batch.column(len(head) + 1).to_pylist())
            images = [png(np.clip(v.values.to_numpy(zero_copy_only=False), 0, 65535).astype(np.uint16).reshape(-1, w)) for v, w in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(head)], pa.array(images, pa.binary())], names=[*head, "image"])

    made = frames.select(*head, values, width).mapInArrow(run, schema)
    order = [*keys, "frame_index"]
    dealt = made.repartitionByRange(partitions, *order) if partitions else made.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("append").parquet(path)


def read_frames(spark: SparkSession, path: str, where: Column | None = None, stride: int = 1, shrink: int = 1) -> DataFrame:
    """Keys, ``frame_index, timestamp_sec, width, height, valid, gray``.

    ``where`` is a condition on keys and frames and reaches the scan.  With a ``stride`` only every so many frames are
    decoded; ``source_frame`` is their index before, ``frame_index`` counts on.  An image that can't be decoded keeps its
    row, with ``valid`` false and no pixels.
    """
    stored = spark.read.parquet(path)
    rows = stored if where is None else stored.filter(where)
    if stride > 1:
        rows = rows.filter(F.pmod("frame_index", F.lit(stride)) == 0)
    rows = rows.withColumns({"source_frame": c("frame_index"), "frame_index": F.floor(c("frame_index") / stride).cast("bigint")})
    head = [n for n in rows.columns if n != "image"]
    kind = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data in batch.column(len(head)).to_pylist():
                try:
                    pixels = gray(data) if shrink == 1 else shrunk(gray(data), shrink)
                    found.append((pixels.shape[1], pixels.shape[0], True, pixels.ravel()))
                except (ValueError, TypeError, IndexError, struct.error, zlib.error):
                    found.append((0, 0, False, None))
            cols = [pa.array(v, t) for v, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.float64())))]
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(head)], *cols], names=[*head, "width", "height", "valid", "gray"])

    return rows.select(*head, "image").mapInArrow(run, f"{kind}, width int, height int, valid boolean, gray array<double>")
