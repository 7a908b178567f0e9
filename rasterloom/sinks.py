"""Exports as files: 16-bit PNG tiles, raw floats, Parquet by tile, and a sidecar."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import PlanError
from .operators import metrics


def png16(samples: np.ndarray) -> bytes:
    """A 16-bit grey (depth, width) or RGB (depth, width, 3) PNG; rows are filtered against the row above."""
    depth, width = samples.shape[:2]
    raw = samples.astype(">u2").reshape(depth, -1).view(np.uint8).reshape(depth, -1)
    up = raw.copy()
    up[1:] -= raw[:-1]
    rows = np.concatenate([np.full((depth, 1), 2, np.uint8), up], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, depth, 16, 2 if samples.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 2)) + chunk(b"IEND", b"")


def _unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """The bytes of an image from its filtered rows; step: bytes a pixel."""
    kinds, out = rows[:, 0], rows[:, 1:].astype(np.int64)
    for k, kind in enumerate(kinds.tolist()):
        up = out[k - 1] if k else np.zeros(out.shape[1], np.int64)
        line = out[k]
        if kind == 2:
            line += up
        elif kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step])
        elif kind in (3, 4):
            for i in range(len(line)):
                a = int(line[i - step]) & 255 if i >= step else 0
                b, c = int(up[i]), int(up[i - step]) if i >= step else 0
                if kind == 3:
                    line[i] += (a + b) // 2
                else:
                    line[i] += min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        elif kind:
            raise PlanError("source", f"rows of filter {kind}")
        line &= 255
    return out.astype(np.uint8)


def read_png16(data: bytes) -> np.ndarray:
    """The samples of a PNG of 8 or 16 bits, grey or RGB with or without alpha (which is dropped), as 16-bit values (depth, width) or (depth, width, 3)."""
    at, parts, head = 8, [], None
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PlanError("source", "not a PNG")
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 8 + n])
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if head is None or head[2] not in (8, 16) or head[3] not in (0, 2, 4, 6) or head[6]:
        raise PlanError("source", "a PNG of 8 or 16 bits, grey or RGB, not interlaced, is needed")
    width, depth, bits, colour = head[:4]
    channels, size = {0: 1, 2: 3, 4: 2, 6: 4}[colour], bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(depth, -1)
    raw = np.ascontiguousarray(_unfiltered(rows, channels * size))
    out = raw.view(">u2").astype(np.uint16) if bits == 16 else raw.astype(np.uint16) * 257
    out = out.reshape(depth, width, channels)[:, :, : 3 if channels > 2 else 1]
    return out if out.shape[2] == 3 else out[:, :, 0]


def luminance(samples: np.ndarray) -> np.ndarray:
    """Grey values in [0, 1] of a 16-bit image; colours by the weights of Rec. 709."""
    x = samples / 65535.0
    return x if x.ndim == 2 else x @ np.array([0.2126, 0.7152, 0.0722])


def _quantised(rows, columns: list[str], order: np.ndarray, shape: tuple[int, int], lo: float, hi: float) -> tuple[np.ndarray, int]:
    """Samples of an image (one component over [lo, hi], two or three over [-1, 1]), and how many were clamped."""
    lo, hi = (lo, hi) if len(columns) == 1 else (-1.0, 1.0)
    layers, clamped = [], 0
    for c in columns:
        v = rows[c].to_numpy().astype(float)[order].reshape(shape)
        t = (v - lo) / (hi - lo) if hi > lo else np.zeros(shape)
        clamped += int(((t < 0) | (t > 1)).sum())
        layers.append(np.floor(np.clip(t, 0, 1) * 65535 + 0.5).astype(np.uint16))
    if len(layers) == 2:
        layers.append(np.full(shape, 32768, np.uint16))
    return (layers[0] if len(layers) == 1 else np.stack(layers, axis=2)), clamped


def adler_joined(first: int, second: int, n: int) -> int:
    """Adler-32 of two pieces of data from those of each; the second has n bytes."""
    m = 65521
    a, b, c, d = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return ((b + d + n * (a - 1)) % m) << 16 | (a + c - 1) % m


def png_strips(df: DataFrame, columns: list[str], lo: float, hi: float, strip: int = 64) -> DataFrame:
    """(strip, deflated, adler, bytes, clamped): `strip` rows of one image over the whole raster, each deflated by itself so that the strips, one after the other, are one stream.

    A strip's first row is filtered against the row above, so that row is sent along: one shuffle.
    """
    if not 1 <= len(columns) <= 3:
        raise PlanError("sink", f"{len(columns)} components have no image form")
    first = F.floor(F.col("sz") / strip)
    sent = df.select("sx", "sz", *columns, F.explode(F.array_distinct(F.array(first, F.floor((F.col("sz") + 1) / strip)))).alias("strip"))

    def run(key, rows):
        x, z, number = rows["sx"].to_numpy(), rows["sz"].to_numpy(), key[0].as_py()
        if not (z >= number * strip).any():
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())], names=["strip", "deflated", "adler", "bytes", "clamped"])
        shape = (int(z.max() - z.min()) + 1, int(x.max() - x.min()) + 1)
        if shape[0] * shape[1] != len(x):
            raise PlanError("sink", f"strip {number} has gaps")
        image, _ = _quantised(rows, columns, np.lexsort((x, z)), shape, lo, hi)
        above = int(z.min()) < number * strip
        own = rows.filter(pa.array(z >= number * strip))
        clamped = _quantised(own, columns, np.arange(own.num_rows), (own.num_rows, 1), lo, hi)[1]
        raw = image.astype(">u2").reshape(shape[0], -1).view(np.uint8).reshape(shape[0], -1)
        up = raw.copy()
        up[1:] -= raw[:-1]
        up = up[1:] if above else up
        data = np.concatenate([np.full((len(up), 1), 2, np.uint8), up], axis=1).tobytes()
        z_ = zlib.compressobj(2, zlib.DEFLATED, -15)
        deflated = z_.compress(data) + z_.flush(zlib.Z_FULL_FLUSH)
        return pa.table([pa.array([number]), pa.array([deflated], pa.binary()), pa.array([zlib.adler32(data)]), pa.array([len(data)]), pa.array([clamped])], names=["strip", "deflated", "adler", "bytes", "clamped"])

    return sent.groupBy("strip").applyInArrow(run, "strip long, deflated binary, adler long, bytes long, clamped long")


def write_png(df: DataFrame, columns: list[str], lo: float, hi: float, path: str, strip: int = 64) -> int:
    """One 16-bit PNG of an exported raster (sx, sz, columns); returns how many samples were clamped. The strips are compressed by the executors; the driver holds one at a time."""
    box = df.agg(F.min("sx"), F.max("sx"), F.min("sz"), F.max("sz")).first()
    width, depth = int(box[1] - box[0]) + 1, int(box[3] - box[2]) + 1
    moved = df.withColumn("sz", F.col("sz") - box[2])
    head = struct.pack(">IIBBBBB", width, depth, 16, 2 if len(columns) > 1 else 0, 0, 0, 0)
    adler, clamped = 1, 0

    def chunk(f, kind: bytes, data: bytes) -> None:
        f.write(struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)))

    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n")
        chunk(f, b"IHDR", head)
        chunk(f, b"IDAT", b"\x78\x5e")
        for r in png_strips(moved, columns, lo, hi, strip).orderBy("strip").toLocalIterator():
            chunk(f, b"IDAT", bytes(r["deflated"]))
            adler, clamped = adler_joined(adler, r["adler"], r["bytes"]), clamped + r["clamped"]
        chunk(f, b"IDAT", b"\x03\x00" + struct.pack(">I", adler))
        chunk(f, b"IEND", b"")
    return clamped


def write_raw(df: DataFrame, columns: list[str], path: str, strip: int = 64) -> None:
    """One file of little-endian 32-bit floats: x fastest, then z, then y if the raster is a volume; components interleaved."""
    rows = F.floor(F.col("sz") / strip).alias("strip")
    keys = (["sy"] if "sy" in df.columns else []) + ["strip"]

    def run(key, t):
        at = np.lexsort((t["sx"].to_numpy(), t["sz"].to_numpy()))
        data = np.stack([t[c].to_numpy()[at] for c in columns], axis=1).astype("<f4").tobytes()
        return pa.table([pa.array([k.as_py()]) for k in key] + [pa.array([data], pa.binary())], names=[*keys, "data"])

    strips = df.select("*", rows).groupBy(*keys).applyInArrow(run, ", ".join(f"{k} long" for k in keys) + ", data binary")
    with open(path, "wb") as f:
        for r in strips.orderBy(*keys).toLocalIterator():
            f.write(bytes(r["data"]))


def tiles(df: DataFrame, columns: list[str], lo: float, hi: float, section: int) -> DataFrame:
    """(tx, tz, png, clamped): one PNG a section of an exported raster; one column is grey over [lo, hi], two or three are RGB over [-1, 1]."""
    if not 1 <= len(columns) <= 3:
        raise PlanError("sink", f"{len(columns)} components have no image form")

    def run(key, rows):
        order = np.lexsort((rows["sx"].to_numpy(), rows["sz"].to_numpy()))
        x, z = rows["sx"].to_numpy(), rows["sz"].to_numpy()
        shape = (int(z.max() - z.min()) + 1, int(x.max() - x.min()) + 1)
        if shape[0] * shape[1] != len(order):
            raise PlanError("sink", f"tile {key} has gaps")
        image, clamped = _quantised(rows, columns, order, shape, lo, hi)
        return pa.table([pa.array([k.as_py()]) for k in key] + [pa.array([png16(image)], pa.binary()), pa.array([clamped])], names=["tx", "tz", "png", "clamped"])

    tiled = df.select("sx", "sz", *columns, F.floor(F.col("sx") / section).alias("tx"), F.floor(F.col("sz") / section).alias("tz"))
    return tiled.groupBy("tx", "tz").applyInArrow(run, "tx long, tz long, png binary, clamped long")


def raw_blocks(df: DataFrame, columns: list[str], section: int) -> DataFrame:
    """(tx, tz, data): little-endian 32-bit floats of each section, x fastest, components interleaved."""

    def run(key, rows):
        order = np.lexsort((rows["sx"].to_numpy(), rows["sz"].to_numpy()))
        data = np.stack([rows[c].to_numpy()[order] for c in columns], axis=1).astype("<f4").tobytes()
        return pa.table([pa.array([k.as_py()]) for k in key] + [pa.array([data], pa.binary())], names=["tx", "tz", "data"])

    tiled = df.select("sx", "sz", *columns, F.floor(F.col("sx") / section).alias("tx"), F.floor(F.col("sz") / section).alias("tz"))
    return tiled.groupBy("tx", "tz").applyInArrow(run, "tx long, tz long, data binary")


def write_tiles(df: DataFrame, path: str, section: int) -> None:
    """Parquet, one directory a section."""
    df.withColumn("tx", F.floor(F.col("sx") / section)).withColumn("tz", F.floor(F.col("sz") / section)).write.partitionBy("tx", "tz").parquet(path)


def provenance(values: dict) -> str:
    """SHA-256 of the sorted key=value lines."""
    return hashlib.sha256("".join(f"{k}={v}\n" for k, v in sorted(values.items())).encode()).hexdigest()


def sidecar(df: DataFrame, outputs: dict[str, list[str]], job: dict, ranges: dict[str, tuple[float, float]]) -> dict:
    """What was exported: the job, its hash, and each output's statistics."""
    out = []
    for name, columns in sorted(outputs.items()):
        s = metrics.output_statistics(df, *columns).first().asDict()
        lo, hi = ranges.get(name, (-1.0, 1.0))
        beyond = sum(F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)) for c in columns)
        out.append({"name": name, "components": len(columns), "range_min": lo, "range_max": hi, "clamped_samples": df.agg(beyond).first()[0], "statistics": s})
    return {**job, "params_hash": provenance(job), "outputs": out}


def write_sidecar(spark, values: dict, path: str) -> None:
    clean = json.dumps(values, sort_keys=True, default=lambda v: None, allow_nan=False)
    spark.createDataFrame([(clean,)], "value string").coalesce(1).write.text(path)
