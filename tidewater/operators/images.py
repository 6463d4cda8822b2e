"""Image folders: scan, profile, patches and their 47 features.

Files are read by Spark's binaryFile source; decoding and pixels stay inside the tasks. PNG (8 bits, not interlaced) and
binary PPM and PGM are decoded here, other formats by Pillow where it is installed.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffixes, and the names and order of the features.
SUFFIXES = ("png", "jpg", "jpeg", "bmp", "webp", "ppm", "pgm")
FEATURES = (
    ["width", "height", "aspect", "mean", "std", "min", "max", "p10", "p90", "contrast"]
    + [f"{c}_{s}" for s in ("mean", "std", "min", "max") for c in "rgb"]
    + ["saturation_mean", "saturation_std", "texture", "edge", "gradient_x", "gradient_y", "entropy"]
    + [f"{c}_hist_{i}" for c in "rgb" for i in range(4)]
    + [f"hist_{i}" for i in range(6)]
)


def decode_png(b: bytes) -> np.ndarray:
    at, idat, palette = 8, [], None
    while at < len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        body = b[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or lace:
                raise ValueError("unsupported PNG")
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            idat.append(body)
        at += 12 + n
    bands = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    raw = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h, w * bands), np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros_like(line)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        elif kind == 1:
            out[y] = np.cumsum(line.reshape(w, bands), 0).ravel() & 255
        else:  # average and Paeth need the byte to the left
            row = np.zeros(w * bands, np.int32)
            for x in range(w * bands):
                a = row[x - bands] if x >= bands else 0
                c = up[x - bands] if x >= bands else 0
                if kind == 3:
                    p = (a + up[x]) // 2
                else:
                    d = a + up[x] - c
                    p = min((abs(d - a), 0, a), (abs(d - up[x]), 1, up[x]), (abs(d - c), 2, c))[2]
                row[x] = (line[x] + p) & 255
            out[y] = row
    px = out.reshape(h, w, bands)
    if color == 3:
        return palette[px[:, :, 0]]
    return np.repeat(px[:, :, :1], 3, 2) if bands < 3 else px[:, :, :3]


def decode_netpbm(b: bytes) -> np.ndarray:
    head = b.split(None, 4)
    w, h, most = int(head[1]), int(head[2]), int(head[3])
    bands = 3 if head[0] == b"P6" else 1
    if most != 255:
        raise ValueError("unsupported netpbm")
    px = np.frombuffer(b[len(b) - w * h * bands :], np.uint8).reshape(h, w, bands)
    return np.repeat(px, 3 // bands, 2)


def decode(b: bytes) -> np.ndarray | None:
    """Height x width x 3 bytes, or None for what is no readable image."""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return decode_png(b)
        if b[:2] in (b"P5", b"P6"):
            return decode_netpbm(b)
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(b)).convert("RGB"))
    except Exception:
        return None


def scan(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file below the folder that is named like an image."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*SUFFIXES)).select("path", "content")


def profile(spark: SparkSession, path: str, sizes: tuple[int, ...] = (64,), strides: tuple[int, ...] = (64,)) -> DataFrame:
    """One row: files, images, unsupported, unreadable, least and largest sides, distinct sizes, estimated patches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            shapes = [decode(b) if x.rsplit(".", 1)[-1].lower() in SUFFIXES else () for x, b in zip(p.path, p.content)]
            yield pd.DataFrame({"supported": [s is None or len(s) > 0 for s in shapes], "w": pd.array([s.shape[1] if s is not None and len(s) else None for s in shapes], "Int32"), "h": pd.array([s.shape[0] if s is not None and len(s) else None for s in shapes], "Int32")})

    m = files.select("path", "content").mapInPandas(measure, "supported boolean, w int, h int")
    count = F.lit(0)
    for size, stride in zip(sizes, strides, strict=True):
        steps = [F.greatest(F.floor((F.col(c) - size) / stride) + 1, F.lit(0)) for c in "wh"]
        count = count + F.greatest(steps[0] * steps[1], F.lit(1))
    ok = F.col("w").isNotNull()
    n = lambda c: F.sum(c.cast("long"))
    return m.agg(F.count("*").alias("files"), n(ok).alias("images"), n(~F.col("supported")).alias("unsupported"), n(F.col("supported") & ~ok).alias("unreadable"), F.min("w").alias("min_width"), F.max("w").alias("max_width"), F.min("h").alias("min_height"), F.max("h").alias("max_height"), F.count_distinct("w", "h").alias("distinct_sizes"), F.sum(F.when(ok, count)).cast("long").alias("estimated_patches"))


def dimensions(images: DataFrame) -> DataFrame:
    """path, width, height of every readable image of (path, content)."""

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            shapes = [(path, px.shape[1], px.shape[0]) for path, px in zip(p.path, map(decode, p.content)) if px is not None]
            yield pd.DataFrame(shapes, columns=["path", "width", "height"])

    return images.mapInPandas(measure, "path string, width int, height int")


def labels_of(sizes: tuple[int, ...]) -> list[str]:
    """s64, and s64_2 for a second scale of the same size."""
    return [f"s{s}" + (f"_{sizes[:i].count(s) + 1}" if s in sizes[:i] else "") for i, s in enumerate(sizes)]


def boxes(w: int, h: int, size: int, stride: int) -> list[tuple[int, int, int, int]]:
    """x, y, width, height of the full patches, row by row; one cropped patch for an image too small for any."""
    full = [(x, y, size, size) for y in range(0, h - size + 1, stride) for x in range(0, w - size + 1, stride)]
    return full or [(0, 0, min(w, size), min(h, size))]


def features(px: np.ndarray) -> np.ndarray:
    """The 47 features of a patch of bytes, in the order of FEATURES."""
    a = px.astype(np.float64) / 255
    h, w = a.shape[:2]
    gray = a.mean(2)
    flat = a.reshape(-1, 3)
    spread = a.max(2) - a.min(2)
    share = lambda v, bins: np.histogram(v, bins, (0, 1))[0] / v.size
    texture = 0.0
    if min(h, w) >= 3:
        mid = gray[1:-1, 1:-1]
        texture = np.mean([np.abs(mid - gray[1 + dy : h - 1 + dy, 1 + dx : w - 1 + dx]) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])
    gx, gy = (np.abs(np.diff(gray, axis=1)).mean(), np.abs(np.diff(gray, axis=0)).mean()) if min(h, w) >= 2 else (0.0, 0.0)
    p = share(gray, 16)
    p = p[p > 0]
    out = [min(w / 1024, 1), min(h / 1024, 1), w / h, gray.mean(), gray.std(), gray.min(), gray.max(), *np.percentile(gray, [10, 90]), gray.std()]
    out += [*flat.mean(0), *flat.std(0), *flat.min(0), *flat.max(0), spread.mean(), spread.std(), texture, (gx + gy) / 2, gx, gy, -(p * np.log2(p)).sum() / 4]
    return np.nan_to_num(np.concatenate([out, *[share(a[:, :, c], 4) for c in range(3)], share(gray, 6)]), nan=0, posinf=0, neginf=0)


def patches(images: DataFrame, sizes: tuple[int, ...] = (64,), strides: tuple[int, ...] = (64,)) -> DataFrame:
    """patch_id, path, scale, x, y, w, h, v (features) of every patch; unreadable images give none."""
    if len(sizes) != len(strides) or min(sizes) <= 0 or min(strides) <= 0:
        raise ValueError("sizes and strides must be positive and as many")
    names = labels_of(sizes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, content in zip(p.path, p.content):
                px = decode(content)
                if px is None:
                    continue
                stem = path.rsplit(".", 1)[0].split(":", 1)[-1].lstrip("/")
                for name, size, stride in zip(names, sizes, strides):
                    for x, y, w, h in boxes(px.shape[1], px.shape[0], size, stride):
                        rows.append((f"{stem}_{name}_stride{stride}_x{x}_y{y}", path, name, x, y, w, h, features(px[y : y + h, x : x + w])))
            yield pd.DataFrame(rows, columns=["patch_id", "path", "scale", "x", "y", "w", "h", "v"])

    return images.mapInPandas(run, "patch_id string, path string, scale string, x int, y int, w int, h int, v array<double>")
