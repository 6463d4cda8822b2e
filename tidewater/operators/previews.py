"""PNG previews of maps and patches, encoded in tasks.

A map's preview is put together from bands, one for each row of tiles. A band is compressed by itself and ends at a byte,
so the compressed bands of an image only have to be joined: no task holds an image's pixels. Edge cases: bands without
tiles are black, images that cannot be read give no patch previews, and boxes are cut off at their image's border.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rasters
from .images import decode

HEAD, BASE = b"\x89PNG\r\n\x1a\n", 65521


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def header(width: int, height: int, bands: int) -> bytes:
    return chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2 if bands == 3 else 0, 0, 0, 0))


def lines(px: np.ndarray) -> bytes:
    """The rows of an image, each after its filter byte."""
    return np.hstack([np.zeros((len(px), 1), np.uint8), px.reshape(len(px), -1)]).tobytes()


def png(px: np.ndarray) -> bytes:
    """A whole small image of bytes, height x width or height x width x 3."""
    return HEAD + header(px.shape[1], px.shape[0], 1 if px.ndim == 2 else 3) + chunk(b"IDAT", zlib.compress(lines(px))) + chunk(b"IEND", b"")


def band(raw: bytes) -> tuple[bytes, int, int]:
    """Lines as a chunk of the image's stream, their checksum and length."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return chunk(b"IDAT", c.compress(raw) + c.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)


def joined_adler(a: int, b: int, length: int) -> int:
    """The checksum of two stretches of bytes from theirs and the length of the second."""
    low = ((a & 0xFFFF) + (b & 0xFFFF) - 1) % BASE
    high = ((a >> 16) + (b >> 16) + length % BASE * ((a & 0xFFFF) - 1)) % BASE
    return high << 16 | low


def map_previews(tiles: DataFrame, tile: int = rasters.TILE) -> DataFrame:
    """image_id, content: a grey PNG of every map, scaled to its own least and largest value."""
    kind = tiles.schema["image_id"].dataType.simpleString()

    def one_band(p: pd.DataFrame) -> pd.DataFrame:
        at = next(p.itertuples(index=False))
        px = np.zeros((at.h, at.width), np.uint8)
        for r in p.itertuples(index=False):
            px[:, r.tx * tile : r.tx * tile + r.w] = np.rint(np.clip(np.asarray(r.value, float), 0, 1) * 255).reshape(r.h, r.w)
        return pd.DataFrame([(at.image_id, at.ty, at.width, at.height, *band(lines(px)))], columns=["image_id", "ty", "width", "height", "part", "adler", "size"])

    def one_image(p: pd.DataFrame) -> pd.DataFrame:
        at = next(p.itertuples(index=False))
        known = {r.ty: (r.part, r.adler, r.size) for r in p.itertuples(index=False)}
        out, total = [HEAD, header(at.width, at.height, 1), chunk(b"IDAT", b"\x78\x9c")], 1
        for ty in range(-(-at.height // tile)):
            part, adler, size = known.get(ty) or band(lines(np.zeros((min(tile, at.height - ty * tile), at.width), np.uint8)))
            out.append(bytes(part))
            total = joined_adler(total, int(adler), int(size))
        out += [chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)), chunk(b"IEND", b"")]
        return pd.DataFrame([(at.image_id, b"".join(out))], columns=["image_id", "content"])

    bands = rasters.display(tiles).select("image_id", "ty", "tx", "width", "height", "w", "h", "value").groupBy("image_id", "ty").applyInPandas(one_band, f"image_id {kind}, ty int, width int, height int, part binary, adler long, size long")
    return bands.groupBy("image_id").applyInPandas(one_image, f"image_id {kind}, content binary")


def patch_previews(images: DataFrame, chosen: DataFrame) -> DataFrame:
    """name, content: a PNG of each chosen patch (name, path, x, y, w, h) of the images (path, content); every image that
    is asked for is decoded once. Chosen patches are few."""
    wanted = chosen.groupBy("path").agg(F.collect_list(F.struct("name", "x", "y", "w", "h")).alias("boxes"))

    def cut_out(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for content, boxes in zip(p.content, p.boxes):
                px = decode(content)
                for b in boxes if px is not None else ():
                    area = px[max(b["y"], 0) : b["y"] + b["h"], max(b["x"], 0) : b["x"] + b["w"]]
                    if area.size:
                        out.append((b["name"], png(np.ascontiguousarray(area, np.uint8))))
            yield pd.DataFrame(out, columns=["name", "content"])

    return images.join(wanted, "path").select("content", "boxes").mapInPandas(cut_out, "name string, content binary")


def safe_name(column: str):
    """A file name for an id: what is unusual in names becomes _, and a digest keeps names apart."""
    return F.concat(F.regexp_replace(F.col(column).cast("string"), r"[^A-Za-z0-9._-]+", "_"), F.lit("-"), F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 12))
