"""Maps over images as tiles: patch scores drawn on tiles, smoothing with strips of the neighbouring tiles.

A map is a table with a row for each tile: image_id of any type, ty and tx (the tile's row and column), width and height
of the image, w and h of the tile (less than the full size at the right and lower border), value (h * w doubles, row by
row, NaN where no patch lies) and coverage (patches a pixel). Tiles without patches have no row. Work and memory of a
task are bounded by a tile and what lies on it, however large the image is, and tiles of one image are dealt to all
tasks.

Edge cases: patches with a null score, place or size, or that lie outside their image, draw nothing; parts of patches
beyond the border are cut off; repeated patches count as often as they come; an empty table gives an empty map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

TILE = 256
COMBINE = ("mean", "max")
REST = "ty int, tx int, width int, height int, w int, h int, value array<double>, coverage array<int>"


def _schema(images: DataFrame) -> str:
    return f"image_id {images.schema['image_id'].dataType.simpleString()}, {REST}"


MAP = ["image_id", "ty", "tx", "width", "height", "w", "h", "value", "coverage"]
#: Pixels of tiles that a task holds before it sends them on.
PIXELS = 1 << 18


def by_tile(rows: DataFrame, order: list[str], one: Callable[[dict[str, np.ndarray]], tuple | None], schema: str) -> DataFrame:
    """`one` on the columns of each tile's rows, ordered by `order`: rows are dealt by tile and sorted in their tasks, so that
    many small tiles pass without a group's cost for each. A task holds one tile's rows and some finished tiles."""
    keys = ["image_id", "ty", "tx"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: list[pd.DataFrame] = []
        done, held = [], 0
        for p in parts:
            if not len(p):
                continue
            if left and all(left[-1][k].iloc[-1] == p[k].iloc[-1] for k in keys) and all(p[k].iloc[0] == p[k].iloc[-1] for k in keys):
                left.append(p)  # one tile all through
                continue
            whole = pd.concat([*left, p], ignore_index=True) if left else p
            columns = {c: whole[c].to_numpy() for c in whole.columns}
            new = np.zeros(len(whole), bool)
            for k in keys:
                new[1:] |= columns[k][1:] != columns[k][:-1]
            edges = [0, *np.flatnonzero(new)]
            for a, b in zip(edges, edges[1:]):
                got = one({c: x[a:b] for c, x in columns.items()})
                if got is not None:
                    done.append(got)
                    held += len(got[7])
                if held >= PIXELS:
                    yield pd.DataFrame(done, columns=MAP)
                    done, held = [], 0
            left = [whole.iloc[edges[-1] :]]
        if left:
            whole = pd.concat(left, ignore_index=True)
            got = one({c: whole[c].to_numpy() for c in whole.columns})
            if got is not None:
                done.append(got)
        if done:
            yield pd.DataFrame(done, columns=MAP)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as a few bytes may be much work
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def image_sizes(patches: DataFrame) -> DataFrame:
    """image_id, width, height of images that end with their last patch."""
    return patches.groupBy("image_id").agg(F.max(F.col("x") + F.col("w")).cast("int").alias("width"), F.max(F.col("y") + F.col("h")).cast("int").alias("height"))


def draw(patches: DataFrame, sizes: DataFrame | None = None, within: str = "mean", across: str = "max", tile: int = TILE) -> DataFrame:
    """The map of patches (image_id, scale, x, y, w, h, score): `within` a scale overlapping patches are combined by mean
    or max, then the scales `across`. sizes holds image_id, width and height; without it an image ends with its last patch.

    Equal boxes are summed up before they are sent to the tiles that they touch.
    """
    if within not in COMBINE or across not in COMBINE:
        raise ValueError(f"patches and scales are combined by one of {COMBINE}")
    seen = patches.where(" and ".join(f"{c} is not null" for c in ("image_id", "x", "y", "w", "h", "score")) + " and w > 0 and h > 0")
    boxes = seen.groupBy("image_id", F.coalesce(F.col("scale").cast("string"), F.lit("")).alias("scale"), "x", "y", "w", "h").agg(F.sum("score").alias("total"), F.max("score").alias("most"), F.count("*").alias("n"))
    if sizes is None:
        boxes = cut(boxes, "boxes")  # read twice
    sizes = image_sizes(boxes) if sizes is None else sizes.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    boxes = boxes.join(sizes, "image_id").where("x < width and y < height and x + w > 0 and y + h > 0")
    first = lambda a: F.floor(F.greatest(F.col(a), F.lit(0)) / tile).cast("int")
    last = lambda a, size, end: F.floor((F.least(F.col(a) + F.col(size), F.col(end)) - 1) / tile).cast("int")
    dealt = boxes.withColumn("ty", F.explode(F.sequence(first("y"), last("y", "h", "height")))).withColumn("tx", F.explode(F.sequence(first("x"), last("x", "w", "width"))))

    def one_tile(p: dict[str, np.ndarray]) -> tuple:
        image, ty, tx, width, height = (p[c][0] for c in ("image_id", "ty", "tx", "width", "height"))
        top, left = int(ty) * tile, int(tx) * tile
        h, w = min(tile, int(height) - top), min(tile, int(width) - left)
        layers, coverage = [], np.zeros((h, w), np.int32)
        scale = p["scale"]
        edges = [0, *(np.flatnonzero(scale[1:] != scale[:-1]) + 1), len(scale)]
        y0, x0 = np.maximum(p["y"] - top, 0).astype(int), np.maximum(p["x"] - left, 0).astype(int)
        y1, x1 = np.maximum(p["y"] + p["h"] - top, 0).astype(int), np.maximum(p["x"] + p["w"] - left, 0).astype(int)
        for low, high in zip(edges, edges[1:]):
            acc, n = np.full((h, w), 0.0 if within == "mean" else -np.inf), np.zeros((h, w), np.int32)
            for i in range(low, high):
                area = np.s_[y0[i] : y1[i], x0[i] : x1[i]]
                n[area] += p["n"][i]
                if within == "mean":
                    acc[area] += p["total"][i]
                else:
                    np.maximum(acc[area], p["most"][i], out=acc[area])
            layers.append(np.where(n > 0, acc / np.maximum(n, 1) if within == "mean" else acc, np.nan))
            coverage += n
        stack = np.stack(layers)
        there = ~np.isnan(stack)
        none = ~there.any(0)
        value = np.where(there, stack, 0.0).sum(0) / np.maximum(there.sum(0), 1) if across == "mean" else np.where(there, stack, -np.inf).max(0)
        value[none] = np.nan
        return image, ty, tx, width, height, w, h, np.round(value, 9).ravel(), coverage.ravel()

    columns = ["image_id", "ty", "tx", "width", "height", "scale", "x", "y", "w", "h", "total", "most", "n"]
    return by_tile(dealt.select(columns), ["scale", "y", "x", "h", "w"], one_tile, _schema(patches))


def kernel(sigma: float) -> np.ndarray:
    """Weights of a Gaussian out to three sigmas; a single one for sigma 0."""
    if sigma < 0 or not np.isfinite(sigma):
        raise ValueError("sigma must be finite and not negative")
    radius = max(1, int(np.ceil(3 * sigma))) if sigma else 0
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / (sigma or 1.0)) ** 2)
    return k / k.sum()


def _along(a: np.ndarray, k: np.ndarray, axis: int) -> np.ndarray:
    n = a.shape[axis] - len(k) + 1
    return sum(c * np.take(a, np.arange(i, i + n), axis) for i, c in enumerate(k))


def smooth(tiles: DataFrame, sigma: float, tile: int = TILE) -> DataFrame:
    """The map after a separable Gaussian over each whole image: pixels without patches neither give nor get, and the
    border's pixels repeat beyond it.

    Every tile sends the strips that others need to them, and one group puts a tile and its strips together: (tile + 2 *
    radius) squared pixels. With a radius beyond a tile the strips come from as many tiles away as it takes.
    """
    k = kernel(sigma)
    radius = len(k) // 2
    if not radius:
        return tiles
    reach = -(-radius // tile)
    kind = tiles.schema["image_id"].dataType.simpleString()
    strip = f"image_id {kind}, ty int, tx int, width int, height int, y0 int, x0 int, h int, w int, own boolean, value array<double>, coverage array<int>"

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in strip.split(", ")]
        for p in parts:
            held, out = 0, []
            for r in p.itertuples(index=False):
                value = np.asarray(r.value, float).reshape(r.h, r.w)
                top, left = r.ty * tile, r.tx * tile
                for dy in range(-reach, reach + 1):
                    for dx in range(-reach, reach + 1):
                        ty, tx = r.ty + dy, r.tx + dx
                        if ty < 0 or tx < 0 or ty * tile >= r.height or tx * tile >= r.width:
                            continue
                        y0, y1 = max(top, ty * tile - radius), min(top + r.h, (ty + 1) * tile + radius)
                        x0, x1 = max(left, tx * tile - radius), min(left + r.w, (tx + 1) * tile + radius)
                        if y0 >= y1 or x0 >= x1:
                            continue
                        part, own = value[y0 - top : y1 - top, x0 - left : x1 - left], not dy and not dx
                        if own or not np.isnan(part).all():
                            out.append((r.image_id, ty, tx, r.width, r.height, y0, x0, y1 - y0, x1 - x0, own, part.ravel(), r.coverage if own else None))
                            held += part.size
                if held >= PIXELS:
                    yield pd.DataFrame(out, columns=names)
                    held, out = 0, []
            if out:
                yield pd.DataFrame(out, columns=names)

    def gather(p: dict[str, np.ndarray]) -> tuple | None:
        mine = np.flatnonzero(p["own"])
        if not len(mine):  # a neighbour without patches
            return None
        m = mine[0]
        image, ty, tx, width, height, w, h = (p[c][m] for c in ("image_id", "ty", "tx", "width", "height", "w", "h"))
        top, left = ty * tile, tx * tile
        y_low, y_high = max(top - radius, 0), min(top + h + radius, height)
        x_low, x_high = max(left - radius, 0), min(left + w + radius, width)
        value, there = np.zeros((y_high - y_low, x_high - x_low)), np.zeros((y_high - y_low, x_high - x_low))
        for y0, x0, rh, rw, v in zip(p["y0"], p["x0"], p["h"], p["w"], p["value"]):
            v = np.asarray(v, float).reshape(rh, rw)
            area = np.s_[y0 - y_low : y0 - y_low + rh, x0 - x_low : x0 - x_low + rw]
            value[area], there[area] = np.nan_to_num(v), ~np.isnan(v)
        beyond = ((y_low - (top - radius), top + h + radius - y_high), (x_low - (left - radius), left + w + radius - x_high))
        got = [_along(_along(np.pad(a, beyond, mode="edge"), k, 1), k, 0) for a in (value, there)]
        own = np.asarray(p["value"][m], float).reshape(h, w)
        out = np.where(np.isnan(own), np.nan, got[0] / np.maximum(got[1], 1e-12))
        return image, ty, tx, width, height, w, h, out.ravel(), p["coverage"][m]

    return by_tile(tiles.mapInPandas(send, strip), ["y0", "x0"], gather, _schema(tiles))


def display(tiles: DataFrame) -> DataFrame:
    """The map with values scaled to 0..1 in each image and 0 where no patch lies; constant images give 0.

    Tiles are read twice: give a stored table, or they are drawn twice."""
    number = lambda x: ~F.isnan(x)
    ends = tiles.groupBy("image_id").agg(F.min(F.array_min(F.filter("value", number))).alias("_low"), F.max(F.array_max(F.filter("value", number))).alias("_high"))
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low"))
    shown = F.transform("value", lambda x: F.when(F.isnan(x), 0.0).otherwise(F.coalesce((x - F.col("_low")) / span, F.lit(0.0))))
    return tiles.join(ends, "image_id").withColumn("value", shown).drop("_low", "_high")


def share() -> Column:
    """The share of an image's pixels that a patch covers: an aggregate over the image's tiles, beside others."""
    n = F.sum(F.size(F.filter("coverage", lambda c: c > 0)))
    return n / (F.first("width").cast("double") * F.first("height"))


def coverage_share(tiles: DataFrame) -> DataFrame:
    """image_id, covered: the share of an image's pixels that a patch covers."""
    return tiles.groupBy("image_id").agg(share().alias("covered"))


def pixels(tiles: DataFrame, tile: int = TILE, covered: bool = True) -> DataFrame:
    """image_id, px, py, value, coverage of every pixel, or of every one that a patch covers; built-in functions only."""
    each = tiles.select("image_id", "ty", "tx", "w", F.posexplode(F.arrays_zip("value", "coverage")).alias("i", "p"))
    each = each.where("p.coverage > 0") if covered else each
    px, py = F.col("tx") * tile + F.col("i") % F.col("w"), F.col("ty") * tile + F.floor(F.col("i") / F.col("w"))
    return each.select("image_id", px.cast("int").alias("px"), py.cast("int").alias("py"), F.col("p.value").alias("value"), F.col("p.coverage").cast("long").alias("coverage"))


def of_pixels(pixels: DataFrame, sizes: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """The map of pixels (image_id, px, py, value, coverage); one value a pixel."""
    sizes = pixels.groupBy("image_id").agg((F.max("px") + 1).cast("int").alias("width"), (F.max("py") + 1).cast("int").alias("height")) if sizes is None else sizes.select("image_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"))
    dealt = pixels.join(sizes, "image_id").withColumn("ty", F.floor(F.col("py") / tile).cast("int")).withColumn("tx", F.floor(F.col("px") / tile).cast("int"))
    h, w = (F.least(F.lit(tile), F.col(size) - F.col(at) * tile).cast("int") for size, at in (("height", "ty"), ("width", "tx")))

    def one_tile(p: pd.DataFrame) -> pd.DataFrame:
        at = next(p.itertuples(index=False))
        value, coverage = np.full((at.h, at.w), np.nan), np.zeros((at.h, at.w), np.int32)
        y, x = p.py.to_numpy() - at.ty * tile, p.px.to_numpy() - at.tx * tile
        value[y, x], coverage[y, x] = p.value, p.coverage
        return pd.DataFrame([(at.image_id, at.ty, at.tx, at.width, at.height, at.w, at.h, value.ravel(), coverage.ravel())], columns=["image_id", "ty", "tx", "width", "height", "w", "h", "value", "coverage"])

    return dealt.withColumn("h", h).withColumn("w", w).select("image_id", "ty", "tx", "width", "height", "w", "h", "px", "py", "value", "coverage").groupBy("image_id", "ty", "tx").applyInPandas(one_tile, _schema(pixels))
