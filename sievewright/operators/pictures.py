"""Pictures in columns: resizing, preparation for a model, perceptual hashes and seeded augmentation.

A picture is a struct (height, width, channels, pixels): pixels line by line, the channels of a pixel side by side.
Pictures may differ in size. Every operator is one pass in Arrow batches without a shuffle; nulls, and pictures whose
number of pixels is not what their sides say, give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import CHANNEL_MEAN, CHANNEL_STD
from ..functions import resample as R

PICTURE = "struct<height: int, width: int, channels: int, pixels: array<double>>"
_ARROW = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("pixels", pa.list_(pa.float64()))])
#: Side of the square that is hashed, and how many of its lowest frequencies on either axis are.
HASH_SIDE, HASH_KEEP = 32, 8
#: Shares of a picture that a crop may keep, its ratios of width to height, tries at fitting one, and degrees of a turn.
CROP, RATIO, TRIES, TURN = (0.8, 1.0), (3 / 4, 4 / 3), 10, 10.0


def picture(pixels: Column, height: int, width: int, channels: int = 1) -> Column:
    values = F.transform(pixels, lambda x: x.cast("double"))
    return F.struct(F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(channels).alias("channels"), values.alias("pixels"))


def _arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The pictures of a column as (height, width, channels), None where there is none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sides = [column.field(c).to_pylist() for c in ("height", "width", "channels")]
    there, pixels = column.is_valid().to_pylist(), column.field("pixels")
    for i, shape in enumerate(zip(*sides)):
        values = pixels[i].values if there[i] and None not in shape and min(shape) > 0 else None
        sound = values is not None and len(values) == math.prod(shape) and not values.null_count
        yield values.to_numpy(zero_copy_only=False).reshape(shape) if sound else None


def _structs(pictures: list[np.ndarray | None]) -> pa.Array:
    return pa.array([None if x is None else {"height": x.shape[0], "width": x.shape[1], "channels": x.shape[2], "pixels": x.ravel()} for x in pictures], _ARROW)


def _mapped(rows: DataFrame, name: str, ddl: str, work: Callable[[pa.RecordBatch, list[str]], pa.Array]) -> DataFrame:
    """rows with a column, which takes the place of one of that name, made of whole batches (and the names of their columns)."""
    names, fields = rows.columns, rows.schema.fields
    kept = [i for i, c in enumerate(names) if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), work(b, names)], names=[*(names[i] for i in kept), name])

    return rows.mapInArrow(run, StructType([*(fields[i] for i in kept), *StructType.fromDDL(f"{name} {ddl}").fields]))


def resized(rows: DataFrame, height: int, width: int, kind: str = "area", *, column: str = "picture", name: str = "resized", whole: bool = False) -> DataFrame:
    """rows with the picture at another size: ``area``, ``bilinear`` or ``lanczos``."""
    one = lambda x: None if x is None else R.resize(x, height, width, kind, whole)
    return _mapped(rows, name, PICTURE, lambda b, names: _structs([one(x) for x in _arrays(b.column(names.index(column)))]))


def _planes(x: np.ndarray) -> list[float]:
    return ((x / 255.0 - CHANNEL_MEAN) / CHANNEL_STD).transpose(2, 0, 1).ravel()


def prepared(rows: DataFrame, side: int = 224, *, column: str = "picture", name: str = "planes") -> DataFrame:
    """rows with what a model takes: red, green and blue planes of side * side pixels, one after another, normalised.

    The shorter side is brought to ``side`` (bilinear), the middle is cut out, levels from 0 to 255 become 0 to 1, less
    the channel's mean, over its deviation. Pictures of one channel are taken as grey.
    """

    def one(x: np.ndarray | None) -> np.ndarray | None:
        if x is None or x.shape[2] not in (1, 3):
            return None
        x = np.repeat(x, 3, 2) if x.shape[2] == 1 else x
        return _planes(R.centre(R.resize(x, *R.shorter_side(*x.shape[:2], side), "bilinear"), side))

    return _mapped(rows, name, "array<double>", lambda b, names: pa.array([one(x) for x in _arrays(b.column(names.index(column)))], pa.list_(pa.float64())))


def picture_hashes(rows: DataFrame, *, column: str = "picture", name: str = "hash", whole: bool = True) -> DataFrame:
    """rows with the 63-bit hash of a grey picture of any size: a square of 32, of which the low frequencies but the first count.

    ``whole`` keeps to whole levels when the square is made, as picture libraries do for levels from 0 to 255.
    """

    def one(x: np.ndarray | None) -> int | None:
        if x is None or x.shape[2] != 1:
            return None
        return R.median_bits(R.low_frequencies(R.resize(x, HASH_SIDE, HASH_SIDE, "lanczos", whole)[:, :, 0], HASH_KEEP).ravel()[1:])

    return _mapped(rows, name, "bigint", lambda b, names: pa.array([one(x) for x in _arrays(b.column(names.index(column)))], pa.int64()))


def uniform(seed: int, key: Column, draw: Column | str) -> Column:
    """A number from 0 up to 1 that depends on the seed, the row's key and the draw's name only: the same at any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), F.lit(draw) if isinstance(draw, str) else draw)
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def augmentation_draws(height: Column, width: Column, key: Column, seed: int) -> Column:
    """Struct (top, left, height, width, flip, degrees) of a row's augmentation.

    Up to TRIES crops are drawn, by share of the picture and ratio; the first that fits counts, else the middle of all.
    """
    high, wide = height.cast("double"), width.cast("double")
    least, most = (math.log(x) for x in RATIO)

    def attempt(i: Column) -> Column:
        u = lambda what: uniform(seed, key, F.concat(F.lit(what), i.cast("string")))
        area = high * wide * (F.lit(CROP[0]) + F.lit(CROP[1] - CROP[0]) * u("share"))
        ratio = F.exp(F.lit(least) + F.lit(most - least) * u("ratio"))
        w, h = F.rint(F.sqrt(area * ratio)).cast("int"), F.rint(F.sqrt(area / ratio)).cast("int")
        at = lambda what, room: F.floor(u(what) * (room + 1)).cast("int")
        return F.struct(at("top", height - h).alias("top"), at("left", width - w).alias("left"), h.alias("height"), w.alias("width"))

    fits = F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), attempt), lambda c: (c["height"] > 0) & (c["width"] > 0) & (c["height"] <= height) & (c["width"] <= width))
    whole = F.struct(F.lit(0).alias("top"), F.lit(0).alias("left"), height.cast("int").alias("height"), width.cast("int").alias("width"))
    crop = F.get(F.concat(fits, F.array(whole)), F.lit(0))
    degrees = (uniform(seed, key, "turn") * 2 - 1) * TURN
    return F.struct(*(crop[c].alias(c) for c in ("top", "left", "height", "width")), (uniform(seed, key, "flip") < 0.5).alias("flip"), degrees.alias("degrees"))


def augmented(rows: DataFrame, side: int, seed: int, *, key: str, column: str = "picture", name: str = "augmented") -> DataFrame:
    """rows with the picture cropped, brought to side * side, flipped and turned as drawn by seed and key, and the ``draws``."""
    drawn = rows.withColumn("draws", augmentation_draws(F.col(f"{column}.height"), F.col(f"{column}.width"), F.col(key), seed))

    def one(x: np.ndarray | None, d: dict) -> np.ndarray | None:
        if x is None:
            return None
        cut = x[d["top"] : d["top"] + d["height"], d["left"] : d["left"] + d["width"]]
        out = R.resize(cut, side, side, "bilinear")
        return R.rotate(out[:, ::-1] if d["flip"] else out, d["degrees"])

    def work(b: pa.RecordBatch, names: list[str]) -> pa.Array:
        draws = b.column(names.index("draws")).to_pylist()
        return _structs([one(x, d) for x, d in zip(_arrays(b.column(names.index(column))), draws)])

    return _mapped(drawn, name, PICTURE, work)


def pixel_rows(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, y, x, channel, value): a row for every pixel and channel of a picture."""
    out = rows.select(F.col(key), F.col(column).alias("p"), F.posexplode(f"{column}.pixels").alias("at", "value"))
    line = F.col("p.width") * F.col("p.channels")
    place = F.floor(F.col("at") % line / F.col("p.channels")).cast("int")
    return out.select(key, F.floor(F.col("at") / line).cast("int").alias("y"), place.alias("x"), (F.col("at") % F.col("p.channels")).cast("int").alias("channel"), "value")
