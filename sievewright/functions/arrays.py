"""Column functions on arrays and bits: softmax, argmax, normalising, hashes from coefficients, bands."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CHANNEL_MEAN, CHANNEL_STD


def argmax(values: Column) -> Column:
    """Index, from 0, of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    """Shares that sum to 1; the largest logit is subtracted first, so nothing overflows."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def normalise_channels(pixel: Column) -> Column:
    """(value - mean) / deviation for each channel of a pixel."""
    stats = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(s).alias("s")) for m, s in zip(CHANNEL_MEAN, CHANNEL_STD)))
    return F.zip_with(pixel, stats, lambda x, s: (x - s["m"]) / s["s"])


def hash_from_array(low: Column) -> Column:
    """63 coefficients as bits: 1 where above the median, most significant first; fits a signed long without its sign."""
    median = F.get(F.array_sort(low), F.lit(31))
    return F.aggregate(low, F.lit(0).cast("bigint"), lambda acc, x: acc * 2 + F.when(x > median, 1).otherwise(0))


def dct_hash(pixels: Column, side: int, keep: int = 8) -> Column:
    """The hash of a grey picture of side * side pixels (row by row): its DCT's keep * keep lowest coefficients but the first, as bits.

    Type-II cosines, orthonormal. Only the kept rows and columns are worked out: rows of the picture first, then columns.
    """
    wave = [[math.cos(math.pi * (2 * x + 1) * u / (2 * side)) * math.sqrt((1 if u == 0 else 2) / side) for x in range(side)] for u in range(keep)]
    waves = F.array(*(F.array(*(F.lit(x) for x in row)) for row in wave))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    lines = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda y: F.transform(F.slice(pixels, y * side + 1, F.lit(side)), lambda v: v.cast("double")))
    turn = lambda many: F.transform(waves, lambda w: F.transform(many, lambda one: dot(one, w)))
    # Bound, so that lines and what becomes of them are worked out once: first coefficient v of each line, then u along these.
    bound = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    both = F.flatten(bound(bound(lines, turn), turn))
    return bound(F.slice(both, F.lit(2), F.lit(keep * keep - 1)), hash_from_array)


def to_planes(pixels: Column, channels: int = 3) -> Column:
    """Values of pixels (channels side by side, 0 to 255) as one plane a channel, 0 to 1, in reverse order of channels (BGR to RGB)."""
    places = lambda c: F.filter(pixels, lambda _, i: i % channels == c)
    return F.array(*(F.transform(places(c), lambda x: x / F.lit(255.0)) for c in reversed(range(channels))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_keys(value: Column, threshold: int) -> Column:
    """threshold + 1 equal bands of a 64-bit hash, most significant first."""
    bands = threshold + 1
    width = 64 // bands
    mask = (1 << width) - 1 if width < 64 else -1
    return F.array(*(F.shiftrightunsigned(value, 64 - (i + 1) * width).bitwiseAND(F.lit(mask)) for i in range(bands)))


def hash_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def value_range(values: Column) -> Column:
    return F.struct(F.array_min(values).alias("low"), F.array_max(values).alias("high"))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b as a double; 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def at_most(n: Column, most: int, what: str) -> Column:
    """True up to a size; beyond it the query fails by name, where a group would grow in one task without end."""
    return F.when(n <= most, F.lit(True)).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(f" {what}: more than {most}"))).cast("boolean"))
