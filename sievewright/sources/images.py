"""What the bytes of a picture file say: whether it is whole, its format and its sides, without decoding pixels.

PNG: every chunk is walked by its stated length and held against its checksum, so damage anywhere is found. JPEG:
segments are walked by their stated lengths up to the scan, and the file ends with its mark; what lies within the scan
has no checksum. BMP and WEBP state their length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How files begin and end, as hexadecimal digits.
PNG, JPEG, BMP, WEBP = "89504E470D0A1A0A", "FFD8", "424D", "52494646"
PNG_END, JPEG_END = "0000000049454E44AE426082", "FFD9"
#: Marks of JPEG without a length, and those of frames, which have the sides.
BARE = ("01", *(f"D{i}" for i in range(8)))
FRAMES = tuple(f"C{i:X}" for i in range(16) if i not in (4, 8, 12))
#: Segments before the scan from which a JPEG counts as damaged; whole ones have some tens.
MOST_SEGMENTS = 65_536


def _digits(content: Column, at: Column | int, n: Column | int) -> Column:
    """n bytes from a place (from 0) on, as hexadecimal digits."""
    return F.hex(F.substring(content, (F.lit(at) if isinstance(at, int) else at) + 1, n))


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def _little(content: Column, at: int, n: int = 4) -> Column:
    return _number(F.concat(*(_digits(content, at + i, 1) for i in reversed(range(n)))))


def _state(at: Column, whole: Column, width: Column, height: Column) -> Column:
    """Where a walk is, whether it has come to a good end (null: not yet), and the sides."""
    return F.struct(at.cast("bigint").alias("at"), whole.cast("boolean").alias("whole"), width.cast("bigint").alias("width"), height.cast("bigint").alias("height"))


def _walk(steps: Column, start: int, step) -> Column:
    none = F.lit(None)
    on = lambda now, _: F.when(now["whole"].isNotNull(), now).otherwise(step(now))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), _state(F.lit(start), none, none, none), on)


def _png(content: Column) -> Column:
    size = F.octet_length(content)

    def step(now: Column) -> Column:
        at, width, height = now["at"], now["width"], now["height"]
        length, kind = _number(_digits(content, at.cast("int"), 4)), _digits(content, at.cast("int") + 4, 4)
        end = at + 12 + length
        sound = (at + 12 <= size) & (end <= size)
        checked = F.crc32(F.substring(content, at.cast("int") + 5, length.cast("int") + 4)) == _number(_digits(content, (end - 4).cast("int"), 4))
        first = at == 8
        header = first & (kind == "49484452") & (length == 13)
        side = lambda by: _number(_digits(content, at.cast("int") + 8 + by, 4))
        last = kind == "49454E44"
        return (
            F.when(~F.coalesce(sound, F.lit(False)), _state(at, F.lit(False), width, height))
            .when(~checked | (first != header), _state(at, F.lit(False), width, height))
            .otherwise(_state(end, F.when(last, end == size), F.when(header, side(0)).otherwise(width), F.when(header, side(4)).otherwise(height)))
        )

    return _walk(F.ceil(size / 12).cast("int"), 8, step)


def _jpeg(content: Column) -> Column:
    size = F.octet_length(content)

    def step(now: Column) -> Column:
        at, width, height = now["at"], now["width"], now["height"]
        place = at.cast("int")
        sign, mark = _digits(content, place, 1), _digits(content, place + 1, 1)
        length = _number(_digits(content, place + 2, 2))
        frame = mark.isin(*FRAMES)
        side = lambda by: _number(_digits(content, place + by, 2))
        ended = F.endswith(F.hex(F.substring(content, -2, 2)), F.lit(JPEG_END))
        return (
            F.when((at + 2 > size) | (sign != "FF"), _state(at, F.lit(False), width, height))
            .when(mark == "FF", _state(at + 1, F.lit(None), width, height))  # filling before a mark
            .when(mark.isin(*BARE), _state(at + 2, F.lit(None), width, height))
            .when((at + 4 > size) | (length < 2) | (at + 2 + length > size), _state(at, F.lit(False), width, height))
            .when(mark == "DA", _state(at, ended & width.isNotNull(), width, height))
            .otherwise(_state(at + 2 + length, F.lit(None), F.when(frame, side(7)).otherwise(width), F.when(frame, side(5)).otherwise(height)))
        )

    return _walk(F.least(F.ceil(size / 2).cast("int"), F.lit(MOST_SEGMENTS)), 2, step)


def inspected(content: Column) -> Column:
    """Struct (format, width, height, whole): null format for other files; null sides where the file doesn't tell them."""
    begins = lambda digits: F.startswith(F.hex(F.substring(content, 1, 12)), F.lit(digits))
    named = lambda name, walked: F.struct(
        F.lit(name).alias("format"), walked["width"].alias("width"), walked["height"].alias("height"), F.coalesce(walked["whole"], F.lit(False)).alias("whole")
    )
    size, none = F.octet_length(content), F.lit(None)
    bmp = _state(none, (size >= 26) & (_little(content, 2) == size), _little(content, 18), _little(content, 22))
    webp = _state(none, (_digits(content, 8, 4) == "57454250") & (_little(content, 4) + 8 == size), none, none)
    return (
        F.when(begins(PNG), named("PNG", _png(content)))
        .when(begins(JPEG), named("JPEG", _jpeg(content)))
        .when(begins(BMP), named("BMP", bmp))
        .when(begins(WEBP), named("WEBP", webp))
        .otherwise(F.struct(none.cast("string").alias("format"), none.cast("bigint").alias("width"), none.cast("bigint").alias("height"), F.lit(False).alias("whole")))
    )
