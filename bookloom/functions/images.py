"""Kind and size of images by their headers, and whether a policy takes them: column expressions over bytes.

Sizes stand at fixed places in PNG, GIF, WebP and BMP. A JPEG is walked segment by segment, in a fold of bounded length;
a TIFF's first directory is searched for its two entries. Nothing beyond the headers is read or decoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The longest side and the most pixels of an image.
MAX_SIDE, MAX_PIXELS = 4096, 4 << 20
#: Segments of a JPEG that are walked, and entries of a TIFF directory that are looked at, at most.
MAX_SEGMENTS, MAX_ENTRIES = 256, 64


def number(data: Column, at, n: int, little: bool = False) -> Column:
    """The unsigned number in n bytes from byte at (the first is 0); null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(data, at + 1, F.lit(n)))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(n - 1, -1, -1)])
    return F.when((at >= 0) & (F.octet_length(data) >= at + n), F.conv(digits, 16, 10).cast("long"))


def image_kind(data: Column) -> Column:
    """jpeg, png, gif, webp, bmp or tiff by the first bytes, else null."""
    head = F.hex(F.substring(data, 1, 16))
    return (
        F.when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
        .when(head.rlike("^47494638(37|39)61"), "gif")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
        .when(F.startswith(head, F.lit("424D")), "bmp")
        .when(head.rlike("^(49492A00|4D4D002A)"), "tiff")
    )


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _jpeg(data: Column) -> Column:
    """From segment to segment until one declares a frame; bytes FF between segments are fill."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))

    def step(s: Column, _) -> Column:
        at = s["at"]
        marker = number(data, at + 1, 1)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        alone = (marker == 1) | marker.between(0xD0, 0xD8)  # markers without a length
        ends = marker.isin(0xD9, 0xDA)  # the end, or the picture itself
        length = number(data, at + 2, 2)
        after = F.when(marker == 0xFF, at + 1).when(alone, at + 2).when(~ends & (length >= 2), at + 2 + length)
        here = number(data, at, 1) == 0xFF
        stop = F.struct(none.alias("at"), s["width"].alias("width"), s["height"].alias("height"))
        found = F.struct(none.alias("at"), number(data, at + 7, 2).alias("width"), number(data, at + 5, 2).alias("height"))
        return F.when(at.isNull(), s).when(~F.coalesce(here, F.lit(False)) | marker.isNull(), stop).when(frame, found).otherwise(F.struct(after.alias("at"), s["width"].alias("width"), s["height"].alias("height")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_SEGMENTS)), start, step, lambda s: _size(s["width"], s["height"]))


def _webp(data: Column) -> Column:
    chunk = F.hex(F.substring(data, 13, 4))
    bits = number(data, 21, 4, little=True)
    lossy = _size(number(data, 26, 2, True).bitwiseAND(0x3FFF), number(data, 28, 2, True).bitwiseAND(0x3FFF))
    lossless = _size(bits.bitwiseAND(0x3FFF) + 1, F.shiftright(bits, 14).bitwiseAND(0x3FFF) + 1)
    extended = _size(number(data, 24, 3, True) + 1, number(data, 27, 3, True) + 1)
    return F.when(chunk == "56503820", lossy).when(chunk == "5650384C", lossless).when(chunk == "56503858", extended)


def _tiff(data: Column, little: bool) -> Column:
    first = number(data, 4, 4, little)
    many = F.least(number(data, first, 2, little), F.lit(MAX_ENTRIES)).cast("int")
    at = lambda i: first + 2 + 12 * i
    value = lambda i: F.when(number(data, at(i) + 2, 2, little) == 3, number(data, at(i) + 8, 2, little)).otherwise(number(data, at(i) + 8, 4, little))
    entries = F.when(many > 0, F.sequence(F.lit(0), many - 1))
    of = lambda tag: F.get(F.transform(F.filter(entries, lambda i: number(data, at(i), 2, little) == tag), value), F.lit(0))
    return _size(of(256), of(257))


def image_size(data: Column) -> Column:
    """struct<width, height> as the header declares them; null where it ends too early or says nothing."""
    kind, head = image_kind(data), F.hex(F.substring(data, 1, 2))
    signed = lambda c: F.abs(F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))  # noqa: E731  rows of a BMP from the top
    bmp = F.when(number(data, 14, 4, True) == 12, _size(number(data, 18, 2, True), number(data, 20, 2, True))).otherwise(_size(number(data, 18, 4, True), signed(number(data, 22, 4, True))))
    found = (
        F.when(kind == "png", F.when(F.hex(F.substring(data, 13, 4)) == "49484452", _size(number(data, 16, 4), number(data, 20, 4))))
        .when(kind == "gif", _size(number(data, 6, 2, True), number(data, 8, 2, True)))
        .when(kind == "webp", _webp(data)).when(kind == "bmp", bmp).when(kind == "jpeg", _jpeg(data))
        .when((kind == "tiff") & (head == "4949"), _tiff(data, True)).when(kind == "tiff", _tiff(data, False))
    )
    return F.when(found["width"].isNotNull() & found["height"].isNotNull(), found)


def image_verdict(kind: Column, size: Column, max_side: int = MAX_SIDE, max_pixels: int = MAX_PIXELS) -> Column:
    """unknown (no kind), undecodable (no size, or a side of 0), too large, or fine."""
    w, h = size["width"], size["height"]
    return F.when(kind.isNull(), "unknown").when(size.isNull() | (w <= 0) | (h <= 0), "undecodable").when((w > max_side) | (h > max_side) | (w * h > max_pixels), "too large").otherwise("fine")


def judged_images(images, data: str = "data", **limits):
    """images with kind, size and verdict; each is a column of its own, so that headers are read once."""
    sized = images.withColumn("kind", image_kind(F.col(data))).withColumn("size", image_size(F.col(data)))
    return sized.withColumn("verdict", image_verdict(F.col("kind"), F.col("size"), **limits))
