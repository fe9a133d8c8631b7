import struct

import pytest

from bookloom.functions import images as I


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x02\0\0\0"


def gif(w, h):
    return b"GIF89a" + struct.pack("<HH", w, h) + b"\0\0\0"


def jpeg(w, h, segments=(), sof=0xC0, fill=0):
    out = b"\xff\xd8"
    for n in segments:
        out += b"\xff\xe1" + struct.pack(">H", n + 2) + b"\xff\xc0" * (n // 2) + b"x" * (n % 2)  # frames within are none
    return out + b"\xff" * fill + bytes([0xFF, sof]) + struct.pack(">HBHHB", 8, 8, h, w, 3) + b"\xff\xda"


def webp(kind, w, h):
    if kind == "VP8 ":
        body = b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", w, h)
    elif kind == "VP8L":
        body = b"\x2f" + struct.pack("<I", (w - 1) | (h - 1) << 14)
    else:
        body = b"\0\0\0\0" + struct.pack("<I", w - 1)[:3] + struct.pack("<I", h - 1)[:3]
    return b"RIFF\0\0\0\0WEBP" + kind.encode() + struct.pack("<I", len(body)) + body


def bmp(w, h, core=False):
    return b"BM" + b"\0" * 12 + (struct.pack("<IHH", 12, w, h) if core else struct.pack("<Iii", 40, w, h))


def tiff(w, h, little=True, wide=4):
    e = "<" if little else ">"
    entry = lambda tag, v: struct.pack(e + "HHI", tag, 4, 1) + struct.pack(e + "I", v) if wide == 4 else struct.pack(e + "HHIHH", tag, 3, 1, v, 0)
    return (b"II*\0" if little else b"MM\0*") + struct.pack(e + "IH", 8, 3) + struct.pack(e + "HHII", 254, 4, 1, 0) + entry(256, w) + entry(257, h)


CASES = [
    (png(640, 480), "png", 640, 480, "fine"), (png(4096, 1024), "png", 4096, 1024, "fine"), (png(4097, 1), "png", 4097, 1, "too large"), (png(3000, 3000), "png", 3000, 3000, "too large"),
    (png(0, 5), "png", 0, 5, "undecodable"), (png(5, 5)[:20], "png", None, None, "undecodable"), (png(2**32 - 1, 1), "png", 2**32 - 1, 1, "too large"), (png(5, 5).replace(b"IHDR", b"IDAT"), "png", None, None, "undecodable"),
    (gif(20, 30), "gif", 20, 30, "fine"), (gif(65535, 30)[:8], "gif", None, None, "undecodable"), (b"GIF88a1234", None, None, None, "unknown"),
    (jpeg(100, 50), "jpeg", 100, 50, "fine"), (jpeg(100, 50, [10, 65533, 0, 7]), "jpeg", 100, 50, "fine"), (jpeg(100, 50, [3], 0xC2, 5), "jpeg", 100, 50, "fine"), (jpeg(5000, 50, [1] * 200), "jpeg", 5000, 50, "too large"),
    (jpeg(100, 50, [1] * 300), "jpeg", None, None, "undecodable"), (jpeg(100, 50, sof=0xC4), "jpeg", None, None, "undecodable"), (jpeg(100, 50)[:9], "jpeg", None, None, "undecodable"), (b"\xff\xd8\xff\xe0\0\1", "jpeg", None, None, "undecodable"),
    (b"\xff\xd8\xff\xd9" + jpeg(1, 1), "jpeg", None, None, "undecodable"), (b"\xff\xd8\xff\xe0\0\4ab\0\0", "jpeg", None, None, "undecodable"), (b"\xff\xd8\xff", "jpeg", None, None, "undecodable"),
    (webp("VP8 ", 321, 123), "webp", 321, 123, "fine"), (webp("VP8L", 16384, 2), "webp", 16384, 2, "too large"), (webp("VP8L", 77, 8000), "webp", 77, 8000, "too large"), (webp("VP8X", 70000, 1), "webp", 70000, 1, "too large"), (webp("VP8 ", 9, 9)[:29], "webp", None, None, "undecodable"), (webp("ALPH", 9, 9), "webp", None, None, "undecodable"),
    (bmp(11, -12), "bmp", 11, 12, "fine"), (bmp(7, 8, True), "bmp", 7, 8, "fine"), (b"BM", "bmp", None, None, "undecodable"), (tiff(31, 32), "tiff", 31, 32, "fine"), (tiff(31, 32, False), "tiff", 31, 32, "fine"), (tiff(300, 5, False, 2), "tiff", 300, 5, "fine"),
    (tiff(9, 9)[:30], "tiff", None, None, "undecodable"), (b"II*\0\xff\xff\xff\xff", "tiff", None, None, "undecodable"), (b"", None, None, None, "unknown"), (None, None, None, None, "unknown"), (b"<svg/>", None, None, None, "unknown"),
]


def test_sizes_and_verdicts(spark):
    df = spark.createDataFrame([(i, c[0], "k") for i, c in enumerate(CASES)], "id int, data binary, name string")
    got = {r.id: (r.kind, r["size"] and r["size"].width, r["size"] and r["size"].height, r.verdict) for r in I.judged_images(df).collect()}
    for i, c in enumerate(CASES):
        assert got[i] == tuple(c[1:]), (i, c)


def test_other_limits(spark):
    df = spark.createDataFrame([(png(10, 10),), (png(11, 2),)], "data binary")
    assert sorted(r.verdict for r in I.judged_images(df, max_side=10, max_pixels=100).collect()) == ["fine", "too large"]


@pytest.mark.parametrize("cut", [0, 1, 5, 12])
def test_no_header_fails_the_job(spark, cut):
    rows = [(c[0][:cut + k],) for c in CASES if c[0] for k in range(0, len(c[0]), 7) if k < 80]
    assert set(r.verdict for r in I.judged_images(spark.createDataFrame(rows, "data binary")).collect()) <= {"unknown", "undecodable", "too large", "fine"}
