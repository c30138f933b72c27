"""Headers, the size guard and statistics of images against NumPy and hand-made files."""

import struct
import zlib

import numpy as np
import pytest

from proofline.shipping import ship
from proofline.sources import images


def png(width, height):
    body = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body))


def jpeg(width, height, *segments):
    frame = struct.pack(">BHHB", 8, height, width, 3) + b"\x01\x11\x00" * 3
    return b"\xff\xd8" + b"".join(b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d for m, d in segments) + b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame


LITTLE_TIFF = b"II*\x00" + struct.pack("<IH", 8, 3) + struct.pack("<HHII", 254, 4, 1, 0) + struct.pack("<HHIHH", 256, 3, 1, 640, 0) + struct.pack("<HHII", 257, 4, 1, 480)
CASES = [
    (png(1400, 900), "png", 1400, 900, None), (png(9_000, 9_000), "png", 9_000, 9_000, images.TOO_LARGE), (png(8_000, 10_000), "png", 8_000, 10_000, None), (png(0, 5), "png", 0, 5, images.UNDECODABLE), (png(2**31, 2**31), "png", 2**31, 2**31, images.TOO_LARGE),
    (jpeg(640, 480), "jpeg", 640, 480, None), (jpeg(30_000, 3_000, (0xE0, b"JFIF\0"), (0xE1, jpeg(160, 120)), (0xC4, b"x" * 60_000)), "jpeg", 30_000, 3_000, images.TOO_LARGE), (b"\xff\xd8\xff\xff\xff" + jpeg(7, 9)[3:], "jpeg", 7, 9, None),
    (jpeg(5, 5)[:8], "jpeg", None, None, images.UNDECODABLE), (b"\xff\xd8\xff\xd9", "jpeg", None, None, images.UNDECODABLE), (jpeg(5, 5, *[(0xE2, b"")] * 100), "jpeg", 5, 5, None),
    (b"GIF89a" + struct.pack("<HH", 320, 200), "gif", 320, 200, None), (b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 33, -44), "bmp", 33, 44, None), (b"BM" + b"\0" * 12 + struct.pack("<IHH", 12, 33, 44), "bmp", 33, 44, None),
    (LITTLE_TIFF, "tiff", 640, 480, None), (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 199 << 14), "webp", 100, 200, None), (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 176, 144), "webp", 176, 144, None),
    (b"text", None, None, None, images.UNDECODABLE), (b"", None, None, None, images.NO_IMAGE), (None, None, None, None, images.NO_IMAGE), (b"\xff", None, None, None, images.UNDECODABLE),
]


def test_headers(spark):
    rows = images.guarded(spark.createDataFrame([(i, None if c[0] is None else bytearray(c[0])) for i, c in enumerate(CASES)], "id int, content binary")).orderBy("id").collect()
    assert [(r["format"], r["width"], r["height"], r["error"]) for r in rows] == [c[1:] for c in CASES]


def test_decoder_sees_only_what_the_guard_lets_through(spark):
    ship(spark)
    files = spark.createDataFrame([("a", bytearray(png(2, 1))), ("b", bytearray(png(9_000, 9_000))), ("c", bytearray(b"x")), ("d", bytearray(png(3, 1)))], "path string, content binary")

    def decoder(content):
        width, height = struct.unpack(">II", content[16:24])
        if width != 2:
            raise OSError("broken")
        return height, width, 4, bytes([10, 20, 30, 255, 10, 20, 30, 0])

    rows = {r["path"]: r for r in images.decode(files, decoder).collect()}
    assert (rows["a"]["nChannels"], bytes(rows["a"]["data"]), rows["a"]["error"]) == (3, bytes([10, 20, 30, 255, 255, 255]), None)
    assert [rows[p]["error"] for p in "bcd"] == [images.TOO_LARGE, images.UNDECODABLE, images.UNDECODABLE]
    assert images.quality(images.decode(files, decoder)).count() == 1


def plain(x):
    grey = x[..., 0] if x.shape[2] < 3 else (x[..., 0] * 1868 + x[..., 1] * 9617 + x[..., 2] * 4899 + 8192) >> 14
    step = max(1, -(-max(grey.shape) // 1000))
    grey = grey[::step, ::step]
    rows, columns = (np.pad(np.arange(n), 1, mode="reflect" if n > 1 else "edge") for n in grey.shape)
    p = grey[rows][:, columns].astype(float)
    laplacian = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * grey
    medians = [np.median(t) for row in np.array_split(grey, 4) for t in np.array_split(row, 4, axis=1) if t.size]
    low, high = np.percentile(grey, [1, 99])
    return laplacian.var(), high - low, (grey >= 250).mean(), np.ptp(medians)


@pytest.mark.parametrize("shape", [(16, 16, 1), (1, 1, 1), (1, 9, 3), (13, 7, 3), (5, 2, 4), (2, 1500, 1)])
def test_statistics_equal_numpy(spark, shape):
    r = np.random.default_rng(sum(shape))
    made = [r.integers(0, 256, shape), np.full(shape, 255), np.indices(shape).sum(0) % 2 * 255]
    df = spark.createDataFrame([(str(i), shape[0], shape[1], shape[2], bytearray(x.astype(np.uint8).tobytes())) for i, x in enumerate(made)] + [("no", -1, -1, -1, bytearray())], "path string, height int, width int, nChannels int, data binary")
    found = {x["path"]: x for x in images.quality(df).collect()}
    assert set(found) == {"0", "1", "2"}
    for i, x in enumerate(made):
        got = found[str(i)]
        assert (got["blur_variance"], got["contrast_range"], got["glare_fraction"], got["illumination_spread"]) == pytest.approx(plain(x))


def test_sharp_and_blank_images_are_told_apart(spark):
    sharp, blank = (np.indices((32, 32)).sum(0) % 2 * 255).astype(np.uint8), np.full((32, 32), 255, np.uint8)
    df = spark.createDataFrame([(n, 32, 32, 1, bytearray(x.tobytes())) for n, x in (("sharp", sharp), ("blank", blank))], "path string, height int, width int, nChannels int, data binary")
    found = {r["path"]: r for r in images.quality(df).collect()}
    assert not found["sharp"]["is_blurry"] and found["blank"]["is_blurry"] and found["blank"]["needs_contrast"] and not found["blank"]["has_glare"] and found["sharp"]["scale"] == 2.0


def test_images_of_several_shapes_are_measured_in_batches_and_broken_ones_are_null(spark):
    r = np.random.default_rng(4)
    made = [r.integers(0, 256, shape) for shape in [(16, 16, 1), (3, 5, 3), (16, 16, 1), (40, 20, 2)] * 3]
    rows = [(str(i), *x.shape, bytearray(x.astype(np.uint8).tobytes())) for i, x in enumerate(made)]
    df = spark.createDataFrame([*rows, ("short", 4, 4, 3, bytearray(47)), ("none", 4, 4, 1, None)], "path string, height int, width int, nChannels int, data binary")
    assert "transform(" not in images.quality(df)._jdf.queryExecution().optimizedPlan().toString()
    found = {x["path"]: x for x in images.quality(df).collect()}
    for i, x in enumerate(made):
        assert [found[str(i)][m] for m in images.MEASURES] == pytest.approx(list(plain(x)))
    assert {found[k][m] for k in ("short", "none") for m in images.MEASURES} == {None}
