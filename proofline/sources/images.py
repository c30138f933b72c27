"""Uploaded images: the binary file source, what their headers say, and quality statistics on decoded pixels.

A file's format and size are read from its first bytes by binary expressions, so that an image too large to decode is an error row before anything decodes it.
Statistics are taken by NumPy in Arrow batches, of all images of one shape at once. Spark's image source decodes PNG, JPEG, BMP and GIF on the JVM; perspective correction, deskewing and text recognition need
libraries that are not installed here and stay an interface: a decoder is any callable from image bytes to pixels, a reader one from image bytes to blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from proofline.functions import text as T

KINDS = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff", "heic", "heif")
#: Their extensions in either case.
PATTERN = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in kind) for kind in KINDS) + "}"
# ---- Fixed values: gates of image quality ----
ANALYSIS_SIDE, MOST_PIXELS = 1000, 80_000_000
BLUR, CONTRAST, SPREAD, GLARE_FROM, GLARE = 80.0, 80.0, 40.0, 250, (0.02, 0.45)
TARGET_SIDE, MOST_SIDE, MOST_UPSCALE = 736, 1400, 2.0
BLOCKS = "label_id long, position int, text string, bbox array<struct<x:double,y:double>>, confidence double, width double, height double"
PIXELS = "path string, height int, width int, nChannels int, data binary, error string"
#: Segments of a JPEG file before its frame header that are looked at; each holds up to 64 KB. A file with more of them is taken for undecodable.
SEGMENTS = 256
NO_IMAGE, UNDECODABLE, TOO_LARGE = "image_bytes must contain an encoded image", "image_bytes could not be decoded", "image_bytes describes an image too large to decode"


def uploads(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """filename, order (the path, by which files stand in a folder), length, content of every accepted file; content is only read if it is used."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("order"), "path", "length", "content")


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """path, height, width, nChannels, data (BGR rows); undecodable files have height -1."""
    return spark.read.format("image").option("dropInvalid", False).load(folder).select(F.col("image.origin").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


# ---- headers ----


def _number(data: Column, at: Column | int, length: int, little: bool = False) -> Column:
    """The unsigned number in `length` bytes from a place (from 0)."""
    at = at if isinstance(at, Column) else F.lit(at)
    byte = lambda i: F.conv(F.hex(F.substring(data, at + i + 1, F.lit(1))), 16, 10).cast("long")
    places = range(length) if little else range(length - 1, -1, -1)
    return sum((byte(i) * 256**k for k, i in enumerate(places)), F.lit(0).cast("long"))


def _is(data: Column, at: int, magic: bytes) -> Column:
    return F.substring(data, F.lit(at + 1), F.lit(len(magic))) == F.lit(magic)


def _size(width: Column, height: Column) -> Column:
    return F.struct(width.cast("long").alias("width"), height.cast("long").alias("height"))


def _jpeg(data: Column) -> Column:
    """Walks from segment to segment up to the first frame header. Fill bytes before a marker count as segments of their own."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))

    def step(state: Column, _: Column) -> Column:
        marker = _number(data, state["at"] + 1, 1)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8, 0xCC)
        alone = marker.between(0xD0, 0xD7) | (marker == 0x01)
        further = F.when(marker == 0xFF, state["at"] + 1).when(alone, state["at"] + 2).otherwise(state["at"] + 2 + _number(data, state["at"] + 2, 2))
        found = F.struct(none.alias("at"), _number(data, state["at"] + 7, 2).alias("width"), _number(data, state["at"] + 5, 2).alias("height"))
        ended = (_number(data, state["at"], 1) != 0xFF) | marker.isin(0xD9, 0xDA) | (state["at"] + 4 > F.octet_length(data))
        moved = F.struct(further.alias("at"), none.alias("width"), none.alias("height"))
        lost = F.struct(none.alias("at"), none.alias("width"), none.alias("height"))
        return F.when(state["at"].isNull(), state).when(frame, found).when(F.coalesce(ended, F.lit(True)), lost).otherwise(moved)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), start, step)
    return T.named(walked, lambda s: _size(s["width"], s["height"]))


def _tiff(data: Column, little: bool) -> Column:
    """The first directory's entries for width and height; a short or a long number."""
    first = _number(data, 4, 4, little)

    def sized(first: Column) -> Column:
        count = _number(data, first, 2, little)
        entries = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: first + 2 + i * 12)

        def value(tag: int) -> Column:
            own = F.filter(entries, lambda at: _number(data, at, 2, little) == tag)
            return T.named(F.get(own, F.lit(0)), lambda at: F.when(_number(data, at + 2, 2, little) == 3, _number(data, at + 8, 2, little)).otherwise(_number(data, at + 8, 4, little)))

        return _size(value(256), value(257))

    return T.named(first, sized)


def _webp(data: Column) -> Column:
    bits = _number(data, 21, 4, True)
    return (
        F.when(_is(data, 12, b"VP8X"), _size(_number(data, 24, 3, True) + 1, _number(data, 27, 3, True) + 1))
        .when(_is(data, 12, b"VP8L"), _size(bits % 16384 + 1, F.floor(bits / 16384) % 16384 + 1))
        .when(_is(data, 12, b"VP8 "), _size(_number(data, 26, 2, True) % 16384, _number(data, 28, 2, True) % 16384))
    )


def _bmp(data: Column) -> Column:
    signed = lambda v: F.when(v >= 2**31, 2**32 - v).otherwise(v)  # noqa: E731  rows from the top down have a negative height
    new = _size(_number(data, 18, 4, True), signed(_number(data, 22, 4, True)))
    return F.when(_number(data, 14, 4, True) == 12, _size(_number(data, 18, 2, True), _number(data, 20, 2, True))).otherwise(new)


def header(data: Column) -> Column:
    """struct(format, width, height) from the bytes before any pixel; null for what is none of these formats, null sizes where the header breaks off."""
    made = lambda name, size: T.named(size, lambda x: F.struct(F.lit(name).alias("format"), x["width"].alias("width"), x["height"].alias("height")))
    return (
        F.when(_is(data, 0, b"\x89PNG\r\n\x1a\n") & _is(data, 12, b"IHDR"), made("png", _size(_number(data, 16, 4), _number(data, 20, 4))))
        .when(_is(data, 0, b"\xff\xd8\xff"), made("jpeg", _jpeg(data)))
        .when(_is(data, 0, b"GIF87a") | _is(data, 0, b"GIF89a"), made("gif", _size(_number(data, 6, 2, True), _number(data, 8, 2, True))))
        .when(_is(data, 0, b"BM"), made("bmp", _bmp(data)))
        .when(_is(data, 0, b"RIFF") & _is(data, 8, b"WEBP"), made("webp", _webp(data)))
        .when(_is(data, 0, b"II*\x00"), made("tiff", _tiff(data, True)))
        .when(_is(data, 0, b"MM\x00*"), made("tiff", _tiff(data, False)))
    )


def guarded(files: DataFrame) -> DataFrame:
    """files (content, ...) with format, width, height and error: why an image must not be decoded, or null. Only headers are looked at."""
    found = files.withColumn("_h", header(F.col("content")))
    width, height = F.col("_h.width"), F.col("_h.height")
    error = (
        F.when(F.col("content").isNull() | (F.octet_length("content") == 0), NO_IMAGE).when(width * height > MOST_PIXELS, TOO_LARGE)
        .when(F.col("_h").isNull() | ~F.coalesce((width > 0) & (height > 0), F.lit(False)), UNDECODABLE)
    )
    return found.select(*(c for c in files.columns), F.col("_h.format").alias("format"), width.alias("width"), height.alias("height"), error.alias("error"))


def decode(files: DataFrame, decoder: Callable[[bytes], tuple[int, int, int, bytes]]) -> DataFrame:
    """path, height, width, nChannels, data, error of files (path, content) by a pluggable decoder: bytes -> (height, width, channels, BGR(A) or grey rows).

    What the size guard refuses never reaches the decoder; its failures are error rows. Alpha is laid on white.
    """

    def batches(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            rows = []
            for r in batch.itertuples():
                try:
                    made = (*opaque(*decoder(r.content)), None) if r.error is None else (None, None, None, None, r.error)
                except Exception:  # whatever a foreign decoder raises, the batch goes on
                    made = None, None, None, None, UNDECODABLE
                rows.append((r.path, *made))
            yield pd.DataFrame(rows, columns=["path", "height", "width", "nChannels", "data", "error"]).astype({"height": "Int32", "width": "Int32", "nChannels": "Int32"})

    checked = guarded(files).select("path", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")
    return checked.mapInPandas(batches, PIXELS)


def opaque(height: int, width: int, channels: int, data: bytes) -> tuple[int, int, int, bytes]:
    """Rows without alpha: BGRA and grey with alpha are laid on white."""
    if channels not in (2, 4):
        return height, width, channels, data
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.uint32)
    alpha = x[..., -1:]
    laid = (x[..., :-1] * alpha + 255 * (255 - alpha) + 127) // 255
    return height, width, channels - 1, laid.astype(np.uint8).tobytes()


# ---- statistics ----

MEASURES = ["blur_variance", "contrast_range", "glare_fraction", "illumination_spread"]
#: Bytes of images that are measured at once.
TOGETHER = 1 << 20


def grey(rows: np.ndarray) -> np.ndarray:
    """Luminance of images (n, height, width, channels) of BGR(A) or grey bytes."""
    if rows.shape[3] < 3:
        return rows[..., 0].astype(np.int64)
    # Fixed-point weights of 0.114, 0.587 and 0.299, rounded.
    return (rows[..., :3].astype(np.int64) @ np.array([1868, 9617, 4899]) + 8192) >> 14


def sharpness(pixels: np.ndarray) -> np.ndarray:
    """Variance of the Laplacian, from exact sums. What lies beyond an edge mirrors what lies inside; a single line is its own neighbour."""
    (up, down), (left, right) = ((np.minimum(abs(i - 1), n - 1), np.maximum(n - 1 - abs(n - 2 - i), 0)) for n, i in ((n, np.arange(n)) for n in pixels.shape[1:]))
    each = (pixels[:, up] + pixels[:, down] + pixels[:, :, left] + pixels[:, :, right] - 4 * pixels).reshape(len(pixels), -1)
    n, total, squares = float(each.shape[1]), each.sum(axis=1).astype(float), (each * each).sum(axis=1).astype(float)
    return (n * squares - total * total) / (n * n)


def _ranked(ordered: np.ndarray, q: float) -> np.ndarray:
    """The quantile of each row of sorted values, linear between two ranks."""
    at = (ordered.shape[1] - 1) * q
    low = int(at)
    return ordered[:, low] * (1 - (at - low)) + ordered[:, min(low + 1, ordered.shape[1] - 1)] * (at - low)


def spread(pixels: np.ndarray, parts: int = 4) -> np.ndarray:
    """Spread of the medians of 4 x 4 tiles; earlier tiles take what is left over."""
    edges = ([n // parts * k + min(k, n % parts) for k in range(parts + 1)] for n in pixels.shape[1:])
    (ys, xs), n = edges, len(pixels)
    tiles = (pixels[:, y:y2, x:x2].reshape(n, -1) for y, y2 in zip(ys, ys[1:]) for x, x2 in zip(xs, xs[1:]) if y < y2 and x < x2)
    medians = np.stack([_ranked(np.sort(t, axis=1), 0.5) for t in tiles])
    return medians.max(axis=0) - medians.min(axis=0)


def _measures(data: list[bytes], height: int, width: int, channels: int) -> np.ndarray:
    """The statistics of images of one shape, as columns of MEASURES; every step-th pixel of every step-th row is looked at."""
    step, size = max(1, -(-max(height, width) // ANALYSIS_SIDE)), height * width * channels
    rows = np.stack([np.frombuffer(d, np.uint8, size).reshape(height, width, channels)[::step, ::step] for d in data])
    pixels = grey(rows)
    ordered = np.sort(pixels.reshape(len(data), -1), axis=1)
    return np.stack([sharpness(pixels), _ranked(ordered, 0.99) - _ranked(ordered, 0.01), (ordered >= GLARE_FROM).mean(axis=1), spread(pixels)], axis=1)


@F.pandas_udf(StructType([StructField(m, DoubleType()) for m in MEASURES]))
def measured(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.DataFrame:
    """Statistics of images, those of one shape at once, in pieces of some TOGETHER bytes. Null where data is missing or breaks off."""
    out, alike = np.full((len(data), len(MEASURES)), np.nan), {}
    for i, (h, w, c, d) in enumerate(zip(height, width, channels, data, strict=True)):
        if d is not None and pd.notna(c) and 0 < h * w * c <= len(d):
            alike.setdefault((int(h), int(w), int(c)), []).append(i)
    for shape, places in alike.items():
        n = max(1, TOGETHER // math.prod(shape))
        for some in (places[k : k + n] for k in range(0, len(places), n)):
            out[some] = _measures([data.iat[i] for i in some], *shape)
    return pd.DataFrame(out, columns=MEASURES)


def quality(images: DataFrame) -> DataFrame:
    """path, width, height, statistics of decoded images (path, height, width, nChannels, data), and which corrections they call for. Images of height 0 or less are left out."""
    some = images.where("height > 0 AND width > 0")
    found = some.select("path", "width", "height", measured("height", "width", "nChannels", "data").alias("_m"))
    return found.select("path", "width", "height", *(F.col(f"_m.{m}").alias(m) for m in MEASURES)).withColumns(gates())


def gates() -> dict[str, Column]:
    side, long_side = F.least("width", "height"), F.greatest("width", "height")
    return {
        "is_blurry": F.col("blur_variance") < BLUR,
        "needs_contrast": (F.col("contrast_range") < CONTRAST) | (F.col("illumination_spread") > SPREAD) | F.col("glare_fraction").between(*GLARE),
        "has_glare": F.col("glare_fraction").between(*GLARE),
        "needs_upscale": side < TARGET_SIDE,
        "needs_downscale": long_side > MOST_SIDE,
        "scale": F.when(long_side > MOST_SIDE, MOST_SIDE / long_side).when(side < TARGET_SIDE, F.least(F.lit(MOST_UPSCALE), TARGET_SIDE / side, MOST_SIDE / long_side)).otherwise(1.0),
    }


def usable(text: Column, bbox: Column, confidence: Column) -> Column:
    """Whether a recognised block can be used: some text, four finite corners, a confidence from 0 to 1."""
    finite = F.forall(bbox, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) != float("inf")) & (F.abs(p["y"]) != float("inf")))
    return F.coalesce((F.trim(text) != "") & (F.size(bbox) == 4) & finite & confidence.between(0, 1) & ~F.isnan(confidence), F.lit(False))


def recognised(images: DataFrame, reader: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Blocks of every image (label_id, content) by a pluggable reader: bytes -> (width, height, [(text, corners, confidence)])."""

    def batches(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in source:
            rows = []
            for r in batch.itertuples():
                width, height, blocks = reader(r.content)
                rows += [(r.label_id, i, text, [{"x": float(x), "y": float(y)} for x, y in corners], float(c), float(width), float(height)) for i, (text, corners, c) in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["label_id", "position", "text", "bbox", "confidence", "width", "height"])

    found = images.select("label_id", "content").mapInPandas(batches, BLOCKS)
    return found.where(usable(F.col("text"), F.col("bbox"), F.col("confidence")))
