"""Image checks and hashes. What needs pixels takes them as arrays; decoding is left to Spark's image source."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsift import lexicon as lx

MOST_BYTES = 50 * 1024 * 1024


def image_format(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 16))
    out = None
    for magic, name in lx.MAGIC:
        test = head.startswith(magic.hex().upper())
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def suspicious(content: Column) -> Column:
    low = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    test = F.lit(False)
    for p in lx.SUSPICIOUS:
        test = test | F.contains(low, F.lit(p))
    return test


def _whole_png(c: bytes) -> bool:
    at, body = 8, b""
    while True:
        size, kind = int.from_bytes(c[at : at + 4], "big"), c[at + 4 : at + 8]
        data, check = c[at + 8 : at + 8 + size], c[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + data) != int.from_bytes(check, "big"):
            return False
        if kind == b"IDAT":
            body += data
        if kind == b"IEND":
            return bool(zlib.decompress(body))
        at += 12 + size


def _whole_jpg(c: bytes) -> bool:
    at = 2
    while c[at : at + 1] == b"\xff":
        if c[at + 1] == 0xDA:  # the scan, up to the end mark
            return c.rstrip(b"\0").endswith(b"\xff\xd9")
        at += 2 + int.from_bytes(c[at + 2 : at + 4], "big")
    return False


def whole(content: bytes) -> bool:
    """Whether an image file is complete, by its format's own structure: check sums, lengths and end marks."""
    kind = next((f for m, f in lx.MAGIC if content.startswith(m)), None)
    try:
        if kind == "png":
            return _whole_png(content)
        if kind == "jpg":
            return _whole_jpg(content)
        if kind == "gif":
            return len(content) > 13 and content.endswith(b";")
        if kind == "bmp":
            return 26 <= int.from_bytes(content[2:6], "little") <= len(content)
        if kind == "tiff":
            order = "little" if content[:1] == b"I" else "big"
            at = int.from_bytes(content[4:8], order)
            return 8 <= at and at + 2 + 12 * max(1, int.from_bytes(content[at : at + 2], order)) <= len(content)
        return kind == "webp" and content[8:12] == b"WEBP" and int.from_bytes(content[4:8], "little") + 8 <= len(content)
    except (zlib.error, IndexError):
        return False


@F.pandas_udf(T.BooleanType())
def intact(content: pd.Series) -> pd.Series:
    return content.map(lambda c: c is not None and whole(bytes(c)))


def validation_error(content: Column, most: int = MOST_BYTES) -> Column:
    """The first check that fails: size, format, suspicious text, integrity."""
    checked = F.when(F.length(content) > most, "too large").when(image_format(content).isNull(), "unknown format").when(suspicious(content), "suspicious content")
    return F.coalesce(checked, F.when(~intact(content), "corrupted"))


def hash_pair(content: Column, perceptual: Column) -> Column:
    """The content's md5 and the perceptual hash, empty where there is none."""
    return F.struct(F.md5(content).alias("md5"), F.coalesce(perceptual, F.lit("")).alias("phash"))


def average_hash(pixels: Column) -> tuple[Column, Column]:
    """Two 32-bit halves of the hash of 64 grey values: a bit is set where a value is above the mean."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / 64
    bits = F.array_join(F.transform(pixels, lambda p: F.when(p > mean, "1").otherwise("0")), "")
    return tuple(F.conv(F.substring(bits, at, 32), 2, 10).cast("long") for at in (1, 33))


def hash_hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 8, "0"), F.lpad(F.hex(lo), 8, "0")))


def similarity(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return 1 - (F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))) / F.lit(64.0)


def _stacks(pixels: pd.Series, width: pd.Series, height: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Images of one size at a time: their places, and an array of images by rows and columns."""
    sizes = width.astype(int) * (1 << 20) + height.astype(int)
    for size in sizes.unique():
        at = np.flatnonzero(sizes == size)
        yield at, np.stack([np.asarray(p, float) for p in pixels.iloc[at]]).reshape(len(at), size % (1 << 20), size >> 20)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("resolution", "sharpness", "exposure", "contrast", "score")]))
def quality(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Scores of grey images given as flat arrays: resolution, variance of the Laplacian, exposure and contrast."""
    out = np.zeros((len(pixels), 5))
    for at, g in _stacks(pixels, width, height):
        lap = g[:, :-2, 1:-1] + g[:, 2:, 1:-1] + g[:, 1:-1, :-2] + g[:, 1:-1, 2:] - 4 * g[:, 1:-1, 1:-1]
        r = np.full(len(at), min(1.0, g[0].size / (1920 * 1080)))
        b = np.minimum(1.0, lap.reshape(len(at), -1).var(axis=1) / 500) if lap.size else np.full(len(at), 0.5)
        flat = g.reshape(len(at), -1)
        e, c = 1 - np.abs(flat.mean(axis=1) - 128) / 128, np.minimum(1.0, flat.std(axis=1) / 255)
        out[at] = np.stack((r, b, e, c, 0.3 * r + 0.3 * b + 0.2 * e + 0.2 * c), axis=1)
    return pd.DataFrame(out, columns=["resolution", "sharpness", "exposure", "contrast", "score"])


@F.pandas_udf(T.StringType())
def image_kind(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """thermal: large and of much variance; diagram: a middling share of edges; else a photograph."""
    out = np.full(len(pixels), "photograph", object)
    for at, g in _stacks(pixels, width, height):
        edges = (np.abs(np.diff(g, axis=2)) > 50).mean(axis=(1, 2)) if g.shape[2] > 1 else np.zeros(len(at))
        out[at[(edges > 0.05) & (edges < 0.3)]] = "diagram"
        if g[0].size > 1000:
            out[at[g.reshape(len(at), -1).var(axis=1) > 1000]] = "thermal"
    return pd.Series(out)


def survivors(pairs: DataFrame, images: DataFrame, key: str = "vec_id") -> DataFrame:
    """Images that no earlier surviving one is near to, in order of key, found in rounds on the pair graph.

    An image whose earlier neighbours are all dropped survives; one with a surviving neighbour is dropped.
    """
    from docsift.session import stash

    undecided = stash(images.select(F.col(key).alias("k")), "images")
    edges = stash(pairs.select("a", "b"), "edges")
    kept = None
    while not undecided.isEmpty():
        blocked = edges.select(F.col("b").alias("k")).distinct()
        free = stash(undecided.join(blocked, "k", "left_anti"), "free")
        kept = free if kept is None else kept.union(free)
        dropped = edges.join(free, edges["a"] == free["k"], "left_semi").select(F.col("b").alias("k")).distinct()
        gone = stash(free.union(dropped).distinct(), "gone")
        undecided = stash(undecided.join(gone, "k", "left_anti"), "images")
        edges = stash(edges.join(gone, edges["b"] == gone["k"], "left_anti").join(gone, F.col("a") == gone["k"], "left_anti"), "edges")
    return (kept if kept is not None else undecided).select(F.col("k").alias(key))
