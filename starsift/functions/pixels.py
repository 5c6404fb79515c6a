"""Pixel maps: exact integer ones as array expressions, and the augmentation job on bytes.

Images are RGB bytes by rows. Views are drawn by a generator seeded with seed, filename and view, so
a retried task makes the same pixels.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def invert(v: Column) -> Column:
    return F.transform(v, lambda x: 255 - x)


def posterize(v: Column, bits: int) -> Column:
    """The highest ``bits`` bits of each value."""
    step = 1 << (8 - bits)
    return F.transform(v, lambda x: x - x % step)


def solarize(v: Column, threshold: int) -> Column:
    return F.transform(v, lambda x: F.when(x < threshold, x).otherwise(255 - x))


def autocontrast(v: Column) -> Column:
    """The range of a channel stretched to 0..255; a constant one stays."""
    low, high = F.array_min(v), F.array_max(v)
    return F.when(high > low, F.transform(v, lambda x: F.floor((x - low) * 255.0 / (high - low)).cast("int"))).otherwise(v)


def hflip(v: Column, width: int) -> Column:
    """Each row of one channel from right to left."""
    return F.transform(v, lambda x, i: F.element_at(v, (i - i % width + (width - 1 - i % width) + 1).cast("int")))


def translate(v: Column, width: int, dx: int) -> Column:
    """One channel moved dx to the right (left where negative), zeros behind."""
    place = lambda i: i % width - dx
    return F.transform(v, lambda x, i: F.when((place(i) >= 0) & (place(i) < width), F.try_element_at(v, (i - dx + 1).cast("int"))).otherwise(F.lit(0)))


def channel_filter(v: Column, shown: tuple[bool, bool, bool]) -> Column:
    """RGB triples with channels that aren't shown at 0."""
    keep = F.array(*(F.lit(int(s)) for s in shown))
    return F.transform(v, lambda x, i: x * F.element_at(keep, (i % 3 + 1).cast("int")))


def block_mean(v: Column, width: int, factor: int) -> Column:
    """One channel with blocks of factor * factor pixels as their mean, halves up."""
    out = width // factor
    cells = F.sequence(F.lit(0), F.lit(out * out - 1))
    offsets = F.array(*(F.lit(r * width + c) for r in range(factor) for c in range(factor)))
    first = lambda k: (k - k % out) / out * factor * width + (k % out) * factor
    return F.transform(cells, lambda k: F.floor(F.aggregate(offsets, F.lit(0.0), lambda s, o: s + F.element_at(v, (first(k) + o + 1).cast("int"))) / (factor * factor) + 0.5).cast("int"))


def _blend(a: np.ndarray, b: np.ndarray, v: float) -> np.ndarray:
    return np.clip(a + (b.astype(np.float64) - a) * v + 0.5, 0, 255).astype(np.uint8)


def _luma(x: np.ndarray) -> np.ndarray:
    return x @ np.array([0.299, 0.587, 0.114])


def _smooth(x: np.ndarray) -> np.ndarray:
    """A 3 x 3 mean with the centre weighing 5; the rim stays."""
    y = x.astype(np.float64)
    out = y.copy()
    parts = sum(y[1 + i : y.shape[0] - 1 + i, 1 + j : y.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1))
    out[1:-1, 1:-1] = (parts + 4 * y[1:-1, 1:-1]) / 13
    return out


def _affine(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Nearest source pixel of each pixel by the 2 x 3 matrix ``m`` of (column, row, 1); zeros outside."""
    h, w, _ = x.shape
    rows, cols = np.mgrid[0:h, 0:w]
    source = m @ np.stack([cols.ravel() + 0.5, rows.ravel() + 0.5, np.ones(h * w)])
    c, r = np.floor(source[0]).astype(int), np.floor(source[1]).astype(int)
    good = (c >= 0) & (c < w) & (r >= 0) & (r < h)
    out = np.zeros_like(x).reshape(h * w, 3)
    out[good] = x[r[good], c[good]]
    return out.reshape(h, w, 3)


def _equalize(x: np.ndarray) -> np.ndarray:
    out = x.copy()
    for k in range(3):
        counts = np.bincount(x[:, :, k].ravel(), minlength=256)
        filled = counts[counts > 0]
        step = (filled.sum() - filled[-1]) // 255
        if len(filled) > 1 and step:
            table = np.minimum((step // 2 + np.concatenate([[0], np.cumsum(counts)[:-1]])) // step, 255)
            out[:, :, k] = table[x[:, :, k]]
    return out


def _stretch(x: np.ndarray) -> np.ndarray:
    low, high = x.min(axis=(0, 1)).astype(np.float64), x.max(axis=(0, 1)).astype(np.float64)
    span = np.where(high > low, high - low, 255)
    return np.where(high > low, np.floor((x - low) * 255 / span), x).astype(np.uint8)


def _turn(x: np.ndarray, degrees: float) -> np.ndarray:
    a = np.deg2rad(degrees)
    h, w = x.shape[:2]
    cos, sin, cx, cy = np.cos(a), np.sin(a), w / 2, h / 2
    return _affine(x, np.array([[cos, sin, cx - cos * cx - sin * cy], [-sin, cos, cy + sin * cx - cos * cy]]))


def cutout(x: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """A box of ``share`` of the width about a uniform point, cut at the rim; its gray is a fixed value."""
    h, w = x.shape[:2]
    half = share * w / 2
    cx, cy = rng.uniform(0, w), rng.uniform(0, h)
    out = x.copy()
    out[int(max(0, cy - half)) : int(min(h, cy + half)), int(max(0, cx - half)) : int(min(w, cx + half))] = (125, 123, 114)
    return out


#: The strong view's operations with the range of their magnitude. Fixed values.
STRONG = {
    "autocontrast": (0, 1), "brightness": (0.05, 0.95), "color": (0.05, 0.95), "contrast": (0.05, 0.95), "equalize": (0, 1), "identity": (0, 1), "posterize": (4, 8),
    "rotate": (-30, 30), "sharpness": (0.05, 0.95), "shear_x": (-0.3, 0.3), "shear_y": (-0.3, 0.3), "solarize": (0, 256), "translate_x": (-0.3, 0.3), "translate_y": (-0.3, 0.3),
}


def apply(x: np.ndarray, name: str, v: float) -> np.ndarray:
    """One operation on (height, width, 3) bytes with magnitude ``v``."""
    h, w = x.shape[:2]
    if name == "autocontrast":
        return _stretch(x)
    if name == "brightness":
        return _blend(np.zeros_like(x, dtype=np.float64), x, v)
    if name == "color":
        return _blend(np.repeat(_luma(x)[:, :, None], 3, axis=2), x, v)
    if name == "contrast":
        return _blend(np.full(x.shape, np.floor(np.round(_luma(x).mean(), 6) + 0.5)), x, v)
    if name == "equalize":
        return _equalize(x)
    if name == "invert":
        return 255 - x
    if name == "posterize":
        return x & np.uint8((0xFF << (8 - max(1, int(v)))) & 0xFF)
    if name == "rotate":
        return _turn(x, v)
    if name == "sharpness":
        return _blend(_smooth(x), x, v)
    if name == "shear_x":
        return _affine(x, np.array([[1, v, 0], [0, 1, 0]]))
    if name == "shear_y":
        return _affine(x, np.array([[1, 0, 0], [v, 1, 0]]))
    if name == "solarize":
        return np.where(x < v, x, 255 - x).astype(np.uint8)
    if name == "translate_x":
        return _affine(x, np.array([[1, 0, v * w], [0, 1, 0]]))
    if name == "translate_y":
        return _affine(x, np.array([[1, 0, 0], [0, 1, v * h]]))
    if name == "identity":
        return x
    raise ValueError(f"unknown operation {name}")


def weak_view(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A flip for half of all draws, and a vertical move of up to an eighth."""
    if rng.random() < 0.5:
        x = x[:, ::-1]
    return _affine(np.ascontiguousarray(x), np.array([[1, 0, 0], [0, 1, np.round(rng.uniform(-0.125, 0.125) * x.shape[0])]]))


def strong_view(x: np.ndarray, rng: np.random.Generator, n: int = 3) -> np.ndarray:
    """n operations drawn with replacement, a cutout of up to half the width, then a weak view."""
    names = list(STRONG)
    for k in rng.integers(0, len(names), n):
        low, high = STRONG[names[k]]
        x = apply(x, names[k], float(rng.uniform(low, high)))
    return weak_view(cutout(x, float(rng.uniform(0, 0.5)), rng), rng)


def augment_views(images: DataFrame, size: int, seed: int = 42, views: tuple[str, ...] = ("weak", "strong")) -> DataFrame:
    """(filename, view, pixels) for each image of (filename, pixels) and view."""
    make = {"weak": weak_view, "strong": strong_view}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["filename"], batch["pixels"], strict=True):
                x = np.frombuffer(bytes(data), np.uint8).reshape(size, size, 3)
                for view in views:
                    rng = np.random.default_rng(zlib.crc32(f"{seed}|{name}|{view}".encode()))
                    rows.append((name, view, np.ascontiguousarray(make[view](x, rng)).tobytes()))
            yield pd.DataFrame(rows, columns=["filename", "view", "pixels"])

    return images.select("filename", "pixels").mapInPandas(run, "filename string, view string, pixels binary")


def adjust_images(images: DataFrame, size: int, inverted: bool = False, brightness: float = 1.0, contrast: float = 1.0, unsharp: bool = False, shown: tuple[bool, bool, bool] = (True, True, True)) -> DataFrame:
    """(filename, pixels) after inversion, brightness, contrast, unsharp mask and channel filter, in this order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data in batch["pixels"]:
                x = np.frombuffer(bytes(data), np.uint8).reshape(size, size, 3)
                if inverted:
                    x = 255 - x
                if brightness != 1.0:
                    x = apply(x, "brightness", brightness)
                if contrast != 1.0:
                    x = apply(x, "contrast", contrast)
                if unsharp:
                    x = _blend(_smooth(x), x, 2.5)
                out.append((x * np.array(shown, np.uint8)).astype(np.uint8).tobytes())
            yield pd.DataFrame({"filename": batch["filename"], "pixels": out})

    return images.select("filename", "pixels").mapInPandas(run, "filename string, pixels binary")
