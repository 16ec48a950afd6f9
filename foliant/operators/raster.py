"""Page images as numpy arrays, one Arrow batch at a time. Images come from Spark's `image` source."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INK = 245


def gray(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Luma of BGR(A) bytes, rows from the top."""
    a = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return a[:, :, 0] if channels == 1 else (a[:, :, :3] @ np.array([114, 587, 299]) / 1000 + 0.5).astype(np.uint8)


def ink_box(page: np.ndarray, threshold: int = INK) -> tuple[int, int, int, int] | None:
    """The box around everything darker than the threshold."""
    ys, xs = np.flatnonzero((page < threshold).any(axis=1)), np.flatnonzero((page < threshold).any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def trim_box(page: np.ndarray, threshold: int = 249, pad: int = 28, least: float = 0.78) -> tuple[int, int, int, int]:
    """The padded ink box, unless trimming would leave less than `least` of a side."""
    h, w = page.shape
    found = ink_box(page, threshold)
    if found is None:
        return 0, 0, w, h
    x0, y0, x1, y1 = max(0, found[0] - pad), max(0, found[1] - pad), min(w, found[2] + pad), min(h, found[3] + pad)
    return (x0, y0, x1, y1) if x1 - x0 >= w * least and y1 - y0 >= h * least else (0, 0, w, h)


def row_density(page: np.ndarray, threshold: int = INK) -> np.ndarray:
    return (page < threshold).sum(axis=1) / max(1, page.shape[1])


def bands(density: np.ndarray, threshold: float = 0.01, least: int = 10, gap: int = 8) -> list[tuple[int, int]]:
    """Runs of dense rows, at least so high, joined across small gaps."""
    edge = np.diff(np.concatenate(([False], density > threshold, [False])).astype(np.int8))
    out: list[tuple[int, int]] = []
    for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if hi - lo < least:
            continue
        if out and lo - out[-1][1] <= gap:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def pages_of(image: pd.DataFrame):  # noqa: ANN201
    """The grey page of each image, None for one that can't be read."""
    for h, w, c, d in zip(image["height"], image["width"], image["nChannels"], image["data"], strict=True):
        yield None if d is None or h <= 0 else gray(h, w, c, d)


def _boxes(image: pd.DataFrame, find: Callable[[np.ndarray], tuple[int, int, int, int] | None]) -> pd.DataFrame:
    found = [None if p is None else find(p) for p in pages_of(image)]
    return pd.DataFrame([f or (None,) * 4 for f in found], columns=["x0", "y0", "x1", "y1"]).astype("Int32")


def content_box(image: Column) -> Column:
    """Where the page has ink: the one candidate figure of a page without layout boxes."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        return _boxes(image, ink_box)

    return F.pandas_udf(run, "struct<x0:int,y0:int,x1:int,y1:int>")(image)


def trimmed(image: Column) -> Column:
    """The part of the page that trim_box() keeps."""

    def run(image: pd.DataFrame) -> pd.DataFrame:
        return _boxes(image, trim_box)

    return F.pandas_udf(run, "struct<x0:int,y0:int,x1:int,y1:int>")(image)


def density(image: Column) -> Column:
    """The share of ink in each row of pixels."""

    def run(image: pd.DataFrame) -> pd.Series:
        return pd.Series([None if p is None else row_density(p).tolist() for p in pages_of(image)])

    return F.pandas_udf(run, "array<double>")(image)
