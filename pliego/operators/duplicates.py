"""Repeated pages: a fingerprint of each page's words, compared with the last pages of its document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import library

WIDTH, HEIGHT, SHIFT = 72, 96, 3
LEAST_ENERGY, SAME, SHAPE = 4.0, 0.55, 0.12
SCHEMA = "v array<float>, energy double, aspect double"


def rgba(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 4)


def luma(img: np.ndarray) -> np.ndarray:
    return img[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def cell_means(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Block means on a grid; a cell without pixels has 0."""
    rows, columns = (np.minimum(n - 1, np.arange(g.shape[k]) * n // g.shape[k]) for k, n in ((0, height), (1, width)))
    at = (rows[:, None] * width + columns[None, :]).ravel()
    n = np.bincount(at, minlength=height * width)
    return (np.bincount(at, g.ravel(), height * width) / np.maximum(n, 1)).reshape(height, width)


def shrinking_mean(g: np.ndarray, r: int, axis: int) -> np.ndarray:
    """Sliding mean over ±r, over what there is at the borders."""
    n = g.shape[axis]
    sums = np.cumsum(np.insert(g, 0, 0, axis=axis), axis=axis)
    low, high = np.maximum(np.arange(n) - r, 0), np.minimum(np.arange(n) + r + 1, n)
    shape = [1] * g.ndim
    shape[axis] = n
    return (sums.take(high, axis) - sums.take(low, axis)) / (high - low).reshape(shape)


def clamped_mean(v: np.ndarray, r: int) -> np.ndarray:
    """Sliding mean over ±r with the border values repeated."""
    sums = np.cumsum(np.r_[0.0, np.pad(np.asarray(v, float), r, mode="edge")])
    return (sums[2 * r + 1 :] - sums[: -2 * r - 1]) / (2 * r + 1)


def fingerprint(img: np.ndarray) -> dict:
    """What the words of a page draw: its small grey picture without what is even along rows, zero at the rim, centred, clipped."""
    small = cell_means(luma(img), HEIGHT, WIDTH)
    v = small - shrinking_mean(small, 4, 1)
    bx, by = round(WIDTH * 0.06), round(HEIGHT * 0.05)
    inside = np.zeros_like(v)
    inside[by : HEIGHT - by, bx : WIDTH - bx] = v[by : HEIGHT - by, bx : WIDTH - bx]
    v = inside - inside.mean()
    energy = float(np.sqrt((v * v).mean()))
    return {"v": np.clip(v, -2 * energy, 2 * energy).astype(np.float32).ravel(), "energy": energy, "aspect": img.shape[1] / img.shape[0]}


def similarity(a: dict, b: dict) -> float:
    """The best correlation over small shifts; 0 for near-empty pages or other shapes."""
    if abs(a["aspect"] - b["aspect"]) / max(a["aspect"], b["aspect"]) > SHAPE or min(a["energy"], b["energy"]) < LEAST_ENERGY:
        return 0.0
    p, q = (np.asarray(x["v"], np.float64).reshape(HEIGHT, WIDTH) for x in (a, b))
    # All shifts at once: views of q, of its squares and of where it is, each moved by up to SHIFT rows and columns.
    moved = lambda v: sliding_window_view(np.pad(v, SHIFT), (HEIGHT, WIDTH))
    both = np.einsum("ij,abij->ab", p, moved(q))
    weight = np.einsum("ij,abij->ab", p * p, moved(np.ones_like(q))) * moved(q * q).sum(axis=(2, 3))
    return float((both / np.sqrt(np.where(weight > 0, weight, 1.0))).max())


def fingerprint_alike(a: dict, b: dict) -> bool:
    return similarity(a, b) >= SAME


def fingerprints():
    """A function from image structs (width, height, data: RGBA) to fingerprints."""

    def of(images: pd.DataFrame) -> pd.DataFrame:
        made = [fingerprint(rgba(d, w, h)) for w, h, d in zip(images["width"], images["height"], images["data"], strict=True)]
        return pd.DataFrame({"v": [m["v"].tolist() for m in made], "energy": [m["energy"] for m in made], "aspect": [m["aspect"] for m in made]})

    return F.pandas_udf(of, SCHEMA)


def similarities():
    def of(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        # A function in Python sees every row, also those that a condition around it leaves out.
        return pd.Series([similarity(x, y) if x["v"] is not None and y["v"] is not None else 0.0 for x, y in zip(a.to_dict("records"), b.to_dict("records"), strict=True)], dtype="float64")

    return F.pandas_udf(of, "double")


def repeated_pages(pages: DataFrame, most: int = 5) -> DataFrame:
    """pages (doc_id, pos, id, papelera, modo, no_repetida, mark: fingerprint): (id, twin), the nearest earlier page that it repeats.

    Shape and energy are compared before the Python function is; pages that aren't comparable take up places.
    """
    marks = pages.withColumn("mark", F.when(library.comparable(pages), F.col("mark")))

    def alike(a, b):
        cheap = (F.abs(a["aspect"] - b["aspect"]) / F.greatest(a["aspect"], b["aspect"]) <= SHAPE) & (a["energy"] >= LEAST_ENERGY) & (b["energy"] >= LEAST_ENERGY)
        return F.when(cheap, similarities()(a, b) >= SAME).otherwise(False)

    return library.nearest_previous(marks, "doc_id", "pos", "id", "mark", alike, most)
