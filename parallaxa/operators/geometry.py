"""Robust two-view support and triangulation, one small kernel for each pair or point batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the acceptance policy.
LEAST_SUPPORT, LEAST_INLIERS, LEAST_RATIO = 7, 16, 0.20


def estimable(distinct_a: Column, distinct_b: Column, matches: Column) -> Column:
    """Whether a pair can be verified at all, before any estimate: distinct indexes on both sides and enough rows."""
    return (distinct_a >= LEAST_SUPPORT) & (distinct_b >= LEAST_SUPPORT) & (matches >= LEAST_INLIERS)


def _normalise(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    centre = p.mean(0)
    scale = np.sqrt(2) / max(1e-12, np.sqrt(((p - centre) ** 2).sum(1)).mean())
    t = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
    return (p - centre) * scale, t


def fundamental(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Eight-point estimate with normalised coordinates and rank 2."""
    x, ta = _normalise(a)
    y, tb = _normalise(b)
    rows = np.column_stack([y[:, :1] * x, y[:, :1], y[:, 1:] * x, y[:, 1:], x, np.ones(len(x))])
    f = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    u, s, v = np.linalg.svd(f)
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ v) @ ta
    return f / max(1e-300, np.linalg.norm(f))


def sampson(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """First-order squared distance of each correspondence to the epipolar constraint."""
    ah, bh = np.column_stack([a, np.ones(len(a))]), np.column_stack([b, np.ones(len(b))])
    fa, fb = ah @ f.T, bh @ f
    return (bh * fa).sum(1) ** 2 / np.maximum(1e-300, fa[:, 0] ** 2 + fa[:, 1] ** 2 + fb[:, 0] ** 2 + fb[:, 1] ** 2)


def verify_pairs(matches: DataFrame, pair: str, threshold: float = 1.5, rounds: int = 500, seed: int = 1) -> DataFrame:
    """(pair, matches, inliers, verified, model): rows (pair, ax, ay, bx, by) through a seeded consensus search.

    Pairs that `estimable` rules out, and pairs whose inliers are too few or too small a share of all rows, are not
    verified and have no model. A pair has at most a few thousand rows, so that each is one small kernel.
    """
    kind = dict(matches.dtypes)[pair]

    def estimate(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[["ax", "ay"]].to_numpy(float), pdf[["bx", "by"]].to_numpy(float)
        order = np.lexsort((b[:, 1], b[:, 0], a[:, 1], a[:, 0]))
        a, b = a[order], b[order]
        n = len(a)
        best = np.zeros(n, dtype=bool)
        if min(len(np.unique(a, axis=0)), len(np.unique(b, axis=0))) >= LEAST_SUPPORT and n >= LEAST_INLIERS:
            rng = np.random.default_rng(seed)
            tried, needed = 0, rounds
            while tried < needed:
                tried += 1
                some = rng.choice(n, 8, replace=False)
                inside = sampson(fundamental(a[some], b[some]), a, b) <= threshold**2
                if inside.sum() > best.sum():
                    best = inside
                    share = np.clip(best.mean() ** 8, 1e-9, 1 - 1e-9)
                    needed = min(rounds, int(np.ceil(np.log(1e-3) / np.log1p(-share))))
        for _ in range(3 if best.sum() >= 8 else 0):
            again = sampson(fundamental(a[best], b[best]), a, b) <= threshold**2
            if again.sum() < best.sum():
                break
            best = again
        ok = bool(best.sum() >= LEAST_INLIERS and best.sum() >= LEAST_RATIO * n)
        model = None
        if ok:
            f = fundamental(a[best], b[best]).ravel()
            model = (f * np.sign(f[np.argmax(np.abs(f))]) + 0.0).tolist()
        return pd.DataFrame({pair: [pdf[pair].iloc[0]], "matches": [n], "inliers": [int(best.sum())], "verified": [ok], "model": [model]})

    return matches.groupBy(pair).applyInPandas(estimate, f"{pair} {kind}, matches bigint, inliers bigint, verified boolean, model array<double>")


def triangulate(views: DataFrame, p1: np.ndarray, p2: np.ndarray, key: str) -> DataFrame:
    """(key, x, y, z, depth_ok) from rows (key, u1, v1, u2, v2) of two cameras: linear solutions, a batch at a time."""
    kind = dict(views.dtypes)[key]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.stack(
                [
                    pdf["u1"].to_numpy()[:, None] * p1[2] - p1[0], pdf["v1"].to_numpy()[:, None] * p1[2] - p1[1],
                    pdf["u2"].to_numpy()[:, None] * p2[2] - p2[0], pdf["v2"].to_numpy()[:, None] * p2[2] - p2[1],
                ], axis=1,
            )
            h = np.linalg.svd(rows)[2][:, -1, :]
            x = h[:, :3] / h[:, 3:]
            whole = np.column_stack([x, np.ones(len(x))])
            ahead = (whole @ p1[2] > 1e-9) & (whole @ p2[2] > 1e-9)
            yield pd.DataFrame({key: pdf[key], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "depth_ok": ahead})

    return views.mapInPandas(solve, f"{key} {kind}, x double, y double, z double, depth_ok boolean")
