"""Picture kernels for Arrow batches: resampling, blurs and structural similarity on 2-D arrays."""

from __future__ import annotations

import numpy as np

#: Weights of the five scales, and the stabilisers of the two ratios.
SCALE_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def area_weights(n: int, m: int) -> np.ndarray:
    """m x n matrix that averages n samples into m boxes of equal width."""
    edges = np.arange(m + 1) * n / m
    low, high = np.arange(n), np.arange(1, n + 1)
    part = np.clip(np.minimum(high, edges[1:, None]) - np.maximum(low, edges[:-1, None]), 0, None)
    return part / part.sum(axis=1, keepdims=True)


def linear_weights(n: int, m: int) -> np.ndarray:
    """m x n matrix of linear interpolation at sample centres, held at the ends."""
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(at).astype(int)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (at - low))
    np.add.at(out, (np.arange(m), np.minimum(low + 1, n - 1)), at - low)
    return out


def resize(plane: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box averages when both sides shrink, linear interpolation otherwise, a copy at the same size."""
    if plane.shape == (h, w):
        return plane.copy()
    weights = area_weights if h <= plane.shape[0] and w <= plane.shape[1] else linear_weights
    return weights(plane.shape[0], h) @ plane @ weights(plane.shape[1], w).T


def blur(plane: np.ndarray, taps: int = 11, sigma: float = 1.5) -> np.ndarray:
    """Gaussian blur where the whole kernel lies inside."""
    k = np.exp(-((np.arange(taps) - taps // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    rows = np.lib.stride_tricks.sliding_window_view(plane, taps, axis=0) @ k
    return np.lib.stride_tricks.sliding_window_view(rows, taps, axis=1) @ k


def similarity(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Mean structural similarity of two planes, and of their contrast and structure alone."""
    mx, my = blur(x), blur(y)
    vx, vy, cov = blur(x * x) - mx * mx, blur(y * y) - my * my, blur(x * y) - mx * my
    cs = (2 * cov + C2) / (vx + vy + C2)
    return float(((2 * mx * my + C1) / (mx * mx + my * my + C1) * cs).mean()), float(cs.mean())


def halve(plane: np.ndarray) -> np.ndarray:
    h, w = plane.shape[0] // 2 * 2, plane.shape[1] // 2 * 2
    p = plane[:h, :w]
    return (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4


def multi_scale(x: np.ndarray, y: np.ndarray) -> float:
    """Similarity over five scales; planes of less than 176 a side have none (nan)."""
    if min(x.shape) < 176:
        return float("nan")
    y, total = np.clip(y, 0, 255), 1.0
    for s, weight in enumerate(SCALE_WEIGHTS):
        whole, cs = similarity(x, y)
        total *= max(whole if s == len(SCALE_WEIGHTS) - 1 else cs, 1e-6) ** weight
        x, y = halve(x), halve(y)
    return total


def colour_score(luma: float, cb: float, cr: float) -> float:
    """One score of three planes: luma counts six times."""
    return (6 * luma + cb + cr) / 8


def homography(corners: np.ndarray, targets: np.ndarray) -> np.ndarray | None:
    """3 x 3 projective map of four points to four others; None if they lie in a line."""
    rows = []
    for (x, y), (u, v) in zip(corners, targets):
        rows += [[x, y, 1, 0, 0, 0, -x * u, -y * u], [0, 0, 0, x, y, 1, -x * v, -y * v]]
    a = np.array(rows, float)
    if np.linalg.matrix_rank(a) < 8:
        return None
    return np.append(np.linalg.solve(a, np.asarray(targets, float).ravel()), 1.0).reshape(3, 3)


def predict_residuals(values: np.ndarray, step: float) -> np.ndarray:
    """Levels of a plane by the median edge predictor on what a decoder knows, half rounded up."""
    out = np.zeros_like(values, dtype=float)
    levels = np.zeros(values.shape, np.int64)
    for y, x in np.ndindex(*values.shape):
        left = out[y, x - 1] if x else out[y - 1, x] if y else 128.0
        up = out[y - 1, x] if y else left
        corner = out[y - 1, x - 1] if x and y else left
        guess = min(left, up) if corner >= max(left, up) else max(left, up) if corner <= min(left, up) else left + up - corner
        levels[y, x] = np.floor((values[y, x] - guess) / step + 0.5)
        out[y, x] = np.clip(guess + levels[y, x] * step, 0, 255)
    return levels


def components(mask: np.ndarray) -> np.ndarray:
    """Number of the component of each set sample, neighbours by side or corner: its first sample's place; -1 elsewhere."""
    label = np.where(mask, np.arange(mask.size).reshape(mask.shape), mask.size)
    while True:
        wide = np.pad(label, 1, constant_values=mask.size)
        low = np.lib.stride_tricks.sliding_window_view(wide, (3, 3)).min(axis=(2, 3))
        new = np.where(mask, low, mask.size)
        if (new == label).all():
            return np.where(mask, label, -1)
        label = new
