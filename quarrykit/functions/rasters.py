"""Numpy kernels of one raster (height x width, or x channels), reflect-101 borders, no imaging library."""

from __future__ import annotations

import math

import numpy as np

# The weights of luma.
LUMA = (0.299, 0.587, 0.114)


def gray(x: np.ndarray) -> np.ndarray:
    """Luma of an RGB raster; a single channel as it is."""
    return x.astype(float) if x.ndim == 2 else x[..., 0].astype(float) if x.shape[2] == 1 else x[..., :3].astype(float) @ np.array(LUMA)


def _area_matrix(n: int, m: int) -> np.ndarray:
    """Weights that average n cells into m by overlap."""
    edges = np.linspace(0, n, m + 1)
    cells = np.arange(n)
    over = np.clip(np.minimum(edges[1:, None], cells + 1) - np.maximum(edges[:-1, None], cells), 0, None)
    return over / over.sum(axis=1, keepdims=True)


def _line_matrix(n: int, m: int) -> np.ndarray:
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), max(0, n - 2))
    out = np.zeros((m, n))
    f = at - low
    out[np.arange(m), low] += 1 - f
    out[np.arange(m), np.minimum(low + 1, n - 1)] += f
    return out


def _cubic_matrix(n: int, m: int, a: float = -0.75) -> np.ndarray:
    at = (np.arange(m) + 0.5) * n / m - 0.5
    out = np.zeros((m, n))
    base = np.floor(at).astype(int)
    for k in range(-1, 3):
        d = np.abs(at - (base + k))
        w = np.where(d <= 1, (a + 2) * d**3 - (a + 3) * d**2 + 1, np.where(d < 2, a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a, 0))
        np.add.at(out, (np.arange(m), np.clip(base + k, 0, n - 1)), w)
    return out


def resize(x: np.ndarray, height: int, width: int, how: str = "area") -> np.ndarray:
    """``area`` (bilinear where it grows), ``bilinear`` or ``bicubic``."""
    def matrix(n: int, m: int) -> np.ndarray:
        if how == "bicubic":
            return _cubic_matrix(n, m)
        return _line_matrix(n, m) if how == "bilinear" or m > n else _area_matrix(n, m)

    x = x.astype(float)
    return np.moveaxis(np.tensordot(matrix(x.shape[1], width), np.tensordot(matrix(x.shape[0], height), x, (1, 0)), (1, 1)), 0, 1)


def dct_matrix(n: int) -> np.ndarray:
    k, j = np.arange(n)[:, None], np.arange(n)[None, :]
    c = math.sqrt(2 / n) * np.cos(math.pi * (2 * j + 1) * k / (2 * n))
    c[0] = math.sqrt(1 / n)
    return c


def phash(x: np.ndarray) -> int:
    """64 bits of the low frequencies of a 32x32 cosine transform, above the mean of all rows but the first; signed."""
    c = dct_matrix(32)
    low = (c @ gray(resize(x, 32, 32)) @ c.T)[:8, :8]
    bits = (low > low[1:].mean()).ravel()
    value = 0
    for b in bits:
        value = value << 1 | int(b)
    return value - (1 << 64) if value >> 63 else value


def _filter(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    h, w = k.shape
    p = np.pad(x, ((h // 2,) * 2, (w // 2,) * 2), mode="reflect")
    return sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(h) for j in range(w))


# Gradient kernels.
SOBEL = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=float)
PREWITT = np.array([[-1, 0, 1], [-1, 0, 1], [-1, 0, 1]], dtype=float)


def magnitude(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return np.hypot(_filter(x, kernel), _filter(x, kernel.T))


def canny(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges by Sobel gradients (sum of magnitudes), thinning across four directions, and linking of weak to strong."""
    gx, gy = _filter(x, SOBEL), _filter(x, SOBEL.T)
    m = np.abs(gx) + np.abs(gy)
    p = np.pad(m, 1)
    angle = (np.degrees(np.arctan2(gy, gx)) + 180) % 180
    sector = (np.floor((angle + 22.5) / 45) % 4).astype(int)
    ahead = np.choose(sector, [p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2]])
    behind = np.choose(sector, [p[1:-1, :-2], p[:-2, :-2], p[:-2, 1:-1], p[:-2, 2:]])
    thin = (m > behind) & (m >= ahead) & (m > low)
    edge = thin & (m > high)
    while True:
        q = np.pad(edge, 1)
        near = np.logical_or.reduce([q[i : i + edge.shape[0], j : j + edge.shape[1]] for i in range(3) for j in range(3)])
        new = thin & near
        if (new == edge).all():
            return edge
        edge = new


def edge_densities(x: np.ndarray, size: int = 128) -> dict[str, float]:
    g = gray(resize(x, size, size, "bilinear"))
    s, p = magnitude(g, SOBEL), magnitude(g, PREWITT)
    return {"canny_50_150": canny(g, 50, 150).mean(), "canny_100_200": canny(g, 100, 200).mean(), "sobel_50": (s > 50).mean(), "sobel_100": (s > 100).mean(), "prewitt_50": (p > 50).mean(), "prewitt_100": (p > 100).mean()}


def psnr(original: np.ndarray, small: np.ndarray) -> float:
    """Against the small raster enlarged by cubic interpolation."""
    mse = ((original.astype(float) - np.clip(resize(small, *original.shape[:2], "bicubic"), 0, 255)) ** 2).mean()
    return math.inf if mse == 0 else 20 * math.log10(255 / math.sqrt(mse))


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    """Structural similarity over one window, the whole raster."""
    x, y = gray(a), gray(b if a.shape[:2] == b.shape[:2] else resize(b, *a.shape[:2], "bicubic"))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    cov = ((x - x.mean()) * (y - y.mean())).mean()
    return float((2 * x.mean() * y.mean() + c1) * (2 * cov + c2) / ((x.mean() ** 2 + y.mean() ** 2 + c1) * (x.var() + y.var() + c2)))


def to_hsv(x: np.ndarray) -> np.ndarray:
    """8-bit HSV, hue in 0..179."""
    r, g, b = (x[..., i].astype(float) for i in range(3))
    v, low = x.max(axis=2).astype(float), x.min(axis=2).astype(float)
    d = np.where(v > low, v - low, 1)
    h = np.where(v == r, 60 * (g - b) / d, np.where(v == g, 120 + 60 * (b - r) / d, 240 + 60 * (r - g) / d))
    s = np.where(v > 0, (v - low) / np.where(v > 0, v, 1) * 255, 0)
    return np.round(np.stack([np.where(v > low, h % 360, 0) / 2, s, v], axis=2))


def to_lab(x: np.ndarray) -> np.ndarray:
    """8-bit CIE L*a*b* of sRGB, D65."""
    c = x.astype(float) / 255
    c = np.where(c > 0.04045, ((c + 0.055) / 1.055) ** 2.4, c / 12.92)
    # sRGB to XYZ, and the D65 white.
    xyz = c @ np.array([[0.412453, 0.212671, 0.019334], [0.357580, 0.715160, 0.119193], [0.180423, 0.072169, 0.950227]]) / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    light = np.where(xyz[..., 1] > 0.008856, 116 * f[..., 1] - 16, 903.3 * xyz[..., 1])
    return np.round(np.clip(np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], axis=2), 0, 255))


def convert(x: np.ndarray, space: str) -> np.ndarray:
    if space == "Grayscale":
        return gray(x)
    return {"RGB": lambda v: v.astype(float), "HSV": to_hsv, "LAB": to_lab}[space](x)


def rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    """Counter-clockwise about the centre, bilinear, mirrored at the border."""
    h, w = x.shape[:2]
    t = math.radians(degrees)
    yy, xx = np.mgrid[0:h, 0:w].astype(float)
    cx, cy = w / 2, h / 2
    sx = math.cos(t) * (xx - cx) - math.sin(t) * (yy - cy) + cx
    sy = math.sin(t) * (xx - cx) + math.cos(t) * (yy - cy) + cy

    def mirror(i: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return np.zeros_like(i)
        i = np.abs(i) % (2 * n - 2)
        return np.where(i >= n, 2 * n - 2 - i, i)

    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    if x.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    at = lambda dy, dx: x[mirror(y0 + dy, h), mirror(x0 + dx, w)].astype(float)
    return (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy


def flip(x: np.ndarray) -> np.ndarray:
    return x[:, ::-1]


def crop(x: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    h, w = x.shape[:2]
    ch, cw = max(1, int(h * share)), max(1, int(w * share))
    top, left = rng.integers(0, h - ch + 1), rng.integers(0, w - cw + 1)
    return resize(x[top : top + ch, left : left + cw], h, w, "bilinear")


def noise(x: np.ndarray, mean: float, deviation: float, rng: np.random.Generator) -> np.ndarray:
    """Normal noise, saturated to whole values of 0..255."""
    return np.floor(np.clip(x.astype(float) + rng.normal(mean, deviation, x.shape), 0, 255))


def adjust(x: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    return np.minimum(255, np.abs(np.round(alpha * x.astype(float) + beta)))


def softmax_epochs(x: np.ndarray, y: np.ndarray, n: int, train: np.ndarray, test: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, batch: int = 32) -> list[tuple[float, float, float, float]]:
    """Accuracy and weighted precision, recall and F1 on ``test`` after each epoch of softmax regression by stochastic gradients; the rate falls to a fifth when the loss stops falling."""
    mean, sd = x[train].mean(0), x[train].std()
    z = (x - mean) / (sd or 1.0)
    w, b, out, best = np.zeros((x.shape[1], n)), np.zeros(n), [], math.inf
    for _ in range(epochs):
        order, loss = rng.permutation(train), 0.0
        for i in range(0, len(order), batch):
            rows = order[i : i + batch]
            s = z[rows] @ w + b
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss -= np.log(p[np.arange(len(rows)), y[rows]] + 1e-12).sum()
            p[np.arange(len(rows)), y[rows]] -= 1
            w -= rate * (z[rows].T @ p + 1e-4 * w)
            b -= rate * p.sum(axis=0)
        rate, best = (rate / 5 if loss > best - 1e-3 * len(train) else rate), min(best, loss)
        guess, truth = np.argmax(z[test] @ w + b, axis=1), y[test]
        hit = np.bincount(truth[guess == truth], minlength=n).astype(float)
        held, said = np.bincount(truth, minlength=n), np.bincount(guess, minlength=n)
        precision, recall = hit / np.maximum(said, 1), hit / np.maximum(held, 1)
        f1 = np.where(precision + recall > 0, 2 * precision * recall / np.where(precision + recall > 0, precision + recall, 1), 0)
        share = held / max(1, len(truth))
        out.append((float(hit.sum() / max(1, len(truth))), float(precision @ share), float(recall @ share), float(f1 @ share)))
    return out
