"""Image kernels on NumPy arrays: 8-bit BGR frames (h, w, 3) and grey masks (h, w).

Masks are 0 or 255. Borders follow the usual conventions of each operation:
filters reflect without repeating the edge, morphology ignores what lies outside.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def saturated(x: np.ndarray) -> np.ndarray:
    """Rounded half to even and clipped to 8 bits."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def mask(where: np.ndarray) -> np.ndarray:
    return np.where(where, np.uint8(255), np.uint8(0))


def share(where: np.ndarray) -> float:
    """Mean of a mask of 0 and 255; 0 for an empty one."""
    return float(where.mean() * 255) if where.size else 0.0


def grey(bgr: np.ndarray) -> np.ndarray:
    """0.114 B + 0.587 G + 0.299 R, rounded, in 14-bit fixed point."""
    x = bgr.astype(np.int32)
    return ((x[..., 0] * 1868 + x[..., 1] * 9617 + x[..., 2] * 4899 + 8192) >> 14).astype(np.uint8)


def hsv(bgr: np.ndarray) -> np.ndarray:
    """Hue in half degrees (0 to 179), saturation and value 0 to 255."""
    b, g, r = (bgr[..., i].astype(np.int16) for i in range(3))
    top = np.maximum(np.maximum(b, g), r)
    spread = top - np.minimum(np.minimum(b, g), r)
    by = np.float32(30) / np.maximum(spread, 1).astype(np.float32)
    hue = np.where(top == r, (g - b) * by, np.where(top == g, 60 + (b - r) * by, 120 + (r - g) * by))
    hue = np.rint(np.where(hue < 0, hue + 180, hue))
    hue[(spread == 0) | (hue >= 180)] = 0
    saturation = np.rint(spread * (np.float32(255) / np.maximum(top, 1).astype(np.float32)))
    return np.stack([hue, saturation, top], -1).astype(np.uint8)


def within(image: np.ndarray, low, high) -> np.ndarray:
    """Boolean mask of pixels whose every channel lies in a closed range."""
    inside = (image >= np.asarray(low)) & (image <= np.asarray(high))
    return inside.all(-1) if image.ndim == 3 else inside


def within_any(image: np.ndarray, ranges) -> np.ndarray:
    """``within`` any of (low, low, low, high, high, high)."""
    out = np.zeros(image.shape[:2], bool)
    for r in ranges:
        out |= within(image, r[:3], r[3:])
    return out


def _reflected(x: np.ndarray, rows: int, columns: int, mode: str = "reflect") -> np.ndarray:
    for axis, n in ((0, rows), (1, columns)):
        width = [(0, 0), (0, 0)]
        width[axis] = (n, n)
        x = np.pad(x, width, mode if x.shape[axis] > 1 else "edge") if n else x
    return x


def sobel(x: np.ndarray, dx: int, dy: int, size: int = 3) -> np.ndarray:
    """First derivative as signed integers; size 1 has no smoothing across."""
    x = _reflected(x.astype(np.int32), 1, 1)
    smooth = np.array([1, 2, 1] if size == 3 else [0, 1, 0])
    slope = np.array([-1, 0, 1])
    down, across = (slope, smooth) if dy else (smooth, slope)
    h, w = x.shape[0] - 2, x.shape[1] - 2
    rows = sum(int(down[i]) * x[i : i + h] for i in range(3))
    return sum(int(across[j]) * rows[:, j : j + w] for j in range(3))


def edges(bgr: np.ndarray, size: int = 3) -> np.ndarray:
    """Edge strength over the colours: saturated |dx| + |dy| a channel, then a third of each, rounded at each step."""
    one = [np.minimum(np.minimum(np.abs(sobel(bgr[..., c], 1, 0, size)), 255) + np.minimum(np.abs(sobel(bgr[..., c], 0, 1, size)), 255), 255) for c in range(3)]
    b, g, r = (x.astype(np.float64) for x in one)
    return saturated(saturated(r / 3 + g / 3) + b / 3)


@lru_cache(maxsize=64)
def rectangle(width: int, height: int) -> np.ndarray:
    return np.ones((height, width), bool)


@lru_cache(maxsize=64)
def ellipse(width: int, height: int) -> np.ndarray:
    """An ellipse filling the rectangle, as rows of centred runs."""
    out = np.zeros((height, width), bool)
    r, c = height // 2, width // 2
    for i in range(height):
        dy = i - r
        if abs(dy) <= r:
            dx = int(np.rint(c * np.sqrt((r * r - dy * dy) / (r * r)))) if r else c
            out[i, max(c - dx, 0) : min(c + dx + 1, width)] = True
    return out


def _morph(x: np.ndarray, kernel: np.ndarray, grow: bool) -> np.ndarray:
    """Dilation or erosion: a row of the kernel is a run, so each needs one sliding extreme along the row."""
    kh, kw = kernel.shape
    ay, ax = kh // 2, kw // 2
    outside, best = (0, np.maximum) if grow else (255, np.minimum)
    h, w = x.shape
    if grow:
        kernel = kernel[::-1, ::-1]
        ay, ax = kh - 1 - ay, kw - 1 - ax
    padded = np.full((h + kh - 1, w + kw - 1), outside, x.dtype)
    padded[ay : ay + h, ax : ax + w] = x
    out, made = np.full((h, w), outside, x.dtype), {}
    for i in range(kh):
        at = np.flatnonzero(kernel[i])
        if not len(at):
            continue
        a, n = int(at[0]), int(at[-1]) + 1 - int(at[0])
        if n not in made:
            # The extreme of n neighbours, by doubling.
            run, done = padded, 1
            while done < n:
                step = min(done, n - done)
                run = best(run[:, : run.shape[1] - step], run[:, step:])
                done += step
            made[n] = run
        out = best(out, made[n][i : i + h, a : a + w])
    return out


def dilate(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _morph(x, kernel, True)


def erode(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return _morph(x, kernel, False)


def opened(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return dilate(erode(x, kernel), kernel)


def closed(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return erode(dilate(x, kernel), kernel)


def top_hat(x: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    return x - np.minimum(opened(x, kernel), x)


def strokes_over(x: np.ndarray, erode_by: int, dilate_by: int) -> np.ndarray:
    """Strokes of a mask thicker than a bound."""
    return x & dilate(erode(x, ellipse(erode_by, erode_by)), ellipse(dilate_by, dilate_by))


def strokes_under(x: np.ndarray, erode_by: int, dilate_by: int) -> np.ndarray:
    """Strokes of a mask thinner than a bound."""
    return x & ~dilate(erode(x, ellipse(erode_by, erode_by)), ellipse(dilate_by, dilate_by))


def near(x: np.ndarray, ref: np.ndarray, reach: int) -> np.ndarray:
    """What of a mask lies near another."""
    return x & dilate(ref, ellipse(reach, reach))


def box_mean(x: np.ndarray, width: int, height: int, mode: str = "reflect") -> np.ndarray:
    """Mean over a window around each pixel, by sums of a rectangle's corners."""
    rows, columns = height // 2, width // 2
    while rows or columns:  # reflections of small images, repeated
        r, c = min(rows, max(x.shape[0] - 1, 1)), min(columns, max(x.shape[1] - 1, 1))
        x = _reflected(x, r, c, mode)
        rows, columns = rows - r, columns - c
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    total[1:, 1:] = np.cumsum(np.cumsum(x.astype(np.float64), 0), 1)
    return (total[height:, width:] - total[:-height, width:] - total[height:, :-width] + total[:-height, :-width]) / (width * height)


@lru_cache(maxsize=16)
def gaussian(size: int) -> np.ndarray:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    g = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * sigma * sigma))
    return g / g.sum()


def gaussian_mean(x: np.ndarray, size: int) -> np.ndarray:
    g, n = gaussian(size), size // 2
    x = _reflected(x.astype(np.float64), n, n, "edge")
    h, w = x.shape[0] - 2 * n, x.shape[1] - 2 * n
    rows = sum(g[i] * x[i : i + h] for i in range(size))
    return sum(g[j] * rows[:, j : j + w] for j in range(size))


def above_local(x: np.ndarray, size: int, less: float, weighted: bool = True) -> np.ndarray:
    """Pixels brighter than their neighbourhood's mean less a constant."""
    local = gaussian_mean(x, size) if weighted else box_mean(x, size, size, "edge")
    return x > np.rint(local) - less


def components(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of 4-connected regions, and (x, y, width, height, area) of each; label 0 is the background.

    Horizontal runs are the nodes; runs of neighbouring rows that overlap are joined.
    """
    on = x > 0
    h, w = on.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = on
    step = np.diff(padded, axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    n = len(row)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = int(first[y - 1]), int(first[y])
        while i < first[y] and j < first[y + 1]:
            if begin[i] < end[j] and begin[j] < end[i]:
                a, b = root(i), root(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if end[i] <= end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(n)], np.int64)
    kept, label = np.unique(roots, return_inverse=True)
    labels = np.zeros((h, w), np.int32)
    for k in range(n):
        labels[row[k], begin[k] : end[k]] = label[k] + 1
    stats = np.zeros((len(kept) + 1, 5), np.int64)
    off = ~on
    if off.any():
        ys, xs = np.flatnonzero(off.any(1)), np.flatnonzero(off.any(0))
        stats[0] = xs[0], ys[0], xs[-1] - xs[0] + 1, ys[-1] - ys[0] + 1, off.sum()
    if n:
        area = np.bincount(label, end - begin, len(kept))
        left, right = np.full(len(kept), w), np.zeros(len(kept), np.int64)
        top, bottom = np.full(len(kept), h), np.zeros(len(kept), np.int64)
        np.minimum.at(left, label, begin)
        np.maximum.at(right, label, end)
        np.minimum.at(top, label, row)
        np.maximum.at(bottom, label, row + 1)
        stats[1:] = np.stack([left, top, right - left, bottom - top, area], 1)
    return labels, stats


def resized(x: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w = x.shape[:2]

    def places(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = places(h, height)
    x0, x1, fx = places(w, width)
    x = x.astype(np.float64)
    rows = x[y0] * (1 - fy)[:, None] + x[y1] * fy[:, None]
    return saturated(rows[:, x0] * (1 - fx) + rows[:, x1] * fx)


@lru_cache(maxsize=16)
def cosines(n: int, k: int) -> np.ndarray:
    """The first k rows of the orthonormal cosine transform of n samples."""
    base = np.cos(np.pi * (np.arange(n) + 0.5) * np.arange(k)[:, None] / n) * np.sqrt(2 / n)
    base[0] /= np.sqrt(2)
    return base


def dct_feature(x: np.ndarray, k: int = 8) -> np.ndarray:
    """The k by k lowest cosine coefficients, flattened, of length 1 (all zero for a black image)."""
    f = (cosines(x.shape[0], k) @ x.astype(np.float64) @ cosines(x.shape[1], k).T).ravel()
    size = np.linalg.norm(f)
    return f / size if size > 0 else f


def image_of(feature: np.ndarray, width: int, height: int, k: int = 8) -> np.ndarray:
    """The image that a feature describes, stretched to 0 to 255."""
    x = cosines(height, k).T @ np.asarray(feature).reshape(k, k) @ cosines(width, k)
    spread = x.max() - x.min()
    return saturated((x - x.min()) * 255 / spread) if spread > 0 else np.zeros((height, width), np.uint8)


def standardised(x: np.ndarray) -> np.ndarray:
    """Columns less their mean, by their population deviation (1 where that is 0)."""
    deviation = x.std(0)
    return (x - x.mean(0)) / np.where(deviation == 0, 1, deviation)


def clusters(points: np.ndarray, most: float) -> np.ndarray:
    """Labels of hierarchical clusters by weighted average linkage, cut at a distance."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, bool)
    while alive.sum() > 1:
        at = int(np.argmin(d))
        i, j = sorted(divmod(at, n))
        if d[i, j] > most:
            break
        d[i] = d[:, i] = (d[i] + d[j]) / 2
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def principal_components(x: np.ndarray, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the k leading eigenvectors (rows) of samples in rows."""
    mean = x.mean(0)
    _, _, v = np.linalg.svd(x - mean, full_matrices=False)
    return mean, v[:k]


def projected(x: np.ndarray, mean: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return (x - mean) @ vectors.T
