"""Image kernels in numpy: colour spaces, histograms, gradients, moments, signatures, Earth Mover's Distance.

Images are arrays (height, width, 3) of bytes in BGR order, or (height, width) gray.
"""

from __future__ import annotations

import numpy as np


def decode(pixels: bytes, height: int, width: int, channels: int) -> np.ndarray:
    flat = np.frombuffer(pixels, np.uint8)
    return flat.reshape(height, width) if channels == 1 else flat.reshape(height, width, channels)[:, :, :3]


def gray(image: np.ndarray) -> np.ndarray:
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.114, 0.587, 0.299])


def to_hsv(image: np.ndarray) -> np.ndarray:
    """Hue 0..180, saturation and value 0..255."""
    b, g, r = (image[..., i].astype(np.float64) for i in range(3))
    top, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    span = top - low
    safe = np.where(span > 0, span, 1)
    hue = np.where(top == r, (g - b) / safe, np.where(top == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 60
    hue = np.where(span > 0, hue % 360, 0) / 2
    return np.stack([hue, np.where(top > 0, span / np.where(top > 0, top, 1), 0) * 255, top], axis=-1)


def to_luv(image: np.ndarray) -> np.ndarray:
    """CIE L*u*v* of linear RGB under D65."""
    rgb = image[..., ::-1].astype(np.float64) / 255
    xyz = rgb @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T
    x, y, z = xyz[..., 0], xyz[..., 1], xyz[..., 2]
    light = np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y)
    d = np.where(x + 15 * y + 3 * z > 0, x + 15 * y + 3 * z, 1)
    return np.stack([light, 13 * light * (4 * x / d - 0.19793943), 13 * light * (9 * y / d - 0.46831096)], axis=-1)


def histogram(image: np.ndarray, bins: tuple[int, ...], ranges: tuple[tuple[float, float], ...], norm: str | None = "l1") -> np.ndarray:
    """Joint histogram of the first ``len(bins)`` channels; norm is l1, l2 or None."""
    values = image.reshape(-1, image.shape[-1] if image.ndim == 3 else 1)[:, : len(bins)].astype(np.float64)
    at = [np.clip(np.floor((values[:, i] - lo) * n / (hi - lo)).astype(int), 0, n - 1) for i, (n, (lo, hi)) in enumerate(zip(bins, ranges, strict=True))]
    h = np.zeros(bins)
    np.add.at(h, tuple(at), 1.0)
    size = h.sum() if norm == "l1" else np.sqrt((h * h).sum()) if norm == "l2" else 1.0
    return h / size if size else h


def bgr_histogram(image: np.ndarray, n: int = 16) -> np.ndarray:
    return histogram(image, (n, n, n), ((0, 256),) * 3, "l2")


def hsv_histogram(image: np.ndarray) -> np.ndarray:
    return histogram(to_hsv(image), (30, 32), ((0, 180), (0, 256)), "l1")


def rgb_counts(image: np.ndarray) -> np.ndarray:
    """768 raw counts: red, green, blue."""
    return np.concatenate([np.bincount(image[..., c].ravel(), minlength=256) for c in (2, 1, 0)])


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear."""
    h, w = image.shape[:2]
    y, x = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1), np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    g = image.astype(np.float64)
    return (g[y0][:, x0] * (1 - fx) + g[y0][:, x1] * fx) * (1 - fy) + (g[y1][:, x0] * (1 - fx) + g[y1][:, x1] * fx) * fy


def hog(image: np.ndarray, height: int = 128, width: int = 64, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Histogram of oriented gradients (Dalal and Triggs 2005): unsigned, 2 x 2 cells a block, L2-hys."""
    g = resize(gray(image), height, width)
    dx, dy = np.zeros_like(g), np.zeros_like(g)
    dx[:, 1:-1], dy[1:-1, :] = g[:, 2:] - g[:, :-2], g[2:, :] - g[:-2, :]
    size, angle = np.hypot(dx, dy), np.arctan2(dy, dx) % np.pi * bins / np.pi - 0.5
    low = np.floor(angle).astype(int)
    share = angle - low
    rows, cols = height // cell, width // cell
    cells = np.zeros((rows, cols, bins))
    cy, cx = np.minimum(np.arange(height) // cell, rows - 1)[:, None] + np.zeros((1, width), int), np.minimum(np.arange(width) // cell, cols - 1)[None, :] + np.zeros((height, 1), int)
    np.add.at(cells, (cy, cx, low % bins), size * (1 - share))
    np.add.at(cells, (cy, cx, (low + 1) % bins), size * share)
    blocks = np.concatenate([cells[:-1, :-1], cells[:-1, 1:], cells[1:, :-1], cells[1:, 1:]], axis=-1)
    for _ in range(2):
        blocks = blocks / np.sqrt((blocks**2).sum(-1, keepdims=True) + 1e-10)
        blocks = np.minimum(blocks, 0.2) if _ == 0 else blocks
    return blocks.ravel()


def hu_moments(mask: np.ndarray) -> np.ndarray:
    """The seven invariants of Hu (1962) of a gray or binary image."""
    m = np.asarray(mask, dtype=np.float64)
    y, x = np.mgrid[: m.shape[0], : m.shape[1]]
    area = m.sum()
    if area == 0:
        return np.zeros(7)
    cx, cy = (x * m).sum() / area, (y * m).sum() / area
    eta = lambda p, q: ((x - cx) ** p * (y - cy) ** q * m).sum() / area ** (1 + (p + q) / 2)
    n20, n02, n11, n30, n03, n21, n12 = eta(2, 0), eta(0, 2), eta(1, 1), eta(3, 0), eta(0, 3), eta(2, 1), eta(1, 2)
    a, b, c, d = n30 + n12, n21 + n03, n30 - 3 * n12, 3 * n21 - n03
    return np.array(
        [n20 + n02, (n20 - n02) ** 2 + 4 * n11**2, c**2 + d**2, a**2 + b**2, c * a * (a**2 - 3 * b**2) + d * b * (3 * a**2 - b**2), (n20 - n02) * (a**2 - b**2) + 4 * n11 * a * b, d * a * (a**2 - 3 * b**2) - c * b * (3 * a**2 - b**2)]
    )


def shape_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Largest relative difference of the signed log moments of two images; 0 for shapes alike."""
    def logs(h: np.ndarray) -> np.ndarray:
        return np.where(np.abs(h) > 1e-30, np.sign(h) * np.log10(np.maximum(np.abs(h), 1e-30)), 0.0)

    p, q = logs(hu_moments(a)), logs(hu_moments(b))
    both = (p != 0) & (q != 0)
    return float(np.max(np.abs(p[both] - q[both]) / np.abs(p[both]), initial=0.0))


def boundary(mask: np.ndarray) -> np.ndarray:
    """Contour points (y, x): set pixels with an unset 4-neighbour or on the edge of the image."""
    m = np.pad(np.asarray(mask) > 0, 1)
    inner = m[1:-1, 1:-1] & m[:-2, 1:-1] & m[2:, 1:-1] & m[1:-1, :-2] & m[1:-1, 2:]
    return np.argwhere(m[1:-1, 1:-1] & ~inner)


def signature(image: np.ndarray, space: str = "luv", bins: tuple[int, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, coordinates) of the occupied bins: Luv 6 x 6 x 6, HSV 6 x 6 or 30 x 32. A gray image uses its one channel."""
    if image.ndim == 2:
        data, bins, ranges = image[..., None].astype(np.float64), bins or (16,), ((0, 256),)
    elif space == "luv":
        data, bins, ranges = to_luv(image), bins or (6, 6, 6), ((0, 100), (-134, 220), (-140, 122))
    else:
        data, bins, ranges = to_hsv(image), bins or (6, 6), ((0, 180), (0, 256))
    h = histogram(data, bins, ranges, "l1")
    at = np.argwhere(h > 0)
    return h[h > 0], at.astype(np.float64)


def earth_mover(wa: np.ndarray, ca: np.ndarray, wb: np.ndarray, cb: np.ndarray) -> float:
    """Earth Mover's Distance with Euclidean ground distance: minimum-cost flow by successive shortest paths.

    Total weights are scaled to 1; the result is the mean distance that mass moves. Empty signatures give nan.
    """
    if not len(wa) or not len(wb):
        return float("nan")
    supply, demand = wa / wa.sum(), wb / wb.sum()
    cost = np.sqrt(((ca[:, None] - cb[None]) ** 2).sum(2))
    n, m = cost.shape
    flow, pa, pb = np.zeros((n, m)), np.zeros(n), np.zeros(m)
    supply, demand = supply.copy(), demand.copy()
    while supply.max() > 1e-12 and demand.max() > 1e-12:
        # Dijkstra over the dense bipartite residual graph with reduced costs
        da, db = np.where(supply > 1e-12, 0.0, np.inf), np.full(m, np.inf)
        from_b, from_a = np.full(n, -1), np.full(m, -1)
        done_a, done_b = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            ia, ib = int(np.argmin(np.where(done_a, np.inf, da))), int(np.argmin(np.where(done_b, np.inf, db)))
            xa, xb = (np.inf if done_a[ia] else da[ia]), (np.inf if done_b[ib] else db[ib])
            if min(xa, xb) == np.inf:
                return float("nan")
            if xa <= xb:
                done_a[ia] = True
                reach = xa + np.maximum(0, cost[ia] + pa[ia] - pb)
                better = (reach < db - 1e-15) & ~done_b
                db[better], from_a[better] = reach[better], ia
            else:
                done_b[ib] = True
                if demand[ib] > 1e-12:
                    end = ib
                    break
                reach = xb + np.maximum(0, -cost[:, ib] + pb[ib] - pa)
                better = (reach < da - 1e-15) & ~done_a & (flow[:, ib] > 1e-15)
                da[better], from_b[better] = reach[better], ib
        limit = db[end]
        pa += np.minimum(da, limit)
        pb += np.minimum(db, limit)
        path, b, amount = [], end, demand[end]
        while True:
            a = from_a[b]
            path.append((a, b, 1))
            if from_b[a] < 0:
                amount = min(amount, supply[a])
                break
            amount = min(amount, flow[a, from_b[a]])
            path.append((a, from_b[a], -1))
            b = from_b[a]
        for x, y, sign in path:
            flow[x, y] += sign * amount
        supply[a] -= amount
        demand[end] -= amount
    return float((flow * cost).sum())
