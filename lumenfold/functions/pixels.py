"""Array kernels over decoded images (numpy); called from Arrow functions, never a row at a time in SQL.

An image is an (h, w, 3) array of 8-bit RGB.  ``gray8`` is 8-bit luminance; measures that are defined on
16-bit channels use ``gray8 * 257``.

Fixed values: the thresholds, divisors, sampling steps and bit orders of the hashes and measures below are part of what they mean.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from lumenfold.schema import ImageTooSmall


def from_spark(width: int, height: int, channels: int, data: bytes) -> np.ndarray | None:
    """RGB array of a row of Spark's image source (BGR, or one channel); None for undecodable rows."""
    if width <= 0 or height <= 0 or not data:
        return None
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(a, 3, axis=2)
    return a[:, :, 2::-1]


def gray8(rgb: np.ndarray) -> np.ndarray:
    """Luminance in integers: weights of 16-bit channels, rounded, upper 8 bits."""
    c = rgb.astype(np.int64) * 257
    return ((19595 * c[..., 0] + 38470 * c[..., 1] + 7471 * c[..., 2] + 32768) >> 24).astype(np.uint8)


# --- geometry ---------------------------------------------------------------------------------


@lru_cache(maxsize=256)
def _lanczos(src: int, dst: int) -> np.ndarray:
    """(dst, src) weights of a three-lobed Lanczos filter, widened when shrinking."""
    scale = src / dst
    reach = max(scale, 1.0)
    centre = (np.arange(dst) + 0.5) * scale - 0.5
    x = (np.arange(src)[None, :] - centre[:, None]) / reach
    w = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(a: np.ndarray, width: int, height: int) -> np.ndarray:
    """Exact size; a side of 0 follows the aspect ratio."""
    h, w = a.shape[:2]
    if not width:
        width = max(1, round(w * height / h))
    if not height:
        height = max(1, round(h * width / w))
    out = np.tensordot(_lanczos(h, height), a.astype(float), (1, 0))
    out = np.moveaxis(np.tensordot(_lanczos(w, width), out, (1, 1)), 0, 1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def fit_size(w: int, h: int, max_w: int, max_h: int) -> tuple[int, int]:
    """Largest size of the same aspect within the box, never larger than the image."""
    k = min(max_w / w, max_h / h, 1.0)
    return max(1, int(w * k)), max(1, int(h * k))


def resize_to_fit(a: np.ndarray, max_w: int, max_h: int) -> np.ndarray:
    return resize(a, *fit_size(a.shape[1], a.shape[0], max_w, max_h))


def resize_to_cover(a: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = a.shape[:2]
    k = max(width / w, height / h)
    return resize(a, max(1, int(w * k)), max(1, int(h * k)))


def crop(a: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """Region, clipped to the image."""
    h, w = a.shape[:2]
    x0, y0 = min(max(x, 0), w), min(max(y, 0), h)
    return a[y0 : max(y0, min(y + height, h)), x0 : max(x0, min(x + width, w))]


def crop_center(a: np.ndarray, width: int, height: int) -> np.ndarray:
    return crop(a, (a.shape[1] - width) // 2, (a.shape[0] - height) // 2, width, height)


def resize_to_fill(a: np.ndarray, width: int, height: int) -> np.ndarray:
    return crop_center(resize_to_cover(a, width, height), width, height)


def orient(a: np.ndarray, code: int) -> np.ndarray:
    """Undo a camera's orientation code 1..8."""
    if code in (5, 6, 7, 8):
        a = np.swapaxes(a, 0, 1)  # code 5 is the plain transposition
    flips = {2: (1,), 3: (0, 1), 4: (0,), 6: (1,), 7: (0, 1), 8: (0,)}.get(code, ())
    return np.flip(a, flips) if flips else a


def rotate(a: np.ndarray, quarters: int) -> np.ndarray:
    """Counter-clockwise quarter turns."""
    return np.rot90(a, quarters)


def adjust(a: np.ndarray, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0) -> np.ndarray:
    """Percentages -100..100, applied in this order."""
    x = a.astype(float) + 255 * brightness / 100
    x = (np.clip(x, 0, 255) - 127.5) * (1 + contrast / 100) + 127.5
    if saturation:
        mean = (x.max(2, keepdims=True) + x.min(2, keepdims=True)) / 2
        x = mean + (x - mean) * (1 + saturation / 100)
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def blur(a: np.ndarray, sigma: float) -> np.ndarray:
    if sigma <= 0:
        return a
    r = max(1, math.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    k /= k.sum()
    x = np.pad(a.astype(float), ((r, r), (r, r), (0, 0)), "edge")
    x = sum(k[i] * x[i : i + a.shape[0]] for i in range(2 * r + 1))
    x = sum(k[i] * x[:, i : i + a.shape[1]] for i in range(2 * r + 1))
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def sharpen(a: np.ndarray, sigma: float) -> np.ndarray:
    soft = blur(a, sigma).astype(int)
    return np.clip(2 * a.astype(int) - soft, 0, 255).astype(np.uint8)


def collage(images: list[np.ndarray], columns: int) -> np.ndarray:
    """Images side by side in cells of the largest width and height."""
    if not images:
        return np.zeros((0, 0, 3), np.uint8)
    ch, cw = max(i.shape[0] for i in images), max(i.shape[1] for i in images)
    rows = -(-len(images) // columns)
    out = np.zeros((rows * ch, columns * cw, 3), np.uint8)
    for n, i in enumerate(images):
        y, x = n // columns * ch, n % columns * cw
        out[y : y + i.shape[0], x : x + i.shape[1]] = i
    return out


def pyramid(a: np.ndarray, levels: int, least: int = 16) -> list[np.ndarray]:
    out = [a]
    while len(out) < levels and min(out[-1].shape[:2]) // 2 >= least:
        out.append(resize(out[-1], out[-1].shape[1] // 2, out[-1].shape[0] // 2))
    return out


def preprocess(a: np.ndarray, max_side: int, gray: bool = False) -> np.ndarray:
    a = resize_to_fit(a, max_side, max_side)
    return np.repeat(gray8(a)[..., None], 3, 2) if gray else a


# --- hashes -----------------------------------------------------------------------------------


def _word(bits: np.ndarray) -> int:
    """First bit lowest; as a signed 64-bit number."""
    b = np.zeros(64, np.uint8)
    flat = bits.ravel()[:64]
    b[: len(flat)] = flat
    return int(np.packbits(b, bitorder="little").view(np.int64)[0])


def _thumb(rgb: np.ndarray, w: int, h: int) -> np.ndarray:
    return gray8(resize(rgb, w, h)).astype(np.int64) * 257


def average_hash(rgb: np.ndarray) -> int:
    g = _thumb(rgb, 8, 8)
    return _word(g > g.sum() // 64)


def difference_hash(rgb: np.ndarray, columns: int = 9) -> int:
    """``columns`` 9 gives 8 bits a row; 10 the variant of 9 bits a row, cut off at 64."""
    g = _thumb(rgb, columns, 8)
    return _word(g[:, 1:] > g[:, :-1])


def fold_hash(rgb: np.ndarray) -> int:
    g = _thumb(rgb, 32, 32) / 65535.0
    return _word((g > g.mean()).reshape(16, 64).any(0))


@lru_cache(maxsize=4)
def _cosines(n: int) -> np.ndarray:
    i = np.arange(n)
    return np.cos((2 * i[None, :] + 1) * i[:, None] * math.pi / (2 * n))


def dct_hash(rgb: np.ndarray) -> int:
    c = _cosines(32)
    low = (c @ (_thumb(rgb, 32, 32) / 65535.0) @ c.T)[:8, :8].ravel()[1:]
    return _word(low > low.mean())


def haar(m: np.ndarray, in_place: bool = False) -> np.ndarray:
    """Multi-level 2-D Haar averages and differences; ``in_place`` repeats the order in which cells were overwritten."""
    m = m.astype(float).copy()
    size = len(m)

    def one(rows: np.ndarray) -> np.ndarray:
        half = rows.shape[1] // 2
        if not in_place:
            return np.concatenate([(rows[:, ::2] + rows[:, 1::2]) / 2, (rows[:, ::2] - rows[:, 1::2]) / 2], 1)
        for x in range(half):
            p, q = rows[:, 2 * x].copy(), rows[:, 2 * x + 1].copy()
            rows[:, x], rows[:, x + half] = (p + q) / 2, (p - q) / 2
        return rows

    while size > 1:
        m[:size, :size] = one(m[:size, :size].copy())
        m[:size, :size] = one(m[:size, :size].T.copy()).T
        size //= 2
    return m


def haar_hash(rgb: np.ndarray, in_place: bool = False) -> int:
    low = np.abs(haar(_thumb(rgb, 64, 64) / 65535.0, in_place)[:8, :8]).ravel()[1:]
    return _word(low > low.mean())


HASHERS = {
    "engine": {"a_hash": average_hash, "p_hash": fold_hash, "d_hash": difference_hash, "w_hash": average_hash},
    "dct": {"a_hash": average_hash, "p_hash": dct_hash, "d_hash": lambda a: difference_hash(a, 10), "w_hash": haar_hash},
    "compat": {"a_hash": average_hash, "p_hash": dct_hash, "d_hash": lambda a: difference_hash(a, 10), "w_hash": lambda a: haar_hash(a, True)},
}


def hash_set(rgb: np.ndarray, names=("a_hash", "p_hash", "d_hash", "w_hash"), variant: str = "engine") -> dict[str, int]:
    unknown = set(names) - set(HASHERS[variant])
    if unknown:
        raise ValueError(f"no such hash: {sorted(unknown)}")
    return {n: HASHERS[variant][n](rgb) for n in names}


# --- quality ----------------------------------------------------------------------------------


def _around(g: np.ndarray) -> np.ndarray:
    """(8, h-2, w-2): the neighbours of every inner pixel."""
    h, w = g.shape
    return np.stack([g[dy : h - 2 + dy, dx : w - 2 + dx] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)]).astype(float)


def sharpness(rgb: np.ndarray, strict: bool = False) -> float:
    g = gray8(rgb).astype(float)
    if min(g.shape) < 3:
        if strict:
            raise ImageTooSmall("3x3 pixels at least")
        return 0.0
    lap = np.abs(4 * g[1:-1, 1:-1] - g[:-2, 1:-1] - g[2:, 1:-1] - g[1:-1, :-2] - g[1:-1, 2:])
    return float(min(lap.mean() / 100, 1.0))


def noise(rgb: np.ndarray, scale: int = 255) -> float:
    """``scale`` 65535 measures 16-bit values, which makes the smoothness test stricter."""
    g = gray8(rgb).astype(float) * (scale // 255)
    if min(g.shape) < 3:
        return 0.5
    near = _around(g)
    smooth = np.abs(g[1:-1, 1:-1] - near.mean(0)) < 10
    return float(min(near.std(0)[smooth].mean() / 50, 1.0)) if smooth.any() else 0.5


def exposure(rgb: np.ndarray) -> float:
    g = gray8(rgb) / 255.0
    if not g.size:
        return 0.5
    dark, bright = (g < 0.1).mean(), (g > 0.9).mean()
    return float(np.clip(g.mean() - max(dark - 0.3, 0) * 0.5 + max(bright - 0.3, 0) * 0.5, 0, 1))


def contrast(rgb: np.ndarray) -> float:
    g = gray8(rgb) / 255.0
    return float(min(math.sqrt(max(0.0, (g * g).mean() - g.mean() ** 2)) / 0.4, 1.0)) if g.size else 0.5


def color_cast(rgb: np.ndarray) -> float:
    means = rgb[::4, ::4].reshape(-1, 3).mean(0) if rgb.size else np.zeros(3)
    if not means.max():
        return 0.0
    return float(min(math.sqrt(((1 - means / means.max()) ** 2).sum() / 3), 1.0))


def blockiness(rgb: np.ndarray) -> float:
    g = gray8(rgb).astype(int) * 257
    h, w = g.shape
    blocks = (w // 8 - 1) * (h // 8 - 1)
    if blocks <= 0:
        return 0.0
    ys, xs = np.arange(8, h - 8, 8), np.arange(8, w - 8, 8)
    here, left, top = g[np.ix_(ys, xs)], g[np.ix_(ys, xs - 1)], g[np.ix_(ys - 1, xs)]
    return float(min(((np.abs(here - left) > 10000) | (np.abs(here - top) > 10000)).sum() / blocks, 1.0))


def ringing(rgb: np.ndarray) -> float:
    g = gray8(rgb).astype(int) * 257
    h, w = g.shape
    samples = ((w - 2) // 2) * ((h - 2) // 2)
    if samples <= 0 or w < 8:
        return 0.0
    step = np.diff(g, axis=1)
    turn = np.sign(step) * (np.abs(step) > 1000)
    flips = (turn[:, 1:] * turn[:, :-1] < 0).astype(int)  # at x: steps x-1->x and x->x+1 oppose, column x - 1
    xs = np.arange(1, w - 1, 2)
    xs = xs[(xs > 2) & (xs < w - 3)]
    ys = np.arange(1, h - 1, 2)
    if not len(xs) or not len(ys):
        return 0.0
    edge = np.maximum(np.abs(step[np.ix_(ys, xs - 1)]), np.abs(step[np.ix_(ys, xs)])) > 15000
    before = flips[np.ix_(ys, xs - 3)] + flips[np.ix_(ys, xs - 2)]
    after = flips[np.ix_(ys, xs)] + flips[np.ix_(ys, xs + 1)]
    return float(min((edge & ((before / 3 > 0.5) | (after / 3 > 0.5))).sum() / samples, 1.0))


def compression_noise(rgb: np.ndarray) -> float:
    g = gray8(rgb).astype(int) * 257
    h, w = g.shape
    p = np.pad(g, 3)  # beyond the border values read as 0
    ys, xs = np.arange(2, h - 2, 4), np.arange(2, w - 2, 4)
    if not len(ys) or not len(xs):
        return 0.0
    centre = g[np.ix_(ys, xs)]
    far = np.stack([np.abs(p[np.ix_(ys + 3 + dy, xs + 3 + dx)] - centre) for dy in range(-3, 4) for dx in range(-3, 4)])
    near = np.stack([np.abs(p[np.ix_(ys + 3 + dy, xs + 3 + dx)] - centre) > 2000 for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    smooth = far.max(0) < 5000
    return float(near.mean(0)[smooth].mean()) if smooth.any() else 0.0


def compression(rgb: np.ndarray, measured: bool = False) -> float:
    h, w = rgb.shape[:2]
    if not measured:
        return 0.1 if w < 100 or h < 100 else 0.3
    return 0.1 if w < 16 or h < 16 else min((blockiness(rgb) + ringing(rgb) + compression_noise(rgb)) / 3, 1.0)


def quality_metrics(rgb: np.ndarray, weights: dict[str, float] | None = None) -> dict[str, float]:
    from lumenfold.functions.scalars import SCORE_WEIGHTS

    m = {"sharpness": sharpness(rgb), "noise": noise(rgb), "exposure": exposure(rgb), "contrast": contrast(rgb), "compression": compression(rgb), "color_cast": color_cast(rgb)}
    good = {**m, "noise": 1 - m["noise"], "exposure": 1 - 2 * abs(m["exposure"] - 0.5), "compression": 1 - m["compression"], "color_cast": 1 - m["color_cast"]}
    w = weights or SCORE_WEIGHTS
    m["final_score"] = min(100.0, max(0.0, 100 * sum(w[k] * good[k] for k in w)))
    return m


def edge_stats(rgb: np.ndarray) -> dict[str, float]:
    g = gray8(rgb).astype(float)
    if min(g.shape) < 3:
        return dict.fromkeys(("strong_edges", "medium_edges", "weak_edges", "total_edges"), 0.0)
    dx = g[:, 2:] - g[:, :-2]
    dy = g[2:] - g[:-2]
    gx = dx[:-2] + 2 * dx[1:-1] + dx[2:]
    gy = dy[:, :-2] + 2 * dy[:, 1:-1] + dy[:, 2:]
    m = np.sqrt(gx * gx + gy * gy)
    strong, medium, weak = ((lo < m) & (m <= hi) for lo, hi in ((50, np.inf), (20, 50), (5, 20)))
    out = {"strong_edges": strong.sum() / g.size, "medium_edges": medium.sum() / g.size, "weak_edges": weak.sum() / g.size}
    return {k: float(v) for k, v in out.items()} | {"total_edges": float((m > 5).sum() / g.size)}


def focus_regions(rgb: np.ndarray) -> dict[str, float]:
    h, w = rgb.shape[:2]
    boxes = {
        "center": (w // 4, h // 4, w // 2, h // 2), "top_left": (0, 0, w // 4, h // 4), "top_right": (3 * w // 4, 0, w // 4, h // 4),
        "bottom_left": (0, 3 * h // 4, w // 4, h // 4), "bottom_right": (3 * w // 4, 3 * h // 4, w // 4, h // 4),
    }
    return {k: sharpness(crop(rgb, *b)) for k, b in boxes.items()}


def noise_patterns(rgb: np.ndarray, flags: bool = False) -> dict[str, float]:
    """Share of inner pixels that differ from their surroundings; ``flags`` gives 0 or 1 for "any"."""
    g = gray8(rgb).astype(float)
    if min(g.shape) < 5:
        return {"high_frequency": 0.0, "low_frequency": 0.0, "salt_pepper": 0.0}
    off = np.abs(g[1:-1, 1:-1] - _around(g).mean(0))
    wide = np.stack([g[dy : g.shape[0] - 4 + dy, dx : g.shape[1] - 4 + dx] for dy in range(5) for dx in range(5)]).mean(0)
    low = (np.abs(g[2:-2, 2:-2] - wide) > 2)[::2, ::2]
    high = off > 5
    share = (lambda x: float(x.any())) if flags else (lambda x: float(x.mean()))
    return {"high_frequency": share(high), "low_frequency": share(low), "salt_pepper": min(1.0, 10 * float((off > 50).sum() / g.size))}


def color_temperature(rgb: np.ndarray) -> tuple[str, float]:
    s = rgb[::8, ::8].reshape(-1, 3).astype(float).sum(0)
    if not s[2]:
        return "neutral", 0.5
    x = s[0] / s[2]
    return ("warm", min((x - 1.2) / 0.8, 1.0)) if x > 1.2 else ("cool", (0.8 - x) / 0.8) if x < 0.8 else ("neutral", 0.0)


def color_distribution(rgb: np.ndarray, loose: bool = False) -> dict[str, float]:
    """Shares of the sampled pixels; ``loose`` divides by the reckoned number of samples instead of the true one."""
    h, w = rgb.shape[:2]
    c = rgb[::4, ::4].reshape(-1, 3) / 255.0
    if not len(c):
        return dict.fromkeys(("saturation_high", "saturation_low", "brightness_low", "brightness_high"), 0.0)
    hi, lo = c.max(1), c.min(1)
    sat, light = np.where(hi > 0, (hi - lo) / np.where(hi > 0, hi, 1), 0), c.mean(1)
    n = (w // 4 + 1) * (h // 4 + 1) if loose else len(c)
    return {"saturation_high": float((sat > 0.7).sum() / n), "saturation_low": float((sat < 0.3).sum() / n), "brightness_low": float((light < 0.2).sum() / n), "brightness_high": float((light > 0.8).sum() / n)}


def is_blank(rgb: np.ndarray, threshold: float) -> bool:
    g = gray8(rgb)[::10, ::10].astype(int) * 257
    return not g.size or bool(((g < 0x1000) | (g > 0xF000)).mean() >= threshold)


def dominant_colors(rgb: np.ndarray, most: int, levels: int = 16) -> list[tuple[int, int, int]]:
    """Most frequent quantised colours (ties by colour), those with more than a twentieth of the distinct ones."""
    step = 256 // levels
    q = rgb[::10, ::10].reshape(-1, 3) // step * step
    colours, n = np.unique(q, axis=0, return_counts=True)
    keep = np.flatnonzero(n > len(colours) // 20)
    keep = keep[np.lexsort((keep, -n[keep]))]
    return [tuple(int(v) for v in colours[i]) for i in keep[:most]]


# --- histograms, features, moments ------------------------------------------------------------------


def channel_histogram(channels: np.ndarray, bins: int) -> np.ndarray:
    """Shares per channel (last axis) of values 0..1, channels one after the other."""
    flat = (channels.reshape(-1, channels.shape[-1]) * (bins - 1)).astype(int)
    return np.concatenate([np.bincount(flat[:, c], minlength=bins)[:bins] / max(1, len(flat)) for c in range(flat.shape[1])])


def rgb_histogram(rgb: np.ndarray, bins: int = 16) -> np.ndarray:
    return channel_histogram(rgb / 255.0, bins)


def hsv(rgb: np.ndarray) -> np.ndarray:
    c = rgb / 255.0
    hi, lo = c.max(-1), c.min(-1)
    d = hi - lo
    safe = np.where(d == 0, 1, d)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    h = np.where(hi == r, (g - b) / safe + np.where(g < b, 6, 0), np.where(hi == g, (b - r) / safe + 2, (r - g) / safe + 4)) / 6
    return np.stack([np.where(d == 0, 0, h), np.where(hi == 0, 0, d / np.where(hi == 0, 1, hi)), hi], -1)


def hsv_histogram(rgb: np.ndarray, bins: int = 16) -> np.ndarray:
    return channel_histogram(hsv(rgb), bins)


def luminance_histogram(rgb: np.ndarray, bins: int = 16) -> np.ndarray:
    return channel_histogram(gray8(rgb)[..., None] / 255.0, bins)


def edge_density(rgb: np.ndarray) -> float:
    g = gray8(rgb).astype(int) * 257
    if min(g.shape) < 3:
        return 0.0
    c = g[1:-1, 1:-1]
    return float(((np.abs(c - g[1:-1, 2:]) > 10000) | (np.abs(c - g[2:, 1:-1]) > 10000)).sum() / g.size)


def feature_vector(rgb: np.ndarray) -> np.ndarray:
    h, w = rgb.shape[:2]
    return np.r_[rgb_histogram(rgb), edge_density(rgb), w / h, w / 2, h / 2]


def moments(rgb: np.ndarray) -> dict[str, float]:
    """Centroid and the first three moment invariants, not normalised by size."""
    g = gray8(rgb) / 255.0
    y, x = np.mgrid[: g.shape[0], : g.shape[1]].astype(float)
    m = {(p, q): float((x**p * y**q * g).sum()) for p in range(4) for q in range(4 - p)}
    mass = m[0, 0]
    if not mass:
        return dict.fromkeys(("hu1", "hu2", "hu3", "centroid_x", "centroid_y"), 0.0)
    cx, cy = m[1, 0] / mass, m[0, 1] / mass
    return {**invariants(m, cx, cy), "centroid_x": cx, "centroid_y": cy}


def invariants(m: dict, cx: float, cy: float) -> dict[str, float]:
    """The published (non-standard for the mixed third order) formulas over raw moments."""
    a11, a20, a02 = m[1, 1] - cx * m[0, 1], m[2, 0] - cx * m[1, 0], m[0, 2] - cy * m[0, 1]
    a30 = m[3, 0] - 3 * m[2, 0] * cx + 2 * m[1, 0] * cx**2
    a03 = m[0, 3] - 3 * m[0, 2] * cy + 2 * m[0, 1] * cy**2
    a12 = m[1, 2] - 2 * m[1, 1] * cy - cy * m[2, 0] + 2 * m[1, 0] * cy**2
    a21 = m[2, 1] - 2 * m[1, 1] * cx - cx * m[0, 2] + 2 * m[0, 1] * cx**2
    return {"hu1": a20 + a02, "hu2": (a20 - a02) ** 2 + 4 * a11**2, "hu3": (a30 - 3 * a12) ** 2 + (3 * a21 - a03) ** 2}
