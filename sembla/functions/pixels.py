"""Image descriptors and transformations on arrays of pixels (rows x columns, 0..255).

Names follow ``CODE_parameters``; ``extract`` and ``transform`` make Arrow UDFs of them,
in which the pixels of a batch are one flat array. Grey images are 2-d, colour images
rows x columns x 3 (red, green, blue).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from sembla.session import ship_package

_R = 2**0.5
# The edge kernels (2 x 2 blocks) of the MPEG-7 edge histogram, and the set of ten with both directions.
EDGE_KERNELS = {
    5: ((1, -1, 1, -1), (1, 1, -1, -1), (_R, 0, 0, -_R), (0, _R, -_R, 0), (2, -2, -2, 2)),
    10: ((-1, 1, -1, 1), (0, _R, -_R, 0), (1, 1, -1, -1), (_R, 0, 0, -_R), (1, -1, 1, -1), (0, -_R, _R, 0), (-1, -1, 1, 1), (-_R, 0, 0, _R), (2, -2, -2, 2), (-2, 2, 2, -2)),
}
# The names of the colour spaces, and how many values the first channel has where they are not 256.
COLOR_SPACES = ("GRAY", "RGB", "HSV", "HLS", "LAB", "LUV", "XYZ", "YCRCB")
FIRST_CHANNEL = {"HSV": 180, "HLS": 180}


def color_space(image: np.ndarray, name: str) -> np.ndarray:
    """A red-green-blue image in another colour space, channels as bytes (hue in 180 steps); a grey image only as GRAY."""
    name = name.upper()
    if image.ndim == 2:
        if name != "GRAY":
            raise ValueError(f"a grey image has no {name}")
        return image
    r, g, b = (image[..., i].astype(float) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    some = np.where(span > 0, span, 1.0)
    if name == "GRAY":
        return _clamp(y)
    if name == "RGB":
        return image
    if name == "YCRCB":
        parts = y, (r - y) * 0.713 + 128, (b - y) * 0.564 + 128
    elif name in ("HSV", "HLS"):
        turn = np.where(top == r, 60 * (g - b) / some, np.where(top == g, 120 + 60 * (b - r) / some, 240 + 60 * (r - g) / some))
        hue = np.where(span > 0, np.where(turn < 0, turn + 360, turn), 0.0) / 2
        if name == "HSV":
            parts = hue, np.where(top > 0, 255 * span / np.where(top > 0, top, 1), 0.0), top
        else:
            both = (top + low) / 255
            room = np.where(both < 1, both, 2 - both) * 255
            parts = hue, (top + low) / 2, np.where(span > 0, 255 * span / np.where(room > 0, room, 1), 0.0)
        parts = np.mod(np.floor(np.round(parts[0], 6) + 0.5), 180), parts[1], parts[2]
    elif name in ("XYZ", "LAB", "LUV"):
        xyz = 0.412453 * r + 0.357580 * g + 0.180423 * b, 0.212671 * r + 0.715160 * g + 0.072169 * b, 0.019334 * r + 0.119193 * g + 0.950227 * b
        if name == "XYZ":
            parts = xyz
        else:
            u, v, w = (x / 255 for x in xyz)
            light = np.where(v > 0.008856, 116 * np.cbrt(v) - 16, 903.3 * v)
            if name == "LAB":
                f = lambda t: np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
                parts = light * 255 / 100, 500 * (f(u / 0.950456) - f(v)) + 128, 200 * (f(v) - f(w / 1.088754)) + 128
            else:
                d = u + 15 * v + 3 * w
                d = np.where(d > 0, d, 1.0)
                parts = light * 255 / 100, (13 * light * (4 * u / d - 0.19793943) + 134) * 255 / 354, (13 * light * (9 * v / d - 0.46831096) + 140) * 255 / 262
    else:
        raise ValueError(f"unknown colour space {name}")
    return np.stack([_clamp(x) for x in parts], -1)


def quantize(values: np.ndarray, how: str) -> np.ndarray:
    """Values of 0..1 in a quantisation: 1U to bytes, rounded up; R1U to bytes, to the nearest; 4F and 8F as they are."""
    if how.lstrip("R") not in ("1U", "4F", "8F"):
        raise ValueError(f"unknown quantisation {how}")
    if how.endswith("F"):
        return values.astype(np.float32).astype(float) if how.endswith("4F") else values
    scaled = np.round(np.asarray(values, float) * 255, 9)
    return np.clip(np.floor(scaled + 0.5) if how[0] == "R" else np.ceil(scaled), 0, 255)


def zones(image: np.ndarray, width: int, height: int) -> list[np.ndarray]:
    """width x height zones, row by row; borders spread evenly."""
    ys = [image.shape[0] * i // height for i in range(height + 1)]
    xs = [image.shape[1] * i // width for i in range(width + 1)]
    return [image[a:b, c:d] for a, b in zip(ys, ys[1:]) for c, d in zip(xs, xs[1:])]


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean over the covered pixels when shrinking, nearest pixel when enlarging."""
    h, w = image.shape[:2]
    if h >= height and w >= width:
        return np.array([z.mean(axis=(0, 1)) for z in zones(image, width, height)]).reshape(height, width, *image.shape[2:])
    return image[np.arange(height) * h // height][:, np.arange(width) * w // width].astype(float)


def histogram_gray(image: np.ndarray, width: int = 1, height: int = 1, bins: int = 16, values: int = 256) -> np.ndarray:
    """Per zone the share of pixels in each of ``bins`` equal ranges of 0..values."""
    return np.concatenate([np.bincount(np.minimum(z.astype(int) * bins // values, bins - 1).ravel(), minlength=bins) / max(1, z.size) for z in zones(image, width, height)])


def histogram_color(image: np.ndarray, width: int, height: int, b1: int, b2: int, b3: int, first: int = 256) -> np.ndarray:
    """Per zone the joint histogram of three channels; ``first`` is the number of values of the first one."""
    out = []
    for z in zones(image, width, height):
        code = np.zeros(z.shape[:2], int)
        for c, b in enumerate((b1, b2, b3)):
            code = code * b + np.minimum(z[:, :, c].astype(int) * b // (256 if c else first), b - 1)
        out.append(np.bincount(code.ravel(), minlength=b1 * b2 * b3) / max(1, code.size))
    return np.concatenate(out)


def histogram_channels(image: np.ndarray, width: int, height: int, *bins: int, first: int = 256) -> np.ndarray:
    """Per zone the histograms of the channels one after the other; one number of bins for all, or one each."""
    bins = bins * image.shape[2] if len(bins) == 1 else bins
    return np.concatenate([histogram_gray(z[:, :, c], 1, 1, b, 256 if c else first) for z in zones(image, width, height) for c, b in enumerate(bins)])


def keyframe(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """The resized pixels."""
    return resize(image, width, height).ravel()


def ordinal(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Rank (from 0) of each zone by its mean, a quarter of it rounded; equal ones in zone order."""
    means = np.array([np.floor(z.mean() / 4 + 0.5) for z in zones(image, width, height)])
    rank = np.empty(len(means), int)
    rank[np.argsort(means, kind="stable")] = np.arange(len(means))
    return rank


def cell_means(image: np.ndarray, columns: int, rows: int) -> np.ndarray:
    """Means of rows x columns cells, from sums over rectangles; a cell without a pixel is 0."""
    h, w = image.shape
    ys, xs = np.arange(rows + 1) * h // rows, np.arange(columns + 1) * w // columns
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(image, 0), 1, out=total[1:, 1:])
    corner = total[np.ix_(ys, xs)]
    sums = corner[1:, 1:] - corner[:-1, 1:] - corner[1:, :-1] + corner[:-1, :-1]
    return sums / np.maximum(np.outer(np.diff(ys), np.diff(xs)), 1)


def _strongest(image: np.ndarray, columns: int, rows: int, threshold: float, kernels: int, absolute: bool) -> np.ndarray:
    """rows x columns: per block of 2 x 2 cells the number of its strongest kernel, -1 if all are under the threshold.

    Among equal ones the last counts; strengths are rounded to 9 decimals.
    """
    c = cell_means(image, 2 * columns, 2 * rows)
    corners = np.stack([c[::2, ::2], c[::2, 1::2], c[1::2, ::2], c[1::2, 1::2]], -1)
    s = corners @ np.array(EDGE_KERNELS[kernels], float).T
    s = np.round(np.abs(s) if absolute else s, 9)
    last = s.shape[2] - 1 - s[:, :, ::-1].argmax(2)
    return np.where(s.max(2) >= threshold, last, -1)


def edge_histogram(image: np.ndarray, width: int = 4, height: int = 4, bw: int = 8, bh: int = 8, threshold: float = 10, kernels: int = 5, absolute: bool = False) -> np.ndarray:
    """Per zone the shares of the kernels among its bw x bh blocks that have a strongest one at or over the threshold; zeros if none has."""
    best = _strongest(image, width * bw, height * bh, threshold, kernels, absolute)
    zone = np.arange(height * bh)[:, None] // bh * width + np.arange(width * bw)[None] // bw
    counts = np.bincount((zone * kernels + best)[best >= 0], minlength=width * height * kernels).reshape(-1, kernels)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).ravel()


def edges(image: np.ndarray, bw: int, bh: int, threshold: float = 10, kernels: int = 5, absolute: bool = False) -> np.ndarray:
    """Per block the number of its strongest kernel, -1 under the threshold."""
    return _strongest(image, bw, bh, threshold, kernels, absolute).ravel()


def correlate(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with repeated borders."""
    kh, kw = kernel.shape
    padded = np.pad(image.astype(float), ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), mode="edge")
    out = np.zeros(image.shape, float)
    for i in range(kh):
        for j in range(kw):
            out += kernel[i, j] * padded[i : i + image.shape[0], j : j + image.shape[1]]
    return out


_SOBEL_X = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], float)


def gradients(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives in x and y."""
    return correlate(image, _SOBEL_X), correlate(image, _SOBEL_X.T)


def gradient_histogram(image: np.ndarray, width: int = 1, height: int = 1, bins: int = 8, threshold: float = 20) -> np.ndarray:
    """Per zone the share of pixels with a gradient over the threshold in each direction range of half a turn."""
    gx, gy = gradients(image)
    size = np.hypot(gx, gy)
    code = np.minimum((np.mod(np.arctan2(gy, gx), np.pi) / np.pi * bins).astype(int), bins - 1)
    out = []
    for c, s in zip(zones(code, width, height), zones(size, width, height)):
        out.append(np.bincount(c[s > threshold], minlength=bins) / max(1, c.size))
    return np.concatenate(out)


def edge_centroids(image: np.ndarray, bw: int, bh: int, threshold: float = 40) -> np.ndarray:
    """Per block the mean place (x, y in 0..1) of its edge pixels, the middle if it has none."""
    strong = np.hypot(*gradients(image)) > threshold
    out = []
    for z in zones(strong, bw, bh):
        y, x = np.nonzero(z)
        out += [(x.mean() + 0.5) / z.shape[1], (y.mean() + 0.5) / z.shape[0]] if len(x) else [0.5, 0.5]
    return np.array(out)


def canny(image: np.ndarray, low: float = 50, high: float = 100) -> np.ndarray:
    """Edge pixels (0 or 255): largest along the gradient and over low, linked to one over high."""
    gx, gy = gradients(image)
    size = np.hypot(gx, gy)
    turn = np.mod(np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int), 4)
    pad = np.pad(size, 1)
    h, w = size.shape
    top = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        one, two = pad[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], pad[1 - dy : 1 - dy + h, 1 - dx : 1 - dx + w]
        top |= (turn == k) & (size >= one) & (size > two)
    weak, strong = top & (size > low), top & (size > high)
    while True:
        grown = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for dy in range(3):
            for dx in range(3):
                near |= grown[dy : dy + h, dx : dx + w]
        after = strong | (near & weak)
        if (after == strong).all():
            return np.where(strong, 255, 0)
        strong = after


def canny_bits(image: np.ndarray, width: int, height: int, low: float = 50, high: float = 100) -> np.ndarray:
    """Edge bits of the resized image, packed into bytes."""
    return np.packbits(canny(resize(image, width, height), low, high).ravel() > 0).astype(int)


def _clamp(image: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.round(np.asarray(image, float), 6) + 0.5), 0, 255)


def gray(image: np.ndarray, scale: float = 1, shift: float = 0, absolute: bool = False, threshold: float | None = None, equalize: bool = False) -> np.ndarray:
    """scale * v + shift, then absolute value, threshold (0 or 255) and equalisation as asked."""
    out = image.astype(float) * scale + shift
    out = _clamp(np.abs(out) if absolute else out)
    if threshold is not None:
        out = np.where(out >= threshold, 255.0, 0.0)
    if equalize:
        total = np.cumsum(np.bincount(out.astype(int).ravel(), minlength=256))
        first = total[total > 0][0]
        out = _clamp((total[out.astype(int)] - first) / max(1, out.size - first) * 255)
    return out


def rank_filter(image: np.ndarray, width: int, height: int, kind: str) -> np.ndarray:
    """median, max, min or avg over a window with repeated borders."""
    padded = np.pad(image.astype(float), ((height // 2, height - 1 - height // 2), (width // 2, width - 1 - width // 2)), mode="edge")
    windows = np.lib.stride_tricks.sliding_window_view(padded, (height, width))
    return {"median": np.median, "max": np.max, "min": np.min, "avg": np.mean}[kind](windows, axis=(2, 3))


def cross_filter(image: np.ndarray, kind: str) -> np.ndarray:
    """max or min over a pixel and its four neighbours."""
    p = np.pad(image.astype(float), 1, mode="edge")
    parts = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
    return np.max(parts, axis=0) if kind == "max" else np.min(parts, axis=0)


def convolve(image: np.ndarray, kernel: np.ndarray, absolute: bool = False, most: float = 256, add: bool = False) -> np.ndarray:
    """Kernel sums with repeated borders, scaled by 256 / most (0: by the largest value), as bytes; add: on top of the image."""
    v = correlate(image, kernel)
    if absolute:
        v = np.abs(v)
    most = most or float(max(v.max(), 0.0)) or 256
    out = _clamp(v * 256 / most)
    return np.minimum(image + out, 255.0) if add else out


def gray_chain(image: np.ndarray, steps: list[str]) -> np.ndarray:
    """Steps of a grey transformation in order: cContrast, bBrightness and ABS (one step, at the place of the first), tThreshold, EQUALIZE, ERODE, DILATE."""
    pixel = {t[0].lower(): _fraction(t[1:]) for t in steps if t[0] in "cCbB"}
    absolute, done, out = "ABS" in (t.upper() for t in steps), False, image.astype(float)
    for t in steps:
        name = t.upper()
        if name == "EQUALIZE":
            out = gray(out, equalize=True)
        elif name in ("ERODE", "DILATE"):
            out = cross_filter(out, "min" if name == "ERODE" else "max")
        elif t[0] in "tT":
            out = np.where(out > _fraction(t[1:]), 255.0, 0.0)
        elif t[0] in "cCbB" or name == "ABS":
            if not done:
                out, done = gray(out, pixel.get("c", 1), pixel.get("b", 0), absolute), True
        else:
            raise ValueError(f"unknown step {t}")
    return out


def sobel(image: np.ndarray, threshold: float | None = None, approximate: bool = False) -> np.ndarray:
    """Gradient size, |x| + |y| if approximate; clamped, or 0 / 255 with a threshold."""
    gx, gy = gradients(image)
    size = np.abs(gx) + np.abs(gy) if approximate else np.hypot(gx, gy)
    return _clamp(size) if threshold is None else np.where(size >= threshold, 255.0, 0.0)


def laplace(image: np.ndarray) -> np.ndarray:
    """Absolute Laplacian, clamped."""
    return _clamp(np.abs(correlate(image, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))))


def gaussian(sigma: float) -> np.ndarray:
    """A normalised kernel that reaches three deviations."""
    r = max(1, int(np.ceil(3 * sigma)))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return np.outer(g, g) / g.sum() ** 2


def difference_of_gaussians(image: np.ndarray, one: float, two: float, threshold: float | None = None) -> np.ndarray:
    """Absolute difference of two blurs; 0 / 255 with a threshold, else stretched to 255."""
    d = np.abs(correlate(image, gaussian(one)) - correlate(image, gaussian(two)))
    if threshold is not None:
        return np.where(d >= threshold, 255.0, 0.0)
    return _clamp(d * 255 / d.max()) if d.max() > 0 else d


def rotate(image: np.ndarray, what: str) -> np.ndarray:
    """VFLIP, HFLIP, or a multiple of 90 degrees; other angles change nothing."""
    if what == "VFLIP":
        return image[::-1]
    if what == "HFLIP":
        return image[:, ::-1]
    angle = int(what)
    return np.rot90(image, -(angle // 90) % 4) if angle % 90 == 0 else image


def crop(image: np.ndarray, width: int, height: int, x: int | None = None, y: int | None = None) -> np.ndarray:
    """A rectangle at (x, y), centred by default, cut at the border."""
    h, w = image.shape[:2]
    x = (w - width) // 2 if x is None else x
    y = (h - height) // 2 if y is None else y
    return image[max(0, y) : max(0, y + height), max(0, x) : max(0, x + width)]


def crop_black(image: np.ndarray, threshold: float = 16, share: float = 1 / 8) -> np.ndarray:
    """Without border rows and columns of which at most ``share`` of the pixels are brighter than the threshold."""
    bright = image > threshold
    rows, cols = np.flatnonzero(bright.mean(1) > share), np.flatnonzero(bright.mean(0) > share)
    return image[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1] if len(rows) and len(cols) else image


def noise(image: np.ndarray, black: float, white: float, seed: int = 0) -> np.ndarray:
    """Salt and pepper with a seed."""
    r = np.random.default_rng(seed).random(image.shape[:2])
    out = image.astype(float).copy()
    out[r < black] = 0
    out[(r >= black) & (r < black + white)] = 255
    return out


def otsu(image: np.ndarray) -> int:
    """The grey value that splits the histogram with the largest variance between both parts."""
    n = np.bincount(image.astype(int).ravel(), minlength=256).astype(float)
    w = np.cumsum(n)
    m = np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.argmax(np.round(np.where(np.isfinite(between), between, -1), 6)))


def threshold(image: np.ndarray, at: float = 0) -> np.ndarray:
    """0 / 255; 0 asks for the automatic value."""
    return np.where(image > (at or otsu(image)), 255.0, 0.0)


def template(image: np.ndarray, pattern: np.ndarray, limit: float, step: int = 3) -> tuple[int, int, float] | None:
    """(x, y, mean difference) of the best place of the pattern on a grid, if it is under the limit."""
    best = None
    for y in range(0, image.shape[0] - pattern.shape[0] + 1, step):
        for x in range(0, image.shape[1] - pattern.shape[1] + 1, step):
            d = float(np.abs(image[y : y + pattern.shape[0], x : x + pattern.shape[1]].astype(float) - pattern).mean())
            if d < limit and (best is None or d < best[2]):
                best = (x, y, d)
    return best


def principal_angle(image: np.ndarray, limit: float = 40, least: int = 100) -> float | None:
    """Direction (degrees) of the main axis of the edge pixels; none if there are few, or half of all."""
    y, x = np.nonzero(np.hypot(*gradients(image)) > limit)
    if len(x) <= least or 2 * len(x) >= image.size:
        return None
    values, axes = np.linalg.eigh(np.cov(np.stack([x, y])))
    return float(np.degrees(np.arctan2(axes[1, -1], axes[0, -1])) % 180)


def straighten(image: np.ndarray, limit: float = 40) -> np.ndarray:
    """The image turned by quarter turns so that the main axis of its edges lies nearest to the x axis."""
    angle = principal_angle(image, limit)
    return image if angle is None or not 45 <= angle < 135 else np.rot90(image, -1)


def mark_template(image: np.ndarray, pattern: np.ndarray, limit: float) -> np.ndarray:
    """The image with the best place of the pattern blacked out, if there is one under the limit."""
    found, out = template(image, pattern, limit), image.astype(float)
    if found:
        out[found[1] : found[1] + pattern.shape[0], found[0] : found[0] + pattern.shape[1]] = 0
    return out


def _fraction(text: str) -> float:
    a, _, b = text.partition("/")
    return float(a) / float(b) if b else float(a)


def _pair(text: str) -> list[int]:
    return [int(x) for x in text.lower().split("x")]


def _over_zones(text: str, make: Callable[[int, int], np.ndarray]) -> np.ndarray:
    """The descriptors of zonings such as 1x1+2x2, one after the other."""
    return np.concatenate([make(*_pair(z)) for z in text.split("+")])


def _histogram(image: np.ndarray, zoning: str, quant: str, *rest: str) -> np.ndarray:
    bins = int(rest[0])
    size = 1 if "NoNorm" not in rest else image.size
    return quantize(_over_zones(zoning, lambda w, h: histogram_gray(color_space(image, "GRAY"), w, h, bins)), quant) * size


def _color(image: np.ndarray, zoning: str, quant: str, space: str, bins: str) -> np.ndarray:
    made, first = color_space(image, space), FIRST_CHANNEL.get(space.upper(), 256)
    return quantize(_over_zones(zoning, lambda w, h: histogram_color(made, w, h, *_pair(bins), first=first)), quant)


def _channels(image: np.ndarray, zoning: str, space: str, bins: str, quant: str) -> np.ndarray:
    made, first = color_space(image, space), FIRST_CHANNEL.get(space.upper(), 256)
    return quantize(_over_zones(zoning, lambda w, h: histogram_channels(made, w, h, *map(int, bins.split("+")), first=first)), quant)


def _edge_code(rest: tuple[str, ...]) -> tuple[int, bool, str]:
    """Kernels, whether signs don't count, and quantisation of the tail of a code such as K10_ABS_4F."""
    kernels = next((int(t[1:]) for t in rest if t[0] == "K"), 5)
    return kernels, "ABS" in rest, next((t for t in rest if t[-1] in "UF"), "8F")


def _edge_histogram(image: np.ndarray, size: str, blocks: str, limit: str, *rest: str) -> np.ndarray:
    kernels, absolute, quant = _edge_code(rest)
    return quantize(edge_histogram(color_space(image, "GRAY"), *_pair(size), *_pair(blocks), float(limit), kernels, absolute), quant)


def _edges(image: np.ndarray, blocks: str, limit: str, *rest: str) -> np.ndarray:
    return edges(color_space(image, "GRAY"), *_pair(blocks), float(limit), *_edge_code(rest)[:2])


def _keyframe(image: np.ndarray, size: str, space: str = "GRAY", quant: str = "8F") -> np.ndarray:
    made = keyframe(color_space(image, space), *_pair(size))
    return _clamp(made) if quant.endswith("1U") else made.astype(np.float32).astype(float) if quant == "4F" else made


def _gradient_code(image: np.ndarray, zoning: str, bins: str, limit: str, quant: str = "8F") -> np.ndarray:
    return quantize(_over_zones(zoning, lambda w, h: gradient_histogram(image, w, h, int(bins), float(limit))), quant)


def _filter(image: np.ndarray, size: str, what: str, *flags: str) -> np.ndarray:
    w, h = _pair(size)
    add = "ADD" in flags
    if what in ("MEDIAN", "MAX", "MIN", "AVG"):
        out = _clamp(rank_filter(image, w, h, what.lower()))
        return np.minimum(image + out, 255.0) if add else out
    parts = what.split(",")
    tail = parts[w * h :]
    most = _fraction(tail[tail.index("MAX") + 1]) if "MAX" in tail else 256.0
    return convolve(image, np.array([_fraction(x) for x in parts[: w * h]]).reshape(h, w), "ABS" in tail, most, add)


#: Descriptors by code: functions of an image and the parts of the code.
EXTRACTORS: dict[str, Callable[..., np.ndarray]] = {
    "KF": _keyframe, "HISTGRAY": _histogram, "HISTCOLOR": _color, "HISTBYCHANNEL": _channels, "OMD": lambda i, size: ordinal(i, *_pair(size)), "EHD": _edge_histogram, "EDGES": _edges, "GDH": _gradient_code,
    "HAMP": lambda i, size, t: edge_centroids(i, *_pair(size), float(t)), "CANNY": lambda i, size, a, b: canny_bits(i, *_pair(size), float(a), float(b)),
}
#: Transformations by code.
TRANSFORMS: dict[str, Callable[..., np.ndarray]] = {
    "GRAY": lambda i, *steps: gray_chain(i, list(steps)), "EQUALIZE": lambda i: gray(i, equalize=True), "FILTER": _filter, "SOBEL": lambda i, *t: sobel(i, next((float(x) for x in t if x != "APROX"), None), "APROX" in t), "LAPLACE": lambda i: laplace(i),
    "DOG": lambda i, *t: difference_of_gaussians(i, *map(float, t)), "CANNY": lambda i, *t: canny(i, *map(float, t)), "RESIZE": lambda i, size: resize(i, *_pair(size)), "CROP": lambda i, size, *xy: crop(i, *_pair(size), *map(int, xy)),
    "CROPBLACK": lambda i: crop_black(i), "THRESHOLD": lambda i, t="0": threshold(i, float(t)), "NOISE": lambda i, a, b, seed="0": noise(i, float(a), float(b), int(seed)), "ROTATE": lambda i, a: rotate(i, a), "COLOR": lambda i, space: color_space(i, space),
    "PCA": lambda i, t="40": straighten(i, float(t)), "TEMPLATE": lambda i, t, size, v: mark_template(i, np.full(_pair(size)[::-1], float(v)), float(t)),
}


def parse_code(text: str) -> tuple[str, list[str]]:
    """``CODE_1x2_3`` -> code and its parts."""
    code, *rest = text.split("_")
    return code.upper(), rest


def _images(column: pa.Array) -> list[np.ndarray | None]:
    """The images of an Arrow column of nested lists; null where the image is, or where it holds a null or rows of different lengths."""
    lengths, level = [], column
    while pa.types.is_list(level.type):
        lengths.append(np.diff(level.offsets.to_numpy()))
        level = level.flatten()
    pixels = level.to_numpy(zero_copy_only=False).astype(float)
    out: list[np.ndarray | None] = []
    starts = [np.concatenate([[0], np.cumsum(np.where(level_nulls, 0, n))]) for n, level_nulls in zip(lengths, _nulls(column))]
    for i, missing in enumerate(_nulls(column)[0]):
        if missing:
            out.append(None)
            continue
        shape, a, z = [], i, i + 1
        for n, at in zip(lengths, starts):
            inner = n[a:z]
            shape.append(int(inner[0]) if len(inner) and (inner == inner[0]).all() else -1)
            a, z = int(at[a]), int(at[z])
        image = pixels[a:z]
        out.append(image.reshape(shape) if min(shape) > 0 and not np.isnan(image).any() else None)
    return out


def _nulls(column: pa.Array) -> list[np.ndarray]:
    """Per level of nesting which lists are null."""
    out, level = [], column
    while pa.types.is_list(level.type):
        out.append(level.is_null().to_numpy(zero_copy_only=False))
        level = level.flatten()
    return out


def image_type(color: bool = False) -> tuple[pa.DataType, str]:
    """The Arrow and the Spark type of an image column."""
    kind = pa.list_(pa.list_(pa.list_(pa.float64()) if color else pa.float64()))
    return kind, "array<array<array<double>>>" if color else "array<array<double>>"


def image_lists(arrays: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Arrays of one number of dimensions as an Arrow column of nested lists of double."""
    some = [np.asarray(a, float) for a in arrays if a is not None]
    if not some:
        return pa.nulls(len(arrays), kind)
    values: pa.Array = pa.array(np.concatenate([a.ravel() for a in some]))
    for d in range(some[0].ndim - 1, 0, -1):
        counts = np.concatenate([np.full(int(np.prod(a.shape[:d])), a.shape[d]) for a in some])
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)
    counts = np.array([0 if a is None else len(a) for a in arrays])
    gone = np.array([a is None for a in arrays] + [False])
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=gone) if gone.any() else pa.array(offsets), values)


def extract(image: Column, code: str) -> Column:
    """The descriptor of an image column (nested arrays) as array<double>; null for a null image or one with a null pixel."""
    ship_package()
    name, parts = parse_code(code)
    f = EXTRACTORS[name]

    def run(images: pa.Array) -> pa.Array:
        return image_lists([None if v is None else np.asarray(f(v, *parts), float).ravel() for v in _images(images)], pa.list_(pa.float64()))

    run.__annotations__ = {"images": pa.Array, "return": pa.Array}
    # asNondeterministic: run once, not again for the filter that explode asks for
    return F.arrow_udf(run, "array<double>").asNondeterministic()(image)


def transform(image: Column, code: str, color: bool = False) -> Column:
    """The transformed image (array of arrays of double, with color of arrays of three); null for a null image or one with a null pixel."""
    ship_package()
    name, parts = parse_code(code)
    f = TRANSFORMS[name]
    kind, text = image_type(color)

    def run(images: pa.Array) -> pa.Array:
        return image_lists([None if v is None else f(v, *parts) for v in _images(images)], kind)

    run.__annotations__ = {"images": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, text).asNondeterministic()(image)
