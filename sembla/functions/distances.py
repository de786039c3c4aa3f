"""Vector distances as Column expressions and as NumPy kernels over blocks.

Both forms accumulate in double precision. A distance is named by a string such as
``L2``, ``LP,order=3``, ``DPF,order=2,pct_discard=0.25`` or
``COSINE_DISTANCE,normalize_vectors=true``; nested values stand in brackets.
Vectors of a pair must have one length; a null vector or element gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def parse_parameters(text: str) -> tuple[str, dict[str, str]]:
    """``ID,k=v,k=(nested,..)`` -> id and values; brackets protect commas."""
    parts, depth, part = [], 0, ""
    for ch in text:
        depth += (ch in "([{") - (ch in ")]}")
        if ch == "," and depth == 0:
            parts.append(part)
            part = ""
        else:
            part += ch
    if depth:
        raise ValueError(f"unbalanced brackets in {text!r}")
    name, *rest = [p.strip() for p in [*parts, part]]
    values = {}
    for item in rest:
        key, sep, value = item.partition("=")
        if not sep:
            raise ValueError(f"no value in {item!r}")
        value = value.strip()
        values[key.strip()] = value[1:-1] if value[:1] == "(" and value[-1:] == ")" else value
    return name.upper(), values


def _sum(a: Column, b: Column, f: Callable) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    """The vector with elements as double."""
    return v.cast("array<double>")


def lp(a: Column, b: Column, order: float) -> Column:
    """Minkowski distance; order inf is the maximum, order must be positive."""
    if not order > 0:
        raise ValueError("order must be positive")
    a, b = doubles(a), doubles(b)
    if math.isinf(order):
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if order == 1:
        return _sum(a, b, lambda x, y: F.abs(x - y))
    if order == 2:
        return F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y)))
    if order == 0.5:
        root = _sum(a, b, lambda x, y: F.sqrt(F.abs(x - y)))
        return root * root
    return F.pow(_sum(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(float(order)))), F.lit(1.0 / order))


def l2squared(a: Column, b: Column) -> Column:
    """Sum of squared differences."""
    return _sum(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))


def hamming(a: Column, b: Column) -> Column:
    """Number of unequal coordinates."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)).cast("double")


def bits(a: Column, b: Column) -> Column:
    """Number of differing bits of whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


def chi2(a: Column, b: Column) -> Column:
    """One-sided chi-square: sum of (x - mean)^2 / mean where the mean of the pair is positive."""

    def term(x: Column, y: Column) -> Column:
        mean = (x + y) / 2
        return F.when(mean > 0, (x - mean) * (x - mean) / mean).otherwise(0.0)

    return _sum(doubles(a), doubles(b), term)


def hellinger(a: Column, b: Column) -> Column:
    """Square root of half the squared difference of square roots."""
    return F.sqrt(_sum(doubles(a), doubles(b), lambda x, y: (F.sqrt(x) - F.sqrt(y)) * (F.sqrt(x) - F.sqrt(y))) / 2)


def cosine_similarity(a: Column, b: Column, normalize: bool = True) -> Column:
    """Dot product, by the norms if normalize; 0 where a norm is 0."""
    a, b = doubles(a), doubles(b)
    dot = _sum(a, b, lambda x, y: x * y)
    if not normalize:
        return dot
    norm = F.sqrt(_sum(a, a, lambda x, y: x * y)) * F.sqrt(_sum(b, b, lambda x, y: x * y))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column, normalize: bool = True) -> Column:
    """Chord length sqrt(2 |1 - cos|); sqrt 2 where the similarity is 0."""
    cos = cosine_similarity(a, b, normalize)
    return F.when(cos == 0, F.lit(math.sqrt(2))).otherwise(F.sqrt(F.abs(1 - cos) * 2))


def dpf(a: Column, b: Column, order: float = 2, discard: int = 0, mode: str = "documented") -> Column:
    """Dynamic partial function: Lp over the differences left after ``discard`` were dropped.

    documented drops the largest differences; as_coded drops the smallest ones.
    """
    diff = F.array_sort(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))
    keep = F.greatest(F.size(diff) - discard, F.lit(0))
    kept = F.slice(diff, F.lit(1), keep) if mode == "documented" else F.slice(diff, F.lit(1 + discard), keep)
    total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.pow(x, F.lit(float(order))))
    return F.pow(total, F.lit(1.0 / order))


def multidistance(parts: list[Column], weights: list[float] | None = None, norms: list[float] | None = None) -> Column:
    """Weighted sum of distances, each divided by its norm (0 counts as 1); parts of weight 0 aren't evaluated."""
    weights = weights or [1.0] * len(parts)
    norms = norms or [1.0] * len(parts)
    if not len(parts) == len(weights) == len(norms):
        raise ValueError("parts, weights and norms need one length")
    terms = [(p / float(n or 1.0)) * float(w) for p, w, n in zip(parts, weights, norms) if w]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def _discard(p: dict[str, str], dims: int) -> int:
    if "pct_discard" in p:
        return min(dims, math.floor(dims * float(p["pct_discard"]) + 0.5))
    return min(dims, int(p.get("dims_discard", 0)))


def _flag(p: dict[str, str], default: bool = True) -> bool:
    return p.get("normalize_vectors", str(default)).lower() in ("true", "1", "yes")


def distance_column(text: str, a: Column, b: Column, dims: int | None = None) -> Column:
    """The expression of a named distance between two array columns; DPF with pct_discard needs dims."""
    name, p = parse_parameters(text)
    order = float(p.get("order", 2))
    makers: dict[str, Callable[[], Column]] = {
        "L1": lambda: lp(a, b, 1), "L2": lambda: lp(a, b, 2), "LMAX": lambda: lp(a, b, math.inf), "LP": lambda: lp(a, b, order), "L2SQUARED": lambda: l2squared(a, b), "HAMMING": lambda: hamming(a, b),
        "BITS": lambda: bits(a, b), "CHI2": lambda: chi2(a, b), "HELLINGER": lambda: hellinger(a, b), "COSINE_SIMILARITY": lambda: cosine_similarity(a, b, _flag(p)), "COSINE_DISTANCE": lambda: cosine_distance(a, b, _flag(p)),
        "DPF": lambda: dpf(a, b, order, _discard(p, dims or 0), p.get("mode", "documented")),
    }
    if name not in makers:
        raise ValueError(f"unknown distance {name}")
    return makers[name]()


def _each(q: np.ndarray, r: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """f of the pairwise differences, a few queries at a time."""
    step = max(1, 4_000_000 // max(1, r.size))
    return np.concatenate([f(q[i : i + step, None, :] - r[None]) for i in range(0, len(q), step)]) if len(q) else np.zeros((0, len(r)))


def _cos(q: np.ndarray, r: np.ndarray, normalize: bool) -> np.ndarray:
    dot = np.stack([(x * r).sum(1) for x in q]) if len(q) else np.zeros((0, len(r)))
    if not normalize:
        return dot
    norm = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((r * r).sum(1))[None]
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0)


def _chi2(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(r)))
    for i, x in enumerate(q):
        mean = (x + r) / 2
        out[i] = np.where(mean > 0, (x - mean) ** 2 / np.where(mean > 0, mean, 1), 0).sum(1)
    return out


def distance_kernel(text: str) -> Kernel:
    """The NumPy twin: (queries x dims, references x dims) -> queries x references."""
    name, p = parse_parameters(text)
    order = float(p.get("order", 2))

    def power(o: float) -> Kernel:
        if not o > 0:
            raise ValueError("order must be positive")
        if math.isinf(o):
            return lambda q, r: _each(q, r, lambda d: np.abs(d).max(2))
        if o == 2:
            return lambda q, r: _each(q, r, lambda d: np.sqrt((d * d).sum(2)))
        return lambda q, r: _each(q, r, lambda d: (np.abs(d) ** o).sum(2) ** (1 / o))

    def partial(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        drop = _discard(p, q.shape[1])

        def f(d: np.ndarray) -> np.ndarray:
            d = np.sort(np.abs(d), axis=2)
            d = d[:, :, : d.shape[2] - drop] if p.get("mode", "documented") == "documented" else d[:, :, drop:]
            return (d**order).sum(2) ** (1 / order)

        return _each(q, r, f)

    def chord(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        cos = _cos(q, r, _flag(p))
        return np.where(cos == 0, math.sqrt(2), np.sqrt(2 * np.abs(1 - cos)))

    makers: dict[str, Callable[[], Kernel]] = {
        "L1": lambda: power(1), "L2": lambda: power(2), "LMAX": lambda: power(math.inf), "LP": lambda: power(order), "L2SQUARED": lambda: lambda q, r: _each(q, r, lambda d: (d * d).sum(2)),
        "HAMMING": lambda: lambda q, r: _each(q, r, lambda d: (d != 0).sum(2).astype(float)), "BITS": lambda: lambda q, r: np.stack([np.bitwise_count(x.astype(np.int64) ^ r.astype(np.int64)).sum(1).astype(float) for x in q]) if len(q) else np.zeros((0, len(r))),
        "CHI2": lambda: _chi2, "HELLINGER": lambda: lambda q, r: _each(np.sqrt(q), np.sqrt(r), lambda d: np.sqrt((d * d).sum(2) / 2)), "COSINE_SIMILARITY": lambda: lambda q, r: _cos(q, r, _flag(p)), "COSINE_DISTANCE": lambda: chord,
        "DPF": lambda: partial, "EMD": lambda: emd_kernel(p),
    }
    if name in CUSTOM:
        return CUSTOM[name](p)
    if name not in makers:
        raise ValueError(f"unknown distance {name}")
    return makers[name]()


#: Distances that were registered: id -> function of the parameters that gives a kernel.
CUSTOM: dict[str, Callable[[dict[str, str]], Kernel]] = {}


def register_distance(name: str, factory: Callable[[dict[str, str]], Kernel]) -> None:
    """Makes a distance known under an id, for all block searches."""
    CUSTOM[name.upper()] = factory


def transport_cost(a: np.ndarray, b: np.ndarray, cost: np.ndarray) -> float:
    """Cost per unit of the cheapest flow from masses a to masses b (partial if the totals differ).

    Successive cheapest paths with potentials on the bipartite graph of sources
    and sinks. An empty side or a NaN gives infinity.
    """
    if np.isnan(a).any() or np.isnan(b).any() or a.sum() <= 0 or b.sum() <= 0:
        return math.inf
    left, right = a.astype(float).copy(), b.astype(float).copy()
    n, m = cost.shape
    flow = np.zeros((n, m))
    goal = min(left.sum(), right.sum())
    moved = total = 0.0
    eps = 1e-12 * goal
    up, vp = np.zeros(n), np.zeros(m)
    while goal - moved > eps:
        # Dijkstra over reduced costs; sinks relax back along positive flow
        du = np.where(left > eps, 0.0, np.inf)
        dv = np.full(m, np.inf)
        from_u, from_v = np.full(m, -1), np.full(n, -1)
        done_u, done_v = np.zeros(n, bool), np.zeros(m, bool)
        for _ in range(n + m):
            iu = np.where(done_u, np.inf, du)
            iv = np.where(done_v, np.inf, dv)
            i, j = int(iu.argmin()), int(iv.argmin())
            if iu[i] <= iv[j]:
                if math.isinf(iu[i]):
                    break
                done_u[i] = True
                reach = du[i] + np.maximum(cost[i] + up[i] - vp, 0)
                better = reach < dv - 1e-15
                dv[better], from_u[better] = reach[better], i
            else:
                done_v[j] = True
                back = flow[:, j] > eps
                reach = dv[j] - np.minimum(cost[:, j] + up - vp[j], 0)
                better = back & (reach < du - 1e-15)
                du[better], from_v[better] = reach[better], j
        ends = np.where(right > eps, dv + vp, np.inf)
        j = int(ends.argmin())
        if math.isinf(ends[j]):
            break
        path, amount, end = [], right[j], j
        while True:
            i = int(from_u[end])
            path.append((i, end, 1))
            if from_v[i] < 0:
                amount = min(amount, left[i])
                break
            before = int(from_v[i])
            amount = min(amount, flow[i, before])
            path.append((i, before, -1))
            end = before
        for i, k, sign in path:
            flow[i, k] += sign * amount
            total += sign * amount * cost[i, k]
        left[path[-1][0]] -= amount
        right[j] -= amount
        moved += amount
        top = dv[np.isfinite(dv)].max(initial=0.0)
        up += np.where(np.isfinite(du), np.minimum(du, top), top)
        vp += np.where(np.isfinite(dv), dv, top)
    return total / moved if moved else math.inf


def emd_kernel(p: dict[str, str]) -> Kernel:
    """Earth mover's distance; matrix_dims=RxC and matrix=v;v;.. give the cost, |i - j| by default."""

    def run(q: np.ndarray, r: np.ndarray) -> np.ndarray:
        if "matrix" not in p and _flag(p, False) and (q >= 0).all() and (r >= 0).all():
            # equal masses on a line: the cost is the area between the cumulative masses
            share = lambda x: np.cumsum(x, axis=1) / np.where(x.sum(1, keepdims=True) > 0, x.sum(1, keepdims=True), np.nan)
            area = _each(share(q), share(r), lambda d: np.abs(d[:, :, :-1]).sum(2))
            return np.where(np.isnan(area), np.inf, area)
        if "matrix" in p:
            rows, cols = map(int, p["matrix_dims"].lower().split("x"))
            cost = np.array([float(x) for x in p["matrix"].split(";")]).reshape(rows, cols)
        else:
            cost = np.abs(np.arange(q.shape[1])[:, None] - np.arange(r.shape[1])[None]).astype(float)
        if cost.shape != (q.shape[1], r.shape[1]):
            raise ValueError("the cost matrix doesn't fit the vectors")
        if _flag(p, False):
            q, r = (x / np.where(x.sum(1, keepdims=True) > 0, x.sum(1, keepdims=True), 1) for x in (q, r))
        return np.array([[transport_cost(x, y, cost) for y in r] for x in q]).reshape(len(q), len(r))

    return run
