"""Numpy reductions over sorted segments of flat arrays (segment ids ascending)."""

from __future__ import annotations

import numpy as np


def list_parts(col) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number per item and the struct fields (float64, None as NaN) of an Arrow list<struct> column."""
    col = col.combine_chunks() if hasattr(col, "combine_chunks") else col
    if hasattr(col, "chunks"):
        import pyarrow as pa

        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], type=col.type)
    lengths = np.diff(col.offsets.to_numpy(zero_copy_only=False))
    flat = col.flatten()
    fields = []
    for k in range(flat.type.num_fields):
        f = flat.field(k)
        if f.null_count:
            f = f.cast("float64").fill_null(float("nan"))
        fields.append(f.to_numpy(zero_copy_only=False))
    return np.repeat(np.arange(len(lengths)), lengths), fields


def medians(seg: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Median of v per segment 0..n-1, NaN where a segment has none."""
    out = np.full(n, np.nan)
    if len(v):
        o = np.lexsort((v, seg))
        s, x = seg[o], v[o]
        count = np.bincount(s, minlength=n)
        start = np.cumsum(count) - count
        has = count > 0
        lo, hi = start[has] + (count[has] - 1) // 2, start[has] + count[has] // 2
        out[has] = (x[lo] + x[hi]) / 2
    return out


#: Bins of `tail_bins` for a doubling of the value; values below the first edge share the lowest bin, those above the last the highest.
PER_DOUBLING, LOWEST, HIGHEST = 20, -5 * 20, 12 * 20


def tail_bins(v: np.ndarray) -> np.ndarray:
    """Logarithmic bin of every value >= 0."""
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(PER_DOUBLING * np.log2(v)), LOWEST, HIGHEST).astype(np.int32)


def tail_cutoff(bins: np.ndarray, count: np.ndarray, risk: float, top: float = 0.15, seen: float = 0.5, least: int = 20, usual: float = 0.1) -> float:
    """Peaks over threshold: the level that a value exceeds with probability `risk`, from counts by `tail_bins`.

    The threshold is the bin edge that a share of at most `top` of all values exceeds. A generalised Pareto law is fitted
    to the excesses by maximum likelihood over bins, first with those beyond the share `seen` right-censored, so that the
    spikes which the level is to tell apart don't draw it up, then with all up to the level found, of those beyond it no
    more than the risk allows for. The shape has a normal prior about 0, an exponential tail, of deviation `usual`, which
    only few excesses leave any weight. NaN where there are fewer than `least` excesses, or where fewer than half the
    share `top` are positive.
    """
    o = np.argsort(bins)
    b, c = bins[o], count[o].astype(float)
    total = c.sum()
    above = np.r_[np.cumsum(c[::-1])[::-1], 0.0]  # values in this bin or higher
    k = int(np.argmax(above <= top * total))
    if above[k] < least or above[k] < top * total / 2 or b[min(k, len(b) - 1)] <= LOWEST:
        return float("nan")
    edge = lambda x: 2.0 ** (x / PER_DOUBLING)
    u = edge(b[k])
    lo, hi = edge(b[k:]) - u, edge(b[k:] + 1.0) - u
    last = int(np.searchsorted(np.cumsum(c[k:]), seen * above[k])) + 1
    beyond, level = above[k + last], 0.0
    for _ in range(4):
        level = _pareto_level(lo[:last], hi[:last], c[k : k + last], beyond, total, risk, usual)
        last = max(int(np.searchsorted(hi, level)), 1)
        beyond = min(above[k + last], risk * total)
    return float(u + level)


def _pareto_level(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, beyond: float, total: float, risk: float, usual: float) -> float:
    """Excess at `risk` of the generalised Pareto law most likely for n values between lo and hi and `beyond` above them."""
    far, tiny = hi[-1], 1e-300
    edges = np.r_[lo, far]
    shape, scale = np.linspace(-0.5, 1.0, 16), far * np.geomspace(0.02, 20, 40)
    for _ in range(2):  # a coarse grid, then a fine one around its best
        g, s = shape[:, None, None], scale[None, :, None]
        flat = np.abs(g) < 1e-9

        def stays(x: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return np.where(flat, np.exp(-x / s), np.maximum(1 + g * x / s, 0) ** (-1 / np.where(flat, 1, g)))

        below = stays(edges)
        upper = below[..., 1:] if np.array_equal(hi[:-1], lo[1:]) else stays(hi)
        like = (n * np.log(np.maximum(below[..., :-1] - upper, tiny))).sum(-1) + beyond * np.log(np.maximum(below[..., -1], tiny))
        like -= (shape[:, None] / usual) ** 2 / 2
        i, j = np.unravel_index(int(like.argmax()), like.shape)
        best, width = (shape[i], scale[j]), (shape[1] - shape[0], scale[1] / scale[0])
        shape = np.clip(best[0] + width[0] * np.linspace(-1, 1, 9), -0.5, 1.0)
        scale = best[1] * width[1] ** np.linspace(-1, 1, 9)
    r = max((n.sum() + beyond) / total / risk, 1.0)
    return float(best[1] * np.log(r) if abs(best[0]) < 1e-9 else best[1] / best[0] * (r ** best[0] - 1))
