"""NumPy kernels of Tier B: batched correlation and refinement of many points of one geometry."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from shiftgrid.functions.scalar import next_fft_size, refinement_matrix
from shiftgrid.registry import Similarity

EPS32 = float(np.finfo(np.float32).eps)
PATCH = 5


def _box(sq: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums of all h x w boxes of a batch, by summed-area tables in double."""
    t = np.zeros((sq.shape[0], sq.shape[1] + 1, sq.shape[2] + 1))
    np.cumsum(sq, axis=1, out=t[:, 1:, 1:])
    np.cumsum(t[:, 1:, 1:], axis=2, out=t[:, 1:, 1:])
    return t[:, h:, w:] - t[:, :-h, w:] - t[:, h:, :-w] + t[:, :-h, :-w]


def spread(image: np.ndarray, h: int, w: int, measure: str) -> np.ndarray:
    """The norm (of what the measure divides by) of every h x w box of images (B, rows, columns)."""
    n = h * w
    if measure == "coherence":
        s2 = _box(image.real.astype(np.float64) ** 2 + image.imag.astype(np.float64) ** 2, h, w)
        power = s2 - (_box(image.real, h, w) ** 2 + _box(image.imag, h, w) ** 2) / n
    else:
        x = image.astype(np.float64)
        if measure == "zncc":  # unchanged by a constant, and sums about the mean cancel less
            x -= x.mean(axis=(1, 2), keepdims=True)
        s2 = _box(x * x, h, w)
        power = s2 - _box(x, h, w) ** 2 / n if measure == "zncc" else s2
    # Differences of sums leave noise of their own size, which is not texture.
    return np.sqrt(np.where(power > 1e-12 * s2, power, 0.0))


def surfaces(chips: np.ndarray, windows: np.ndarray, measure: str | Similarity = "zncc", norms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Scores (B, 2 ry, 2 rx) and whether each chip has texture; without it the surface is zeros.

    ``norms``: the windows' boxes' norms where they were taken from a table of the whole image. ``measure``: a built-in
    name, or a method of one's own.
    """
    b, ch, cw = chips.shape
    _, wh, ww = windows.shape
    complex_ = np.iscomplexobj(chips)
    own = measure if isinstance(measure, Similarity) else None
    if complex_ != (own.complex_ if own else measure == "coherence"):
        raise ValueError(f"`similarity` {own.name if own else measure} does not fit {'complex' if complex_ else 'real'} images")
    t = chips - chips.mean(axis=(1, 2), keepdims=True, dtype=np.complex128 if complex_ else np.float64)
    tt = np.einsum("bij,bij->b", t, t.conj()).real
    ok = tt > EPS32 * ch * cw
    fy, fx = next_fft_size(wh), next_fft_size(ww)
    ny, nx = wh - ch + 1, ww - cw + 1
    # Correlation theorem; wrapped-around places are only those left of the chip, which are cut off.
    if complex_:
        f = np.fft.fft2(windows, (fy, fx)) * np.conj(np.fft.fft2(t, (fy, fx)))
        num = np.fft.ifft2(f)[:, :ny, :nx]
        num = num if own else np.abs(num)
    else:
        f = np.fft.rfft2(windows.astype(np.float32, copy=False), (fy, fx))
        f *= np.conj(np.fft.rfft2(t.astype(np.float32), (fy, fx)))
        num = np.fft.irfft(np.fft.ifft(f, axis=1)[:, :ny], fx, axis=2)[:, :, :nx]
    if own:
        score = np.nan_to_num(own.arrays(_sums(chips, windows, num, tt, ch * cw)), nan=-np.inf).astype(np.float32)
        score[~ok] = 0.0
        return score, ok
    den = (spread(windows, ch, cw, measure) if norms is None else norms) * np.sqrt(tt)[:, None, None]
    score = np.zeros((b, ny, nx), np.float32)
    np.divide(num, den, out=score, where=den > 0, casting="same_kind")
    score[~ok] = 0.0
    return score, ok


def _sums(chips: np.ndarray, windows: np.ndarray, num: np.ndarray, tt: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """What a similarity of one's own is made of, at every shift."""
    h, w = chips.shape[1:]
    each = lambda a: a[:, None, None]
    if np.iscomplexobj(chips):
        s2 = _box(windows.real.astype(np.float64) ** 2 + windows.imag.astype(np.float64) ** 2, h, w)
        return {"re": num.real, "im": num.imag, "s1_re": _box(windows.real, h, w), "s1_im": _box(windows.imag, h, w), "s2": s2, "tt": each(tt), "n": n}
    x = windows.astype(np.float64)
    return {"num": num, "s1": _box(x, h, w), "s2": _box(x * x, h, w), "tt": each(tt), "n": n, "mean": each(chips.mean(axis=(1, 2), dtype=np.float64))}


@lru_cache(maxsize=8)
def _matrix(upsampling: int) -> np.ndarray:
    return np.ascontiguousarray(refinement_matrix(PATCH, upsampling).astype(np.float32))


def peaks(surf: np.ndarray, upsampling: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dx, dy, score) about zero shift: the first maximum row by row, refined if the surface holds a patch."""
    b, nr, nc = surf.shape
    k = surf.reshape(b, -1).argmax(1)
    i, j = np.divmod(k, nc)
    best = surf.reshape(b, -1)[np.arange(b), k].astype(np.float64)
    row, col = i.astype(np.float64), j.astype(np.float64)
    if upsampling > 1 and nr >= PATCH and nc >= PATCH:
        i0 = np.clip(i - PATCH // 2, 0, nr - PATCH)
        j0 = np.clip(j - PATCH // 2, 0, nc - PATCH)
        p = np.lib.stride_tricks.sliding_window_view(surf, (PATCH, PATCH), axis=(1, 2))[np.arange(b), i0, j0]
        c = _matrix(upsampling)
        n = len(c)
        for s in range(0, b, 16):  # a few hundred kilobytes a point: stay within the cache
            up = (c @ p[s : s + 16] @ c.T).reshape(-1, n * n)
            at = up.argmax(1)
            best[s : s + 16] = up[np.arange(len(up)), at]
            y, x = np.divmod(at, n)
            row[s : s + 16] = y / upsampling + i0[s : s + 16]
            col[s : s + 16] = x / upsampling + j0[s : s + 16]
    return col - nc // 2, row - nr // 2, best


def _means(x: np.ndarray, w: int) -> np.ndarray:
    """Sums over w x w windows clipped at the edges; even widths begin one before the middle."""
    before, after = w // 2, w - 1 - w // 2
    t = np.pad(np.cumsum(np.cumsum(x, 0, dtype=np.float64), 1), ((1, 0), (1, 0)))
    i, j = np.arange(x.shape[0]), np.arange(x.shape[1])
    lo_i, hi_i = np.maximum(i - before, 0), np.minimum(i + after, len(i) - 1) + 1
    lo_j, hi_j = np.maximum(j - before, 0), np.minimum(j + after, len(j) - 1) + 1
    rows = t[hi_i] - t[lo_i]  # whole rows are taken faster than single places
    return np.take(rows, hi_j, 1) - np.take(rows, lo_j, 1)


def _counts(shape: tuple[int, int], w: int) -> np.ndarray:
    """Places of the windows of :func:`_means` that lie within the array."""
    before, after = w // 2, w - 1 - w // 2
    n = [np.minimum(np.arange(s) + after, s - 1) + 1.0 - np.maximum(np.arange(s) - before, 0) for s in shape]
    return n[0][:, None] * n[1]


def prepare(v: np.ndarray, filter_width: int, quantize: bool, own_filter=None, own_quantize=None) -> tuple[np.ndarray, np.ndarray]:
    """A scene high-passed (unless the width is 0) and quantized as the tables do it: values and validity.

    ``own_filter(x, ok)`` and ``own_quantize(x, ok)`` stand for either where they are given.
    """
    ok = np.isfinite(v)
    x = np.where(ok, v, 0.0).astype(np.float64)
    if own_filter:
        x, ok = own_filter(x, ok)
        x = np.where(ok, x, 0.0)
    elif filter_width:
        whole = bool(ok.all())
        middle = (x if whole else x[ok]).mean() if ok.any() else 0.0  # sums about the mean cancel less
        x = x - middle if whole else np.where(ok, x - middle, 0.0)
        n = _counts(x.shape, filter_width) if whole else _means(ok.astype(np.float64), filter_width)
        x -= _means(x, filter_width) / np.maximum(n, 1)
        if not whole:
            ok = ok & (_means((~ok).astype(np.float64), filter_width) < 0.5)
            x = np.where(ok, x, 0.0)
    if own_quantize:
        x = np.where(ok, own_quantize(x, ok), 0.0)
    elif quantize:
        good = x if ok.all() else x[ok]
        mean, sd = (good.mean(), good.std(ddof=1)) if good.size > 1 else (0.0, 0.0)
        scaled = np.rint(np.clip((x - (mean - 3 * sd)) * (255.0 / (6 * sd)), 0, 255)) if sd > 0 else np.full(x.shape, 128.0)
        x = np.where(ok, scaled, 0.0)
    return x.astype(np.float32), ok


def rotate(chips: np.ndarray, degrees: float) -> np.ndarray:
    """Chips turned about their centre, bilinear, outside 0."""
    if degrees == 0:
        return chips
    _, h, w = chips.shape
    a = np.deg2rad(degrees)
    yc, xc = (h + 1) / 2, (w + 1) / 2
    dy, dx = np.meshgrid(np.arange(1, h + 1) - yc, np.arange(1, w + 1) - xc, indexing="ij")
    sy, sx = yc + np.cos(a) * dy + np.sin(a) * dx, xc - np.sin(a) * dy + np.cos(a) * dx
    i0, j0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    inside = (i0 >= 1) & (j0 >= 1) & (i0 + 1 <= h) & (j0 + 1 <= w)
    i, j = np.clip(i0 - 1, 0, h - 2), np.clip(j0 - 1, 0, w - 2)
    fy, fx = sy - i0, sx - j0
    out = (1 - fy) * ((1 - fx) * chips[:, i, j] + fx * chips[:, i, j + 1]) + fy * ((1 - fx) * chips[:, i + 1, j] + fx * chips[:, i + 1, j + 1])
    return np.where(inside, out, 0)


def track(ref: np.ndarray, sec: np.ndarray, valid: np.ndarray, pts: dict[str, np.ndarray], r0: int, c0: int, upsampling: int, measure: str | Similarity = "zncc",
          angles: tuple[float, ...] = (0.0,), batch: int = 16) -> dict[str, np.ndarray]:
    """Correlate points over image arrays whose first pixel is (r0, c0); ``pts`` are image coordinates.

    Returns dx, dy, correlation (NaN where nothing was measured) and searched, in the points' order.
    """
    n = len(pts["x"])
    out = {k: np.full(n, np.nan) for k in ("dx", "dy", "correlation")} | {"searched": np.zeros(n, bool)}
    rx, ry, cx, cy = (pts[k].astype(int) for k in ("radius_x", "radius_y", "chip_x", "chip_y"))
    # Half a pixel on, to which an even chip's centre refers; then places in the arrays.
    at_x, at_y = np.floor(pts["x"] + 0.5 - pts["dx_prior"]).astype(int), np.floor(pts["y"] + 0.5 - pts["dy_prior"]).astype(int)
    win_x, win_y = np.floor(pts["x"] + 0.5).astype(int), np.floor(pts["y"] + 0.5).astype(int)
    live = np.flatnonzero((rx > 0) & (ry > 0))
    shapes: dict[tuple, list] = {}
    for k in live:
        shapes.setdefault((rx[k], ry[k], cx[k], cy[k]), []).append(k)
    for (prx, pry, pcx, pcy), own in shapes.items():
        own = np.array(own)
        hx, hy = pcx // 2, pcy // 2
        # Only what these points' chips and windows touch: tables of the whole tile cost more than its points.
        cut_y = _span(ref.shape[0], own, (at_y - hy - r0, 2 * hy), (win_y - hy - pry - r0, 2 * (hy + pry) - 1))
        cut_x = _span(ref.shape[1], own, (at_x - hx - c0, 2 * hx), (win_x - hx - prx - c0, 2 * (hx + prx) - 1))
        top, left, size = r0 + cut_y.start, c0 + cut_x.start, (cut_y.stop - cut_y.start, cut_x.stop - cut_x.start)
        pad_y, pad_x = _outside(size, own, at_y - hy - top, 2 * hy, at_x - hx - left, 2 * hx, win_y - hy - pry - top, 2 * (hy + pry) - 1, win_x - hx - prx - left, 2 * (hx + prx) - 1)

        def pad(a):
            a = a[cut_y, cut_x]  # noqa: B023
            return np.pad(a, ((pad_y, pad_y), (pad_x, pad_x))) if pad_y or pad_x else a  # noqa: B023

        a, b, v = pad(ref), pad(sec), pad(valid)
        view = np.lib.stride_tricks.sliding_window_view
        chips_of, win_of, ok_of = view(b, (2 * hy, 2 * hx)), view(a, (2 * (hy + pry) - 1, 2 * (hx + prx) - 1)), view(v, (2 * hy, 2 * hx))
        # Windows overlap: norms of all boxes of the image are taken once, from one table, and shared by its points.
        norm_of = None if isinstance(measure, Similarity) else view(spread(a[None], 2 * hy, 2 * hx, measure)[0], (2 * pry, 2 * prx))
        for s in range(0, len(own), batch):
            k = own[s : s + batch]
            iy, ix = at_y[k] - hy - top + pad_y, at_x[k] - hx - left + pad_x
            real = ok_of[iy, ix].any(axis=(1, 2))
            out["searched"][k] = real
            k, iy, ix = k[real], iy[real], ix[real]
            if not len(k):
                continue
            wy, wx = win_y[k] - hy - pry - top + pad_y, win_x[k] - hx - prx - left + pad_x
            chips, wins, norms = chips_of[iy, ix], win_of[wy, wx], None if norm_of is None else norm_of[wy, wx]
            surf, ok = surfaces(rotate(chips, angles[0]), wins, measure, norms)
            for angle in angles[1:]:
                other, fine = surfaces(rotate(chips, angle), wins, measure, norms)
                height = np.where(ok, surf.max(axis=(1, 2)), -np.inf)
                better = fine & (other.max(axis=(1, 2)) > height)
                surf[better], ok = other[better], ok | fine
            dx, dy, best = peaks(surf, upsampling)
            out["dx"][k] = np.where(ok, dx + pts["dx_prior"][k], np.nan)
            out["dy"][k] = np.where(ok, dy + pts["dy_prior"][k], np.nan)
            out["correlation"][k] = np.where(ok, best, np.nan)
    return out


def _span(n: int, own, *ranges) -> slice:
    """The part of an axis of ``n`` places that any of the points' ranges (start, length) touch."""
    low, high = min(int(start[own].min()) for start, _ in ranges), max(int(start[own].max()) + length for start, length in ranges)
    low = min(max(low, 0), n)
    return slice(low, max(low, min(high, n)))


def _outside(shape, own, *ranges) -> tuple[int, int]:
    """How far any of the points' chips or windows leave the arrays, along y and x."""
    need = [0, 0]
    for axis in (0, 1):
        for start, length in (ranges[2 * axis : 2 * axis + 2], ranges[4 + 2 * axis : 6 + 2 * axis]):
            s = start[own]
            need[axis] = max(need[axis], -int(s.min()), int(s.max()) + length - shape[axis])
    return max(0, need[0]), max(0, need[1])
