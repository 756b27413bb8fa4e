"""Methods of one's own, by name: similarities, filters, quantizations, outlier filters, sources of matches.

A method has a form for tables (columns in, columns out) and one for Arrow tasks (arrays in, arrays out). Names are
resolved when a plan is made, and the method itself travels with the plan, so workers need no registry. Built-in names
can't be taken.

>>> register("similarity", Similarity("closeness", columns=..., arrays=...))
>>> track_pair(a, b, shape, similarity="closeness")
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

#: The built-in names of each kind.
BUILT_IN = {
    "similarity": ("zncc", "ncc", "coherence"),
    "preprocess": ("none", "highpass", "wallis", "wallis_gapfill", "sobel", "laplacian", "decibel", "deramp"),
    "quantize": ("uint8", "none"),
    "outliers": ("gardner", "none"),
    "matches": ("corners",),
}


@dataclass(frozen=True)
class Similarity:
    """A score of a chip at each shift, from sums: ``num`` (of t w), ``tt`` (of t t), ``s1`` and ``s2`` (of w and w w), ``n``
    pixels and the chip's ``mean``, where t is the chip less its mean and w the window's pixels under it.

    ``complex_``: of complex images; then ``re`` and ``im`` are of conj(t) w, ``s1_re`` and ``s1_im`` of w, ``s2`` and ``tt``
    of squared sizes. Scores are compared, the highest wins; null (NaN in arrays) is never taken.
    """

    name: str
    columns: Callable[[Mapping[str, Any]], Any]
    arrays: Callable[[Mapping[str, Any]], Any] | None = None
    complex_: bool = False


@dataclass(frozen=True)
class Filter:
    """``columns(pixels, preprocess, shape)`` to pixels with v (or z) and valid; ``arrays(v, ok, preprocess)`` to both, for scenes
    as planes. ``complex_``: of complex images, of real ones, or None of either."""

    name: str
    columns: Callable
    arrays: Callable | None = None
    complex_: bool | None = False


@dataclass(frozen=True)
class Quantize:
    """``columns(pixels)`` and ``arrays(v, ok)``: values of filtered images as they are correlated."""

    name: str
    columns: Callable
    arrays: Callable | None = None


@dataclass(frozen=True)
class OutlierFilter:
    """What to keep of a field. ``columns(field, upsampling, shape)`` adds ``keep``; ``arrays(dx, dy, radius_x, radius_y,
    upsampling, shape)`` is true where a place is kept, NaN is missing. ``window``: the least points of a grid's axis that it
    can judge. ``reach``: how many points away all its passes look. ``coarse``: what stands for it on a decimated grid."""

    name: str
    columns: Callable
    arrays: Callable
    window: int = 1
    reach: int = 0
    coarse: Any = None

    def relaxed(self):
        return self.coarse or self


@dataclass(frozen=True)
class Matches:
    """``find(session, pairs, **options)`` to ``(pair_id, m_id, r, c, dx, dy)``: matches of image pairs."""

    name: str
    find: Callable


_OWN: dict[str, dict[str, Any]] = {k: {} for k in BUILT_IN}


def register(kind: str, method: Any, replace: bool = False) -> Any:
    """Make ``method`` known by its name. A name that is taken is an error, unless it is one's own and ``replace`` is set."""
    if kind not in _OWN:
        raise ValueError(f"kind: {kind!r} is none of {', '.join(_OWN)}")
    if method.name in BUILT_IN[kind] or (method.name in _OWN[kind] and not replace):
        raise ValueError(f"`{kind}` has a method {method.name!r} already")
    _OWN[kind][method.name] = method
    return method


def unregister(kind: str, name: str) -> None:
    _OWN[kind].pop(name, None)


def names(kind: str) -> tuple[str, ...]:
    return (*BUILT_IN[kind], *_OWN[kind])


def own(kind: str, name: str) -> Any | None:
    """The registered method of that name, None for a built-in one; another name is an error that lists all."""
    if name not in names(kind):
        raise ValueError(f"`{kind}` is {name!r}; it may be {', '.join(names(kind))}")
    return _OWN[kind].get(name)
