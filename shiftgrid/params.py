"""Parameters: resolved and checked once on the driver, immutable from there on."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from shiftgrid import registry

#: The names that a choice without methods of one's own may have.
SUBPIXEL = ("pyramid", "none")


def _choice(name: str, value: str, options: tuple[str, ...]) -> str:
    if value not in options:
        raise ValueError(f"`{name}` is {value!r}; it may be {', '.join(options)}")
    return value


def _whole(name: str, value, least: int | None = None) -> int:
    if isinstance(value, bool) or value != int(value):
        raise ValueError(f"`{name}` must be a whole number, got {value!r}")
    if least is not None and value < least:
        raise ValueError(f"`{name}` must be at least {least}, got {value}")
    return int(value)


def _positive(name: str, value: float) -> float:
    if not value > 0:
        raise ValueError(f"`{name}` must be positive, got {value}")
    return value


def _fraction(name: str, value: float, above_zero: bool = False) -> float:
    if not (0 < value <= 1 if above_zero else 0 <= value <= 1):
        raise ValueError(f"`{name}` must be in {'(' if above_zero else '['}0, 1], got {value}")
    return float(value)


def _odd(name: str, value: int, least: int) -> int:
    if _whole(name, value, least) % 2 == 0:
        raise ValueError(f"`{name}` must be odd, got {value}")
    return int(value)


@dataclass(frozen=True)
class Preprocess:
    kind: str = "highpass"
    width: int = 5
    min_std: float = 0.0
    axis: str = "both"

    def __post_init__(self):
        registry.own("preprocess", self.kind)
        _odd("filter_width", self.width, 3)
        _choice("axis", self.axis, ("x", "y", "both"))
        if self.min_std < 0:
            raise ValueError(f"`min_std` must be at least 0, got {self.min_std}")


@dataclass(frozen=True)
class Gardner:
    """Two-stage outlier filter: agreement with neighbours, then distance from their median."""

    window: int = 5
    iterations: int = 3
    min_agree_fraction: float = 8 / 25
    agree_tolerance: float = 0.2
    mad_scale: float = 4.0

    def __post_init__(self):
        _odd("outlier_window", self.window, 3)
        _whole("outlier_iterations", self.iterations, 1)
        _fraction("min_agree_fraction", self.min_agree_fraction)
        _fraction("agree_tolerance", self.agree_tolerance, above_zero=True)
        _positive("mad_scale", self.mad_scale)

    @property
    def reach(self) -> int:
        """How many points away all passes together look."""
        return (self.iterations + max(self.iterations - 1, 1)) * (self.window // 2)

    def relaxed(self) -> Gardner:
        """For a decimated grid: one iteration fewer, at least one."""
        return replace(self, iterations=max(1, self.iterations - 1))


@dataclass(frozen=True)
class Rotation:
    """Chip rotations in degrees that are tried; each is turned back by ``about``, the scene's own."""

    angles: tuple[float, ...] = (-6.0, -3.0, 0.0, 3.0, 6.0)
    about: float = 0.0

    def __post_init__(self):
        if not self.angles:
            raise ValueError("`rotation` needs at least one angle")

    def tried(self) -> tuple[float, ...]:
        return tuple(a - self.about for a in self.angles)


@dataclass(frozen=True)
class Params:
    similarity: tuple[str, ...] = ("zncc",)
    preprocess: Preprocess = field(default_factory=Preprocess)
    quantize: str = "uint8"
    upsampling: int = 64
    outliers: Gardner | registry.OutlierFilter | None = field(default_factory=Gardner)
    rotation: Rotation | None = None
    chip_size: int = 32
    chip_size_min: int = 32
    chip_size_max: int = 128
    chip_aspect: float = 1.0
    grid_spacing: int = 32
    radius_x: int = 25
    radius_y: int = 25
    min_search_radius: int = 6
    coarse_stride: int = 4
    coarse_buffer: int = 8
    min_coarse_valid_fraction: float = 0.01
    dx_prior: float = 0.0
    dy_prior: float = 0.0
    fill_window: int = 3

    def chip_sizes(self) -> tuple[int, ...]:
        """Levels, finest first: doublings of ``chip_size`` within the bounds."""
        out, cs = [], self.chip_size
        while cs <= self.chip_size_max:
            if cs >= self.chip_size_min:
                out.append(cs)
            cs *= 2
        return tuple(out)

    def chip_height(self, chip_size: int) -> int:
        """Even, rounded half to even."""
        return 2 * round(chip_size * self.chip_aspect / 2)

    def measures(self) -> tuple[str, ...]:
        """The similarity of each level; the last named one repeats, too many are an error."""
        levels = self.chip_sizes()
        if len(self.similarity) > len(levels):
            raise ValueError(f"`similarity` names {len(self.similarity)} measures for {len(levels)} chip sizes; name fewer, or widen the sizes")
        return tuple(self.similarity[min(k, len(self.similarity) - 1)] for k in range(len(levels)))


_UNSET = object()


def params(
    *, similarity="zncc", preprocess="highpass", quantize="uint8", subpixel="pyramid", filter_width=_UNSET, upsampling=64,
    chip_size=32, chip_size_min=_UNSET, chip_size_max=_UNSET, chip_aspect=1.0, grid_spacing=_UNSET, search_radius=25,
    search_radius_x=_UNSET, search_radius_y=_UNSET, min_search_radius=6, dx_prior=0.0, dy_prior=0.0, coarse_stride=4, coarse_buffer=8,
    min_coarse_valid_fraction=0.01, rotation=None, outliers="gardner", outlier_window=_UNSET, outlier_iterations=_UNSET,
    min_agree_fraction=_UNSET, agree_tolerance=_UNSET, mad_scale=_UNSET, fill_window=3,
) -> Params:
    """Check every keyword and resolve defaults that depend on others. Errors name the keyword."""
    names = (similarity,) if isinstance(similarity, str) else tuple(similarity)
    if not names:
        raise ValueError("`similarity` names no measure")
    for s in names:
        registry.own("similarity", s)
    if isinstance(preprocess, Preprocess):
        if filter_width is not _UNSET:
            raise ValueError("`filter_width` has no effect beside a `preprocess` that has its own width")
        pre = preprocess
    else:
        registry.own("preprocess", preprocess)
        pre = Preprocess(preprocess, 5 if filter_width is _UNSET else filter_width, 0.25 if preprocess == "wallis_gapfill" else 0.0)
    registry.own("quantize", quantize)
    _choice("subpixel", subpixel, SUBPIXEL)
    up = _whole("upsampling", upsampling, 2)
    if up & (up - 1):
        raise ValueError(f"`upsampling`: peaks are refined by doublings, which never give {upsampling}")

    loose = {k: v for k, v in dict(window=outlier_window, iterations=outlier_iterations, min_agree_fraction=min_agree_fraction, agree_tolerance=agree_tolerance, mad_scale=mad_scale).items() if v is not _UNSET}
    if not isinstance(outliers, str) and outliers is not None:
        if loose:
            raise ValueError(f"outlier keywords ({', '.join(loose)}) have no effect beside an `outliers` that has its own")
        out = outliers
    elif (own := registry.own("outliers", outliers)) or outliers == "none":
        if loose:
            raise ValueError(f"outlier keywords ({', '.join(loose)}) have no effect with `outliers` {outliers}")
        out = own
    else:
        out = Gardner(**loose)

    def chip(name: str, value) -> int:
        if _whole(name, value, 1) % 4:
            raise ValueError(f"`{name}`: {value} cannot be halved twice into whole pixels; take a multiple of 4 above zero")
        return int(value)

    base = chip("chip_size", chip_size)
    low = base if chip_size_min is _UNSET else chip("chip_size_min", chip_size_min)
    high = 4 * base if chip_size_max is _UNSET else chip("chip_size_max", chip_size_max)
    if low > high:
        raise ValueError(f"no chip size lies between `chip_size_min` {low} and `chip_size_max` {high}")
    if base > low:
        raise ValueError(f"`chip_size_min` {low} lies below `chip_size` {base}, from which sizes only grow")
    if high % base or (high // base) & (high // base - 1):
        raise ValueError(f"doubling `chip_size` {base} never gives `chip_size_max` {high}")

    rx, ry = search_radius if isinstance(search_radius, (tuple, list)) else (search_radius, search_radius)
    rx = _whole("search_radius_x", rx if search_radius_x is _UNSET else search_radius_x, 0)
    ry = _whole("search_radius_y", ry if search_radius_y is _UNSET else search_radius_y, 0)
    if rx == 0 and ry == 0:
        raise ValueError("`search_radius`: with none along x and none along y there is no shift to try")

    if rotation is None or rotation is False:
        rot = None
    elif rotation is True:
        rot = Rotation()
    else:
        rot = rotation if isinstance(rotation, Rotation) else Rotation(tuple(float(a) for a in rotation))
    return Params(
        similarity=names, preprocess=pre, quantize=quantize, upsampling=up if subpixel == "pyramid" else 1, outliers=out, rotation=rot,
        chip_size=base, chip_size_min=low, chip_size_max=high, chip_aspect=float(_positive("chip_aspect", chip_aspect)),
        grid_spacing=base if grid_spacing is _UNSET else _whole("grid_spacing", _positive("grid_spacing", grid_spacing)),
        radius_x=rx, radius_y=ry, min_search_radius=_whole("min_search_radius", min_search_radius),
        coarse_stride=_whole("coarse_stride", _positive("coarse_stride", coarse_stride)), coarse_buffer=_whole("coarse_buffer", coarse_buffer),
        min_coarse_valid_fraction=_fraction("min_coarse_valid_fraction", min_coarse_valid_fraction),
        dx_prior=float(dx_prior), dy_prior=float(dy_prior), fill_window=_odd("fill_window", fill_window, 1),
    )


def search_margin(chip: int, radius: int) -> int:
    """Pixels that a search centre keeps from an edge, so that its window lies within the image."""
    return math.ceil(chip / 2) + radius + 1
