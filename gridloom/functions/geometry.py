"""Column expressions of reciprocal- and real-space geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def q_vector(ub: Column | Sequence[float], h: Column, k: Column, l: Column) -> tuple[Column, Column, Column]:
    """Cartesian components of UB·(h, k, l); ub is an array column of nine doubles (row-major) or nine numbers."""
    m = [ub[i] for i in range(9)] if isinstance(ub, Column) else [F.lit(float(x)) for x in ub]
    return tuple(m[3 * r] * h + m[3 * r + 1] * k + m[3 * r + 2] * l for r in range(3))  # type: ignore[return-value]


def length(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def q_magnitude(ub: Column | Sequence[float], h: Column, k: Column, l: Column) -> Column:
    """|Q|, always in double precision."""
    return length(*q_vector(ub, h.cast("double"), k.cast("double"), l.cast("double")))


def azimuth(x: Column, y: Column) -> Column:
    """Angle in the plane, in [0, 2π)."""
    return F.pmod(F.atan2(y, x) + 2 * F.lit(3.141592653589793), F.lit(2 * 3.141592653589793))


def cell_to_metric(a: Column, b: Column, c: Column, al: Column, be: Column, ga: Column) -> list[Column]:
    """Real-space metric tensor (row-major, nine columns) from lengths and angles in degrees."""
    ca, cb, cg = (F.cos(F.radians(x)) for x in (al, be, ga))
    return [a * a, a * b * cg, a * c * cb, a * b * cg, b * b, b * c * ca, a * c * cb, b * c * ca, c * c]


def inverse(m: Sequence[Column]) -> list[Column]:
    """3×3 inverse by cofactors."""
    a, b, c, d, e, f, g, h, i = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [x / det for x in (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)]


def quadratic(m: Sequence[Column], x: Column, y: Column, z: Column) -> Column:
    """xᵀ M x for a row-major 3×3 of columns."""
    return m[0] * x * x + m[4] * y * y + m[8] * z * z + (m[1] + m[3]) * x * y + (m[2] + m[6]) * x * z + (m[5] + m[7]) * y * z


def gaussian(x: Column, centre: Column, sigma: Column) -> Column:
    return F.exp(-0.5 * F.pow((x - centre) / sigma, F.lit(2.0)))


def lorentzian(x: Column, centre: Column, half: Column) -> Column:
    return 1.0 / (1.0 + F.pow((x - centre) / half, F.lit(2.0)))


def pseudo_voigt(x: Column, centre: Column, fwhm: Column, eta: Column) -> Column:
    """eta·Lorentzian + (1 − eta)·Gaussian of one full width at half maximum, height 1."""
    return eta * lorentzian(x, centre, fwhm / 2) + (1 - eta) * gaussian(x, centre, fwhm / 2.3548200450309493)


def window_weight(kind: str, i: Column, n: Column, sigma: float = 0.4) -> Column:
    """Apodization weight of bin i of n on an axis: x runs from −1 to 1; the Gaussian is 0 at the faces."""
    x = F.when(n > 1, 2.0 * i / (n - 1) - 1.0).otherwise(F.lit(0.0))
    if kind == "none":
        return F.lit(1.0)
    if kind == "hann":
        return 0.5 * (1 + F.cos(F.lit(3.141592653589793) * x))
    if kind == "gaussian":
        import math

        edge = math.exp(-0.5 / sigma**2)
        return (F.exp(-0.5 * F.pow(x / sigma, F.lit(2.0))) - edge) / (1 - edge)
    raise ValueError(f"unknown window {kind!r}")


def capsule_inside(d: Sequence[Column], shape: Sequence[float], segment: Sequence[float]) -> Column:
    """Whether δ lies in the ellipsoid δᵀAδ ≤ 1 swept along ±segment (closed-form nearest point)."""
    a = [F.lit(float(x)) for x in shape]
    s = [F.lit(float(x)) for x in segment]

    def form(u: Sequence[Column], v: Sequence[Column]) -> Column:
        return sum((a[3 * i + j] * u[i] * v[j] for i in range(3) for j in range(3)), F.lit(0.0))

    along = form(s, s)
    t = F.when(along > 0, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), form(d, s) / along))).otherwise(F.lit(0.0))
    r = [d[i] - t * s[i] for i in range(3)]
    return form(r, r) <= 1.0
