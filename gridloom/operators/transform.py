"""Windowed Fourier transform of volumes to real-space maps, its inverse, and what is read off the maps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import window_weight
from ..functions.sizes import hinted
from .filters import measured
from .lattice import saved

BINKEY = ["volume_id", "ih", "ik", "il"]


def prepared(bins: DataFrame, volumes: DataFrame, kind: str = "gaussian", sigma: float = 0.4) -> DataFrame:
    """Window-weighted mean over the support taken off, then windowed: (volume_id, ih, ik, il, value, weight, mean).

    Unmeasured space is a difference of 0, so only measured bins appear.
    """
    size = hinted(volumes.select("volume_id", "nh", "nk", "nl"))
    w = F.lit(1.0)
    for a in "hkl":
        w = w * window_weight(kind, F.col(f"i{a}"), F.col(f"n{a}"), sigma)
    b = bins.filter(measured()).join(size, "volume_id").withColumn("weight", w).select(*BINKEY, "intensity", "weight")
    mean = b.groupBy("volume_id").agg((F.sum(F.col("weight") * F.col("intensity")) / F.sum("weight")).alias("mean"))
    return b.join(hinted(mean), "volume_id").select(*BINKEY, ((F.col("intensity") - F.col("mean")) * F.col("weight")).alias("value"), "weight", "mean")


def _along(axes: tuple[str, ...], sizes: str, inverse: bool):
    """A grouped map that transforms lines or planes of (re, im) along integer axes about their middle bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = [int(pdf[f"n{a}"].iloc[0]) for a in axes]
        x = np.zeros(n, complex)
        x[tuple(pdf[f"i{a}"].to_numpy() for a in axes)] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        x = np.fft.ifftshift(x)
        x = np.fft.fftshift(np.fft.ifftn(x) if inverse else np.fft.fftn(x))
        at = np.indices(n).reshape(len(n), -1)
        out = {c: np.full(at.shape[1], pdf[c].iloc[0]) for c in ("volume_id", "nh", "nk", "nl")}
        for a in "hkl":
            out[f"i{a}"] = at[axes.index(a)] if a in axes else np.full(at.shape[1], pdf[f"i{a}"].iloc[0])
        out["re"], out["im"] = x.real.ravel(), x.imag.ravel()
        return pd.DataFrame(out)[COLUMNS]

    return run


#: Lines along h that one call transforms together.
LINES = 256


def _lines(inverse: bool):
    """A grouped map that transforms many lines of (re, im) along h at once, about their middle bin."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nh, nl = int(pdf["nh"].iloc[0]), int(pdf["nl"].iloc[0])
        line, at = np.unique(pdf["ik"].to_numpy(np.int64) * nl + pdf["il"].to_numpy(), return_inverse=True)
        x = np.zeros((len(line), nh), complex)
        x[at, pdf["ih"].to_numpy()] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        x = np.fft.ifftshift(x, axes=1)
        x = np.fft.fftshift(np.fft.ifft(x, axis=1) if inverse else np.fft.fft(x, axis=1), axes=1)
        out = {c: np.full(x.size, pdf[c].iloc[0]) for c in ("volume_id", "nh", "nk", "nl")}
        out["ih"], out["ik"], out["il"] = np.tile(np.arange(nh), len(line)), np.repeat(line // nl, nh), np.repeat(line % nl, nh)
        out["re"], out["im"] = x.real.ravel(), x.imag.ravel()
        return pd.DataFrame(out)[COLUMNS]

    return run


COLUMNS = ["volume_id", "nh", "nk", "nl", "ih", "ik", "il", "re", "im"]
SCHEMA = "volume_id string, nh int, nk int, nl int, ih int, ik int, il int, re double, im double"


def fft(values: DataFrame, volumes: DataFrame, inverse: bool = False) -> DataFrame:
    """Centred 3-D transform of column ``value`` (complex: ``re``, ``im``) in two exchanges: planes of k, l, then blocks of lines of h."""
    size = hinted(volumes.select("volume_id", "nh", "nk", "nl"))
    if "re" in values.columns:
        v = values.select(*BINKEY, "re", "im").join(size, "volume_id")
    else:
        v = values.select(*BINKEY, F.col("value").alias("re"), F.lit(0.0).alias("im")).join(size, "volume_id")
    v = v.select(*COLUMNS)
    planes = v.groupBy("volume_id", "ih").applyInPandas(_along(("k", "l"), "", inverse), SCHEMA)
    block = F.expr(f"(ik * nl + il) % greatest(nk * nl div {LINES}, 1)").alias("block")
    return planes.groupBy("volume_id", block).applyInPandas(_lines(inverse), SCHEMA)


def delta_pdf(bins: DataFrame, volumes: DataFrame, kind: str = "gaussian", sigma: float = 0.4) -> DataFrame:
    """Real part of the transform: (volume_id, ix, iy, iz, x, y, z, value), x in lattice units of the reciprocal step."""
    f = fft(prepared(bins, volumes, kind, sigma), volumes)
    step = hinted(volumes.select("volume_id", *[f"d{a}" for a in "hkl"]))
    f = f.join(step, "volume_id")
    at = lambda a: (F.col(f"i{a}") - F.floor(F.col(f"n{a}") / 2)) / (F.col(f"n{a}") * F.col(f"d{a}"))
    return f.select("volume_id", F.col("ih").alias("ix"), F.col("ik").alias("iy"), F.col("il").alias("iz"), at("h").alias("x"), at("k").alias("y"), at("l").alias("z"), F.col("re").alias("value"))


def round_trip(bins: DataFrame, volumes: DataFrame, kind: str = "gaussian", sigma: float = 0.4, floor: float = 1e-3) -> DataFrame:
    """Transform, inverse, window divided out, mean added back: measured bins with ``recon``, where the window is above floor."""
    p = saved(prepared(bins, volumes, kind, sigma))
    back = fft(fft(p, volumes).select(*BINKEY, "re", "im"), volumes, inverse=True).select(*BINKEY, "re")
    j = p.join(back, BINKEY).filter(F.col("weight") > floor)
    own = bins.select(*BINKEY, "intensity")
    return j.join(own, BINKEY).select(*BINKEY, "intensity", (F.col("re") / F.col("weight") + F.col("mean")).alias("recon"))


def fft_by_join(values: DataFrame, volumes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Real part of the transform at a few wanted points (volume_id, ix, iy, iz): one pass over the bins for each point.

    The table of wanted points is bounded (checked when hinted).
    """
    size = hinted(volumes.select("volume_id", "nh", "nk", "nl"))
    v = values.select(*BINKEY, "value").join(size, "volume_id").join(hinted(wanted), "volume_id")
    phase = F.lit(0.0)
    for a, x in zip("hkl", "xyz", strict=True):
        phase = phase + (F.col(f"i{a}") - F.floor(F.col(f"n{a}") / 2)) * (F.col(f"i{x}") - F.floor(F.col(f"n{a}") / 2)) / F.col(f"n{a}")
    c = F.cos(phase * (2 * 3.141592653589793))
    return v.groupBy("volume_id", "ix", "iy", "iz").agg(F.sum(F.col("value") * c).alias("value"))


def sigma_outside_origin(pdf: DataFrame, share: float = 0.05) -> DataFrame:
    """Median and robust σ of a map outside the disk of 5 % of its half-width about the origin.

    The map is read three times: pass one that is written (:func:`gridloom.operators.lattice.saved`).
    """
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    half = pdf.groupBy("volume_id").agg(F.least(F.max("x"), F.max("y"), F.max("z")).alias("_h"))
    p = pdf.join(hinted(half), "volume_id").filter(r > share * F.col("_h"))
    m = saved(p.groupBy("volume_id").agg(F.expr("percentile(value, 0.5)").alias("median"), F.count("*").alias("n")))
    d = p.join(hinted(m), "volume_id").groupBy("volume_id").agg((1.4826 * F.expr("percentile(abs(value - median), 0.5)")).alias("sigma"))
    return m.join(d, "volume_id")


def pair_signal(pdf: DataFrame, volumes: DataFrame, vectors: DataFrame, key: list[str], share: float = 0.05) -> DataFrame:
    """The map at vectors (volume_id, key, x, y, z) inside it, trilinear and in σ; null in the origin's disk and where σ is 0."""
    from .resample import at_points

    pdf = saved(pdf)
    as_bins = pdf.select("volume_id", F.col("ix").alias("ih"), F.col("iy").alias("ik"), F.col("iz").alias("il"), F.col("value").alias("intensity"), F.lit(True).alias("measured"))
    grid, inside = volumes.select("volume_id", *[f"{p}{a}" for p in "nd" for a in "hkl"]), F.lit(True)
    for a, x in zip("hkl", "xyz", strict=True):
        grid = grid.withColumn(f"d{a}", 1 / (F.col(f"n{a}") * F.col(f"d{a}"))).withColumn(f"{a}0", -F.floor(F.col(f"n{a}") / 2) * F.col(f"d{a}"))
        slack = 1e-6 * F.col(f"d{a}")
        inside = inside & F.col(x).between(F.col(f"{a}0") - slack, F.col(f"{a}0") + (F.col(f"n{a}") - 1) * F.col(f"d{a}") + slack)
    p = vectors.join(hinted(grid), "volume_id").filter(inside).select("volume_id", *key, *[F.col(x).alias(a) for a, x in zip("hkl", "xyz", strict=True)])
    half = pdf.groupBy("volume_id").agg(F.least(F.max("x"), F.max("y"), F.max("z")).alias("_h"))
    s = hinted(sigma_outside_origin(pdf, share).select("volume_id", "sigma").join(half, "volume_id"))
    j = at_points(as_bins, grid, p, [*key, "h", "k", "l"]).join(s, "volume_id")
    r = F.sqrt(F.col("h") ** 2 + F.col("k") ** 2 + F.col("l") ** 2)
    seen = (r > share * F.col("_h")) & (F.col("sigma") > 0)
    return j.select("volume_id", *key, F.col("h").alias("x"), F.col("k").alias("y"), F.col("l").alias("z"), F.when(seen, F.col("value") / F.col("sigma")).alias("in_sigma"))


def box_extremes(pdf: DataFrame) -> DataFrame:
    """A complete map with ``low`` and ``high``, the least and largest value of the 3×3×3 box about each point.

    Axis by axis: extremes of three along one axis, then of those along the next, so the map is dealt three times
    and no point is copied to its neighbours.
    """
    d = pdf.withColumn("low", F.col("value")).withColumn("high", F.col("value"))
    for axis, rest in (("iz", ("ix", "iy")), ("iy", ("ix", "iz")), ("ix", ("iy", "iz"))):
        w = Window.partitionBy("volume_id", *rest).orderBy(axis).rangeBetween(-1, 1)
        d = d.select(*pdf.columns, F.min("low").over(w).alias("low"), F.max("high").over(w).alias("high"))
    return d


def strongest(pdf: DataFrame, n_sigma: float = 5.0) -> DataFrame:
    """Extrema of a complete map above n·σ outside the origin, one of each pair ±r, with length and height in σ."""
    pdf = saved(pdf)
    s = saved(sigma_outside_origin(pdf))
    half = (F.col("x") > 0) | ((F.col("x") == 0) & ((F.col("y") > 0) | ((F.col("y") == 0) & (F.col("z") > 0))))
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    j = box_extremes(pdf).filter(half & ((F.col("value") == F.col("low")) | (F.col("value") == F.col("high")))).join(hinted(s), "volume_id")
    j = j.filter(F.abs("value") >= n_sigma * F.col("sigma"))
    return j.select("volume_id", "x", "y", "z", "value", r.alias("length"), (F.col("value") / F.col("sigma")).alias("in_sigma"))
