"""Small volumes with planted peaks, as bins and volumes."""

import numpy as np
import pandas as pd

BINS = "volume_id string, ih int, ik int, il int, h double, k double, l double, intensity double, sigma double, measured boolean"
VOLUMES = "volume_id string, nh int, nk int, nl int, h0 double, dh double, k0 double, dk double, l0 double, dl double, ub array<double>"


def axes(shape, step):
    return [(np.arange(n) - n // 2) * step for n in shape]


def gaussians(shape, step, ub, peaks, base=10.0, noise=0.0, seed=0):
    """A volume of base + noise and of peaks (centre hkl, covariance in Q, height)."""
    ub = np.array(ub, float)
    grid = np.stack(np.meshgrid(*axes(shape, step), indexing="ij"), -1)
    data = base + noise * np.random.default_rng(seed).normal(size=shape)
    for centre, cov, height in peaks:
        d = (grid - np.array(centre)) @ ub.T
        data += height * np.exp(-0.5 * np.einsum("...i,ij,...j", d, np.linalg.inv(cov), d))
    return data


def frames(spark, data, step, ub, measured=None, sigma=1.0, name="v"):
    """(bins, volumes) of an array."""
    shape = data.shape
    i = np.indices(shape).reshape(3, -1)
    at = axes(shape, step)
    ok = np.ones(shape, bool) if measured is None else measured
    pdf = pd.DataFrame({"volume_id": name, "ih": i[0].astype(np.int32), "ik": i[1].astype(np.int32), "il": i[2].astype(np.int32)})
    for a, x, n in zip("hkl", at, range(3), strict=True):
        pdf[a] = x[i[n]]
    pdf["intensity"], pdf["sigma"], pdf["measured"] = np.where(ok, data, 0.0).ravel(), np.where(ok, sigma, 0.0).ravel(), ok.ravel()
    bins = spark.createDataFrame(pdf, BINS).repartition(4)
    row = [name, *shape]
    for x in at:
        row += [float(x[0]), float(step)]
    return bins, spark.createDataFrame([(*row, np.array(ub, float).ravel().tolist())], VOLUMES)


def index_of(centre, shape, step):
    return tuple(int(round(c / step)) + n // 2 for c, n in zip(centre, shape, strict=True))
