"""Registered queries that return an operator's whole result; SQL on whole tables would be too slow for them, so tests
hold them against brute force instead."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as cl
from ..operators import resample as rs
from .catalogue import KEY, STEP, _holes, _positions
from .catalogue_clean import _ring_shells
from .catalogue_more import _differences
from .registry import flt, lat, query, r6, tr


def _every_bin(v):
    """Every bin of the volumes' grids, with its h, k, l, whether or not the table has it."""
    g = v.select("volume_id", *[f"{x}{a}" for a in "hkl" for x in "nd"], *[f"{a}0" for a in "hkl"])
    for a in "hkl":
        g = g.withColumn(f"i{a}", F.explode(F.sequence(F.lit(0), F.col(f"n{a}") - 1))).withColumn(a, F.col(f"{a}0") + F.col(f"i{a}") * F.col(f"d{a}"))
    return g.select(*KEY, "h", "k", "l")


@query("dom_delta_pdf_map")
def _(b, v):
    return r6(tr.delta_pdf(b, v, "hann"), "x", "y", "z", "value")


@query("dom_regrid_volume")
def _(b, v):
    return r6(rs.regrid(b, v, _every_bin(v), (0.5, 0, 0, 0, 1, 0, 0, 0, 1)), "intensity")


@query("flt_nearest_positions")
def _(b, v):
    p = b.filter("measured").select(*KEY, "h", "k", "l")
    return r6(flt.nearest_position(p, _positions(b)).select(*KEY, "position_id", "distance"), "distance")


@query("dom_ring_profiles")
def _(b, v):
    return r6(cl.ring_model_profiles(b, "h", _ring_shells(b), STEP), "median", "removed")


@query("dom_hole_sizes")
def _(b, v):
    c = lat.hole_census(lat.components(_holes(b), faces=False), v, (30, 100))
    return r6(c, *[x for x in c.columns if x.startswith("s")])


@query("dom_largest_holes")
def _(b, v):
    return r6(lat.largest_holes(lat.components(_holes(b), faces=False), v), "h", "k", "l")


@query("dom_pair_values")
def _(b, v):
    p = rs.pair_vectors(_differences(b), 3).select("site", "site2", "x", "y", "z")  # the map reaches under 3 cells
    p = b.select("volume_id").distinct().join(F.broadcast(p))
    return r6(tr.pair_signal(tr.delta_pdf(b, v, "hann"), v, p, ["site", "site2"]), "x", "y", "z", "in_sigma")
