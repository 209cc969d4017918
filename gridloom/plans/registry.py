"""All registered queries of the volume analytics and their SQL twins.

Every query starts from the grid that :func:`gridloom.sources.bins.from_lineitem` folds out of ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import filters as flt
from ..operators import lattice as lat
from ..operators import shells as sh
from ..operators import transform as tr
from ..sources import bins as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STEP = 0.25


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Registers fn(b, v) -> DataFrame over bins with q and their volumes; sql runs with CTEs bins, qbins (and ctes).

    The bins are few and written once: ``lineitem`` is read once, and no predicate of fn moves below the fold onto its rows.
    """

    def put(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bins = src.from_lineitem(spark, sf_dir)
            vols = src.volumes_of(spark.createDataFrame([(x,) for x in "ANR"], "volume_id string"))
            bins = src.with_q(bins, vols)
            return fn(lat.saved(bins), vols)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = src.BINS_SQL + ("," + ctes if ctes else "") + sql
        return fn

    return put


def r6(df: DataFrame, *names: str) -> DataFrame:
    """df with double columns rounded to six places."""
    for c in names:
        df = df.withColumn(c, F.round(c, 6) + F.lit(0.0))
    return df


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalogue, catalogue_clean, catalogue_more, catalogue_peaks, catalogue_tables, catalogue_whole  # noqa: F401  (they register on import)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import catalogue, catalogue_clean, catalogue_more, catalogue_peaks, catalogue_tables, catalogue_whole  # noqa: F401

    return dict(ORACLES)


__all__ = ["STEP", "flt", "geo", "lat", "oracle_sql", "queries", "query", "r6", "sh", "src", "tr"]
