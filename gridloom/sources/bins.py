"""Bins and volumes: loading rules, construction, and the grid folded out of ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import q_magnitude
from ..functions.sizes import hinted

BIN_COLUMNS = ("volume_id", "ih", "ik", "il", "h", "k", "l", "intensity", "sigma", "measured")
#: The orientation matrix of the volumes folded out of ``lineitem``.
UB = (1.4, 0.0, 0.0, 0.0, 1.4, 0.0, 0.0, 0.0, 1.2)
SHAPE = (21, 21, 11)

BINS_SQL = """
WITH raw AS (
  SELECT l_returnflag AS volume_id, CAST(l_orderkey % 21 AS INT) AS ih, CAST(l_partkey % 21 AS INT) AS ik,
         CAST(l_suppkey % 11 AS INT) AS il, CAST(l_quantity AS BIGINT) AS qty FROM lineitem),
cell AS (
  SELECT volume_id, ih, ik, il, CAST(SUM(qty) AS DOUBLE) AS intensity, CAST(COUNT(*) AS DOUBLE) AS n
  FROM raw GROUP BY volume_id, ih, ik, il),
bins AS (
  SELECT volume_id, ih, ik, il, CAST(ih - 10 AS DOUBLE) / 5 AS h, CAST(ik - 10 AS DOUBLE) / 5 AS k,
         CAST(il - 5 AS DOUBLE) / 5 AS l, intensity, SQRT(n) AS sigma,
         ((ih * 7 + ik * 11 + il * 13) % 17 <> 0) AS measured
  FROM cell),
qbins AS (
  SELECT *, SQRT((1.4e0*h)*(1.4e0*h) + (1.4e0*k)*(1.4e0*k) + (1.2e0*l)*(1.2e0*l)) AS q FROM bins)
"""


def from_lineitem(spark: SparkSession, sf_dir: str, run: int | None = None, together: bool = False) -> DataFrame:
    """One row per bin of three volumes (or three per run of orders) on a 21×21×11 grid, by one combined group-by.

    ``together`` first deals the lines out by volume, so that nothing grouped by volume or by its nodes is shuffled again: for many small volumes.
    """
    name = F.col("l_returnflag") if run is None else F.concat_ws("-", "l_returnflag", F.expr(f"l_orderkey div {run}").cast("string"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        name.alias("volume_id"),
        (F.col("l_orderkey") % 21).cast("int").alias("ih"),
        (F.col("l_partkey") % 21).cast("int").alias("ik"),
        (F.col("l_suppkey") % 11).cast("int").alias("il"),
        F.col("l_quantity").cast("long").alias("qty"),
    )
    if together:  # a fixed number, so that tasks stay small: a task holds its bins several times on the way to the volumes
        lines = lines.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * lines.rdd.getNumPartitions()), "volume_id")
    cell = lines.groupBy("volume_id", "ih", "ik", "il").agg(F.sum("qty").cast("double").alias("intensity"), F.count("*").cast("double").alias("n"))
    return cell.select(
        "volume_id", "ih", "ik", "il",
        ((F.col("ih") - 10).cast("double") / 5).alias("h"), ((F.col("ik") - 10).cast("double") / 5).alias("k"),
        ((F.col("il") - 5).cast("double") / 5).alias("l"), "intensity", F.sqrt("n").alias("sigma"),
        ((F.col("ih") * 7 + F.col("ik") * 11 + F.col("il") * 13) % 17 != 0).alias("measured"),
    )


#: The same grid folded out of runs of 500 orders, so volumes and bins grow with the table.
SCANS_SQL = BINS_SQL.replace("l_returnflag AS volume_id", "l_returnflag || '-' || CAST(l_orderkey // 500 AS VARCHAR) AS volume_id")


def scans(spark: SparkSession, sf_dir: str, run: int = 500, together: bool = False) -> DataFrame:
    """Bins with q of one volume per return flag and run of orders: their number grows with ``lineitem``."""
    return from_lineitem(spark, sf_dir, run, together).withColumn("q", q_magnitude(UB, F.col("h"), F.col("k"), F.col("l")))


def volumes_of(bins: DataFrame, shape: tuple[int, int, int] = SHAPE, step: float = 0.2, ub: tuple[float, ...] = UB) -> DataFrame:
    """The ``volumes`` row of each volume of a regular grid whose middle bin is 0 on every axis."""
    v = bins.select("volume_id").distinct()
    for a, n in zip("hkl", shape, strict=True):
        v = v.withColumn(f"n{a}", F.lit(n)).withColumn(f"{a}0", F.lit(-(n // 2) * step)).withColumn(f"d{a}", F.lit(step))
    return (
        v.withColumn("ub", F.array(*[F.lit(float(x)) for x in ub]))
        .withColumn("sigma_estimated", F.lit(False))
        .withColumn("instrument", F.lit("table"))
        .withColumn("attrs", F.create_map(F.lit("a"), F.lit("4.4880"), F.lit("b"), F.lit("4.4880")))
    )


def with_q(bins: DataFrame, volumes: DataFrame) -> DataFrame:
    """bins with |Q| in double precision from each volume's own orientation matrix."""
    ub = hinted(volumes.select("volume_id", "ub"))
    return bins.join(ub, "volume_id").withColumn("q", q_magnitude(F.col("ub"), F.col("h"), F.col("k"), F.col("l"))).drop("ub")


def load(raw: DataFrame) -> DataFrame:
    """Loading rule: (…, signal, errors_squared or null, mask) to intensity, sigma, measured, sigma_estimated.

    σ is the root of the squared error, or of |signal| where there is none (then it is estimated); a NaN or
    null signal or a mask of 1 leaves the bin unmeasured with value and σ zero.
    """
    ok = ~(F.isnan("signal") | F.col("signal").isNull() | (F.coalesce(F.col("mask"), F.lit(0)) == 1))
    sigma = F.coalesce(F.sqrt("errors_squared"), F.sqrt(F.abs("signal")))
    return raw.select(
        *[c for c in raw.columns if c not in ("signal", "errors_squared", "mask")],
        F.when(ok, F.col("signal")).otherwise(0.0).alias("intensity"),
        F.when(ok, sigma).otherwise(0.0).alias("sigma"),
        ok.alias("measured"),
        (F.col("errors_squared").isNull() & ok).alias("sigma_estimated"),
    )


def centres(edges: DataFrame) -> DataFrame:
    """Bin centres from (volume_id, axis, edges array): one row per bin."""
    e = edges.select("volume_id", "axis", F.posexplode("edges").alias("idx", "edge"))
    nxt = F.lead("edge").over(Window.partitionBy("volume_id", "axis").orderBy("idx"))
    return e.withColumn("centre", (F.col("edge") + nxt) / 2).filter("centre is not null").select("volume_id", "axis", "idx", "centre")


def from_arrays(arrays: DataFrame) -> DataFrame:
    """Bins of volumes given as one nested array each: (volume_id, data, h0, h1, k0, k1, l0, l1), ends included."""
    d = arrays.select("*", F.posexplode("data").alias("ih", "_p")).select("*", F.posexplode("_p").alias("ik", "_r")).select("*", F.posexplode("_r").alias("il", "v"))
    at = lambda a, size: F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col(f"i{a}") / F.greatest(size - 1, F.lit(1))
    v = F.coalesce(F.col("v").cast("double"), F.lit(0.0))
    return d.select(
        "volume_id", "ih", "ik", "il", at("h", F.size("data")).alias("h"), at("k", F.size("_p")).alias("k"), at("l", F.size("_r")).alias("l"),
        v.alias("intensity"), F.sqrt(F.abs(v)).alias("sigma"), F.col("v").isNotNull().alias("measured"),
    )


def save(bins: DataFrame, volumes: DataFrame, path: str) -> None:
    """Parquet partitioned by volume and sorted by plane, so crops and sections prune row groups."""
    bins.repartition("volume_id", "ih").sortWithinPartitions("volume_id", "ih").write.mode("errorifexists").partitionBy("volume_id").parquet(f"{path}/bins")
    volumes.write.mode("errorifexists").parquet(f"{path}/volumes")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/bins").select(*BIN_COLUMNS), spark.read.parquet(f"{path}/volumes")


def sigma_note(bins: DataFrame) -> DataFrame:
    """Per volume: largest value, whether any is no whole number, and whether σ = √I then looks normalised."""
    x = F.col("intensity")
    return bins.filter("measured").groupBy("volume_id").agg(
        F.max(x).alias("largest"), F.expr("bool_or(abs(intensity - round(intensity)) > 1e-6)").alias("fractional")
    ).withColumn("normalised", F.col("fractional") | (F.col("largest") < 1))
