"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\f\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``, which driver and executors share.

    A session of one machine that sets none, as in tests, gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="gridloom-ckpt-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df once to the shared checkpoint folder and cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none gives an empty array."""
    core = F.btrim(text, F.lit(SPACES))
    return F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, SPACE_RE))


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """df with a broadcast hint if it is shown to have at most most_rows rows, else as it is.

    df should be materialised: its rows are counted here.  Beyond the bound Spark joins by shuffle.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
