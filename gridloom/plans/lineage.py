"""Stage lineage: what each output was made from, what is stale, and the chain that runs only stale stages."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("average", "rings", "punch", "backfill", "flatten", "transform", "check")


def fingerprint(settings: dict) -> str:
    """Canonical text of settings: equal settings give equal text."""
    return json.dumps(settings, sort_keys=True, separators=(",", ":"))


def latest(lineage: DataFrame) -> DataFrame:
    """The newest record of each volume and stage."""
    return lineage.groupBy("volume_id", "stage").agg(F.max_by("settings", "made_at").alias("settings"), F.max_by("input_id", "made_at").alias("input_id"), F.max("made_at").alias("made_at"))


def staleness(lineage: DataFrame, expected: DataFrame) -> DataFrame:
    """expected (volume_id, position, stage, settings, input_id) with ``reason``: missing, settings, input, upstream or null."""
    j = expected.join(latest(lineage).select("volume_id", "stage", F.col("settings").alias("_s"), F.col("input_id").alias("_i")), ["volume_id", "stage"], "left")
    own = F.when(F.col("_s").isNull(), "missing").when(F.col("_s") != F.col("settings"), "settings").when(F.col("_i") != F.col("input_id"), "input")
    j = j.withColumn("_own", own)
    before = F.max(F.col("_own").isNotNull()).over(Window.partitionBy("volume_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    return j.select("volume_id", "position", "stage", F.coalesce("_own", F.when(before, "upstream")).alias("reason"))


def run_chain(bins: DataFrame, stages: list[tuple[str, dict, Callable[[DataFrame, dict], DataFrame]]], folder: str, force: bool = False) -> DataFrame:
    """Applies stages in order; each output is written once under its own fingerprint and read back when it is still current."""
    spark, key = bins.sparkSession, ""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, settings, stage in stages:
        if not settings.get("enabled", True):
            continue
        key = fingerprint({"before": key, "stage": name, "settings": settings})
        path = f"{folder}/{name}-{abs(hash_text(key)):016x}"
        done = hadoop.Path(f"{path}/_SUCCESS")
        there = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
        if force or not there:
            stage(bins, settings).write.mode("overwrite").parquet(path)
        bins = spark.read.parquet(path)
    return bins


def hash_text(text: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")
