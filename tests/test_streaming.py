from pyspark.sql import functions as F

from gridloom.streaming import ingest


def test_stream_equals_batch(spark, tmp_path):
    rows = [("v", f"2024-01-01 0{i % 5}:10:00", (i % 3) * 0.2, 0.0, 0.0, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "volume_id string, at string, h double, k double, l double, counts double").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ingest.binned(stream).writeStream.format("memory").queryName("parts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, ingest.merged(spark.table("parts")).collect()))
    assert got == sorted(map(tuple, ingest.merged(ingest.binned(df)).collect())) and len(got) == 3
