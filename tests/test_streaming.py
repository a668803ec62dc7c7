from __future__ import annotations

from pyspark.sql import functions as F

from strandline.streaming.windows import group_stream


def test_stream_windows_are_those_of_the_batch(spark, tmp_path):
    df = spark.range(60).select(F.lit("a").alias("input_id"), F.timestamp_seconds(F.col("id") * 10).alias("t"), F.col("id").alias("v"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = group_stream(stream, "t", "1m", late="0s").writeStream.format("memory").queryName("windows").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted(r.v for r in spark.table("windows").collect())
    finally:
        q.stop()
    assert got == [list(range(i, i + 6)) for i in range(0, 54, 6)]
