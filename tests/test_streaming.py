import random

from pyspark.sql import functions as F

from loamline.operators.coupling import bursts
from loamline.streaming.bursts import streaming_bursts

T0 = 1_700_000_000


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted({(rng.choice("abc"), T0 + rng.choice([1, 59, 60, 61, 120]) * rng.randint(0, 300)) for _ in range(400)}, key=lambda r: r[1])
    schema = "file string, t long"
    for i in range(0, len(rows), 100):
        part = spark.createDataFrame(rows[i : i + 100], schema).coalesce(1)
        part.select("file", F.timestamp_seconds("t").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
    last = spark.createDataFrame([("end", T0 + 10**7)], schema)
    last.select("file", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streaming_bursts(stream, 60, "30 days").writeStream.outputMode("append").format("memory").queryName("stream_bursts").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.file, r.start, r.end, r.events) for r in spark.table("stream_bursts").collect())
    want = sorted((r.file, r.start, r.end, r.events) for r in bursts(spark.createDataFrame(rows, schema), 60).collect())
    assert got == want
