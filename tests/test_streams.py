"""The streaming form of sessions on a whole table in order of arrival, late and repeated deliveries included."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewarden.operators.sessions import actor_events, sessionize
from lakewarden.plans.problems import MINUTE_US, timed_telemetry
from lakewarden.streaming.flows import session_stream


def test_stream_of_a_whole_table_is_the_batch(spark, tmp_path):
    timed = timed_telemetry(spark, "/root/testdata/sf0.01", "event_id", "username", "source_ip", "ingested_at")
    arrived = timed.withColumn("_part", F.ntile(6).over(Window.orderBy("ingested_at")))
    actors = actor_events(timed)
    rows = arrived.select("event_id", "_part", F.timestamp_micros("instant_us").alias("at")).join(actors.select("event_id", "actor"), "event_id").cache()
    late = rows.withColumn("_seen", F.max("at").over(Window.orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)))
    assert late.where(F.col("at") < F.col("_seen") - F.expr("interval 1 day")).count() > 10  # whole batches behind
    for part in range(1, 7):
        rows.where(F.col("_part") == part).drop("_part").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    last = spark.createDataFrame([(-1, "end")], "event_id bigint, actor string").select("event_id", F.timestamp_micros(F.lit(4 * 10**15)).alias("at"), "actor")
    last.coalesce(1).write.parquet(f"{tmp_path}/in/p7")
    source = spark.readStream.schema(last.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    found = session_stream(source, "actor", "at", "event_id", 30 * MINUTE_US, late="400 days")
    query = found.writeStream.format("memory").queryName("bulk").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = spark.sql("SELECT actor, start_us, end_us, event_count FROM bulk WHERE actor <> 'end'").collect()
    want = sessionize(actors, "actor", "instant_us", 30 * MINUTE_US).select("actor", "start_us", "end_us", "event_count").collect()
    assert len(want) > 1000 and sorted(map(tuple, got)) == sorted(map(tuple, want))
