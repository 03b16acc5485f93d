"""Streams over folders of records."""

from pyspark.sql import functions as F

from lithos.operators.changes import debounce
from lithos.streaming import streams
from tests.conftest import DATA


def test_subscription_and_debounce(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    rows.repartitionByRange(3, "ts").write.parquet(str(tmp_path / "in"))
    source = streams.tail(spark, str(tmp_path / "in"), rows.schema, files_per_trigger=10)
    got = []
    streams.subscribe(source, "event_type = 'purchase'", lambda df, n: got.append(df.count()), str(tmp_path / "c1")).awaitTermination()
    assert sum(got) == rows.where("event_type = 'purchase'").count()
    out = streams.debounced(source, "user_id", "event_type", ["ts", "event_id"])
    q = out.writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r[0] for r in debounce(rows, "user_id", "event_type", ["ts", "event_id"]).select("event_id").collect()}
    assert {r[0] for r in spark.table("debounced").select("event_id").collect()} == want


def test_changed_state(spark):
    state = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    seen = []
    streams.changed_state(lambda: state, "k", lambda df, n: seen.extend(r.v for r in df.collect()))(spark.createDataFrame([("a",)], "k string"), 0)
    assert sorted(seen) == [1, 2]
