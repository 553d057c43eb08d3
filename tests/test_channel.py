"""The event channel: batches, streams, and restarts in the middle."""

import pytest
from pyspark.sql import functions as F

from loomtext.sources.channel import EVENT, Channel


@pytest.fixture
def channel(spark, tmp_path):
    spark.dataSource.register(Channel)
    uri = f"file://{tmp_path}/channel"

    def send(low, high):
        rows = [(f"r{i % 3}", None if i % 5 == 0 else f"u{i}", "chat", f"text {i}", None) for i in range(low, high)]
        spark.createDataFrame(rows, EVENT).repartition(3).write.format("channel").option("path", uri).mode("append").save()

    return uri, send


def contents(df):
    return sorted(int(r["content"].split()[1]) for r in df.collect())


def test_batches(spark, channel):
    uri, send = channel
    read = lambda: spark.read.format("channel").option("path", uri).load()
    assert read().count() == 0
    send(0, 50)
    send(50, 70)
    assert contents(read()) == list(range(70)) and read().filter("sender is null").count() == 14
    with pytest.raises(Exception, match="append"):
        read().write.format("channel").option("path", uri).mode("overwrite").save()


def test_a_stream_that_fails_and_restarts_sees_each_event_once(spark, channel, tmp_path):
    uri, send = channel
    out, fail = f"file://{tmp_path}/out", {"now": False}

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/n={number}")
        if fail["now"]:
            raise RuntimeError("lost in the middle")

    def run():
        stream = spark.readStream.format("channel").option("path", uri).load()
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()

    send(0, 30)
    run()
    send(30, 60)
    send(60, 90)
    fail["now"] = True
    with pytest.raises(Exception):
        run()
    send(90, 100)
    fail["now"] = False
    run()
    run()
    assert contents(spark.read.parquet(out)) == list(range(100))


def test_a_repeated_micro_batch_adds_nothing(spark, channel, tmp_path):
    """A stream into the channel whose marks of the last batch are lost writes it again; the channel keeps one."""
    import shutil

    uri, _ = channel
    spark.range(40).select(F.lit("r").alias("room"), F.lit("u").alias("sender"), F.lit("chat").alias("kind"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"), F.current_timestamp().alias("sent")).write.parquet(f"file://{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/in")
        stream.writeStream.format("channel").option("path", uri).option("writer", "w").option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()

    run()
    shutil.rmtree(tmp_path / "marks" / "commits")
    run()
    assert contents(spark.read.format("channel").option("path", uri).load()) == list(range(40))


def test_tasks_without_events_leave_no_file(spark, channel, tmp_path):
    """Batches and streams whose tasks are partly or all empty."""
    uri, _ = channel
    spark.range(2).select(F.lit("r").alias("room"), F.lit("u").alias("sender"), F.lit("chat").alias("kind"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"), F.lit(None).cast("timestamp").alias("sent")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    events = spark.read.parquet(f"file://{tmp_path}/in")
    for df in (events.repartition(4, "room"), events.filter("room = 'none'")):
        df.write.format("channel").option("path", uri).mode("append").save()
    assert contents(spark.read.format("channel").option("path", uri).load()) == [0, 1] and len(list((tmp_path / "channel" / "events").iterdir())) == 1
    stream = spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/in").repartition(4, "room")
    stream.writeStream.format("channel").option("path", uri).option("writer", "w").option("checkpointLocation", f"file://{tmp_path}/marks").trigger(availableNow=True).start().awaitTermination()
    assert contents(spark.read.format("channel").option("path", uri).load()) == [0, 0, 1, 1]
