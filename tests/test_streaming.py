"""Live tracking in micro-batches against the batch operator."""

import pytest
from compare import rows
from pyspark.sql import functions as F
from test_tracking import cached, random_cache

from framewise.operators import bridge, tracking
from framewise.schema import Params
from framewise.streaming import live, timed

COLUMNS = ("video_id", "frame", "x1", "y1", "x2", "y2", "conf", "src", "track_id")


@pytest.mark.parametrize("what", ["tracks", "zones"])
def test_live_equals_batch(spark, tmp_path, what):
    p = Params(max_gap=6, moto_min_h_frac=0.15)
    frames, plates, vehicles = cached(spark, random_cache(11, 60))
    table = live.records(frames, plates, vehicles).cache()
    for k, (low, high) in enumerate(((0, 100), (100, 220), (220, 1000))):
        table.filter(f"frame >= {low} and frame < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = {"tracks": live.live_tracks, "zones": live.live_zones}[what]
    query = run(stream, p).writeStream.format("memory").queryName(what).outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = spark.table(what)
    assert not found.filter("late").count()
    want = tracking.selected(frames, plates, vehicles, p)
    if what == "zones":
        want = bridge.zones(want, vehicles, p)
        assert want.filter("src = 'bridge'").count() > 0
    assert rows(found, *COLUMNS) == rows(want, *COLUMNS)


def test_frames_come_complete_also_at_the_end_and_after_a_restart(spark, tmp_path):
    p = Params(max_gap=6, moto_min_h_frac=0.15)
    frames, plates, vehicles = cached(spark, random_cache(11, 60))
    last = frames.agg(F.max("frame")).first()[0]
    time = F.timestamp_seconds(F.col("frame") / 10)
    table = live.records(frames, plates, vehicles).withColumn("at", time).cache()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(low, high, rows_=table):
        """The next micro-batch; each call restarts the query from its checkpoint."""
        rows_.filter(f"frame >= {low} and frame < {high}").coalesce(1).write.parquet(f"{tmp_path}/in/{low}")
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").withWatermark("at", "0 seconds")
        query = timed.closed_zones(stream, p, fps=10.0, idle=60.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
        return spark.read.parquet(f"{tmp_path}/out")

    try:
        want = bridge.zones(tracking.selected(frames, plates, vehicles, p), vehicles, p)
        columns = COLUMNS
        first = rows(go(0, 150), *columns)
        whole = rows(want, *columns)
        # What has come is complete, and all that could be.
        assert first == [r for r in whole if r[1] <= 149 - 7]
        found = go(150, last + 1)
        assert rows(found, *columns) == [r for r in whole if r[1] <= last - 7] or rows(found, *columns) == whole
        # Another video goes on: the watermark passes, and the last frames close without a further plate.
        other = spark.createDataFrame([(2, last + 400)], "video_id long, frame int").join(table.filter(F.col("frame") == frames.first().frame).drop("video_id", "frame", "at")).withColumn("at", F.timestamp_seconds(F.lit(last / 10 + 30.0)))
        found = go(last + 400, last + 401, other.select(table.columns))
        assert rows(found.filter("video_id = 1"), *columns) == whole and not found.filter("late").count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
