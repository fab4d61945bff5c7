"""Streams: closed bars, repeats, late events, and a sink that publishes each bar once."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from barloom.streaming import bars as S

START = datetime(2024, 1, 1)
EVENT = "symbol string, ts timestamp, tie long, price double, volume double"


def batch(spark, *rows):
    return spark.createDataFrame([(k, i, f"{k}{i}") for k, i in rows], "series_key string, bar_index long, note string")


def bars_of(df):
    return sorted((r.series_key, r.bar_index) for r in df.collect())


def test_sink_publishes_each_bar_once(spark, tmp_path):
    path = f"file://{tmp_path}/sink"
    write = S.publish_once(path)
    assert S.published(spark, path) is None
    write(batch(spark, ("a", 0), ("a", 1), ("b", 0)), 0)
    write(batch(spark, ("a", 0), ("a", 1), ("b", 0)), 0)  # the same batch again
    write(batch(spark, ("a", 1), ("a", 2), ("c", 0), ("c", 0)), 1)  # a restart that repeats the last bar
    write(batch(spark).where("false"), 2)
    write(batch(spark, ("b", 0), ("b", 1)), 3)
    assert bars_of(S.published(spark, path)) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("c", 0)]
    assert {(r.epoch, r.series_key, r.bar_index) for r in S.published(spark, path).where("epoch = 1").collect()} == {(1, "a", 2), (1, "c", 0)}


@pytest.mark.parametrize("at", ["rows", "index"])
def test_batch_killed_between_its_writes(spark, tmp_path, monkeypatch, at):
    """What a dead batch has written isn't seen, and its second run leaves no row twice."""
    path = f"file://{tmp_path}/sink"
    write = S.publish_once(path)
    write(batch(spark, ("a", 0), ("b", 0)), 0)
    whole = DataFrameWriter.parquet

    def dies(self, target, *args, **kw):
        if f"/{at}/epoch=1" in target:
            if at == "rows":
                whole(self, target, *args, **kw)
            raise OSError("killed")
        return whole(self, target, *args, **kw)

    monkeypatch.setattr(DataFrameWriter, "parquet", dies)
    with pytest.raises(OSError, match="killed"):
        write(batch(spark, ("a", 0), ("a", 1)), 1)
    monkeypatch.undo()
    assert bars_of(S.published(spark, path)) == [("a", 0), ("b", 0)]
    write(batch(spark, ("a", 0), ("a", 1)), 1)
    assert bars_of(S.published(spark, path)) == [("a", 0), ("a", 1), ("b", 0)]


def test_events_beyond_the_watermark_go_to_a_table(spark, tmp_path):
    path = f"file://{tmp_path}/late"
    split = S.late_events(spark, path, "1 hour")

    def events(*minutes):
        return spark.createDataFrame([("a", START + timedelta(minutes=m), m, 1.0, 1.0) for m in minutes], EVENT)

    kept = [sorted(r.tie for r in split(events(*minutes), epoch).collect()) for epoch, minutes in enumerate([(100, 0), (130, 39, 40, 41), (10, 71, 69)])]
    assert kept == [[0, 100], [40, 41, 130], [71]]
    again = sorted(r.tie for r in split(events(10, 71, 69), 2).collect())
    assert again == [71]
    late = spark.read.parquet(f"{path}/late")
    assert sorted((r.epoch, r.tie) for r in late.collect()) == [(1, 39), (2, 10), (2, 69)]


def run(spark, df, folder):
    """All rows that a stream gives by the end of its input."""
    query = df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def test_bars_close_when_the_watermark_has_passed(spark, tmp_path):
    minutes = [0, 3, 14, 16, 29, 31, 44, 100]
    rows = [("a", START + timedelta(minutes=m), m, 10.0 + m, 1.0) for m in minutes] + [("a", START + timedelta(minutes=5), 9, -1.0, 1.0)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = run(spark, S.stream_bars(spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in"), "15m", "30 minutes"), tmp_path)
    got = {r.opened_at: (float(r.open), float(r.high), float(r.low), float(r.close), r.volume) for r in out.collect()}
    assert got == {
        START: (10.0, 24.0, 10.0, 24.0, 3.0), START + timedelta(minutes=15): (26.0, 39.0, 26.0, 39.0, 2.0), START + timedelta(minutes=30): (41.0, 54.0, 41.0, 54.0, 2.0),
    }


def test_closed_bars_drop_what_a_feed_repeats(spark, tmp_path):
    schema = "series_key string, opened_at timestamp, close double"
    rows = [(k, START + timedelta(minutes=15 * i), float(i)) for k in "ab" for i in (0, 1, 1, 2, 2, 2, 3)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    out = run(spark, S.closed_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "1 hour"), tmp_path)
    assert sorted((r.series_key, r.close) for r in out.collect()) == [(k, float(i)) for k in "ab" for i in range(4)]


def test_later_bars_see_a_higher_bar_from_its_close(spark, tmp_path):
    """The direction of a closed higher bar reaches bars that open at its close or later."""
    schema = "series_key string, opened_at timestamp, high double, low double, close double, higher_at timestamp, higher_direction string"
    rows = [("a", START + timedelta(minutes=15 * i), 1.0, 1.0, 1.0, START + timedelta(hours=1) if i == 2 else None, "BULLISH" if i == 2 else None) for i in range(7)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = run(spark, S.stream_facts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), S.Config(), 900), tmp_path)
    assert {r.bar_index: r.htf_direction for r in out.collect()} == {i: "BULLISH" if i >= 4 else None for i in range(7)}
    assert out.where(F.col("ignored").isNotNull()).count() == 0
