"""Streams against the batch result: batches, late rows, reruns, nothing to read."""

import datetime as dt

from pyspark.sql import functions as F

from raresight.session import scratch_path
from raresight.streaming import screen

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, value double, kind string"


def counts(events, delay="2 hours"):
    return screen.windowed_confusion(events, "ts", F.col("value") >= 1, F.col("kind") == "bad", "1 hour", delay)


def by_window(df):
    return {r["window_start"]: tuple(r[c] for c in ("true_positives", "false_positives", "false_negatives", "true_negatives")) for r in df.collect()}


def at(hour, minute=0):
    return DAY + dt.timedelta(hours=hour, minutes=minute)


def files(spark, *parts):
    path = scratch_path(spark, "events")
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def test_batches_equal_one_table(spark):
    rows = [(at(i // 6, i % 60), float(i % 3), "bad" if i % 4 else "good") for i in range(120)] + [(None, 1.0, "bad"), (at(3), None, "bad"), (at(3), 2.0, None)]
    path = files(spark, rows[:50], rows[50:90], rows[90:])
    streamed = by_window(screen.run_available(counts(screen.file_stream(spark, path, 1), "2 days"), ["window_start"]))
    assert streamed == by_window(counts(spark.read.parquet(path)))
    assert sum(map(sum, streamed.values())) == 120 and None not in streamed


def test_late_rows(spark):
    first, late, in_time = [(at(1), 1.0, "bad"), (at(10), 1.0, "bad")], [(at(1, 30), 1.0, "bad"), (at(10, 5), 0.0, "good")], [(at(9, 30), 1.0, "good")]
    # rows are measured by the mark of the batch before: one more batch lies between
    path = files(spark, first, [(at(10, 1), None, None)], late, in_time)
    got = by_window(screen.run_available(counts(screen.file_stream(spark, path, 1)), ["window_start"]))
    # the window of 1 o'clock was closed when the late row came; that of 9 o'clock was not
    assert got == {at(1): (1, 0, 0, 0), at(10): (1, 0, 0, 1), at(9): (0, 1, 0, 0)}
    assert by_window(screen.run_available(counts(screen.file_stream(spark, path)), ["window_start"]))[at(1)] == (2, 0, 0, 0)


def test_empty_stream(spark):
    path = files(spark, [])
    found = screen.run_available(counts(screen.file_stream(spark, path)), ["window_start"])
    assert found.count() == 0 and "true_positives" in found.columns
