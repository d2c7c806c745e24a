"""Queries over streams."""

from pyspark.sql import functions as F

from raresight.streaming import screen


def stream_screen(spark, sf):
    """Errors among the events, screened by their value, per day of event time."""
    events = screen.file_stream(spark, f"{sf}/events.parquet")
    counts = screen.windowed_confusion(events, "ts", F.col("value") >= 20, F.col("event_type") == "error", "1 day", "2 days")
    return screen.run_available(counts, ["window_start"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


QUERIES = {
    "stream_screen": (
        stream_screen,
        """select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as window_start,
 count(*) filter (where value >= 20 and event_type = 'error') as true_positives, count(*) filter (where value >= 20 and event_type <> 'error') as false_positives,
 count(*) filter (where value < 20 and event_type = 'error') as false_negatives, count(*) filter (where value < 20 and event_type <> 'error') as true_negatives, count(*) as total_predictions
 from events where ts is not null group by 1""",
    ),
}
