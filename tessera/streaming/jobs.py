"""Job events as streams: the newest progress of each job, its conflicts, counts per window, silent jobs.

Functions take and return DataFrames that may be streaming or not. Events have job_id, kind, at (timestamp),
``seq`` (grows within a job) and a payload. Rows without a job or time are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timely(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events with a watermark: state of jobs and windows older than ``late`` is let go."""
    return events.filter("job_id is not null and at is not null").withWatermark("at", late)


def latest_progress(events: DataFrame) -> DataFrame:
    """The newest progress event of each job: older ones coalesce into it. State is one row per job."""
    rows = events.filter("kind = 'progress' and job_id is not null")
    return rows.groupBy("job_id").agg(F.max_by(F.struct("at", "payload"), "seq").alias("e"), F.max("seq").alias("seq")).select("job_id", "seq", "e.at", "e.payload")


def conflicts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """All conflict events, each once: a repeated delivery (same job and seq within the watermark) is dropped."""
    rows = timely(events, late).filter("kind = 'conflict'")
    return rows.dropDuplicatesWithinWatermark(["job_id", "seq"]) if rows.isStreaming else rows.dropDuplicates(["job_id", "seq"])


def activity(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per kind and tumbling window."""
    return timely(events, late).groupBy(F.window("at", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans of a job's events with no pause of ``gap``; a span's end is when its lease would have run out."""
    return timely(events, late).groupBy("job_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("job_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
