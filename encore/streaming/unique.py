"""Duplicate suppression with bounded state (R4): a stream that keeps keys only as long as the watermark.

The store's upserts suppress a duplicate however late it comes, by looking into the months it touches.
Where that look is too dear, this stream keeps the keys of recent plays in Spark's state store instead:
a play is passed on once; a repeat within ``delay`` of the newest play is dropped because its key is
known, a record older than that is dropped as late (with it a first play that comes that late), and
the keys behind the watermark are forgotten, so state follows the plays of ``delay``, not the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions.records import parse_records
from encore.sources.files import parse_json_lines

KEY = ["timestamp", "track_id"]


def record_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The readable plays of JSONL files in ``landing_dir``, with names and ids, as a stream."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    parsed = parse_records(parse_json_lines(reader.load(landing_dir)))
    return parsed.filter(F.col("reject_reason").isNull()).drop("reject_reason", "raw_timestamp")


def unique_plays(records: DataFrame, delay: str = "3 days") -> DataFrame:
    """Each (timestamp, track_id) once; keys are kept until the newest play is ``delay`` ahead of them."""
    return records.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(KEY)


def start_unique(
    spark: SparkSession,
    landing_dir: str,
    out: str,
    checkpoint_location: str,
    delay: str = "3 days",
    max_files_per_trigger: int | None = None,
):
    """Append the unique plays of ``landing_dir`` to the Parquet table ``out``; state and progress are in the checkpoint, so it may be stopped and started."""
    plays = unique_plays(record_stream(spark, landing_dir, max_files_per_trigger), delay)
    return (
        plays.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint_location).trigger(availableNow=True).start()
    )
