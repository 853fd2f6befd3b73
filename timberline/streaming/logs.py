"""The same operators over streams of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.pseudonyms import grown, pseudonymised
from timberline.operators.syslog import parse_syslog
from timberline.session import written
from timberline.sources.files import valid_text, with_line_numbers

_DICTIONARY = "category string, value string, ordinal int, token string"


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, _block, line) of files as they arrive, undecodable bytes dropped. A stream has no line numbers:
    they need a file's other splits. :func:`numbered` gives them to the files of a micro-batch."""
    raw = spark.readStream.text(folder)
    return raw.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("_block"), valid_text(F.col("value")).alias("line"))


def numbered(batch: DataFrame) -> DataFrame:
    """(file_path, line_number, line) of a micro-batch of :func:`stream_lines`: a file arrives whole, in one
    batch, so its lines are numbered as in a batch run; use it in foreachBatch."""
    return with_line_numbers(batch.withColumn("_id", F.monotonically_increasing_id()))


def stream_syslog(spark: SparkSession, folder: str) -> DataFrame:
    """Structured records of arriving files, without line numbers."""
    lines = stream_lines(spark, folder).drop("_block").withColumn("line_number", F.lit(None).cast("bigint"))
    return parse_syslog(lines)


def event_counts(records: DataFrame, ts: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event, count) over event time; what is later than ``late`` is not counted."""
    w = F.window(ts, window)
    return records.withWatermark(ts, late).groupBy(w.alias("w"), "event").agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), "event", "count")


def stream_sessions(events: DataFrame, entity: list[str], ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(entity..., start, end, n_events) of sessions by inactivity, of a stream or a table."""
    w = F.session_window(ts, gap)
    grouped = events.withWatermark(ts, late).groupBy(*entity, w.alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_events"))
    return grouped.drop("w")


class StreamingDictionary:
    """Pseudonyms that grow with micro-batches, kept under a path; use :meth:`batch` in foreachBatch.

    New values are numbered behind those known. Numbers equal a batch run's as long as input arrives in
    order. A new instance goes on where the last one stopped, and a batch that is run again finds its own
    version and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def version(self) -> int:
        """The last batch whose values are in the dictionary, -1 for none."""
        return max((int(n[1:]) for n in written(self.spark, self.path)), default=-1)

    def tokens(self, version: int | None = None) -> DataFrame:
        at = self.version() if version is None else version
        if at < 0:
            return self.spark.createDataFrame([], _DICTIONARY)
        return self.spark.read.schema(_DICTIONARY).parquet(f"{self.path}/v{at}")

    def batch(self, records: DataFrame, batch_id: int | None = None) -> DataFrame:
        """The batch's records with pseudonyms, after the dictionary has taken in their new values."""
        last = self.version()
        at = last + 1 if batch_id is None else batch_id
        if at > last:
            grown(records, self.tokens(last)).write.mode("overwrite").parquet(f"{self.path}/v{at}")
        return pseudonymised(records, self.tokens(at if at > last else last))
