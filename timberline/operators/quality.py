"""How complete records are, and what masking kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: words that masking must keep
KEPT = (
    "authentication failure", "session opened", "session closed", "check pass", "ALERT", "connection from", "shutdown", "startup", "restart", "Received SNMP",
    "timed out", "exited abnormally", "DHCPDISCOVER", "DHCPOFFER", "terminated", "Normal exit", "imklog", "rejected", "user unknown",
)
FIELDS = ("timestamp", "hostname", "process", "component", "pid", "message", "event")


def fill_rates(records: DataFrame) -> DataFrame:
    """(field, filled, total, rate): how often each field has a value; component and pid, which a line
    may lack, always count as filled."""
    filled = [F.struct(F.lit(f).alias("field"), (F.lit(True) if f in ("component", "pid") else F.coalesce(F.col(f).cast("string"), F.lit("")) != "").alias("ok")) for f in FIELDS]
    rows = records.select(F.explode(F.array(*filled)).alias("x")).groupBy("x.field").agg(F.count_if("x.ok").alias("filled"), F.count("*").alias("total"))
    return rows.withColumn("rate", F.round(100.0 * F.col("filled") / F.col("total"), 2))


def kept_words(records: DataFrame, masked: DataFrame) -> DataFrame:
    """(word, before, kept, rate): in how many messages each word was, and still is after masking."""
    key = ["file_path", "line_number"]
    both = records.select(*key, F.col("message").alias("m0")).join(masked.select(*key, F.col("message").alias("m1")), key)
    words = F.array(*[F.lit(w) for w in KEPT])
    rows = both.select(F.explode(F.filter(words, lambda w: F.contains("m0", w))).alias("word"), "m1")
    agg = rows.groupBy("word").agg(F.count("*").alias("before"), F.count_if(F.contains("m1", F.col("word"))).alias("kept"))
    return agg.withColumn("rate", F.round(100.0 * F.col("kept") / F.col("before"), 2))
