"""Records as short texts, and statistics of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.text import joined, strip

RENDERINGS = ("message_only", "process_message", "event_message", "full", "raw_masked")
RARE_BELOW = 5


def _known(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c).otherwise("unknown")


def renderings(records: DataFrame) -> DataFrame:
    """The five texts of each record, with its file and line; raw_masked needs masked_log, else it is ''."""
    message, process, event = strip(F.coalesce(F.col("message"), F.lit(""))), _known(F.col("process")), _known(F.col("event"))
    meta = F.nullif(joined(F.col("metadata")), F.lit(""))
    masked = strip(F.coalesce(F.col("masked_log"), F.lit(""))) if "masked_log" in records.columns else F.lit("")
    return records.select(
        "file_path", "line_number", message.alias("message_only"), F.concat_ws(" : ", process, message).alias("process_message"), F.concat_ws(" : ", event, message).alias("event_message"),
        F.concat_ws(" | ", process, event, meta, message).alias("full"), masked.alias("raw_masked"),
    )


def corpus_lines(texts: DataFrame, rendering: str) -> DataFrame:
    """(file_path, line_number, part, line): non-empty texts of one rendering, one row per physical line."""
    parts = texts.filter(F.col(rendering) != "").select("file_path", "line_number", F.posexplode(F.split(rendering, "\n")).alias("part", "line"))
    return parts.withColumn("line", strip(F.col("line"))).filter("line <> ''")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def token_stats(texts: DataFrame, rendering: str, tokenize=tokens, rare_below: int = RARE_BELOW) -> DataFrame:
    """One row: non-empty lines, tokens, distinct and rare ones, and tokens per line, of one rendering."""
    lines = texts.filter(F.col(rendering) != "").select(tokenize(F.col(rendering)).alias("t"))
    # lines are counted beside their tokens in the same pass: a null token stands for each line
    each = lines.select(F.explode(F.concat(F.array(F.lit(None).cast("string")), "t")).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"))
    real = F.col("token").isNotNull()
    total, n = F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0))
    return counts.agg(
        F.lit(rendering).alias("rendering"), n.alias("total_lines"), total.alias("total_tokens"), F.count_if(real).alias("unique_tokens"),
        F.count_if(real & (F.col("n") < rare_below)).alias("rare_tokens"), F.round(F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)), 2).alias("avg_tokens_per_line"),
    )


def vocabulary_reduction(before: DataFrame, after: DataFrame, text: str = "message") -> DataFrame:
    """One row: distinct tokens and mean length of two states of a text, and the reduction in percent."""

    def of(df: DataFrame, name: str) -> DataFrame:
        t = F.coalesce(F.col(text), F.lit(""))
        rows = df.select(F.lit(name).alias("side"), F.length(t).alias("len"), F.explode_outer(F.array_distinct(tokens(t))).alias("token"), F.monotonically_increasing_id().alias("id"))
        return rows

    both = of(before, "b").unionByName(of(after, "a"))
    lengths = both.groupBy("side", "id").agg(F.first("len").alias("len")).groupBy().agg(*[F.avg(F.when(F.col("side") == s, F.col("len"))).alias(n) for s, n in (("b", "avg_before"), ("a", "avg_after"))])
    counts = both.groupBy("side", "token").agg(F.lit(1).alias("one")).filter("token is not null").groupBy().agg(*[F.count_if(F.col("side") == s).alias(n) for s, n in (("b", "tokens_before"), ("a", "tokens_after"))])
    avg = lengths.select(F.struct("*").alias("s")).scalar()
    saved = F.round(F.coalesce(F.try_divide(100.0 * (F.col("tokens_before") - F.col("tokens_after")), F.col("tokens_before")), F.lit(0.0)), 2)
    return counts.select("tokens_before", "tokens_after", saved.alias("reduction"), F.round(avg["avg_before"], 2).alias("avg_length_before"), F.round(avg["avg_after"], 2).alias("avg_length_after"))
