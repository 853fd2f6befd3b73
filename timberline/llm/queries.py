"""Queries of the training-data operators, and SQL where it can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.encode import decode, encode
from timberline.llm.mix import mix, mix_shares
from timberline.llm.runs import collapse_runs, masked_words
from timberline.llm.terms import SCHEMA, TermCounts, delivery_changes, letter_runs, record_changes, term_deltas
from timberline.llm.truncation import find_truncated, truncation_rates
from timberline.operators.instants import resolve_instants
from timberline.session import shared_folder

LINE = ["file_path", "line_number"]


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- 3: repeated consecutive events


def _runs(rows: DataFrame, similarity: float, us: str | None = None, max_gap_us: int | None = None, least: int = 1) -> DataFrame:
    found = collapse_runs(rows, ["file_path", "process"], "line_number", [F.col("event")], masked_words(F.col("message")), similarity, us, max_gap_us, least)
    return found.withColumnsRenamed({"first": "first_line", "last": "last_line", "n": "n_events"})


def _timed(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "canonical").select("file_path", "process", "line_number", "timestamp", "event", "message")
    return resolve_instants(rows, _table(spark, d, "log_files"), "us")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Runs whose events are all like the first one, without a limit of time between them."""
    rows = _table(spark, d, "canonical").select("file_path", "process", "line_number", "event", "message")
    return _runs(rows, 1.0, least=3).select("file_path", "process", "first_line", "last_line")


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    """Every record collapsed: one row per run of any length, with count and duration."""
    return _runs(_timed(spark, d), 1.0, "us")


def p3_similar(spark: SparkSession, d: str) -> DataFrame:
    """Runs of events of which four in five words are those of the first one, at most an hour apart."""
    return _runs(_timed(spark, d), 0.8, "us", 3_600_000_000, 2)


# --- 4: term frequencies


def _lines(df: DataFrame) -> DataFrame:
    return df.dropDuplicates(LINE)


def _line_deltas(lines: DataFrame, sign: int | Column = 1, by: tuple[str, ...] = ()) -> DataFrame:
    return term_deltas(lines, {"message": letter_runs(F.col("message"))}, {"process": F.col("process"), "event": F.col("event")}, sign, by)


def _counts(spark: SparkSession, d: str) -> TermCounts:
    """The counts of the lines received in the first half of the time, updated by what later deliveries change."""
    rows = _table(spark, d, "canonical").select(*LINE, "message", "process", "event", "received_at")
    ends = rows.agg(F.unix_micros(F.min(F.col("received_at").cast("timestamp"))).alias("a"), F.unix_micros(F.max(F.col("received_at").cast("timestamp"))).alias("b")).first()
    half = ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    rows = rows.withColumn("delivery", F.when(F.unix_micros(F.col("received_at").cast("timestamp")) > half, 2).otherwise(1))
    changes = delivery_changes(rows, LINE, ["message", "process", "event"], ["delivery", "received_at"])
    at = shared_folder(spark, "term-deltas")
    _line_deltas(changes, F.col("sign"), ("delivery",)).write.partitionBy("delivery").parquet(at)
    counts = TermCounts(spark, shared_folder(spark, "term-counts"))
    for delivery in (1, 2):
        deltas = spark.read.schema(f"{SCHEMA}, delivery int").parquet(at).filter(F.col("delivery") == delivery).drop("delivery")
        counts = counts.update(deltas)
    return counts


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).marked().filter("mark is not null").select("field_name", "term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d).marked().select("field_name", "term", "occurrences", "records")


def p4_updated(spark: SparkSession, d: str) -> DataFrame:
    """The counts of an earlier state of the table, with late, changed and removed lines applied to them."""
    shared_folder(spark, "term-states")
    now = _lines(_table(spark, d, "canonical").select(*LINE, "message", "process", "event")).checkpoint()
    part = F.pmod(F.xxhash64(*LINE), F.lit(50))
    before = now.filter(part != 0).withColumn("process", F.when(part == 1, "renamed").otherwise(F.col("process")))
    before = before.unionByName(now.filter(part == 2).withColumn("line_number", -F.col("line_number") - 1)).checkpoint()
    removed, added = record_changes(before, now, LINE, ["message", "process", "event"])
    counts = TermCounts(spark, shared_folder(spark, "term-counts")).update(_line_deltas(before))
    counts = counts.update(_line_deltas(removed, -1).unionByName(_line_deltas(added)))
    return counts.marked().select("field_name", "term", "occurrences", "records")


# --- 6: encoding


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(_table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return decode(p6_ids(spark, d))


# --- 7: mixing


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix_shares(p7_mix(spark, d), _table(spark, d, "mix_targets"))


# --- 8: texts cut off


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_truncated(_table(spark, d, "documents")).filter("cut").select(F.col("doc").alias("doc_id"))


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation_rates(find_truncated(_table(spark, d, "documents")))


QUERIES = {"p3_found": p3_found, "p3_runs": p3_runs, "p3_similar": p3_similar, "p4_found": p4_found, "p4_counts": p4_counts, "p4_updated": p4_updated, "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p8_found": p8_found, "p8_rates": p8_rates}

ORACLE = {
    "p3_found": """
        with lines as (select file_path, process, line_number, any_value(event) as event, any_value(message) as message from canonical where process is not null group by all),
        keyed as (select *, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(message), '\\s+'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') then '0' else x end), ' ') as k from lines),
        stepped as (select *, case when event is not distinct from lag(event) over w and k is not distinct from lag(k) over w and lag(line_number) over w is not null then 0 else 1 end as step from keyed window w as (partition by file_path, process order by line_number)),
        runs as (select *, sum(step) over (partition by file_path, process order by line_number) as run from stepped)
        select file_path, process, min(line_number) as first_line, max(line_number) as last_line from runs group by file_path, process, run having count(*) >= 3""",
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p4_counts": """
        with lines as (select file_path, line_number, any_value(message) as message, any_value(process) as process, any_value(event) as event from canonical group by all),
        terms as (select 'message' as field_name, file_path, line_number, unnest(regexp_extract_all(lower(message), '[a-z]+')) as term from lines
            union all select 'process', file_path, line_number, process from lines where process is not null
            union all select 'event', file_path, line_number, event from lines where event is not null)
        select field_name, term, count(*) as occurrences, count(distinct (file_path, line_number)) as records from terms group by all""",
}
ORACLE["p4_found"] = f"""
    with c as ({ORACLE["p4_counts"]}), n as (select count(distinct (file_path, line_number)) as lines from canonical)
    select field_name, term, case when occurrences < 5 then 'rare' else 'common' end as mark from c, n where occurrences < 5 or records > lines * 0.1"""
ORACLE["p4_updated"] = ORACLE["p4_counts"]
