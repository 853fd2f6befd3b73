"""python -m timberline.cli parse|syslog|query|corpus|score ..."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from timberline.operators import anomaly, corpus, detect, pseudonyms, records, syslog, windows
from timberline.session import ship
from timberline.sources import files, sinks


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="timberline")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("parse", help="lines of any format to canonical records")
    a.add_argument("input")
    a.add_argument("-o", "--output")
    a.add_argument("--format", choices=("ndjson", "pretty"), default="ndjson")
    a.add_argument("--streaming", action="store_true", help="JSON lines, whatever --format says")
    a.add_argument("--llm-endpoint", help="where a language model proposes a format for files that none fits")
    a.add_argument("--llm-model", default="llama3")
    a.add_argument("--anonymize", action="store_true")
    a.add_argument("--sample-size", type=int, default=detect.SAMPLE)
    a.add_argument("--failure-threshold", type=int, default=detect.FAILURES)
    a.add_argument("--no-metadata", action="store_true")
    a = sub.add_parser("syslog", help="syslog lines to structured records")
    a.add_argument("input")
    a.add_argument("-o", "--output", required=True)
    a.add_argument("--anonymize", action="store_true")
    a.add_argument("--keep-raw", action="store_true")
    a = sub.add_parser("query", help="filter and count records")
    a.add_argument("-i", "--input", required=True)
    for name in ("process", "event", "hostname", "pid", "user", "rhost", "message-contains"):
        a.add_argument(f"--{name}")
    a.add_argument("--meta", nargs="*", default=[])
    a.add_argument("--aggregate", "--count-by", choices=records.GROUPS)
    a.add_argument("--limit", type=int, default=100, help="0 for all")
    a.add_argument("--export-json")
    a.add_argument("--export-csv")
    a = sub.add_parser("corpus", help="records to texts")
    a.add_argument("input")
    a.add_argument("-o", "--output-dir", required=True)
    a.add_argument("--stats", action="store_true")
    a = sub.add_parser("score", help="windows of a corpus to anomalies")
    a.add_argument("--corpus", required=True)
    a.add_argument("--window_size", "--window-size", type=int, default=windows.SIZE)
    a.add_argument("--k_mad", "--k", type=float, default=3.0)
    a.add_argument("--test_fraction", "--test-fraction", type=float, default=0.2)
    a.add_argument("--anomaly_ratio", "--anomaly-ratio", type=float, default=0.1)
    a.add_argument("--seed", type=int, default=7)
    return p


def _secret_map(output: str) -> str:
    return str(Path(output).parent / "anonymization_map.json")


def _parse(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = files.read_lines(spark, a.input)
    if a.llm_endpoint:
        detect.register_provided(lines, detect.endpoint(a.llm_endpoint, a.llm_model), a.sample_size)
    rows = detect.parse_lines(lines, a.sample_size, a.failure_threshold)
    stats = [r.asDict() for r in detect.parse_stats(lines, a.sample_size, a.failure_threshold).toLocalIterator()]
    pretty = a.format == "pretty" and not a.streaming
    output = a.output or f"{Path(a.input).with_suffix('')}.parsed.{'json' if pretty else 'ndjson'}"
    if a.anonymize:
        tokens = pseudonyms.dictionary(rows, True)
        rows = pseudonyms.pseudonymised(rows, tokens, True, keep_raw=False)
        sinks.write_dictionary(tokens, f"{output}.anonymization_map", _secret_map(output))
    meta = None if a.no_metadata else {"files": stats}
    if pretty:
        sinks.write_json(rows, output, meta)
    elif meta:
        sinks.write_ndjson_with_stats(rows, meta, output, first=not a.streaming)
    else:
        sinks.write_ndjson(rows, output)
    for r in stats:
        print(", ".join(f"{k}: {v}" for k, v in r.items()))


def _syslog(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = files.read_lines(spark, a.input)
    rows = syslog.parse_syslog(lines)
    if a.anonymize:
        tokens = pseudonyms.dictionary(rows)
        rows = pseudonyms.pseudonymised(rows, tokens, keep_raw=a.keep_raw)
        sinks.write_dictionary(tokens, f"{a.output}.anonymization_map", _secret_map(a.output))
    sinks.write_ndjson(rows, a.output)
    syslog.parse_summary(lines).show(truncate=False)
    syslog.rejected_lines(lines).show(truncate=False)


def _query(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_records(spark, a.input)
    wanted = records.matches(a.pid, a.user, a.rhost, records.meta_args(a.meta), a.message_contains, process=a.process, event=a.event, hostname=a.hostname)
    rows = rows.filter(wanted)
    if a.aggregate:
        out = records.count_by(rows, a.aggregate, a.limit)
        out.show(max(a.limit, 1), truncate=False)
        if a.export_csv:
            sinks.write_counts_csv(out, a.export_csv)
        if a.export_json:
            sinks.write_ndjson(out, a.export_json)
        return
    print(f"{rows.count()} records match")
    out = records.first_rows(rows, a.limit)
    for r in sinks.console_lines(out).toLocalIterator():
        print(r["line"])
    if a.export_csv:
        sinks.write_records_csv(out, a.export_csv)
    if a.export_json:
        sinks.write_json(out, a.export_json) if a.limit else sinks.write_ndjson(out, a.export_json)


def _corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = corpus.renderings(files.read_records(spark, a.input, need_message=True))
    sinks.write_corpus(texts, a.output_dir)
    for r in corpus.RENDERINGS if a.stats else ():
        corpus.token_stats(texts, r).show(truncate=False)


def _score(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = windows.split_windows(windows.count_windows(files.read_corpus(spark, a.corpus), a.window_size), a.test_fraction)
    scorer = anomaly.BigramScorer().fit(parts.filter("part = 'train'"))
    scored = scorer.score(windows.with_attacks(parts.filter("part = 'test'"), a.anomaly_ratio, a.seed)).persist()
    limit = anomaly.threshold(scored, a.k_mad)
    limit.show()
    at = F.lit(limit.first()["threshold"])
    rows = anomaly.predicted(scored, at)
    anomaly.metrics(rows).show()
    for kind in ("top", "bottom", "boundary"):
        anomaly.audit(rows, kind, at).select("window_id", "ppl", "label", F.substring("text", 1, 80)).show(truncate=False)


def main(args: list[str] | None = None) -> None:
    a = _arguments().parse_args(args)
    spark = SparkSession.builder.appName("timberline").getOrCreate()
    ship(spark)
    {"parse": _parse, "syslog": _syslog, "query": _query, "corpus": _corpus, "score": _score}[a.what](spark, a)


if __name__ == "__main__":
    main()
