"""Which format each file has, when it changes, and which lines continue an entry.

What a line could be is decided for every line at once by native expressions. Only the choice among
them depends on the lines before it; that choice walks each file's lines in order, over a few bytes per
line, and streams: its memory is one buffer of failures, whatever the file's length.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.stage import staged
from timberline.functions.text import strip
from timberline.functions.vocab import FIELD_OF
from timberline.operators.formats import FORMATS, LineFormat, canonical, continues, fits, json_object, register_format

SAMPLE = 20
FAILURES = 10
JSON_SHARE, LEAST_SCORE, OTHER_SCORE = 0.7, 0.5, 0.2
JSON = -1  # the choice of JSON, among numbers of formats


def line_masks(lines: DataFrame) -> DataFrame:
    """(file_path, line_number, blank, cont, mask, json_ok, json_filled): ``mask`` has a bit per format."""
    df = staged(lines.dropna(subset=["file_path", "line_number"]), {"_s": strip(F.coalesce(F.col("line"), F.lit("")))})
    bits = sum((F.when(fits(F.col("_s"), f), F.lit(1 << i)).otherwise(0) for i, f in enumerate(FORMATS)), F.lit(0))
    keys = json_object(F.col("_s"))
    return df.select("file_path", F.col("line_number").cast("bigint").alias("line_number"), (F.col("_s") == "").alias("blank"), F.coalesce(continues(F.col("line")), F.lit(False)).alias("cont"), bits.alias("mask"), keys.isNotNull().alias("json_ok"), F.coalesce(F.size(keys) > 0, F.lit(False)).alias("json_filled"))


def known_formats() -> list[tuple[str, int]]:
    """Names and priorities of the registered formats, for workers that know only the built-in ones."""
    return [(f.name, f.priority) for f in FORMATS]


def choose(masks: list[int], json_ok: list[bool], known: list[tuple[str, int]] | None = None) -> int | None:
    """The format of a sample: JSON by vote, else the best score; None if none reaches half the lines.

    If any other format fits a fifth of the lines, the key=value format is out of the question.
    """
    n = len(masks)
    if not n:
        return None
    if sum(json_ok) >= JSON_SHARE * n:
        return JSON
    known = known_formats() if known is None else known
    scores = [(sum(m >> i & 1 for m in masks) / n, priority, -i) for i, (_, priority) in enumerate(known)]
    named = [i for i, (name, _) in enumerate(known) if name == "key_value"]
    if any(s >= OTHER_SCORE for i, (s, _, _) in enumerate(scores) if i not in named):
        scores = [x for i, x in enumerate(scores) if i not in named]
    best = max(scores)
    return -best[2] if best[0] >= LEAST_SCORE else None


def name_of(choice: int | None) -> str | None:
    return None if choice is None else "json" if choice == JSON else FORMATS[choice].name


def _sampled(masks: DataFrame, sample: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("file_path").orderBy("line_number"))
    return masks.filter("not blank").withColumn("rank", rank).filter(F.col("rank") <= sample)


def format_scores(lines: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(file_path, format, score): the share of each file's first non-blank lines that has each format."""
    rows = _sampled(line_masks(lines), sample)
    each = F.array(*[F.struct(F.lit(f.name).alias("format"), (F.col("mask").bitwiseAND(1 << i) != 0).cast("double").alias("hit")) for i, f in enumerate(FORMATS)])
    return rows.select("file_path", F.explode(each).alias("x")).groupBy("file_path", "x.format").agg(F.round(F.avg("x.hit"), 6).alias("score"))


def detected_formats(lines: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(file_path, format) from each file's first non-blank lines; null where no format fits."""
    rows = _sampled(line_masks(lines), sample).groupBy("file_path")
    hits = [F.avg((F.col("mask").bitwiseAND(1 << i) != 0).cast("double")).alias(f"s{i}") for i in range(len(FORMATS))]
    df = rows.agg(F.avg(F.col("json_ok").cast("double")).alias("js"), *hits)
    options = F.array(*[F.struct(F.col(f"s{i}").alias("score"), F.lit(f.priority).alias("priority"), F.lit(-i).alias("at"), F.lit(f.name).alias("format")) for i, f in enumerate(FORMATS)])
    others = F.exists(options, lambda x: (x["format"] != "key_value") & (x["score"] >= OTHER_SCORE))
    allowed = F.when(others, F.filter(options, lambda x: x["format"] != "key_value")).otherwise(options)
    best = F.array_max(allowed)
    return df.select("file_path", F.when(F.col("js") >= JSON_SHARE, "json").when(best["score"] >= LEAST_SCORE, best["format"]).alias("format"))


class Walker:
    """State of one file: what its lines are now read as, and the failures since the last success."""

    def __init__(self, failures: int = FAILURES, known: list[tuple[str, int]] | None = None):
        self.limit, self.known = failures, known_formats() if known is None else known
        self.fmt: int | None = None
        self.json = False
        self.fails: list[tuple[int, int, bool, bool]] = []
        self.last: int | None = None
        self.redetections = 0

    def start(self, masks: list[int], json_ok: list[bool]) -> None:
        self._set(choose(masks, json_ok, self.known))

    def _set(self, choice: int | None) -> bool:
        self.json = choice == JSON
        if choice is not None and choice != JSON:
            self.fmt = choice
        return choice is not None

    def _read(self, mask: int, filled: bool) -> str | None:
        if self.json and filled:
            return "json"
        return self.known[self.fmt][0] if self.fmt is not None and mask >> self.fmt & 1 else None

    def flush(self) -> list[tuple]:
        out = [(n, "fallback", None, False) for n, *_ in self.fails]
        self.fails = []
        return out

    def line(self, n: int, blank: bool, cont: bool, mask: int, ok: bool, filled: bool) -> list[tuple]:
        """(line, what it is, the entry it continues, read again) of every line that is now decided."""
        if blank:
            return [(n, "blank", None, False)]
        if not self.fails and self.last is not None and cont:
            return [(n, "cont", self.last, False)]
        got = self._read(mask, filled)
        if got is not None:
            out = self.flush()
            self.last = n
            return [*out, (n, got, None, False)]
        self.fails.append((n, mask, ok, filled))
        if len(self.fails) < self.limit:
            return []
        if not self._set(choose([m for _, m, _, _ in self.fails], [o for _, _, o, _ in self.fails], self.known)):
            return self.flush()
        self.redetections += 1
        out = [(k, got or "fallback", None, got is not None) for k, m, _, f in self.fails for got in [self._read(m, f)]]
        self.fails = []
        return out


_RESOLVED = "file_path string, line_number bigint, resolved string, parent bigint, replayed boolean, redetections bigint"


def resolve_lines(lines: DataFrame, sample: int = SAMPLE, failures: int = FAILURES) -> DataFrame:
    """(file_path, line_number, resolved, parent, replayed, redetections) of every line.

    ``resolved`` is a format, json, fallback, cont (then ``parent`` is the line it continues) or blank.
    A file starts with the format of its first lines; after ``failures`` lines in a row that don't have
    it, those lines decide anew and are read again. Lines delivered again count once. ``redetections``
    counts the file's changes so far.
    """

    known = known_formats()

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, walker, seen, held = None, Walker(failures, known), None, []

        def emit(rows: list[tuple]) -> None:
            out.extend((path, *r, walker.redetections) for r in rows)

        def begin() -> None:
            nonlocal held
            if held is not None:
                full = [r for r in held if not r[1]][:sample]
                walker.start([r[3] for r in full], [r[4] for r in full])
                for r in held:
                    emit(walker.line(*r))
                held = None

        out: list[tuple] = []
        for pdf in batches:
            for p, *row in pdf[["file_path", "line_number", "blank", "cont", "mask", "json_ok", "json_filled"]].itertuples(index=False, name=None):
                if p != path:
                    if path is not None:
                        begin()
                        emit(walker.flush())
                    path, walker, seen, held = p, Walker(failures, known), None, []
                if row[0] == seen:
                    continue
                seen = row[0]
                if held is None:
                    emit(walker.line(*row))
                else:
                    held.append(tuple(row))
                    if sum(not r[1] for r in held) >= sample:
                        begin()
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESOLVED.split(", ")]).astype({"parent": "Int64"})
                out.clear()
        if path is not None:
            begin()
            emit(walker.flush())
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESOLVED.split(", ")]).astype({"parent": "Int64"})

    masks = line_masks(lines)
    return masks.repartition("file_path").sortWithinPartitions("file_path", "line_number").mapInPandas(walk, _RESOLVED)


def parse_lines(lines: DataFrame, sample: int = SAMPLE, failures: int = FAILURES) -> DataFrame:
    """Canonical records of lines of unknown and changing formats; continuations are appended to the
    message of the record that they continue, whose event stays."""
    once = lines.dropna(subset=["file_path", "line_number"]).dropDuplicates(["file_path", "line_number"])
    resolved = resolve_lines(lines, sample, failures)
    rows = once.select("file_path", F.col("line_number").cast("bigint").alias("line_number"), "line").join(resolved, ["file_path", "line_number"])
    heads = canonical(rows.filter("resolved not in ('cont', 'blank')").select("file_path", "line_number", "line", F.col("resolved").alias("_format"), "replayed"))
    tails = rows.filter("resolved = 'cont'").groupBy("file_path", F.col("parent").alias("line_number")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", strip(F.col("line")).alias("t")))), lambda x: x["t"]), "\n").alias("_more"))
    full = heads.join(tails, ["file_path", "line_number"], "left")
    return full.withColumn("message", F.when(F.col("_more").isNotNull(), F.concat("message", F.lit("\n"), "_more")).otherwise(F.col("message"))).drop("_more")


def parse_stats(lines: DataFrame, sample: int = SAMPLE, failures: int = FAILURES) -> DataFrame:
    """Per file: lines, parsed ones (fallback included), unparsed ones, continuations, changes of format,
    lines read again, the formats found and the rates of parsed and of truly parsed lines."""
    r = resolve_lines(lines, sample, failures)
    known = ~F.col("resolved").isin("cont", "blank", "fallback")
    agg = r.groupBy("file_path").agg(
        F.count("*").alias("total_lines"), F.count_if(~F.col("resolved").isin("cont", "blank")).alias("parsed_lines"), F.count_if(F.col("resolved") == "fallback").alias("failed_lines"),
        F.count_if(F.col("resolved") == "cont").alias("multiline_continuations"), F.max("redetections").alias("format_redetections"), F.count_if("replayed").alias("replayed_lines"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("resolved")))), ",").alias("formats_detected"), F.count_if(known).alias("_known"),
    )
    rate = lambda c: F.round(100.0 * F.col(c) / F.greatest(F.col("total_lines"), F.lit(1)), 1)
    return agg.select(*[c for c in agg.columns if c != "_known"], rate("parsed_lines").alias("parse_rate"), rate("_known").alias("strict_rate"))



FormatProvider = Callable[[list[str]], str | None]


def provided_format(sample: list[str], provider: FormatProvider) -> LineFormat | None:
    """A format whose pattern another program (say, a language model) proposes for lines that no format fits.

    The pattern needs ten characters, a named group, and to match at least half the lines; code fences
    around it are dropped. Group names go through the JSON aliases. Any failure gives None.
    """
    try:
        answer = provider(sample[:10])
        text = re.sub(r"^```\w*\s*|\s*```$", "", (answer or "").strip())
        compiled = re.compile(text)
    except Exception:  # whatever the provider does must not stop a run
        return None
    names = sorted(compiled.groupindex, key=compiled.groupindex.get)
    if len(text) < 10 or not names or sum(bool(compiled.match(x)) for x in sample) < LEAST_SCORE * len(sample):
        return None
    groups = [""] * compiled.groups
    for n in names:
        groups[compiled.groupindex[n] - 1] = n
    fields = {n: FIELD_OF[n.lower()] for n in names if n.lower() in FIELD_OF}
    level = next((n for n, t in fields.items() if t == "severity"), None)
    java = re.sub(r"\(\?P<\w+>", "(", text)
    return LineFormat("provided", f"(?d)(?U){java if java.startswith('^') else '^' + java}", tuple(groups), 20, {n: t for n, t in fields.items() if t != "severity"}, level)


def endpoint(url: str, model: str, seconds: float = 60) -> FormatProvider:
    """A provider that asks a model behind an HTTP interface for a pattern."""

    def ask(lines: list[str]) -> str | None:
        prompt = "Give one Python regular expression with named groups that matches each of these log lines, and nothing else:\n" + "\n".join(lines)
        body = json.dumps({"model": model, "prompt": prompt, "stream": False}).encode()
        request = urllib.request.Request(f"{url.rstrip('/')}/api/generate", body, {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.loads(answer.read()).get("response")

    return ask


def register_provided(lines: DataFrame, provider: FormatProvider, sample_size: int = SAMPLE, most_files: int = 20) -> list[str]:
    """Registers a proposed format for each of the first files that no format fits; returns their names.

    ``most_files`` bounds how often the provider is asked; the other files stay without a format, as they
    are without a provider.
    """
    plain = detected_formats(lines, sample_size).filter("format is null").orderBy("file_path").limit(most_files)
    texts = lines.dropna(subset=["file_path", "line_number"]).withColumn("blank", strip(F.coalesce(F.col("line"), F.lit(""))) == "")
    rows = _sampled(texts, sample_size).join(plain.select(F.col("file_path").alias("_f")), F.col("file_path") == F.col("_f")).orderBy("file_path", "line_number").select("file_path", "line").collect()  # at most most_files * sample_size
    by: dict[str, list[str]] = {}
    for r in rows:
        by.setdefault(r["file_path"], []).append(r["line"])
    found = []
    for i, sample in enumerate(by.values()):
        fmt = provided_format(sample, provider)
        if fmt is not None:
            found.append(f"provided_{i}")
            register_format(replace(fmt, name=found[-1]))
    return found
