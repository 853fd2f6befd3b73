"""Texts that were cut off, and how often each source cuts.

A backward character n-gram model is counted over the whole corpus: for the last characters of a text,
how often texts of its source end there, how often lines do, and how often the text goes on, at every
position. Two probabilities, of a text's and of a line's end after these characters, are interpolated
from the shortest context to the longest, each order with those below it as its prior. Their logs are
weighed into the log-odds of a cut against an end, with weights of each source and a threshold of each
language in it, fitted to the texts of which it is known: layouts that say how they end, and texts with a
recorded number of cells. A text is found only if its score proposes it; then what its layout and its
cells prove can refute it, or save it the need of a clear score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.functions.stage import staged
from timberline.session import shared_folder

LOW, HIGH = (1, 2, 3, 4), (6, 8, 12, 16)
ORDERS = LOW + HIGH
PRIOR = 30.0  # occurrences that the lower orders count for
PROPOSED = -5.0  # log-odds of a cut that a text needs to be looked at
SUREST = -8.0  # log-odds below which the model isn't believed: a cut can fall just where texts end
CLEAR = 2.0  # log-odds of a cut beyond which a stop after a letter proves nothing
SAMPLE = 20_000  # labelled texts that the weights are fitted to, in all and of each source
WEIGHTS = (-2.0, -1.0, -0.8)  # where no text is labelled: of a cut at even odds, of the end of texts, of lines
HELD_TO = (0.4, 4.0, 4.0)  # how strongly a source's weights are held to those of all
BITS = 22  # log2 of the size of the filter of end contexts: 512 KB, whatever the corpus
PART = 1 << 16
MOST_SUMS = 1 << 22  # contexts of which a task holds sums before it sends them on
HELD = 1 << 21  # positions of a source whose low orders are counted at once
_STEPS = ((1, 1), (2, 2), (4, 2), (4, 4), (8, 4), (8, 8))
_P_INT, _Q = 0x9E3779B97F4A7C15, np.uint64(0xC2B2AE3D27D4EB4F)
_LUT = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LUT[48:58] = 49  # every digit is 0
_GAP = b"\0" * max(ORDERS)


def _salt(source: str | None, k: int) -> np.uint64:
    return np.uint64((zlib.crc32(f"{k}|{source}".encode()) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)


def _mix(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = h ^ salt
    x ^= x >> np.uint64(29)
    x *= _Q
    x ^= x >> np.uint64(32)
    return x


def _rolling(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each high order, a hash of the context that ends at each position."""
    hashes = {1: codes}
    for a, b in _STEPS:  # a context of order a + b is one of order a, and before it one of order b
        h = hashes[a].copy()
        h[a:] += hashes[b][:-a] * np.uint64(pow(_P_INT, a, 1 << 64))
        hashes[a + b] = h
        if a + b in HIGH:
            yield a + b, h


def _packed(codes: np.ndarray) -> np.ndarray:
    """The last four characters at each position as one number, the last on top: of order k it is the
    upper k bytes, so that one sorting counts all low orders, without collisions."""
    c = codes.astype(np.uint8).astype(np.uint32)  # a byte 255 isn't in any text
    out = c << np.uint32(24)
    for j in (1, 2, 3):
        out[j:] |= c[:-j] << np.uint32(24 - 8 * j)
    return out


def _contexts(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each order, a number for the context that ends at each position."""
    packed = _packed(codes)
    for k in LOW:
        yield k, (packed >> np.uint32(32 - 8 * k)).astype(np.uint64)
    yield from _rolling(codes)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values of a sorted array, and where each begins."""
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[at], at


def _codes(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    codes = _LUT[b]
    codes[b == 0] = 0
    return codes


_BLANKS = " \n\t\r\f\v\u00a0\u3000…"


def plain(text: Column) -> Column:
    """Line ends as one, without blanks and an ellipsis character at the end."""
    return F.rtrim(F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text), F.lit(_BLANKS))


def _end_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sources, tails = b.column("source").to_pylist(), b.column("tail").to_pylist()
        out = np.zeros((len(tails), len(ORDERS)), np.int64)
        for s in set(sources):
            rows = np.array([i for i, x in enumerate(sources) if x == s])
            texts = [tails[i][-max(ORDERS) :] for i in rows]
            ends = np.cumsum([len(t) + len(_GAP) for t in texts]) - 1
            for k, (order, h) in enumerate(_contexts(_codes(_GAP + _GAP.join(texts)))):
                out[rows, k] = _mix(h[ends], _salt(s, order)).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1, dtype=np.int32) * len(ORDERS)), pa.array(out.ravel()))
        yield pa.RecordBatch.from_arrays([b.column("doc"), lists], names=["doc", "contexts"])


class _Sums:
    """Occurrences of contexts, and how many of them a line's end follows."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((2, 0))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, h: np.ndarray, t: np.ndarray, stops: np.ndarray) -> None:
        self.held.append((h, t, stops))
        self.size += len(h)
        if self.size > 1_000_000:
            self.fold()

    def fold(self) -> None:
        if self.held:
            h, t, s = (np.concatenate(x) for x in zip((self.keys, *self.sums), *self.held, strict=True))
            self.keys, at = np.unique(h, return_inverse=True)
            self.sums = np.stack([np.bincount(at, t, len(self.keys)), np.bincount(at, s, len(self.keys))])
            self.held, self.size = [], 0

    def sent(self) -> Iterator[pa.RecordBatch]:
        """The sums so far, which are then forgotten."""
        self.fold()
        keys, sums = self.keys, self.sums
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((2, 0))
        for i in range(0, len(keys), 100_000):
            cut = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[cut].view(np.int64)), *(pa.array(x[cut].astype(np.int64)) for x in sums)], names=["h", "t", "stops"])


def _occurrences(bits):
    """Counts of the contexts that pass the filter, over all positions of all texts of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        sums = _Sums()

        def passing(h: np.ndarray) -> np.ndarray:
            return wanted[(h >> np.uint64(64 - BITS)).view(np.int64)]

        def low(s: str | None, inside: list[np.ndarray], stop: list[np.ndarray]) -> None:
            every, stops = np.sort(np.concatenate(inside)), np.sort(np.concatenate(stop))
            for k in LOW:
                shift = np.uint32(32 - 8 * k)
                keys, at = _runs(every >> shift)
                ended, from_ = _runs(stops >> shift)
                n = np.zeros(len(keys))
                n[np.searchsorted(keys, ended)] = np.diff(from_, append=len(stops))
                h = _mix(keys.astype(np.uint64), _salt(s, k))
                ok = passing(h)
                sums.add(h[ok], np.diff(at, append=len(every))[ok].astype(float), n[ok])

        for b in batches:
            by: dict[str | None, list[bytes]] = {}
            for s, t in zip(b.column("source").to_pylist(), b.column("text"), strict=True):
                by.setdefault(s, []).append(t.as_py())
            for s, texts in by.items():
                held, held_stops, size = [], [], 0
                for raw in _limited(texts):
                    codes = _codes(raw)
                    after = np.append(codes[1:], np.uint64(0))
                    inside, stop = after != 0, after == _LUT[10]
                    inside[: max(ORDERS) - 1] = stop[: max(ORDERS) - 1] = False  # counted in the piece before
                    packed = _packed(codes)
                    held.append(packed[inside])
                    held_stops.append(packed[stop])
                    size += len(held[-1])
                    if size >= HELD:
                        low(s, held, held_stops)
                        held, held_stops, size = [], [], 0
                    for k, h in _rolling(codes):
                        h = _mix(h, _salt(s, k))
                        at = np.flatnonzero(passing(h) & inside)
                        sums.add(h[at], np.ones(len(at)), stop[at].astype(float))
                if held:
                    low(s, held, held_stops)
            if len(sums.keys) > MOST_SUMS:
                yield from sums.sent()
        yield from sums.sent()

    return count


def _limited(texts: list[bytes]) -> Iterator[bytes]:
    """The texts, with gaps between, in pieces of bounded size; each begins with the characters that the
    longest context at the end of the one before has, as what follows that context is in this one."""
    part, size = [_GAP], 0
    for t in texts:
        for i in range(0, len(t), PART):
            part.append(t[i : i + PART])
            size += len(part[-1])
            if i + PART >= len(t):
                part.append(_GAP)
            if size >= PART:
                yield (raw := b"".join(part))
                part, size = [raw[-len(_GAP) :]], 0
    if size:
        yield b"".join(part)


# --- what layouts say about their end

# fixed values: texts that begin a cell or an output in each layout; the first two start a line
CELL = {
    "percent": ("\n# %%", "\n\n#>"),
    "json": ('"cell_type":', '"output_type":'),
    "tag": ('<cell type="',),
}


def _count(text: Column, part: str) -> Column:
    """Occurrences of a fixed text that doesn't overlap itself."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def layout(text: Column) -> Column:
    head = F.ltrim(F.substring(text, 1, 64), F.lit(" \n\t\r"))
    return (
        F.when(head.startswith("{"), "json")
        .when(head.startswith("<notebook"), "tag")
        .when(head.startswith("# %%"), "percent")
        .when(head.startswith("In [") | text.contains("\nIn ["), "log")
        .otherwise("markdown")
    )


def _blocks(text: Column, kind: Column) -> Column:
    """Cells of a text in which blank lines separate them: a heading and what follows it are one cell;
    fenced blocks, and an output with its own blank lines, too."""
    text = F.regexp_replace(text, r"\n[^\S\n]*+\n(?:[^\S\n]*+\n)*+", "\n\n")
    # every second part of a text split at fences is inside one; there, lines are no blocks of their own
    parts = F.split(F.concat(F.lit("\n"), text), r"\n```[^\n]*")
    outside = F.array_join(F.filter(parts, lambda x, i: i % 2 == 0), "\n\n```\n\n")
    out = F.regexp_replace(text, r"\n\n(?=\[\d+ rows x \d+ columns\]|\w+(?:Error|Exception|Interrupt|Warning)\b: )", "\n")
    bare = F.when(kind == "markdown", F.when(text.contains("```"), outside).otherwise(text)).otherwise(out)
    joined = F.when(bare.contains("## "), F.regexp_replace(bare, r"(?<=\n|^)(## [^\n]*)\n\n+(?!```|In \[|Out ?\[|## |\n)", "$1\n")).otherwise(bare)
    return F.size(F.split(F.trim(joined, F.lit(_BLANKS)), r"\n\n+"))


def cells(text: Column, kind: Column) -> Column:
    out = F.when(kind.isin("markdown", "log"), _blocks(text, kind))
    for k, marks in CELL.items():
        at = F.concat(F.lit("\n"), F.ltrim(text, F.lit(_BLANKS))) if k == "percent" else text
        out = out.when(kind == k, sum((_count(at, m) for m in marks), F.lit(0)))
    return out


def closed(text: Column, kind: Column) -> Column:
    """Whether the end is the layout's own closing; null where a layout has none."""
    # an object that is whole ends with a brace in the first column, or has as many closing as opening ones
    whole = text.endswith("}") & (text.endswith("\n}") | (_count(text, "{") == _count(text, "}")))
    after = F.substring_index(text, "</notebook>", -1)
    ended = text.contains("</notebook>") & after.rlike(r"^\s*(?:<!--[^<]*-->)?$")
    return F.when(kind == "json", whole).when(kind == "tag", ended)


def _features(df: DataFrame, doc: str, text: str, source: str, lang: str, n_cells: str | None) -> DataFrame:
    rows = df.filter(F.col(doc).isNotNull() & F.col(text).rlike(r"\S")).select(
        F.col(doc).alias("doc"),
        F.coalesce(F.col(source), F.lit("")).alias("source"),
        F.coalesce(F.col(lang), F.lit("")).alias("lang"),
        (F.col(n_cells) if n_cells else F.lit(None)).cast("int").alias("n_cells"),
        F.length(text).alias("n_chars"),
        F.octet_length(text).alias("n_bytes"),
        F.rtrim(F.col(text), F.lit(_BLANKS.replace("…", ""))).endswith("…").alias("ellipsis"),
        plain(F.col(text)).alias("__plain"),
    )
    rows = staged(rows, {"plain": F.col("__plain")}).drop("__plain")
    kind = layout(F.col("plain"))
    word = F.regexp_extract(F.expr("right(plain, 200)"), r"(\w{3,})\W{0,3}$", 1)
    before = F.expr("left(plain, length(plain) - 3)")
    again = F.rlike(F.substring(before, 1, F.length(before) - F.length(word)), F.concat(F.lit(r"(?U)\b"), word, F.lit(r"\b")))
    return rows.select(
        "doc", "source", "lang", "n_chars", "n_bytes", "ellipsis",
        F.expr("right(plain, 16)").cast("binary").alias("tail"),
        F.expr("xxhash64(right(plain, 200))").alias("copy"),
        ((word != "") & again).alias("word_again"),
        F.expr("right(plain, 1)").isin(*".!?。！？").alias("stopped"),
        F.expr("right(plain, 2)").rlike(r"^\p{L}").alias("after_letter"),
        (F.col("n_cells") - cells(F.col("plain"), kind)).alias("missing"),
        closed(F.col("plain"), kind).alias("closed"),
        (_count(F.col("plain"), "\n") + 1).alias("lines"),
    )


def end_scores(df: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", n_cells: str | None = "n_cells") -> DataFrame:
    """One row per text that has a non-blank character: its features; ``orders``, of each order that is
    counted the texts that end so (copies as one, itself among them), the positions that go on and those
    of them at a line's end; ``text_end`` and ``line_end``, the log of how much likelier an end is there
    than anywhere in the source."""
    spark = df.sparkSession
    shared_folder(spark, "ends")
    feats = _features(df, doc, text, source, lang, n_cells).checkpoint()
    tails = feats.select("doc", "source", "tail").mapInArrow(_end_contexts, "doc bigint, contexts array<bigint>")
    ends = tails.select("doc", F.posexplode("contexts").alias("k", "h"))
    # copies of one text that end alike are one witness
    witnesses = feats.select("doc", "copy").join(ends, "doc").groupBy("h", "copy").agg(F.max("k").alias("k"))
    n_ends = witnesses.groupBy("h").agg(F.count("*").alias("e"), F.max("k").alias("k"))
    # a context of a high order that a single text ends with says nothing that shorter ones don't
    n_ends = n_ends.filter((F.col("e") >= 2) | (F.col("k") < len(LOW)))
    bucket = F.shiftrightunsigned(F.col("h"), 64 - BITS) + 1  # bitmaps count from 1
    maps = n_ends.select(bucket.alias("b")).groupBy(F.bitmap_bucket_number(F.col("b")).alias("n")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b"))).alias("bits"))
    bits = bytearray((1 << BITS) // 8)
    for r in maps.collect():  # at most 2^BITS bits, whatever the corpus
        bits[(r["n"] - 1) * 4096 : r["n"] * 4096] = r["bits"]
    shared = spark.sparkContext.broadcast(bytes(bits))
    texts = df.filter(F.col(text).rlike(r"\S")).select(F.coalesce(F.col(source), F.lit("")).alias("source"), plain(F.col(text)).cast("binary").alias("text"))
    seen = texts.mapInArrow(_occurrences(shared), "h bigint, t bigint, stops bigint").groupBy("h").agg(F.sum("t").alias("t"), F.sum("stops").alias("stops"))
    known = n_ends.join(seen, "h", "left").select("h", "e", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("stops", F.lit(0)).alias("stops"))
    counts = ends.join(known, "h").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("k", "e", "t", "stops"))).alias("orders"))
    sizes = feats.groupBy("source").agg(F.sum("n_chars").cast("double").alias("chars"), F.count("*").alias("docs"), F.sum("lines").alias("all_lines"))
    rows = feats.join(counts, "doc", "left").join(sizes, "source")
    text_rate, line_rate = F.col("docs") / F.col("chars"), F.col("all_lines") / F.col("chars")

    def longer(p: Column, x: Column) -> Column:
        n = x["t"] + x["e"] - 1
        return F.struct(((x["e"] - 1 + PRIOR * p["text"]) / (n + PRIOR)).alias("text"), ((x["stops"] + PRIOR * p["line"]) / (x["t"] + PRIOR)).alias("line"))

    start = F.struct(text_rate.alias("text"), line_rate.alias("line"))
    ends_at = F.when(F.col("orders").isNull(), start).otherwise(F.aggregate("orders", start, longer))
    rows = staged(rows.withColumns({"text_rate": text_rate, "line_rate": line_rate}), {"p": ends_at})
    features = ("doc", "source", "lang", "word_again", "stopped", "after_letter", "copy", "missing", "closed", "ellipsis", "n_chars", "n_bytes")
    return rows.select(*features, "orders", F.log(F.col("p.text") / F.col("text_rate")).alias("text_end"), F.log(F.col("p.line") / F.col("line_rate")).alias("line_end"))


# --- weights


def fitted(x: np.ndarray, cut: np.ndarray, prior: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Logistic weights of columns ``x``, the first of which is 1, held to a prior."""
    w = prior.copy()

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - cut @ z + held @ (v - prior) ** 2 / 2)

    now = loss(w)
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (q - cut) + held * (w - prior)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(held), slope)
        size = 1.0
        while loss(w - size * step) > now - 1e-4 * size * (slope @ step) and size > 1e-10:
            size /= 2
        w = w - size * step
        last, now = now, loss(w)
        if last - now < 1e-9 * (1 + abs(now)):
            break
    return w


def weights(x: np.ndarray, cut: np.ndarray, prior: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Fitted once more without the texts that have all their cells and yet look cut, as the last cell may be."""
    w = fitted(x, cut, prior, held)
    for _ in range(3):
        clean = cut.astype(bool) | (x @ w <= 0)
        w = fitted(x[clean], cut[clean], prior, held)
    return w


def _with_ones(pdf: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), pdf["text_end"], pdf["line_end"]])


def _of_source(everywhere: np.ndarray):
    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, cut = _with_ones(pdf), pdf["cut"].to_numpy(float)
        w = weights(x, cut, everywhere, np.array(HELD_TO))
        shift = {}
        for lang, at in pdf.groupby("lang").indices.items():
            z = x[at] @ w
            clean = cut[at].astype(bool) | (z <= 0)
            b = fitted(np.column_stack([np.ones(clean.sum()), z[clean]]), cut[at][clean], np.array([0.0, 1.0]), np.array([HELD_TO[1], 1e6]))
            shift[lang] = float(b[0])
        return pd.DataFrame({"of": [key[0]], "w": [w.tolist()], "langs": [list(shift)], "shifts": [list(shift.values())]})

    return fit


def log_odds(scores: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``scores`` with ``log_odds``: the ends weighed by their source and language.

    The weights are fitted to about ``sample`` texts of which it is known whether they were cut, or all if
    there are fewer: on the driver for the corpus, in a task for each source, held to the corpus's.
    """
    proven = (F.coalesce("missing", F.lit(0)) > 0) | ~F.coalesce("closed", F.lit(True))
    told = scores.filter("missing is not null or closed is not null").select("doc", "source", "lang", "text_end", "line_end", proven.cast("int").alias("cut"))
    draw = F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) / float(1 << 20)
    n = told.count()
    some = told.filter(draw <= sample / max(n, 1)).select("text_end", "line_end", "cut").toPandas()  # about sample rows
    all_over = weights(_with_ones(some), some["cut"].to_numpy(float), np.array(WEIGHTS), np.full(3, 0.01))
    per = told.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "_s")
    fits = told.join(per, F.col("source") == F.col("_s")).filter(draw <= F.lit(sample) / F.col("n")).select("source", "lang", "text_end", "line_end", "cut")
    fits = fits.groupBy("source").applyInPandas(_of_source(all_over), "of string, w array<double>, langs array<string>, shifts array<double>")
    rows = scores.join(fits, F.col("source") == F.col("of"), "left")
    w = F.coalesce(F.col("w"), F.array(*[F.lit(float(v)) for v in all_over]))
    shift = F.coalesce(F.try_element_at(F.map_from_arrays("langs", "shifts"), F.col("lang")), F.lit(0.0))
    z = w[0] + w[1] * F.col("text_end") + w[2] * F.col("line_end") + shift
    return rows.withColumn("log_odds", z).drop("of", "w", "langs", "shifts")


def field_limits(scores: DataFrame, share: float = 0.01, least: int = 4) -> DataFrame:
    """(source, limits): the lengths, each with its unit, characters or bytes, at which a source's texts pile
    up, and the log of how many more texts have it than if lengths were spread evenly.

    They are the lengths that at least ``share`` of a source's texts have, and ``least`` different ones.
    """
    both = scores.select("source", "copy", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("n")))).alias("x")).select("source", "copy", "x.*")
    piles = both.groupBy("source", "unit", "n", "copy").count().groupBy("source", "unit", "n").agg(F.count("*").alias("texts"))
    every = both.groupBy("source", "unit").agg(F.count("*").alias("docs"), (F.max("n") - F.min("n") + 1).alias("span"))
    high = piles.join(every, ["source", "unit"]).filter((F.col("texts") >= least) & (F.col("texts") >= share * F.col("docs")))
    return high.groupBy("source").agg(F.collect_list(F.struct("unit", F.col("n").alias("most"), F.log(F.col("texts") * F.col("span") / F.col("docs")).alias("odds"))).alias("limits"))  # at most 2 / share


def find_truncated(df: DataFrame, proposed: float = PROPOSED, **columns: str) -> DataFrame:
    """(doc, source, lang, log_odds, cut) of every text that has a non-blank character.

    The score proposes: no text below ``proposed`` is cut, where a text as long as a field limit of its
    source has the log-odds of that, too. Of those proposed, a layout's own closing, or
    as many cells as were recorded and more, refute; a missing closing and missing cells confirm, and so
    does a field limit that the text fills without stopping at a sentence's end. Where nothing is known,
    the score must be above 0, and above ``CLEAR`` for a text that stops like a sentence after a letter;
    a stop after anything else, such as a number, and a last word that the text has before, refute it.
    Null, empty and blank texts aren't listed. Rows with a null id are left out; repeated ids must be of
    equal texts. An empty table gives no rows.
    """
    scores = end_scores(df, **columns).checkpoint()
    rows = log_odds(scores).join(field_limits(scores), "source", "left")
    fills = F.filter("limits", lambda x: F.when(x["unit"] == "chars", F.col("n_chars").between(x["most"] - 1, x["most"])).otherwise(F.col("n_bytes").between(x["most"] - 3, x["most"])))
    rows = staged(rows, {"at_limit": F.array_max(F.transform(fills, lambda x: x["odds"]))})
    full, odds = F.col("at_limit").isNotNull(), F.col("log_odds")
    scored = (odds > 0) & ~F.col("word_again") & (~F.col("stopped") | (F.col("after_letter") & (odds > CLEAR)))
    found = (
        F.when(F.col("missing") > 0, True)
        .when(F.col("closed").isNotNull(), ~F.col("closed"))
        .when(F.col("missing") < 0, False)
        .when(full, F.col("ellipsis") | ~F.col("stopped"))
        .otherwise(scored | (F.col("ellipsis") & (odds > 0)))
    )
    return rows.select("doc", "source", "lang", "log_odds", ((F.greatest(odds, F.lit(SUREST)) + F.coalesce("at_limit", F.lit(0.0)) > proposed) & found).alias("cut"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, n_texts, n_cut, rate) of the result of :func:`find_truncated`."""
    return found.groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("rate"))
