"""Encoding of a corpus with a public byte-level BPE vocabulary, by a global shuffle of distinct words.

Texts are cut into pre-tokens; a block of documents keeps the list of its distinct words and, for each
document, the positions' word numbers. The words of all blocks are shuffled by a hash of the word, so
that each is encoded where all its blocks meet, once; the ids return to the blocks that asked for them
and are put in place of the word numbers. A word crosses the network once per block and not once per
occurrence, so no word is hotter than one row per block, and no table of words is broadcast. A word that
is no token by itself is encoded once where it meets, as long as a task has fewer than ``CACHE_WORDS`` of them.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
BLOCK_CHARS = 8_000_000
BUCKET_BYTES = 1 << 28  # of input for each bucket of words
BUCKETS = (64, 2048)  # at least and at most, so that a block asks a bounded number of them
PIECE_CHARS = 1_000_000
CACHE_WORDS = 1_000_000

# fixed values: the pre-token pattern of the vocabulary; the second form is the same for ASCII texts
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\v\f\rA-Za-z0-9]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+"


@cache
def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks(name, folder), special_tokens={})


@cache
def _patterns():
    import regex

    return re.compile(ASCII_PATTERN), regex.compile(PATTERN)


def pieces(text: str, most: int = PIECE_CHARS) -> Iterator[str]:
    """A long text in parts that no pre-token spans: each cut is before a line break after a non-blank."""
    at = 0
    while len(text) - at > most:
        cut = text.find("\n", at + most)
        while 0 < cut and text[cut - 1].isspace():
            cut = text.find("\n", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_ZSTD = pa.Codec("zstd", 1)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _ZSTD.decompress(data[8:], size, asbytes=True) if size else b""


def _pack_strings(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return len(words).to_bytes(8, "little") + _pack(lengths.tobytes() + b"".join(words))


def _unpack_strings(data: bytes) -> list[bytes]:
    n, raw = int.from_bytes(data[:8], "little"), _unpack(data[8:])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64) + 4 * n
    starts = np.concatenate([[4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


_BLOCKS = pa.schema([("block", pa.int64()), ("words", pa.binary()), ("docs", pa.binary()), ("lengths", pa.binary()), ("numbers", pa.binary())])
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("sum", pa.int64()), ("words", pa.binary())])
_ANSWERED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("sum", pa.int64()), ("counts", pa.binary()), ("ids", pa.binary())])


def _ddl(s: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in s)


def _order(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, and the words' numbers sorted by bucket."""
    b = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int32, len(words))
    return b, np.argsort(b, kind="stable")


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ascii_pattern, pattern = _patterns()
    ascii_words, any_words = ascii_pattern.findall, pattern.findall
    base, count = TaskContext.get().partitionId() << 32, 0
    numbers, docs, lengths, parts, size = _Numbers(), [], [], [], 0

    def block() -> pa.RecordBatch:
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        wide = len(numbers) > 0xFFFF
        packed = _pack(flat.astype(np.uint32 if wide else np.uint16).tobytes())
        words = _pack_strings([w.encode() for w in numbers])
        row = [[base + count], [words], [np.array(docs, np.int64).tobytes()], [np.array(lengths, np.int64).tobytes()], [(b"w" if wide else b"n") + packed]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            n = 0
            find = ascii_words if text.isascii() else any_words
            for piece in pieces(text):
                words = find(piece)
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                n += len(words)
            docs.append(doc)
            lengths.append(n)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield block()
                count += 1
                numbers, docs, lengths, parts, size = _Numbers(), [], [], [], 0
    if docs:
        yield block()


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["block", "words"]).to_pylist():
                words = _unpack_strings(row["words"])
                b, order = _order(words, buckets)
                cuts = np.searchsorted(b[order], np.arange(buckets + 1))
                out = [(k, row["block"], zlib.crc32(row["words"]), _pack_strings([words[i] for i in order[cuts[k] : cuts[k + 1]]])) for k in np.unique(b).tolist()]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _ASKED, strict=True)], schema=_ASKED)

    return ask


def _answer(name: str, folder: str):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, whole = encoder(name, folder), ranks(name, folder)
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                counts, ids = [], []
                for w in _unpack_strings(row["words"]):
                    one = whole.get(w)
                    if one is not None:
                        counts.append(1)
                        ids.append(one)
                        continue
                    got = known.get(w)
                    if got is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        got = known[w] = tuple(enc.encode_ordinary(w.decode()))
                    counts.append(len(got))
                    ids.extend(got)
                out.append((row["block"], row["bucket"], row["sum"], _pack(np.array(counts, np.uint32).tobytes()), _pack(np.array(ids, np.uint32).tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), _ANSWERED, strict=True)], schema=_ANSWERED)

    return answer


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes starts[i] .. starts[i] + counts[i] - 1 for every i, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def _assemble(buckets: int):
    def assemble(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        docs, offsets, values, at = [], [np.zeros(1, np.int64)], [], 0
        for row in blocks.to_pylist():
            words = _unpack_strings(row["words"])
            b, order = _order(words, buckets)
            del words
            counts, ids = [], []
            for a in sorted(answers.to_pylist(), key=lambda x: x["bucket"]):
                if a["sum"] != zlib.crc32(row["words"]):
                    raise RuntimeError("a block was read again in another order of rows than before; checkpoint the texts first")
                counts.append(np.frombuffer(_unpack(a["counts"]), np.uint32))
                ids.append(np.frombuffer(_unpack(a["ids"]), np.uint32))
            by_bucket = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            begin = np.cumsum(by_bucket) - by_bucket
            count_of, start_of = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            count_of[order], start_of[order] = by_bucket, begin
            raw = _unpack(row["numbers"][1:])
            numbers = np.frombuffer(raw, np.uint32 if row["numbers"][:1] == b"w" else np.uint16).astype(np.int64)
            lengths = np.frombuffer(row["lengths"], np.int64)
            n = count_of[numbers]
            values.append(flat[ragged(start_of[numbers], n)])
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(lengths)]
            offsets.append(ends + at)
            at += len(values[-1])
            docs.append(np.frombuffer(row["docs"], np.int64))
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(offsets)), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))
        return pa.table({"doc_id": pa.array(np.concatenate(docs) if docs else np.zeros(0, np.int64)), "ids": lists.cast(pa.list_(pa.int32()))})

    return assemble


def encode(df: DataFrame, doc: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id BIGINT, ids ARRAY<INT>): the ids of every text, without special tokens.

    The strings of special tokens are ordinary text. An empty list for an empty and for a null text.
    Every row gives one row, those with repeated doc ids included; only rows without a doc id are left
    out. Texts of any length are processed whole. An empty table gives no rows. Blocks follow the order of
    rows, which is fixed in tables that are read from files; should a lost block be made again of rows in
    another order, the query fails and doesn't mix them up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    buckets = max(BUCKETS[0], min(BUCKETS[1], size // BUCKET_BYTES))
    src = df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).dropna(subset=["doc"])
    blocks = src.mapInArrow(_to_blocks, _ddl(_BLOCKS)).repartition(n, "block")
    asked = blocks.mapInArrow(_ask(buckets), _ddl(_ASKED))
    answers = asked.repartition(n, "bucket").mapInArrow(_answer(name, folder), _ddl(_ANSWERED)).repartition(n, "block")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_assemble(buckets), "doc_id bigint, ids array<int>")


def decode(df: DataFrame, doc: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) from ids, through the table of each token's bytes (its size is the vocabulary's).

    An empty list gives ''; null ids give null; an id outside the vocabulary raises.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(name, folder)
        tokens = [b""] * (max(table.values()) + 1)
        for t, i in table.items():
            tokens[i] = t
        for batch in batches:
            texts = [None if x is None else b"".join([tokens[i] for i in x]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.select(F.col(doc).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(join, "doc_id bigint, text string")


def with_token_counts(df: DataFrame, text: str, out: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text (0 for null and empty), without a shuffle."""
    kinds = dict(df.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            n = [0 if (x := t.as_py()) is None else sum(len(enc.encode_ordinary(p)) for p in pieces(x)) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, out])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + f", `{out}` bigint"
    return df.select(*[F.col(k) for k in keep], F.col(text).alias("__text")).mapInArrow(count, schema)
