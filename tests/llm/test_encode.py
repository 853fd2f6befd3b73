import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import encode as m

pytestmark = pytest.mark.skipif(not os.path.exists(f"{m.TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary here")

TEXTS = ["Hello world", "", None, "  two  blanks\n\n\tand tabs \n", "<|endoftext|> is text", "été über 日本語 שלום 👩‍👩‍👧", "don't we'll I'M", "a\r\nb c d\x1c\x1d", "x" * 300_000, "\n" * 5000, "the the the the", "0\x00\x01", " ", "tail "]


def test_ids_equal_the_library_and_decode(spark):
    df = spark.createDataFrame([(i, t, 1, "w") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2, "w"), (None, "lost", 3, "w")], "doc_id bigint, text string, block int, words string")
    out = m.encode(df)
    got = sorted((r["doc_id"], list(r["ids"])) for r in out.collect())
    enc = m.encoder()
    assert got == sorted([(i, enc.encode_ordinary(t or "")) for i, t in enumerate(TEXTS)] + [(3, enc.encode_ordinary(TEXTS[3]))])
    back = {r["doc_id"]: r["text"] for r in m.decode(out).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_small_blocks_give_the_same(spark, monkeypatch):
    docs = [(i, f"word{i % 7} and {'x' * (i % 5)} text {i}\n") for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = {i: m.encoder().encode_ordinary(t) for i, t in docs}
    assert {r["doc_id"]: list(r["ids"]) for r in m.encode(df).collect()} == want
    import pyarrow as pa

    monkeypatch.setattr(m, "BLOCK_CHARS", 50)

    class Context:
        @staticmethod
        def get():
            return Context()

        def partitionId(self):
            return 0

    monkeypatch.setattr(m, "TaskContext", Context)
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc", "text"])
    blocks = pa.Table.from_batches(list(m._to_blocks(iter([batch]))))
    assert len(blocks) > 20 and len(set(blocks["block"].to_pylist())) == len(blocks)
    asked = list(m._ask(8)(iter(blocks.to_batches())))
    answers = pa.Table.from_batches(list(m._answer("byte_bpe_50k", m.TOKENIZERS)(iter(asked))))
    got = {}
    for i in range(len(blocks)):
        one = blocks.slice(i, 1)
        mine = answers.filter(pa.compute.equal(answers["block"], one["block"][0]))
        for r in m._assemble(8)(one, mine).to_pylist():
            got[r["doc_id"]] = r["ids"]
    assert got == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert m.encode(df).count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(1, "a b", "n"), (2, None, "n"), (3, "", "n")], "doc_id bigint, text string, n string")
    got = {r["doc_id"]: r["k"] for r in m.with_token_counts(df, "text", "k", ["doc_id", "n"]).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sé日 .!"), max_size=60), st.integers(1, 10))
def test_pieces_never_cut_a_word(text, most):
    enc = m.encoder()
    parts = list(m.pieces(text, most))
    assert "".join(parts) == text
    assert [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=80))
def test_both_patterns_agree_on_ascii(text):
    fast, full = m._patterns()
    assert fast.findall(text) == full.findall(text)
