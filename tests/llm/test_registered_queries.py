"""The registered queries on the smallest tables, column by column, against the contract worked out by other means."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantarium.llm import queries as registered
from quantarium.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def encoded(spark, small):
    """(doc_id, text, ids) in ascending order."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    library.no_truncation()
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())
    return [(d, t, e.ids, library.decode(e.ids, skip_special_tokens=False)) for (d, t), e in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False))]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_op2(spark, small, encoded):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in registered.op2_bpe(spark, small).collect()}
    assert got == {d: (len(ids), hashlib.sha256(raw(ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()) for d, _, ids, back in encoded}


def test_op8(spark, small, encoded):
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in registered.op8_huffman(spark, small).orderBy("start").collect()]
    starts = itertools.accumulate([0, *(len(ids) + 1 for _, _, ids, _ in encoded)])
    assert got == [(d, s, len(ids) + 1, zlib.crc32(raw([*ids, 2]))) for s, (d, _, ids, _) in zip(starts, encoded)]


def test_op9(spark, small, encoded):
    """Every id lies in exactly one piece, each piece's ids are the document's, sequences have no gap and no padding."""
    pieces = registered.op9_packing(spark, small).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {d for d, *_ in encoded}
    for d, _, ids, _ in encoded:
        at, own = 0, [*ids, 0]
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(raw(own[at : at + r.length]))) and r.length > 0
            at += r.length
        assert at == len(own)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1024 or at & (at - 1) == 0 and at < 1024


def test_op10(spark, small):
    said = r"\### Assistant: </turn> ok"
    turns = {-7: [("user", said), ("assistant", said)]}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, rows in turns.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        want[c] = (len(rows), digest("".join(f"{role}\n{t}\n" for role, t in rows)), len(loss), digest(loss))
    got = registered.op10_chat(spark, small).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and all(r.formatted_chars >= r.loss_chars for r in got)


def test_op3_columns(spark, small):
    got = registered.op3_quality(spark, small)
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert got.where("base_failed AND kept").count() == 0 and got.where("base_failed <> (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)").count() == 0
    assert got.count() == spark.read.parquet(f"{small}/documents.parquet").count() and got.where(F.col("kept").isNull()).count() == 0
