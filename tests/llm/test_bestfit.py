"""Best-fit packing: every id once, no gap, no sequence too long, and close to the least number of sequences."""

import random
import zlib

import numpy as np
import pytest

from quantarium.llm import bestfit, queries
from quantarium.llm.tokens import vocabulary_path

PATH = vocabulary_path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    lib.no_truncation()
    return lambda texts: [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def held_to(rows, pieces, library, width, end_id=1):
    """Number of sequences, after all that must hold has been checked. rows: (doc_id, text), each doc_id once."""
    docs = {d: [*ids, end_id] for (d, _), ids in zip(rows, library([t for _, t in rows]))}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for d, own in docs.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            ids = np.array(own[at : at + width], "<u4").tobytes()
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, at, len(ids) // 4, zlib.crc32(ids))
            assert getattr(r, "ids", None) is None or bytes(r.ids) == ids
            at += r.length
        assert at == len(own)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
    return len(by_sequence), -(-sum(map(len, docs.values())) // width)


def test_registered_query(spark, small, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_bestfit(spark, small)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    n, least = held_to(rows, got.collect(), library, 4096)
    assert n == least


def test_groups_meet(spark, library):
    """Many small groups: what they leave underfull is packed together up the tree."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["one", "Two", "three!", "naïve"]) for _ in range(rng.randint(0, 90)))) for k in range(3000)]
    got = bestfit.pack(spark.createDataFrame(rows, SCHEMA), PATH, width=128, group_pieces=40).collect()
    n, least = held_to(rows, got, library, 128)
    assert n <= least * 1.01 + 1


def test_odd_rows(spark, library):
    texts = [None, "", " \n ", "A  b\tc\r\nD", "<|endoftext|>x<|STARTOFTEXT|> <|startoftext|>", "İstanbul ΣΑΣ ﬁ é x y\x1cz\x85w", "北京 😀", "w" * 5000, "a b " * 5000, "don't I'LL 12345"]
    rows = list(enumerate(texts))
    held_to(rows, bestfit.pack(spark.createDataFrame(rows, SCHEMA), PATH, width=64).collect(), library, 64)
    twice = [(1, "same"), (1, "same"), (None, "x"), (None, "x"), (None, None)]
    got = bestfit.pack(spark.createDataFrame(twice, SCHEMA).selectExpr("*", "1 AS row", "2 AS grp", "3 AS length", "'i' AS ids"), PATH, width=8).collect()
    assert sorted((r.doc_id is None, r.length) for r in got) == [(False, 2), (False, 2), (True, 1), (True, 2), (True, 2)] and len({r.sequence_id for r in got}) == 2
    assert bestfit.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_one_group_of_equal_rows(spark, library):
    """Copies with one id are dealt like all others."""
    got = bestfit.pack(spark.createDataFrame([(7, "a b c d e f g")] * 500, SCHEMA), PATH, width=24, group_pieces=50, with_ids=False).collect()
    assert len(got) == 500 and len({r.sequence_id for r in got}) == 167  # three of eight ids each


@pytest.mark.parametrize("low, high, n", [(1, 100, 400), (20, 60, 300), (30, 40, 300), (51, 100, 50), (100, 100, 7), (1, 1, 250), (48, 56, 120)])
def test_search_keeps_items_and_never_loses_to_best_fit(low, high, n):
    rng = random.Random(n)
    sizes = [rng.randint(low, high) for _ in range(n)]
    bins = bestfit.pack_group(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(n)) and all(b and sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(bestfit.best_fit(sizes, 100))


def test_each_kind_of_step():
    """Bins that only a move, an exchange one for one, two for one, or one for two can empty or fill."""

    def fills(bins, sizes, width=10):
        search = bestfit.LocalSearch(bins, sizes, width)
        out = search.run()
        assert sorted(i for b in out for i in b) == list(range(len(sizes)))
        return sorted((sum(sizes[i] for i in b) for b in out), reverse=True)

    assert fills([[0], [1], [2, 3]], [5, 6, 2, 2]) == [10, 5]  # moves: 2 and 2 onto 6
    assert fills([[0, 1], [2], [3, 4]], [4, 5, 4, 5, 1]) in ([10, 9], [10, 5, 4])
    assert fills([[0, 1], [2, 3], [4, 5]], [5, 3, 5, 3, 2, 2]) == [10, 10]  # moves of 2
    assert fills([[0, 1], [2, 3], [4, 5]], [5, 2, 5, 2, 3, 3]) == [10, 10]  # 3 for 2, or moves
    assert fills([[0, 1], [2], [3]], [4, 3, 6, 7]) == [10, 10]  # 4 to 6, 3 to 7
