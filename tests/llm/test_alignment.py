"""Cross-tokenizer alignment against whole-text encoding and plain counting."""

import collections
import hashlib

import numpy as np
import pytest

from quantarium.llm import alignment as al
from quantarium.llm import queries
from quantarium.llm.tokens import vocabulary_path

A, B = vocabulary_path(), vocabulary_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def brute():
    """Rows (doc_id, text) to the wanted rows, by encoding each whole text at once."""
    import sentencepiece
    from tokenizers import Tokenizer

    lib_a, lib_b, known = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), al.Aligner(A, B)
    lib_a.encode_special_tokens = True

    def run(rows):
        docs, count = [], collections.Counter()
        for d, t in rows:
            a, b = (lib_a.encode(" " + t, add_special_tokens=False).ids, lib_b.encode(t)) if t else ([], [])
            raw = b"" if not t else (" " + t).encode()
            a_raw, b_raw = [known.a_bytes[i] for i in a], [known.b_bytes[i] for i in b]
            if not t or b"".join(a_raw) != raw or b"".join(b_raw) != raw:
                a, b, a_raw, b_raw = [], [], [], []
            ends_a, ends_b = np.cumsum([len(x) for x in a_raw], dtype=int).tolist(), np.cumsum([len(x) for x in b_raw], dtype=int).tolist()
            groups, links, i, j = [], [], 0, 0
            for end in sorted({*ends_a} & {*ends_b}):
                p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
                links.append((a[p - 1], b[q - 1]))
                i, j = p, q
            count.update(links)
            docs.append((d, len(a), len(b), groups, links))
        best = collections.Counter()
        for (_, b), n in count.items():
            best[b] = max(best[b], n)
        out = []
        for d, n_a, n_b, groups, links in docs:
            text = ";".join(groups)
            digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
            out.append((d, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), digest, text))
        return sorted(out, key=repr), count

    return run


ODD = [
    (1, None), (2, ""), (3, " "), (4, "  "), (5, "a "), (6, " a"), (7, "a  b   c \n d\n\n e\t f\r\n"), (8, "\n"), (9, "a\nb c"), (10, "mark ▁ inside"), (11, "<|endoftext|> <s> </s> a<|endoftext|>b <unk>"),
    (12, "naïve café 北京 😀 é   x  y　z"), (13, "x" * 3000 + " " * 300 + "y"), (14, "can't we've I'M 1234567 3.14 -- ..."), (15, "a\x00b \x1c c\x85 d"), (16, "same text here"), (16, "same text here"), (None, "same text here"), (None, None), (17, "▁"),
    (18, "word " * 4000), (19, "end with mark ▁"), (20, "ﬁ ﻿ ́"),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_texts(spark, brute):
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    want, count = brute(ODD)
    assert rows_of(al.align(docs, A, B)) == want
    assert {(r.a, r.b): r.n for r in al.pair_counts(al.count_segments(docs, A, B)).collect()} == count


def test_slices_of_counts(spark, brute):
    """Counts beyond the broadcast's bound: the same rows, one slice after the other."""
    rows = ODD + [(100 + k, " ".join(f"w{k * j % 97}x" for j in range(50))) for k in range(40)]
    want, count = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    per = sum(r.size for r in al.count_segments(docs, A, B).selectExpr("length(hash) * 12 + length(keys) + length(n) AS size").collect())
    assert rows_of(al.align(docs, A, B, slice_bytes=per // 3)) == want


def test_small_cache(spark, brute, monkeypatch):
    """Pieces are dropped from the worker's cache in the middle of a task."""
    monkeypatch.setattr(al, "KEPT_PIECES", 3)
    al._HELD.clear()
    import pyarrow as pa

    rows = [(k, f"one two{k} three{k % 3}") for k in range(30)]
    want, count = brute(rows)
    batches = [pa.RecordBatch.from_pydict({"text": [t for _, t in rows[k : k + 2]]}) for k in range(0, 30, 2)]
    monkeypatch.setattr(al.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    got = collections.Counter()
    for b in al._pair_batches(batches, A, B):
        for p, n in zip(al._numbers(b, "pairs"), al._numbers(b, "n")):
            got.update({(int(x) >> 16, int(x) & 0xFFFF): int(y) for x, y in zip(p, n)})
    assert got == count


def test_empty_and_clashing_names(spark, brute):
    empty = spark.createDataFrame([], SCHEMA)
    assert al.align(empty, A, B).collect() == []
    rows = [(1, "a b"), (2, None)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_a", "2 AS segment", "'x' AS groups", "3 AS pairs", "4 AS n_best")
    assert rows_of(al.align(docs, A, B)) == brute(rows)[0]
    assert [r[-1] for r in al.align(docs, A, B, with_groups=False).collect()] == [None, None]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 20000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    mph = al.PerfectHash.from_bytes(al.PerfectHash.of(keys).to_bytes())
    assert sorted(mph.places(keys).tolist()) == list(range(n))
    table = keys.copy()
    table[mph.places(keys)] = keys
    others = np.setdiff1d(np.arange(5000), keys)
    place = mph.places(others)
    assert n == 0 or not (table[place[place >= 0]] == others[place >= 0]).any()
    counts = al.Counts([])
    assert (counts.look_up(keys) == 0).all()


def test_registered_query(spark, small, brute):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_alignment(spark, small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows_of(got) == [w[:-1] for w in brute(rows)[0]]


def test_words_of_a_list_are_aligned_as_alone():
    import random

    one, rng = al.Aligner(A, B), random.Random(5)
    parts = ["don't", "'s", "12", "a", "é", "日本", "—", "…", "x.", "(", "</s>", "<0x41>", "🙂", "Ünï", "'", "1st", "​", "<|endoftext|>", "_"]
    words = list(dict.fromkeys("".join(rng.choices(parts, k=rng.randint(1, 5))) for _ in range(1500)))
    texts = [" ".join(rng.choices(words, k=9)) + rng.choice(["", " ", "  ", "\n\n", "!?"]) for _ in range(400)]
    one.read(texts)
    alone = one._alone(list(one.places))
    assert [list(x) for x in (one.n_a, one.n_b, one.ok, one.n_links, one.groups)] == [[r[0] for r in alone], [r[1] for r in alone], [r[2] for r in alone], [len(r[3]) for r in alone], [r[4] for r in alone]]
    assert np.concatenate(one.links).tolist() == [x for r in alone for x in r[3]]


def test_texts_are_aligned_once(spark, brute, monkeypatch):
    """The pass that looks the counts up reads written links: it takes no text, and what has no tokens has no links."""
    asked, plain = [], al.stored
    monkeypatch.setattr(al, "stored", lambda df, name, **kw: (asked.append((name, df.columns)), plain(df, name, **kw))[1])
    docs = spark.createDataFrame(ODD, SCHEMA).repartition(3)
    found = al.align(docs, A, B)
    assert [c for n, c in asked if n == "aligned"] and all("text" not in c for _, c in asked)
    assert rows_of(found) == brute(ODD)[0]
    assert found.inputFiles() and all("aligned" in f for f in found.inputFiles())
