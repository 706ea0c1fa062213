"""The text operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quantarium.llm import bpe, chat, common, huffman, packing, pages, passages, pii, quality, simhash, winnow
from quantarium.llm import queries as llm_queries
from quantarium.llm.tokens import PieceEncoder, vocabulary_path

SCHEMA = "doc_id long, text string, _row string, fp long, n_words long"  # extra columns with clashing names
ODD = [(1, None, "x", 1, 2), (2, "", None, None, None), (3, " \n\t ", "x", 1, 2), (4, "one", "x", 1, 2), (4, "one", "x", 1, 2), (None, "one two three", "x", 1, 2), (5, "a b c d " * 4000, "x", 1, 2), (6, "a b c d " * 4000, "x", 1, 2), (7, "\U0001f642 é <|endoftext|>  x", "x", 1, 2)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def roots(pairs, nodes):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


# -- near duplicates ----------------------------------------------------------


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.root for r in simhash.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}


@pytest.mark.parametrize(("cap", "max_bits"), [(4096, 4), (8, 4), (8, 6)])
def test_links_equal_brute_force(spark, cap, max_bits):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    fps = {int(b) for b in base}
    for b in base[:6]:  # dense groups: more rows in a bucket than the cap
        for _ in range(40):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 9), replace=False):
                x ^= 1 << int(bit) if bit < 63 else -(2**63)
            fps.add(x)
    fps |= {int(b) ^ -(2**63) for b in base[6:20]} | {0, -1}
    fps = sorted(fps)
    edges = simhash.link_fingerprints(spark.createDataFrame([(x,) for x in [*fps, None]], "fp long"), max_bits, cap)
    got = {r.node: r.root for r in simhash.connected_components(edges).collect()}
    near = [(x, y) for x, y in itertools.combinations(fps, 2) if ((x ^ y) & (2**64 - 1)).bit_count() <= max_bits]
    want = roots(near, fps)
    assert {x: got.get(x, x) for x in fps} == want


def test_fingerprint_by_hand():
    text = "The cat SAT\ton\nthe mat É"
    words = text.encode().lower().split()
    counts = np.zeros(64)
    for k in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42)
        counts += [(h >> b) & 1 for b in range(64)]
    want = sum(1 << b for b in range(64) if 2 * counts[b] > len(words) - 3)
    assert simhash.simhash(text) & (2**64 - 1) == want and simhash.simhash(" \n") == 0


def test_near_duplicates_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicate_texts(spark):
    words = [f"w{k * 7919 % 1000}" for k in range(200)]
    near = words.copy()
    near[100] = "other"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, " ".join(reversed(words))), (5, None), (6, "")]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_op1_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {}
    for r in docs.collect():
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (r.text or "").encode()))
        grams = [b" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        want[r.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    pairs = [(a, b) for a, b in itertools.combinations(want, 2) if (want[a] ^ want[b]).bit_count() <= 4]
    comp = roots(pairs, want)
    got = llm_queries.op1_simhash(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{f:016x}", comp[d]) for d, f in want.items()}


def edited_texts(n=60):
    """(rows, pairs): pairs of texts of 200 words at a similarity of 0.8 or a little more: words changed here and there,
    a block changed, words added at the end."""
    rng = np.random.default_rng(5)
    fill = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    rows, pairs = [], []
    for k in range(n):
        a = fill(200)
        b = list(a)
        if k % 3 == 0:
            for at in (30, 80, 120, 160):
                b[at] = f"new{k}"
        elif k % 3 == 1:
            b[90:106] = fill(16)
        else:
            b += fill(38)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        pairs.append((2 * k, 2 * k + 1))
    return rows, pairs


def similarity(x, y):
    a, b = (set(zip(*(w[k:] for k in range(5)))) for w in (x.split(), y.split()))
    return len(a & b) / len(a | b)


def test_near_duplicate_texts_of_all_edits(spark):
    rows, pairs = edited_texts()
    assert all(0.8 <= similarity(rows[a][1], rows[b][1]) for a, b in pairs)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs) and len(set(got.values())) >= len(pairs)


def test_near_duplicate_cloud_equals_brute_force(spark, monkeypatch):
    """Many versions of one text, most of them too far apart, in more than one block and in buckets over the cap."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 100)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        for at in rng.choice(120, rng.integers(1, 8), replace=False):
            w[at] = f"q{rng.integers(10**6)}"
        rows.append((k, " ".join(w)))
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if similarity(x, y) >= 0.8]
    want = roots(near, range(400))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(spark.createDataFrame(rows, "doc_id long, text string"), cap=50).collect()}
    assert got == want and len(set(want.values())) > 20


def test_near_duplicate_texts_odd_rows(spark, odd):
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_texts(odd).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert simhash.near_duplicate_texts(odd.limit(0)).count() == 0


# -- tokens -------------------------------------------------------------------


def test_automaton_equals_library(library):
    m, enc = bpe.automaton(vocabulary_path()), PieceEncoder(vocabulary_path())
    rng = np.random.default_rng(1)
    letters = list("aabcdeehillmnoorsstttu  \n\t.,'éü漢\U0001f642019-_<|>　")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(2000)] + ["a" * k for k in range(40)] + ["  <|endoftext|>  ", "I'll  don't\n\n x", "hello" * 500, "½ ² x²y", "a.\nb", "word,\nNext."]
    for t, e, pieces in zip(texts, library.encode_batch(texts, add_special_tokens=False), enc.encode(texts)):
        want = np.array(e.ids, "<u4").tobytes()
        assert m.encode(t) == want, t
        assert np.frombuffer(pieces, "<u2").astype("<u4").tobytes() == want, t
        assert m.decode(want) == library.decode(e.ids, skip_special_tokens=False)


def test_round_trip(odd, library):
    for r in bpe.round_trip(odd, vocabulary_path()).collect():
        text = next(t or "" for d, t, *_ in ODD if d == r.doc_id)
        ids = np.array(library.encode(text, add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = bpe.decode(bpe.encode(odd, vocabulary_path()), vocabulary_path())
    assert sorted((r.doc_id or 0, r.text) for r in back.collect()) == sorted((d or 0, t or "") for d, t, *_ in ODD)


def test_huffman_lengths():
    rng = np.random.default_rng(0)
    for n, limit in ((1, 16), (2, 16), (300, 9), (300, 16)):
        counts = np.zeros(65536, np.int64)
        counts[rng.choice(65536, n, replace=False)] = np.ceil(2.0 ** rng.uniform(0, 30, n))
        lengths = huffman.code_lengths(counts, limit)
        used = lengths[lengths > 0].astype(float)
        assert (lengths > 0).sum() == n and used.max() <= limit
        assert n == 1 or (2.0**-used).sum() == 1.0
    counts = np.array([1, 1, 2, 4, 8])
    assert huffman.code_lengths(counts).tolist() == [4, 4, 3, 2, 1]


def test_token_files(spark, odd, library):
    out = common.new_dir(spark, "test")
    huffman.write_tokens(odd, out, vocabulary_path(), end_id=2)
    got = huffman.read_tokens(spark, out).orderBy("start").collect()
    want = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for d, t, *_ in ODD}
    assert [r.doc_id for r in got] == sorted((d for d, *_ in ODD), key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert (r.start, bytes(r.ids), r.ids_crc32) == (at, want[r.doc_id], zlib.crc32(want[r.doc_id]))
        at += r.n_tokens


def test_packing(odd, library):
    got = packing.pack(odd, vocabulary_path(), width=64).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rows in sequences.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == list(itertools.accumulate([0, *(r.length for r in rows[:-1])]))
        size = sum(r.length for r in rows)
        assert size == 64 or size & (size - 1) == 0
    per = Counter()
    for r in got:
        per[r.doc_id] += r.length
    for d, n in Counter(d for d, *_ in ODD).items():
        text = next(t or "" for x, t, *_ in ODD if x == d)
        assert per[d] == n * (1 + len(library.encode(text, add_special_tokens=False).ids))


def test_packing_with_a_small_cache_keeps_few_pieces_and_the_same_ids():
    import pyarrow as pa

    from quantarium.llm.tokens import encoder

    rng = np.random.default_rng(15)
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([" ".join(f"w{x}" for x in rng.integers(0, 10**9, 1000))])], ["doc_id", "text"]) for k in range(30)]
    run = lambda pieces: [b.column("ids").to_pylist() for b in packing._key_batches(iter(batches), vocabulary_path(), 0, pieces)]
    small = run(2000)
    assert len(encoder(vocabulary_path(), 2000).cache) <= 4000
    assert small == run(1_100_000)


def test_hilbert_curve_is_a_walk():
    cells = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_key(cells, 3)
    assert sorted(keys) == list(range(512)) and np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1).max() == 1


# -- cleaning -----------------------------------------------------------------


def test_quality_counts(docs, odd):
    for r in quality.line_quality(docs.unionByName(odd.select("doc_id", "text"), allowMissingColumns=True)).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(rep))
        assert r.base_failed == (len(w) < 50 or 100 * len(rep) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_verdicts(docs, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality.line_quality(docs).where("NOT base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    right = sum(r["count"] for r in got if bool(r.quality) == r.kept)
    assert right >= 0.97 * sum(r["count"] for r in got)


def test_quality_keeps_columns(odd):
    got = quality.line_quality(odd)
    assert got.columns[:4] == ["doc_id", "text", "_row", "fp"] and got.where("kept").count() == 0 and quality.line_quality(odd.limit(0)).count() == 0


def test_personal_data():
    model = pii.train()
    assert model[2]["precision"] >= 0.97 and model[2]["recall"] >= 0.9
    text = 'mail a.b@c-d.org or 10.0.0.256 and 10.0.0.1, card 4111 1111 1111 1111, +1 (017) 555-7713. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    base, spans = pii.find_spans(text, model)
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in base] == [("email", "a.b@c-d.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert [pii.KINDS[k] for _, k, _ in spans if _ is not None][-1] == "secret" and set(base) <= set(spans)
    assert pii.redact(text, spans).count("[") == 5 and pii.find_spans("version 4.0 of 2020-11-05, 12 345", model)[1] == []


def test_email_spans_equal_the_pattern():
    pattern = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = np.random.default_rng(5)
    for _ in range(3000):
        t = "".join(rng.choice(list("ab.@- +é"), rng.integers(0, 25)))
        assert [m.span() for m in pattern.finditer(t)] == list(pii._emails(t)), t


def test_personal_data_odd_rows(odd):
    assert pii.personal_data(odd, keep=("doc_id", "_row")).where("spans = ''").count() == len(ODD)
    assert pii.personal_data(odd.limit(0)).count() == 0


def winnowed(text):
    """By hand: Spark's xxhash64 of several strings hashes each with the one before as seed."""
    w = [x.encode() for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]

    def gram(words):
        h = 42
        for x in words:
            h = xxhash.xxh64_intdigest(x, h)
        return h - (1 << 64) if h >> 63 else h

    h = [gram(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [gram([b" ".join(w)])] * bool(w)
    places = sorted({max(i for i in range(k, min(k + 8, len(h))) if h[i] == min(h[k : k + 8])) for k in range(max(1, len(h) - 7))}) if h else []
    return ",".join(f"{i}:{h[i] >> 32 & 0xFFFFFFFF:08x}" for i in places)


def alike(a, b):
    x, y = ({p.split(":")[1] for p in f.split(",") if p} for f in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_winnowing_far_ids(spark):
    rows = [(k, f"text {k} of some words {k % 7}") for k in range(300)] + [(2**60, "a far one"), (-(2**60), "another")]
    got = {r.doc_id: r for r in winnow.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=16).collect()}
    order = sorted(rows)
    for (d, t), (_, n) in zip(order, [*order[1:], order[0]]):
        q = len(t) // 4
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest() and got[d].near_next == alike(winnowed(t), winnowed(n))


def test_winnowing(docs, odd):
    rows = docs.unionByName(odd.where("doc_id IS NULL").select("doc_id", "text"), allowMissingColumns=True)
    got = {r.doc_id: r for r in winnow.fingerprint_edits(rows, block_rows=16).collect()}
    src = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    for (d, t), (_, n) in zip(src, [*src[1:], src[0]]):
        q = len(t) // 4
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256((t[: len(t) - q] + n[:q]).encode()).hexdigest()
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w]
        places = [int(x.split(":")[0]) for x in got[d].fingerprint.split(",") if x]
        grams = len(words) - 2
        assert places == sorted(set(places)) and all(b - a <= 8 for a, b in zip(places, places[1:]))
        assert grams < 8 or (places[0] < 8 and places[-1] >= grams - 8)
        assert got[d].fingerprint == winnowed(t) and got[d].edited_fingerprint == winnowed(t[: len(t) - q] + n[:q])
        assert got[d].near_edited == alike(got[d].fingerprint, got[d].edited_fingerprint) and got[d].near_next == alike(got[d].fingerprint, winnowed(n))
    assert got[None].near_next is None and np.mean([r.near_edited for r in got.values()]) > 0.5
    assert winnow.fingerprint_edits(odd.limit(0)).count() == 0 and winnow.fingerprint_edits(odd).count() == len(ODD)


def test_base_spans_equal_the_patterns():
    """All four base kinds as the contract's patterns find them."""
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def ok(kind, x):
        d = re.sub("[^0-9]", "", x)
        if kind == 1:
            return all(int(p) <= 255 for p in x.split("."))
        if kind == 2:
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(d) <= 15

    rng = np.random.default_rng(8)
    pieces = ["4111 1111 1111 1111", "10.0.0.1", "1.2.3.4.5", "256.1.1.1", "00012.3.4.5", "+1 (017) 555-7713", "+4", "a.b@c-d.org", "@x.y", "123456789012", "5500-0000-0000-0004", " ", "-", ".", "9", "(", "x", "é", "\U0001f642", "+49.30.1234567", "\n"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces, rng.integers(0, 9)))
        want = sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in re.finditer(p, t, re.ASCII) if ok(k, m.group()))
        assert pii.base_spans(t) == want, t


def test_op4_against_brute_force(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in llm_queries.op4_pii(spark, small).collect():
        base = pii.base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(listed.split(",")) <= set(r.spans.split(","))


def test_long_texts_take_linear_time():
    model, began = pii.train(), time.time()
    for t in ("7" * 1_000_000, "1." * 500_000, "a@b." * 200_000, " ".join(f"user{k}@mail{k}.example.org" for k in range(50_000)), "+1 " * 300_000, "<" * 1_000_000):
        pii.find_spans(t, model)
    for t in ("<div>" * 100_000 + "x", "<a " * 300_000, "<p><b>" * 50_000, "</i>" * 200_000):
        pages.extract(t, None)
    assert time.time() - began < 40


def test_passages_against_brute_force(docs):
    got = {r.doc_id: r for r in passages.passage_classes(docs).collect()}
    seen = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r.text or "").encode().lower().split()
        for k in range(len(w) - 49):
            seen.setdefault(tuple(w[k : k + 50]), set()).add(r.doc_id)
    pairs = [(min(s), x) for s in seen.values() for x in s]
    want = roots(pairs, got)
    assert all(got[x].n_links > 0 for s in seen.values() if len(s) > 1 for x in s)
    assert all(got[x].class_id == got[y].class_id for x, y in want.items())


def test_cut_passages(spark, odd):
    p = " ".join(f"p{k}" for k in range(60))
    fill = [" ".join(f"{c}{k}" for k in range(80)) for c in "abc"]
    rows = [(1, f"{fill[0]} {p} end"), (2, f"{fill[1]} {p} tail"), (3, fill[2]), (4, None), (None, p), (5, p)]
    got = {r.doc_id: r.text for r in passages.cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == rows[0][1] and got[3] == fill[2] and got[4] is None and got[None] == p and 5 not in got
    assert got[2].startswith(fill[1]) and got[2].endswith("tail") and "p30" not in got[2]
    assert passages.passage_classes(odd).count() == len(ODD) and passages.passage_classes(odd.limit(0)).count() == 0


def edited_passages(n=120):
    """(rows, pairs): pairs of texts that share a passage of 50 to 70 words but for one word inserted, deleted or changed."""
    rng = np.random.default_rng(11)
    fill = lambda k: [f"w{x}" for x in rng.integers(0, 50_000, k)]
    rows, pairs = [], []
    for k in range(n):
        size, kind = (50, 60, 70)[k % 3], k // 3 % 3
        p = fill(size + (kind == 1 and size == 50))  # both passages have 50 words or more
        q, at = list(p), int(rng.integers(1, size - 1))
        q[at : at + (kind > 0)] = ["new"] if kind != 1 else []
        rows += [(2 * k, " ".join(fill(90) + p + fill(40))), (2 * k + 1, " ".join(fill(30) + q + fill(110)))]
        pairs.append((2 * k, 2 * k + 1))
    return rows, pairs


def near_passages(x, y, words=50, similarity=0.8):
    """By brute force: some stretches of ``words`` and one more or less, at their shingles' Jaccard similarity."""
    sets = [[{tuple(w[i + j : i + j + 5]) for j in range(n - 4)} for n in (words, words + 1) for i in range(len(w) - n + 1)] for w in (x.split(), y.split())]
    return any(len(a & b) >= similarity * len(a | b) for a in sets[0] for b in sets[1])


def test_edited_passages_all_meet(spark):
    rows, pairs = edited_passages()
    assert all(near_passages(rows[a][1], rows[b][1]) for a, b in pairs[:9]) and not near_passages(rows[0][1], rows[3][1])
    links, _ = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r.first_id, r.doc_id): r.spans for r in links.collect()}
    assert set(got) == set(pairs)
    assert all(len(rows[b][1][s.start : s.end].split()) >= 45 for (a, b), spans in got.items() for s in spans)


def test_partly_shared_first_documents_lose_no_link(spark):
    """An earlier document holds only a part of the passage that two later ones share: the two must still link."""
    rng = np.random.default_rng(12)
    fill = lambda k: [f"w{x}" for x in rng.integers(0, 50_000, k)]
    rows, pairs = [], []
    for k in range(60):
        p = fill(50)
        held = (30, 38, 44)[k % 3]
        part = p[:held] if k % 2 else p[-held:]
        rows += [(3 * k, " ".join(fill(40) + part + fill(60))), (3 * k + 1, " ".join(fill(70) + p + fill(20))), (3 * k + 2, " ".join(fill(20) + p + fill(50)))]
        pairs.append((3 * k + 1, 3 * k + 2))
    got = {r.doc_id: r for r in passages.passage_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[a].class_id == got[b].class_id for a, b in pairs)
    assert all(got[b].n_links >= 1 and got[b].spans for _, b in pairs)


def around_a_frequent_stretch(n):
    """(ids, texts) of ``n`` documents that hold the same 44 words, which are no passage; with 12 more behind a changed word,
    which the first 20 pairs share, they are."""
    rng = np.random.default_rng(14)
    fill = lambda k: [f"w{x}" for x in rng.integers(0, 10**12, k)]
    common, rows = fill(44), []
    for k in range(n // 2):
        tail = fill(12)
        for _ in range(2):
            behind = [*fill(1), *(tail if k < 20 else fill(12))]
            rows.append(" ".join([*fill(15), *common, *behind, *fill(20)]))
    return rng.permutation(n).tolist(), rows


def test_pipeline_cuts_edited_passages_around_a_frequent_stretch(spark):
    import corpus_pipeline as p

    ids, rows = around_a_frequent_stretch(60)
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in zip(ids, rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(p.STAGES)["repeated_passages"](spark, docs, "").collect()}
    later = {max(ids[2 * k : 2 * k + 2]) for k in range(20)}
    assert {d for d, t in zip(ids, rows) if got[d] != t} == later and all(len(got[d].split()) == 92 - 57 for d in later)


@pytest.mark.parametrize("n", [60, 1200])
def test_edited_passages_around_a_frequent_stretch_all_link(spark, n):
    """Larger groups than a block are compared block by block."""
    ids, rows = around_a_frequent_stretch(n)
    links, _ = passages.repeated_passages(spark.createDataFrame(list(zip(ids, rows)), "doc_id long, text string"))
    got = {(r.doc_id, r.first_id): r.spans for r in links.collect()}
    assert set(got) == {(max(ids[2 * k : 2 * k + 2]), min(ids[2 * k : 2 * k + 2])) for k in range(20)}
    assert all(len(rows[ids.index(d)][s.start : s.end].split()) == 57 for (d, _), spans in got.items() for s in spans)


def test_pairs_of_a_large_group_take_little_memory():
    """Two blocks of one group whose rows are joined but for a few: only pairs with these are listed."""
    rng, n = np.random.default_rng(16), 2 * passages.BLOCK
    context = np.repeat(rng.integers(1, 1 << 24, (1, 108)).astype(np.uint32), n, axis=0)
    for row in context:
        row[rng.integers(0, 108, 3)] = rng.integers(1, 1 << 24, 3)
    docs, centers = list(range(n)), [[0]] * (n - 30) + [[d] for d in range(n - 30, n)]
    tracemalloc.start()
    got = passages.near_pairs(docs, [c[0] < d for c, d in zip(centers, docs)], centers, context, np.arange(passages.BLOCK), np.arange(n), 46, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {d for d, _ in got} == set(range(n - 30, n)) and all(f < passages.BLOCK for _, f in got)
    assert peak < 50e6


def test_texts_in_buckets_are_not_shuffled_again(spark):
    from quantarium.llm.common import stored_by

    some = stored_by(spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")), "some", "doc_id")
    other = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).alias("x")).hint("merge")
    both = some.join(other, "doc_id", "left")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and both.where("x = 1").count() == 1000


def test_long_texts_go_to_python_in_small_batches(spark):
    import pyarrow as pa

    from quantarium.llm.common import BATCH_BYTES, small_batches

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    rows = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 10000) AS text")
    with small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) > 30e6 and max(got) < 1.1 * BATCH_BYTES


def test_repeated_lines_are_matched_in_short_time():
    rng = np.random.default_rng(13)
    line = [f"l{k}".encode() for k in range(30)]
    one = [w for k in range(700) for w in [*line, f"a{rng.integers(10**9)}".encode()]]
    two = [w for k in range(700) for w in [*line, f"b{rng.integers(10**9)}".encode()]]
    same = [b"the"] * 20_000
    began = time.time()
    assert passages.match(passages.shingles(same), passages.shingles(same[:9000]), 46, 0.8) == [(0, 19_996)]
    passages.match(passages.shingles(one), passages.shingles(two), 46, 0.8)
    assert passages.match(passages.shingles(one), passages.shingles(same), 46, 0.8) == []
    assert time.time() - began < 5


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(2)
    for n, kinds in ((60, 10**9), (60, 3), (40, 1)):
        h = rng.integers(0, kinds, n).astype(np.uint64)
        windows = passages.compact_windows(h, 10)
        for a in range(n):
            for b in range(a + 9, n):
                hit = [c for x, c, y in windows if x <= a <= c <= b <= y]
                assert len(hit) == 1 and h[hit[0]] == h[a : b + 1].min()


# -- pages and chats ----------------------------------------------------------


def test_pages(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet")
    import html

    for r in pages.main_text(rows).join(rows.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"<p>|</p>|</?h1>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_template_finds_the_article_without_its_name(spark):
    """No article element: free text of all the host's pages shows the slot, whatever the classes are called."""
    fill = lambda k, c: " ".join(f"{c}{k}x{j}" for j in range(30))

    def page(k):
        side = f'<div class="rail"><a href="/{k}">link {k}</a></div>'
        return f'<html><body><div class="top">Our site</div><div class="box has-sidebar"><h1>Title {k}</h1><p class="share-price">{fill(k, "a")}</p><div class="ad-hoc">{fill(k, "b")}</div><div>Press here</div><ul class="share"><li>Share {k}</li></ul></div>{side}<div class="comment-list">c{k} said</div><div class="end">The end</div></body></html>'

    rows = [(k, f"https://h.example/{k}", page(k)) for k in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in pages.main_text(frame, salt_pages=8).collect()}
    assert got == {k: f"Title {k}\n{fill(k, 'a')}\n{fill(k, 'b')}" for k in range(40)}
    assert pages.extract(page(3), None) != got[3]  # without its host's template the page is read otherwise


def test_template_slots(spark):
    page = lambda k: f'<html><body><div>Home News</div><div id="c"><p>story {k} one</p><p>more {k} &lt;here&gt;</p></div><div>Imprint</div></body></html>'
    rows = [(k, f"https://h.example/{k}", page(k), "x") for k in range(6)] + [(90, None, None, "x"), (91, "nohost", "", "x"), (92, "https://h.example/x", "<p>open <b>tag", "x")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert all(got[k] == f"story {k} one\nmore {k} <here>" for k in range(6)) and got[90] == got[91] == "" and got[92] == "open tag"


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "us:er#\\b", "x\\l \\\\h </turn>\n### a: b\\"), (1, 1, "assistant", ""), (1, 2, "assistant", None), (1, 3, "user", "tail"), (2, 0, None, None), (None, 0, "assistant", "q"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_chat(turns)
    for r in examples.where("loss_start IS NOT NULL").collect():
        assert r.text[r.loss_end :].startswith("</turn>\n")
    got = {r.conv_id: r for r in chat.read_chat(common.stored(examples, "chat")).collect()}
    for c in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == c]
        assert list(got[c].roles) == [r[2] or "" for r in own] and list(got[c].texts) == [r[3] or "" for r in own]
        assert list(got[c].trained) == [r[3] or "" for r in own if r[2] == "assistant"]
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_chat_turns_without_a_conversation(spark):
    """Each is a conversation of its own, so that their output is linear."""
    rows = [(None, k % 3, "assistant" if k % 2 else None, f"said {k}") for k in range(400)] + [(None, None, None, None), (5, 0, "assistant", "x")]
    examples = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert examples.count() == 402 and examples.agg(F.max(F.length("text"))).head()[0] < 40
    read = [r for r in chat.read_chat(common.stored(examples, "chat")).collect() if r.conv_id is None]
    assert sorted((r.roles[0], r.texts[0], *r.trained) for r in read) == sorted((r or "", t or "", *([t] if r else [])) for c, _, r, t in rows if c is None)


# -- pipeline -----------------------------------------------------------------


def test_pipeline(spark, small):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "personal_data", "pack_sequences"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, small), name)
        assert docs.columns == p.COLUMNS and docs.where("n_chars <> length(text)").count() == 0
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    assert docs.where(F.col("text").rlike(r"[a-z]@[a-z0-9]+\.")).count() == 0
    assert p.run(spark, small).select("doc_id").distinct().count() == counts[-1]


def test_pipeline_odd_rows(spark, odd):
    import corpus_pipeline as p

    rows = odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    stages = dict(p.STAGES)
    for name, stage in stages.items():
        assert stage(spark, rows.limit(0), "").count() == 0, name
    given = rows.collect()
    own = Counter(r.doc_id for r in given)
    texts = {(r.doc_id, r.text or "") for r in given}
    good = stages["quality_rules"](spark, rows, "").collect()
    assert all(len(r.text.split()) >= 30 for r in good) and {r.doc_id for r in good} <= set(own)
    near = stages["near_duplicates"](spark, rows, "").collect()
    found = Counter(r.doc_id for r in near)
    assert found[None] == own[None] and all(n == 1 for d, n in found.items() if d is not None) and {(r.doc_id, r.text or "") for r in near} <= texts
    assert {" ".join((r.text or "").split()) for r in near} >= {t for t in {" ".join((r.text or "").split()) for r in given if r.doc_id is not None} if t and len(t.split()) < 3}
    passed = stages["repeated_passages"](spark, rows, "").collect()
    assert {r.doc_id for r in passed} <= set(own) and all((r.n_chars or 0) == len(r.text or "") for r in passed)
    private = stages["personal_data"](spark, rows, "")
    assert private.columns == p.COLUMNS and Counter(r.doc_id for r in private.collect()) == own
    pieces = stages["pack_sequences"](spark, rows, "").collect()
    assert Counter(r.doc_id for r in pieces if r.start == 0) == own and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_run_hashes_and_word_limits(spark):
    from quantarium.llm import passages

    h = passages.shingles([b"w%d" % (k % 40) for k in range(200)])
    runs = passages.Runs(h)
    at = np.arange(0, 120)
    keys = runs(at, 41, 7)
    for i in at:
        for j in at:
            assert (keys[i] == keys[j]) == bool((h[i : i + 41] == h[j : j + 41]).all())
    assert passages.Runs(h[:0])(np.array([-20, 0]), 16, 1).tolist() == passages.Runs(h)(np.array([-20, 200]), 16, 1).tolist()
    assert passages.word_places(" a\tbé\n")[0].tolist() == [1, 3] and passages.word_places(" a\tbé\n")[1].tolist() == [2, 5]
    assert [len(x) for x in passages.word_places("")] == [0, 0]
    rows = spark.createDataFrame([("",), (" a ",), ("a b",), (" a\tb\nc ",), ("a" * 100000,), (None,)], "text string")
    assert [r[0] for r in rows.select(passages.has_words("text", 2)).collect()] == [False, False, True, True, False, None]
