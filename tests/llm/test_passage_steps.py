"""Steps of the passage search against plainer forms of them, and what its jobs pass through Python."""

import numpy as np
import pytest

from quantarium.llm import passages


@pytest.mark.parametrize("kinds", [10**9, 30, 2, 1])
def test_smallest_places(kinds):
    rng = np.random.default_rng(kinds)
    for n in (21, 22, 46, 300):
        x = rng.integers(0, kinds, n).astype(np.uint64)
        every = [int(x[k : k + 21].argmin()) + k for k in range(n - 20)]
        assert passages.smallest_places(x, 21).tolist() == sorted(set(every))


def test_hashes_of_many_texts():
    many = ["", "a b c d", "a b c d e", "\ud800 x y z q r", "B c D e F g " * 90_000, " a\tb c\nd e f ", ""]
    assert [h.tolist() for h in passages.all_hashes(many)] == [passages.text_hashes(t).tolist() for t in many]


def test_growing_is_the_nearest_equal_shingle():
    """Held against the array form: of the nearest, the one with fewest skipped in the first text."""
    rng = np.random.default_rng(5)
    for kinds in (3, 12, 200):
        a = rng.integers(0, kinds, 150).tolist()
        b = a[:60] + rng.integers(0, kinds, int(rng.integers(0, 9))).tolist() + a[63:120] + rng.integers(0, kinds, 20).tolist()
        rows, first = passages._grow(a, b, 4, 4, 0.8)
        i = j = 4 + first
        for end, end_b, _ in rows[1:]:
            u, v = np.nonzero(np.array(a[i : i + passages.AHEAD])[:, None] == np.array(b[j : j + passages.AHEAD])[None, :])
            k = int((u + v).argmin())
            i, j = i + int(u[k]), j + int(v[k])
            n = passages._equal(a, b, i, j)
            assert a[i : i + n] == b[j : j + n] and (a[i + n : i + n + 1] != b[j + n : j + n + 1] or i + n == len(a) or j + n == len(b))
            i, j = i + n, j + n
            assert (i, j) == (end, end_b)


def test_large_groups_pass_no_stretches_through_the_id_filter(spark, monkeypatch):
    """Rows of stretches grow with the input; only rows of documents may go through the filter's Python."""
    seen, filtered = [], passages.split_by_ids

    def noted(docs, ids, id_col="doc_id"):
        seen.append(docs.columns)
        return filtered(docs, ids, id_col)

    monkeypatch.setattr(passages, "split_by_ids", noted)
    monkeypatch.setattr(passages, "BLOCK", 8)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(d, " ".join(f"x{d}y{k}" for k in range(20)) + " " + shared) for d in range(30)]
    links, _ = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in links.collect()} == set(range(1, 30))
    assert seen and all("key" not in columns for columns in seen)
