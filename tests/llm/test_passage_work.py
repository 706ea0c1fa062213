"""How often the passage search does its costly steps, and that many texts at once give what each gives alone."""

import numpy as np
import pyarrow as pa
import pytest

from quantarium.llm import passages


def _texts():
    rng = np.random.default_rng(3)
    some = [" ".join(f"v{k}" for k in rng.integers(0, kinds, int(n))) for kinds in (1, 2, 30, 10**6) for n in (49, 50, 51, 300)]
    return ["", "a b", *some, "p q r s t u v " * 40, "", "z " * 500]


@pytest.mark.parametrize("width", [46, 20])
def test_windows_of_many_texts(width):
    many = _texts()
    found = list(passages.all_places(many, width, 0.8))
    assert len(found) == len(many)
    for text, (h, (keys, at, side)) in zip(many, found):
        alone = passages.text_hashes(text)
        assert h.tolist() == alone.tolist()
        assert [x.tolist() for x in passages.window_places(alone, width, 0.8)] == [keys.tolist(), at.tolist(), side.tolist()]
        places = {c for _, c, _ in passages.compact_windows(passages.mix(alone, 100), passages.least_run(width, 0.8))}
        reach = passages.least_run(width, 0.8) // 2
        if len(set(alone.tolist())) == len(alone) >= width:
            assert set((at + np.where(side == 2, reach, 0)).tolist()) == places


def test_smallest_places_stay_in_their_text():
    rng = np.random.default_rng(9)
    for kinds in (1, 2, 5, 10**9):
        parts = [rng.integers(0, kinds, n).astype(np.uint64) for n in (21, 60, 22, 200)]
        own, begins = np.repeat(np.arange(4), [len(x) for x in parts]), np.cumsum([0] + [len(x) for x in parts])
        each = [passages.smallest_places(x, 21) + s for x, s in zip(parts, begins)]
        assert passages.smallest_places(np.concatenate(parts), 21, own).tolist() == np.concatenate(each).tolist()


def test_windows_of_many_texts_are_hashed_at_once(monkeypatch):
    made, runs = [], passages.Runs
    monkeypatch.setattr(passages, "Runs", lambda h: made.append(len(h)) or runs(h))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([" ".join(f"w{d}x{k}" for k in range(80)) for d in range(40)])], ["doc_id", "text"])
    rows = list(passages._window_batches([batch], 50, 0.8))
    assert sum(r.num_rows for r in rows) == 40 and len(made) == 1


def test_memory_goes_back_once_for_all_groups(monkeypatch):
    """Not at each small group: giving it back costs more than the group's pairs."""
    released, pool = [], pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            released.append(1)
            pool.release_unused()

    n = 200
    columns = {
        "key": pa.array(np.repeat(np.arange(n), 2)), "doc_id": pa.array(np.tile([1, 2], n)), "later": pa.array([False] * (2 * n)), "center": pa.array(np.tile([1, 2], n)),
        "centers": pa.array([[]] * (2 * n), pa.list_(pa.int64())), "context": pa.nulls(2 * n, pa.binary()), "block": pa.array(np.zeros(2 * n, np.int64)), "side": pa.array(np.zeros(2 * n, np.int64)),
    }
    batch = pa.RecordBatch.from_pydict(columns)
    monkeypatch.setattr(passages.pa, "default_memory_pool", Pool)
    pairs = [p for b in passages._pair_batches([batch], 50, 0.8) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert pairs == [(2, 1)] * n and len(released) == 1


def test_equal_contexts_are_compared_once(monkeypatch):
    """Two surroundings of the same shingles in other orders, each around six documents' places: near within, not across."""
    rng = np.random.default_rng(4)
    run = passages.least_run(46, 0.8) // 2 + 1
    left, middle, right = (np.arange(s, s + n, dtype=np.uint32) + 1 for s, n in ((0, passages.REACH), (1000, run), (2000, passages.REACH)))
    kinds = [np.concatenate([rng.permutation(left), middle, rng.permutation(right)]) for _ in range(2)]
    context = np.array([kinds[d % 2] for d in range(12)], np.uint32)
    tried, real = [], passages.passage_at
    monkeypatch.setattr(passages, "passage_at", lambda a, b, *x: tried.append((a.tobytes(), b.tobytes())) or real(a, b, *x))
    docs = list(range(12))
    pairs = passages.near_pairs(docs, [False] * 12, [[d] for d in docs], context, docs, docs, 46, 0.8)
    assert {(a % 2, b % 2) for a, b in pairs} == {(0, 0), (1, 1)} and {a for a, _ in pairs} == set(range(2, 12))
    assert len(tried) == len(set(tried)) == 4


def test_equal_contexts_that_no_other_row_is_like():
    """Counted as one row, their shingles are still in common to them."""
    run = passages.least_run(46, 0.8) // 2 + 1
    size = 2 * passages.REACH + run
    context = np.array([np.arange(size) + 1 + 1000 * (d // 2) for d in range(8)], np.uint32)
    docs = list(range(8))
    pairs = passages.near_pairs(docs, [False] * 8, [[d] for d in docs], context, docs, docs, 46, 0.8)
    assert sorted(pairs) == [(1, 0), (3, 2), (5, 4), (7, 6)]


def test_counts_of_shingles_that_the_same_rows_hold():
    rng = np.random.default_rng(6)
    context = rng.integers(0, 40, (30, 107)).astype(np.uint32)
    context[::3, 10:60] = np.arange(50) + 100  # one stretch in ten rows
    context[5] = 0
    a, b = np.arange(0, 20), np.arange(8, 30)
    count = lambda x: {v: int((x == v).sum()) for v in set(x.tolist()) - {0}}
    want = [[sum(min(n, count(context[j]).get(v, 0)) for v, n in count(context[i]).items()) for j in b] for i in a]
    assert passages._common(context, a, b).tolist() == passages._common(context, a, b, cells=64).tolist() == want
    x, y = rng.integers(0, 30, 50), rng.integers(0, 30, 50)
    tries = passages._Tries(context, 46, 0.8)
    plain = (passages._best_share(context[x], context[y], 46) >= passages.least_share(0.8)).tolist()
    assert tries.may(x, y).tolist() == plain
    tries = passages._Tries(context, 46, 0.8)
    tries.held = None
    assert tries.may(x, y).tolist() == plain
