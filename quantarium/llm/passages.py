"""Near-duplicate passages by compact windows.

A text is a sequence of hashed five-word shingles. For a hash function, a compact window (a, c, b) stands for all
passages inside [a, b] that contain c, whose smallest hash is at c; the windows are the nodes of the sequence's
Cartesian tree that are wide enough for a passage. An edit costs two near-equal passages four shingles or more each, so
they hold an equal run of some length (:func:`least_run`; 21 shingles for 50 words at 0.8). Windows are made for runs of
that length: the run has its smallest hash at the same word in both texts, and reaches at least half its length to one
side of it. The key of a window and side is the stretch from c to that side (15 words), so one hash function meets every
such pair. Only passages that repeat within themselves (a period under five words) can be edited at a lesser cost.

Keys that one document alone holds go at once. Stretches of 45 words around a window's place are keys of their own: all
that share one are near enough, so a star to the first document loses no unedited passage of 50 words, whatever else the
group holds. For edited ones, all documents of a window's key are compared, but for those that a star joins at that place
already. Small groups give their pairs; in larger ones, pairs are first counted by the shingles that their surroundings
have in common, then followed there, until what is near is joined and every place that an earlier document's is near to
has a pair. Groups beyond a block are compared block by block: only what the largest star leaves out meets all blocks.

Pairs are verified on the texts. From each common window the texts are followed to both sides, over differences, while
they stay similar. What is found counts if it lies in a stretch of 50 words or more of each text and the similarity of
their shingles is 0.8 or more; its span goes from its first equal shingle to its last.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gives_back, parts, small_batches, split_by_ids, stored, stored_by, texts
from .graph import connected_components
from .tokens import chunks

SHINGLE = 5
_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser: one pseudo-random function for each seed."""
    z = x ^ _U(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the runs of five words; empty for shorter texts."""
    return _shingles(np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words)))


def _shingles(w: np.ndarray) -> np.ndarray:
    n = len(w) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, _U)
    w, total = mix(w, 1), np.zeros(n, _U)
    for k, odd in enumerate(_ODD):
        total += w[k : n + k] * _U(odd)
    return mix(total, 2)


#: Places before and behind a text that hashes of runs may reach.
PAD = 32
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse


@lru_cache(maxsize=1)
def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        x = np.full(n, base, _U)
        x[0] = 1
        both.append(np.cumprod(x, dtype=_U))
    return both[0], both[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; texts of about one length share them."""
    return _powers_of(max(1 << 18, 1 << int(n).bit_length()))


class Runs:
    """Hashes of runs of shingles, each in a fixed number of steps: differences of the sums of h[k] * base ** k. Places
    outside the text count as one value."""

    def __init__(self, h: np.ndarray):
        up, self.down = _powers(len(h) + 2 * PAD + 1)
        self.sums = np.zeros(len(h) + 2 * PAD + 1, _U)
        np.cumsum(h * up[PAD : PAD + len(h)], out=self.sums[PAD + 1 : PAD + 1 + len(h)])
        self.sums[PAD + 1 + len(h) :] = self.sums[PAD + len(h)]

    def __call__(self, at: np.ndarray, length: int, seed: int) -> np.ndarray:
        """Of the ``length`` shingles from each place on."""
        x = at + PAD
        return mix((self.sums[x + length] - self.sums[x]) * self.down[x], seed)


def _is_in(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in ``of``, which is sorted."""
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x if len(of) else np.zeros(len(x), bool)


def _sorted(keys) -> np.ndarray:
    """Signed keys of an array as sorted unsigned ones."""
    return np.sort(keys.view(_U))


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """The values of each row of a column of lists of longs; none of a null."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).tolist()
    return [values[s:e] for s, e in zip([0, *ends], ends)]


def compact_windows(h: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(a, c, b), ends included, of all windows at least ``width`` wide. Of equal minima the middle one splits."""
    out, todo = [], [(0, len(h) - 1)]
    ties = len(np.unique(h)) < len(h)
    while todo:
        a, b = todo.pop()
        if b - a + 1 < width:
            continue
        part = h[a : b + 1]
        c = int(part.argmin())
        if ties:
            same = np.flatnonzero(part == part[c])
            c = int(same[len(same) // 2])
        c += a
        out.append((a, c, b))
        todo += [(a, c - 1), (c + 1, b)]
    return out


@lru_cache
def least_run(width: int, similarity: float) -> int:
    """Length of the equal run that two passages of ``width`` shingles or more hold, at this similarity or more.

    With k edits at least 9 k shingles of both sides are lost, and the m equal ones make k + 1 runs.
    """
    lost = 1 / similarity - 1  # shingles of both sides without a partner, for each equal one
    least = 2 * similarity * width / (1 + similarity)
    runs = [max(9 * k / lost, least) / (k + 1) if k and lost > 0 else least for k in range(width if lost > 0 else 1)]
    return max(1, int(np.ceil(min(runs) - 1e-9)))


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of a small array, sorted, each once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


#: Stretches whose smallest value is looked for at once, where equal values make all of them count.
_ROWS = 1 << 16


def smallest_places(x: np.ndarray, run: int, own: np.ndarray | None = None) -> np.ndarray:
    """The compact windows' places: where the smallest of some stretch of ``run`` values is, the first of equal ones.
    ``own``: of texts that follow one another in ``x``, each value's text; no stretch spans two."""
    rows = np.lib.stride_tricks.sliding_window_view(x, run)
    least, n = x, 1
    while 2 * n <= run:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    least = np.minimum(least[: len(rows)], least[run - n : run - n + len(rows)])
    new = np.concatenate([[True], least[1:] != least[:-1]])
    within = np.ones(len(rows), bool) if own is None else own[: len(rows)] == own[run - 1 :]
    new[1:] |= ~within[:-1]
    at = np.flatnonzero(new & within)
    last = np.flatnonzero(within & np.concatenate([new[1:] | ~within[1:], [True]]))
    c = rows[at].argmin(axis=1) + at
    equal = np.flatnonzero(c < last)  # the place is left behind, and the smallest value stays: there is another one like it
    if not len(equal):
        return c
    sizes = last[equal] - at[equal] + 1
    every = np.repeat(at[equal] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    more = [rows[every[k : k + _ROWS]].argmin(axis=1) + every[k : k + _ROWS] for k in range(0, len(every), _ROWS)]
    return _distinct(np.concatenate([c, *more]))


def window_places(h: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, from, side): for each compact window wide enough for a run, and each side, a hash of the stretch and the
    side, and the stretch's first shingle."""
    keys, at, side, _ = _window_places(h, np.array([len(h)]), width, similarity)
    return keys, at, side


def _window_places(h: np.ndarray, sizes: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, from, side, text) as :func:`window_places` has them, of texts of these sizes that follow one another in
    ``h``. Side 1 comes first; on each side, places ascend. ``from`` counts from the first shingle of all."""
    run = least_run(width, similarity)
    reach = run // 2
    if (sizes < width).any():  # they hold no passage
        long = np.repeat(sizes >= width, sizes)
        if not long.any():
            return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        texts_left = np.flatnonzero(sizes >= width)
        places = np.flatnonzero(long)
        keys, at, side, text = _window_places(h[long], sizes[texts_left], width, similarity)
        return keys, places[at], side, texts_left[text]
    own = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    c = smallest_places(mix(h, 100), run, own if len(sizes) > 1 else None)
    text = own[c]
    runs = Runs(h)
    keys, places, sides, of = [], [], [], []
    for side, ok, back in ((1, c + reach < ends[text], 0), (2, c - reach >= (ends - sizes)[text], reach)):
        at, which = c[ok] - back, text[ok]
        key = runs(at, reach + 1, 200 + side)
        # of one word said over and over, the ends will do, and places a passage apart
        next_to = np.concatenate([[False], (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1), [False]])[: len(key) + 1]
        begun = np.maximum.accumulate(np.where(next_to[:-1], 0, at)) if len(at) else at
        ok = ~(next_to[:-1] & next_to[1:]) | ((at - begun) % width == 0)
        keys.append(key[ok]), places.append(at[ok]), sides.append(np.full(int(ok.sum()), side)), of.append(which[ok])
    return np.concatenate(keys), np.concatenate(places), np.concatenate(sides), np.concatenate(of)


def all_places(many: list[str], width: int, similarity: float):
    """(hashes, window places) of each text, as :func:`text_hashes` and :func:`window_places` have them: the windows of many
    texts are looked for in one array."""
    for hashes in _hash_chunks(many):
        sizes = np.array([len(h) for h in hashes])
        keys, at, side, text = _window_places(np.concatenate(hashes), sizes, width, similarity)
        by = np.argsort(text, kind="stable")
        bounds = np.searchsorted(text[by], np.arange(len(sizes) + 1)).tolist()
        at -= (np.cumsum(sizes) - sizes)[text]
        keys, at, side = keys[by], at[by], side[by]
        for h, s, e in zip(hashes, bounds[:-1], bounds[1:]):
            yield h, (keys[s:e], at[s:e], side[s:e])


@gives_back
def _window_batches(batches, words, similarity):
    width = words - SHINGLE + 1
    for b in batches:
        at = 0
        for hashes in _hash_chunks(b.column("text").to_pylist()):
            keys, _, _, text = _window_places(np.concatenate(hashes), np.array([len(h) for h in hashes]), width, similarity)
            by = np.lexsort((keys, text))
            keys, text = keys[by], text[by]
            ok = np.concatenate([[True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])])[: len(keys)]
            bounds = np.searchsorted(text[ok], np.arange(len(hashes) + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys[ok].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[at : at + len(hashes)], listed], ["doc_id", "keys"])
            at += len(hashes)


def text_hashes(text: str) -> np.ndarray:
    return shingles(text.encode("utf-8", "surrogatepass").lower().split())


def all_hashes(many: list[str]):
    """:func:`text_hashes` of each text: the words of many are hashed in one array, in which no shingle spans two texts."""
    return chain.from_iterable(_hash_chunks(many))


def _hash_chunks(many: list[str]):
    """The same in lists, of texts whose words were hashed at once."""
    for s, e in chunks(many, 500_000):
        words = [t.encode("utf-8", "surrogatepass").lower().split() for t in many[s:e]]
        n = sum(map(len, words))
        both, at, out = _shingles(np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(words)), _U, n)), 0, []
        for own in words:
            out.append(both[at : at + max(0, len(own) - SHINGLE + 1)])
            at += len(own)
        yield out


def long_keys(h: np.ndarray, places: np.ndarray, width: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(keys, from): long stretches around windows' places, from all places before it in steps of a shingle. Whoever
    shares one is near enough, and whoever shares a passage of ``width`` unedited shares one."""
    long = width - SHINGLE  # equal shingles of two passages of ``width``, at the least, after a step is lost
    steps = np.arange(0, 2 * (least_run(width, similarity) // 2) + 1, SHINGLE)
    at = (places[None, :] - steps[:, None]).ravel()
    at = at[(at >= 0) & (at + long <= len(h))]
    return Runs(h)(at, long, 203), at


def _wanted(places, width, similarity, wanted):
    """Of a text's windows, those whose key is ``wanted``: their keys, stretches' starts and places."""
    keys, at, side = places
    ok = _is_in(keys, _sorted(wanted))
    return keys[ok], at[ok], np.where(side == 1, at, at + least_run(width, similarity) // 2)[ok]


@gives_back
def _long_batches(batches, words, similarity):
    width = words - SHINGLE + 1
    for b in batches:
        docs, found = [], []
        found_in = all_places(b.column("text").to_pylist(), width, similarity)
        for d, (h, own), wanted in zip(b.column("doc_id").to_pylist(), found_in, _lists(b.column("keys"))):
            keys = _distinct(long_keys(h, _distinct(_wanted(own, width, similarity, wanted)[2]), width, similarity)[0])
            docs.append(np.full(len(keys), d)), found.append(keys.view(np.int64))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(docs))], ["key", "doc_id"])


#: Groups of a key below this size give their pairs as they are; in others, pairs are first compared by context.
FEW = 8
#: Rows of one block: groups of a key beyond it are compared block by block.
BLOCK = 1024
#: Shingles on either side of a window's stretch that its context holds: what a run of 45, a difference and as much of a
#: second run as makes 41 equal shingles can take.
REACH = 48


def near_rows(h: np.ndarray, own, d: int, width: int, similarity: float, wanted, shared, firsts) -> tuple[np.ndarray, list[tuple], np.ndarray]:
    """(keys, centers, from) of the windows, of all ``own`` ones, whose key is ``wanted``. centers: the ``firsts`` of the long
    stretches around the place whose keys are ``shared``, ascending, or ``d`` itself."""
    keys, at, places = _wanted(own, width, similarity, wanted)
    long = width - SHINGLE
    shared = shared.view(_U)
    by = np.argsort(shared)
    shared, firsts = shared[by], firsts[by]
    keys_long, starts = long_keys(h, _distinct(places), width, similarity)
    ok = _is_in(keys_long, shared)
    starts, index = np.unique(starts[ok], return_index=True)
    first = firsts[np.searchsorted(shared, keys_long[ok][index])]
    lo, hi = np.searchsorted(starts, places - long, "right"), np.searchsorted(starts, places, "right")
    spots = list(zip(lo.tolist(), hi.tolist()))
    made = {(x, y): tuple(sorted(set(first[x:y].tolist()))) or (d,) for x, y in set(spots)}
    return keys, [made[spot] for spot in spots], at


def contexts(h: np.ndarray, at: np.ndarray, reach: int) -> np.ndarray:
    """The shingles around the stretches from ``at`` on, three bytes each; zeros outside the text."""
    x = np.zeros(len(h) + 2 * REACH + reach + 1, np.uint32)
    x[REACH : REACH + len(h)] = np.maximum((mix(h, 204) >> _U(40)).astype(np.uint32), 1)
    size = 2 * REACH + reach + 1
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, size)[at], "<u4")
    return rows.view(np.uint8).reshape(len(at), size, 4)[:, :, :3].reshape(len(at), 3 * size)


@gives_back
def _near_batches(batches, words, similarity, with_context=True):
    width = words - SHINGLE + 1
    reach = least_run(width, similarity) // 2
    for b in batches:
        cols: list[list] = [[], [], [], []]
        sizes, docs = [], b.column("doc_id").to_pylist()
        found = all_places(b.column("text").to_pylist(), width, similarity)
        for (h, own), d, wanted, often, shared, firsts in zip(found, docs, *(_lists(b.column(c)) for c in ("keys", "often", "long_keys", "firsts"))):
            keys, centers, at = near_rows(h, own, d, width, similarity, wanted if with_context else often, shared, firsts)
            around = [None] * len(keys)
            if with_context:
                large = np.flatnonzero(_is_in(keys, _sorted(often)))
                for k, x in zip(large.tolist(), contexts(h, at[large], reach)):
                    around[k] = x.tobytes()
            rows = dict.fromkeys(zip(keys.view(np.int64).tolist(), centers, around))  # each once
            sizes.append(len(rows))
            for col, v in zip(cols, ([r[0] for r in rows], [r[1][0] for r in rows], [r[1][1:] for r in rows], [r[2] for r in rows])):
                col += v
        doc = np.repeat(np.array(docs, np.int64), sizes)
        center = np.array(cols[1], np.int64)
        columns = pa.array(cols[0], pa.int64()), pa.array(doc), pa.array(center < doc), pa.array(center), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())
        yield pa.RecordBatch.from_arrays(list(columns), ["key", "doc_id", "later", "center", "centers", "context"])


NEAR = "key long, doc_id long, later boolean, center long, centers array<long>, context binary"


class _Sets:
    """Disjoint sets."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)


def _common(context: np.ndarray, a: np.ndarray, b: np.ndarray, cells: int = 1 << 22) -> np.ndarray:
    """How many values each row ``a`` has in common with each row ``b``, a value held k times counted k times; zeros do
    not count."""
    used, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, context = both[: len(a)], both[len(a) :], context[used]
    x = np.sort(context, axis=1).astype(np.int64)
    at = np.arange(x.shape[1])
    nth = at - np.maximum.accumulate(np.where(np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1), at, 0), axis=1)
    row, col = np.nonzero(x)
    _, inverse, count = np.unique(x[row, col] << 8 | nth[row, col], return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    ok = count[inverse] > 1
    row, col = row[ok], number[inverse[ok]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    weight = np.ones(0, np.float32)
    if len(col):  # shingles that the same rows hold, as those of an unedited stretch, are one with a weight
        starts = np.flatnonzero(np.concatenate([[True], col[1:] != col[:-1]]))
        held_by = np.add.reduceat(mix(np.arange(len(x), dtype=_U), 205)[row], starts)
        _, first, count = np.unique(held_by, return_index=True, return_counts=True)
        renamed = np.full(len(starts), -1)
        renamed[first] = np.arange(len(first))
        weight, col = count.astype(np.float32), np.repeat(renamed, np.diff(np.concatenate([starts, [len(col)]])))
        row, col = row[col >= 0], col[col >= 0]
        by = np.argsort(col, kind="stable")
        row, col = row[by], col[by]
    out, step = np.zeros((len(a), len(b)), np.float32), max(1, cells // len(x))
    for s in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        i, j = np.searchsorted(col, (s, s + step))
        held = np.zeros((len(x), min(step, int(col[-1]) + 1 - s)), np.float32)
        held[row[i:j], col[i:j] - s] = 1
        out += (held[a] * weight[s : s + step]) @ held[b].T
    i, j = np.nonzero(a[:, None] == b[None, :])
    out[i, j] = (x[a[i]] != 0).sum(axis=1)  # with itself, shingles that no other row holds too
    return out


def _best_share(x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Row by row, the largest share of shingles that the other context holds anywhere, of all stretches of ``width``."""
    out = []
    for s in range(0, len(x), 256):
        p, q = x[s : s + 256], y[s : s + 256]
        same = (p[:, :, None] == q[:, None, :]) & (p != 0)[:, :, None]
        out.append(_share_of(same.any(axis=2), same.any(axis=1), width))
    return np.concatenate(out) if out else np.zeros(0)


def _share_of(held_x: np.ndarray, held_y: np.ndarray, width: int) -> np.ndarray:
    both = []
    for held in (held_x, held_y):
        sums = np.concatenate([np.zeros((len(held), 1), np.int64), np.cumsum(held, axis=1)], axis=1)
        both.append(np.maximum((sums[:, width:] - sums[:, :-width]).max(axis=1) / width, 1e-9))
    return 1 / (1 / both[0] + 1 / both[1] - 1)


class _Tries:
    """What pairs of one group's differing contexts have come to: rows of equal ones get the same answers."""

    #: Documented bound: cells of the table that says which context holds which shingle; without it, contexts are compared.
    CELLS = 1 << 25

    def __init__(self, context: np.ndarray, width: int, similarity: float):
        self.context, self.width, self.similarity, n = context, width, similarity, len(context)
        values, ids = np.unique(context, return_inverse=True)
        self.ids, self.held = ids.reshape(context.shape), None
        if n * len(values) <= self.CELLS:
            self.held = np.zeros((n, len(values)), bool)
            self.held[np.arange(n)[:, None], self.ids] = values[self.ids] != 0
        self.alike: dict[int, bool] = {}
        self.passages: dict[tuple[int, int], bool] = {}

    def may(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether :func:`_best_share` of the contexts x and y is enough."""
        codes, back = np.unique(x * len(self.context) + y, return_inverse=True)
        listed = codes.tolist()
        new = np.array([c for c in listed if c not in self.alike], np.int64)
        if len(new):
            p, q = new // len(self.context), new % len(self.context)
            if self.held is None:
                share = _best_share(self.context[p], self.context[q], self.width)
            else:
                share = _share_of(self.held[q[:, None], self.ids[p]], self.held[p[:, None], self.ids[q]], self.width)
            self.alike.update(zip(new.tolist(), (share >= least_share(self.similarity)).tolist()))
        return np.array([self.alike[c] for c in listed], bool)[back]

    def have_passage(self, x: int, y: int) -> bool:
        if (x, y) not in self.passages:
            p, q = self.context[x], self.context[y]
            begin = [int(np.flatnonzero(z)[0]) for z in (p, q)]
            self.passages[x, y] = passage_at(p[p != 0], q[q != 0], REACH - begin[0], REACH - begin[1], self.width, self.similarity) is not None
        return self.passages[x, y]


def near_pairs(docs: list[int], later: list[bool], centers: list[list[int]], context: np.ndarray | None, first_rows, second_rows, width: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs (doc_id, first_id), later document first, of a row of ``first_rows`` and one of ``second_rows``, such that
    their links join whatever shares a passage around the key, and every place that an earlier document's is near to has
    a pair. Rows of one center are joined by it. With contexts, pairs are tried on them, most shingles in common first."""
    sets, out = _Sets(), set()
    for cs in centers:
        for c in cs:
            sets.join(c, cs[0])
    if context is None:
        return _few_pairs(docs, later, [sets.root(c[0]) for c in centers], first_rows, second_rows)
    done = np.array(later, bool)
    a, b = np.asarray(first_rows), np.asarray(second_rows)
    roots = np.array([sets.root(c[0]) for c in centers])
    ids = np.array(docs)
    later_one = ids[a][:, None] > ids[b][None, :]
    pair = later_one | (ids[a][:, None] < ids[b][None, :])
    if len(a) == len(ids) and len(b) == len(ids):
        pair = np.triu(pair)
    # what is joined already, at places that have a pair, is left out before anything is counted
    pair &= (roots[a][:, None] != roots[b][None, :]) | np.where(later_one, ~done[a][:, None], ~done[b][None, :])
    rows, cols = pair.any(axis=1), pair.any(axis=0)
    a, b, pair = a[rows], b[cols], pair[rows][:, cols]
    if not len(a):
        return []
    of, used = np.zeros(len(ids), np.int64), np.unique(np.concatenate([a, b]))
    numbers: dict[bytes, int] = {}
    of[used] = [numbers.setdefault(context[k].tobytes(), len(numbers)) for k in used.tolist()]
    context = context[used[np.unique(of[used], return_index=True)[1]]]
    # two stretches of ``width`` at this similarity have so many equal shingles
    (one, at_a), (two, at_b) = (np.unique(of[k], return_inverse=True) for k in (a, b))
    common = _common(context, one, two)[at_a][:, at_b]
    i, j = np.nonzero(pair & (common >= np.ceil(2 * similarity * width / (1 + similarity) - 1e-9)))
    by = np.argsort(-common[i, j], kind="stable")
    i, j = a[i[by]], b[j[by]]
    i, j = np.where(ids[i] > ids[j], i, j), np.where(ids[i] > ids[j], j, i)
    tries = _Tries(context, width, similarity) if len(i) else None
    s, step = 0, 64
    while s < len(i):  # a few at a time: what they join needs no further comparison
        x, y = i[s : s + step], j[s : s + step]
        s += step
        ok = (roots[x] != roots[y]) | ~done[x]
        x, y = x[ok], y[ok]
        step = min(2 * step, 4096) if len(x) < 64 else 256
        ok = tries.may(of[x], of[y])
        for k, m in zip(x[ok].tolist(), y[ok].tolist()):
            if done[k] and roots[k] == roots[m]:
                continue
            if (docs[k], docs[m]) not in out:
                if not tries.have_passage(int(of[k]), int(of[m])):
                    continue
                out.add((docs[k], docs[m]))
            done[k] = True
            if roots[k] != roots[m]:
                roots[roots == roots[k]] = roots[m]
    return list(out)


def _few_pairs(docs: list[int], later: list[bool], roots: list[int], first_rows, second_rows) -> list[tuple[int, int]]:
    """What :func:`near_pairs` compares, as it is: pairs that are not joined yet, or whose later document has none here."""
    out = set()
    for i in first_rows:
        for j in second_rows:
            k, m = (i, j) if docs[i] > docs[j] else (j, i)
            if docs[k] != docs[m] and (roots[k] != roots[m] or not later[k]):
                out.add((docs[k], docs[m]))
    return list(out)


@gives_back
def _pair_batches(batches, words, similarity):
    """Rows sorted by key, block and doc_id: the pairs of each group. Rows of ``side`` 1 meet those of side 2, rows of
    side 0 one another. At most one group is held, which is no larger than two blocks."""
    width, held = words - SHINGLE + 1, None

    def groups(t, starts):
        later, center = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("later", "center"))
        sizes = np.diff(starts)
        # nothing to compare: one center, and all but the first document are covered
        rest = np.arange(len(later)) != np.repeat(starts[:-1], sizes)
        open_ = np.add.reduceat((~later.astype(bool) & rest).astype(np.int64), starts[:-1]) > 0
        open_ |= np.maximum.reduceat(center, starts[:-1]) != np.minimum.reduceat(center, starts[:-1])
        found, at = [], 0
        t = t.filter(pa.array(np.repeat(open_, sizes)))
        docs, laters, firsts, mores, sides = (t.column(c).to_pylist() for c in ("doc_id", "later", "center", "centers", "side"))
        few = t.column("context").is_null().to_pylist()
        for n in sizes[open_].tolist():
            here, at = slice(at, at + n), at + n
            centers, context, side = [[c, *more] for c, more in zip(firsts[here], mores[here])], None, sides[here]
            if not few[here.start]:
                raw = t.column("context").slice(here.start, n).to_pylist()
                x = np.zeros((len(raw), len(raw[0]) // 3, 4), np.uint8)
                x[:, :, :3] = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1, 3)
                context = x.view("<u4")[:, :, 0]
            one, two = [k for k, x in enumerate(side) if x < 2], [k for k, x in enumerate(side) if x != 1]
            found += near_pairs(docs[here], laters[here], centers, context, one, two, width, similarity)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["doc_id", "first_id"])

    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t.rename_columns(held.schema.names)])
        key, block = (t.column(c).to_numpy() for c in ("key", "block"))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
        if len(starts) > 1:
            yield groups(t.slice(0, int(starts[-1])), starts)
        held = t.slice(int(starts[-1]))
    if held is not None:
        yield groups(held, np.array([0, held.num_rows]))


def _shared_batches(batches):
    """Of rows sorted by key and doc_id, those whose key another row has too. size: 0, or 1 in a group of :data:`FEW` rows
    or more. A group beyond a block adds one row without a document, whose size is the number of its rows."""
    held, before = None, 0  # the last rows, at most FEW of one key; how many of that key went out before
    schema = ["key", "doc_id", "size"]

    def out(key, doc, before, last):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([starts, [len(key)]]))
        whole = n.copy()
        whole[0] += before
        each = np.repeat(whole, n)
        ok = each > 1
        big = np.flatnonzero(whole > BLOCK)
        big = big[(big < len(starts) - 1) | last]
        docs = pa.concat_arrays([pa.array(doc[ok]), pa.nulls(len(big), pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key[ok], key[starts[big]]])), docs, pa.array(np.concatenate([(each[ok] >= FEW).astype(np.int64), whole[big]]))], schema)

    for b in batches:
        key, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id"))
        if not len(key):
            continue
        if held is not None:
            key, doc = np.concatenate([held[0], key]), np.concatenate([held[1], doc])
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tail = len(key) - int(starts[-1])  # rows of the last key
        own = before if len(starts) == 1 else 0  # of them, what went out before
        if own + tail > FEW:  # known to be a large group: all but one row go out
            cut = len(key) - 1
        else:
            cut = len(key) - tail
        if cut:
            yield out(key[:cut], doc[:cut], before, cut == int(starts[-1]))
        before = own + cut - int(starts[-1]) if cut > int(starts[-1]) else (0 if cut else before)
        held = key[cut:], doc[cut:]
    if held is not None:
        yield out(*held, before, True)


def _first_batches(batches):
    """Rows sorted by key and doc_id: those whose key another row has too, with the first row's document."""
    held, seen, first = None, False, None  # the last row; whether the one before it is its equal; its key's first
    schema = ["key", "doc_id", "first_id"]
    for b in batches:
        key, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc_id"))
        if not len(key):
            continue
        if held is not None:
            key, doc = np.concatenate([held[0], key]), np.concatenate([held[1], doc])
        same = key[1:] == key[:-1]
        keep = np.concatenate([[seen], same]) | np.concatenate([same, [False]])
        at = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(key)), 0))
        firsts = doc[at]
        if seen:
            firsts = np.where(at == 0, first, firsts)
        held, seen, first = (key[-1:], doc[-1:]), bool(keep[-1]), firsts[-1]
        ok = keep[:-1]
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][ok]) for x in (key, doc, firsts)], schema)
    if held is not None and seen:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1]), pa.array(np.array([first], np.int64))], schema)


#: How far behind a difference the two texts may go on to be equal, in shingles: what one passage of the least length
#: can lose, thrice.
AHEAD = 32


def _equal(a: list[int], b: list[int], i: int, j: int) -> int:
    """Length of the equal stretch from a[i] and b[j] on."""
    n, k, step = min(len(a) - i, len(b) - j), 0, 8
    while k < n:
        m = min(step, n - k)
        if a[i + k : i + k + m] == b[j + k : j + k + m]:
            k, step = k + m, 2 * step
        elif m > 8:
            step = 8
        else:
            while a[i + k] == b[j + k]:
                k += 1
            return k
    return n


def _grow(a: list[int], b: list[int], i: int, j: int, similarity: float) -> tuple[list[tuple[int, int, float]], int]:
    """Rows (end in a, end in b, score) behind an equal stretch that starts at (i, j), one after each further equal one;
    and the length of the first. An equal shingle scores 1 - similarity, one skipped on either side -similarity: a
    stretch is similar enough if its score is not negative."""
    first = n = _equal(a, b, i, j)
    i, j, score, best, out = i + n, j + n, 0.0, 0.0, []
    out.append((i, j, 0.0))
    while i < len(a) and j < len(b):
        # the nearest equal shingles behind the difference, those with fewest skipped in a first
        ahead = b[j + AHEAD - 1 : j - 1 if j else None : -1]
        place = dict(zip(ahead, range(len(ahead) - 1, -1, -1)))  # the first place of each
        if place.keys().isdisjoint(a[i : i + AHEAD]):
            break
        skip_a, least = 0, 2 * AHEAD
        for u, x in enumerate(a[i : i + AHEAD]):
            if u >= least:
                break
            v = place.get(x)
            if v is not None and u + v < least:
                skip_a, least = u, u + v
        score -= similarity * least
        if score < best - AHEAD:
            break
        i, j = i + skip_a, j + least - skip_a
        n = _equal(a, b, i, j)
        i, j, score = i + n, j + n, score + (1 - similarity) * n
        best = max(best, score)
        out.append((i, j, score))
    return out, first


def passage_at(a, b, i: int, j: int, width: int, similarity: float) -> tuple[int, int] | None:
    """The longest stretch (from, to) of ``a`` around a[i] = b[j] that lies, with its counterpart, in stretches of
    ``width`` or more shingles at this similarity or more: from its first to its last equal shingle. Arrays or lists."""
    a, b = (x if isinstance(x, list) else x.tolist() for x in (a, b))
    right, n = _grow(a, b, i, j, similarity)
    left, m = _grow(a[i::-1], b[j::-1], 0, 0, similarity)
    if len(left) * len(right) <= 24:  # arrays cost more than so few
        least, found = -1, None
        for x, y, s in left:
            for end, end_b, t in right:
                la, lb = end - (i + 1 - x), end_b - (j + 1 - y)
                if la > least and s + t + (1 - similarity) * (n + m - 1) - similarity * (max(width - la, 0) + max(width - lb, 0)) >= -1e-9:
                    least, found = la, (i + 1 - x, end)
        return found
    left, right = np.array(left), np.array(right)
    starts, starts_b = i + 1 - left[:, 0], j + 1 - left[:, 1]
    la, lb = right[None, :, 0] - starts[:, None], right[None, :, 1] - starts_b[:, None]
    short = np.maximum(width - la, 0) + np.maximum(width - lb, 0)
    score = left[:, 2, None] + right[None, :, 2] + (1 - similarity) * (n + m - 1) - similarity * short
    la = np.where(score >= -1e-9, la, -1)
    best = int(la.argmax())
    if la.flat[best] < 0:
        return None
    x, y = divmod(best, la.shape[1])
    return int(starts[x]), int(right[y, 0])


def least_share(similarity: float) -> float:
    """What the best stretches of the least width must have in common, a little less for rounding: with one difference
    between two equal runs, as wide as the similarity allows, the best stretch of either text has no more than this share
    of equal shingles, which makes s / (2 - s) of both."""
    return similarity / (2 - similarity) - 0.02


def _share(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """For each place of ``a``, the largest share of shingles that ``b`` holds anywhere, of all stretches of ``width``
    around it."""
    sums = np.concatenate([[0], np.cumsum(_is_in(a, np.sort(b)))])
    share = np.full(len(a) + width - 1, 0.0)
    share[width - 1 : len(a)] = (sums[width:] - sums[:-width]) / width
    return np.lib.stride_tricks.sliding_window_view(share, width).max(axis=1)


def match(a: np.ndarray, b: np.ndarray, width: int, similarity: float, places_a=None, places_b=None) -> list[tuple[int, int]]:
    """Stretches (from, to; end exclusive) of ``a`` that ``b`` holds too, near enough, overlapping ones merged.

    Every common window is tried that lies in none found so far, against its places in ``b`` until one fits, unless the shingles
    around both that the other text holds anywhere are too few. Places with equal surroundings are one, since they give
    the same answer, so that texts of repeated lines cost little.
    """
    keys_a, at_a, _ = places_a if places_a is not None else window_places(a, width, similarity)
    keys_b, at_b, _ = places_b if places_b is not None else window_places(b, width, similarity)
    by = np.argsort(keys_b, kind="stable")
    keys_b, at_b = keys_b[by], at_b[by]
    common = _is_in(keys_a, keys_b)
    out: list[tuple[int, int]] = []
    if not common.any():
        return out
    list_a, list_b = a.tolist(), b.tolist()
    share: list[np.ndarray] = []  # made when a try fails: most pairs need none
    least = least_share(similarity)
    done, spread, reach = 0, width + AHEAD, least_run(width, similarity) // 2
    around = lambda x, k: x[max(0, k - spread) : k + spread].tobytes()
    held: dict[int, list[int]] = {}  # the places of a key in b, one of each surroundings
    tried: set[tuple] = set()
    until: dict[int, int] = {}  # by diagonal: the end of the last equal run that was tried in vain
    order = np.argsort(at_a[common], kind="stable")
    for key, i in zip(keys_a[common][order].tolist(), at_a[common][order].tolist()):
        if i + reach < done:
            continue
        if key in held and (key, around(a, i)) in tried:
            continue
        if key not in held:
            places = at_b[np.searchsorted(keys_b, _U(key), "left") : np.searchsorted(keys_b, _U(key), "right")].tolist()
            held[key] = list({around(b, j): j for j in reversed(places)}.values()) if len(places) > 1 else places
        places = held[key]
        if share:
            tries = 1 / (1 / max(share[0][i], 1e-9) + 1 / np.maximum(share[1][places], 1e-9) - 1) >= least
            places = [j for j, ok in zip(places, tries.tolist()) if ok]
        found = None
        for j in places:
            if i < until.get(i - j, 0):
                continue
            found = passage_at(list_a, list_b, i, j, width, similarity)
            if found is not None:
                break
            until[i - j] = i + _equal(list_a, list_b, i, j)
        if found is None:
            tried.add((key, around(a, i)))
            share = share or [_share(a, b, width), _share(b, a, width)]
            continue
        s, e = found
        done = max(done, e)
        while out and out[-1][1] >= s:
            s, e = min(s, out[-1][0]), max(e, out[-1][1])
            out.pop()
        out.append((s, e))
    return out


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """First code points of the words, and those behind their last ones."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.concatenate([[False], (x != 0x20) & ((x < 0x09) | (x > 0x0D)), [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


@gives_back
def _verify_batches(batches, words, similarity):
    width = words - SHINGLE + 1
    for b in batches:
        cols = ([], [], [])
        docs, firsts, texts_a, texts_b = (b.column(c).to_pylist() for c in ("doc_id", "first_id", "text", "first_text"))
        one = dict(zip(chain(docs, firsts), chain(texts_a, texts_b)))  # a text of the batch is looked at once
        held = dict(zip(one, all_places(list(one.values()), width, similarity)))
        for d, f, ta in zip(docs, firsts, texts_a):
            (ha, at_a), (hb, at_b) = held[d], held[f]
            found = match(ha, hb, width, similarity, at_a, at_b)
            if found:
                begins, ends = word_places(ta)
                spans = [(int(begins[s]), int(ends[e + SHINGLE - 2])) for s, e in found]
                for c, v in zip(cols, (d, f, [{"start": s, "end": e} for s, e in spans])):
                    c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "first_id", "spans"])


def first_texts(base: DataFrame) -> DataFrame:
    """(doc_id, first_id): the smallest id with the same text, by its MD5."""
    hashed = base.where("doc_id IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("_h"))
    firsts = hashed.groupBy("_h").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(firsts, "_h").select("doc_id", "first_id").distinct()


def _listed(long: DataFrame) -> DataFrame:
    """(doc_id, long_keys, firsts): one row for each document of ``long``."""
    listed = long.groupBy("doc_id").agg(F.collect_list(F.struct("key", "first_id")).alias("l"))
    return listed.select("doc_id", F.col("l.key").alias("long_keys"), F.col("l.first_id").alias("firsts"))


def _in_blocks(some: DataFrame, long: DataFrame, large: DataFrame, words: int, similarity: float) -> DataFrame:
    """Rows of windows' keys with ``block`` and ``side``. Of ``large`` keys, those with more rows than a block, only what is
    not joined to most by a long stretch is to be compared: in blocks, each against all blocks of the key."""
    listed = stored_by(_listed(long), "listed", "doc_id")  # read twice, shuffled once
    rows = some.join(listed, "doc_id", "left").mapInArrow(partial(_near_batches, words=words, similarity=similarity), NEAR)
    whole = F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("side")
    large = stored(large, "large")
    if large.isEmpty():
        return rows.select("*", *whole)
    # documents without a large key are left out
    light = some.join(F.broadcast(large.agg(F.collect_set("key").alias("large"))), F.arrays_overlap("often", "large"))
    light = light.select("doc_id", "text", "keys", F.array_intersect("often", "large").alias("often")).join(listed, "doc_id", "left")
    light = light.mapInArrow(partial(_near_batches, words=words, similarity=similarity, with_context=False), NEAR).groupBy("key", "center")
    light = light.agg(F.count("*").alias("n"), F.sum(F.col("later").cast("long")).alias("covered"))
    each = light.groupBy("key").agg(F.max_by("center", F.struct("n", "center")).alias("main"), F.sum("n").alias("n"), F.max_by("covered", F.struct("n", "center")).alias("done"))
    each = stored(each.select("key", "main", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil((F.col("n") - F.col("done")) / BLOCK).alias("rests")), "blocks")
    known = rows.join(F.broadcast(each), "key", "left")
    columns = ["key", "doc_id", "later", "center", "centers", "context"]
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    rest = ~F.col("later") | (F.col("center") != F.col("main"))
    number = lambda k, m: (k * F.lit(1 << 20) + m).cast("long")
    one = F.transform(up_to("blocks"), lambda b: F.struct(number(place("rests"), b).alias("block"), F.lit(1).cast("long").alias("side")))
    two = F.transform(up_to("rests"), lambda r: F.struct(number(r, place("blocks")).alias("block"), F.lit(2).cast("long").alias("side")))
    alone = F.array(F.struct(*whole))
    dealt = F.when(F.col("blocks").isNull() | F.col("context").isNull(), alone).when(F.col("rests") < 1, F.slice(alone, 1, 0)).when(rest, F.concat(one, two)).otherwise(two)
    return known.select(*columns, F.explode(dealt).alias("p")).select(*columns, "p.block", "p.side")


def repeated_passages(docs: DataFrame, words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, ids). links: (doc_id, first_id, spans) between differing texts, verified: the spans of doc_id's text (code
    points, end exclusive) that an earlier document first_id holds too. ids: (doc_id, first_id) of equal texts.

    Texts are compared without ASCII case; words are split at ASCII white space. Texts under ``words`` words, and null
    ones, hold no passage. Rows with a null id take no part; rows with one id are one document.
    """
    with small_batches(docs.sparkSession):
        return _repeated_passages(docs, words, similarity, id_col, text_col)


def _repeated_passages(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    ids = stored(first_texts(base), "first")
    own = ids.where("doc_id = first_id").select("doc_id").distinct()
    # a copy's links are those of the first of its text
    copies = stored(ids.select("doc_id").distinct().join(own, "doc_id", "left_anti"), "copies")
    maybe, once = split_by_ids(base, copies)
    made = once.unionByName(maybe.join(copies, "doc_id", "left_anti")).mapInArrow(partial(_window_batches, words=words, similarity=similarity), "doc_id long, keys array<long>")
    dealt = made.select(F.explode("keys").alias("key"), "doc_id").repartition(parts(spark), "key").sortWithinPartitions("key", "doc_id")
    shared = dealt.mapInArrow(_shared_batches, "key long, doc_id long, size long").groupBy("doc_id")
    shared = stored(shared.agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("size") > 0, F.col("key"))).alias("often"), F.max("size").alias("size")), "shared")
    some = split_by_ids(base, shared)[0].join(shared.drop("size"), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "keys", "often"), F.md5(F.col("text").cast("binary"))).alias("r"))
    # read by doc_id twice more: in buckets, so that the texts are shuffled once
    some = stored_by(some.select("doc_id", "r.*"), "texts", "doc_id")
    made = some.mapInArrow(partial(_long_batches, words=words, similarity=similarity), "key long, doc_id long")
    made = made.repartition(parts(spark), "key").sortWithinPartitions("key", "doc_id")
    long = stored(made.mapInArrow(_first_batches, "key long, doc_id long, first_id long"), "long")
    near = _in_blocks(some, long, shared.where("doc_id IS NULL").select(F.explode("keys").alias("key")), words, similarity)
    near = near.repartition(parts(spark), "key", "block").sortWithinPartitions("key", "block", "doc_id")
    near = near.mapInArrow(partial(_pair_batches, words=words, similarity=similarity), "doc_id long, first_id long")
    pairs = stored(long.where("doc_id <> first_id").select("doc_id", "first_id").unionByName(near).distinct(), "pairs")
    often = pairs.groupBy("first_id").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("salts"))
    salted = pairs.join(often, "first_id").withColumn("salt", F.pmod(F.hash("doc_id"), F.col("salts")))
    firsts = some.select(F.col("doc_id").alias("first_id"), F.col("text").alias("first_text")).join(often, "first_id")
    firsts = firsts.select("first_id", "first_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = salted.join(some.select("doc_id", "text"), "doc_id").join(firsts, ["first_id", "salt"])
    links = both.mapInArrow(partial(_verify_batches, words=words, similarity=similarity), "doc_id long, first_id long, spans array<struct<start: long, end: long>>")
    return stored(links, "passages"), ids


#: Pairs of one first document that one task verifies; a document in more pairs is copied.
PAIRS = 256


def has_words(text: str, n: int) -> Column:
    """Whether a text has so many words; it is read no further than that."""
    return F.col(text).rlike(rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{{max(n, 1) - 1}}}[^\x20\x09-\x0D]")


def passage_classes(docs: DataFrame, words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, spans.

    class_id is the smallest doc_id reachable over shared passages (its own for a document that shares none, and for
    texts under ``words`` words); n_links counts the other documents of the class; spans are the passages an earlier
    document holds too (``start:end``, merged, comma-joined; a later copy's span is its whole text). A row with a null
    id keeps its row with a null class; rows of one id have one class; an empty table gives an empty one.
    """
    links, ids = repeated_passages(docs, words, similarity, id_col=id_col, text_col=text_col, **kw)
    roots = stored(connected_components(links.select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))), "roots").withColumnRenamed("node", "first_id")
    spans = merged_spans(links).withColumnRenamed("doc_id", "first_id")
    rooted = stored(ids.join(roots, "first_id", "left").select("doc_id", "first_id", F.coalesce("root", "first_id").alias("root")), "classes")
    sizes = rooted.groupBy("root").agg((F.count("*") - 1).alias("others"))
    named = rooted.join(sizes, "root").join(spans, "first_id", "left").withColumnRenamed("doc_id", "_id")
    long = has_words("text", words)
    rows = texts(docs, id_col, text_col).select("doc_id", F.length("text").cast("long").alias("n_chars"), long.alias("long"))
    both = rows.join(named, rows.doc_id == named._id, "left")
    listed = F.array_join(F.transform(F.col("spans"), lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    copy = F.col("long") & (F.col("doc_id") != F.col("first_id"))
    return both.select(
        "doc_id", F.when(F.col("long"), F.col("root")).otherwise(F.col("doc_id")).alias("class_id"), F.when(F.col("long"), F.coalesce("others", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(copy, F.concat(F.lit("0:"), F.col("n_chars").cast("string"))).when(F.col("long"), F.coalesce(listed, F.lit(""))).otherwise(F.lit("")).alias("spans"),
    )


def merged_spans(links: DataFrame) -> DataFrame:
    """(doc_id, spans): per document, its spans in order, overlapping ones merged."""
    each = links.select("doc_id", F.explode("spans").alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("s"))
    merged = """aggregate(s, CAST(array() AS array<struct<start: bigint, end: bigint>>), (acc, x) ->
        CASE WHEN size(acc) > 0 AND element_at(acc, -1).end >= x.start
             THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
             ELSE concat(acc, array(named_struct('start', x.start, 'end', x.end))) END)"""
    return each.select("doc_id", F.expr(merged).alias("spans"))


def cut_passages(docs: DataFrame, words: int = 50, similarity: float = 0.8, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the passages that an earlier document holds too cut out of ``text``; what is left empty goes.

    Later copies of a text of ``words`` words or more lose all of it. Shorter texts, and rows with a null id or text,
    stay as they are. Columns other than ``text`` are kept.
    """
    links, ids = repeated_passages(docs, words, similarity, text_col=text_col, **kw)
    later = ids.where("doc_id <> first_id").select("doc_id", F.lit(True).alias("_copy"))
    touched = stored(links.select("doc_id").union(later.select("doc_id")).distinct(), "touched")
    maybe, other = split_by_ids(docs, touched)
    both = maybe.join(merged_spans(links), "doc_id", "left").join(later, "doc_id", "left")
    pieces = f"""aggregate(spans, named_struct('at', 1L, 'out', ''),
        (acc, x) -> named_struct('at', x.end + 1, 'out', concat(acc.out, substring({text_col}, CAST(acc.at AS INT), CAST(x.start + 1 - acc.at AS INT)))),
        acc -> concat(acc.out, substring({text_col}, CAST(acc.at AS INT))))"""
    long = has_words(text_col, words)
    cut = F.when(F.col("_copy") & long, F.lit("")).when(F.col("spans").isNotNull(), F.expr(pieces)).otherwise(F.col(text_col))
    changed = both.withColumn("_new", cut)
    left = F.col("_new").isNull() | (F.col("_new") == F.col(text_col)) | F.col("_new").rlike(r"[^\x20\x09-\x0D]")
    return changed.where(left | F.col(text_col).isNull()).withColumn(text_col, F.col("_new")).select(*docs.columns).unionByName(other)
