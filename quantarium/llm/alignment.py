"""Alignment of two tokenizers over a corpus, and how often each pair of their ids meets.

A (a byte-level BPE file of the tokenizers library) and B (a sentencepiece BPE model) both read a text with a space before
it. Byte offsets where a token of A and a token of B end cut the text in groups; the two tokens that end there are linked.
How often a pair of ids is linked in the whole corpus is counted in dense vectors: the distinct pairs get a minimal perfect
hash (levels of bits; a key's place is its rank among the set bits), each part of the corpus becomes a vector indexed by it,
and vectors are summed up a tree. The pairs stand beside the counts, so that a look-up is verified. The pass that aligns the
documents writes their links; a second pass reads these and looks the counts up.

Pairs are dealt by hash into ``SEGMENTS``, each with its own hash function and vector. A segment is bounded by the two
vocabularies, not by the corpus (1.6 thousand million pairs at most, 6.3 million a segment).

Neither tokenizer merges across a space that follows another character than white space: A's pre-split ends a word there, and
no piece of B holds its space mark behind another character (checked when the model is read). Texts are cut there, and a
worker aligns each distinct piece once.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from collections import defaultdict
from functools import partial
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import stored, texts
from .tokens import chunks, unsafe

#: Fixed: parts of the pairs by hash. Pieces that a worker keeps. Bytes of counts that are broadcast at once.
SEGMENTS, KEPT_PIECES, SLICE_BYTES = 256, 500_000, 64 << 20
#: Bits of a level of the hash function to a key that is left.
LOAD = 1.5
_MARK = "▁"
_CUT = re.compile(r"(?<=\S) ")
#: Pieces that are cut apart again where they stand in one text: no white space in them, and no space mark of B.
_JOINED = re.compile(f"[^\\s{_MARK}]+")
_HELD: dict[tuple, "Aligner"] = {}


# -- minimal perfect hash -----------------------------------------------------


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def segment_of(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1000) % np.uint64(SEGMENTS)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash: n distinct keys have the places 0 to n - 1. Keys that share a bit of a level go on to the
    next one. Another key gets some place or -1: its place must be verified against the key that stands there."""

    def __init__(self, ranks: list[np.ndarray]):
        self.ranks = ranks

    @classmethod
    def of(cls, keys: np.ndarray) -> "PerfectHash":
        ranks, left, n, level = [], keys, 0, 0
        while len(left):
            m = max(8, int(LOAD * len(left)))
            at = (_mixed(left, level) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            rank = np.where(alone, np.cumsum(alone) - 1 + n, -1)
            ranks.append(rank.astype(np.int32))
            n += int(alone.sum())
            left, level = left[~alone[at]], level + 1
        return cls(ranks)

    def places(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, rank in enumerate(self.ranks):
            got = rank[(_mixed(keys[left], level) % np.uint64(len(rank))).astype(np.int64)]
            out[left] = got
            left = left[got < 0]
            if not len(left):
                break
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(r) for r in self.ranks], "<u4")
        return np.array([len(sizes)], "<u4").tobytes() + sizes.tobytes() + b"".join(np.packbits(r >= 0).tobytes() for r in self.ranks)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "PerfectHash":
        sizes = np.frombuffer(raw, "<u4", int(np.frombuffer(raw, "<u4", 1)[0]), 4)
        ranks, at, n = [], 4 + 4 * len(sizes), 0
        for m in sizes.tolist():
            bits = np.unpackbits(np.frombuffer(raw, np.uint8, (m + 7) // 8, at), count=m).astype(bool)
            ranks.append(np.where(bits, np.cumsum(bits) - 1 + n, -1).astype(np.int32))
            at, n = at + (m + 7) // 8, n + int(bits.sum())
        return cls(ranks)


class Counts:
    """Counts of pairs, of some segments: {segment: (PerfectHash, keys by place, counts by place)}."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]]):
        self.of = {s: (PerfectHash.from_bytes(h), np.frombuffer(k, np.int64), np.frombuffer(n, np.int64)) for s, h, k, n in rows}

    def look_up(self, pairs: np.ndarray) -> np.ndarray:
        """0 where a pair isn't among these segments' keys."""
        out, segments = np.zeros(len(pairs), np.int64), segment_of(pairs)
        order = np.argsort(segments, kind="stable")
        kinds, starts = np.unique(segments[order], return_index=True)
        for s, rows in zip(kinds.tolist(), np.split(order, starts[1:])):
            if s in self.of:
                mph, keys, counts = self.of[s]
                place = mph.places(pairs[rows])
                right = place >= 0
                right[right] = keys[place[right]] == pairs[rows[right]]
                out[rows[right]] = counts[place[right]]
        return out


# -- alignment ----------------------------------------------------------------


def _columns(rows: list[tuple]) -> tuple:
    """Arrays of (tokens of A, of B, both give back the bytes, number of links, links) of rows that :meth:`Aligner._alone` gives."""
    n_a, n_b, ok, links, _ = zip(*rows) if rows else ((), (), (), (), ())
    flat = np.array([x for own in links for x in own], np.int64)
    return np.array(n_a, np.int64), np.array(n_b, np.int64), np.array(ok, bool), np.array([len(x) for x in links], np.int64), flat


#: Marks that both tokenizers cut off letters before them: A by its pre-split, B if no piece of it has both. No apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words that are encoded as one text.
_WORDS = 512


class Aligner:
    """Aligns pieces once each. Per piece: tokens of A and B, groups, whether both give back its bytes, the groups' text
    (if wanted) and its links (pairs a << 16 | b). Words without white space are encoded many at a time and cut apart again;
    a piece of letters with marks behind it is made of its two parts."""

    def __init__(self, path_a: str, path_b: str, with_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters, vocabulary = byte_letters(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.b_bytes, apart = [], True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if _MARK in piece.lstrip(_MARK):
                raise ValueError("a piece holds the space mark behind another character: texts can't be cut at spaces")
            plain = not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))
            apart = apart and not (plain and any(x.isalpha() and y in _MARKS for x, y in zip(piece, piece[1:])))
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_MARK, " ").encode())
        if len(self.a_bytes) > 1 << 16 or len(self.b_bytes) > 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.apart = apart
        self.a_len, self.b_len = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        self.a_first, self.b_first = (np.array([x[:1] == b" " for x in own]) for own in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.space = [self.b.piece_to_id(_MARK)]
        self.with_text = with_text
        self.clear()

    def clear(self):
        self.places: dict[str, int] = defaultdict(count().__next__)  # numbers of pieces in order of first sight
        self.n_a, self.n_b, self.n_links, self.ok = array("q"), array("q"), array("q"), array("b")
        self.groups: list[str] = []
        self.links: list[np.ndarray] = []  # of all pieces, in order: one array at most

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text cut before spaces that follow another character than white space; these spaces are left out."""
        return _CUT.split(text) if unsafe(text) else text.split(" ")

    def _aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of two token sequences with the same bytes: where they end together (bytes), their links there, and for each
        group its text."""
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        near = np.searchsorted(ends_b, ends_a)  # both end with the same byte: never beyond the last
        at_a = np.flatnonzero(ends_b[near] == ends_a)
        at_b = near[at_a]
        text: list[str] = []
        if self.with_text:
            name = self.names.__getitem__
            sa, sb, i, j = list(map(name, a.tolist())), list(map(name, b.tolist())), 0, 0
            for p, q in zip((at_a + 1).tolist(), (at_b + 1).tolist()):
                text.append((sa[i] if p == i + 1 else ",".join(sa[i:p])) + "|" + (sb[j] if q == j + 1 else ",".join(sb[j:q])))
                i, j = p, q
        return ends_a[at_a], a[at_a].astype(np.int64) << 16 | b[at_b], ends_a, text

    def _alone(self, pieces: list[str], before: str = " ") -> list[tuple]:
        """(tokens of A, of B, both give back the bytes, links, text) of pieces, one by one. before: ' ', or a letter whose
        token is left out again, for what stands behind letters."""
        out = []
        encoded = self.a.encode_batch_fast([(before if before == " " else "") + p for p in pieces], add_special_tokens=False)
        other = self.b.encode([("" if before == " " else before) + p for p in pieces], num_threads=1)
        for piece, e, b in zip(pieces, encoded, other):
            b = b[1:] if before != " " else b if piece else self.space
            raw = ((" " if before == " " else "") + piece).encode("utf-8", "surrogatepass")
            ok = b"".join([self.b_bytes[i] for i in b]) == raw and b"".join([self.a_bytes[i] for i in e.ids]) == raw
            links, text = self._walked(e.ids, b) if ok else ([], [])
            out.append((len(e.ids), len(b), ok, links, ";".join(text)))
        return out

    def _walked(self, a: list[int], b: list[int]) -> tuple[list[int], list[str]]:
        """Links and groups of a few tokens: what :func:`_aligned` does with arrays for many."""
        links, text, at_a, at_b, i, j, p, q = [], [], 0, 0, 0, 0, 0, 0
        name, len_a, len_b = self.names, self.a_bytes, self.b_bytes
        while p < len(a):
            at_a += len(len_a[a[p]])
            p += 1
            while at_b < at_a:
                at_b += len(len_b[b[q]])
                q += 1
            if at_a == at_b:
                links.append(a[p - 1] << 16 | b[q - 1])
                if self.with_text:
                    text.append(",".join([name[x] for x in a[i:p]]) + "|" + ",".join([name[x] for x in b[j:q]]))
                i, j = p, q
        return links, text

    def _words(self, words: list[str]) -> tuple[list[tuple], list[str]]:
        """The same of words: columns of each batch of them, and the words' texts (if wanted)."""
        cols: list[tuple] = []
        out: list[str] = []
        lists = [words[k : k + _WORDS] for k in range(0, len(words), _WORDS)]
        whole = [" ".join(own) for own in lists]
        encoded = self.a.encode_batch_fast([" " + t for t in whole], add_special_tokens=False)
        for own, t, e, ids_b in zip(lists, whole, encoded, self.b.encode(whole, num_threads=1)):
            ids_a, raw = e.ids, (" " + t).encode("utf-8", "surrogatepass")
            a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
            from_a, from_b = np.flatnonzero(self.a_first[a]), np.flatnonzero(self.b_first[b])
            same = b"".join([self.b_bytes[i] for i in ids_b]) == raw and b"".join([self.a_bytes[i] for i in ids_a]) == raw
            if not same or len(from_a) != len(own) or len(from_b) != len(own):
                rows = self._alone(own)
                cols.append(_columns(rows))
                out += [r[4] for r in rows]
                continue
            ends, links, ends_a, text = self._aligned(a, b)
            word_ends = np.append(ends_a[from_a[1:] - 1], ends_a[-1])  # both cut before each space
            cuts = np.searchsorted(ends, word_ends, side="right")
            cols.append((np.diff(from_a, append=len(a)), np.diff(from_b, append=len(b)), np.ones(len(own), bool), np.diff(cuts, prepend=0), links))
            if self.with_text:
                to = cuts.tolist()
                out += [";".join(text[s:e]) for s, e in zip([0, *to], to)]
        return cols, out

    def _fill(self):
        """Align the pieces that came since the last time: words, marks behind letters, and the rest one by one."""
        new = list(islice(self.places, len(self.n_a), None))
        if not new:
            return
        cores: dict[str, int] = defaultdict(count().__next__)
        marks: dict[str, int] = defaultdict(count().__next__)
        whole: list[str] = []
        first, second = [], []  # of each piece: its word, or -1 - n for the n-th of the rest; the marks behind it, or -1
        for p in new:
            core = p.rstrip(_MARKS) if self.apart else ""
            if core.isalpha() and len(core) < len(p):
                first.append(cores[core])
                second.append(marks[p[len(core) :]])
            elif p.isalpha() or _JOINED.fullmatch(p):
                first.append(cores[p])
                second.append(-1)
            else:
                first.append(-1 - len(whole))
                second.append(-1)
                whole.append(p)
        cols, text = self._words(list(cores))
        for rows in (self._alone(whole), self._alone(list(marks), before="a")):
            cols.append(_columns(rows))
            text += [r[4] for r in rows] if self.with_text else []
        n_a, n_b, ok, n, links = (np.concatenate(c) for c in zip(*cols))
        x, y = np.array(first, np.int64), np.array(second, np.int64)
        x, has = np.where(x < 0, len(cores) - 1 - x, x), y >= 0
        y = np.where(has, y + len(cores) + len(whole), 0)
        for own, v in ((self.n_a, n_a), (self.n_b, n_b), (self.n_links, n)):
            own.frombytes((v[x] + np.where(has, v[y], 0)).astype(np.int64).tobytes())
        self.ok.frombytes((ok[x] & (ok[y] | ~has)).astype(np.int8).tobytes())
        if self.with_text:
            self.groups.extend([text[i] + ";" + text[j] if h else text[i] for i, j, h in zip(x.tolist(), y.tolist(), has.tolist())])
        parts = np.stack([x, y], 1)[np.stack([np.ones_like(has), has], 1)]  # word, marks, word, marks, ...
        sizes, starts = n[parts], (np.cumsum(n) - n)[parts]
        pairs = links[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        self.links = [np.concatenate([*self.links, pairs])]

    def read(self, many: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pieces; no number for a text that has no tokens."""
        get = self.places.__getitem__
        collecting = gc.isenabled()
        gc.disable()  # few objects that refer to others are made here
        try:
            rows = [list(map(get, self.pieces(t))) if t else [] for t in many]
            self._fill()
        finally:
            if collecting:
                gc.enable()
        ok = np.frombuffer(self.ok, np.int8).astype(bool)
        out = [np.array(r, np.int64) for r in rows]
        return [r if ok[r].all() else r[:0] for r in out]


def aligner(path_a: str, path_b: str, with_text: bool) -> Aligner:
    """The worker's aligner. One is kept a process."""
    key = (path_a, path_b, with_text)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Aligner(path_a, path_b, with_text)
    return _HELD[key]


def counts_of(token: int, rows) -> Counts:
    """The worker's counts of a slice, which ``token`` names. One slice is kept a process."""
    key = ("counts", token)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Counts(rows.value)
    return _HELD[key]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, and the sums of their counts."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    kinds, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, at, n)
    return kinds, total


_PAIRS = "segment int, task int, pairs binary, n binary"


class _Tally:
    """Numbers of the distinct links of a task's documents."""

    def __init__(self, al: Aligner):
        self.al, self.held, self.seen = al, [], np.zeros(0, np.int64)

    def _flush(self) -> None:
        pairs, sizes = np.concatenate([*self.al.links, np.zeros(0, np.int64)]), np.frombuffer(self.al.n_links, np.int64)
        if len(pairs):
            n = np.repeat(np.pad(self.seen, (0, len(sizes) - len(self.seen))), sizes)
            self.held = [_summed([*self.held, (pairs[n > 0], n[n > 0])])]
        self.seen = np.zeros(0, np.int64)

    def make_room(self) -> None:
        if len(self.al.places) > KEPT_PIECES:
            self._flush()
            self.al.clear()

    def add(self, pieces: np.ndarray) -> None:
        more = np.bincount(pieces, minlength=len(self.seen))
        more[: len(self.seen)] += self.seen
        self.seen = more

    def columns(self) -> list:
        """A row a segment: segment, task, pairs, n."""
        self._flush()
        pairs, n = self.held[0] if self.held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        segments = segment_of(pairs)
        order = np.argsort(segments, kind="stable")
        kinds, starts = np.unique(segments[order], return_index=True)
        rows = np.split(order, starts[1:]) if len(kinds) else []
        cols = [kinds.astype(np.int32), [TaskContext.get().partitionId()] * len(kinds), [pairs[r].tobytes() for r in rows], [n[r].tobytes() for r in rows]]
        return [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))]


def _pair_batches(batches, path_a, path_b):
    """The links of a task's documents: a row a segment, of distinct pairs and their numbers."""
    tally = _Tally(al := aligner(path_a, path_b, False))
    for b in batches:
        all_texts = b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            tally.make_room()
            tally.add(np.concatenate([*al.read(all_texts[s:e]), np.zeros(0, np.int64)]))
    yield pa.RecordBatch.from_arrays(tally.columns(), ["segment", "task", "pairs", "n"])


_BOTH = f"doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, groups string, links binary, {_PAIRS}"
_BOTH_SCHEMA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]]) for c in _BOTH.split(", ")])


def _aligned_batches(batches, path_a, path_b, with_groups):
    """A row a document, with its links one after the other (pairs of four bytes); then, of a task's documents, those of
    :func:`_pair_batches`. Either kind has nulls in the other's columns."""
    tally = _Tally(al := aligner(path_a, path_b, True))
    for b in batches:
        all_texts = b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            tally.make_room()
            found = al.read(all_texts[s:e])
            pieces, ends = np.concatenate([*found, np.zeros(0, np.int64)]), np.cumsum([0, *map(len, found)])
            tally.add(pieces)
            n_a, n_b, sizes = (np.array(x, np.int64)[pieces] for x in (al.n_a, al.n_b, al.n_links))
            total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[ends])
            own = np.array(al.n_links, np.int64)
            starts = (np.cumsum(own) - own)[pieces]
            pairs = np.concatenate([*al.links, np.zeros(0, np.int64)])[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].astype("<u4")
            n_links = total(sizes)
            at = np.concatenate([[0], np.cumsum(4 * n_links)]).astype(np.int32)
            links = pa.Array.from_buffers(pa.binary(), e - s, [None, pa.py_buffer(at), pa.py_buffer(pairs)])
            groups = [";".join(map(al.groups.__getitem__, r.tolist())) for r in found]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            cols = [b.column("doc_id")[s:e], pa.array(total(n_a)), pa.array(total(n_b)), pa.array(n_links), pa.array(digests, pa.string()), pa.array(groups if with_groups else [None] * (e - s), pa.string()), links]
            yield _in_schema(cols, 0)
    yield _in_schema(tally.columns(), 7)


def _in_schema(cols: list, first: int) -> pa.RecordBatch:
    """Columns from the ``first`` on of the rows of :func:`_aligned_batches`, the others null."""
    filled = dict(enumerate(cols, first))
    return pa.RecordBatch.from_arrays([filled[k] if k in filled else pa.nulls(len(cols[0]), f.type) for k, f in enumerate(_BOTH_SCHEMA)], schema=_BOTH_SCHEMA)


def _numbers(t: pa.Table, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in t.column(name).to_pylist()]


def _segment(t: pa.Table) -> int:
    return t.column("segment")[0].as_py()


def _union(t: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate(_numbers(t, "pairs")))
    return pa.table([pa.array([_segment(t)], pa.int32()), pa.array([keys.tobytes()], pa.binary())], ["segment", "pairs"])


def _hashed(t: pa.Table) -> pa.Table:
    """The hash function of a segment, and its keys in their places."""
    keys = np.unique(np.concatenate(_numbers(t, "pairs")))
    mph = PerfectHash.of(keys)
    by_place = np.zeros(len(keys), np.int64)
    by_place[mph.places(keys)] = keys
    return pa.table([pa.array([_segment(t)], pa.int32()), pa.array([mph.to_bytes()], pa.binary()), pa.array([by_place.tobytes()], pa.binary())], ["segment", "hash", "keys"])


def _vector(left: pa.Table, right: pa.Table) -> pa.Table:
    """The dense vector of some tasks' counts of a segment."""
    mph, keys = PerfectHash.from_bytes(right.column("hash")[0].as_py()), _numbers(right, "keys")[0]
    total = np.zeros(len(keys), np.int64)
    for pairs, n in zip(_numbers(left, "pairs"), _numbers(left, "n")):
        place = mph.places(pairs)
        if (keys[place] != pairs).any():
            raise ValueError("a pair isn't at its place")
        total[place] += n
    return pa.table([pa.array([_segment(left)], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["segment", "n"])


def _vector_sum(t: pa.Table) -> pa.Table:
    return pa.table([pa.array([_segment(t)], pa.int32()), pa.array([np.sum(_numbers(t, "n"), axis=0).tobytes()], pa.binary())], ["segment", "n"])


def count_segments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(segment, hash, keys, n) of the corpus: ``docs`` (text). Documents that have no tokens, null ones among them, count
    nothing; without links there is no segment."""
    whole = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    return _counted(stored(whole.mapInArrow(partial(_pair_batches, path_a=path_a, path_b=path_b), _PAIRS), "pairs"))


def _counted(parts: DataFrame) -> DataFrame:
    """:func:`count_segments` of the tasks' rows of pairs and numbers."""
    tasks = parts.agg(F.count_distinct("task")).head()[0]
    branches = max(1, int(np.ceil(np.sqrt(tasks))))  # of the tree: so many vectors meet at its root, and as many at each branch
    parts = parts.withColumn("branch", F.pmod("task", F.lit(branches)))
    some = parts.select("segment", "branch", "pairs").groupBy("segment", "branch").applyInArrow(_union, "segment int, pairs binary")
    hashed = stored(some.groupBy("segment").applyInArrow(_hashed, "segment int, hash binary, keys binary"), "hashes")
    spread = hashed.select("*", F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch"))
    vectors = parts.groupBy("segment", "branch").cogroup(spread.groupBy("segment", "branch")).applyInArrow(_vector_or_none, "segment int, n binary")
    total = vectors.groupBy("segment").applyInArrow(_vector_sum, "segment int, n binary")
    return stored(hashed.join(total, "segment"), "counts")


def _vector_or_none(left: pa.Table, right: pa.Table) -> pa.Table:
    """A branch without rows of a segment gives no vector."""
    if not left.num_rows:
        return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], ["segment", "n"])
    return _vector(left, right)


def _exploded(batches):
    for b in batches:
        keys = np.concatenate([*_numbers(b, "keys"), np.zeros(0, np.int64)])
        n = np.concatenate([*_numbers(b, "n"), np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)), pa.array(n)], ["a", "b", "n"])


def pair_counts(segments: DataFrame) -> DataFrame:
    """(a, b, n): how many links of the corpus hold a pair of ids."""
    return segments.select("keys", "n").mapInArrow(_exploded, "a int, b int, n long")


#: Links whose counts are looked up at once.
_LINKS = 1 << 20


def _looked_up_batches(batches, token, rows, best):
    """Rows of documents, with the counts of a slice added to their sums."""
    counts, best = counts_of(token, rows), np.frombuffer(best, np.int64)
    for b in batches:
        links = b.column("links")
        at = np.frombuffer(links.buffers()[1], np.int32, len(links) + 1, 4 * links.offset) if len(links) else np.zeros(1, np.int32)
        pairs = np.frombuffer(links.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view("<u4")
        of_best, sums = np.zeros(len(pairs) + 1, np.int64), np.zeros(len(pairs) + 1, np.int64)
        for s in range(0, len(pairs), _LINKS):
            kinds, inverse = np.unique(pairs[s : s + _LINKS], return_inverse=True)
            n = counts.look_up(kinds.astype(np.int64))
            sums[s + 1 : s + 1 + len(inverse)] = n[inverse]
            of_best[s + 1 : s + 1 + len(inverse)] = ((n > 0) & (n == best[kinds & 0xFFFF]))[inverse]
        ends = (at - at[0]) // 4
        new = {c: pa.array(b.column(c).to_numpy() + np.diff(np.cumsum(v)[ends])) for c, v in (("n_best", of_best), ("count_sum", sums))}
        yield pa.RecordBatch.from_arrays([new.get(f.name, b.column(k)) for k, f in enumerate(b.schema)], b.schema.names)


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string, links binary"


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True, slice_bytes: int = SLICE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) of every row.

    n_groups: stretches between byte offsets where a token of A and one of B end; n_links: pairs of tokens that end
    together, one a group; count_sum: the sum over links of how many links of the corpus hold the same pair of ids; n_best:
    links whose number is the highest of their B id, ties included. groups: ``a1,a2|b1;a3|b2,b3``, the decimal ids (null
    without ``with_groups``); groups_sha256: its digest, '' without tokens. A null or empty text, or one that a tokenizer
    doesn't give back byte for byte (one with B's space mark), has no tokens: zeros. Null ids stay, repeated rows count
    each, an empty table gives none.

    The counts are broadcast if they fit in ``slice_bytes``; else documents meet one slice of them after the other, and
    carry their sums along in a written table. So a worker holds one slice whatever the number of pairs.
    """
    base = texts(docs, id_col, text_col)
    both = stored(base.mapInArrow(partial(_aligned_batches, path_a=path_a, path_b=path_b, with_groups=with_groups), _BOTH), "aligned", compression="zstd")
    segments = _counted(both.where("segment IS NOT NULL").select("segment", "task", "pairs", "n"))
    sizes = segments.select("segment", (F.length("hash") * 12 + F.length("keys") + F.length("n")).alias("size")).orderBy("segment").collect()  # SEGMENTS rows at most
    slices, room = [[]], slice_bytes
    for r in sizes:
        if slices[-1] and r["size"] > room:
            slices.append([])
            room = slice_bytes
        slices[-1].append(r.segment)
        room -= r["size"]
    best = np.zeros(1 << 16, np.int64)
    for r in pair_counts(segments).groupBy("b").agg(F.max("n").alias("n")).collect():  # as many as B has ids
        best[r.b] = r.n
    none = F.lit(0).cast("long")
    rows = both.where("segment IS NULL").select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", none.alias("n_best"), none.alias("count_sum"), "groups_sha256", "groups", "links")
    for k, own in enumerate(slices):
        if k:
            rows = stored(rows, "slice", compression="zstd")
        got = [(r.segment, bytes(r["hash"]), bytes(r["keys"]), bytes(r["n"])) for r in segments.where(F.col("segment").isin(own)).collect()] if own else []
        shared = docs.sparkSession.sparkContext.broadcast(got)
        rows = rows.mapInArrow(partial(_looked_up_batches, token=shared._jbroadcast.id(), rows=shared, best=best.tobytes()), _ROWS)
    return rows.drop("links")
