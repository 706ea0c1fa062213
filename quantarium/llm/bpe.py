"""Byte-level BPE by a tokenization automaton.

The automaton reads tokens: a state stands for what may follow, and its accepted paths are exactly the sequences that
BPE produces. It starts with one state that every byte loops on. The merges are then applied in order, each by a
gadget: for the merge of u and v into w, the state behind u becomes a copy without the arc v, and wherever an arc u
is left, an arc w is added that leads where v led. Copies share their arcs until one of them changes, so the compiled
tables keep, per token, from which token's state its own was copied and at which merge, and, per merge, the arc cut;
whether state p has arc t follows from the cuts made along p's copies and t's left parts while these were current.

Every string has exactly one accepted path, and so has each of its prefixes. A word is encoded in one walk over its
bytes: the state behind each prefix is the last token of its path, and transitions, once looked up, are kept in a table.
Written out, the tables would have billions of arcs for a vocabulary of 50,000; that is why copies share them.
Decoding emits the arcs' byte labels.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts
from .tokens import CACHE_PIECES, chunks, unsafe

_HELD: dict[str, "Automaton"] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """Compiled from the vocabulary and merges of a tokenizers JSON file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.labels: dict[int, bytes] = {i: spell(t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: s.encode() for s, i in self.special.items()}
        self.tokens: dict[bytes, int] = {self.labels[i]: i for i in vocab.values()}
        self.longest = [1] * 65536  # of the tokens that start with these two bytes
        for label in self.tokens:
            if len(label) > 1:
                k = label[0] << 8 | label[1]
                self.longest[k] = max(self.longest[k], len(label))
        #: left[w], right[w]: parts; born[w]: the merge's number, -1 for bytes; cut[u << 16 | v]: the merge that cut arc v behind u.
        size = max(self.labels) + 1
        self.left, self.right, self.born = [0] * size, [0] * size, [-1] * size
        self.cut: dict[int, int] = {}
        if size > 65536:
            raise ValueError("ids do not fit in 16 bits")
        #: first[t]: whether the start state has the arc t: its parts' arcs were there when their merge came.
        self.first = [False] * size
        for t in vocab.values():
            self.first[t] = len(self.labels[t]) == 1
        for step, pair in enumerate(spec["model"]["merges"]):
            u, v = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(step, vocab[u], vocab[v], vocab[u + v])
        self.label_list = [self.labels.get(i, b"") for i in range(size)]
        self.arcs: dict[int, bool] = {}  # transitions looked up so far
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Fixed value: the pre-split pattern of byte-level vocabularies.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        self.cut[u << 16 | v] = step
        self.left[w], self.right[w], self.born[w] = u, v, step
        self.first[w] = self.first[u] and self.first[v] and self.has_arc(u, v, step)

    def has_arc(self, p: int, t: int, until: int = 1 << 30) -> bool:
        """Whether t may follow p before merge ``until``: no gadget cut a left part of t behind a right part of p while
        both were current.

        Going back in time, the part born later gives way to its own part. A cut comes before the new arc of its
        merge, so a left part still counts at the merge that made its parent, and a right part does not.
        """
        born, cut = self.born, self.cut
        while True:
            at = cut.get(p << 16 | t)
            if at is not None and at < until:
                return False
            if born[p] > born[t]:
                until = born[p]
                p = self.right[p]
            elif born[t] < 0:
                return True
            else:
                until = born[t] + 1
                t = self.left[t]

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of the word's only accepted path.

        Every prefix has one accepted path too, so one walk over the bytes suffices: from the state behind each prefix,
        named by its last token, each arc that spells what follows gives the state behind a longer prefix.
        """
        n, tokens, longest, arcs, first = len(word), self.tokens, self.longest, self.arcs, self.first
        if len(arcs) > 600_000:
            arcs.clear()
        state = [-1] * (n + 1)  # the last token of the path to each place
        for at in range(n):
            p = state[at]
            if p < 0 and at:
                raise ValueError("a prefix without a path")
            row = p << 16
            end = at + longest[word[at] << 8 | word[at + 1]] if at + 1 < n else n
            for j in range(at + 1, min(n, end) + 1):
                t = tokens.get(word[at:j])
                if t is None or state[j] >= 0:
                    continue
                if at == 0:
                    ok = first[t]
                else:
                    ok = arcs.get(row | t)
                    if ok is None:
                        ok = arcs[row | t] = first[t] and self.has_arc(p, t)
                if ok:
                    state[j] = t
        out, at = [], n
        while at:
            out.append(state[at])
            at -= len(self.label_list[state[at]])
        return out[::-1]

    def _piece(self, piece: str) -> bytes:
        out = []
        for w in self.pattern.findall(piece):
            got = self.words.get(w)
            if got is None:
                got = array("I", self.encode_word(w.encode("utf-8", "surrogatepass"))).tobytes()
                if len(self.words) > CACHE_PIECES // 2:
                    self.words.clear()
                self.words[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit bytes; a special token's string in the text is that token."""
        if any(s in text for s in self.special):
            cut = self.special_pattern.split(text)
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else self.encode_plain(x) for k, x in enumerate(cut))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if not text or unsafe(text):
            return self._piece(text)
        first, *rest = text.split(" ")
        pieces = self.pieces
        try:
            return self._piece(first) + b"".join(map(pieces.__getitem__, rest))
        except KeyError:
            if len(pieces) > CACHE_PIECES:
                pieces.clear()
            for x in rest:
                if x not in pieces:
                    pieces[x] = self._piece(" " + x)
            return self._piece(first) + b"".join(map(pieces.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.label_list.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def automaton(path: str) -> Automaton:
    """The worker's automaton; compiled once a process."""
    if path not in _HELD:
        _HELD[path] = Automaton(path)
    return _HELD[path]


def _encode_batches(batches, path):
    m = automaton(path)
    for b in batches:
        ids, all_texts = b.column("doc_id"), b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            raw = [m.encode(t) for t in all_texts[s:e]]
            yield pa.RecordBatch.from_arrays([ids[s:e], pa.array(raw, pa.binary())], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit) for every row. A null text is an empty one: no ids."""
    return texts(docs, id_col, text_col).mapInArrow(partial(_encode_batches, path=path), "doc_id long, ids binary")


def _decode_batches(batches, path):
    m = automaton(path)
    for b in batches:
        raw = b.column("ids").to_pylist()
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([m.decode(r or b"") for r in raw])], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids). Null ids are none; bytes that are no UTF-8 become replacement characters."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode_batches, path=path), "doc_id long, text string")


def _round_trip_batches(batches, path):
    m = automaton(path)
    for b in batches:
        rows = []
        for t in b.column("text").to_pylist():
            raw = m.encode(t)
            rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(m.decode(raw).encode()).hexdigest()))
        n, a, c = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(c, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded in one pass.

    A null text is an empty one (no ids); rows that repeat each give a row, ids may be null; an empty table gives none.
    """
    return texts(docs, id_col, text_col).mapInArrow(partial(_round_trip_batches, path=path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
