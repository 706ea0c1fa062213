"""Whole texts to token ids with the tokenizers library, with a word cache in each Python worker.

A byte-level BPE with the usual pre-split pattern never merges across a space that follows a character other than
white space: the space starts the next word. Texts are therefore cut before such spaces, each distinct piece is
encoded by the library once per worker, and the pieces' ids are joined. Texts where a cut could differ (two or more
white-space characters around a space, or an added token's string) go to the library whole.
"""

from __future__ import annotations

import gc
import os
import re
from array import array

import numpy as np

#: Pieces kept in a worker's cache before it starts afresh.
CACHE_PIECES = 1_100_000
#: White space other than the space, before a space: conservative, and found by plain searches where it is ASCII.
_BEFORE = tuple(f"{c} " for c in " \n\r\t\x0b\x0c\x1c\x1d\x1e\x1f")
_WIDE_BEFORE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")
#: Letters, marks, and after a line's end perhaps letters and marks again: the pre-split pattern cuts between these.
_SHAPE = re.compile(r"([^\W\d_]+)([^\w\s']*)(?:\n([^\W\d_]+)([^\w\s']*))?")
#: The ASCII ones of these marks.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
_HELD: dict[str, "PieceEncoder"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def unsafe(text: str) -> bool:
    """Whether a cut before one of the text's spaces could change its pre-split words."""
    return text[:1] == " " or text[-1:] == " " or any(b in text for b in _BEFORE) or (not text.isascii() and bool(_WIDE_BEFORE.search(text)))


class PieceEncoder:
    """Ids of whole texts as little-endian 16-bit bytes (the vocabulary has fewer than 65,536 ids)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.get_vocab_size() > 65536:
            raise ValueError("ids do not fit in 16 bits")
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.spaced = np.zeros(65536, bool)  # ids that begin with a space
        for t, i in self.library.get_vocab().items():
            self.spaced[i] = t.startswith("\u0120")
        if any(" " in a for a in self.added):
            raise ValueError("an added token holds a space")
        self.limit = CACHE_PIECES
        self.cache = _Pieces(self.added)
        self.bare: dict[str, bytes] = {}

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of a space and a word for each word of letters only: many words are one text, cut where an id begins with
        the space, which no other id of such a word holds."""
        out: list[bytes] = []
        for at in range(0, len(words), 4096):
            part = words[at : at + 4096]
            got = self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0]
            ids = array("H", got.ids)
            starts = (2 * np.flatnonzero(self.spaced[np.frombuffer(ids, "<u2")])).tolist()
            if len(starts) != len(part):
                raise ValueError("the vocabulary cuts words of letters otherwise than byte-level ones do")
            raw = ids.tobytes()
            out += [raw[s:e] for s, e in zip(starts, [*starts[1:], len(raw)])]
        return out

    def _fill(self, new: list[str]) -> None:
        """Ids for new pieces: a word with marks behind it, and a word after a line's end, are made from their parts."""
        cache, bare, whole, made, cores, marks = self.cache, self.bare, [], [], [], set()
        for x in new:
            if x.isalpha():
                cores.append(x)
                continue
            core = x.rstrip(_MARKS)
            if core.isalpha():
                made.append((x, core, (x[len(core) :],)))
                marks.add(x[len(core) :])
                continue
            m = _SHAPE.fullmatch(x)
            if m:
                core, end, more, last = m.groups()
                if core.isalpha() and (more is None or more.isalpha()):
                    parts = (end,) if more is None else tuple(filter(None, (end, "\n", more, last)))
                    made.append((x, core, parts))
                    marks.update(parts)
                    continue
            whole.append(x)
        cores += {core for _, core, _ in made if core not in cache}
        cache.update(zip(cores, self._words(cores)))
        cache.update(zip(whole, self._library([" " + x for x in whole])))
        marks = list(marks - bare.keys())
        bare.update(zip(marks, self._library(marks)))
        for x, core, parts in made:
            cache[x] = cache[core] + bare[parts[0]] if len(parts) == 1 else cache[core] + b"".join(map(bare.__getitem__, parts))

    def encode(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # only strings and bytes are made here: nothing for the collector to find
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit:
            self.cache.clear()
            self.bare.clear()
        cache = self.cache
        get, heads, found = cache.__getitem__, [], []
        for t in texts:
            pieces = iter(t.split(" "))
            first = next(pieces)
            heads.append(first)
            found.append(list(map(get, pieces)) if first and not cache.unsafe(first) else _WHOLE)
        new, cache.new = cache.new, []
        waiting = [cache[x] for x in new]
        self._fill(new)
        for x, place in zip(new, waiting):
            place += cache[x]
        out: list[bytes | None] = []
        for row in found:
            try:
                out.append(b"".join(row))
            except TypeError:  # a piece that can't stand alone
                out.append(None)
        whole = [t for t, raw in zip(texts, out) if raw is None]
        wholes = iter(self._library(whole))
        heads = iter(self._library([h for h, raw in zip(heads, out) if raw is not None]))
        return [next(wholes) if raw is None else next(heads) + raw for raw in out]


#: Stands for the pieces of a text that goes to the library whole.
_WHOLE = [None]


class _Pieces(dict):
    """Ids by piece; a piece not seen before gets an empty place, to be filled, and is noted in ``new``. None stands for
    a piece that a cut before or behind it could change: an empty one, one that ends in white space, or one with an
    added token's string."""

    def __init__(self, added: list[str]):
        super().__init__()
        self.new: list[str] = []
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.marked = not any(a.isalpha() for a in added)  # then a piece of letters alone holds none

    def unsafe(self, piece: str) -> bool:
        return piece[-1].isspace() or self.added.search(piece) is not None

    def __missing__(self, piece: str) -> bytearray | None:
        if not piece or not (self.marked and piece.isalpha()) and self.unsafe(piece):
            self[piece] = None
            return None
        place = self[piece] = bytearray()
        self.new.append(piece)
        return place


def encoder(path: str, pieces: int = CACHE_PIECES) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; made once a process. It starts its cache afresh beyond ``pieces``."""
    if path not in _HELD:
        _HELD[path] = PieceEncoder(path)
    _HELD[path].limit = pieces
    return _HELD[path]


def drop_encoder(path: str) -> None:
    """Forget the worker's encoder for a vocabulary file, and all its pieces; :func:`encoder` makes a new one."""
    _HELD.pop(path, None)


def chunks(texts: list[str], chars: int = 4_000_000):
    """Slices (from, to) of about so many characters, so that long texts do not add up in memory."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def ids_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2")
