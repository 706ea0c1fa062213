"""Best-fit packing, improved by a swap-based local search.

Documents are encoded, ended and cut only where they are longer than a sequence; whole sequences are done then. The other
pieces are dealt into groups by hash and packed best-fit, longest first. What best-fit leaves underfull is searched: the
least filled bin gives its pieces away, by moves (a piece goes where it fits), exchanges of one for one (a piece against a
shorter one of another bin) and of two for one either way (two pieces against a shorter one, or one against two). A step is taken
only if it raises the sum of squared fills, so that the search ends, and the bin that gives empties in the end or stays as
it is left. Underfull bins of several groups then meet in a larger group, and so on up a tree, with at most ``PASSED_ON``
bins of each group: no task holds more than that many times ``BRANCH`` bins, however many rows there are.
"""

from __future__ import annotations

import gc
import os
import zlib
from bisect import bisect_left, bisect_right, insort
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, stored, texts
from .tokens import chunks

#: Fixed: pieces of a first group, about; groups that meet in one; underfull bins that a group passes on; words kept a worker.
GROUP_PIECES, BRANCH, PASSED_ON, KEPT_WORDS = 5_000, 16, 48, 1_000_000
#: Shorter items of the giver that each of its items is paired with for two-for-one exchanges.
NEAR = 8
_HELD: dict[str, "WordEncoder"] = {}


# -- encoding -----------------------------------------------------------------


#: Marks that the pre-split cuts off letters before them, and that no normalisation joins to a letter. No apostrophe.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Words(dict):
    """Ids (bytes) by word; an unknown one gets an empty place and is noted in ``new``."""

    def __init__(self):
        super().__init__({"": b""})
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytearray:
        place = self[word] = bytearray()
        self.new.append(word)
        return place


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, for vocabularies that drop white space and mark words'
    ends: texts are cut at spaces and line ends, which no token of such a vocabulary holds, and each distinct word is
    encoded once. A word of letters with marks behind it is made of its parts."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        got = [e.ids for e in self.library.encode_batch(["a b\n c", "a", "b", "c"], add_special_tokens=False)]
        added = self.library.get_added_tokens_decoder().values()
        if got[0] != got[1] + got[2] + got[3] or any(set(" \n") & set(t.content) or t.lstrip or t.rstrip for t in added):
            raise ValueError("the vocabulary keeps white space: words can't be encoded apart")
        vocabulary, suffix = self.library.get_vocab(), self.library.model.end_of_word_suffix or ""
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.words, self.marks = _Words(), {}

    def _library(self, many: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(many, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: many are one text, cut behind each id that ends a word. Where these are more than the
        words (lower case may make a letter two), the words are encoded one by one."""
        out: list[bytes] = []
        for at in range(0, len(words), 16_384):
            lists = [words[k : k + 64] for k in range(at, min(at + 16_384, len(words)), 64)]
            for own, e in zip(lists, self.library.encode_batch_fast([" ".join(x) for x in lists], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
                if len(ends) != len(own) or ends[-1] != 4 * len(ids):
                    out += self._library(own)
                    continue
                raw = ids.tobytes()
                out += [raw[s:t] for s, t in zip([0, *ends], ends)]
        return out

    def _fill(self, new: list[str]) -> None:
        words, cores, made, whole = self.words, [], [], []
        for w in new:
            if w.isalpha():
                cores.append(w)
                continue
            core = w.rstrip(_MARKS)
            if core.isalpha():
                made.append((w, core, w[len(core) :]))
            else:
                whole.append(w)
        more = list({core for _, core, _ in made if not words.get(core)})
        found = dict(zip(cores + more, self._letters(cores + more)))
        marks = list({m for _, _, m in made} - self.marks.keys())
        self.marks.update(zip(marks, self._library(marks)))
        for w in cores:
            words[w] += found[w]
        for w, core, m in made:
            words[w] += (found.get(core) or words[core]) + self.marks[m]
        for w, ids in zip(whole, self._library(whole)):
            words[w] += ids

    def encode(self, many: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self.words = _Words()
        collecting = gc.isenabled()
        gc.disable()  # only strings and bytes are made here: nothing for the collector to find
        try:
            words = self.words
            get = words.__getitem__
            rows = [list(map(get, t.replace("\n", " ").split(" "))) for t in many]
            new, words.new = words.new, []
            self._fill(new)
            return [b"".join(r) for r in rows]
        finally:
            if collecting:
                gc.enable()


def encoder(path: str) -> WordEncoder:
    if path not in _HELD:
        _HELD[path] = WordEncoder(path)
    return _HELD[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def _piece_batches(batches, path, end_id, width, with_ids):
    enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
    for b in batches:
        ids, all_texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            cols = ([], [], [], [], [], [])
            for d, raw in zip(ids[s:e], enc.encode(all_texts[s:e])):
                raw += end
                for k in range(0, len(raw), 4 * width):
                    part = raw[k : k + 4 * width]
                    for c, v in zip(cols, (d, k // (4 * width), k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None)):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])


# -- packing ------------------------------------------------------------------


def best_fit(sizes: list[int], width: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Bins (lists of item numbers) of items at most ``width`` long: longest first, each into the fullest bin with room."""
    bins = [] if bins is None else bins
    room: list[tuple[int, int]] = []  # (room, bin), ascending
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[item],))
        if at < len(room):
            free, k = room.pop(at)
            bins[k].append(item)
        else:
            free, k = width, len(bins)
            bins.append([item])
        if free > sizes[item]:
            insort(room, (free - sizes[item], k))
    return bins


class LocalSearch:
    """Underfull bins, and steps that raise the sum of their squared fills.

    An item's reach is its length and the room of its bin: what may stand in its place. Reaches are kept in order, so that the
    partner that leaves the least room behind is found by bisection; the two shortest items of a bin have a reach together.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], width: int):
        self.sizes, self.width = sizes, width
        self.bins = {k: list(b) for k, b in enumerate(bins)}
        self.fill = {k: sum(sizes[i] for i in b) for k, b in self.bins.items()}
        self.reach: list[tuple[int, int, int, tuple[int, ...]]] = []  # (reach, length, bin, items), ascending
        self.room: list[tuple[int, int]] = []  # (room, bin), ascending
        self.listed: dict[int, list] = {}
        for k in self.bins:
            self.listed[k] = self._entries(k)
            self.reach += self.listed[k]
            self.room.append((width - self.fill[k], k))
        self.reach.sort()
        self.room.sort()

    def _entries(self, k: int) -> list:
        room, own = self.width - self.fill[k], sorted(self.bins[k], key=lambda i: (self.sizes[i], i))
        if not room:
            return []
        single = {self.sizes[i]: (self.sizes[i] + room, self.sizes[i], k, (i,)) for i in own}  # one of each length
        two = self.sizes[own[0]] + self.sizes[own[1]] if len(own) > 1 else 0
        return [*single.values(), *([(two + room, two, k, (own[0], own[1]))] if two else [])]

    def _unlist(self, k: int):
        for entry in self.listed.pop(k):
            del self.reach[bisect_left(self.reach, entry)]
        del self.room[bisect_left(self.room, (self.width - self.fill[k], k))]

    def _list(self, k: int):
        self.listed[k] = self._entries(k)
        for entry in self.listed[k]:
            insort(self.reach, entry)
        insort(self.room, (self.width - self.fill[k], k))

    def _exchange(self, giver: int, mine: tuple[int, ...], k: int, theirs: tuple[int, ...]):
        self._unlist(k)
        for i in mine:
            self.bins[giver].remove(i)
            self.bins[k].append(i)
        for j in theirs:
            self.bins[k].remove(j)
            self.bins[giver].append(j)
        gain = sum(self.sizes[i] for i in mine) - sum(self.sizes[j] for j in theirs)
        self.fill[k] += gain
        self.fill[giver] -= gain
        self._list(k)

    def _give(self, giver: int) -> bool:
        """One step away from ``giver``, which isn't listed; whether there was one."""
        sizes, floor = self.sizes, self.fill[giver]
        own = list({sizes[i]: i for i in sorted(self.bins[giver], reverse=True)}.items())  # one of each length
        own.sort(reverse=True)
        for size, i in own:  # a move: into the fullest bin that has room
            at = bisect_left(self.room, (size, -1))
            if at < len(self.room) and self.fill[k := self.room[at][1]] + size > floor:
                self._exchange(giver, (i,), k, ())
                return True
        pairs = [(a + b, (i, j)) for n, (a, i) in enumerate(own) for b, j in own[n + 1 : n + 1 + NEAR]]
        best = None
        for size, mine in [*((size, (i,)) for size, i in own), *pairs]:
            at = bisect_left(self.reach, (size,))
            while at < len(self.reach) and (best is None or self.reach[at][0] - size < best[0]):
                reach, length, k, theirs = self.reach[at]
                if length < size and self.fill[k] + size - length > floor and not len(mine) == len(theirs) == 2:
                    best = (reach - size, mine, k, theirs)
                    break
                at += 1
            if best and not best[0]:
                break
        if best is None:
            return False
        self._exchange(giver, *best[1:])
        return True

    def _possible(self) -> bool:
        """Whether the room of all bins together holds a bin."""
        return sum(self.width - f for f in self.fill.values()) >= self.width

    def run(self) -> list[list[int]]:
        """The bins left, after sweeps from the least filled bin on, until one empties none."""
        emptied = True
        while emptied and self._possible():
            emptied = False
            for k in sorted(self.bins, key=lambda k: (self.fill[k], k)):
                if not self._possible():
                    break
                self._unlist(k)
                while self.bins[k] and self._give(k):
                    pass
                if self.bins[k]:
                    self._list(k)
                else:
                    del self.bins[k], self.fill[k]
                    emptied = True
        return [self.bins[k] for k in sorted(self.bins)]


def pack_group(sizes: list[int], width: int) -> list[list[int]]:
    """Best fit, then the local search over the bins that it leaves underfull."""
    bins = best_fit(sizes, width)
    fills = [sum(sizes[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fills) if f == width]
    return full + LocalSearch([b for b, f in zip(bins, fills) if f < width], sizes, width).run()


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, grp long, done boolean"


def _packer(width: int, level: int, last: bool):
    def packed(t: pa.Table) -> pa.Table:
        return _pack_group(t, width, level, last)

    return packed


def _pack_group(t: pa.Table, width: int, level: int, last: bool) -> pa.Table:
    t = t.sort_by("row")
    sizes = t.column("length").to_pylist()
    group = t.column("grp")[0].as_py()
    bins = pack_group(sizes, width)
    fills = np.array([sum(sizes[i] for i in b) for b in bins])
    done = np.ones(len(bins), bool)
    if not last:
        done[np.argsort(fills, kind="stable")[:PASSED_ON]] = False
        done[fills == width] = True
    order, sequence, offset, ended = [], [], [], []
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            order.append(i)
            sequence.append((level << 57) + (group << 25) + k)
            offset.append(at)
            ended.append(bool(done[k]))
            at += sizes[i]
    out = t.select(["doc_id", "piece", "start", "length", "ids_crc32", "row"]).take(pa.array(order, pa.int64()))
    for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("grp", [group // BRANCH] * len(order), pa.int64()), ("done", ended, pa.bool_())):
        out = out.append_column(name, pa.array(values, kind))
    return out


def pack(docs: DataFrame, path: str, width: int = 4096, end_id: int = 1, with_ids: bool = True, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids) of all documents.

    A document is its text's ids and ``end_id``; only one longer than ``width`` is cut, into pieces of ``width`` and a rest.
    Pieces of a sequence lie one after the other from offset 0 and fill at most ``width``. A null text is empty (only
    ``end_id``), a null id stays null, repeated rows are documents of their own, an empty table gives none. ids are
    little-endian unsigned 32-bit (null without ``with_ids``).
    """
    made = texts(docs, id_col, text_col).mapInArrow(partial(_piece_batches, path=path, end_id=end_id, width=width, with_ids=with_ids), _PIECES)
    made = stored(made.withColumn("row", F.monotonically_increasing_id()), "pieces")
    own = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    whole = made.where(F.col("length") == width).select(*own, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(F.col("length") < width).select(*own)
    groups = max(1, -(-rest.count() // group_pieces))
    if groups > 1:
        groups = max(groups, parts(docs.sparkSession))
    rest, level, out = rest.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("long")), 0, whole
    while True:
        last = groups == 1
        packed = stored(rest.groupBy("grp").applyInArrow(_packer(width, level, last), _PACKED), "packed")
        out = out.unionByName(packed.where("done").select(*own, "sequence_id", "offset"))
        if last:
            break
        rest, groups, level = packed.where("NOT done").select(*own, "grp"), -(-groups // BRANCH), level + 1
    if with_ids:
        out = out.join(made.select("row", "ids"), "row")
    else:
        out = out.withColumn("ids", F.lit(None).cast("binary"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
