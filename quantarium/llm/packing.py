"""Packing along a space-filling curve.

A document's token counts are projected to three dimensions by fixed pseudo-random directions per token id, squashed
to the unit cube and turned into a Hilbert key. Documents are range-sorted by that key, so neighbours on the curve
are alike, and the ids of each range are cut into sequences of ``width`` in that order.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, parts, stored, texts
from .tokens import CACHE_PIECES, chunks, drop_encoder, encoder

DIMS, BITS, SEED = 3, 10, 20240229


def directions() -> np.ndarray:
    """A fixed direction for each of the 65,536 possible ids."""
    return np.random.default_rng(SEED).standard_normal((1 << 16, DIMS)).astype(np.float32)


def cells(many: list[np.ndarray], towards: np.ndarray) -> np.ndarray:
    """The grid cells of documents: their counts' projection over their norm, through a normal distribution's curve; 0
    without ids. The ids of many documents are counted at once."""
    out, sizes = np.zeros((len(many), DIMS), np.int64), np.array([len(x) for x in many], np.int64)
    row = np.repeat(np.arange(len(many), dtype=np.uint64), sizes)
    both, n = np.unique(row << np.uint64(16) | np.concatenate([*many, np.zeros(0, np.uint16)]).astype(np.uint64), return_counts=True)
    if not len(both):
        return out
    row, kinds, n = (both >> np.uint64(16)).astype(np.int64), (both & np.uint64(0xFFFF)).astype(np.int64), n.astype(np.float64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    z = np.add.reduceat(np.sqrt(n)[:, None] * towards[kinds], starts) / np.sqrt(np.add.reduceat(n, starts))[:, None]
    u = 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))
    out[row[starts]] = np.minimum((u * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
    return out


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of grid cells (rows) along the Hilbert curve: Gray-coded bits with each level's turns undone."""
    x = np.array(cells, np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@gives_back
def _key_batches(batches, path, end_id, pieces, keep=True):
    try:
        yield from _keyed(batches, encoder(path, pieces), end_id)
    finally:
        if not keep:
            drop_encoder(path)


def _keyed(batches, enc, end_id):
    end, towards = np.array([end_id], "<u2").tobytes(), directions()
    for b in batches:
        ids, all_texts = b.column("doc_id"), b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            raw = enc.encode(all_texts[s:e])
            ids_of_all = [np.frombuffer(r, "<u2") for r in raw]
            keys = hilbert_key(np.concatenate([cells(ids_of_all[k : k + 128], towards) for k in range(0, len(raw), 128)]))
            yield pa.RecordBatch.from_arrays([ids[s:e], pa.array(keys), pa.array([r + end for r in raw], pa.binary())], ["doc_id", "key", "ids"])


def power_cuts(n: int) -> list[int]:
    """n as a sum of powers of two, the largest first: sequences of these lengths need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@gives_back
def _pack_batches(batches, width, with_ids):
    base, seq, held, filled = TaskContext.get().partitionId() << 32, 0, [], 0

    def rows(pieces):
        cols = list(zip(*pieces)) if pieces else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    def piece(d, start, ids, total, sequence, offset):
        raw = ids.astype("<u4").tobytes()
        return d, start, len(ids), zlib.crc32(raw), total, base + sequence, offset, raw if with_ids else None

    for b in batches:
        out = []
        for d, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
            ids, at = np.frombuffer(raw, "<u2"), 0
            while at < len(ids):
                part = ids[at : at + width - filled]
                held.append((d, at, part, len(ids)))
                at, filled = at + len(part), filled + len(part)
                if filled == width:
                    offset = 0
                    for x, s, p, t in held:
                        out.append(piece(x, s, p, t, seq, offset))
                        offset += len(p)
                    seq, held, filled = seq + 1, [], 0
        yield rows(out)
    out = []
    for size in power_cuts(filled):  # the last, unfilled sequence of this range
        offset = 0
        while offset < size:
            d, s, p, t = held.pop(0)
            part = p[: size - offset]
            out.append(piece(d, s, part, t, seq, offset))
            if len(part) < len(p):
                held.insert(0, (d, s + len(part), p[len(part) :], t))
            offset += len(part)
        seq += 1
    yield rows(out)


def pack(docs: DataFrame, path: str, width: int = 1024, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text", pieces: int = CACHE_PIECES, keep: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents.

    Every id of a document (its text's, then ``end_id``) lies in exactly one piece; a sequence holds ``width`` ids, but
    for a range's last ones, which are powers of two, so nothing is padded. Sequence ids rise along the curve. A null
    text is empty (only ``end_id``), a null id stays null, repeated rows are packed each, an empty table gives none.
    Ties on the curve are ordered by id, so copies spread over ranges however many there are. ``pieces`` bounds what a
    worker's encoder keeps; a smaller cache takes less memory and more time, and gives the same ids. Without ``keep`` a
    worker drops its encoder at the end of each task, so that idle workers hold none.
    """
    spark = docs.sparkSession
    keyed = stored(texts(docs, id_col, text_col).mapInArrow(partial(_key_batches, path=path, end_id=end_id, pieces=pieces, keep=keep), "doc_id long, key long, ids binary"), "keyed", compression="zstd")
    sorted_ = keyed.repartitionByRange(parts(spark), "key", "doc_id").sortWithinPartitions("key", "doc_id", F.xxhash64("ids"))
    return sorted_.mapInArrow(partial(_pack_batches, width=width, with_ids=with_ids), _PIECES)
