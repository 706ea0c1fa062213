"""Token ids as canonical length-limited Huffman blocks.

Codes of at most 16 bits come from the ids' counts over the whole corpus (package-merge) and are canonical, so that
the code book is one length per id. A file is a table of independent blocks in ascending document order; a block holds
whole documents, its document table, a bit offset for every ``INTERVAL`` ids, and the bits. Decoding looks 16 bits up
in a table; the bit offsets let all stretches of a block, and all blocks of a batch, advance at once.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, stored, texts
from .tokens import chunks, encoder, ids_of

#: Fixed: longest code in bits, ids between bit offsets, ids after which a block closes at the next document's end.
MAX_BITS, INTERVAL, BLOCK_IDS = 16, 256, 65536
_MAGIC = b"CHB1"


# -- code book ----------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal lengths of at most ``max_bits`` for the ids that occur (0 for the others), by package-merge."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    packages, levels = np.zeros(0), []
    for _ in range(max_bits):
        weights = np.concatenate([leaves, packages])
        order = np.argsort(weights, kind="stable")
        levels.append(order < len(leaves))
        merged = weights[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(used) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:take].sum())
        lengths[used[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(1 << (MAX_BITS - size))])[:-1]
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = starts >> (MAX_BITS - size)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, code length) for each 16-bit window."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << MAX_BITS, np.uint16), np.ones(1 << MAX_BITS, np.int64)
    n = int(spans.sum())
    ids[:n], size[:n] = np.repeat(order.astype(np.uint16), spans), np.repeat(lengths[order].astype(np.int64), spans)
    return ids, size


# -- blocks -------------------------------------------------------------------


def encode_block(doc_ids: list, n_ids: list[int], ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ends) else 0
    value = codes[ids] << (64 - (at & 31) - size)  # of a window of 64 bits at each word of 32
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros((total + 31) // 32 + 1, np.uint64)
    if len(ids):  # codes don't overlap: a sum joins those of a word, and its lower half goes to the next word
        value = value.view(np.uint64)
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    body = out.astype(">u4").tobytes()[: (total + 7) // 8 + 3]
    marks = at[::INTERVAL].astype("<u4")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = struct.pack("<4sIII", _MAGIC, len(doc_ids), len(ids), len(marks))
    return b"".join([head, nulls.tobytes(), known.tobytes(), np.array(n_ids, "<u4").tobytes(), marks.tobytes(), body.ljust((total + 7) // 8 + 3, b"\0")])


def decode_blocks(blocks: list[bytes], table: tuple[np.ndarray, np.ndarray]) -> list[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, ids per document, ids) of each block; all stretches between bit offsets advance together."""
    parsed, bits, lanes, left, base = [], [], [], [], 0
    for block in blocks:
        magic, n_docs, n, n_marks = struct.unpack_from("<4sIII", block)
        if magic != _MAGIC:
            raise ValueError("not a block of this format")
        p = 16
        nulls = np.frombuffer(block, np.uint8, n_docs, p)
        known = np.frombuffer(block, "<i8", n_docs, p + n_docs)
        sizes = np.frombuffer(block, "<u4", n_docs, p + 9 * n_docs)
        marks = np.frombuffer(block, "<u4", n_marks, p + 13 * n_docs)
        body = np.frombuffer(block, np.uint8, -1, p + 13 * n_docs + 4 * n_marks)
        parsed.append(([None if z else int(d) for z, d in zip(nulls, known)], sizes, n, n_marks))
        bits.append(body)
        lanes.append(marks.astype(np.int64) + 8 * base)
        left.append(np.minimum(INTERVAL, n - INTERVAL * np.arange(n_marks)))
        base += len(body)
    buf = np.concatenate([*bits, np.zeros(4, np.uint8)]).astype(np.uint32)
    words = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
    at, n_left = np.concatenate(lanes), np.concatenate(left)
    out = np.zeros((len(at), INTERVAL), np.uint16)
    by_id, by_size = table
    last = len(words) - 1
    for k in range(int(n_left.max(initial=0))):
        window = (words[np.minimum(at >> 3, last)] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
        out[:, k] = by_id[window]
        at += by_size[window]
    result, row = [], 0
    for doc_ids, sizes, n, n_marks in parsed:
        result.append((doc_ids, sizes, out[row : row + n_marks].ravel()[:n]))
        row += n_marks
    return result


# -- Spark --------------------------------------------------------------------

_RAW = "file_no int, block_no int, base long, n_ids long, doc_ids array<long>, sizes array<int>, ids binary, counts binary"


def _token_batches(batches, path, end_id):
    """Sorted documents to raw blocks; base: ids of the same file before the block. The task's last block has its counts."""
    enc, end = encoder(path), np.array([end_id], "<u2").tobytes()
    file_no, block_no, base = TaskContext.get().partitionId(), 0, 0
    docs, sizes, raw, n = [], [], [], 0
    counts = np.zeros(1 << 16, np.int64)

    def block(last=False):
        ids = b"".join(raw)
        np.add(counts, np.bincount(ids_of(ids), minlength=1 << 16), out=counts)
        cols = [[file_no], [block_no], [base], [n], [docs], [sizes], [ids], [counts.tobytes() if last else None]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file_no", "block_no", "base", "n_ids", "doc_ids", "sizes", "ids", "counts"])

    for b in batches:
        ids, all_texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            for d, got in zip(ids[s:e], enc.encode(all_texts[s:e])):
                docs.append(d)
                sizes.append(len(got) // 2 + 1)
                raw += (got, end)
                n += sizes[-1]
                if n >= BLOCK_IDS:
                    yield block()
                    block_no, base = block_no + 1, base + n
                    docs, sizes, raw, n = [], [], [], 0
    if docs or block_no:
        yield block(last=True)


def _count_batches(batches):
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for counts in b.column("counts").to_pylist():
            total += np.frombuffer(counts, np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])


def _block_batches(batches, lengths):
    lengths = np.frombuffer(lengths, np.uint8)
    codes = canonical_codes(lengths)
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("doc_ids", "sizes", "ids")))
        out = [encode_block(d, s, ids_of(raw), lengths, codes) for d, s, raw in rows]
        yield pa.RecordBatch.from_arrays([b.column("file_no"), b.column("block_no"), b.column("base"), b.column("n_ids"), pa.array(out, pa.binary())], ["file_no", "block_no", "base", "n_ids", "block"])


def write_tokens(docs: DataFrame, out_dir: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row's whole text, append ``end_id``, and write ``out_dir``/blocks and ``out_dir``/lengths.

    Documents are in ascending id order over files (file_no) and blocks (block_no); null ids come first, a null text
    is empty, repeated rows are all written. The code book is made from at most 65,536 counts, the only rows that the
    driver sees.
    """
    spark = docs.sparkSession
    dealt = texts(docs, id_col, text_col).repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    raw = stored(dealt.mapInArrow(partial(_token_batches, path=path, end_id=end_id), _RAW), "ids", compression="snappy")
    counts = np.zeros(1 << 16, np.int64)
    for r in raw.select("counts").where("counts IS NOT NULL").mapInArrow(_count_batches, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    raw.drop("counts").mapInArrow(partial(_block_batches, lengths=lengths.tobytes()), "file_no int, block_no int, base long, n_ids long, block binary").write.parquet(f"{out_dir}/blocks", compression="none")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{out_dir}/lengths")


def _read_batches(batches, lengths, with_ids):
    table = decode_table(np.frombuffer(lengths, np.uint8))
    for b in batches:
        blocks, bases = b.column("block").to_pylist(), b.column("base").to_pylist()
        for at in range(0, len(blocks), 32):
            cols = ([], [], [], [], [])
            for (doc_ids, sizes, ids), base in zip(decode_blocks(blocks[at : at + 32], table), bases[at : at + 32]):
                ids = ids.astype("<u4")
                ends = np.cumsum(sizes.astype(np.int64))
                for d, e, n in zip(doc_ids, ends.tolist(), sizes.tolist()):
                    raw = ids[e - n : e].tobytes()
                    for c, v in zip(cols, (d, base + e - n, n, zlib.crc32(raw), raw if with_ids else None)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def read_tokens(spark, out_dir: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files of :func:`write_tokens`.

    start counts the ids of all documents before it; ids (little-endian unsigned 32-bit) is null without ``with_ids``. A
    null doc_id is read back as null; files of an empty table give no row.
    """
    blocks = spark.read.parquet(f"{out_dir}/blocks")
    lengths = bytes(spark.read.parquet(f"{out_dir}/lengths").head().lengths)
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))  # one row a file
    before = files.select("file_no", F.coalesce(F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = blocks.join(F.broadcast(before), "file_no").select((F.col("base") + F.col("before")).alias("base"), "block")
    return placed.mapInArrow(partial(_read_batches, lengths=lengths, with_ids=with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
