"""SimHash near-duplicate groups by the generalised pigeonhole principle.

A 64-bit SimHash per text; fingerprints at a Hamming distance of at most ``max_bits`` link, and a group is what can
be reached over links. Bits are grouped so that correlated ones share a partition, and every partition gets its own
threshold: if the thresholds t_i satisfy sum(t_i + 1) > max_bits, two fingerprints within max_bits differ in at most
t_i bits of some partition i. Dynamic programming picks the cheapest thresholds on candidate counts estimated from
all fingerprints. Each partition is probed by masked keys (the partition's bits with up to t_i of them cleared), and
every pair met is verified on all 64 bits.

Only distinct fingerprints are linked, so copies cost nothing. Inside a bucket no pair list is made: a breadth-first
walk gives a spanning forest, at most one edge a row. Buckets beyond ``cap`` rows are cut in blocks; what the blocks'
own links leave apart meets the other blocks in tasks of their own, so no link is lost and no task holds more than two
blocks.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gives_back, parts, repeated_batches, split_by_ids, stored, texts
from .graph import connected_components, rest_against_blocks
from .passages import SHINGLE, first_texts, mix, shingles
from .tokens import chunks

BITS = 64
#: Relative costs of one probe row (made, shuffled, sorted: microseconds) and of one candidate pair (a popcount in an array:
#: some nanoseconds).
PROBE_COST, PAIR_COST = 1.0, 0.01
#: Buckets of up to so many rows are compared by array operations over a whole batch.
SMALL = 5


def simhash(text: str, width: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if set in over half the XXH64 hashes of the word shingles.

    Width 0 takes each distinct word once: few edits then move few bits, and related texts come close.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    if width == 0:
        shingles = set(words)
    elif len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    total, n = np.zeros(BITS, np.int64), 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.int64)[0])


@gives_back
def _fingerprint_batches(batches, width):
    for b in batches:
        fp = np.fromiter((simhash(t, width) for t in b.column("text").to_pylist()), np.int64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row. A null text is an empty one, whose fingerprint is zero."""
    return texts(docs, id_col, text_col).mapInArrow(partial(_fingerprint_batches, width=width), "doc_id long, fp long")


# -- statistics and allocation ------------------------------------------------


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _moment_batches(batches):
    """One row a task: how often each pair of bits is set together (the diagonal: each bit)."""
    both, n = np.zeros((BITS, BITS), np.int64), 0
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 65536):
            x = _bits(fp[at : at + 65536]).astype(np.float32)
            both += (x.T @ x).astype(np.int64)
        n += len(fp)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([both.ravel().tolist()], pa.list_(pa.int64()))], ["n", "both"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the 64 x 64 counts of bits set together, over all of them.

    4096 sums come back, whatever the number of fingerprints: tasks add up first, then Spark adds by position.
    """
    rows = distinct.mapInArrow(_moment_batches, "n long, both array<long>").select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r.pos] = r.s
    return (rows[0].n if rows else 0), both.reshape(BITS, BITS)


def partition_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of nearly equal size, each gathering the bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.clip(p * (1 - p), 1e-12, None))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, groups = list(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        seed = min(left, key=lambda b: (-corr[b, left].sum(), b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = min(left, key=lambda b: (-corr[b, group].sum(), b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def differing_bits(group: list[int], both: np.ndarray, n: int, most: int) -> np.ndarray:
    """Chances that two fingerprints differ in 0, 1, .. ``most`` bits of a group.

    Bits of a group are correlated, so that equal groups are much likelier than independent bits would make them: mean and
    variance come from the counts of bits set together, and a beta-binomial distribution has both. With no more variance
    than of independent bits, it is theirs.
    """
    p = np.diag(both)[group] / max(n, 1)
    set_both = both[np.ix_(group, group)] / max(n, 1)
    one = p[:, None] - set_both  # the first bit set, the second not
    none = 1 - p[:, None] - p[None, :] + set_both
    differ = 2 * (set_both * none + one * one.T)  # of two fingerprints, in both bits
    q = 2 * p * (1 - p)
    np.fill_diagonal(differ, q)
    size, mean = len(group), q.sum()
    variance, alone = differ.sum() - mean * mean, (q * (1 - q)).sum()
    out = np.zeros(most + 1)
    share = mean / size
    plain = size * share * (1 - share)
    rho = (variance / plain - 1) / (size - 1) if size > 1 and plain > 0 else 0.0
    if variance <= alone or not 1e-6 < rho < 1 - 1e-6:
        out[0] = 1
        for x in q:
            out[1:] = out[1:] * (1 - x) + out[:-1] * x
            out[0] *= 1 - x
        return out
    a, b = share * (1 / rho - 1), (1 - share) * (1 / rho - 1)
    for k in range(min(most, size) + 1):
        out[k] = comb(size, k) * exp(lgamma(k + a) + lgamma(size - k + b) - lgamma(size + a + b) + lgamma(a + b) - lgamma(a) - lgamma(b))
    return out


def allocate(groups: list[list[int]], both: np.ndarray, n: int, max_bits: int) -> tuple[float, list[int]]:
    """Thresholds (-1: not probed) with sum(t + 1) = max_bits + 1 at the least estimated cost, by dynamic programming."""
    costs = []
    for g in groups:
        dist = differing_bits(g, both, n, max_bits)
        row = [0.0]
        for t in range(max_bits + 1):
            probes = sum(comb(len(g), k) for k in range(t + 1))
            row.append(PROBE_COST * probes * n + PAIR_COST * dist[: t + 1].sum() * n * n / 2)
        costs.append(row)
    best = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t1 in range(max_bits + 2 - used):
                new = (cost + row[t1], [*ts, t1 - 1])
                if used + t1 not in step or new < step[used + t1]:
                    step[used + t1] = new
        best = step
    return best[max_bits + 1]


def plan_probes(both: np.ndarray, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the cheapest partitioning into 2 to max_bits + 1 groups."""
    options = []
    for m in range(min(2, max_bits + 1), max_bits + 2):
        groups = partition_bits(both, n, m)
        cost, ts = allocate(groups, both, n, max_bits)
        options.append((cost, m, [(g, t) for g, t in zip(groups, ts) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


# -- probing and verification -------------------------------------------------


def _probe_batches(batches, plan):
    """Keys: 10 bits or more for partition and mask, then the masked bits of the partition."""
    masks = []
    for i, (bits, t) in enumerate(plan):
        for k in range(t + 1):
            masks += [(i, ~np.int64(sum(1 << c for c in cleared))) for cleared in combinations(range(len(bits)), k)]
    for b in batches:
        fp_all = b.column("fp").to_numpy(zero_copy_only=False)
        step = max(1, 2_000_000 // max(1, len(masks)))
        for at in range(0, len(fp_all), step):
            fp = fp_all[at : at + step]
            values = []
            for bits, _ in plan:
                v = np.zeros(len(fp), np.int64)
                for k, bit in enumerate(bits):
                    v |= ((fp >> np.int64(bit)) & 1) << np.int64(k)
                values.append(v)
            keys = np.concatenate([((values[i] & mask) * len(masks)) + k for k, (i, mask) in enumerate(masks)]) if masks else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fp, len(masks)))], ["key", "fp"])


def distance(a: np.ndarray, b) -> np.ndarray:
    """Differing bits. The count is of unsigned words: of a negative one numpy would count the absolute value's."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def spanning_edges(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among these fingerprints: each walks from a found one to unseen ones."""
    out, left = [], fp
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = distance(left, x) <= max_bits
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def _table(a, b, block):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(block, pa.int32())], ["a", "b", "block"])


def _bucket_batches(batches, max_bits, cap):
    """Sorted (key, fp) rows to edges (block -1), at most one a row; buckets over cap rows are walked block by block,
    and give their rows as (key, fp, block) too."""
    key0, held, block = None, [], 0  # the bucket that may go on in the next batch

    def close(key, held, block):
        rows = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
        return spanning_edges(rows, max_bits), [(key, int(x), block) for x in rows] if block else []

    for b in batches:
        keys, fps = b.column("key").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        size = ends - starts
        edges, wide = [], []
        inner = np.ones(len(starts), bool)
        inner[-1] = False
        if keys[0] == key0:
            inner[0] = False
        elif key0 is not None:
            e, w = close(key0, held, block)
            edges, wide = edges + e, wide + w
            held, block, key0 = [], 0, None
        small = inner & (size > 1) & (size <= SMALL)
        ok = np.repeat(small, size)
        for d in range(1, int(size[small].max(initial=1))):  # small buckets: all pairs, by their distance in the batch
            hit = np.flatnonzero(ok[:-d] & (keys[:-d] == keys[d:]) & (distance(fps[:-d], fps[d:]) <= max_bits))
            edges += list(zip(fps[hit].tolist(), fps[hit + d].tolist()))
        todo = [g for g in np.flatnonzero((size > SMALL) | ~inner)]
        for g in todo:
            s, e_, key = starts[g], ends[g], keys[starts[g]]
            if key != key0:
                if key0 is not None:
                    e, w = close(key0, held, block)
                    edges, wide = edges + e, wide + w
                key0, held, block = key, [], 0
            held.append(fps[s:e_])
            while sum(map(len, held)) > cap:  # too wide: give full blocks away at once
                rows = np.concatenate(held)
                edges += spanning_edges(np.unique(rows[:cap]), max_bits)
                wide += [(int(key), int(x), block) for x in rows[:cap]]
                held, block = [rows[cap:]], block + 1
            if inner[g]:
                e, w = close(key0, held, block)
                edges, wide = edges + e, wide + w
                key0, held, block = None, [], 0
        if edges:
            a, c = zip(*edges)
            yield _table(a, c, [-1] * len(a))
        if wide:
            a, c, k = zip(*wide)
            yield _table(a, c, k)
    if key0 is not None:
        e, w = close(key0, held, block)
        for rows, blocks in ((e, None), (w, True)):
            if rows:
                yield _table([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows] if blocks else [-1] * len(rows))


def _joining(max_bits):
    """Edges from the rest's fingerprints of one block to fingerprints of another block: one for each root they reach."""

    def walk(table):
        node, root, rest = (table.column(c).to_numpy() for c in ("node", "root", "rest"))
        rest = rest.astype(bool)
        edges = []
        for x, r in zip(node[rest], root[rest]):
            near = (distance(node[~rest], x) <= max_bits) & (root[~rest] != r)
            _, first = np.unique(root[~rest][near], return_index=True)
            edges += [(int(x), int(y)) for y in node[~rest][near][first]]
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return walk


def link_fingerprints(distinct: DataFrame, max_bits: int = 4, cap: int = 4096) -> DataFrame:
    """Edges (a, b) that connect what links connect, over a table of distinct fingerprints (fp). Rows with a null fp are
    left out; an empty table gives none.

    A bucket gives at most one edge a row. Buckets over ``cap`` rows are linked inside their blocks first; then only
    fingerprints that are not yet in the bucket's largest component meet the other blocks.
    """
    spark = distinct.sparkSession
    known = distinct.select("fp").where("fp IS NOT NULL")
    n, both = bit_statistics(known)
    plan = plan_probes(both, n, max_bits)
    probes = known.mapInArrow(partial(_probe_batches, plan=plan), "key long, fp long")
    dealt = probes.repartition(parts(spark), "key").sortWithinPartitions("key", "fp")
    found = stored(dealt.mapInArrow(partial(_bucket_batches, max_bits=max_bits, cap=cap), "a long, b long, block int"), "links")
    edges = found.where("block < 0").select("a", "b")
    wide = found.where("block >= 0").select(F.col("a").alias("key"), F.col("b").alias("node"), "block")
    if wide.isEmpty():
        return edges
    rooted = wide.join(connected_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    more = rest_against_blocks(rooted, cap).groupBy("key", "rest_block", "block").applyInArrow(_joining(max_bits), "a long, b long")
    return edges.unionByName(more)


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, cap: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the smallest doc_id of all rows whose fingerprints can be reached over links; rows of equal
    fingerprint belong together. A null text counts as empty (fingerprint zero); rows with a null id keep their row
    and get the smallest id that is not null, or null; repeated rows each give a row; an empty table gives none.
    """
    fps = stored(fingerprints(docs, width, id_col, text_col), "fps")
    groups = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(link_fingerprints(groups.select("fp"), max_bits, cap))
    rooted = groups.join(roots, groups.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


# -- verified on shingles -----------------------------------------------------

#: Bands of minima: a pair of similarity s shares no band with probability (1 - s^ROWS)^BANDS, 0.07 % at 0.8.
BANDS, ROWS = 24, 6
#: Minima whose last four bits estimate a similarity; LEAST_ESTIMATE lies 3.8 standard deviations under 0.8, so that
#: a pair of similarity 0.8 is missed with a probability under 0.01 %.
SKETCH, LEAST_ESTIMATE = 128, 0.66
#: Rows and characters of one block of a candidate cluster, compared in one task.
BLOCK_ROWS, BLOCK_CHARS = 1024, 4_000_000
_FACTORS = np.random.default_rng(20240301).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ONES = np.uint64(0x1111111111111111)


def text_shingles(text: str) -> np.ndarray:
    """Distinct hashes of the runs of five words; a shorter text is one run, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if 0 < len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 5)], np.uint64)
    return np.unique(shingles(words))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The smallest hash of each set (row) under each of BANDS * ROWS functions; the largest number for an empty set."""
    out = np.full((len(sets), BANDS * ROWS), np.uint64(2**64 - 1))
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 8192):
            size += len(sets[to])
            to += 1
        full = [k for k in range(at, to) if len(sets[k])]
        if to == at + 1:  # one set, however large
            for k in range(0, size, 8192):
                out[at] = np.minimum(out[at], (sets[at][k : k + 8192, None] * _FACTORS[0] + _FACTORS[1]).min(axis=0))
        elif full:
            h = np.concatenate([sets[k] for k in full])
            starts = np.cumsum([0] + [len(sets[k]) for k in full[:-1]])
            out[full] = np.minimum.reduceat(h[:, None] * _FACTORS[0] + _FACTORS[1], starts, axis=0)
        at = to
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys, signed."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(least), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key + least[:, r::ROWS], 11)
    return key.view(np.int64)


def sketches(least: np.ndarray) -> np.ndarray:
    """(rows, 8) words of 16 times four bits."""
    four = (mix(least[:, :SKETCH], 12) >> np.uint64(60)).astype(np.uint8)
    return np.ascontiguousarray(four[:, ::2] | four[:, 1::2] << 4).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated similarity of rows of sketches: of four equal bits, one in sixteen is so by chance."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    same = 1 - np.bitwise_count(x & _ONES).sum(axis=-1) / SKETCH
    return (same - 1 / 16) * 16 / 15


@gives_back
def _sketch_batches(batches):
    for b in batches:
        all_texts = b.column("text").to_pylist()
        for s, e in chunks(all_texts):
            fp = np.fromiter((simhash(t, 0) for t in all_texts[s:e]), np.int64, e - s)
            least = minima([text_shingles(t) for t in all_texts[s:e]])
            keys, drawn = band_keys(least), sketches(least)
            flat = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[s:e], pa.array(fp), flat, pa.array([r.tobytes() for r in drawn], pa.binary())], ["doc_id", "fp", "keys", "sketch"])


def _pairs(edges):
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])


def _alike(ids: list[int], drawn: list[bytes]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that are alike by their sketches."""
    words = np.frombuffer(b"".join(drawn), np.uint64).reshape(len(ids), SKETCH // 16)
    out, left = [], np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = estimate(words[left], words[x]) >= LEAST_ESTIMATE
            out += [(ids[x], ids[y]) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return out


def _alike_batches(batches, cap):
    """Rows (key, doc_id, sketch) sorted by key to edges, at most one a row: of the first ``cap`` rows of a key those
    that are alike; all later rows link to the first, since candidates too many do no harm."""
    key0, first, ids, drawn, many = None, None, [], [], False
    for b in batches:
        edges = []
        for key, d, x in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "sketch"))):
            if key != key0:
                edges += _alike(ids, drawn)
                key0, first, ids, drawn, many = key, d, [], [], False
            if many:
                edges.append((first, d))
                continue
            ids.append(d), drawn.append(x)
            if len(ids) > cap:
                edges += [(first, y) for y in ids[1:]]
                ids, drawn, many = [], [], True
        yield _pairs(edges)
    yield _pairs(_alike(ids, drawn))


def verified_edges(ids: list[int], sets: list[np.ndarray], similarity: float, root: list[int], rest: list[bool] | None = None) -> list[tuple[int, int]]:
    """Edges that connect what the pairs of sets at this Jaccard similarity or more connect, beyond known components.

    Pairs come by their estimated similarity, the likeliest first, and are compared in full unless they are connected
    already. With ``rest``, only pairs of one that is of the rest and one that is not.
    """
    size = np.array([len(s) for s in sets])
    n, up = len(ids), {}

    def find(x):
        while x in up:
            x = up[x]
        return x

    held: dict[int, frozenset] = {}

    def items(k):
        if k not in held:
            held[k] = frozenset(sets[k].tolist())
        return held[k]

    first, second, order = [], [], []
    drawn = sketches(minima(sets)) if n > 1 else None
    for k in range(n - 1):
        ok = np.minimum(size[k], size[k + 1 :]) >= similarity * np.maximum(size[k], size[k + 1 :]) - 1e-9
        if rest is not None:
            ok &= np.array(rest[k + 1 :]) != rest[k]
        likely = estimate(drawn[k + 1 :], drawn[k])
        ok &= likely >= LEAST_ESTIMATE
        to = np.flatnonzero(ok)
        first.append(np.full(len(to), k)), second.append(to + k + 1), order.append(likely[to])
    out = []
    if not first:
        return out
    a, b, by = np.concatenate(first), np.concatenate(second), np.argsort(-np.concatenate(order), kind="stable")
    for x, y in zip(a[by].tolist(), b[by].tolist()):
        rx, ry = find(root[x]), find(root[y])
        if rx == ry:
            continue
        both = len(items(x) & items(y))
        if both >= similarity * (size[x] + size[y] - both) - 1e-9:
            up[max(rx, ry)] = min(rx, ry)
            out.append((ids[x], ids[y]))
    return out


@gives_back
def _block_batches(batches, similarity):
    """Rows (cluster, block, doc_id, text) sorted by cluster and block to verified edges."""
    key0, ids, held = None, [], []
    for b in batches:
        edges = []
        for c, k, d, t in zip(*(b.column(x).to_pylist() for x in ("cluster", "block", "doc_id", "text"))):
            if (c, k) != key0:
                edges += verified_edges(ids, held, similarity, ids)
                key0, ids, held = (c, k), [], []
            ids.append(d), held.append(text_shingles(t))
        yield _pairs(edges)
    yield _pairs(verified_edges(ids, held, similarity, ids))


def _rest_blocks(similarity):
    def walk(table):
        ids, root, rest, all_texts = (table.column(c).to_pylist() for c in ("node", "root", "rest", "text"))
        edges = verified_edges(ids, [text_shingles(t) for t in all_texts], similarity, root, rest)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return walk


def near_duplicate_texts(docs: DataFrame, similarity: float = 0.8, max_bits: int = 4, cap: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for every doc_id that is not null: groups of texts whose five-word shingles have a Jaccard
    similarity of ``similarity`` or more; component_id is the smallest doc_id of the group.

    Candidates are links within ``max_bits`` of the texts' SimHash (of each distinct word once: few edits then move few
    bits) as in :func:`near_duplicates`, and, because a block of changed or added words moves more bits than can be
    probed, texts that share a band of minima and look alike by their sketches. Candidates form clusters. Inside a
    cluster, pairs are compared in full, the likeliest first, until all are connected or refused; a cluster of more than
    a block (BLOCK_ROWS, BLOCK_CHARS) is compared by blocks, and then what is not in its largest component with all
    other blocks. For similarities other than 0.8 BANDS, ROWS and LEAST_ESTIMATE give other chances of a miss.

    Equal texts (a null one counts as empty) belong together, and so do texts without words. Rows with one id are one
    document; if their texts differ, it is that of the smallest MD5. An empty table gives none.
    """
    spark = docs.sparkSession
    base = texts(docs, id_col, text_col).where("doc_id IS NOT NULL")
    ids = stored(first_texts(base), "first")
    own = ids.where("doc_id = first_id").select("doc_id").distinct()
    fields = "doc_id long, fp long, keys array<long>, sketch binary"
    marked = stored(base.mapInArrow(_sketch_batches, fields).join(own, "doc_id", "left_semi"), "sketches")
    firsts = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    near = link_fingerprints(firsts.select("fp"), max_bits)
    a, b = firsts.select(F.col("fp").alias("a"), F.col("first").alias("da")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("db"))
    near = near.join(a, "a").join(b, "b").select(F.col("da").alias("a"), F.col("db").alias("b"))
    same = marked.select("doc_id", "fp").join(firsts, "fp").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    keyed = marked.select(F.explode("keys").alias("key"), "doc_id").repartition(parts(spark), "key").sortWithinPartitions("key", "doc_id")
    shared = stored(keyed.mapInArrow(repeated_batches, "key long, doc_id long"), "bands")
    drawn = shared.join(marked.select("doc_id", "sketch"), "doc_id").repartition(parts(spark), "key").sortWithinPartitions("key", "doc_id")
    alike = drawn.mapInArrow(partial(_alike_batches, cap=cap), "a long, b long")
    roots = connected_components(near.unionByName(same).unionByName(alike))
    some = split_by_ids(base, roots.withColumnRenamed("node", "doc_id"))[0].join(roots.withColumnRenamed("node", "doc_id"), "doc_id")
    some = some.groupBy("doc_id", "root").agg(F.min_by("text", F.md5(F.col("text").cast("binary"))).alias("text"))
    some = stored(some.withColumnRenamed("root", "cluster"), "texts")
    size = some.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS), F.lit(1)).alias("blocks"))
    blocked = some.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = blocked.select("cluster", "block", "doc_id", "text").repartition(parts(spark), "cluster", "block").sortWithinPartitions("cluster", "block", "doc_id")
    links = stored(dealt.mapInArrow(partial(_block_batches, similarity=similarity), "a long, b long"), "near")
    wide = stored(blocked.where("blocks > 1").select(F.col("cluster").alias("key"), F.col("doc_id").alias("node"), "block"), "wide")
    if not wide.isEmpty():
        rooted = wide.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        met = rest_against_blocks(rooted, BLOCK_ROWS).join(some.select(F.col("doc_id").alias("node"), "text"), "node")
        links = links.unionByName(met.groupBy("key", "rest_block", "block").applyInArrow(_rest_blocks(similarity), "a long, b long"))
    found = connected_components(links).withColumnRenamed("node", "first_id")
    return ids.join(found, "first_id", "left").select("doc_id", F.coalesce("root", "first_id").alias("component_id"))


def fingerprint_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
