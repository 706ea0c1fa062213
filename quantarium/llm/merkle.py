"""A Merkle manifest of a dataset, and its check by a recursive query.

Every row is a leaf; the leaves of a group (a source) form a tree in which each run of three nodes has their hash above it,
and the groups' roots form the tree of the whole. Built levels are stored as node rows that link to their parent. A row
covers ``STRIDE`` levels at once: it holds the siblings on the way from a node to its ancestor there. A recursive query
climbs from every leaf: each step joins the row behind the place reached, appends its siblings to the proof and folds them
with the hash so far, which begins with the hash of what a reader presents.

All leaves of a large tree pass the same few nodes near its root. Rows above the first stride are therefore stored once for
each ``SPAN`` leaves (their chunk), and the leaves of a chunk, which pass the same nodes from there on, climb side by side
in one row: each with its own hash, and with one copy of the siblings that all of them append. So a step's join meets one
row under a key, and what a step carries is a few hashes a leaf.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, stored

#: Fixed: nodes of a run; levels that a node row covers, and so leaves of a chunk.
FAN, STRIDE = 3, 4
SPAN = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1  # the tree of the groups' roots


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@dataclass
class Manifest:
    """chunks: (tree, n, chunk, rung, done, leaves: array of (doc_id, leaf, presented) in order), nodes: (tree, chunk, rung,
    up_rung, last, path, subroot), each linked to the row above it by (tree, chunk, up_rung); path: array of (left, right)
    siblings, from below; n: leaves of the tree. root: the dataset's hash in hex, None without rows."""

    chunks: DataFrame | None
    nodes: DataFrame | None
    root: str | None


def _ranked(rows: DataFrame, *order: str) -> tuple[DataFrame, Column]:
    """Rows in ``order`` over written range parts, and the expression of a row's part; ``_at`` rises within a part."""
    dealt = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked"), F.shiftright("_at", 33)


def _before(rows: DataFrame, part: Column, *group: str) -> DataFrame:
    """(part, group.., first, before, n): of each part and group, the first ``_at``, the rows of the group in earlier
    parts and in all parts. One row a part and group."""
    runs = rows.groupBy(part.alias("_part"), *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    by = Window.partitionBy(*group)
    earlier = F.sum("_k").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    return runs.select("_part", *group, "_first", F.coalesce(earlier, F.lit(0)).alias("_before"), F.sum("_k").over(by).alias("n"))


def placed_leaves(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """``leaves`` (group, doc_id, leaf, ..) with tree (the place of their group), pos (place in the group) and n (leaves of
    the group); the number of groups; the leaves of the largest. No group passes through one task."""
    rows, part = _ranked(leaves, "group", "doc_id", "leaf")
    runs = stored(_before(rows, part, "group"), "runs")
    groups, at = _ranked(runs.groupBy("group").agg(F.max("n").alias("n")), "group")
    trees = groups.join(_before(groups, at).select("_part", "_first", "_before"), at == F.col("_part"))
    trees = stored(trees.select("group", "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree")), "trees")
    found = trees.agg(F.count("*").alias("k"), F.max("n").alias("n")).head()
    known = runs.join(trees.select(F.col("group").alias("g"), "tree"), F.col("group").eqNullSafe(F.col("g"))).drop("g").withColumnRenamed("group", "g")
    both = rows.join(known, (part == known["_part"]) & rows["group"].eqNullSafe(known["g"]))
    return both.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before", "g", "group"), found.k, found.n or 0


def _strides(n: int) -> int:
    """Strides from the leaves of a tree of n to its root."""
    k = 0
    while SPAN**k < n:
        k += 1
    return k


def _strides_of(n: str) -> Column:
    return F.coalesce(*[F.when(F.col(n) <= F.lit(SPAN**k), k) for k in range(10)])


def _levels() -> dict[str, Column]:
    """Columns l1.. of a group of nodes: the levels above l0 (hex hashes); null where the tree has ended below. n: nodes
    of the whole tree at l0."""
    out, n = {}, F.col("n")
    for k in range(STRIDE):
        below = F.col(f"l{k}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / FAN).cast("int"))
        hashes = F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(below, i * FAN + 1, F.lit(FAN)), "").cast("binary"), 256))  # noqa: B023
        out[f"l{k + 1}"] = F.when(n > 1, hashes)
        n = F.floor((n + (FAN - 1)) / FAN)
    return out


def _path(i: Column) -> Column:
    """The siblings of node i of a group at each of its levels, as (left, right)."""
    steps = []
    for k in range(STRIDE):
        level, p = F.col(f"l{k}"), F.floor(i / FAN**k).cast("int")
        inner = p % FAN
        left = F.unhex(F.array_join(F.slice(level, p - inner + 1, inner), ""))
        right = F.unhex(F.array_join(F.slice(level, p + 2, F.lit(FAN - 1) - inner), ""))
        steps.append(F.when(F.col(f"l{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def _with_levels(groups: DataFrame, hashes: Column) -> DataFrame:
    """l0, l1, .. of groups of nodes (n: nodes of the whole tree). Each level comes from a generator of one row, so that it is
    made once, and not anew in every expression over it."""
    for name, level in {"l0": F.transform(hashes, hex_text), **_levels()}.items():
        groups = groups.select("*", F.explode(F.array(level)).alias(name))
    return groups


def _with_paths(groups: DataFrame, own: str) -> DataFrame:
    """groups with ``own``, an array of structs with a hash, where each struct has its path as well."""
    fields = [f.name for f in groups.schema[own].dataType.elementType.fields]
    row = lambda k, i: F.struct(*[k[f].alias(f) for f in fields], _path(i).alias("path"))
    kept = [c for c in groups.columns if c != own]
    return groups.select(*kept, F.explode(F.array(F.transform(own, row))).alias(own))


def _climbed(rows: DataFrame, most: int, carry: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Groups (tree, n, up, kids: array of (pos, hash, carry..)) of each stride of the trees in ``rows`` (tree, pos, n, hash,
    carry..), and the roots (tree, hash). most: nodes of the largest tree."""
    strides, roots = [], rows.where("n = 1").select("tree", "hash")
    for _ in range(_strides(most)):
        kids = F.sort_array(F.collect_list(F.struct("pos", "hash", *carry)))
        groups = rows.where("n > 1").groupBy("tree", "n", F.floor(F.col("pos") / SPAN).alias("up")).agg(kids.alias("kids"))
        groups = _with_levels(groups, F.transform("kids", lambda k: k["hash"]))
        top = F.coalesce(*[F.col(f"l{k}") for k in range(STRIDE, 0, -1)])
        groups = stored(groups.select("tree", "n", "up", "kids", F.unhex(F.get(top, F.lit(0))).alias("up_hash")), "nodes")
        strides.append(groups)
        rows, carry = groups.select("tree", F.col("up").alias("pos"), F.ceil(F.col("n") / SPAN).alias("n"), F.col("up_hash").alias("hash")), ()
        roots = roots.unionByName(rows.where("n = 1").select("tree", "hash"))
    return strides, roots


def _node_rows(groups: DataFrame) -> DataFrame:
    """(tree, pos, path) of each node of a stride's groups."""
    with_paths = _with_paths(_with_levels(groups, F.transform("kids", lambda k: k["hash"])), "kids")
    return with_paths.select("tree", F.explode("kids").alias("k")).select("tree", "k.pos", "k.path")


def build_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", presented: dict[str, Column] | None = None) -> Manifest:
    """The tree over all rows of ``docs``, with the hash of what a reader presents for each of them.

    A leaf hashes the row's ``fields`` one after the other (see :func:`field`); ``presented`` replaces fields by what the
    reader presents instead. Per group, leaves ascend by id, null first, equal ids by their hash; equal rows are leaves of
    their own. A null group is a group, the first one. An empty table has no tree: chunks, nodes and root are None. Other
    columns, whatever their names, take no part.
    """
    presented = presented or {}
    leaf = digest(F.concat(*[field(F.col(c)) for c in fields]))
    shown = digest(F.concat(*[field(presented.get(c, F.col(c))) for c in fields]))
    hashed = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("doc_id"), leaf.alias("leaf"), shown.alias("shown"))
    # Hashes are written first: the range sort reads its rows twice, and texts need be read once only.
    lean = stored(hashed.select("group", "doc_id", "leaf", F.when(F.col("leaf") != F.col("shown"), F.col("shown")).alias("presented")), "leaves")
    placed, n_groups, most = placed_leaves(lean)
    if not n_groups:
        return Manifest(None, None, None)
    base = placed.withColumnRenamed("leaf", "hash")
    strides, subroots = _climbed(base, most, ("doc_id", "presented"))
    subroots = stored(subroots, "subroots")
    top, roots = _climbed(subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_groups).cast("long").alias("n"), "hash"), n_groups)
    root = bytes(roots.head().hash)
    height, chunk = _strides(n_groups), F.floor(F.col("pos") / SPAN)
    kid = F.struct("doc_id", F.col("hash").alias("leaf"), F.coalesce("presented", "hash").alias("presented"))
    first = base.where("n = 1").select("tree", "n", F.lit(0).cast("long").alias("chunk"), F.array(kid).alias("leaves"))
    if strides:
        of = F.transform("kids", lambda k: F.struct(k["doc_id"].alias("doc_id"), k["hash"].alias("leaf"), F.coalesce(k["presented"], k["hash"]).alias("presented")))
        first = first.unionByName(strides[0].select("tree", "n", F.col("up").alias("chunk"), of.alias("leaves")))
    rung = F.least(_strides_of("n"), F.lit(1))
    found = first.select("tree", "n", "chunk", rung.alias("rung"), (rung == _strides_of("n") + height).alias("done"), "leaves")
    # Above the first stride: each node row once a chunk of leaves beneath it, found by the node's place.
    chunks = stored(base.where(F.col("pos") % SPAN == 0).select("tree", "n", chunk.alias("chunk"), _strides_of("n").alias("own")), "chunks")
    rows = [_node_rows(strides[k]).withColumn("rung", F.lit(k)) for k in range(1, len(strides))]
    nodes = None
    if rows:
        inner = rows[0]
        for r in rows[1:]:
            inner = inner.unionByName(r)
        span = F.element_at(F.array(*[F.lit(SPAN**k).cast("long") for k in range(10)]), F.col("rung").cast("int"))
        wanted = chunks.where("own > 1").select("tree", "chunk", "own", F.explode(F.sequence(F.lit(1), F.col("own") - 1)).alias("rung"))
        wanted = wanted.withColumn("pos", F.floor(F.col("chunk") / span))
        nodes = wanted.join(inner, ["tree", "rung", "pos"]).select("tree", "chunk", "rung", "own", "path", F.lit(None).cast("binary").alias("subroot"))
    for k, r in enumerate(top):
        over = _node_rows(r).select(F.col("pos").alias("p"), "path")
        wanted = chunks.withColumn("p", F.floor(F.col("tree") / SPAN**k)).join(over, "p")
        known = wanted.join(subroots.select("tree", F.col("hash").alias("subroot")), "tree") if k == 0 else wanted.withColumn("subroot", F.lit(None).cast("binary"))
        own = known.select("tree", "chunk", (F.col("own") + k).alias("rung"), "own", "path", "subroot")
        nodes = own if nodes is None else nodes.unionByName(own)
    if nodes is not None:
        up = F.col("rung") + 1
        nodes = stored(nodes.select("tree", "chunk", "rung", up.alias("up_rung"), (up == F.col("own") + height).alias("last"), "path", "subroot"), "node-rows")
    return Manifest(found, nodes, root.hex())


#: One step of the climb: the siblings of a node row around a hash so far, one level after the other.
_FOLD = "aggregate({path}, {hash}, (acc, s) -> unhex(sha2(CAST(lower(hex(concat(s.left, acc, s.right))) AS BINARY), 256)))"
_SIBLINGS = "aggregate({path}, CAST('' AS BINARY), (acc, s) -> concat(acc, s.left, s.right))"
_FOLDED = f"transform(c.leaves, x -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'folded', {_FOLD.format(path='n.path', hash='x.folded')}))"
_CLIMB = f"""
    WITH RECURSIVE climb AS (
        SELECT tree, n, chunk, rung, done, leaves, CAST('' AS BINARY) AS shared, CAST(NULL AS BINARY) AS subroot FROM {{chunks}}
        UNION ALL
        SELECT c.tree, c.n, c.chunk, n.up_rung, n.last, {_FOLDED}, concat(c.shared, {_SIBLINGS.format(path="n.path")}), coalesce(c.subroot, n.subroot)
        FROM climb c JOIN {{nodes}} n ON c.tree = n.tree AND c.chunk = n.chunk AND c.rung = n.rung
        WHERE NOT c.done
    )
    SELECT n, leaves, shared, subroot FROM climb WHERE done"""


@contextlib.contextmanager
def _all_rows(spark: SparkSession):
    """Recursive queries stop at a million rows unless told otherwise; the former setting comes back."""
    name = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def verify(manifest: Manifest, spark: SparkSession) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf, all hashes in hex.

    proof_sha256 hashes the leaf's siblings on the way up, left to right and level by level; folded_root is what the
    presented hash and these siblings lead to; verified: whether that is the root. A manifest without rows gives none.
    """
    schema = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if manifest.root is None:
        return spark.createDataFrame([], "doc_id long, " + schema)
    root = F.lit(manifest.root)
    low = _with_paths(_with_levels(manifest.chunks, F.transform("leaves", lambda x: x["leaf"])), "leaves")
    fold = _FOLD.format(path="x.path", hash="x.presented")
    start = low.select("tree", "n", "chunk", "rung", "done", F.expr(f"transform(leaves, x -> named_struct('doc_id', x.doc_id, 'leaf', x.leaf, 'folded', {fold}))").alias("leaves"))
    if manifest.nodes is None:  # one stride at most: no row above the leaves' own
        top = start.select("n", "leaves", F.lit(b"").alias("shared"), F.lit(None).cast("binary").alias("subroot"))
    else:
        with _all_rows(spark):
            top = stored(spark.sql(_CLIMB, chunks=start, nodes=manifest.nodes), "climbed")
    own = _with_paths(_with_levels(top, F.transform("leaves", lambda x: x["leaf"])), "leaves").select("shared", "subroot", F.explode("leaves").alias("x"))
    proof = F.concat(F.expr(_SIBLINGS.format(path="x.path")), F.col("shared"))
    folded = hex_text(F.col("x.folded"))
    return own.select(
        "x.doc_id", hex_text(F.col("x.leaf")).alias("leaf"), F.coalesce(hex_text(F.col("subroot")), root).alias("subroot"), root.alias("root"),
        F.sha2(hex_text(proof).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"), (folded == root).alias("verified"),
    )
