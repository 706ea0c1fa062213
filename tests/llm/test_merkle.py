"""The Merkle manifest against hashlib, on trees of every shape, odd rows, and the registered query's SQL."""

import hashlib
import zlib

import compare
import pytest
from pyspark.sql import functions as F

from quantarium.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes):
    """(root, siblings of each node from below) of a list of nodes."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    proofs = []
    for i in range(len(hashes)):
        steps = []
        for level in levels[:-1]:
            run = i // 3 * 3
            steps.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            i //= 3
        proofs.append(steps)
    return levels[-1][0], proofs


def wanted(rows, present=lambda row: row):
    """Sorted results (doc_id, leaf, subroot, root, proof, folded, verified) by plain loops."""
    first_null = lambda v: (v is not None, v if v is not None else "")
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda r: (first_null(r[0])[0], r[0] if r[0] is not None else 0, leaf_of(r)))
        trees.append((own, *climb([leaf_of(r) for r in own])))
    root, tops = climb([t[1] for t in trees])
    out = []
    for (own, subroot, proofs), top in zip(trees, tops):
        for r, steps in zip(own, proofs):
            folded = leaf_of(present(r))
            for left, right in [*steps, *top]:
                folded = sha(left + folded + right)
            out.append((r[0], leaf_of(r), subroot, root, sha("".join(a + b for a, b in [*steps, *top])), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows, presented=None):
    docs = spark.createDataFrame(rows, SCHEMA)
    found = merkle.verify(merkle.build_manifest(docs, presented=presented), spark)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def row(i, source="a"):
    return (i, source, "en", i, f"text {i}\nend")


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [81], [82], [243, 1], [1, 2, 85], [7000], [1] * 83, [90] + [2] * 85])
def test_shapes(spark, sizes):
    rows = [row(1000 * k + i, f"s{k:03d}") for k, n in enumerate(sizes) for i in range(n)]
    assert got(spark, rows) == wanted(rows)


def test_odd_rows_and_tampering(spark):
    """Nulls in any column, an empty text, repeated rows, equal ids, accents, a text of a megabyte."""
    rows = [(None, None, None, None, None), (None, "a", "en", 1, ""), (1, None, "en", 1, "x\ny"), (1, "a", None, None, "é\n€\n"), (1, "a", None, None, "é\n€\n"), (1, "a", "de", 2, "\n"), (2, "Z", "en", 5, None), (3, "é", "en", 1, "a" * 1_000_000 + "\n")]
    rows += [row(i) for i in range(100)] + [row(7)] * 90
    shown = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    present = lambda r: (*r[:4], r[4].replace("\n", "") if r[4] is not None and r[0] is not None and r[0] % 2 == 1 else r[4])
    found = got(spark, rows, {"text": shown})
    assert found == wanted(rows, present)
    assert {r[-1] for r in found} == {True, False}


def test_empty_and_other_columns(spark):
    assert got(spark, []) == []
    docs = spark.createDataFrame([row(i) for i in range(200)], SCHEMA)
    more = docs.withColumn("tree", F.lit(3)).withColumn("leaf", F.lit("x")).withColumn("_at", F.lit(1)).withColumn("group", F.lit("g")).withColumn("path", F.lit(None).cast("string"))
    result = lambda d: sorted(tuple(r) for r in merkle.verify(merkle.build_manifest(d), spark).collect())
    assert result(docs) == result(more)


def test_every_change_is_seen(spark):
    """Each field counts, and so does the border between two of them."""
    rows = [row(i) for i in range(30)]
    for name, other in (("doc_id", F.col("doc_id") + 1), ("lang", F.lit("d")), ("n_chars", F.lit(None)), ("text", F.concat("text", F.lit(" "))), ("source", F.lit(""))):
        assert not any(r[-1] for r in got(spark, rows, {name: other})), name
    assert leaf_of((1, "a", "bc", 1, "x")) != leaf_of((1, "ab", "c", 1, "x"))


def test_registered_query(spark, small):
    assert compare.differences(spark, compare.connect(small), queries.op11_merkle, queries.oracle_sql()["op11_merkle"], small) == ""
    present = lambda r: (*r[:4], r[4].replace("\n", "")) if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in queries.op11_merkle(spark, small).collect()), key=repr) == wanted(rows, present)
