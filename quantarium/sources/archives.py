"""Yearly filing archives: members of zip files or of their unpacked folders, each read by its own header.

Years differ in their columns, and early years lack some members. Rows of all years are joined by column name: a year
without a column has nulls there, and a year without the member has no rows.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CSV = {"sep": ";", "header": True, "quote": '"', "escape": '"', "encoding": "ISO-8859-1"}
_CELLS = "year int, member string, line long, cells map<string,string>"
#: Rows of a member that are handed on at once.
_ROWS = 20_000


def filing_member(spark: SparkSession, root: str, member: str, years: list[int], schema: str | None = None) -> DataFrame:
    """One member's rows of unpacked archives laid out as root/year=YYYY/stmt=NAME/*.csv: the columns of all files by name
    (text), then year, stmt and file.

    Files are listed by Spark with year and member as partition filters, so that others are never opened. Each file's
    header is read (one row), files of one header are one scan, and the scans are joined by name. With ``schema`` the
    columns are these, and a header that has another is an error.
    """
    listed = spark.read.format("binaryFile").option("basePath", root).load(root)
    if "stmt" not in listed.columns or "year" not in listed.columns:
        files = []
    else:
        files = listed.where((F.col("stmt") == member) & F.col("year").isin(*years)).select("path").orderBy("path").collect()
    by_header: dict[tuple[str, ...], list[str]] = {}
    for r in files:
        head = spark.read.csv(r.path, **_CSV).columns
        by_header.setdefault(tuple(head), []).append(r.path)
    wanted = spark.createDataFrame([], schema).columns if schema else None
    scans = []
    for head, paths in by_header.items():
        if wanted is not None and (unknown := [c for c in head if c not in wanted]):
            raise ValueError(f"columns {unknown} are not in the schema")
        text = ", ".join(f"`{c}` string" for c in head)
        rows = spark.read.schema(f"{text}, year int, stmt string").option("basePath", root).csv(paths, **_CSV)
        scans.append(rows.withColumn("file", F.col("_metadata.file_name")))
    own = "year int, stmt string, file string"
    if schema:
        empty = spark.createDataFrame([], f"{schema}, {own}")
        typed = [s.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in empty.schema if f.name in s.columns]) for s in scans]
        return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), typed, empty)
    if not scans:
        return spark.createDataFrame([], own)
    found = reduce(partial(DataFrame.unionByName, allowMissingColumns=True), scans)
    return found.select(*[f"`{c}`" for c in found.columns if c not in ("year", "stmt", "file")], "year", "stmt", "file")


def issuer_index(spark: SparkSession, root: str, years: list[int]) -> DataFrame:
    """The regulator's document index of several years."""
    return filing_member(spark, root, "index", years)


def zip_archives(spark: SparkSession, root: str, kind: str, years: list[int]) -> DataFrame:
    """(path, content) of the archives ``kind``_YYYY.zip of these years; others are not read, missing ones are no error."""
    names = f"{kind}_{{{','.join(map(str, years))}}}.zip"
    return spark.read.format("binaryFile").option("pathGlobFilter", names).option("recursiveFileLookup", True).load(root).select("path", "content")


def _members(content: bytes, wanted: re.Pattern):
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for name in sorted(archive.namelist()):
            if wanted.search(name):
                with archive.open(name) as raw:
                    yield name, csv.reader(io.TextIOWrapper(raw, encoding="latin-1", newline=""), delimiter=";", quotechar='"', doublequote=True)


def _cell_batches(batches, member, heads_only):
    wanted = re.compile(member, re.I)

    def table(year, name, first, rows, head):
        offsets, keys, values = [0], [], []
        for r in rows:
            n = min(len(r), len(head))
            keys += head[:n]
            values += r[:n]
            offsets.append(len(keys))
        cells = pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
        n = len(rows)
        cols = [pa.array([year] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), cells]
        return pa.RecordBatch.from_arrays(cols, ["year", "member", "line", "cells"])

    for b in batches:
        for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
            year = int(re.search(r"(\d{4})\.zip$", path, re.I).group(1))
            for name, lines in _members(content, wanted):
                head = [h.strip().removeprefix("﻿").removeprefix("ï»¿") for h in next(lines, [])]
                if heads_only:
                    yield table(year, name, 0, [head], head)
                    continue
                rows, first = [], 1
                for r in lines:
                    if r:
                        rows.append(r)
                    if len(rows) == _ROWS:
                        yield table(year, name, first, rows, head)
                        first, rows = first + len(rows), []
                if rows:
                    yield table(year, name, first, rows, head)


def zip_member(archives: DataFrame, member: str, columns: list[str] | None = None) -> DataFrame:
    """(year, member, line, columns..) of the members whose name matches, of zip files (path, content): one task unpacks a
    file, in memory and only these members, and reads them line by line. columns: these, by name; else those of all
    headers, for which archives are read once more. A cell that a row or its year lacks is null."""
    if columns is None:
        heads = archives.mapInArrow(partial(_cell_batches, member=member, heads_only=True), _CELLS)
        first = heads.select("year", F.posexplode(F.map_keys("cells")).alias("place", "name")).groupBy("name").agg(F.min(F.struct("year", "place")).alias("first"))
        columns = [r.name for r in first.orderBy("first", "name").collect()]
    rows = archives.mapInArrow(partial(_cell_batches, member=member, heads_only=False), _CELLS)
    return rows.select("year", "member", "line", *[F.col("cells")[c].alias(c) for c in columns])
