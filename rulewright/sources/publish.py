"""Sinks that leave either a whole, checked result or the one before it.

A release is a folder ``name`` under a root: its data as Parquet or JSON lines, and a manifest. Data are staged beside it
first; checks read what was staged; only then does the release get its manifest, which is what makes it one. Readers go by the
manifest, so a run that fails, or loses its executors or driver half way, changes nothing that they see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"
#: How many bad rows an error names; all are counted.
NAMED = 20


class Rejected(ValueError):
    """A check found rows; nothing was published."""


def digest(rows: DataFrame) -> tuple[int, str]:
    """Number of rows and a hash of them that their order does not change: the sum of the rows' 256-bit hashes in eight parts.

    Equal rows count as often as they stand. Columns are taken by name, so their order does not matter; null, "" and
    "null" differ.
    """
    named = F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    hashed = rows.select(F.sha2(named, 256).alias("h"))
    part = lambda i: F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"p{i}")
    n, *parts = hashed.agg(F.count("*"), *map(part, range(8))).first()
    return n, "".join(f"{int(p or 0) % 2**64:016x}" for p in parts)


def missing_in(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """A check: the values of column that known (one column) lacks. A null refers to nothing."""
    ids = known.select(F.col(known.columns[0]).alias(column)).distinct()
    return rows.select(column).where(F.col(column).isNotNull()).distinct().join(ids, column, "left_anti")


def repeated(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """A check: keys that are null in a part, or stand more than once."""
    incomplete = F.lit(False)
    for c in key:
        incomplete = incomplete | F.col(c).isNull()
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | incomplete)


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, release: str) -> dict | None:
    """What a release holds; null if there is no such release, or only what a failed run left."""
    fs, path = _path(spark, f"{release}/{MANIFEST}")
    if not fs.exists(path):
        return None
    return json.loads("\n".join(r.value for r in spark.read.text(f"{release}/{MANIFEST}", wholetext=True).collect()))


def publish(spark: SparkSession, root: str, name: str, tables: Mapping[str, DataFrame], checks: Mapping[str, object], json_too: Sequence[str] = ()) -> dict:
    """Writes tables as release ``name`` and returns its manifest, or raises and leaves every release as it was.

    checks: by name, a function of the staged tables (a dict of DataFrames) that returns the rows at fault; all are run, and
    Rejected names each that found any. A release is never changed: a name in use raises FileExistsError, even if
    the tables are the same. json_too: tables to write as JSON lines besides. An empty table is a table of no rows.
    """
    release = f"{root.rstrip('/')}/{name}"
    if manifest(spark, release) is not None:
        raise FileExistsError(f"{release} is published")
    run = uuid.uuid4().hex  # data of a run that failed stay in a folder that no manifest names
    staged = {}
    for table, rows in tables.items():
        rows.write.parquet(f"{release}/{run}/{table}")
        staged[table] = spark.read.schema(rows.schema).parquet(f"{release}/{run}/{table}")
    faults = []
    for check, find in checks.items():
        bad = find(staged)
        if first := bad.limit(NAMED).collect():
            faults.append(f"{check}: {bad.count()} rows, as {', '.join(str(tuple(r)) for r in first)}")
    if faults:
        raise Rejected("\n".join(faults))
    for table in json_too:
        staged[table].write.option("ignoreNullFields", "false").json(f"{release}/{run}/{table}.json")
    held = {}
    for table, rows in staged.items():
        n, sha = digest(rows)
        held[table] = {"path": f"{run}/{table}", "rows": n, "digest": sha, "schema": rows.schema.simpleString()}
    content = {"release": name, "tables": held}
    _claim(spark, release, run, content)
    return content


def _claim(spark: SparkSession, release: str, run: str, content: dict) -> None:
    """The manifest appears whole and at once; of two runs for one name the first wins and the other raises."""
    fs, draft = _path(spark, f"{release}/{run}/{MANIFEST}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(content, indent=2, sort_keys=True).encode()))
    finally:
        out.close()
    _, final = _path(spark, f"{release}/{MANIFEST}")
    if fs.exists(final) or not fs.rename(draft, final):
        raise FileExistsError(f"{release} was published by another run")


def read(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    """A table of a release, as its manifest names it; FileNotFoundError if there is no such release or table."""
    release = f"{root.rstrip('/')}/{name}"
    held = (manifest(spark, release) or {"tables": {}})["tables"].get(table)
    if held is None:
        raise FileNotFoundError(f"{release} has no {table}")
    return spark.read.parquet(f"{release}/{held['path']}")


def damaged(spark: SparkSession, root: str, name: str) -> list[str]:
    """The tables of a release whose rows are not those it was published with; files that are gone count."""
    found = manifest(spark, f"{root.rstrip('/')}/{name}")
    if found is None:
        raise FileNotFoundError(name)
    bad = []
    for table, held in found["tables"].items():
        fs, path = _path(spark, f"{root.rstrip('/')}/{name}/{held['path']}")
        if not fs.exists(path) or digest(read(spark, root, name, table)) != (held["rows"], held["digest"]):
            bad.append(table)
    return bad
