"""Tables kept as versions of their partitions, so that a merge reads and writes only the partitions that a batch touches.

    <path>/data/_version=7/day=2024-01-05/...       rows of the partitions that merge 7 touched
    <path>/manifest/merge=000000000007/             one row: schema, and which version of every partition holds now

A merge finds the touched partition values, a list as long as the batch has days. They become literal conditions on the
partition columns, so the scan prunes everything else before it opens a file. The merged partitions are written as a new
version, and the manifest that names them switches readers over: they see all of a merge or nothing. One writer at a time.
A merge that fails leaves files no manifest names; its repetition overwrites them. A merge that is repeated after its
manifest was written (same `mark`) is skipped.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelforge.sources.publish import upsert

VERSION = "_version"
_MANIFEST = "merge long, mark string, partition string, schema string, live array<struct<value:string,version:long>>"


@dataclass(frozen=True)
class Manifest:
    merge: int
    mark: str
    partition: str
    schema: StructType
    live: dict[str | None, int]


def _file_system(spark: SparkSession, path: str) -> tuple[JavaObject, Callable[[str], JavaObject]]:
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def current_manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of the last merge that was completed."""
    files, at = _file_system(spark, path)
    folder = at(f"{path}/manifest")
    if not files.exists(folder):
        return None
    names = sorted(s.getPath().getName() for s in files.listStatus(folder))
    whole = [n for n in names if files.exists(at(f"{path}/manifest/{n}/_SUCCESS"))]
    if not whole:
        return None
    r = spark.read.schema(_MANIFEST).json(f"{path}/manifest/{whole[-1]}").first()
    return Manifest(r["merge"], r["mark"], r["partition"], StructType.fromJson(json.loads(r["schema"])), {x["value"]: x["version"] for x in r["live"]})


def _among(column: StructField, values: list[str | None]) -> Column:
    some = [F.lit(v).cast(column.dataType) for v in values if v is not None]
    tests = [F.col(column.name).isin(some)] if some else []
    tests += [F.col(column.name).isNull()] if None in values else []
    return reduce(lambda a, b: a | b, tests)


def read_partitions(spark: SparkSession, path: str, manifest: Manifest, values: list[str | None] | None = None) -> DataFrame:
    """Rows of the given partitions (all of them without `values`), each from the version that holds."""
    by_version, wanted = defaultdict(list), None if values is None else set(values)
    for value, version in manifest.live.items():
        if wanted is None or value in wanted:
            by_version[version].append(value)
    if not by_version:
        return spark.createDataFrame([], manifest.schema)
    roots = [f"{path}/data/{VERSION}={v}" for v in sorted(by_version)]
    schema = StructType([*manifest.schema.fields, StructField(VERSION, LongType())])
    rows = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*roots)
    holds = [(F.col(VERSION) == v) & _among(manifest.schema[manifest.partition], named) for v, named in by_version.items()]
    return rows.filter(reduce(lambda a, b: a | b, holds)).select(*manifest.schema.names)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The whole table as of its last merge."""
    manifest = current_manifest(spark, path)
    if manifest is None:
        raise ValueError(f"{path}: no merge has been completed")
    return read_partitions(spark, path, manifest)


def merge_partitions(
    batch: DataFrame, path: str, partition: str, combine: Callable[[DataFrame, DataFrame], DataFrame], mark: str = ""
) -> Manifest:
    """Replaces the partitions that `batch` touches by combine(their rows now, batch). `combine` must give rows of these
    partitions only, with the columns of the batch. The first merge creates the table."""
    spark = batch.sparkSession
    before = current_manifest(spark, path)
    if before is not None and mark and before.mark == mark:
        return before
    if before is not None and (before.partition != partition or set(before.schema.names) != set(batch.columns)):
        raise ValueError(f"{path}: kept by {before.partition} with columns {before.schema.names}")
    schema = batch.schema if before is None else before.schema
    head = before or Manifest(-1, "", partition, schema, {})
    touched = [r[0] for r in batch.select(F.col(partition).cast("string")).distinct().collect()]  # as many as the batch has days
    merged = combine(read_partitions(spark, path, head, touched), batch.select(*schema.names))
    done = Manifest(head.merge + 1, mark, partition, schema, head.live | dict.fromkeys(touched, head.merge + 1))
    rows = merged.select(*schema.names).hint("rebalance", partition)  # a large partition is split, small ones share a task
    rows.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/data/{VERSION}={done.merge}")
    live = [(str(k) if k is not None else None, v) for k, v in done.live.items()]
    row = spark.createDataFrame([(done.merge, mark, partition, schema.json(), live)], _MANIFEST)
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/merge={done.merge:012d}")
    return done


def upsert_partitions(new: DataFrame, path: str, keys: list[str], partition: str, mark: str = "") -> Manifest:
    """New rows win on equal keys; only the partitions they lie in are read and written."""
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys")
    return merge_partitions(new, path, partition, lambda old, batch: upsert(old, batch, keys), mark)


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Removes partitions of older versions and manifests that no longer hold; returns how many folders. For times when no
    reader of an earlier manifest is left."""
    manifest = current_manifest(spark, path)
    if manifest is None:
        return 0
    files, at = _file_system(spark, path)
    held = {(v, k) for k, v in manifest.live.items()}
    gone = []
    for folder in files.listStatus(at(f"{path}/data")):
        version = int(folder.getPath().getName().split("=")[1])
        for part in files.listStatus(folder.getPath()):
            name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(part.getPath().getName())
            if part.isDirectory() and "=" in name:
                value = name.split("=", 1)[1]
                if (version, None if value == "__HIVE_DEFAULT_PARTITION__" else value) not in held:
                    gone.append(part.getPath())
    kept = f"merge={manifest.merge:012d}"
    gone += [s.getPath() for s in files.listStatus(at(f"{path}/manifest")) if s.getPath().getName() < kept]
    for p in gone:
        files.delete(p, True)
    return len(gone)
