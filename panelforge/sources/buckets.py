"""Tables stored by buckets of their key, so that repeated joins and aggregates on the key move the other side only.

Rows are dealt to buckets by the hash that Spark's own exchanges use and sorted inside each: a join on the key finds one side
already where an exchange and a sort would put it. Bloom filters in the files let a scan for a few keys skip row groups.
Every write is a new version next to the last one; a one-row layout beside the table names the current version, its schema
and its buckets, so that any session can open it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panelforge.core.exprs import require_columns

_LAYOUT = "version string, schema string, keys array<string>, buckets int"


def _table_name(version: str) -> str:
    return f"stored_{hashlib.sha256(version.encode()).hexdigest()[:24]}"


def store_bucketed(
    df: DataFrame, path: str, keys: Sequence[str], buckets: int | None = None, bloom: Sequence[str] = (), distinct_keys: int = 1_000_000
) -> DataFrame:
    """Writes a version of the table by `keys` and returns it. Choose `buckets` so that one fits a task: a bucket is never
    split. `bloom` columns get Bloom filters sized for `distinct_keys` different values a file."""
    require_columns(df, [*keys, *bloom])
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    version = f"{path.rstrip('/')}/version-{uuid.uuid4().hex}"
    writer = df.repartition(buckets, *keys).write.format("parquet").option("path", version)  # one file per bucket
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct_keys))
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(_table_name(version))
    row = spark.createDataFrame([(version, df.schema.json(), list(keys), buckets)], _LAYOUT)
    row.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.layout")
    return spark.table(_table_name(version))


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a stored table, with its buckets known to the session."""
    layout = spark.read.schema(_LAYOUT).json(f"{path.rstrip('/')}.layout").first()
    if layout is None:
        raise ValueError(f"{path}: no layout")
    name = _table_name(layout["version"])
    if not spark.catalog.tableExists(name):
        schema = StructType.fromJson(json.loads(layout["schema"]))
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{k}`" for k in layout["keys"])
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{layout['version']}'"
        )
    return spark.table(name)
