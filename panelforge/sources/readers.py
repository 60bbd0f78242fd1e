"""Readers by suffix and by locale dialect, and point-event clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions.text import normalize_columns


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    decimal: str = "."
    thousands: str = ""
    encoding: str = "UTF-8"
    header: bool = True
    quote: str = '"'
    #: Line breaks inside quotes; files are then not split, so switch it on only where they occur.
    multiline: bool = False


# ISO-8859-9 equals ISO-8859-1 but for these six letters. Spark reads the latter natively.
LATIN5 = ("ISO-8859-9", "WINDOWS-1254", "CP1254")
LATIN1_LETTERS, LATIN5_LETTERS = "ÐÝÞðýþ", "ĞİŞğış"

TURKISH = Dialect(delimiter=";", decimal=",", thousands=".", encoding="ISO-8859-9")


def dialect_number(text: str | Column, dialect: Dialect) -> Column:
    """Number under the dialect's separators, NULL where the text is none."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    if dialect.thousands:
        t = F.replace(t, F.lit(dialect.thousands), F.lit(""))
    if dialect.decimal != ".":
        t = F.replace(t, F.lit(dialect.decimal), F.lit("."))
    return F.nullif(t, F.lit("")).try_cast("double")


def read_table(
    spark: SparkSession,
    path: str,
    dialect: Dialect = Dialect(),
    numeric: Sequence[str] = (),
    normalize_names: bool = True,
) -> DataFrame:
    """Delimited text as strings, one pass, no inference; the named columns become numbers."""
    latin5 = dialect.encoding.upper() in LATIN5
    raw = (
        spark.read.option("sep", dialect.delimiter)
        .option("encoding", "ISO-8859-1" if latin5 else dialect.encoding)
        .option("quote", dialect.quote)
        .option("escape", dialect.quote)  # a quote inside quotes is doubled
        .option("multiLine", str(dialect.multiline).lower())
        .option("header", str(dialect.header).lower())
        .csv(path)
    )
    if latin5:
        letters = str.maketrans(LATIN1_LETTERS, LATIN5_LETTERS)
        raw = raw.select(
            *[F.translate(F.col(f"`{c}`"), LATIN1_LETTERS, LATIN5_LETTERS).alias(c.translate(letters)) for c in raw.columns]
        )
    df = normalize_columns(raw) if normalize_names else raw
    return df.withColumns({c: dialect_number(c, dialect) for c in numeric}) if numeric else df


def read_any(spark: SparkSession, path: str, dialect: Dialect | None = None, normalize_names: bool = True) -> DataFrame:
    """Parquet, ORC, JSON or delimited text by suffix."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix in ("parquet", "orc", "json"):
        df = spark.read.format(suffix).load(path)
        return normalize_columns(df) if normalize_names else df
    if suffix in ("csv", "tsv", "txt", "dat"):
        given = dialect or Dialect(delimiter="\t" if suffix == "tsv" else ",")
        return read_table(spark, path, given, normalize_names=normalize_names)
    raise ValueError(f"no reader for {path}")


def write_cache(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_cache(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The cache with only the named columns read from the files."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def clean_point_events(
    df: DataFrame,
    sensor: str,
    box: tuple[float, float, float, float],
    rename: Mapping[str, str],
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Rows inside (lat_min, lat_max, lon_min, lon_max) with renamed columns and a sensor label."""
    lat_min, lat_max, lon_min, lon_max = box
    inside = df.filter(F.col(lat).between(lat_min, lat_max) & F.col(lon).between(lon_min, lon_max))
    label = "MODIS" if sensor == "modis" else "VIIRS-SNPP"
    return inside.select(
        *[F.col(a).alias(b) for a, b in rename.items()],
        F.col(lat).cast("double").alias("lat"),
        F.col(lon).cast("double").alias("lon"),
        F.lit(label).alias("device"),
    )


_POINT = r"(?i)^\s*POINT\(\s*(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)\s*\)\s*$"


def wkt_point(text: str | Column) -> tuple[Column, Column]:
    """(lat, lon) of `POINT(lon lat)`; NULL for anything else."""
    t = F.col(text) if isinstance(text, str) else text
    return (
        F.nullif(F.regexp_extract(t, _POINT, 2), F.lit("")).cast("double"),
        F.nullif(F.regexp_extract(t, _POINT, 1), F.lit("")).cast("double"),
    )
