"""Pipeline over `documents`: language, near copies, benchmark passages, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is written
as Parquet and read back as the next one's input. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.core.scale import written
from panelforge.llm.decontaminate import decontaminate
from panelforge.llm.jaccard_join import one_of_each
from panelforge.llm.kd_sharding import kd_shards
from panelforge.llm.language_id import accepted
from panelforge.llm.mixing import mixed_rows


#: Rows of text in one Arrow batch. At Spark's 10,000, a batch of web texts is tens of megabytes, held by the JVM and by the
#: Python worker of every running task.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    """For this session from here on, as a stage's rows are computed when they are written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the declared language is `lang`, the host is `source`."""
    _small_batches(spark)
    return accepted(docs, declared=F.col("lang"), host=F.col("source"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    _small_batches(spark)
    return one_of_each(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    _small_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix."""
    return kd_shards(docs, shards=16)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL has no training of language models and no order sampling by the hash used here.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
