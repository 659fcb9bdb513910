"""Sources of labelled texts for training and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quillsift.runtime import hash_sample


def labelled_texts(spark: SparkSession, path: str, split: str | None = None, limit: int | None = None) -> DataFrame:
    """(id, text, label, language) of a labelled table; a missing language is "unknown"."""
    df = spark.read.parquet(path)
    if split is not None:
        df = df.filter(F.col("split") == split)
    language = F.when(F.trim("language") != "", F.col("language")).otherwise(F.lit("unknown")) if "language" in df.columns else F.lit("unknown")
    out = df.select(F.col("row_id").alias("id"), "text", "label", F.coalesce(language, F.lit("unknown")).alias("language"))
    return out if limit is None else out.orderBy("id").limit(limit)


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, raw): files as binary documents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("content").cast(BinaryType()).alias("raw"))


def capped(df: DataFrame, most: int, text: str = "text", seed: int = 42) -> DataFrame:
    """At most ``most`` rows, chosen by a hash of the text: a sampling operator, the same on every run."""
    return hash_sample(df, text, most, seed)


def combined(sources: list[DataFrame], text: str = "text", label: str = "label", order: str = "id") -> DataFrame:
    """(text, label, source_no): the rows of all sources, of equal texts the first one in the order of the sources.

    Copies are found by a combined aggregate over the digest of the text. Null texts are left out.
    """
    parts = [df.select(F.col(text).alias("text"), F.col(label).alias("label"), F.lit(k).alias("source_no"), F.col(order).alias("__o")) for k, df in enumerate(sources)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    first = F.min_by(F.struct("text", "label", "source_no"), F.struct("source_no", "__o"))
    return whole.filter("text is not null").groupBy(F.md5("text").alias("digest")).agg(first.alias("r")).select("r.*")
