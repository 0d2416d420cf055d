"""What the operators share: tables, patterns, samples, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import delete, new_path, shared_dir, written  # noqa: F401  used through here by the operators

#: ASCII white space, as the contracts' `[\x20\x09-\x0D]`.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def share(key: Column, rate: float) -> Column:
    """Whether a row falls into a repeatable sample of about rate of all rows, by the hash of key."""
    scale = 1 << 30
    return F.pmod(F.xxhash64(key, F.lit(20011)), F.lit(scale)) < F.lit(int(min(1.0, rate) * scale))
