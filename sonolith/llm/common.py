"""Expressions and helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Rows a broadcast side may have; a side beyond it is joined by a shuffle.
BROADCAST_ROWS = 100_000
BATCH_BYTES = 4 << 20


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; null gives an empty string."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def split_words(text: Column, separators: str) -> Column:
    """The non-empty pieces between runs of ``separators``, a regex character class."""
    return F.array_remove(F.split(text, separators + "+", -1), "")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, so that later jobs neither recompute it nor depend on executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def batches_by_bytes(spark: SparkSession) -> None:
    """Rows go to Python in batches of at most BATCH_BYTES from now on, so that long texts don't make large ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, those with arrays counted as their ``weight`` of elements; it should be cheap to read (cut)."""
    if weight is None:
        return F.broadcast(df) if df.limit(most + 1).count() <= most else df
    return F.broadcast(df) if (df.agg(F.sum(weight + F.lit(1))).first()[0] or 0) <= most else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_rows(df: DataFrame) -> DataFrame:
    """``df`` as the one column r, so that names made here can't clash with its own; r.* undoes it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("r"))
