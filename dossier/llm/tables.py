"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.session import work_folder


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` below the checkpoint folder and continue from the written table.

    What follows depends on files that every executor can read, so an executor lost later costs no recomputation.
    """
    path = work_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, for use inside array functions."""
    return F.transform(F.array(value), body)[0]


def id_text() -> Column:
    """``doc_id`` as text, in which form it passes through Python functions: nulls and large ids stay exact there."""
    return F.col("doc_id").cast("string").alias("doc_id")


def id_number() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return name if name not in taken else f"{name}_{uuid.uuid4().hex[:8]}"


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
