"""Shared plumbing of the training-data operators.

Null texts count as empty; a null ``doc_id`` is a document like any other, and
sorts last. Only the columns an operator names are read, so further columns,
whatever their names, never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import shared_dir as shared_dir
from ..cluster import ship as ship
from ..cluster import written as written

#: White space of the contracts: blank, tab, newline, vertical tab, form feed, return.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id where an order is needed: after every other.
LAST = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z only. ``lower`` has a fast path for ASCII; other texts go by ``translate``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Marks a table for broadcast if it has at most max_rows rows, counted; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
