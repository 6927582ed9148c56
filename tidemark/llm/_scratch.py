"""Helpers of this subpackage: column names, ASCII case, and the tables that Python workers keep."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut, scratch_path, shared_dir

__all__ = ["ascii_lower", "col", "cut", "documents", "fresh", "kept", "release", "scratch_path", "shared_dir"]

_KEPT: list = []

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` (compared without case) does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def kept(name: str, token, make):
    """What a Python worker keeps from task to task. It is the only owner of such tables and holds
    one at a time: those of one operator make way for those of the next."""
    if not _KEPT or _KEPT[0] != name or _KEPT[1] is not token:
        _KEPT.clear()
        release()
        _KEPT.extend((name, token, make()))
    return _KEPT[2]


def release() -> None:
    """Give freed memory back to the system: a worker outlives its task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(rows):
    """The items of ``rows``; memory goes back when they end."""
    try:
        yield from rows
    finally:
        release()
