"""Computing a frame once when a plan needs it twice.

Catalyst prunes columns per branch, so two branches over one aggregate get two
different exchanges and the fact table is read twice. Frames that feed both a
result and its own benchmark are therefore kept as they are first computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



#: Frames kept by compute_once since the last release.
KEPT: list[DataFrame] = []


def compute_once(small: DataFrame) -> DataFrame:
    """Mark an aggregated frame to be kept when an action first computes it.

    Nothing runs here. Later uses read one row per group from the executors, and parts
    lost with an executor are computed again from the tables. ``release`` drops what is kept.
    """
    kept = small.persist(StorageLevel.MEMORY_AND_DISK)
    KEPT.append(kept)
    return kept


def release() -> None:
    """Drop all frames kept so far; a plan that still uses one computes it again."""
    while KEPT:
        KEPT.pop().unpersist()


def one_row(frame: DataFrame) -> Column:
    """The single row of a global aggregate as a struct-valued scalar subquery."""
    return frame.select(F.struct(*frame.columns).alias("row")).scalar()


@contextmanager
def shared(frame: DataFrame) -> Iterator[DataFrame]:
    """Keep a dataset cached while several queries read it, then release it."""
    frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frame
    finally:
        frame.unpersist()
