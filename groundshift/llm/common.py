"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from groundshift.plans.scratch import checked_side, join_hot, materialize, scratch_dir

__all__ = ["bounded_batches", "checked_side", "give_back", "join_hot", "materialize", "scratch_dir", "small_batches", "table"]

#: Rows of an Arrow batch that become Python objects at once.
SLICE_ROWS = 512
#: Rows of an Arrow batch in the pipeline.
ARROW_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(batches):
    """The batches in slices, so that a worker holds the Python strings of few rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and the next may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of this session hold at most ARROW_ROWS rows, so that one of long texts stays small in the JVM and in the worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
