"""Tables that an operator writes between its jobs, and sizes that it checks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.session import new_stage_path

BATCH_BYTES = 8_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as Parquet in the folder that all executors share, and read again.

    This cuts the lineage: what is written survives the loss of executors. Its
    shuffle files go at once; else they stay beside those of the next steps
    until the driver happens to collect its garbage.
    """
    path = new_stage_path(df.sparkSession, f"llm-{name}")
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, units: int | None, per_part: int) -> int:
    """How many parts to deal `units` into: the session's shuffle partitions
    at least, and more where a part would pass `per_part`."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(units or 0) // per_part), 1)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)).cast("bigint"))).first()[0] or 0


def packed_row(df: DataFrame) -> "F.Column":
    """All columns in one struct, so that no internal name clashes with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run`, after which the worker gives what it no longer uses back to the system.

    Workers outlive their tasks; what they hold then is missing beside the heap of the next stages.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim is not None:
            trim(0)

    return task


def map_texts(d: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kind: T.StructType | str) -> DataFrame:
    """`d.mapInArrow`, in batches of about `BATCH_BYTES` unless the session sets other ones,
    since a batch is held several times: by the JVM, on its way and by the worker."""
    if _BATCH not in d.sparkSession.conf.getAll:
        d.sparkSession.conf.set(_BATCH, str(BATCH_BYTES))
    return d.mapInArrow(freeing(run), kind)
