"""Helpers shared by the operators: scratch tables, whole-text batches, reproducible splits."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 4 << 20
_open_scratch: list[list[str]] = []  # tables stored within each open ``scratch``
BATCH_ROWS = 1_000  # rows that Spark sends to Python at once: whole texts vary from nothing to megabytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a local master may go without one (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "/tmp/pagelake-shared"
    return folder.rstrip("/")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lost executor costs a re-read, not a recomputation.

    Within ``scratch`` the table is removed at its end unless it is to ``keep``. Spark drops the shuffle files of
    finished work when the driver collects its garbage, so that is asked for here.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if _open_scratch and not keep:
        _open_scratch[-1].append(path)
    df.write.parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was stored inside; what the work gives must have been stored by then, to ``keep``."""
    made: list[str] = []
    _open_scratch.append(made)
    try:
        yield
    finally:
        _open_scratch.remove(made)
        for name in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_fields(docs: DataFrame, keep: Sequence[str], more: str) -> StructType:
    """Schema of the kept columns followed by further fields."""
    return StructType([*docs.select(*keep).schema.fields, *StructType.fromDDL(more).fields])


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        start, size = 0, 0
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def one_thread() -> None:
    """Keep numpy's matrix products to the one core of the task: threads that wait for each other waste the cores of others."""
    libraries = Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*")
    for path in libraries:
        with contextlib.suppress(OSError, AttributeError):  # another linear algebra library
            ctypes.CDLL(str(path)).scipy_openblas_set_num_threads64_(1)


def give_back_memory() -> None:
    """Return freed memory to the system: Spark keeps its Python workers for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType,
              column: str = "text", limit: int = BATCH_BYTES) -> DataFrame:
    """``mapInArrow`` over batches of bounded size."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def run(batches):
        yield from fn(pieces(batches, column, limit))
        give_back_memory()

    return df.mapInArrow(run, schema)
