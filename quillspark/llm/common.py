"""Shared plumbing: table access, lineage cuts on shared storage, Arrow row maps."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quillspark.llm as _package

# Python workers receive this subpackage's functions by value, so executors need
# no copy of the repository on their import path.
cloudpickle.register_pickle_by_value(_package)

#: Rows taken out of an Arrow batch at a time, which bounds the Python objects alive.
SLICE_ROWS = 256
#: Rows in an Arrow batch where the session leaves the default; whole texts make batches of the default's rows large.
BATCH_ROWS, DEFAULT_BATCH_ROWS = "1000", "10000"

WHITESPACE = r"[\x20\x09-\x0D]"
NON_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local session without one (tests) gets a folder of this machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    context.setCheckpointDir(local)
    return local


#: Folders written and not yet removed, with their sessions.
_written: dict[str, SparkSession] = {}


def _remove(path: str) -> None:
    spark = _written.pop(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_written() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # that session has ended; the cluster's retention clears its folder
            continue


atexit.register(_remove_written)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write df once as Parquet in the shared checkpoint folder and read it back.

    Unlike cache() it survives the loss of any executor, unlike checkpoint() it computes
    df once and is columnar, and its size is known to the optimiser.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


#: Rows of a hot key that one task may take.
TASK_ROWS = 1_000_000


def aggregated(df: DataFrame, tag: str, rows: int) -> DataFrame:
    """df, an aggregate that at most so many rows of any one key join back to.

    Written out if these are more than a task should take: the join then has plain exchanges on both sides, which adaptive
    execution can split where a key is hot; it can't split a join with an aggregate of the same query.
    """
    return materialise(df, tag) if rows > TASK_ROWS else df


def release(*tables: DataFrame) -> None:
    """Remove those that materialise wrote, as nothing reads them any more; the rest go when the driver ends."""
    for made in tables:
        if "_written_at" in vars(made):
            _remove(made._written_at)


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _gnu(name: str, *values: int) -> None:
    """Call a function that only the GNU library has."""
    import ctypes

    found = getattr(ctypes.CDLL(None), name, None)
    if found is not None:
        found(*values)


#: Fixed values of malloc.h: the numbers of two settings.
M_MMAP_THRESHOLD, M_ARENA_MAX = -3, -8


def share_arena() -> None:
    """Let a worker's threads share one heap, and large blocks go back to the system as soon as they are freed."""
    _gnu("mallopt", M_ARENA_MAX, 1)
    _gnu("mallopt", M_MMAP_THRESHOLD, 1 << 20)


def give_back() -> None:
    """Return a finished task's memory to the system, as Python workers live on between tasks."""
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    _gnu("malloc_trim", 0)


def map_rows(
    df: DataFrame, schema: str, start: Callable[[], Callable[[Iterable[tuple]], Iterator[tuple]]]
) -> DataFrame:
    """mapInArrow over tuples. start() runs once in each task and returns a function from rows to rows.

    Lowers the session's Arrow batch size from its default, so that buffers of whole texts stay small on both sides.
    """
    small_batches(df.sparkSession)
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema).fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share_arena()
        step = start()
        batch = rows = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                rows = list(step(zip(*(column.slice(at, SLICE_ROWS).to_pylist() for column in batch.columns))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=fields)
            _gnu("malloc_trim", 0)
        del step, batch, rows
        give_back()

    return df.mapInArrow(_typed(run, schema), schema)


def _typed(run, schema: str):
    """Cast each produced batch to the declared schema, so that columns of nulls keep their type."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def typed(batches):
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(
                [column.cast(field.type) for column, field in zip(batch.columns, target)], schema=target
            )

    return typed
