"""Helpers that several operators share: work tables, Arrow row loops, bounded joins."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A side with at most so many rows of a few numbers each may be broadcast (about 16 bytes a row: 32 MB).
BROADCAST_ROWS = 2_000_000
#: Rows in an Arrow batch at most.
BATCH_ROWS = 2_000
#: Files that `keyed` numbers at most: their names are broadcast (some 150 bytes each).
FILES = 50_000


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch at most, but for a single row that is larger.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where it is unset, a local session gets a temporary one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: dict[str, list[str]] = {}  # work paths since the last begin_stage, by application


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def work_path(spark: SparkSession, name: str) -> str:
    path = _fresh(spark, name)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def lasting_path(spark: SparkSession, name: str) -> str:
    """A path that begin_stage leaves alone."""
    return _fresh(spark, name)


def delete(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._work_path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of actions that are over, as it does once the driver's garbage is collected: a driver with room to spare seldom does that by itself."""
    spark.sparkContext._jvm.java.lang.System.gc()


def begin_stage(spark: SparkSession) -> None:
    """Delete the work tables of the stage before, whose rows are written by now, and collect garbage.

    The driver's lets Spark drop its shuffle files; that of executors gives back the heap the stage before has grown, which
    Python workers need. A task a core and a spare reach each of them.
    """
    delete(spark, *_made.pop(spark.sparkContext.applicationId, []))
    drop_shuffles(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.expr("java_method('java.lang.System', 'gc')")).collect()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of `rows` and BATCH_BYTES for actions inside: whole texts come in batches, and 10,000 would hold much of a split at once, on both sides."""
    before, size = spark.conf.get(ARROW_ROWS), spark.conf.get(ARROW_BYTES)
    spark.conf.set(ARROW_ROWS, min(rows, int(before)) if int(before) > 0 else rows)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)
        spark.conf.set(ARROW_BYTES, size)


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and no executor is needed for it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def keyed(df: DataFrame, name: str, key: str = "row_key") -> DataFrame:
    """df with a key of its own for each row: its doc_id may be null or repeat. `key` is a name that df doesn't use.

    Rows of Parquet files go by file and place within it, without a copy; other tables, and those of more than FILES
    files, are written once with numbers.
    """
    if df._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        file, nth, part = (unused(df, n) for n in ("row_file", "row_nth", "row_part"))
        with contextlib.suppress(AnalysisException):  # no Parquet, no places
            placed = df.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(nth))
            files = sorted(r[0] for r in placed.select(file).distinct().limit(FILES + 1).collect())
            if len(files) <= FILES:
                numbers = df.sparkSession.createDataFrame(list(enumerate(files)), f"{part} long, {file} string")
                own = F.col(part) * (1 << 40) + F.col(nth)
                return placed.join(F.broadcast(numbers), file).select(*[F.col(f"`{c}`") for c in df.columns], own.alias(key))  # at most FILES rows
    return work_table(df.withColumn(key, F.monotonically_increasing_id()), name)


def keep_rows(df: DataFrame, column: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows for which `keep`, given a batch of one column, says true: one pass, whatever the other columns are."""
    names = [f"_{i}" for i in range(len(df.columns))]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in batches:
                for i in range(0, b.num_rows, BATCH_ROWS):
                    part = b.slice(i, BATCH_ROWS)
                    yield part.filter(pa.array(keep(part.column(at)), pa.bool_()))
        finally:
            release()

    schema = StructType([StructField(n, f.dataType) for n, f in zip(names, df.schema)])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns)


def release() -> None:
    """Give memory that a task has freed back to the system: workers live on, and the next tasks may be of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict | pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow for functions that yield dicts of columns; Spark's schema string names and types them."""
    spark = df.sparkSession
    arrow = _arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        try:
            for out in rows(small):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
        finally:
            release()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join that broadcasts `small` only when it is counted to be within BROADCAST_ROWS; beyond that both sides shuffle."""
    n = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return big.join(F.broadcast(small) if n <= BROADCAST_ROWS else small, on, how)


def held_out(doc_id) -> Column:
    """True for rows kept out of all fitting: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label): rows that may be learned from, at most about `bound` of them, chosen by a hash of the id.

    Rows with a null label or id are left out; an id labelled more than once counts by its largest label.
    """
    rows = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .filter("doc_id is not null and label in (0, 1)")
        .filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    n = rows.count()
    if n > bound:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * bound / n))
    return rows
