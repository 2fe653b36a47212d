"""Shared helpers of the training-data operators.

Texts travel as UTF-8 bytes inside the Arrow functions: ``bytes.split()`` splits on
exactly the ASCII white space ``\\x20 \\x09-\\x0D`` that the word contracts name.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch: texts of 100 kB would otherwise meet ten thousand at a time.
ARROW_ROWS = 1000
#: Text bytes that one step inside an Arrow function holds at a time.
SLICE_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark alone, so any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where ``spark.checkpoint.dir`` is unset and Spark runs in this process alone, as in tests, a
    temporary folder is set on the context. On a cluster it has to be named.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if not named and held.isEmpty() and not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if held.isEmpty():
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="tonewright-"))
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    with bounded_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, column: str) -> DataFrame:
    """``saved``, in as many buckets as the session has shuffle partitions, by a column of evenly
    spread values that ``df`` is dealt by already: joins on it don't shuffle this side again."""
    spark = df.sparkSession
    name = f"tonewright_{uuid.uuid4().hex}"
    with bounded_batches(spark):
        df.write.format("parquet").bucketBy(parts_for(spark), column).option("path", fresh_path(spark, label)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the plan that is bound to them
    return out


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``ARROW_ROWS`` rows at most while a table is written; then the caller's
    setting holds again. Functions cut any batch by bytes (``slices``) in either case."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def spent_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each statement go when it ends, not when the driver happens to collect
    its garbage; for statements whose result is written. Then the caller's setting holds again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def columns(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, whatever characters these hold."""
    return [F.col(f"`{n}`") for n in names]


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, whatever else the table carries."""
    return df.select(*columns(names))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with marks behind it until no taken name equals it in any case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with a null text as the empty one; other columns are dropped."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def arrow_map(
    df: DataFrame,
    fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
) -> DataFrame:
    """``mapInArrow``; ``fn`` takes its batches apart with ``slices``. Workers serve many tasks: what
    a task has freed goes back to the system at its end, or executors would hold every stage's peak."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of text; a longer text is one part."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def raw(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes; null as the empty text."""
    col = batch.column(column)
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [x or b"" for x in col.cast(kind).to_pylist()]


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending split points of a numeric column, near quantiles.

    Their number is fixed by ``parts``; only these numbers reach the driver.
    """
    if parts < 2:
        return []
    got = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in got})


def range_of(column: str, bounds: list[int]) -> Column:
    """Ordinal of the range of ``column``: how many bounds are at most its value (null: 0)."""
    if not bounds:
        return F.lit(0)

    def pick(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"IF(`{column}` < {bounds[mid]}L, {pick(lo, mid)}, {pick(mid + 1, hi)})"

    return F.when(F.col(f"`{column}`").isNull(), 0).otherwise(F.expr(pick(0, len(bounds))))


def parts_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; ``TOKENIZER_DIR`` overrides the installed one."""
    if base := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def in_order(df: DataFrame, column: str, *then: str, parts: int | None = None) -> DataFrame:
    """Rows dealt to partitions by ranges of ``column`` and sorted there, with their ``range``.

    Ranges lie near quantiles of the column, which is read alone for them. Partition k holds
    range k, so partitions follow one another in the column's order; nulls come first.
    """
    parts = parts or parts_for(df.sparkSession)
    bounds = range_bounds(df.select(column), column, parts)
    dealt = df.withColumn("range", range_of(column, bounds)).repartitionById(len(bounds) + 1, F.col("range"))
    return dealt.sortWithinPartitions("range", column, *then)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system that nothing reads any more."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def forget(df: DataFrame) -> None:
    """Delete a table that ``saved`` has written, once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, such as a manifest, whole or not at all: by a rename."""
    fs, where = _file_system(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".draft")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(draft, where)


def read_file(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    fs, where = _file_system(spark, path)
    if not fs.exists(where):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
