"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Characters of text that one Python step handles at a time; longer documents form a step of their own.
STEP_CHARS = 1 << 20
#: Spark's setting by which a query's shuffle files go once it ends.
REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where all runs on this machine and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("A cluster needs spark.checkpoint.dir, a folder that all its machines share.")
    return "/tmp/checkpoints"


_stashed: dict[str, SparkSession] = {}


def drop(paths: Iterable[str]) -> None:
    """Deletes stashed relations that nothing reads any more."""
    for path in list(paths):
        spark = _stashed.pop(path, None)
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # noqa: BLE001 - the session may have ended; the others are tried all the same
            continue


atexit.register(lambda: drop(_stashed))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what runs inside go as it ends; else they stay until the driver collects its garbage."""
    before = spark.conf.get(REMOVES_SHUFFLES, None)
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(REMOVES_SHUFFLES) if before is None else spark.conf.set(REMOVES_SHUFFLES, before)


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df, written to the shared folder and read back, and its path."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gridlark-{label}-{uuid.uuid4().hex}"
    _stashed[path] = spark
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    return written(df, label)[0]


@contextmanager
def temporary() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is stashed inside goes at the end, but for what the given function stashes: the relations that results read."""
    before, kept = set(_stashed), set()

    def keep(df: DataFrame, label: str) -> DataFrame:
        out, path = written(df, label)
        kept.add(path)
        return out

    keep.paths = kept
    yield keep
    drop(set(_stashed) - before - kept)


def input_bytes(df: DataFrame) -> int:
    """An estimate of df's stored bytes from metadata alone.

    Catalyst knows the files' sizes of a scan but takes the worst of joins, so the plan's leaves bound
    it. Rows that came from code have no known size: then partitions count as full ones of a scan.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if known < 1 << 60:
        return known
    return max(1, df.rdd.getNumPartitions()) * int(df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes())


def buckets(df: DataFrame, bytes_per_bucket: int = 8 << 20) -> int:
    """How many hash buckets keep each one's share of df about bytes_per_bucket, however large df is."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // bytes_per_bucket))


def map_arrow(
    df: DataFrame,
    step: Callable[[dict[str, list]], dict[str, Any]],
    schema: StructType,
    size_of: str | None = None,
    step_size: int = STEP_CHARS,
) -> DataFrame:
    """df through step, a function of columns as lists, in pieces of bounded size.

    Pieces end once the lengths in column size_of add up to step_size, so one piece holds either
    about step_size characters or one longer value.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, size_of, step_size):
                out = step({f.name: piece.column(i).to_pylist() for i, f in enumerate(piece.schema)})
                yield pa.record_batch(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((out[f.name], f) for f in arrow)],
                    schema=arrow,
                )

    return df.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch, size_of: str | None, step_size: int) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    if size_of is None or not batch.num_rows:
        if batch.num_rows:
            yield batch
        return
    start = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(batch.schema.get_field_index(size_of))).to_pylist()):
        total += n or 0
        if total >= step_size:
            yield batch.slice(start, i + 1 - start)
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def ascii_words(text: str | bytes | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; bytes.split() splits at just these six characters."""
    return [] if text is None else (text if isinstance(text, bytes) else text.encode()).split()


def crc_mod(column: str, modulus: int):
    """crc32 of the value's text, mod modulus; a null key counts as remainder 0 (held out)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))
