"""What the text operators share: the shared folder, stored tables, row keys and hold-out folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as a class for Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1_000
#: Tables of at most so many bytes are dealt out anew before the work on their texts.
SMALL_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where nothing is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="ravelin-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Stored:
    """A table in the shared folder. Given rows are written to it and read again, so a lost executor costs no recomputation."""

    def __init__(self, df: DataFrame | None, label: str, spark: SparkSession | None = None):
        self.spark = spark or df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        for tables in _SCRATCH[-1:]:
            tables.append(self)
        if df is not None:
            df.write.parquet(self.path)
            self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    return Stored(df, label).df


def table_path(spark: SparkSession, label: str) -> str:
    """Where to write a table piece by piece."""
    return Stored(None, label, spark).path


_SCRATCH: list[list[Stored]] = []


@contextmanager
def scratch(keep: bool = False) -> Iterator[None]:
    """Tables that operators store inside are dropped at the end, so what is to stay must have been written by then.

    Operators return plans over their stored tables; without this those tables stay in the shared folder, as do those
    stored with keep."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for table in _SCRATCH.pop():
            if not keep:
                table.drop()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that df has not, each beginning with its stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def share_of(share: float, *keys: Column) -> Column:
    """Whether a row is in a share of all rows, by a 63-bit hash of its keys."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1) <= F.lit(min(2**63 - 1, int(share * 2**63)))


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow for rows that hold whole texts: the session's Arrow batches are held at BATCH_ROWS rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def row_keys(id_col: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of id and text. Rows that agree in both columns share them, and then every result."""
    return [F.xxhash64(id_col, text).alias("_k1"), F.xxhash64(text, F.lit("row"), id_col).alias("_k2")]


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo parts; -1 for a null id, which therefore is in no numbered fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % F.lit(parts), F.lit(-1).cast("bigint"))


def runs_by_size(sizes: Sequence[int], limit: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes sum to at most limit; what is larger alone has a slice of its own."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield slice(start, k)
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores where all of it is small: such a file is often one row group, so one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SMALL_BYTES and df.rdd.getNumPartitions() <= cores else df


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most so many bytes together; a larger text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for run in runs_by_size(sizes, most):
        yield batch.slice(run.start, run.stop - run.start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
