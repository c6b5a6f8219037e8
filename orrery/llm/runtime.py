"""Session services shared by the operators: shared-folder tables, sizing and Arrow batch limits."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold at most this many rows; the kernels cut them further by bytes.
ARROW_ROWS = 1000
#: Text bytes that one numpy kernel call works on (a single longer text is worked on whole).
BLOCK_BYTES = 4 << 20
#: Hash ranges of an exchange that grow as its bytes do; beyond it they grow as the square root.
RANGES = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset, a temporary one, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="orrery-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    The files go when the driver's Python ends, or by ``release`` once nothing reads them any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/orrery-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._shared_path = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a ``table`` that no later step reads."""
    _drop(df.sparkSession, df._shared_path)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p.getParent(), True)
    except Exception:  # the session may have ended first; the folder is temporary
        pass


def arrow_limits(spark: SparkSession) -> None:
    """Keep Arrow batches small: rows are whole documents, some of them very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def text_bytes(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes) of a text column, from one scan."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def groups_for(n_bytes: int, each: int = 8 << 20) -> int:
    return max(1, -(-n_bytes // each))


def ranges_for(n_bytes: int, each: int) -> int:
    """Hash ranges that groups send keys to, one row for each (group, range).

    Both grow with the input: past ``RANGES`` ranges these grow slower, so that rows hold several keys for longer, and what
    a range answers for grows as slowly (at 100 TB and 8 MB each to 220 MB of text).
    """
    n = groups_for(n_bytes, each)
    return n if n <= RANGES else int((RANGES * n) ** 0.5)


def thinned(df: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """About n of ``total`` rows (all, if not more), by a hash of their keys and their place: equal rows fall one by one."""
    if total <= n:
        return df
    h = F.xxhash64(*keys, F.monotonically_increasing_id())
    return df.where(F.pmod(h, F.lit(1 << 31)) < int((1 << 31) * (n / total)))


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The n rows (all, if fewer) with the smallest hashes of their keys, for fitting models of bounded size.

    Rows are first thinned to over twice as many, so that what tasks send to be merged does not grow with
    their number.
    """
    return thinned(df, 2 * n + 64, df.count(), *keys).orderBy(F.xxhash64(*keys), *keys).limit(n)
