"""What the operators share: table reading, bounded Arrow batches, the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ship

#: Rows of an Arrow batch that goes to Python, and its bytes where Spark knows that setting.
BATCH_ROWS = 1000
BATCH_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(spark: SparkSession) -> SparkSession:
    """Batches sent to Python hold few enough rows that long texts fit in a worker's memory."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, under its own names, whatever else the table has."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Give freed memory back to the system, since workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What a worker makes once and keeps for later tasks that name it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(keeps: tuple[str, ...] = ()) -> None:
    """A worker that goes on to other work drops what that does not name."""
    gone = [k for k in _kept if k not in keeps]
    for k in gone:
        del _kept[k]
    if gone:
        release()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None], schema: str | StructType, keeps: tuple[str, ...] = ()) -> DataFrame:
    """mapInArrow by a function of one batch; it gets whole rows, and may give none, one or several batches.

    keeps: of what workers keep from task to task, that which fn uses; the rest goes.
    """
    bounded(df.sparkSession)

    def run(batches):
        forget(keeps)
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
                out = None
                release()

    return df.mapInArrow(run, schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema that Spark expects for a DDL schema. Needs a session, so it is made on the driver."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only where it is unset, as in tests."""
    sc = spark.sparkContext
    set_here = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None and set_here is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='loomframe-')}"
    if set_here is None:
        sc.setCheckpointDir(named)
    return (named or set_here).rstrip("/")


@contextlib.contextmanager
def _without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Executions of plans that are made within leave no shuffle files; otherwise these stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder and read from there, so that lineage ends and a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    with _without_leftovers(df.sparkSession):
        out = df.select("*").checkpoint(eager=True)  # select: a plan of its own
    rdd = out._jdf.queryExecution().logical().rdd()
    out.held_at = rdd.getCheckpointFile().get() if rdd.getCheckpointFile().isDefined() else None
    return out


def written(df: DataFrame) -> DataFrame:
    """As stored, but as a Parquet table, which takes less room for many narrow rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with _without_leftovers(spark):
        df.write.option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes
    out = spark.read.schema(df.schema).parquet(path)
    out.held_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete the files of what stored and written gave, once nothing reads them any more."""
    for df in tables:
        if df.held_at:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.held_at)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, as a path of a mounted file system, for files that workers map into memory."""
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file:"):
        raise RuntimeError(f"{root} is not a mounted folder; name one for the files that workers map into memory")
    root = "/" + root.removeprefix("file:").lstrip("/") if root.startswith("file:") else root
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    os.makedirs(path, exist_ok=True)
    return path
