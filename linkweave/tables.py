"""Written tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests), a temporary one of this application.

    Off local mode no folder of the driver's machine will do, so there the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="linkweave-")
    return _LOCAL[app]


#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again; the shuffles that made it are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkweave/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a written table, once nothing will read it again."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


#: Rows, and bytes as written, of a table that may be sent to every executor.
SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20


def sent(small: DataFrame) -> DataFrame:
    """A written table with the hint to broadcast it if its rows and bytes prove it small enough."""
    jvm, sc = small.sparkSession._jvm, small.sparkSession.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(small._written_at)
    size = at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return F.broadcast(small) if size <= SMALL_BYTES and small.count() <= SMALL_ROWS else small


#: Rows of a task where each row is costly, as one that is parsed.
COSTLY_ROWS = 5000


def spread(rows: DataFrame, most: int = COSTLY_ROWS) -> DataFrame:
    """rows in as many files as their number asks for, where a table that is small as a file, or one row group, is read by one task.

    A written table, since conditions on what is parsed would move below a shuffle and do the work there.
    """
    parts = -(-rows.count() // most)
    return written(rows.repartition(parts), "spread") if parts > 1 else rows
