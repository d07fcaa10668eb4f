"""What the operators of this subpackage share: a folder that all executors see, written tables and graph components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
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


def materialise(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write df as Parquet in the shared folder, divided by some columns if these are named, and read it again: later stages
    survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/linkweave/{label}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialise() wrote, once nothing will read it again."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stands for a null doc_id where rows are joined.
NO_ID = -(1 << 63)


def ident(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> DataFrame:
    """(row, id, digest): all columns of docs in one struct, so none of their names meets those of an operator; id is doc_id
    with NO_ID for null, digest the MD5 of the text, null counting as empty. row.* gives the columns back."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(quoted(c).alias(c) for c in docs.columns))
    return docs.select(row.alias("row"), ident(F.col("doc_id")).alias("id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"))


def tidied(batches):
    """The batches of a Python task; behind the last one the worker, which Spark uses again, gives its free memory back."""
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


#: Rows, and bytes as written, of a table that may be sent to every executor; above, the join shuffles.
SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files of a table that materialise() wrote; 0 for others."""
    path = getattr(df, "_written_at", None)
    if not path:
        return 0
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(at).getLength()


def sent(small: DataFrame, **renamed: str) -> DataFrame:
    """small, columns renamed, with the hint to broadcast it if its rows and its bytes prove it small enough."""
    fits = written_bytes(small) <= SMALL_BYTES and small.count() <= SMALL_ROWS
    small = small.withColumnsRenamed(renamed) if renamed else small
    return F.broadcast(small) if fits else small


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where small is a written table or narrow columns of one: broadcast only if it proves small enough."""
    return big.join(sent(small), keys, how)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (src long, dst long) -> (node, root), root the least node that can be reached; nodes that are their own root are left out.

    Alternating large-star and small-star rounds. Minima come from map-side combined aggregates, so no neighbourhood is
    ever gathered in a task; each round is a written table, and only a count and a checksum reach the driver.
    """
    a, b = F.col("src"), F.col("dst")
    now = materialise(
        edges.where(a != b).select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst")).distinct(), "edges"
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        seen = mark
        both = now.select(a.alias("u"), b.alias("v")).union(now.select(b.alias("u"), a.alias("v")))
        # Minima are written before they are joined, so that a node of very many edges can be split there.
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = small_join(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst")).distinct()
        large = materialise(large, "large")
        lesser = materialise(large.groupBy("src").agg(F.min("dst").alias("m")), "least")
        small = small_join(large, lesser, ["src"], "inner")
        small = small.select("src", F.col("m").alias("dst")).union(
            small.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        )
        before, now = now, materialise(small.distinct(), "edges")
        for used in (before, least, large, lesser):
            discard(used)
