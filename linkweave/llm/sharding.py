"""Sharding by extendible hashing: DataFrame functions only.

A document hashes to 60 bits. A shard is a prefix of those bits; only a prefix whose documents exceed the byte limit is split
on one more bit, until every shard fits. Sizes are summed once at a depth some bits beyond the even one, and all shorter
prefixes are sums of those; prefixes still too large there are counted again at more bits, alone. So the directory has a few
entries per shard and documents are read twice, whatever their number.

Edge cases: null or empty texts have 0 bytes and are placed like others; a null doc_id hashes as an empty string; a document
larger than the limit, however long, gets a shard or part of its own, the only kind above the limit; rows that share a doc_id,
repeated rows among them, hash alike and are cut into numbered parts once their prefix has all 60 bits (ties there go by the
order of the written table); an empty table gives an empty result; extra columns, of any name, are ignored by shard_of and kept
by write_shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, quoted, small_join

BITS = 60
#: Bits counted beyond those that equal shards would need, and bits added where that isn't enough.
SLACK, MORE = 4, 8


def hashed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, bytes, h, more..): h of 60 bits from the MD5 of the decimal doc_id."""
    ident = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("bytes"),
        F.conv(F.substring(ident, 1, BITS // 4), 16, 10).cast("long").alias("h"), *more,
    )


def directory(rows: DataFrame, limit: int) -> tuple[list[DataFrame], list[int]]:
    """Tables (slot, depth) for the counted depths: the shard of a slot is its first depth bits; null: look one table on."""
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    at = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK)
    floor, tables, depths = 0, [], []
    while True:
        sizes = rows.groupBy(F.shiftright("h", BITS - at).alias("slot")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        sizes = materialise(sizes, "slots")
        every = sizes.select("slot", "bytes", "n", F.explode(F.sequence(F.lit(floor), F.lit(at))).alias("depth"))
        prefix = F.expr(f"shiftright(slot, {at} - depth)")
        nodes = every.groupBy("depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        # A prefix of one document can't be split further.
        fits = nodes.where((F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS)).select("depth", "prefix")
        leaf = every.withColumn("prefix", prefix).join(fits, ["depth", "prefix"], "left_semi").groupBy("slot").agg(F.min("depth").alias("depth"))
        tables.append(materialise(sizes.select("slot").join(leaf, "slot", "left"), "directory"))
        depths.append(at)
        full = tables[-1].where("depth is null").select("slot")
        if at == BITS or full.isEmpty():
            return tables, depths
        rows = small_join(rows.withColumn("slot", F.shiftright("h", BITS - at)), full, ["slot"], "left_semi").drop("slot")
        floor, at = at + 1, min(BITS, at + MORE)


def placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows (bytes, h, ..), a written table, with depth, shard (the bits of the prefix as text) and part.

    Rows that no bit tells apart, as they share a doc_id, are numbered partition by partition of the written table: each part
    is a run within one partition, so a doc_id that very many rows share is never gathered in a task.
    """
    tables, depths = directory(rows.select("bytes", "h"), limit)
    rows = rows.withColumn("pid", F.spark_partition_id())
    out, left = [], rows
    for entry, at in zip(tables, depths, strict=True):
        found = small_join(left.withColumn("slot", F.shiftright("h", BITS - at)), entry, ["slot"], "inner").drop("slot")
        out.append(found.where("depth is not null"))
        left = found.where("depth is null").drop("depth")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr(f"lpad(conv(cast(shiftright(h, {BITS} - depth) as string), 10, 2), depth, '0')"))
    whole = found.where(F.col("depth") < BITS).withColumn("part", F.lit(0).cast("long"))
    # Above half the limit a row is a part alone, the others make runs of half the limit.
    run = "partition by h, pid order by bytes rows between unbounded preceding and current row"
    cut = F.expr(f"pid * {1 << 32} + case when bytes * 2 > {limit} then {1 << 31} + row_number() over (partition by h, pid order by bytes) else (sum(bytes) over ({run}) * 2) div {limit} end")
    alike = found.where(F.col("depth") == BITS).withColumn("part", cut.cast("long"))
    return whole.unionByName(alike).withColumns({"depth": F.col("depth").cast("int"), "shard": shard}).drop("pid", "h")


def shard_of(docs: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(doc_id, bytes, depth, shard, part): where every document goes."""
    return placed(materialise(hashed(docs), "hashed"), limit).select("doc_id", "bytes", "depth", "shard", "part")


def write_shards(docs: DataFrame, path: str, limit: int = 1 << 20) -> None:
    """Write docs under path, a folder per shard and in it one per part; every row's columns are kept. The folders' columns are
    called shard and part, with underscores before where docs has such columns."""
    mark = ""
    while {f"{mark}shard", f"{mark}part"} & set(docs.columns):
        mark += "_"
    row = F.struct(*(quoted(c).alias(c) for c in docs.columns)).alias("row")
    rows = placed(materialise(hashed(docs, row), "hashed"), limit)
    named = rows.select("row.*", F.concat(F.lit("s"), "shard").alias(f"{mark}shard"), F.col("part").alias(f"{mark}part"))
    named.repartition(f"{mark}shard", f"{mark}part").write.partitionBy(f"{mark}shard", f"{mark}part").parquet(path)
