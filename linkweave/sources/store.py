"""A graph kept in a folder, which upserts merge into: nodes by (kind, id), edges by (rel, src, dst).

Keys fall into buckets by hash. An upsert reads and rewrites only the buckets that its rows touch, into a folder of its own, and
then commits by renaming a new manifest (which folder holds each bucket) into place beside the old ones. Readers take the newest
manifest, so a write that dies leaves the graph as it was, and of two writers at once the second fails to commit and may try
again. Only bucket numbers and manifests reach the driver.

Names: the last one that isn't null stays. Edges are kept only between nodes of the graph as it is after the upsert.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators import graph
from linkweave.tables import discard, written

BUCKETS = 64
SCHEMAS = {"nodes": "kind string, id string, name string", "edges": "rel string, src_kind string, src string, dst_kind string, dst string"}
KEYS = {"nodes": ("kind", "id"), "edges": ("rel", "src", "dst")}


class Conflict(RuntimeError):
    """Another writer has committed since this one read the graph."""


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed manifests, oldest first."""
    fs, at = _at(spark, f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """{version, buckets, nodes: {bucket: folder}, edges: {bucket: folder}} of a version, the newest if none is named."""
    known = versions(spark, path)
    if not known:
        return {"version": 0, "buckets": BUCKETS, "nodes": {}, "edges": {}}
    return json.loads(spark.read.text(f"{path}/manifests/{version or known[-1]:012d}.json", wholetext=True).first()[0])


def _commit(spark: SparkSession, path: str, content: dict) -> None:
    fs, at = _at(spark, f"{path}/manifests")
    fs.mkdirs(at)
    _, temporary = _at(spark, f"{path}/manifests/{uuid.uuid4().hex}.tmp")
    out = fs.create(temporary, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    _, final = _at(spark, f"{path}/manifests/{content['version']:012d}.json")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(temporary), fs.makeQualified(final), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:  # of Py4J: the target is there
        fs.delete(temporary, False)
        if fs.exists(final):
            raise Conflict(f"version {content['version']} was committed by another writer") from e
        raise


def _read(spark: SparkSession, path: str, kind: str, of: dict, buckets=None) -> DataFrame:
    held = of[kind] if buckets is None else {b: f for b, f in of[kind].items() if int(b) in buckets}
    paths = [f"{path}/{folder}/bucket={b}" for b, folder in sorted(held.items())]
    return spark.read.schema(SCHEMAS[kind]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[kind])


def nodes(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(kind, id, name) of the graph."""
    return _read(spark, path, "nodes", manifest(spark, path, version))


def edges(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(rel, src_kind, src, dst_kind, dst) of the graph."""
    return _read(spark, path, "edges", manifest(spark, path, version))


def _merged(spark: SparkSession, path: str, kind: str, new: DataFrame, now: dict, merge) -> dict:
    """Write the buckets that new touches, merged with what they hold; bucket -> folder of all buckets from now on."""
    bucket = F.pmod(F.xxhash64(*KEYS[kind]), F.lit(now["buckets"])).cast("int")
    touched = {r[0] for r in new.select(bucket).distinct().collect()}  # at most as many as there are buckets
    if not touched:
        return now[kind]
    folder = f"{kind}/{now['version'] + 1:012d}-{uuid.uuid4().hex}"
    # Keys of new are distinct, so what goes to a folder that holds nothing yet is new as it is.
    held = touched & {int(b) for b in now[kind]}
    rows = (merge(_read(spark, path, kind, now, touched), new) if held else new).withColumn("bucket", bucket)
    rows.repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    return now[kind] | {str(b): folder for b in touched}


def _named(old: DataFrame, new: DataFrame) -> DataFrame:
    return graph.upsert_nodes(old.withColumn("pos", F.lit(0)).unionByName(new.withColumn("pos", F.lit(1))))


def upsert(spark: SparkSession, path: str, new_nodes: DataFrame | None = None, new_edges: DataFrame | None = None) -> int:
    """Merge nodes (kind, id, name[, pos]) and edges (rel, src, dst) into the graph; the version that holds them."""
    now = manifest(spark, path)
    then = dict(now, version=now["version"] + 1)
    if new_nodes is not None:
        given = written(graph.upsert_nodes(new_nodes if "pos" in new_nodes.columns else new_nodes.withColumn("pos", F.lit(1))), "given")
        then["nodes"] = _merged(spark, path, "nodes", given, now, _named)
        discard(given)
    if new_edges is not None:
        given = written(graph.upsert_edges(new_edges, _read(spark, path, "nodes", then)), "given")
        then["edges"] = _merged(spark, path, "edges", given, now, lambda old, new: old.unionByName(new).distinct())
        discard(given)
    _commit(spark, path, then)
    return then["version"]


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete all but the newest versions and the folders that only those, or writes that died, used; no write may be under way."""
    known = versions(spark, path)
    kept, gone = known[-keep:], known[:-keep]
    used = {f for v in kept for kind in SCHEMAS for f in manifest(spark, path, v)[kind].values()}
    for v in gone:
        fs, at = _at(spark, f"{path}/manifests/{v:012d}.json")
        fs.delete(at, False)
    for kind in SCHEMAS:
        fs, at = _at(spark, f"{path}/{kind}")
        for s in fs.listStatus(at) if fs.exists(at) else ():
            if f"{kind}/{s.getPath().getName()}" not in used:
                fs.delete(s.getPath(), True)
