"""Readers of the interchange formats; paths go to Spark's own readers, so any store that Spark reads will do."""

from __future__ import annotations

import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.tables import written


def xml_records(spark: SparkSession, path: str, tag: str, schema=None) -> DataFrame:
    """One row per element of that name; attributes are _name, text beside attributes _VALUE."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def id_keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """{id: value} documents -> (id, value); value is the DDL of the values."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("id", "value"))


#: Bytes of an archive, as compressed, that a task reads.
SPAN = 32 << 20


def _opened(path: str):
    """A file of any store that Arrow knows, for reading at any place; path is a URI as Spark gives it."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_file(at)


def zip_members(spark: SparkSession, path: str, ending: str = "", max_records: int | None = None) -> DataFrame:
    """(path, pos, name, offset, packed, size, method, crc) of the members whose names end so, the first max_records of an archive:
    from the central directories at the archives' ends, whatever their size; of an archive one task reads that alone."""

    def listed(parts):
        for pdf in parts:
            for uri in pdf.path:
                with _opened(uri) as f, zipfile.ZipFile(f) as z:
                    found = [m for m in z.infolist() if m.filename.endswith(ending) and not m.is_dir()][:max_records]
                for lo in range(0, len(found), 10_000):
                    some = found[lo : lo + 10_000]
                    yield pd.DataFrame({
                        "path": uri, "pos": range(lo, lo + len(some)), "name": [m.filename for m in some], "offset": [m.header_offset for m in some], "packed": [m.compress_size for m in some],
                        "size": [m.file_size for m in some], "method": [m.compress_type for m in some], "crc": [m.CRC for m in some],
                    })

    archives = spark.read.format("binaryFile").load(path).select("path")
    return archives.repartition("path").mapInPandas(listed, "path string, pos long, name string, offset long, packed long, size long, method int, crc long")


def zipped_texts(spark: SparkSession, path: str, ending: str = "", max_records: int | None = None, span: int = SPAN) -> DataFrame:
    """(pos, name, text) of the files in zip archives whose names end so, the first max_records of an archive.

    Members are read by their places in the archive, spans of about span bytes to a task, so an archive may be of any size and
    is read by many tasks. Stored and deflated members; others raise, as do damaged ones.
    """

    def read(parts):
        for pdf in parts:
            for uri, some in pdf.groupby("path"):
                with _opened(uri) as f:
                    for lo in range(0, len(some), 100):
                        rows = some.iloc[lo : lo + 100]
                        yield pd.DataFrame({"pos": rows.pos, "name": rows.name, "text": [_member(f, r) for r in rows.itertuples()]})

    members = written(zip_members(spark, path, ending, max_records), "members")
    total = members.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    dealt = members.repartition(max(1, -(-total // span)), "path", F.floor(F.col("offset") / span)).sortWithinPartitions("path", "offset")
    return dealt.mapInPandas(read, "pos long, name string, text string")


def _member(f, m) -> str:
    """The text of a member, from its local header on."""
    f.seek(m.offset)
    head = f.read(30)
    if head[:4] != b"PK\x03\x04" or m.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError(f"cannot read {m.name}: not a stored or deflated member")
    f.seek(m.offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    data = f.read(m.packed)
    data = zlib.decompress(data, -15) if m.method == zipfile.ZIP_DEFLATED else data
    if len(data) != m.size or zlib.crc32(data) != m.crc:
        raise ValueError(f"{m.name} is damaged")
    return data.decode("utf-8", "replace")


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, namespace, definition, synonyms, parents) of the terms of an OBO ontology."""
    stanza = spark.read.text(path, lineSep="\n[Term]\n").select(F.concat(F.lit("\n"), "value", F.lit("\n")).alias("t"))
    stanza = stanza.select(F.split("t", "\n\\[[A-Z]")[0].alias("t"))

    def one(tag):
        return F.regexp_extract("t", rf"\n{tag}: ([^\n]*)", 1)

    rows = stanza.select(
        one("id").alias("id"), one("name").alias("name"), one("namespace").alias("namespace"), F.regexp_extract("t", '\ndef: "([^"]*)"', 1).alias("definition"),
        F.regexp_extract_all("t", F.lit('\nsynonym: "([^"]*)"'), F.lit(1)).alias("synonyms"), F.regexp_extract_all("t", F.lit(r"\nis_a: (\S+)"), F.lit(1)).alias("parents"),
    )
    return rows.where("id <> ''")


def children(terms: DataFrame) -> DataFrame:
    """(id, children) from the parents of each term."""
    up = terms.select(F.col("id").alias("child"), F.explode("parents").alias("id"))
    return up.groupBy("id").agg(F.array_sort(F.collect_set("child")).alias("children"))


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(head, relation, tail) of a file of three words a line."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("head"), parts[1].alias("relation"), parts[2].alias("tail")).where("tail is not null")


def wide_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(item, user, rating) of a CSV with one row per item and one column per user."""
    wide = spark.read.csv(path, header=True)
    first, *users = wide.columns
    return wide.unpivot(first, users, "user", "rating").select(F.col(first).alias("item"), "user", F.col("rating").cast("double").alias("rating"))


def table(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=sep)


def count_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, float]:
    """((user, item, count), alpha) of a tab-separated file of counts; alpha is zero cells over the sum of counts."""
    rows = spark.read.csv(path, sep="\t", schema="user long, item long, count double")
    return rows, confidence_weight(rows)


def confidence_weight(rows: DataFrame) -> float:
    """Zero cells over the sum of counts, of (user, item, count)."""
    n = rows.agg(F.count_distinct("user") * F.count_distinct("item") - F.count_if(F.col("count") != 0), F.sum("count")).first()
    return float(n[0]) / n[1] if n[1] else 0.0


def scores_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Metapath scores from a tab-separated file, or the named columns of it."""
    schema = "source_id string, target_id string, source_name string, target_name string, source_degree int, target_degree int, path_count long, dwpc double, metapath string"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return rows.select(*columns) if columns else rows


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(exp, set, dataset, item, user, label) of a JSON file {exp: {test_set: [..], train_sets: {dataset: [..]}}}."""
    pair = "array<array<int>>"
    text = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,struct<test_set:{pair},train_sets:map<string,{pair}>>>")).alias("exp", "s"))
    test = text.select("exp", F.lit("test").alias("set"), F.lit(None).cast("string").alias("dataset"), F.explode("s.test_set").alias("t"))
    train = text.select("exp", F.lit("train").alias("set"), F.explode("s.train_sets").alias("dataset", "p")).select("exp", "set", "dataset", F.explode("p").alias("t"))
    t = F.col("t")
    return test.unionByName(train).select(F.col("exp").cast("int").alias("exp"), "set", "dataset", t[0].alias("item"), t[1].alias("user"), t[2].alias("label"))
