"""Writers of the interchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, sep="\t")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_triples(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws(" ", "src", "rel", "dst")).write.mode("overwrite").text(path)


def write_nodes(nodes: DataFrame, path: str) -> None:
    """Nodes as a tab-separated table of Kind::id and name."""
    write_tsv(nodes.select(F.concat_ws("::", "kind", "id").alias("id"), "name", "kind"), path)


def write_sif(edges: DataFrame, path: str) -> None:
    """Edges as a tab-separated table of Kind::source, relation and Kind::target."""
    write_tsv(edges.select(F.concat_ws("::", "src_kind", "src").alias("source"), F.col("rel").alias("metaedge"), F.concat_ws("::", "dst_kind", "dst").alias("target")), path)


def write_matrix(ratings: DataFrame, path: str, users: list[str]) -> None:
    """One row an item and one column a user; for study-sized tables, as the columns are named in the plan."""
    write_csv(ratings.groupBy("item").pivot("user", users).agg(F.first("rating")).fillna(0), path)


def tsv_to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_factors(factors: DataFrame, path: str, key: str) -> None:
    """Latent vectors (key, v) as a tab-separated table, the vector's numbers joined by commas."""
    write_tsv(factors.select(key, F.array_join(F.transform("v", lambda x: x.cast("string")), ",").alias("vector")), path)


def append_splits(splits: DataFrame, path: str) -> None:
    """Experiments one after another: what is there stays."""
    splits.write.mode("append").partitionBy("exp").parquet(path)
