"""The fixture graph over the driver tables, once as DataFrames and once as the same SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkweave.operators.graph import METAGRAPH


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, rel: str) -> DataFrame:
    """(src, dst) distinct pairs of one relation, ids as text."""
    def t(name):
        return table(spark, sf_dir, name)

    if rel in ("INDICATED_FOR", "ASSOCIATED_WITH"):
        cut = "l_returnflag = 'R' and l_discount >= 0.085" if rel == "INDICATED_FOR" else "l_returnflag = 'N' and l_discount between 0.045 and 0.055"
        src = "l_partkey" if rel == "INDICATED_FOR" else "l_suppkey"
        rows = t("lineitem").where(cut).join(t("orders"), F.expr("l_orderkey = o_orderkey")).select(F.col(src).alias("src"), F.col("o_custkey").alias("dst"))
    elif rel == "TARGETS":
        rows = t("lineitem").where("l_returnflag = 'A' and l_discount <= 0.015").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    elif rel == "HAS_PROCESS":
        rows = t("supplier").select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))
    elif rel == "HAS_COMPONENT":
        rows = t("supplier").join(t("nation"), F.expr("s_nationkey = n_nationkey")).select(F.col("s_suppkey").alias("src"), F.col("n_regionkey").alias("dst"))
    elif rel == "HAS_FUNCTION":
        rows = t("lineitem").where("l_tax < 0.005 and l_quantity <= 1.5").join(t("part"), F.expr("l_partkey = p_partkey")).selectExpr("l_suppkey as src", "concat(p_brand, cast(p_size as string)) as dst")
    else:
        group = {"HAS_THERAPEUTIC_GROUP": "concat(p_brand, p_type)", "HAS_PHARMACOLOGICAL_GROUP": "concat(p_brand, cast(p_size as string))",
                 "HAS_CHEMICAL_GROUP": "concat(p_brand, p_type, cast(p_size as string))", "HAS_CATEGORY": "p_name"}[rel]
        rows = t("part").selectExpr("p_partkey as src", f"{group} as dst")
    return rows.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()


def edges(spark: SparkSession, sf_dir: str, rels: list[str] | None = None) -> DataFrame:
    """(rel, src_kind, src, dst_kind, dst) of the named relations, or all ten."""
    out = None
    for rel, (src, _, dst) in METAGRAPH.items():
        if rels is None or rel in rels:
            one = relation(spark, sf_dir, rel).select(F.lit(rel).alias("rel"), F.lit(src).alias("src_kind"), "src", F.lit(dst).alias("dst_kind"), "dst")
            out = one if out is None else out.unionByName(one)
    return out


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, name) of drugs, conditions and proteins, and of every other end of an edge with its id as name."""
    out = None
    for kind, (name, key, label) in NODES.items():
        one = table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).alias("name"))
        out = one if out is None else out.unionByName(one)
    rest = edges(spark, sf_dir, [r for r in METAGRAPH if r.startswith("HAS_")]).select(F.col("dst_kind").alias("kind"), F.col("dst").alias("id"), F.col("dst").alias("name")).distinct()
    return out.unionByName(rest)


#: Kind -> (table, id, name).
NODES = {"Drug": ("part", "p_partkey", "p_name"), "Condition": ("customer", "c_custkey", "c_name"), "Protein": ("supplier", "s_suppkey", "s_name")}


def nodes_sql() -> str:
    """A CTE body named nodes; needs edges of all relations."""
    parts = [f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS id, {label} AS name FROM {name}" for kind, (name, key, label) in NODES.items()]
    return "nodes AS (" + " UNION ALL ".join(parts) + " UNION ALL SELECT DISTINCT dst_kind, dst, dst FROM edges WHERE rel LIKE 'HAS_%')"


_LO = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_SOURCE = {
    "INDICATED_FOR": ("l_partkey", "o_custkey", f"{_LO} WHERE l_returnflag = 'R' AND l_discount >= 0.085"),
    "TARGETS": ("l_partkey", "l_suppkey", "lineitem WHERE l_returnflag = 'A' AND l_discount <= 0.015"),
    "ASSOCIATED_WITH": ("l_suppkey", "o_custkey", f"{_LO} WHERE l_returnflag = 'N' AND l_discount BETWEEN 0.045 AND 0.055"),
    "HAS_THERAPEUTIC_GROUP": ("p_partkey", "p_brand || p_type", "part"),
    "HAS_PHARMACOLOGICAL_GROUP": ("p_partkey", "p_brand || CAST(p_size AS VARCHAR)", "part"),
    "HAS_CHEMICAL_GROUP": ("p_partkey", "p_brand || p_type || CAST(p_size AS VARCHAR)", "part"),
    "HAS_CATEGORY": ("p_partkey", "p_name", "part"),
    "HAS_PROCESS": ("s_suppkey", "s_nationkey", "supplier"),
    "HAS_COMPONENT": ("s_suppkey", "n_regionkey", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    "HAS_FUNCTION": ("l_suppkey", "p_brand || CAST(p_size AS VARCHAR)", "lineitem JOIN part ON l_partkey = p_partkey WHERE l_tax < 0.005 AND l_quantity <= 1.5"),
}


def edges_sql(rels: list[str] | None = None) -> str:
    """A CTE body named edges."""
    parts = [
        f"SELECT DISTINCT '{r}' AS rel, '{METAGRAPH[r][0]}' AS src_kind, CAST({a} AS VARCHAR) AS src, '{METAGRAPH[r][2]}' AS dst_kind, CAST({b} AS VARCHAR) AS dst FROM {source}"
        for r, (a, b, source) in _SOURCE.items() if rels is None or r in rels
    ]
    return "edges AS (" + " UNION ALL ".join(parts) + ")"
