"""A spread of catalogue queries against their SQL at the smallest scale."""

import math

import duckdb
import pytest
from conftest import SF

from linkweave.plans import ORACLES, QUERIES, significance

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KEYS = ["g08_dwpc_target_association", "g08_dwpc_shared_condition", "g08_dwpc_component", "g09_direct_function", "j05_first_match", "j12_prefix_parent", "g17_ancestors", "g16_two_core", "g15_prune_40", "r01_test_split", "e12_auc", "e10_ndcg", "t08_kendall", "u07_leave_one_metapath_out", "g10_degrees_kept", "s02_drugs", "s10_studies", "g03_edge_upsert", "r02_train_negatives", "r03_random_control", "l08_scaler", "e17_summary", "w11_roc_grid", "a15_dataset_summary", "g19_explained_shared_target", "g17_circle", "l13_dictionary_ner", "l15_extraction", "k05_upsert", "g09_far_drugs", "f03_piece_rows", "p19_affirmed_rows", "w07_neighbours", "g11_results_function"]


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def test_component_results_match_sql(spark):
    """The query that has no SQL of its own at larger scales."""
    compare(spark, "g11_results_component", significance._results_sql(("Dt>PRh>CE<hPRa>CO",)))


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_sql(spark, key):
    compare(spark, key, ORACLES[key])


@pytest.mark.parametrize("key", ["j24_joined_vectors", "l10_same_features_product"])
def test_negative_zero_matches_sql(spark, key, tmp_path):
    """Balances that round to zero from below."""
    for t in TABLES:
        if t != "customer":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    balance = "CASE c_custkey % 3 WHEN 0 THEN -0.0::double WHEN 1 THEN -1e-9 ELSE 0.0 END"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({balance} AS c_acctbal) FROM '{SF}/customer.parquet') TO '{tmp_path}/customer.parquet'")
    compare(spark, key, ORACLES[key], str(tmp_path))


def test_cross_pairs_match_sql_with_nulls(spark, tmp_path):
    """Lines without a supplier; and no order's lines are held as arrays."""
    nulls = "CASE WHEN l_partkey % 3 > 0 THEN l_suppkey END"
    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({nulls} AS l_suppkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    compare(spark, "j23_cross_arrays", ORACLES["j23_cross_arrays"], str(tmp_path))
    assert "collect" not in QUERIES["j23_cross_arrays"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def compare(spark, key, sql, folder=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = QUERIES[key](spark, folder)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(df.columns)) for r in res.fetchall())
    assert got == want
