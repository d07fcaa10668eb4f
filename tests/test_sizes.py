"""What is kept, shuffled or made at once, and results that don't depend on it."""

import collections

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from linkweave.operators import graph, mentions, products, recommend, stats
from linkweave.plans import QUERIES, fixtures
from linkweave.tables import written


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_written_tables_leave_no_shuffle(spark):
    before = shuffle_files(spark)
    rows = written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    assert rows.count() == 7 and shuffle_files(spark) <= before + 8  # the count's own shuffle
    written(spark.range(1000).groupBy(F.col("id") % 7).count(), "counts")
    assert shuffle_files(spark) <= before + 8


def test_permutations_are_the_same_in_batches(spark, monkeypatch):
    """Batches of two permutations give the edges of one batch; a relation with a hub and one of a single edge are among them."""
    e = fixtures.edges(spark, SF, ["TARGETS"]).select("rel", "src", "dst")
    hub = spark.range(40).select(F.lit("HUB").alias("rel"), F.lit("h").alias("src"), F.col("id").cast("string").alias("dst"))
    one = spark.createDataFrame([("ONE", "a", "b")], "rel string, src string, dst string")
    e = e.unionByName(hub).unionByName(one)
    whole = sorted(map(tuple, graph.permute(e, 5, 2).collect()))
    monkeypatch.setattr(graph, "BATCH_EDGES", 2 * e.count())
    assert sorted(map(tuple, graph.permute(e, 5, 2).collect())) == whole
    assert len(whole) == 5 * e.count() and {(r, s, d) for _, r, s, d in whole if r != "TARGETS"} == {(r, s, d) for r, s, d in map(tuple, e.collect()) if r != "TARGETS"}


def test_bounded_relations_are_permuted_without_rounds_of_shuffles(spark, monkeypatch):
    """All rounds in a task, all by shuffles, or one relation of each: the same edges; only rounds by shuffles write tables."""
    e = graph.coded(fixtures.edges(spark, SF, ["TARGETS", "HAS_PROCESS", "ASSOCIATED_WITH"]))[0]
    e = written(e, "coded")
    tables = []
    monkeypatch.setattr(graph, "written", lambda df, label: tables.append(label) or written(df, label))
    made = lambda: sorted(map(tuple, graph.permute_coded(e, 4, 3, seed=1, first=2).collect()))
    whole = made()
    assert not tables and len(whole) == 4 * e.count()
    size = {r.rel: r["count"] for r in e.groupBy("rel").count().collect()}
    for most in (min(size.values()), 0):
        monkeypatch.setattr(graph, "WHOLE_EDGES", most)
        assert made() == whole and len(tables) == 3
        tables.clear()


def test_more_walks_are_listed_by_more_tasks(spark, monkeypatch):
    """Listed pairs are those of the products; partitions follow the counted walks."""
    m = "Dt>PR<tDi>CO"
    e = fixtures.edges(spark, SF, ["TARGETS", "INDICATED_FOR"])
    t, i = (e.where(F.col("rel") == rel).select("src", "dst") for rel in ("TARGETS", "INDICATED_FOR"))
    n = t.join(t.withColumnsRenamed({"src": "drug"}), "dst").join(i.select(F.col("src").alias("drug")), "drug").count()
    assert graph.walks(e, m) == n > 20
    monkeypatch.setattr(graph, "TASK_WALKS", n // 20)
    listed = graph.dwpc(e, m, method="direct")
    rounded = lambda rows: sorted((r.source_id, r.target_id, r.path_count, round(r.dwpc, 9)) for r in rows.collect())
    assert listed.rdd.getNumPartitions() == -(-n // (n // 20)) and rounded(listed) == rounded(graph.dwpc(e, m))


def test_upserts_make_their_rows_once(spark, tmp_path):
    """What an upsert is given is made once, though its buckets are told before it is merged."""
    from linkweave.sources import store

    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(40).select(F.lit("Drug").alias("kind"), F.col("id").cast("string").alias("id"), F.lit("x").alias("name"))
    for turn in (1, 2):
        store.upsert(spark, str(tmp_path / "g"), rows.mapInArrow(counted, rows.schema))
        assert made.value == 40 * turn
    assert store.nodes(spark, str(tmp_path / "g")).count() == 40


def test_degrees_are_counted_without_repeating_rows(spark):
    plan = QUERIES["g10_degrees_kept"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_statistics_folded_in_blocks_are_those_of_listed_pairs(spark, monkeypatch):
    """Numbers, means, spreads, extremes and hits of permuted graphs in several blocks, against all their pairs."""
    monkeypatch.setattr(products, "GRAPHS", 2)
    monkeypatch.setattr(products, "FOLDED_PRODUCTS", 20_000)
    m = "Dt>PRh>CE<hPRa>CO"
    e = fixtures.edges(spark, SF, ["TARGETS", "HAS_COMPONENT", "ASSOCIATED_WITH"])
    by_number = written(graph.coded(e)[0], "coded")
    ends = [written(x, "ends") for x in stats._ends(by_number.withColumnsRenamed({"s": "src", "d": "dst"}), m)]
    graphs = graph.permute_coded(by_number, 3, 2).unionByName(by_number.withColumn("perm", F.lit(0))).withColumnsRenamed({"s": "src", "d": "dst"})
    graphs = written(graph.weighted(graphs, 0.5, ("perm", "rel")).select("perm", "rel", "src", "dst", "w"), "graphs")
    out = graph.fold(graphs, m, ends, True).collect()
    pairs = [r for r in out if r.source_degree is None]
    listed = stats._scaled_pairs(graphs, m, {}, ends).collect()
    seen = {(r.source_id, r.target_id) for r in listed if not r.perm}
    null, hits = collections.defaultdict(list), collections.Counter()
    for r in listed:
        if r.perm:
            null[r.source_degree, r.target_degree].append(r.dwpc)
            hits[r.source_id, r.target_id] += (r.source_id, r.target_id) in seen
    found = collections.Counter()
    for r in pairs:
        found[r.source_id, r.target_id] += r.n
    assert found == +hits and len(pairs) > len(found) > 0
    known = spark.createDataFrame([r for r in out if r.source_degree is not None], "source_id long, target_id long, source_degree long, target_degree long, n long, mean double, var double, low double, high double, hits long")
    assert known.count() > len(null) and known.agg(F.sum("hits")).first()[0] == sum(hits.values())
    for r in stats.merged(known.where("n > 0"), ("source_degree", "target_degree")).collect():
        v = np.array(null.pop((r.source_degree, r.target_degree)))
        assert r.nnz == v.size and np.allclose([r.mean, r.low, r.high], [v.mean(), v.min(), v.max()], rtol=1e-9)
        assert abs(r["var"] - (v.var(ddof=1) if v.size > 1 else 0)) <= 1e-9
    assert not null


def test_small_relations_are_folded_where_they_are_permuted(spark, monkeypatch):
    """Zeros and fits of whole graphs in tasks are those of blocks, and no permuted graph is written."""
    m = "Dt>PR<tDi>CO"
    e = fixtures.edges(spark, SF, ["TARGETS", "INDICATED_FOR"])
    labels, was = [], stats.written
    monkeypatch.setattr(stats, "written", lambda df, label: labels.append(label) or was(df, label))
    rows = lambda found: [sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()) for df in found[1:]]
    whole = rows(stats.study(e, [m], 3, 2))
    assert "graphs" not in labels
    monkeypatch.setattr(graph, "WHOLE_PAIRS", 1)
    monkeypatch.setattr(products, "ONCE", 0)
    assert rows(stats.study(e, [m], 3, 2)) == whole and "graphs" in labels and all(whole)


def test_graphs_without_pairs_are_folded(spark):
    """A graph that connects nothing has no mean, which is no error."""
    side = lambda rows: spark.createDataFrame(rows, "perm int, p long, q long, w double, n long")
    ends = [written(spark.createDataFrame([(k, 1)], "id long, degree long"), "ends") for k in (1, 3)]
    left, right = side([(0, 1, 2, 1.0, 1), (1, 1, 2, 1.0, 1)]), side([(0, 2, 3, 1.0, 1), (1, 4, 3, 1.0, 1)])
    assert products.folded([(left, right, None)], ends, False).agg(F.sum("n")).first()[0] in (None, 0)


def test_one_split_is_that_of_all(spark):
    from linkweave.plans import study

    one, every = study._first_split(spark, SF), study._splits(spark, SF).where("exp = 0 and (set = 'test' or dataset = 'baseline')")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, every.collect()))


def test_normal_equations_are_solved_as_rows_pass(spark, monkeypatch):
    """An id's rows in several batches; no group is a call of its own, and factors are those of a plain solve."""
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda *a: pytest.fail("grouped"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(4)
        fixed = {f"i{k}": rng.standard_normal(3).tolist() for k in range(30)}
        pos = [(f"i{k}", f"u{u}", 1.0 + u) for u in range(5) for k in range(30) if (k * 7 + u) % (u + 2)]
        model = recommend.ALS(factors=3, alpha=2.0, reg=0.1)
        before = spark.createDataFrame([(f"u{u}", [0.0] * 3) for u in range(6)], "user string, v array<double>")
        out = model._solve(spark.createDataFrame(pos, "item string, user string, r double"), "user", "item", spark.createDataFrame(list(fixed.items()), "item string, v array<double>"), before)
        got = {r.user: r.v for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = np.array(list(fixed.values()))
    for u in range(5):
        mine = np.array([fixed[i] for i, v, _ in pos if v == f"u{u}"])
        c = 2.0 * (1 + u)
        assert np.allclose(got[f"u{u}"], np.linalg.solve(x.T @ x + 0.1 * np.eye(3) + c * mine.T @ mine, (1 + c) * mine.sum(axis=0)))
    assert got["u5"] == [0.0] * 3 and len(got) == 6


def test_pairwise_training_makes_few_rounds(spark):
    """Rounds move all factors, so their number must not follow the ids where a block has room for them."""
    rows = spark.range(12_000).select(F.col("id").alias("item"), (F.col("id") % 3).alias("user"), F.lit(1).alias("rating"))
    model = recommend.BPR()
    model._number(rows)
    assert model.blocks == 2 and recommend.LogisticMF.block == recommend.BLOCK


def test_mentions_do_not_depend_on_the_places_of_tokens(spark, monkeypatch):
    """Runs that can't be names are left out; where all tokens share one place, none is, and mentions are the same."""
    names = spark.createDataFrame([(1, 1, "Big Red Dog", ["dog"]), (2, 2, "Été Rouge", None)], "id int, pos int, name string, synonyms array<string>")
    texts = spark.createDataFrame([(1, "a BIG red dog, a dog; éTÉ rouge"), (2, "red"), (3, ""), (4, None)], "doc int, sentence string")
    few = sorted(map(tuple, mentions.mentions(texts, names).collect()))
    assert [r[:3] for r in few] == [(1, 1, 3), (1, 5, 1), (1, 6, 2)]
    monkeypatch.setattr(mentions, "PLACES", 1)
    assert sorted(map(tuple, mentions.mentions(texts, names).collect())) == few
