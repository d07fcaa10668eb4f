import math
import zipfile

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from linkweave.functions import text as tx
from linkweave.functions.special import gamma_q
from linkweave.operators import datasets, features, graph, links, lookup, metrics, recommend, stats
from linkweave.plans import fixtures
from linkweave.sources import readers, records, writers


def test_metapaths():
    every = graph.enumerate_metapaths()
    assert len(every) == 21 and set(graph.METAPATHS) <= set(every)


def test_fixture_counts(spark):
    g = graph.dwpc(fixtures.edges(spark, SF, ["TARGETS", "ASSOCIATED_WITH"]), "Dt>PRa>CO")
    assert g.agg(F.count("*"), F.sum("path_count")).first()[:] == (4881, 5300)


def test_gamma():
    x = np.array([0.1, 0.5, 1.0, 3.0, 20.0])
    assert np.allclose(gamma_q(np.ones(5), x), np.exp(-x), atol=1e-14)
    assert np.allclose(gamma_q(np.full(5, 0.5), x), [math.erfc(math.sqrt(v)) for v in x], atol=1e-14)


def test_p_value_branches(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.5), (3, 1, 0.5), (4, 1, 0.5)], "source_degree long, target_degree long, dwpc double")
    null = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.2), (3, 1, 0.1), (3, 1, 0.3)], "source_degree long, target_degree long, dwpc double")
    zeros = spark.createDataFrame([(2, 1, 3), (3, 1, 2)], "source_degree long, target_degree long, zeros long")
    keys = ("source_degree", "target_degree")
    p = {r.source_degree: r.p_value for r in stats.p_values(rows, stats.gamma_fit(null, zeros, keys), keys).collect()}
    assert p[1] == 1.0 and p[2] == 0.0 and p[4] == 0.0 and 0 < p[3] < 0.5


def test_permutation_keeps_degrees(spark):
    e = fixtures.edges(spark, SF, ["TARGETS"])
    p = graph.permute(e, 2, rounds=5).cache()
    for r in ("src", "dst"):
        a = {x[0]: x[1] for x in e.groupBy(r).count().collect()}
        for perm in (1, 2):
            assert a == {x[0]: x[1] for x in p.where(F.col("perm") == perm).groupBy(r).count().collect()}
    assert p.count() == p.distinct().count() == 2 * e.count()
    moved = p.where("perm = 1").select("src", "dst").join(e.select("src", "dst"), ["src", "dst"], "left_anti").count()
    assert moved > e.count() / 4
    assert graph.permute(e.limit(0), 2).count() == 0


def test_metrics_by_hand(spark):
    rows = spark.createDataFrame([("u", "a", 1, 0.9), ("u", "b", 0, 0.8), ("u", "c", 1, 0.7), ("u", "d", 0, 0.1), ("v", "a", 1, 0.5)], "user string, item string, truth int, score double")
    r = metrics.per_user(rows, k=2).collect()
    assert len(r) == 1 and r[0].auc == 0.75 and r[0].mrr == 1.0 and r[0].precision_k == 0.5 and abs(r[0].map - (1 + 2 / 3) / 2) < 1e-12


def test_models_recover_blocks(spark):
    pairs = [(f"i{i}", f"u{u}", int(i // 5 == u // 5)) for i in range(10) for u in range(10)]
    rows = spark.createDataFrame(pairs, "item string, user string, rating int")
    for name, params in (("ALS", {"iterations": 3, "factors": 3}), ("ALS", {"iterations": 5, "factors": 3, "engine": "mllib"}), ("BPR", {"iterations": 60, "factors": 4}), ("LMF", {"iterations": 12}), ("BNNR", {"iterations": 50})):
        m = recommend.MODELS[name](**params).fit(rows, 1)
        assert m.recommend(rows.select("item", "user"), k=7).count() == 7 and m.describe().startswith(type(m).__name__)
        s = {(r.item, r.user): r.score for r in m.predict_proba(rows).collect()}
        good, bad = [s[i, u] for i, u, r in pairs if r], [s[i, u] for i, u, r in pairs if not r]
        assert min(good) > max(bad) or np.mean(good) > np.mean(bad) + 0.3, name


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "g.obo").write_text('format-version: 1.2\n\n[Term]\nid: GO:1\nname: root\nnamespace: p\n\n[Term]\nid: GO:2\nname: leaf\nnamespace: p\ndef: "a leaf" [x]\nsynonym: "l" EXACT []\nis_a: GO:1 ! root\n')
    terms = readers.obo_terms(spark, str(tmp_path / "g.obo"))
    assert {r.id: (r.name, r.synonyms, r.parents) for r in terms.collect()} == {"GO:1": ("root", [], []), "GO:2": ("leaf", ["l"], ["GO:1"])}
    assert readers.children(terms).collect()[0][:] == ("GO:1", ["GO:2"])
    (tmp_path / "d.xml").write_text('<all><drug id="1"><name>a</name></drug><drug id="2"><name>b</name></drug></all>')
    assert {(r._id, r.name) for r in readers.xml_records(spark, str(tmp_path / "d.xml"), "drug").collect()} == {(1, "a"), (2, "b")}
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("x.xml", "<a/>")
    assert readers.zipped_texts(spark, str(tmp_path / "z.zip")).collect()[0][:] == (0, "x.xml", "<a/>")
    e = spark.createDataFrame([("a", "R", "b")], "src string, rel string, dst string")
    writers.write_triples(e, str(tmp_path / "t"))
    assert readers.triples(spark, str(tmp_path / "t")).collect()[0][:] == ("a", "R", "b")
    (tmp_path / "j.json").write_text('{"k": {"n": 1}, "l": {"n": 2}}')
    assert {(r.id, r.value.n) for r in readers.id_keyed_json(spark, str(tmp_path / "j.json"), "struct<n:int>").collect()} == {("k", 1), ("l", 2)}


def test_als_equals_the_normal_equations(spark):
    rng = np.random.default_rng(4)
    cells = [(f"i{i}", f"u{u}", 1) for i in range(12) for u in range(9) if rng.random() < 0.4] + [("i0", "u0", 1), ("i11", "u8", 0)]
    rows = spark.createDataFrame(cells, "item string, user string, rating int").repartition(4)
    m = recommend.ALS(iterations=2, factors=3).fit(rows, 7)
    items, users = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    r = np.zeros((len(items), len(users)))
    for i, u, v in cells:
        r[items.index(i), users.index(u)] = max(v, r[items.index(i), users.index(u)])
    start = {x.item: np.array(x.v) for x in recommend._start(rows.select("item").distinct(), "item", 3, 7).collect()}
    x = np.array([start[i] for i in items])
    for _ in range(2):
        solve = lambda f, c: np.array([np.linalg.solve(f.T @ f + 0.01 * np.eye(3) + (f * (15 * k)[:, None]).T @ f, ((1 + 15) * k) @ f) for k in c])
        y = solve(x, r.T)
        x = solve(y, r)
    got = {v.item: v.v for v in m.item_factors.collect()}
    assert np.allclose([got[i] for i in items], x, atol=1e-8)


def test_zero_scores_get_the_floor(spark):
    m = recommend.Model()
    m.item_factors = spark.createDataFrame([("a", [1.0]), ("b", [0.0]), ("c", [1e-40])], "item string, v array<double>")
    m.user_factors = spark.createDataFrame([("u", [1.0])], "user string, v array<double>")
    pairs = spark.createDataFrame([(i, "u") for i in "abc"], "item string, user string")
    assert {r.item: r.score for r in m.predict_proba(pairs).collect()} == {"a": 1.0, "b": 5e-41, "c": 1e-40}
    with pytest.raises(ValueError):
        recommend.ALS(wrong=1)


def test_too_large_for_the_driver(spark, monkeypatch):
    monkeypatch.setattr(recommend, "CELLS", 3)
    rows = spark.createDataFrame([("a", "u", 1), ("b", "v", 1)], "item string, user string, rating int")
    with pytest.raises(ValueError):
        recommend.BNNR().fit(rows)


def test_drawn_items_are_new_distinct_and_enough(spark):
    items = spark.createDataFrame([(f"i{k}",) for k in range(200)] + [("i0",)], "item string")
    taken = spark.createDataFrame([(f"i{k}", "u") for k in range(30)] + [(f"i{k}", "w") for k in range(190)], "item string, user string")
    want = spark.createDataFrame([("u", 20), ("v", 500), ("w", 50), ("x", 0)], "user string, need long")
    got = {}
    for r in links.draw(want, items, taken, 1).collect():
        got.setdefault(r.user, []).append(r.item)
    assert {u: len(v) for u, v in got.items()} == {"u": 20, "v": 200, "w": 10} and all(len(set(v)) == len(v) for v in got.values())
    assert not set(got["u"]) & {f"i{k}" for k in range(30)}
    assert links.draw(want, items.limit(0), taken, 1).count() == 0


def test_draws_are_not_shuffled(spark):
    """Only what is drawn in the end leaves a user's row: no aggregate, window or join over places that aren't taken."""
    items, want = spark.range(5000).selectExpr("cast(id as string) as item"), spark.range(50).selectExpr("cast(id as string) as user", "10L as need")
    taken = want.selectExpr("'1' as item", "user")
    plan = links.draw(want, items, taken, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate explode") == 1 and plan.count("array_except") >= 2


def test_lowest_and_dense_index(spark):
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", k) for k in range(3)], "g string, k int")
    most = spark.createDataFrame([("a", 10), ("b", 5)], "g string, most long")
    got = links.lowest(rows, F.md5(F.col("k").cast("string")), most, ["g"], ["k"])
    want = sorted(range(50), key=lambda k: __import__("hashlib").md5(str(k).encode()).hexdigest())[:10]
    assert sorted(r.k for r in got.where("g = 'a'").collect()) == sorted(want) and got.where("g = 'b'").count() == 3
    ids = spark.createDataFrame([(f"x{k}",) for k in range(500)], "id string")
    index = {r.id: r.idx for r in links.dense_index(ids, "id", parts=7).collect()}
    assert index == {x: k for k, x in enumerate(sorted(index))}


def test_ancestors_of_a_chain(spark):
    up = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None)], "code string, parent string")
    assert {(r.code, r.ancestor, r.depth) for r in lookup.ancestors(up).collect()} == {("a", "b", 1), ("b", "c", 1), ("a", "c", 2)}


def test_frequent_features_are_cut(spark, monkeypatch):
    rows = spark.createDataFrame([(k, "f") for k in range(40)] + [(0, "g"), (1, "g"), (99, "h")], "id int, feature string")
    whole = {tuple(r) for r in links.jaccard(rows).collect()}
    monkeypatch.setattr(links, "CHUNK", 7)
    assert {tuple(r) for r in links.jaccard(rows).collect()} == whole and len(whole) == 40 * 41 // 2 + 1


def test_drug_file(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        '<drugbank><drug type="x"><drugbank-id primary="true">D1</drugbank-id><drugbank-id>old</drugbank-id><name> one </name><half-life>2 h</half-life><groups><group>approved</group></groups>'
        '<atc-codes><atc-code code="A01AA01"><level code="A01AA">x</level><level code="A">y</level></atc-code></atc-codes>'
        '<targets><target><name>t</name><actions><action>agonist</action></actions></target></targets></drug><drug><name>no id</name></drug></drugbank>'
    )
    x = records.read_drugs(spark, str(tmp_path / "d.xml"))
    r = records.drugs(x).collect()
    assert len(r) == 1 and (r[0].id, r[0].name, r[0].half_life, r[0].toxicity, r[0].atc_codes, r[0].salts, r[0].categories) == ("D1", "one", "2 h", "", ["A01AA01", "A01AA", "A"], [], [])
    assert records.targets(x).collect()[0].targets[0].asDict() == {"name": "t", "actions": ["agonist"], "known_action": "unknown"}
    assert records.interactions(x).count() == 0


def test_studies_of_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("readme.txt", "x")
        for k, ident in enumerate(("N1", "N2", "N1", "")):
            z.writestr(f"{k}.xml", f"<clinical_study><id_info><nct_id>{ident}</nct_id></id_info><brief_title>t{k}</brief_title><condition>c</condition><condition/></clinical_study>")
    found = {r.nct_id: r for r in records.studies(records.read_studies(spark, str(tmp_path / "s.zip"))).collect()}
    assert {k: v.brief_title for k, v in found.items()} == {"N1": "t2", "N2": "t1"} and found["N1"].condition_mesh_terms == ["c"] and found["N1"].intervention_mesh_terms == []
    assert records.read_studies(spark, str(tmp_path / "s.zip"), max_records=2).count() == 2


def test_tables_and_back(spark, tmp_path):
    r = spark.createDataFrame([("a", "u", 1), ("b", "v", -1)], "item string, user string, rating int")
    writers.write_matrix(r, str(tmp_path / "m"), ["u", "v"])
    assert {(x.item, x.user, x.rating) for x in readers.wide_matrix(spark, str(tmp_path / "m")).collect()} == {("a", "u", 1.0), ("a", "v", 0.0), ("b", "u", 0.0), ("b", "v", -1.0)}
    (tmp_path / "c.tsv").write_text("0\t0\t2\n0\t1\t0\n1\t1\t2\n")
    rows, alpha = readers.count_matrix(spark, str(tmp_path / "c.tsv"))
    assert rows.count() == 3 and alpha == 0.5
    (tmp_path / "p.json").write_text('{"0": {"test_set": [[1, 2, 1]], "train_sets": {"d": [[3, 4, 0], [5, 6, 1]]}}}')
    assert {tuple(x) for x in readers.splits(spark, str(tmp_path / "p.json")).collect()} == {(0, "test", None, 1, 2, 1), (0, "train", "d", 3, 4, 0), (0, "train", "d", 5, 6, 1)}
    (tmp_path / "w.tsv").write_text("source_id\ttarget_id\tsource_name\ttarget_name\tsource_degree\ttarget_degree\tpath_count\tdwpc\tmetapath\na\tb\tA\tB\t1\t2\t3\t0.5\tDi>CO\n")
    s = readers.scores_table(spark, str(tmp_path / "w.tsv"), ["source_id", "dwpc"])
    assert s.collect()[0][:] == ("a", 0.5)
    writers.tsv_to_parquet(s, str(tmp_path / "w.parquet"))
    assert spark.read.parquet(str(tmp_path / "w.parquet")).count() == 1
    f = spark.createDataFrame([("a", [1.0, 2.0])], "item string, v array<double>")
    writers.write_factors(f, str(tmp_path / "f"), "item")
    assert spark.read.csv(str(tmp_path / "f"), sep="\t", header=True).collect()[0][:] == ("a", "1.0,2.0")


def test_graph_is_built_and_exported(spark, tmp_path):
    n = spark.createDataFrame([("Drug", "d", "old", 1), ("Drug", "d", "new", 2), ("Condition", "c", "ill", 1), ("Condition", "alone", "x", 1), ("Drug", None, "y", 1)], "kind string, id string, name string, pos int")
    e = spark.createDataFrame([("INDICATED_FOR", "d", "c"), ("INDICATED_FOR", "d", "c"), ("INDICATED_FOR", "d", "nowhere"), ("OTHER", "d", "c")], "rel string, src string, dst string")
    nodes, edges = graph.build(n, e, str(tmp_path))
    assert {tuple(r) for r in nodes.collect()} == {("Drug", "d", "new"), ("Condition", "c", "ill")} and edges.collect()[0][:] == ("INDICATED_FOR", "Drug", "d", "Condition", "c")
    assert spark.read.csv(f"{tmp_path}/edges.sif", sep="\t", header=True).collect()[0][:] == ("Drug::d", "INDICATED_FOR", "Condition::c")
    assert graph.from_triples(graph.to_triples(edges), nodes).collect() == edges.collect()


def test_dataset_errors(spark):
    pairs = spark.createDataFrame([("a", "u")], "item string, user string")
    other = spark.createDataFrame([("b", "u")], "item string, user string")
    with pytest.raises(ValueError, match="unknown ids: item a"):
        datasets.from_pairs(pairs, other, pairs)
    with pytest.raises(ValueError):
        datasets.mask(spark.createDataFrame([(0, 5)], "row long, column long"), 1, 5)
    x = spark.createDataFrame([("a", "f", 1.0)], "id string, feature string, value double")
    y = spark.createDataFrame([("u", "g", 1.0)], "id string, feature string, value double")
    with pytest.raises(ValueError):
        datasets.build(pairs.withColumn("rating", F.lit(1)), x, y, same_features=True)


def test_features_without_values(spark):
    x = spark.createDataFrame([("a", "f", None), ("b", "f", float("nan")), ("a", "g", 2.0), ("b", "g", 2.0), ("a", "h", float("inf")), ("b", "h", 0.0)], "id string, feature string, value double")
    got = {(r.id, r.feature): r.value for r in features.Scaler(4.0, -4.0).fit_transform(x).collect()}
    assert got == {("a", "f"): 0.0, ("b", "f"): 0.0, ("a", "g"): 0.0, ("b", "g"): 0.0, ("a", "h"): 1.0, ("b", "h"): -1.0}
    with pytest.raises(ValueError):
        features.prepare("none", x, x, x)


def test_pieces_keep_their_digits(spark):
    one = spark.createDataFrame([("10 | 201|  | 0",)], "t string").select(tx.pieces(F.col("t"))).first()[0]
    assert one == ["10", "201", "0"]


def test_results_skip_metapaths_without_null(spark):
    e = fixtures.edges(spark, SF, ["TARGETS", "ASSOCIATED_WITH", "HAS_PROCESS"])
    e = e.where("rel <> 'HAS_PROCESS'")
    r = stats.results(e, fixtures.nodes(spark, SF), ["Dt>PRa>CO", "Dt>PRh>B<hPRa>CO"], permutations=3, rounds=2)
    assert {x.metapath for x in r.select("metapath").distinct().collect()} == {"Dt>PRa>CO"}
    one = r.agg(F.min("p_value"), F.max("adjusted_p_value"), F.count("source_name"), F.count("*")).first()
    assert one[0] >= 0 and one[1] <= 1 and one[2] == one[3] > 0
    found = stats.explanations(e, fixtures.nodes(spark, SF), stats.significant(r).limit(50))
    assert found.columns[-1] == "path_score"


def test_run_pipeline(spark):
    rows = spark.createDataFrame([(f"i{i}", f"u{u}", int(i // 6 == u // 6)) for i in range(12) for u in range(12)], "item string, user string, rating int")
    test = rows.withColumn("truth", F.col("rating")).drop("rating")
    out = recommend.run_pipeline("LMF", rows, test, experiments=2, k=5, iterations=6)
    assert out.select("experiment").distinct().count() == 2 and out.where("metric = 'auc'").first().average > 0.9
    splits = rows.withColumns({"exp": F.lit(0), "set": F.lit("train"), "dataset": F.lit("base")}).unionByName(rows.withColumns({"exp": F.lit(0), "set": F.lit("test"), "dataset": F.lit("base")}))
    done = recommend.run_experiments(splits, [{"model": "LMF", "dataset": "base", "runs": 1}], k=5, LMF={"iterations": 5})
    assert done.where("metric = 'auc'").count() == 1
