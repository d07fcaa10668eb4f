"""Circles, names of several words, upserts, general metapaths and null statistics against brute force."""

import collections
import itertools
import math
import re
from functools import reduce

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.operators import datasets, graph, lookup, mentions, stats
from linkweave.plans import fixtures
from linkweave.sources import store

EDGE = "rel string, src_kind string, src string, dst_kind string, dst string"


def closure(pairs):
    """{(code, ancestor): least depth} by search from every code."""
    up = collections.defaultdict(set)
    for c, p in pairs:
        if p is not None:
            up[c].add(p)
    out = {}
    for c in list(up):
        front, depth, seen = {c}, 0, {c}
        while front:
            depth += 1
            front = {p for x in front for p in up[x]} - seen
            seen |= front
            out |= {(c, p): depth for p in front}
    return out


@pytest.mark.parametrize("pairs", [
    [("x", "a"), ("a", "b"), ("b", "a")],
    [("a", "a"), ("a", "b"), ("a", "b"), ("b", None)],
    [(f"n{k}", f"n{(k + 1) % 7}") for k in range(7)] + [("n0", "n4"), ("out", "n2"), ("n5", "top")],
])
def test_ancestors_in_circles(spark, pairs):
    up = spark.createDataFrame(pairs, "code string, parent string")
    got = [(r.code, r.ancestor, r.depth) for r in lookup.ancestors(up).collect()]
    assert sorted(got) == sorted((c, a, d) for (c, a), d in closure(pairs).items())


NAMES = [
    (10, 0, "Asthma", ["bronchial asthma"]), (11, 1, "Breast Cancer", ["cancer of the breast"]), (12, 2, "cancer", []), (13, 3, "type 2 diabetes", ["T2D", "diabetes"]),
    (14, 4, "diabetes", None), (15, 5, "2 diabetes mellitus type", []), (16, 6, "AIDS", ["acquired immune deficiency"]), (17, 7, "maladie d'Alzheimer", []), (18, 8, "--", ["", None]),
]


def plain_mentions(sentence):
    """Leftmost, then longest; the first entry of a phrase."""
    ids = {}
    for i, _, name, more in NAMES:
        for x in [name, *(more or [])]:
            ids.setdefault(tuple(re.findall(r"[^\W_]+", (x or "").lower())), i)
    words, at, out = re.findall(r"[^\W_]+", sentence), 0, []
    while at < len(words):
        n = next((n for n in range(len(words) - at, 0, -1) if tuple(w.lower() for w in words[at : at + n]) in ids), 0)
        if n:
            out.append((at, n, " ".join(words[at : at + n]), ids[tuple(w.lower() for w in words[at : at + n])]))
        at += n or 1
    return out


def test_mentions(spark):
    v = spark.createDataFrame(NAMES, "id int, pos int, name string, synonyms array<string>")
    rng = np.random.default_rng(2)
    words = "type 2 diabetes mellitus cancer of the breast Breast asthma bronchial AIDS aids Maladie d'alzheimer other T2D, - .".split()
    texts = ["Breast cancer, then type 2 diabetes.", "", None, "no name", "cancer of the cancer of the breast"] + [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, sentence string").repartition(4)
    got = collections.defaultdict(list)
    for r in mentions.mentions(rows, v).collect():
        got[r.k].append((r.start, r.words, r.surface, r.id))
    assert {k: sorted(x) for k, x in got.items()} == {k: plain_mentions(t) for k, t in enumerate(texts) if t and plain_mentions(t)}
    assert mentions.mentions(rows, v.limit(0)).count() == 0 and mentions.mentions(rows.limit(0), v).count() == 0


def test_treatments(spark):
    v = spark.createDataFrame(NAMES, "id int, pos int, name string, synonyms array<string>")
    rows = spark.createDataFrame(
        [
            ("d1", ["approved"], "For breast cancer [L1] and type 2 diabetes. Not for asthma. Useful in another cancer.", "Contraindicated in AIDS. May cause bronchial\nasthma."),
            ("d2", ["approved", "x"], "For AIDS and T2D.", None), ("d3", ["experimental"], "asthma", "asthma"), ("d4", None, "asthma", "asthma"), ("d5", ["approved"], None, "acquired immune deficiency; aids"),
        ],
        "id string, groups array<string>, indication string, toxicity string",
    )
    got = {r.id: (r.treats, r.not_treats) for r in mentions.treatments(rows, "id", v).collect()}
    # A sentence with "not" in any word is left out, and isolated abbreviations are.
    assert got == {"d1": ([11, 13], [10]), "d2": ([], []), "d3": ([], []), "d4": ([], []), "d5": ([], [16])}


def test_upserts_keep_what_is_there(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "g")
    n = lambda *rows: spark.createDataFrame(list(rows), "kind string, id string, name string")
    e = lambda *rows: spark.createDataFrame(list(rows), "rel string, src string, dst string")
    assert store.nodes(spark, path).count() == 0
    store.upsert(spark, path, n(("Drug", "d1", "one"), ("Condition", "c1", "ill"), ("Condition", "c2", None)), e(("INDICATED_FOR", "d1", "c1"), ("INDICATED_FOR", "d1", "nowhere")))
    assert store.upsert(spark, path, n(("Drug", "d1", None), ("Drug", "d2", "two"), ("Condition", "c2", "sick")), e(("INDICATED_FOR", "d2", "c1"), ("INDICATED_FOR", "d1", "c1"))) == 2
    nodes = {("Drug", "d1", "one"), ("Drug", "d2", "two"), ("Condition", "c1", "ill"), ("Condition", "c2", "sick")}
    edges = {("INDICATED_FOR", "d1", "c1"), ("INDICATED_FOR", "d2", "c1")}

    def held(version=None):
        return {tuple(r) for r in store.nodes(spark, path, version).collect()}, {(r.rel, r.src, r.dst) for r in store.edges(spark, path, version).collect()}

    assert held() == (nodes, edges) and held(1)[1] == {("INDICATED_FOR", "d1", "c1")}

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # killed after its data are written, before the commit
        m.setattr(store, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            store.upsert(spark, path, n(("Drug", "d1", "half"), ("Drug", "d3", "three")))
    assert held() == (nodes, edges)
    with monkeypatch.context() as m:  # another writer commits meanwhile
        now = store.manifest(spark, path)
        m.setattr(store, "manifest", lambda *_: dict(now, version=1))
        with pytest.raises(store.Conflict):
            store.upsert(spark, path, n(("Drug", "d4", "four")))
    assert held() == (nodes, edges)
    store.vacuum(spark, path)
    assert held() == (nodes, edges) and store.versions(spark, path) == [2]
    assert store.upsert(spark, path, n(("Drug", "d1", "new"))) == 3 and ("Drug", "d1", "new") in held()[0] and held()[1] == edges


def dense_graph(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for rel, (a, _, b) in graph.METAGRAPH.items():
        cells = [(x, y) for x in range(5) for y in range(4) if rng.random() < 0.55]
        rows += [(rel, a, f"{a}{x}", b, f"{b}{y}") for x, y in cells]
    return spark.createDataFrame(rows, EDGE)


def test_all_metapaths_without_listing_paths(spark):
    """All 21: kinds that come twice or three times, next to one another or far apart."""
    e = dense_graph(spark).cache()
    every = graph.enumerate_metapaths()
    assert len(every) == 21

    def rows(method):
        out = {}
        for lo in range(0, 21, 7):  # several at once, as each costs more in planning than in work
            some = [graph.dwpc(e, m, method=method, cost={1: 1, 2: 2, 3: 1}).withColumn("m", F.lit(m)) for m in every[lo : lo + 7]]
            out |= {(r.m, r.source_id, r.target_id): (r.path_count, round(r.dwpc, 9)) for r in reduce(DataFrame.unionByName, some).collect()}
        return out

    one = rows("factorised")
    assert one == rows("direct") and {k[0] for k in one} == set(every)


def test_several_graphs_at_once(spark):
    e = dense_graph(spark)
    both = e.withColumn("perm", F.lit(0)).unionByName(dense_graph(spark, 1).withColumn("perm", F.lit(1)))
    got = graph.dwpc(both, "Di>CO<iDi>CO", by=("perm",))
    want = graph.dwpc(e, "Di>CO<iDi>CO", method="direct")
    rows = lambda d: {(r.source_id, r.target_id, r.path_count, round(r.dwpc, 9)) for r in d.collect()}
    assert rows(got.where("perm = 0")) == rows(want)


def test_tables_of_the_study_layer():
    """Enumerated metapaths by length, correction factors by length, the experiment catalogue."""
    assert collections.Counter(len(graph.parse_metapath(m)) for m in graph.enumerate_metapaths()) == {1: 1, 2: 1, 3: 7, 4: 12}
    assert collections.Counter(stats.factors(graph.METAPATHS[1:]).values()) == {1: 1, 6: 6, 3: 3}
    rows = collections.defaultdict(list)
    for r in datasets.experiments():
        rows[r["model"]].append(r["runs"])
    assert {m: (len(x), sum(x)) for m, x in rows.items()} == {"ALS": (17, 1200), "BPR": (17, 1200), "LMF": (17, 1200), "BNNR": (17, 85)}


def test_coincidences():
    for kinds in ("abab", "aaa", "abcab", "abaca"):
        for n in (2, 3):
            for ends in itertools.islice(itertools.product(range(n), repeat=len(kinds)), 400):
                total = sum(c * all(ends[i] == ends[b] for i, b in enumerate(block)) for c, block in graph.coincidences(list(kinds)))
                assert total == all(ends[i] != ends[j] for i in range(len(kinds)) for j in range(i) if kinds[i] == kinds[j])


def test_null_statistics_by_brute_force(spark):
    """Folded statistics, hits and fits equal those of all permuted scores, listed; folded from two batches."""
    metapaths = ["Dt>PRa>CO", "Di>CO<iDi>CO"]
    e = fixtures.edges(spark, SF, ["TARGETS", "ASSOCIATED_WITH", "INDICATED_FOR"])
    perms, coded, numbers = 3, *graph.coded(e)
    name = {r.idx: r.id for r in numbers.collect()}
    graphs = {0: [(r.rel, name[r.s], name[r.d]) for r in coded.collect()]}
    for r in graph.permute_coded(coded, perms, 2).collect():
        graphs.setdefault(r.perm, []).append((r.rel, name[r.s], name[r.d]))
    scores = {}
    for perm, rows in graphs.items():
        one = spark.createDataFrame(rows, "rel string, src string, dst string")
        for m in metapaths:
            found = {(r.source_id, r.target_id): r.dwpc for r in graph.dwpc(one, m, method="direct").collect()}
            mean = sum(found.values()) / len(found)
            scores[perm, m] = {k: math.asinh(v / mean) for k, v in found.items()}
    for batch in (2,):
        observed, zeros, fits = (x.collect() for x in stats.study(e, metapaths, perms, 2, batch=batch))
        degree = {}
        for r in observed:
            assert abs(r.dwpc - scores[0, r.metapath][r.source_id, r.target_id]) < 1e-9
            degree[r.metapath, "from", r.source_id], degree[r.metapath, "to", r.target_id] = r.source_degree, r.target_degree
        assert len(observed) == sum(len(scores[0, m]) for m in metapaths)
        assert {(r.metapath, r.source_id, r.target_id): r.zeros for r in zeros} == {(m, *k): sum(k not in scores[p, m] for p in range(1, perms + 1)) for m in metapaths for k in scores[0, m]}
        none = collections.Counter()
        for r in zeros:
            none[r.metapath, degree[r.metapath, "from", r.source_id], degree[r.metapath, "to", r.target_id]] += r.zeros
        # Degrees of ends that only permuted pairs have come from the edges.
        ends = {m: [collections.Counter(x[i + 1] for x in graphs[0] if x[0] == rel) for rel, i in ((h[0][0], 0 if h[0][1] else 1), (h[-1][0], 1 if h[-1][1] else 0))] for m in metapaths for h in [graph.parse_metapath(m)]}
        null = collections.defaultdict(list)
        for (p, m), rows in scores.items():
            for (s, t), v in rows.items() if p else ():
                null[m, ends[m][0][s], ends[m][1][t]].append(v)
        assert {(r.metapath, r.source_degree, r.target_degree) for r in fits} == set(null)
        for r in fits:
            key = (r.metapath, r.source_degree, r.target_degree)
            v = np.array(null[key])
            assert r.nnz == len(v) and r.n == len(v) + none[key]
            if len(v) > 1 and v.max() - v.min() > 1e-9:
                assert abs(r.beta - v.mean() / v.var(ddof=1)) <= 1e-6 * r.beta and abs(r.alpha - v.mean() ** 2 / v.var(ddof=1)) <= 1e-6 * r.alpha
