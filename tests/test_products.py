"""Products by blocks against sums over all of them."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from linkweave.operators import graph, products
from linkweave.plans import QUERIES


def term(rnd, xs, vs, ys, n):
    left = {(f"x{rnd.randrange(xs)}", f"v{rnd.randrange(vs)}"): rnd.random() for _ in range(n)}
    right = {(f"v{rnd.randrange(vs)}", f"y{rnd.randrange(ys)}"): rnd.random() for _ in range(n)}
    pairs = {(f"x{rnd.randrange(xs)}", f"y{rnd.randrange(ys)}"): -rnd.random() for _ in range(n // 4)}
    return left, right, pairs


def brute(terms):
    w, n = defaultdict(float), defaultdict(int)
    for left, right, pairs in terms:
        by = defaultdict(list)
        for (v, y), r in right.items():
            by[v].append((y, r))
        for (x, v), r in left.items():
            for y, q in by[v]:
                w[x, y] += r * q
                n[x, y] += 1
        for k, r in pairs.items():
            w[k] += r
            n[k] -= 1
    return {k: (n[k], round(w[k], 9)) for k in n if n[k] > 0}


@pytest.mark.parametrize("shape", [(40, 3, 30, 80), (300, 200, 300, 500), (1, 1, 1, 1)])
@pytest.mark.parametrize("held", [1, 500, 2_000_000])
def test_a_block(monkeypatch, shape, held):
    monkeypatch.setattr(products, "HELD", held)
    terms = [term(random.Random(k), *shape) for k in (1, 2)]
    rows = [(k, t, p, q, w, -1 if k == 2 else 1) for t, sides in enumerate(terms) for k, some in enumerate(sides) for (p, q), w in some.items()]
    names = ["side", "term", "p", "q", "w", "n"]
    table = pa.table(dict(zip(names, map(list, zip(*rows)))))
    got = {}
    for x, y, w, n, xs, ys in products.block_pairs(table):
        for a, b, c, m in zip(x, y, w, n):
            key = xs[a].as_py(), ys[b].as_py()
            assert key not in got
            got[key] = (m, round(c, 9))
    assert got == brute(terms)


@pytest.mark.parametrize("held", [1, 300])
def test_pairs_are_counted_without_weights(monkeypatch, held):
    """Few cells of many, some of them several times and some taken off: the same pairs with weights and without."""
    monkeypatch.setattr(products, "HELD", held)
    rng = np.random.default_rng(5)
    left, right = (np.unique(rng.integers(0, n, (400, 2)), axis=0) for n in (150, 150))
    one = (left[:, 0], left[:, 1], rng.random(len(left)), np.ones(len(left), int), right[:, 0], right[:, 1], rng.random(len(right)), np.ones(len(right), int))
    paths = defaultdict(list)
    for x, v, a in zip(*one[:3]):
        for u, y, b in zip(*one[4:7]):
            if u == v:
                paths[x, y].append(a * b)
    gone = [k for k in paths if sum(k) % 3 == 0]
    off = np.array([k[0] for k in gone]), np.array([k[1] for k in gone]), np.array([-paths[k][0] for k in gone]), np.full(len(gone), -1)
    graph_ = products.Graph([one], off, 150, 150, 150)
    want = {k: sum(v[k in gone :]) for k, v in paths.items() if len(v) > (k in gone)}
    got, counted = {}, 0
    for a, b in products._cut(graph_.made, 150):
        where, w, n = graph_.pairs(a, b)
        got |= dict(zip(zip((where // 150 + a).tolist(), (where % 150).tolist()), w.tolist()))
        counted += graph_.pairs(a, b, False)[0].size
    assert got.keys() == want.keys() and counted == len(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert abs(graph_.total() - sum(want.values())) < 1e-9


def test_blocks_hold_few_rows():
    for left, right, met in ((10, 10, 10), (1_600_000, 78_000_000, 2 * 10**9), (10**8, 10**3, 10**10), (10**7, 10**7, 10**9)):
        nx, ny = products.blocks(left, right, met)
        assert left / nx + right / ny <= products.BLOCK_ROWS
        assert nx * ny >= met / products.BLOCK_PRODUCTS


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """Many blocks, several graphs; nothing is summed by pair of ends after the blocks."""
    monkeypatch.setattr(products, "BLOCK_PRODUCTS", 60)
    rnd = random.Random(7)
    two = [term(rnd, 30, 10, 30, 60) for _ in range(2)]
    side = lambda k, sign: spark.createDataFrame([(g, p, q, w, sign) for g, t in enumerate(two) for (p, q), w in t[k].items()], "perm int, p string, q string, w double, n long")
    found = products.summed([(side(0, 1), side(1, 1), None), (None, None, side(2, -1))], ("perm",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert found.rdd.getNumPartitions() > 4
    got = {(r.perm, r.a, r.b): (r.n, round(r.w, 9)) for r in found.collect()}
    assert got == {(g, *k): v for g, t in enumerate(two) for k, v in brute([t]).items()}
    plan = QUERIES["g08_dwpc_shared_therapeutic"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_few_products_are_dealt_to_all_cores(spark, monkeypatch):
    """What one block could hold isn't one task, so neither is what follows the pairs."""
    monkeypatch.setattr(products, "LEAST_PRODUCTS", 50)
    rows = spark.createDataFrame([(k, k % 7, 1.0, 1) for k in range(300)], "p long, q long, w double, n long")
    assert products.summed([(rows, rows.select(F.col("q").alias("p"), F.col("p").alias("q"), "w", "n"), None)]).rdd.getNumPartitions() >= 16


def test_reach_adds_up(spark):
    e = spark.createDataFrame([("INDICATED_FOR", f"d{a}", f"c{(a * b) % 7}") for a in range(8) for b in range(1, 4)], "rel string, src string, dst string").distinct()
    want = defaultdict(lambda: np.zeros(3))
    for r in graph.dwpc(e, "Di>CO<iDi>CO", method="direct").collect():
        want[r.source_id] += (1, r.path_count, r.dwpc)
    got = {r.source_id: (r.pairs, r.path_count, r.dwpc) for r in graph.reach(e, "Di>CO<iDi>CO").collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_nearest_by_brute_force(spark, monkeypatch):
    """Several blocks of both sides; copies, a null vector, one holding null, one too short; no pair of vectors is a row of a join."""
    from linkweave.operators import links

    monkeypatch.setattr(links, "MET", 30)
    rnd = np.random.default_rng(3)
    v = {k: [float(x) for x in rnd.integers(-3, 4, 6)] for k in range(200)}
    v |= {k: [1.0, 2.0, 0.0, 0.0, 1.0, 1.0] for k in range(200, 260)} | {260: None, 261: [1.0, None, 0.0, 0.0, 0.0, 0.0], 262: [1.0]}
    rows = spark.createDataFrame(list(v.items()), "vec_id long, v array<double>").where("v is null or size(v) < 6 or exists(v, x -> x is null or x <> 0)")
    ids = sorted(r.vec_id for r in rows.collect())
    asked = rows.where("vec_id % 5 = 0")
    found = links.nearest(rows, asked, 5, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.item, r.rank): (r.other, None if r.cosine is None else round(r.cosine, 9)) for r in found.collect()}
    want = {}
    for item in (k for k in ids if k % 5 == 0):
        near = []
        for other in ids:
            a, b = v[item], v[other]
            if other != item:
                ok = a is not None and b is not None and len(a) == len(b) and None not in a + b
                near.append((-round(float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 9) if ok else 9, other))
        for rank, (c, other) in enumerate(sorted(near)[:5], 1):
            want[item, rank] = other, None if c == 9 else -c
    assert got == want


@pytest.mark.parametrize("metapath", ["Di>CO", "Dt>PRa>CO", "Dt>PR<tDi>CO", "Di>CO<aPRa>CO", "Dt>PRa>CO<aPRa>CO"])
def test_paths_between_pairs(spark, metapath):
    """Only paths of the asked pairs are listed, and the whole graph's are never joined first."""
    rnd = random.Random(5)
    some = {(r, f"{a}{rnd.randrange(6)}", f"{b}{rnd.randrange(6)}") for r, a, b in (("INDICATED_FOR", "d", "c"), ("TARGETS", "d", "p"), ("ASSOCIATED_WITH", "p", "c")) for _ in range(16)}
    e = spark.createDataFrame(sorted(some), "rel string, src string, dst string")
    nodes = spark.createDataFrame([(k, f"{x}{i}", f"{k} {i}") for k, x in (("Drug", "d"), ("Condition", "c"), ("Protein", "p")) for i in range(5)], "kind string, id string, name string")
    n = len(graph.parse_metapath(metapath))
    places = [f"n{k}" for k in range(n + 1)]
    want = [r for r in graph.paths(e, metapath).collect()]
    keep = sorted({(r["n0"], r[f"n{n}"]) for r in want})[::2]
    mine = spark.createDataFrame([(*k, 7) for k in keep], f"n0 string, n{n} string, seven int")
    got = graph.paths_between(e, metapath, mine, nodes).collect()
    flat = lambda rows: sorted((*(r[p] for p in places), round(r["weight"], 9)) for r in rows)
    assert flat(got) == flat([r for r in want if (r["n0"], r[f"n{n}"]) in keep])
    kind = {"d": "Drug", "c": "Condition", "p": "Protein"}
    for r in got:
        assert r["seven"] == 7
        assert all(r[f"name{k}"] == (None if r[p][1] == "5" else f"{kind[r[p][0]]} {r[p][1]}") for k, p in enumerate(places))
