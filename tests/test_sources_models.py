"""Archives read by many tasks, level-5 matrices, public sets, block-trained recommenders and studies that go on."""

import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkweave.operators import metrics, recommend
from linkweave.sources import matlab, public_sets, readers
from linkweave.tables import spread

# ---------------------------------------------------------------- archives


def test_one_archive_is_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "z.zip"
    texts = {f"d/{k:03d}.xml": f"<a>{k}</a>é" * (k * 50) for k in range(60)} | {"note.txt": "no"}
    with zipfile.ZipFile(path, "w") as z:
        for k, (name, text) in enumerate(texts.items()):
            z.writestr(name, text, zipfile.ZIP_STORED if k % 3 else zipfile.ZIP_DEFLATED)
    rows = readers.zipped_texts(spark, str(path), ".xml", span=50_000).withColumn("task", F.spark_partition_id()).collect()
    assert [(r.name, r.text) for r in sorted(rows, key=lambda r: r.pos)] == [(n, t) for n, t in texts.items() if n.endswith(".xml")]
    assert len({r.task for r in rows}) > 1
    few = readers.zipped_texts(spark, str(path), max_records=5).collect()
    assert sorted((r.pos, r.name) for r in few) == list(enumerate(list(texts)[:5]))
    (tmp_path / "bad.zip").write_bytes(path.read_bytes().replace(b"<a>1</a>", b"<a>7</a>", 1))
    with pytest.raises(Exception, match="damaged"):
        readers.zipped_texts(spark, str(tmp_path / "bad.zip")).collect()


# ---------------------------------------------------------------- matrices


def element(kind, data, order="<", small=True):
    if small and 0 < len(data) <= 4:
        return struct.pack(order + "I", len(data) << 16 | kind) + data.ljust(4, b"\0")
    return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def matrix(name, cls, shape, *parts, order="<"):
    flags = element(6, struct.pack(order + "II", cls, 0), order)
    dims = element(5, struct.pack(order + f"{len(shape)}i", *shape), order)
    return element(14, flags + dims + element(1, name.encode(), order) + b"".join(parts), order)


def packed(data):
    z = zlib.compress(data)
    return struct.pack("<II", 15, len(z)) + z


def mat_file(path, *elements, order="<"):
    path.write_bytes(b"MATLAB 5.0".ljust(124) + struct.pack(order + "H", 0x0100) + (b"IM" if order == "<" else b"MI") + b"".join(elements))


def dense(name, a, order="<", code=9, kind="f8"):
    return matrix(name, 6, a.shape, element(code, a.T.astype(order + kind).tobytes(), order), order=order)


def test_level_5_matrices(spark, tmp_path):
    matlab.register(spark)
    a, b = np.arange(6.0).reshape(2, 3) / 4, np.array([[1.0, 0.0], [0.0, -1.0], [7.0, 2.0]])
    sparse = matrix("s", 5, (4, 3), element(5, struct.pack("<3i", 3, 0, 2)), element(5, struct.pack("<4i", 0, 1, 1, 3)), element(9, struct.pack("<3d", 5.0, 6.0, 7.0)))
    text = matrix("", 4, (1, 5), element(16, "naïve"[:5].encode()))
    wide = matrix("", 4, (2, 3), element(4, np.array([ord(c) for c in "adbecf"], "<u2").tobytes()))
    cell = matrix("names", 1, (2, 1), text, wide)
    mat_file(tmp_path / "m.mat", dense("a", a), packed(dense("bb", b, code=2, kind="u1")), sparse, packed(cell), packed(dense("long_name_here", np.ones((300, 400)))))
    got = spark.read.format("mat5").load(str(tmp_path / "m.mat"))
    assert got.rdd.getNumPartitions() == 5
    cells = {(r.variable, r.row, r.column): r.value for r in got.where("text is null").collect()}
    assert {(i, j): cells["a", i, j] for i in range(2) for j in range(3)} == {(i, j): a[i, j] for i in range(2) for j in range(3)}
    assert [cells["bb", i, j] for i in range(3) for j in range(2)] == [1, 0, 0, 255, 7, 2]  # stored as bytes
    assert {k[1:]: v for k, v in cells.items() if k[0] == "s"} == {(3, 0): 5.0, (0, 2): 6.0, (2, 2): 7.0}
    assert sum(v for k, v in cells.items() if k[0] == "long_name_here") == 120_000
    assert {(r.row, r.text) for r in got.where("variable = 'names'").collect()} == {(0, "naïve"), (1, "abc\ndef")}
    one = spark.read.format("mat5").option("variables", "a,none").load(str(tmp_path / "m.mat"))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 6
    assert spark.read.format("mat5").option("variables", "none").load(str(tmp_path / "m.mat")).count() == 0
    mat_file(tmp_path / "big.mat", dense("a", a, ">"), order=">")
    assert spark.read.format("mat5").load(str(tmp_path / "big.mat")).agg(F.sum("value")).first()[0] == a.sum()


def as_dict(df, *keys):
    return {tuple(str(r[k]) for k in keys): r[-1] for r in df.collect()}


def test_public_sets(spark, tmp_path):
    f = tmp_path
    (f / "ratings_mat.csv").write_text(",u1,u2\nd1,1,\nd2,-1,0\n")
    (f / "users.csv").write_text(",u1,u2\nfa,0.5,\nfb,1,2\n")
    (f / "items.csv").write_text(",d1,d2\n7,0.25,3\n")
    ratings, users, items = public_sets.load(spark, "TRANSCRIPT", str(f))
    assert as_dict(ratings, "item", "user") == {("d1", "u1"): 1, ("d1", "u2"): 0, ("d2", "u1"): -1, ("d2", "u2"): 0}
    assert as_dict(users, "id", "feature") == {("u1", "fa"): 0.5, ("u2", "fa"): 0.0, ("u1", "fb"): 1.0, ("u2", "fb"): 2.0}
    assert as_dict(items, "id", "feature") == {("d1", "7"): 0.25, ("d2", "7"): 3.0}
    # Diseases by drugs, lines end with a tab.
    (f / "DiDrAMat").write_text("1\t0\t0\t\n0\t1\t1\t\n")
    (f / "DiseaseSimMat").write_text("1 0.5\n0.5 1\n")
    (f / "DrugSimMat").write_text("1 0.1 0.2\n0.1 1 0.3\n0.2 0.3 1\n")
    (f / "DrugsName").write_text("a\nb\nc\n")
    (f / "DiseasesName").write_text("x\r\ny\r\n")
    ratings, users, items = public_sets.load(spark, "Gottlieb", str(f))
    assert as_dict(ratings, "item", "user") == {("a", "x"): 1, ("b", "x"): 0, ("c", "x"): 0, ("a", "y"): 0, ("b", "y"): 1, ("c", "y"): 1}
    assert as_dict(users, "id", "feature")["x", "y"] == 0.5 and as_dict(items, "id", "feature")["c", "a"] == 0.2
    (f / "DrDiMat").write_text("1\t0\t\n0\t1\t\n1\t1\t\n")
    ratings, users, items = public_sets.load(spark, "Cdataset_Aonly", str(f))
    assert as_dict(ratings, "item", "user")["c", "y"] == 1 and ratings.count() == 6 and users.count() == items.count() == 0
    (f / "DiDrA.txt").write_text("1\t0\t0\n0\t1\t1\n")
    (f / "DiseaseSim.txt").write_text("1\t0.5\n0.5\t1\n")
    (f / "DrugSim.txt").write_text("1\t0.1\t0.2\n0.1\t1\t0.3\n0.2\t0.3\t1\n")
    assert as_dict(public_sets.load(spark, "Cdataset", str(f))[0], "item", "user")["c", "y"] == 1
    assert as_dict(public_sets.load(spark, "DNdataset", str(f))[0], "item", "user")["2", "1"] == 1
    mat_file(f / "PREDICT.mat", *(packed(dense(v, a)) for v, a in (("predictAdMatdgc", np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 1.0]])), ("predictSimMatdg", np.eye(2)), ("predictSimMatdcChemical", np.eye(3)), ("predictSimMatdcDomain", np.eye(3) * 2), ("predictSimMatdcGo", np.eye(3) * 3))))
    ratings, users, items = public_sets.load(spark, "PREDICT_Gottlieb", str(f))
    assert as_dict(ratings, "item", "user")["drug3", "disease2"] == 1 and as_dict(users, "id", "feature")["disease1", "disease1"] == 1.0
    assert as_dict(items, "id", "feature")["drug2", "go-drug2"] == 3.0 and items.count() == 27
    mat_file(f / "DiDrMat.mat", dense("R_Wdr", np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 1.0]])))
    (f / "R_Wrname").write_text("a\nb\nc\n")
    (f / "R_Wdname").write_text("x\ny\n")
    assert as_dict(public_sets.load(spark, "indep", str(f))[0], "item", "user")["c", "y"] == 1
    (f / "drug_dis_mat.txt").write_text("\tp\tq\nd1\t1\t0\nd2\t0\t1\n")
    (f / "disease_similarity.txt").write_text("\tu1\tu2\nu1\t1\t0.5\nu2\t0.5\t1\n")
    (f / "drug_pubchem_mat.txt").write_text("\tc1\nd1\t1\nd9\t1\n")
    (f / "drug_target_domain_mat.txt").write_text("\tt1\nd2\t1\n")
    ratings, users, items = public_sets.load(spark, "LRSSL", str(f))
    assert as_dict(ratings, "item", "user") == {("d1", "u1"): 1, ("d1", "u2"): 0, ("d2", "u1"): 0, ("d2", "u2"): 1}
    assert as_dict(items, "id", "feature") == {("d1", "c1"): 1.0, ("d2", "c1"): 0.0, ("d1", "t1"): 0.0, ("d2", "t1"): 1.0}
    with pytest.raises(ValueError, match="unknown set"):
        public_sets.load(spark, "none", str(f))


# ---------------------------------------------------------------- recommenders


def low_rank(seed=0, items=60, users=40):
    """(item, user, rating) with structure, and whether a pair is held out."""
    rng = np.random.default_rng(seed)
    p = rng.standard_normal((items, 3)) @ rng.standard_normal((users, 3)).T
    liked = p > 1.2
    out = rng.random(p.shape) < 0.25
    return [(f"i{i}", f"u{u}", int(liked[i, u]), bool(out[i, u])) for i in range(items) for u in range(users)]


def dense_bpr(rows, p, seed):
    """Scores of plain stochastic pairwise ranking on a dense matrix."""
    rng = np.random.default_rng(seed)
    items, users = (sorted({r[k] for r in rows}) for k in (0, 1))
    m = np.zeros((len(items), len(users)))
    for i, u, rating, out in rows:
        m[items.index(i), users.index(u)] = rating and not out
    x, y = rng.standard_normal((len(items), p["factors"])) * 0.1, rng.standard_normal((len(users), p["factors"])) * 0.1
    for _ in range(p["iterations"]):
        for u in rng.permutation(len(users)):
            liked = np.nonzero(m[:, u])[0]
            j = rng.integers(0, len(items))
            if len(liked) and not m[j, u]:
                i = rng.choice(liked)
                g = 1 / (1 + np.exp((x[i] - x[j]) @ y[u]))
                di, dj, du = g * y[u] - p["reg"] * x[i], -g * y[u] - p["reg"] * x[j], g * (x[i] - x[j]) - p["reg"] * y[u]
                x[i], x[j], y[u] = x[i] + p["rate"] * di, x[j] + p["rate"] * dj, y[u] + p["rate"] * du
    return {(a, b): float(x[k] @ y[n]) for k, a in enumerate(items) for n, b in enumerate(users)}


def mean_auc(spark, rows, score):
    test = spark.createDataFrame([(u, i, r, score[i, u]) for i, u, r, out in rows if out], "user string, item string, truth int, score double")
    return metrics.per_user(test, 10).agg(F.avg("auc")).first()[0]


@pytest.mark.parametrize("blocks", [1, 3])
def test_bpr_in_strata_ranks_like_the_dense_fit(spark, blocks, monkeypatch):
    monkeypatch.setattr(recommend, "CELLS", 0)  # no bound on cells
    rows = low_rank(0, 120, 80)
    p = {"iterations": 400, "factors": 6, "rate": 0.1, "reg": 0.01}
    train = spark.createDataFrame([(i, u, r) for i, u, r, out in rows if not out] + [(i, u, 0) for i, u, r, out in rows if out], "item string, user string, rating int")
    model = recommend.BPR(**p, blocks=blocks, passes=100).fit(train, 3)
    got = {(r.item, r.user): r.score for r in model.predict_proba(train.select("item", "user")).collect()}
    dense_one = np.mean([mean_auc(spark, rows, dense_bpr(rows, p, s)) for s in range(2)])
    assert dense_one > 0.7 and mean_auc(spark, rows, got) > dense_one - 0.02


def test_logistic_factors_equal_the_dense_ascent(spark, monkeypatch):
    monkeypatch.setattr(recommend, "CELLS", 0)
    rows = low_rank(1, 30, 20)
    train = spark.createDataFrame([r[:3] for r in rows], "item string, user string, rating int")
    p = recommend.LogisticMF.defaults | {"iterations": 4, "blocks": 3}
    model = recommend.LogisticMF(iterations=4, blocks=3).fit(train, 5)
    got = {(r.item, r.user): r.score for r in model.predict_proba(train.select("item", "user")).collect()}
    items, users = (sorted({r[k] for r in rows}) for k in (0, 1))
    m = np.array([[next(r[2] for r in rows if r[0] == i and r[1] == u) for u in users] for i in items], float)
    c, k = m * ((m.size - m.sum()) / m.sum()), p["factors"]
    x = np.array([np.random.default_rng([5, 0, n]).standard_normal(k + 2) * 0.1 for n in range(len(items))])
    y = np.array([np.random.default_rng([5, 1, n]).standard_normal(k + 2) * 0.1 for n in range(len(users))])
    x[:, k + 1], y[:, k] = 1.0, 1.0
    sx, sy, likelihood = np.full_like(x, 1e-9), np.full_like(y, 1e-9), []
    for _ in range(p["iterations"]):
        for a, b, s, mat, held in ((y, x, sy, c.T, k), (x, y, sx, c, k + 1)):
            e = 1 / (1 + np.exp(-np.clip(a @ b.T, -30, 30)))
            g = mat @ b - ((1 + mat) * e) @ b - p["reg"] * a
            g[:, held] = 0
            s += g * g
            a += p["gamma"] * g / np.sqrt(s)
        z = np.clip(x @ y.T, -30, 30)
        likelihood.append((c * z - (1 + c) * np.log1p(np.exp(z))).sum() - p["reg"] / 2 * ((x**2).sum() + (y**2).sum()))
    assert all(abs(got[i, u] - x[a] @ y[b]) < 1e-6 for a, i in enumerate(items) for b, u in enumerate(users))
    assert np.allclose(model.likelihood, likelihood, rtol=1e-9)


def test_a_stopped_study_goes_on(spark, tmp_path, monkeypatch):
    rows = low_rank(2, 20, 12)
    splits = spark.createDataFrame([(e, "test" if out else "train", "base", i, u, r) for e in range(3) for i, u, r, out in rows], "exp int, set string, dataset string, item string, user string, rating int")
    calls = []

    class Counted(recommend.ALS):
        def fit(self, ratings, seed=0):
            calls.append(seed)
            if len(calls) == 3 and not done:
                raise RuntimeError("stopped")
            return super().fit(ratings, seed)

    monkeypatch.setitem(recommend.MODELS, "ALS", Counted)
    study, done = [{"model": "ALS", "dataset": "base", "runs": 3}], []
    params = {"ALS": {"iterations": 1, "factors": 2}}
    with pytest.raises(RuntimeError):
        recommend.run_experiments(splits, study, path=str(tmp_path / "s"), at_once=1, **params)
    assert calls == [0, 1, 2]
    done.append(True)
    found = recommend.run_experiments(splits, study, path=str(tmp_path / "s"), at_once=2, **params)
    assert calls == [0, 1, 2, 2]  # only what was missing
    assert {(r.model, r.dataset, r.experiment) for r in found.collect()} == {("ALS", "base", e) for e in range(3)}


def test_spread_tables_are_read_by_many_tasks(spark):
    one = spark.range(20_000).coalesce(1)
    dealt = spread(one)
    assert one.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() >= 4
    assert dealt.agg({"id": "sum"}).first()[0] == 20_000 * 19_999 // 2
    assert spread(one.limit(10)).count() == 10


def test_all_pairs_of_a_tile_count_as_negatives(monkeypatch):
    """Gradients and likelihoods of rows in pieces, far scores too, against the plain sums; no logarithm for each pair."""
    rng = np.random.default_rng(2)
    y, x = rng.standard_normal((150, 4)), rng.standard_normal((1100, 4))
    y[0], y[1] = 40.0, -40.0
    z = np.clip(y @ x.T, -30, 30)
    monkeypatch.delattr(np, "log1p")
    g, likely = recommend._negatives(y, x, True)
    assert np.allclose(g, -(1 / (1 + np.exp(-z))) @ x, rtol=1e-9)
    assert np.allclose(likely, -np.log(1 + np.exp(z)).sum(axis=1), rtol=1e-9)
    assert np.array_equal(recommend._negatives(y, x, False)[0], g) and not recommend._negatives(y, x, False)[1].any()
