"""Queries of the study layer: datasets, splits and experiments, features, curves and model outputs."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from linkweave.operators import datasets, features, links, metrics, recommend
from linkweave.sources import readers
from linkweave.tables import written

from .catalogue import _METRIC_SQL, _PAIRS, _RANKED, _RATE_SQL, _SCORES, _base, _more, _ratings, _score_rows, draw_sql
from .fixtures import edges, edges_sql, relation, table
from .registry import query, r6, rounded

# ---------------------------------------------------------------- datasets

_BASE = f"WITH {edges_sql(['INDICATED_FOR'])}, base AS (SELECT src AS item, dst AS user FROM edges)"


def _parts(s, d):
    return table(s, d, "part").select(F.col("p_partkey").cast("string").alias("item"))


def _customers(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("user"))


@query("m03_from_pairs", _BASE + " SELECT item, user, 1 AS rating FROM base")
def _(s, d):
    return datasets.from_pairs(_base(s, d).unionByName(_base(s, d)), _parts(s, d), _customers(s, d))


@query("m03_unknown_ids", f"WITH {edges_sql(['TARGETS'])} SELECT DISTINCT 'user' AS side, dst AS id FROM edges WHERE CAST(dst AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(s, d):
    pairs = relation(s, d, "TARGETS").select(F.col("src").alias("item"), F.col("dst").alias("user"))
    even = table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("user"))
    return datasets.unknown_ids(pairs, _parts(s, d), even)


@query("m04_mask", _BASE + ", i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS r FROM (SELECT DISTINCT item FROM base)), u AS (SELECT user, row_number() OVER (ORDER BY user) - 1 AS c FROM (SELECT DISTINCT user FROM base)) SELECT r AS row, c AS column, 2 AS value FROM base JOIN i USING (item) JOIN u USING (user)")
def _(s, d):
    b = _base(s, d)
    n = datasets.numbered(b, b.select("item"), b.select("user"))
    one = b.agg(F.count_distinct("item").alias("i"), F.count_distinct("user").alias("u")).first()
    return datasets.mask(n.unionByName(n), one.i, one.u).withColumn("value", F.col("value").cast("int"))


def _dataset(s, d):
    """Ratings of events, one a pair, null for views; keys have the numbers of parts and users those of customers as features."""
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).when(F.col("event_type") != "view", 0)
    r = table(s, d, "events").select(F.get_json_object("props", "$.k").alias("item"), F.col("user_id").cast("string").alias("user"), F.col("event_id"), kind.alias("rating"))
    r = r.groupBy("item", "user").agg(F.max_by("rating", "event_id").alias("rating"))
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.expr("stack(2, 'size', if(p_size < 10, null, cast(p_size as double)), 'price', p_retailprice) as (feature, value)"))
    c = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr("stack(2, 'balance', c_acctbal, 'price', if(c_custkey % 3 = 0, double('nan'), cast(c_custkey as double))) as (feature, value)"))
    return datasets.build(r, p, c)


_DATASET = (
    "WITH e AS (SELECT json_extract_string(props, '$.k') AS item, CAST(user_id AS VARCHAR) AS user, event_id, CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'error' THEN -1 WHEN event_type <> 'view' THEN 0 END AS rating FROM events), "
    "l AS (SELECT item, user, max(event_id) AS event_id FROM e GROUP BY 1, 2), a AS (SELECT e.* FROM e JOIN l USING (item, user, event_id)), r AS (SELECT * FROM a WHERE rating IS NOT NULL), "
    "p AS (SELECT * FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT item FROM a)), c AS (SELECT * FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT user FROM a))"
)


@query("a15_dataset_summary", _DATASET + ", n AS (SELECT COUNT(DISTINCT item) AS i, COUNT(DISTINCT user) AS u, COUNT(DISTINCT item) FILTER (rating <> 0) AS ik, COUNT(DISTINCT user) FILTER (rating <> 0) AS uk, COUNT(*) FILTER (rating = 1) AS p, COUNT(*) FILTER (rating = -1) AS m, COUNT(*) AS seen FROM r) SELECT i AS items, u AS users, ik AS items_known, uk AS users_known, p AS positive, m AS negative, i * u - p - m AS unlabelled, i * u - seen AS unavailable, round(100.0 * (p + m) / (i * u), 6) AS density, round(100.0 * (p + m) / (ik * uk), 6) AS density_known, 2 AS item_features, round((SELECT 50.0 * COUNT(*) FILTER (p_size < 10) / COUNT(*) FROM p), 6) AS item_missing, 2 AS user_features, round((SELECT 50.0 * COUNT(*) FILTER (c_custkey % 3 = 0) / COUNT(*) FROM c), 6) AS user_missing FROM n")
def _(s, d):
    one = datasets.summary(_dataset(s, d))
    return one.withColumns({c: r6(c) for c in ("density", "density_known", "item_missing", "user_missing")} | {c: F.col(c).cast("int") for c in ("item_features", "user_features")})


@query("m05_aligned_users", _DATASET + " SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE round(CAST(c_custkey AS DOUBLE), 6) END AS value FROM c")
def _(s, d):
    rows = _dataset(s, d).users.where("feature = 'price'")
    return rows.select("id", F.when(F.isnan("value"), None).otherwise(r6("value")).alias("value"))


@query("m05_same_features", "SELECT DISTINCT 'price' AS feature, item_side FROM (SELECT 'item' AS item_side UNION ALL SELECT 'user')")
def _(s, d):
    one = _dataset(s, d)
    same = datasets.build(one.ratings, one.items, one.users, same_features=True)
    return same.items.select("feature", F.lit("item").alias("item_side")).union(same.users.select("feature", F.lit("user"))).distinct()


@query("a22_profile", f"WITH {_RATE_SQL} SELECT COUNT(DISTINCT item) AS items, COUNT(DISTINCT user) AS users, COUNT(*) FILTER (rating = 1) AS positive, COUNT(*) FILTER (rating = -1) AS negative, COUNT(DISTINCT item) * COUNT(DISTINCT user) - COUNT(*) FILTER (rating <> 0) AS unknown FROM r WHERE rating <> 0")
def _(s, d):
    return datasets.profile(_ratings(s, d).where("rating <> 0"))


@query("a14_item_sums", f"WITH {_RATE_SQL} SELECT item, CAST(sum(CASE WHEN rating <> 0 THEN rating END) AS BIGINT) AS total FROM r GROUP BY item")
def _(s, d):
    return _ratings(s, d).groupBy("item").agg(F.sum(F.when(F.col("rating") != 0, F.col("rating"))).alias("total"))


@query("a25_confidence", f"WITH {_RATE_SQL} SELECT round((COUNT(DISTINCT item) * COUNT(DISTINCT user) - COUNT(*) FILTER (n <> 0)) * 1.0 / sum(n), 6) AS alpha FROM (SELECT item, user, COUNT(*) AS n FROM r GROUP BY 1, 2)")
def _(s, d):
    counts = _ratings(s, d).groupBy("user", "item").agg(F.count("*").cast("double").alias("count"))
    return s.range(1).select(r6(F.lit(readers.confidence_weight(counts))).alias("alpha"))


@query("a20_zero_share", f"WITH {edges_sql(['ASSOCIATED_WITH'])}, s AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM edges x JOIN edges y ON x.src = y.src) SELECT round(1 - (SELECT COUNT(*) FROM s) * 1.0 / (COUNT(DISTINCT dst) * COUNT(DISTINCT dst)), 6) AS zero_share FROM edges")
def _(s, d):
    e = relation(s, d, "ASSOCIATED_WITH").select(F.col("dst").alias("id"), F.col("src").alias("feature"))
    cells = links.jaccard(e).agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(2)).alias("nnz"))
    n = e.agg(F.count_distinct("id").alias("n"))
    return cells.join(F.broadcast(n)).select(r6(1 - F.col("nnz") / (F.col("n") * F.col("n"))).alias("zero_share"))  # one row each


# ---------------------------------------------------------------- splits and experiments

_EXPS = 3
_SPLITS = (
    f"WITH {_PAIRS}, pos AS (SELECT 'baseline' AS dataset, item, user FROM base UNION ALL SELECT 'augmented', item, user FROM (SELECT * FROM base UNION SELECT * FROM more)), "
    "every AS (SELECT DISTINCT item, user FROM pos), items AS (SELECT DISTINCT src AS item FROM edges), "
    f"b AS (SELECT CAST(x AS INT) AS exp, item, user, md5(x || '|' || item || '|' || user) AS k FROM base, range({_EXPS}) t(x)), "
    "f AS (SELECT *, row_number() OVER (PARTITION BY exp, item ORDER BY k, item, user) AS ri, row_number() OVER (PARTITION BY exp, user ORDER BY k, item, user) AS ru, COUNT(*) OVER (PARTITION BY exp, user) AS n FROM b), "
    "q AS (SELECT *, row_number() OVER (PARTITION BY exp, user ORDER BY k, item) AS q FROM f WHERE ri > 1 AND ru > 1), "
    "test AS (SELECT exp, item, user FROM (SELECT *, row_number() OVER (PARTITION BY exp ORDER BY k, item, user) AS z FROM q WHERE q <= greatest(1, round_even(n * 0.2, 0))) WHERE z <= (SELECT floor(COUNT(*) * 0.2) FROM base)), "
    "tw AS (SELECT DISTINCT exp, user, 100 AS need FROM test), "
    + draw_sql("tneg", "tw", "items", "every", "test", ("exp",))
    + f", lft AS (SELECT e.exp, p.* FROM pos p CROSS JOIN (SELECT CAST(x AS INT) AS exp FROM range({_EXPS}) t(x)) e LEFT JOIN test t ON t.exp = e.exp AND t.item = p.item AND t.user = p.user WHERE t.exp IS NULL), "
    "nw AS (SELECT exp, dataset, user, COUNT(*) * 5 AS need FROM lft GROUP BY 1, 2, 3), "
    f"hd AS (SELECT e.exp, p.dataset, p.item, p.user FROM pos p CROSS JOIN (SELECT CAST(x AS INT) AS exp FROM range({_EXPS}) t(x)) e UNION ALL SELECT exp, n.dataset, item, user FROM tneg CROSS JOIN (SELECT DISTINCT dataset FROM pos) n), "
    + draw_sql("dneg", "nw", "items", "hd", "train", ("exp", "dataset"), ("exp", "dataset"))
    + ", splits AS (SELECT exp, 'test' AS \"set\", 'baseline' AS dataset, item, user, 1 AS label FROM test UNION ALL SELECT exp, 'test', 'baseline', item, user, 0 FROM tneg UNION ALL SELECT exp, 'train', dataset, item, user, 1 FROM lft UNION ALL SELECT exp, 'train', dataset, item, user, 0 FROM dneg)"
)


def _positives(s, d):
    more = links.augmented(_base(s, d), _more(s, d)).select("item", "user")
    return _base(s, d).withColumn("dataset", F.lit("baseline")).unionByName(more.withColumn("dataset", F.lit("augmented"))).select("dataset", "item", "user")


def _splits(s, d):
    return datasets.precompute("baseline", _positives(s, d), _items(s, d), _EXPS)


def _items(s, d):
    return edges(s, d, ["INDICATED_FOR", "TARGETS", "ASSOCIATED_WITH"]).select(F.col("src").alias("item")).distinct()


def _first_split(s, d):
    """The first experiment of _splits() as far as the baseline trains and tests on it; experiments don't depend on each other."""
    positives = written(_positives(s, d), "positives")
    return datasets.precompute("baseline", positives, _items(s, d), 1).where("set = 'test' or dataset = 'baseline'")


@query("r04_experiment_splits", _SPLITS + ' SELECT exp, "set", dataset, item, user, label FROM splits')
def _(s, d):
    return _splits(s, d)


@query("r01_test_negatives", _SPLITS + " SELECT exp, item, user FROM tneg")
def _(s, d):
    return _splits(s, d).where("set = 'test' and label = 0").select("exp", "item", "user")


@query("j26_negatives_in_no_dataset", _SPLITS + " SELECT COUNT(*) AS negatives, COUNT(*) FILTER ((item, user) IN (SELECT (item, user) FROM every)) AS positive_somewhere FROM tneg")
def _(s, d):
    wrong = _splits(s, d).where("set = 'test' and label = 0").select("item", "user")
    held = _positives(s, d).select("item", "user").distinct().withColumn("held", F.lit(1))
    return wrong.join(held, ["item", "user"], "left").agg(F.count("*").alias("negatives"), F.count("held").alias("positive_somewhere"))


@query("m10_rebuilt", _SPLITS + ", s AS (SELECT DISTINCT exp, \"set\", dataset, item, user FROM splits WHERE \"set\" = 'test' OR dataset <> 'augmented') SELECT s.exp, s.\"set\", s.dataset, COUNT(*) AS pairs, COUNT(p.item) AS positive FROM s LEFT JOIN pos p ON p.dataset = s.dataset AND p.item = s.item AND p.user = s.user GROUP BY 1, 2, 3")
def _(s, d):
    rows = datasets.rebuild(_splits(s, d), _positives(s, d).withColumn("rating", F.lit(1)), "baseline", skip=("augmented",))
    return rows.groupBy("exp", "set", "dataset").agg(F.count("*").alias("pairs"), F.sum("rating").alias("positive"))


def _fitted(model, params, s, d):
    """Ranking metrics by user of a model that was fitted on one experiment's training set, on its test set."""
    one = written(_first_split(s, d), "splits")
    train = one.where("set = 'train' and dataset = 'baseline'").select("item", "user", F.col("label").alias("rating"))
    test = one.where("set = 'test'").select("item", "user", (F.col("label") > 0).cast("int").alias("truth"))
    fitted = recommend.MODELS[model](**params).fit(train, 1)
    return metrics.per_user(fitted.predict_proba(test.select("item", "user")).join(test, ["item", "user"]), 10)


for _name, _model, _params in (("l04_als", "ALS", {"iterations": 5}), ("l05_bpr", "BPR", {"iterations": 60}), ("l06_logistic_mf", "LMF", {"iterations": 8})):
    query(_name, None)(partial(_fitted, _model, _params))


# ---------------------------------------------------------------- features

_LONG = "x AS (SELECT vec_id, i - 1 AS pos, CASE WHEN (vec_id + i) % 7 = 0 THEN NULL WHEN (vec_id * 31 + i) % 97 = 0 THEN 10 WHEN (vec_id * 31 + i) % 97 = 1 THEN -10 ELSE CAST(embedding[i] AS DOUBLE) END AS v FROM embeddings, range(1, 65) t(i))"


def _long(s, d):
    """All 64 components of all vectors, some of them missing or infinite."""
    x = table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("feature", "v"))
    k, i = F.col("id"), F.col("feature") + 1
    odd = F.when((k + i) % 7 == 0, float("nan")).when((k * 31 + i) % 97 == 0, float("inf")).when((k * 31 + i) % 97 == 1, float("-inf")).otherwise(F.col("v"))
    return x.select("id", "feature", odd.alias("value"))


_SCALED = "m AS (SELECT pos, avg(v) AS m, sqrt(var_pop(v) * COUNT(v) / COUNT(*)) AS sd FROM x GROUP BY 1)"


@query("l08_scaler", f"WITH {_LONG}, {_SCALED} SELECT vec_id AS id, CAST(pos AS INT) AS feature, round((COALESCE(v, m) - m) / sd, 6) + 0.0 AS value FROM x JOIN m USING (pos)")
def _(s, d):
    return features.Scaler(10.0, -10.0).fit_transform(_long(s, d)).withColumn("value", r6("value") + 0.0)


@query("l08_scaler_subset", f"WITH {_LONG}, t AS (SELECT pos FROM x GROUP BY 1 ORDER BY var_pop(v) DESC, pos LIMIT 8), y AS (SELECT * FROM x JOIN t USING (pos)), {_SCALED.replace('FROM x', 'FROM y')} SELECT vec_id AS id, CAST(pos AS INT) AS feature, round((COALESCE(v, m) - m) / sd, 6) + 0.0 AS value FROM y JOIN m USING (pos)")
def _(s, d):
    return features.Scaler(10.0, -10.0).fit_transform(_long(s, d), subset=8).withColumn("value", r6("value") + 0.0)


@query("a21_variances", f"WITH {_LONG.replace('THEN 10 ', 'THEN NULL ').replace('THEN -10 ', 'THEN NULL ')} SELECT CAST(pos AS INT) AS feature, round(CASE WHEN pos % 8 = 0 THEN 0 ELSE var_pop(v) END, 6) AS variance FROM x GROUP BY pos")
def _(s, d):
    known = _long(s, d).withColumn("value", F.when(F.abs("value") == float("inf"), None).otherwise(F.col("value")))
    gone = known.withColumn("value", F.when(F.col("feature") % 8 == 0, None).otherwise(F.col("value")))
    return features.variances(gone).withColumn("variance", r6("variance"))


_SIDES = (
    f"WITH {edges_sql(['INDICATED_FOR'])}, i AS (SELECT CAST(p_partkey AS VARCHAR) AS item, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS price FROM part), "
    "u AS (SELECT CAST(c_custkey AS VARCHAR) AS user, c_acctbal AS price, CAST(c_nationkey AS DOUBLE) AS size FROM customer)"
)


def _sides(s, d):
    i = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.expr("stack(2, 'price', if(p_partkey % 5 <> 0, p_retailprice, null), 'size', cast(p_size as double)) as (feature, value)"))
    u = table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.expr("stack(2, 'price', c_acctbal, 'size', cast(c_nationkey as double)) as (feature, value)"))
    return _base(s, d), i, u


def _six(column):
    return F.transform(column, lambda v: F.round(v, 6) + 0.0)


@query("l09_standardised", _SIDES + ", a AS (SELECT avg(price) AS pm, sqrt(var_pop(price) * COUNT(price) / COUNT(*)) AS ps, avg(size) AS sm, stddev_pop(size) AS ss FROM i), b AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps, avg(size) AS sm, stddev_pop(size) AS ss FROM u) SELECT src AS item, dst AS user, [round((COALESCE(i.price, a.pm) - a.pm) / a.ps, 6) + 0.0, round((i.size - a.sm) / a.ss, 6) + 0.0, round((u.price - b.pm) / b.ps, 6) + 0.0, round((u.size - b.sm) / b.ss, 6) + 0.0] AS x FROM edges JOIN i ON src = item JOIN u ON dst = user, a, b")
def _(s, d):
    return features.prepare("meanimputation_standardize", *_sides(s, d)).select("item", "user", _six("x").alias("x"))


@query("j24_joined_vectors", _SIDES + " SELECT src AS item, dst AS user, [round(COALESCE(i.price, 0), 6), i.size, round(u.price, 6), u.size] AS x FROM edges JOIN i ON src = item JOIN u ON dst = user")
def _(s, d):
    pairs, i, u = _sides(s, d)
    return features.joined_vectors(pairs, i, u).select("item", "user", F.transform("x", lambda v: rounded(F.coalesce(v, F.lit(0.0)), 6)).alias("x"))


for _op in ("*", "+", "-"):
    query(f"l10_same_features_{ {'*': 'product', '+': 'sum', '-': 'difference'}[_op] }", _SIDES + f" SELECT src AS item, dst AS user, [round(COALESCE(i.price, 1) {_op} u.price, 4), round(i.size {_op} u.size, 4)] AS x FROM edges JOIN i ON src = item JOIN u ON dst = user")(
        lambda s, d, op=_op: (lambda p, i, u: features.prepare("same_feature_preprocessing", p, i.withColumn("value", F.coalesce("value", F.lit(1.0))), u, operator=op))(*_sides(s, d)).select("item", "user", F.transform("x", lambda v: rounded(v, 4)).alias("x"))
    )


@query("l14_correlation", _SCORES + ", o AS (SELECT user, item, max(score) AS score FROM sc GROUP BY 1, 2) SELECT round(corr(score, sqrt(score) + CAST(item AS DOUBLE) / 1e6), 6) AS correlation FROM o")
def _(s, d):
    a = _score_rows(s, d).groupBy("item", "user").agg(F.max("score").alias("score"))
    b = a.withColumn("score", F.sqrt("score") + F.col("item").cast("double") / 1e6)
    return features.correlation(a, b).select(r6("correlation").alias("correlation"))


# ---------------------------------------------------------------- model outputs, metrics, curves

@query("w04_threshold", _SCORES + " SELECT user, item, truth, round(score, 6) AS score FROM sc WHERE score >= 0.9")
def _(s, d):
    return links.recommend(_score_rows(s, d), threshold=0.9).withColumn("score", r6("score"))


@query("l01_recommend", _SCORES + " SELECT user, item, truth, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, user, item LIMIT 50")
def _(s, d):
    return links.recommend(_score_rows(s, d), k=50, threshold=0.99).withColumn("score", r6("score"))


@query("a24_class_counts", _SCORES + " SELECT COUNT(*) AS pairs, COUNT(DISTINCT item) AS items, COUNT(DISTINCT user) AS users, COUNT(*) FILTER (score > 0.5) AS positive, COUNT(*) FILTER (score <= 0.5) AS negative FROM sc")
def _(s, d):
    return metrics.class_counts(metrics.classify(_score_rows(s, d)))


def _column(column, s, d):
    return metrics.per_user(_score_rows(s, d)).select("user", r6(column).alias(column))


_F_SQL = "(CASE WHEN sum(truth) + COUNT(*) FILTER (score > 0.5) > 0 THEN sum(truth) * 2.0 * COUNT(*) FILTER (truth = 1 AND score > 0.5) / (sum(truth) + COUNT(*) FILTER (score > 0.5)) ELSE 0 END) / COUNT(*)"
_DCG1_SQL = "sum(CASE WHEN rank <= 10 AND truth = 1 THEN 1.0 / log2(rank + 1) ELSE 0 END)"
query("e13_f_beta", _RANKED + f" SELECT user, round({_F_SQL}, 6) AS fscore FROM r GROUP BY user")(partial(_column, "fscore"))
query("e09_dcg_method_1", _RANKED + f" SELECT user, round({_DCG1_SQL}, 6) AS dcg1_k FROM r GROUP BY user")(partial(_column, "dcg1_k"))


@query("e17_ignored_users", _SCORES + ", t AS (SELECT user, COUNT(DISTINCT truth) AS n FROM sc GROUP BY 1) SELECT COUNT(*) AS users, COUNT(*) FILTER (n = 1) AS ignored FROM t")
def _(s, d):
    return metrics.ignored_users(_score_rows(s, d))


_HITS = ", h AS (SELECT *, sum(truth) OVER (PARTITION BY user ORDER BY rank) AS hits FROM r)"
_EACH = {v[0]: v[1] for v in _METRIC_SQL.values()} | {"fscore": _F_SQL, "dcg1_k": _DCG1_SQL, "map": "avg(hits / rank) FILTER (truth = 1)", "err": "COALESCE(sum(pow(0.75, hits - 1) * 0.25 / rank) FILTER (truth = 1 AND rank <= 10), 0)"}
_SUMMARY = (
    _RANKED + _HITS + ", m AS (SELECT user, " + ", ".join(f"{e} AS {c}" for c, e in _EACH.items()) + " FROM h GROUP BY user), "
    "auc AS (SELECT a.user, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM r a JOIN r b ON a.user = b.user AND a.truth = 1 AND b.truth = 0 GROUP BY 1) "
    + " UNION ALL ".join(f"SELECT '{c}' AS metric, round(avg({c}), 6) AS average, round(stddev_pop({c}), 6) AS standard_deviation FROM {'auc' if c == 'auc' else 'm'}" for c in (*_EACH, "auc"))
    + " UNION ALL SELECT 'arguments (k, beta)', 10.0, 1.0"
)


@query("e17_summary", _SUMMARY)
def _(s, d):
    m = metrics.summary(metrics.per_user(_score_rows(s, d), 10, 1.0), 10, 1.0)
    return m.withColumns({"average": r6("average"), "standard_deviation": r6("standard_deviation")})


@query("e17_rank_on_prediction", _SCORES + ", s2 AS (SELECT user, item, truth, CASE WHEN score <= 0.5 THEN -1.0 ELSE 1.0 END AS score FROM sc), n AS (SELECT *, COUNT(*) OVER (PARTITION BY user) AS n, sum(truth) OVER (PARTITION BY user) AS pos FROM s2), r AS (SELECT * FROM n WHERE pos > 0 AND pos < n) SELECT a.user, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM r a JOIN r b ON a.user = b.user AND a.truth = 1 AND b.truth = 0 GROUP BY 1")
def _(s, d):
    return metrics.per_user(_score_rows(s, d), rank_on="prediction").select("user", r6("auc").alias("auc"))


_CURVE = ", g AS (SELECT user, score, sum(truth) AS t, sum(1 - truth) AS f FROM sc GROUP BY 1, 2), c AS (SELECT user, score, sum(t) OVER o AS ct, sum(f) OVER o AS cf, sum(t) OVER (PARTITION BY user) AS pt, sum(f) OVER (PARTITION BY user) AS pf FROM g WINDOW o AS (PARTITION BY user ORDER BY score DESC)), k AS (SELECT * FROM c WHERE pt > 0 AND pf > 0)"


@query("w11_roc_grid", _SCORES + _CURVE + ", z AS (SELECT user, ct, cf, pt, pf FROM k UNION ALL SELECT DISTINCT user, 0, 0, pt, pf FROM k), w AS (SELECT user, CAST(i AS INT) AS step, pt, pf, max(cf) FILTER (cf * 100 <= i * pf) AS lo, min(cf) FILTER (cf * 100 > i * pf) AS hi FROM z, range(101) t(i) GROUP BY ALL), e AS (SELECT w.*, (SELECT max(ct) FROM z WHERE z.user = w.user AND z.cf = w.lo) AS clo, (SELECT min(ct) FROM z WHERE z.user = w.user AND z.cf = w.hi) AS chi FROM w) SELECT step, round(avg(v), 6) AS average, round(stddev_pop(v), 6) AS standard_deviation FROM (SELECT step, CASE WHEN step = 0 THEN 0 WHEN hi IS NULL THEN clo * 1.0 / pt ELSE (clo + (chi - clo) * (step * pf / 100.0 - lo) / (hi - lo)) / pt END AS v FROM e) GROUP BY 1")
def _(s, d):
    m = metrics.mean_curve(metrics.roc_grid(_score_rows(s, d)), "tpr")
    return m.withColumns({"average": r6("average"), "standard_deviation": r6("standard_deviation")})


@query("e16_pr_grid", _SCORES + _CURVE + " SELECT user, CAST(i AS INT) AS step, round(COALESCE(max(ct * 1.0 / pt) FILTER (ct * 100 >= i * (ct + cf)), 0), 6) AS recall FROM k, range(101) t(i) GROUP BY user, i")
def _(s, d):
    return metrics.pr_grid(_score_rows(s, d)).withColumn("recall", r6("recall"))
