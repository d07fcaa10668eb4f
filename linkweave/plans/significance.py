"""Queries of the significance study: permutations, nulls, p-values, results, explanations."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from linkweave.operators import graph, stats

from .catalogue import path_sql
from .fixtures import edges, edges_sql, nodes, nodes_sql, relation, table
from .registry import LIFT, query, r6, r6w

PERMUTATIONS, ROUNDS = 200, 5


def permute_sql(permutations: int, rounds: int, seed: int = 0) -> str:
    """CTEs ending in ids(id, i) and perms(perm, rel, s, d): the trades of graph.permute_coded, round by round, from edges."""
    parts = [
        "ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT src AS id FROM edges UNION SELECT dst FROM edges))",
        "numbered AS MATERIALIZED (SELECT rel, a.i AS s, b.i AS d, greatest(1, COUNT(*) OVER (PARTITION BY rel) // 2) AS m FROM edges JOIN ids a ON a.id = src JOIN ids b ON b.id = dst)",
        f"e0 AS MATERIALIZED (SELECT CAST(p AS INT) AS perm, rel, s, d, m FROM numbered, range(1, {permutations + 1}) t(p))",
    ]
    for r in range(rounds):
        salt = graph.round_salt(seed, r)
        parts.append(f"c{r} AS MATERIALIZED (SELECT perm, rel, s, d, m, xor(s * 4294967296 + d, {salt}) AS x, {graph.bucket_expression(seed, r, 'm')} AS bucket FROM e{r})")
        parts.append(f"v{r} AS (SELECT perm, rel, bucket, xor(min(x), {salt}) AS p, xor(max(x), {salt}) AS q FROM c{r} GROUP BY 1, 2, 3 HAVING COUNT(*) > 1)")
        parts.append(f"o{r} AS MATERIALIZED (SELECT perm, rel, bucket, p // 4294967296 AS s1, p % 4294967296 AS d1, q // 4294967296 AS s2, q % 4294967296 AS d2 FROM v{r})")
        parts.append(f"n{r} AS (SELECT perm, rel, bucket, s1 AS s, d2 AS d FROM o{r} UNION ALL SELECT perm, rel, bucket, s2, d1 FROM o{r})")
        parts.append(f"u{r} AS (SELECT *, COUNT(*) OVER (PARTITION BY perm, rel, s, d) AS u FROM n{r})")
        parts.append(f"g{r} AS (SELECT u.perm, u.rel, u.bucket FROM u{r} u LEFT JOIN e{r} e ON u.perm = e.perm AND u.rel = e.rel AND u.s = e.s AND u.d = e.d WHERE u = 1 AND e.s IS NULL GROUP BY ALL HAVING COUNT(*) = 2)")
        parts.append(f"t{r} AS (SELECT o.* FROM o{r} o JOIN g{r} g ON o.perm = g.perm AND o.rel = g.rel AND o.bucket = g.bucket)")
        parts.append(f"e{r + 1} AS MATERIALIZED (SELECT c.perm, c.rel, c.s, CASE WHEN c.s = t.s1 AND c.d = t.d1 THEN t.d2 WHEN c.s = t.s2 AND c.d = t.d2 THEN t.d1 ELSE c.d END AS d, c.m FROM c{r} c LEFT JOIN t{r} t ON c.perm = t.perm AND c.rel = t.rel AND c.bucket = t.bucket)")
    return ", ".join(parts) + f", perms AS (SELECT perm, rel, s, d FROM e{rounds})"


@query("g10_permute", f"WITH {edges_sql()}, {permute_sql(20, ROUNDS)} SELECT perm, rel, a.id AS src, b.id AS dst FROM perms JOIN ids a ON a.i = s JOIN ids b ON b.i = d")
def _(s, d):
    return graph.permute(edges(s, d), 20, ROUNDS)


@query("g10_degrees_kept", f"WITH {edges_sql(['TARGETS'])} SELECT p AS perm, COUNT(*) AS edges, COUNT(*) AS pairs, COUNT(DISTINCT src) AS sources, 0 AS changed FROM edges, range(1, 11) t(p) GROUP BY p")
def _(s, d):
    e = edges(s, d, ["TARGETS"])
    p = graph.permute(e, 10, ROUNDS)
    was = e.groupBy("dst").agg(F.count("*").alias("was"))
    now = p.groupBy("perm", "dst").agg(F.count("*").alias("now")).join(was, "dst", "left")
    changed = now.groupBy("perm").agg(F.count_if(F.coalesce("was", F.lit(0)) != F.col("now")).alias("changed"))
    each = p.groupBy("perm", "src").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("pairs"))  # one distinct: rows aren't multiplied
    one = each.groupBy("perm").agg(F.sum("edges").alias("edges"), F.sum("pairs").alias("pairs"), F.count("*").alias("sources"))
    return one.join(changed, "perm").select(F.col("perm").cast("long").alias("perm"), "edges", "pairs", "sources", F.col("changed").cast("int").alias("changed"))


def _score_sql(metapaths) -> str:
    """CTEs ending in x: scaled scores of the observed graph (0) and the permuted ones, with degrees, by plain path joins; ends are numbers."""
    rels = sorted({h[0] for m in metapaths for h in graph.parse_metapath(m)})
    parts, ends = [], []
    for i, m in enumerate(metapaths):
        hops = graph.parse_metapath(m)
        kinds = [hops[0][2], *(h[3] for h in hops)]
        joins, where = "", []
        for k, (rel, forward, _, _) in enumerate(hops):
            a, b = ("s", "d") if forward else ("d", "s")
            view = f"(SELECT perm, {a} AS a, {b} AS b, w FROM w WHERE rel = '{rel}') h{k}"
            joins += view if k == 0 else f" JOIN {view} ON h{k - 1}.perm = h{k}.perm AND h{k - 1}.b = h{k}.a"
            at = lambda j: "h0.a" if j == 0 else f"h{j - 1}.b"
            where += [f"{at(j)} <> h{k}.b" for j in range(k + 1) if kinds[j] == kinds[k + 1]]
        weight = " * ".join(f"h{k}.w" for k in range(len(hops)))
        cond = " WHERE " + " AND ".join(where) if where else ""
        parts.append(f"SELECT h0.perm, '{m}' AS metapath, h0.a AS source_id, h{len(hops) - 1}.b AS target_id, COUNT(*) AS path_count, sum({weight}) AS dwpc FROM {joins}{cond} GROUP BY 1, 2, 3, 4")
        for (rel, forward, _, _), end, front in ((hops[0], "source", True), (hops[-1], "target", False)):
            side = "s" if forward == front else "d"
            ends.append(f"SELECT '{m}' AS metapath, '{end}' AS e, {side} AS id, COUNT(*) AS degree FROM numbered WHERE rel = '{rel}' GROUP BY {side}")
    return (
        f"{edges_sql(rels)}, {permute_sql(PERMUTATIONS, ROUNDS)}, every AS (SELECT 0 AS perm, rel, s, d FROM numbered UNION ALL SELECT * FROM perms), "
        "ws AS (SELECT rel, s, pow(COUNT(*), -0.5) AS a FROM numbered GROUP BY 1, 2), wd AS (SELECT rel, d, pow(COUNT(*), -0.5) AS b FROM numbered GROUP BY 1, 2), "
        "w AS MATERIALIZED (SELECT perm, rel, s, d, a * b AS w FROM every JOIN ws USING (rel, s) JOIN wd USING (rel, d)), "
        f"raw AS MATERIALIZED ({' UNION ALL '.join(parts)}), means AS (SELECT perm, metapath, avg(dwpc) AS mean FROM raw GROUP BY 1, 2), z AS (SELECT raw.* EXCLUDE (dwpc), asinh(dwpc / mean) AS dwpc FROM raw JOIN means USING (perm, metapath)), "
        f"ends AS ({' UNION ALL '.join(ends)}), "
        "x AS (SELECT z.*, a.degree AS source_degree, b.degree AS target_degree FROM z JOIN ends a ON a.e = 'source' AND a.metapath = z.metapath AND a.id = source_id JOIN ends b ON b.e = 'target' AND b.metapath = z.metapath AND b.id = target_id)"
    )


_FIT_SQL = (
    f"zc AS (SELECT o.metapath, o.source_id, o.target_id, o.source_degree, o.target_degree, {PERMUTATIONS} - COUNT(p.perm) AS zeros FROM (SELECT * FROM x WHERE perm = 0) o LEFT JOIN (SELECT * FROM x WHERE perm > 0) p ON o.metapath = p.metapath AND o.source_id = p.source_id AND o.target_id = p.target_id GROUP BY ALL), "
    "nn AS (SELECT metapath, source_degree, target_degree, COUNT(*) AS nnz, avg(dwpc) AS mean, COALESCE(var_samp(dwpc), 0) AS v, min(dwpc) AS lo, max(dwpc) AS hi FROM x WHERE perm > 0 GROUP BY 1, 2, 3), "
    "fit AS (SELECT nn.*, nnz + COALESCE(q.zeros, 0) AS n, hi - lo <= 1e-12 * abs(hi) AS flat, COALESCE(q.zeros, 0) AS zeros FROM nn LEFT JOIN (SELECT metapath, source_degree, target_degree, CAST(sum(zeros) AS BIGINT) AS zeros FROM zc GROUP BY 1, 2, 3) q USING (metapath, source_degree, target_degree))"
)
#: The upper incomplete gamma function as one less the series of the lower one, with as many terms as matter.
_TAIL = (
    "CASE WHEN a <= 0 OR y <= 0 THEN 1 WHEN y - a > 40 * sqrt(y) + 50 THEN 0 ELSE greatest(0, 1 - list_sum(list_transform(range(CAST(greatest(y - a, 0) + 12 * sqrt(greatest(a, y)) + 60 AS BIGINT)), "
    "lambda n: exp(a * ln(y) - y + n * ln(y) - lgamma(a + n + 1))))) END"
)


def _p_sql(metapaths) -> str:
    factor = "CASE metapath " + " ".join(f"WHEN '{m}' THEN {f}" for m, f in stats.factors(graph.METAPATHS[1:]).items() if m in metapaths) + " END"
    return (
        f"{_score_sql(metapaths)}, {_FIT_SQL}, "
        "j AS (SELECT x.*, fit.n, fit.nnz, fit.flat, CASE WHEN fit.flat THEN 0 ELSE fit.mean * fit.mean / fit.v END AS a, CASE WHEN fit.flat THEN 0 ELSE fit.mean / fit.v * x.dwpc END AS y, CASE WHEN fit.flat AND fit.zeros = 0 THEN fit.hi ELSE -1 END AS single "
        "FROM x LEFT JOIN fit USING (metapath, source_degree, target_degree) WHERE x.perm = 0), "
        f"g AS (SELECT a, y, {_TAIL} AS tail FROM (SELECT DISTINCT a, y FROM j WHERE NOT flat AND nnz > 0)), "
        "p AS (SELECT j.*, CASE WHEN COALESCE(nnz, 0) = 0 THEN 0 WHEN flat THEN CASE WHEN dwpc > single THEN 0 ELSE nnz * 1.0 / n END ELSE nnz * 1.0 / n * tail END AS p_value FROM j LEFT JOIN g ON j.a = g.a AND j.y = g.y), "
        f"r AS (SELECT *, least(1.0, p_value * {factor}) AS adjusted_p_value FROM p)"
    )


_ONE = ("Dt>PRa>CO",)
_IDS = "JOIN ids a ON a.i = source_id JOIN ids b ON b.i = target_id"


def _relations(metapaths):
    return sorted({h[0] for m in metapaths for h in graph.parse_metapath(m)})


def _studied(s, d, metapaths=_ONE, each=False):
    return stats.study(edges(s, d, _relations(metapaths)), list(metapaths), PERMUTATIONS, ROUNDS, each=each)


@query("t02_zero_counts", f"WITH {_score_sql(_ONE)}, {_FIT_SQL} SELECT a.id AS source_id, b.id AS target_id, zeros FROM zc {_IDS}")
def _(s, d):
    return _studied(s, d, each=True)[1].select("source_id", "target_id", "zeros")


@query("t04_gamma_fit", f"WITH {_score_sql(_ONE)}, {_FIT_SQL} SELECT source_degree, target_degree, n, nnz, round(CASE WHEN flat THEN 0 ELSE ln(mean * mean / v) END, 5) AS log_alpha, round(CASE WHEN flat THEN 0 ELSE ln(mean / v) END, 5) AS log_beta, round(CASE WHEN flat AND zeros = 0 THEN hi ELSE -1 END, 6) AS single FROM fit")
def _(s, d):
    log = lambda c: F.round(F.when(F.col(c) == 0, 0.0).otherwise(F.log(c)), 5)
    return _studied(s, d)[2].select("source_degree", "target_degree", "n", "nnz", log("alpha").alias("log_alpha"), log("beta").alias("log_beta"), r6("single").alias("single"))


@query("t05_p_values", f"WITH {_p_sql(_ONE)} SELECT a.id AS source_id, b.id AS target_id, round(dwpc, 6) AS dwpc, round(p_value, 4) AS p_value FROM r {_IDS}")
def _(s, d):
    observed, _, fits = _studied(s, d)
    return stats.p_values(observed, fits).select("source_id", "target_id", r6("dwpc").alias("dwpc"), F.round("p_value", 4).alias("p_value"))


@query("a11_degree_pairs", f"WITH {edges_sql(['TARGETS', 'ASSOCIATED_WITH'])}, ds AS (SELECT src, COUNT(*) AS n FROM edges WHERE rel = 'TARGETS' GROUP BY 1), dt AS (SELECT dst, COUNT(*) AS n FROM edges WHERE rel = 'ASSOCIATED_WITH' GROUP BY 1) SELECT DISTINCT 'Dt>PRa>CO' AS metapath, ds.n AS source_degree, dt.n AS target_degree FROM edges t JOIN edges a ON t.dst = a.src AND t.rel = 'TARGETS' AND a.rel = 'ASSOCIATED_WITH' JOIN ds ON ds.src = t.src JOIN dt ON dt.dst = a.dst")
def _(s, d):
    e = edges(s, d, ["TARGETS", "ASSOCIATED_WITH"])
    rows = graph.dwpc(e, "Dt>PRa>CO").withColumn("metapath", F.lit("Dt>PRa>CO"))
    return stats.degree_pairs(stats.with_degrees(rows, e))


def _results(metapaths, s, d):
    rows = stats.results(edges(s, d, _relations(metapaths)), nodes(s, d), list(metapaths), PERMUTATIONS, ROUNDS)
    return rows.withColumns({"dwpc": r6("dwpc"), "p_value": F.round("p_value", 4), "adjusted_p_value": F.round("adjusted_p_value", 4)})


def _results_sql(metapaths) -> str:
    return (
        f"WITH {_p_sql(metapaths)}, names AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS source_name FROM part), ills AS (SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS target_name FROM customer) "
        "SELECT a.id AS source_id, b.id AS target_id, source_name, target_name, source_degree, target_degree, path_count, round(dwpc, 6) AS dwpc, metapath, round(p_value, 4) AS p_value, round(adjusted_p_value, 4) AS adjusted_p_value "
        f"FROM r {_IDS} LEFT JOIN names ON names.id = a.id LEFT JOIN ills ON ills.id = b.id"
    )


#: One metapath of each length, in one study.
SCORED = ("Dt>PRa>CO", "Dh>CH<hDi>CO", "Dt>PRh>M<hPRa>CO")
query("g11_results", _results_sql(SCORED))(partial(_results, SCORED))

#: Names of the ten scored metapaths.
STUDIED = dict(zip(graph.METAPATHS[1:], (
    "target_association", "shared_target", "shared_therapeutic", "shared_pharmacological", "shared_chemical", "shared_category", "shared_condition", "process", "component", "function",
)))
for _metapath, _name in STUDIED.items():
    # Five components join nearly all ends: 1.5 * 10^8 permuted scores at sf0.01, which plain path joins in SQL can't hold. There
    # a test compares the folded statistics with all scores listed on the smallest scale.
    query(f"g11_results_{_name}", None if _name == "component" else _results_sql((_metapath,)))(partial(_results, (_metapath,)))


@query("p14_significant", "SELECT event_id FROM events WHERE value / 1000 <= 0.05")
def _(s, d):
    rows = table(s, d, "events").select("event_id", (F.col("value") / 1000).alias("adjusted_p_value"))
    return stats.significant(rows).select("event_id")


@query("j19_end_degrees", f"WITH {path_sql('Dt>PRa>CO')} SELECT DISTINCT n0 AS source_id, n2 AS target_id, a.n AS source_degree, b.n AS target_degree FROM paths JOIN (SELECT src, COUNT(*) AS n FROM edges WHERE rel = 'TARGETS' GROUP BY 1) a ON a.src = n0 JOIN (SELECT dst, COUNT(*) AS n FROM edges WHERE rel = 'ASSOCIATED_WITH' GROUP BY 1) b ON b.dst = n2")
def _(s, d):
    e = edges(s, d, ["TARGETS", "ASSOCIATED_WITH"])
    rows = graph.dwpc(e, "Dt>PRa>CO").withColumn("metapath", F.lit("Dt>PRa>CO"))
    return stats.with_degrees(rows, e).select("source_id", "target_id", "source_degree", "target_degree")


@query("j20_end_names", f"WITH {edges_sql(['INDICATED_FOR'])} SELECT src AS source_id, dst AS target_id, p_name AS source_name, c_name AS target_name FROM edges LEFT JOIN part ON src = CAST(p_partkey AS VARCHAR) LEFT JOIN customer ON dst = CAST(c_custkey AS VARCHAR)")
def _(s, d):
    rows = relation(s, d, "INDICATED_FOR").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    return stats.with_names(rows, nodes(s, d)).select("source_id", "target_id", "source_name", "target_name")


def _explained(metapath, s, d):
    """Explanations of the pairs that several paths connect, with a p-value that the path count sets."""
    e = edges(s, d, sorted({h[0] for h in graph.parse_metapath(metapath)}))
    rows = graph.dwpc(e, metapath).where("path_count >= 2").withColumns({"metapath": F.lit(metapath), "adjusted_p_value": 0.01 / F.col("path_count")})
    return stats.explanations(e, nodes(s, d), rows).withColumns({"percent_dwpc": r6w("percent_dwpc"), "path_score": r6w("path_score")})


def _explained_sql(metapath) -> str:
    hops = graph.parse_metapath(metapath)
    n, kinds = len(hops), [hops[0][2], *(h[3] for h in hops)]
    own = path_sql(metapath)
    own = edges_sql() + own[own.index("), h0 AS") + 1 :]  # all relations, for the names
    path, long = " || '->' || ".join(f"p.n{k}" for k in range(n + 1)), " || '->' || ".join(f"COALESCE(m{k}.name, p.n{k})" for k in range(n + 1))
    names = " ".join(f"LEFT JOIN nodes m{k} ON m{k}.kind = '{kind}' AND m{k}.id = p.n{k}" for k, kind in enumerate(kinds))
    return (
        f"WITH {own}, {nodes_sql()}, q AS (SELECT n0, n{n}, sum(weight) AS dwpc, COUNT(*) AS c FROM paths GROUP BY 1, 2 HAVING COUNT(*) >= 2) "
        f"SELECT p.n0 AS source_id, p.n{n} AS target_id, '{metapath}' AS metapath, row_number() OVER (PARTITION BY p.n0, p.n{n} ORDER BY {path}) AS path_index, {path} AS path, {long} AS path_extended, "
        f"round(100 * weight / dwpc * {LIFT}, 6) AS percent_dwpc, round(-log10(0.01 / c) * 100 * weight / dwpc * {LIFT}, 6) AS path_score FROM paths p JOIN q ON p.n0 = q.n0 AND p.n{n} = q.n{n} {names}"
    )


for _name, _metapath in (
    ("target_association", "Dt>PRa>CO"), ("shared_target", "Dt>PR<tDi>CO"), ("shared_therapeutic", "Dh>T<hDi>CO"), ("shared_pharmacological", "Dh>PH<hDi>CO"), ("shared_category", "Dh>CA<hDi>CO"),
    ("shared_condition", "Di>CO<aPRa>CO"), ("process", "Dt>PRh>B<hPRa>CO"),
):
    query(f"g19_explained_{_name}", _explained_sql(_metapath))(partial(_explained, _metapath))
