"""Significance of metapath scores against permuted graphs: gamma-hurdle nulls, p-values, corrections, explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions.special import gamma_upper
from linkweave.tables import discard, sent, written

from . import graph


#: What tells one null distribution from another.
KEYS = ("metapath", "source_degree", "target_degree")


def _ends(edges: DataFrame, metapath: str) -> list[DataFrame]:
    """(id, degree) of the sources and of the targets of a metapath in its first and last relation."""
    hops = graph.parse_metapath(metapath)
    out = []
    for (rel, forward, _, _), front in ((hops[0], True), (hops[-1], False)):
        side = "src" if forward == front else "dst"
        out.append(edges.where(F.col("rel") == rel).groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree")))
    return out


def _scaled_pairs(graphs: DataFrame, metapath: str, cost: dict[int, int], ends: list[DataFrame]) -> DataFrame:
    """(perm, source_id, target_id, path_count, dwpc, source_degree, target_degree) of every graph; the mean of a graph comes from
    the same shuffle as its pairs."""
    pairs = graph.dwpc(graphs, metapath, by=("perm",), cost=cost)
    mean = pairs.groupBy("perm").agg(F.avg("dwpc").alias("_mean"))
    out = pairs.join(F.broadcast(mean), "perm").withColumn("dwpc", F.asinh(F.col("dwpc") / F.col("_mean"))).drop("_mean")  # a row a graph
    for end, degree in zip(("source", "target"), ends):
        out = out.join(sent(degree).select(F.col("id").alias(f"{end}_id"), F.col("degree").alias(f"{end}_degree")), f"{end}_id")
    return out


def study(edges: DataFrame, metapaths: list[str], permutations: int = 200, rounds: int = 10, seed: int = 0, batch: int | None = None, each: bool = True) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(observed, zeros, fits) of metapaths against degree-preserving permutations of edges (rel, src, dst).

    observed: (metapath, source_id, target_id, path_count, dwpc, source_degree, target_degree), scores scaled by their graph's
    mean through asinh; zeros: (metapath, source_id, target_id, zeros), in how many permutations an observed pair isn't connected;
    fits: as of fit(). Without each, zeros are only counted by degrees, for the fits, and are None.

    Permutations are folded into statistics that add up: numbers, means and spreads of each pair of degrees, and hits of observed
    pairs. No permuted pair is ever written. Where graph.holds_whole() says so, tasks make whole permutations and all that follows;
    of larger metapaths they are folded batch by batch, of graph.BATCH_EDGES edges at most. Permutations keep degrees, so edge
    weights and degrees are those of the observed graph.
    """
    coded, numbers = graph.coded(edges)
    coded = written(coded.select("rel", F.col("s").alias("src"), F.col("d").alias("dst")), "coded")
    damped = {end: written(coded.groupBy("rel", end).agg(F.pow(F.count("*").cast("double"), F.lit(-0.5)).alias(f"_{end}")), "damped") for end in ("src", "dst")}
    batch = batch or graph.batches(coded.count(), permutations)[0][1]

    def with_weights(e):
        for end, w in damped.items():
            e = e.join(sent(w), ["rel", end])
        return e.select("perm", "rel", "src", "dst", (F.col("_src") * F.col("_dst")).alias("w"))

    now = written(with_weights(coded.withColumn("perm", F.lit(0))), "graph")
    plans = {m: (graph.join_rows(coded, m), [written(x, "ends") for x in _ends(coded, m)]) for m in metapaths}
    observed = {m: written(_scaled_pairs(now, m, *plan).drop("perm"), "observed") for m, plan in plans.items()}
    whole = [m for m, (cost, _) in plans.items() if graph.holds_whole(coded, observed[m].count(), cost, m)]
    folded = None
    for m in whole:
        part = written(graph.fold_whole(coded, m, each, plans[m][0], permutations, rounds, seed).withColumn("metapath", F.lit(m)), "folded")
        folded = part if folded is None else folded.unionByName(part)
    rest = {m: plan for m, plan in plans.items() if m not in whole}
    for first in range(1, permutations + 1, batch) if rest else ():
        made = graph.permute_coded(coded.select("rel", F.col("src").alias("s"), F.col("dst").alias("d")), min(batch, permutations + 1 - first), rounds, seed, first)
        graphs = written(with_weights(made.withColumnsRenamed({"s": "src", "d": "dst"})), "graphs")
        discard(made)
        both = now.unionByName(graphs)
        for m, (cost, ends) in rest.items():
            part = written(graph.fold(both, m, ends, each, cost).withColumn("metapath", F.lit(m)), "folded")
            folded = part if folded is None else folded.unionByName(part)
        discard(graphs)
    names = lambda end: sent(numbers).select(F.col("idx").alias(f"{end}_id"), F.col("id").alias(f"_{end}"))

    def named(rows):
        rows = rows.join(names("source"), "source_id").join(names("target"), "target_id")
        return rows.drop("source_id", "target_id").withColumnsRenamed({"_source": "source_id", "_target": "target_id"})

    every = None
    for m, rows in observed.items():
        one = rows.withColumn("metapath", F.lit(m))
        every = one if every is None else every.unionByName(one)
    pair = ["metapath", "source_id", "target_id"]
    known = folded.where("source_degree is not null")
    missing = every.groupBy(*KEYS).agg(F.count("*").alias("pairs")).join(known.groupBy(*KEYS).agg(F.sum("hits").alias("hits")), list(KEYS), "left")
    missing = missing.select(*KEYS, (F.col("pairs") * permutations - F.coalesce("hits", F.lit(0))).alias("zeros"))
    fits = written(fit(merged(known.where("n > 0")), missing), "fits")
    if not each:
        return named(every), None, fits
    hits = folded.where("source_degree is null").groupBy(*pair).agg(F.sum("n").alias("hits"))
    missed = every.join(hits, pair, "left").withColumn("zeros", F.lit(permutations) - F.coalesce("hits", F.lit(0))).drop("hits")
    missed = written(named(missed), "study")
    return missed.drop("zeros"), missed.select(*pair, "zeros"), fits


def merged(parts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys.., nnz, mean, var, low, high) of parts (keys.., n, mean, var, low, high) with variances of whole parts; the result's is
    of a sample. Deviations from the common mean are added up, so nothing cancels."""
    mean = parts.groupBy(*keys).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    some = parts.join(mean, list(keys)).groupBy(*keys).agg(
        F.sum("n").alias("nnz"), F.first("_mean").alias("mean"), F.sum(F.col("n") * (F.col("var") + off * off)).alias("_squares"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    var = F.when(F.col("nnz") > 1, F.col("_squares") / (F.col("nnz") - 1)).otherwise(0.0)
    return some.select(*keys, "nnz", "mean", var.alias("var"), "low", "high")


def with_degrees(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (metapath, source_id, target_id, ..) with the degrees of both ends in the metapath's first and last relation.

    Permutations keep degrees, so those of the observed graph hold for all.
    """
    out = None
    for m in [r[0] for r in rows.select("metapath").distinct().collect()]:  # the metapaths of the study
        hops = graph.parse_metapath(m)
        one = rows.where(F.col("metapath") == m)
        for (rel, forward, _, _), end, front in ((hops[0], "source", True), (hops[-1], "target", False)):
            side = "src" if forward == front else "dst"
            degree = edges.where(F.col("rel") == rel).groupBy(F.col(side).alias(f"{end}_id")).agg(F.count("*").alias(f"{end}_degree"))
            one = one.join(degree, f"{end}_id")
        out = one if out is None else out.unionByName(one)
    return rows.withColumns({"source_degree": F.lit(0).cast("long"), "target_degree": F.lit(0).cast("long")}) if out is None else out


def with_names(rows: DataFrame, nodes: DataFrame, source: str = "Drug", target: str = "Condition") -> DataFrame:
    """rows with source_name and target_name from nodes (kind, id, name); null where an id has none."""
    def names(kind, end):
        return nodes.where(F.col("kind") == kind).select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))

    return rows.join(names(source, "source"), "source_id", "left").join(names(target, "target"), "target_id", "left")


def degree_pairs(rows: DataFrame) -> DataFrame:
    """The distinct pairs of degrees of each metapath."""
    return rows.select(*KEYS).distinct()


def gamma_fit(null: DataFrame, zeros: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """fit() of non-zero values null (keys.., dwpc)."""
    some = null.groupBy(*keys).agg(
        F.count("*").alias("nnz"), F.avg("dwpc").alias("mean"), F.coalesce(F.var_samp("dwpc"), F.lit(0.0)).alias("var"), F.min("dwpc").alias("low"), F.max("dwpc").alias("high")
    )
    return fit(some, zeros, keys)


def fit(some: DataFrame, zeros: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys.., n, nnz, alpha, beta, single) by metapath and degree pair.

    some (keys.., nnz, mean, var, low, high) tells of the non-zero values; zeros (keys.., zeros) adds to n. single is the common
    value when all values, zeros included, are one; else -1.
    """
    none = zeros.groupBy(*keys).agg(F.sum("zeros").alias("zeros"))
    both = some.join(none, list(keys), "left").withColumn("zeros", F.coalesce("zeros", F.lit(0)))
    # A spread within rounding of equal values is none.
    flat = F.col("high") - F.col("low") <= 1e-12 * F.abs("high")
    beta = F.when(flat, 0.0).otherwise(F.col("mean") / F.col("var"))
    return both.select(
        *keys, (F.col("nnz") + F.col("zeros")).alias("n"), "nnz", F.when(flat, 0.0).otherwise(F.col("mean") * beta).alias("alpha"), beta.alias("beta"),
        F.when(flat & (F.col("zeros") == 0), F.col("high")).otherwise(-1.0).alias("single"),
    )


def p_values(rows: DataFrame, fits: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """rows with p_value: the share of non-zero nulls times the gamma tail; the constant case compares; no null gives 0."""
    both = rows.join(fits, list(keys), "left")
    share = F.try_divide(F.col("nnz").cast("double"), F.col("n"))
    tail = gamma_upper(F.coalesce("alpha", F.lit(1.0)), F.coalesce(F.col("beta") * F.col("dwpc"), F.lit(1.0)))
    p = F.when(F.coalesce("nnz", F.lit(0)) == 0, 0.0).when(F.col("beta") == 0, F.when(F.col("dwpc") > F.col("single"), 0.0).otherwise(share)).otherwise(share * tail)
    return both.withColumn("p_value", p).drop("n", "nnz", "alpha", "beta", "single")


def factors(metapaths: tuple[str, ...]) -> dict[str, int]:
    """How many of the metapaths have the length of each: what its p-values are multiplied by."""
    length = {m: len(graph.parse_metapath(m)) for m in metapaths}
    return {m: list(length.values()).count(n) for m, n in length.items()}


def results(edges: DataFrame, nodes: DataFrame, metapaths: list[str], permutations: int = 200, rounds: int = 10, seed: int = 0) -> DataFrame:
    """Every connected pair of every metapath with names, degrees, path count, score, p-value and adjusted p-value.

    Metapaths without any fitted null are left out. The correction counts the retained metapaths, whichever are asked for.
    """
    observed, _, fits = study(edges, metapaths, permutations, rounds, seed, each=False)
    fitted = observed.join(F.broadcast(fits.select("metapath").distinct()), "metapath", "left_semi")  # the metapaths of the study
    rows = p_values(fitted, fits)
    every = factors(graph.METAPATHS[1:])
    times = F.create_map(*(F.lit(x) for m in metapaths for x in (m, every.get(m, 1))))[F.col("metapath")]
    rows = rows.withColumn("adjusted_p_value", bonferroni(F.col("p_value"), times))
    columns = ["source_id", "target_id", "source_name", "target_name", "source_degree", "target_degree", "path_count", "dwpc", "metapath", "p_value", "adjusted_p_value"]
    return with_names(rows, nodes).select(columns)


def significant(rows: DataFrame, most: float = 0.05) -> DataFrame:
    return rows.where(F.col("adjusted_p_value") <= most)


def bonferroni(p, factor):
    return F.least(p * factor, F.lit(1.0))


def explain(path_rows: DataFrame, dwpc: DataFrame) -> DataFrame:
    """Paths of significant pairs with their index, share of the pair's score and path score; further columns of paths stay.

    dwpc (source_id, target_id, dwpc, adjusted_p_value) comes filtered: paths are only listed for its pairs. A zero p-value has
    no logarithm: its path score is null.
    """
    ends = sorted((c for c in path_rows.columns if c[0] == "n" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    scores = dwpc.select(F.col("source_id").alias(ends[0]), F.col("target_id").alias(ends[-1]), "dwpc", "adjusted_p_value")
    return _indexed(path_rows.join(scores, [ends[0], ends[-1]]))


def _indexed(rows: DataFrame) -> DataFrame:
    """explain() of paths (n0, n1, .., weight, ..) that hold their pair's dwpc and adjusted_p_value."""
    nodes = sorted((c for c in rows.columns if c[0] == "n" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    more = [c for c in rows.columns if c not in nodes and c not in ("weight", "dwpc", "adjusted_p_value")]
    rows = rows.withColumns({"source_id": F.col(nodes[0]), "target_id": F.col(nodes[-1]), "path": F.concat_ws("->", *nodes)})
    percent = 100 * F.col("weight") / F.col("dwpc")
    score = F.when(F.col("adjusted_p_value") > 0, -F.log10(F.when(F.col("adjusted_p_value") > 0, F.col("adjusted_p_value"))) * percent)
    index = F.row_number().over(Window.partitionBy("source_id", "target_id").orderBy("path"))
    return rows.select("source_id", "target_id", *more, index.alias("path_index"), "path", percent.alias("percent_dwpc"), score.alias("path_score"))


def explanations(edges: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(source_id, target_id, metapath, path_index, path, path_extended, percent_dwpc, path_score) of the significant rows.

    rows are those of results() that the cut left; they are written, so they are made once. Paths are listed only between their
    pairs: from both ends to a place in the middle, where the halves meet. path_extended has names in the place of ids, where
    there are any.
    """
    rows = written(rows.select("metapath", "source_id", "target_id", "dwpc", "adjusted_p_value"), "significant")
    out = None
    for m in [r[0] for r in rows.select("metapath").distinct().collect()]:  # the metapaths of the study
        hops = graph.parse_metapath(m)
        mine = rows.where(F.col("metapath") == m).select(F.col("source_id").alias("n0"), F.col("target_id").alias(f"n{len(hops)}"), "dwpc", "adjusted_p_value")
        listed = graph.paths_between(edges, m, mine, nodes)
        extended = F.concat_ws("->", *(F.coalesce(f"name{k}", f"n{k}") for k in range(len(hops) + 1)))
        listed = listed.select(*(f"n{k}" for k in range(len(hops) + 1)), "weight", "dwpc", "adjusted_p_value", extended.alias("path_extended"))
        one = _indexed(listed).withColumn("metapath", F.lit(m))
        out = one if out is None else out.unionByName(one)
    columns = ["source_id", "target_id", "metapath", "path_index", "path", "path_extended", "percent_dwpc", "path_score"]
    if out is None:
        return rows.sparkSession.createDataFrame([], "source_id string, target_id string, metapath string, path_index int, path string, path_extended string, percent_dwpc double, path_score double")
    return out.select(columns)
