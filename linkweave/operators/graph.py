"""Typed property graphs as edge tables: summaries, pruning, metapath queries and permutations.

Edges are (rel, src_kind, src, dst_kind, dst). A metapath such as "Dt>PRa>CO" compiles to a chain of equi-joins. Counts and
weights are aggregated place by place (sparse matrix products), and walks that visit a node twice are subtracted, so the
intermediate result is the number of reachable pairs rather than of paths; "direct" lists the paths instead.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linkweave.tables import discard, sent, written

from .links import dense_index, lowest
from .products import Graph, folded, folded_batches, folded_schema, summed, totals, whole_statistics

#: Relation -> (source kind, letter, target kind).
METAGRAPH = {
    "INDICATED_FOR": ("Drug", "i", "Condition"), "TARGETS": ("Drug", "t", "Protein"), "ASSOCIATED_WITH": ("Protein", "a", "Condition"),
    "HAS_THERAPEUTIC_GROUP": ("Drug", "h", "TherapeuticGroup"), "HAS_PHARMACOLOGICAL_GROUP": ("Drug", "h", "PharmacologicalGroup"),
    "HAS_CHEMICAL_GROUP": ("Drug", "h", "ChemicalGroup"), "HAS_CATEGORY": ("Drug", "h", "CategoryDrug"),
    "HAS_PROCESS": ("Protein", "h", "BiologicalProcess"), "HAS_COMPONENT": ("Protein", "h", "CellularComponent"), "HAS_FUNCTION": ("Protein", "h", "MolecularFunction"),
}
ABBREVIATIONS = {
    "Drug": "D", "Condition": "CO", "Protein": "PR", "TherapeuticGroup": "T", "PharmacologicalGroup": "PH", "ChemicalGroup": "CH",
    "CategoryDrug": "CA", "BiologicalProcess": "B", "CellularComponent": "CE", "MolecularFunction": "M",
}
#: The metapaths that are scored, and the direct one, which is only counted.
METAPATHS = (
    "Di>CO", "Dt>PRa>CO", "Dt>PR<tDi>CO", "Dh>T<hDi>CO", "Dh>PH<hDi>CO", "Dh>CH<hDi>CO", "Dh>CA<hDi>CO", "Di>CO<aPRa>CO",
    "Dt>PRh>B<hPRa>CO", "Dt>PRh>CE<hPRa>CO", "Dt>PRh>M<hPRa>CO",
)


def parse_metapath(metapath: str) -> list[tuple[str, bool, str, str]]:
    """[(relation, forward, kind before, kind after)] of the hops."""
    kinds = {v: k for k, v in ABBREVIATIONS.items()}
    parts = re.split(r"(<[a-z]|[a-z]>)", metapath)
    by = {v: k for k, v in METAGRAPH.items()}
    hops = []
    for k in range(0, len(parts) - 2, 2):
        a, arrow, b = kinds[parts[k]], parts[k + 1], kinds[parts[k + 2]]
        forward = arrow[1] == ">"
        letter = arrow[0] if forward else arrow[1]
        hops.append((by[(a, letter, b) if forward else (b, letter, a)], forward, a, b))
    return hops


def enumerate_metapaths(start: str = "Drug", end: str = "Condition", longest: int = 4) -> list[str]:
    """All metapaths from start to end of at most longest hops, by length, then name."""
    steps: dict[str, list[tuple[str, str]]] = {}
    for a, letter, b in METAGRAPH.values():
        steps.setdefault(a, []).append((f"{letter}>", b))
        steps.setdefault(b, []).append((f"<{letter}", a))
    found, front = [], [(ABBREVIATIONS[start], start)]
    for n in range(longest):
        front = [(p + arrow + ABBREVIATIONS[b], b) for p, a in front for arrow, b in steps[a]]
        found += sorted(p for p, b in front if b == end)
    return found


def hop(edges: DataFrame, rel: str, forward: bool, damping: float, a: str, b: str, w: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., a, b, w) of a relation walked one way; w is the degree weight of the edge. by: columns that tell graphs apart.

    Degrees are counted by combining aggregates and joined, so a hub's edges never meet in one task. Edges that come with their
    weight as w keep it.
    """
    e = edges.where(F.col("rel") == rel)
    if "w" not in edges.columns:
        e = weighted(e.select(*by, "src", "dst"), damping, by)
    x, y = ("src", "dst") if forward else ("dst", "src")
    return e.select(*by, F.col(x).alias(a), F.col(y).alias(b), F.col("w").alias(w))


def weighted(edges: DataFrame, damping: float, by: tuple[str, ...] = ()) -> DataFrame:
    """edges (by.., src, dst) with w, the damped degrees of both ends in the graph that by names."""
    if not damping:
        return edges.withColumn("w", F.lit(1.0))
    e = edges
    for end in ("src", "dst"):
        degree = edges.groupBy(*by, end).agg(F.pow(F.count("*").cast("double"), F.lit(-damping)).alias(f"_{end}"))
        e = e.join(degree, [*by, end])
    return e.withColumn("w", F.col("_src") * F.col("_dst")).drop("_src", "_dst")


def coincidences(kinds: list[str]) -> list[tuple[int, list[int]]]:
    """[(coefficient, block of each place)]: which places of a metapath may be the same node, and how the walks in which they are
    count, so that all together count the walks in which no node comes twice (Moebius inversion over set partitions)."""
    out: list[tuple[int, list[int]]] = [(1, [])]
    for place, kind in enumerate(kinds):
        more = []
        for c, blocks in out:
            more.append((c, [*blocks, place]))
            for first in sorted({x for x in blocks if kinds[x] == kind}):
                more.append((-c * blocks.count(first), [*blocks, first]))
        out = more
    return out


class _Tables:
    """Factors of metapaths as tables (by.., v0, v1, .., w, n)."""

    def __init__(self, edges: DataFrame, damping: float, by: tuple[str, ...]):
        self.edges, self.damping, self.by = edges, damping, by

    def hop(self, rel: str, forward: bool, x: int, y: int) -> DataFrame:
        """A relation walked from variable x to y, which may be the same."""
        one = hop(self.edges, rel, forward, self.damping, f"v{x}", "_to" if x == y else f"v{y}", "w", self.by)
        one = one.where(F.col(f"v{x}") == F.col("_to")).drop("_to") if x == y else one
        return one.withColumn("n", F.lit(1).cast("long"))

    def times(self, left, right):
        """The product of two factors (variables, rows): joined where they share variables."""
        (xs, a), (ys, b) = left, right
        b = b.withColumnsRenamed({"w": "_w", "n": "_n"})
        both = a.join(b, [*self.by, *(f"v{x}" for x in sorted(xs & ys))])
        names = [f"v{x}" for x in sorted(xs | ys)]
        return xs | ys, both.select(*self.by, *names, (F.col("w") * F.col("_w")).alias("w"), (F.col("n") * F.col("_n")).alias("n"))

    def over(self, rest: set[int], rows: DataFrame) -> DataFrame:
        """rows summed over all variables but rest."""
        return rows.groupBy(*self.by, *(f"v{x}" for x in sorted(rest))).agg(F.sum("w").alias("w"), F.sum("n").alias("n"))

    def ends(self, rows: DataFrame, p: int, q: int) -> DataFrame:
        return rows.select(*self.by, F.col(f"v{p}").alias("p"), F.col(f"v{q}").alias("q"), "w", "n")

    @staticmethod
    def scaled(rows: DataFrame | None, c: int) -> DataFrame | None:
        return rows if rows is None else rows.withColumns({"w": F.col("w") * F.lit(c), "n": F.col("n") * F.lit(c)})


class _Arrays:
    """The same factors as arrays of one graph in a task: edges by relation (source, target, weight), nodes numbered below count."""

    def __init__(self, edges: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], count: int):
        self.edges, self.count = edges, count

    def hop(self, rel, forward, x, y):
        s, d, w = self.edges[rel]
        s, d = (s, d) if forward else (d, s)
        if x == y:
            s, w = s[s == d], w[s == d]
            return {x: s, "w": w, "n": np.ones(s.size, np.int64)}
        return {x: s, y: d, "w": w, "n": np.ones(s.size, np.int64)}

    def _code(self, columns: list[np.ndarray]) -> np.ndarray:
        """One number for the values of all columns."""
        out = columns[0]
        for c in columns[1:]:
            if out.max(initial=0) >= (1 << 62) // self.count:
                out = np.unique(out, return_inverse=True)[1]
            out = out * self.count + c
        return out

    def times(self, left, right):
        (xs, a), (ys, b) = left, right
        both = self._code([np.append(a[v], b[v]) for v in sorted(xs & ys)])
        l, r = both[: a["w"].size], both[a["w"].size :]
        order = np.argsort(r, kind="stable")
        first = np.searchsorted(r[order], l)
        size = np.searchsorted(r[order], l, "right") - first
        row = np.repeat(np.arange(l.size), size)
        at = order[np.arange(row.size) + np.repeat(first - np.cumsum(size) + size, size)]
        return xs | ys, {v: a[v][row] if v in xs else b[v][at] for v in xs | ys} | {c: a[c][row] * b[c][at] for c in ("w", "n")}

    def over(self, rest, rows):
        code = self._code([rows[v] for v in sorted(rest)])
        order = np.argsort(code, kind="stable")
        code = code[order]
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if code.size else np.zeros(0, int)
        summed = lambda c: np.add.reduceat(rows[c][order], first) if first.size else rows[c]
        return {v: rows[v][order[first]] for v in rest} | {c: summed(c) for c in ("w", "n")}

    def ends(self, rows, p, q):
        return rows[p], rows[q], rows["w"], rows["n"]

    @staticmethod
    def scaled(rows, c):
        return rows if rows is None else (*rows[:2], rows[2] * c, rows[3] * c)


def _contracted(factors, ends: set[int], algebra, cost, keep: int = 0):
    """Sum the product of factors over all variables but ends, one variable after another: the one that leaves the narrowest
    factor first, then the one whose join is the smallest. The last keep variables stay: factors, not yet multiplied."""
    while len(inner := set().union(*(xs for xs, _ in factors)) - ends) > keep:
        v = min(inner, key=lambda v: (len(set().union(*(xs for xs, _ in factors if v in xs))), cost.get(v, 0), v))
        xs, rows = reduce(algebra.times, [f for f in factors if v in f[0]])
        rest = xs - {v}
        factors = [f for f in factors if v not in f[0]] + [(rest, algebra.over(rest, rows))]
    return factors


def _halves(factors, a: int, b: int, algebra, cost):
    """(left, right, pairs) of a term between places a and b: two factors that meet in one place, or the pairs themselves."""
    left = _contracted(factors, {a, b}, algebra, cost, keep=1)
    inner = set().union(*(xs for xs, _ in left)) - {a, b}
    sides = [[f for f in left if end in f[0]] for end in (a, b)]
    product = lambda some: reduce(algebra.times, sorted(some, key=lambda f: -len(f[0])))[1]
    if a != b and inner and all(sides) and not any({a, b} <= xs for xs, _ in left):
        (v,) = inner
        alone = [f for f in left if f[0] == {v}]
        if len(sides[0]) + len(sides[1]) + len(alone) == len(left):
            return algebra.ends(product(sides[0] + alone), a, v), algebra.ends(product(sides[1]), v, b), None
    return None, None, algebra.ends(product(_contracted(left, {a, b}, algebra, cost)), a, b)


def join_rows(edges: DataFrame, metapath: str) -> dict[int, int]:
    """Rows of the join at each inner place of a metapath: the products of its nodes' degrees, summed."""
    hops = parse_metapath(metapath)
    out = None
    for k in range(1, len(hops)):
        sides = []
        for (rel, forward, _, _), into in ((hops[k - 1], True), (hops[k], False)):
            end = "dst" if forward == into else "src"
            sides.append(edges.where(F.col("rel") == rel).groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n" if into else "m")))
        one = sides[0].join(sides[1], "id").agg(F.lit(k).alias("k"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("rows"))
        out = one if out is None else out.unionByName(one)
    return {r.k: r.rows for r in out.collect()} if out is not None else {}


#: Walks that a task lists.
TASK_WALKS = 1_000_000


def walks(edges: DataFrame, metapath: str) -> int:
    """How many walks a metapath has, nodes that come twice included; counted node by node, none is listed."""
    now = None
    for rel, forward, _, _ in parse_metapath(metapath):
        a, b = ("src", "dst") if forward else ("dst", "src")
        one = edges.where(F.col("rel") == rel).select(F.col(a).alias("id"), F.col(b).alias("_to"))
        one = one.withColumn("n", F.lit(1).cast("long")) if now is None else one.join(now, "id")
        now = one.groupBy(F.col("_to").alias("id")).agg(F.sum("n").alias("n"))
    return now.agg(F.sum("n")).first()[0] or 0


def paths(edges: DataFrame, metapath: str, damping: float = 0.5, parts: int = 0) -> DataFrame:
    """All paths as (n0, n1, .., weight): no node twice. parts: how many tasks each join has, Spark's choice if none is given."""
    hops = parse_metapath(metapath)
    out, kinds = None, [hops[0][2]]
    for k, (rel, forward, _, kind) in enumerate(hops):
        one = hop(edges, rel, forward, damping, f"n{k}", f"n{k + 1}", f"w{k}")
        if parts and out is not None:
            out, one = out.repartition(parts, f"n{k}"), one.repartition(parts, f"n{k}")
        out = one if out is None else out.join(one, f"n{k}")
        for j, other in enumerate(kinds):
            if other == kind:
                out = out.where(F.col(f"n{j}") != F.col(f"n{k + 1}"))
        kinds.append(kind)
    weight = F.col("w0")
    for k in range(1, len(hops)):
        weight = weight * F.col(f"w{k}")
    return out.select(*(f"n{k}" for k in range(len(hops) + 1)), weight.alias("weight"))


def paths_between(edges: DataFrame, metapath: str, pairs: DataFrame, nodes: DataFrame, damping: float = 0.5) -> DataFrame:
    """Columns of pairs (n0, .., last place) with n1, .., weight and name0, name1, .. of every path that connects them.

    Halves of paths are listed from both ends to the place that makes them fewest, and named there; pairs meet them one after the
    other, so no path between other ends is ever listed.
    """
    hops = parse_metapath(metapath)
    last, kinds = len(hops), [hops[0][2], *(h[3] for h in hops)]
    cost = join_rows(edges, metapath) if last == 3 else {}
    middle = (1 if cost.get(2, 0) <= cost.get(1, 0) else 2) if last == 3 else last // 2
    half = {0: None, 1: None}
    for k, (rel, forward, _, _) in enumerate(hops):
        one = hop(edges, rel, forward, damping, f"n{k}", f"n{k + 1}", f"w{k}")
        side = int(k >= middle)
        half[side] = one if half[side] is None else half[side].join(one, f"n{k}")
    at = {0: range(middle + 1), 1: range(middle + 1, last + 1)}  # places named by each half
    out = pairs
    for side, rows in half.items():
        if rows is not None:
            out = out.join(_named_places(rows, at[side], kinds, nodes), ["n0"] if side == 0 and middle else [f"n{middle}", f"n{last}"])
    if half[0] is None:
        out = _named_places(out, at[0], kinds, nodes)
    for j in range(last + 1):
        for k in range(j + 1, last + 1):
            if kinds[j] == kinds[k]:
                out = out.where(F.col(f"n{j}") != F.col(f"n{k}"))
    weight = reduce(lambda a, b: a * b, (F.col(f"w{k}") for k in range(last)))
    return out.withColumn("weight", weight).drop(*(f"w{k}" for k in range(last)))


def _named_places(rows: DataFrame, places, kinds: list[str], nodes: DataFrame) -> DataFrame:
    for k in places:
        names = nodes.where(F.col("kind") == kinds[k]).select(F.col("id").alias(f"n{k}"), F.col("name").alias(f"name{k}"))
        rows = rows.join(names, f"n{k}", "left")
    return rows


def _terms(edges: DataFrame, metapath: str, damping: float, by: tuple[str, ...] = (), cost: dict[int, int] | None = None):
    """[(left, right, pairs)] of a metapath, one for each way in which places may coincide, signed."""
    if cost is None:
        cost = {} if by or len(parse_metapath(metapath)) < 3 else join_rows(edges, metapath)
    return _signed_terms(_Tables(edges, damping, by), metapath, cost)


def _signed_terms(algebra, metapath: str, cost: dict[int, int]):
    hops = parse_metapath(metapath)
    terms = []
    for coefficient, block in coincidences([hops[0][2], *(h[3] for h in hops)]):
        factors = [({block[k], block[k + 1]}, algebra.hop(rel, forward, block[k], block[k + 1])) for k, (rel, forward, _, _) in enumerate(hops)]
        left, right, pairs = _halves(factors, block[0], block[-1], algebra, cost)
        terms.append((algebra.scaled(left, coefficient), right, algebra.scaled(pairs, coefficient)))
    return terms


def dwpc(edges: DataFrame, metapath: str, damping: float = 0.5, method: str = "factorised", by: tuple[str, ...] = (), cost: dict[int, int] | None = None) -> DataFrame:
    """(by.., source_id, target_id, path_count, dwpc) of the pairs that the metapath connects.

    factorised never lists a path: walks are counted by joins that are summed up place by place, and walks in which places
    coincide are counted likewise and taken off, for any metapath; direct lists the paths. by: columns that tell graphs apart.
    cost: join_rows of the graphs, where known.
    """
    hops = parse_metapath(metapath)
    if method == "direct":
        if by:
            raise ValueError("paths are listed of one graph at a time")
        # More walks are listed by more tasks, so that neither a join nor the sums of a task grow with the input.
        parts = -(-walks(edges, metapath) // TASK_WALKS)
        parts = parts if parts > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0
        listed = paths(edges, metapath, damping, parts)
        listed = listed.repartition(parts, "n0", f"n{len(hops)}") if parts else listed
        found = listed.groupBy(F.col("n0").alias("source_id"), F.col(f"n{len(hops)}").alias("target_id"))
        return found.agg(F.count("*").alias("path_count"), F.sum("weight").alias("dwpc"))
    terms = _terms(edges, metapath, damping, by, cost)
    if len(terms) == 1 and terms[0][0] is None:
        every = terms[0][2].withColumnsRenamed({"p": "a", "q": "b"})
    else:
        every = summed(terms, by)
    return every.select(*by, F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("n").alias("path_count"), F.col("w").alias("dwpc"))


def reach(edges: DataFrame, metapath: str, damping: float = 0.5) -> DataFrame:
    """(source_id, pairs, path_count, dwpc): how many targets each source is connected with, and the sums of dwpc() over them."""
    found = totals(_terms(edges, metapath, damping))
    return found.select(F.col("a").alias("source_id"), "pairs", F.col("n").alias("path_count"), F.col("w").alias("dwpc"))


def fold(graphs: DataFrame, metapath: str, ends: list[DataFrame], each: bool, cost: dict[int, int] | None = None) -> DataFrame:
    """products.folded() of the dwpc() pairs of graphs (perm, ..), of which 0 is the observed one; ends: written (id, degree)."""
    return folded(_terms(graphs, metapath, 0.5, ("perm",), cost), ends, each)


#: Pairs of the observed graph, and rows of a join inside a metapath, up to which a task holds whole graphs.
WHOLE_PAIRS, WHOLE_ROWS = 60_000_000, 4_000_000


def holds_whole(edges: DataFrame, pairs: int, cost: dict[int, int], metapath: str) -> bool:
    """Whether tasks may hold graphs of edges (rel, ..) whole: their relations, observed pairs and all joins but the last."""
    rels = {h[0] for h in parse_metapath(metapath)}
    rows = [r.n for r in edges.where(F.col("rel").isin(*rels)).groupBy("rel").agg(F.count("*").alias("n")).collect()]  # a row per relation
    return len(rows) == len(rels) and max(rows) <= WHOLE_EDGES and pairs <= WHOLE_PAIRS and all(n <= WHOLE_ROWS for n in sorted(cost.values())[:-1])


def fold_whole(edges: DataFrame, metapath: str, each: bool, cost: dict[int, int], permutations: int, rounds: int, seed: int) -> DataFrame:
    """fold() of the permutations 1, 2, .. of edges (rel, src, dst) with numbers as ends, where holds_whole() says so.

    Each task is dealt the edges and some permutations: it makes these one after the other, their pairs and their statistics, so
    neither a permuted edge nor a pair ever leaves it.
    """
    spark, hops = edges.sparkSession, parse_metapath(metapath)
    names = sorted({h[0] for h in hops})
    tasks = min(permutations, 2 * spark.sparkContext.defaultParallelism)
    number = F.create_map(*(F.lit(x) for k, rel in enumerate(names) for x in (rel, k)))[F.col("rel")]
    rows = edges.where(F.col("rel").isin(*names)).select(number.alias("r"), (F.col("src") * _WIDE + F.col("dst")).alias("e"))
    rows = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "r", "e").repartitionById(tasks, F.col("task"))

    def apply(batches):
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            del held
            task, r, e = table["task"][0].as_py(), table["r"].to_numpy(), table["e"].to_numpy()
            now = {rel: np.sort(e[r == k]) for k, rel in enumerate(names)}
            del table, r, e
            perms = range(1 + task, permutations + 1, tasks)
            made = _Whole(now, metapath, cost)
            graphs = (made.graph({rel: _permuted(e, p, rounds, seed) for rel, e in now.items()}) for p in perms)
            yield from folded_batches(whole_statistics(made.graph(now), graphs, *made.ends, each), pa.int64(), pa.int64())

    return rows.mapInArrow(apply, folded_schema(LongType(), LongType()))


class _Whole:
    """Graphs of a metapath in a task, of edges numbered as one each; all have the degrees of the first."""

    def __init__(self, edges: dict[str, np.ndarray], metapath: str, cost: dict[int, int]):
        self.metapath, self.cost = metapath, cost
        self.count = 1 + int(max(max((e >> 32).max(), (e & (_WIDE - 1)).max()) for e in edges.values()))
        degree = {rel: [np.bincount(end, minlength=self.count) for end in (e >> 32, e & (_WIDE - 1))] for rel, e in edges.items()}
        self.damped = {rel: [np.maximum(d, 1) ** -0.5 for d in both] for rel, both in degree.items()}
        hops = parse_metapath(metapath)
        both = degree[hops[0][0]][not hops[0][1]], degree[hops[-1][0]][hops[-1][1]]
        xs, ys = (np.flatnonzero(d) for d in both)
        self.ends = xs, ys, both[0][xs], both[1][ys]
        self.x, self.y = (np.cumsum(d > 0) - 1 for d in both)

    def graph(self, edges: dict[str, np.ndarray]) -> Graph:
        ends = {rel: (e >> 32, e & (_WIDE - 1)) for rel, e in edges.items()}
        algebra = _Arrays({rel: (s, d, self.damped[rel][0][s] * self.damped[rel][1][d]) for rel, (s, d) in ends.items()}, self.count)
        terms, pairs = [], [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for left, right, some in _signed_terms(algebra, self.metapath, self.cost):
            if some is None:
                terms.append((self.x[left[0]], *left[1:], right[0], self.y[right[1]], *right[2:]))
            else:
                pairs.append((self.x[some[0]], self.y[some[1]], *some[2:]))
        return Graph(terms, tuple(map(np.concatenate, zip(*pairs))), self.ends[0].size, self.count, self.ends[1].size)


def scaled(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """dwpc divided by its mean over the non-zero rows of each group (graph and metapath), through asinh."""
    if not groups:
        mean = rows.agg(F.avg("dwpc").alias("_mean"))
        both = rows.join(F.broadcast(mean))  # one row
    else:
        both = rows.join(rows.groupBy(*groups).agg(F.avg("dwpc").alias("_mean")), groups)
    return both.withColumn("dwpc", F.asinh(F.col("dwpc") / F.col("_mean"))).drop("_mean")


def degrees(edges: DataFrame) -> DataFrame:
    """(kind, id, rel, direction, degree) of every node that has edges of a relation, both ways."""
    out = edges.select(F.col("src_kind").alias("kind"), F.col("src").alias("id"), "rel", F.lit("out").alias("direction"))
    into = edges.select(F.col("dst_kind").alias("kind"), F.col("dst").alias("id"), "rel", F.lit("in").alias("direction"))
    return out.unionByName(into).groupBy("kind", "id", "rel", "direction").agg(F.count("*").alias("degree"))


def two_core(pairs: DataFrame, least: int = 2) -> DataFrame:
    """(src, dst) pairs in which every src and every dst keeps at least so many partners: repeated until nothing changes.

    Each round is a written table, so plans don't grow; only a count reaches the driver.
    """
    now = written(pairs.select("src", "dst").distinct(), "core")
    n = now.count()
    while True:
        left = now
        for side in ("src", "dst"):
            full = left.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(side)
            left = left.join(full, side, "left_semi").select("src", "dst")
        before, now = now, written(left, "core")
        discard(before)
        last, n = n, now.count()
        if n == last:
            return now


def prune(edges: DataFrame, percent: int, keep: tuple[str, ...] = ("INDICATED_FOR",), seed: int = 42) -> DataFrame:
    """edges without the first percent of each relation in a seeded order; stages of rising percent are nested."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "rel", "src", "dst"))
    cut = edges.where(~F.col("rel").isin(*keep))
    most = cut.groupBy("rel").agg(F.floor(F.count("*") * percent / 100).alias("most"))
    gone = lowest(cut.select("rel", "src", "dst"), key, most, ["rel"], ["src", "dst"])
    return edges.join(gone.select("rel", "src", "dst"), ["rel", "src", "dst"], "left_anti").select(edges.columns)


#: Fixed values of the mixing of a round: the prime 2^31 - 1 and multipliers of congruential generators.
_PRIME, _MIX = 2147483647, ((48271, 69621), (40014, 52774))
#: An edge is one number: source times _WIDE plus target, so a graph has at most 2^31 nodes.
_WIDE = 1 << 32


def bucket_expression(seed: int, turn: int, buckets: str) -> str:
    """SQL of the bucket that an edge (perm, s, d) falls into in a round; the same in every engine with whole numbers of 64 bits."""
    x = f"((s * 48271 + d * 69621 + CAST(perm AS BIGINT) * 40692 + {(seed * 1000 + turn + 1) * 16807}) % {_PRIME})"
    for a, b in _MIX:
        x = f"(({x} * {x} % {_PRIME} * {a} + {x} * {b} + 11) % {_PRIME})"
    return f"({x} % {buckets})"


def round_salt(seed: int, turn: int) -> int:
    """The number that a round compares edges under, by exclusive or, so that each prefers other ones."""
    x = seed * 1000 + turn + 1
    for _ in range(4):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 62)
    return x


def coded(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rel, s, d) with numbers in place of ids, and the written table (id, idx) that says which."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    numbers = written(dense_index(written(ends, "ids"), "id"), "numbers")
    for end, name in (("src", "s"), ("dst", "d")):
        edges = edges.join(sent(numbers).select(F.col("id").alias(end), F.col("idx").alias(name)), end)
    return edges.select("rel", "s", "d"), numbers


def _graph_codes(table: pa.Table, relations: int) -> np.ndarray:
    return table["perm"].to_numpy().astype(np.int64) * relations + table["r"].to_numpy()


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, size): rows sorted by keys, the last one first, and the runs of equal keys but the first in that order."""
    order = np.lexsort(keys)
    new = np.ones(order.size, bool)
    new[1:] = reduce(np.logical_or, (k[order][1:] != k[order][:-1] for k in keys[1:]))
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, order.size))


def _proposed(table: pa.Table, relations: int, salt: int) -> dict[str, np.ndarray]:
    """Edges of whole buckets with the edge that each would become, or -1: the least and the greatest of a bucket trade targets."""
    bucket, e = table["bucket"].to_numpy().copy(), table["e"].to_numpy()
    x = e ^ salt
    order, first, size = _runs(x, bucket, _graph_codes(table, relations))
    a, b = order[first], order[first + size - 1]
    two = x[a] < x[b]
    a, b = a[two], b[two]
    new = np.full(e.size, -1)
    new[a], new[b] = (e[a] & -_WIDE) | (e[b] & (_WIDE - 1)), (e[b] & -_WIDE) | (e[a] & (_WIDE - 1))
    bucket[new < 0] = -1
    return {"bucket": bucket, "e": e, "new": new}


def _fresh(table: pa.Table, relations: int) -> dict[str, np.ndarray]:
    """All edges of some sources; what would become an edge that exists or is proposed twice stays as it is."""
    bucket, e, new = (table[c].to_numpy() for c in ("bucket", "e", "new"))
    offers = np.flatnonzero(new >= 0)
    code, graphs = np.append(e, new[offers]), _graph_codes(table, relations)
    order, first, size = _runs(np.zeros(code.size, bool), code, np.append(graphs, graphs[offers]))
    alone = np.zeros(code.size, bool)
    alone[order[first[size == 1]]] = True
    stays = np.ones(e.size, bool)
    stays[offers] = ~alone[e.size :]
    return {"bucket": np.where(stays, -1, bucket), "e": e, "new": np.where(stays, -1, new)}


def _traded(table: pa.Table, relations: int) -> dict[str, np.ndarray]:
    """Edges after the trades that both edges of a bucket may make."""
    bucket, e, new = table["bucket"].to_numpy(), table["e"].to_numpy().copy(), table["new"].to_numpy()
    offers = np.flatnonzero(new >= 0)
    order, first, size = _runs(new[offers], bucket[offers], _graph_codes(table, relations)[offers])
    made = offers[order[np.repeat(size == 2, size)]]
    e[made] = new[made]
    return {"e": e}


def _by_task(rows: DataFrame, columns: str, step) -> DataFrame:
    """step (a table of a task's rows: new columns) beside perm and r."""

    def apply(batches):
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            del held
            out = pa.table({"perm": table["perm"], "r": table["r"], **step(table)})
            yield from out.combine_chunks().to_batches(max_chunksize=200_000)

    return rows.mapInArrow(apply, f"perm int, r int, {columns}")


def _permuted(e: np.ndarray, perm: int, rounds: int, seed: int) -> np.ndarray:
    """The edges of a relation after the rounds of one permutation: the steps of permute_coded without shuffles."""
    e, buckets = e.copy(), max(1, e.size // 2)
    for turn in range(rounds):
        salt = round_salt(seed, turn)
        bucket = ((e >> 32) * 48271 + (e & (_WIDE - 1)) * 69621 + (perm * 40692 + (seed * 1000 + turn + 1) * 16807)) % _PRIME
        for a, b in _MIX:
            bucket = (bucket * bucket % _PRIME * a + bucket * b + 11) % _PRIME
        bucket %= buckets
        x = e ^ salt
        least, most = np.full(buckets, np.iinfo(np.int64).max), np.full(buckets, -1)
        np.minimum.at(least, bucket, x)
        np.maximum.at(most, bucket, x)
        a, b = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for place, end in ((a, least), (b, most)):
            at = np.flatnonzero(x == end[bucket])
            place[bucket[at]] = at
        two = least < most
        a, b = a[two], b[two]
        new = np.array([(e[a] & -_WIDE) | (e[b] & (_WIDE - 1)), (e[b] & -_WIDE) | (e[a] & (_WIDE - 1))])
        every = np.sort(np.append(e, new))
        fresh = ~np.isin(new, every[1:][every[1:] == every[:-1]])
        made = fresh[0] & fresh[1]
        e[a[made]], e[b[made]] = new[0][made], new[1][made]
    return e


def _permute_whole(edges: DataFrame, perms: DataFrame, permutations: int, tasks: int, relations: int, rounds: int, seed: int) -> DataFrame:
    """(perm, r, e) of relations (r, e) of no more than WHOLE_EDGES edges: a task makes whole permutations, so edges are shuffled once."""

    def apply(batches):
        held = list(batches)
        if held:
            table = pa.Table.from_batches(held)
            del held
            code, e = _graph_codes(table, relations), table["e"].to_numpy()
            order, first, size = _runs(np.zeros(code.size, bool), code)
            for a, n in zip(first, size):
                some = order[a : a + n]
                perm, r = divmod(int(code[some[0]]), relations)
                done = _permuted(e[some], perm, rounds, seed)
                for lo in range(0, n, 200_000):
                    part = done[lo : lo + 200_000]
                    yield pa.RecordBatch.from_pydict({"perm": pa.array(np.full(part.size, perm, np.int32)), "r": pa.array(np.full(part.size, r, np.int32)), "e": pa.array(part)})

    rows = edges.repartition(edges.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(perms)).select("perm", "r", "e")
    return rows.repartitionById(tasks, F.pmod(F.col("perm") + F.col("r") * permutations, F.lit(tasks)).cast("int")).mapInArrow(apply, "perm int, r int, e long")


#: Edges of permuted graphs that are held at once, edges of a relation that a task may hold whole, and those that a task is dealt.
BATCH_EDGES, WHOLE_EDGES, TASK_EDGES = 20_000_000, 2_000_000, 500_000


def batches(edges: int, permutations: int) -> list[tuple[int, int]]:
    """(first, how many) of the permutations of so many edges that are made together."""
    some = max(1, BATCH_EDGES // max(1, edges))
    return [(k, min(some, permutations + 1 - k)) for k in range(1, permutations + 1, some)]


def permute_coded(edges: DataFrame, permutations: int, rounds: int = 10, seed: int = 0, first: int = 1) -> DataFrame:
    """(perm, rel, s, d): degree-preserving permutations first, first + 1, .. of every relation of (rel, s, d), all at once.

    In a round each relation's edges fall into buckets of two on average by a hash that the round decides; the least and the
    greatest of a bucket, as a round compares them, propose to trade targets. A trade is made if neither new edge exists or is
    proposed twice, so all degrees stay and no edge ever repeats. Edges are numbers. Relations of no more than WHOLE_EDGES edges
    are dealt to tasks by permutation, which make all rounds. Of larger ones a round shuffles each edge three times, by bucket,
    source and bucket: an edge keeps its source in a trade, so new edges are checked where the edges of their source are. Such a
    round is a written table, the last one is the caller's to discard.
    """
    spark = edges.sparkSession
    rows = {r.rel: r.n for r in edges.groupBy("rel").agg(F.count("*").alias("n")).collect()}  # a row per relation
    if not rows:
        return spark.createDataFrame([], "perm int, rel string, s long, d long")
    names = sorted(rows)
    number = F.create_map(*(F.lit(x) for k, rel in enumerate(names) for x in (rel, k)))[F.col("rel")]
    perms = spark.range(first, first + permutations).select(F.col("id").cast("int").alias("perm"))
    one = edges.select(number.alias("r"), (F.col("s") * _WIDE + F.col("d")).alias("e"))
    small = [k for k, rel in enumerate(names) if rows[rel] <= WHOLE_EDGES]
    large = [k for k in range(len(names)) if k not in small]
    now = whole = rounded = None
    if small:
        every = permutations * sum(rows[names[k]] for k in small)
        tasks = min(permutations * len(names), max(spark.sparkContext.defaultParallelism, -(-every // TASK_EDGES)))
        now = whole = _permute_whole(one.where(F.col("r").isin(small)), perms, permutations, tasks, len(names), rounds, seed)
    if large:
        now = rounded = _permute_rounds(one.where(F.col("r").isin(large)), perms, [max(1, rows[rel] // 2) for rel in names], rounds, seed)
    if small and large:
        now = whole.unionByName(rounded)
    rel = F.array(*map(F.lit, names))[F.col("r")]
    out = now.select("perm", rel.alias("rel"), F.shiftright("e", 32).alias("s"), F.col("e").bitwiseAND(F.lit(_WIDE - 1)).alias("d"))
    out._written_at = getattr(rounded, "_written_at", None)
    return out


def _permute_rounds(edges: DataFrame, perms: DataFrame, sizes: list[int], rounds: int, seed: int) -> DataFrame:
    """(perm, r, e) of relations (r, e) of any size, round by round; tasks compare their rows as arrays."""
    buckets = F.array(*map(F.lit, sizes))[F.col("r")]
    now = edges.repartition(edges.sparkSession.sparkContext.defaultParallelism).join(F.broadcast(perms)).select("perm", "r", "e")
    source, target = F.shiftright("e", 32), F.col("e").bitwiseAND(F.lit(_WIDE - 1))
    count, columns = len(sizes), "bucket long, e long, new long"
    for turn in range(rounds):
        keyed = now.select("perm", "r", "e", source.alias("s"), target.alias("d"), buckets.alias("m"))
        keyed = keyed.select("perm", "r", F.expr(bucket_expression(seed, turn, "m")).alias("bucket"), "e").repartition("perm", "r", "bucket")
        salt = round_salt(seed, turn)
        offers = _by_task(keyed, columns, lambda t, salt=salt: _proposed(t, count, salt)).repartition("perm", "r", source)
        good = _by_task(offers, columns, lambda t: _fresh(t, count))
        settled = good.repartition("perm", "r", F.when(F.col("new") < 0, F.col("e")).otherwise(F.col("bucket")))
        before, now = now, written(_by_task(settled, "e long", lambda t: _traded(t, count)), "permuted")
        discard(before)
    return now


def permute(edges: DataFrame, permutations: int, rounds: int = 10, seed: int = 0) -> DataFrame:
    """(perm, rel, src, dst): degree-preserving permutations 1 .. permutations of every relation.

    As many are made at once as BATCH_EDGES allows, and kept with their ids, so neither shuffles nor rounds of all are ever on
    disk together.
    """
    by_number, numbers = coded(edges)
    by_number = written(by_number, "coded")
    out = None
    for first, some in batches(by_number.count(), permutations):
        made = permute_coded(by_number, some, rounds, seed, first)
        named = made
        for end, name in (("src", "s"), ("dst", "d")):
            named = named.join(sent(numbers).select(F.col("id").alias(end), F.col("idx").alias(name)), name)
        one = written(named.select("perm", "rel", "src", "dst"), "permutations")
        discard(made)
        out = one if out is None else out.unionByName(one)
    return out


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """(kind, id, name) of nodes given several times (kind, id, name, pos): the last name that isn't null stays; no id, no node."""
    given = rows.where("id is not null and id <> ''")
    last = F.max_by("name", F.when(F.col("name").isNotNull(), F.col("pos")))
    return given.groupBy("kind", "id").agg(last.alias("name"))


def upsert_edges(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (rel, src_kind, src, dst_kind, dst) of the metagraph's relations whose ends are both nodes."""
    kinds = rows.sparkSession.createDataFrame([(r, a, b) for r, (a, _, b) in METAGRAPH.items()], "rel string, src_kind string, dst_kind string")
    typed = rows.select("rel", "src", "dst").distinct().join(F.broadcast(kinds), "rel")  # ten rows
    for end in ("src", "dst"):
        typed = typed.join(nodes.select(F.col("kind").alias(f"{end}_kind"), F.col("id").alias(end)), [f"{end}_kind", end], "left_semi")
    return typed.select("rel", "src_kind", "src", "dst_kind", "dst")


def to_triples(edges: DataFrame) -> DataFrame:
    """(head, relation, tail) with Kind::id at both ends."""
    return edges.select(F.concat_ws("::", "src_kind", "src").alias("head"), F.col("rel").alias("relation"), F.concat_ws("::", "dst_kind", "dst").alias("tail"))


def from_triples(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """Typed edges of triples whose ends are Kind::id; both ends must be nodes."""
    head, tail = F.split("head", "::", 2), F.split("tail", "::", 2)
    rows = triples.select(F.col("relation").alias("rel"), head[0].alias("src_kind"), head[1].alias("src"), tail[0].alias("dst_kind"), tail[1].alias("dst")).where("src is not null and dst is not null")
    return upsert_edges(rows, nodes)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes that an edge has at one of its ends."""
    used = edges.select(F.col("src_kind").alias("kind"), F.col("src").alias("id")).union(edges.select("dst_kind", "dst")).distinct()
    return nodes.join(used, ["kind", "id"], "left_semi")


def build(nodes: DataFrame, edges: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as they are kept: nodes upserted, edges between them, isolated nodes gone; with path also exported: merged
    into the graph kept there, as triples and as node and edge lists."""
    kept = upsert_nodes(nodes)
    found = upsert_edges(edges, kept)
    kept = connected(kept, found)
    if path:
        from linkweave.sources import store, writers

        kept, found = written(kept, "nodes"), written(found, "edges")
        store.upsert(kept.sparkSession, f"{path}/graph", kept, found)
        writers.write_triples(found, f"{path}/triples")
        writers.write_nodes(kept, f"{path}/nodes.tsv")
        writers.write_sif(found, f"{path}/edges.sif")
    return kept, found


def metanodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, nodes, metaedges, unconnected) of every kind of node."""
    ends = edges.select(F.col("src_kind").alias("kind"), F.col("src").alias("id"), "rel").union(edges.select("dst_kind", "dst", "rel"))
    relations = ends.groupBy("kind").agg(F.count_distinct("rel").alias("metaedges"))
    used = ends.select("kind", "id").distinct().withColumn("_u", F.lit(1))
    n = nodes.join(used, ["kind", "id"], "left").groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("_u").isNull()).alias("unconnected"))
    return n.join(relations, "kind", "left").select("kind", "nodes", F.coalesce("metaedges", F.lit(0).cast("long")).alias("metaedges"), "unconnected")
