"""Sums of products of two factors over what they share, block by block: no pair of ends is ever shuffled.

A product of (x, v) with (v, y) has far more pairs (x, y) than rows on either side. Rows of the left factor are dealt to blocks of
x and repeated for every block of y, those of the right one the other way round, so a task holds all that a block of pairs needs
and adds up its pairs by itself, some sources at a time. Numbers of blocks follow from the counted rows: what is repeated stays
least while a block's rows stay below BLOCK_ROWS.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkweave.tables import sent, written

#: Rows of both factors in a block, products of a block aimed at, cells of a dense factor, and cells or products that are held at
#: once: few enough for the processor's cache.
BLOCK_ROWS, BLOCK_PRODUCTS, DENSE, HELD = 2_000_000, 40_000_000, 8_000_000, 200_000
#: Products of a block below which more blocks don't pay.
LEAST_PRODUCTS = 500_000
_LEFT, _RIGHT, _PAIR = 0, 1, 2
#: Graphs that a block holds besides the observed one, and products aimed at where only statistics leave a block.
GRAPHS, FOLDED_PRODUCTS = 8, 200_000_000
#: Products of a graph that is held whole, up to which its pairs are kept from its mean to its statistics.
ONCE = 4_000_000


def blocks(left: int, right: int, products: int, most: int = BLOCK_ROWS, aim: int = BLOCK_PRODUCTS) -> tuple[int, int]:
    """Blocks of x and of y for factors of so many rows."""
    left, right = max(1, left), max(1, right)
    every = max(1, ceil(products / aim))
    nx = min(every, max(1, round(sqrt(every * left / right))))
    ny = ceil(every / nx)
    while left / nx + right / ny > most:
        if left / nx > right / ny:
            nx *= 2
        else:
            ny *= 2
    return nx, ny


def _codes(*columns: pa.ChunkedArray) -> tuple[list[np.ndarray], pa.Array]:
    """Numbers in place of values, the same in all columns, and the values."""
    at = np.cumsum([0, *(len(c) for c in columns)])
    every = pa.chunked_array([k for c in columns for k in c.chunks], columns[0].type).combine_chunks()
    every = every if isinstance(every, pa.Array) else pa.concat_arrays(every.chunks)
    coded = every.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return [codes[a:b] for a, b in zip(at, at[1:])], coded.dictionary


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


class _Factors:
    """One term of a block: rows of the left factor by x, rows of the right one by v."""

    def __init__(self, x, v, lw, ln, u, y, rw, rn, nx, nv, ny):
        by_x, by_v = np.argsort(x, kind="stable"), np.argsort(u, kind="stable")
        self.v, self.lw, self.ln = v[by_x], lw[by_x], ln[by_x].astype(float)
        self.x = x[by_x]
        self.first = np.searchsorted(self.x, np.arange(nx + 1))
        self.y, self.rw, self.rn = y[by_v], rw[by_v], rn[by_v].astype(float)
        self.start = np.searchsorted(u[by_v], np.arange(nv + 1))
        self.size = np.diff(self.start)
        self.made = np.add.reduceat(np.append(self.size[self.v], 0), self.first[:-1]) * (np.diff(self.first) > 0) if nx else np.zeros(0, int)
        self.ny, self.used = ny, np.unique(self.v[self.size[self.v] > 0])
        # The weights of all products together, without making one.
        self.total = float(self.lw @ np.bincount(u, weights=rw, minlength=nv)[self.v]) if self.v.size else 0.0
        # Few shared values and many products: a product of dense matrices.
        self.dense = 0 < self.used.size * ny <= DENSE and self.used.size * nx * ny <= 30 * self.made.sum()
        if self.dense:
            self.place = np.full(nv, -1)
            self.place[self.used] = np.arange(self.used.size)
            place = np.repeat(self.place, self.size)
            ok = place >= 0
            cell = place[ok] * ny + self.y[ok]
            self.right = [np.bincount(cell, weights=r[ok], minlength=self.used.size * ny).reshape(-1, ny) for r in (self.rw, self.rn)]

    def add(self, a: int, b: int, out: list, weights: bool, full: bool) -> None:
        """Products of sources a to b: to dense sums in out, or as (cell, w, n) behind them; w only with weights."""
        lo, hi = self.first[a], self.first[b]
        v, x = self.v[lo:hi], self.x[lo:hi] - a
        if self.dense and full:
            ok = self.place[v] >= 0
            cell = x[ok] * self.used.size + self.place[v[ok]]
            for k, side in enumerate((self.lw, self.ln)):
                if k or weights:
                    out[k] += (np.bincount(cell, weights=side[lo:hi][ok], minlength=(b - a) * self.used.size).reshape(b - a, -1) @ self.right[k]).ravel()
            return
        size = self.size[v]
        row = np.repeat(np.arange(v.size), size)
        at = np.arange(row.size) + np.repeat(self.start[v] - np.cumsum(size) + size, size)
        out.append((x[row] * self.ny + self.y[at], self.lw[lo:hi][row] * self.rw[at] if weights else None, self.ln[lo:hi][row] * self.rn[at]))


def _cut(made: np.ndarray, ny: int) -> Iterator[tuple[int, int]]:
    """Runs of sources whose products, or cells, are no more than HELD; one source at least."""
    total, a = np.cumsum(made), 0
    while a < made.size:
        done = total[a - 1] if a else 0
        sparse = int(np.searchsorted(total, done + HELD, "right"))
        dense = a + HELD // max(1, ny)
        b = min(made.size, max(a + 1, sparse, dense))
        yield a, b
        a = b


class Graph:
    """The terms of one graph in a block: pairs of its sources, some at a time."""

    def __init__(self, terms: list[tuple], pairs: tuple, nx: int, nv: int, ny: int):
        """terms (x, v, w, n, v, y, w, n) of both factors, pairs (x, y, w, n) of what needs no sum; all numbered."""
        self.ny, self.terms = ny, [f for t in terms if (f := _Factors(*t, nx, nv, ny)).used.size]
        by_x = np.argsort(pairs[0], kind="stable")
        self.px, self.py, self.pw, self.pn = (c[by_x] for c in pairs)
        self.pn = self.pn.astype(float)
        self.pfirst = np.searchsorted(self.px, np.arange(nx + 1))
        self.made = sum((f.made for f in self.terms), np.diff(self.pfirst))

    def total(self) -> float:
        """The sum of the weights of all pairs."""
        return sum(f.total for f in self.terms) + float(self.pw.sum())

    def pairs(self, a: int, b: int, weights: bool = True) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        """(cell, w, n) of sources a to b where n is positive; cells count rows of ny from source a, in any order; w only with weights."""
        count, cells = int(self.made[a:b].sum()), (b - a) * self.ny
        if not count:
            return np.zeros(0, int), np.zeros(0), np.zeros(0)
        full = cells <= max(HELD, 4 * count)  # one array of cells, or the cells that occur
        out = [np.zeros(cells) if weights else None, np.zeros(cells)] if full else [None, None]
        for f in self.terms:
            f.add(a, b, out, weights, full)
        some = slice(self.pfirst[a], self.pfirst[b])
        out.append(((self.px[some] - a) * self.ny + self.py[some], self.pw[some], self.pn[some]))
        if full:
            for cell, *values in out[2:]:
                for k, c in enumerate(values):
                    if cell.size and out[k] is not None:
                        if cell.size * 4 < cells:
                            np.add.at(out[k], cell, c)
                        else:
                            out[k] += np.bincount(cell, weights=c, minlength=cells)
            w, n = out[:2]
            where = np.flatnonzero(n > 0.5)
            return where, w[where] if weights else None, n[where]
        cell = np.concatenate([c for c, _, _ in out[2:]])
        n = np.concatenate([c[2] for c in out[2:]])
        w = np.concatenate([c[1] for c in out[2:]]) if weights else None
        often = _repeated(cell)
        some = np.flatnonzero(often)
        if not some.size:  # each cell comes once
            hit = n > 0.5
            return (cell, w, n) if hit.all() else (cell[hit], w[hit] if weights else None, n[hit])
        some = some[np.argsort(cell[some], kind="stable")]
        few = cell[some]
        first = np.flatnonzero(np.append(True, few[1:] != few[:-1]))
        summed = lambda v: None if v is None else np.add.reduceat(v[some], first)
        often |= n <= 0.5
        once = np.flatnonzero(~often)
        fn, fw = summed(n), summed(w)
        hit = fn > 0.5
        return np.append(cell[once], few[first[hit]]), np.append(w[once], fw[hit]) if weights else None, np.append(n[once], fn[hit])


def _repeated(cell: np.ndarray) -> np.ndarray:
    """Which cells come more than once; sorting the values alone is many times faster than sorting with places."""
    ordered = np.sort(cell)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not twice.size:
        return np.zeros(cell.size, bool)
    maybe = np.flatnonzero(_marked(twice, cell))
    at = np.minimum(np.searchsorted(twice, cell[maybe]), twice.size - 1)
    out = np.zeros(cell.size, bool)
    out[maybe[twice[at] == cell[maybe]]] = True
    return out


def _marked(some: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which cells may be among some, by their low bits: all that are, and few others."""
    size = 1 << max(8, (8 * some.size).bit_length())
    mark = np.zeros(size, bool)
    mark[some & (size - 1)] = True
    return mark[cell & (size - 1)]


def _graph(table, x, v, u, y, px, py, nx: int, nv: int, ny: int) -> Graph:
    """The graph of (left, right, pair rows) with the codes of their ends."""
    left, right, pair = table
    lt, rt = _numbers(left, "term"), _numbers(right, "term")
    terms = []
    for t in np.unique(lt):
        a, b = lt == t, rt == t
        terms.append((x[a], v[a], _numbers(left, "w")[a], _numbers(left, "n")[a], u[b], y[b], _numbers(right, "w")[b], _numbers(right, "n")[b]))
    return Graph(terms, (px, py, _numbers(pair, "w"), _numbers(pair, "n")), nx, nv, ny)


def _block(table: pa.Table):
    """((left, right, pair rows), codes of x and v, of v and y, of x and y, values of x, values of y, how many v) of a block."""
    side = _numbers(table, "side")
    left, right, pair = (table.filter(pa.array(side == k)) for k in (_LEFT, _RIGHT, _PAIR))
    (x, px), xs = _codes(left["p"], pair["p"])
    (y, py), ys = _codes(right["q"], pair["q"])
    (v, u), vs = _codes(left["q"], right["p"])
    return (left, right, pair), ((x, v), (u, y), (px, py)), xs, ys, len(vs)


def block_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]]:
    """(x, y, w, n, values of x, values of y) of the pairs of one block whose n is positive, some sources at a time."""
    rows, codes, xs, ys, nv = _block(table)
    one, ny = _graph(rows, *(c for two in codes for c in two), len(xs), nv, len(ys)), len(ys)
    for a, b in _cut(one.made, ny):
        where, w, n = one.pairs(a, b)
        if where.size:
            yield where // ny + a, where % ny, w, np.rint(n).astype(np.int64), xs, ys


def _asinh(x: np.ndarray) -> np.ndarray:
    """asinh of positive numbers, by a logarithm where that is as exact."""
    out = np.log(x + np.sqrt(x * x + 1))
    small = np.flatnonzero(x < 0.01)
    out[small] = np.arcsinh(x[small])
    return out


class _Spread:
    """Numbers, means, squared deviations and extremes of values by key, which add up."""

    def __init__(self, keys: int):
        self.n, self.mean, self.squares, self.hits = (np.zeros(keys) for _ in range(4))
        self.low, self.high = np.full(keys, np.inf), np.full(keys, -np.inf)

    def add(self, key: np.ndarray, value: np.ndarray) -> None:
        keys = self.n.size
        n = np.bincount(key, minlength=keys).astype(float)
        mean = np.bincount(key, weights=value, minlength=keys) / np.maximum(n, 1)
        off = value - mean[key]
        every, step = np.maximum(self.n + n, 1), mean - self.mean
        self.squares += np.bincount(key, weights=off * off, minlength=keys) + step * step * self.n * n / every
        self.mean += step * n / every
        self.n += n
        np.minimum.at(self.low, key, value)
        np.maximum.at(self.high, key, value)

    def rows(self, sd: np.ndarray, td: np.ndarray) -> dict[str, pa.Array]:
        """A row of each key that has values or hits; keys count the degrees td of targets for each of the degrees sd."""
        k = np.flatnonzero((self.n > 0) | (self.hits > 0))
        return {
            "source_degree": pa.array(sd[k // td.size]), "target_degree": pa.array(td[k % td.size]), "n": pa.array(self.n[k].astype(np.int64)), "mean": pa.array(self.mean[k]),
            "var": pa.array(self.squares[k] / np.maximum(self.n[k], 1)), "low": pa.array(self.low[k]), "high": pa.array(self.high[k]), "hits": pa.array(self.hits[k].astype(np.int64)),
        }


class _Observed:
    """Pairs of the observed graph among the cells of some sources, and how many graphs hold them."""

    def __init__(self, where: np.ndarray, cells: int):
        self.full = where.size * 16 > cells
        self.where = where.astype(np.int32) if cells < 1 << 31 else where
        self.count = np.zeros(cells if self.full else where.size, np.int32)

    def add(self, where: np.ndarray) -> None:
        if self.full:
            self.count[where] += 1
        elif self.where.size and where.size:
            where = where[_marked(self.where, where)]
            at = np.minimum(np.searchsorted(self.where, where), self.where.size - 1)
            self.count[at[self.where[at] == where]] += 1

    def hits(self) -> np.ndarray:
        return self.count[self.where] if self.full else self.count


def _graphs(table: pa.Table):
    """(graphs of a block by number, lazily; runs of sources; values of x and y; degree of each x and y)."""
    rows, codes, xs, ys, nv = _block(table)
    perms = [_numbers(r, "perm") for r in rows]

    def graph(perm: int) -> Graph:
        mine = [np.flatnonzero(p == perm) for p in perms]
        return _graph([r.take(pa.array(m)) for r, m in zip(rows, mine)], *(c[m] for two, m in zip(codes, mine) for c in two), len(xs), nv, len(ys))

    degree = [np.zeros(len(xs), np.int64), np.zeros(len(ys), np.int64)]
    for k, code, where in ((0, codes[0][0], rows[0]), (0, codes[2][0], rows[2]), (1, codes[1][1], rows[1]), (1, codes[2][1], rows[2])):
        degree[k][code] = _numbers(where, ("dp", "dq")[k])
    return graph, sorted(set(np.concatenate(perms).tolist())), xs, ys, degree


def _sums(table: pa.Table) -> pa.RecordBatch:
    """(perm, n, w): how many pairs each graph has in a block, and the sum of their weights; pairs are only counted."""
    graph, perms, _, ys, _ = _graphs(table)
    out = {}
    for p in perms:
        one = graph(p)
        out[p] = sum(one.pairs(a, b, False)[0].size for a, b in _cut(one.made, len(ys))), one.total()
    return pa.RecordBatch.from_pydict({"perm": pa.array(perms, pa.int32()), "n": pa.array([out[p][0] for p in perms], pa.int64()), "w": pa.array([out[p][1] for p in perms], pa.float64())})


def _statistics(table: pa.Table, means: dict[int, float], each: bool) -> Iterator[dict[str, np.ndarray]]:
    """Of a block: statistics by degrees of both ends, then with each the observed pairs that other graphs hold."""
    graph, perms, xs, ys, (dx, dy) = _graphs(table)
    ny = len(ys)
    (sd, sx), (td, ty) = np.unique(dx, return_inverse=True), np.unique(dy, return_inverse=True)
    key = lambda where, a: sx[where // ny + a] * td.size + ty[where % ny]
    spread, observed = _Spread(sd.size * td.size), {}
    if 0 in perms:
        seen = graph(0)
        # All graphs are cut alike: they have the degrees of the observed one, so about its products.
        runs = list(_cut(seen.made, ny))
        for a, b in runs:
            observed[a] = _Observed(np.sort(seen.pairs(a, b, False)[0]), (b - a) * ny)
        del seen
    else:
        runs = None
    for p in perms:
        if p:
            one = graph(p)
            for a, b in runs or _cut(one.made, ny):
                where, w, _ = one.pairs(a, b)
                if where.size:
                    spread.add(key(where, a), _asinh(w / means[p]))
                    if observed:
                        observed[a].add(where)
    for a, o in observed.items():
        hits = o.hits()
        spread.hits += np.bincount(key(o.where.astype(np.int64), a), weights=hits, minlength=spread.n.size)
        if each:
            some = np.flatnonzero(hits)
            where = o.where[some].astype(np.int64)
            for lo in range(0, some.size, 100_000):
                s = slice(lo, lo + 100_000)
                yield {"source_id": xs.take(pa.array(where[s] // ny + a)), "target_id": ys.take(pa.array(where[s] % ny)), "n": pa.array(hits[some[s]].astype(np.int64))}
    yield spread.rows(sd, td)


class _Seen:
    """Pairs of the observed graph by source: in how many other graphs each is, with each, and how many are, by degrees."""

    def __init__(self, graph: Graph, key, each: bool):
        self.ny, self.key = graph.ny, key
        first, places = [np.zeros(1, np.int64)], []
        for a, b in _cut(graph.made, graph.ny):
            where = np.sort(graph.pairs(a, b, False)[0])
            row = where // self.ny
            first.append(first[-1][-1] + np.cumsum(np.bincount(row, minlength=b - a)))
            places.append((where - row * self.ny).astype(np.int32))
        self.first, self.y = np.concatenate(first), np.concatenate([np.zeros(0, np.int32), *places])
        self.count = np.zeros(self.y.size, np.int32) if each else None

    def add(self, a: int, b: int, where: np.ndarray, spread: _Spread) -> None:
        """Pairs of another graph among sources a to b."""
        lo, hi = self.first[a], self.first[b]
        if lo == hi or not where.size:
            return
        cells = np.repeat(np.arange(b - a) * self.ny, np.diff(self.first[a : b + 1])) + self.y[lo:hi]
        some = where[_marked(cells, where)]
        at = np.minimum(np.searchsorted(cells, some), cells.size - 1)
        same = cells[at] == some
        spread.hits += np.bincount(self.key(some[same], a), minlength=spread.n.size)
        if self.count is not None:
            self.count[lo + at[same]] += 1

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(source, target, graphs that hold it) of the pairs that others hold."""
        hit = np.flatnonzero(self.count) if self.count is not None else np.zeros(0, int)
        for lo in range(0, hit.size, 100_000):
            some = hit[lo : lo + 100_000]
            yield np.searchsorted(self.first, some, "right") - 1, self.y[some], self.count[some].astype(np.int64)


def whole_statistics(observed: Graph, graphs: Iterator[Graph], xs: np.ndarray, ys: np.ndarray, dx: np.ndarray, dy: np.ndarray, each: bool) -> Iterator[dict[str, pa.Array]]:
    """What folded() gives, of whole graphs: those of the observed one's ends xs and ys, of degrees dx and dy.

    A graph's mean is known where its pairs are, so few enough pairs are made once.
    """
    ny = ys.size
    (sd, sx), (td, ty) = np.unique(dx, return_inverse=True), np.unique(dy, return_inverse=True)

    def key(where, a):
        row = where // ny
        return sx[row + a] * td.size + ty[where - row * ny]

    spread, seen = _Spread(sd.size * td.size), _Seen(observed, key, each)
    for one in graphs:
        runs = list(_cut(one.made, ny))
        if one.made.sum() <= ONCE:
            made = [(a, b, *one.pairs(a, b)[:2]) for a, b in runs]
            count = sum(m[2].size for m in made)
        else:
            made = ((a, b, *one.pairs(a, b)[:2]) for a, b in runs)
            count = sum(one.pairs(a, b, False)[0].size for a, b in runs)
        mean = one.total() / max(1, count)
        for a, b, where, w in made:
            if where.size:
                spread.add(key(where, a), _asinh(w / mean))
                seen.add(a, b, where, spread)
    for x, y, n in seen.found():
        yield {"source_id": pa.array(xs[x]), "target_id": pa.array(ys[y]), "n": pa.array(n)}
    yield spread.rows(sd, td)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[list, pa.Table]]:
    """(values of keys, rows) of each block that a task holds."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    each = table.select(keys).group_by(keys).aggregate([]).to_pylist()
    if len(each) == 1:
        yield list(each[0].values()), table
        return
    codes = reduce(lambda c, k: c * (1 + k.max(initial=0)) + k, [_codes(table[k])[0][0] for k in keys])
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    for some in np.split(order, cuts):
        one = table.take(pa.array(some))
        yield [one[k][0].as_py() for k in keys], one


def dealt(terms: list[tuple[DataFrame | None, DataFrame | None, DataFrame | None]], by: tuple[str, ...] = (), ends: list[DataFrame] | None = None) -> DataFrame:
    """Rows of all blocks, block by block, of terms (left, right, pairs).

    left (by.., p, q, w, n) has x and v, right v and y, pairs (by.., p, q, w, n) both ends of what needs no sum. With ends, written
    tables (id, degree) of both, rows have the degrees of their ends as dp and dq, and a block holds only GRAPHS graphs (perm) and
    the one of number 0.
    """
    sides = []
    for t, term in enumerate(terms):
        for k, rows in enumerate(term):
            if rows is not None:
                rows = rows.select(F.lit(k).alias("side"), F.lit(t).alias("term"), *by, "p", "q", "w", F.col("n").cast("long").alias("n"))
                for end, name, there in (("p", "dp", k != _RIGHT), ("q", "dq", k != _LEFT)) if ends else ():
                    degree = sent(ends[name == "dq"]).select(F.col("id").alias(end), F.col("degree").alias(name))
                    rows = rows.join(degree, end) if there else rows.withColumn(name, F.lit(0).cast("long"))
                sides.append(rows)
    held = written(reduce(DataFrame.unionByName, sides), "factors")
    size = {r.side: r.rows for r in held.groupBy("side").agg(F.count("*").alias("rows")).collect()}  # three rows
    degree = lambda k, end: held.where(F.col("side") == k).groupBy("term", *by, F.col(end).alias("v")).agg(F.count("*").alias(f"d{k}"))
    met = degree(_LEFT, "q").join(degree(_RIGHT, "p"), ["term", *by, "v"]).agg(F.sum(F.col("d0") * F.col("d1"))).first()[0] or 0
    parts = max(1, ceil((held.select("perm").distinct().count() - 1) / GRAPHS)) if ends else 1  # a row a graph
    # A block is a task: few products are dealt to all cores, and what follows pairs has as many files.
    some = min(BLOCK_PRODUCTS, max(LEAST_PRODUCTS, ceil(met / (3 * held.sparkSession.sparkContext.defaultParallelism))))
    nx, ny = blocks(*(ceil(c / parts) for c in (size.get(_LEFT, 0) + size.get(_PAIR, 0), size.get(_RIGHT, 0), met)), aim=FOLDED_PRODUCTS if ends else some)
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    if ends:
        every = F.sequence(F.lit(0), F.lit(parts - 1))
        held = held.withColumn("_part", F.explode(F.when(F.col("perm") == 0, every).otherwise(F.array(F.pmod("perm", F.lit(parts))))))
    else:
        held = held.withColumn("_part", F.lit(0))
    out = None
    for k, x, y in ((_LEFT, number("p", nx), each(ny)), (_RIGHT, each(nx), number("q", ny)), (_PAIR, number("p", nx), number("q", ny))):
        rows = held.where(F.col("side") == k).select("*", x.alias("_x")).select("*", y.alias("_y"))
        rows = rows.withColumn("block", (F.col("_part") * nx + F.col("_x")) * ny + F.col("_y")).drop("_x", "_y", "_part")
        out = rows if out is None else out.unionByName(rows)
    return out.repartitionById(parts * nx * ny, F.col("block"))


def summed(terms: list[tuple[DataFrame | None, DataFrame | None, DataFrame | None]], by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., a, b, w, n): the terms' products summed by pair of ends, of those pairs whose n is positive."""
    rows = dealt(terms, by)
    fields = {f.name: f for f in rows.schema}
    schema = StructType([fields[c] for c in by]).add("a", fields["p"].dataType).add("b", fields["q"].dataType).add("w", "double").add("n", "long")

    def pairs(batches):
        for keys, table in groups(batches, ["block", *by]):
            for x, y, w, n, xs, ys in block_pairs(table):
                for lo in range(0, x.size, 100_000):
                    s = slice(lo, lo + 100_000)
                    same = [pa.array([k] * w[s].size, table.schema.field(c).type) for k, c in zip(keys[1:], by)]
                    yield pa.RecordBatch.from_arrays([*same, xs.take(pa.array(x[s])), ys.take(pa.array(y[s])), pa.array(w[s]), pa.array(n[s])], names=[*by, "a", "b", "w", "n"])

    return rows.mapInArrow(pairs, schema)


def totals(terms: list[tuple[DataFrame | None, DataFrame | None, DataFrame | None]]) -> DataFrame:
    """(a, pairs, w, n): how many pairs of summed() each first end has, and their sums; pairs are counted where they are made."""
    rows = dealt(terms)
    schema = StructType().add("a", rows.schema["p"].dataType).add("pairs", "long").add("w", "double").add("n", "long")

    def sums(batches):
        for _, table in groups(batches, ["block"]):
            for x, _, w, n, xs, _ in block_pairs(table):
                some, place, count = np.unique(x, return_inverse=True, return_counts=True)
                paths = np.zeros(some.size, np.int64)
                np.add.at(paths, place, n)
                yield pa.RecordBatch.from_arrays([xs.take(pa.array(some)), pa.array(count), pa.array(np.bincount(place, weights=w)), pa.array(paths)], names=["a", "pairs", "w", "n"])

    return rows.mapInArrow(sums, schema).groupBy("a").agg(*(F.sum(c).alias(c) for c in ("pairs", "w", "n")))


def folded(terms: list[tuple[DataFrame | None, DataFrame | None, DataFrame | None]], ends: list[DataFrame], each: bool) -> DataFrame:
    """Statistics of the pairs of many graphs (perm from 1) that add up, with those of the observed one (perm 0) as hits.

    (source_degree, target_degree, n, mean, var, low, high, hits) by block, of values scaled by their graph's mean through asinh;
    hits: in how many graphs the observed pairs of these degrees are connected, all together. With each also (source_id,
    target_id, n), hits of observed pairs. Pairs are made twice inside blocks, for the graphs' means and for all else; none
    leaves its block.
    """
    rows = dealt(terms, ("perm",), ends)

    def sums(batches):
        for _, table in groups(batches, ["block"]):
            yield _sums(table)

    means = rows.where("perm > 0").mapInArrow(sums, "perm int, n long, w double").groupBy("perm").agg(F.try_divide(F.sum("w"), F.sum("n")).alias("mean")).collect()  # a row a graph; none where it has no pair
    means = {r.perm: r.mean for r in means if r.mean is not None}
    fields = {f.name: f.dataType for f in rows.schema}

    def statistics(batches):
        for _, table in groups(batches, ["block"]):
            yield from folded_batches(_statistics(table, means, each), table.schema.field("p").type, table.schema.field("q").type)

    return rows.mapInArrow(statistics, folded_schema(fields["p"], fields["q"]))


def folded_schema(source, target) -> StructType:
    out = StructType().add("source_id", source).add("target_id", target).add("source_degree", "long").add("target_degree", "long").add("n", "long")
    return out.add("mean", "double").add("var", "double").add("low", "double").add("high", "double").add("hits", "long")


def folded_batches(rows: Iterator[dict[str, pa.Array]], source: pa.DataType, target: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of folded() with nulls in place of what isn't told."""
    kinds = {"source_id": source, "target_id": target, **dict.fromkeys(("source_degree", "target_degree", "n", "hits"), pa.int64()), **dict.fromkeys(("mean", "var", "low", "high"), pa.float64())}
    names = ["source_id", "target_id", "source_degree", "target_degree", "n", "mean", "var", "low", "high", "hits"]
    for some in rows:
        count = len(next(iter(some.values())))
        yield pa.RecordBatch.from_arrays([some[c] if c in some else pa.nulls(count, kinds[c]) for c in names], names=names)
