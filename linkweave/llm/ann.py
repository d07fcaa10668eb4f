"""Nearest neighbours by additive quantisation with an exact check.

Codebooks of full dimension are fitted one after another on what the former leave of a bounded sample (FIT vectors of length 1,
the least hashes). Every vector's direction is encoded by a beam search over sums of one codeword from each book and stored as one
byte a book with the vector's norm over that of the sum and a bound of what the code leaves. Queries and codes meet in blocks of
bounded size, so no task or driver holds all of either. In a block a query scores all codes by table lookups, and its best SHORTLIST
codes are scored again exactly by their vectors, which came along. An exact check follows: an estimate is off by the norms of query
and remainder at most, so every further code whose estimate comes within that bound of the k-th best score is scored exactly too.
Only the k best leave the block, and they are the nearest whatever the vectors: codes that fit rows badly cost time, not results.

Every query looks at every code: cells of a coarse partition would have to be probed by the half to keep nine in ten of the
neighbours among vectors that lie evenly in all directions (README), so work is queries times rows, a lookup a book.

Equal vectors are one index entry with their K + 1 least ids: as many as any query's result can name, so a vector that many
rows share neither fills the shortlist nor gathers in a task.

Edge cases: vectors that are null, zero, of another length than most, or that hold a null or non-finite number take no part;
rows without vec_id take no part; equal rows count once; ties go to the smaller vec_id; an empty table gives an empty result;
a query with fewer candidates than K gets them all; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitslice import run_bounds, runs_of
from .common import materialise, tidied

BOOKS, WORDS, BEAM = 24, 256, 2
FIT = 8192
SHORTLIST = 240
CODES, QUERIES = 65536, 4096
#: Queries that are scored at once, and the rounding of bounds and sums in double precision, relative to norms.
TURN, ROUNDING = 64, 1e-11


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part; v is array<float> where they are given so, else array<double>."""
    kind = "array<float>" if dict(rows.dtypes)[embedding] == "array<float>" else "array<double>"
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(kind).alias("v")).where("vec_id is not null and size(v) > 0")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = materialise(rows.where(good), "vectors")
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return rows.where(F.size("v") == (usual[0].d if usual else 0))


def nearest_word(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (book * book).sum(axis=1) / 2
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (x[lo : lo + 4096] @ book.T - half).argmax(axis=1)
    return out


def fit_books(sample: np.ndarray, rounds: int = 8) -> np.ndarray:
    """[BOOKS, WORDS, d] codebooks, each by k-means of the residuals so far."""
    rng = np.random.default_rng(8)
    left = sample.astype(np.float32).copy()
    books = np.zeros((BOOKS, WORDS, sample.shape[1]), np.float32)
    for m in range(BOOKS):
        book = left[rng.choice(len(left), WORDS, replace=len(left) < WORDS)].copy()
        for _ in range(rounds):
            at = nearest_word(left, book)
            n = np.bincount(at, minlength=WORDS)
            order = np.argsort(at, kind="stable")
            total = np.zeros_like(book)
            held = np.nonzero(n)[0]
            total[held] = np.add.reduceat(left[order], (np.cumsum(n) - n)[held], axis=0)
            book[held] = total[held] / n[held, None]
        books[m] = book
        left -= book[nearest_word(left, book)]
    return books


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, also where squares would overflow or vanish."""
    most = np.maximum(np.abs(x).max(axis=1, initial=0.0), np.finfo(np.float64).tiny)
    return most * np.linalg.norm(x / most[:, None], axis=1)


def directions(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes [n, BOOKS] of the directions by beam search, the norm of each vector over that of its sum of codewords, and the most
    by which an estimate for a query of length 1 can be off, with the rounding of estimates in single precision."""
    exact = x.astype(np.float64)
    norm, unit = norms(exact), directions(exact)
    x = unit.astype(np.float32)
    n = len(x)
    left, codes = x[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for book in books:
        half = (book * book).sum(axis=1) / 2
        gain = left @ book.T - half
        cost = (left * left).sum(axis=2)[:, :, None] / 2 - gain
        width = min(BEAM, cost.shape[1] * cost.shape[2])
        best = np.argpartition(cost.reshape(n, -1), width - 1, axis=1)[:, :width]
        beam, word = best // len(book), best % len(book)
        left = np.take_along_axis(left, beam[:, :, None], axis=1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    pick = (left * left).sum(axis=2).argmin(axis=1)
    codes = codes[np.arange(n), pick]
    near, size = np.zeros_like(unit), np.zeros(n)
    for m, book in enumerate(books.astype(np.float64)):
        near += book[codes[:, m]]
        size += np.linalg.norm(book, axis=1)[codes[:, m]]
    ratio = np.clip(1 / np.maximum(np.linalg.norm(near, axis=1), 1e-12), 0.5, 2.0)
    off = np.linalg.norm(unit - ratio[:, None] * near, axis=1) + (x.shape[1] + 64) * 2.0**-22 * (1 + ratio * size)
    return codes, ratio * norm, off * norm


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _encode_batches(batches, books):
    return tidied(_encoded(batches, books))


def _encoded(batches, books):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        parts = [encode(x[lo : lo + 1024], books) for lo in range(0, len(x), 1024)]
        codes, ratio, off = (np.concatenate(p) for p in zip(*parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(ratio), pa.array(off), batch.column(1), batch.column(2)],
            ["entry", "code", "ratio", "off", "v", "ids"],
        )


def lookup_scores(queries: np.ndarray, codes: np.ndarray, ratio: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Estimated inner products [queries, codes]: for each query a table of its products with all codewords, then lookups."""
    tables = np.einsum("qd,mkd->mqk", queries.astype(np.float32), books, optimize=True)
    out = tables[0][:, codes[:, 0]]
    for m in range(1, len(books)):
        out += tables[m][:, codes[:, m]]
    return out * ratio


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed component by component in order, so equal sums are equal numbers."""
    out = np.zeros(len(vectors))
    for d in range(len(query)):
        out += vectors[:, d].astype(np.float64) * query[d]
    return out


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products [queries, vectors] in double precision, summed in any order."""
    out = np.empty((len(queries), len(vectors)))
    for lo in range(0, len(vectors), 8192):
        out[:, lo : lo + 8192] = queries @ vectors[lo : lo + 8192].astype(np.float64).T
    return out


def named_best(entries: np.ndarray, score: np.ndarray, ids: np.ndarray, edge: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The k best (-score, id) of the ids that entries name, own left out; an entry names its least id first."""
    first = ids[edge[entries]]
    best = np.lexsort((first, -score))[: k + np.count_nonzero(first == own)]  # k of them at least name another row
    found = [(-s, i) for s, e in zip(score[best].tolist(), entries[best].tolist()) for i in ids[edge[e] : edge[e + 1]].tolist() if i != own]
    return sorted(found)[:k]


def _block_batches(batches, books, shortlist, k):
    return tidied(_blocks(batches, books, shortlist, k))


def _blocks(batches, books, shortlist, k):
    for t in runs_of(batches, ["cb", "qb"], rows=1):
        for lo, n in zip(*run_bounds(t, ["cb", "qb"])):
            part = t.slice(lo, n)
            is_query = part["code"].is_null().to_numpy()
            mask = pa.array(~is_query)
            named, asked = part["ids"].filter(mask).combine_chunks(), part["id"].to_numpy()[is_query]
            owner = part["own"].filter(pa.array(is_query)).to_numpy()
            if not len(named) or not len(asked):
                continue
            codes = np.frombuffer(b"".join(part["code"].filter(mask).to_pylist()), np.uint8).reshape(len(named), -1)
            ratio, off = part["ratio"].to_numpy()[~is_query], part["off"].to_numpy()[~is_query]
            v = _matrix(part["v"].combine_chunks())
            x, q = v[~is_query], v[is_query].astype(np.float64)
            ids, edge = named.flatten().to_numpy(), np.append(0, np.cumsum(named.value_lengths().to_numpy()))
            short, lengths = min(shortlist, len(named)), norms(x.astype(np.float64))
            for at in range(0, len(asked), TURN):
                sizes = norms(q[at : at + TURN])
                guess = lookup_scores(directions(q[at : at + TURN]), codes, ratio, books)
                top = np.argpartition(-guess, short - 1, axis=1)[:, :short]
                out, all_sums = [], None
                for row, (no, own) in enumerate(zip(asked[at : at + TURN].tolist(), owner[at : at + TURN].tolist())):
                    size, bound = sizes[row], guess[row] + off
                    near, score = top[row], exact_scores(x[top[row]], q[at + row])
                    found = named_best(near, score, ids, edge, own, k)
                    least = -found[-1][0] if len(found) == k else -np.inf
                    more = ~(bound < least / size - ROUNDING * np.abs(bound))  # what isn't a number can't be excluded
                    more[near] = False
                    rest = np.nonzero(more)[0]
                    if 8 * len(rest) > len(named) and all_sums is None:
                        all_sums = products(q[at : at + TURN], x)
                    sums = x[rest] @ q[at + row] if all_sums is None else all_sums[row, rest]
                    rest = rest[~(sums < least - ROUNDING * size * lengths[rest])]  # then the ordered sums
                    if len(rest):
                        near, score = np.append(near, rest), np.append(score, exact_scores(x[rest], q[at + row]))
                        found = named_best(near, score, ids, edge, own, k)
                    out += [(no, own, i, -s) for s, i in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out) if out else ([], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["no", "query_id", "vec_id", "score"])


def search(rows: DataFrame, every: int = 20, k: int = 20, shortlist: int = SHORTLIST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by every, the k rows of largest inner product."""
    vectors = usable(rows)
    mark = (F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    once = vectors.select("vec_id", "v", *mark).dropDuplicates(["vec_id", "a", "b"])
    least = once.withColumn("r", F.row_number().over(Window.partitionBy("a", "b").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    entry = least.groupBy("a", "b").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))  # k + 1 ids
    entries = materialise(entry.select(F.col("ids")[0].alias("entry"), "ids", "v"), "entries")
    queries = materialise(once.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.monotonically_increasing_id().alias("no"), F.col("vec_id").alias("query_id"), "v"), "queries")
    kinds = "query_id long, rank int, vec_id long, score double"
    n, asked = entries.count(), queries.count()
    if not n or not asked:
        return rows.sparkSession.createDataFrame([], kinds)
    sample = entries.orderBy(F.xxhash64("v"), "entry").limit(FIT).select("v").toPandas()
    books = fit_books(directions(np.array(sample.v.tolist(), np.float64)))
    kind = dict(entries.dtypes)["v"]
    coded = entries.select("entry", "v", "ids").mapInArrow(partial(_encode_batches, books=books), f"entry long, code binary, ratio double, off double, v {kind}, ids array<bigint>")
    coded = materialise(coded, "codes")

    code_blocks, query_blocks = math.ceil(n / CODES), math.ceil(asked / QUERIES)
    none = F.lit(None)
    left = coded.select(
        F.pmod(F.xxhash64("entry"), F.lit(code_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")).alias("qb"),
        F.col("entry").alias("id"), none.cast("long").alias("own"), "code", "ratio", "off", "v", "ids",
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1)).cast("array<bigint>")).alias("cb"), F.pmod(F.xxhash64("no"), F.lit(query_blocks)).alias("qb"),
        F.col("no").alias("id"), F.col("query_id").alias("own"), none.cast("binary").alias("code"), none.cast("double").alias("ratio"), none.cast("double").alias("off"), "v", none.cast("array<bigint>").alias("ids"),
    )
    dealt = left.unionByName(right).repartition("cb", "qb").sortWithinPartitions("cb", "qb")
    best = dealt.mapInArrow(partial(_block_batches, books=books, shortlist=shortlist, k=k), "no long, query_id long, vec_id long, score double")
    order = Window.partitionBy("no").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
