"""Similarities, ratings, splits and rankings of links. Ratings are (item, user, rating) with rating -1, 0 or 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linkweave.tables import sent, written

from .products import groups


def order_key(seed, *columns) -> Column:
    """A random order that is the same everywhere: by MD5 of seed and keys."""
    seed = F.lit(str(seed)) if isinstance(seed, int | str) else seed.cast("string")
    return F.md5(F.concat_ws("|", seed, *columns))


def lowest(rows: DataFrame, key: Column, most: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows of least key in each group, as many as most (by.., most) says; ties by order.

    Keys are hexadecimal digests. Rows are counted by the first four digits, which tells where the cut falls; only the rows of
    that one part of 65,536 are ranked, so no group is ever sorted in one task.
    """
    keyed = rows.withColumn("_k", key).withColumn("_part", F.substring("_k", 1, 4))
    parts = keyed.groupBy(*by, "_part").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by, F.lit(0)).orderBy("_part")  # at most 65,536 rows
    parts = parts.withColumn("_before", F.sum("_c").over(w) - F.col("_c"))
    parts = parts.join(most, by) if by else parts.join(F.broadcast(most))  # without groups most is one row
    open_ = parts.where("_before < most").select(*by, "_part", (F.col("most") - F.col("_before")).alias("_room"), "_c")
    kept = keyed.join(open_, [*by, "_part"])
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_k", *order))
    whole = kept.where("_c <= _room")
    cut = kept.where("_c > _room").withColumn("_r", rank).where("_r <= _room").drop("_r")
    return whole.unionByName(cut).select(rows.columns)


def dense_index(rows: DataFrame, column: str, parts: int = 256) -> DataFrame:
    """rows (distinct in column) with idx, their place from 0 in the order of column.

    parts - 1 bounds, the values of least digests, cut the order into ranges; ranges are counted and ranked each on its own.
    """
    bounds = sorted(r[0] for r in rows.select(column).orderBy(F.md5(F.col(column).cast("string")), column).limit(parts - 1).collect())
    at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))) if bounds else F.lit(0)
    ranged = rows.withColumn("_part", at)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    sizes = sizes.select("_part", (F.sum("_c").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_c")).alias("_before"))  # at most parts rows
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return ranged.join(F.broadcast(sizes), "_part").withColumn("idx", (F.col("_before") + rank).cast("long")).drop("_part", "_before")


#: Ids of one feature that are compared in one piece.
CHUNK = 1024


def jaccard(features: DataFrame) -> DataFrame:
    """(a, b, similarity) for a <= b with a common feature, from distinct (id, feature): an inverted index, no pair without one.

    The ids of a frequent feature are cut into chunks of CHUNK on one side, so its pairs are made by many tasks.
    """
    size = features.groupBy("id").agg(F.count("*").alias("n"))
    held = features.groupBy("feature").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    f = features.join(size, "id").join(held, "feature")
    left = f.select("feature", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.col("id").alias("a"), F.col("n").alias("na"))
    right = f.select("feature", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"))
    both = left.join(right, ["feature", "part"]).where("a <= b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return both.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("similarity"))


def draw(want: DataFrame, items: DataFrame, taken: DataFrame, seed, by: list[str] | None = None) -> DataFrame:
    """(by.., item, user): for each row of want (by.., user, need) that many random items that taken doesn't hold, or all there are.

    taken is (item, user) or (by.., item, user). A user draws places in the ordered items by hash, 4 * need + 64 of them (the later
    ones only if the first few don't do), and keeps the first that are new to it. Where the items are fewer than four times what a user needs and holds, all of them are
    taken in a hashed order instead, which is never much more than the result. So no user is ever crossed with all items.
    """
    by = by or []
    mine = [c for c in by if c in taken.columns]
    numbered = written(dense_index(items.select("item").distinct(), "item"), "items")
    total = numbered.agg(F.count("*").alias("total"))  # one row
    # The places that a user holds are an array beside its draws, so only what is drawn in the end is ever shuffled.
    held = taken.select(*mine, "item", "user").distinct().join(sent(numbered), "item", "left")
    held = held.groupBy(*mine, "user").agg(F.count("*").alias("_held"), F.collect_list("idx").alias("_places"))
    know = want.where("need > 0").join(held, [*mine, "user"], "left").join(F.broadcast(total)).where("total > 0")
    know = know.withColumns({"_held": F.coalesce("_held", F.lit(0)), "_places": F.coalesce("_places", F.array().cast("array<bigint>"))})
    digest = lambda j: F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in by), "user", j.cast("string")))
    every = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), F.col("total") - 1), lambda j: F.struct(digest(j).alias("o"), j.alias("idx"))))["idx"]

    def first(draws):  # each place once, where it first comes
        places = F.transform(F.sequence(F.lit(0).cast("long"), draws - 1), lambda j: F.conv(F.substring(digest(j), 1, 12), 16, 10).cast("long") % F.col("total"))
        return F.array_except(places, "_places")

    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: users are few bytes, but draw much
    know, need = know.repartition(parts, *by, "user"), F.col("need").cast("long")
    few, most = need + F.floor(need / 8) + 8, 4 * need + 64
    know = know.withColumn("_all", F.col("total") <= 4 * (need + F.col("_held"))).withColumn("_first", F.when(~F.col("_all"), first(few)))
    chosen = F.when(F.col("_all"), F.array_except(every, "_places")).when(F.size("_first") >= need, F.col("_first")).otherwise(first(most))
    drawn = know.select(*by, "user", F.explode(F.slice(chosen, F.lit(1), need.cast("int"))).alias("idx"))
    return drawn.join(sent(numbered), "idx").select(*by, "item", "user")


def augmented(base: DataFrame, more: DataFrame) -> DataFrame:
    """(item, user, origin): base pairs, then the further ones that base doesn't hold."""
    extra = more.select("item", "user").distinct().join(base, ["item", "user"], "left_anti")
    return base.select("item", "user", F.lit("base").alias("origin")).unionByName(extra.withColumn("origin", F.lit("augmented")))


def random_control(base: DataFrame, target: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """base with random pairs added until each user has as many as in target; candidates are all items the user hasn't."""
    want = target.groupBy("user").agg(F.count("*").alias("t")).join(base.groupBy("user").agg(F.count("*").alias("b")), "user", "left")
    want = want.select("user", (F.col("t") - F.coalesce("b", F.lit(0))).alias("need"))
    return base.select("item", "user").unionByName(draw(want, items, base, seed))


def merge_ratings(ratings: DataFrame) -> DataFrame:
    """Every row with its pair's common rating: -1 if any is -1, else 1 if any is 1, else 0."""
    w = Window.partitionBy("item", "user")
    low, high = F.min("rating").over(w), F.max("rating").over(w)
    return ratings.withColumn("rating", F.when(low == -1, -1).when(high == 1, 1).otherwise(0))


def test_splits(positives: DataFrame, share: float, exps: DataFrame) -> DataFrame:
    """(exp, item, user): test positives of every experiment in exps (exp), which is also the seed.

    Every item and user keeps its first pair in hash order, a user gives at most max(1, round(share * n)), and all together at
    most floor(share * total).
    """
    rows = positives.select("item", "user").distinct().join(F.broadcast(exps))  # a row per experiment
    key = order_key(F.col("exp"), "item", "user")
    first = lambda by: F.row_number().over(Window.partitionBy("exp", by).orderBy("k", "item", "user"))
    n = F.count("*").over(Window.partitionBy("exp", "user"))
    rows = rows.withColumn("k", key).withColumns({"ri": first("item"), "ru": first("user"), "n": n}).where("ri > 1 and ru > 1")
    rows = rows.withColumn("q", F.row_number().over(Window.partitionBy("exp", "user").orderBy("k", "item")))
    rows = rows.where(F.col("q") <= F.greatest(F.lit(1), F.bround(F.col("n") * share))).select("exp", "item", "user", "k")
    most = exps.join(F.broadcast(positives.select("item", "user").distinct().agg(F.floor(F.count("*") * share).alias("most"))))  # one row
    return lowest(rows, F.col("k"), most, ["exp"], ["item", "user"]).select("exp", "item", "user")


def test_split(positives: DataFrame, share: float, seed: int) -> DataFrame:
    """test_splits of one experiment, without its number."""
    one = positives.sparkSession.range(seed, seed + 1).select(F.col("id").cast("int").alias("exp"))
    return test_splits(positives, share, one).select("item", "user")


def train_negatives(positives: DataFrame, test: DataFrame, items: DataFrame, per_positive: int, seed: int) -> DataFrame:
    """per_positive random non-positive items for each training positive of a user, none of them in the test set."""
    train = positives.join(test, ["item", "user"], "left_anti")
    want = train.groupBy("user").agg((F.count("*") * per_positive).alias("need"))
    return draw(want, items, positives.select("item", "user").unionByName(test.select("item", "user")), seed)


def leave_one_out(base: DataFrame, support: DataFrame, metapath: str) -> DataFrame:
    """Pairs of base and of support (item, user, metapath), without those that only this metapath supports."""
    count = support.groupBy("item", "user").agg(F.count_distinct("metapath").alias("n"), F.min("metapath").alias("one"))
    only = count.where((F.col("n") == 1) & (F.col("one") == metapath)).join(base, ["item", "user"], "left_anti")
    every = base.select("item", "user").union(support.select("item", "user")).distinct()
    return every.join(only, ["item", "user"], "left_anti")


def top_n(scores: DataFrame, n: int, liked: DataFrame | None = None) -> DataFrame:
    """The n best items of each user, those already liked left out."""
    if liked is not None:
        scores = scores.join(liked, ["item", "user"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "item"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= n)


def recommend(scores: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
    """The k best pairs of all, ties to the smaller user and item, or all pairs scored threshold or more; k wins over threshold."""
    if k is not None:
        return scores.orderBy(F.desc("score"), "user", "item").limit(k)
    if threshold is None:
        raise ValueError("k or threshold is needed")
    return scores.where(F.col("score") >= threshold)


def to_matrix(ratings: DataFrame, users: list[str]) -> DataFrame:
    """One row per item, one column per user: mean of repeated ratings, cut to int, 0 where there is none."""
    wide = ratings.groupBy("item").pivot("user", users).agg(F.avg("rating"))
    return wide.select("item", *(F.coalesce(F.col(f"`{u}`"), F.lit(0.0)).cast("int").alias(u) for u in users))


def from_matrix(wide: DataFrame) -> DataFrame:
    """Non-zero cells of a wide table whose first column is item."""
    users = wide.columns[1:]
    return wide.unpivot("item", users, "user", "rating").where("rating <> 0")


def subset(ratings: DataFrame, folds: DataFrame) -> DataFrame:
    """Ratings of the pairs that a fold makes observable."""
    return ratings.join(folds.select("item", "user").distinct(), ["item", "user"], "left_semi")


#: Vectors of either side that meet in a block, and cosines that are held at once.
MET, COSINES = 20_000, 2_000_000
#: Cosines are ranked by nine digits; what is within this of the n-th best may share its place.
_NEAR = 2e-9


def _best(q: np.ndarray, e: np.ndarray, other: np.ndarray, own: np.ndarray, n: int):
    """(query, row, cosine) of candidates for the n nearest of each query, itself left out; other, the rows' ids, ascends."""
    with np.errstate(all="ignore"):
        norm, m = np.sqrt((e * e).sum(1)), np.sqrt((q * q).sum(1))
        for lo in range(0, len(q), max(1, COSINES // max(1, len(e)))):
            hi = min(len(q), lo + max(1, COSINES // max(1, len(e))))
            c = q[lo:hi] @ e.T / (m[lo:hi, None] * norm)
            key = np.where(np.isnan(c), np.inf, c)  # as in SQL, NaN comes first
            key[own[lo:hi, None] == other] = -np.inf
            bound = np.full(hi - lo, -np.inf) if len(e) <= n else np.partition(key, len(e) - n, axis=1)[:, len(e) - n] - _NEAR
            i, j = np.nonzero((key >= bound[:, None]) & (key > -np.inf))
            order = np.lexsort((j, -key[i, j], i))
            i, j = i[order], j[order]
            # Of equal cosines of a query only the first n rows can be among its nearest.
            k = key[i, j]
            fresh = np.append(True, (i[1:] != i[:-1]) | (k[1:] != k[:-1]))[: len(i)]
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(i)), 0))
            some = np.arange(len(i)) - start < n
            yield i[some] + lo, j[some], c[i[some], j[some]]


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (ids, vectors)} in order of ids; vectors that are null or hold null are under -1."""
    table = table.sort_by("id")
    v, ids = table["v"].combine_chunks(), table["id"].to_numpy()
    v = v if isinstance(v, pa.Array) else pa.concat_arrays(v.chunks)
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    if v.flatten().null_count:
        parent = pc.list_parent_indices(v).to_numpy()
        size[parent[v.flatten().is_null().to_numpy(zero_copy_only=False)]] = -1
    out = {}
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        flat = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False) if n > 0 else np.zeros(0)
        out[int(n)] = (ids[at], flat.reshape(len(at), max(0, n)))
    return out


def nearest(rows: DataFrame, asked: DataFrame, n: int, parts: int = 16) -> DataFrame:
    """(item, other, rank, cosine): for each asked vector the n nearest of all rows by cosine, itself left out; (vec_id, v) each.

    Every row is compared with the stated set of queries, in blocks of both, of which there are as many as MET vectors a block
    need (parts of rows at least): a task multiplies the matrices of a block of rows and a block of queries, a query keeps what can
    be among its n best there, and only those are ranked together. Vectors that are null, hold null or are of another length have
    no cosine and come last.
    """
    parts, blocks = max(parts, -(-rows.count() // MET)), max(1, -(-asked.count() // MET))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    number = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    sides = []
    for side, (table, part, block) in enumerate(((rows, number(parts), every(blocks)), (asked, every(parts), number(blocks)))):
        dealt = table.where("vec_id is not null").select(F.lit(side).alias("side"), F.col("vec_id").alias("id"), F.col("v").cast("array<double>").alias("v")).select("*", part.alias("part"))
        sides.append(dealt.select("*", block.alias("block")).withColumn("block", F.col("part") * blocks + F.col("block")).drop("part"))
    kind = rows.schema["vec_id"].dataType

    def compared(batches):
        for _, table in groups(batches, ["block"]):
            side = table["side"].to_numpy()
            e, q = (_matrices(table.filter(pa.array(side == k))) for k in (0, 1))
            for size, (items, vectors) in q.items():
                others, found = e.get(size, (np.zeros(0, np.int64), vectors[:0])) if size >= 0 else (np.zeros(0, np.int64), vectors[:0])
                for i, j, c in _best(vectors, found, others, items, n) if len(others) else ():
                    yield pa.RecordBatch.from_arrays([pa.array(items[i]), pa.array(others[j]), pa.array(c)], names=["item", "other", "cosine"])
                if len(others) <= n:  # too few cosines here: some rows without one
                    rest = np.sort(np.concatenate([x for k, (x, _) in e.items() if k != size or size < 0] or [others]))[: n + 1]
                    item, other = np.repeat(items, len(rest)), np.tile(rest, len(items))
                    ok = item != other
                    none = pa.nulls(int(ok.sum()), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(item[ok]), pa.array(other[ok]), none], names=["item", "other", "cosine"])

    schema = StructType().add("item", kind).add("other", kind).add("cosine", "double")
    near = sides[0].unionByName(sides[1]).repartitionById(parts * blocks, F.col("block")).mapInArrow(compared, schema)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc(F.round("cosine", 9)), F.col("other")))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("item", "other", "rank", "cosine")
