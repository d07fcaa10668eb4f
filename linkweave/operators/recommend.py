"""Recommenders on (item, user, rating): implicit ALS, BPR, logistic MF and bounded nuclear-norm completion.

ALS is distributed: factors are tables, each half-step joins the positives with the fixed side, sums the normal equations of ids as
their rows pass by in order and solves them, so neither the driver nor a task holds a side or a frequent id's ratings. BPR and logistic
MF train in blocks of both sides. The completion trains on the driver on a dense matrix of at most CELLS cells, as a study's matrix
has; beyond it it raises.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.tables import discard, exists, sent, shared_dir, written

from . import links

#: Cells (items times users) up to which a model is trained on the driver; 8 bytes each and a few copies.
CELLS = 20_000_000
#: What a score of zero becomes at most.
FLOOR = 1e-31


class Model:
    """fit, predict_proba, predict, recommend, describe. Factors are DataFrames (item, v) and (user, v)."""

    defaults: dict = {}

    def __init__(self, **params):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        self.params = self.defaults | params

    def fit(self, ratings: DataFrame, seed: int = 1354) -> Model:
        items, users = (sorted(r[0] for r in self._ids(ratings, side)) for side in ("item", "user"))
        if len(items) * len(users) > CELLS:
            raise ValueError(f"{len(items)} items times {len(users)} users are more than {CELLS} cells; the other models have no such bound")
        self.items, self.users = ({x: k for k, x in enumerate(ids)} for ids in (items, users))
        x, y = self.train(ratings, np.random.default_rng(seed))
        spark = ratings.sparkSession
        self.item_factors = spark.createDataFrame(pd.DataFrame({"item": items, "v": x.tolist()}))
        self.user_factors = spark.createDataFrame(pd.DataFrame({"user": users, "v": y.tolist()}))
        return self

    @staticmethod
    def _ids(ratings: DataFrame, side: str) -> list:
        ids = ratings.select(side).distinct()
        if ids.count() > CELLS:
            raise ValueError(f"more than {CELLS} distinct {side}s; the other models have no such bound")
        return ids.collect()

    def train(self, ratings: DataFrame, rng) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def matrix(self, ratings: DataFrame) -> np.ndarray:
        pdf = ratings.where("rating > 0").select("item", "user").distinct().toPandas()  # at most CELLS pairs
        out = np.zeros((len(self.items), len(self.users)))
        out[pdf.item.map(self.items), pdf.user.map(self.users)] = 1.0
        return out

    def predict_proba(self, pairs: DataFrame) -> DataFrame:
        """pairs (item, user) with score; zeros become half the least positive score, or FLOOR if that is smaller."""
        dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        scored = pairs.join(self.item_factors.withColumnRenamed("v", "x"), "item").join(self.user_factors.withColumnRenamed("v", "y"), "user")
        scored = scored.select("item", "user", dot.alias("score"))
        least = scored.agg(F.least(F.lit(FLOOR), F.min(F.when(F.col("score") > 0, F.col("score"))) / 2).alias("_least"))  # one row
        both = scored.join(F.broadcast(least))
        return both.withColumn("score", F.when(F.col("score") == 0, F.col("_least")).otherwise(F.col("score"))).drop("_least")

    @staticmethod
    def predict(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
        return scores.withColumn("prediction", F.when(F.col("score") <= threshold, -1).otherwise(1))

    def recommend(self, pairs: DataFrame, k: int | None = None, threshold: float | None = None) -> DataFrame:
        """The k best of all pairs, or those scored threshold or more."""
        return links.recommend(self.predict_proba(pairs), k, threshold)

    def describe(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v}' for k, v in self.params.items())})"


class ALS(Model):
    """Implicit feedback, confidence 1 + alpha * r, unweighted ridge. engine "mllib" uses Spark's own solver instead, whose ridge
    grows with an id's ratings."""

    defaults = {"iterations": 15, "factors": 15, "alpha": 15.0, "reg": 0.01, "engine": "exact"}

    def fit(self, ratings, seed=1354):
        if self.params["engine"] == "mllib":
            return self._fit_mllib(ratings, seed)
        k = self.params["factors"]
        pos = written(ratings.where("rating > 0").groupBy("item", "user").agg(F.max("rating").cast("double").alias("r")), "positives")
        item, user = (written(_start(ratings.select(side).distinct(), side, k, seed), side) for side in ("item", "user"))
        for _ in range(self.params["iterations"]):
            user, old = self._solve(pos, "user", "item", item, user), user
            discard(old)
            item, old = self._solve(pos, "item", "user", user, item), item
            discard(old)
        self.item_factors, self.user_factors = item, user
        discard(pos)
        return self

    def _solve(self, pos: DataFrame, mine: str, other: str, fixed: DataFrame, before: DataFrame) -> DataFrame:
        """Factors of one side from the other's; an id without positives gets zeros."""
        k, alpha, reg = self.params["factors"], self.params["alpha"], self.params["reg"]

        def gram(parts):
            total = np.zeros((k, k))
            for pdf in parts:
                if len(pdf):
                    f = np.array(pdf.v.tolist())
                    total += f.T @ f
            yield pd.DataFrame({"g": [total.ravel().tolist()]})

        # One row of k * k numbers for each partition.
        base = sum(np.array(r.g) for r in fixed.select("v").mapInPandas(gram, "g array<double>").collect()).reshape(k, k) + reg * np.eye(k)

        def solved(parts):
            """Rows come sorted by id; the sums of the last id of a batch go on in the next."""
            held = None
            for pdf in parts:
                if len(pdf):
                    f, c, ids = np.array(pdf.v.tolist()), alpha * pdf.r.to_numpy(), pdf[mine].to_numpy()
                    first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    a = np.add.reduceat((f[:, :, None] * f[:, None, :] * c[:, None, None]).reshape(len(f), -1), first, axis=0).reshape(-1, k, k)
                    b = np.add.reduceat(f * (1 + c)[:, None], first, axis=0)
                    ids = ids[first]
                    if held is not None:
                        if held[0][0] == ids[0]:
                            a[0] += held[1][0]
                            b[0] += held[2][0]
                        else:
                            ids, a, b = (np.concatenate(x) for x in zip(held, (ids, a, b)))
                    held = ids[-1:], a[-1:], b[-1:]
                    yield from one_by_one(ids[:-1], a[:-1], b[:-1])
            if held is not None:
                yield from one_by_one(*held)

        def one_by_one(ids, a, b):
            if len(ids):
                yield pd.DataFrame({mine: ids, "v": np.linalg.solve(base + a, b[:, :, None])[:, :, 0].tolist()})

        kind = dict(before.dtypes)[mine]
        met = pos.join(fixed, other).select(mine, "r", "v").repartition(mine).sortWithinPartitions(mine)
        new = met.mapInPandas(solved, f"{mine} {kind}, v array<double>")
        none = F.array_repeat(F.lit(0.0), k)
        return written(before.select(mine).join(new, mine, "left").select(mine, F.coalesce("v", none).alias("v")), mine)

    def _fit_mllib(self, ratings, seed):
        from pyspark.ml.recommendation import ALS as Solver

        p = self.params
        index = [links.dense_index(ratings.select(side).distinct(), side).select(side, F.col("idx").cast("int").alias(f"{side}_no")) for side in ("item", "user")]
        rows = ratings.where("rating > 0").groupBy("item", "user").agg(F.max("rating").cast("float").alias("rating")).join(index[0], "item").join(index[1], "user")
        model = Solver(
            rank=p["factors"], maxIter=p["iterations"], regParam=p["reg"], alpha=p["alpha"], implicitPrefs=True, seed=seed, itemCol="item_no", userCol="user_no", ratingCol="rating",
        ).fit(rows)
        none = F.array_repeat(F.lit(0.0), p["factors"])
        self.item_factors, self.user_factors = (
            no.join(f.select(F.col("id").alias(f"{side}_no"), F.col("features").cast("array<double>").alias("v")), f"{side}_no", "left").select(side, F.coalesce("v", none).alias("v"))
            for side, no, f in (("item", index[0], model.itemFactors), ("user", index[1], model.userFactors))
        )
        return self


def _start(ids: DataFrame, side: str, k: int, seed: int) -> DataFrame:
    """(side, v): small normal numbers that depend on seed and id alone."""

    def draw(parts):
        for pdf in parts:
            v = [(np.random.default_rng([seed, zlib.crc32(f"{side}|{x}".encode())]).standard_normal(k) * 0.1).tolist() for x in pdf[side]]
            yield pd.DataFrame({side: pdf[side], "v": v})

    return ids.mapInPandas(draw, f"{side} {dict(ids.dtypes)[side]}, v array<double>")


#: Ids of a side that a block holds at most.
BLOCK = 5_000


class Blocked(Model):
    """Models whose factors are tables (no, v) in blocks of at most so many ids a side as block says; tasks hold a block of items, a block of users
    and the positives between them, whatever the number of ids. Needs no bound on cells."""

    block = BLOCK

    def _number(self, ratings: DataFrame) -> None:
        self.index = {side: written(links.dense_index(written(ratings.select(side).distinct(), side), side), side) for side in ("item", "user")}
        pos = ratings.where("rating > 0").select("item", "user").distinct()
        for side, no in (("item", "i"), ("user", "u")):
            pos = pos.join(sent(self.index[side]).withColumnRenamed("idx", no), side)
        self.sizes = {side: index.count() for side, index in self.index.items()}
        self.blocks = max(1, min(self.params["blocks"], *self.sizes.values()), -(-max(self.sizes.values()) // self.block))
        self.positives = written(pos.select("i", "u"), "positives")

    def _start(self, side: str, k: int, seed: int) -> DataFrame:
        salt = ("item", "user").index(side)

        def draw(parts):
            for pdf in parts:
                yield pd.DataFrame({"no": pdf.idx, "v": [(np.random.default_rng([seed, salt, x]).standard_normal(k) * 0.1).tolist() for x in pdf.idx]})

        return written(self.index[side].select("idx").mapInPandas(draw, "no long, v array<double>"), "factors")

    def _keep(self, item: DataFrame, user: DataFrame) -> None:
        self.item_factors, self.user_factors = (
            f.join(sent(self.index[side]).withColumnRenamed("idx", "no"), "no").select(side, "v") for side, f in (("item", item), ("user", user))
        )


class BPR(Blocked):
    """Pairwise ranking by stochastic gradient steps in strata.

    A round gives every task one block of users and one block of items that no other task of the round has, so steps of different
    tasks never touch the same factors; after as many rounds as blocks every user block has met every item block. A visit makes
    passes: in each a user draws one of its positives on average over all blocks, and an item of the block that isn't one. A task
    holds factors and positives, never a matrix of both sides, so blocks are large: every round moves all factors, and there are as
    many rounds as blocks.
    """

    block = 10 * BLOCK

    defaults = {"iterations": 160, "factors": 15, "rate": 0.1, "reg": 0.01, "batch": 100, "blocks": 2, "passes": 20}

    def fit(self, ratings, seed=1354):
        p = self.params
        self._number(ratings)
        n = F.lit(self.blocks)
        item, user = (self._start(side, p["factors"], seed) for side in ("item", "user"))
        liked = self.positives.groupBy("u").agg((1 / F.count("*")).alias("share"))
        pos = self.positives.join(liked, "u").select(F.lit(2).alias("side"), F.col("u").alias("a"), F.col("i").alias("b"), "share", F.lit(None).cast("array<double>").alias("v"))
        pos = written(pos, "positives")
        rounds = -(-p["iterations"] // p["passes"])
        for epoch in range(rounds):
            for shift in range(self.blocks):
                def block(f, side, move):
                    cell = F.pmod(F.col("no") - move, n)
                    return f.select(cell.alias("cell"), F.lit(side).alias("side"), F.col("no").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("double").alias("share"), "v")

                met = pos.where(F.pmod(F.col("b") - shift, n) == F.pmod("a", n)).select(F.pmod("a", n).alias("cell"), *pos.columns)
                cells = block(user, 0, 0).unionByName(block(item, 1, shift)).unionByName(met)
                passes = min(p["passes"], p["iterations"] - epoch * p["passes"])
                new = written(cells.groupBy("cell").applyInPandas(_visit(p, passes, (seed, epoch, shift)), "side int, no long, v array<double>"), "factors")
                item, user, old = new.where("side = 1").select("no", "v"), new.where("side = 0").select("no", "v"), (item, user)
                for f in old if epoch or shift else ():
                    discard(getattr(f, "_from", f))
                item._from = user._from = new
        self._keep(item, user)
        return self


def _visit(p: dict, passes: int, seeds: tuple[int, ...]):
    """The steps of a task: factors of its users and items after passes over the positives between them."""

    def step(key, pdf):
        rng = np.random.default_rng([*seeds, int(key[0])])
        users, items, pos = (pdf[pdf.side == k].sort_values(["a", "b"]) for k in range(3))
        y, x = (np.array(f.v.tolist(), float).reshape(len(f), -1) for f in (users, items))
        u, i = np.searchsorted(users.a.to_numpy(), pos.a.to_numpy()), np.searchsorted(items.a.to_numpy(), pos.b.to_numpy(dtype=np.int64))
        held = np.sort(u * max(1, len(x)) + i)
        for _ in range(passes if len(pos) else 0):
            drawn = rng.permutation(np.nonzero(rng.random(len(u)) < pos.share.to_numpy())[0])
            for lo in range(0, len(drawn), p["batch"]):
                at = drawn[lo : lo + p["batch"]]
                j = rng.integers(0, len(x), len(at))
                code = u[at] * len(x) + j
                fair = held[np.minimum(np.searchsorted(held, code), len(held) - 1)] != code
                a, b, j = u[at][fair], i[at][fair], j[fair]
                g = 1 / (1 + np.exp(np.clip(((x[b] - x[j]) * y[a]).sum(axis=1), -30, 30)))[:, None]
                dx, dy = g * y[a], g * (x[b] - x[j])
                np.add.at(y, a, p["rate"] * (dy - p["reg"] * y[a]))
                np.add.at(x, b, p["rate"] * (dx - p["reg"] * x[b]))
                np.add.at(x, j, p["rate"] * (-dx - p["reg"] * x[j]))
        return pd.DataFrame({"side": [0] * len(users) + [1] * len(items), "no": np.concatenate([users.a, items.a]).astype(np.int64), "v": [*y.tolist(), *x.tolist()]})

    return step


class LogisticMF(Blocked):
    """Logistic factorisation with biases, alternating adaptive gradient ascent; confidence = zeros / positives.

    Half a round computes the gradient of one side: a task takes a tile, which is a block of that side, a block of the other and
    the positives between them, and gives the sums of its rows; sums of tiles are added by combiners. The squares that adapt the
    steps are a column of the factor table. likelihood holds the penalised likelihood after each round.
    """

    defaults = {"iterations": 30, "factors": 2, "reg": 0.6, "gamma": 1.0, "blocks": 2}

    def fit(self, ratings, seed=1354):
        p = self.params
        self._number(ratings)
        k, n = p["factors"] + 2, self.positives.count()
        confidence = (self.sizes["item"] * self.sizes["user"] - n) / max(1.0, n)
        flat = F.array(*(F.lit(1e-9) for _ in range(k)))
        sides = {}
        for side, held in (("item", k - 1), ("user", k - 2)):  # biases: place k - 2 of items and k - 1 of users; the other is 1
            one = F.transform("v", lambda x, at: F.when(at == held, 1.0).otherwise(x))  # noqa: B023
            sides[side] = written(self._start(side, k, seed).select("no", one.alias("v"), flat.alias("s")), "factors")
        self.likelihood = []
        for turn in range(p["iterations"] + 1):
            last = turn == p["iterations"]
            for mine, other, held in (("user", "item", k - 2), ("item", "user", k - 1)):
                tiles = self._tiles(sides[mine], sides[other], mine).groupBy("m", "o").applyInPandas(_gradients(confidence, mine == "user" and turn > 0), "no long, g array<double>, l double")
                sums = tiles.groupBy("no").agg(F.array(*(F.sum(F.col("g")[c]) for c in range(k))).alias("g"), F.sum("l").alias("l"))
                g = F.zip_with("g", "v", lambda g, v: g - p["reg"] * v)
                g = F.transform(g, lambda x, at: F.when(at == held, 0.0).otherwise(x))  # noqa: B023
                new = sides[mine].join(sums, "no").select("no", "v", "s", g.alias("g"), "l").withColumn("s", F.zip_with("s", "g", lambda s, g: s + g * g))
                step = F.zip_with("g", "s", lambda g, s: p["gamma"] * g / F.sqrt(s))
                squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
                new = written(new.select("no", F.zip_with("v", step, lambda v, d: v + d).alias("v"), "s", "l", squares.alias("n")), "factors")
                if mine == "user" and turn:  # what the round before has reached
                    fit_, norms = new.agg(F.sum("l"), F.sum("n")).first()
                    theirs = sides["item"].agg(F.sum(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
                    self.likelihood.append(fit_ - p["reg"] / 2 * (norms + theirs))
                if last:
                    break
                sides[mine], old = new.select("no", "v", "s"), sides[mine]
                sides[mine]._from = new
                discard(getattr(old, "_from", old))
        self._keep(sides["item"].select("no", "v"), sides["user"].select("no", "v"))
        return self

    def _tiles(self, mine: DataFrame, other: DataFrame, side: str) -> DataFrame:
        """(m, o, kind, a, b, v): every pair of blocks with its factors of this side (0), of the other (1) and its positives (2)."""
        n, all_blocks = F.lit(self.blocks), F.explode(F.sequence(F.lit(0), F.lit(self.blocks - 1)).cast("array<bigint>"))
        none, own = F.lit(None).cast("array<double>"), F.pmod("no", n)
        a, b = ("u", "i") if side == "user" else ("i", "u")
        left = mine.select(own.alias("m"), all_blocks.alias("o"), F.lit(0).alias("kind"), F.col("no").alias("a"), F.lit(0).cast("long").alias("b"), "v")
        right = other.select(all_blocks.alias("m"), own.alias("o"), F.lit(1).alias("kind"), F.col("no").alias("a"), F.lit(0).cast("long").alias("b"), "v")
        pos = self.positives.select(F.pmod(a, n).alias("m"), F.pmod(b, n).alias("o"), F.lit(2).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), none.alias("v"))
        return left.unionByName(right).unionByName(pos)


#: Rows of both sides whose scores a task holds at once, few enough for the processor's cache, and how many are multiplied before
#: a logarithm: each is at most 1 + exp(30).
TILE, TOGETHER = (32, 1024), 16


def _gradients(confidence: float, likelihood: bool = True):
    """Of a tile: for each row of this side the gradient of the likelihood without its penalty, and its likelihood if asked for.

    Pairs count as negatives first.
    """

    def step(key, pdf):
        mine, other, pos = (pdf[pdf.kind == k].sort_values(["a", "b"]) for k in range(3))
        y, x = (np.array(f.v.tolist(), float).reshape(len(f), -1) for f in (mine, other))
        if not len(y):
            return pd.DataFrame({"no": [], "g": [], "l": []})
        u, i = np.searchsorted(mine.a.to_numpy(), pos.a.to_numpy()), np.searchsorted(other.a.to_numpy(), pos.b.to_numpy())
        g, likely = _negatives(y, x, likelihood)
        z = np.clip((y[u] * x[i]).sum(axis=1), -30, 30)
        np.add.at(g, u, (confidence * (1 - 1 / (1 + np.exp(-z))))[:, None] * x[i])
        np.add.at(likely, u, confidence * (z - np.log1p(np.exp(z))))
        return pd.DataFrame({"no": mine.a.to_numpy(), "g": g.tolist(), "l": likely})

    return step


def _negatives(y: np.ndarray, x: np.ndarray, likelihood: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and, if asked for, likelihood of the rows of y when all their pairs with rows of x are negatives."""
    g, likely = np.zeros_like(y), np.zeros(len(y))
    rows, columns = TILE
    z = np.empty((rows, columns))
    for lo in range(0, len(x), columns):
        some = x[lo : lo + columns]
        turned = np.ascontiguousarray(some.T)
        for at in range(0, len(y), rows):
            here = slice(at, min(at + rows, len(y)))
            t = z[: here.stop - at, : len(some)] if len(some) == columns else np.empty((here.stop - at, len(some)))
            np.matmul(y[here], turned, out=t)
            np.clip(t, -30, 30, out=t)
            if likelihood:
                likely[here] -= t.sum(axis=1)
            np.negative(t, out=t)
            np.exp(t, out=t)
            t += 1
            if likelihood:  # log(1 + exp(z)) = z + log(1 + exp(-z))
                cut = len(some) - len(some) % TOGETHER
                likely[here] -= np.log(np.prod(t[:, :cut].reshape(len(t), -1, TOGETHER), axis=2)).sum(axis=1) + np.log(t[:, cut:]).sum(axis=1)
            np.reciprocal(t, out=t)
            g[here] -= t @ some
    return g, likely


class BNNR(Model):
    """Bounded nuclear norm completion of the rating matrix by alternating directions with singular value thresholding."""

    defaults = {"iterations": 300, "alpha": 1.0, "beta": 10.0, "tol1": 2e-3, "tol2": 1e-5, "low": 0.0, "high": 1.0}

    def train(self, ratings, rng):
        p, m = self.params, self.matrix(ratings)
        seen = m != 0
        x = w = z = m.copy()
        dual, before = m.copy(), 1.0
        for _ in range(p["iterations"]):
            t = dual / p["beta"] + (p["alpha"] / p["beta"]) * m * seen + x
            w = np.clip(np.where(seen, t / (1 + p["alpha"] / p["beta"]), t), p["low"], p["high"])
            u, s, v = np.linalg.svd(w - dual / p["beta"], full_matrices=False)
            z = (u * np.maximum(s - 1 / p["beta"], 0)) @ v
            dual = dual + p["beta"] * (z - w)
            gap = np.linalg.norm(z - x) / max(np.linalg.norm(x), 1e-12)
            if gap < p["tol1"] and abs(gap - before) / max(1, abs(before)) < p["tol2"]:
                break
            before, x = gap, z
        u, s, v = np.linalg.svd(w, full_matrices=False)
        return u * s, v.T


MODELS: dict[str, Callable[..., Model]] = {"ALS": ALS, "BPR": BPR, "LMF": LogisticMF, "BNNR": BNNR}


def run_pipeline(model: str, train: DataFrame, test: DataFrame, experiments: int = 3, k: int = 10, beta: float = 1.0, **params) -> DataFrame:
    """(experiment, time_seconds, metric, average, standard_deviation) of a model fitted anew with each seed."""
    import time

    out = None
    for seed in range(experiments):
        began = time.time()
        fitted = MODELS[model](**params).fit(train, seed)
        took = round(time.time() - began, 3)
        one = _scored_summary(fitted, test, k, beta).select(F.lit(seed).alias("experiment"), F.lit(took).alias("time_seconds"), "metric", "average", "standard_deviation")
        out = one if out is None else out.unionByName(one)
    return out


def run_experiments(splits: DataFrame, catalogue: list[dict], k: int = 10, beta: float = 1.0, path: str | None = None, at_once: int = 4, **params) -> DataFrame:
    """(model, dataset, experiment, metric, ..) of the rows of datasets.experiments() on splits (exp, set, dataset, item, user,
    rating): each fit on its own training pairs, tested on the experiment's test set.

    at_once fits run at the same time. Each writes its result to a folder of its own under path as it ends, and a fit whose result
    is there whole isn't made again: a study that was stopped goes on where it was when it is started with the same path.
    """
    from concurrent.futures import ThreadPoolExecutor

    spark = splits.sparkSession
    path = path or f"{shared_dir(spark)}/linkweave/study-{uuid.uuid4().hex}"
    places = {(row["model"], row["dataset"], exp): f"{path}/model={row['model']}/dataset={row['dataset']}/experiment={exp}" for row in catalogue for exp in range(row["runs"])}
    missing = [key for key, at in places.items() if not exists(spark, f"{at}/_SUCCESS")]

    def fit(key):
        model, dataset, exp = key
        one = splits.where(F.col("exp") == exp)
        train = one.where((F.col("set") == "train") & (F.col("dataset") == dataset)).select("item", "user", "rating")
        test = one.where("set = 'test'").select("item", "user", (F.col("rating") > 0).cast("int").alias("truth"))
        _scored_summary(MODELS[model](**params.get(model, {})).fit(train, exp), test, k, beta).write.mode("overwrite").parquet(places[key])

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(fit, missing))
    every = spark.read.schema("model string, dataset string, experiment int, metric string, average double, standard_deviation double").parquet(path)
    asked = spark.createDataFrame(list(places), "model string, dataset string, experiment int")
    return every.join(F.broadcast(asked), ["model", "dataset", "experiment"], "left_semi")  # a row a fit


def _scored_summary(fitted: Model, test: DataFrame, k: int, beta: float) -> DataFrame:
    """(metric, average, standard_deviation) of a fitted model on test (item, user, truth)."""
    from .metrics import per_user, summary

    scores = fitted.predict_proba(test.select("item", "user")).join(test, ["item", "user"])
    return summary(per_user(scores.select("user", "item", "truth", "score"), k, beta), k, beta).select("metric", "average", "standard_deviation")
