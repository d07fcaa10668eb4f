"""Rating datasets, their folds, splits and experiments, as long tables.

ratings are (item, user, rating) with rating -1, 0 or 1 and null for unavailable; folds (item, user) are the pairs that may be
looked at; features are (id, feature, value). Splits of all experiments are one table (exp, set, dataset, item, user, label).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import links


@dataclass(frozen=True)
class Dataset:
    """A study's ratings with the features of its items and users."""

    ratings: DataFrame
    folds: DataFrame
    items: DataFrame
    users: DataFrame
    name: str = "dataset"

    def subset(self, pairs: DataFrame, name: str = "subset") -> Dataset:
        """The same dataset with only the given pairs observable."""
        return replace(self, ratings=links.subset(self.ratings, pairs), folds=pairs.select("item", "user").distinct(), name=name)

    def positives(self) -> DataFrame:
        return self.ratings.where("rating = 1").select("item", "user").distinct()


def build(ratings: DataFrame, items: DataFrame, users: DataFrame, same_features: bool = False, name: str = "dataset") -> Dataset:
    """Align features with the ids of the ratings; available ratings make the folds; with same_features both sides keep only the
    features that they share, of which there must be one."""
    items = items.join(ratings.select(F.col("item").alias("id")).distinct(), "id", "left_semi")
    users = users.join(ratings.select(F.col("user").alias("id")).distinct(), "id", "left_semi")
    if same_features:
        shared = items.select("feature").intersect(users.select("feature"))
        if shared.isEmpty():
            raise ValueError("items and users have no feature in common")
        items, users = items.join(shared, "feature", "left_semi"), users.join(shared, "feature", "left_semi")
    known = ratings.where("rating is not null").select("item", "user", F.col("rating").cast("int").alias("rating"))
    return Dataset(known, known.select("item", "user").distinct(), items, users, name)


def unknown_ids(pairs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """(side, id) of the ids in pairs that items or users don't hold."""
    a = pairs.select(F.col("item").alias("id")).distinct().join(items.select(F.col("item").alias("id")), "id", "left_anti")
    b = pairs.select(F.col("user").alias("id")).distinct().join(users.select(F.col("user").alias("id")), "id", "left_anti")
    return a.select(F.lit("item").alias("side"), "id").unionByName(b.select(F.lit("user").alias("side"), "id"))


def from_pairs(pairs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """(item, user, rating) with 1 for each pair; an id that items or users don't hold is an error."""
    wrong = unknown_ids(pairs, items, users).limit(5).collect()
    if wrong:
        raise ValueError("unknown ids: " + ", ".join(f"{r.side} {r.id}" for r in wrong))
    return pairs.select("item", "user").distinct().withColumn("rating", F.lit(1))


def mask(pairs: DataFrame, n_items: int, n_users: int) -> DataFrame:
    """(row, column, value) of index pairs; repeated pairs sum up, an index outside the shape is an error."""
    outside = pairs.where((F.col("row") < 0) | (F.col("row") >= n_items) | (F.col("column") < 0) | (F.col("column") >= n_users))
    if not outside.isEmpty():
        raise ValueError(f"an index lies outside ({n_items}, {n_users})")
    return pairs.groupBy("row", "column").agg(F.count("*").alias("value"))


def numbered(pairs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """(row, column) of pairs: their places in the ordered ids of items and users."""
    rows = links.dense_index(items.select("item").distinct(), "item").withColumnRenamed("idx", "row")
    columns = links.dense_index(users.select("user").distinct(), "user").withColumnRenamed("idx", "column")
    return pairs.join(rows, "item").join(columns, "user").select("row", "column")


def summary(d: Dataset) -> DataFrame:
    """One row of 14 figures: sizes, ratings by sign, density of all and of the known part, and features with their gaps."""
    r = d.ratings
    rated = F.col("rating") != 0
    n = r.agg(
        F.count_distinct("item").alias("items"), F.count_distinct("user").alias("users"),
        F.count_distinct(F.when(rated, F.col("item"))).alias("items_known"), F.count_distinct(F.when(rated, F.col("user"))).alias("users_known"),
        F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"),
        F.count_if(rated).alias("_rated"),
    )
    folds = d.folds.agg(F.count("*").alias("_seen"))

    def gaps(features: DataFrame, side: str) -> DataFrame:
        lost = F.count_if(F.col("value").isNull() | F.isnan("value"))
        return features.agg(F.count_distinct("feature").alias(f"{side}_features"), F.coalesce(100.0 * lost / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias(f"{side}_missing"))

    one = n.join(folds).join(gaps(d.items, "item")).join(gaps(d.users, "user"))  # four tables of one row
    cells = F.col("items") * F.col("users")
    return one.select(
        "items", "users", "items_known", "users_known", "positive", "negative", (cells - F.col("_rated")).alias("unlabelled"), (cells - F.col("_seen")).alias("unavailable"),
        (100.0 * F.col("_rated") / cells).alias("density"), F.coalesce(F.try_divide(100.0 * F.col("_rated"), F.col("items_known") * F.col("users_known")), F.lit(0.0)).alias("density_known"),
        "item_features", "item_missing", "user_features", "user_missing",
    )


def profile(ratings: DataFrame) -> DataFrame:
    """Items, users and ratings by value of a rating list; where no 0 is listed, what isn't listed counts as unknown."""
    n, m = F.count_distinct("item"), F.count_distinct("user")
    plus, minus, none = F.count_if(F.col("rating") == 1), F.count_if(F.col("rating") == -1), F.count_if(F.col("rating") == 0)
    return ratings.agg(n.alias("items"), m.alias("users"), plus.alias("positive"), minus.alias("negative"), F.when(none > 0, none).otherwise(n * m - plus - minus).alias("unknown"))


def precompute(main: str, positives: DataFrame, items: DataFrame, experiments: int, share: float = 0.2, per_user: int = 100, per_positive: int = 5) -> DataFrame:
    """Splits (exp, set, dataset, item, user, label) of all experiments at once; positives are (dataset, item, user).

    The test set comes from the main dataset: positives by links.test_split, and per_user negatives for each of its users
    that are positive in no dataset. Each dataset trains on its other positives and per_positive negatives for each of them.
    """
    exps = positives.sparkSession.range(experiments).select(F.col("id").cast("int").alias("exp"))
    own = positives.where(F.col("dataset") == main).select("item", "user").distinct()
    test = links.test_splits(own, share, exps)
    every = positives.select("item", "user").distinct()
    want = test.select("exp", "user").distinct().withColumn("need", F.lit(per_user).cast("long"))
    wrong = links.draw(want, items, every, "test", ["exp"])
    shown = test.withColumn("label", F.lit(1)).unionByName(wrong.select("exp", "item", "user", F.lit(0).alias("label")))
    left = positives.join(F.broadcast(exps)).join(test, ["exp", "item", "user"], "left_anti")  # exps: a row per experiment
    need = left.groupBy("exp", "dataset", "user").agg((F.count("*") * per_positive).alias("need"))
    held = positives.join(F.broadcast(exps)).select("exp", "dataset", "item", "user")
    names = positives.select("dataset").distinct()
    held = held.unionByName(wrong.join(F.broadcast(names)).select("exp", "dataset", "item", "user"))  # names: a row per dataset
    drawn = links.draw(need, items, held, "train", ["exp", "dataset"])
    train = left.withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))
    columns = ["exp", "set", "dataset", "item", "user", "label"]
    return shown.withColumns({"set": F.lit("test"), "dataset": F.lit(main)}).select(columns).unionByName(train.withColumn("set", F.lit("train")).select(columns))


def rebuild(splits: DataFrame, ratings: DataFrame, main: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(exp, set, dataset, item, user, rating): the ratings that each split makes observable, of pairs without a rating 0.

    ratings are (dataset, item, user, rating); the test set is looked up in the main dataset; names in skip don't train.
    """
    chosen = splits.where((F.col("set") == "test") | ~F.col("dataset").isin(*skip)) if skip else splits
    pairs = chosen.select("exp", "set", F.when(F.col("set") == "test", main).otherwise(F.col("dataset")).alias("dataset"), "item", "user").distinct()
    known = ratings.groupBy("dataset", "item", "user").agg(F.max("rating").alias("rating"))
    return pairs.join(known, ["dataset", "item", "user"], "left").withColumn("rating", F.coalesce("rating", F.lit(0)))


def experiments(runs: int = 100, runs_bnnr: int = 5, runs_out: int = 50) -> list[dict]:
    """The study's experiments: models by regime, with the number of seeded runs of each."""
    regimes = {
        "ratings": ["baseline", "augmented", "random", "similarity_items", "similarity_users"],
        "external": ["phases_1_2", "phases_3_4"],
        "leave_one_metapath_out": [f"without_{k}" for k in range(10)],
    }
    models = ("ALS", "BPR", "LMF", "BNNR")
    most = {"ratings": runs, "external": runs, "leave_one_metapath_out": runs_out}
    return [
        {"model": m, "regime": r, "dataset": d, "runs": min(most[r], runs_bnnr) if m == "BNNR" else most[r]}
        for m in models for r, names in regimes.items() for d in names
    ]
