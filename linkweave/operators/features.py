"""Feature tables (id, feature, value): repair of infinities, choice by variance, imputation, scaling and pairs of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that two features of the same name may be combined by.
COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "*": lambda a, b: a * b, "+": lambda a, b: a + b, "-": lambda a, b: a - b, "/": lambda a, b: F.try_divide(a, b),
    "min": F.least, "max": F.greatest,
}


def repaired(features: DataFrame, posinf: float, neginf: float) -> DataFrame:
    """NaN becomes null, infinities become the given numbers."""
    v = F.col("value")
    fixed = F.when(F.isnan(v), None).when(v == float("inf"), posinf).when(v == float("-inf"), neginf).otherwise(v)
    return features.select("id", "feature", fixed.cast("double").alias("value"))


def variances(features: DataFrame) -> DataFrame:
    """(feature, variance) over the known values; 0 where there are none or the result isn't finite."""
    v = features.groupBy("feature").agg(F.var_pop(F.when(~F.isnan("value"), F.col("value"))).alias("v"))
    finite = F.col("v").isNotNull() & ~F.isnan("v") & (F.col("v") < float("inf"))
    return v.select("feature", F.when(finite, F.col("v")).otherwise(0.0).alias("variance"))


def most_variable(features: DataFrame, n: int) -> DataFrame:
    """(feature, variance) of the n features of largest variance, ties to the smaller name."""
    return variances(features).orderBy(F.desc("variance"), "feature").limit(n)


class Scaler:
    """Mean imputation and standardisation with population spread, fitted once and used again.

    A feature without values becomes 0 throughout; one without spread is only centred.
    """

    def __init__(self, posinf: float = 10.0, neginf: float = -10.0):
        self.posinf, self.neginf, self.fitted = posinf, neginf, None

    def fit(self, features: DataFrame, subset: int | None = None) -> Scaler:
        known = repaired(features, self.posinf, self.neginf)
        if subset is not None:
            known = known.join(most_variable(known, subset).select("feature"), "feature", "left_semi")
        mean, n = F.avg("value"), F.count("*")
        # Imputed values lie on the mean: they add nothing to the squares, but count.
        spread = F.sqrt(F.var_pop("value") * F.count("value") / n)
        self.fitted = known.groupBy("feature").agg(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.coalesce(spread, F.lit(0.0)).alias("spread"))
        return self

    def transform(self, features: DataFrame) -> DataFrame:
        rows = repaired(features, self.posinf, self.neginf).join(self.fitted, "feature")
        z = (F.coalesce("value", "mean") - F.col("mean")) / F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0)
        return rows.select("id", "feature", z.alias("value"))

    def fit_transform(self, features: DataFrame, subset: int | None = None) -> DataFrame:
        return (self if self.fitted is not None else self.fit(features, subset)).transform(features)


def vectors(features: DataFrame, key: str) -> DataFrame:
    """(key, v): the values of each id in the order of the features' names; gaps are NaN-free zeros only after scaling."""
    each = features.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("feature", "value"))).alias("f"))  # one value a feature
    return each.select(F.col("id").alias(key), F.transform("f", lambda x: x["value"]).alias("v"))


def joined_vectors(pairs: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """pairs (item, user, ..) with x: the item's vector and then the user's."""
    a, b = vectors(items, "item").withColumnRenamed("v", "_a"), vectors(users, "user").withColumnRenamed("v", "_b")
    return pairs.join(a, "item").join(b, "user").withColumn("x", F.concat("_a", "_b")).drop("_a", "_b")


def combined_vectors(pairs: DataFrame, items: DataFrame, users: DataFrame, operator: str = "*") -> DataFrame:
    """pairs with x: the features that both sides have, combined one by one; operator is a key of COMBINE."""
    op = COMBINE[operator]
    shared = items.select("feature").intersect(users.select("feature"))
    a = vectors(items.join(shared, "feature", "left_semi"), "item").withColumnRenamed("v", "_a")
    b = vectors(users.join(shared, "feature", "left_semi"), "user").withColumnRenamed("v", "_b")
    return pairs.join(a, "item").join(b, "user").withColumn("x", F.zip_with("_a", "_b", op)).drop("_a", "_b")


def standardised(pairs: DataFrame, items: DataFrame, users: DataFrame, subset: int | None = None, scalers: tuple[Scaler, Scaler] | None = None) -> DataFrame:
    """pairs with x: imputed and standardised vectors of item and user, each side with its own scaler."""
    mine, theirs = scalers or (Scaler(), Scaler())
    return joined_vectors(pairs, mine.fit_transform(items, subset), theirs.fit_transform(users, subset))


#: Preparations by name, each (pairs, items, users, ..) -> pairs with x.
PREPARE = {"meanimputation_standardize": standardised, "same_feature_preprocessing": combined_vectors}


def prepare(kind: str, pairs: DataFrame, items: DataFrame, users: DataFrame, **more) -> DataFrame:
    if kind not in PREPARE:
        raise ValueError(f"unknown preparation {kind!r}; known: {', '.join(sorted(PREPARE))}")
    return PREPARE[kind](pairs, items, users, **more)


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """(correlation) of two models' scores (item, user, score), which must cover the same pairs."""
    x, y = a.select("item", "user", F.col("score").alias("x")), b.select("item", "user", F.col("score").alias("y"))
    both = x.join(y, ["item", "user"], "full")
    r = both.agg(F.corr("x", "y").alias("correlation"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("alone"))
    return r.select(F.when(F.col("alone") > 0, F.raise_error(F.lit("the models score different pairs"))).otherwise(F.col("correlation")).alias("correlation"))
