"""Ranking and classification metrics per user, all from one window and one grouped aggregate.

Rows are (user, item, truth 0/1, score), and prediction (-1 or 1) where there is one; ties go to the smaller item. Only users
with both truths count; ignored_users tells how many others there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Grade that ERR divides by, and its deepest rank.
ERR_GRADES, ERR_DEPTH = 4.0, 10


def ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("user")
    order = w.orderBy(F.desc("score"), "item")
    out = rows.withColumns({"rank": F.row_number().over(order), "n": F.count("*").over(w), "pos": F.sum("truth").over(w)})
    out = out.where("pos > 0 and pos < n")
    ties = Window.partitionBy("user", "score")
    return out.withColumns({
        "hits": F.sum("truth").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        # Average rank from below, for the rank-sum form of AUC.
        "low": F.rank().over(w.orderBy("score")) + (F.count("*").over(ties) - 1) / 2.0,
    })


def per_user(rows: DataFrame, k: int = 10, beta: float = 1.0, rank_on: str = "score", threshold: float = 0.5) -> DataFrame:
    """One row per user with two truths: all metrics. Metrics at k are null for users with fewer than k items.

    rank_on is score, or prediction to rank by the predicted class. fscore is the F-beta score of each true class, weighted by
    its share; a true class that is never predicted scores 0.
    """
    if "prediction" not in rows.columns:
        rows = classify(rows, threshold)
    if rank_on != "score":
        rows = rows.withColumn("score", F.col(rank_on).cast("double"))
    r = ranked(rows)
    hit, top = F.col("truth") == 1, F.col("rank") <= k
    first, last = F.min(F.when(hit, F.col("rank"))), F.max(F.when(hit, F.col("rank")))
    sums = r.groupBy("user").agg(
        F.first("n").alias("n"), F.first("pos").alias("pos"), first.alias("first"), last.alias("last"),
        F.sum(F.when(top, F.col("truth")).otherwise(0)).alias("in_k"),
        F.avg(F.when(hit, F.col("hits") / F.col("rank"))).alias("ap"),
        F.sum(F.when(top & hit, F.when(F.col("rank") == 1, 1.0).otherwise(1.0 / F.log2(F.greatest("rank", F.lit(2)))))).alias("dcg"),
        F.sum(F.when(top & hit, 1.0 / F.log2(F.col("rank") + 1))).alias("dcg1"),
        F.array(*(F.struct(F.count_if(F.col("truth") == c).alias("true"), F.count_if(F.col("prediction") == c).alias("said"), F.count_if((F.col("truth") == c) & (F.col("prediction") == c)).alias("both")) for c in (-1, 0, 1))).alias("classes"),
        F.sum(F.when(hit, F.col("low"))).alias("ranks"),
        F.sum(F.when(hit & (F.col("rank") <= ERR_DEPTH), F.pow(F.lit(1 - 1 / ERR_GRADES), F.col("hits") - 1) / ERR_GRADES / F.col("rank"))).alias("err"),
    )
    enough = F.col("n") >= k
    p, q = F.col("in_k") / F.lit(float(k)), F.col("in_k") / F.col("pos")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("pos")).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i == 1, 1.0).otherwise(1.0 / F.log2(F.greatest(i, F.lit(2)))))
    f1 = F.when(p + q > 0, (1 + beta**2) * p * q / F.greatest(beta**2 * p + q, F.lit(1e-300))).otherwise(0.0)
    weighted = F.aggregate("classes", F.lit(0.0), lambda t, c: t + F.coalesce(F.try_divide(c["true"] * (1 + beta**2) * c["both"], beta**2 * c["true"] + c["said"]), F.lit(0.0)))
    return sums.select(
        "user", (weighted / F.col("n")).alias("fscore"), F.coalesce("dcg1", F.lit(0.0)).alias("dcg1_k"),
        ((F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * (F.col("n") - F.col("pos")))).alias("auc"),
        (1.0 / F.col("first")).alias("mrr"), F.col("first").cast("double").alias("mean_rank"), (F.col("pos") / F.col("last")).alias("r_precision"),
        F.when(enough, p).alias("precision_k"), F.when(enough, q).alias("recall_k"), F.when(enough, f1).alias("f1_k"), F.col("ap").alias("map"),
        F.coalesce("dcg", F.lit(0.0)).alias("dcg_k"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_k"),
        F.when(enough, (F.col("in_k") > 0).cast("double")).alias("hit_rate_k"), F.coalesce("err", F.lit(0.0)).alias("err"),
    )


METRICS = ("auc", "fscore", "mrr", "mean_rank", "r_precision", "precision_k", "recall_k", "f1_k", "map", "dcg_k", "dcg1_k", "ndcg_k", "hit_rate_k", "err")


def summary(users: DataFrame, k: int | None = None, beta: float = 1.0) -> DataFrame:
    """(metric, average, standard_deviation) over users, population spread; with k a row of the arguments, k and beta, as well."""
    long = users.unpivot("user", list(METRICS), "metric", "value")
    out = long.groupBy("metric").agg(F.avg("value").alias("average"), F.stddev_pop("value").alias("standard_deviation"))
    if k is None:
        return out
    row = users.sparkSession.range(1).select(F.lit("arguments (k, beta)").alias("metric"), F.lit(float(k)).alias("average"), F.lit(float(beta)).alias("standard_deviation"))
    return out.unionByName(row)


def ignored_users(rows: DataFrame) -> DataFrame:
    """(users, ignored): how many users there are, and how many of them have one truth only."""
    n = rows.groupBy("user").agg(F.min("truth").alias("a"), F.max("truth").alias("b"))
    return n.agg(F.count("*").alias("users"), F.count_if(F.col("a") == F.col("b")).alias("ignored"))


def spearman(rows: DataFrame) -> DataFrame:
    """(user, rho) between truth and score with average ranks; 0 where either is constant."""
    def average_rank(c):
        return F.rank().over(Window.partitionBy("user").orderBy(c)) + (F.count("*").over(Window.partitionBy("user", c)) - 1) / 2.0

    r = rows.withColumns({"a": average_rank("truth"), "b": average_rank("score")})
    return r.groupBy("user").agg((F.coalesce(F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")), F.lit(0.0)) + 0.0).alias("rho"))


def kendall(rows: DataFrame) -> DataFrame:
    """(user, tau) tau-b of truth and score. A truth has two values, so concordance needs no pairs: it is the rank sum of AUC."""
    w = Window.partitionBy("user")
    low = F.rank().over(w.orderBy("score")) + (F.count("*").over(Window.partitionBy("user", "score")) - 1) / 2.0
    tie = F.count("*").over(Window.partitionBy("user", "score"))
    r = rows.withColumns({"low": low, "tie": tie})
    s = r.groupBy("user").agg(F.count("*").alias("n"), F.sum("truth").alias("p"), F.sum(F.when(F.col("truth") == 1, F.col("low"))).alias("ranks"), F.sum((F.col("tie") - 1) / 2.0).alias("tied"))
    p, n = F.col("p"), F.col("n")
    pairs = p * (n - p)
    u = F.col("ranks") - p * (p + 1) / 2  # pairs in order, half of each tie
    free = n * (n - 1) / 2 - F.col("tied")
    return s.select("user", F.when((pairs > 0) & (free > 0), (2 * u - pairs) / F.sqrt(pairs.cast("double") * F.greatest(free, F.lit(1e-300)))).otherwise(0.0).alias("tau"))


def roc_points(rows: DataFrame) -> DataFrame:
    """(user, score, fpr, tpr) after each distinct score, falling."""
    return curve_counts(rows).select("user", "score", (F.col("cf") / F.col("af")).alias("fpr"), (F.col("ct") / F.col("at")).alias("tpr"))


def curve_counts(rows: DataFrame) -> DataFrame:
    """(user, score, ct, cf, at, af): true and false rows down to each distinct score, and all of the user's."""
    w = Window.partitionBy("user")
    by = rows.groupBy("user", "score").agg(F.sum("truth").alias("t"), F.sum(1 - F.col("truth")).alias("f"))
    order = w.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = by.withColumns({"ct": F.sum("t").over(order), "cf": F.sum("f").over(order), "at": F.sum("t").over(w), "af": F.sum("f").over(w)}).where("at > 0 and af > 0")
    return out.select("user", "score", "ct", "cf", "at", "af")


def roc_grid(rows: DataFrame, steps: int = 100) -> DataFrame:
    """(user, step, tpr): the ROC curve at false positive rates step / steps, linear between points; 0 at step 0.

    Each stretch between two points names the steps that it covers, in whole numbers.
    """
    c = curve_counts(rows)
    start = c.select("user", F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("ct"), F.lit(0).cast("long").alias("cf"), "at", "af").distinct()
    order = Window.partitionBy("user").orderBy(F.desc("score"))
    c = c.unionByName(start).withColumns({"nt": F.lead("ct").over(order), "nf": F.lead("cf").over(order)})
    c = c.withColumns({"lo": F.expr(f"({steps} * cf + af - 1) div af"), "hi": F.coalesce(F.expr(f"({steps} * nf + af - 1) div af") - 1, F.lit(steps).cast("long"))}).where("lo <= hi")
    each = c.withColumn("step", F.explode(F.sequence("lo", "hi")))
    beyond = F.coalesce((F.col("nt") - F.col("ct")) * F.try_divide(F.col("step") * F.col("af") / F.lit(float(steps)) - F.col("cf"), F.col("nf") - F.col("cf")), F.lit(0.0))
    return each.select("user", F.col("step").cast("int").alias("step"), F.when(F.col("step") == 0, 0.0).otherwise((F.col("ct") + beyond) / F.col("at")).alias("tpr"))


def pr_grid(rows: DataFrame, steps: int = 100) -> DataFrame:
    """(user, step, recall): the largest recall among thresholds whose precision is step / steps or more, 0 if there is none."""
    c = curve_counts(rows).select("user", F.expr(f"({steps} * ct) div (ct + cf)").alias("best"), (F.col("ct") / F.col("at")).alias("recall"))
    best = c.groupBy("user", "best").agg(F.max("recall").alias("recall"))  # at most steps + 1 rows a user
    covered = best.select("user", F.explode(F.sequence(F.lit(0).cast("long"), "best")).alias("step"), "recall")
    none = best.select("user").distinct().select("user", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))).alias("step"), F.lit(0.0).alias("recall"))
    return covered.unionByName(none).groupBy("user", F.col("step").cast("int").alias("step")).agg(F.max("recall").alias("recall"))


def mean_curve(grid: DataFrame, value: str) -> DataFrame:
    """(step, average, standard_deviation) of a grid over users."""
    return grid.groupBy("step").agg(F.avg(value).alias("average"), F.stddev_pop(value).alias("standard_deviation"))


def class_counts(predictions: DataFrame) -> DataFrame:
    """Pairs, items, users and predictions of each class."""
    return predictions.agg(
        F.count("*").alias("pairs"), F.count_distinct("item").alias("items"), F.count_distinct("user").alias("users"),
        F.count_if(F.col("prediction") == 1).alias("positive"), F.count_if(F.col("prediction") == -1).alias("negative"),
    )


def classify(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.withColumn("prediction", F.when(F.col("score") <= threshold, -1).otherwise(1))
