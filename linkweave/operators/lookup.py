"""Lookups of names, aliases, code hierarchies and nested lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkweave.tables import written


def aliases(vocabulary: DataFrame, fold: bool = True) -> DataFrame:
    """(alias, id): the first entry, by pos, that has the alias as name or synonym. vocabulary (id, pos, name, synonyms)."""
    names = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>")))))
    each = vocabulary.select("id", "pos", names.alias("alias")).where("alias is not null")
    if fold:
        each = each.withColumn("alias", F.lower("alias"))
    return each.groupBy("alias").agg(F.min_by("id", "pos").alias("id"))


def first_match(rows: DataFrame, column: str, vocabulary: DataFrame, fold: bool = True) -> DataFrame:
    """rows with matched_id of the first vocabulary entry; null where none matches."""
    key = F.lower(F.col(column)) if fold else F.col(column)
    table = aliases(vocabulary, fold).withColumnsRenamed({"alias": "_alias", "id": "matched_id"})
    return rows.withColumn("_key", key).join(table, F.col("_key") == F.col("_alias"), "left").drop("_key", "_alias")


def matched_ids(rows: DataFrame, key: str, terms: str, vocabulary: DataFrame, fold: bool = True) -> DataFrame:
    """(key, ids, terms): per row the ids of the terms that match, aligned with these terms, in order."""
    each = rows.select(key, F.posexplode(terms).alias("_pos", "_term"))
    found = first_match(each, "_term", vocabulary, fold).where("matched_id is not null")
    kept = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_pos", "matched_id", "_term"))).alias("m"))
    return kept.select(key, F.transform("m", lambda x: x["matched_id"]).alias("ids"), F.transform("m", lambda x: x["_term"]).alias("terms"))


def prefix_parents(codes: DataFrame) -> DataFrame:
    """(code, parent): the longest other code that starts a code. Candidate prefixes are equi-joined, never compared in pairs."""
    cut = codes.select("code", F.explode(F.sequence(F.lit(1), F.greatest(F.length("code") - 1, F.lit(1)))).alias("k")).where(F.col("k") < F.length("code"))
    cut = cut.select("code", "k", F.expr("substring(code, 1, k)").alias("parent"))
    known = codes.select(F.col("code").alias("parent")).distinct()
    best = cut.join(known, "parent").groupBy("code").agg(F.max_by("parent", "k").alias("parent"))
    return codes.select("code").distinct().join(best, "code", "left")


def ancestors(parents: DataFrame) -> DataFrame:
    """(code, ancestor, depth) of all ancestors at their least depth; parents may run in circles, and no code is its own ancestor.

    Semi-naive: a round joins only the pairs that the last one found with their parents and keeps those that no round has found
    yet. Rounds are written tables; they end when nothing is new, at the latest after the longest way without a repeat.
    """
    up = written(parents.where("parent is not null and parent <> code").select("code", "parent").distinct(), "parents")
    new = written(up.select("code", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "level")
    levels = [new]
    while True:
        more = new.join(up.select(F.col("code").alias("ancestor"), "parent"), "ancestor").where("parent <> code")
        more = more.select("code", F.col("parent").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        found = reduce(DataFrame.unionByName, levels).select("code", "ancestor")
        new = written(more.join(found, ["code", "ancestor"], "left_anti"), "level")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        levels.append(new)


def tree_parents(numbers: DataFrame) -> DataFrame:
    """(id, parents): ids whose tree number is one of the id's with its last part cut off. numbers (id, tree)."""
    child = numbers.select("id", F.regexp_replace("tree", r"\.[^.]+$", "").alias("up"), "tree").where("up <> tree")
    found = child.join(numbers.select(F.col("id").alias("parent"), F.col("tree").alias("up")), "up")
    return found.groupBy("id").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def two_hop(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    return left.join(right, by).drop(by).distinct()
