"""Mentions of vocabulary names in sentences: names of any number of words, leftmost and longest, never overlapping.

Names and texts are cut into the same tokens (letters and digits). Every run of tokens of a length that some name has is
equi-joined with the names, by broadcast where their written table proves small and by a shuffle else; runs are only made where
first and last token may be those of a name of that length. Overlapping matches are then settled inside the cluster that they form. A mention whose letters are all upper case is an isolated abbreviation and is
left out, as are sentences that deny.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkweave.functions import text as tx
from linkweave.tables import sent, written

TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def phrases(vocabulary: DataFrame) -> DataFrame:
    """(phrase, words, id): the first entry, by pos, that has the folded phrase as name or synonym. vocabulary (id, pos, name, synonyms)."""
    names = F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    each = vocabulary.select("id", "pos", names.alias("name")).select("id", "pos", tokens(F.lower("name")).alias("t")).where(F.size("t") > 0)
    return each.groupBy(F.array_join("t", " ").alias("phrase")).agg(F.first(F.size("t")).alias("words"), F.min_by("id", F.struct("pos", "id")).alias("id"))


def _settled(matches: Column) -> Column:
    """The leftmost-longest of overlapping matches, sorted by start, the longest of each start."""
    end = lambda m: m["start"] + m["words"]
    first = F.slice(matches, 1, 1)
    return F.aggregate(F.slice(matches, 2, 1 << 30), first, lambda kept, m: F.when(m["start"] >= end(F.element_at(kept, -1)), F.array_append(kept, m)).otherwise(kept))


#: Places of the table that tells which tokens names begin and end with.
PLACES = 1 << 16


def _place(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(PLACES)).cast("int")


def _ends(names: DataFrame, lengths: list[int]) -> dict[int, tuple[bytes, bytes]]:
    """Of each length a byte for every place: whether a name's first, or last, token falls there. At most PLACES numbers each."""
    word = lambda k: _place(F.element_at(F.split("phrase", " "), k))
    out = {n: (bytearray(PLACES), bytearray(PLACES)) for n in lengths}
    for r in names.select("words", F.explode(F.array(F.struct(F.lit(0).alias("end"), word(1).alias("at")), F.struct(F.lit(1).alias("end"), word(-1).alias("at")))).alias("x")).select("words", "x.*").distinct().collect():
        out[r.words][r.end][r.at] = 1
    return {n: (bytes(a), bytes(b)) for n, (a, b) in out.items()}


def mentions(sentences: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(.., start, words, surface, id) of each mention in sentences (.., sentence); start counts tokens from 0.

    Further columns of sentences stay, of any name but those of the result.
    """
    carried = [c for c in sentences.columns if c != "sentence"]
    names = written(phrases(vocabulary), "phrases")
    lengths = sorted(r[0] for r in names.select("words").distinct().collect())  # at most as many as the longest name has words
    if not lengths:
        return sentences.select(*carried, F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit("").alias("surface"), F.lit(None).cast(names.schema["id"].dataType).alias("id")).limit(0)
    known = _ends(names, lengths)
    rows = sentences.select(*carried, F.monotonically_increasing_id().alias("_row"), tokens(F.col("sentence")).alias("_t"))
    rows = rows.withColumn("_p", F.transform("_t", lambda x: _place(F.lower(x))))

    def among(places, at):
        return F.substring(F.lit(places), F.get("_p", at) + 1, F.lit(1)) == F.lit(b"\x01")

    def of_length(n):
        first, last = known[n]
        starts = F.when(F.size("_t") >= n, F.sequence(F.lit(0), F.size("_t") - n)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: among(first, i) & among(last, i + n - 1) if n > 1 else among(first, i))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(n).alias("words"), F.array_join(F.slice("_t", i + 1, n), " ").alias("surface")))

    runs = F.concat(*map(of_length, lengths))
    each = rows.select(*carried, "_row", F.inline(runs)).withColumn("phrase", F.lower("surface"))
    found = each.join(sent(names).select("phrase", "id"), "phrase").drop("phrase")
    # The longest of each start; then clusters of matches that reach into one another, which are settled one by one.
    best = found.groupBy("_row", "start").agg(F.max_by(F.struct(*carried, "words", "surface", "id"), "words").alias("m")).select("_row", "start", "m.*")
    by = Window.partitionBy("_row").orderBy("start")
    reached = F.max(F.col("start") + F.col("words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_new", F.when(F.col("start") < reached, 0).otherwise(1)).withColumn("_cluster", F.sum("_new").over(by))
    match = F.struct("start", "words", "surface", "id")
    clusters = best.groupBy("_row", "_cluster").agg(F.array_sort(F.collect_list(match)).alias("_m"), *(F.first(c).alias(c) for c in carried))
    return clusters.select(*carried, F.inline(_settled(F.col("_m"))))


def treatments(rows: DataFrame, key: str, vocabulary: DataFrame, indication: str = "indication", toxicity: str = "toxicity", approved: str = "approved") -> DataFrame:
    """(key, treats, not_treats): sorted ids of what the affirming sentences of indication and of toxicity mention.

    Rows whose groups don't hold approved get empty lists. key is unique.
    """
    told = F.explode(F.array(F.struct(F.lit(True).alias("good"), F.col(indication).alias("told")), F.struct(F.lit(False).alias("good"), F.col(toxicity).alias("told"))))
    each = rows.where(F.array_contains("groups", approved)).select(F.col(key).alias("_key"), told.alias("_x")).select("_key", "_x.*")
    each = each.select("_key", "good", F.explode(tx.affirmed(tx.clean(F.col("told")))).alias("sentence"))
    found = mentions(each, vocabulary).where(~tx.isolated_abbreviation(F.col("surface")))
    ids = lambda good: F.array_sort(F.collect_set(F.when(F.col("good") == good, F.col("id"))))
    lists = found.groupBy("_key").agg(ids(True).alias("treats"), ids(False).alias("not_treats"))
    kind = dict(lists.dtypes)["treats"]
    none = F.array().cast(kind)
    out = rows.select(key).join(lists, F.col(key) == F.col("_key"), "left")
    return out.select(key, F.coalesce("treats", none).alias("treats"), F.coalesce("not_treats", none).alias("not_treats"))
