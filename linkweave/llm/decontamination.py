"""Benchmark decontamination by template canonicalisation: DataFrame functions only.

Numbers, names and units become typed placeholders, so a question that was asked again with other values keeps its template.
Windows of WINDOW template words are hashed and joined with those of the benchmark items. Where enough windows of an item are
found in a document, the values behind the placeholders are lined up: every value of the item must stand for one value of the
document throughout, otherwise the match is a coincidence of form. Each place in the document is judged on its own. A mark
depends on the word alone, never on what stands around it, so a name that opens a sentence is a slot as well.

Windows of slots alone say nothing by their form: they don't count for an item that has others, and an item that has no others
is found by its values, as a run of the same words. Items shorter than a window are compared whole; those of fewer than SHORT
words, which prose is full of, are found only where they are all of a document.

Edge cases: null texts and null item texts count as empty and match nothing; a null doc_id or item_id stays null; rows repeated
in documents give one row in the result; a very long document is cut into windows like any other; of places that match equally
well none is preferred, as an item is reported once a document; an empty table on either side gives an empty result; other
columns, of any name, are ignored by leaks and kept by drop_leaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, packed, small_join

WINDOW = 8
#: Words below which an item must be all of a document.
SHORT = 4
#: Share of an item's windows that must be found, or their number where the item is long.
COVERED, MANY = 0.5, 16
#: Windows of the benchmark up to which their hashes are sent to all executors (16 bytes each).
SENT = 2_000_000
#: Stands for the first places of an item's windows in a cluster of places; one less for the last.
FIRST = -(1 << 40)
NUMBER, NAME, UNIT, POINT = "\ue000", "\ue001", "\ue002", "\ue003"
# Units that may follow a number.
UNITS = "km|m|cm|mm|mi|ft|kg|g|mg|lb|oz|l|ml|s|ms|min|h|hours?|days?|weeks?|months?|years?|usd|eur|dollars?|euros?|cents?|percent|kwh|kw|w|v|hz"

# Words that are no names though they open a sentence.
PLAIN = "A|An|And|Are|As|At|But|By|Can|Did|Do|Does|Each|Every|Find|For|From|Given|He|Her|His|How|If|In|Is|It|Its|Let|Of|On|Or|She|So|Some|Suppose|That|The|Their|Then|There|They|This|Those|These|To|Was|We|Were|What|When|Where|Which|Who|Why|Will|With|You"


def marked(text: Column) -> Column:
    """Words of a text; a number, name or unit keeps its value behind the mark of its type.

    Each pattern begins with what is rare, so that most characters are passed after one look.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    text = F.regexp_replace(text, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?!(?:{PLAIN})(?!\p{{Ll}}))(\p{{Lu}}\p{{Ll}}+)", NAME + "$1")
    # A number is one slot whatever its size: grouping commas go, its points stay part of it.
    text = F.regexp_replace(text, ",(?=[0-9]{3}(?![0-9]))(?<=[0-9],)(?<![0-9]{4},)", "")
    text = F.regexp_replace(text, r"\.(?=[0-9])(?<=[0-9]\.)", POINT)
    text = F.regexp_replace(text, f"([0-9][0-9{POINT}]*)", f" {NUMBER}$1 ")
    text = F.when(text.contains(NUMBER), F.regexp_replace(text, rf"(?i)({NUMBER}[0-9{POINT}]+ +)({UNITS})(?![\p{{L}}\p{{N}}])", f"$1{UNIT}$2")).otherwise(text)
    return F.array_remove(F.split(F.lower(text), rf"[^\p{{L}}\p{{N}}{NUMBER}{NAME}{UNIT}{POINT}]+"), "")


def template_hashes(words: Column) -> Column:
    """A hash for each word, that of its mark alone where it has one."""
    first = lambda w: F.substring(w, 1, 1)
    return F.transform(words, lambda w: F.xxhash64(F.when(first(w).isin(NUMBER, NAME, UNIT), first(w)).otherwise(w)))


def windows(hashes: Column, width: int) -> Column:
    """Hashes of all windows of width words, in order: windows of 1, 2, 4 .. words are joined to longer ones, pair by pair."""
    def bound(value, use):  # use(value) with value evaluated once
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def joined(a, b, by):
        # a[i] with b[i + by], as far as b goes.
        n = F.greatest(F.size(b) - by, F.lit(0))
        return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), lambda x, y: F.xxhash64(x, y))

    def grown(power, one, out, covered):
        if width & one:
            out, covered = (power if out is None else joined(out, power, covered)), covered + one
        return out if 2 * one > width else bound(joined(power, power, one), lambda q: grown(q, 2 * one, out, covered))

    return bound(hashes, lambda h: grown(h, 1, None, 0))


def slots_only(words: Column, width: int) -> Column:
    """For each window whether all its words are slots."""
    slot = F.transform(words, lambda w: F.substring(w, 1, 1).isin(NUMBER, NAME, UNIT))
    return F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.forall(F.slice(slot, i + 1, F.lit(width)), lambda x: x))


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, exact, digest) of the documents that hold benchmark items, exact or re-parameterised."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), marked(F.col("text")).alias("item"))
    items = items.where(F.size("item") > 0).withColumn("no", F.xxhash64("item_id", "item")).dropDuplicates(["no"])
    items = items.withColumn("width", F.least(F.lit(WINDOW), F.size("item")))
    items = materialise(items.withColumn("hashes", template_hashes(F.col("item"))), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # WINDOW values at most
    spark = docs.sparkSession
    if not widths:
        return spark.createDataFrame([], "doc_id long, item_id long, n_windows long, coverage double, exact boolean, digest binary")
    def cut(w):
        both = F.arrays_zip(windows(F.col("hashes"), w).alias("hash"), slots_only(F.col("item"), w).alias("bare"))
        each = items.where(F.col("width") == w).select("no", F.lit(w).alias("width"), F.size("item").alias("long"), F.posexplode(both).alias("ipos", "x"))
        return each.select("no", "width", "long", "ipos", F.col("x.hash").alias("hash"), F.col("x.bare").alias("bare"))

    grams = materialise(reduce(DataFrame.unionByName, map(cut, widths)), "grams")
    counted = materialise(grams.where("not bare").groupBy("no").agg(F.count("*").alias("of")), "counted")
    bare = materialise(items.join(counted, "no", "left_anti"), "bare")
    grams = grams.where("not bare").drop("bare")
    wanted = grams.select("width", "hash").distinct()
    if wanted.count() <= SENT:
        wanted = F.broadcast(wanted)
    rows = keyed(docs).select("doc_id", "digest", template_hashes(marked(F.col("text"))).alias("hashes"))

    def here(w):
        every = F.transform(windows(F.col("hashes"), w), lambda x, i: F.struct(F.lit(w).alias("width"), i.alias("dpos"), x.alias("hash")))
        return every if w >= SHORT else F.when(F.size("hashes") == w, every).otherwise(F.array().cast("array<struct<width:int,dpos:int,hash:bigint>>"))

    if widths == [WINDOW]:
        found = rows.select("doc_id", "digest", F.lit(WINDOW).alias("width"), F.posexplode(windows(F.col("hashes"), WINDOW)).alias("dpos", "hash"))
    else:  # all widths in one pass
        found = rows.select("doc_id", "digest", F.explode(F.concat(*map(here, widths))).alias("x")).select("doc_id", "digest", "x.*")
    found = found.join(wanted, ["width", "hash"], "left_semi")
    # Rows repeated in documents meet here; every place of a window stays, as another place may hold other values.
    found = found.distinct()
    held = materialise(found.join(grams, ["width", "hash"]).select("doc_id", "digest", "no", "width", "long", "ipos", "dpos"), "held")
    # Places of an item: windows at one distance from the item's, or, where words were put in between, the first or the last of
    # each window in a cluster of places, none of which is farther from the next than the item is long.
    place = ["doc_id", "digest", "no", "align"]
    by = Window.partitionBy("doc_id", "digest", "no").orderBy("dpos")
    apart = (F.col("dpos") - F.lag("dpos").over(by) > F.col("long")).cast("long")
    near = held.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("cluster", F.sum("apart").over(by))
    ends = near.groupBy("doc_id", "digest", "no", "width", "ipos", "cluster").agg(F.min("dpos").alias("first"), F.max("dpos").alias("last"))
    ends = materialise(ends, "ends")
    runs = held.drop("long").withColumn("align", (F.col("dpos") - F.col("ipos")).cast("long"))
    for k, end in enumerate(("first", "last")):
        runs = runs.unionByName(ends.select("doc_id", "digest", "no", "width", "ipos", F.col(end).alias("dpos"), (F.lit(FIRST) - 2 * F.col("cluster") - k).alias("align")))
    need = items.select("no", "item_id", "item").join(counted, "no")
    per = runs.groupBy(*place).agg(F.count("*").alias("n"))
    per = small_join(per, materialise(need, "need"), ["no"], "inner").where((F.col("n") >= F.col("of") * COVERED) | (F.col("n") >= MANY))
    per = materialise(per, "covered")

    # Values behind the marks, window by window.
    texts = small_join(keyed(docs), materialise(per.select("digest").distinct(), "texts"), ["digest"], "left_semi")
    texts = texts.groupBy("digest").agg(F.first("text").alias("text")).select("digest", marked(F.col("text")).alias("words"))
    chosen = per.withColumnsRenamed({"doc_id": "d", "digest": "t"})
    spots = runs.join(chosen, runs.doc_id.eqNullSafe(F.col("d")) & (runs.digest == F.col("t")) & (runs.no == chosen.no) & (runs.align == chosen.align))
    spots = spots.drop("d", "t", chosen.no, chosen.align).join(texts, "digest")
    pair = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.struct(F.get("item", F.col("ipos") + k).alias("a"), F.get("words", F.col("dpos") + k).alias("b")))
    whole = ["doc_id", "digest", "item_id", "no", "align", "n", "of"]
    pairs = spots.select(*whole, F.explode(pair).alias("p"))
    slot = F.substring("p.a", 1, 1).isin(NUMBER, NAME, UNIT)
    value = pairs.groupBy(*whole, "p.a").agg(
        F.min(F.when(slot, F.col("p.b"))).alias("low"), F.max(F.when(slot, F.col("p.b"))).alias("high"),
        F.min(F.col("p.a") == F.col("p.b")).alias("same"),
    )
    judged = value.groupBy(*whole).agg(
        F.min(F.coalesce(F.col("low") == F.col("high"), F.lit(True))).alias("consistent"), F.min("same").alias("exact")
    )
    best = judged.where("consistent").groupBy("doc_id", "digest", "item_id", "no", "of").agg(F.max("n").alias("n"), F.max("exact").alias("exact"))
    told = best.select("doc_id", "item_id", F.col("n").alias("n_windows"), (F.col("n") / F.col("of")).alias("coverage"), "exact", "digest")
    return told if bare.isEmpty() else told.unionByName(by_values(docs, bare))


def by_values(docs: DataFrame, bare: DataFrame) -> DataFrame:
    """leaks() of items of slots alone: their words must stand in a document one after another, as they are."""
    literal = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    widths = sorted(r.width for r in bare.select("width").distinct().collect())  # WINDOW values at most
    out = None
    for w in widths:
        mine = bare.where(F.col("width") == w).select("item_id", "item", F.get(windows(literal(F.col("item")), w), F.lit(0)).alias("hash"))
        words = keyed(docs).select("doc_id", "digest", marked(F.col("text")).alias("words"))
        words = words.where(F.size("words") == w) if w < SHORT else words
        starts = words.select("doc_id", "digest", "words", F.posexplode(windows(literal(F.col("words")), w)).alias("dpos", "hash"))
        both = small_join(starts, materialise(mine, "values"), ["hash"], "inner").where(F.slice("words", F.col("dpos") + 1, F.size("item")) == F.col("item"))
        one = both.select("doc_id", "item_id", (F.size("item") - w + 1).cast("long").alias("n_windows"), F.lit(1.0).alias("coverage"), F.lit(True).alias("exact"), "digest").distinct()
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    bad = materialise(leaks(docs, benchmark).select("digest").distinct(), "bad")
    return small_join(packed(docs), bad, ["digest"], "left_anti").select("row.*")
