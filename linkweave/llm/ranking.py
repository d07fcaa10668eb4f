"""Ranked lexical search by Fagin's threshold algorithm.

The corpus is read once into a forward index: for each different sequence of terms the terms that items ask for, with their
counts; copies are one entry with the K least ids. Every asked term has a list of its entries, highest impact first. A list is
read in bands of growing depth: round r reads band r of all lists of the items that are still open (round robin, a band at a
time), looks up the entries met there in the forward index to get their whole scores, and closes an item once the threshold,
which is the sum of the highest impacts that its lists have not shown yet, falls strictly below its K-th score. The heads of the
lists, whose size the terms bound and not the documents, are written sorted and divided by band; deeper bands are written in the
same way when an item needs them, down to the ends of the lists.

A place in a list comes from the counts of its impacts (fewer than 10^6 numbers a term) and, among equal impacts, from a hash of
the entry, so no list is ever gathered or numbered in one task, however common its term. Items are taken in lots of about LOT
(item, term) pairs and results, which is what tasks and driver hold of them: the driver keeps the thresholds and the k best
entries of the lot's items. Each lot reads the corpus again.

Edge cases: null or empty texts have no terms: such documents count nowhere, such items get no rows; each row of either table
counts as a document or an item of its own, also where ids are null or repeat; null ids rank behind others at equal scores;
an empty table gives an empty result; very long texts are read whole, a task holds one at a time; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import partial, reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, small_join, tidied

K = 10
#: Places of a list that band b goes from and up to: 0, 16, 64, 256, 1024, ... ; bands that are written at once.
FIRST, GROWTH, AT_ONCE = 16, 4, 4
#: (item, term) pairs and results of a lot.
LOT = 500_000

_fold = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _fold[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
_fold[0x41:0x5B] += 0x20
FOLD = _fold.tobytes()  # bytes of terms, A-Z lower-cased; all others become spaces


def depth(band: int) -> int:
    """The first place of a band."""
    return FIRST * GROWTH ** (band - 1) if band else 0


def term_list(text: pa.Scalar) -> list[bytes]:
    return text.as_buffer().to_pybytes().translate(FOLD).split() if text.is_valid else []


def _item_batches(batches):
    for batch in batches:
        terms = [sorted(set(term_list(t))) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.binary()))], ["item_id", "terms"])


def asked_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): item numbers the rows that have terms."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    got = rows.mapInArrow(_item_batches, "item_id long, terms array<binary>").where("size(terms) > 0")
    return materialise(got.withColumn("item", F.monotonically_increasing_id()), "asked")


def _scan_batches(batches, number):
    return tidied(_scans(batches, number))


def _scans(batches, number):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            ids, digests, sizes, ends, terms, counts = [], [], [], [0], [], []
            for i, t in zip(part.column(0).to_pylist(), part.column(1)):
                words = term_list(t)
                if not words:
                    continue
                held = Counter(words)
                for w in held.keys() & number.keys():
                    terms.append(number[w])
                    counts.append(held[w])
                ids.append(i)
                digests.append(md5(b" ".join(words)).digest())
                sizes.append(len(words))
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in ((terms, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), *lists], ["id", "digest", "n", "terms", "counts"])


def scan(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(id, digest, n, terms, counts) of each document with a term: digest of its sequence of terms, n its terms with repeats,
    then the numbered terms that it holds with their occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_scan_batches, number=number), "id long, digest binary, n long, terms array<int>, counts array<long>")


def exploded(forward: DataFrame) -> DataFrame:
    """(entry, copies, t, g) of each term of the entries; g is what the term adds to a score, but for its weight."""
    each = forward.select("entry", "copies", "m", F.posexplode("terms").alias("at", "t"), "counts")
    each = each.select("entry", "copies", "m", "t", F.get("counts", F.col("at")).alias("tf"))
    return each.select("entry", "copies", "t", F.expr("(1000000000 * tf) div (1000 * tf + 8 * m)").cast("int").alias("g"))


class Index:
    """Forward index of a corpus for numbered terms.

    forward: (entry, id, copies, m, terms, counts), an entry for each different sequence of terms; id is its least;
    ids: (entry, ids), the k least ids of each;
    levels: (t, g, places, before, w): for each impact g of a term the entries with it and those with a higher one.
    """

    def __init__(self, docs: DataFrame, number: dict[bytes, int], k: int = K):
        rows = materialise(scan(docs, number).withColumn("row", F.monotonically_increasing_id()), "scanned")
        order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        first = rows.select("digest", order.alias("o")).withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("o"))).where(F.col("r") <= k)
        kept = first.groupBy("digest").agg(F.array_sort(F.collect_list("o")).alias("o"))  # k rows
        self.ids = materialise(kept.select(F.col("o")[0]["row"].alias("entry"), F.col("o.id").alias("ids")), "ids")
        size = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(1)).alias("terms")).first()
        m = F.expr(f"10 + (90 * n * {size.docs}L) div {size.terms}L").alias("m")
        once = rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min(order).alias("o"), F.first(F.struct("n", "terms", "counts")).alias("one"))
        once = once.select(F.col("o.row").alias("entry"), "o.id", "copies", "one.*").select("entry", "id", "copies", m, "terms", "counts")
        self.forward = materialise(once, "forward")
        discard(rows)
        level = exploded(self.forward).groupBy("t", "g").agg(F.count("*").alias("places"), F.sum("copies").alias("copies"))
        by = Window.partitionBy("t").orderBy(F.desc("g"))
        level = level.withColumns({"before": F.sum("places").over(by) - F.col("places"), "df": F.sum("copies").over(Window.partitionBy("t"))})
        w = F.floor(1000 * F.log((2.0 * size.docs + 2) / (2 * F.col("df").cast("double") + 1)))
        self.levels = materialise(level.select("t", "g", "places", "before", w.cast("long").alias("w")), "levels")

    def heads(self, band: int) -> DataFrame:
        """The sorted lists, (t, g, entry, band), from this band over AT_ONCE of them, divided by band. A list's part is bounded by depth."""
        lo, hi = depth(band), depth(band + AT_ONCE)
        met = materialise(self.levels.where((F.col("before") < hi) & (F.col("before") + F.col("places") > lo)).select("t", "g", "places", "before"), "met")
        ends = materialise(met.groupBy("t").agg(F.min("g").alias("least"), F.max("g").alias("most")), "ends")
        some = small_join(exploded(self.forward).select("t", "g", "entry"), ends, ["t"], "inner").where("g between least and most").drop("least", "most")
        some = small_join(some, met, ["t", "g"], "inner")
        among = F.shiftrightunsigned(F.xxhash64("entry"), 12) / F.lit(float(1 << 52))  # in [0, 1)
        place = F.col("before") + F.floor(F.col("places") * among)
        at = F.lit(band)
        for b in range(band + 1, band + AT_ONCE):
            at = F.when(F.col("place") >= depth(b), F.lit(b)).otherwise(at)
        some = some.withColumn("place", place).where((F.col("place") >= lo) & (F.col("place") < hi)).select("t", "g", "entry", at.alias("band"))
        lists = materialise(some.repartition("band", "t").sortWithinPartitions("band", "t", F.desc("g"), "entry"), "lists", "band")
        discard(ends)
        discard(met)
        return lists

    def unseen(self, band: int, terms: int) -> np.ndarray:
        """By number of the lot's terms the highest impact that bands below this one have not shown, 0 at the end of a list."""
        left = self.levels.where(F.col("before") + F.col("places") > depth(band)).groupBy("t").agg(F.max("g").alias("g")).collect()
        out = np.zeros(terms, np.int64)
        out[[r.t for r in left]] = [r.g for r in left]
        return out


def _look_up_batches(batches, sums, parts, weights):
    return tidied(_look_ups(batches, sums, parts, weights))


def _look_ups(batches, sums, parts, weights):
    """Whole scores: sums[item] and the next one bound the item's terms in parts, each with its weight."""
    impact = np.zeros(int(parts.max(initial=-1)) + 1, np.int64)
    for batch in batches:
        rows, items, scores = [], [], []
        m, terms, counts, asked = (batch.column(batch.schema.get_field_index(c)) for c in ("m", "terms", "counts", "items"))
        for k in range(batch.num_rows):
            t, tf, who = terms[k].values.to_numpy(), counts[k].values.to_numpy(), asked[k].values.to_numpy()
            impact[t] = 1_000_000_000 * tf // (1000 * tf + 8 * m[k].as_py())
            size = sums[who + 1] - sums[who]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(sums[who] - (ends - size), size)
            scores.append(np.add.reduceat(weights[at] * impact[parts[at]], ends - size))
            impact[t] = 0
            items.append(who)
            rows.append(np.full(len(who), k))
        if rows:
            same = pa.array(np.concatenate(rows))
            own = [batch.column(batch.schema.get_field_index(c)).take(same) for c in ("entry", "id", "copies")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items)), *own, pa.array(np.concatenate(scores))], ["item", "entry", "id", "copies", "score"])


def _merged(best: dict, rows, k: int) -> None:
    """Put rows among the k best entries of their items: highest score, then least id, null ids last."""
    for r in rows:
        best.setdefault(r.item, {})[r.entry] = (-r.score, r.id is None, r.id or 0, r.entry, r.copies)
    for item in {r.item for r in rows}:
        best[item] = {x[3]: x for x in sorted(best[item].values())[:k]}


def _kth(entries: dict, k: int) -> int | None:
    """The k-th score of an item's documents; None if fewer are found."""
    found = 0
    for score, _, _, _, copies in sorted(entries.values()):
        found += copies
        if found >= k:
            return -score
    return None


def search_lot(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of the items asked, which are few enough for one lot."""
    spark = docs.sparkSession
    lot = [(r.item_id, [bytes(t) for t in r.terms]) for r in asked.select("item_id", "terms").collect()]
    terms = sorted({t for _, x in lot for t in x})
    number = {t: k for k, t in enumerate(terms)}
    index = Index(docs, number, k)
    weight = {r.t: r.w for r in index.levels.groupBy("t").agg(F.first("w").alias("w")).collect()}
    own = [[number[t] for t in x if number[t] in weight] for _, x in lot]  # terms that no document has drop out
    parts = np.array([t for x in own for t in x], np.int64)
    sums = np.cumsum([0, *map(len, own)])
    weights = np.array([weight[t] for t in parts.tolist()], np.int64)
    item_of = np.repeat(np.arange(len(own)), np.diff(sums))
    still = np.diff(sums) > 0
    best: dict[int, dict] = {}
    kth = np.full(len(own), -1)  # -1: fewer than k found
    lists, band = None, 0
    while still.any():
        if band % AT_ONCE == 0:
            if lists is not None:
                discard(lists)
            lists = index.heads(band)
        ahead = weights * index.unseen(band + 1, len(terms))[parts]
        total = np.append(0, np.cumsum(ahead))
        threshold = total[sums[1:]] - total[sums[:-1]]
        # An entry that no earlier band has shown scores at most the threshold and what it showed above that: no look-up where
        # this falls below the k-th score. (What earlier bands have shown was looked up then.)
        lack = np.where(kth < 0, np.iinfo(np.int64).min, kth - threshold)
        on = still[item_of]
        opened = pd.DataFrame({"t": parts[on].astype(np.int32), "item": item_of[on], "w": weights[on], "ahead": ahead[on], "lack": lack[item_of[on]]})
        opened = F.broadcast(spark.createDataFrame(opened))  # at most the pairs of a lot
        shown = lists.where(F.col("band") == band).select("t", "entry", "g").join(opened, "t")
        met = shown.groupBy("item", "entry").agg(F.sum(F.col("w") * F.col("g") - F.col("ahead")).alias("above"), F.first("lack").alias("lack")).where("above >= lack")
        met = materialise(met.groupBy("entry").agg(F.collect_list("item").alias("items")), "met")  # at most the items of a lot
        # Random look-ups of the whole scores in the forward index.
        looked = small_join(index.forward, met, ["entry"], "inner")
        scored = looked.mapInArrow(partial(_look_up_batches, sums=sums, parts=parts, weights=weights), "item long, entry long, id long, copies long, score long").where("score > 0")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "entry")
        _merged(best, scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).collect(), k)
        discard(met)
        for item in np.nonzero(still)[0].tolist():
            found = _kth(best.get(item, {}), k)
            kth[item] = -1 if found is None else found
        still &= (threshold > 0) & ((kth < 0) | (threshold >= kth))
        band += 1
    rows = [(lot[item][0], item, entry, -x[0]) for item, entries in best.items() for entry, x in entries.items()]
    found = F.broadcast(spark.createDataFrame(rows, "item_id long, item long, entry long, score long"))  # the results of a lot
    each = index.ids.join(found, "entry").select("item", "item_id", "score", "entry", F.posexplode("ids").alias("copy", "doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "entry", "copy")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    for used in (index.forward, index.levels, *([lists] if lists is not None else [])):
        discard(used)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, lot: int = LOT) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    asked = asked_terms(items)
    lots = max(1, math.ceil((asked.agg(F.sum(F.size("terms") + k)).first()[0] or 0) / lot))
    of = F.pmod(F.xxhash64("item"), F.lit(lots))
    return reduce(DataFrame.unionByName, [search_lot(docs, asked.where(of == n), k) for n in range(lots)])
