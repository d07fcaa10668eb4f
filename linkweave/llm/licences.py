"""Licence scan by a positional rare-token index: DataFrame functions only.

Document frequencies of the words of all mandatory key phrases are counted over the whole table. The rarest two of each key
phrase (highest IDF) index its template, however common they are. Each file looks up the index words of every template of which
it has all, joins their places to the postings of the licence templates, and keeps the (template, offset) alignments that
both words agree on; a template is reported where its mandatory key phrase stands at the aligned place and at least SHARE of all
its words stand at theirs, so every such place is found and a file's answer doesn't depend on its neighbours. Versions are part of
the key phrases. Plain key phrases are found besides, in all files.

Edge cases: null text counts as empty (0 words, no places); a null doc_id stays null; repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored; the work on a very long text is in proportion to its words, and
ties have no say, as all places and labels are returned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sent

# Key phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Fixed values: (label, template, mandatory phrase of it, with its version where it has one).
TEMPLATES = (
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2.0", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", "free software foundation either version 2 of the license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3.0", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "free software foundation either version 3 of the license"),
    ("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    ("lgpl-2.1", "gnu lesser general public license v2 1", "gnu lesser general public license v2 1"),
    ("lgpl-3.0", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
)
#: Share of a template's words that must stand at their places for it to be reported.
SHARE = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Index words of a template, all of which must agree on a place.
AGREE = 2


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def places(words: Column, phrase: str) -> Column:
    """Places where the words of phrase stand one after another; others than files with its last word aren't searched."""
    parts = phrase.split()
    none = F.array().cast("array<int>")

    def here(i):
        return reduce(lambda a, b: a & b, (F.get(words, i + k) == w for k, w in enumerate(parts)))

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), here)
    return F.when(F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]), found).otherwise(none)


def index_words(rows: DataFrame) -> list[list[str]]:
    """For each template the AGREE words of its key phrase with the least document frequency, whatever that is.

    A verified template has all words of its key phrase in place, so these words always agree on it: rarity only keeps the
    look-up short.
    """
    vocabulary = sorted({w for _, _, key in TEMPLATES for w in key.split()})
    held = rows.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("w"))
    df = {r.w: r.n for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}  # at most one row a licence word
    return [sorted(set(key.split()), key=lambda w: (df.get(w, 0), w))[:AGREE] for _, _, key in TEMPLATES]


def aligned(rows: DataFrame, index: list[list[str]]) -> DataFrame:
    """(doc_id, digest, method array<struct<label, score>>) of the files with verified templates."""
    spark = rows.sparkSession
    # A file looks up the words of the templates of which it has all index words.
    sets = F.array(*(F.array(*map(F.lit, ws)) for ws in index))
    present = F.array_intersect(F.array(*map(F.lit, sorted({w for ws in index for w in ws}))), F.col("words"))
    whole = F.transform(F.array(present), lambda h: F.flatten(F.filter(sets, lambda ws: F.size(F.array_except(ws, h)) == 0)))
    rare = F.array_distinct(F.flatten(whole))
    held = rows.select("doc_id", "digest", "words", rare.alias("rare")).where(F.size("rare") > 0)
    held = materialise(held.select("doc_id", "digest", "words", "rare").dropDuplicates(["doc_id", "digest"]), "held")
    posting = [(t, w, p) for t, (_, text, _) in enumerate(TEMPLATES) for p, w in enumerate(text.split()) if w in index[t]]
    postings = F.broadcast(spark.createDataFrame(posting, "template int, word string, at int"))  # bounded by the templates
    seen = held.select("doc_id", "digest", "rare", F.posexplode("words").alias("pos", "word")).where(F.array_contains("rare", F.col("word")))
    votes = seen.join(postings, "word").groupBy("doc_id", "digest", "template", (F.col("pos") - F.col("at")).alias("offset"))
    votes = votes.agg(F.count_distinct("word").alias("agree")).where(F.col("agree") >= AGREE)
    spots = votes.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("template", "offset")).alias("spots"))

    texts = F.array(*(F.array(*map(F.lit, text.split())) for _, text, _ in TEMPLATES))
    keys = F.array(*(F.array(*map(F.lit, key.split())) for _, _, key in TEMPLATES))
    starts = F.array(*(F.lit(_start(text.split(), key.split())) for _, text, key in TEMPLATES))
    names = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))

    def verified(s):
        key = F.get(keys, s["template"])
        at = s["offset"] + F.get(starts, s["template"])
        return (at >= 0) & (F.slice(F.col("words"), F.greatest(at, F.lit(0)) + 1, F.size(key)) == key)

    def scored(s):
        text = F.get(texts, s["template"])
        same = F.filter(F.sequence(F.lit(0), F.size(text) - 1), lambda i: F.get(F.col("words"), s["offset"] + i) == F.get(text, i))
        return F.struct(F.get(names, s["template"]).alias("label"), (F.size(same) / F.size(text)).alias("score"))

    both = held.join(spots.withColumnsRenamed({"doc_id": "d", "digest": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("t")))
    good = F.filter(F.transform(F.filter("spots", verified), scored), lambda m: m["score"] >= SHARE)
    return both.select("doc_id", "digest", F.array_distinct(good).alias("method")).where(F.size("method") > 0)


def _start(text: list[str], key: list[str]) -> int:
    return next(k for k in range(len(text)) if text[k : k + len(key)] == key)


def scan_licences(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document.

    score is the matched share of the best verified template's words; a plain phrase alone gives 0.5, nothing 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).alias("digest"))
    found = [places(F.col("words"), p) for p in PHRASES]
    base = rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), *(x.alias(f"p{k}") for k, x in enumerate(found)))
    method = sent(materialise(aligned(rows, index_words(rows)), "method"), doc_id="d", digest="t")
    both = base.join(method, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("t")), "left")
    every = F.concat(*(F.col(f"p{k}") for k in range(len(found))))
    plain = F.filter(F.array(*(F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    more = F.coalesce(F.transform("method", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("method", lambda m: m["score"])), F.lit(0.0))
    return both.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(plain)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(plain, more))), ",").alias("labels"),
        F.greatest(best, F.when(F.size(every) > 0, 0.5).otherwise(0.0)).alias("score"),
    )
