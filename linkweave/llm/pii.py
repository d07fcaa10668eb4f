"""Personal data by pattern and by information: DataFrame functions only.

Base spans are e-mail and IP addresses, card and phone numbers. The information-theoretic part looks at all words of the
documents that hold such entities: over all documents it counts how many hold a term at all and how many hold it together with
each entity, wherever in the document. A term that tells an entity with at least half certainty, and that lifts its odds by
several bits over the corpus rate, discloses it: it becomes a span of kind "term" at every place of every document, with the
entity or without it, and sanitise() replaces it by a general placeholder.

Positions are code points, end exclusive. Spark has no function for the places of all matches, so they are summed up from the
pieces between matches. The patterns are written so that each character is looked at a bounded number of times: possessive
repeats never give back, and a match starts only at the start of its run of characters or where the last match ended.

Edge cases: null text counts as empty (no spans); a null doc_id stays null; repeated rows give repeated results; terms need
documents of MIN_TEXTS different texts, where near copies count as one, so copies never make a term; ties in the order of terms have no say, as all that
reach the bounds count; a very long text with very many matches costs time in proportion to its length; an empty table gives an
empty result; sanitise returns all columns, of any name, and changes only the texts that hold spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, ident, materialise, packed, sent, small_join
from .decontamination import windows

KINDS = ("email", "ip", "card", "phone")
#: Matches that are gathered at once.
BLOCK = 256
#: Java patterns, equal to the plain ones: those start anywhere, but only a run's start or the end of a match can succeed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Near copies: windows of SHINGLE words, the least hash in each of 64 parts of the hashes' range, bands of four parts to find pairs
#: that may be similar (at 0.9 all but 1 in 10^7), and the share of equal parts from which they are (standard error 0.05 at most), so
#: that copies of 0.9 and more count as one and notes from one template each.
SHINGLE, NEAR = 5, 0.85
#: Different texts that must hold entity and term, the least share of the term's documents, the least bits.
MIN_TEXTS, MIN_SHARE, MIN_BITS = 3, 0.5, 3.0
#: A term is a whole run of letters and digits, none of them of an entity; HIDDEN stands for those of an entity.
HIDDEN = "\ue000"
WORD = rf"(?<![\p{{L}}\p{{N}}{HIDDEN}])[\p{{L}}\p{{N}}]{{4,}}+(?!{HIDDEN})"


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(items: Column, state: Column, out: str, step, enter=None) -> Column:
    """The items' results one after another, with a state carried along: step(state, item, of) -> (state, result).

    Results are gathered in blocks of BLOCK, since an array that grows item by item is copied whole each time; of is what
    enter(state, block) says. Returns struct<out, s>: the results and the last state.
    """
    blocks = bound(items, lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.slice(z, b * BLOCK + 1, F.lit(BLOCK))))

    def one_block(acc, block):
        def go(of):
            def one(a, x):
                new, result = step(a["s"], x, of)
                return F.struct(new.alias("s"), F.concat(a["out"], F.array(result)).alias("out"))

            return F.aggregate(block, F.struct(acc["s"].alias("s"), F.array().cast(f"array<{out}>").alias("out")), one)

        done = bound(enter(acc["s"], block) if enter else F.lit(0), go)
        return bound(done, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    start = F.struct(state.alias("s"), F.array().cast(f"array<array<{out}>>").alias("out"))
    return F.aggregate(blocks, start, one_block, lambda acc: F.struct(F.flatten(acc["out"]).alias("out"), acc["s"].alias("s")))


def located(text: Column, pattern: Column) -> Column:
    """array<struct<start, end, value>> of the matches of pattern, leftmost first and without overlaps."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)
    sized = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda a, b: F.struct(F.length(a).alias("gap"), b.alias("value")))

    def step(at, x, _):
        start = at + x["gap"]
        end = start + F.length(x["value"])
        return end, F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))

    every = folded(sized, F.lit(0), "struct<start:int,end:int,value:string>", step)["out"]
    return F.when(F.rlike(text, pattern), every).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, value>> of all base kinds, by kind, then start."""

    def of(kind: str) -> Column:
        kept = F.filter(located(text, F.lit(PATTERNS[kind])), lambda s: valid(kind, s["value"]))
        return F.transform(kept, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*map(of, KINDS))


def spellings(text: Column) -> Column:
    """The different words of a text, as they are spelled."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spans, words, sketch) of every document, as a written table; words are those outside entities and sketch tells
    near copies, where there are any."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    hidden = rewritten(F.col("text"), F.col("spans"), lambda kind, value: F.regexp_replace(value, r"[\p{L}\p{N}]+", HIDDEN))
    words = F.array_distinct(F.transform(spellings(hidden), F.lower))
    words = F.when(F.size("spans") > 0, words).otherwise(F.array().cast("array<string>"))
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    sketch = F.when(F.size("spans") > 0, sketched(F.col("text"))).otherwise(F.array().cast("array<bigint>"))
    return materialise(rows.select("doc_id", digest.alias("digest"), "spans", words.alias("words"), sketch.alias("sketch")), "spans")


def part(x: Column) -> Column:
    return F.shiftrightunsigned(x, 58)


def sketched(text: Column) -> Column:
    """The least hash in each part, of those of all windows of SHINGLE words; of fewer words the hash of them all."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))
    hashes = bound(words, lambda h: F.when(F.size(h) < SHINGLE, F.array(F.xxhash64(h))).otherwise(windows(h, SHINGLE)))
    first = lambda h: F.filter(h, lambda x, i: (i == 0) | (part(x) != part(F.get(h, i - 1))))
    return bound(F.sort_array(hashes), first)


def classes(texts: DataFrame) -> DataFrame:
    """(digest, class) of near copies among texts (digest, sketch); texts without near copies are their own class."""
    texts = texts.select("digest", F.xxhash64("digest").alias("node"), "sketch")

    def key(band):
        mine = F.filter("sketch", lambda x: F.shiftrightunsigned(x, 60) == band)
        return F.when(F.size(mine) > 0, F.xxhash64(band, mine))

    each = texts.select("node", F.explode(F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(15)), key))).alias("key"))
    shared = each.groupBy("key").agg(F.min("node").alias("root"), F.count("*").alias("n")).where("n > 1")
    links = small_join(each, materialise(shared.select("key", "root"), "shared"), ["key"], "inner").where("node <> root").select("node", "root").distinct()
    for end, name in (("node", "a"), ("root", "b")):
        links = links.join(texts.select(F.col("node").alias(end), F.col("sketch").alias(name)), end)
    parts = lambda c: F.transform(c, part)
    equal = F.size(F.array_intersect("a", "b")) / F.size(F.array_union(parts("a"), parts("b")))
    roots = connected_components(links.where(equal >= NEAR).select(F.col("node").alias("src"), F.col("root").alias("dst")))
    return small_join(texts.select("digest", "node"), materialise(roots, "classes"), ["node"], "left").select("digest", F.coalesce("root", "node").alias("class"))


def disclosing_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(entity, term, share, bits): terms that tell an entity of the same document, by counts over all documents.

    Entities and terms that cannot reach the bounds, by the numbers of their own documents alone, go before they are paired,
    which loses no pair.
    """
    n = found.count()
    entity = F.array_distinct(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["value"])))
    # Copies of a text are one row with their number, so a frequent copy is never gathered.
    texts = found.where(F.size("spans") > 0).groupBy("digest").agg(F.first(entity).alias("entities"), F.first("words").alias("words"), F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    texts = materialise(texts, "texts")
    texts = materialise(texts.drop("sketch").join(classes(texts.select("digest", "sketch")), "digest"), "texts")
    rate = texts.select("copies", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("texts"), F.sum("copies").alias("with_entity"))
    rate = rate.where((F.col("texts") >= MIN_TEXTS) & (F.log2(F.lit(n) / F.col("with_entity")) >= MIN_BITS)).drop("texts")
    held = small_join(texts.select("digest", F.explode("entities").alias("entity")), materialise(rate, "entities"), ["entity"], "inner")
    held = materialise(held, "holders")
    # A term's documents with an entity are at most the entity's, so those of the term are at most that many by MIN_SHARE.
    most = materialise(held.groupBy("digest").agg(F.max("with_entity").alias("most")), "most")
    each = small_join(texts.select("digest", "class", "copies", F.explode("words").alias("term")), most, ["digest"], "inner")
    terms = each.groupBy("term").agg(F.count("*").alias("texts"), F.sum("copies").alias("beside"), F.max("most").alias("most"))
    terms = terms.where((F.col("texts") >= MIN_TEXTS) & (F.col("most") >= F.col("beside") * MIN_SHARE)).select("term", "most")
    terms = materialise(terms, "terms")
    word = F.explode(F.array_distinct(F.transform(spellings(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lower)))
    spread = small_join(docs.select(word.alias("term")), terms.select("term"), ["term"], "left_semi").groupBy("term").agg(F.count("*").alias("with_term"))
    spread = spread.join(terms, "term").where(F.col("most") >= F.col("with_term") * MIN_SHARE).select("term", "with_term")
    each = small_join(each.drop("most"), materialise(spread, "spread"), ["term"], "inner")
    both = F.greatest("with_term", "with_entity")
    joint = each.join(held, "digest").where((F.col("with_entity") >= F.col("with_term") * MIN_SHARE) & (F.log2(F.lit(n) / both) >= MIN_BITS))
    joint = joint.groupBy("entity", "term", "with_entity", "with_term").agg(F.count_distinct("class").alias("texts"), F.sum("copies").alias("joint"))
    share = F.col("joint") / F.col("with_term")
    told = joint.where(F.col("texts") >= MIN_TEXTS).withColumns({"share": share, "bits": F.log2(share * F.lit(n) / F.col("with_entity"))})
    return told.where((F.col("share") >= MIN_SHARE) & (F.col("bits") >= MIN_BITS)).select("entity", "term", "share", "bits")


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, digest, terms array<struct<start, end>>): every place of disclosing terms, in all documents that hold any."""
    told = materialise(disclosing_terms(docs, found).select("term").distinct(), "told")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("digest"), text.alias("text"))
    each = rows.select("doc_id", "digest", F.explode(spellings(F.col("text"))).alias("word")).withColumn("term", F.lower("word"))
    each = small_join(each, told, ["term"], "left_semi").select("doc_id", "digest", "word").distinct()
    hits = materialise(each.groupBy("doc_id", "digest").agg(F.concat_ws("|", F.collect_list("word")).alias("words")), "hits")
    hits = sent(hits, doc_id="d", digest="t")
    both = rows.join(hits, rows.doc_id.eqNullSafe(F.col("d")) & (rows.digest == F.col("t"))).dropDuplicates(["doc_id", "digest"])
    # Terms are letters and digits only, so they stand in a pattern as they are.
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.col("words"), F.lit(r")(?![\p{L}\p{N}])"))
    return both.select("doc_id", "digest", F.transform(located(F.col("text"), pattern), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"))).alias("terms"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, spans, terms) of every document: base spans and disclosing terms."""
    found = scanned(docs)
    terms = sent(materialise(term_spans(docs, found), "terms"), doc_id="d", digest="t")
    both = found.join(terms, found.doc_id.eqNullSafe(F.col("d")) & (found.digest == F.col("t")), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    free = F.filter("terms", lambda w: ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    return both.select("doc_id", "digest", "spans", F.coalesce(free, none).alias("terms"))


def span_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans: the base and term spans as text."""
    found = find_personal_data(docs)
    base = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    more = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, more), ",").alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def bracketed(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("["), F.upper(kind), F.lit("]"))


def rewritten(text: Column, spans: Column, put_for=bracketed) -> Column:
    """text with every span replaced by its kind in brackets, or what put_for gives; of a span that begins in an earlier one
    the rest is replaced, so no character of any span stays.

    A block of spans looks at its own stretch of the text only, so the work is in proportion to the text.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("stop"), s["kind"].alias("kind"))))

    def enter(at, block):
        last = F.array_max(F.transform(block, lambda s: -s["stop"]))
        return F.struct(at.alias("base"), F.substring(text, at + 1, last - at).alias("text"))

    def step(at, s, of):
        begin, end = F.greatest(at, s["start"]), -s["stop"]
        gap = F.substring(of["text"], at - of["base"] + 1, begin - at)
        shown = put_for(s["kind"], F.substring(of["text"], begin - of["base"] + 1, end - begin))
        return F.greatest(at, end), F.when(end > begin, F.concat(gap, shown)).otherwise("")

    done = folded(ordered, F.lit(0), "string", step, enter)
    whole = bound(done, lambda r: F.concat(F.array_join(r["out"], ""), F.substring(text, r["s"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in text; all other columns and rows stay."""
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    hit = find_personal_data(docs).where("size(spans) > 0 or size(terms) > 0")
    hit = materialise(hit.select(ident(F.col("doc_id")).alias("id"), "digest", F.concat(base, terms).alias("spans")).dropDuplicates(["id", "digest"]), "hits")
    rows = small_join(packed(docs), hit, ["id", "digest"], "left")
    old = F.col("row")["text"]
    text = F.when(F.col("spans").isNull(), old).otherwise(rewritten(old.cast("string"), F.col("spans")))
    return rows.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
