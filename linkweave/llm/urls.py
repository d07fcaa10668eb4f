"""URL filter: rules first, then a path-template tree per host. DataFrame functions only.

Paths become templates: numbers, hexadecimal names and dates in a segment are typed placeholders. The tree is then built level by
level from the root. At each node a segment that takes many different values, none of which holds a large share of the node's
different paths, becomes a wildcard, so the next level's nodes are templates already. Of a node's branches those whose labelled
share of blocked pages doesn't differ significantly from that of their siblings are merged, at every level. A template is rejected
if its smoothed share of blocked pages reaches the threshold; shares are smoothed down the tree: a fixed prior, the host, the
merged branch at each level, the template. Labels are the verdicts of rules on the urls that they fit, or given ones.

Paths count once for the shape of the tree, however many urls have them, so repeated rows don't change it. Nodes are counted by
combining aggregates and written; a join with them sends small ones to all tasks, and a frequent host's paths can be split.

Edge cases: a url that is null or has no "://" has empty host and path, fits no rule and is judged as the root of the empty
host; segments beyond DEPTH are read as one, so a very long url is one path like others; without any labels everything that no
rule fits is allowed; a null page_id stays; repeated rows give repeated results; of values of equal count none is preferred; an
empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_join

#: (verdict, host, path) of the rules that the query uses.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DEPTH = 4
#: A segment is variable with so many different values, none of which has more than this share of the node's paths.
MANY, LARGEST = 8, 0.25
#: Normal quantile of the merging test, strength of the smoothing in urls, prior share of bad urls where nothing is known,
#: and the share that rejects. The prior isn't the labelled share: rules name what is bad far more often than what is good.
Z, STRENGTH, PRIOR, REJECT = 1.96, 4.0, 0.2, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are a list in the program, tested longest first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The first DEPTH segments of a path, the last of them with all that follows, with typed placeholders."""
    typed = F.regexp_replace(F.concat(F.lit("/"), path), "[0-9]{4}-[0-9]{2}-[0-9]{2}", "{d}")
    typed = F.regexp_replace(typed, r"(?<=[/_.-])(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{8,}(?=$|[/_.-])", "{h}")
    typed = F.regexp_replace(typed, "[0-9]+", "{n}")
    return F.split(F.regexp_replace(typed, "^/+", ""), "/+", DEPTH)


def judged(pages: DataFrame, rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity); labels (page_id, bad 0 or 1) replace the rules' verdicts as labels."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), verdict.alias("said"), segments(F.col("path")).alias("segs"))
    bad = (F.col("said") == "block").cast("long")
    if labels is not None:
        marks = labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad")).where("page_id is not null")
        rows = rows.join(marks.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left")
        bad = F.col("bad")
    rows = materialise(rows, "urls")
    leaf = rows.groupBy("host", "segs").agg(F.count(bad).alias("labels"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"))
    verdicts = materialise(templates(leaf), "verdicts")
    out = small_join(rows, verdicts, ["host", "segs"], "inner")
    mine = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", mine).alias("verdict"), "template", "purity")


def smoothed(prior: Column) -> Column:
    """Posterior share of labels and bad under a prior share."""
    return (F.col("bads") + STRENGTH * prior) / (F.col("labelled") + STRENGTH)


def templates(leaf: DataFrame) -> DataFrame:
    """(host, segs, labels, bad) of different paths -> (host, segs, template, purity)."""
    sums = [F.sum("labels").alias("labelled"), F.sum("bad").alias("bads")]
    hosts = leaf.groupBy("host").agg(*sums).select("host", smoothed(F.lit(PRIOR)).alias("share"))
    # share: of the branch so far; at: the template so far; kin: the merged branches so far.
    tree = leaf.join(hosts, "host").withColumns({"at": F.lit(""), "kin": F.lit("")})
    tree = materialise(tree, "tree")
    for level in range(DEPTH):
        seg = F.get("segs", F.lit(level))
        value = tree.where(seg.isNotNull()).groupBy("host", "at", seg.alias("seg")).agg(F.count("*").alias("n"))
        node = value.groupBy("host", "at").agg(F.count("*").alias("values"), F.max("n").alias("most"), F.sum("n").alias("paths"))
        wild = node.where((F.col("values") >= MANY) & (F.col("most") <= LARGEST * F.col("paths"))).select("host", "at", F.lit("*").alias("wild"))
        wild = materialise(wild, "wild")
        shown = small_join(tree, wild, ["host", "at"], "left").withColumn("seg", F.when(seg.isNotNull(), F.coalesce("wild", seg))).drop("wild")
        # Two-proportion test of a branch against its siblings; without labels on a side there is nothing to tell apart.
        branch = shown.where("seg is not null").groupBy("host", "kin", "seg").agg(*sums)
        every = materialise(branch.groupBy("host", "kin").agg(F.sum("labelled").alias("hl"), F.sum("bads").alias("hb")), "siblings")
        both = small_join(materialise(branch, "branches"), every, ["host", "kin"], "inner")
        other, other_bad = F.col("hl") - F.col("labelled"), F.col("hb") - F.col("bads")
        pooled = F.try_divide(F.col("hb"), F.col("hl"))
        spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), other)))
        differs = (F.col("labelled") > 0) & (other > 0) & (spread > 0)
        differs = F.when(differs, F.abs(F.try_divide(F.col("bads"), F.col("labelled")) - F.try_divide(other_bad, other)) > Z * spread).otherwise(F.lit(False))
        own = materialise(both.where(differs).select("host", "kin", "seg", F.col("seg").alias("own")), "own")
        grown = small_join(shown, own, ["host", "kin", "seg"], "left")
        more = lambda name, part: F.when(F.col("seg").isNull(), F.col(name)).otherwise(F.concat(name, F.lit("/"), part)).alias(name)
        grown = materialise(grown.select("host", "segs", "labels", "bad", "share", F.col("seg").isNotNull().alias("deep"), more("at", F.col("seg")), more("kin", F.coalesce("own", F.lit("*")))), "grown")
        branch = grown.where("deep").groupBy("host", "kin").agg(*sums)
        branch = materialise(branch, "kin")
        before, tree = tree, materialise(
            small_join(grown, branch, ["host", "kin"], "left").withColumn("share", F.when(F.col("deep") & F.col("labelled").isNotNull(), smoothed(F.col("share"))).otherwise(F.col("share"))).drop("deep", "labelled", "bads"), "tree"
        )
        for used in (before, grown):
            discard(used)
    whole = materialise(tree.groupBy("host", "kin", "at").agg(*sums), "templates")
    out = small_join(tree, whole, ["host", "kin", "at"], "inner")
    return out.select("host", "segs", F.when(F.col("at") == "", "/").otherwise(F.col("at")).alias("template"), smoothed(F.col("share")).alias("purity"))
