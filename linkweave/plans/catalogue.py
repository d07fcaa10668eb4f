"""Named queries over the driver tables and the SQL that says what they return: sources, lookups, aggregates, paths, metrics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkweave.functions import text as tx
from linkweave.operators import graph, links, lookup, mentions, metrics, stats

from .fixtures import edges, edges_sql, relation, table
from .registry import LIFT, QUERIES, query, r6, r6w


# ---------------------------------------------------------------- sources, projections, scalars

@query("s01_json_map_explode", "SELECT event_id, 'k' AS key, CAST(json_extract_string(props, '$.k') AS BIGINT) AS value FROM events")
def _(s, d):
    m = table(s, d, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return m.select("event_id", F.explode("m").alias("key", "value")).where("key = 'k'")


@query("s15_nodes_by_kind", f"WITH {edges_sql()} SELECT kind, COUNT(*) AS nodes FROM (SELECT src_kind AS kind, src AS id FROM edges UNION SELECT dst_kind, dst FROM edges) GROUP BY kind")
def _(s, d):
    e = edges(s, d)
    return e.select(F.col("src_kind").alias("kind"), F.col("src").alias("id")).union(e.select("dst_kind", "dst")).distinct().groupBy("kind").agg(F.count("*").alias("nodes"))


@query("s16_edges_by_relation", f"WITH {edges_sql(['TARGETS'])} SELECT src, dst FROM edges")
def _(s, d):
    return relation(s, d, "TARGETS")


@query("s17_triples", f"WITH {edges_sql(['TARGETS'])} SELECT 'Drug::' || src || ' ' || rel || ' Protein::' || dst AS line FROM edges")
def _(s, d):
    e = edges(s, d, ["TARGETS"])
    return e.select(F.concat_ws(" ", F.concat_ws("::", "src_kind", "src"), "rel", F.concat_ws("::", "dst_kind", "dst")).alias("line"))


@query("s27_names", "SELECT 'Part::' || CAST(p_partkey AS VARCHAR) AS node, CAST(p_partkey AS VARCHAR) AS id, p_name AS name FROM part")
def _(s, d):
    p = table(s, d, "part").select(F.concat(F.lit("Part::"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_name").alias("name"))
    return p.select("node", F.split("node", "::")[1].alias("id"), "name").where("size(split(node, '::')) >= 2")


@query("p01_rename", 'SELECT p_partkey AS part_key, p_name AS part_name FROM part')
def _(s, d):
    return table(s, d, "part").select("p_partkey", "p_name").withColumnsRenamed({"p_partkey": "part_key", "p_name": "part_name"})


@query("p03_array_contains", "SELECT o_orderkey FROM (SELECT l_orderkey AS o_orderkey, list(l_returnflag) AS flags FROM lineitem GROUP BY 1) WHERE list_contains(flags, 'R')")
def _(s, d):
    g = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("flags"))
    return g.where(F.array_contains("flags", "R")).select("o_orderkey")


@query("p04_key_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (1, 5, 7)")
def _(s, d):
    return table(s, d, "customer").where(~F.col("c_nationkey").isin(1, 5, 7)).select("c_custkey", "c_mktsegment")


@query("p05_array_anti", "SELECT l_orderkey, COUNT(*) AS kept FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def _(s, d):
    small = table(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(s, d, "lineitem").join(small, "l_partkey", "left_anti").groupBy("l_orderkey").agg(F.count("*").alias("kept"))


@query("p08_route_empty", "SELECT c_custkey, CASE WHEN COUNT(o_orderkey) = 0 THEN 'empty' ELSE 'full' END AS route FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def _(s, d):
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(s, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.when(F.col("n").isNull(), "empty").otherwise("full").alias("route"))


@query("p09_codes_by_length", "SELECT p_partkey, list_filter([p_brand, p_brand || p_type, CAST(p_size AS VARCHAR)], lambda x: length(x) = 2)[1] AS two FROM part")
def _(s, d):
    codes = F.array("p_brand", F.concat("p_brand", "p_type"), F.col("p_size").cast("string"))
    return table(s, d, "part").select("p_partkey", F.get(F.filter(codes, lambda x: F.length(x) == 2), F.lit(0)).alias("two"))


@query("p10_known_action", "SELECT l_orderkey, l_linenumber, CASE WHEN lower(l_returnflag) = 'r' THEN 'known' ELSE 'unknown' END AS action FROM lineitem WHERE l_linestatus IS NOT NULL AND l_linestatus <> ''")
def _(s, d):
    rows = table(s, d, "lineitem").where(F.col("l_linestatus").isNotNull() & (F.col("l_linestatus") != ""))
    return rows.select("l_orderkey", "l_linenumber", F.when(F.lower("l_returnflag") == "r", "known").otherwise("unknown").alias("action"))


@query("p13_phase_router", "SELECT o_orderkey, CASE WHEN contains(o_orderpriority, '1') OR contains(o_orderpriority, '2') THEN '12' WHEN contains(o_orderpriority, '3') OR contains(o_orderpriority, '4') THEN '34' END AS phase FROM orders")
def _(s, d):
    return table(s, d, "orders").select("o_orderkey", tx.phase(F.col("o_orderpriority")).alias("phase"))


@query("p23_array_field", "SELECT l_orderkey, list_sort(list(l_partkey)) AS parts FROM lineitem GROUP BY 1 HAVING l_orderkey % 10 = 1 OR l_orderkey % 10 <> 1")
def _(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_linenumber")).alias("x"))
    return g.select("l_orderkey", F.array_sort(F.transform("x", lambda x: x["l_partkey"])).alias("parts"))


@query("f01_clean", r"SELECT doc_id, md5(translate(regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '\(PubMed:[^)]*\)', '', 'g'), chr(13) || chr(10), '  ')) AS cleaned FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(tx.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query("f02_sentences", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[.!?]\s+')) + 1 AS BIGINT) AS sentences FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


_CUT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"


@query("f02_sentence_rows", f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, {_CUT} AS s FROM documents), range(1, len(s) + 1) t(i)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("f03_piece_rows", r"SELECT doc_id, i - 1 AS pos, p[i] AS piece FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '\s*\|\s*', '; ', 'g'), '; '), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents), range(1, len(p) + 1) t(i)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(tx.pieces(F.col("text"))).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("long"))


@query("p19_affirmed_rows", f"SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, list_filter({_CUT}, lambda x: NOT contains(lower(x), 'not') AND NOT contains(lower(x), 'contraindicated')) AS s FROM documents), range(1, len(s) + 1) t(i)")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.posexplode(tx.affirmed(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query("f03_pieces", r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '\s*\|\s*', '; ', 'g'), '; '), lambda x: trim(x, ' ')), lambda x: x <> '')) AS BIGINT) AS pieces FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(tx.pieces(F.col("text"))).cast("long").alias("pieces"))


@query("f04_capitalised", "SELECT p_partkey, upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", tx.capitalised(F.col("p_name")).alias("name"))


@query("f08_padded", "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 3, '0') AS code FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.lpad(F.col("p_size").cast("string"), 3, "0").alias("code"))


@query("f13_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS p FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", r6(tx.sigmoid(F.col("value") / 100)).alias("p"))


@query("p19_negation", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: NOT contains(lower(x), 'not') AND NOT contains(lower(x), 'contraindicated'))) AS BIGINT) AS affirmed FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.size(tx.affirmed(F.col("text"))).cast("long").alias("affirmed"))


@query("p20_abbreviations", "SELECT p_partkey, (upper(p_brand) = p_brand AND lower(p_brand) <> p_brand) AS abbreviation FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", tx.isolated_abbreviation(F.col("p_brand")).alias("abbreviation"))


# ---------------------------------------------------------------- joins and lookups

_ALIAS_SQL = "WITH v AS (SELECT p_partkey AS id, p_partkey AS pos, p_name AS name, p_brand AS syn FROM part), a AS (SELECT {f}(name) AS alias, id, pos FROM v UNION ALL SELECT {f}(syn), id, pos FROM v), m AS (SELECT alias, arg_min(id, pos) AS matched_id FROM a GROUP BY alias) "


def _vocabulary(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.array("p_brand").alias("synonyms"))


@query("j01_edge_merge", f"WITH {edges_sql(['TARGETS'])} SELECT DISTINCT src, dst FROM edges JOIN part ON src = CAST(p_partkey AS VARCHAR) JOIN supplier ON dst = CAST(s_suppkey AS VARCHAR) WHERE p_size > 10")
def _(s, d):
    parts = table(s, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("src"))
    supp = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("dst"))
    return relation(s, d, "TARGETS").join(parts, "src", "left_semi").join(supp, "dst", "left_semi").select("src", "dst").dropDuplicates()


@query("j03_alias_semi", _ALIAS_SQL.format(f="lower") + "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(p_brand) IN (SELECT alias FROM a)")
def _(s, d):
    known = lookup.aliases(_vocabulary(s, d)).select("alias")
    rows = table(s, d, "lineitem").join(table(s, d, "part"), F.expr("l_partkey = p_partkey")).withColumn("alias", F.lower("p_brand"))
    return rows.join(known, "alias", "left_semi").select("l_orderkey", "l_linenumber")


@query("j05_first_match", _ALIAS_SQL.format(f="lower") + "SELECT p_partkey, matched_id FROM part LEFT JOIN m ON lower(p_brand) = alias")
def _(s, d):
    return lookup.first_match(table(s, d, "part").select("p_partkey", "p_brand"), "p_brand", _vocabulary(s, d)).select("p_partkey", "matched_id")


@query("j06_first_match_cs", _ALIAS_SQL.format(f="") + "SELECT p_partkey, matched_id FROM part LEFT JOIN m ON p_name = alias")
def _(s, d):
    return lookup.first_match(table(s, d, "part").select("p_partkey", "p_name"), "p_name", _vocabulary(s, d), fold=False).select("p_partkey", "matched_id")


@query("j27_aligned_lookup", _ALIAS_SQL.format(f="lower") + ", t AS (SELECT p_partkey, unnest([p_brand, 'nothing', p_name]) AS term, unnest([0, 1, 2]) AS pos FROM part) SELECT p_partkey, list(matched_id ORDER BY t.pos) AS ids, list(term ORDER BY t.pos) AS terms FROM t JOIN m ON lower(term) = alias GROUP BY p_partkey")
def _(s, d):
    rows = table(s, d, "part").select("p_partkey", F.array("p_brand", F.lit("nothing"), "p_name").alias("t"))
    return lookup.matched_ids(rows, "p_partkey", "t", _vocabulary(s, d))


@query("j07_two_hop", f"WITH {edges_sql(['TARGETS', 'ASSOCIATED_WITH'])} SELECT DISTINCT t.src AS drug, a.dst AS condition FROM edges t JOIN edges a ON t.dst = a.src WHERE t.rel = 'TARGETS' AND a.rel = 'ASSOCIATED_WITH'")
def _(s, d):
    t = relation(s, d, "TARGETS").select(F.col("src").alias("drug"), F.col("dst").alias("p"))
    return lookup.two_hop(t, relation(s, d, "ASSOCIATED_WITH").select(F.col("src").alias("p"), F.col("dst").alias("condition")), "p")


@query("j08_left_default", f"WITH {edges_sql(['ASSOCIATED_WITH'])} SELECT CAST(s_suppkey AS VARCHAR) AS protein, COUNT(dst) AS conditions FROM supplier LEFT JOIN edges ON src = CAST(s_suppkey AS VARCHAR) GROUP BY 1")
def _(s, d):
    a = relation(s, d, "ASSOCIATED_WITH").groupBy(F.col("src").alias("protein")).agg(F.collect_list("dst").alias("x"))
    p = table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("protein"))
    return p.join(a, "protein", "left").select("protein", F.size(F.coalesce("x", F.array().cast("array<string>"))).cast("long").alias("conditions"))


@query("j09_external_minus_base", f"WITH {edges_sql(['INDICATED_FOR', 'TARGETS'])} SELECT src FROM edges WHERE rel = 'TARGETS' AND src NOT IN (SELECT src FROM edges WHERE rel = 'INDICATED_FOR') GROUP BY src")
def _(s, d):
    return relation(s, d, "TARGETS").join(relation(s, d, "INDICATED_FOR"), "src", "left_anti").select("src").distinct()


@query("j10_survivors", f"WITH {edges_sql(['INDICATED_FOR', 'TARGETS'])} SELECT src, dst FROM edges WHERE rel = 'TARGETS' AND src IN (SELECT src FROM edges WHERE rel = 'INDICATED_FOR')")
def _(s, d):
    return relation(s, d, "TARGETS").join(relation(s, d, "INDICATED_FOR"), "src", "left_semi").select("src", "dst")


_CODES_SQL = "codes AS (SELECT DISTINCT p_brand AS code FROM part UNION SELECT DISTINCT p_brand || p_type FROM part UNION SELECT DISTINCT p_brand || p_type || CAST(p_size AS VARCHAR) FROM part)"
_PARENT_SQL = _CODES_SQL + ", parents AS (SELECT c.code, arg_max(p.code, length(p.code)) AS parent FROM codes c LEFT JOIN codes p ON starts_with(c.code, p.code) AND length(p.code) < length(c.code) GROUP BY c.code)"


def _codes(s, d):
    p = table(s, d, "part")
    return p.select(F.col("p_brand").alias("code")).union(p.selectExpr("concat(p_brand, p_type)")).union(p.selectExpr("concat(p_brand, p_type, cast(p_size as string))")).distinct()


@query("j12_prefix_parent", f"WITH {_PARENT_SQL} SELECT code, parent FROM parents")
def _(s, d):
    return lookup.prefix_parents(_codes(s, d))


@query("g17_ancestors", f"WITH RECURSIVE {_PARENT_SQL}, up AS (SELECT code, parent AS ancestor, 1 AS depth FROM parents WHERE parent IS NOT NULL UNION ALL SELECT u.code, p.parent, u.depth + 1 FROM up u JOIN parents p ON u.ancestor = p.code WHERE p.parent IS NOT NULL) SELECT code, ancestor, depth FROM up")
def _(s, d):
    return lookup.ancestors(lookup.prefix_parents(_codes(s, d)))


@query("j11_tree_parent", "WITH n AS (SELECT p_partkey AS id, p_brand || '.' || p_type AS tree FROM part UNION ALL SELECT -n_nationkey - 1, 'Brand#' || CAST(n_nationkey AS VARCHAR) FROM nation) SELECT c.id, list_sort(list(DISTINCT p.id)) AS parents FROM n c JOIN n p ON regexp_replace(c.tree, '\\.[^.]+$', '') = p.tree AND c.tree <> p.tree GROUP BY c.id".replace("\\\\", "\\"))
def _(s, d):
    n = table(s, d, "part").selectExpr("p_partkey as id", "concat(p_brand, '.', p_type) as tree").union(table(s, d, "nation").selectExpr("cast(-n_nationkey - 1 as bigint)", "concat('Brand#', n_nationkey)"))
    return lookup.tree_parents(n)


@query("j14_isolated_nodes", f"WITH {edges_sql()} SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT dst FROM edges WHERE dst_kind = 'Condition')")
def _(s, d):
    used = edges(s, d, ["INDICATED_FOR", "ASSOCIATED_WITH"]).select(F.col("dst").alias("id")).distinct()
    return table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id")).join(used, "id", "left_anti")


@query("j15_first_kind", f"WITH {edges_sql()}, k AS (SELECT src AS id, src_kind AS kind FROM edges UNION SELECT dst, dst_kind FROM edges) SELECT id, min(kind) AS kind FROM k GROUP BY id")
def _(s, d):
    e = edges(s, d)
    k = e.select(F.col("src").alias("id"), F.col("src_kind").alias("kind")).union(e.select("dst", "dst_kind"))
    return k.groupBy("id").agg(F.min_by("kind", "kind").alias("kind"))


@query("j16_orphans", f"WITH {edges_sql(['TARGETS', 'HAS_FUNCTION'])} SELECT DISTINCT dst FROM edges WHERE rel = 'TARGETS' AND dst IN (SELECT src FROM edges WHERE rel = 'HAS_FUNCTION')")
def _(s, d):
    return relation(s, d, "TARGETS").select("dst").distinct().join(relation(s, d, "HAS_FUNCTION").select(F.col("src").alias("dst")), "dst", "left_semi")


@query("j23_cross_arrays", "SELECT DISTINCT a.l_partkey AS item, b.l_suppkey AS user_id FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
def _(s, d):
    side = lambda c, name: table(s, d, "lineitem").select("l_orderkey", F.col(c).alias(name)).distinct()
    return side("l_partkey", "item").join(side("l_suppkey", "user_id"), "l_orderkey").select("item", "user_id").distinct()


@query("j13_outer_features", f"WITH {edges_sql(['TARGETS', 'INDICATED_FOR'])}, t AS (SELECT src, COUNT(*) AS n FROM edges WHERE rel = 'TARGETS' GROUP BY 1), i AS (SELECT src, COUNT(*) AS n FROM edges WHERE rel = 'INDICATED_FOR' GROUP BY 1) SELECT COALESCE(t.src, i.src) AS id, COALESCE(t.n, 0) AS targets, COALESCE(i.n, 0) AS indications FROM t FULL JOIN i ON t.src = i.src")
def _(s, d):
    t = relation(s, d, "TARGETS").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("a"))
    i = relation(s, d, "INDICATED_FOR").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("b"))
    return t.join(i, "id", "full").select("id", F.coalesce("a", F.lit(0)).alias("targets"), F.coalesce("b", F.lit(0)).alias("indications"))


def names_sql(sentences: str) -> str:
    """CTEs ending in mention(doc_id, good, no, x), x with start, words, surface and id: the names of benchmark items in sentences
    (doc_id, good, no, sentence), greedily from the left, the longest first."""
    return (
        f"v AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\pL\\pN]+') AS t FROM benchmark), "
        "n AS (SELECT array_to_string(p, ' ') AS phrase, len(p)::int AS words, min(id) AS id FROM (SELECT id, unnest([t[1:3], t[1:2], t[4:4], t[5:7], t[6:9]]) AS p FROM v) WHERE len(p) > 0 GROUP BY 1, 2), "
        f"{sentences}, st AS (SELECT doc_id, good, no, regexp_extract_all(sentence, '[\\pL\\pN]+') AS t FROM sentence), "
        "m AS MATERIALIZED (SELECT doc_id, good, no, struct_pack(start := start, w := -words, words := words, surface := surface, id := n.id) AS x FROM (SELECT doc_id, good, no, i::int AS start, array_to_string(t[i + 1 : i + l], ' ') AS surface, l FROM (SELECT *, unnest(range(len(t))) AS i FROM st), (SELECT DISTINCT words AS l FROM n) WHERE i + l <= len(t)) JOIN n ON lower(surface) = phrase AND words = l), "
        "mention(doc_id, good, no, x) AS (SELECT doc_id, good, no, min(x) FROM m GROUP BY 1, 2, 3 UNION ALL SELECT m.doc_id, m.good, m.no, min(m.x) FROM mention p JOIN m ON p.doc_id = m.doc_id AND p.good = m.good AND p.no = m.no WHERE m.x.start >= p.x.start + p.x.words GROUP BY 1, 2, 3)"
    )


def benchmark_names(s, d):
    """(id, pos, name, synonyms): names of one to four words from the benchmark's items."""
    t = table(s, d, "benchmark").select("item_id", mentions.tokens(F.lower("text")).alias("t"))
    name = lambda a, n: F.array_join(F.slice("t", a, n), " ")
    return t.select(F.col("item_id").alias("id"), F.col("item_id").alias("pos"), name(1, 3).alias("name"), F.array(name(1, 2), name(4, 1), name(5, 3), name(6, 4)).alias("synonyms"))


@query("l13_dictionary_ner", f"WITH RECURSIVE {names_sql('sentence AS (SELECT doc_id, true AS good, 0 AS no, text AS sentence FROM documents)')} SELECT doc_id, x.start AS start, x.words AS words, x.surface AS surface, x.id AS item_id FROM mention")
def _(s, d):
    found = mentions.mentions(table(s, d, "documents").select("doc_id", F.col("text").alias("sentence")), benchmark_names(s, d))
    return found.withColumnRenamed("id", "item_id")


@query("g17_circle", "WITH RECURSIVE parents AS (SELECT 'C' || c_custkey AS code, 'N' || c_nationkey AS parent FROM customer UNION SELECT 'N' || n_nationkey, 'N' || (n_nationkey + 5) % 25 FROM nation UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation), up AS (SELECT code, parent AS ancestor, 1 AS depth FROM parents UNION SELECT u.code, p.parent, u.depth + 1 FROM up u JOIN parents p ON u.ancestor = p.code WHERE u.depth < 30) SELECT code, ancestor, min(depth)::int AS depth FROM up WHERE code <> ancestor GROUP BY 1, 2")
def _(s, d):
    c = table(s, d, "customer").selectExpr("concat('C', c_custkey) as code", "concat('N', c_nationkey) as parent")
    n = table(s, d, "nation").selectExpr("concat('N', n_nationkey)", "explode(array(concat('N', (n_nationkey + 5) % 25), concat('R', n_regionkey)))")
    return lookup.ancestors(c.union(n))


# ---------------------------------------------------------------- aggregates and profiles

_IND = f"WITH {edges_sql(['INDICATED_FOR'])} "


@query("a01_counts_sorted", _IND + "SELECT dst AS condition, COUNT(*) AS drugs FROM edges GROUP BY 1 ORDER BY 2 DESC")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").groupBy(F.col("dst").alias("condition")).agg(F.count("*").alias("drugs")).orderBy(F.desc("drugs"))


@query("a03_single_support", _IND + "SELECT src, COUNT(DISTINCT dst) AS n FROM edges GROUP BY 1 HAVING COUNT(DISTINCT dst) = 1")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").groupBy("src").agg(F.count_distinct("dst").alias("n")).where("n = 1")


@query("a04_edges_by_kind", f"WITH {edges_sql()} SELECT rel, COUNT(*) AS edges FROM edges GROUP BY 1")
def _(s, d):
    return edges(s, d).groupBy("rel").agg(F.count("*").alias("edges")).orderBy("rel")


@query("a05_metanodes", f"WITH {edges_sql()}, n AS (SELECT 'Condition' AS kind, CAST(c_custkey AS VARCHAR) AS id FROM customer UNION ALL SELECT 'Protein', CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'Drug', CAST(p_partkey AS VARCHAR) FROM part), u AS (SELECT src_kind AS kind, src AS id FROM edges UNION SELECT dst_kind, dst FROM edges) SELECT n.kind, COUNT(*) AS nodes, COUNT(*) - COUNT(u.id) AS unconnected FROM n LEFT JOIN u ON n.kind = u.kind AND n.id = u.id GROUP BY n.kind")
def _(s, d):
    n = None
    for kind, name, key in (("Condition", "customer", "c_custkey"), ("Protein", "supplier", "s_suppkey"), ("Drug", "part", "p_partkey")):
        one = table(s, d, name).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        n = one if n is None else n.unionByName(one)
    e = edges(s, d)
    used = e.select(F.col("src_kind").alias("kind"), F.col("src").alias("id")).union(e.select("dst_kind", "dst")).distinct().withColumn("u", F.lit(1))
    return n.join(used, ["kind", "id"], "left").groupBy("kind").agg(F.count("*").alias("nodes"), F.count_if(F.col("u").isNull()).alias("unconnected"))


@query("a06_metaedges", f"WITH {edges_sql()} SELECT rel, COUNT(*) AS edges, COUNT(DISTINCT src) AS sources, COUNT(DISTINCT dst) AS targets FROM edges GROUP BY 1")
def _(s, d):
    return edges(s, d).groupBy("rel").agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query("a07_degrees", f"WITH {edges_sql()} SELECT src_kind AS kind, src AS id, rel, 'out' AS direction, COUNT(*) AS degree FROM edges GROUP BY 1, 2, 3 UNION ALL SELECT dst_kind, dst, rel, 'in', COUNT(*) FROM edges GROUP BY 1, 2, 3")
def _(s, d):
    return graph.degrees(edges(s, d))


@query("k11_degree_histogram", f"WITH {edges_sql()} SELECT kind, rel, degree, COUNT(*) AS nodes FROM (SELECT src_kind AS kind, src, rel, COUNT(*) AS degree FROM edges GROUP BY 1, 2, 3) GROUP BY 1, 2, 3")
def _(s, d):
    return graph.degrees(edges(s, d)).where("direction = 'out'").groupBy("kind", "rel", "degree").agg(F.count("*").alias("nodes"))


_RATE_SQL = "r AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, user_id AS user, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS rating FROM events)"


def _ratings(s, d):
    kind = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return table(s, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("user_id").alias("user"), kind.alias("rating"))


@query("a14_rating_sums", f"WITH {_RATE_SQL} SELECT user, CAST(sum(rating) AS BIGINT) AS total FROM r GROUP BY user")
def _(s, d):
    return _ratings(s, d).groupBy("user").agg(F.sum("rating").alias("total"))


@query("a15_summary", f"WITH {_RATE_SQL} SELECT COUNT(DISTINCT item) AS items, COUNT(DISTINCT user) AS users, COUNT(*) FILTER (rating = 1) AS positive, COUNT(*) FILTER (rating = -1) AS negative, round(100.0 * COUNT(*) FILTER (rating <> 0) / (COUNT(DISTINCT item) * COUNT(DISTINCT user)), 6) AS density FROM r")
def _(s, d):
    n, m = F.count_distinct("item"), F.count_distinct("user")
    return _ratings(s, d).agg(n.alias("items"), m.alias("users"), F.count_if(F.col("rating") == 1).alias("positive"), F.count_if(F.col("rating") == -1).alias("negative"), r6(100.0 * F.count_if(F.col("rating") != 0) / (n * m)).alias("density"))


@query("a17_merge", f"WITH {_RATE_SQL} SELECT item, user, CASE WHEN min(rating) OVER w = -1 THEN -1 WHEN max(rating) OVER w = 1 THEN 1 ELSE 0 END AS rating FROM r WINDOW w AS (PARTITION BY item, user)")
def _(s, d):
    return links.merge_ratings(_ratings(s, d))


@query("a23_score_profile", "SELECT round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(median(value), 6) AS mid, round(max(value), 6) AS high, round(stddev_pop(value), 6) AS spread FROM events")
def _(s, d):
    return table(s, d, "events").agg(r6(F.min("value")).alias("low"), r6(F.avg("value")).alias("mean"), r6(F.median("value")).alias("mid"), r6(F.max("value")).alias("high"), r6(F.stddev_pop("value")).alias("spread"))


@query("a26_few_conditions", _IND + "SELECT round(avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END), 6) AS one, round(avg(CASE WHEN n <= 2 THEN 1.0 ELSE 0.0 END), 6) AS two FROM (SELECT src, COUNT(*) AS n FROM edges GROUP BY 1)")
def _(s, d):
    g = relation(s, d, "INDICATED_FOR").groupBy("src").agg(F.count("*").alias("n"))
    return g.agg(r6(F.avg((F.col("n") <= 1).cast("double"))).alias("one"), r6(F.avg((F.col("n") <= 2).cast("double"))).alias("two"))


@query("a27_distinct_ends", _IND + "SELECT COUNT(DISTINCT src) AS drugs, COUNT(DISTINCT dst) AS conditions FROM edges")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").agg(F.count_distinct("src").alias("drugs"), F.count_distinct("dst").alias("conditions"))


# ---------------------------------------------------------------- matrices, sets, links

#: The fixture's rating items; a matrix names its columns in the plan, so they are the side of fixed size.
_KEYS = [str(k) for k in range(100)]


@query("m01_unpivot", f"WITH {_RATE_SQL}, m AS (SELECT item, user, CAST(trunc(avg(rating)) AS INT) AS rating FROM r GROUP BY 1, 2) SELECT user AS item, CAST(item AS VARCHAR) AS user, rating FROM m WHERE rating <> 0")
def _(s, d):
    turned = _ratings(s, d).select(F.col("user").alias("item"), F.col("item").alias("user"), "rating")
    return links.from_matrix(links.to_matrix(turned, _KEYS))


@query("m02_pivot", f"WITH {_RATE_SQL} SELECT user AS item, " + ", ".join(f"CAST(trunc(COALESCE(avg(rating) FILTER (item = {k}), 0)) AS INT) AS k{k}" for k in _KEYS) + " FROM r GROUP BY user")
def _(s, d):
    m = links.to_matrix(_ratings(s, d).select(F.col("user").alias("item"), F.col("item").alias("user"), "rating"), _KEYS)
    return m.select("item", *(F.col(f"`{k}`").alias(f"k{k}") for k in _KEYS))


@query("m06_subset", f"WITH {_RATE_SQL} SELECT item, user, rating FROM r WHERE item % 2 = 0")
def _(s, d):
    r = _ratings(s, d)
    return links.subset(r, r.where("item % 2 = 0"))


@query("m07_index", _IND + "SELECT src AS id, row_number() OVER (ORDER BY src) - 1 AS idx FROM (SELECT DISTINCT src FROM edges)")
def _(s, d):
    return links.dense_index(relation(s, d, "INDICATED_FOR").select(F.col("src").alias("id")).distinct(), "id")


@query("m08_positives", f"WITH {_RATE_SQL} SELECT DISTINCT item, user FROM r WHERE rating = 1")
def _(s, d):
    return _ratings(s, d).where("rating = 1").select("item", "user").distinct()


_ALLOWED = ["TARGETS", "HAS_THERAPEUTIC_GROUP", "HAS_PHARMACOLOGICAL_GROUP"]


@query("j17_jaccard_drugs", f"WITH {edges_sql(_ALLOWED)}, f AS (SELECT src AS id, rel || dst AS feature FROM edges), n AS (SELECT id, COUNT(*) AS n FROM f GROUP BY 1), c AS (SELECT x.id AS a, y.id AS b, COUNT(*) AS c FROM f x JOIN f y ON x.feature = y.feature AND x.id <= y.id GROUP BY 1, 2) SELECT a, b, round(c.c / (p.n + q.n - c.c), 6) AS similarity FROM c JOIN n p ON a = p.id JOIN n q ON b = q.id")
def _(s, d):
    f = edges(s, d, _ALLOWED).select(F.col("src").alias("id"), F.concat("rel", "dst").alias("feature"))
    return links.jaccard(f).withColumn("similarity", r6("similarity"))


@query("j17_jaccard_conditions", f"WITH {edges_sql(['ASSOCIATED_WITH'])}, n AS (SELECT dst AS id, COUNT(*) AS n FROM edges GROUP BY 1), c AS (SELECT x.dst AS a, y.dst AS b, COUNT(*) AS c FROM edges x JOIN edges y ON x.src = y.src AND x.dst <= y.dst GROUP BY 1, 2) SELECT a, b, round(c.c / (p.n + q.n - c.c), 6) AS similarity FROM c JOIN n p ON a = p.id JOIN n q ON b = q.id")
def _(s, d):
    f = relation(s, d, "ASSOCIATED_WITH").select(F.col("dst").alias("id"), F.col("src").alias("feature"))
    return links.jaccard(f).withColumn("similarity", r6("similarity"))


@query("u02_difference", f"WITH {edges_sql(['INDICATED_FOR', 'ASSOCIATED_WITH'])} SELECT dst FROM edges WHERE rel = 'INDICATED_FOR' EXCEPT SELECT dst FROM edges WHERE rel = 'ASSOCIATED_WITH'")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").select("dst").subtract(relation(s, d, "ASSOCIATED_WITH").select("dst"))


@query("u03_union", f"WITH {edges_sql(['INDICATED_FOR', 'ASSOCIATED_WITH'])} SELECT DISTINCT dst FROM edges")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").select("dst").union(relation(s, d, "ASSOCIATED_WITH").select("dst")).distinct()


@query("u04_intersection", f"WITH {edges_sql(['INDICATED_FOR', 'ASSOCIATED_WITH'])} SELECT dst FROM edges WHERE rel = 'INDICATED_FOR' INTERSECT SELECT dst FROM edges WHERE rel = 'ASSOCIATED_WITH'")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").select("dst").intersect(relation(s, d, "ASSOCIATED_WITH").select("dst"))


_PAIRS = edges_sql(["INDICATED_FOR", "TARGETS", "ASSOCIATED_WITH"]) + ", base AS (SELECT src AS item, dst AS user FROM edges WHERE rel = 'INDICATED_FOR'), more AS (SELECT t.src AS item, a.dst AS user FROM edges t JOIN edges a ON t.dst = a.src WHERE t.rel = 'TARGETS' AND a.rel = 'ASSOCIATED_WITH' GROUP BY 1, 2 HAVING COUNT(*) >= 2)"


def _base(s, d):
    return relation(s, d, "INDICATED_FOR").select(F.col("src").alias("item"), F.col("dst").alias("user"))


def _more(s, d):
    return graph.dwpc(edges(s, d, ["TARGETS", "ASSOCIATED_WITH"]), "Dt>PRa>CO").where("path_count >= 2").select(F.col("source_id").alias("item"), F.col("target_id").alias("user"))


@query("u06_augmented", f"WITH {_PAIRS} SELECT item, user, 'base' AS origin FROM base UNION ALL SELECT item, user, 'augmented' FROM (SELECT * FROM more EXCEPT SELECT * FROM base)")
def _(s, d):
    return links.augmented(_base(s, d), _more(s, d))


@query("u07_leave_one_metapath_out", f"WITH {_PAIRS}, s AS (SELECT item, user, 'one' AS m FROM more UNION ALL SELECT src, dst, 'two' FROM edges WHERE rel = 'INDICATED_FOR' AND CAST(src AS BIGINT) % 3 = 0), o AS (SELECT item, user FROM s GROUP BY 1, 2 HAVING COUNT(DISTINCT m) = 1 AND min(m) = 'one') SELECT item, user FROM base UNION SELECT item, user FROM s WHERE (item, user) NOT IN (SELECT (item, user) FROM o) OR (item, user) IN (SELECT (item, user) FROM base)")
def _(s, d):
    two = _base(s, d).where("cast(item as bigint) % 3 = 0").withColumn("metapath", F.lit("two"))
    return links.leave_one_out(_base(s, d), _more(s, d).withColumn("metapath", F.lit("one")).unionByName(two), "one")


_SPLIT = f"WITH {edges_sql(['INDICATED_FOR'])}, p AS (SELECT src AS item, dst AS user, md5('7|' || src || '|' || dst) AS k FROM edges), f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY k, item, user) AS ri, row_number() OVER (PARTITION BY user ORDER BY k, item, user) AS ru, COUNT(*) OVER (PARTITION BY user) AS n FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY k, item) AS q FROM f WHERE ri > 1 AND ru > 1), test AS (SELECT item, user FROM q WHERE q <= greatest(1, round_even(n * 0.2, 0)) ORDER BY k, item, user LIMIT (SELECT CAST(floor(COUNT(*) * 0.2) AS BIGINT) FROM p))"


def _test(s, d):
    return links.test_split(_base(s, d), 0.2, 7)


@query("r01_test_split", _SPLIT + " SELECT item, user FROM test")
def _(s, d):
    return _test(s, d)


def draw_sql(name: str, want: str, items: str, taken: str, seed, by: tuple[str, ...] = (), shared: tuple[str, ...] = ()) -> str:
    """CTEs ending in name(by.., item, user): what links.draw gives; shared are the columns of by that taken has."""
    b = "".join(f"{c}, " for c in by)
    m = "".join(f"{c}, " for c in shared)
    digest = "md5(concat_ws('|', '" + str(seed) + "', " + "".join(f"CAST({c} AS VARCHAR), " for c in by) + "user, CAST(j AS VARCHAR)))"
    same = " AND ".join(f"d.{c} = h.{c}" for c in (*shared, "user")) + " AND i.item = h.item"
    return (
        f"{name}_i AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM {items})), "
        f"{name}_t AS (SELECT DISTINCT {m}item, user FROM {taken}), {name}_h AS (SELECT {m}user, COUNT(*) AS held FROM {name}_t GROUP BY ALL), "
        f"{name}_k AS (SELECT w.*, total, total <= 4 * (need + COALESCE(held, 0)) AS every FROM {want} w LEFT JOIN {name}_h h ON " + " AND ".join(f"w.{c} = h.{c}" for c in (*shared, "user"))
        + f" CROSS JOIN (SELECT COUNT(*) AS total FROM {name}_i) WHERE need > 0), "
        f"{name}_e AS (SELECT {b}user, need, total, every, unnest(range(CAST(CASE WHEN every THEN total ELSE 4 * need + 64 END AS BIGINT))) AS j FROM {name}_k), "
        f"{name}_m AS (SELECT *, {digest} AS g FROM {name}_e), "
        f"{name}_d AS (SELECT {b}user, need, CASE WHEN every THEN j ELSE CAST(('0x' || substr(g, 1, 12)) AS BIGINT) % total END AS idx, min(CASE WHEN every THEN g ELSE lpad(CAST(j AS VARCHAR), 20, '0') END) AS o FROM {name}_m GROUP BY ALL), "
        f"{name} AS (SELECT {b}item, user FROM (SELECT {''.join(f'd.{c}, ' for c in by)}i.item, d.user, need, row_number() OVER (PARTITION BY {''.join(f'd.{c}, ' for c in by)}d.user ORDER BY o) AS r FROM {name}_d d JOIN {name}_i i USING (idx) LEFT JOIN {name}_t h ON {same} WHERE h.item IS NULL) WHERE r <= need)"
    )


def _items(s, d):
    return relation(s, d, "TARGETS").select(F.col("src").alias("item")).distinct()


_WITH_ITEMS = _SPLIT.replace(edges_sql(["INDICATED_FOR"]), edges_sql(["INDICATED_FOR", "TARGETS"])).replace("FROM edges)", "FROM edges WHERE rel = 'INDICATED_FOR')")
_ITEMS_SQL = "items AS (SELECT DISTINCT src AS item FROM edges WHERE rel = 'TARGETS')"


@query("r02_train_negatives", f"{_WITH_ITEMS}, {_ITEMS_SQL}, w AS (SELECT user, COUNT(*) * 5 AS need FROM p WHERE (item, user) NOT IN (SELECT (item, user) FROM test) GROUP BY 1), {draw_sql('drawn', 'w', 'items', 'p', 9)} SELECT item, user FROM drawn")
def _(s, d):
    return links.train_negatives(_base(s, d), _test(s, d), _items(s, d), 5, 9)


@query("r03_random_control", f"WITH {_PAIRS}, aug AS (SELECT * FROM base UNION SELECT * FROM more), {_ITEMS_SQL}, w AS (SELECT t.user, t.n - COALESCE(b.n, 0) AS need FROM (SELECT user, COUNT(*) AS n FROM aug GROUP BY 1) t LEFT JOIN (SELECT user, COUNT(*) AS n FROM base GROUP BY 1) b ON t.user = b.user), {draw_sql('drawn', 'w', 'items', 'base', 3)} SELECT item, user FROM base UNION ALL SELECT item, user FROM drawn")
def _(s, d):
    return links.random_control(_base(s, d), links.augmented(_base(s, d), _more(s, d)), _items(s, d), 3)


# ---------------------------------------------------------------- metapaths

def path_sql(metapath: str, damping: float = 0.5) -> str:
    """CTEs ending in paths(n0, .., weight): the plain join of all hops, as a check of the factorised plan."""
    hops = graph.parse_metapath(metapath)
    parts, kinds, where = [], [hops[0][2]], []
    for k, (rel, forward, _, kind) in enumerate(hops):
        a, b = ("src", "dst") if forward else ("dst", "src")
        weight = f"pow(COUNT(*) OVER (PARTITION BY src), -{damping}) * pow(COUNT(*) OVER (PARTITION BY dst), -{damping})" if damping else "1.0"
        parts.append(f"h{k} AS (SELECT {a} AS a, {b} AS b, {weight} AS w FROM edges WHERE rel = '{rel}')")
        where += [f"{_node(j)} <> h{k}.b" for j, other in enumerate(kinds) if other == kind]
        kinds.append(kind)
    joins = "h0" + "".join(f" JOIN h{k} ON h{k - 1}.b = h{k}.a" for k in range(1, len(hops)))
    nodes = ", ".join(f"{_node(k)} AS n{k}" for k in range(len(hops) + 1))
    cond = " WHERE " + " AND ".join(where) if where else ""
    return edges_sql(sorted({h[0] for h in hops})) + ", " + ", ".join(parts) + f", paths AS (SELECT {nodes}, {' * '.join(f'h{k}.w' for k in range(len(hops)))} AS weight FROM {joins}{cond})"


def _node(k: int) -> str:
    return "h0.a" if k == 0 else f"h{k - 1}.b"


def _dwpc_sql(metapath: str) -> str:
    n = len(graph.parse_metapath(metapath))
    return f"WITH {path_sql(metapath)} SELECT n0 AS source_id, n{n} AS target_id, COUNT(*) AS path_count, round(sum(weight) * {LIFT}, 6) AS dwpc FROM paths GROUP BY 1, 2"


def _dwpc(metapath, method, s, d):
    rels = sorted({h[0] for h in graph.parse_metapath(metapath)})
    return graph.dwpc(edges(s, d, rels), metapath, method=method).withColumn("dwpc", r6w("dwpc"))


for _name, _metapath in (
    ("target_association", "Dt>PRa>CO"), ("indication", "Di>CO"), ("shared_target", "Dt>PR<tDi>CO"), ("shared_therapeutic", "Dh>T<hDi>CO"), ("shared_pharmacological", "Dh>PH<hDi>CO"),
    ("shared_chemical", "Dh>CH<hDi>CO"), ("shared_category", "Dh>CA<hDi>CO"), ("shared_condition", "Di>CO<aPRa>CO"), ("process", "Dt>PRh>B<hPRa>CO"), ("component", "Dt>PRh>CE<hPRa>CO"), ("function", "Dt>PRh>M<hPRa>CO"),
):
    query(f"g08_dwpc_{_name}", _dwpc_sql(_metapath))(partial(_dwpc, _metapath, "factorised"))
for _name, _metapath in (("target_association", "Dt>PRa>CO"), ("shared_target", "Dt>PR<tDi>CO"), ("function", "Dt>PRh>M<hPRa>CO")):
    query(f"g09_direct_{_name}", _dwpc_sql(_metapath))(partial(_dwpc, _metapath, "direct"))


@query("t01_scaled", f"WITH {path_sql('Dt>PRa>CO')}, g AS (SELECT n0 AS source_id, n2 AS target_id, sum(weight) AS dwpc FROM paths GROUP BY 1, 2) SELECT source_id, target_id, round(asinh(dwpc / (SELECT avg(dwpc) FROM g)), 6) AS dwpc FROM g")
def _(s, d):
    g = graph.dwpc(edges(s, d, ["TARGETS", "ASSOCIATED_WITH"]), "Dt>PRa>CO")
    return graph.scaled(g).select("source_id", "target_id", r6("dwpc").alias("dwpc"))


_EXPLAIN = f"WITH {path_sql('Dt>PRa>CO')}, g AS (SELECT n0, n2, sum(weight) AS dwpc, COUNT(*) AS n FROM paths GROUP BY 1, 2), h AS (SELECT * FROM g WHERE n >= 2)"


@query("g13_paths", _EXPLAIN + " SELECT p.n0 AS source_id, p.n2 AS target_id, row_number() OVER (PARTITION BY p.n0, p.n2 ORDER BY p.n0 || '->' || p.n1 || '->' || p.n2) AS path_index, p.n0 || '->' || p.n1 || '->' || p.n2 AS path, round(100 * weight / dwpc, 6) AS percent_dwpc, round(-log10(0.01 / h.n) * 100 * weight / dwpc, 6) AS path_score FROM paths p JOIN h ON p.n0 = h.n0 AND p.n2 = h.n2")
def _(s, d):
    e = edges(s, d, ["TARGETS", "ASSOCIATED_WITH"])
    pairs = graph.dwpc(e, "Dt>PRa>CO").where("path_count >= 2").withColumn("adjusted_p_value", 0.01 / F.col("path_count"))
    out = stats.explain(graph.paths(e, "Dt>PRa>CO"), pairs)
    return out.select("source_id", "target_id", "path_index", "path", r6("percent_dwpc").alias("percent_dwpc"), r6("path_score").alias("path_score"))


@query("t06_bonferroni", "SELECT event_id, round(least(1.0, value / 1000 * 6), 6) AS p FROM events")
def _(s, d):
    return table(s, d, "events").select("event_id", r6(stats.bonferroni(F.col("value") / 1000, 6)).alias("p"))


for _percent in (20, 40, 60, 80):
    query(f"g15_prune_{_percent}", f"WITH {edges_sql()}, r AS (SELECT *, row_number() OVER (PARTITION BY rel ORDER BY md5('42|' || rel || '|' || src || '|' || dst)) AS r, COUNT(*) OVER (PARTITION BY rel) AS n FROM edges) SELECT rel, src, dst FROM r WHERE rel = 'INDICATED_FOR' OR r > floor(n * {_percent} / 100)")(
        partial(lambda p, s, d: graph.prune(edges(s, d), p).select("rel", "src", "dst"), _percent)
    )

_core = ["e0 AS (SELECT src, dst FROM edges)"] + [
    f"e{k + 1} AS (SELECT src, dst FROM (SELECT src, dst FROM e{k} WHERE src IN (SELECT src FROM e{k} GROUP BY 1 HAVING COUNT(*) >= 2)) WHERE dst IN (SELECT dst FROM e{k} WHERE src IN (SELECT src FROM e{k} GROUP BY 1 HAVING COUNT(*) >= 2) GROUP BY 1 HAVING COUNT(*) >= 2))".replace("AS (SELECT", "AS MATERIALIZED (SELECT", 1)
    for k in range(10)
]


@query("g16_two_core", _IND.rstrip() + ", " + ", ".join(_core) + " SELECT src, dst FROM e10")
def _(s, d):
    return graph.two_core(relation(s, d, "INDICATED_FOR"))


# ---------------------------------------------------------------- ranking and metrics

_SCORES = f"WITH {edges_sql(['INDICATED_FOR', 'ASSOCIATED_WITH'])}, sc AS (SELECT dst AS user, src AS item, CASE WHEN rel = 'INDICATED_FOR' THEN 1 ELSE 0 END AS truth, CAST(('0x' || substr(md5(rel || '|' || src || '|' || dst), 1, 2)) AS INT) / 256.0 AS score FROM edges)"


def _score_rows(s, d):
    e = edges(s, d, ["INDICATED_FOR", "ASSOCIATED_WITH"])
    score = F.conv(F.substring(F.md5(F.concat_ws("|", "rel", "src", "dst")), 1, 2), 16, 10).cast("double") / 256.0
    return e.select(F.col("dst").alias("user"), F.col("src").alias("item"), F.when(F.col("rel") == "INDICATED_FOR", 1).otherwise(0).alias("truth"), score.alias("score"))


@query("w04_top_k", _SCORES + " SELECT user, item, truth, round(score, 6) AS score FROM sc ORDER BY sc.score DESC, user, item, truth LIMIT 100")
def _(s, d):
    return _score_rows(s, d).orderBy(F.desc("score"), "user", "item", "truth").limit(100).withColumn("score", r6("score"))


@query("w05_top_n_user", _SCORES + " SELECT user, item, r AS rank FROM (SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS r FROM (SELECT user, item, max(score) AS score FROM sc GROUP BY 1, 2)) WHERE r <= 3")
def _(s, d):
    best = _score_rows(s, d).groupBy("user", "item").agg(F.max("score").alias("score"))
    return links.top_n(best, 3).select("user", "item", "rank")


@query("w06_exclude_liked", _SCORES + " SELECT user, item, r AS rank FROM (SELECT user, item, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS r FROM (SELECT user, item, max(score) AS score FROM sc GROUP BY 1, 2) WHERE (user, item) NOT IN (SELECT (user, item) FROM sc WHERE truth = 1)) WHERE r <= 3")
def _(s, d):
    rows = _score_rows(s, d)
    best = rows.groupBy("user", "item").agg(F.max("score").alias("score"))
    return links.top_n(best, 3, rows.where("truth = 1").select("item", "user")).select("user", "item", "rank")


@query("l03_classify", _SCORES + " SELECT user, item, truth, CASE WHEN score <= 0.5 THEN -1 ELSE 1 END AS prediction FROM sc")
def _(s, d):
    return metrics.classify(_score_rows(s, d)).select("user", "item", "truth", "prediction")


_RANKED = _SCORES + ", n AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rank, COUNT(*) OVER (PARTITION BY user) AS n, sum(truth) OVER (PARTITION BY user) AS pos FROM sc), r AS (SELECT * FROM n WHERE pos > 0 AND pos < n)"
_METRIC_SQL = {
    "e01_hit_rate": ("hit_rate_k", "CASE WHEN max(n) >= 10 THEN max(CASE WHEN rank <= 10 THEN truth ELSE 0 END) * 1.0 END"),
    "e02_mean_rank": ("mean_rank", "min(CASE WHEN truth = 1 THEN rank END) * 1.0"),
    "e03_mrr": ("mrr", "1.0 / min(CASE WHEN truth = 1 THEN rank END)"),
    "e04_r_precision": ("r_precision", "sum(truth) * 1.0 / max(CASE WHEN truth = 1 THEN rank END)"),
    "e05_precision_k": ("precision_k", "CASE WHEN max(n) >= 10 THEN sum(CASE WHEN rank <= 10 THEN truth ELSE 0 END) / 10.0 END"),
    "e06_recall_k": ("recall_k", "CASE WHEN max(n) >= 10 THEN sum(CASE WHEN rank <= 10 THEN truth ELSE 0 END) * 1.0 / max(pos) END"),
    "e07_f1_k": ("f1_k", "CASE WHEN max(n) >= 10 THEN 2.0 * sum(CASE WHEN rank <= 10 THEN truth ELSE 0 END) / (10 + max(pos)) END"),
    "e09_dcg": ("dcg_k", "sum(CASE WHEN rank <= 10 AND truth = 1 THEN CASE WHEN rank = 1 THEN 1.0 ELSE 1.0 / log2(rank) END ELSE 0 END)"),
    "e10_ndcg": ("ndcg_k", "sum(CASE WHEN rank <= 10 AND truth = 1 THEN CASE WHEN rank = 1 THEN 1.0 ELSE 1.0 / log2(rank) END ELSE 0 END) / list_sum(list_transform(range(1, CAST(least(10, max(pos)) + 1 AS BIGINT)), lambda i: CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / log2(i) END))"),
}


def _metric(column, s, d):
    return metrics.per_user(_score_rows(s, d)).select("user", r6(column).alias(column))


for _key, (_column, _expr) in _METRIC_SQL.items():
    query(_key, _RANKED + f" SELECT user, round({_expr}, 6) AS {_column} FROM r GROUP BY user")(partial(_metric, _column))
query("e08_average_precision", _RANKED + ", h AS (SELECT *, sum(truth) OVER (PARTITION BY user ORDER BY rank) AS hits FROM r) SELECT user, round(avg(hits / rank) FILTER (truth = 1), 6) AS map FROM h GROUP BY user")(partial(_metric, "map"))
query("e11_err", _RANKED + ", h AS (SELECT *, sum(truth) OVER (PARTITION BY user ORDER BY rank) AS hits FROM r) SELECT user, round(COALESCE(sum(pow(0.75, hits - 1) * 0.25 / rank) FILTER (truth = 1 AND rank <= 10), 0), 6) AS err FROM h GROUP BY user")(partial(_metric, "err"))
query("e12_auc", _RANKED + " SELECT a.user, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc FROM r a JOIN r b ON a.user = b.user AND a.truth = 1 AND b.truth = 0 GROUP BY 1")(partial(_metric, "auc"))


@query("t08_kendall", _SCORES + ", p AS (SELECT a.user, sign(a.truth - b.truth) * sign(a.score - b.score) AS c, abs(sign(a.truth - b.truth)) AS x, abs(sign(a.score - b.score)) AS y FROM sc a JOIN sc b ON a.user = b.user AND (a.item, a.truth) < (b.item, b.truth)), t AS (SELECT user, sum(c) AS c, sum(x) AS x, sum(y) AS y FROM p GROUP BY 1) SELECT u.user, round(COALESCE(CASE WHEN x > 0 AND y > 0 THEN c / sqrt(x * y) END, 0), 6) AS tau FROM (SELECT DISTINCT user FROM sc) u LEFT JOIN t ON u.user = t.user")
def _(s, d):
    return metrics.kendall(_score_rows(s, d)).withColumn("tau", F.round("tau", 6))


@query("t09_spearman", _SCORES + ", k AS (SELECT user, rank() OVER (PARTITION BY user ORDER BY truth) + (COUNT(*) OVER (PARTITION BY user, truth) - 1) / 2.0 AS a, rank() OVER (PARTITION BY user ORDER BY score) + (COUNT(*) OVER (PARTITION BY user, score) - 1) / 2.0 AS b FROM sc) SELECT user, round(COALESCE(CASE WHEN isfinite(c) THEN c END, 0), 6) + 0.0 AS rho FROM (SELECT user, CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS c FROM k GROUP BY 1)")
def _(s, d):
    return metrics.spearman(_score_rows(s, d)).withColumn("rho", r6("rho"))


@query("w11_roc_points", _SCORES + ", g AS (SELECT user, score, sum(truth) AS t, sum(1 - truth) AS f FROM sc GROUP BY 1, 2), c AS (SELECT user, score, sum(t) OVER o AS ct, sum(f) OVER o AS cf, sum(t) OVER (PARTITION BY user) AS pt, sum(f) OVER (PARTITION BY user) AS pf FROM g WINDOW o AS (PARTITION BY user ORDER BY score DESC)) SELECT user, round(score, 6) AS score, round(cf / pf, 6) AS fpr, round(ct / pt, 6) AS tpr FROM c WHERE pt > 0 AND pf > 0")
def _(s, d):
    return metrics.roc_points(_score_rows(s, d)).withColumns({"score": r6("score"), "fpr": r6("fpr"), "tpr": r6("tpr")})


@query("w07_neighbours", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS item, e.vec_id AS other, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS c FROM q JOIN e ON q.vec_id <> e.vec_id) SELECT item, other, r AS rank, round(c, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY round(c, 9) DESC, other) AS r FROM p) WHERE r <= 5")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    found = links.nearest(e, e.where("vec_id % 20 = 0"), 5)
    return found.withColumn("cosine", r6("cosine"))


@query("w08_top_variance", "WITH x AS (SELECT i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)) SELECT i - 1 AS pos, round(var_pop(v), 6) AS variance FROM x GROUP BY 1 ORDER BY var_pop(v) DESC LIMIT 8")
def _(s, d):
    x = table(s, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "v"))
    v = x.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.var_pop("v").alias("variance")).orderBy(F.desc("variance")).limit(8)
    return v.withColumn("variance", r6("variance"))


_PATHS = {"repeated_ends": "Di>CO<iDi>CO", "far_conditions": "Di>CO<aPRa>CO", "three_conditions": "Dt>PRa>CO<aPRa>CO", "far_drugs": "Dt>PR<tDt>PRa>CO"}


def _general(metapath, s, d):
    found = graph.reach(edges(s, d, sorted({h[0] for h in graph.parse_metapath(metapath)})), metapath)
    return found.select("source_id", "pairs", F.col("path_count").alias("paths"), r6(F.col("dwpc") * float(LIFT)).alias("dwpc"))


for _name, _metapath in _PATHS.items():
    _n = len(graph.parse_metapath(_metapath))
    query(f"g09_{_name}", f"WITH {path_sql(_metapath)} SELECT n0 AS source_id, COUNT(DISTINCT n{_n}) AS pairs, COUNT(*) AS paths, round(sum(weight) * {LIFT}, 6) AS dwpc FROM paths GROUP BY 1")(partial(_general, _metapath))
