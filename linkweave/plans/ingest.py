"""Queries of the ingestion layer. The records are XML, CSV or JSON texts made from the driver tables and parsed again by the same
expressions as files; the SQL says what they hold from the columns alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkweave.functions import text as tx
from linkweave.operators import graph, lookup, mentions
from linkweave.operators.graph import METAGRAPH
from linkweave.sources import records, store
from linkweave.tables import shared_dir, spread, written

from .catalogue import benchmark_names, names_sql
from .fixtures import NODES, edges, edges_sql, nodes, nodes_sql, relation, table
from .registry import query, r6


def _xml(name: str, *parts, attributes: str = ""):
    return F.concat(F.lit(f"<{name}{attributes}>"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit(f"</{name}>"))


def _drugs(s, d):
    """Drug elements: every part; the third part has no primary id, odd ones have salts, those of size over 40 targets."""
    p = spread(table(s, d, "part"))
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    ident = F.when(F.col("p_partkey") == 3, F.lit("<drugbank-id>none</drugbank-id>")).otherwise(F.concat(_xml("drugbank-id", "old", attributes=' primary="false"'), F.lit('<drugbank-id primary="true"> D'), key, F.lit("</drugbank-id>")))
    salts = F.when(F.col("p_partkey") % 2 == 1, _xml("salts", _xml("salt", _xml("name", F.col("p_name"))))).otherwise("<salts/>")
    targets = F.when(F.col("p_size") > 40, _xml("targets", _xml("target", _xml("name", F.col("p_type")), _xml("actions", _xml("action", "inhibitor"), _xml("action", size)), _xml("known-action", "yes")), _xml("target", _xml("name", "second"), "<actions/>"))).otherwise("<targets/>")
    text = _xml(
        "drug", ident, _xml("name", " ", F.col("p_name"), " "), "<description/>", _xml("indication", F.col("p_type")), _xml("toxicity", "none"),
        _xml("groups", _xml("group", "approved"), _xml("group", F.col("p_type"))), salts, _xml("synonyms", _xml("synonym", F.col("p_name")), _xml("synonym", F.col("p_brand")), _xml("synonym", F.col("p_name"))),
        _xml("products", _xml("product", _xml("name", F.col("p_brand")))),
        _xml("atc-codes", F.concat(F.lit('<atc-code code="'), F.col("p_brand"), F.lit('"><level code="'), F.col("p_type"), F.lit('">x</level><level code="'), F.col("p_brand"), F.lit('">y</level></atc-code>'))),
        _xml("categories", _xml("category", _xml("category", F.col("p_type")), _xml("mesh-id", size)), _xml("category", _xml("category", "no id"), "<mesh-id/>")),
        _xml("drug-interactions", _xml("drug-interaction", _xml("drugbank-id", "D", size), _xml("description", " with ", F.col("p_brand")))), targets,
    )
    return p.select(F.from_xml(text, records.DRUG).alias("x"))


_DRUG = "FROM part WHERE p_partkey <> 3"


@query("s02_drugs", f"SELECT 'D' || p_partkey AS id, trim(p_name) AS name, '' AS description, p_type AS indication, 'none' AS toxicity, '' AS half_life, ['approved', p_type] AS groups, CASE WHEN p_partkey % 2 = 1 THEN [p_name] ELSE [] END AS salts, CASE WHEN p_name = p_brand THEN [p_name] ELSE [p_name, p_brand] END AS synonyms, [p_brand] AS products, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS atc_codes, p_type AS category, CAST(p_size AS VARCHAR) AS mesh_id {_DRUG}")
def _(s, d):
    rows = records.drugs(_drugs(s, d))
    one = F.get("categories", F.lit(0))
    return rows.where("size(categories) = 1").select("id", "name", "description", "indication", "toxicity", "half_life", "groups", "salts", "synonyms", "products", "atc_codes", one["category"].alias("category"), one["mesh_id"].alias("mesh_id"))


@query("s03_interactions", f"SELECT 'D' || p_partkey AS id, 'D' || p_size AS drugbank_id, 'with ' || p_brand AS description {_DRUG}")
def _(s, d):
    return records.interactions(_drugs(s, d))


@query("s04_targets", f"SELECT 'D' || p_partkey AS id, t.name, t.actions, t.known_action FROM part, (SELECT unnest([1, 2]) AS k) u, LATERAL (SELECT CASE k WHEN 1 THEN p_type ELSE 'second' END AS name, CASE k WHEN 1 THEN ['inhibitor', CAST(p_size AS VARCHAR)] ELSE [] END AS actions, CASE k WHEN 1 THEN 'yes' ELSE 'unknown' END AS known_action) t WHERE p_partkey <> 3 AND p_size > 40")
def _(s, d):
    return records.targets(_drugs(s, d)).select("id", F.explode("targets").alias("t")).select("id", "t.*")


def _proteins(s, d):
    n = spread(table(s, d, "supplier")).join(table(s, d, "nation"), F.expr("s_nationkey = n_nationkey"))
    go = lambda kind, text: _xml("go-classifier", _xml("category", kind), _xml("description", text))
    text = F.concat(
        F.lit('<polypeptide id="'), F.when(F.col("s_suppkey") == 1, "").otherwise(F.col("s_suppkey").cast("string")), F.lit('">'), _xml("name", F.col("s_name")), F.lit("<general-function/>"),
        _xml("specific-function", F.col("n_name")), _xml("organism", "man"),
        _xml("go-classifiers", go("function", F.lit("binding")), go("process", F.col("n_name")), go("component", F.lit("")), F.when(F.col("s_suppkey") % 2 == 0, go("function", F.col("n_name"))).otherwise("")), F.lit("</polypeptide>"),
    )
    return records.proteins(n.select(F.from_xml(text, records.POLYPEPTIDE).alias("x")))


@query("s05_proteins", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, '' AS general_function, 'man' AS organism, n_name AS specific_function, CAST([] AS VARCHAR[]) AS components, ['binding', n_name] AS functions, [n_name] AS processes FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey <> 1")
def _(s, d):
    g = F.col("go_classifiers")
    return _proteins(s, d).select("id", "name", "general_function", "organism", "specific_function", g["component"].alias("components"), g["function"].alias("functions"), g["process"].alias("processes"))


@query("f16_map_of_lists", "SELECT CAST(s_suppkey AS VARCHAR) AS id, unnest(['function', 'function', 'process']) AS kind, unnest(['binding', n_name, n_name]) AS term FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey <> 1")
def _(s, d):
    each = _proteins(s, d).select("id", F.explode("go_classifiers").alias("kind", "terms"))
    return each.select("id", "kind", F.explode("terms").alias("term"))


@query("s06_text_or_default", "SELECT doc_id, coalesce(nullif(trim(substr(text, 1, 1), chr(32)), ''), 'none') AS first FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.text_or(F.substring("text", 1, 1), "none").alias("first"))


def _descriptors(s, d):
    """Nations below their regions in two tree numbers each, one of them at the root."""
    n = table(s, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("tree"))
    r = table(s, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("tree"))
    rows = n.unionByName(r)
    text = _xml("DescriptorRecord", _xml("DescriptorUI", F.col("id")), _xml("DescriptorName", _xml("String", F.col("name"))), _xml("ConceptList", _xml("Concept", _xml("ScopeNote", " about ", F.col("name"), " "))), _xml("TreeNumberList", _xml("TreeNumber", F.col("tree")), _xml("TreeNumber", F.concat(F.lit("Z"), F.col("id")))))
    return records.descriptors(rows.select(F.from_xml(text, records.DESCRIPTOR).alias("x")))


@query("s07_descriptors", "SELECT 'N' || n_nationkey AS id, n_name AS name, 'about ' || trim(n_name) AS scope_note, ['R' || n_regionkey] AS parents FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, 'about ' || trim(r_name), [] FROM region")
def _(s, d):
    return _descriptors(s, d)


def _studies(s, d):
    """Study elements: orders, keyed by customer; every seventh has no id."""
    o = spread(table(s, d, "orders"))
    ident = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    text = _xml("clinical_study", _xml("id_info", _xml("nct_id", ident)), _xml("brief_title", " ", F.col("o_orderkey").cast("string")), _xml("overall_status", F.col("o_orderstatus")), _xml("phase", F.col("o_orderpriority")), _xml("condition", F.col("o_orderstatus")), _xml("condition", F.col("o_orderpriority")), _xml("intervention_browse", _xml("mesh_term", F.col("o_orderpriority"))))
    return records.studies(o.select(F.col("o_orderkey").alias("pos"), F.from_xml(text, records.STUDY).alias("x")))


@query("s10_studies", "SELECT CAST(o_custkey AS VARCHAR) AS nct_id, arg_max(CAST(o_orderkey AS VARCHAR), o_orderkey) AS brief_title, arg_max(o_orderstatus, o_orderkey) AS overall_status, arg_max(trim(o_orderpriority), o_orderkey) AS phase, CAST(NULL AS VARCHAR) AS start_date, arg_max([o_orderstatus, trim(o_orderpriority)], o_orderkey) AS condition_mesh_terms, arg_max([trim(o_orderpriority)], o_orderkey) AS intervention_mesh_terms FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY o_custkey")
def _(s, d):
    return _studies(s, d).select("nct_id", "brief_title", "overall_status", "phase", "start_date", "condition_mesh_terms", "intervention_mesh_terms")


@query("p07_linked_studies", "WITH o AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS st, arg_max(trim(o_orderpriority), o_orderkey) AS pr FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1) SELECT CAST(o_custkey AS VARCHAR) AS nct_id, ['c1'] AS conditions, [st] AS condition_mesh_terms, ['d1'] AS drugs, [pr] AS intervention_mesh_terms FROM o WHERE st IN ('F', 'O') AND pr IN ('1-URGENT', '2-HIGH')")
def _(s, d):
    kinds = "id string, pos int, name string, synonyms array<string>"
    ills = s.createDataFrame([("c1", 1, "f", ["o"]), ("c2", 2, "O", [])], kinds)
    drugs = s.createDataFrame([("d1", 1, "1-URGENT", ["2-HIGH"]), ("d2", 2, "2-HIGH", ["5-low"])], kinds)
    found = records.linked_studies(_studies(s, d), ills, drugs)
    return found.select("nct_id", "conditions", "condition_mesh_terms", "drugs", "intervention_mesh_terms")


def _conditions(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("DiseaseID"), F.col("p_name").alias("DiseaseName"), F.lit(None).cast("string").alias("Definition"), F.concat("p_brand", F.lit(" | "), "p_type").alias("ParentIDs"), F.concat("p_brand", F.lit("||"), "p_name", F.lit("|")).alias("Synonyms"), F.when(F.col("p_size") > 10, F.col("p_type")).alias("SlimMappings"))
    return records.conditions(p)


@query("s12_conditions", "SELECT p_partkey AS id, p_name AS name, '' AS definition, [trim(p_brand), trim(p_type)] AS parents, [trim(p_brand), trim(p_name)] AS synonyms, CASE WHEN p_size > 10 THEN [trim(p_type)] ELSE [] END AS slim_terms FROM part")
def _(s, d):
    return _conditions(s, d)


@query("s12_without_slim", "SELECT p_partkey AS id FROM part WHERE p_size <= 10")
def _(s, d):
    return records.by_slim(_conditions(s, d))[1]


_CODE_SQL = "k AS (SELECT DISTINCT upper(substr(md5(p_brand), 1, n)) AS code FROM part, (SELECT unnest([1, 3, 4, 5, 7]) AS n))"


def _codes(s, d):
    n = F.explode(F.array(*map(F.lit, records.LEVELS))).alias("n")
    return table(s, d, "part").select("p_brand", n).select(F.upper(F.expr("substring(md5(p_brand), 1, n)")).alias("atc_code")).withColumn("atc_name", F.concat(F.lit("NAME "), "atc_code"))


@query("s13_codes", f"WITH {_CODE_SQL} SELECT c.code, 'Name ' || lower(c.code) AS name, arg_max(p.code, length(p.code)) AS parent, CASE length(c.code) WHEN 1 THEN 'anatomical' WHEN 3 THEN 'therapeutic' WHEN 4 THEN 'pharmacological' WHEN 5 THEN 'chemical' WHEN 7 THEN 'substance' END AS \"group\" FROM k c LEFT JOIN k p ON starts_with(c.code, p.code) AND length(p.code) < length(c.code) GROUP BY c.code")
def _(s, d):
    return records.drug_codes(_codes(s, d))


@query("p18_code_nodes", f"WITH {_CODE_SQL} SELECT code FROM k WHERE length(code) = 4")
def _(s, d):
    rows = records.drug_codes(_codes(s, d))
    return rows.where((F.length("code") > 1) & (F.length("code") < 7) & (F.col("group") == "pharmacological")).select("code")


@query("f19_code_groups", "SELECT p_partkey AS id, [substr(h, 1, 1)] AS anatomical, [substr(h, 1, 3)] AS therapeutic, [substr(h, 1, 4)] AS pharmacological, [substr(h, 1, 5), substr(h, 2, 5)] AS chemical FROM (SELECT p_partkey, md5(p_brand) AS h FROM part)")
def _(s, d):
    h = F.md5("p_brand")
    codes = F.array(*(F.substring(h, 1, n) for n in (1, 3, 4, 5, 7)), F.substring(h, 2, 5))
    rows = records.code_groups(table(s, d, "part").select(F.col("p_partkey").alias("id"), codes.alias("atc_codes")))
    return rows.withColumnsRenamed({f"{g}_groups": g for g in ("anatomical", "therapeutic", "pharmacological", "chemical")})


@query("s14_protein_conditions", "SELECT DISTINCT u.s AS protein, CAST(o_custkey AS VARCHAR) AS condition FROM (SELECT l_partkey, CAST(unnest([l_suppkey, l_suppkey + 1]) AS VARCHAR) AS s FROM lineitem WHERE l_discount > 0.09) u JOIN supplier ON u.s = CAST(s_suppkey AS VARCHAR) JOIN (SELECT l_partkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_tax > 0.07) c ON u.l_partkey = c.l_partkey")
def _(s, d):
    l = table(s, d, "lineitem")
    genes = l.where("l_discount > 0.09").select(F.col("l_partkey").alias("GeneID"), F.concat_ws("|", "l_suppkey", F.col("l_suppkey") + 1).alias("UniProtIDs"))
    curated = l.where("l_tax > 0.07").join(table(s, d, "orders"), F.expr("l_orderkey = o_orderkey")).select(F.col("l_partkey").alias("GeneID"), F.col("o_custkey").cast("string").alias("DiseaseID"))
    return records.protein_conditions(genes, curated, table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id")))


@query("j04_name_map", "SELECT p_name AS name, max(p_partkey) AS id FROM part GROUP BY 1")
def _(s, d):
    return records.name_map(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name")))


@query("p21_valid_categories", "SELECT 'D' || p_partkey AS id, CAST(p_size AS VARCHAR) AS category FROM part JOIN nation ON p_size = n_nationkey WHERE p_partkey <> 3")
def _(s, d):
    given = records.drugs(_drugs(s, d)).select("id", F.explode("categories").alias("c")).select("id", F.col("c.mesh_id").alias("category"))
    known = table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("id"))
    return records.valid_categories(given, known)


@query("p02_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def _(s, d):
    return table(s, d, "orders").drop("o_orderdate", "o_orderpriority")


@query("p05_arrays_without", "SELECT l_orderkey, list_sort(list_distinct(COALESCE(list(l_partkey) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)), []))) AS parts FROM lineitem GROUP BY 1")
def _(s, d):
    gone = table(s, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"), F.lit(1).alias("gone"))
    rows = table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(gone, "l_partkey", "left")
    return rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.when(F.col("gone").isNull(), F.col("l_partkey")))).alias("parts"))


_BLOCKED = ["old gear", "Blue Plate", "no such name"]


@query("p06_blocklist", "WITH b AS (SELECT min(p_partkey) AS id FROM part WHERE lower(p_name) IN ('old gear', 'blue plate') GROUP BY lower(p_name)) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM b)")
def _(s, d):
    v = table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"), F.array().cast("array<string>").alias("synonyms"))
    gone = records.blocked(v, _BLOCKED).select(F.col("id").alias("l_partkey"))
    return table(s, d, "lineitem").join(gone, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("a28_fill_rates", f"WITH {edges_sql(['INDICATED_FOR'])}, t AS (SELECT CAST(p_partkey AS VARCHAR) AS id, COUNT(dst) AS n, COUNT(dst) FILTER (CAST(dst AS BIGINT) % 3 <> 0) AS m FROM part LEFT JOIN edges ON src = CAST(p_partkey AS VARCHAR) GROUP BY 1) SELECT COUNT(*) FILTER (n > 0) AS before, COUNT(*) FILTER (m > 0) AS after, round((SELECT COUNT(DISTINCT dst) FILTER (CAST(dst AS BIGINT) % 3 = 0) * 1.0 / COUNT(DISTINCT dst) FROM edges), 6) AS blocked FROM t")
def _(s, d):
    e = relation(s, d, "INDICATED_FOR")
    bad = F.col("dst").cast("long") % 3 == 0
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("src"))
    lists = p.join(e.groupBy("src").agg(F.collect_list("dst").alias("treats")), "src", "left").withColumn("treats", F.coalesce("treats", F.array().cast("array<string>")))
    kept = F.filter("treats", lambda c: c.cast("long") % 3 != 0)
    fill = lists.agg(F.count_if(F.size("treats") > 0).alias("before"), F.count_if(F.size(kept) > 0).alias("after"))
    share = e.agg(r6(F.count_distinct(F.when(bad, F.col("dst"))) / F.count_distinct("dst")).alias("blocked"))
    return fill.join(F.broadcast(share))  # one row each


@query("p11_known_actions", f"WITH {edges_sql(['INDICATED_FOR'])} SELECT DISTINCT 'D' || p_partkey AS id, p_type AS name, 'inhibitor|' || p_size AS actions FROM part JOIN edges ON src = CAST(p_partkey AS VARCHAR) WHERE p_partkey <> 3 AND p_size > 40")
def _(s, d):
    kept = relation(s, d, "INDICATED_FOR").select(F.concat(F.lit("D"), "src").alias("id")).distinct()
    rows = records.targets(_drugs(s, d)).join(kept, "id", "left_semi")
    known = rows.select("id", F.explode(F.filter("targets", lambda t: t["known_action"] == "yes")).alias("t"))
    return known.select("id", "t.name", tx.joined_actions(F.col("t.actions")).alias("actions"))


@query("p12_guards", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> '' AND o_orderstatus IN ('F', 'O')")
def _(s, d):
    status = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return table(s, d, "orders").withColumn("st", status).where(F.col("st").isNotNull() & (F.col("st") != "")).select("o_orderkey")


_SIX = ["TARGETS", "HAS_THERAPEUTIC_GROUP", "HAS_PHARMACOLOGICAL_GROUP", "HAS_CHEMICAL_GROUP", "HAS_CATEGORY", "INDICATED_FOR"]


@query("p16_allowed_relations", f"WITH {edges_sql()} SELECT rel, src, dst FROM edges WHERE rel IN ({', '.join(repr(r) for r in _SIX)})")
def _(s, d):
    return edges(s, d).where(F.col("rel").isin(*_SIX)).select("rel", "src", "dst")


@query("p24_pairs", "SELECT DISTINCT l_partkey AS item, o_custkey AS user_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.array("o_custkey").alias("users"))
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("items")).join(o, "l_orderkey")
    return g.select(F.explode("items").alias("item"), "users").select("item", F.explode("users").alias("user_id")).distinct()


@query("f05_actions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'unknown' ELSE p_brand || '|' || p_type END AS actions FROM part")
def _(s, d):
    first = F.when(F.col("p_size") % 3 == 0, "other").otherwise(F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", tx.joined_actions(F.array(first, "p_type")).alias("actions"))


@query("f14_array_sets", "SELECT p_partkey, list_sort(list_distinct([p_brand, p_type, p_brand])) AS uniq, list_contains([p_brand, p_type], p_name) AS has, list_concat([p_brand], [p_type]) AS more FROM part")
def _(s, d):
    a = F.array("p_brand", "p_type", "p_brand")
    return table(s, d, "part").select("p_partkey", F.array_sort(F.array_distinct(a)).alias("uniq"), F.array_contains(F.array("p_brand", "p_type"), F.col("p_name")).alias("has"), F.concat(F.array("p_brand"), F.array("p_type")).alias("more"))


@query("f15_append_if_absent", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_brand, p_type] ELSE [p_brand] END AS names FROM part")
def _(s, d):
    value = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise(F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", tx.append_if_absent(F.array("p_brand"), value).alias("names"))


@query("f17_json_round_trip", "SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def _(s, d):
    text = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(s, d, "part").select("p_partkey", F.from_json(text, "name string, size int").alias("r")).select("p_partkey", "r.*")


@query("f18_finite", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 9 WHEN event_id % 5 = 2 THEN -9 WHEN event_id % 5 = 3 THEN 0 ELSE value END AS v FROM events")
def _(s, d):
    k = F.col("event_id") % 5
    odd = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k == 4, F.col("value"))
    return table(s, d, "events").select("event_id", tx.finite(odd, 0.0, 9.0, -9.0).alias("v"))


_CLEAN = r"translate(regexp_replace(regexp_replace(told, '\[[^\]]*\]', '', 'g'), '\(PubMed:[^)]*\)', '', 'g'), chr(13) || chr(10), '  ')"
_TOLD = (
    "told AS (SELECT doc_id, true AS good, text AS told FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, false, regexp_replace(text, '[.!?]', ';', 'g') FROM documents WHERE lang = 'en'), "
    rf"cut AS (SELECT doc_id, good, unnest(string_split(regexp_replace({_CLEAN}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM told), "
    "sentence AS (SELECT doc_id, good, row_number() OVER () AS no, sentence FROM cut WHERE NOT contains(lower(sentence), 'not') AND NOT contains(lower(sentence), 'contraindicated'))"
)
_ITEM = "list_sort(list(DISTINCT id) FILTER (good = {}))"


@query("l15_extraction", f"WITH RECURSIVE {names_sql(_TOLD)}, e AS (SELECT doc_id, good, x.id AS id FROM mention WHERE NOT (upper(x.surface) = x.surface AND lower(x.surface) <> x.surface)), g AS (SELECT doc_id, {_ITEM.format('true')} AS treats, {_ITEM.format('false')} AS not_treats FROM e GROUP BY 1) SELECT doc_id, COALESCE(treats, []) AS treats, COALESCE(not_treats, []) AS not_treats FROM documents LEFT JOIN g USING (doc_id)")
def _(s, d):
    groups = F.array(F.when(F.col("lang") == "en", "approved").otherwise("other")).alias("groups")
    docs = table(s, d, "documents").select("doc_id", groups, F.col("text").alias("indication"), F.regexp_replace("text", "[.!?]", ";").alias("toxicity"))
    return mentions.treatments(docs, "doc_id", benchmark_names(s, d))


@query("k05_upsert", f"WITH {edges_sql()}, {nodes_sql()}, n AS (SELECT kind, id, CASE WHEN kind = 'Drug' AND TRY_CAST(id AS BIGINT) % 2 = 0 AND TRY_CAST(id AS BIGINT) % 3 <> 0 THEN 'renamed' ELSE name END AS name FROM nodes) SELECT rel, src, dst, a.name AS src_name, b.name AS dst_name FROM edges JOIN n a ON a.kind = src_kind AND a.id = src JOIN n b ON b.kind = dst_kind AND b.id = dst")
def _(s, d):
    path = f"{shared_dir(s)}/linkweave/graph-{uuid.uuid4().hex}"
    n, e = written(nodes(s, d), "nodes"), written(edges(s, d).select("rel", "src", "dst"), "edges")  # both upserts read them
    half = F.pmod(F.xxhash64("src", "dst"), F.lit(2)) == 0
    store.upsert(s, path, n, e.where(half))
    number = F.expr("try_cast(id as bigint)")
    again = n.where("kind = 'Drug'").where(number % 2 == 0).withColumn("name", F.when(number % 3 != 0, "renamed"))
    store.upsert(s, path, again, e.where(~half))
    names = store.nodes(s, path)
    name = lambda end: names.select(F.col("kind").alias(f"{end}_kind"), F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return store.edges(s, path).join(name("src"), ["src_kind", "src"]).join(name("dst"), ["dst_kind", "dst"]).select("rel", "src", "dst", "src_name", "dst_name")


# ---------------------------------------------------------------- graph build and export

_ALL_NODES = " UNION ALL ".join(f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS id, {label} AS name FROM {name}" for kind, (name, key, label) in NODES.items())


def _twice(s, d):
    """Every node twice: first under another name, then under its own; conditions of even number the second time without one."""
    n = nodes(s, d)
    own = F.when((F.col("kind") == "Condition") & (F.col("id").cast("long") % 2 == 0), None).otherwise(F.col("name"))
    return n.select("kind", "id", F.lit("first name").alias("name"), F.lit(1).alias("pos")).unionByName(n.select("kind", "id", own.alias("name"), F.lit(2).alias("pos")))


@query("g02_node_upsert", f"WITH {edges_sql()}, {nodes_sql()} SELECT kind, id, CASE WHEN kind = 'Condition' AND CAST(id AS BIGINT) % 2 = 0 THEN 'first name' ELSE name END AS name FROM nodes".replace("CAST(id AS BIGINT) % 2", "TRY_CAST(id AS BIGINT) % 2"))
def _(s, d):
    return graph.upsert_nodes(_twice(s, d))


@query("g03_edge_upsert", f"WITH {edges_sql()} SELECT rel, src_kind, src, dst_kind, dst FROM edges WHERE (src_kind <> 'Drug' OR TRY_CAST(src AS BIGINT) % 4 <> 0)")
def _(s, d):
    rows = edges(s, d).select("rel", "src", "dst")
    known = nodes(s, d).where("kind <> 'Drug' or try_cast(id as bigint) % 4 <> 0")
    return graph.upsert_edges(rows.unionByName(rows), known)


@query("g05_triples", f"WITH {edges_sql()} SELECT src_kind || '::' || src AS head, rel AS relation, dst_kind || '::' || dst AS tail FROM edges")
def _(s, d):
    return graph.to_triples(edges(s, d))


@query("g06_nodes_by_kind", f"WITH {edges_sql()}, {nodes_sql()} SELECT kind, COUNT(*) AS nodes, min(id) AS first_id, max(name) AS last_name FROM nodes GROUP BY 1")
def _(s, d):
    return nodes(s, d).groupBy("kind").agg(F.count("*").alias("nodes"), F.min("id").alias("first_id"), F.max("name").alias("last_name"))


@query("g07_from_triples", f"WITH {edges_sql()} SELECT rel, src_kind, src, dst_kind, dst FROM edges")
def _(s, d):
    return graph.from_triples(graph.to_triples(edges(s, d)), nodes(s, d))


@query("g20_built_nodes", f"WITH {edges_sql()}, {nodes_sql()}, u AS (SELECT src_kind AS kind, src AS id FROM edges UNION SELECT dst_kind, dst FROM edges) SELECT kind, id, name FROM nodes WHERE (kind, id) IN (SELECT (kind, id) FROM u)")
def _(s, d):
    kept, _ = graph.build(nodes(s, d).withColumn("pos", F.lit(1)), edges(s, d))
    return kept


for _kind in ("Drug", "Condition", "Protein"):
    query(f"s15_nodes_{_kind.lower()}", f"SELECT id, name FROM ({_ALL_NODES}) WHERE kind = '{_kind}'")(lambda s, d, k=_kind: nodes(s, d).where(F.col("kind") == k).select("id", "name"))
for _kind, _rel in (("TherapeuticGroup", "HAS_THERAPEUTIC_GROUP"), ("PharmacologicalGroup", "HAS_PHARMACOLOGICAL_GROUP"), ("ChemicalGroup", "HAS_CHEMICAL_GROUP"), ("CategoryDrug", "HAS_CATEGORY"), ("BiologicalProcess", "HAS_PROCESS"), ("CellularComponent", "HAS_COMPONENT"), ("MolecularFunction", "HAS_FUNCTION")):
    query(f"s15_nodes_{_kind.lower()}", f"WITH {edges_sql([_rel])} SELECT DISTINCT dst AS id, dst AS name FROM edges")(lambda s, d, k=_kind: nodes(s, d).where(F.col("kind") == k).select("id", "name"))
for _rel in METAGRAPH:
    if _rel != "TARGETS":
        query(f"s16_edges_{_rel.lower()}", f"WITH {edges_sql([_rel])} SELECT src, dst FROM edges")(lambda s, d, r=_rel: relation(s, d, r))


@query("a05_metanode_summary", f"WITH {edges_sql()}, {nodes_sql()}, ends AS (SELECT src_kind AS kind, src AS id, rel FROM edges UNION ALL SELECT dst_kind, dst, rel FROM edges), r AS (SELECT kind, COUNT(DISTINCT rel) AS metaedges FROM ends GROUP BY 1), u AS (SELECT DISTINCT kind, id FROM ends) SELECT n.kind, COUNT(*) AS nodes, any_value(metaedges) AS metaedges, COUNT(*) - COUNT(u.id) AS unconnected FROM nodes n LEFT JOIN u ON n.kind = u.kind AND n.id = u.id LEFT JOIN r ON n.kind = r.kind GROUP BY n.kind")
def _(s, d):
    return graph.metanodes(nodes(s, d), edges(s, d))


@query("a02_condition_drugs", f"WITH {edges_sql(['INDICATED_FOR'])} SELECT dst AS condition, list_sort(list(DISTINCT src)) AS drugs FROM edges GROUP BY 1")
def _(s, d):
    return relation(s, d, "INDICATED_FOR").groupBy(F.col("dst").alias("condition")).agg(F.array_sort(F.collect_set("src")).alias("drugs"))


@query("j09_external_pairs", f"WITH {edges_sql(['INDICATED_FOR'])}, more AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS src, CAST(o_custkey AS VARCHAR) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND l_discount >= 0.08) SELECT (SELECT COUNT(*) FROM more) AS pairs, (SELECT COUNT(*) FROM more WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edges)) AS kept, (SELECT COUNT(*) FROM more WHERE (src, dst) IN (SELECT (src, dst) FROM edges)) AS overlap")
def _(s, d):
    l = table(s, d, "lineitem").where("l_returnflag = 'R' and l_discount >= 0.08").join(table(s, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    more = l.select(F.col("l_partkey").cast("string").alias("src"), F.col("o_custkey").cast("string").alias("dst")).distinct()
    base = relation(s, d, "INDICATED_FOR").withColumn("own", F.lit(1))
    both = more.join(base, ["src", "dst"], "left")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("own").isNull()).alias("kept"), F.count("own").alias("overlap"))
