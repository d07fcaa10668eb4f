"""Domain records from the interchange formats: XML elements, CSV rows and ontology terms to typed columns.

Each parser takes a DataFrame whose elements were read under a fixed schema (readers.xml_records with that schema, or from_xml
over a text column), so the same expressions serve files and tests. Elements without an id are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkweave.functions.text import capitalised, pieces, text_or
from linkweave.operators.lookup import aliases, prefix_parents, tree_parents

from . import readers

# The text fields of a drug, as the elements are called.
DRUG_TEXTS = (
    "name", "description", "indication", "pharmacodynamics", "mechanism-of-action", "toxicity", "metabolism", "absorption", "half-life",
    "protein-binding", "route-of-elimination", "volume-of-distribution", "clearance",
)
_TEXTS = ", ".join(f"`{f}` string" for f in DRUG_TEXTS)
DRUG = (
    f"`drugbank-id` array<struct<_VALUE: string, _primary: string>>, {_TEXTS}, groups struct<`group`: array<string>>, "
    "salts struct<salt: array<struct<name: string>>>, synonyms struct<synonym: array<string>>, products struct<product: array<struct<name: string>>>, "
    "`atc-codes` struct<`atc-code`: array<struct<_code: string, level: array<struct<_code: string, _VALUE: string>>>>>, "
    "categories struct<category: array<struct<category: string, `mesh-id`: string>>>, "
    "`drug-interactions` struct<`drug-interaction`: array<struct<`drugbank-id`: string, description: string>>>, "
    "targets struct<target: array<struct<name: string, actions: struct<action: array<string>>, `known-action`: string>>>"
)
POLYPEPTIDE = (
    "_id string, name string, `general-function` string, `specific-function` string, `gene-name` string, `cellular-location` string, organism string, "
    "`go-classifiers` struct<`go-classifier`: array<struct<category: string, description: string>>>"
)
DESCRIPTOR = (
    "DescriptorUI string, DescriptorName struct<String: string>, ConceptList struct<Concept: array<struct<ScopeNote: string>>>, "
    "TreeNumberList struct<TreeNumber: array<string>>"
)
STUDY = (
    "id_info struct<nct_id: string>, brief_title string, official_title string, brief_summary struct<textblock: string>, "
    "detailed_description struct<textblock: string>, overall_status string, start_date string, completion_date string, phase string, study_type string, "
    "condition array<string>, intervention_browse struct<mesh_term: array<string>>"
)


def _each(array: Column) -> Column:
    """Trimmed texts of an array, the empty text for missing ones; no array is an empty one."""
    return F.coalesce(F.transform(array, lambda x: text_or(x, "")), F.array().cast("array<string>"))


def _known(array: Column) -> Column:
    """Trimmed texts of the elements that have one."""
    return F.filter(_each(array), lambda x: x != "")


def primary_id(x: Column) -> Column:
    """The first id marked as primary."""
    return F.trim(F.get(F.filter(x["drugbank-id"], lambda i: i["_primary"] == "true"), F.lit(0))["_VALUE"])


def drugs(elements: DataFrame, x: str = "x") -> DataFrame:
    """Drugs by primary id: 13 texts, groups, salts, synonyms, products, ATC codes of all levels, categories (name, mesh id)."""
    e = F.col(x)
    codes = F.coalesce(e["atc-codes"]["atc-code"], F.array().cast("array<struct<_code:string,level:array<struct<_code:string,_VALUE:string>>>>"))
    levels = F.transform(codes, lambda c: F.concat(F.array(c["_code"]), F.coalesce(F.transform(c["level"], lambda v: v["_code"]), F.array().cast("array<string>"))))
    empty = F.array().cast("array<struct<category:string,mesh_id:string>>")
    category = F.transform(e["categories"]["category"], lambda c: F.struct(text_or(c["category"], "").alias("category"), text_or(c["mesh-id"], "").alias("mesh_id")))
    return elements.select(
        primary_id(e).alias("id"), *(text_or(e[f], "").alias(f.replace("-", "_")) for f in DRUG_TEXTS), _each(e["groups"]["group"]).alias("groups"),
        _each(e["salts"]["salt"]["name"]).alias("salts"), F.array_distinct(_each(e["synonyms"]["synonym"])).alias("synonyms"),
        F.array_distinct(_each(e["products"]["product"]["name"])).alias("products"), F.array_distinct(F.flatten(levels)).alias("atc_codes"),
        F.coalesce(F.filter(category, lambda c: c["mesh_id"] != ""), empty).alias("categories"),
    ).where("id <> ''")


def interactions(elements: DataFrame, x: str = "x") -> DataFrame:
    """(id, drugbank_id, description): a row per interaction."""
    rows = elements.select(primary_id(F.col(x)).alias("id"), F.explode(F.col(x)["drug-interactions"]["drug-interaction"]).alias("i")).where("id <> ''")
    return rows.select("id", text_or(F.col("i")["drugbank-id"], "").alias("drugbank_id"), text_or(F.col("i")["description"], "").alias("description"))


def targets(elements: DataFrame, x: str = "x") -> DataFrame:
    """(id, targets array<struct<name, actions, known_action>>) of drugs that have any; an action that isn't told is unknown."""
    e = F.col(x)["targets"]["target"]
    one = F.transform(e, lambda t: F.struct(text_or(t["name"], "").alias("name"), _each(t["actions"]["action"]).alias("actions"), text_or(t["known-action"], "unknown").alias("known_action")))
    return elements.select(primary_id(F.col(x)).alias("id"), one.alias("targets")).where("id <> '' and size(targets) > 0")


def proteins(elements: DataFrame, x: str = "x") -> DataFrame:
    """Polypeptides with six texts and their GO descriptions by category; the specific function joins the functions if absent."""
    e = F.col(x)
    every = F.coalesce(e["go-classifiers"]["go-classifier"], F.array().cast("array<struct<category:string,description:string>>"))

    def of(kind):
        return _known(F.transform(F.filter(every, lambda g: g["category"] == kind), lambda g: g["description"]))

    more = text_or(e["specific-function"], "")
    functions = F.when((more != "") & ~F.array_contains(of("function"), more), F.array_append(of("function"), more)).otherwise(of("function"))
    kinds = F.map_from_arrays(F.array(*map(F.lit, ("component", "function", "process"))), F.array(of("component"), functions, of("process")))
    fields = ("name", "general-function", "specific-function", "gene-name", "cellular-location", "organism")
    return elements.select(F.trim(e["_id"]).alias("id"), *(text_or(e[f], "").alias(f.replace("-", "_")) for f in fields), kinds.alias("go_classifiers")).where("id <> ''")


def descriptors(elements: DataFrame, x: str = "x") -> DataFrame:
    """(id, name, scope_note, parents) of thesaurus descriptors; parents are those of their tree numbers."""
    e = F.col(x)
    rows = elements.select(
        e["DescriptorUI"].alias("id"), e["DescriptorName"]["String"].alias("name"), F.trim(F.get(e["ConceptList"]["Concept"], F.lit(0))["ScopeNote"]).alias("scope_note"),
        e["TreeNumberList"]["TreeNumber"].alias("trees"),
    )
    up = tree_parents(rows.select("id", F.explode("trees").alias("tree")))
    return rows.drop("trees").join(up, "id", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def studies(elements: DataFrame, x: str = "x", order: str = "pos") -> DataFrame:
    """Clinical studies by id, ten texts and two lists; of several with an id the last by order; without an id none."""
    e = F.col(x)
    texts = {
        "nct_id": e["id_info"]["nct_id"], "brief_title": e["brief_title"], "official_title": e["official_title"], "brief_summary": e["brief_summary"]["textblock"],
        "detailed_description": e["detailed_description"]["textblock"], "overall_status": e["overall_status"], "start_date": e["start_date"],
        "completion_date": e["completion_date"], "phase": e["phase"], "study_type": e["study_type"],
    }
    rows = elements.select(
        order, *(F.nullif(F.trim(v), F.lit("")).alias(k) for k, v in texts.items()),
        _known(e["condition"]).alias("condition_mesh_terms"), _known(e["intervention_browse"]["mesh_term"]).alias("intervention_mesh_terms"),
    ).where("nct_id is not null")
    columns = [c for c in rows.columns if c not in (order, "nct_id")]
    last = rows.groupBy("nct_id").agg(F.max_by(F.struct(*columns), order).alias("s"))
    return last.select("nct_id", "s.*")


def linked_studies(found: DataFrame, conditions: DataFrame, medicines: DataFrame) -> DataFrame:
    """found with the ids of its terms and only the terms that have one; studies that lack either kind go.

    conditions and medicines are vocabularies (id, pos, name, synonyms); the former match in any case, the latter as spelled.
    """
    from linkweave.operators.lookup import matched_ids

    a = matched_ids(found, "nct_id", "condition_mesh_terms", conditions).select("nct_id", F.col("ids").alias("conditions"), F.col("terms").alias("condition_mesh_terms"))
    b = matched_ids(found, "nct_id", "intervention_mesh_terms", medicines, fold=False).select("nct_id", F.col("ids").alias("drugs"), F.col("terms").alias("intervention_mesh_terms"))
    return found.drop("condition_mesh_terms", "intervention_mesh_terms").join(a, "nct_id").join(b, "nct_id").where("size(conditions) > 0 and size(drugs) > 0")


def conditions(rows: DataFrame) -> DataFrame:
    """(id, name, definition, parents, synonyms, slim_terms) from a disease vocabulary; its lists are split at bars."""
    def listed(c):
        return pieces(F.coalesce(F.col(c), F.lit("")))

    return rows.select(
        F.col("DiseaseID").alias("id"), F.col("DiseaseName").alias("name"), F.coalesce("Definition", F.lit("")).alias("definition"),
        listed("ParentIDs").alias("parents"), listed("Synonyms").alias("synonyms"), listed("SlimMappings").alias("slim_terms"),
    )


def by_slim(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conditions with slim terms, and the ids of those without."""
    return found.where("size(slim_terms) > 0"), found.where("size(slim_terms) = 0").select("id")


# What a code of this length names.
LEVELS = {1: "anatomical", 3: "therapeutic", 4: "pharmacological", 5: "chemical", 7: "substance"}


def level(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for n, name in LEVELS.items():
        out = F.when(F.length(code) == n, name).otherwise(out)
    return out


def drug_codes(rows: DataFrame) -> DataFrame:
    """(code, name, parent, group) from (atc_code, atc_name, ..): names capitalised, repeats dropped, the first name kept."""
    first = rows.select("atc_code", capitalised(F.col("atc_name")).alias("name")).distinct().groupBy(F.col("atc_code").alias("code")).agg(F.min("name").alias("name"))
    return first.join(prefix_parents(first.select("code")), "code", "left").select("code", "name", "parent", level(F.col("code")).alias("group"))


def code_groups(drugs: DataFrame) -> DataFrame:
    """drugs (id, atc_codes) with their codes by level."""
    def of(n):
        return F.filter("atc_codes", lambda c: F.length(c) == n).alias(f"{LEVELS[n]}_groups")

    return drugs.select("id", of(1), of(3), of(4), of(5))


def protein_conditions(genes: DataFrame, curated: DataFrame, proteins: DataFrame) -> DataFrame:
    """(protein, condition): genes (GeneID, UniProtIDs split at bars) of known proteins, with the curated diseases of the gene."""
    each = genes.where("UniProtIDs is not null").select("GeneID", F.explode(F.split("UniProtIDs", "\\|")).alias("protein"))
    each = each.join(proteins.select(F.col("id").alias("protein")), "protein", "left_semi")
    return each.join(curated.select("GeneID", F.col("DiseaseID").alias("condition")), "GeneID").select("protein", "condition").distinct()


def name_map(rows: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """(name, id): the last entry of each name."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.max_by("id", order).alias("id"))


def used_terms(terms: DataFrame, proteins: DataFrame) -> DataFrame:
    """Ontology terms whose name or synonym is among the proteins' descriptions, in any case."""
    kinds = proteins.select(F.explode("go_classifiers").alias("kind", "names")).select(F.lower(F.explode("names")).alias("alias")).distinct()
    known = aliases_of(terms).join(kinds, "alias", "left_semi").select("id").distinct()
    return terms.join(known, "id", "left_semi")


def aliases_of(terms: DataFrame) -> DataFrame:
    every = F.explode(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return terms.select("id", F.lower(every).alias("alias")).distinct()


def with_protein_ids(found: DataFrame, proteins: DataFrame) -> DataFrame:
    """targets (id, targets) as rows (id, name, actions, known_action, protein_id); those whose protein isn't known go."""
    each = found.select("id", F.explode("targets").alias("t")).select("id", "t.*")
    names = name_map(proteins).withColumnsRenamed({"id": "protein_id"})
    return each.join(names, "name")


def valid_categories(drug_categories: DataFrame, found: DataFrame) -> DataFrame:
    """(id, category) whose category is one of the descriptors found."""
    return drug_categories.join(found.select(F.col("id").alias("category")), "category", "left_semi").select("id", "category")


def blocked(vocabulary: DataFrame, names: list[str]) -> DataFrame:
    """(id) of the vocabulary's first entries with these names, the list of over-general ones."""
    spark = vocabulary.sparkSession
    given = spark.createDataFrame([(n.lower(),) for n in names], "alias string")
    return aliases(vocabulary).join(F.broadcast(given), "alias", "left_semi").select("id").distinct()  # the list is the program's own


def read_drugs(spark: SparkSession, path: str) -> DataFrame:
    """The drug elements of an XML file as one struct column x."""
    rows = readers.xml_records(spark, path, "drug", DRUG)
    return rows.select(F.struct(*rows.columns).alias("x"))


def read_studies(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """(pos, x) of the studies in zip archives of XML files, in the order of the archive."""
    rows = readers.zipped_texts(spark, path, ".xml", max_records)
    return rows.select("pos", F.from_xml("text", STUDY).alias("x"))


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
