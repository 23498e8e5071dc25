"""Graph candidates from records of any field of science, and from evidence in texts; all rows are merged by graph.merge_nodes and merge_edges.

Node candidates are (id, label, properties, seq), a row for each label of a node; edge candidates (src, dst, type, properties, seq).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.functions.normalize import MISSING, clean, stable_id

# What the fields of a domain record say about its system, as (relationship, label of what it leads to).
COMMON_FIELDS = {
    "Domain_methods": ("USES_METHOD", "Method"), "Domain_conditions": ("HAS_CONDITION", "ExperimentalCondition"), "Domain_intervention_or_variable": ("TESTS_VARIABLE", "ScientificVariable"),
    "Domain_comparison": ("USES_COMPARISON", "Comparison"), "Domain_processing_steps": ("PROCESSED_BY", "Process"), "Domain_characterization": ("USES_CHARACTERIZATION", "Characterization"),
    "Domain_defect_chemistry": ("HAS_DEFECT_CHEMISTRY", "DefectChemistry"), "Domain_microstructure": ("HAS_MICROSTRUCTURE", "Microstructure"), "Domain_materials_or_entities": ("INCLUDES_ENTITY", "ScientificConcept"),
    "Domain_composition_formula": ("HAS_COMPOSITION", "Composition"), "Domain_a_site_species": ("HAS_A_SITE_SPECIES", "Chemical"), "Domain_b_site_species": ("HAS_B_SITE_SPECIES", "Chemical"),
    "Domain_substitutions_or_dopants": ("HAS_SUBSTITUTION_OR_DOPANT", "Chemical"), "Domain_oxygen_stoichiometry": ("HAS_OXYGEN_STOICHIOMETRY", "Stoichiometry"), "Domain_oxidation_states": ("HAS_OXIDATION_STATE", "OxidationState"),
    "Domain_crystal_structure": ("HAS_CRYSTAL_STRUCTURE", "CrystalStructure"), "Domain_space_group": ("HAS_SPACE_GROUP", "SpaceGroup"), "Domain_phases": ("HAS_PHASE", "MaterialPhase"),
    "Domain_atmosphere": ("PROCESSED_UNDER", "ExperimentalCondition"), "Domain_temperatures": ("PROCESSED_AT_TEMPERATURE", "ExperimentalCondition"),
}
SYSTEM_FIELD, FORMULA_FIELD = "Domain_system_or_subject", "Domain_composition_formula"
MEASUREMENT_FIELDS = ("Domain_measurements", "Domain_measured_properties")
#: Labels that the system of a profile has beside its own.
PROFILE_LABELS = {"oxide_perovskite": ("MaterialSystem", "OxidePerovskite")}
#: Characters of a text that are a node's name, and pieces of evidence that a paper gets from its raw texts.
NAME_LENGTH, MOST_EVIDENCE = 120, 30


def split_values(c: Column) -> Column:
    """The values of a cell: the items of a JSON list, else what stands between semicolons, bars and line feeds; distinct, first seen first, no missing tokens."""
    text = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    listed = F.from_json(text, "array<string>")
    cut = F.split(text, r"\s*(?:;|\||\n)\s*")
    parts = F.when(text.startswith("[") & text.endswith("]") & listed.isNotNull(), listed).otherwise(F.transform(cut, lambda x: F.btrim(x, F.lit(" []'\""))))
    cleaned = F.transform(parts, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00\s]+", " ")))
    return F.array_distinct(F.filter(cleaned, lambda x: ~F.lower(x).isin(*MISSING) & (x != "")))


def _properties(pairs: Mapping[str, Column]) -> Column:
    made = F.map_from_arrays(F.array(*map(F.lit, pairs)), F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in pairs.values())))
    return F.map_filter(made, lambda _, v: v != "")


def _candidates(rows: DataFrame, labels: Column) -> DataFrame:
    return rows.select("id", F.explode(labels).alias("label"), "properties", "seq")


def domain_subgraph(records: DataFrame, key: str, paper: str, seq: str, index: DataFrame | None = None, profile: str = "_domain_profile", prefix: str = "Domain_", fields: Mapping[str, tuple[str, str]] = COMMON_FIELDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) candidates of records whose fields begin with `prefix`: no device, but the system that a paper studies and what its fields say of it.

    The system is named by its own field, else the formula, else the paper. `fields` lead to nodes of their label, one
    for each different value; measurements are JSON objects (name, value, unit, context) with a node for each; every other
    column of the prefix is an attribute. index(norm, term, category): spellings in lower case with single spaces; a value that has
    one takes the term's name, keeps its own as raw_name, and gets the category. A sentence in _evidence_<field> supports
    all nodes of the field. Records are unpivoted in the row; the index is the only join.
    """
    names = records.columns
    cell = lambda c: F.col(f"`{c}`") if c in names else F.lit(None).cast("string")
    domain = [c for c in names if c.startswith(prefix)]
    attributes = [c for c in domain if c not in fields and c not in (SYSTEM_FIELD, *MEASUREMENT_FIELDS)]
    value = lambda kind, f: F.transform(split_values(cell(f)), lambda v: F.struct(F.lit(kind).alias("kind"), F.lit(f).alias("field"), v.alias("raw")))
    first = F.coalesce(*(F.nullif(clean(cell(c)), F.lit("")) for c in (SYSTEM_FIELD, FORMULA_FIELD)), clean(F.col(paper)))
    system = F.array(F.struct(F.lit("system").alias("kind"), F.lit(SYSTEM_FIELD).alias("field"), first.alias("raw")))
    valued = F.concat(system, *(value("field", f) for f in fields if f in names), *(value("attribute", f) for f in attributes))
    base = records.select(F.col(key).alias("_key"), F.col(paper).alias("_paper"), F.col(seq).alias("seq"), F.coalesce(cell(profile), F.lit("")).alias("_profile"), F.inline(valued))
    norm = F.lower(F.trim(F.regexp_replace("raw", r"\s+", " ")))
    if index is not None:
        base = base.join(index.select(F.col("norm").alias("_norm"), "term", "category"), norm == F.col("_norm"), "left")
    else:
        base = base.withColumns({"term": F.lit(None).cast("string"), "category": F.lit("")})
    base = base.withColumn("name", F.coalesce("term", "raw"))
    of_paper = stable_id("Paper", "_paper")
    table = F.create_map(*(F.lit(x) for f, (_, label) in fields.items() for x in (f, label)))
    relation = F.create_map(*(F.lit(x) for f, (rel, _) in fields.items() for x in (f, rel)))
    label = F.when(F.col("kind") == "system", "StudiedSystem").when(F.col("kind") == "attribute", "DomainAttribute").otherwise(F.element_at(table, F.col("field")))
    own = F.when(F.col("kind") == "system", F.concat("_profile", F.lit("|"), "name")).when(F.col("kind") == "attribute", F.concat("field", F.lit("|"), "name")).otherwise(F.col("name"))
    node_id = F.concat(F.lower(label), F.lit(":"), F.substring(F.sha1(F.encode(F.lower(clean(own)), "UTF-8")), 1, 20))
    rows = base.withColumn("id", node_id).withColumn("_label", label)
    systems = rows.where("kind = 'system'").select("_key", F.col("id").alias("_system"))

    attribute = F.when(F.col("kind") == "attribute", F.col("field"))
    rows_p = rows.withColumn("properties", _properties({"name": F.col("name"), "raw_name": F.col("raw"), "ontology_category": F.col("category"), "domain_profile": F.when(F.col("kind") != "field", F.col("_profile")), "domain_field": attribute}))
    more = F.create_map(*(x for p, ls in PROFILE_LABELS.items() for x in (F.lit(p), F.array(*map(F.lit, ls)))))
    extra = F.when(F.col("kind") == "system", F.coalesce(F.element_at(more, F.col("_profile")), F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    nodes = _candidates(rows_p, F.concat(F.array(F.col("_label"), F.lit("DomainEntity")), extra))

    def objects(f: str) -> Column:
        listed = F.coalesce(F.from_json(cell(f).cast("string"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
        return F.transform(listed, lambda m: F.struct(F.lit(f).alias("field"), m.alias("m")))

    items = F.concat(*map(objects, MEASUREMENT_FIELDS))
    of = lambda *ks: F.coalesce(*(F.nullif(clean(F.try_element_at("m", F.lit(k))), F.lit("")) for k in ks), F.lit(""))
    measured = records.select(F.col(key).alias("_key"), F.col(paper).alias("_paper"), F.col(seq).alias("seq"), F.coalesce(cell(profile), F.lit("")).alias("_profile"), F.inline(items))
    measured = measured.select("_key", "_paper", "seq", "_profile", "field", F.coalesce(F.nullif(of("name", "property"), F.lit("")), F.lit("measurement")).alias("name"), of("value").alias("value"), of("unit").alias("unit"), of("context", "conditions").alias("context"))
    measured = measured.withColumn("id", stable_id("DomainMeasurement", F.concat_ws("|", F.col("_key").cast("string"), "name", "value", "unit", "context")))
    m_nodes = _candidates(measured.withColumn("properties", _properties({c: F.col(c) for c in ("name", "value", "unit", "context")} | {"domain_profile": F.col("_profile")})), F.array(F.lit("Measurement"), F.lit("DomainMeasurement")))

    edge = lambda src, dst, kind, field, record: [src.alias("src"), dst.alias("dst"), kind.alias("type"), _properties({"field": field, "record": record.cast("string")}).alias("properties"), F.col("seq")]
    record, field = F.col("_key"), F.col("field")
    studied = rows.where("kind = 'system'").select(*edge(of_paper, F.col("id"), F.lit("STUDIES_SYSTEM"), field, record))
    kind = F.when(F.col("kind") == "attribute", "HAS_DOMAIN_ATTRIBUTE").otherwise(F.element_at(relation, field))
    said = rows.where("kind <> 'system'").join(systems, "_key").select(*edge(F.col("_system"), F.col("id"), kind, field, record))
    held = measured.join(systems, "_key").select(*edge(F.col("_system"), F.col("id"), F.lit("HAS_MEASUREMENT"), field, record))

    spoken = [c for c in names if c.startswith(f"_evidence_{prefix}")]
    nodes, edges = nodes.unionByName(m_nodes), studied.unionByName(said).unionByName(held)
    if spoken:
        sentences = F.filter(F.array(*(F.struct(F.lit(c.removeprefix("_evidence_")).alias("field"), clean(cell(c)).alias("text")) for c in spoken)), lambda x: x["text"] != "")
        told = records.select(F.col(key).alias("_key"), F.col(paper).alias("_paper"), F.col(seq).alias("seq"), F.inline(sentences)).withColumn("_evidence", stable_id("DomainEvidence", F.concat_ws("|", "_paper", "field", "text")))
        target = lambda df: df.select(F.col("_key").alias("_of"), F.col("field").alias("_field"), F.col("id").alias("_target"))
        targets = target(rows).union(target(measured))
        same = (F.col("_key") == F.col("_of")) & (F.col("field") == F.col("_field"))
        told = told.join(targets, same, "left_semi")
        nodes = nodes.unionByName(_candidates(told.select(F.col("_evidence").alias("id"), _properties({"name": F.substring("text", 1, NAME_LENGTH), "evidence_text": F.col("text"), "evidence_field": field}).alias("properties"), "seq"), F.array(*map(F.lit, ("Evidence", "TextEvidence", "DomainEvidence")))))
        edges = edges.unionByName(told.select(*edge(of_paper, F.col("_evidence"), F.lit("HAS_TEXT_EVIDENCE"), field, record)))
        edges = edges.unionByName(told.join(targets, same).select(*edge(F.col("_evidence"), F.col("_target"), F.lit("SUPPORTS_ENTITY_OR_MEASUREMENT"), field, record)))
    return nodes, edges


def evidence_candidates(texts: DataFrame, paper: str, text: str, field: str, seq: str, most: int | None = MOST_EVIDENCE) -> DataFrame:
    """texts without repeats: of each paper each normalised text once, where it is first by seq, and of these the first `most` (None: all).

    Normalised: lower case, white space as one space. Blank texts go. Repeats combine before the shuffle, and no more than
    `most` rows of a paper leave a task after it, so a paper with very many texts is neither one row nor a hot key.
    """
    norm = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")))
    firsts = texts.withColumn("_norm", norm).where("_norm <> ''").groupBy(paper, "_norm").agg(F.min(F.struct(F.col(seq).alias("seq"), F.col(field).alias("field"), F.col(text).alias("text"))).alias("f")).select(paper, "f.*")
    if most is None:
        return firsts
    rank = F.row_number().over(Window.partitionBy(paper).orderBy("seq", "field", "text"))
    return firsts.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def evidence_graph(found: DataFrame, paper: str, kind: str, labels: Sequence[str], relation: str, source: str, with_field: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) candidates of evidence_candidates(): a node for each text of a paper (with_field: and field), and an edge to it from its paper."""
    node = stable_id(kind, F.concat_ws("|", F.col(paper).cast("string"), *([F.col("field")] if with_field else []), F.col("text")))
    rows = found.withColumn("id", node)
    properties = _properties({"name": F.substring("text", 1, NAME_LENGTH), "evidence_text": F.col("text"), "evidence_field": F.col("field"), "source": F.lit(source)})
    nodes = _candidates(rows.withColumn("properties", properties), F.array(*map(F.lit, labels)))
    return nodes, rows.select(stable_id("Paper", F.col(paper)).alias("src"), F.col("id").alias("dst"), F.lit(relation).alias("type"), _properties({"field": F.col("field")}).alias("properties"), "seq")
