"""Schema checks against the ontology table (P16-P19, J12, SRC13).

The ontology has a handful of rows; the planner broadcasts it by its size. Where a file is given instead of the
table, three readings exist: tolerant (unreadable -> no relations), plain, and strict (cross-checked).

Defined results: a relation the ontology does not know violates nothing but is not valid either; a null type never
matches; a null triple is neither valid nor a violation; '*' accepts any type.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROVENANCE = "MENTIONED_IN"
# Closed vocabularies of the data model.
ENTITY_TYPES = ("MOF", "MetalPrecursor", "OrganicLinker", "Solvent", "SynthesisMethod", "Condition", "Property", "Application", "Paper")
RELATION_TYPES = ("USES_PRECURSOR", "USES_LINKER", "SYNTHESIZED_BY", "IN_SOLVENT", "AT_CONDITION", "HAS_PROPERTY", "MEASURED_AT", "USED_IN", "MENTIONED_IN")
CONFIDENCES = ("high", "medium", "low")


def read_ontology(spark: SparkSession, path: str, mode: str = "plain") -> DataFrame:
    """SRC13: (relation, from_type, to_type) from a JSON file; modes tolerant, plain, strict."""
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
        rows = [(name, spec.get("from"), spec.get("to")) for name, spec in data.get("relations", {}).items()]
        rows = [r for r in rows if isinstance(r[1], str) and isinstance(r[2], str)]
    except (OSError, ValueError, AttributeError):
        if mode != "tolerant":
            raise
        rows = []
    if mode == "strict":
        unknown = {r for r, _, _ in rows} - set(RELATION_TYPES)
        types = {t for _, a, b in rows for t in (a, b)} - set(ENTITY_TYPES) - {"*"}
        missing = set(RELATION_TYPES) - {r for r, _, _ in rows}
        if unknown or types or missing:
            raise ValueError(f"ontology drift: unknown relations {sorted(unknown)}, unknown types {sorted(types)}, missing {sorted(missing)}")
    return spark.createDataFrame(rows, "relation string, from_type string, to_type string")


def _with_ends(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    ends = ontology.select(F.col("relation").alias("_r"), F.col("from_type").alias("_from"), F.col("to_type").alias("_to"))
    return triples.join(ends, triples["relation"] == F.col("_r"), "left")


def violations(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Rows (relation, subject_type, object_type, ...) whose types break a known relation."""
    checked = _with_ends(triples, ontology).where(F.col("_r").isNotNull() & (F.col("_from") != "*"))
    fits = F.col("subject_type").eqNullSafe(F.col("_from")) & F.col("object_type").eqNullSafe(F.col("_to"))
    return checked.where(~fits).drop("_r", "_from", "_to")


def validity(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Adds valid and why (null when valid). Provenance is never drawn by hand."""
    j = _with_ends(triples, ontology)
    why = (
        F.when(F.col("relation") == PROVENANCE, F.lit("provenance is written by the pipeline"))
        .when(F.col("_r").isNull(), F.lit("unknown relation"))
        .when((F.col("_from") != "*") & ~F.col("subject_type").eqNullSafe(F.col("_from")), F.concat(F.lit("subject must be "), F.col("_from")))
        .when((F.col("_to") != "*") & ~F.col("object_type").eqNullSafe(F.col("_to")), F.concat(F.lit("object must be "), F.col("_to")))
    )
    return j.withColumn("why", why).withColumn("valid", F.col("why").isNull()).drop("_r", "_from", "_to")


def endpoints(ontology: DataFrame) -> DataFrame:
    """(relation, side, entity_type) that a hand-drawn triple may use."""
    sides = F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("from_type").alias("entity_type")), F.struct(F.lit("object").alias("side"), F.col("to_type").alias("entity_type"))))
    return ontology.where(F.col("relation") != PROVENANCE).select("relation", sides.alias("s")).select("relation", "s.*")


def _said(c: str) -> Column:
    return F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))


def writable(triples: DataFrame, ontology: DataFrame) -> DataFrame:
    """Adds accepted: legal ends, names, evidence and a known confidence."""
    v = validity(triples, ontology)
    ok = F.col("valid") & _said("subject_name") & _said("object_name") & _said("evidence") & F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False))
    return v.withColumn("accepted", ok)


def gold_triples(gold: DataFrame) -> DataFrame:
    """P21, SRC8: one row per gold triple, flat, with provenance; null elements are left out.

    For evaluation ``source_paper_id`` is the passage, as scores are kept per passage.
    """
    t = gold.select("line_no", "passage_id", "paper_id", "section", F.posexplode("triples").alias("triple_ix", "t")).where("t IS NOT NULL")
    return t.select(
        "line_no", "triple_ix", "passage_id", "paper_id", F.col("passage_id").alias("source_paper_id"), F.col("section").alias("source_section"), F.lit("gold").alias("extractor"),
        "t.relation", "t.subject_type", "t.subject_name", "t.object_type", "t.object_name", "t.evidence", "t.confidence",
    )


def predicted_triples(results: DataFrame) -> DataFrame:
    """SRC9: one row per predicted triple, flat."""
    t = results.select("line_no", "passage_id", "paper_id", "section_name", "extractor", F.posexplode("triples").alias("triple_ix", "t")).where("t IS NOT NULL")
    return t.select(
        "line_no", "triple_ix", "passage_id", "paper_id", F.col("passage_id").alias("source_paper_id"), F.col("section_name").alias("source_section"), "extractor",
        "t.relation", F.col("t.subject.type").alias("subject_type"), F.col("t.subject.name").alias("subject_name"), F.col("t.object.type").alias("object_type"),
        F.col("t.object.name").alias("object_name"), "t.evidence", "t.confidence",
    )
