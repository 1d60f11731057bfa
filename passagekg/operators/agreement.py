"""Record agreement with a reference (A8, J9, J10) over long records (paper_id, field, values).

Long form keeps the schema open: a field is a row, not a column. Values are cleaned and normalised once; exact
agreement is set equality, relaxed agreement a one-to-one matching of the two small value sets.

Defined results: a field without reference values is not comparable; a field only we lack is a disagreement; a
paper without reference record is counted as missing; a rate over nothing is NULL, never 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagekg.functions import text as tx

# Entity type of a record field; others normalise as chemicals.
FIELD_TYPES = {"mof": "MOF", "metal_precursor": "MetalPrecursor", "linker": "OrganicLinker", "solvent": "Solvent", "synthesis_method": "SynthesisMethod", "temperature": "Condition", "time": "Condition"}


def _field_type(field: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_TYPES.items() for x in kv]), field), F.lit("Chemical"))


def prepared(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, paper_id, field, raw, keys): cleaned values and their distinct non-empty normal forms."""
    key = [*by, "paper_id", "field"]
    cleaned = records.groupBy(*key).agg(F.flatten(F.collect_list(tx.clean_values(F.col("values")))).alias("raw"))
    rows = cleaned.select(*key, F.explode("raw").alias("value"), _field_type(F.col("field")).alias("kind"))
    keys = tx.with_key(rows, "kind", "value", "key").where("key <> ''").groupBy(*key).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return cleaned.join(keys, key, "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))


def _relaxed_matches(ours: Column, theirs: Column, threshold: float) -> Column:
    """How many values pair up one to one, best similarity first."""
    prep = lambda k: F.struct(k.alias("k"), tx.tokens(k).alias("t"), tx.numbers(k).alias("n"))
    pairs = F.flatten(
        F.transform(
            F.transform(ours, prep),
            lambda a: F.transform(F.transform(theirs, prep), lambda b: F.struct((-tx.name_similarity(a["k"], b["k"], a["t"], b["t"], a["n"], b["n"], "relaxed", threshold)).alias("neg"), b["k"].alias("b"), a["k"].alias("a"))),
        )
    )
    ordered = F.array_sort(F.filter(pairs, lambda p: p["neg"] < 0))
    empty = F.array().cast("array<struct<neg:double,b:string,a:string>>")
    kept = F.aggregate(ordered, empty, lambda acc, p: F.when(F.exists(acc, lambda q: (q["a"] == p["a"]) | (q["b"] == p["b"])), acc).otherwise(F.array_append(acc, p)))
    return F.size(kept)


def compared(ours: DataFrame, reference: DataFrame, mode: str = "exact", threshold: float = 0.6, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, paper_id, field, verdict, overlap, ours, reference) for every paper of ours and every known field.

    ``by`` are further key columns of ours (no nulls), such as the extractor; the reference is the same for all.
    """
    o, r = prepared(ours, by), prepared(reference)
    fields = ours.select("field").union(reference.select("field")).distinct()
    grid = ours.select(*by, "paper_id").distinct().crossJoin(F.broadcast(fields))  # field names: a handful
    a = o.select(*by, "paper_id", "field", F.col("raw").alias("ours"), F.col("keys").alias("a"))
    b = r.select("paper_id", "field", F.col("raw").alias("reference"), F.col("keys").alias("b"))
    j = grid.join(a, [*by, "paper_id", "field"], "left").join(b, ["paper_id", "field"], "left")
    none = F.array().cast("array<string>")
    j = j.withColumns({c: F.coalesce(c, none) for c in ("a", "b", "ours", "reference")})
    matched = F.size(F.array_intersect("a", "b")) if mode == "exact" else _relaxed_matches(F.col("a"), F.col("b"), threshold)
    j = j.withColumn("m", matched)
    agree = (F.col("m") == F.size("a")) & (F.col("m") == F.size("b")) & (F.size("b") > 0)
    verdict = F.when(F.size("reference") == 0, "not_comparable").when(agree, "agree").otherwise("disagree")
    union = F.size("a") + F.size("b") - F.col("m")
    return j.withColumn("verdict", verdict).select(*by, "paper_id", "field", "verdict", F.when(union > 0, F.round(F.col("m") / union, 6)).otherwise(0.0).alias("overlap"), "ours", "reference")


def report(compared: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per field (and ``by``) comparable, agreed, disagreed, not_comparable and the rate (NULL without comparable)."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1))
    g = compared.groupBy(*by, "field").agg(n("agree").alias("agreed"), n("disagree").alias("disagreed"), n("not_comparable").alias("not_comparable"))
    total = F.col("agreed") + F.col("disagreed")
    return g.select(*by, "field", total.alias("comparable"), "agreed", "disagreed", "not_comparable", F.when(total > 0, F.round(F.col("agreed") / total, 6)).alias("agreement_rate"))


def disagreements(compared: DataFrame) -> DataFrame:
    return compared.where("verdict = 'disagree'").drop("verdict")


def missing_records(ours: DataFrame, reference: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Papers of ours without any reference record: one row, or one per ``by`` (0 where none is missing)."""
    if by:
        known = reference.select("paper_id").distinct().withColumn("known", F.lit(True))
        return ours.select(*by, "paper_id").distinct().join(known, "paper_id", "left").groupBy(*by).agg(F.count(F.when(F.col("known").isNull(), 1)).alias("n_missing"))
    left = ours.select("paper_id").distinct().join(reference.select("paper_id").distinct(), "paper_id", "left_anti")
    return left.agg(F.count("*").alias("n_missing"))
