"""Problem 6: visually identical text with different characters.

Look-alike characters are mapped to their plain spelling (``functions.lookalike``: wide, joined and one-character
forms, letters of other scripts, spaces, invisible characters), then values are grouped in SQL under the
accent-sensitive, case-sensitive ``UNICODE`` collation, under which composed and decomposed accents are equal.
Each class gets one canonical member (the least value in code point order) and it is joined back.

Long values travel only if they can matter. A class needs two different values, so a first pass reduces every value
to two 8-byte hashes, of the value and of a still coarser spelling (ASCII characters of the mapped value only), and finds
the coarse classes with two different values; that table is written once and only its hashes are shuffled. Only values
of those classes are fetched and grouped under the collation, and classes are then known by a 16-byte hash, so neither the join of
members nor a hot class carries texts.

Defined results: null and blank values belong to no class; a value alone in its class is its own canonical member;
copies of one value form no pair; texts of any length are compared whole; repeated rows count once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekg.functions.lookalike import fold_lookalikes
from passagekg.runtime import stage_table

COLLATION = "UNICODE"
_NON_BLANK = r"(?U)[^\s\x1c-\x1f\x85]"


@F.pandas_udf(T.StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_lookalikes(t))


def folded(text: Column) -> Column:
    """``text`` in its mapped form; only texts with a character beyond ASCII travel to Python. Null stays null."""
    return F.coalesce(_fold_udf(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _hashed(values: DataFrame, within: list[str]) -> DataFrame:
    """(*within, key, coarse, h) of the values that are not blank."""
    rows = values.where(F.col("value").rlike(_NON_BLANK)).withColumn("plain", folded(F.col("value")))
    return rows.select(*within, "key", _coarse(), F.xxhash64("value").alias("h"))


def _coarse() -> Column:
    return F.xxhash64(F.regexp_replace("plain", r"[^\x21-\x7E]", "")).alias("coarse")


def candidates(values: DataFrame, within: list[str] = []) -> DataFrame:  # noqa: B006
    """Of ``values`` (key, value, *within) those whose coarse class (inside ``within``) has two different values.

    Adds ``coarse`` and ``h``, which together tell values apart (16 bytes), and ``plain``, the mapped value. A key may
    state several values.
    """
    hashes = stage_table(_hashed(values, within), "same-hashes")
    by = [*within, "coarse"]
    mixed = hashes.groupBy(*by).agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select(*by)
    wanted = hashes.join(mixed, by, "left_semi").select("key", "h").distinct()
    found = values.where(F.col("value").rlike(_NON_BLANK)).withColumn("h", F.xxhash64("value")).join(wanted, ["key", "h"], "left_semi")
    return found.withColumn("plain", folded(F.col("value"))).withColumn("coarse", _coarse())


def classes(cands: DataFrame, within: list[str] = []) -> DataFrame:  # noqa: B006
    """One row per distinct value: (*within, coarse, h, class, canonical, n_values), grouped in SQL under the collation.

    The class is aggregated to its least value (combining map-side) and joined back to its members, so no class is
    ever held as a list, however many of the values it has. ``class`` is a hash of ``within`` and the least value.
    """
    on = "".join(f"v.{c} = g.{c} AND " for c in within)
    scope = "".join(f"{c}, " for c in within)
    members = cands.groupBy(*within, "coarse", "h").agg(F.min("value").alias("value"), F.min("plain").alias("plain"))
    query = f"""
        WITH grouped AS (
            SELECT {scope} min(plain) AS plain, min(value) AS canonical, count(*) AS n_values
            FROM {{members}}
            GROUP BY {scope} plain COLLATE {COLLATION}
            HAVING count(*) > 1)
        SELECT {"".join(f"v.{c}, " for c in within)} v.coarse, v.h, v.value, g.canonical, g.n_values
        FROM {{members}} v JOIN grouped g ON {on} v.plain COLLATE {COLLATION} = g.plain COLLATE {COLLATION}
    """
    return cands.sparkSession.sql(query, members=members).withColumn("class", F.unhex(F.substring(F.sha2(F.concat_ws("\n", *within, "canonical"), 256), 1, 32)))


def canonical(values: DataFrame) -> DataFrame:
    """``values`` (key, value) with ``canonical``, the class's member in which all equal-looking values agree."""
    values = values.drop("canonical", "n_values")  # result columns replace columns of their names
    found = stage_table(classes(candidates(values.select("key", "value"))).where("value <> canonical").select("h", F.col("value").alias("same"), "canonical"), "same-forms")
    hashed = values.withColumn("h", F.xxhash64("value"))
    # members are found by hash and confirmed by the value itself
    joined = hashed.join(found, (hashed["h"] == found["h"]) & (hashed["value"] == found["same"]), "left")
    return joined.select(*[hashed[c] for c in values.columns], F.coalesce("canonical", "value").alias("canonical"))


def pairs(values: DataFrame, within: list[str] = []) -> DataFrame:  # noqa: B006
    """(key_a, key_b): keys whose values look the same but differ in characters; smaller key first.

    The statement asks for the pairs, so the members of a class are joined with each other, by hashes alone; copies of one
    value are never paired with each other.
    """
    cands = stage_table(candidates(values, within), "same")
    found = classes(cands, within).select(*within, "coarse", "h", "class")
    keyed = stage_table(cands.select("key", *within, "coarse", "h").distinct().join(found, [*within, "coarse", "h"]).select("key", "h", "class"), "same-members")
    a = keyed.select("class", F.col("key").alias("key_a"), F.col("h").alias("h_a"))
    b = keyed.select("class", F.col("key").alias("key_b"), F.col("h").alias("h_b"))
    return a.join(b, "class").where((F.col("key_a") < F.col("key_b")) & (F.col("h_a") != F.col("h_b"))).select("key_a", "key_b").distinct()


def passage_values(passages: DataFrame) -> DataFrame:
    return passages.select(F.col("passage_id").alias("key"), F.col("text").alias("value"))


def endpoint_names(results: DataFrame) -> DataFrame:
    """(key, value) of every endpoint name of every results row, the key as in :func:`name_values`."""
    return results.select(F.explode(_ends()).alias("e")).select("e.key", "e.value").where("value IS NOT NULL")


def canonical_forms(passages: DataFrame, results: DataFrame) -> DataFrame:
    """(field, key, value, canonical) of passage texts and of endpoint names, each grouped over all rows.

    Names repeat, so their classes are found among the distinct names, and only forms that change are joined back.
    """
    text = canonical(passage_values(passages)).select(F.lit("text").alias("field"), "key", "value", "canonical")
    names = endpoint_names(results)
    distinct = stage_table(names.select("value").distinct().withColumn("key", F.xxhash64("value")), "names")
    forms = canonical(distinct).where("value <> canonical").select("value", "canonical")
    name = names.join(forms, "value", "left").select(F.lit("name").alias("field"), "key", "value", F.coalesce("canonical", "value").alias("canonical"))
    return text.unionByName(name)


def _ends():
    """Array of (key, value) of the endpoints of a results row."""
    def end(t, i, role):
        return F.struct(F.concat_ws(":", F.col("line_no"), F.when(i < 10, F.concat(F.lit("0"), i)).otherwise(i.cast("string")), F.lit(role[0])).alias("key"), t[role]["name"].alias("value"))

    return F.flatten(F.transform("triples", lambda t, i: F.array(end(t, i, "subject"), end(t, i, "object"))))


def name_values(results: DataFrame) -> DataFrame:
    """Endpoint names of results rows that could have an equal-looking partner in the same row.

    At least one name of such a pair has a character beyond ASCII, so rows of plain names end here.
    """
    rows = results.select("line_no", _ends().alias("ends"))
    rows = rows.where(F.exists("ends", lambda e: e["value"].rlike(r"[^\x00-\x7F]")))
    return rows.select(F.col("line_no").alias("row"), F.explode("ends").alias("e")).select("row", "e.key", "e.value")


def found_pairs(passages: DataFrame, results: DataFrame) -> DataFrame:
    """(field, key_a, key_b) for passage texts and for names within one results row."""
    text = pairs(passage_values(passages)).select(F.lit("text").alias("field"), "key_a", "key_b")
    name = pairs(name_values(results), ["row"]).select(F.lit("name").alias("field"), "key_a", "key_b")
    return text.unionByName(name)
