"""Name identity and text helpers as Column expressions.

Everything stays in the JVM except compatibility folding of text beyond ASCII, which has no builtin and is
an Arrow UDF that ASCII rows never reach. Nulls behave as empty text unless stated.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names that denote the same chemical, after folding.
SYNONYMS: dict[str, str] = {
    "h3btc": "trimesic acid",
    "btc": "trimesic acid",
    "benzene-1,3,5-tricarboxylic acid": "trimesic acid",
    "1,3,5-benzenetricarboxylic acid": "trimesic acid",
    "h2bdc": "terephthalic acid",
    "bdc": "terephthalic acid",
    "benzene-1,4-dicarboxylic acid": "terephthalic acid",
    "1,4-benzenedicarboxylic acid": "terephthalic acid",
    "hmim": "2-methylimidazole",
    "2-meim": "2-methylimidazole",
    "mim": "2-methylimidazole",
    "dmf": "n,n-dimethylformamide",
    "def": "n,n-diethylformamide",
    "dmso": "dimethyl sulfoxide",
    "dma": "n,n-dimethylacetamide",
    "thf": "tetrahydrofuran",
    "meoh": "methanol",
    "etoh": "ethanol",
    "mecn": "acetonitrile",
    "acn": "acetonitrile",
    "h2o": "water",
    "deionised water": "water",
    "deionized water": "water",
    "distilled water": "water",
    "di water": "water",
    "zn(no3)2": "zinc nitrate",
    "cu(no3)2": "copper nitrate",
    "zrcl4": "zirconium chloride",
    "fecl3": "iron chloride",
    "alcl3": "aluminium chloride",
    "aluminum chloride": "aluminium chloride",
}
# Patterns of the shared identity rule.
HYDRATE = r"\s*[.·•*x×]\s*\d*\s*h\s*2\s*o\b|\s*\b(?:mono|di|tri|tetra|penta|hexa|hepta|octa|nona|deca)?hydrate\b"
PUNCTUATION = r"""[\s\-‐-―_,;'"()\[\]{}]+"""
PARENTHETICAL = r"\s*\(([^)]*)\)\s*"
FRAMEWORK = r"^([a-z]+)\s*[-\s]?\s*(\d+[a-z]?)(.*)$"
CONDITION_UNITS = (
    (r"degrees?\s*c(?:elsius)?", "c"),
    (r"deg\s*c", "c"),
    (r"kelvin", "k"),
    (r"(?:hours?|hrs?)", "h"),
    (r"(?:minutes?|mins?)", "min"),
    (r"days?", "d"),
)
#: A word character; \\b is not used, as engines differ on joiners and marks.
WORD = r"[\p{L}\p{N}_]"
STOPWORDS = ("a", "an", "the", "of", "synthesis", "synthesised", "synthesized", "method", "route", "process", "approach", "technique")
NULL_TOKENS = ("", "na", "n/a", "none", "null", "nan", "-", "--", "unknown", "not reported")

_WHITE = r"(?U)[\s\x1c-\x1f\x85]+"


def squeeze(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, _WHITE, " "))


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f\x85]+|[\s\x1c-\x1f\x85]+$", "")


def fold_text(text: str) -> str:
    plain = unicodedata.normalize("NFKC", text).replace("°", " degrees ")
    bare = (c for c in unicodedata.normalize("NFD", plain) if unicodedata.category(c) != "Mn")
    return " ".join("".join(bare).lower().split())


@F.pandas_udf(T.StringType())
def _fold_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else fold_text(t))


def fold(text: Column) -> Column:
    """compatibility forms, degree sign, accents, case and white space unified; null gives ''."""
    beyond = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_fold_udf(beyond), squeeze(F.lower(text)), F.lit(""))


def _synonym(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])
    return F.try_element_at(table, text)


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "(?U)" + PUNCTUATION, " "))


def _dry(folded: Column) -> Column:
    """A folded name without hydrates; the pattern is tried only where it can match."""
    return F.when(folded.contains("hydrate") | folded.contains("2"), F.trim(F.regexp_replace(folded, "(?iU)" + HYDRATE, ""))).otherwise(F.trim(folded))


def _chemical(base: Column) -> Column:
    """F2 over a dry name with its synonym resolved: the bare name, then halves of "name (ABBREV)"."""
    halves = F.array_append(F.regexp_extract_all(base, F.lit(PARENTHETICAL), F.lit(1)), F.lit(None))
    halves = F.filter(F.array_prepend(halves, F.trim(F.regexp_replace(base, PARENTHETICAL, " "))), lambda h: h.isNotNull())
    known = F.filter(F.transform(halves, lambda h: F.coalesce(_synonym(F.trim(h)), _synonym(_bare(h)))), lambda k: k.isNotNull())
    half = F.when(base.contains("("), F.try_element_at(known, F.lit(1)))
    return F.coalesce(_synonym(_bare(base)), half, base)


def chemical_of(folded: Column) -> Column:
    """F2 over an already folded column: hydrates dropped, synonyms resolved, halves of "name (ABBREV)" tried."""
    dry = _dry(folded)
    return F.when(folded == "", "").otherwise(_chemical(F.coalesce(_synonym(dry), dry)))


def mof_of(folded: Column) -> Column:
    """F3 over a folded column: family-number, the number never touched."""
    return F.when(folded.rlike("(?U)" + FRAMEWORK), F.trim(F.regexp_replace(folded, "(?U)" + FRAMEWORK, "$1-$2$3"))).otherwise(folded)


def condition_of(folded: Column) -> Column:
    """F4 over a folded column: unit spellings unified, magnitudes never converted."""
    for pattern, unit in CONDITION_UNITS:
        folded = F.regexp_replace(folded, f"(?U)(?<!{WORD}){pattern}(?!{WORD})", unit)
    return squeeze(folded)


def normalize_chemical(name: Column) -> Column:
    return chemical_of(fold(name))


def normalize_mof(name: Column) -> Column:
    return mof_of(fold(name))


def normalize_condition(name: Column) -> Column:
    return condition_of(fold(name))


def normalize_by_type(kind: Column, name: Column) -> Column:
    """the identity rule of an entity type; folding runs once for all branches."""
    folded = fold(name)
    return F.when(kind == "MOF", mof_of(folded)).when(kind == "Condition", condition_of(folded)).otherwise(chemical_of(folded))


def with_key(df, kind: str, name: str, key: str):
    """Adds ``key``: the folded name, the dry name and its base are materialised as columns, each computed once a row."""
    folded, plain = F.col("_folded"), F.col(kind).isin("MOF", "Condition")
    f = df.withColumn("_folded", fold(F.col(name)))
    f = f.withColumn("_dry", F.when(~F.coalesce(plain, F.lit(False)), _dry(folded))).withColumn("_base", F.coalesce(_synonym(F.col("_dry")), "_dry"))
    k = F.when(F.col(kind) == "MOF", mof_of(folded)).when(F.col(kind) == "Condition", condition_of(folded)).when(folded == "", "").otherwise(_chemical(F.col("_base")))
    return f.withColumn(key, k).drop("_folded", "_dry", "_base")


def tokens(normal: Column) -> Column:
    """distinct letter-digit tokens without process nouns, which never leave a name empty."""
    found = F.array_distinct(F.regexp_extract_all(normal, F.lit("[a-z0-9]+"), F.lit(0)))
    kept = F.array_except(found, F.array(*[F.lit(s) for s in STOPWORDS]))
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def numbers(normal: Column) -> Column:
    """sorted multiset of digit runs."""
    return F.array_sort(F.regexp_extract_all(normal, F.lit(r"(?U)\d+(?:\.\d+)?"), F.lit(0)))


def name_similarity(a: Column, b: Column, a_tokens: Column, b_tokens: Column, a_numbers: Column, b_numbers: Column, mode: str = "exact", threshold: float = 0.6) -> Column:
    """F7 over prepared columns: 1 for equal non-empty names; relaxed adds Jaccard behind equal numbers."""
    same = (a != "") & (a == b)
    if mode == "exact":
        return F.when(same, 1.0).otherwise(0.0)
    share = F.size(F.array_intersect(a_tokens, b_tokens)) / F.size(F.array_union(a_tokens, b_tokens))
    near = (a != "") & (b != "") & (a_numbers == b_numbers) & (F.size(a_tokens) > 0) & (F.size(b_tokens) > 0) & (share >= threshold)
    return F.when(same, 1.0).when(near, share).otherwise(0.0)


def clean_values(values: Column) -> Column:
    """array of stripped values that are not null-like."""
    stripped = F.transform(F.coalesce(values, F.array().cast("array<string>")), strip)
    return F.filter(stripped, lambda v: v.isNotNull() & ~F.lower(v).isin(*NULL_TOKENS))


def elements_in(value: Column) -> Column:
    """distinct element symbols of a metal string; null-like gives an empty array."""
    text = strip(value)
    known = F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]?"), F.lit(0)))
    return F.when(text.isNull() | F.lower(text).isin("", "nan", "none"), F.array().cast("array<string>")).otherwise(known)


def slug(text: Column) -> Column:
    """lower-case token for ids; 'section' when nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", "section").otherwise(s)


def extractor_family(name: Column) -> Column:
    """rule, or the model part of provider:model:strategy."""
    return F.when(name.startswith("rule"), "rule").otherwise(F.coalesce(F.try_element_at(F.split(name, ":"), F.lit(2)), name))


def span_of(span: Column) -> Column:
    """F16: a two-element array as a struct (start, end); anything else is null."""
    pair = F.struct(F.try_element_at(span, F.lit(1)).alias("start"), F.try_element_at(span, F.lit(2)).alias("end"))
    return F.when((F.size(span) == 2) & ~F.exists(span, lambda x: x.isNull()), pair)


def phrase_regex(phrases: tuple[str, ...], left: bool = True, right: bool = True) -> str:
    """P10: pattern over literal lower-case phrases, to be applied to lower-cased text.

    A word boundary is asked for only where the phrase's edge is a letter or digit. Phrases of one kind of edge
    share one boundary and start with a look at their first letters, so most positions are rejected at once.
    """
    kinds: dict[tuple[bool, bool], list[str]] = {}
    for p in phrases:
        kinds.setdefault((left and p[0].isalnum(), right and p[-1].isalnum()), []).append(p)
    parts = []
    for (before, after), group in kinds.items():
        literal = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}&#~-])", r"\\\1", p) for p in group)
        first = "".join(sorted({re.sub(r"([\\\]\[^&-])", r"\\\1", p[0]) for p in group}))
        parts.append(f"(?=[{first}])" + (f"(?<!{WORD})" if before else "") + f"(?:{literal})" + (f"(?!{WORD})" if after else ""))
    return "|".join(parts)
