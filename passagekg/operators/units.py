"""Problem 5: quantities recorded in different units -> one base unit per quantity.

1. ``measurements``: a vectorised parser finds every number (ranges, clock times, number words, powers of ten,
   decimal commas) with the raw spelling that follows it. Narrow: no shuffle.
2. ``unit_aliases``: the *distinct* spellings are mapped to known units through a character n-gram inverted
   index, whose candidates are verified by weighted edit distance. The result is the alias dictionary.
3. ``to_base``: the dictionary is joined to all measurements and values are converted by Catalyst expressions.

The dictionary has one row per distinct spelling, so AQE broadcasts it while it is small and otherwise splits
the hot spelling (``h`` may hold a third of the rows) as a skewed join; nothing is collected.

Defined results: null, blank and unit-less names give no row; a spelling near no known unit gives no row in
``to_base`` and is reported by ``unknown_units``; a percentage counts only where the text speaks of a yield;
very long names are parsed whole; repeated rows give one row each per line.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekg.functions.lookalike import plain_text
from passagekg.runtime import stage_table

#: Quantity, scale, offset (base = value * scale + offset) and accepted spellings of each unit.
UNITS: dict[str, tuple[str, float, float, tuple[str, ...]]] = {
    "degC": ("temperature", 100.0, 0.0, ("°C", "C", "oC", "deg C", "degC", "degree C", "degrees C", "degree Celsius", "degrees Celsius", "celsius", "centigrade", "º C", "deg. C", "° C")),
    "kelvin": ("temperature", 100.0, -27315.0, ("K", "kelvin", "kelvins", "°K", "deg K", "degrees K", "degrees Kelvin")),
    "degF": ("temperature", 500.0 / 9.0, -16000.0 / 9.0, ("°F", "F", "oF", "deg F", "degF", "degree F", "degrees F", "degree Fahrenheit", "degrees Fahrenheit", "fahrenheit", "° F", "deg. F")),
    "s": ("time", 1.0, 0.0, ("s", "sec", "secs", "second", "seconds")),
    "min": ("time", 60.0, 0.0, ("min", "mins", "minute", "minutes", "min.")),
    "h": ("time", 3600.0, 0.0, ("h", "hr", "hrs", "hour", "hours", "h.", "hr.")),
    "d": ("time", 86400.0, 0.0, ("d", "day", "days")),
    "week": ("time", 604800.0, 0.0, ("week", "weeks", "wk", "wks")),
    "Pa": ("pressure", 1.0, 0.0, ("Pa", "pascal", "pascals")),
    "hPa": ("pressure", 100.0, 0.0, ("hPa", "hectopascal", "mbar", "millibar", "millibars")),
    "kPa": ("pressure", 1000.0, 0.0, ("kPa", "kilopascal", "kilopascals")),
    "mPa": ("pressure", 1e-3, 0.0, ("mPa", "millipascal", "millipascals")),
    "MPa": ("pressure", 1e6, 0.0, ("MPa", "megapascal", "megapascals")),
    "GPa": ("pressure", 1e9, 0.0, ("GPa", "gigapascal", "gigapascals")),
    "bar": ("pressure", 1e5, 0.0, ("bar", "bars")),
    "atm": ("pressure", 101325.0, 0.0, ("atm", "atmosphere", "atmospheres")),
    "torr": ("pressure", 101325.0 / 760.0, 0.0, ("Torr", "torr", "mmHg", "mm Hg", "millimetres of mercury")),
    "psi": ("pressure", 6894.757, 0.0, ("psi", "psia", "lb/in2", "pounds per square inch")),
    "m2/g": ("surface_area", 1.0, 0.0, ("m2/g", "m2 per g", "square metres per gram", "square meters per gram", "sq m/g")),
    "m2/kg": ("surface_area", 1e-3, 0.0, ("m2/kg", "m2 per kg", "square metres per kilogram", "square meters per kilogram")),
    "m2/mg": ("surface_area", 1e3, 0.0, ("m2/mg", "m2 per mg", "square metres per milligram")),
    "cm2/g": ("surface_area", 1e-4, 0.0, ("cm2/g", "cm2 per g", "square centimetres per gram")),
    "cm3/g": ("pore_volume", 1e3, 0.0, ("cm3/g", "cc/g", "mL/g", "L/kg", "dm3/kg", "ccm/g", "cm3 per g", "cubic centimetres per gram", "cubic centimeters per gram", "millilitres per gram", "litres per kilogram")),
    "mm3/g": ("pore_volume", 1.0, 0.0, ("mm3/g", "μL/g", "uL/g", "cm3/kg", "mL/kg", "cubic millimetres per gram", "microlitres per gram")),
    "m3/kg": ("pore_volume", 1e6, 0.0, ("m3/kg", "cubic metres per kilogram", "L/g")),
    "percent": ("yield", 10.0, 0.0, ("%", "percent", "per cent", "pct")),
    "permille": ("yield", 1.0, 0.0, ("per mille", "‰", "permille", "promille")),
    "fraction": ("yield", 1000.0, 0.0, ("fraction", "as a fraction")),
}
#: Number words.
_ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WORDS = {w: i for i, w in enumerate(_ONES)} | {w: 20 + 10 * i for i, w in enumerate(_TENS)}
WORDS |= {f"{t}-{o}": 20 + 10 * i + j for i, t in enumerate(_TENS) for j, o in enumerate(_ONES) if 0 < j < 10}
RELATIONS = ("AT_CONDITION", "MEASURED_AT", "HAS_PROPERTY")
#: Longest weighted edit distance accepted, per character of the known spelling.
FUZZ = 0.17
#: Words that a leading part of a spelling may have: those of the longest known spelling, and one more for a word written apart.
MOST_WORDS = 1 + max(len(x.split()) for *_, names in UNITS.values() for x in names)

_WORD = re.compile(r"\b(" + "|".join(sorted(WORDS, key=len, reverse=True)) + r")\b(?=[ -]*[a-z])", re.I)
_N = r"[+-]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+|\.(?= ?[^\W\d]))?|\.\d+)(?:[eE][+-]?\d+(?![\d.])| ?[×x*·] ?10 ?\^ ?[+-]?\d+)?"
_STOP = r"(?= ?(?:[,;()\[\]]| / |\b(?:at|for|and|to|under|in|with|over|by|then|of|followed|after|or)\b|$))"
_TIME = r"(?:h|hr|hrs|hours?)"
_MEASURE = re.compile(
    rf"(?<![\w.^])(?:(?P<ch>\d{{1,3}}):(?P<cm>[0-5]\d)(?::[0-5]\d)? ?{_TIME}\b"
    rf"|(?P<dh>\d+(?:\.\d+)?) ?{_TIME}\.? ?(?:and )?(?P<dm>\d{{1,2}}(?:\.\d+)?) ?(?:min|mins|minutes?)\b"
    rf"|(?P<a>{_N})(?: ?(?:-|to|and|or) ?(?P<b>{_N}))? ?(?P<u>[^\W\d_]|[°º%‰])(?P<v>[^,;()\[\]]*?){_STOP})",
    re.I,
)
_NOTE = re.compile(r"\((?![^)]*\bfraction\b)[^()\d]*\)")
_PER = re.compile(r"(?<=[a-z0-9]) ?[·.* ]? ?(kg|mg|g) ?\^? ?-1\b", re.I)
_POWER = re.compile(r"(?<=m) ?\^ ?(?=[23])")


def spelled(raw: str) -> str:
    """A unit's raw spelling without differences of notation: ``m^2 g-1`` -> ``m2/g``."""
    raw = _PER.sub(r"/\1", _POWER.sub("", raw))
    return re.sub(r" ?/ ?", "/", raw).strip(" .:=-")


def _number(text: str, unit: str) -> float:
    m = re.match(r"([^eE×x*· ]+)(?:[eE]([+-]?\d+)| ?[×x*·] ?10 ?\^ ?([+-]?\d+))?$", text)
    body, power = m[1], int(m[2] or m[3] or 0)
    if "," in body:
        groups = re.fullmatch(r"[+-]?[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", body)
        small = re.match(r"(?:cm3|cc|ml|l)\b", unit, re.I) and body.count(",") == 1 and "." not in body and len(body.split(",")[0].lstrip("+-")) == 1
        body = body.replace(",", "") if groups and not small else body.replace(",", ".")
    return float(f"{body}e{power}")


def parse(name: str) -> list[tuple[float, str]]:
    """(value, unit spelling) of every number with something like a unit in ``name``."""
    text = plain_text(name)
    about_yield = "yield" in text.lower()
    text = re.sub(r"\( ?(?:as an? )?fraction ?\)", "fraction", text, flags=re.I)
    text = _NOTE.sub("", text)
    text = _WORD.sub(lambda m: str(WORDS[m[1].lower()]), text)
    out: list[tuple[float, str]] = []
    for m in _MEASURE.finditer(text):
        if m["ch"]:
            out.append((int(m["ch"]) + int(m["cm"]) / 60, "h"))
        elif m["dh"]:
            out.append((float(m["dh"]) + float(m["dm"]) / 60, "h"))
        else:
            unit = spelled(m["u"] + m["v"])
            if re.match(r"(%|‰|per ?cent|percent|pct|per ?mille|promille|fraction)", unit, re.I):
                unit = re.sub(r" ?(isolated|overall|total)? ?yield.*$", "", unit, flags=re.I).strip()
                if not about_yield:
                    continue
            if unit:
                out += [(_number(x, unit), unit) for x in (m["a"], m["b"]) if x]
    return out


_MEASURES = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType())]))


@F.pandas_udf(_MEASURES)
def _parse_udf(names: pd.Series) -> pd.Series:
    cached = lru_cache(maxsize=65536)(parse)
    return names.map(lambda n: None if n is None else [{"value": v, "unit": u} for v, u in cached(n)])


def quantity_names(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(src, line_no, triple_ix, name) of the object names that may state a quantity."""
    wanted = F.upper(F.trim(F.col("t.relation"))).isin(*RELATIONS)
    r = results.select(F.lit("results").alias("src"), F.col("line_no").cast("bigint").alias("line_no"), F.posexplode("triples").alias("triple_ix", "t"))
    g = gold.select(F.lit("gold").alias("src"), F.col("line_no").cast("bigint").alias("line_no"), F.posexplode("triples").alias("triple_ix", "t"))
    r = r.where(wanted).select("src", "line_no", "triple_ix", F.col("t.object.name").alias("name"))
    g = g.where(wanted).select("src", "line_no", "triple_ix", F.col("t.object_name").alias("name"))
    return r.unionByName(g)


def measurements(names: DataFrame) -> DataFrame:
    """Every (value, raw unit spelling) of ``names``; other columns are kept unless a result column has their name."""
    keys = [c for c in names.columns if c not in ("name", "value", "unit", "base_unit", "quantity", "scale", "shift", "distance", "value_base")]
    # a digit or a number word is necessary, so other names never reach Python
    stating = F.col("name").rlike(r"(?iU)\d|\p{N}|" + "|".join(_ONES[1:] + _TENS)) | F.col("name").rlike(r"[^\x00-\x7F]")
    return names.where(stating).select(*keys, F.explode(_parse_udf("name")).alias("m")).select(*keys, "m.value", "m.unit")


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


_CHEAP = {frozenset(p) for p in ("ck", "ei", "ae", "sz", "yi", "ou")}


def weighted_distance(a: str, b: str) -> float:
    """Edit distance; a swap of neighbours, a doubled letter or a look-alike vowel costs half."""
    rows: list[list[float]] = [[float(j) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            put = 0.5 if j > 1 and y == b[j - 2] else 1.0
            cut = 0.5 if i > 1 and x == a[i - 2] else 1.0
            change = 0.0 if x == y else 0.5 if frozenset((x, y)) in _CHEAP else 1.0
            best = min(rows[i - 1][j] + cut, row[j - 1] + put, rows[i - 1][j - 1] + change)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[i - 2][j - 2] + 0.5)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


@F.pandas_udf(T.DoubleType())
def _distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_distance(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


def unit_table(spark: SparkSession) -> DataFrame:
    """Known spellings: (spelling, base_unit, quantity, scale, shift). Size fixed by ``UNITS``."""
    rows = [(spelled(s), unit, q, scale, shift) for unit, (q, scale, shift, names) in UNITS.items() for s in names]
    return spark.createDataFrame(rows, "spelling string, base_unit string, quantity string, scale double, shift double").dropDuplicates(["spelling"])


def unit_aliases(measures: DataFrame) -> DataFrame:
    """Alias dictionary (unit, base_unit, quantity, scale, shift, distance): one row per distinct known spelling.

    Every leading part of a spelling is a candidate (``h under N2`` -> ``h``), longest first; a part of more words than any
    known spelling has cannot be one. Case decides between spellings that differ in nothing else (``mPa``, ``MPa``); words of
    letters may differ by ``FUZZ`` per character, which is less than the cheapest edit below five letters: shorter
    spellings (``h``, ``bar``) are a letter away from other units and are only taken as they are.
    """
    spark = measures.sparkSession
    known = F.broadcast(unit_table(spark))  # fixed size
    spellings = measures.groupBy("unit").agg(F.count("*").alias("n"))
    words = F.split("unit", " ")
    parts = spellings.select("unit", F.posexplode(F.transform(F.sequence(F.lit(1), F.least(F.size(words), F.lit(MOST_WORDS))), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("cut", "part"))
    exact = parts.join(known, F.lower("part") == F.lower("spelling")).select(
        "unit", "cut", "spelling", "base_unit", "quantity", "scale", "shift", F.when(F.col("part") == F.col("spelling"), 0.0).otherwise(0.01).alias("distance")
    )
    # inverted index over letter-only spellings of five letters or more
    lettered = parts.where(F.col("part").rlike("^[A-Za-z ]{5,}$"))
    index = F.broadcast(known.where(F.col("spelling").rlike("^[A-Za-z ]{5,}$")).withColumn("gram", F.explode(_grams(F.col("spelling")))))
    hits = lettered.select("unit", "cut", "part", F.explode(_grams(F.col("part"))).alias("gram")).join(index, "gram")
    shared = hits.groupBy("unit", "cut", "part", "spelling", "base_unit", "quantity", "scale", "shift").agg(F.count("*").alias("shared"))
    near = shared.where(F.col("shared") >= F.greatest(F.lit(2), (F.length("spelling") - 6) / 2))
    fuzzy = near.withColumn("distance", _distance_udf("part", "spelling")).where(F.col("distance") <= FUZZ * F.length("spelling"))
    found = exact.unionByName(fuzzy.select(exact.columns))
    best = F.min_by(F.struct("base_unit", "quantity", "scale", "shift", "distance"), F.struct(-F.col("cut"), "distance", "spelling"))
    return found.groupBy("unit").agg(best.alias("b")).select("unit", "b.*")


def base_value() -> Column:
    return F.round(F.round(F.col("value") * F.col("scale") + F.col("shift"), 6)).cast("bigint")


def to_base(measures: DataFrame) -> DataFrame:
    """``measures`` with quantity and value_base (BIGINT, rounded); rows of unknown units are left out."""
    return measures.join(unit_aliases(measures), "unit").withColumn("value_base", base_value())


def unknown_units(measures: DataFrame) -> DataFrame:
    """Report: spellings after a number that no known unit explains, with their counts."""
    return measures.groupBy("unit").agg(F.count("*").alias("n_rows")).join(unit_aliases(measures).select("unit"), "unit", "left_anti")


def converted(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(src, line_no, triple_ix, quantity, value_base), distinct."""
    measures = stage_table(measurements(quantity_names(results, gold)), "measures")
    return to_base(measures).select("src", "line_no", "triple_ix", "quantity", "value_base").distinct()
