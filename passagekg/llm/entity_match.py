"""Problem 4: gold preparations <-> merged rows that describe the same preparation, without a common key.

Both sources become *entries* (metal, linker, temperature, time, yield, solvents) with names brought to the reference
list and quantities to base units. Sorted neighbourhood over three composite sort keys finds candidates:

    metal | linker | time  | yield        metal | linker | yield | temperature        metal | linker | time | temperature

The window that slides over the last part of a key is bounded by value (the tolerance), not by a number of rows, so no
neighbour within tolerance is ever lost and none beyond it is looked at. It runs as a banded join: the sort order is cut
into stretches of the last part, each gold entry is in one stretch, and a merged row is in every stretch its window
reaches. Only gold entries probe, nothing is listed per row, and ties cost no more than the pairs they are. Each of the three
keys compares its neighbours at once by weighted field similarities (``confidence``); ``one_to_one`` then assigns each side at
most one partner, maximising total confidence: contested pairs fall into connected components, and each is solved
exactly by shortest augmenting paths, whatever the size of the whole.

Defined results: entries without metal or linker, or with fewer than two of the three quantities, have no candidate;
a value null on one side is not compared; ranges and repeated statements count as several values of which any may
agree; repeated rows count once per (passage_id, refcode); blank refcodes and passage ids give nothing.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekg.functions.lookalike import plain_text
from passagekg.llm import canonical
from passagekg.operators import units
from passagekg.runtime import stage_table

TEMPERATURE_TOLERANCE = 60  # in 0.01 degrees C
#: Length of a stretch of temperatures that one window holds.
STRETCH = 500
#: Composite sort keys: (leading parts, last part, tolerance of its window, length of a stretch).
KEYS = (
    (["metal", "linker", "time"], "yield", 0, 1),
    (["metal", "linker", "yield"], "temperature", TEMPERATURE_TOLERANCE, STRETCH),
    (["metal", "linker", "time"], "temperature", TEMPERATURE_TOLERANCE, STRETCH),
)
#: Weights of the field similarities.
WEIGHTS = {"temperature": 0.3, "time": 0.25, "yield": 0.25, "solvents": 0.1, "linker": 0.1}
#: Contested edges up to which components are found and solved in one place; beyond, by Spark, with the same result.
LOCAL_EDGES = 20_000

_SHORTHAND = T.StructType([T.StructField("metal", T.StringType()), T.StructField("name", T.StringType())])
_WORDING = re.compile(r"^(?:as-synthesi[sz]ed|as-made|activated|nano|pristine|desolvated)[ -]|[ -](?:crystals?|powders?|framework|sample)$", re.I)


def _shorthand_udf(symbols: dict[str, str]):
    """Subject names such as ``activated Zn-MIM`` read as (metal symbol, linker wording)."""
    by_case = {s.lower(): s for s in symbols}

    def read(name: str | None) -> tuple[str | None, str | None]:
        text = _WORDING.sub("", _WORDING.sub("", plain_text(name or "")))
        m = re.fullmatch(r"([A-Za-z]{1,2}) ?[-_ ] ?(.+)", text)
        metal = m and by_case.get(m[1].lower())
        return (metal, m[2]) if metal else (None, None)

    @F.pandas_udf(_SHORTHAND)
    def shorthand(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(n) for n in names], columns=["metal", "name"])

    return shorthand


def _gold_triples(gold: DataFrame) -> DataFrame:
    t = gold.where((F.lower("status") == "annotated") & F.trim("passage_id").rlike(".")).select("line_no", "passage_id", F.posexplode("triples").alias("ix", "t"))
    return t.where("t IS NOT NULL").select("line_no", "passage_id", "ix", F.upper(F.trim("t.relation")).alias("relation"), F.col("t.subject_name").alias("subject"), F.col("t.object_name").alias("object"))


def gold_entries(gold: DataFrame, canon: DataFrame, symbols: DataFrame, shared=None) -> DataFrame:
    """(line_no, passage_id, metal, linker, linker_distance, temperatures, times, yields, solvents)."""
    triples = _gold_triples(gold)
    objects = triples.where(F.col("relation").isin("USES_PRECURSOR", "USES_LINKER", "IN_SOLVENT") & F.col("object").isNotNull())
    objects = objects.select("line_no", "ix", "relation", F.lit(None).cast("string").alias("said_metal"), F.col("object").alias("name"))
    read = _shorthand_udf(canonical.symbol_table(symbols))
    subjects = triples.where("subject IS NOT NULL").select("line_no", "ix", F.lit("subject").alias("relation"), read("subject").alias("s")).where("s.metal IS NOT NULL")
    named = objects.unionByName(subjects.select("line_no", "ix", "relation", F.col("s.metal").alias("said_metal"), "s.name"))
    named = canonical.mapped(named, canon, symbols, shared, F.col("relation") != "subject")  # shorthand is read exactly
    kinds = canon.select("canon_id", "entity_type", F.split("canonical_name", " ")[0].alias("element"), "pubchem_cid").join(symbols.select("symbol", "element"), "element", "left")
    known = named.join(kinds, "canon_id")  # left to the planner, which broadcasts the list while it is small
    first = lambda cond, value: F.min_by(value, F.when(cond, F.col("ix")))
    is_metal = (F.col("relation") == "USES_PRECURSOR") & (F.col("entity_type") == "MetalPrecursor")
    is_linker = (F.col("relation") == "USES_LINKER") & (F.col("entity_type") == "OrganicLinker")
    is_subject = (F.col("relation") == "subject") & (F.col("distance") == 0)
    names = known.groupBy("line_no").agg(
        first(is_metal, F.col("symbol")).alias("metal"), first(is_linker, F.col("canon_id")).alias("linker"), first(is_linker, F.col("distance")).alias("linker_distance"),
        first(is_subject, F.col("said_metal")).alias("s_metal"), first(is_subject, F.col("canon_id")).alias("s_linker"),
        F.array_distinct(F.collect_list(F.when(F.col("relation") == "IN_SOLVENT", F.col("pubchem_cid")))).alias("solvents"),
    )
    stated = triples.where(F.col("relation").isin("AT_CONDITION", "HAS_PROPERTY")).select("line_no", F.col("object").alias("name"))
    measures = stage_table(units.measurements(stated), "gold-measures")
    base = units.to_base(measures)
    values = lambda q: F.array_sort(F.collect_set(F.when(F.col("quantity") == q, F.col("value_base"))))
    quantities = base.groupBy("line_no").agg(values("temperature").alias("temperatures"), values("time").alias("times"), values("yield").alias("yields"))
    lines = triples.select("line_no", "passage_id").distinct()
    joined = lines.join(names, "line_no", "left").join(quantities, "line_no")
    return joined.select(
        "line_no", "passage_id", F.coalesce("metal", "s_metal").alias("metal"), F.coalesce("linker", "s_linker").alias("linker"), F.coalesce("linker_distance", F.lit(0.0)).alias("linker_distance"),
        "temperatures", "times", "yields", F.coalesce("solvents", F.array().cast("array<bigint>")).alias("solvents"),
    ).where("metal IS NOT NULL AND linker IS NOT NULL")


def merged_entries(merged: DataFrame, canon: DataFrame, symbols: DataFrame, shared=None) -> DataFrame:
    """(refcode, metal, linker, linker_distance, temperature, time, yield, solvents), one per distinct row."""
    refcode = F.upper(F.regexp_replace("refcode", r"(?U)^\s+|\s+$", ""))
    metal = F.trim(F.coalesce("metal_ele1", "metal"))
    percent = F.regexp_extract(F.regexp_replace("yield_percent", ",", "."), r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    solvents = F.array(*[F.col(f"solvent{i}").cast("bigint") for i in range(1, 6)])
    rows = merged.select(
        refcode.alias("refcode"), F.when(~F.lower(metal).isin("0", "nan", "none", "null", ""), metal).alias("metal"), F.col("clean_linker_1").alias("name"),
        F.round(F.nanvl(F.col("temperature_celsius"), F.lit(None).cast("double")) * 100).cast("bigint").alias("temperature"),
        F.round(F.nanvl(F.col("time_h"), F.lit(None).cast("double")) * 3600).cast("bigint").alias("time"), F.round(percent * 10).cast("bigint").alias("yield"),
        F.array_sort(F.array_distinct(F.filter(solvents, lambda s: s.isNotNull()))).alias("solvents"),
    ).where("refcode <> '' AND metal IS NOT NULL AND name IS NOT NULL").distinct()
    found = canonical.mapped(rows, canon, symbols, shared).where("canon_id > 0").withColumnRenamed("canon_id", "linker").withColumnRenamed("distance", "linker_distance")
    linkers = canon.where("entity_type = 'OrganicLinker'").select(F.col("canon_id").alias("linker"))
    return found.join(linkers, "linker").select("refcode", "metal", "linker", "linker_distance", "temperature", "time", "yield", "solvents")


def _neighbours(gold: DataFrame, merged: DataFrame, key: list[str], last: str, tolerance: int, stretch: int) -> DataFrame:
    """Gold entries (g_ columns) beside the merged rows (m_ columns) within ``tolerance`` of them in the sort order key | last.

    The sort order is cut into stretches of the last part; a merged row is put into each stretch that its window
    reaches, so no window misses a neighbour, and a pair meets in the one stretch of its gold entry.
    """
    stated = lambda side: " AND ".join(f"`{side}_{c}` IS NOT NULL" for c in [*key, last])
    at = lambda c, shift: F.floor((F.col(c) + shift) / stretch)
    g = gold.where(stated("g")).withColumn("stretch", at(f"g_{last}", 0))
    m = merged.where(stated("m")).withColumn("stretch", F.explode(F.sequence(at(f"m_{last}", -tolerance), at(f"m_{last}", tolerance))))
    for c in key:
        g, m = g.withColumn(f"k_{c}", F.col(f"g_{c}")), m.withColumn(f"k_{c}", F.col(f"m_{c}"))
    keys = [*(f"k_{c}" for c in key), "stretch"]
    return g.join(m, keys).where(F.abs(F.col(f"g_{last}") - F.col(f"m_{last}")) <= tolerance).drop(*keys)


def _judged(pairs: DataFrame) -> DataFrame:
    """(passage_id, refcode, n_agree, n_disagree, confidence) of neighbours, by weighted field similarities."""

    def verdict(values: str, value: str, tolerance: int):
        both = (F.size(values) > 0) & F.col(value).isNotNull()
        return F.when(both, F.exists(values, lambda v: F.abs(v - F.col(value)) <= tolerance))

    same = [verdict("temperatures", "m_temperature", TEMPERATURE_TOLERANCE), verdict("times", "m_time", 0), verdict("yields", "m_yield", 0)]
    j = pairs.withColumns(dict(zip(("same_0", "same_1", "same_2"), same, strict=True)))
    same = [F.col(f"same_{i}") for i in range(3)]
    count = lambda value: sum((F.when(c == value, 1).otherwise(0) for c in same[1:]), F.when(same[0] == value, 1).otherwise(0))
    union = F.size(F.array_union("g_solvents", "m_solvents"))
    solvents = F.when((F.size("g_solvents") > 0) & (F.size("m_solvents") > 0), F.size(F.array_intersect("g_solvents", "m_solvents")) / union)
    linker = 1 - 0.5 * F.least(F.coalesce("g_distance", F.lit(0.0)) + F.coalesce("m_distance", F.lit(0.0)), F.lit(1.0))
    scored = {"temperature": same[0].cast("double"), "time": same[1].cast("double"), "yield": same[2].cast("double"), "solvents": solvents, "linker": linker}
    # a field that one side does not state counts half: it neither speaks for nor against the pair
    confidence = sum((F.lit(WEIGHTS[k]) * F.coalesce(v, F.lit(0.5)) for k, v in scored.items()), F.lit(0.0))
    return j.select("passage_id", "refcode", count(True).alias("n_agree"), count(False).alias("n_disagree"), F.round(confidence, 4).alias("confidence"))


def compared(gold: DataFrame, merged: DataFrame) -> DataFrame:
    """(passage_id, refcode, n_agree, n_disagree, confidence) of every neighbour of every gold entry.

    A pair may come from more than one key (and value of a gold entry), always with the same judgement.
    """
    values = ("temperature", "time", "yield")
    keep = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("bigint")))
    g = gold.select(
        "passage_id", F.col("metal").alias("g_metal"), F.col("linker").alias("g_linker"), "temperatures", "times", "yields", F.col("solvents").alias("g_solvents"), F.col("linker_distance").alias("g_distance")
    )
    m = merged.select("refcode", *[F.col(c).alias(f"m_{c}") for c in ("metal", "linker", *values, "solvents")], F.col("linker_distance").alias("m_distance"))
    found = None
    for key, last, tolerance, stretch in KEYS:
        stated = g
        for v in [c for c in [*key, last] if c in values]:
            stated = stated.withColumn(f"g_{v}", F.explode(keep(f"{v}s")))
        pairs = _judged(_neighbours(stated, m, key, last, tolerance, stretch))
        found = pairs if found is None else found.unionByName(pairs)
    return found


def matches(gold: DataFrame, merged: DataFrame, canon: DataFrame, symbols: DataFrame) -> DataFrame:
    """(passage_id, refcode, confidence): pairs of which at least two quantities agree and none disagrees."""
    shared = canonical.dictionary(canon, symbols)
    g = stage_table(gold_entries(gold, canon, symbols, shared), "gold-entries")
    m = stage_table(merged_entries(merged, canon, symbols, shared), "merged-entries")
    good = compared(g, m).where("n_agree >= 2 AND n_disagree = 0")
    return good.groupBy("passage_id", "refcode").agg(F.max("confidence").alias("confidence"))


def auction(edges: list[tuple[str, str, float]], step: float) -> dict[str, str]:
    """Assignment maximising total confidence up to ``step`` per pair, by bids: a check of :func:`assignment`."""
    options: dict[str, list[tuple[str, float]]] = {}
    for a, b, c in sorted(edges):
        options.setdefault(a, []).append((b, c))
    price: dict[str, float] = {}
    owner: dict[str, str] = {}
    waiting = sorted(options)
    while waiting:
        a = waiting.pop()
        net = sorted(((c - price.get(b, 0.0), b) for b, c in options[a]), key=lambda x: (-x[0], x[1]))
        if net[0][0] <= 0:
            continue
        best, b = net[0]
        second = max(net[1][0], 0.0) if len(net) > 1 else 0.0
        price[b] = price.get(b, 0.0) + best - second + step
        if b in owner:
            waiting.append(owner[b])
        owner[b] = a
    return {a: b for b, a in owner.items()}


def assignment(edges: Iterable[tuple[str, str, float]]) -> dict[str, str]:
    """Assignment of greatest total confidence, exact; edges (left, right, confidence), each pair once.

    Lefts are added one by one along the shortest augmenting path under prices (Dijkstra over reduced costs); a path
    ends at a free right or at a left that is better left without partner. Whole numbers, so nothing is rounded.
    """
    options: dict[str, list[tuple[str, int]]] = {}
    for a, b, c in sorted(edges):
        if c > 0:
            options.setdefault(a, []).append((b, round(c * 10**12)))
    price: dict[str, int] = {}
    gain: dict[str, int] = {}
    owner: dict[str, str] = {}
    partner: dict[str, str] = {}
    for new in options:
        gain[new] = max(0, max(w - price.get(b, 0) for b, w in options[new]))
        reached: dict[str, int] = {}
        before: dict[str, str] = {}
        closed: dict[str, int] = {}
        heap: list[tuple[int, bool, str]] = []
        a, base = new, 0
        out, least_out = new, gain[new]
        while True:
            for b, w in options[a]:
                d = base + gain[a] - w + price.get(b, 0)
                if b not in closed and d < reached.get(b, d + 1):
                    reached[b], before[b] = d, a
                    heapq.heappush(heap, (d, b in owner, b))
            if base + gain[a] < least_out:
                out, least_out = a, base + gain[a]
            while heap and heap[0][2] in closed:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= least_out:
                end, length = partner.pop(out, None), least_out
                break
            d, _, b = heapq.heappop(heap)
            if b not in owner:
                end, length = b, d
                break
            closed[b] = d
            a, base = owner[b], d
        for b, d in closed.items():
            price[b] = price.get(b, 0) + length - d
            gain[owner[b]] -= length - d
        gain[new] -= length
        while end is not None:
            a = before[end]
            owner[end] = a
            last, partner[a] = partner.get(a), end
            end = None if a == new else last
    return partner


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Each passage and each refcode at most once, total confidence maximal: (passage_id, refcode, confidence).

    Pairs without a rival are final. The contested rest falls into connected components, each solved exactly by
    :func:`assignment`. Up to ``LOCAL_EDGES`` edges (checked) that happens in one place, beyond it with one group per
    component; a component is solved alike in both, so the result does not depend on the size. One component is
    held by one task.
    """
    spark = pairs.sparkSession
    pairs = stage_table(pairs.select("passage_id", "refcode", "confidence"), "pairs")
    by = lambda c: F.count("*").over(Window.partitionBy(c))
    marked = pairs.withColumn("a", by("passage_id")).withColumn("b", by("refcode"))
    marked = stage_table(marked, "contested")
    sole = marked.where("a = 1 AND b = 1").select("passage_id", "refcode", "confidence")
    rest = marked.where("a > 1 OR b > 1").select("passage_id", "refcode", "confidence")
    n = rest.count()
    if n == 0:
        return sole
    if n <= LOCAL_EDGES:
        won = spark.createDataFrame(list(assignment(tuple(r) for r in rest.collect()).items()), "passage_id string, refcode string")
    else:
        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            got = assignment(pdf[["passage_id", "refcode", "confidence"]].itertuples(index=False, name=None))
            return pd.DataFrame(list(got.items()), columns=["passage_id", "refcode"])

        won = components(rest).groupBy("component").applyInPandas(solve, "passage_id string, refcode string")
    return sole.unionByName(rest.join(won, ["passage_id", "refcode"]))


def components(edges: DataFrame) -> DataFrame:
    """``edges`` with ``component``, the least passage_id of the connected component.

    Labels spread through the edges, passage to refcode and back, until none changes.
    """
    edges = stage_table(edges.withColumn("component", F.col("passage_id")), "components")
    while True:
        low = edges.groupBy("refcode").agg(F.min("component").alias("low"))
        by_passage = edges.select("passage_id", "refcode").join(low, "refcode").groupBy("passage_id").agg(F.min("low").alias("low"))
        spread = stage_table(edges.join(by_passage, "passage_id").withColumn("changed", F.col("low") != F.col("component")), "components")
        edges = spread.withColumn("component", F.col("low")).drop("low", "changed")
        if spread.where("changed").isEmpty():
            return edges
