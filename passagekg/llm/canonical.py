"""Problem 2: freely typed names -> the one entry of a reference list they denote, or 0.

A symmetric-delete dictionary holds, for every spelling of every reference entry, the strings left after deleting
characters of its first ``PREFIX``: one for keys of ``LEAST_LETTERS`` letters, two for keys of ``TWO_EDITS`` and more. A name
is brought to its keys (look-alikes folded; hydrate, purity and sample wording dropped; word order, notation of
formulas and of framework codes unified), and each key's own deletions are looked up; two strings within k edits share a
string that is k deletions in their prefixes away from both, so the prefix loses nothing and long keys stay cheap. Candidates are
verified and ranked by weighted Damerau-Levenshtein distance, ties by how often the entry is named exactly in the
corpus, then by id. Digits, roman numerals and functional groups are never edited: another number makes another material.

While the reference list has at most ``REFERENCE_BOUND`` entries (checked), the dictionary is broadcast and the mapping
is a narrow, shuffle-free pass whatever name is hot. Beyond, the same keys, deletions, verification and ranking run as equi-joins
over the distinct names (``mapped`` goes over by itself; the rows are the same on both sides of the bound).

Defined results: null, blank and null-like names, and names nothing in the list is near to, map to 0
(``misses`` reports them with counts); repeated rows map alike; names of any length are handled whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekg.functions.lookalike import plain_text
from passagekg.runtime import stage_table

#: Letters from which a key may be reached by one edit and by two (shorter ones are near to each other by themselves).
LEAST_LETTERS, TWO_EDITS = 5, 12
#: Characters in which deletions are made.
PREFIX = 14
REFERENCE_BOUND = 20_000

#: Words that say nothing about which entry is meant.
NULL_WORDS = frozenset(["", "-", "--", "n/a", "na", "nan", "none", "null", "nil", "unknown", "not reported", "not given", "not specified", "unspecified", "?", "tbd"])
#: Trade and lab wordings of an entry that share no word with its names, so that no edit leads to them; general
#: laboratory language, each the usual name of the method or solvent elsewhere. A caller may pass a list of their own.
SYNONYMS = {
    "sonochemical synthesis": ("ultrasonication", "sonication", "ultrasonic synthesis"),
    "mechanochemical synthesis": ("ball-milled", "ball mill", "liquid-assisted grinding", "grinding", "LAG"),
    "room-temperature stirring": ("room temperature synthesis", "stirring at RT", "stirring at room temperature", "stirred at RT"),
    "slow diffusion": ("diffusion", "slow-diffusion method"),
    "spray drying": ("spray-dried",),
    "ionothermal synthesis": ("ionic liquid route", "ionic liquid synthesis"),
    "microwave-assisted synthesis": ("microwave heating", "microwave irradiation"),
    "electrochemical synthesis": ("electrosynthesis", "electrolysis"),
    "water": ("dist. H2O", "aqua", "DI water"),
}
_DROPPED = (
    r"as[- ](?:synthesi[sz]ed|made|prepared|received)", r"activated", r"pristine", r"desolvated", r"nano(?:crystalline)?", r"bulk", r"crystals?", r"crystalline",
    r"powders?", r"particles?", r"sample of", r"anhydrous", r"dry", r"fresh(?:ly)?", r"recrystalli[sz]ed", r"purified", r"distilled", r"redistilled",
    r"dei?oni[sz]ed", r"ultrapure", r"(?:hplc|milli-?q|acs|analytical|reagent|technical|lc-ms|spectroscopic)(?:[- ]grade)?", r"degassed",
    r"(?:hemi|mono|di|tri|tetra|penta|hexa|hepta|octa|nona|deca)?hydrate[ds]?", r"linkers?", r"ligands?", r"solvents?", r"grade", r"di(?= water)", r"pure",
)
_METHOD_WORDS = r"conditions?|routes?|methods?|preparations?|reactions?|treatments?|heating|irradiation|process|procedure|synthes[ie]s|techniques?|assisted"
_SYMBOL = {"oac": "acetate", "ch3coo": "acetate", "ch3co2": "acetate", "o2cch3": "acetate", "acac": "acetylacetonate", "c5h7o2": "acetylacetonate"}

_DROP = re.compile(r"(?<![\w,'])(?:" + "|".join(_DROPPED) + r")(?![\w'])(?:-(?=[a-z]))?")
_PURITY = re.compile(r"[,;]? ?[(\[]? ?(?:[>≥~] ?)?\d{2,3}(?:\.\d+)? ?%(?: purity)? ?[)\]]?")
_WATER = re.compile(r"(?<=[\w)\]]) ?(?:[·.*•∙⋅×]| x) ?\(?\d*(?:\.\d+)? ?h2o\)?")
_ROMAN = re.compile(r" ?\((i{1,3}|iv|vi{0,3})\)(?!\w)")
_CODE = re.compile(r"(?:(nh2|amino|oh|hydroxy|no2|nitro|br|bromo)[ _-]+)?([a-z]{2,4})[ _-]{0,3}(\d+)(?:[ _-]{0,3}\(?(nh2|oh|no2|br)\)?|[ _-]?\(([a-z]{2})\)|[ _-]([a-z]{2}))?")
_GROUP = {"amino": "nh2", "hydroxy": "oh", "nitro": "no2", "bromo": "br"}
_WORDS = re.compile(r"[a-z]+|\d+|'")
_ROMANS = re.compile(r"\b(?:i{1,3}|iv|vi{0,3})\b")
#: Functional groups in a name; a garbled one (``dimeethyl``, ``nitrole``) is not another one.
_GROUPS = re.compile(r"(?:meth|(?<!me)eth|prop|but|pent|hex|phen|benz)yl|amino|nitro(?:so)?(?!le)|hydroxy|bromo|chloro|fluoro|iodo|mercapto|nitrite|nitrate|sulf[aiu]|phosph|methoxy|ethoxy|carboxy")
_STOP = frozenset("of the a an at by and with to via".split())


def _stripped(text: str) -> str:
    text = _PURITY.sub(" ", text)
    text = _WATER.sub("", text)
    text = _DROP.sub(" ", text)
    return re.sub(r" +", " ", text).strip(" ,;:-_")


def _words(text: str) -> list[str]:
    """Words, number runs and primes; plurals of ``acid`` and spelling variants unified."""
    text = text.replace("aluminum", "aluminium").replace("sulph", "sulf").replace("acids", "acid").replace("′", "'").replace("’", "'")
    return [w for w in _WORDS.findall(text) if w not in _STOP]


def _framework(text: str) -> str | None:
    """Key of a framework code such as ``MIL-382(Cr)`` or ``NH2-MOF-350``."""
    m = _CODE.fullmatch(text)
    if not m:
        return None
    front, family, number, group, metal, suffix = m.groups()
    metal = metal or suffix
    group = group or _GROUP.get(front, front)
    if front and m[4]:
        return None
    return f"code {family} {number}" + (f" {group}" if group else "") + (f" ({metal})" if metal else "")


def _views(text: str) -> list[str]:
    """The ways to read one spelling, most literal first."""
    out = [text]
    roman = _ROMAN.sub(r" \1 ", text)
    if roman != text:
        out[0] = roman = re.sub(r" +", " ", roman).strip()
    inside = re.search(r"(?:^|(?<=[\w\])]) )\((.{2,})\)$|(?<=\S) \[(.{2,})\]$", text)
    if inside:
        out += [text[: inside.start()].strip(), (inside[1] or inside[2]).strip()]
    return out


def keys(name: str | None, reference: bool = False) -> tuple[str, ...]:
    """Comparable keys of a name; the first that is known decides. Empty for null-like names."""
    if name is None:
        return ()
    text = plain_text(name).lower().strip(" .,;")
    if text in NULL_WORDS:
        return ()
    out: list[str] = []

    def add(view: str) -> None:
        code = _framework(view)
        if code:
            out.append(code)
            return
        words = _words(view)
        if not words:
            return
        out.append(" ".join(words))
        if len(words) > 1:
            # word order: 'nitrate of cobalt', 'acetate, zinc'; locants keep their place in a word of their own
            parts = [" ".join(_words(w)) for w in re.split(r"[ ,]+ ?(?![\d'])", view.replace(" of ", " ")) if _words(w)]
            out.append("~" + " ".join(sorted(parts)))

    for view in _views(text):
        if not reference:
            shorter = _stripped(view)
            if shorter != view and shorter:
                add(shorter)
                for v in _views(shorter)[1:]:
                    add(_stripped(v))
            if shorter == "" and view:
                continue
            add(view)
            method = re.sub(rf"(?:[ -](?:{_METHOD_WORDS}))+$", "", re.sub(r"^(?:via|by|using|under|through) ", "", shorter))
            method = re.sub(r"(?<=cal|mal)ly$", "", method)
            if method != shorter and method:
                add(method)
        else:
            add(view)
    return tuple(dict.fromkeys(k for k in out if k.strip("~ ")))


def reference_spellings(canonical_name: str, other_names, formula: str | None, entity_type: str, symbols: dict[str, str]) -> list[str]:
    """All spellings under which an entry is known; formulas and element symbols spelled out by rule."""
    names = [canonical_name, *(n for n in (other_names if other_names is not None else []) if n)]
    if entity_type == "MetalPrecursor":
        element, _, anion = canonical_name.partition(" ")
        names += [f"{s} {anion}" for s, e in symbols.items() if e == element]
        names += [f"{s}{n[len(element):]}" for s, e in symbols.items() if e == element for n in names[1:] if n.startswith(f"{element}(")]
        if formula:
            names.append(formula)
            for short, anions in (("OAc", ("CH3COO", "CH3CO2", "O2CCH3", "C2H3O2")), ("acac", ("C5H7O2",))):
                names += [formula.replace(short, a) for a in anions if short in formula]
    elif formula:
        names.append(formula)
    names += SYNONYMS.get(canonical_name, ())
    if entity_type == "SynthesisMethod":
        names += [re.sub(rf"[ -](?:{_METHOD_WORDS})$", "", n) for n in names]
        names += [n.replace("room temperature", "rt").replace("room-temperature", "rt") for n in names]
    return list(dict.fromkeys(n for n in names if n and n.strip()))


def edits_allowed(key: str) -> int:
    """Edits by which a reference key may be missed."""
    letters = 0 if key.startswith("code ") else sum(map(str.isalpha, key))
    return (letters >= LEAST_LETTERS) + (letters >= TWO_EDITS)


def edits_tried(key: str) -> int:
    """Edits by which a name's key may have left the reference key it stands for, which may have lost its letters by them."""
    letters = 0 if key.startswith("code ") else sum(map(str.isalpha, key))
    return (letters >= LEAST_LETTERS - 1) + (letters >= TWO_EDITS - 2)


def deletions(key: str, edits: int) -> set[str]:
    """The first ``PREFIX`` characters of ``key`` and every string left after deleting up to ``edits`` of them."""
    out = last = {key[:PREFIX]}
    for _ in range(edits):
        last = {k[:i] + k[i + 1 :] for k in last for i in range(len(k))}
        out = out | last
    return out


def distance(a: str, b: str) -> float:
    """Weighted Damerau-Levenshtein from the typed ``a`` to the known ``b``: a doubled, swapped or dropped letter is likelier than a
    letter too many, and that likelier than another letter."""
    two: list[float] = []
    one = [0.7 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [0.9 * i]
        for j, y in enumerate(b, 1):
            best = one[j - 1] if x == y else min(one[j - 1] + 1.0, one[j] + (0.5 if i > 1 and x == a[i - 2] else 0.9), row[j - 1] + 0.7)
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and x != y:
                best = min(best, two[j - 2] + 0.6)
            row.append(best)
        two, one = one, row
    return one[-1]


def admissible(query: str, known: str) -> bool:
    """An edit may not touch numbers, oxidation states or functional groups."""
    if re.findall(r"\d+", query) != re.findall(r"\d+", known):
        return False
    states = _ROMANS.findall(query)
    if states and states != _ROMANS.findall(known):
        return False
    return not (_GROUPS.findall(query) != _GROUPS.findall(known) and _whole_groups(query, known))


def _whole_groups(query: str, known: str) -> bool:
    """True when the query shows a functional group that the known key lacks (not merely a garbled one)."""
    left = list(_GROUPS.findall(known))
    for g in _GROUPS.findall(query):
        if g in left:
            left.remove(g)
        else:
            return True
    return False


def verified(query: str, known: str) -> float | None:
    """Weighted distance of a candidate; None if it is too far or the edits are not admissible."""
    edits = edits_allowed(known)
    if not edits or abs(len(query) - len(known)) > edits or not admissible(query, known):
        return None
    d = distance(query, known)
    return round(d, 3) if d <= edits else None


class Dictionary:
    """Symmetric-delete dictionary over the reference list."""

    def __init__(self, entries: list[tuple[int, list[str]]]):
        self.exact: dict[str, tuple[int, ...]] = {}
        near: dict[str, set[str]] = defaultdict(set)
        owners: dict[str, dict[int, int]] = defaultdict(dict)
        for canon_id, spellings in entries:
            for rank, spelling in enumerate(spellings):
                for key in keys(spelling, reference=True):
                    owners[key].setdefault(canon_id, rank)
                    if edits_allowed(key):
                        for d in deletions(key, edits_allowed(key)):
                            near[d].add(key)
        self.exact = {k: tuple(sorted(v, key=lambda c: (v[c] > 0, c))) for k, v in owners.items()}
        self.near = {k: tuple(sorted(v)) for k, v in near.items()}

    def exactly(self, name: str | None) -> int:
        for key in keys(name):
            if key in self.exact:
                return self.exact[key][0]
        return 0

    def find(self, name: str | None, frequency: dict[int, int], near: bool = True) -> tuple[int, float]:
        """(canon_id, weighted distance); (0, nan) for a miss."""
        ks = keys(name)
        for key in ks:
            if key in self.exact:
                return min(self.exact[key], key=lambda c: (-frequency.get(c, 0), c)), 0.0
        best: tuple[float, int, int] | None = None
        for key in ks if near else ():
            tried = edits_tried(key)
            for known in {k for d in deletions(key, tried) for k in self.near.get(d, ())} if tried else ():
                w = verified(key, known)
                if w is not None:
                    for c in self.exact[known]:
                        rank = (w, -frequency.get(c, 0), c)
                        best = min(best, rank) if best else rank
        return (best[2], best[0]) if best else (0, float("nan"))


def symbol_table(symbols: DataFrame) -> dict[str, str]:
    """Element symbols (fixed by nature, so a driver-side table)."""
    return {r.symbol: r.element for r in symbols.limit(1000).collect()}


def dictionary(canon: DataFrame, symbols: DataFrame):
    """The dictionary of a reference list as a broadcast variable, or None where the list has more than ``REFERENCE_BOUND`` entries."""
    rows = canon.select("canon_id", "entity_type", "canonical_name", "other_names", "formula").limit(REFERENCE_BOUND + 1).collect()
    if len(rows) > REFERENCE_BOUND:
        return None
    table = symbol_table(symbols)
    known = Dictionary([(r.canon_id, reference_spellings(r.canonical_name, r.other_names, r.formula, r.entity_type, table)) for r in rows if r.canonical_name])
    return canon.sparkSession.sparkContext.broadcast(known)


def name_rows(results: DataFrame, gold: DataFrame) -> DataFrame:
    """(src, line_no, triple_ix, role, name) of the endpoints that name an entry."""
    objects = ("USES_PRECURSOR", "USES_LINKER", "SYNTHESIZED_BY", "IN_SOLVENT")

    def ends(df: DataFrame, src: str, subject: str, obj: str) -> DataFrame:
        t = df.select(F.col("line_no").cast("bigint").alias("line_no"), F.posexplode("triples").alias("triple_ix", "t"))
        relation = F.upper(F.trim(F.col("t.relation")))
        pairs = F.array(
            F.when(relation != "MEASURED_AT", F.struct(F.lit("subject").alias("role"), F.col(f"t.{subject}").alias("name"))),
            F.when(relation.isin(*objects), F.struct(F.lit("object").alias("role"), F.col(f"t.{obj}").alias("name"))),
        )
        rows = t.select("line_no", "triple_ix", F.explode(pairs).alias("e")).where("e.name IS NOT NULL")
        return rows.select(F.lit(src).alias("src"), "line_no", "triple_ix", "e.role", "e.name")

    rows = ends(results, "results", "subject.name", "object.name").unionByName(ends(gold, "gold", "subject_name", "object_name"))
    return rows.where(F.col("name").rlike(r"(?U)[^\s\x1c-\x1f\x85]"))


_FOUND = T.StructType([T.StructField("canon_id", T.LongType()), T.StructField("distance", T.DoubleType())])


def _exact_udf(shared):
    @F.pandas_udf(T.LongType())
    def exact(names: pd.Series) -> pd.Series:
        return names.map(lru_cache(maxsize=None)(shared.value.exactly)).astype("int64")

    return exact


_MEMO: dict[int, dict] = {}


def _find_udf(shared, frequency):
    mark = shared.id if hasattr(shared, "id") else shared._jbroadcast.id()

    @F.pandas_udf(_FOUND)
    def find(names: pd.Series, near: pd.Series) -> pd.DataFrame:
        memo = _MEMO.setdefault(mark, {})
        d, f = shared.value, frequency
        if len(memo) > 500_000:
            memo.clear()
        out = []
        for key in zip(names, near, strict=True):
            hit = memo.get(key)
            if hit is None:
                hit = memo[key] = d.find(key[0], f, key[1])
            out.append(hit)
        return pd.DataFrame(out, columns=["canon_id", "distance"])

    return find


def mapped(rows: DataFrame, canon: DataFrame, symbols: DataFrame, shared=None, near: Column | None = None) -> DataFrame:
    """``rows`` (with ``name``) plus canon_id (0: not in the list) and distance, which replace columns of these names.

    ``shared`` is the :func:`dictionary` of the list, if the caller has it already; ``near`` tells rows that may be reached by an
    edit (all, if not given).
    """
    rows = rows.drop("canon_id", "distance")
    near = F.lit(True) if near is None else F.coalesce(near, F.lit(False))
    shared = shared or dictionary(canon, symbols)
    if shared is None:
        found, edited = _mapped_by_join(rows, canon, symbols), ~near & (F.col("distance") > 0)
        return found.select(*rows.columns, F.when(edited, 0).otherwise(F.col("canon_id")).cast("bigint").alias("canon_id"), F.when(~edited | F.col("distance").isNull(), F.col("distance")).alias("distance"))
    exact = _exact_udf(shared)
    # corpus frequency of each entry: at most one row per reference entry reaches the driver
    counts = rows.groupBy("name").agg(F.count("*").alias("n")).groupBy(exact("name").alias("c")).agg(F.sum("n").alias("n"))
    frequency = {r.c: r.n for r in counts.collect()}
    return rows.withColumn("_f", _find_udf(shared, frequency)("name", near)).select(*rows.columns, "_f.canon_id", "_f.distance")


_STRINGS = T.ArrayType(T.StringType())


@F.pandas_udf(_STRINGS)
def _keys_udf(names: pd.Series) -> pd.Series:
    return names.map(lambda n: list(keys(n)))


@F.pandas_udf(_STRINGS)
def _known_keys_udf(names: pd.Series) -> pd.Series:
    return names.map(lambda n: list(keys(n, True)))


@F.pandas_udf(_STRINGS)
def _tried_udf(ks: pd.Series) -> pd.Series:
    return ks.map(lambda k: sorted(deletions(k, edits_tried(k))) if edits_tried(k) else [])


@F.pandas_udf(_STRINGS)
def _allowed_udf(ks: pd.Series) -> pd.Series:
    return ks.map(lambda k: sorted(deletions(k, edits_allowed(k))) if edits_allowed(k) else [])


@F.pandas_udf(T.DoubleType())
def _verified_udf(query: pd.Series, known: pd.Series) -> pd.Series:
    return pd.Series([verified(q, k) for q, k in zip(query, known, strict=True)], dtype="float64")


def _spellings_udf(table: dict[str, str]):
    @F.pandas_udf(_STRINGS)
    def spellings(names: pd.Series, others: pd.Series, formulas: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([reference_spellings(n, o, f, k, table) if n else [] for n, o, f, k in zip(names, others, formulas, kinds, strict=True)])

    return spellings


def _mapped_by_join(rows: DataFrame, canon: DataFrame, symbols: DataFrame) -> DataFrame:
    """:func:`mapped` for a reference list of any size: keys and deletions of the distinct names meet those of the list in equi-joins."""
    spelled = _spellings_udf(symbol_table(symbols))("canonical_name", "other_names", "formula", "entity_type")
    known = canon.where("canonical_name IS NOT NULL").select("canon_id", F.posexplode(spelled).alias("rank", "spelling"))
    known = known.select("canon_id", "rank", F.explode(_known_keys_udf("spelling")).alias("key")).groupBy("key", "canon_id").agg(F.min("rank").alias("rank"))
    known = stage_table(known, "known-keys")
    asked = stage_table(rows.groupBy("name").agg(F.count("*").alias("n")).withColumn("ks", _keys_udf("name")), "asked-names")
    probes = asked.select("name", "n", F.posexplode("ks").alias("pos", "key"))
    hits = stage_table(probes.join(known, "key").select("name", "n", "pos", "rank", "canon_id"), "key-hits")
    plain = hits.groupBy("name").agg(F.min("n").alias("n"), F.min(F.struct("pos", F.col("rank") > 0, "canon_id")).alias("b"))
    frequency = stage_table(plain.groupBy(F.col("b.canon_id").alias("canon_id")).agg(F.sum("n").alias("f")), "entry-counts")
    often = -F.coalesce(F.col("f"), F.lit(0))
    exact = hits.join(frequency, "canon_id", "left").groupBy("name").agg(F.min(F.struct("pos", often.alias("o"), "canon_id")).alias("b"))
    exact = exact.select("name", F.col("b.canon_id").alias("canon_id"), F.lit(0.0).alias("distance"))
    rest = probes.join(hits.select("name").distinct(), "name", "left_anti")
    tried = rest.select("name", "key", F.explode(_tried_udf("key")).alias("d"))
    allowed = known.select("key").distinct().select(F.col("key").alias("known"), F.explode(_allowed_udf("key")).alias("d"))
    near = tried.join(allowed, "d").select("name", "key", "known").distinct().withColumn("distance", _verified_udf("key", "known")).where("distance IS NOT NULL")
    owners = near.join(known.select(F.col("key").alias("known"), "canon_id"), "known").join(frequency, "canon_id", "left")
    fuzzy = owners.groupBy("name").agg(F.min(F.struct("distance", often.alias("o"), "canon_id")).alias("b")).select("name", "b.canon_id", "b.distance")
    found = exact.unionByName(fuzzy)
    out = rows.join(found, "name", "left")
    return out.select(*rows.columns, F.coalesce("canon_id", F.lit(0)).cast("bigint").alias("canon_id"), "distance")


def misses(found: DataFrame) -> DataFrame:
    """Report of names not in the list: (name, n_rows)."""
    return found.where(F.col("canon_id") == 0).groupBy("name").agg(F.count("*").alias("n_rows"))


def found_ids(results: DataFrame, gold: DataFrame, canon: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, line_no, triple_ix, role, canon_id), distinct (the rows are distinct by construction)."""
    return mapped(name_rows(results, gold), canon, symbols).select("src", "line_no", "triple_ix", "role", "canon_id")
