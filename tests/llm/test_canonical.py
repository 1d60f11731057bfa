import pytest

from passagekg.llm import canonical
from passagekg.sources.readers import GOLD, RESULTS

CANON = "canon_id bigint, entity_type string, canonical_name string, other_names array<string>, formula string, pubchem_cid bigint, name string"
REF = [
    (1, "MOF", "MOF-350", [], None, None, "clash"), (2, "MOF", "MOF-350-NH2", [], None, None, None), (3, "MOF", "MIL-382(Cr)", None, None, None, None), (4, "MetalPrecursor", "zinc nitrate", ["zinc(II) nitrate"], "Zn(NO3)2", None, None),
    (5, "MetalPrecursor", "indium acetate", ["indium(III) acetate"], "In(OAc)3", None, None), (6, "OrganicLinker", "4,4'-stilbenedicarboxylic acid", ["H2STDC", "4-[2-(4-carboxyphenyl)ethenyl]benzoic acid", "STDC"], None, None, None),
    (7, "OrganicLinker", "2-methylimidazole", ["HMIM", "MIM"], None, None, None), (8, "Solvent", "ethanol", ["EtOH"], None, 702, None), (9, "Solvent", "methanol", ["MeOH"], None, 887, None),
    (10, "Solvent", "water", ["H2O", "deionised water"], None, 962, None), (11, "SynthesisMethod", "solvothermal synthesis", ["solvothermal", "solvothermally"], None, None, None),
    (12, "SynthesisMethod", "room-temperature stirring", ["stirred at room temperature", "RT stirring"], None, None, None), (13, "Solvent", "N,N-dimethylformamide", ["DMF"], None, 6228, None),
    (14, "MetalPrecursor", "iron chloride", ["iron(III) chloride"], "FeCl3", None, None),
]
SYMBOLS = [("Zn", "zinc"), ("In", "indium"), ("Fe", "iron")]
CASES = {
    "mof 350": 1, "MOF_350 powder": 1, "as-synthesized MОF-350": 1, "NH2-MOF-350": 2, "amino-MOF-350": 2, "mof- 350-nh₂": 2, "MOF-351": 0, "MOF-3500": 0, "MOF-350-OH": 0, "MIL-382-Cr": 3, "MIL-382(Fe)": 0,
    "zinc(II) nitrate hexahydrate": 4, "Zn(NO₃)₂·6H₂O": 4, "Zn(NO3)2 x 4 H2O": 4, "nitrate of zinc": 4, "nitrate, zinc": 4, "Zn nitrate": 4, "zinc nitrrate": 4, "anhydrous zinc nitrate (Zn(NO3)2)": 4, "zinc nitrite": 0,
    "ｚｉｎｃ nitrаte": 4, "zi​nc nitrate": 4, "In(CH3COO)3": 5, "indium(iii) acetate": 5, "indium(II) acetate": 0, "In-STDC": 0, "4-(2-(4-carboxyphenyl)ethenyl)benzoic acid": 6, "4 - [2-(4-carboxyphenyl)ethhenyl]benzoic acid": 6,
    "4,4' stilbenedicarboxylic acids": 6, "h2stdc": 6, "H2STDC (4,4'-stilbenedicarboxylic acid)": 6, "recrystallised 2-methylimidazole, 98%": 7, "4-methylimidazole": 0, "2-ethylimidazole": 0, "dry EtOH": 8, "etanol": 8, "MeOH (99.8%)": 9,
    "Milli-Q grade water": 10, "deionised wter": 10, "DI water": 10, "H₂O": 10, "via solvothermal route": 11, "solvo-thermal": 11, "stirring at RT": 12, "room-temperаture stirrіng": 12, "HPLC-grade N,N‐dimethylfomramide": 13,
    "N,N-dimeethylformamide": 13, "irn(III) chloride": 14, "N,N-diethylformamide": 0, "kerosene": 0, "the product": 0, "n/a": 0, "none": 0, " ": 0, "": 0, None: 0, "-": 0, "x" * 3000: 0, "iron(III) chloride": 14, "iron(II) chloride": 0,
}


def frames(spark):
    return spark.createDataFrame(REF, CANON), spark.createDataFrame(SYMBOLS, "symbol string, element string")


def test_cases(spark):
    canon, symbols = frames(spark)
    rows = spark.createDataFrame([(i, n, 5) for i, n in enumerate(CASES)], "i int, name string, canon_id int")
    got = {r.i: r.canon_id for r in canonical.mapped(rows, canon, symbols).collect()}
    assert {n: (got[i], w) for i, (n, w) in enumerate(CASES.items()) if got[i] != w} == {}


def test_both_sides_of_the_bound_agree(spark, monkeypatch, sf):
    """The join form takes over by itself and gives the same rows, with ties, repeated rows and corpus frequencies."""
    canon, symbols = frames(spark)
    rows = spark.createDataFrame([(i, n, 5) for i, n in enumerate([*CASES, *CASES, "borxnol", "eathnol", "zinc ntrate", "4,4'-stilbendicarboxylc acid"])], "i int, name string, canon_id int")
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("results", "gold", "canon_entities", "metal_symbols")]
    both = []
    for bound in (20_000, 3):
        monkeypatch.setattr(canonical, "REFERENCE_BOUND", bound)
        small = sorted((r.i, r.canon_id, str(r.distance)) for r in canonical.mapped(rows, canon, symbols).collect())
        both.append((small, sorted(map(tuple, canonical.found_ids(*tables).collect()))))
    assert both[0][0] == both[1][0] and both[0][1] == both[1][1]


def test_symmetric_deletes_equal_brute_force(spark):
    d = canonical.dictionary(*frames(spark)).value
    for name in ("etanol", "ethanoll", "methnaol", "zinc nitraet", "ethxnol", "solvothermel", "indum acetate", "soldothermel", "stilbenedicrboxylc acid", "room-temperatur stiring", "dimethilfromamide"):
        near = set()
        for key in canonical.keys(name):
            for known in d.exact:
                if canonical.verified(key, known) is not None:
                    near |= set(d.exact[known])
        found = d.find(name, {})[0]
        assert found in near if near else found == 0


def _edited(word, rng, edits):
    for _ in range(edits):
        at = [i for i, c in enumerate(word) if c.isalpha()]
        i = rng.choice(at)
        kind = rng.randrange(4)
        j = i + 1 if i + 1 in at else None
        if kind == 0 and j:
            word = word[:i] + word[j] + word[i] + word[j + 1 :]
        elif kind == 1:
            word = word[:i] + word[i] + word[i:]
        elif kind == 2:
            word = word[:i] + rng.choice("abdegoptu") + word[i + 1 :]
        else:
            word = word[:i] + word[i + 1 :]
    return word


@pytest.mark.parametrize("edits", [1, 2])
def test_recall_of_edits(spark, edits):
    """Names of the reference list with letters dropped, doubled, swapped and replaced are found again."""
    import random

    canon = spark.read.parquet("/root/testdata/sf0.001/canon_entities.parquet")
    d = canonical.dictionary(canon, spark.read.parquet("/root/testdata/sf0.001/metal_symbols.parquet")).value
    rng = random.Random(edits)
    names = [r.canonical_name for r in canon.collect() if r.entity_type in ("OrganicLinker", "MetalPrecursor") and sum(map(str.isalpha, r.canonical_name)) >= 14]
    dropped = hits = 0
    for name in names * 5:
        word = name
        for _ in range(edits):  # letters dropped, as in hasty typing
            i = rng.choice([i for i, c in enumerate(word) if c.isalpha()])
            word = word[:i] + word[i + 1 :]
        dropped += 1
        hits += d.find(word, {})[0] == d.find(name, {})[0]
    assert hits >= 0.9 * dropped
    mixed = [(d.find(_edited(n, rng, edits), {})[0], d.find(n, {})[0]) for n in names * 5]
    assert sum(a == b for a, b in mixed) >= 0.8 * len(mixed)


def test_frequency_breaks_ties():
    d = canonical.Dictionary([(1, ["boranol"]), (2, ["bormnol"])])
    assert d.find("borxnol", {})[0] == 1 and d.find("borxnol", {2: 5})[0] == 2


def test_rows_and_reports(spark):
    canon, symbols = frames(spark)
    e = lambda n: ("T", n, None)
    t = lambda s, r, o: (e(s), r, e(o), "", "high", "", "", "")
    triples = [t("MOF-350", "uses_precursor", "zinc nitrate"), None, t("a", "MEASURED_AT", "b"), t("EtOH", "HAS_PROPERTY", "water"), t(" ", "IN_SOLVENT", "kerosene"), (None, "IN_SOLVENT", None, "", "", "", "", "")]
    r = spark.createDataFrame([(7, "p", "P", "S", "x", triples, 1, 0.0, 0.0, [], "r"), (8, "p", "P", "S", "x", None, 1, 0.0, 0.0, [], "r")], "line_no bigint, " + RESULTS)
    gold = spark.createDataFrame([], "line_no bigint, " + GOLD)
    got = {tuple(x) for x in canonical.found_ids(r, gold, canon, symbols).collect()}
    assert got == {("results", 7, 0, "subject", 1), ("results", 7, 0, "object", 4), ("results", 7, 3, "subject", 8), ("results", 7, 4, "object", 0)}
    assert [tuple(x) for x in canonical.misses(canonical.mapped(canonical.name_rows(r, gold), canon, symbols)).collect()] == [("kerosene", 1)]
    assert canonical.found_ids(r.limit(0), gold, canon, symbols).count() == 0
