import itertools
import random

from passagekg.llm import entity_match as em
from passagekg.sources.readers import GOLD

from .test_canonical import frames

MERGED = "refcode string, metal string, clean_linker_1 string, cn_topology string, filename string, metal_ele1 string, temperature_celsius double, time_h double, yield_percent string, solvent1 bigint, solvent2 bigint, solvent3 bigint, solvent4 bigint, solvent5 bigint, passage_id string"
NO = itertools.count(1)


def gold(pid, *triples, status="annotated"):
    rows = [("MOF", s, None, r, "T", o, None, "", "", "") if o is not None or s else None for s, r, o in triples]
    return (next(NO), pid, "P", "S", status, rows, "a", "2021", None, None, None, None, None, None)


def recipe(pid, temperature="120 °C", time="24 h", yields="yield 50.5 %", metal="zinc nitrate", linker="HMIM", subject="X", **more):
    triples = [(subject, "USES_PRECURSOR", metal), (subject, "uses_linker", linker), ("m", "AT_CONDITION", temperature), ("m", "AT_CONDITION", time), (subject, "HAS_PROPERTY", yields), ("m", "IN_SOLVENT", "DMF"), (None, None, None)]
    return gold(pid, *[t for t in triples if t[2] is not None or t[0] is None], **more)


def row(refcode, temperature=120.0, time=24.0, yields="50.5", metal="Zn", ele="Zn", linker=" 2-METHYLIMIDAZOLE "):
    return (refcode, metal, linker, None, "f", ele, temperature, time, yields, 6228, None, None, None, None, "clash")


def matches(spark, golds, rows):
    canon, symbols = frames(spark)
    return em.matches(spark.createDataFrame(golds, "line_no bigint, " + GOLD), spark.createDataFrame(rows, MERGED), canon, symbols)


def test_rules(spark):
    golds = [
        recipe("same"), recipe("same"), recipe("f", temperature="248.5 deg F"), recipe("far", temperature="121 °C"), recipe("no yield", yields=None), recipe("one left", yields=None, time=None), recipe("other time", time="25 h"),
        recipe("range", temperature="110 to 120 °C"), recipe("combined", temperature="at 393.15 K / 1 day", time=None), recipe("skipped", status="skipped"), recipe("short", metal="metal salt", linker=None, subject="activated Zn-MIM"),
        recipe("metal", metal="indium acetate"), recipe("nothing", metal=None, linker=None, subject="product"), gold("empty"), gold("", ("a", "b", "c")),
    ]
    rows = [row(" abcdef "), row("ABCDEF"), row("NOYIEL", yields=None), row("BADYLD", yields="~60"), row("NOTEMP", temperature=None), row("ELEM", ele=None), row("ZERO", ele=None, metal="0"), row("LINK", linker="ethanol"), row(None), row("LONE", temperature=None, yields="")]
    got = {(r.passage_id, r.refcode) for r in matches(spark, golds, rows).collect()}
    full = {"ABCDEF", "ELEM"}
    want = {(p, r) for p in ("same", "f", "range", "short") for r in full | {"NOYIEL", "NOTEMP"}} | {("no yield", r) for r in full | {"NOYIEL", "BADYLD"}} | {("combined", r) for r in full | {"NOYIEL", "NOTEMP"}}
    want |= {("far", "NOTEMP")}
    assert got == want


def test_confidence_and_empty(spark):
    c = {r.refcode: r.confidence for r in matches(spark, [recipe("a")], [row("FULL"), row("PART", yields=None)]).collect()}
    assert 1 >= c["FULL"] > c["PART"] > 0
    assert matches(spark, [], [row("A")]).count() == 0 and matches(spark, [recipe("a")], []).count() == 0


def brute(edges):
    best = 0.0
    for k in range(len(edges) + 1):
        for some in itertools.combinations(edges, k):
            if len({a for a, _, _ in some}) == len({b for _, b, _ in some}) == k:
                best = max(best, sum(c for *_, c in some))
    return best


def test_auction_is_optimal():
    rng = random.Random(3)
    for _ in range(40):
        edges = [(f"a{i}", f"b{j}", round(rng.uniform(0.1, 1), 2)) for i in range(4) for j in range(4) if rng.random() < 0.6]
        value = {(a, b): c for a, b, c in edges}
        got = em.auction(edges, 1e-5)
        assert len(set(got.values())) == len(got) and abs(sum(value[p] for p in got.items()) - brute(edges)) < 1e-3


def test_one_to_one(spark, monkeypatch):
    edges = [("a", "X", 0.9), ("b", "X", 0.8), ("b", "Y", 0.3), ("c", "Z", 0.5), ("d", "X", 0.2)]
    df = spark.createDataFrame(edges, "passage_id string, refcode string, confidence double")
    want = {("a", "X"), ("b", "Y"), ("c", "Z")}
    assert {(r.passage_id, r.refcode) for r in em.one_to_one(df).collect()} == want
    monkeypatch.setattr(em, "LOCAL_EDGES", 0)  # rounds of Spark jobs, as for sets that do not fit in one place
    assert {(r.passage_id, r.refcode) for r in em.one_to_one(df).collect()} == want
    assert em.one_to_one(df.limit(0)).count() == 0


def test_assignment_is_exact():
    rng = random.Random(8)
    for _ in range(60):
        edges = [(f"a{i}", f"b{j}", round(rng.choice([0.9, rng.uniform(0.1, 1)]), 4)) for i in range(4) for j in range(4) if rng.random() < 0.6]
        value = {(a, b): c for a, b, c in edges}
        got = em.assignment(edges)
        assert len(set(got.values())) == len(got) and abs(sum(value[p] for p in got.items()) - brute(edges)) < 1e-9
        other = em.auction(edges, 1e-4 / (len(edges) + 1))
        assert abs(sum(value[p] for p in got.items()) - sum(value[p] for p in other.items())) < 1e-9
    crowd = [(f"a{i}", f"b{j}", 0.9) for i in range(120) for j in range(119)]
    assert len(em.assignment(crowd)) == 119


def test_size_does_not_change_the_assignment(spark, monkeypatch):
    # confidences so close that bids by 1e-4 a pair miss the best assignment
    rng = random.Random(4)
    edges = [(f"{k}a{i}", f"{k}b{j}", round(0.5 + rng.randint(0, 3) * 1e-4, 4)) for k in range(30) for i in range(4) for j in range(4) if rng.random() < 0.7]
    df = spark.createDataFrame(edges, "passage_id string, refcode string, confidence double")
    local = sorted(map(tuple, em.one_to_one(df).collect()))
    value = {(a, b): c for a, b, c in edges}
    assert abs(sum(c for *_, c in local) - sum(value[p] for p in em.auction(edges, 1e-4 / (len(edges) + 1)).items())) < 1e-9
    monkeypatch.setattr(em, "LOCAL_EDGES", 0)
    assert sorted(map(tuple, em.one_to_one(df).collect())) == local
    path = [(f"p{i:02d}", f"q{j:02d}", 0.5) for i in range(9) for j in (i, i + 1)]
    labels = em.components(spark.createDataFrame(path + [("z", "z", 0.1)], df.schema)).collect()
    assert {(r.passage_id == "z", r.component) for r in labels} == {(False, "p00"), (True, "z")}
