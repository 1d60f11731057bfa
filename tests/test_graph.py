import itertools

import pytest
from pyspark.sql import functions as F

from passagekg.operators import graph

COLS = "line_no bigint, triple_ix int, paper_id string, source_section string, extractor string, relation string, subject_type string, subject_name string, object_type string, object_name string, evidence string, confidence string"
PAPERS = "paper_id string, title string, source string, doi string, license string, retrieved_at string"
ROWS = [
    (1, 0, "P1", "S", "x", "USES_PRECURSOR", "MOF", "HKUST-1", "MetalPrecursor", "Cu(NO3)2·3H2O", "e1", "high"),
    (2, 0, "P2", "S", "x", "USES_PRECURSOR", "MOF", "hkust 1", "MetalPrecursor", "copper nitrate", "e2", "low"),
    (3, 0, "P1", "S", "x", "USES_LINKER", "MOF", "HKUST-1", "OrganicLinker", "H3BTC", "e3", "high"),
    (4, 0, "P1", "S", "x", "SYNTHESIZED_BY", "MOF", "HKUST-1", "SynthesisMethod", "solvothermal", "e4", "high"),
    (5, 0, "P1", "S", "x", "IN_SOLVENT", "SynthesisMethod", "solvothermal", "Solvent", "DMF", "e5", "medium"),
    (6, 0, None, "S", "x", "USES_LINKER", "MOF", "A-1", "OrganicLinker", "b", "e", "high"),
    (7, 0, "P1", "S", "x", "MENTIONED_IN", "MOF", "A-1", "Paper", "b", "e", "high"),
    (8, 0, "P1", "S", "x", "USES_LINKER", "MOF", " ", "OrganicLinker", "b", "e", "high"),
    (9, 0, "P1", "S", "x", None, "MOF", "A", "OrganicLinker", "b", "e", "high"),
]


@pytest.fixture
def g(spark):
    papers = spark.createDataFrame([("P1", "t", "s", "10.1/a", None, "2020"), ("P1", None, "s", None, "CC", "2021"), ("P9", "t", "s", "d", "l", "2020")], PAPERS)
    return graph.build(graph.with_ordinal(spark.createDataFrame(ROWS, COLS)), papers)


def test_merge(g):
    nodes = {(r.label, r.key): (r.name, r.aliases) for r in g.nodes.collect()}
    assert nodes[("MOF", "hkust-1")] == ("HKUST-1", ["HKUST-1", "hkust 1"]) and nodes[("MetalPrecursor", "copper nitrate")][0] == "Cu(NO3)2·3H2O"
    e = g.edges.where("rel = 'USES_PRECURSOR'").collect()
    assert len(e) == 1 and (e[0].evidence, e[0].confidence, e[0].paper_id) == ("e2", "low", "P2")
    assert {(r.paper_id, r.doi, r.title, r.license) for r in g.papers.collect()} == {("P1", "10.1/a", "t", "CC"), ("P2", None, None, None)}
    assert g.mentions.where("label = 'MOF' AND key = 'hkust-1' AND paper_id = 'P1'").first().evidence == "e4"


def test_load_reports(spark):
    t = graph.with_ordinal(spark.createDataFrame(ROWS, COLS))
    assert {(r.reason, r.n) for r in graph.rejections(graph.load_rows(t)).collect()} == {("missing paper", 1), ("provenance relation", 1), ("empty key", 1), ("missing type or relation", 1)}
    s = graph.load_stats(t).first()
    assert (s.papers, s.triples_in, s.triples_written, s.nodes_merged) == (2, 9, 5, 10)


def test_rebuild_does_not_depend_on_partitions(spark, g):
    t = graph.with_ordinal(spark.createDataFrame(ROWS, COLS).orderBy(F.desc("line_no")).repartition(7))
    again = graph.build(t, spark.createDataFrame([], PAPERS), staged=True)
    for name in ("nodes", "edges", "mentions"):
        assert sorted(map(str, getattr(g, name).collect())) == sorted(map(str, getattr(again, name).collect()))


def test_queries(g):
    k1 = graph.NAMED["solvent_temperature_by_linker"](g).collect()
    assert [(r.linker, r.solvent, r.condition, r.n_mofs, r.example_mofs) for r in k1] == [("H3BTC", "DMF", "unspecified", 1, ["HKUST-1"])]
    assert [tuple(r) for r in graph.NAMED["method_distribution"](g).collect()] == [("solvothermal", 1, 2)]
    assert [tuple(r) for r in graph.NAMED["precursor_linker_pairs"](g, limit=5).collect()] == [("Cu(NO3)2·3H2O", "H3BTC", 1, 2)]
    rec = graph.NAMED["mof_full_record"](g).first()
    assert rec.linkers == ["H3BTC"] and rec.solvents == ["DMF"] and rec.conditions == [] and len(rec.provenance) == 2
    assert [r.confidence for r in graph.NAMED["provenance_for_claim"](g).collect()] == ["low", "high", "high"]
    assert [r.confidence for r in graph.provenance_for_claim(g, by_rank=True).collect()] == ["high", "high", "low"]
    s = graph.NAMED["graph_stats"](g).first()
    assert (s.nodes, s.rels, s.papers) == (5 + 2, 4 + 7, 2)
    assert {r.entity_type: r.n for r in graph.NAMED["node_breakdown"](g).collect()}["Paper"] == 2
    assert graph.NAMED["provenance_violations"](g).count() == 0 and graph.key_violations(g).count() == 0
    with pytest.raises(TypeError):
        graph.NAMED["graph_stats"](g, limit=1)


def brute_k1(rows, limit):
    sol, con, mofs = {}, {}, {}
    for _, _, _, _, _, rel, _, s, _, o, _, _ in rows:
        {"IN_SOLVENT": sol, "AT_CONDITION": con}.get(rel, mofs.setdefault(rel, {})).setdefault(s, set()).add(o)
    out = {}
    for mof, linkers in mofs.get("USES_LINKER", {}).items():
        for m in mofs.get("SYNTHESIZED_BY", {}).get(mof, ()):
            for lk in linkers:
                for s in sol.get(m, {"unspecified"}):
                    for c in con.get(m, {"unspecified"}):
                        out.setdefault((lk, s, c), set()).add(mof)
    rows = [(lk, s, c, len(ms)) for (lk, s, c), ms in out.items()]
    return sorted(rows, key=lambda r: (-r[3], r[:3]))[:limit]


@pytest.mark.parametrize("limit", [3, 10, 500])
def test_k1_matches_brute_force(spark, limit):
    import random

    rng = random.Random(11)
    pick = {"USES_LINKER": (("MOF", "mof-{}", 12), ("OrganicLinker", "linker{}x", 4)), "SYNTHESIZED_BY": (("MOF", "mof-{}", 12), ("SynthesisMethod", "route{}x", 5)),
            "IN_SOLVENT": (("SynthesisMethod", "route{}x", 4), ("Solvent", "solv{}x", 6)), "AT_CONDITION": (("SynthesisMethod", "route{}x", 4), ("Condition", "{} h", 6))}
    rows = []
    for i in range(150):
        rel = rng.choice(list(pick))
        (st, s, n), (ot, o, k) = pick[rel]
        rows.append((i, 0, "P", "S", "x", rel, st, s.format(rng.randint(1, n)), ot, o.format(rng.randint(1, k)), "e", "high"))
    g = graph.build(graph.with_ordinal(spark.createDataFrame(rows, COLS)), spark.createDataFrame([], PAPERS))
    got = [(r.linker, r.solvent, r.condition, r.n_mofs) for r in graph.solvent_temperature_by_linker(g, limit).collect()]
    assert got == brute_k1(rows, limit)


def test_k1_meets_only_what_can_be_first(spark, monkeypatch):
    # solvent i and condition i belong to the routes from i on: all 3,600 pairs of their route sets differ and share a route
    rows = [(i, 0, "P", "S", "x", rel, "MOF", f"mof-{i}", ot, o, "e", "high") for i in range(60) for rel, ot, o in (("USES_LINKER", "OrganicLinker", "linker1x"), ("SYNTHESIZED_BY", "SynthesisMethod", f"route{i}x"))]
    rows += [(100 + i, r, "P", "S", "x", rel, "SynthesisMethod", f"route{r}x", ot, o.format(i), "e", "high") for i in range(60) for r in range(i, 60) for rel, ot, o in (("IN_SOLVENT", "Solvent", "solv{}x"), ("AT_CONDITION", "Condition", "{} h"))]
    staged, stage = {}, graph.stage_table

    def counting(df, name):
        out = stage(df, name)
        staged[name] = max(staged.get(name, 0), out.count())
        return out

    monkeypatch.setattr(graph, "stage_table", counting)
    g = graph.build(graph.with_ordinal(spark.createDataFrame(rows, COLS)), spark.createDataFrame([], PAPERS))
    got = [(r.linker, r.solvent, r.condition, r.n_mofs) for r in graph.solvent_temperature_by_linker(g, 5).collect()]
    assert got == brute_k1(rows, 5) and max(n for name, n in staged.items() if name in ("linker-rows", "linker-classes")) <= 20


def brute_k3(rows, limit):
    pre, lin, papers, out = {}, {}, {}, {}
    for _, _, paper, _, _, rel, _, s, _, o, _, _ in rows:
        papers.setdefault(s, set()).add(paper)
        {"USES_PRECURSOR": pre, "USES_LINKER": lin}.get(rel, {}).setdefault(s, set()).add(o)
    for mof in pre.keys() & lin.keys():
        for pair in itertools.product(pre[mof], lin[mof]):
            mofs, seen = out.setdefault(pair, (set(), set()))
            mofs.add(mof)
            seen |= papers[mof]
    return sorted(((*pair, len(m), len(p)) for pair, (m, p) in out.items()), key=lambda r: (-r[3], -r[2], r[:2]))[:limit]


@pytest.mark.parametrize(("limit", "n_papers"), [(1, 150), (3, 6), (10, 150), (500, 90), (0, 9)])
def test_k3_matches_brute_force(spark, limit, n_papers):
    import random

    rng = random.Random(n_papers)
    ends = {"USES_PRECURSOR": ("MetalPrecursor", "metal{}x", 7), "USES_LINKER": ("OrganicLinker", "linker{}x", 6), "HAS_PROPERTY": ("Property", "area {}", 40)}
    rows = []
    for i in range(400):
        rel = rng.choice(list(ends))
        ot, o, k = ends[rel]
        rows.append((i, 0, f"P{rng.randint(1, n_papers)}", "S", "x", rel, "MOF", f"mof-{int(14 * rng.random() ** 2)}", ot, o.format(rng.randint(1, k)), "e", "high"))
    t = graph.with_ordinal(spark.createDataFrame(rows, COLS))
    assert [tuple(r) for r in graph.precursor_linker_pairs(graph.outline(t), limit).collect()] == brute_k3(rows, limit)


def test_k3_of_a_framework_of_many_names(spark):
    # 150 precursors, 150 linkers and 3000 papers of one framework: 67.5 million rows, had they met
    rows = [(i, 0, f"P{i}", "S", "x", rel, "MOF", "mof-1", ot, f"{ot}{i % 300:03d}x", "e", "high") for i in range(1500, 4500) for rel, ot in [("USES_PRECURSOR", "MetalPrecursor") if i % 2 else ("USES_LINKER", "OrganicLinker")]]
    g = graph.outline(graph.with_ordinal(spark.createDataFrame(rows, COLS)))
    got = graph.precursor_linker_pairs(g, 2)
    assert [tuple(r) for r in got.collect()] == [("MetalPrecursor001x", "OrganicLinker000x", 1, 3000), ("MetalPrecursor001x", "OrganicLinker002x", 1, 3000)]


def test_outline_has_the_graphs_shape(spark, g):
    o = graph.outline(graph.with_ordinal(spark.createDataFrame(ROWS, COLS)))
    for name, cols in (("nodes", ["label", "key", "name"]), ("edges", ["src_label", "src_key", "rel", "dst_label", "dst_key"]), ("mentions", ["label", "key", "paper_id"]), ("papers", ["paper_id"])):
        assert sorted(map(str, getattr(o, name).select(cols).collect())) == sorted(map(str, getattr(g, name).select(cols).collect()))
    empty = graph.outline(graph.with_ordinal(spark.createDataFrame([], COLS)))
    assert graph.precursor_linker_pairs(empty).count() == 0


def test_empty_and_written(spark, g, tmp_path):
    none = graph.build(graph.with_ordinal(spark.createDataFrame([], COLS)), spark.createDataFrame([], PAPERS))
    assert tuple(graph.graph_stats(none).first()) == (0, 0, 0) and graph.node_breakdown(none).count() == 0 and graph.solvent_temperature_by_linker(none).count() == 0
    graph.write(g, str(tmp_path / "g"))
    assert graph.read(spark, str(tmp_path / "g")).edges.count() == g.edges.count()


def test_writer_is_the_callers(spark, sf):
    from passagekg.plans.graph_queries import _graph

    held = {}
    graph.write(_graph(spark, sf), lambda name, df: held.__setitem__(name, df.columns))
    assert list(held) == ["papers", "nodes", "edges", "mentions"] and held["nodes"] == ["label", "key", "name", "aliases"]
