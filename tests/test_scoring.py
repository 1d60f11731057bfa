"""Evaluation, agreement, ontology checks."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from passagekg.operators import agreement, evaluate, ontology

COLS = "line_no bigint, triple_ix int, passage_id string, paper_id string, source_paper_id string, source_section string, extractor string, relation string, subject_type string, subject_name string, object_type string, object_name string, evidence string, confidence string, s_tokens int"
TYPES = {"USES_LINKER": ("MOF", "OrganicLinker"), "IN_SOLVENT": ("SynthesisMethod", "Solvent"), "AT_CONDITION": ("SynthesisMethod", "Condition")}


def t(rel, s, o, passage="p", extractor="x", n=itertools.count()):
    st, ot = TYPES.get(rel, ("MOF", "OrganicLinker"))
    return (next(n), 0, passage, "P", passage, "S", extractor, rel, st, s, ot, o, "said", "high", 1)


def table(spark, rows):
    return spark.createDataFrame(rows, COLS)


def counts(spark, pred, gold, mode="exact"):
    f = evaluate.counts_exact if mode == "exact" else evaluate.counts_relaxed
    return {(r.extractor, r.relation): (r.tp, r.fp, r.fn) for r in f(table(spark, pred), table(spark, gold)).collect()}


def test_one_to_one_and_modes(spark):
    gold = [t("USES_LINKER", "ZIF-8", "H3BTC")]
    pred = [t("USES_LINKER", "zif 8", "trimesic acid"), t("USES_LINKER", "ZIF-8", "BTC"), t("USES_LINKER", "ZIF-8", "BTC")]
    assert counts(spark, pred, gold) == {("x", "USES_LINKER"): (1, 2, 0)} == counts(spark, pred, gold, "relaxed")
    a, b = [t("USES_LINKER", "UiO-66", "copper(II) nitrate salt")], [t("USES_LINKER", "UiO-66", "copper nitrate salt")]
    assert counts(spark, a, b) == {("x", "USES_LINKER"): (0, 1, 1)} and counts(spark, a, b, "relaxed") == {("x", "USES_LINKER"): (1, 0, 0)}
    a, b = [t("USES_LINKER", "UiO-66", "a b")], [t("USES_LINKER", "UiO-67", "a b")]
    assert counts(spark, a, b, "relaxed") == {("x", "USES_LINKER"): (0, 1, 1)}


def test_concession_nulls_and_passages(spark):
    gold = [t("IN_SOLVENT", "ZIF-8", "DMF"), t("USES_LINKER", None, "BTC", None), t("USES_LINKER", "A-1", "BTC", None), t(None, "a", "b"), t("ODD", "a", "b")]
    pred = [t("IN_SOLVENT", "solvothermal", "dmf"), t("USES_LINKER", None, "BTC", None), t("USES_LINKER", "A-1", "H3BTC", None), t("USES_LINKER", "A-1", "H3BTC", "q", "y"), t("ODD", "a", "b")]
    got = counts(spark, pred, gold)
    assert got[("x", "IN_SOLVENT")] == (1, 0, 0) and got[("x", "USES_LINKER")] == (1, 1, 1) and got[("y", "USES_LINKER")] == (0, 1, 2) and got[("y", "IN_SOLVENT")] == (0, 0, 1)
    p, g = table(spark, pred), table(spark, gold)
    assert {(r.relation, r.n) for r in evaluate.skipped_relations(p, g).collect()} == {(None, 1), ("ODD", 2)}
    assert evaluate.n_passages(p, g).first()[0] == 3


def test_micro_and_macro(spark):
    pred = [t("USES_LINKER", "A-1", f"linker{i}") for i in range(10)] + [t("AT_CONDITION", "m", "1 h")]
    gold = [t("USES_LINKER", "A-1", f"linker{i}") for i in range(10)] + [t("AT_CONDITION", "m", "2 h")]
    c = evaluate.counts_exact(table(spark, pred), table(spark, gold))
    assert abs(evaluate.micro(c).first().f1 - 10 / 11) < 1e-5
    m = evaluate.macro(c).first()
    assert m.macro_f1 == 0.5 and m.macro_fields == "AT_CONDITION,USES_LINKER"
    published = spark.createDataFrame([("x", "USES_LINKER", 16, 10, 14), ("x", "AT_CONDITION", 7, 43, 27), ("x", "NONE", 0, 0, 0)], "extractor string, relation string, tp int, fp int, fn int")
    s = {r.relation: (round(r.precision, 3), round(r.recall, 3), round(r.f1, 3)) for r in evaluate.scores(published).collect()}
    assert s == {"USES_LINKER": (0.615, 0.533, 0.571), "AT_CONDITION": (0.14, 0.206, 0.167), "NONE": (0.0, 0.0, 0.0)}


def brute_greedy(pred, gold, sim):
    pairs = sorted((-sim(p, g), gi, pi) for pi, p in enumerate(pred) for gi, g in enumerate(gold) if sim(p, g) > 0)
    up, ug = set(), set()
    for _, gi, pi in pairs:
        if pi not in up and gi not in ug:
            up.add(pi)
            ug.add(gi)
    return len(up)


def test_greedy_matches_brute_force(spark):
    rng = random.Random(7)
    words = ["red", "blue", "big", "acid", "salt"]
    name = lambda: " ".join(rng.sample(words, rng.randint(1, 4)))
    pred, gold, want = [], [], 0

    def sim(a, b):
        x, y = set(a.split()), set(b.split())
        j = len(x & y) / len(x | y)
        return 1.0 if a == b else j if j >= 0.6 else 0.0

    for i in range(25):
        ps, gs = [name() for _ in range(rng.randint(0, 5))], [name() for _ in range(rng.randint(0, 5))]
        pred += [t("IN_SOLVENT", "m", n, f"p{i}") for n in ps]
        gold += [t("IN_SOLVENT", "m", n, f"p{i}") for n in gs]
        want += brute_greedy(ps, gs, sim)
    assert counts(spark, pred, gold, "relaxed")[("x", "IN_SOLVENT")] == (want, len(pred) - want, len(gold) - want)


def test_diagnostics_agree_with_counts(spark):
    gold = [t("USES_LINKER", "A-1", "x y z"), t("USES_LINKER", "B-1", "q")]
    pred = [t("USES_LINKER", "A-1", "x y z w"), t("USES_LINKER", "A-1", "x y z"), t("USES_LINKER", "C-1", "q")]
    p, g = table(spark, pred), table(spark, gold)
    m = evaluate.greedy(evaluate.candidates(p, g))
    fp, fn = evaluate.false_positives(p, m), evaluate.false_negatives(g, m, ["x"])
    assert counts(spark, pred, gold, "relaxed") == {("x", "USES_LINKER"): (m.count(), fp.count(), fn.count())} == {("x", "USES_LINKER"): (1, 2, 1)}
    assert evaluate.examples(fp, 1).count() == 1 and {r.object_name for r in fp.collect()} == {"x y z w", "q"}


def test_mismatches(spark):
    pred = [t("USES_LINKER", "A-1", "x"), t("USES_LINKER", "A-1", "y"), t("USES_LINKER", "B-1", "x"), t("IN_SOLVENT", "m", "water")]
    gold = [t("USES_LINKER", "A-1", "z"), t("USES_LINKER", "A-1", "y"), t("USES_LINKER", "C-1", "x"), t("IN_SOLVENT", "n", "DMF")]
    assert {(r.relation, r.n) for r in evaluate.value_mismatches(table(spark, pred), table(spark, gold)).collect()} == {("USES_LINKER", 1)}


def test_empty_sides(spark):
    rows = [t("USES_LINKER", "A-1", "x")]
    assert counts(spark, rows, []) == {("x", "USES_LINKER"): (0, 1, 0)} and counts(spark, [], rows) == {}
    assert evaluate.value_mismatches(table(spark, []), table(spark, rows)).count() == 0


def test_runs(spark):
    r = spark.createDataFrame([(1, "p", "x", "2021", 1, 0.1, 5.0, ["client call failed: 1"]), (2, "p", "x", "2022", 3, 0.2, 7.0, None), (3, "q", None, None, None, None, None, [])], "line_no bigint, passage_id string, extractor string, run_at string, n_triples int, cost_usd double, latency_ms double, errors array<string>")
    assert {x.line_no for x in evaluate.latest_runs(r).collect()} == {2, 3}
    o = {x.extractor: (x.calls, x.failed_calls, x.mean_latency_ms) for x in evaluate.operations(r).collect()}
    assert o == {"x": (2, 1, 6.0), None: (1, 0, None)} and {x.n_with_errors for x in evaluate.run_summary(r).where("extractor = 'x'").collect()} == {1}


def test_agreement(spark):
    cols = "paper_id string, field string, values array<string>"
    ours = spark.createDataFrame([("a", "linker", ["H3BTC"]), ("a", "solvent", ["DMF", "water"]), ("b", "linker", ["x"]), ("c", "linker", ["copper nitrate salt"]), ("a", "empty", [None])], cols)
    ref = spark.createDataFrame([("a", "linker", ["trimesic acid", " "]), ("a", "solvent", ["dmf", "H2O", "ethanol"]), ("b", "linker", ["n/a", None]), ("c", "linker", ["copper(II) nitrate salt"]), ("a", "time", ["1 h"])], cols)
    c = agreement.compared(ours, ref)
    rep = {r.field: (r.comparable, r.agreed, r.disagreed, r.not_comparable, r.agreement_rate) for r in agreement.report(c).collect()}
    assert rep["linker"] == (2, 1, 1, 1, 0.5) and rep["solvent"][:3] == (1, 0, 1) and rep["time"][:3] == (1, 0, 1) and rep["empty"] == (0, 0, 0, 3, None)
    assert c.where("field = 'solvent' AND paper_id = 'a'").first().overlap == pytest.approx(2 / 3, abs=1e-6)
    relaxed = {r.field: r.agreed for r in agreement.report(agreement.compared(ours, ref, "relaxed")).collect()}
    assert relaxed["linker"] == 2
    assert agreement.missing_records(ours, ref.where("paper_id <> 'c'")).first()[0] == 1
    assert agreement.report(agreement.compared(ours.limit(0), ref)).count() == 0


ONTO = [("USES_LINKER", "MOF", "OrganicLinker"), ("MENTIONED_IN", "*", "Paper")]


def test_ontology(spark, tmp_path):
    o = spark.createDataFrame(ONTO, "relation string, from_type string, to_type string")
    rows = [("USES_LINKER", "MOF", "OrganicLinker"), ("USES_LINKER", "MOF", "Solvent"), ("USES_LINKER", None, None), ("MENTIONED_IN", "MOF", "Paper"), ("ODD", "a", "b"), (None, "a", "b")]
    x = spark.createDataFrame([(*r, "s", "o", "e", "high") for r in rows], "relation string, subject_type string, object_type string, subject_name string, object_name string, evidence string, confidence string")
    assert ontology.violations(x, o).count() == 2
    v = [(r.relation, r.valid) for r in ontology.validity(x, o).collect()]
    assert sorted(v, key=str) == sorted([("USES_LINKER", True), ("USES_LINKER", False), ("USES_LINKER", False), ("MENTIONED_IN", False), ("ODD", False), (None, False)], key=str)
    assert ontology.writable(x, o).where("accepted").count() == 1 and ontology.writable(x.withColumn("evidence", F.lit(" ")), o).where("accepted").count() == 0
    assert {(r.side, r.entity_type) for r in ontology.endpoints(o).collect()} == {("subject", "MOF"), ("object", "OrganicLinker")}
    path = tmp_path / "o.json"
    path.write_text('{"relations": {"USES_LINKER": {"from": "MOF", "to": "OrganicLinker"}, "BAD": {}}}')
    assert ontology.read_ontology(spark, str(path)).count() == 1
    assert ontology.read_ontology(spark, str(tmp_path / "none"), "tolerant").count() == 0
    with pytest.raises(ValueError, match="drift"):
        ontology.read_ontology(spark, str(path), "strict")
    with pytest.raises(OSError):
        ontology.read_ontology(spark, str(tmp_path / "none"))


def test_agreement_of_every_extractor(spark, sf):
    import __spark_entry__ as entry

    q, results = entry.queries(), spark.read.parquet(f"{sf}/results.parquet")
    rows = q["ref_a8_agreement"](spark, sf).collect()
    with_field = results.where("passage_id IS NOT NULL AND exists(triples, t -> t IS NOT NULL AND upper(trim(t.relation)) = 'IN_SOLVENT')").select("extractor").distinct()
    assert {r.extractor for r in with_field.collect()} <= {r.extractor for r in rows} and len({r.extractor for r in rows}) > 1
    assert {r.extractor for r in q["ref_a8_relaxed"](spark, sf).collect()} == {r.extractor for r in rows}
