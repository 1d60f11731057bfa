from pyspark.sql import functions as F

from passagekg.llm import sameness
from passagekg.sources.readers import RESULTS

TEXTS = [
    ("p1", "The ﬁlm was heated to 90 ℃", 1), ("p2", "The film was heated to 90 °C", 1), ("p3", "Тhe film was heated\xa0to 90 °C", 1), ("p1", "The ﬁlm was heated to 90 ℃", 2), ("p4", "the film was heated to 90 °C", 1), ("p5", "The film was heated to 9⁰ °C", 1),
    ("q1", "naïve", 1), ("q2", "naïve", 1), ("q3", "naive", 1), ("q4", "na​ïve", 1), ("c1", "copy", 1), ("c2", "copy", 1), ("n1", None, 1), ("n2", "  ", 1), ("n3", "\xa0 ", 1), ("x1", "长" * 9000, 1), ("x2", "长" * 9000 + "⁠", 1),
]


def values(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "key string, value string, plain int").select("key", "value")


def test_pairs(spark):
    got = {tuple(r) for r in sameness.pairs(values(spark)).collect()}
    assert got == {("p1", "p2"), ("p1", "p3"), ("p2", "p3"), ("q1", "q2"), ("q1", "q4"), ("q2", "q4"), ("x1", "x2")}


def test_canonical_is_one_per_class(spark):
    c = {(r.key, r.value): r.canonical for r in sameness.canonical(values(spark)).collect()}
    assert len({v for (k, _), v in c.items() if k in ("p1", "p2", "p3")}) == 1 and len({v for (k, _), v in c.items() if k in ("q1", "q2", "q4")}) == 1
    assert c[("q3", "naive")] == "naive" and c[("p4", "the film was heated to 90 °C")] == "the film was heated to 90 °C" and c[("n1", None)] is None
    assert sameness.canonical(values(spark).withColumn("canonical", F.lit(5))).columns == ["key", "value", "canonical"]
    again = {(r.key, r.value): r.canonical for r in sameness.canonical(values(spark, list(reversed(TEXTS)))).collect()}
    assert c == again


def test_names_within_one_row(spark):
    e = lambda n: ("T", n, None)
    t = lambda s, o: (e(s), "R", e(o), "", "", "", "", "")
    rows = [(3, [t("ZIF-8", "x"), None, t("ZIF‑8", "ＺIF-8"), (None, "R", e("ZIF-8"), "", "", "", "", "")]), (4, [t("ZIF-8", "zif-8"), t("K", "k")]), (5, [t("ΖIF-8", "H₂O"), t("a", "H2O")]), (6, None), (7, [t(f"n{i}", "b") for i in range(12)] + [t("ＺIF", "ZIF")])]
    r = spark.createDataFrame([(no, "p", "P", "S", "x", tr, 1, 0.0, 0.0, [], "r") for no, tr in rows], "line_no bigint, " + RESULTS)
    got = {(x.key_a, x.key_b) for x in sameness.pairs(sameness.name_values(r), ["row"]).collect()}
    assert got == {("3:00:s", "3:02:s"), ("3:00:s", "3:02:o"), ("3:02:o", "3:02:s"), ("3:02:s", "3:03:o"), ("3:02:o", "3:03:o"), ("7:12:o", "7:12:s")}


def test_empty(spark):
    v = values(spark).limit(0)
    assert sameness.pairs(v).count() == 0 and sameness.canonical(v).count() == 0


def test_names_of_different_rows_get_one_form(spark):
    e = lambda n: ("T", n, None)
    t = lambda s, o: (e(s), "R", e(o), "", "", "", "", "")
    rows = [(3, [t("ZIF-8", None), None]), (4, [t("ＺIF-8", "zif-8")]), (5, None), (6, [t("ZIF-8", " ")])]
    r = spark.createDataFrame([(no, "p", "P", "S", "x", tr, 1, 0.0, 0.0, [], "r") for no, tr in rows], "line_no bigint, " + RESULTS)
    p = values(spark).withColumnsRenamed({"key": "passage_id", "value": "text"})
    got = sameness.canonical_forms(p, r)
    assert got.columns == ["field", "key", "value", "canonical"] and got.where("field = 'text'").count() == len(TEXTS)
    assert {x.key: x.canonical for x in got.where("field = 'name'").collect()} == {"3:00:s": "ZIF-8", "4:00:s": "ZIF-8", "4:00:o": "zif-8", "6:00:s": "ZIF-8", "6:00:o": " "}
