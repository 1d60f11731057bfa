import random

from passagekg.llm import mixing

DOCS = "doc_id bigint, text string, source string, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def test_flight_keeps_balance_and_expectation():
    rng = random.Random(5)
    tokens = [float(rng.randint(1, 500)) for _ in range(400)]
    pi = [0.37] * 400
    mean = [0.0] * 400
    for run in range(60):
        out = mixing.flight(tokens, pi, random.Random(run))
        undecided = [p for p in out if 0 < p < 1]
        assert len(undecided) <= 2
        assert abs(sum(t * p for t, p in zip(tokens, out)) - 0.37 * sum(tokens)) < 1e-3
        assert abs(sum(out) - 0.37 * 400) < 1e-6
        mean = [m + p / 60 for m, p in zip(mean, out)]
    assert abs(sum(mean) / 400 - 0.37) < 1e-6 and 0.05 < min(mean) and max(mean) < 0.75


def test_equal_sizes_and_degenerate():
    out = mixing.flight([5.0] * 30, [0.5] * 30, random.Random(1))
    assert abs(sum(out) - 15) < 1e-9 and sum(0 < p < 1 for p in out) <= 2
    assert mixing.flight([], [], random.Random(1)) == [] and mixing.landing([], []) == []
    assert mixing.landing([10.0, 90.0], [0.5, 0.6]) == [0.0, 1.0]


def test_mixture_reaches_shares(spark):
    rng = random.Random(2)
    rows = []
    for source, n in (("a", 900), ("b", 300), ("c", 40), (None, 50), ("untargeted", 50)):
        rows += [(len(rows) + i, " ".join("word" for _ in range(rng.randint(1, 200))), source, 9) for i in range(n)]
    rows += [(10_000, None, "a", 0), (10_001, "", "b", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("absent", 0.1, 3)], TARGETS)
    mixed = mixing.mixture(docs, targets)
    got = mixed.collect()
    ids = [r.doc_id for r in got]
    assert len(ids) == len(set(ids)) and {r.source for r in got} == {"a", "b", "c"}
    cap = {"a": 1, "b": 2, "c": 4}
    assert all(1 <= r.copies <= cap[r.source] for r in got)
    by = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    for s, w in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        assert abs(by[s].share - w) < 0.01
    assert by["absent"].tokens == 0 and by["absent"].share == 0
    assert sorted(ids) == sorted(r.doc_id for r in mixing.mixture(docs, targets).collect())


def test_many_blocks(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("'s' AS source", "id AS doc_id", "1 + id % 97 AS n_tokens", "0.25D AS pi")
    drawn = [r for r in mixing.sample(rows, block=100).collect() if r.pi == 1.0]
    total = sum(1 + i % 97 for i in range(3000))
    assert len(drawn) == len({r.doc_id for r in drawn}) and abs(len(drawn) - 750) <= 2
    assert abs(sum(r.n_tokens for r in drawn) - total / 4) <= 100


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixed = mixing.mixture(docs, targets)
    assert mixed.count() == 0 and mixing.shares(mixed, targets).first().share == 0


def test_copies_of_a_text_are_one_text(spark):
    rows = [(i, f"text {i % 20} " * 20, "a", 0) for i in range(200)] + [(1000 + i, f"other {i} " * 20, "b", 0) for i in range(40)]
    rows += [(2000 + i, f"shared {i} " * 20, "ab"[i % 2], 0) for i in range(10)] + [(3000 + i, f"shared {i} " * 20, "ba"[i % 2], 0) for i in range(10)]
    text = {r[0]: r[1] for r in rows}
    got = mixing.mixture(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], TARGETS)).collect()
    used = {}
    for r in got:
        used[text[r.doc_id]] = used.get(text[r.doc_id], 0) + r.copies
    assert len(got) == len(used) and len(used) > 40
    assert all(n <= (3 if t.startswith("other") else 1) for t, n in used.items())
    tokens = {s: sum(r.n_tokens * r.copies for r in got if r.source == s) for s in "ab"}
    assert abs(tokens["a"] / sum(tokens.values()) - 0.5) < 0.02


def test_level():
    assert mixing.level(30.0, [(1, 10.0), (3, 10.0)]) == 2.0 and mixing.level(5.0, [(1, 10.0)]) == 0.5 and mixing.level(40.0, [(1, 10.0), (3, 10.0)]) == 3.0
