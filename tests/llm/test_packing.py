import random

from pyspark.sql import functions as F

from passagekg.llm import packing

SCHEMA = "doc_id bigint, text string, container int"


def test_patterns_use_every_item_once_and_fit():
    rng = random.Random(3)
    for hist in ({1: 5}, {2047: 3, 1: 2}, {700: 9, 1400: 4}, {rng.randint(1, 2047): rng.randint(1, 60) for _ in range(120)}):
        bound = packing.solve(dict(hist))[2]
        patterns = packing.patterns_of(dict(hist))
        used = {}
        for p, k in patterns:
            assert k > 0 and sum(x * c for x, c in p.items()) <= packing.CAPACITY
            for x, c in p.items():
                used[x] = used.get(x, 0) + c * k
        assert used == hist
        containers = sum(k for _, k in patterns)
        assert bound <= containers + 1e-6
        big = sum(n for x, n in hist.items() if x > packing.CAPACITY // 2)
        assert containers <= 1.04 * max(bound, big) + 2


def test_pack_places_all_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 7)  # many rank buckets, as with billions of texts
    rng = random.Random(1)
    rows = [(i, " ".join("ab" for _ in range(rng.randint(1, 900))), 1) for i in range(60)]
    rows += [(100 + i, "same text here", 1) for i in range(50)]  # ties, copies
    rows += [(200, None, 1), (201, "", 1), (202, "word " * 9000, 1), (203, "x" * 20_000, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = packing.pack(docs).cache()
    n = {r.doc_id: r.n_tokens for r in packing.sizes(docs).collect()}
    assert set(n) == {r[0] for r in rows} - {200, 201}
    got = out.collect()
    per, room = {}, {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.part_ix, r.token_start, r.size))
        room[r.container] = room.get(r.container, 0) + r.size
    assert max(room.values()) <= packing.CAPACITY
    for d, ps in per.items():
        ps.sort()
        assert sum(p[2] for p in ps) == n[d] and [p[1] for p in ps] == [packing.CAPACITY * i for i in range(len(ps))]
        assert len(ps) == 1 or n[d] > packing.CAPACITY
    assert sorted(room) == list(range(len(room)))
    s = packing.summary(out).first()
    assert s.containers <= s.least + 1 and s.tokens == sum(n.values())


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(docs).count() == 0
    assert packing.pack(spark.createDataFrame([(1, None, 1)], SCHEMA)).where(F.lit(True)).count() == 0


def test_linear_program_is_solved_near_its_bound():
    rng = random.Random(5)
    for hist in ({x: rng.randint(1, 400) for x in rng.sample(range(1, 2048), 1500)}, {x: rng.randint(1, 50) for x in rng.sample(range(700, 2048), 600)}, {30: 100_000, **{x: 3 for x in range(900, 1300)}}):
        counts, value, bound, _ = packing.solve(hist)
        assert bound <= value * (1 + 1e-9) and value <= 1.01 * bound
        used = {}
        for pattern, k in counts.items():
            assert sum(x * c for x, c in pattern) <= packing.CAPACITY
            for x, c in pattern:
                used[x] = used.get(x, 0) + c * k
        assert all(used[x] <= hist[x] * (1 + 1e-9) for x in used)


def test_weights_are_learned_between_passes():
    rng = random.Random(5)
    hist = {x: rng.randint(1, 400) for x in rng.sample(range(1, 2048), 1500)}
    learned = packing.solve(hist)[3]
    assert learned[-100:].mean() > 1.05 * learned[:100].mean()  # long items are hard to place and become dear
