import random

import pytest
from pyspark.sql import functions as F

from passagekg.llm import split

SCHEMA = "paper_id string, sections array<struct<name:string,text:string>>, section_ix int"


def sentences(n, seed=0):
    rng = random.Random(seed)
    return " ".join("w" * rng.randint(1, 9) + " " + "x" * rng.randint(2, 80) + rng.choice([".", "?", ", e.g."]) for _ in range(n))


def check(text, start, end, cuts):
    assert cuts[0][0] == start and cuts[-1][1] == end
    for a, b in cuts:
        assert 0 < b - a <= split.LIMIT
    for (_, b), (c, _) in zip(cuts, cuts[1:]):
        assert b - c == split.OVERLAP


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(split, "RANGE", 5000)


def brute(text):
    at = 0
    for run in text.split("\n"):
        body = run.strip()
        if len(body) > split.LIMIT:
            yield at + len(run) - len(run.lstrip()), at + len(run.rstrip())
        at += len(run) + 1


def test_paragraphs_and_pieces_over_ranges(spark, small):
    texts = [
        sentences(900), "a" * 2500, "b" * 2501, "", None, "  " + "c" * 12000 + "  \n" + sentences(200, 1) + "\n\n" + "𝒂" * 2600,
        "\n" * 40 + " " * 9000 + sentences(100, 2) + " " * 7000 + "\nshort", sentences(40, 3) + "\n" + "z" * 5000, " " * 6000,
    ]
    rows = [("p", [("s", t) for t in texts], 1), ("p", [("s", t) for t in texts], 2), (None, None, None), ("q", [], 0), ("r", [None], 0)]
    papers = spark.createDataFrame(rows, SCHEMA)
    found = {tuple(r) for r in split.oversized(papers).collect()}
    assert found == {("p", i, a) for i, t in enumerate(texts) if t for a, _ in brute(t)}
    got = split.section_pieces(papers).collect()
    for i, t in enumerate(texts):
        for a, b in brute(t or ""):
            mine = sorted((r.char_start, r.char_end, r.text) for r in got if (r.paper_id, r.section_ix, r.para_start) == ("p", i, a))
            check(t, a, b, [m[:2] for m in mine])
            assert all(t[x:y] == z for x, y, z in mine)


def test_cuts_are_natural():
    text = sentences(300, 5)
    cuts = list(split.range_pieces(0, 0, len(text), len(text), text, 0, len(text)))
    check(text, 0, len(text), cuts)
    for _, b in cuts[:-1]:
        assert text[:b].rstrip()[-1] in ".?" and not text[:b].rstrip().endswith("e.g.")


def test_files_are_read_by_range(spark, tmp_path, small):
    text = "é" + sentences(600, 7) + "\n\n" + "𝒂b" * 4000 + "\n" + sentences(80, 8) + "\nend"
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    got = split.pieces(split.file_ranges(spark, str(tmp_path), byte_range=4096), ["doc"]).orderBy("char_start").collect()
    assert {r.para_start for r in got} == {a for a, _ in brute(text)}
    for a, b in brute(text):
        mine = [r for r in got if r.para_start == a]
        check(text, a, b, [(r.char_start, r.char_end) for r in mine])
        assert [r.piece_ix for r in mine] == list(range(len(mine))) and all(r.text == text[r.char_start : r.char_end] for r in mine)


def test_stored_sections_give_the_pieces_of_the_table(spark, small):
    texts = [sentences(300), "short", "a" * 2501, None, "  " + "c" * 12000 + "  \n" + sentences(200, 1)]
    papers = spark.createDataFrame([("p", [("s", t) for t in texts], 1), ("p", [("s", t) for t in texts], 1), ("q", [("s", sentences(60, 4))], 2)], SCHEMA)
    rows = lambda df: sorted(map(tuple, df.select("paper_id", "section_ix", "para_start", "char_start", "char_end", "text").collect()))
    stored, cells = rows(split.stored_pieces(papers)), rows(split.section_pieces(papers))
    # ranges lie elsewhere in a file than in a cell, so cuts may differ; what is covered may not
    cover = lambda got: {(k, s, p): max(r[4] for r in got if r[:3] == (k, s, p)) for k, s, p, *_ in got}
    assert cover(stored) == cover(cells) and len(stored) == len(set(stored))
    for k, s, p in cover(stored):
        text = texts[s] if k == "p" else sentences(60, 4)
        check(text, p, cover(stored)[k, s, p], [r[3:5] for r in stored if r[:3] == (k, s, p)])
        assert all(text[r[3] : r[4]] == r[5] for r in stored if r[:3] == (k, s, p))
    assert split.coverage(split.stored_pieces(papers)).where("fits AND overlaps").count() == len(cover(stored))


def test_a_run_without_boundary_is_entered_at_its_edge():
    text = "First words. " * 60 + "x" * 4000
    cuts = list(split.range_pieces(0, 0, len(text), len(text), text, 0, len(text)))
    check(text, 0, len(text), cuts)
    assert cuts[0][1] == len("First words. " * 60)


def test_empty_table(spark):
    papers = spark.createDataFrame([], SCHEMA)
    assert split.oversized(papers).count() == 0 and split.section_pieces(papers).count() == 0
    assert split.section_pieces(papers).where(F.lit(True)).columns[-1] == "text" and split.stored_pieces(papers).count() == 0
