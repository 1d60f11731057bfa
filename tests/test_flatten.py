import json

from passagekg.operators import flatten
from passagekg.sources.readers import GOLD, RESULTS

R = "line_no bigint, src string, " + RESULTS
G = "line_no bigint, key int, " + GOLD


def entity(name, kind="MOF"):
    return (kind, name, [1, 5])


def result(no, triples):
    return (no, "clash", "p", "paper", "Methods", "x", triples, 1, 0.1, 1.0, [], "2021")


def triple(s, o):
    return (s, "USES_LINKER", o, "said", "high", "paper", "Methods", "x")


def test_results_positions_and_links(spark):
    rows = [
        result(1, [triple(entity("A"), entity("B")), None, triple(None, entity(" ")), triple(entity("C"), entity(None))]), result(2, None), result(3, []),
        result(4, [triple(entity("A"), entity("B"))]), result(5, [triple(entity("A"), entity("B"))]),
    ]
    e = flatten.emit_results(spark.createDataFrame(rows, R))
    got = {(r.line_no, r.triple_ix, r.role) for r in flatten.apply_schema(e, "entity").collect()}
    assert got == {(1, 0, "subject"), (1, 0, "object"), (1, 2, "object"), (1, 3, "subject"), (1, 3, "object"), (4, 0, "subject"), (4, 0, "object"), (5, 0, "subject"), (5, 0, "object")}
    assert flatten.apply_schema(e, "record").count() == 5 and flatten.apply_schema(e, "triple").count() == 5
    t = {r.key for r in flatten.apply_schema(e, "triple").collect()}
    assert all(r.parent_key in t for r in flatten.apply_schema(e, "entity").collect())
    first = flatten.apply_schema(e, "entity").where("name = 'A'").first()
    assert (first.type, first.span_start, first.span_end) == ("MOF", 1, 5)


def test_empty_tables(spark):
    e = flatten.emit_all(spark.createDataFrame([], R), spark.createDataFrame([], G), spark.createDataFrame([], "line_no bigint, payload string"))
    assert flatten.endpoints(e).count() == 0


LINES = [
    json.dumps({"triples": [{"subject": {"name": "A"}, "relation": "R", "object": "B"}, None, {"subject_name": "C", "relation": "R", "object_name": " "}], "more": 1}),
    json.dumps({"triples": {"items": [{"subject": "A", "relations": [{"relation": "R", "object": {"name": "B"}}, {"relation": "S", "object": None}]}, {"subject": {"name": "D"}, "relation": "R"}], "count": 2}}),
    json.dumps({"triples": json.dumps([{"subject": {"name": "A"}, "relation": "R", "object": {"name": "B"}}])}),
    json.dumps({"triples": {"subject": {"name": "A"}, "relation": "R", "object": {"name": "B"}}}),
    '{"triples": [{"subject": {"name": "A"}', "", None, "[1]", "{}", '{"triples": null}', '{"triples": "not json"}', '{"triples": {}}', "nan",
]


def test_raw_shapes(spark):
    raw = spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, payload string")
    e = flatten.emit_raw(raw)
    got = {(r.line_no, r.triple_ix, r.role, r.name) for r in flatten.apply_schema(e, "entity").collect()}
    ab = {("subject", "A"), ("object", "B")}
    want = {(0, 0, *x) for x in ab} | {(0, 2, "subject", "C"), (0, 2, "object", " ")} | {(1, 0, *x) for x in ab} | {(1, 1, "subject", "A"), (1, 2, "subject", "D")} | {(2, 0, *x) for x in ab} | {(3, 0, *x) for x in ab}
    assert got == want
    assert [(r.line_no, r.owner, r.name, r.value) for r in flatten.apply_schema(e, "field").orderBy("line_no").collect()] == [(0, "record", "more", "1"), (1, "record", "triples.count", "2"), (10, "record", "triples", '"not json"')]
    assert flatten.endpoints(e).count() == len(want) - 1  # the blank name


def test_written_by_tag(spark, tmp_path):
    raw = spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, payload string")
    path = flatten.write_tagged(flatten.emit_raw(raw), str(tmp_path / "flat"))
    assert {p.name for p in (tmp_path / "flat").iterdir() if p.is_dir()} == {"tag=record", "tag=triple", "tag=entity", "tag=field"}
    assert flatten.read_flat(spark, path, "entity").count() == 12


def test_nothing_is_lost(spark):
    deep = "[" * 30_000 + "]" * 30_000
    lines = [
        '{"passage_id": "p", "errors": ["a", 5], "cas": [1], "n_triples": "many", "x": %s, "triples": [{"subject": {"name": "A", "type": "MOF", "cas": {"no": 7}, "span": [1, 2, 3]}, "relation": "R", "note": "n", "page": 4, "object": "B", "confidence": 0.5}, "odd"]}' % deep,
        json.dumps({"triples": [{"subject_name": "S", "subject_type": "MOF", "lot": 9, "relations": [{"relation": "R", "object_name": "O", "lot": 1}, {"relation": "T", "object": 5}, 7]}]}),
    ]
    e = flatten.emit_raw(spark.createDataFrame(list(enumerate(lines)), "line_no bigint, payload string")).cache()
    fields = {(r.parent_key, r.owner, r.name, r.value) for r in flatten.apply_schema(e, "field").collect()}
    assert fields == {
        ("raw_lines:0", "record", "cas", "[1]"), ("raw_lines:0", "record", "n_triples", '"many"'), ("raw_lines:0", "record", "x", deep), ("raw_lines:0", "record", "triples.1", '"odd"'),
        ("raw_lines:0:0", "triple", "page", "4"), ("raw_lines:0:0:subject", "entity", "cas", '{"no":7}'), ("raw_lines:0:0:subject", "entity", "span", "[1,2,3]"),
        ("raw_lines:1", "record", "triples.0.relations.2", "7"), ("raw_lines:1:0", "triple", "lot", "1"), ("raw_lines:1:1", "triple", "lot", "9"), ("raw_lines:1:1", "triple", "object", "5"),
    }
    assert {(r.parent_key, r.ordinal, r.message) for r in flatten.apply_schema(e, "error").collect()} == {("raw_lines:0", 0, "a"), ("raw_lines:0", 1, "5")}
    triples = {r.key: (r.relation, r.note, r.confidence, r.form) for r in flatten.apply_schema(e, "triple").collect()}
    assert triples == {"raw_lines:0:0": ("R", "n", "0.5", "object"), "raw_lines:1:0": ("R", None, None, "group"), "raw_lines:1:1": ("T", None, None, "group")}
    ends = {(r.key, r.type, r.name) for r in flatten.apply_schema(e, "entity").collect()}
    assert ends == {("raw_lines:0:0:subject", "MOF", "A"), ("raw_lines:0:0:object", None, "B"), ("raw_lines:1:0:subject", "MOF", "S"), ("raw_lines:1:0:object", None, "O"), ("raw_lines:1:1:subject", "MOF", "S")}


def test_deep_json_is_read_and_written_like_plain_json():
    samples = ['{"a":[1,2,{"b":null,"c":"x\\n"}],"d":-1.5e3,"e":{}}', "[]", "{}", "[1,]", '{"a":}', '{"a" 1}', "{,}", "[1 2]", "[[1]", "1", "", '{"a":1}}', '{"a":1,}', "[,1]", "nan", '[{"a":[]},[true,false]]']
    for text in samples:
        try:
            want = json.loads(text)
        except ValueError:
            want = ValueError
        try:
            got = flatten._parse_deep(text)
        except ValueError:
            got = ValueError
        assert got == want, text
    deep = "[" * 20_000 + '{"k":"v"}' + "]" * 20_000
    assert flatten.dump_json(flatten.parse_json(deep)) == deep
