"""Runner, model extraction, ingestion, readers, sinks, annotation, reference tables, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from passagekg.operators import annotate, evaluate, ingest, model_extract, reference, runner
from passagekg.sources import readers, sinks

PASSAGES = "passage_id string, paper_id string, section_name string, text string, is_synthesis boolean"
ENDS = {"USES_LINKER": ("MOF", "OrganicLinker"), "MENTIONED_IN": ("*", "Paper")}
GOOD = {"subject": {"type": "MOF", "name": " ZIF-8 ", "span": [0, 5]}, "relation": "uses linker", "object": {"entity_type": "OrganicLinker", "text": "HmIM"}, "evidence": "said", "confidence": "HIGH"}


def rows(spark):
    return spark.createDataFrame([(f"p{i}", "P", "S", f"ZIF-8 made with H2BDC {i}", i != 2) for i in range(4)], PASSAGES)


def test_resume(spark):
    p = rows(spark)
    first = runner.run(p.limit(2), [runner.RuleExtractor()], stamp="2021")
    both = runner.run(p, [runner.RuleExtractor()], first, stamp="2022")
    assert first.count() == 2 and both.count() == 2 and not {r.passage_id for r in first.collect()} & {r.passage_id for r in both.collect()}
    broken = runner.RowExtractor("b", lambda t, *_: 1 / 0)
    failed = runner.run(p, [broken], stamp="x")
    assert all(r.errors[0].startswith("CONTRACT VIOLATION ZeroDivisionError") for r in failed.collect())
    assert runner.run(p, [broken], failed).count() == 0 and runner.run(p, [broken], failed, retry_errors=True).count() == 4
    assert runner.run(p.union(p), [runner.RuleExtractor()]).count() == 8 and runner.run(p.union(p), [runner.RuleExtractor()], distinct=True).count() == 4
    assert runner.open_calls(p, ["a", "b"], failed.withColumn("extractor", F.lit("b"))).count() == 4
    assert runner.runner_passages(p).count() == 3


def test_specs():
    assert runner.extractor_of("rule").name == "rule_based_v1"
    assert runner.extractor_of("a:b:c", lambda *x: x) == ("a", "b", "c")
    for bad in ("", "a:b", "a::c", "nope"):
        with pytest.raises(ValueError):
            runner.extractor_of(bad, lambda *x: x)


REPLIES = {
    json.dumps([GOOD]): (1, 0), "```json\n" + json.dumps([GOOD]) + "\n```": (1, 0), "I think [see 1]. FINAL JSON: " + json.dumps({"triples": [GOOD]}): (1, 1), json.dumps(GOOD): (1, 1),
    '{"triples": [' + json.dumps(GOOD) + ",],}": (1, 1), "no json here": (0, 1), "": (0, 1), "42": (0, 1), json.dumps([{**GOOD, "relation": "MENTIONED_IN"}]): (0, 1), json.dumps([{**GOOD, "evidence": " "}]): (0, 1),
    json.dumps([{**GOOD, "object": {"type": "Solvent", "name": "x"}}, GOOD, 5, {**GOOD, "relation": "ODD"}, {**GOOD, "subject": None}]): (1, 4), json.dumps([{**GOOD, "confidence": 3}]): (1, 1),
    'text {"triples": [' + json.dumps(GOOD) + "]} tail": (1, 1), "null": (0, 1), '{"a": 1}': (0, 1),
}


def test_replies(spark):
    texts = [*REPLIES, None]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no bigint, reply string")
    got = {texts[r.line_no]: (r.triples, r.errors) for r in model_extract.parsed_replies(df, ENDS).collect()}
    sizes = {k: (len(t), len(e)) for k, (t, e) in got.items()}
    assert {k: (sizes[k], w) for k, w in (REPLIES | {None: (0, 1)}).items() if sizes[k] != w} == {}
    t = got[json.dumps([GOOD])][0][0]
    assert (t.subject.type, t.subject.name, t.subject.span) == ("MOF", "ZIF-8", [0, 5]) and t.relation == "USES_LINKER" and t.confidence == "high" and t.object.name == "HmIM"
    mixed = got[next(k for k in REPLIES if "ODD" in k)][1]
    assert mixed == ["0:endpoints_misfit", "2:not_an_object", "3:relation_unknown", "4:subject_not_an_object"]
    assert got[json.dumps([{**GOOD, "confidence": 3}])][1] == ["0:confidence_defaulted"] and got["42"][1] == ["not_a_list"] and got[""][1] == ["no_json"]


def test_replies_that_were_cut_off_or_hold_brackets_in_strings():
    cut = '[{"relation": "R"}, {"relation": '
    assert model_extract.located(cut) == ("no_json", [])
    assert model_extract.located('said "x" {5] then {"triples": [{"relation": "a ] } b"}]} end') == ("list_under:triples", ['{"relation": "a ] } b"}'])
    assert model_extract.located("[1] [2") == ("list", ["1"])


def test_price_and_key(spark):
    models = ["gpt-4o", "gpt-4o-mini-x", "unknown", None]
    df = spark.createDataFrame([(m,) for m in models], "m string").select(model_extract.cost(F.col("m"), F.lit(1_000_000), F.lit(0)))
    assert [r[0] for r in df.collect()] == [2.5, 0.15, 0.0, 0.0]
    import hashlib

    args = {"provider": "a", "model": "m", "strategy": "s"}
    for text in ("plain", 'quote " and \\ and \n', "µ é 中 \t", ""):
        blob = json.dumps({"key_schema": "1", "provider": "a", "model": "m", "template_name": "t", "template_version": "1", "strategy": "s", "passage": text, "temperature": 0.0, "max_tokens": 1024}, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        got = spark.createDataFrame([(text,)], "t string").select(model_extract.cache_key(F.col("t"), template="t", version="1", **args)).first()[0]
        assert got == hashlib.sha256(blob.encode()).hexdigest(), text


def test_model_run_uses_cache(spark):
    p = rows(spark)

    def client(prompt, model, temperature, max_tokens):
        if prompt.endswith("2"):
            raise RuntimeError("boom")
        return ("" if prompt.endswith("3") else json.dumps([GOOD]), 1200, 300)

    empty = spark.createDataFrame([], model_extract.ENTRY)
    run = lambda cache: model_extract.extract_with_model(p, cache, client, ENDS, provider="o", model="gpt-4o-mini", strategy="z", template="Read: {passage}", stamp="2021")
    out, entries = run(empty)
    got = {r.passage_id: r for r in out.collect()}
    assert got["p0"].n_triples == 1 and abs(got["p0"].cost_usd - (1200 * 0.15 + 300 * 0.6) / 1e6) < 1e-12 and got["p2"].errors[0].startswith("client call failed") and "empty completion" in got["p3"].errors
    assert entries.count() == 3
    again, new = run(entries)
    hits = {r.passage_id: r.cost_usd for r in again.collect()}
    assert hits["p0"] == 0.0 and new.count() == 0
    s = model_extract.cache_stats(model_extract.with_cached(p.withColumn("key", model_extract.cache_key(F.col("text"), "o", "gpt-4o-mini", "extract", "1", "z")), entries)).first()
    assert (s.hits, s.misses) == (3, 1)


def test_retry():
    waits, calls = [], []

    def client(*_):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429: try again in 2.5s" if len(calls) == 1 else "rate_limit")
        return ("ok", 1, 1)

    assert model_extract.generate(client, "p", "m", 0, 1, waits.append)[0] == "ok" and waits == [3.0, 4.0]
    with pytest.raises(RuntimeError):
        model_extract.generate(lambda *_: (_ for _ in ()).throw(RuntimeError("down")), "p", "m", 0, 1, waits.append)


XML = """<article xmlns:x="u"><front><article-meta><article-id pub-id-type="pmc">PMC1</article-id><article-id pub-id-type="doi">10.1/X</article-id><title-group><article-title>A <italic>MOF</italic>  paper</article-title></title-group>
<permissions><license><license-p>CC BY</license-p></license></permissions><abstract><p>Short.</p></abstract></article-meta></front><body><sec><title>Methods</title><p>One.</p><sec><title>Sub</title><p>Two.</p></sec></sec><sec><title>Empty</title></sec><p>Loose.</p></body></article>"""


def test_articles(spark):
    p = ingest.parse_article(XML)
    assert (p["paper_id"], p["doi"], p["title"], p["license"]) == ("PMC1", "10.1/X", "A MOF paper", "CC BY")
    assert [(s["name"], s["text"]) for s in p["sections"]] == [("Abstract", "Short."), ("Methods", "One.\nTwo."), ("Body", "Loose.")]
    for bad in (None, "", "  ", "<not-xml", b"", "<article/>"):
        assert ingest.parse_article(bad) is None
    raw = spark.createDataFrame([("PMC1", XML), ("PMC2", None), ("PMC3", "<x")], "pmcid string, xml string")
    out = ingest.parsed(raw)
    assert [r.hit for r in out.where("paper_id IS NOT NULL").collect()] == ["PMC1"]
    hits = spark.createDataFrame([("PMC1", "other", "L")], "pmcid string, doi string, license string")
    assert ingest.backfilled(out.withColumn("license", F.lit("")), hits).where("hit = 'PMC1'").first().license == "L"


def test_dedupe(spark):
    hits = [{"pmcid": "1", "doi": "A"}, {"pmcid": "2", "doi": "a"}, {"pmcid": "2", "doi": "c"}, {"pmcid": "1"}, {"pmcid": None}, {"pmcid": "3"}]
    kept, why = ingest.ordered_dedupe(hits)
    assert [(h["pmcid"], h.get("doi")) for h in kept] == [("1", "A"), ("2", "c"), ("3", None)] and len(why) == 2
    cols = readers.PAPERS
    p = spark.createDataFrame([("a", "old", None, "X", None, None, [], "2020"), ("a", "new", None, "X", None, "", [], "2021"), ("b", "t", None, "x ", None, None, [], "2020"), ("c", "t", None, None, None, "CC", None, None)], cols)
    assert {(r.paper_id, r.title) for r in ingest.distinct_papers(p).collect()} == {("a", "new"), ("c", "t")}
    assert {(r.license, r.n) for r in ingest.licences(p).collect()} == {("unknown", 3), ("CC", 1)}


def test_search_and_fetch(spark):
    pages = {"*": ([{"id": "1", "pmcid": "P1"}], "c2"), "c2": ([{"id": "2", "pmcid": "P2"}, {"id": "3", "pmcid": None}], "c2")}
    fetch = lambda q, n, c: pages[c]
    assert [h["id"] for h in readers.search(fetch, "q", 10)] == ["1", "2", "3"] and [h["id"] for h in readers.search(fetch, "q", 2)] == ["1", "2"]

    class Source(readers.SearchSource):
        fetch_page = staticmethod(fetch)

    spark.dataSource.register(Source)
    hits = spark.read.format("paper_search").option("query", "q").option("limit", "10").load()
    assert hits.count() == 3
    cache = spark.createDataFrame([("P1", bytearray(b""))], "pmcid string, xml binary")
    got, new = readers.fetched(hits, cache, lambda p: b"<x/>")
    assert [r.pmcid for r in got.collect()] == ["P2"] and new.count() == 1


def test_readers(spark, tmp_path):
    f = tmp_path / "passages.jsonl"
    f.write_text('{"id": "a", "body": "one", "paper": "P"}\n{"passage_id": " ", "text": "two", "document_id": "Q", "is_synthesis": false}\n\nnot json\n{"pid": "b", "text": " "}\n{"text": "three"')
    got = readers.read_annotation_passages(spark, str(f)).orderBy("line_no").collect()
    assert [(r.passage_id, r.text, r.paper_id, r.is_synthesis) for r in got] == [("a", "one", "P", True), ("Q:00002", "two", "Q", False)]
    (tmp_path / "g.jsonl").write_text('{"passage_id": "a", "status": "annotated", "triples": []}\n{"passage_id": ')
    assert readers.read_gold(spark, str(tmp_path / "g.jsonl")).count() == 1 and readers.read_gold(spark, str(tmp_path / "none")).count() == 0
    assert readers.read_results(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError, match="segmentation"):
        readers.read_passages(spark, str(tmp_path / "none"))
    (tmp_path / "p.jsonl").write_text('{"passage_id": "a", "text": "x", "is_synthesis": true}\n{"passage_id": "b", "text": "x"}\n')
    assert readers.read_passages(spark, str(tmp_path / "p.jsonl")).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"paper_id": "a"}\n{"paper_id": ')
    with pytest.raises(Exception):
        readers.read_papers(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "t.txt").write_text("# name: zero\n# version: 3\nRead {passage} now\n")
    assert readers.read_template(str(tmp_path / "t.txt")) == ("zero", "3", "Read {passage} now")
    (tmp_path / "u.txt").write_text("Read it")
    with pytest.raises(ValueError):
        readers.read_template(str(tmp_path / "u.txt"))
    (tmp_path / "v.txt").write_text("Read {passage}")
    assert readers.read_template(str(tmp_path / "v.txt"))[1].startswith("sha256:")


def test_sinks(spark, tmp_path):
    p = rows(spark)
    assert sinks.write_passages(p, str(tmp_path / "p"), synthesis_only=True) == (4, 3) and spark.read.parquet(str(tmp_path / "p")).count() == 3
    out = runner.run(p, [runner.RuleExtractor()], stamp="1")
    sinks.append_results(out, str(tmp_path / "r"), resume=False)
    sinks.append_results(out, str(tmp_path / "r"))
    r = spark.read.parquet(str(tmp_path / "r"))
    assert r.count() == 8
    sinks.replace_atomically(r.limit(3), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    sinks.write_report(evaluate.run_summary(out), str(tmp_path / "s"), "csv")
    sinks.write_papers(p, str(tmp_path / "q"), "json")
    assert spark.read.json(str(tmp_path / "q")).count() == 4


def test_annotation(spark):
    df = spark.createDataFrame([("Cu was used. It was heated (hot). End.", "HEATED"), ("abc", " "), ("abc", "zz"), (None, "a"), ("İx abc", None)], "t string, m string")
    rows_ = df.select(annotate.find_span(F.col("t"), F.col("m")).alias("s"), annotate.sentence_containing(F.col("t"), F.col("m")).alias("e")).collect()
    assert tuple(rows_[0].s) == (20, 26) and rows_[0].e == "It was heated (hot)." and rows_[1].s is None and rows_[1].e == "" and rows_[2].e == ""
    long = ". ".join("Sentence number %d is here" % i for i in range(200)) + "."
    got = spark.createDataFrame([(long,), ("short",)], "t string").select(annotate.chunks(F.col("t")).alias("c")).collect()
    assert " ".join(got[0].c) == long and all(len(c) <= 2500 for c in got[0].c) and got[1].c == ["short"]
    pool = spark.createDataFrame([(f"p{i:03d}", i < 300) for i in range(600)], "passage_id string, is_synthesis boolean")
    w = annotate.worklist(pool, 200).collect()
    assert len(w) == 200 and sum(not r.is_synthesis for r in w) == 20 and sorted(r.position for r in w) == list(range(1, 201))
    assert [r.passage_id for r in annotate.worklist(pool.repartition(5), 200).orderBy("position").collect()] == [r.passage_id for r in sorted(w, key=lambda r: r.position)]
    exact = annotate.worklist_exact(pool, 200)
    assert len(set(exact)) == 200 and exact == annotate.worklist_exact(pool.orderBy(F.rand(1)), 200)
    assert annotate.sample(pool, 1000).count() == 600
    gold = spark.createDataFrame([("a", "annotated", ["x"], "keep"), ("a", "skipped", None, "old"), ("b", "skipped", None, "k")], "passage_id string, status string, triples array<string>, source_doi string")
    new = spark.createDataFrame([("a", "no_synthesis", "n")], "passage_id string, status string, note string")
    up = annotate.upsert(gold, new)
    assert {(r.passage_id, r.status, r.source_doi, r.note) for r in up.collect()} == {("b", "skipped", "k", None), ("a", "no_synthesis", None, "n")}
    assert annotate.pending(pool.limit(0).union(spark.createDataFrame([("b", True), ("c", True), ("a", True)], pool.schema)), gold.where("status <> 'x'")).count() == 2
    p = annotate.progress(gold).first()
    assert (p.reviewed, p.annotated, p.skipped, p.triples, p.remaining, p.complete) == (3, 1, 2, 1, 79, False)
    assert annotate.delete(gold, ["a"]).count() == 1 and annotate.delete(gold, []).count() == 3
    for status, n in (("odd", 0), ("annotated", 0), ("skipped", 1)):
        with pytest.raises(ValueError):
            annotate.check_change(status, n)
    papers = spark.createDataFrame([("P", "t", "s", None, None, None, [("Intro", long), ("Synthesis of X", long + "\nshort\n" + long[:400])], "r"), ("Q", "t", "s", None, None, None, None, "r")], readers.PAPERS)
    got = annotate.passages_from_papers(papers).orderBy("passage_id").collect()
    assert got[0].passage_id == "P:synthesis-of-x:000" and len({r.passage_id for r in got}) == len(got) >= 4


def test_reference(spark):
    left = spark.createDataFrame([(" A ", "CuEr", 1), ("A", "Fe", 2), (None, "x", 3), ("B", "0", 4)], "refcode string, metal string, n int")
    right = spark.createDataFrame([("A_clean", "Er", 1), ("B_clean", "Cu", 2), ("C_clean", None, 3)], "filename string, metal_ele1 string, n int")
    d, s = reference.digimof_rows(left), reference.synmof_rows(right)
    j = reference.joined(d, s, "refcode", ["n"], ["n"])
    assert {(r.refcode, r.metal, r.metal_ele1, r.n_r) for r in j.collect()} == {("A", "CuEr", "Er", 1), ("B", "0", "Cu", 2)}
    assert [tuple(r) for r in reference.join_report(d, s, "refcode").collect()] == [("left", 3, 2, 1), ("right", 3, 3, 0)]
    a = reference.metal_agreement(j).first()
    assert (a.agreed, a.comparable, a.not_comparable, a.pct) == (1, 1, 1, 100.0) and reference.metal_agreement(j.limit(0)).first().pct == 0.0
    reference.require_unique(j)
    with pytest.raises(ValueError):
        reference.require_unique(j.union(j))
    m = spark.createDataFrame([("R", "ZnCo", "2-METHYLIMIDAZOLE", "sod", 962, None), ("S", None, None, None, 5, 962)], "refcode string, metal string, clean_linker_1 string, cn_topology string, solvent1 bigint, solvent2 bigint")
    m = m.withColumns({f"solvent{i}": F.lit(None).cast("bigint") for i in (3, 4, 5)})
    assert [tuple(r) for r in reference.solvent_distribution(m).collect()] == [("water", 2), ("CID_5", 1)]
    names = spark.createDataFrame([("ZIF-8",), ("MOF-801",)], "name string")
    assert [r.refcode for r in reference.composition_screen(m, names).collect()] == ["R"]


def test_stream(spark, tmp_path):
    from passagekg.streaming import runner as streams

    src = rows(spark)
    src.write.parquet(str(tmp_path / "in"))
    q = streams.stream_results(streams.replayed(spark, str(tmp_path / "in"), src.schema), runner.RuleExtractor(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    src.withColumn("passage_id", F.concat(F.lit("n"), "passage_id")).write.mode("append").parquet(str(tmp_path / "in"))
    q = streams.stream_results(streams.replayed(spark, str(tmp_path / "in"), src.schema), runner.RuleExtractor(), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("passage_id").distinct().count() == 8 == spark.read.parquet(str(tmp_path / "out")).count()
