import pytest

from passagekg import cli


def test_commands(spark, sf, tmp_path, capsys):
    out = lambda n: str(tmp_path / n)
    cli.main(["segment", "--papers", f"{sf}/papers.parquet", "--out", out("p"), "--synthesis-only"])
    cli.main(["extract", "--passages", out("p"), "--out", out("r")])
    n = spark.read.parquet(out("r")).count()
    cli.main(["extract", "--passages", out("p"), "--out", out("r")])
    assert n > 0 and spark.read.parquet(out("r")).count() == n
    for mode in ("exact", "relaxed"):
        cli.main(["evaluate", "--results", f"{sf}/results.parquet", "--gold", f"{sf}/gold.parquet", "--out", out("e"), "--mode", mode])
    cli.main(["graph", "--results", f"{sf}/results.parquet", "--papers", f"{sf}/papers.parquet", "--out", out("g")])
    cli.main(["query", "--graph", out("g"), "graph_stats"])
    cli.main(["join", "--left", f"{sf}/digimof_synmof_merged.parquet", "--right", f"{sf}/digimof_synmof_merged.parquet", "--out", out("j")])
    assert spark.read.parquet(out("j")).count() == spark.read.parquet(f"{sf}/digimof_synmof_merged.parquet").select("refcode").where("refcode IS NOT NULL").distinct().count()
    cli.main(["agreement", "--merged", f"{sf}/digimof_synmof_merged.parquet"])
    assert "rule_based_v1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["nope"])


def page(query, size, cursor):
    """A search of two pages, in which hits repeat."""
    if cursor != "*":
        return [], None
    ids = ["PMC1", "PMC2", "PMC1", None, "PMC3", "PMC4", "PMC5"]
    return [{"pmcid": i, "doi": "10.1/a" if i in ("PMC1", "PMC4") else None, "license": "CC BY"} for i in ids], None


def body(pmcid):
    if pmcid == "PMC2":
        raise OSError("timed out")
    if pmcid == "PMC3":
        return b"<article/>"
    return f"<article><front><article-meta><article-id pub-id-type='pmc'>{pmcid}</article-id></article-meta></front><body><p>Text of {pmcid}.</p></body></article>".encode()


def answer(prompt, model, temperature, max_tokens):
    assert "USES_LINKER" in prompt and "{" + "passage}" not in prompt
    return '[{"subject": {"type": "MOF", "name": "X"}, "relation": "USES_LINKER", "object": {"type": "OrganicLinker", "name": "Y"}, "evidence": "said"}]', 10, 5


def test_collection_run(spark, tmp_path):
    from passagekg.operators import ingest
    from passagekg.sources.readers import search

    cache = spark.createDataFrame([], "pmcid string, xml binary")
    papers, skipped, new = ingest.collect(spark, lambda n: search(page, "q", n), body, cache, 3)
    assert [(r.paper_id, r.license) for r in papers.orderBy("rank").collect()] == [("PMC1", "CC BY"), ("PMC5", "CC BY")]
    why = {r.pmcid: r.reason for r in skipped.collect() if r.pmcid != "PMC1"}
    assert why == {"PMC2": "OSError: timed out", "PMC3": "unparseable / no body text", "PMC4": "duplicate DOI 10.1/a, skipped"}
    assert {r.pmcid for r in new.collect()} == {"PMC1", "PMC3", "PMC5"}
    none = ingest.collect(spark, lambda n: [], body, cache, 2)
    assert [df.count() for df in none] == [0, 0, 0]


@pytest.mark.parametrize("strategy", ["zero_shot", "few_shot", "chain_of_thought", "schema_guided"])
def test_models_are_reached_by_spec(spark, sf, tmp_path, strategy):
    p, out, cache = str(tmp_path / "p"), str(tmp_path / "r"), str(tmp_path / "c")
    spark.createDataFrame([("a", "P", "S", "Some text.", True)], "passage_id string, paper_id string, section_name string, text string, is_synthesis boolean").write.parquet(p)
    args = ["extract", "--passages", p, "--out", out, "--extractors", f"lab:m:{strategy}", "--ontology", f"{sf}/ontology.parquet", "--cache", cache, "--client", "lab=tests.test_cli:answer"]
    cli.main(args)
    row = spark.read.parquet(out).first()
    assert row.extractor == f"lab:m:{strategy}" and row.n_triples == 1 and row.triples[0].object.name == "Y" and spark.read.parquet(cache).count() == 1
    with pytest.raises(ValueError, match="provider"):
        cli.main([*args[:5], "--extractors", f"other:m:{strategy}", *args[7:]])
