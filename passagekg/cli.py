"""Command line over the same operators (U7): python -m passagekg.cli COMMAND --help."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _named(path: str):
    """The object at ``module:name``: how a client or a search is given on the command line."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def _collect(spark, a) -> None:
    from passagekg.operators import ingest
    from passagekg.sources.readers import _exists, search

    page, fetch = _named(a.search), _named(a.fetch)
    cache = _read(spark, a.cache) if _exists(spark, a.cache) else spark.createDataFrame([], "pmcid string, xml binary")
    papers, skipped, new = ingest.collect(spark, lambda n: search(page, a.query, n), fetch, cache, a.limit)
    new.write.mode("append").parquet(a.cache)
    papers.drop("rank").withColumn("retrieved_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).write.mode("overwrite").parquet(a.out)
    skipped.show(10, truncate=False)
    ingest.licences(_read(spark, a.out)).show(truncate=False)


def _segment(spark, a) -> None:
    from passagekg.operators import segment
    from passagekg.sources.sinks import write_passages

    everything, written = write_passages(segment.passages(_read(spark, a.papers), a.min_score), a.out, a.synthesis_only)
    segment.summary(_read(spark, a.out)).show(truncate=False)
    print(f"passages: {written} written of {everything}")


def _extract(spark, a) -> None:
    from passagekg.operators import evaluate, runner
    from passagekg.sources.readers import _exists
    from passagekg.sources.sinks import append_results

    before = _read(spark, a.out) if a.resume and _exists(spark, a.out) else None
    make = None
    if a.client:
        from passagekg.operators import model_extract

        ends = {r.relation: (r.from_type, r.to_type) for r in _read(spark, a.ontology).limit(1000).collect()}
        clients = {provider: _named(path) for provider, _, path in (c.partition("=") for c in a.client)}
        make = model_extract.factory(clients, ends, a.cache)
    rows = runner.run(runner.runner_passages(_read(spark, a.passages), not a.all), [runner.extractor_of(s, make) for s in a.extractors.split(",")], before, a.retry_errors)
    append_results(rows, a.out, before is not None)
    evaluate.run_summary(_read(spark, a.out)).show(truncate=False)


def _evaluate(spark, a) -> None:
    from passagekg.operators import evaluate, ontology

    p = ontology.predicted_triples(evaluate.latest_runs(_read(spark, a.results)))
    g = ontology.gold_triples(evaluate.latest_gold(_read(spark, a.gold)))
    counts = evaluate.counts_exact(p, g) if a.mode == "exact" else evaluate.counts_relaxed(p, g)
    evaluate.scores(counts).write.mode("overwrite").parquet(a.out)
    evaluate.with_operations(evaluate.micro(counts), _read(spark, a.results)).show(truncate=False)


def _graph(spark, a) -> None:
    from passagekg.operators import evaluate, graph, ontology

    t = graph.with_ordinal(ontology.predicted_triples(evaluate.latest_runs(_read(spark, a.results))))
    graph.write(graph.build(t, _read(spark, a.papers), staged=True), a.out)
    graph.graph_stats(graph.read(spark, a.out)).show()


def _query(spark, a) -> None:
    from passagekg.operators import graph

    graph.NAMED[a.name](graph.read(spark, a.graph)).show(50, truncate=False)


def _join(spark, a) -> None:
    from passagekg.operators import reference

    left, right = _read(spark, a.left), _read(spark, a.right)
    reference.join_report(left, right, "refcode").show(truncate=False)
    once = [reference.keep_first(df, "refcode") for df in (left, right)]
    once[0].join(once[1].drop(*[c for c in once[1].columns if c in once[0].columns and c != "refcode"]), "refcode").write.mode("overwrite").parquet(a.out)
    print(f"in both: {_read(spark, a.out).count()}")


def _agreement(spark, a) -> None:
    from passagekg.operators import reference

    m = reference.require_unique(reference.keep_first(_read(spark, a.merged), "refcode"))
    for df in (reference.coverage(m), reference.conditions(m), reference.metal_agreement(m), reference.solvent_distribution(m)):
        df.show(truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="passagekg")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, run, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for x in args:
            c.add_argument(f"--{x}", required=True)
        return c

    c = command("collect", _collect, "query", "search", "fetch", "cache", "out")
    c.add_argument("--limit", type=int, default=10)
    c = command("segment", _segment, "papers", "out")
    c.add_argument("--min-score", type=float, default=0.45)
    c.add_argument("--synthesis-only", action="store_true")
    c = command("extract", _extract, "passages", "out")
    c.add_argument("--extractors", default="rule_based")
    c.add_argument("--no-resume", dest="resume", action="store_false")
    c.add_argument("--retry-errors", action="store_true")
    c.add_argument("--all", action="store_true")
    c.add_argument("--client", action="append", help="provider=module:callable, for provider:model:strategy extractors")
    c.add_argument("--ontology", help="table of relations, with --client")
    c.add_argument("--cache", help="folder of model answers, with --client")
    command("evaluate", _evaluate, "results", "gold", "out").add_argument("--mode", choices=("exact", "relaxed"), default="relaxed")
    command("graph", _graph, "results", "papers", "out")
    command("query", _query, "graph").add_argument("name")
    command("join", _join, "left", "right", "out")
    command("agreement", _agreement, "merged")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("passagekg").getOrCreate()
    from passagekg.runtime import ship

    ship(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
