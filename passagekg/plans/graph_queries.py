"""Queries over triples: scans, joins, evaluation, graph, runs, reference tables (SRC*, J*, A*, G*, K*, L*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekg.functions import text as tx
from passagekg.operators import agreement, evaluate, extract, graph, model_extract, ontology, reference, runner
from passagekg.plans import common as c
from passagekg.plans import sqltext
from passagekg.runtime import stage_table, table
from passagekg.streaming import runner as streams


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.predicted_triples(evaluate.latest_runs(table(spark, sf, "results")))


def _gold(spark: SparkSession, sf: str) -> DataFrame:
    return ontology.gold_triples(evaluate.latest_gold(table(spark, sf, "gold")))


def _counts(spark, sf):
    return evaluate.counts_exact(_pred(spark, sf), _gold(spark, sf))


def _graph(spark, sf, staged: bool = False, rows_once: bool = False) -> graph.Graph:
    """The graph; ``rows_once`` for queries that read several of its tables, ``staged`` for those that read them several times."""
    t = graph.with_ordinal(_pred(spark, sf))
    g = graph.build(t, table(spark, sf, "papers"), staged or rows_once)
    if staged:  # several tables of the graph are read by one query: build each once
        return graph.Graph(*(stage_table(x, "graph") for x in (g.nodes, g.edges, g.mentions, g.papers)))
    return g


def _outline(spark, sf) -> graph.Graph:
    return graph.outline(graph.with_ordinal(_pred(spark, sf)))


# -- scans and checks --


def src8_gold(spark, sf):
    return ontology.gold_triples(table(spark, sf, "gold"))


def src9_predictions(spark, sf):
    return ontology.predicted_triples(table(spark, sf, "results"))


def src6_done(spark, sf):
    return runner.done(table(spark, sf, "results"))


def src5_runner(spark, sf):
    return runner.runner_passages(table(spark, sf, "passages")).groupBy("passage_id").agg(F.count("*").alias("n"))


def src12_repeated(spark, sf):
    return reference.repeated_refcodes(table(spark, sf, "digimof_synmof_merged"))


def p16_violations(spark, sf):
    v = ontology.violations(_pred(spark, sf), table(spark, sf, "ontology"))
    return v.groupBy("extractor", "relation", "subject_type", "object_type").agg(F.count("*").alias("n"))


def p17_validity(spark, sf):
    v = ontology.validity(_gold(spark, sf), table(spark, sf, "ontology"))
    return v.groupBy("relation", "subject_type", "object_type", "valid", F.coalesce("why", F.lit("")).alias("why")).agg(F.count("*").alias("n"))


def p18_endpoints(spark, sf):
    return ontology.endpoints(table(spark, sf, "ontology"))


def p19_writable(spark, sf):
    return ontology.writable(_gold(spark, sf), table(spark, sf, "ontology")).groupBy("relation", "accepted").agg(F.count("*").alias("n"))


def set_operations(spark, sf):
    """Union, intersection and difference of the (passage, relation) keys of both sides (2.9)."""
    p, g = (x.select("passage_id", "relation").where("passage_id IS NOT NULL AND relation IS NOT NULL").distinct() for x in (_pred(spark, sf), _gold(spark, sf)))
    parts = {"union": p.union(g).distinct(), "intersect": p.intersect(g), "only_predicted": p.subtract(g), "only_gold": g.subtract(p)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# -- extraction --


def x2_mentions(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "text").distinct()
    return extract.mention_rows(p).groupBy("type", "kind").agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


def x12_triples(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "paper_id", "section_name", "text").distinct()
    t = extract.extract_passages(p).select("passage_id", F.posexplode("triples").alias("triple_ix", "t"))
    return t.select("passage_id", "triple_ix", F.col("t.subject.name").alias("subject"), "t.relation", F.col("t.object.name").alias("object"), "t.confidence")


def x14_mixtures(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "text").distinct()
    return extract.mixture_rows(p).select("passage_id", "text", "start", F.array_join("components", "|").alias("components"), "ratio")


def x15_errors(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "paper_id", "section_name", "text").distinct()
    r = extract.extract_passages(p)
    return r.select(F.explode("errors").alias("e")).groupBy(F.regexp_replace("e", r"\d+", "n").alias("error")).agg(F.count("*").alias("n"))


# -- runs, cost, replies --


def j1_open(spark, sf):
    """Open calls of every extractor that has run."""
    results = table(spark, sf, "results")
    names = [r.extractor for r in results.select("extractor").where("extractor IS NOT NULL").distinct().collect()]  # the extractors of a project
    return runner.open_calls(table(spark, sf, "passages").select("passage_id"), sorted(names), results).groupBy("extractor").agg(F.count("*").alias("n"))


def cumulative(spark, sf):
    return runner.cumulative_spend(table(spark, sf, "results"))


def a6_summary(spark, sf):
    return evaluate.run_summary(table(spark, sf, "results"))


def a7_operations(spark, sf):
    return evaluate.operations(table(spark, sf, "results"))


_KEY = {"provider": "alpha", "model": "gpt-4o-mini", "template": "extract", "version": "1", "strategy": "zero_shot"}


def l3_keys(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "text").where("text IS NOT NULL").distinct()
    return p.select("passage_id", model_extract.cache_key(F.col("text"), **_KEY).alias("key"))


def l4_cache(spark, sf):
    r = table(spark, sf, "results").where("extractor IS NOT NULL")
    cache = r.where("cost_usd > 0").select(F.concat_ws("|", "passage_id", "extractor").alias("key"), "cost_usd", F.col("run_at").alias("created_at"), "line_no")
    calls = r.select(F.concat_ws("|", "passage_id", "extractor").alias("key")).distinct()
    entry = cache.withColumn("created_at", F.struct(F.coalesce("created_at", F.lit("")), "line_no"))
    return model_extract.cache_stats(model_extract.with_cached(calls, entry))


def l6_costs(spark, sf):
    """Cost of sending every passage to each priced model at four characters a token."""
    models = [*model_extract.PRICES, "gpt-4o-mini-2024", "unknown-model"]
    p = table(spark, sf, "passages").agg(F.sum(F.ceil(F.length("text") / 4)).alias("tokens"))
    m = p.select("tokens", F.explode(F.array(*[F.lit(x) for x in models])).alias("model"))
    return m.select("model", F.round(model_extract.cost(F.col("model"), F.col("tokens"), F.lit(0)), 6).alias("cost_usd"))


def l7_replies(spark, sf):
    ends = {r.relation: (r.from_type, r.to_type) for r in table(spark, sf, "ontology").limit(1000).collect()}
    raw = table(spark, sf, "raw_lines").select("line_no", F.col("payload").alias("reply"))
    return model_extract.parsed_replies(raw, ends).select("line_no", F.size("triples").alias("n_triples"), F.size("errors").alias("n_errors"))


# -- evaluation --


def a1_counts(spark, sf):
    return evaluate.scores(_counts(spark, sf))


def a3_micro(spark, sf):
    return evaluate.micro(_counts(spark, sf))


def a4_macro(spark, sf):
    return evaluate.macro(_counts(spark, sf))


def a5_skipped(spark, sf):
    return evaluate.skipped_relations(_pred(spark, sf), _gold(spark, sf)).select(F.coalesce("relation", F.lit("(none)")).alias("relation"), "n")


def a5_passages(spark, sf):
    return evaluate.n_passages(_pred(spark, sf), _gold(spark, sf))


def f8_candidates(spark, sf):
    pairs = evaluate.candidates(_pred(spark, sf).where(F.col("relation").isin(*evaluate.SCORED)), _gold(spark, sf).where(F.col("relation").isin(*evaluate.SCORED)))
    return pairs.groupBy("extractor", "relation").agg(F.count("*").alias("n_pairs"), F.round(F.sum("score"), 4).alias("total"))


def f9_relaxed(spark, sf):
    return evaluate.scores(evaluate.counts_relaxed(_pred(spark, sf), _gold(spark, sf)))


def t7_examples(spark, sf):
    p, g = _pred(spark, sf), _gold(spark, sf)
    scored = lambda df: df.where(F.col("relation").isin(*evaluate.SCORED))
    matches = evaluate.greedy(evaluate.candidates(scored(p), scored(g)))
    return evaluate.examples(evaluate.false_positives(p, matches)).select("extractor", "relation", "line_no", "triple_ix", "subject_name", "object_name")


def f10_mismatches(spark, sf):
    return evaluate.value_mismatches(_pred(spark, sf), _gold(spark, sf))


_EXTRACTOR = ("extractor",)


def _records(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Long records per passage: ours from all triples, by extractor, the reference from gold."""
    fields = {"USES_LINKER": "linker", "USES_PRECURSOR": "metal_precursor", "IN_SOLVENT": "solvent", "SYNTHESIZED_BY": "synthesis_method", "AT_CONDITION": "temperature"}
    name = F.create_map(*[F.lit(x) for kv in fields.items() for x in kv])

    def long(t: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        rows = t.where("passage_id IS NOT NULL").select(*by, F.col("passage_id").alias("paper_id"), F.try_element_at(name, F.col("relation")).alias("field"), "object_name").where("field IS NOT NULL")
        return rows.groupBy(*by, "paper_id", "field").agg(F.collect_list("object_name").alias("values"))

    return long(_pred(spark, sf).withColumn("extractor", F.coalesce("extractor", F.lit(""))), _EXTRACTOR), long(_gold(spark, sf))


def a8_agreement(spark, sf):
    return agreement.report(agreement.compared(*_records(spark, sf), by=_EXTRACTOR), _EXTRACTOR)


def a8_relaxed(spark, sf):
    return agreement.report(agreement.compared(*_records(spark, sf), mode="relaxed", by=_EXTRACTOR), _EXTRACTOR)


def a8_missing(spark, sf):
    return agreement.missing_records(*_records(spark, sf), _EXTRACTOR)


# -- graph --


def g3_nodes(spark, sf):
    return _graph(spark, sf).nodes.select("label", "key", "name", F.array_join("aliases", "|").alias("aliases"))


def g4_edges(spark, sf):
    return _graph(spark, sf).edges


def g5_mentions(spark, sf):
    return _graph(spark, sf).mentions


def g2_papers(spark, sf):
    return _graph(spark, sf).papers


def g6_rejections(spark, sf):
    return graph.rejections(graph.load_rows(graph.with_ordinal(_pred(spark, sf))))


def g1_violations(spark, sf):
    return graph.key_violations(_graph(spark, sf, rows_once=True))


def a20_load(spark, sf):
    return graph.load_stats(graph.with_ordinal(_pred(spark, sf)))


def k1(spark, sf):
    return graph.solvent_temperature_by_linker(_outline(spark, sf)).withColumn("example_mofs", F.array_join("example_mofs", "|"))


def k2(spark, sf):
    return graph.method_distribution(_graph(spark, sf, rows_once=True))


def k3(spark, sf):
    return graph.precursor_linker_pairs(_outline(spark, sf))


_K4 = "nbx-761"


def k4(spark, sf):
    r = graph.mof_full_record(_graph(spark, sf, True), _K4)
    text = ["precursors", "linkers", "methods", "solvents", "conditions", "properties"]
    return r.select("mof", *[F.array_join(x, "|").alias(x) for x in text], F.size("provenance").cast("bigint").alias("n_provenance"))


def k5(spark, sf):
    return graph.provenance_for_claim(_graph(spark, sf, rows_once=True), _K4)


def k6(spark, sf):
    return graph.graph_stats(_graph(spark, sf, rows_once=True))


def k7(spark, sf):
    return graph.node_breakdown(_graph(spark, sf, rows_once=True))


def k8(spark, sf):
    return graph.provenance_violations(_graph(spark, sf, rows_once=True))


# -- reference tables --


def _merged(spark, sf):
    return table(spark, sf, "digimof_synmof_merged")


def j2_join(spark, sf):
    m = _merged(spark, sf)
    left = reference.digimof_rows(m.select("refcode", "metal", "clean_linker_1", "cn_topology"))
    right = reference.synmof_rows(m.select("filename", "metal_ele1", "temperature_celsius", "time_h", "yield_percent"))
    return reference.joined(left, right, "refcode", ["metal", "clean_linker_1", "cn_topology"], ["filename", "temperature_celsius", "time_h", "yield_percent", "metal_ele1"]).select("refcode", "metal", "metal_ele1", "temperature_celsius")


def j2_report(spark, sf):
    m = _merged(spark, sf)
    return reference.join_report(reference.digimof_rows(m.select("refcode")), reference.synmof_rows(m.select("filename")), "refcode")


def a10_coverage(spark, sf):
    return reference.coverage(_merged(spark, sf))


def a11_solvents(spark, sf):
    return reference.solvent_distribution(_merged(spark, sf))


def a11_metals(spark, sf):
    return reference.metal_distribution(_merged(spark, sf))


def a12_conditions(spark, sf):
    return reference.conditions(_merged(spark, sf))


def a13_metals(spark, sf):
    return reference.metal_agreement(_merged(spark, sf))


_COMPOSITIONS = reference.COMPOSITIONS | {"MIL-382(Cr)": ("Cr", "terephthalic"), "ZIF-425": ("Zn", "imidazol"), "UiO-318": ("Zr", "dicarboxylic"), "MOF-350": ("Zr", "fumaric")}


def j4_screen(spark, sf):
    return reference.composition_screen(_merged(spark, sf), reference.gold_names(table(spark, sf, "gold")), _COMPOSITIONS)


def stream_windows(spark, sf):
    w = streams.event_windows(table(spark, sf, "events"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


QUERIES = {
    "ref_src8_gold": src8_gold, "ref_src9_predictions": src9_predictions, "ref_src6_done": src6_done, "ref_src5_runner": src5_runner, "ref_src12_repeated": src12_repeated,
    "ref_p16_violations": p16_violations, "ref_p17_validity": p17_validity, "ref_p18_endpoints": p18_endpoints, "ref_p19_writable": p19_writable, "ref_set_operations": set_operations,
    "ref_x2_mentions": x2_mentions, "ref_x12_triples": x12_triples, "ref_x14_mixtures": x14_mixtures, "ref_x15_errors": x15_errors, "ref_j1_open_calls": j1_open,
    "ref_w1_cumulative_spend": cumulative, "ref_a6_run_summary": a6_summary, "ref_a7_operations": a7_operations, "ref_l3_cache_keys": l3_keys, "ref_l4_cache_stats": l4_cache,
    "ref_l6_costs": l6_costs, "ref_l7_replies": l7_replies, "ref_a1_scores": a1_counts, "ref_a3_micro": a3_micro, "ref_a4_macro": a4_macro, "ref_a5_skipped": a5_skipped,
    "ref_a5_passages": a5_passages, "ref_f8_candidates": f8_candidates, "ref_f9_relaxed": f9_relaxed, "ref_f10_mismatches": f10_mismatches, "ref_t7_examples": t7_examples, "ref_a8_agreement": a8_agreement,
    "ref_a8_relaxed": a8_relaxed, "ref_a8_missing": a8_missing, "ref_g1_key_violations": g1_violations, "ref_g2_papers": g2_papers, "ref_g3_nodes": g3_nodes, "ref_g4_edges": g4_edges,
    "ref_g5_mentions": g5_mentions, "ref_g6_rejections": g6_rejections, "ref_a20_load_stats": a20_load, "ref_k1_solvent_temperature": k1, "ref_k2_methods": k2, "ref_k3_pairs": k3,
    "ref_k4_full_record": k4, "ref_k5_provenance": k5, "ref_k6_stats": k6, "ref_k7_breakdown": k7, "ref_k8_violations": k8, "ref_j2_join": j2_join, "ref_j2_report": j2_report,
    "ref_a10_coverage": a10_coverage, "ref_a11_solvents": a11_solvents, "ref_a11_metals": a11_metals, "ref_a12_conditions": a12_conditions, "ref_a13_metals": a13_metals,
    "ref_j4_screen": j4_screen, "ref_stream_windows": stream_windows,
}

_P, _G = f"({c.predicted()})", f"({c.gold()})"
_SCORED = "(" + ", ".join(sqltext.lit(r) for r in evaluate.SCORED) + ")"
_FREE = "(" + ", ".join(sqltext.lit(r) for r in evaluate.SUBJECT_AGNOSTIC) + ")"
_MK = f"CASE WHEN o_key <> '' AND object_type IS NOT NULL AND (relation IN {_FREE} OR (s_key <> '' AND subject_type IS NOT NULL)) THEN CASE WHEN relation IN {_FREE} THEN '' ELSE subject_type || chr(1) || s_key END || chr(2) || object_type || chr(2) || o_key END"
_CELLS = """cells AS (SELECT e.extractor, r.relation FROM (SELECT DISTINCT extractor FROM p) e, (SELECT relation FROM p UNION SELECT relation FROM g) r),
    counts AS (SELECT c.extractor, c.relation, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(np, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(ng, 0) - coalesce(tp, 0) AS BIGINT) AS fn FROM cells c
        LEFT JOIN tp ON tp.extractor IS NOT DISTINCT FROM c.extractor AND tp.relation = c.relation LEFT JOIN (SELECT extractor, relation, count(*) AS np FROM p GROUP BY ALL) a ON a.extractor IS NOT DISTINCT FROM c.extractor AND a.relation = c.relation
        LEFT JOIN (SELECT relation, count(*) AS ng FROM g GROUP BY ALL) b ON b.relation = c.relation)"""
_EVAL = f"""WITH p AS (SELECT *, {_MK} AS mk FROM ({c.both_keys(_P)}) WHERE relation IN {_SCORED}), g AS (SELECT *, {_MK} AS mk FROM ({c.both_keys(_G)}) WHERE relation IN {_SCORED}),
    pc AS (SELECT extractor, source_paper_id, source_section, relation, mk, count(*) AS np FROM p WHERE mk IS NOT NULL GROUP BY ALL), gc AS (SELECT source_paper_id, source_section, relation, mk, count(*) AS ng FROM g WHERE mk IS NOT NULL GROUP BY ALL),
    tp AS (SELECT pc.extractor, pc.relation, sum(least(np, ng)) AS tp FROM pc JOIN gc ON pc.source_paper_id IS NOT DISTINCT FROM gc.source_paper_id AND pc.source_section IS NOT DISTINCT FROM gc.source_section AND pc.relation = gc.relation AND pc.mk = gc.mk GROUP BY ALL),
    {_CELLS}"""
_PR = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
_RE = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
_F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
_STOP = "[" + ", ".join(sqltext.lit(x) for x in tx.STOPWORDS) + "]"


def _toks(k: str) -> str:
    return f"(CASE WHEN len(list_filter(regexp_extract_all({k}, '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))) > 0 THEN list_distinct(list_filter(regexp_extract_all({k}, '[a-z0-9]+'), lambda x: NOT list_contains({_STOP}, x))) ELSE list_distinct(regexp_extract_all({k}, '[a-z0-9]+')) END)"


def _nums(k: str) -> str:
    return f"list_sort(regexp_extract_all({k}, '\\d+(?:\\.\\d+)?'))"


def _prepared(side: str, keyed: str) -> str:
    gk = "coalesce(source_paper_id, chr(3)) || chr(4) || coalesce(source_section, chr(3)) || chr(4) || relation"
    return f"{side} AS (SELECT *, {gk} AS gk, {_toks('s_key')} AS st, {_toks('o_key')} AS ot, {_nums('s_key')} AS sn, {_nums('o_key')} AS onum FROM ({keyed}) WHERE relation IN {_SCORED})"


def _alike(kind: str, key: str, toks: str, nums: str) -> str:
    share = f"len(list_intersect(p.{toks}, g.{toks})) / len(list_distinct(list_concat(p.{toks}, g.{toks})))"
    near = f"p.{key} <> '' AND g.{key} <> '' AND p.{nums} = g.{nums} AND len(p.{toks}) > 0 AND len(g.{toks}) > 0 AND {share} >= 0.6"
    return f"(CASE WHEN p.{kind} = g.{kind} THEN CASE WHEN p.{key} <> '' AND p.{key} = g.{key} THEN 1.0 WHEN {near} THEN {share} ELSE 0.0 END ELSE 0.0 END)"


_PAIRS = f"""WITH {_prepared('p', c.both_keys(_P))}, {_prepared('g', c.both_keys(_G))},
    sims AS (SELECT p.extractor, p.relation, {_alike('subject_type', 's_key', 'st', 'sn')} AS s, {_alike('object_type', 'o_key', 'ot', 'onum')} AS o FROM p JOIN g ON p.gk = g.gk),
    scored AS (SELECT extractor, relation, CASE WHEN relation IN {_FREE} THEN o WHEN s > 0 AND o > 0 THEN (s + o) / 2 ELSE 0.0 END AS score FROM sims)"""
# greedy one-to-one matches: a fold over the candidate pairs of a group, best first, ties by gold and then prediction
_FOLD = "list_reduce(list([{{'g': {g}, 'p': {p}}}] ORDER BY score DESC, {g}, {p}), lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: q.g = x[1].g OR q.p = x[1].p)) > 0 THEN acc ELSE list_concat(acc, x) END)"
_MATCHED = f"""WITH {_prepared('p', c.both_keys(_P))}, {_prepared('g', c.both_keys(_G))},
    sims AS (SELECT p.extractor, p.relation, p.gk, p.line_no * 1000000 + p.triple_ix AS pid, g.line_no * 1000000 + g.triple_ix AS gid, {_alike('subject_type', 's_key', 'st', 'sn')} AS s, {_alike('object_type', 'o_key', 'ot', 'onum')} AS o FROM p JOIN g ON p.gk = g.gk),
    scored AS (SELECT extractor, relation, gk, pid, gid, CASE WHEN relation IN {_FREE} THEN o WHEN s > 0 AND o > 0 THEN (s + o) / 2 ELSE 0.0 END AS score FROM sims),
    folded AS (SELECT extractor, relation, gk, {_FOLD.format(g='gid', p='pid')} AS m FROM scored WHERE score > 0 GROUP BY extractor, relation, gk),
    tp AS (SELECT extractor, relation, sum(len(m)) AS tp FROM folded GROUP BY ALL),"""
_LEFTOVER = f"""WITH pr AS (SELECT *, coalesce(source_paper_id, chr(3)) || chr(4) || coalesce(source_section, chr(3)) || chr(4) || relation AS gk, {_MK} AS mk, CASE WHEN s_key <> '' THEN coalesce(subject_type || chr(1), '') || s_key END AS sk FROM ({c.both_keys(_P)}) WHERE relation IN {_SCORED}),
    gr AS (SELECT *, coalesce(source_paper_id, chr(3)) || chr(4) || coalesce(source_section, chr(3)) || chr(4) || relation AS gk, {_MK} AS mk, CASE WHEN s_key <> '' THEN coalesce(subject_type || chr(1), '') || s_key END AS sk FROM ({c.both_keys(_G)}) WHERE relation IN {_SCORED}),
    p AS (SELECT *, row_number() OVER (PARTITION BY extractor, gk, mk ORDER BY line_no, triple_ix) AS rn FROM pr), g AS (SELECT *, row_number() OVER (PARTITION BY gk, mk ORDER BY line_no, triple_ix) AS rn FROM gr),
    ng AS (SELECT gk, mk, count(*) AS n FROM g WHERE mk IS NOT NULL GROUP BY ALL), np AS (SELECT extractor, gk, mk, count(*) AS n FROM p WHERE mk IS NOT NULL GROUP BY ALL),
    fp AS (SELECT extractor, p.relation, p.gk, sk, count(*) AS fp FROM p LEFT JOIN ng ON ng.gk = p.gk AND ng.mk = p.mk WHERE sk IS NOT NULL AND (p.mk IS NULL OR rn > coalesce(n, 0)) GROUP BY ALL),
    used AS (SELECT np.extractor, g.gk, g.sk, count(*) AS used FROM g JOIN np ON np.gk = g.gk AND np.mk = g.mk WHERE g.rn <= np.n AND g.sk IS NOT NULL GROUP BY ALL), st AS (SELECT gk, sk, count(*) AS n_gold FROM g WHERE sk IS NOT NULL GROUP BY ALL),
    m AS (SELECT fp.extractor, relation, least(fp, n_gold - coalesce(used, 0)) AS m FROM fp JOIN st ON st.gk = fp.gk AND st.sk = fp.sk LEFT JOIN used u ON u.extractor IS NOT DISTINCT FROM fp.extractor AND u.gk = fp.gk AND u.sk = fp.sk)"""
_GKEYS = sqltext.keyed(f"({sqltext.keyed(_P, 'subject_type', 'subject_name', 'src_key')})", "object_type", "object_name", "dst_key")
_GRAPH = f"""WITH loaded AS (SELECT *, line_no * 100000 + triple_ix AS ord, CASE WHEN coalesce(paper_id, '') = '' THEN 'missing paper' WHEN relation = 'MENTIONED_IN' THEN 'provenance relation'
        WHEN relation IS NULL OR subject_type IS NULL OR object_type IS NULL THEN 'missing type or relation' WHEN src_key = '' OR dst_key = '' THEN 'empty key' END AS reason FROM ({_GKEYS})),
    ok AS (SELECT * FROM loaded WHERE reason IS NULL),
    ends AS (SELECT subject_type AS label, src_key AS key, subject_name AS name, ord * 2 AS o, paper_id, source_section, evidence FROM ok UNION ALL SELECT object_type, dst_key, object_name, ord * 2 + 1, paper_id, source_section, evidence FROM ok),
    surfaces AS (SELECT label, key, name, min(o) AS o FROM ends GROUP BY ALL),
    nodes AS (SELECT label, key, arg_min(name, o) AS name, string_agg(name, '|' ORDER BY o) AS aliases FROM surfaces GROUP BY label, key),
    edges AS (SELECT src_label, src_key, rel, dst_label, dst_key, p.evidence AS evidence, p.confidence AS confidence, p.extractor AS extractor, p.paper_id AS paper_id, p.section AS section FROM (
        SELECT subject_type AS src_label, src_key, relation AS rel, object_type AS dst_label, dst_key, arg_max({{'evidence': evidence, 'confidence': confidence, 'extractor': extractor, 'paper_id': paper_id, 'section': source_section}}, ord) AS p FROM ok GROUP BY ALL)),
    mentions AS (SELECT label, key, paper_id, p.section AS section, p.evidence AS evidence FROM (SELECT label, key, paper_id, arg_max({{'section': source_section, 'evidence': evidence}}, o) AS p FROM ends GROUP BY label, key, paper_id)),
    gpapers AS (SELECT DISTINCT paper_id FROM ok),
    mof_linker AS (SELECT src_key AS mof, dst_key AS lk FROM edges WHERE rel = 'USES_LINKER' AND src_label = 'MOF' AND dst_label = 'OrganicLinker'),
    mof_pre AS (SELECT src_key AS mof, dst_key AS pk FROM edges WHERE rel = 'USES_PRECURSOR' AND src_label = 'MOF' AND dst_label = 'MetalPrecursor'),
    mof_method AS (SELECT src_key AS mof, dst_key AS mk FROM edges WHERE rel = 'SYNTHESIZED_BY' AND src_label = 'MOF' AND dst_label = 'SynthesisMethod'),
    m_solvent AS (SELECT src_key AS mk, n.name AS solvent FROM edges JOIN nodes n ON n.label = 'Solvent' AND n.key = dst_key WHERE rel = 'IN_SOLVENT' AND src_label = 'SynthesisMethod' AND dst_label = 'Solvent'),
    m_condition AS (SELECT src_key AS mk, n.name AS condition FROM edges JOIN nodes n ON n.label = 'Condition' AND n.key = dst_key WHERE rel = 'AT_CONDITION' AND src_label = 'SynthesisMethod' AND dst_label = 'Condition'),
    mof_paper AS (SELECT key AS mof, paper_id FROM mentions WHERE label = 'MOF')"""


def _listed(alias: str, source: str) -> str:
    return f"(SELECT coalesce(string_agg(n, '|' ORDER BY n), '') FROM (SELECT DISTINCT n.name AS n FROM {source})) AS {alias}"


def _first(owner: str, *names: str) -> str:
    """The first of the members that is a text with something in it."""
    each = ", ".join(f"CASE WHEN json_type({owner} -> '{n}') = 'VARCHAR' THEN nullif({c.strip(f'({owner} ->> {sqltext.lit(n)})')}, '') END" for n in names)
    return f"coalesce({each})" if len(names) > 1 else each


_KINDS = "(" + ", ".join(sqltext.lit(x) for x in ontology.ENTITY_TYPES if x != "Paper") + ")"
_RELATIONS = "(" + ", ".join(sqltext.lit(x) for x in ontology.RELATION_TYPES if x != ontology.PROVENANCE) + ")"
_REC = f"""WITH map_(relation, field) AS (VALUES ('USES_LINKER', 'linker'), ('USES_PRECURSOR', 'metal_precursor'), ('IN_SOLVENT', 'solvent'), ('SYNTHESIZED_BY', 'synthesis_method'), ('AT_CONDITION', 'temperature')),
    kinds(field, kind) AS (VALUES ('linker', 'OrganicLinker'), ('metal_precursor', 'MetalPrecursor'), ('solvent', 'Solvent'), ('synthesis_method', 'SynthesisMethod'), ('temperature', 'Condition')),
    ours AS (SELECT passage_id AS paper_id, field, object_name AS v FROM {_P} JOIN map_ USING (relation) WHERE passage_id IS NOT NULL),
    refs AS (SELECT passage_id AS paper_id, field, object_name AS v FROM {_G} JOIN map_ USING (relation) WHERE passage_id IS NOT NULL)"""
_REC_ALL = _REC.replace("SELECT passage_id AS paper_id, field, object_name AS v FROM " + _P, "SELECT passage_id AS paper_id, coalesce(extractor, '') AS extractor, field, object_name AS v FROM " + _P)
_NULLS = "(" + ", ".join(sqltext.lit(s) for s in ("", "na", "n/a", "none", "null", "nan", "-", "--", "unknown", "not reported")) + ")"


def _clean(rel: str, by: str = "") -> str:
    return f"(SELECT {by}paper_id, field, kind, {c.strip('v')} AS v FROM {rel} JOIN kinds USING (field) WHERE v IS NOT NULL AND lower({c.strip('v')}) NOT IN {_NULLS})"


ORACLES = {
    "ref_src8_gold": c.gold(False),
    "ref_src9_predictions": c.predicted(False),
    "ref_src6_done": "SELECT DISTINCT passage_id, extractor FROM results WHERE passage_id IS NOT NULL AND extractor IS NOT NULL",
    "ref_src5_runner": "SELECT passage_id, count(*) AS n FROM passages WHERE coalesce(is_synthesis, false) GROUP BY 1",
    "ref_src12_repeated": "SELECT refcode, count(*) AS n FROM digimof_synmof_merged GROUP BY 1 HAVING count(*) > 1",
    "ref_p16_violations": f"SELECT t.extractor, t.relation, t.subject_type, t.object_type, count(*) AS n FROM {_P} t JOIN ontology o ON o.relation = t.relation WHERE o.from_type <> '*' AND (t.subject_type IS DISTINCT FROM o.from_type OR t.object_type IS DISTINCT FROM o.to_type) GROUP BY ALL",
    "ref_p17_validity": f"""SELECT relation, subject_type, object_type, why = '' AS valid, why, count(*) AS n FROM (SELECT t.relation, t.subject_type, t.object_type, CASE WHEN t.relation = 'MENTIONED_IN' THEN 'provenance is written by the pipeline' WHEN o.relation IS NULL THEN 'unknown relation'
        WHEN o.from_type <> '*' AND t.subject_type IS DISTINCT FROM o.from_type THEN 'subject must be ' || o.from_type WHEN o.to_type <> '*' AND t.object_type IS DISTINCT FROM o.to_type THEN 'object must be ' || o.to_type ELSE '' END AS why
        FROM {_G} t LEFT JOIN ontology o ON o.relation = t.relation) GROUP BY ALL""",
    "ref_p18_endpoints": "SELECT relation, 'subject' AS side, from_type AS entity_type FROM ontology WHERE relation <> 'MENTIONED_IN' UNION ALL SELECT relation, 'object', to_type FROM ontology WHERE relation <> 'MENTIONED_IN'",
    "ref_p19_writable": f"""SELECT relation, accepted, count(*) AS n FROM (SELECT t.relation, coalesce(t.relation <> 'MENTIONED_IN' AND o.relation IS NOT NULL AND (o.from_type = '*' OR t.subject_type IS NOT DISTINCT FROM o.from_type) AND (o.to_type = '*' OR t.object_type IS NOT DISTINCT FROM o.to_type)
        AND {c.strip('t.subject_name')} <> '' AND {c.strip('t.object_name')} <> '' AND {c.strip('t.evidence')} <> '' AND t.confidence IN ('high', 'medium', 'low'), false) AS accepted FROM {_G} t LEFT JOIN ontology o ON o.relation = t.relation) GROUP BY ALL""",
    "ref_set_operations": f"""WITH p AS (SELECT DISTINCT passage_id, relation FROM {_P} WHERE passage_id IS NOT NULL AND relation IS NOT NULL), g AS (SELECT DISTINCT passage_id, relation FROM {_G} WHERE passage_id IS NOT NULL AND relation IS NOT NULL)
        SELECT 'union' AS part, count(*) AS n FROM (SELECT * FROM p UNION SELECT * FROM g) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM g)
        UNION ALL SELECT 'only_predicted', count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g) UNION ALL SELECT 'only_gold', count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)""",
    "ref_j1_open_calls": "SELECT e AS extractor, count(*) AS n FROM passages p, (SELECT DISTINCT extractor AS e FROM results WHERE extractor IS NOT NULL) v WHERE NOT EXISTS (SELECT 1 FROM results r WHERE r.passage_id = p.passage_id AND r.extractor = e) GROUP BY e",
    "ref_w1_cumulative_spend": "SELECT line_no, extractor, round(sum(coalesce(cost_usd, 0.0)) OVER (PARTITION BY extractor ORDER BY run_at NULLS FIRST, line_no ROWS UNBOUNDED PRECEDING), 6) AS spent FROM results",
    "ref_a6_run_summary": "SELECT extractor, count(*) AS n_passages, CAST(sum(n_triples) AS BIGINT) AS n_triples, round(sum(cost_usd), 6) AS cost_usd, round(avg(n_triples), 2) AS mean_triples, round(avg(latency_ms), 1) AS mean_latency_ms, CAST(count(*) FILTER (len(errors) > 0) AS BIGINT) AS n_with_errors FROM results GROUP BY extractor",
    "ref_a7_operations": "SELECT extractor, count(*) AS calls, round(sum(cost_usd), 6) AS cost_usd, round(avg(latency_ms), 1) AS mean_latency_ms, CAST(count(*) FILTER (len(list_filter(errors, lambda e: contains(e, 'client call failed'))) > 0) AS BIGINT) AS failed_calls FROM results GROUP BY extractor",
    "ref_l3_cache_keys": """SELECT DISTINCT passage_id, sha256('{"key_schema":"1","max_tokens":1024,"model":"gpt-4o-mini","passage":' || CAST(to_json(text) AS VARCHAR) || ',"provider":"alpha","strategy":"zero_shot","temperature":0.0,"template_name":"extract","template_version":"1"}') AS key FROM passages WHERE text IS NOT NULL""",
    "ref_l4_cache_stats": """WITH r AS (SELECT *, concat_ws('|', passage_id, extractor) AS key FROM results WHERE extractor IS NOT NULL), e AS (SELECT key, arg_max(cost_usd, coalesce(run_at, '') || '|' || lpad(CAST(line_no AS VARCHAR), 12, '0')) AS cost FROM r WHERE cost_usd > 0 GROUP BY key),
        j AS (SELECT k.key, e.cost FROM (SELECT DISTINCT key FROM r) k LEFT JOIN e USING (key)) SELECT count(cost) AS hits, count(*) - count(cost) AS misses, round(avg(CAST(cost IS NOT NULL AS DOUBLE)), 6) AS hit_rate, round(coalesce(sum(cost), 0.0), 6) AS spend_avoided FROM j""",
    "ref_l6_costs": f"""WITH prices(id, p) AS (VALUES {', '.join(f'({sqltext.lit(k)}, CAST({v[0]} AS DOUBLE))' for k, v in model_extract.PRICES.items())}), models(model) AS (SELECT id FROM prices UNION ALL SELECT * FROM (VALUES ('gpt-4o-mini-2024'), ('unknown-model'))),
        t AS (SELECT sum(ceil(length(text) / 4.0)) AS tokens FROM passages) SELECT model, round(coalesce((SELECT arg_max(p, length(id)) FROM prices WHERE starts_with(model, id)) * tokens / 1e6, 0.0), 6) AS cost_usd FROM models, t""",
    "ref_a1_scores": f"{_EVAL} SELECT extractor, relation, tp, fp, fn, round({_PR}, 6) AS precision, round({_RE}, 6) AS recall, round({_F1}, 6) AS f1, tp + fn AS support FROM counts",
    "ref_a3_micro": f"{_EVAL}, s AS (SELECT extractor, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts GROUP BY extractor) SELECT extractor, tp + fp AS n_predicted, tp, fp, fn, round({_PR}, 6) AS precision, round({_RE}, 6) AS recall, round({_F1}, 6) AS f1 FROM s",
    "ref_a4_macro": f"{_EVAL} SELECT extractor, round(coalesce(avg({_PR}) FILTER (tp + fn > 0), 0.0), 6) AS macro_precision, round(coalesce(avg({_RE}) FILTER (tp + fn > 0), 0.0), 6) AS macro_recall, round(coalesce(avg({_F1}) FILTER (tp + fn > 0), 0.0), 6) AS macro_f1, coalesce(string_agg(relation, ',' ORDER BY relation) FILTER (tp + fn > 0), '') AS macro_fields FROM counts GROUP BY extractor",
    "ref_a5_skipped": f"SELECT coalesce(relation, '(none)') AS relation, count(*) AS n FROM (SELECT relation FROM {_P} UNION ALL SELECT relation FROM {_G}) WHERE relation IS NULL OR relation NOT IN {_SCORED} GROUP BY 1",
    "ref_a5_passages": f"SELECT count(*) AS n_passages FROM (SELECT DISTINCT source_paper_id, source_section FROM (SELECT source_paper_id, source_section, relation FROM {_P} UNION ALL SELECT source_paper_id, source_section, relation FROM {_G}) WHERE relation IN {_SCORED})",
    "ref_f8_candidates": f"{_PAIRS} SELECT extractor, relation, count(*) AS n_pairs, round(sum(score), 4) AS total FROM scored WHERE score > 0 GROUP BY ALL",
    "ref_l7_replies": f"""WITH valid AS (SELECT line_no, CAST(payload AS JSON) AS v FROM raw_lines WHERE json_valid(payload)),
        shaped AS (SELECT line_no, CASE json_type(v) WHEN 'ARRAY' THEN v WHEN 'OBJECT' THEN coalesce({', '.join(f"CASE WHEN json_type(v -> '{k}') = 'ARRAY' THEN v -> '{k}' END" for k in model_extract.LIST_KEYS)}, CASE WHEN list_contains(json_keys(v), 'relation') THEN json_array(v) END) END AS held,
            CAST(json_type(v) <> 'ARRAY' AS INTEGER) AS told FROM valid WHERE json_type(v) <> 'NULL'),
        els AS (SELECT line_no, held -> CAST('$[' || i || ']' AS VARCHAR) AS el FROM (SELECT line_no, held, unnest(range(CAST(json_array_length(held) AS BIGINT))) AS i FROM shaped WHERE held IS NOT NULL)),
        read_ AS (SELECT line_no, el, regexp_replace(upper({_first('el', 'relation', 'predicate', 'type')}), '[ -]', '_', 'g') AS rel, {_first("el -> 'subject'", 'type', 'entity_type', 'label')} AS st, {_first("el -> 'subject'", 'name', 'text', 'value')} AS sn,
            {_first("el -> 'object'", 'type', 'entity_type', 'label')} AS ot, {_first("el -> 'object'", 'name', 'text', 'value')} AS o_n, {_first('el', 'evidence', 'sentence')} AS ev, lower({_first('el', 'confidence')}) AS conf FROM els),
        ends AS (SELECT *, CAST(coalesce(json_type(el -> 'subject') <> 'OBJECT', true) OR st IS NULL OR sn IS NULL OR st NOT IN {_KINDS} AS INTEGER) + CAST(coalesce(json_type(el -> 'object') <> 'OBJECT', true) OR ot IS NULL OR o_n IS NULL OR ot NOT IN {_KINDS} AS INTEGER) AS bad FROM read_),
        judged AS (SELECT e.line_no, CASE WHEN json_type(el) <> 'OBJECT' OR rel IS NULL OR rel NOT IN {_RELATIONS} THEN 1 WHEN bad > 0 THEN bad WHEN w.relation IS NOT NULL AND (st <> from_type OR ot <> to_type) THEN 1 WHEN ev IS NULL THEN 1 ELSE 0 END AS wrong,
            CAST(list_contains(json_keys(el), 'confidence') AND coalesce(conf, '') NOT IN ('high', 'medium', 'low') AS INTEGER) AS unsure FROM ends e LEFT JOIN ontology w ON w.relation = e.rel),
        per AS (SELECT line_no, count(*) FILTER (wrong = 0) AS good, sum(CASE WHEN wrong > 0 THEN wrong ELSE unsure END) AS codes FROM judged GROUP BY line_no)
        SELECT r.line_no, CAST(coalesce(good, 0) AS INTEGER) AS n_triples, CAST(coalesce(told, 1) + coalesce(codes, 0) AS INTEGER) AS n_errors FROM raw_lines r LEFT JOIN shaped USING (line_no) LEFT JOIN per USING (line_no)""",
    "ref_f9_relaxed": f"{_MATCHED} {_CELLS} SELECT extractor, relation, tp, fp, fn, round({_PR}, 6) AS precision, round({_RE}, 6) AS recall, round({_F1}, 6) AS f1, tp + fn AS support FROM counts",
    "ref_t7_examples": f"""{_MATCHED} used AS (SELECT extractor, unnest(list_transform(m, lambda q: q.p)) AS pid FROM folded)
        SELECT extractor, relation, line_no, CAST(triple_ix AS INTEGER) AS triple_ix, subject_name, object_name FROM p WHERE line_no * 1000000 + triple_ix NOT IN (SELECT pid FROM used)
        QUALIFY row_number() OVER (PARTITION BY extractor, relation ORDER BY line_no, triple_ix) <= 20""",
    "ref_a8_relaxed": f"""{_REC_ALL}, a0 AS (SELECT DISTINCT extractor, paper_id, field, key FROM ({sqltext.keyed(_clean('ours', 'extractor, '), 'kind', 'v', 'key')}) WHERE key <> ''), b0 AS (SELECT DISTINCT paper_id, field, key FROM ({sqltext.keyed(_clean('refs'), 'kind', 'v', 'key')}) WHERE key <> ''),
        p AS (SELECT *, 'k' AS kd, {_toks('key')} AS st, {_nums('key')} AS sn FROM a0), g AS (SELECT *, 'k' AS kd, {_toks('key')} AS st, {_nums('key')} AS sn FROM b0),
        sims AS (SELECT p.extractor, p.paper_id, p.field, p.key AS pk, g.key AS gk, {_alike('kd', 'key', 'st', 'sn')} AS score FROM p JOIN g USING (paper_id, field)),
        m AS (SELECT extractor, paper_id, field, len({_FOLD.format(g='gk', p='pk')}) AS m FROM sims WHERE score > 0 GROUP BY ALL),
        has AS (SELECT DISTINCT paper_id, field FROM {_clean('refs')}), grid AS (SELECT DISTINCT p.extractor, p.paper_id, f.field FROM ours p, (SELECT field FROM ours UNION SELECT field FROM refs) f),
        v AS (SELECT g.extractor, g.field, CASE WHEN h.paper_id IS NULL THEN 'n' WHEN nb > 0 AND m = na AND m = nb THEN 'a' ELSE 'd' END AS verdict FROM grid g LEFT JOIN has h USING (paper_id, field)
            LEFT JOIN (SELECT extractor, paper_id, field, count(*) AS na FROM a0 GROUP BY ALL) USING (extractor, paper_id, field) LEFT JOIN (SELECT paper_id, field, count(*) AS nb FROM b0 GROUP BY ALL) USING (paper_id, field) LEFT JOIN m USING (extractor, paper_id, field))
        SELECT extractor, field, count(*) FILTER (verdict <> 'n') AS comparable, count(*) FILTER (verdict = 'a') AS agreed, count(*) FILTER (verdict = 'd') AS disagreed, count(*) FILTER (verdict = 'n') AS not_comparable,
            CASE WHEN count(*) FILTER (verdict <> 'n') > 0 THEN round(count(*) FILTER (verdict = 'a') / count(*) FILTER (verdict <> 'n'), 6) END AS agreement_rate FROM v GROUP BY extractor, field""",
    "ref_f10_mismatches": f"{_LEFTOVER} SELECT extractor, relation, CAST(sum(m) AS BIGINT) AS n FROM m WHERE m > 0 GROUP BY ALL",
    "ref_a8_agreement": f"""{_REC_ALL}, a AS (SELECT DISTINCT extractor, paper_id, field, key FROM ({sqltext.keyed(_clean('ours', 'extractor, '), 'kind', 'v', 'key')}) WHERE key <> ''), b AS (SELECT DISTINCT paper_id, field, key FROM ({sqltext.keyed(_clean('refs'), 'kind', 'v', 'key')}) WHERE key <> ''),
        has AS (SELECT DISTINCT paper_id, field FROM {_clean('refs')}), grid AS (SELECT DISTINCT p.extractor, p.paper_id, f.field FROM ours p, (SELECT field FROM ours UNION SELECT field FROM refs) f),
        v AS (SELECT g.extractor, g.field, CASE WHEN h.paper_id IS NULL THEN 'n' WHEN nb > 0 AND m = na AND m = nb THEN 'a' ELSE 'd' END AS verdict FROM grid g LEFT JOIN has h USING (paper_id, field)
            LEFT JOIN (SELECT extractor, paper_id, field, count(*) AS na FROM a GROUP BY ALL) USING (extractor, paper_id, field) LEFT JOIN (SELECT paper_id, field, count(*) AS nb FROM b GROUP BY ALL) USING (paper_id, field)
            LEFT JOIN (SELECT a.extractor, a.paper_id, a.field, count(*) AS m FROM a JOIN b ON a.paper_id = b.paper_id AND a.field = b.field AND a.key = b.key GROUP BY ALL) USING (extractor, paper_id, field))
        SELECT extractor, field, count(*) FILTER (verdict <> 'n') AS comparable, count(*) FILTER (verdict = 'a') AS agreed, count(*) FILTER (verdict = 'd') AS disagreed, count(*) FILTER (verdict = 'n') AS not_comparable,
            CASE WHEN count(*) FILTER (verdict <> 'n') > 0 THEN round(count(*) FILTER (verdict = 'a') / count(*) FILTER (verdict <> 'n'), 6) END AS agreement_rate FROM v GROUP BY extractor, field""",
    "ref_a8_missing": f"{_REC_ALL} SELECT extractor, count(DISTINCT paper_id) FILTER (paper_id NOT IN (SELECT paper_id FROM refs)) AS n_missing FROM ours GROUP BY extractor",
    "ref_g1_key_violations": "SELECT '' AS label, '' AS key, CAST(0 AS BIGINT) AS n WHERE false",
    "ref_g2_papers": f"""{_GRAPH} SELECT g.paper_id, k.* EXCLUDE (paper_id) FROM gpapers g LEFT JOIN (SELECT paper_id, max((retrieved_at, doi)) FILTER (doi IS NOT NULL)[2] AS doi, max((retrieved_at, title)) FILTER (title IS NOT NULL)[2] AS title, max((retrieved_at, license)) FILTER (license IS NOT NULL)[2] AS license,
        max((retrieved_at, source)) FILTER (source IS NOT NULL)[2] AS source FROM papers GROUP BY paper_id) k ON k.paper_id = g.paper_id""",
    "ref_g3_nodes": f"{_GRAPH} SELECT label, key, name, aliases FROM nodes",
    "ref_g4_edges": f"{_GRAPH} SELECT * FROM edges",
    "ref_g5_mentions": f"{_GRAPH} SELECT * FROM mentions",
    "ref_g6_rejections": f"{_GRAPH} SELECT reason, count(*) AS n FROM loaded WHERE reason IS NOT NULL GROUP BY reason",
    "ref_a20_load_stats": f"{_GRAPH} SELECT count(DISTINCT paper_id) FILTER (reason IS NULL) AS papers, count(*) AS triples_in, count(*) FILTER (reason IS NULL) AS triples_written, count(*) FILTER (reason IS NOT NULL) AS triples_skipped, 2 * count(*) FILTER (reason IS NULL) AS nodes_merged, 2 * count(*) FILTER (reason IS NULL) AS provenance_edges FROM loaded",
    "ref_k1_solvent_temperature": f"""{_GRAPH}, r AS (SELECT l.name AS linker, coalesce(solvent, 'unspecified') AS solvent, coalesce(condition, 'unspecified') AS condition, a.mof, m.name AS mof_name FROM mof_linker a JOIN mof_method b USING (mof) LEFT JOIN m_solvent USING (mk) LEFT JOIN m_condition USING (mk)
        JOIN nodes l ON l.label = 'OrganicLinker' AND l.key = a.lk JOIN nodes m ON m.label = 'MOF' AND m.key = a.mof)
        SELECT linker, solvent, condition, count(DISTINCT mof) AS n_mofs, array_to_string(list_sort(list(DISTINCT mof_name))[:5], '|') AS example_mofs FROM r GROUP BY linker, solvent, condition ORDER BY n_mofs DESC, linker, solvent, condition LIMIT 50""",
    "ref_k2_methods": f"{_GRAPH} SELECT n.name AS method, n_mofs, n_papers FROM (SELECT mk, count(DISTINCT mof) AS n_mofs, count(DISTINCT paper_id) AS n_papers FROM mof_method JOIN mof_paper USING (mof) GROUP BY mk) JOIN nodes n ON n.label = 'SynthesisMethod' AND n.key = mk",
    "ref_k3_pairs": f"""{_GRAPH} SELECT p.name AS precursor, l.name AS linker, count(DISTINCT a.mof) AS n_mofs, count(DISTINCT paper_id) AS n_papers FROM mof_pre a JOIN mof_linker b USING (mof) JOIN mof_paper USING (mof) JOIN nodes p ON p.label = 'MetalPrecursor' AND p.key = pk JOIN nodes l ON l.label = 'OrganicLinker' AND l.key = lk
        GROUP BY ALL ORDER BY n_papers DESC, n_mofs DESC, precursor, linker LIMIT 50""",
    "ref_k4_full_record": f"""{_GRAPH} SELECT name AS mof, {_listed('precursors', f"mof_pre JOIN nodes n ON n.label = 'MetalPrecursor' AND n.key = pk WHERE mof = '{_K4}'")}, {_listed('linkers', f"mof_linker JOIN nodes n ON n.label = 'OrganicLinker' AND n.key = lk WHERE mof = '{_K4}'")},
        {_listed('methods', f"mof_method JOIN nodes n ON n.label = 'SynthesisMethod' AND n.key = mk WHERE mof = '{_K4}'")}, {_listed('solvents', f"mof_method JOIN (SELECT mk, solvent AS name FROM m_solvent) n USING (mk) WHERE mof = '{_K4}'")},
        {_listed('conditions', f"mof_method JOIN (SELECT mk, condition AS name FROM m_condition) n USING (mk) WHERE mof = '{_K4}'")},
        {_listed('properties', f"edges JOIN nodes n ON n.label = 'Property' AND n.key = dst_key WHERE rel = 'HAS_PROPERTY' AND src_label = 'MOF' AND dst_label = 'Property' AND src_key = '{_K4}'")},
        (SELECT count(*) FROM (SELECT DISTINCT paper_id, evidence FROM mentions WHERE label = 'MOF' AND key = '{_K4}')) AS n_provenance FROM nodes WHERE label = 'MOF' AND key = '{_K4}'""",
    "ref_k5_provenance": f"""{_GRAPH} SELECT s.name AS subject, rel AS relation, o.name AS object, evidence, paper_id, section, extractor, confidence FROM edges e JOIN nodes s ON s.label = src_label AND s.key = src_key JOIN nodes o ON o.label = dst_label AND o.key = dst_key
        WHERE src_key = '{_K4}' AND rel <> 'MENTIONED_IN' ORDER BY confidence DESC NULLS LAST, relation, object, subject, evidence LIMIT 25""",
    "ref_k6_stats": f"{_GRAPH} SELECT (SELECT count(*) FROM nodes) + (SELECT count(*) FROM gpapers) AS nodes, (SELECT count(*) FROM edges) + (SELECT count(*) FROM mentions) AS rels, (SELECT count(*) FROM gpapers) AS papers",
    "ref_k7_breakdown": f"{_GRAPH} SELECT label AS entity_type, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'Paper', count(*) FROM gpapers",
    "ref_k8_violations": f"{_GRAPH} SELECT label AS entity_type, name FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM mentions m WHERE m.label = n.label AND m.key = n.key)",
    "ref_j2_join": f"""WITH a AS (SELECT {c.strip('refcode')} AS refcode, metal, clean_linker_1, cn_topology FROM digimof_synmof_merged WHERE refcode IS NOT NULL QUALIFY row_number() OVER (PARTITION BY 1, {c.strip('refcode')} ORDER BY metal NULLS FIRST, clean_linker_1 NULLS FIRST, cn_topology NULLS FIRST) = 1),
        b AS (SELECT {c.strip("replace(filename, '_clean', '')")} AS refcode, metal_ele1, temperature_celsius FROM digimof_synmof_merged QUALIFY row_number() OVER (PARTITION BY {c.strip("replace(filename, '_clean', '')")} ORDER BY filename NULLS FIRST, temperature_celsius NULLS FIRST, time_h NULLS FIRST, yield_percent NULLS FIRST, metal_ele1 NULLS FIRST) = 1)
        SELECT refcode, metal, metal_ele1, temperature_celsius FROM a JOIN b USING (refcode)""",
    "ref_j2_report": f"""SELECT 'left' AS side, count(*) AS n_rows, count(DISTINCT {c.strip('refcode')}) AS n_unique, count(*) - count(DISTINCT {c.strip('refcode')}) AS n_dropped FROM digimof_synmof_merged WHERE refcode IS NOT NULL
        UNION ALL SELECT 'right', count(*), count(DISTINCT {c.strip("replace(filename, '_clean', '')")}), count(*) - count(DISTINCT {c.strip("replace(filename, '_clean', '')")}) FROM digimof_synmof_merged WHERE filename IS NOT NULL""",
    "ref_a10_coverage": " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS n, count(*) AS total, round(100 * count({f}) / count(*), 1) AS pct FROM digimof_synmof_merged" for f in reference.FIELDS),
    "ref_a11_solvents": f"""SELECT CASE cid {' '.join(f"WHEN {k} THEN '{v}'" for k, v in reference.CID_NAMES.items())} ELSE 'CID_' || cid END AS solvent, count(*) AS n FROM (SELECT unnest([solvent1, solvent2, solvent3, solvent4, solvent5]) AS cid FROM digimof_synmof_merged) WHERE cid IS NOT NULL GROUP BY 1""",
    "ref_a11_metals": "SELECT metal_ele1 AS metal, count(*) AS n FROM digimof_synmof_merged WHERE metal_ele1 IS NOT NULL GROUP BY 1",
    "ref_a12_conditions": """SELECT min(temperature_celsius) AS temperature_min, max(temperature_celsius) AS temperature_max, median(temperature_celsius) AS temperature_median, min(time_h) AS time_min, max(time_h) AS time_max, median(time_h) AS time_median,
        median(TRY_CAST(yield_percent AS DOUBLE)) AS yield_median, count(TRY_CAST(yield_percent AS DOUBLE)) AS n_yield FROM digimof_synmof_merged""",
    "ref_a13_metals": """WITH e AS (SELECT CASE WHEN metal IS NULL OR lower(trim(metal)) IN ('', 'nan', 'none') THEN [] ELSE regexp_extract_all(metal, '[A-Z][a-z]?') END AS d, CASE WHEN metal_ele1 IS NULL OR lower(trim(metal_ele1)) IN ('', 'nan', 'none') THEN [] ELSE regexp_extract_all(metal_ele1, '[A-Z][a-z]?') END AS s FROM digimof_synmof_merged),
        v AS (SELECT len(d) > 0 AND len(s) > 0 AS both_, len(d) > 0 AND len(s) > 0 AND list_has_all(d, s) AS ok FROM e) SELECT count(*) FILTER (ok) AS agreed, count(*) FILTER (both_) AS comparable, count(*) - count(*) FILTER (both_) AS not_comparable, round(100 * count(*) FILTER (ok) / count(*) FILTER (both_), 1) AS pct FROM v""",
    "ref_j4_screen": f"""WITH w(name, m, l) AS (VALUES {', '.join(f'({sqltext.lit(k)}, {sqltext.lit(v[0])}, {sqltext.lit(v[1])})' for k, v in _COMPOSITIONS.items())}), g AS (SELECT DISTINCT t.subject_name AS name FROM (SELECT unnest(triples) AS t FROM gold) WHERE t.subject_type = 'MOF' AND t.subject_name IS NOT NULL)
        SELECT DISTINCT w.name, d.refcode, d.metal, d.clean_linker_1 AS linker, d.cn_topology AS topology FROM w JOIN g USING (name) JOIN digimof_synmof_merged d ON lower(trim(d.metal)) NOT IN ('', 'nan', 'none') AND list_contains(regexp_extract_all(d.metal, '[A-Z][a-z]?'), w.m) AND contains(lower(d.clean_linker_1), w.l)""",
    "ref_stream_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
