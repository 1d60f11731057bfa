"""Property graph as tables (G1-G7) and its named queries (K1-K9), by deterministic batch rebuild.

Instead of one MERGE per triple the graph is rebuilt by aggregations over a load ordinal: first write wins for
names, last write wins for edge properties, aliases in first-seen order. The rebuild is idempotent and does not
depend on partitioning, because the ordinal decides every tie. All group-bys combine map-side (min_by/max_by), so a
node mentioned by a third of all triples is reduced before the shuffle.

Defined results: a triple without paper, with MENTIONED_IN or with an empty key on either side is rejected and
reported with its reason; null properties never overwrite known ones of a paper; an empty graph counts zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagekg.functions.text import with_key
from passagekg.operators.ontology import PROVENANCE
from passagekg.runtime import stage_table


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  # label, key, name, aliases
    edges: DataFrame  # src_label, src_key, rel, dst_label, dst_key, evidence, confidence, extractor, paper_id, section
    mentions: DataFrame  # label, key, paper_id, section, evidence
    papers: DataFrame  # paper_id, doi, title, license, source


def load_rows(triples: DataFrame) -> DataFrame:
    """Triples (flat, with ord) plus keys and the reason of rejection."""
    k = with_key(with_key(triples, "subject_type", "subject_name", "src_key"), "object_type", "object_name", "dst_key")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = (
        F.when(blank("paper_id"), "missing paper")
        .when(F.col("relation") == PROVENANCE, "provenance relation")
        .when(F.col("relation").isNull() | F.col("subject_type").isNull() | F.col("object_type").isNull(), "missing type or relation")
        .when(blank("src_key") | blank("dst_key"), "empty key")
    )
    return k.withColumn("reason", reason)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NULL")


def rejections(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def node_table(rows: DataFrame) -> DataFrame:
    """(label, key, name, aliases): first surface as name, distinct surfaces in first-seen order."""
    # subject and object of one triple are ordered by their side
    s = rows.select(F.col("subject_type").alias("label"), F.col("src_key").alias("key"), F.col("subject_name").alias("name"), F.struct(F.col("ord"), F.lit(0).alias("side")).alias("o"))
    o = rows.select(F.col("object_type").alias("label"), F.col("dst_key").alias("key"), F.col("object_name").alias("name"), F.struct(F.col("ord"), F.lit(1).alias("side")).alias("o"))
    surfaces = s.unionByName(o).groupBy("label", "key", "name").agg(F.min("o").alias("o"))
    return surfaces.groupBy("label", "key").agg(
        F.min_by("name", "o").alias("name"), F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("aliases")
    )


def edge_table(rows: DataFrame) -> DataFrame:
    """One edge per (subject, relation, object); properties of the last write."""
    props = F.struct("evidence", "confidence", "extractor", "paper_id", F.col("source_section").alias("section"))
    g = rows.groupBy(F.col("subject_type").alias("src_label"), "src_key", F.col("relation").alias("rel"), F.col("object_type").alias("dst_label"), "dst_key")
    return g.agg(F.max_by(props, "ord").alias("p")).select("src_label", "src_key", "rel", "dst_label", "dst_key", "p.*")


def mention_table(rows: DataFrame) -> DataFrame:
    """One provenance edge per (node, paper); section and evidence of the last write."""
    end = lambda label, key, side: F.struct(F.col(label).alias("label"), F.col(key).alias("key"), F.lit(side).alias("side"))
    ends = rows.select("paper_id", "source_section", "evidence", "ord", F.explode(F.array(end("subject_type", "src_key", 0), end("object_type", "dst_key", 1))).alias("e"))
    g = ends.groupBy("e.label", "e.key", "paper_id").agg(F.max_by(F.struct(F.col("source_section").alias("section"), "evidence"), F.struct("ord", "e.side")).alias("p"))
    return g.select("label", "key", "paper_id", "p.*")


def paper_table(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """The papers that triples cite; per property the latest known value (by retrieved_at)."""
    latest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(F.col("retrieved_at"), F.col(c)))).alias(c)
    known = papers.groupBy("paper_id").agg(*[latest(c) for c in ("doi", "title", "license", "source")])
    return rows.select("paper_id").distinct().join(known, "paper_id", "left")


def build(triples: DataFrame, papers: DataFrame, staged: bool = False) -> Graph:
    rows = accepted(load_rows(triples))
    if staged:  # four tables come from the keyed rows: key them once
        rows = stage_table(rows, "graph-rows")
    return Graph(node_table(rows), edge_table(rows), mention_table(rows), paper_table(rows, papers))


def outline(triples: DataFrame) -> Graph:
    """The graph without what its edges and mentions say: names, ends and papers, keyed once, for queries over its shape.

    Evidence and the like, most of a triple's bytes, are neither read nor written.
    """
    rows = load_rows(triples).select("ord", "paper_id", "relation", "subject_type", "subject_name", "src_key", "object_type", "object_name", "dst_key", "reason")
    rows = accepted(stage_table(rows, "graph-outline"))  # a filter before would go below the keys and compute them again
    edges = rows.select(F.col("subject_type").alias("src_label"), "src_key", F.col("relation").alias("rel"), F.col("object_type").alias("dst_label"), "dst_key").distinct()
    ends = [rows.select(F.col(f"{side}_type").alias("label"), F.col(key).alias("key"), "paper_id") for side, key in (("subject", "src_key"), ("object", "dst_key"))]
    return Graph(node_table(rows), edges, ends[0].unionByName(ends[1]).distinct(), rows.select("paper_id").distinct())


def load_stats(triples: DataFrame) -> DataFrame:
    """Totals of a load, one row."""
    r = load_rows(triples)
    ok = F.col("reason").isNull()
    n = lambda c: F.count(F.when(c, 1))
    return r.agg(
        F.countDistinct(F.when(ok, F.col("paper_id"))).alias("papers"), F.count("*").alias("triples_in"), n(ok).alias("triples_written"), n(~ok).alias("triples_skipped"),
        (2 * n(ok)).alias("nodes_merged"), (2 * n(ok)).alias("provenance_edges"),
    )


def key_violations(g: Graph) -> DataFrame:
    """G1: keys that are not unique; must be empty."""
    n = g.nodes.groupBy("label", "key").agg(F.count("*").alias("n"))
    p = g.papers.groupBy(F.lit("Paper").alias("label"), F.col("paper_id").alias("key")).agg(F.count("*").alias("n"))
    return n.unionByName(p).where("n > 1")


# -- named queries --


def _edges(g: Graph, rel: str, src: str, dst: str) -> DataFrame:
    """Edges of one relation as (src key, dst key) under the given names."""
    return g.edges.where(F.col("rel") == rel).select(F.col("src_label").alias(f"{src}_label"), F.col("src_key").alias(src), F.col("dst_label").alias(f"{dst}_label"), F.col("dst_key").alias(dst))


def _of_mof(g: Graph, rel: str, dst: str, dst_label: str) -> DataFrame:
    return _edges(g, rel, "mof", dst).where((F.col("mof_label") == "MOF") & (F.col(f"{dst}_label") == dst_label)).select("mof", dst)


def _of_method(g: Graph, rel: str, dst: str, dst_label: str) -> DataFrame:
    return _edges(g, rel, "method", dst).where((F.col("method_label") == "SynthesisMethod") & (F.col(f"{dst}_label") == dst_label)).select("method", dst)


def _names(g: Graph, label: str, key: str, name: str) -> DataFrame:
    return g.nodes.where(F.col("label") == label).select(F.col("key").alias(key), F.col("name").alias(name))


def solvent_temperature_by_linker(g: Graph, limit: int = 50) -> DataFrame:
    """K1: frameworks per (linker, solvent, condition), the most common first.

    Solvents and conditions hang on shared routes, so naively every route multiplies its solvents by its conditions
    by its frameworks. Here the frameworks of (linker, route) are bit sets. A row has at most the frameworks that its linker
    has with its solvent and with its condition; rows of the commonest of these are counted first, and the ``limit``-th of
    them settles which others can be among the first rows. One that may equal it is kept, so the cut is exact.
    """
    per = _of_mof(g, "USES_LINKER", "linker_key", "OrganicLinker").join(_of_mof(g, "SYNTHESIZED_BY", "method", "SynthesisMethod"), "mof")
    per = stage_table(per.join(_names(g, "OrganicLinker", "linker_key", "linker"), "linker_key").select("mof", "method", "linker").distinct(), "linker-frameworks")
    routes = per.select("method").distinct()
    sizes = per.groupBy("linker", "method").agg(F.count("*").alias("n"))

    def names(rel: str, label: str, out: str) -> DataFrame:
        named = _of_method(g, rel, "k", label).join(_names(g, label, "k", "name"), "k").select("method", "name").distinct()
        return routes.join(named, "method", "left").select("method", F.coalesce("name", F.lit("unspecified")).alias(out))

    solvents, conditions = stage_table(names("IN_SOLVENT", "Solvent", "solvent"), "linker-solvents"), stage_table(names("AT_CONDITION", "Condition", "condition"), "linker-conditions")
    # a linker gives a row with at least as many frameworks for every solvent and condition of its largest route, so the
    # first ``limit`` rows are settled to be no smaller than the route with which that many rows are reached
    rows_of = solvents.groupBy("method").agg(F.count("*").alias("a")).join(conditions.groupBy("method").agg(F.count("*").alias("b")), "method").select("method", (F.col("a") * F.col("b")).alias("rows"))
    largest = sizes.groupBy("linker").agg(F.max(F.struct("n", "method")).alias("m")).select(F.col("m.n").alias("n"), F.col("m.method").alias("method"))
    first = largest.orderBy(F.desc("n"), "method").limit(limit).join(rows_of, "method")
    reached = first.withColumn("sum", F.sum("rows").over(Window.orderBy(F.desc("n"), "method").rowsBetween(Window.unboundedPreceding, 0)))  # at most ``limit`` rows
    floor = reached.agg(F.coalesce(F.max(F.when(F.col("sum") >= limit, F.col("n"))), F.lit(0)).alias("floor")).first().floor
    totals = per.groupBy("linker").agg(F.countDistinct("mof").alias("total"))
    near = per.join(totals.where(F.col("total") >= floor).select("linker"), "linker")  # only routes of such linkers matter
    bits = stage_table(_bit_sets(near.withColumn("own", F.struct("linker", "method")), "own", "mof").select("own.*", "word", "bits"), "linker-bits")

    def bounds(of: DataFrame, name: str) -> DataFrame:
        return stage_table(_union_sizes(bits.join(of, "method"), ["linker", name], f"{name}_n").where(F.col(f"{name}_n") >= floor), f"linker-{name}")

    by_solvent, by_condition = bounds(solvents, "solvent"), bounds(conditions, "condition")
    most = F.least("solvent_n", "condition_n")

    def counted(rows: DataFrame) -> DataFrame:
        rows = stage_table(rows.select("linker", "solvent", "condition", F.monotonically_increasing_id().alias("id")), "linker-rows")
        of = rows.join(solvents, "solvent").join(conditions, ["condition", "method"]).select("id", "linker", "method")
        return rows.join(_union_sizes(of.join(bits, ["linker", "method"]), ["id"], "n_mofs"), "id")

    common = [x.orderBy(F.desc(f"{name}_n"), "linker", name).limit(limit) for x, name in ((by_solvent, "solvent"), (by_condition, "condition"))]
    some = counted(common[0].join(common[1], "linker").orderBy(F.desc(most), "linker", "solvent", "condition").limit(4 * limit))
    last = some.orderBy(F.desc("n_mofs")).limit(limit).agg(F.count("*").alias("rows"), F.min("n_mofs").alias("n")).first()
    floor = max(floor, last.n) if limit and last.rows == limit else floor
    kept = counted(by_solvent.where(F.col("solvent_n") >= floor).join(by_condition.where(F.col("condition_n") >= floor), "linker"))
    first = stage_table(kept.orderBy(F.desc("n_mofs"), "linker", "solvent", "condition").limit(limit), "linker-first")
    named = per.join(first.select("linker").distinct(), "linker").join(_names(g, "MOF", "mof", "mof_name"), "mof")
    shown = first.join(solvents, "solvent").join(conditions, ["condition", "method"]).join(named, ["method", "linker"]).groupBy("linker", "solvent", "condition", "n_mofs")
    done = shown.agg(F.slice(F.array_sort(F.collect_set("mof_name")), 1, 5).alias("example_mofs"))
    return done.orderBy(F.desc("n_mofs"), "linker", "solvent", "condition")


def method_distribution(g: Graph) -> DataFrame:
    """K2: frameworks per route, and papers that mention such a framework."""
    m = _of_mof(g, "SYNTHESIZED_BY", "method", "SynthesisMethod")
    p = g.mentions.where(F.col("label") == "MOF").select(F.col("key").alias("mof"), "paper_id")
    done = m.join(p, "mof").groupBy("method").agg(F.countDistinct("mof").alias("n_mofs"), F.countDistinct("paper_id").alias("n_papers"))
    named = done.join(_names(g, "SynthesisMethod", "method", "name"), "method").select(F.col("name").alias("method"), "n_mofs", "n_papers")
    return named.orderBy(F.desc("n_papers"), F.desc("n_mofs"), "method")


def _bit_sets(pairs: DataFrame, owner: str, member: str) -> DataFrame:
    """(owner, word, bits): the members of every owner as words of 64 bits, so that unions are ``bit_or`` over few rows."""
    ids = stage_table(pairs.select(member).distinct().withColumn("_id", F.monotonically_increasing_id()), "members")
    bit = F.expr("shiftleft(1L, CAST(_id & 63 AS INT))")
    return pairs.join(ids, member).groupBy(owner, F.shiftright("_id", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _union_sizes(sets: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Distinct members over all words of a key."""
    return sets.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits")).groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias(out))


def precursor_linker_pairs(g: Graph, limit: int = 50) -> DataFrame:
    """K3: frameworks and papers per (precursor, linker), most papers first.

    A framework of many names would multiply its precursors by its linkers by its papers. So pairs of the commonest ends are
    counted first; the ``limit``-th of them settles which others can be among the first rows, and only their papers are
    counted, as bit sets. A pair has at most the papers and frameworks of either end, and the papers of its frameworks added
    up; one that may equal that row is kept, so the cut is exact.
    """
    pre, lin = _of_mof(g, "USES_PRECURSOR", "pk", "MetalPrecursor"), _of_mof(g, "USES_LINKER", "lk", "OrganicLinker")
    both = pre.select("mof").distinct().join(lin.select("mof").distinct(), "mof")
    papers = g.mentions.where(F.col("label") == "MOF").select(F.col("key").alias("mof"), "paper_id")
    papers = stage_table(_bit_sets(stage_table(papers.join(both, "mof"), "pair-papers"), "mof", "paper_id"), "pair-bits")
    sizes = _union_sizes(papers, ["mof"], "n")
    pre, lin = stage_table(pre.join(sizes, "mof"), "pair-precursors"), stage_table(lin.join(both, "mof"), "pair-linkers")
    total = papers.groupBy("word").agg(F.bit_or("bits").alias("bits")).agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]
    bound = lambda n: F.struct(F.least(F.sum(n), F.lit(total)).alias("papers"), F.count("*").alias("mofs")).alias("most")

    def met(pk: DataFrame, lk: DataFrame) -> DataFrame:
        return pre.join(pk.select("pk"), "pk").join(lin.join(lk.select("lk"), "lk"), "mof").groupBy("pk", "lk").agg(bound("n"))

    def counted(pairs: DataFrame) -> DataFrame:
        pairs = stage_table(pairs.select("pk", "lk", F.col("most.mofs").alias("n_mofs"), F.monotonically_increasing_id().alias("id")), "pairs")
        of = pairs.select("id", "pk", "lk").join(pre, "pk").join(lin, ["mof", "lk"]).select("id", "mof")
        return pairs.join(_union_sizes(of.join(papers, "mof"), ["id"], "n_papers"), "id")

    def floor(pairs: DataFrame) -> tuple[int, int]:
        """(papers, frameworks) that the last of the first ``limit`` rows has at least, by the pairs with the highest bounds."""
        rows = counted(pairs.orderBy(F.desc("most"), "pk", "lk").limit(4 * limit)).select(F.struct("n_papers", "n_mofs").alias("row")).orderBy(F.desc("row")).limit(limit)
        last = rows.agg(F.count("*").alias("n"), F.min("row").alias("row")).first()
        return (last.row.n_papers, last.row.n_mofs) if limit and last.n == limit else (0, 0)

    def reaches(least: tuple[int, int], *papers: str):
        return F.struct(F.least("most.papers", *papers) if papers else F.col("most.papers"), F.col("most.mofs")) >= F.struct(*[F.lit(x).cast("bigint") for x in least])

    def within(key: str, ends: DataFrame, pairs: DataFrame, out: str) -> DataFrame:
        return _union_sizes(ends.join(pairs.select(key).distinct(), key).join(papers, "mof"), [key], out)

    pks, lks = pre.groupBy("pk").agg(bound("n")), lin.join(sizes, "mof").groupBy("lk").agg(bound("n"))
    at = floor(met(pks.orderBy(F.desc("most"), "pk").limit(limit), lks.orderBy(F.desc("most"), "lk").limit(limit)))
    pairs = stage_table(met(pks.where(reaches(at)), lks.where(reaches(at))).where(reaches(at)), "pair-bounds")
    at = max(at, floor(pairs))
    pairs = pairs.where(reaches(at))
    pairs = pairs.join(within("pk", pre, pairs, "pn"), "pk").join(within("lk", lin, pairs, "ln"), "lk").where(reaches(at, "pn", "ln"))
    done = counted(pairs).join(_names(g, "MetalPrecursor", "pk", "precursor"), "pk").join(_names(g, "OrganicLinker", "lk", "linker"), "lk")
    return done.select("precursor", "linker", "n_mofs", "n_papers").orderBy(F.desc("n_papers"), F.desc("n_mofs"), "precursor", "linker").limit(limit)


def mof_full_record(g: Graph, mof_key: str = "hkust-1") -> DataFrame:
    """K4: one framework; each list by its own aggregation, so no product of optional matches arises."""
    node = g.nodes.where((F.col("label") == "MOF") & (F.col("key") == mof_key)).select(F.col("name").alias("mof"))

    def listed(rel: str, label: str, out: str) -> DataFrame:
        d = _of_mof(g, rel, "k", label).where(F.col("mof") == mof_key).join(_names(g, label, "k", "n"), "k")
        return d.agg(F.array_sort(F.collect_set("n")).alias(out))

    methods = _of_mof(g, "SYNTHESIZED_BY", "method", "SynthesisMethod").where(F.col("mof") == mof_key).select("method")

    def of_methods(rel: str, label: str, out: str) -> DataFrame:
        d = _of_method(g, rel, "k", label).join(methods, "method").join(_names(g, label, "k", "n"), "k")
        return d.agg(F.array_sort(F.collect_set("n")).alias(out))

    prov = g.mentions.where((F.col("label") == "MOF") & (F.col("key") == mof_key)).join(g.papers.select("paper_id", "doi"), "paper_id", "left")
    out = node
    for one in (
        listed("USES_PRECURSOR", "MetalPrecursor", "precursors"), listed("USES_LINKER", "OrganicLinker", "linkers"), listed("SYNTHESIZED_BY", "SynthesisMethod", "methods"),
        of_methods("IN_SOLVENT", "Solvent", "solvents"), of_methods("AT_CONDITION", "Condition", "conditions"), listed("HAS_PROPERTY", "Property", "properties"),
        prov.agg(F.array_sort(F.collect_set(F.struct(F.col("paper_id").alias("paper"), "doi", "evidence"))).alias("provenance")),
    ):
        out = out.crossJoin(one)  # each side is one row
    return out


def provenance_for_claim(g: Graph, subject_key: str = "hkust-1", limit: int = 25, by_rank: bool = False) -> DataFrame:
    """K5: evidence of a subject's claims; confidence sorts as text, or by rank on request."""
    e = g.edges.where((F.col("src_key") == subject_key) & (F.col("rel") != PROVENANCE))
    s = g.nodes.select(F.col("label").alias("src_label"), F.col("key").alias("src_key"), F.col("name").alias("subject"))
    o = g.nodes.select(F.col("label").alias("dst_label"), F.col("key").alias("dst_key"), F.col("name").alias("object"))
    rows = e.join(s, ["src_label", "src_key"]).join(o, ["dst_label", "dst_key"]).select("subject", F.col("rel").alias("relation"), "object", "evidence", "paper_id", "section", "extractor", "confidence")
    first = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1) if by_rank else F.col("confidence")
    return rows.orderBy(F.desc_nulls_last(first), "relation", "object", "subject", "evidence").limit(limit)


def graph_stats(g: Graph) -> DataFrame:
    """Nodes, relationships and papers; zeros for an empty graph."""
    n = g.nodes.agg(F.count("*").alias("n"))
    p = g.papers.agg(F.count("*").alias("papers"))
    e = g.edges.agg(F.count("*").alias("e"))
    m = g.mentions.agg(F.count("*").alias("m"))
    one = n.crossJoin(p).crossJoin(e).crossJoin(m)  # four single rows
    return one.select((F.col("n") + F.col("papers")).alias("nodes"), (F.col("e") + F.col("m")).alias("rels"), "papers")


def node_breakdown(g: Graph) -> DataFrame:
    """K7."""
    n = g.nodes.groupBy(F.col("label").alias("entity_type")).agg(F.count("*").alias("n"))
    p = g.papers.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("Paper").alias("entity_type"), "n")
    return n.unionByName(p).orderBy(F.desc("n"), "entity_type")


def provenance_violations(g: Graph, limit: int = 100) -> DataFrame:
    """K8: nodes without a paper; must be empty."""
    left = g.nodes.join(g.mentions.select("label", "key"), ["label", "key"], "left_anti")
    return left.select(F.col("label").alias("entity_type"), "name").orderBy("entity_type", "name").limit(limit)


@dataclass(frozen=True)
class NamedQuery:
    """K9: a question with its builder and default parameters."""

    name: str
    question: str
    run: Callable[..., DataFrame]
    params: dict = field(default_factory=dict)

    def __call__(self, g: Graph, **over) -> DataFrame:
        unknown = set(over) - set(self.params)
        if unknown:
            raise TypeError(f"{self.name} takes {sorted(self.params)}, not {sorted(unknown)}")
        return self.run(g, **(self.params | over))


NAMED = {
    q.name: q
    for q in (
        NamedQuery("graph_stats", "How large is the graph?", graph_stats),
        NamedQuery("node_breakdown", "How do nodes spread over entity types?", node_breakdown),
        NamedQuery("method_distribution", "Which routes dominate, in how many papers?", method_distribution),
        NamedQuery("solvent_temperature_by_linker", "Which solvents and conditions go with each linker?", solvent_temperature_by_linker, {"limit": 50}),
        NamedQuery("precursor_linker_pairs", "Which precursor and linker pairs recur?", precursor_linker_pairs, {"limit": 50}),
        NamedQuery("mof_full_record", "What is known about one framework, and from where?", mof_full_record, {"mof_key": "hkust-1"}),
        NamedQuery("provenance_for_claim", "Which sentence and paper support a claim?", provenance_for_claim, {"subject_key": "hkust-1", "limit": 25}),
        NamedQuery("provenance_violations", "Which nodes lack a source paper?", provenance_violations, {"limit": 100}),
    )
}


#: Takes a table's name and its rows, and stores them.
Writer = Callable[[str, DataFrame], None]


def parquet_writer(path: str) -> Writer:
    """Replaces the tables of a folder, sorted inside files by key for later look-ups."""

    def put(name: str, df: DataFrame) -> None:
        keys = [c for c in ("label", "src_label", "key", "src_key", "paper_id") if c in df.columns]
        df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")

    return put


def write(g: Graph, to: str | Writer) -> None:
    """SNK6, G7, U6: store the graph's tables in a folder or by the caller's writer (a database, a fake in a test).

    Papers and nodes come before the tables that point at them.
    """
    put = parquet_writer(to) if isinstance(to, str) else to
    for name in ("papers", "nodes", "edges", "mentions"):
        put(name, getattr(g, name))


def read(spark, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("nodes", "edges", "mentions", "papers")))


def with_ordinal(triples: DataFrame) -> DataFrame:
    """Load ordinal of flat triples from (line_no, triple_ix): no global sort is needed, only an order."""
    return triples.withColumn("ord", F.struct(F.col("line_no").alias("l"), F.col("triple_ix").alias("i")))


def canonical_routes(g: Graph) -> DataFrame:
    """Optional view of K2's routes under one canonical name per adverb/adjective pair (separate from node keys)."""
    return g.nodes.where(F.col("label") == "SynthesisMethod").withColumn("canonical", F.regexp_replace("key", "ly$", ""))


