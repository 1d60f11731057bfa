"""Collection of papers (P1-P3, P20, A16): article XML -> paper records, ordered deduplication, licences.

Defined results: empty, blank and malformed XML and articles without text give null; a hit without identifier is
skipped; repeated identifiers keep the earliest hit; the order of hits is their rank.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAPER = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("paper_id", "title", "source", "doi", "pmcid", "license")]
    + [T.StructField("sections", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])))]
)


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _all(root: ET.Element, name: str) -> Iterator[ET.Element]:
    return (n for n in root.iter() if n is not root and _local(n) == name)


def _children(node: ET.Element, name: str) -> list[ET.Element]:
    return [c for c in node if _local(c) == name]


def _said(node: ET.Element | None) -> str:
    """P20: all text under a node, white space squeezed."""
    return " ".join("".join(node.itertext()).split()) if node is not None else ""


def _paragraphs(nodes: Iterable[ET.Element]) -> str:
    return "\n".join(t for t in map(_said, nodes) if t)


def parse_article(xml: bytes | str | None) -> dict | None:
    """One article as a paper record; namespaces do not matter."""
    if not xml or not xml.strip():
        return None
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return None
    first = lambda name: next(_all(root, name), None)
    ids = [(n.get("pub-id-type"), _said(n)) for n in _all(root, "article-id")]
    doi = next((t for k, t in ids if k == "doi"), None)
    pmcid = next((t for k, t in ids if k in ("pmcid", "pmc")), None)
    title = _said(first("article-title")) or "Untitled"
    licence = next((t for p in _all(root, "permissions") for n in _children(p, "license") if (t := _said(n))), None)

    sections: list[dict[str, str]] = []

    def add(name: str, text: str) -> None:
        if text:
            sections.append({"name": name, "text": text})

    abstract, body = first("abstract"), first("body")
    if abstract is not None:
        add("Abstract", _paragraphs(_all(abstract, "p")) or _said(abstract))
    if body is not None:
        for sec in _children(body, "sec"):
            titles = _children(sec, "title")
            add(_said(titles[0]) if titles else "Untitled section", _paragraphs(_all(sec, "p")))
        add("Body", _paragraphs(_children(body, "p")))
    if not sections:
        return None
    return {"paper_id": pmcid or (f"doi:{doi}" if doi else title[:40]), "title": title, "source": "europepmc", "doi": doi, "pmcid": pmcid, "license": licence, "sections": sections}


@F.pandas_udf(PAPER)
def _parse_udf(xml: pd.Series) -> pd.DataFrame:
    names = [f.name for f in PAPER]
    return pd.DataFrame([[(p or {}).get(n) for n in names] for p in map(parse_article, xml)], columns=names)


def parsed(raw: DataFrame, key: str = "pmcid", xml: str = "xml") -> DataFrame:
    """(hit key, paper columns); articles that gave nothing have a null paper_id."""
    return raw.select(F.col(key).alias("hit"), _parse_udf(xml).alias("p")).select("hit", "p.*")


def backfilled(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """DOI and licence of the article, else of the search hit."""
    h = hits.select(F.col("pmcid").alias("hit"), F.col("doi").alias("_doi"), F.col("license").alias("_license"))
    j = papers.join(h, "hit", "left")
    return j.withColumn("doi", F.coalesce(F.nullif("doi", F.lit("")), "_doi")).withColumn("license", F.coalesce(F.nullif("license", F.lit("")), "_license")).drop("_doi", "_license")


def ordered_dedupe(hits: Iterable[dict]) -> tuple[list[dict], list[str]]:
    """Hits in rank order without repeated identifiers or DOIs, and why others were skipped.

    A hit dropped for its DOI does not use up its identifier, so this is a fold over the ranked hits of one
    search (a few hundred rows by construction of the search).
    """
    ids: set[str] = set()
    dois: set[str] = set()
    kept, why = [], []
    for h in hits:
        pmcid, doi = h.get("pmcid"), (h.get("doi") or "").lower()
        if not pmcid:
            continue
        if pmcid in ids:
            why.append(f"{pmcid}: duplicate PMCID in search results, skipped")
        elif doi and doi in dois:
            why.append(f"{pmcid}: duplicate DOI {doi}, skipped")
        else:
            ids.add(pmcid)
            dois |= {doi} - {""}
            kept.append(h)
    return kept, why


#: Hits asked for per paper wanted, as not every hit has a full text.
OVER_FETCH = 3


def collect(spark: SparkSession, search: Callable[[int], Iterable[dict]], fetch: Callable[[str], bytes | None], cache: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A collection run: (papers, skipped (rank, pmcid, reason), new cache rows) of the first ``limit`` hits that give a paper.

    ``search(n)`` yields the ranked hits. They are fetched and parsed on the executors in waves of as many as are still missing, so
    no more are fetched than one by one, and the result is the same: an identifier counts as seen before it is fetched,
    whether or not a paper comes of it. A fetch that fails is a reason and does not end the run.
    """
    from passagekg.runtime import stage_table

    kept, why = ordered_dedupe(search(limit * OVER_FETCH))
    known = cache.groupBy("pmcid").agg(F.max("xml").alias("xml"))
    papers = skipped = new = None
    start = have = 0

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pmcid, xml in zip(b["pmcid"], b["xml"], strict=True):
                failure = None
                if xml is None:
                    try:
                        xml = fetch(pmcid) or None
                    except Exception as e:
                        failure = f"{type(e).__name__}: {e}"
                rows.append((xml, failure))
            yield b.drop(columns="xml").assign(xml=[r[0] for r in rows], failure=[r[1] for r in rows])

    while have < limit and start < len(kept):
        wave = [(start + i, h["pmcid"], h.get("doi"), h.get("license")) for i, h in enumerate(kept[start : start + limit - have])]
        start += len(wave)
        hits = spark.createDataFrame(wave, "rank int, pmcid string, doi string, license string")
        asked = hits.join(known, "pmcid", "left").withColumn("cached", F.col("xml").isNotNull())
        answers = stage_table(asked.repartition("pmcid").mapInPandas(get, "pmcid string, rank int, doi string, license string, cached boolean, xml binary, failure string"), "collected")
        found = backfilled(parsed(answers.where("xml IS NOT NULL")), hits)
        found = stage_table(found.join(hits.select(F.col("pmcid").alias("hit"), "rank"), "hit").where("paper_id IS NOT NULL"), "collected-papers")
        have += found.count()
        reason = F.coalesce("failure", F.when(F.col("xml").isNull(), "no full-text XML").otherwise("unparseable / no body text"))
        missed = answers.join(found.select(F.col("hit").alias("pmcid")), "pmcid", "left_anti").select("rank", "pmcid", reason.alias("reason"))
        fresh = answers.where("NOT cached AND xml IS NOT NULL").select("pmcid", "xml")
        papers, skipped, new = (b if a is None else a.unionByName(b) for a, b in ((papers, found), (skipped, missed), (new, fresh)))
    repeated = spark.createDataFrame([(None, w.partition(":")[0], w.partition(": ")[2]) for w in why], "rank int, pmcid string, reason string")
    if papers is None:
        papers = parsed(cache.limit(0)).withColumn("rank", F.lit(0))
        skipped, new = repeated.limit(0), cache.limit(0)
    return papers.drop("hit"), skipped.unionByName(repeated), new


def distinct_papers(papers: DataFrame) -> DataFrame:
    """P3 on tables of any size: the latest copy per paper_id, then per DOI (case-insensitive) the first paper_id.

    Two aggregations by key instead of a fold; they differ from the fold only where a copy dropped for its DOI
    would have freed its identifier for another copy. Papers without DOI are all kept.
    """
    row = lambda df: F.struct(*[F.col(c) for c in df.columns])
    order = F.struct(F.col("retrieved_at"), F.xxhash64(F.to_json(F.struct("title", "doi", "license", "sections"))))
    one = papers.where("paper_id IS NOT NULL").groupBy(F.col("paper_id").alias("_k")).agg(F.max_by(row(papers), order).alias("_r")).select("_r.*")
    key = F.coalesce(F.nullif(F.lower(F.trim("doi")), F.lit("")), F.concat(F.lit("no doi:"), "paper_id"))
    return one.groupBy(key.alias("_k")).agg(F.min_by(row(one), "paper_id").alias("_r")).select("_r.*")


def licences(papers: DataFrame) -> DataFrame:
    """Papers per licence; null and empty are 'unknown'."""
    return papers.groupBy(F.coalesce(F.nullif("license", F.lit("")), F.lit("unknown")).alias("license")).agg(F.count("*").alias("n"))
