"""Readers (SRC1-SRC5, SRC7, SRC14). JSON lines with declared schemas; Parquet is the primary format.

Strict readers fail on malformed lines, tolerant ones drop them. Missing inputs raise with what to do about it, except
where an absent file means "nothing yet" (gold, results).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAPERS = "paper_id string, title string, source string, doi string, pmcid string, license string, sections array<struct<name:string,text:string>>, retrieved_at string"
PASSAGES = "passage_id string, paper_id string, doi string, section_name string, text string, char_start int, char_end int, is_synthesis boolean, synthesis_score double, signals map<string,int>"
_ENTITY = "struct<type:string,name:string,span:array<int>>"
RESULTS = (
    f"passage_id string, paper_id string, section_name string, extractor string, triples array<struct<subject:{_ENTITY},relation:string,object:{_ENTITY},evidence:string,confidence:string,"
    "source_paper_id:string,source_section:string,extractor:string>>, n_triples int, cost_usd double, latency_ms double, errors array<string>, run_at string"
)
GOLD = (
    "passage_id string, paper_id string, section string, status string, triples array<struct<subject_type:string,subject_name:string,subject_span:array<int>,relation:string,object_type:string,"
    "object_name:string,object_span:array<int>,evidence:string,confidence:string,note:string>>, annotator string, annotated_at string, note string, passage_text string, source_doi string,"
    " source_title string, source_license string, source_url string"
)
# Accepted keys of a passages file, most specific first.
ALIASES = {
    "passage_id": ("passage_id", "id", "pid"),
    "text": ("text", "passage", "body", "content"),
    "section": ("section", "section_name", "section_title"),
    "paper_id": ("paper_id", "paper", "doc_id", "document_id"),
    "title": ("title", "paper_title"),
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str, how: str) -> str:
    if not _exists(spark, path):
        raise FileNotFoundError(f"{path} not found. {how}")
    return path


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: strict; a malformed line fails the job."""
    return spark.read.schema(PAPERS).option("mode", "FAILFAST").json(require(spark, path, "Build the corpus first."))


def _tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    lines = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", options).alias("j"))
    return lines.where("j IS NOT NULL AND j._bad IS NULL").select("j.*").drop("_bad")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results so far; truncated lines are dropped, an absent file is empty."""
    return _tolerant(spark, path, RESULTS) if _exists(spark, path) else spark.createDataFrame([], RESULTS)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: tolerant; an absent file is empty."""
    return _tolerant(spark, path, GOLD) if _exists(spark, path) else spark.createDataFrame([], GOLD)


def read_passages(spark: SparkSession, path: str, synthesis_only: bool = True) -> DataFrame:
    """SRC5: passages for a run; a missing flag counts as not synthesis."""
    df = _tolerant(spark, require(spark, path, "Run the segmentation first."), PASSAGES).where("passage_id IS NOT NULL AND text IS NOT NULL")
    return df.where(F.coalesce("is_synthesis", F.lit(False))) if synthesis_only else df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no from 1, value) of text files, without a global sort: counts per file block and their prefix sums."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    blocks = lines.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(offsets, ["file", "block"]).select("file", (F.col("before") + F.col("mid") - F.col("first") + 1).alias("line_no"), "value")


def read_annotation_passages(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: passages under any of the accepted keys; lines without text or that are not JSON are dropped.

    The first non-blank alias wins; a missing id is made of paper and line number; a missing flag counts as synthesis.
    """
    keys = [k for ks in ALIASES.values() for k in ks]
    schema = ", ".join(f"`{k}` string" for k in keys) + ", doi string, source string, is_synthesis boolean, synthesis_score double, char_start int, char_end int, _bad string"
    lines = numbered_lines(spark, path)
    j = lines.withColumn("j", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).where("j IS NOT NULL AND j._bad IS NULL")
    first = {out: F.coalesce(*[F.when(F.col(f"j.{k}").rlike(r"(?U)\S"), F.col(f"j.{k}")) for k in ks], F.lit("")) for out, ks in ALIASES.items()}
    rows = j.select("line_no", *[c.alias(n) for n, c in first.items()], "j.doi", "j.source", F.coalesce("j.is_synthesis", F.lit(True)).alias("is_synthesis"), "j.synthesis_score", "j.char_start", "j.char_end")
    made = F.concat_ws(":", "paper_id", F.format_string("%05d", "line_no"))
    return rows.where("text <> ''").withColumn("passage_id", F.when(F.col("passage_id") != "", F.col("passage_id")).otherwise(made))


def choose_annotation_passages(spark: SparkSession, passages_path: str, papers_path: str) -> DataFrame:
    """SRC15: the passages file where it is usable, else passages made from the corpus."""
    from passagekg.operators.annotate import passages_from_papers

    if _exists(spark, passages_path):
        df = read_annotation_passages(spark, passages_path)
        if not df.isEmpty():
            return df
    return passages_from_papers(read_papers(spark, papers_path))


@lru_cache(maxsize=32)
def read_template(path: str) -> tuple[str, str, str]:
    """SRC14: (name, version, text) of a prompt file: leading '#' lines are its header; the version defaults to a hash."""
    head: dict[str, str] = {}
    lines = Path(path).read_text(encoding="utf-8").split("\n")
    n = 0
    while n < len(lines) and lines[n].startswith("#"):
        key, colon, value = lines[n].lstrip("#").partition(":")
        if colon:
            head[key.strip().lower()] = value.strip()
        n += 1
    body = "\n".join(lines[n:]).strip()
    if "{passage}" not in body:
        raise ValueError(f"{path}: template has no {{passage}} placeholder")
    version = head.get("version") or "sha256:" + hashlib.sha256(body.encode()).hexdigest()[:12]
    return head.get("name") or Path(path).stem, version, body


Page = tuple[list[dict], str | None]
HIT = "id string, source string, pmcid string, doi string, title string, license string"


def search(fetch_page: Callable[[str, int, str], Page], query: str, limit: int = 25) -> Iterator[dict]:
    """SRC1: hits of a cursor-paged search; ends on an empty page or a missing or repeated cursor."""
    seen, cursor, n = {None}, "*", 0
    while n < limit and cursor not in seen:
        seen.add(cursor)
        hits, cursor = fetch_page(query, min(100, limit - n), cursor)
        if not hits:
            return
        for h in hits[: limit - n]:
            n += 1
            yield h


class SearchSource(DataSource):
    """SRC1 as a Spark data source: ``spark.read.format("paper_search").option("query", ...).option("limit", ...)``.

    A cursor is sequential, so there is one partition. ``fetch_page`` is set on a subclass (no network here).
    """

    fetch_page: Callable[[str, int, str], Page] | None = None

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return HIT

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(type(self).fetch_page, self.options.get("query", ""), int(self.options.get("limit", "25")))


class _SearchReader(DataSourceReader):
    def __init__(self, fetch_page, query: str, limit: int):
        self.fetch_page, self.query, self.limit = fetch_page, query, limit

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        for h in search(self.fetch_page, self.query, self.limit):
            yield tuple(h.get(k) for k in ("id", "source", "pmcid", "doi", "title", "license"))


def fetched(hits: DataFrame, cache: DataFrame, fetch: Callable[[str], bytes | None]) -> tuple[DataFrame, DataFrame]:
    """SRC2: (pmcid, xml) of all hits and the new cache rows; an entry in the cache wins.

    Only bodies are cached: a failed or empty answer says nothing about the paper and is asked for again next time.
    """
    import pandas as pd

    from passagekg.runtime import stage_table

    known = cache.groupBy("pmcid").agg(F.max("xml").alias("xml"))
    missing = hits.select("pmcid").where("pmcid IS NOT NULL").distinct().join(known, "pmcid", "left_anti")

    def get(batches):
        for b in batches:
            got = [(p, body) for p in b["pmcid"] if (body := fetch(p))]
            yield pd.DataFrame(got, columns=["pmcid", "xml"])

    new = stage_table(missing.mapInPandas(get, "pmcid string, xml binary"), "fetched")
    both = known.unionByName(new)
    return hits.select("pmcid").distinct().join(both, "pmcid").where("length(xml) > 0"), new
