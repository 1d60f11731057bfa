"""Resumable runs of extractors over passages (U1, U2, J1, SRC5, SRC6, SNK3).

Defined results: a pair (passage_id, extractor) already in the results is not run again, also when it ended in errors
(unless ``retry_errors``); passages listed twice in one run are run twice, as each row is its own call, unless
``distinct``; an extractor that breaks its contract gives an error row for the passage.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekg.operators import extract


class Extractor(Protocol):
    """A name and a transform from passages to result rows; it must not raise on any passage."""

    name: str

    def __call__(self, passages: DataFrame) -> DataFrame: ...


class RuleExtractor:
    name = extract.NAME

    def __call__(self, passages: DataFrame) -> DataFrame:
        return extract.extract_passages(passages)


class RowExtractor:
    """Wraps a row function (text, paper_id, section) -> (triples, errors); whatever it raises becomes an error row."""

    def __init__(self, name: str, function: Callable[[str, str | None, str | None], tuple[list[dict], list[str]]]):
        self.name, self.function = name, function

    def __call__(self, passages: DataFrame) -> DataFrame:
        import pandas as pd

        name, function = self.name, self.function

        def work(batches):
            for b in batches:
                rows = []
                for pid, paper, section, text in zip(b["passage_id"], b["paper_id"], b["section_name"], b["text"], strict=True):
                    began = time.perf_counter()
                    try:
                        found, errors = function(text, paper, section)
                    except Exception as e:
                        found, errors = [], [f"CONTRACT VIOLATION {type(e).__name__}: {e}"]
                    rows.append((pid, paper, section, name, found, len(found), 0.0, (time.perf_counter() - began) * 1000, errors))
                yield pd.DataFrame(rows, columns=["passage_id", "paper_id", "section_name", "extractor", "triples", "n_triples", "cost_usd", "latency_ms", "errors"])

        return passages.select("passage_id", "paper_id", "section_name", "text").mapInPandas(work, extract.RESULT)


def extractor_of(spec: str, make_model: Callable[[str, str, str], Extractor] | None = None) -> Extractor:
    """rule_based or rule, or provider:model:strategy built by ``make_model``."""
    if spec in ("rule", "rule_based"):
        return RuleExtractor()
    parts = spec.split(":")
    if len(parts) == 3 and all(p.strip() for p in parts):
        if make_model is None:
            raise ValueError(f"{spec}: no model factory given")
        return make_model(*parts)
    raise ValueError(f"unknown extractor {spec!r}: expected rule_based or provider:model:strategy")


def runner_passages(passages: DataFrame, synthesis_only: bool = True) -> DataFrame:
    """SRC5: what a run reads; a missing flag counts as not synthesis here."""
    return passages.where(F.coalesce("is_synthesis", F.lit(False))) if synthesis_only else passages


def done(results: DataFrame, retry_errors: bool = False) -> DataFrame:
    """SRC6: distinct (passage_id, extractor) already run; rows without keys are ignored."""
    rows = results.where("passage_id IS NOT NULL AND extractor IS NOT NULL")
    if retry_errors:
        rows = rows.where(F.coalesce(F.size("errors"), F.lit(0)) <= 0)
    return rows.select("passage_id", "extractor").distinct()


def open_calls(passages: DataFrame, extractors: list[str], results: DataFrame, retry_errors: bool = False) -> DataFrame:
    """Passages x extractors without the pairs done. The extractors are a short list: an array, not a cross join."""
    every = passages.withColumn("extractor", F.explode(F.array(*[F.lit(e) for e in extractors])))
    return every.join(done(results, retry_errors), ["passage_id", "extractor"], "left_anti")


def run(passages: DataFrame, extractors: list[Extractor], results: DataFrame | None = None, retry_errors: bool = False, distinct: bool = False, stamp: str | None = None) -> DataFrame:
    """New result rows of all extractors; append them to the results to resume later."""
    out = None
    for e in extractors:
        todo = passages if results is None else open_calls(passages, [e.name], results, retry_errors).drop("extractor")
        if distinct:
            todo = todo.dropDuplicates(["passage_id"])
        rows = e(todo)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no extractor given")
    return out.withColumn("run_at", F.lit(stamp) if stamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))


def cumulative_spend(results: DataFrame) -> DataFrame:
    """Running spend per extractor in run order.

    A prefix sum in two levels: rows are range-partitioned in run order, summed inside each partition, and the
    partitions' totals (one row per partition and extractor) give the offsets. No extractor is in one task.
    """
    from pyspark.sql import Window

    from passagekg.runtime import stage_table

    rows = results.select("line_no", "extractor", "run_at", F.coalesce("cost_usd", F.lit(0.0)).alias("cost"))
    placed = stage_table(rows.repartitionByRange("extractor", "run_at", "line_no").withColumn("part", F.spark_partition_id()), "spend")
    inside = Window.partitionBy("part", "extractor").orderBy("run_at", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("extractor").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part", "extractor").agg(F.sum("cost").alias("cost"))
    offsets = totals.select(F.col("part").alias("p"), F.col("extractor").alias("e"), F.coalesce(F.sum("cost").over(before), F.lit(0.0)).alias("before"))
    summed = placed.withColumn("spent", F.sum("cost").over(inside))
    joined = summed.join(offsets, (F.col("part") == F.col("p")) & F.col("extractor").eqNullSafe(F.col("e")))
    return joined.select("line_no", "extractor", F.round(F.col("spent") + F.col("before"), 6).alias("spent"))
