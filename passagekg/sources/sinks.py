"""Sinks (SNK1-SNK4, SNK7). Parquet unless the consumer needs JSON lines or CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_papers(papers: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK1: replace the corpus."""
    papers.write.mode("overwrite").format(fmt).save(path)


def write_passages(passages: DataFrame, path: str, synthesis_only: bool = False, fmt: str = "parquet") -> tuple[int, int]:
    """SNK2: write passages; returns (all, written), counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    flagged = F.coalesce("is_synthesis", F.lit(False))
    observed = passages.observe(seen, F.count("*").alias("n_all"), F.count(F.when(flagged, 1)).alias("n_flagged"))
    (observed.where(flagged) if synthesis_only else observed).write.mode("overwrite").format(fmt).save(path)
    got = seen.get
    return got["n_all"], got["n_flagged"] if synthesis_only else got["n_all"]


def append_results(rows: DataFrame, path: str, resume: bool = True, fmt: str = "parquet") -> None:
    """SNK3: append when resuming, else start over. Commit is per job, so a lost executor leaves no half rows."""
    rows.write.mode("append" if resume else "overwrite").format(fmt).save(path)


def replace_atomically(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK4: write beside the target, then swap by rename; ``df`` may have been read from the target."""
    spark = df.sparkSession
    staged, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").format(fmt).save(staged)
    jpath = spark._jvm.org.apache.hadoop.fs.Path
    fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jpath(path)):
        fs.rename(jpath(path), jpath(old))
    if not fs.rename(jpath(staged), jpath(path)):
        fs.rename(jpath(old), jpath(path))
        raise OSError(f"could not replace {path}")
    fs.delete(jpath(old), True)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SNK7: small report tables as one JSON or CSV file."""
    out = df.coalesce(1).write.mode("overwrite")
    (out.option("header", True).csv if fmt == "csv" else out.json)(path)
