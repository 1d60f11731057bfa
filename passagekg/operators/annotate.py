"""Annotation as functions on tables (P12-P15, T5-T6, U8, A17, J8, SRC15, SNK4).

Samples are drawn by ordering on a seeded hash: reproducible from ids and seed alone, in parallel, and stable when
other rows are added. (``worklist_exact`` draws with the generator of the scripts this replaces, for lists that
must be identical to older ones; it needs the ids on the driver and is for annotation-sized pools, checked.)

Defined results: blank mentions and mentions not found have no span; sampling more than there is returns all; an
annotation of a known passage replaces it; extra columns of gold records are kept.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekg.functions.text import slug, strip

# Fixed values of the annotation protocol.
SEED, TARGET_MIN, TARGET_MAX, CONTROL = 2026, 80, 100, 0.1
STATUSES = ("annotated", "no_synthesis", "skipped")
SECTION_KEYWORDS = ("synthesis", "experimental", "materials and methods", "method", "preparation", "syntheses")
MIN_CHARS, MAX_CHARS = 200, 2500
SENTENCE = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9(\[])"
EXACT_BOUND = 1_000_000


def sentences(text: Column) -> Column:
    """Approximate sentences, stripped, none blank."""
    return F.filter(F.transform(F.split(strip(text), SENTENCE), strip), lambda s: s != "")


def chunks(paragraph: Column, limit: int = MAX_CHARS) -> Column:
    """Sentences packed greedily up to ``limit`` characters; a paragraph within it stays as it is."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def put(acc: Column, s: Column) -> Column:
        longer = F.when(acc["open"] == "", s).otherwise(F.concat(acc["open"], F.lit(" "), s))
        close = (acc["open"] != "") & (F.length(longer) > limit)
        return F.struct(F.when(close, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(close, s).otherwise(longer).alias("open"))

    packed = F.aggregate(sentences(paragraph), state, put, lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]))
    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(packed)


def find_span(text: Column, mention: Column) -> Column:
    """(start, end) of the first occurrence, case-insensitive, 0-based; null when blank or absent."""
    needle = F.lower(strip(mention))
    at = F.instr(F.lower(text), needle)
    return F.when((needle != "") & (at > 0), F.struct((at - 1).alias("start"), (at - 1 + F.length(needle)).alias("end")))


def sentence_containing(text: Column, mention: Column) -> Column:
    """The sentence around the mention's span; '' when not found, the whole text as fallback."""
    span = find_span(text, mention)
    state = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("hit"))

    def step(acc: Column, s: Column) -> Column:
        start = F.call_function("locate", s, text, acc["at"] + 1) - 1
        end = start + F.length(s)
        inside = (start >= 0) & (start <= span["start"]) & (span["start"] < end)
        return F.struct(F.when(start >= 0, end).otherwise(acc["at"]).alias("at"), F.coalesce(acc["hit"], F.when(inside, s)).alias("hit"))

    found = F.aggregate(sentences(text), state, step, lambda acc: acc["hit"])
    return F.when(span.isNull(), "").otherwise(F.coalesce(found, strip(text)))


def passages_from_papers(papers: DataFrame) -> DataFrame:
    """SRC15: annotation passages of the first synthesis-like section of each paper."""
    def named(s: Column) -> Column:
        name = F.lower(F.coalesce(s["name"], F.lit("")))
        return F.exists(F.array(*[F.lit(k) for k in SECTION_KEYWORDS]), lambda k: name.contains(k))

    section = F.try_element_at(F.filter("sections", named), F.lit(1))
    p = papers.select("paper_id", "title", "doi", section.alias("s")).where("s IS NOT NULL")
    paragraphs = F.filter(F.transform(F.split("s.text", "\n"), strip), lambda x: F.length(x) >= MIN_CHARS)
    cut = F.filter(F.flatten(F.transform(paragraphs, lambda x: chunks(x))), lambda x: F.length(x) >= MIN_CHARS)
    rows = p.select("paper_id", "title", "doi", F.col("s.name").alias("section"), F.posexplode(cut).alias("ix", "text"))
    pid = F.concat_ws(":", "paper_id", slug(F.col("section")), F.format_string("%03d", "ix"))
    return rows.select(pid.alias("passage_id"), "paper_id", "section", "text", "title", "doi", F.lit("corpus-fallback").alias("source"), F.lit(True).alias("is_synthesis"))


def draw(key: Column, seed: int) -> Column:
    """Order of a seeded draw."""
    return F.sha1(F.concat_ws(":", key, F.lit(seed)))


def sample(passages: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """T5: ``n`` passages by seeded hash order (a distributed top-n), in id order."""
    return passages.orderBy(draw(F.col("passage_id"), seed), "passage_id").limit(n).orderBy("passage_id")


def worklist(passages: DataFrame, n: int = TARGET_MAX, control: float = CONTROL, seed: int = SEED) -> DataFrame:
    """Mostly flagged passages with a share of unflagged controls, interleaved by hash; adds position."""
    one = passages.dropDuplicates(["passage_id"]).withColumn("is_synthesis", F.coalesce("is_synthesis", F.lit(True)))
    pool = one.where("NOT is_synthesis")
    n_control = min(pool.count(), round(n * control))
    picked = sample(one.where("is_synthesis"), n - n_control, seed).unionByName(sample(pool, n_control, seed + 1))
    order = Window.orderBy(draw(F.col("passage_id"), seed + 2), "passage_id")  # at most n rows
    return picked.withColumn("position", F.row_number().over(order))


def worklist_exact(passages: DataFrame, n: int = TARGET_MAX, control: float = CONTROL, seed: int = SEED) -> list[str]:
    """T5/T6 with the standard generator over sorted ids: identical to lists drawn before. Annotation-sized pools only."""
    ids = passages.select("passage_id", F.coalesce("is_synthesis", F.lit(True)).alias("f")).limit(EXACT_BOUND + 1).collect()
    if len(ids) > EXACT_BOUND:
        raise ValueError(f"pool beyond {EXACT_BOUND} passages: use worklist()")

    def pick(pool: list[str], k: int, s: int) -> list[str]:
        pool = sorted(pool)
        return pool if k >= len(pool) else [pool[i] for i in sorted(random.Random(s).sample(range(len(pool)), k))]

    flagged, rest = [r.passage_id for r in ids if r.f], [r.passage_id for r in ids if not r.f]
    n_control = min(len(rest), round(n * control))
    out = pick(flagged, n - n_control, seed) + pick(rest, n_control, seed + 1)
    random.Random(seed).shuffle(out)
    return out


def upsert(gold: DataFrame, changes: DataFrame) -> DataFrame:
    """U8: ``gold`` with ``changes`` replaced or appended by passage_id; columns only one side has are kept.

    Of several changes of a passage the last one counts: the latest ``annotated_at``, then the greatest ``line_no``, then the
    greatest row as JSON, as far as the columns exist (so the result is the same in every run).
    """
    kept = gold.join(changes.select("passage_id").distinct(), "passage_id", "left_anti")
    row = F.struct(*[F.col(c) for c in changes.columns])
    order = F.struct(*[F.col(c) for c in ("annotated_at", "line_no") if c in changes.columns], F.to_json(row))
    last = changes.groupBy(F.col("passage_id").alias("_p")).agg(F.max_by(row, order).alias("_r")).select("_r.*")
    return kept.unionByName(last, allowMissingColumns=True)


def check_change(status: str, n_triples: int) -> None:
    """U8: a change must state a known status, and triples only where something is annotated."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {STATUSES}")
    if status == "annotated" and n_triples == 0:
        raise ValueError("an annotated record needs at least one triple")
    if status != "annotated" and n_triples:
        raise ValueError(f"a {status} record has no triples")


def delete(gold: DataFrame, passage_ids: list[str]) -> DataFrame:
    return gold.where(~F.col("passage_id").isin(*passage_ids)) if passage_ids else gold


def pending(passages: DataFrame, gold: DataFrame) -> DataFrame:
    """Passages without a decision; skipped ones come back."""
    done = gold.where("status IS NULL OR status <> 'skipped'").select("passage_id").distinct()
    return passages.join(done, "passage_id", "left_anti")


def progress(gold: DataFrame) -> DataFrame:
    """Decisions and triples, and annotated records against the target, one row."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    size = F.coalesce(F.size("triples"), F.lit(0))
    g = gold.agg(F.count("*").alias("reviewed"), *[n(s).alias(s) for s in STATUSES], F.coalesce(F.sum(F.greatest(size, F.lit(0))), F.lit(0)).alias("triples"))
    done = F.col("annotated")
    return g.select(
        "reviewed", *STATUSES, "triples", F.greatest(F.lit(0), F.lit(TARGET_MIN) - done).cast("bigint").alias("remaining"), F.round(F.least(F.lit(1.0), done / TARGET_MIN), 4).alias("fraction"),
        (done >= TARGET_MIN).alias("complete"),
    )
