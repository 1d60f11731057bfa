"""Scoring predicted triples against gold (F7-F10, A1-A5, A7, A21, J3) and operations.

All extractors are scored in one job. Triples are keyed once (``functions.text.with_key``), grouped by
(extractor, passage, section, relation) null-safely, and matched one to one inside each group:

* exact mode is closed form: names either equal or not, so equal keys match least(n_pred, n_gold) times;
* relaxed mode orders the candidate pairs of a group by (-score, gold, prediction) and takes greedily. Pairs that
  agree exactly are few; groups are one passage and relation, i.e. a dozen triples.

Every row counts: the same triple stated twice is two predictions of which one can match. A group is one
passage's claims of one relation; repeated runs of a passage add to it, so callers deduplicate runs first
(``latest_runs``) where a passage may hold a large share of all rows.

Defined results: null names have the empty key, which equals nothing; null relations are skipped and counted as
such; zero denominators give 0.0; an empty side gives only false positives or negatives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagekg.functions import text as tx

SCORED = ("USES_PRECURSOR", "USES_LINKER", "SYNTHESIZED_BY", "IN_SOLVENT", "AT_CONDITION", "HAS_PROPERTY", "MEASURED_AT", "USED_IN")
SUBJECT_AGNOSTIC = ("IN_SOLVENT", "AT_CONDITION")
THRESHOLD = 0.6
GROUP = ["source_paper_id", "source_section", "relation"]


def keyed(triples: DataFrame) -> DataFrame:
    """Adds s_key and o_key, the identity of both endpoints."""
    return tx.with_key(tx.with_key(triples, "subject_type", "subject_name", "s_key"), "object_type", "object_name", "o_key")


def _last(df: DataFrame, keys: list[str], stamp: str) -> DataFrame:
    """The last row per key by (stamp, line_no), whatever columns the caller goes on to read.

    Which rows are last is found over keys, stamp and line_no alone, by an aggregation that reduces copies of a hot key before
    the shuffle; the rows are then kept by their unique line_no, so a scan reads only the columns and nested fields used later.
    """
    held = [F.col(k).alias(f"_{k}") for k in keys]
    last = df.groupBy(*held).agg(F.max(F.struct(F.col(stamp), F.col("line_no"))).alias("_l")).select(F.col("_l.line_no").alias("line_no"))
    return df.join(last, "line_no", "left_semi")


def latest_runs(results: DataFrame) -> DataFrame:
    """One row per (passage_id, extractor): the last run_at, then the last line_no; no date is earliest."""
    return _last(results, ["passage_id", "extractor"], "run_at")


def latest_gold(gold: DataFrame) -> DataFrame:
    """One gold record per passage: the last annotated_at, then the last line_no."""
    return _last(gold, ["passage_id"], "annotated_at")


def _match_key(agnostic: tuple[str, ...]) -> Column:
    """What must agree exactly; null for a triple that can match nothing."""
    free = F.col("relation").isin(*agnostic)
    named = (F.col("o_key") != "") & (free | (F.col("s_key") != "")) & F.col("object_type").isNotNull() & (free | F.col("subject_type").isNotNull())
    subject = F.when(free, F.lit("")).otherwise(F.concat_ws("\u0001", "subject_type", "s_key"))
    return F.when(named, F.concat_ws("\u0002", subject, "object_type", "o_key"))


def counts_exact(predicted: DataFrame, gold: DataFrame, agnostic: tuple[str, ...] = SUBJECT_AGNOSTIC, relations: tuple[str, ...] = SCORED) -> DataFrame:
    """A1: (extractor, relation, tp, fp, fn) with exact matching, for all extractors at once.

    Two aggregations with map-side combine and one join of aggregated keys. Gold is not copied per extractor: what
    an extractor misses is its gold total minus its matches.
    """
    # concat of null-safe parts: one plain equi key, so the join is a hash or merge join
    gk = F.sha2(F.to_json(F.struct(*GROUP), {"ignoreNullFields": "false"}), 256).alias("gk")
    side = lambda df: keyed(df.where(F.col("relation").isin(*relations))).withColumn("mk", _match_key(agnostic))
    # everything below comes from these two aggregates, so their exchanges are planned once and reused
    pc = side(predicted).groupBy("extractor", "relation", gk, "mk").agg(F.count("*").alias("n_pred"))
    gc = side(gold).groupBy("relation", gk, "mk").agg(F.count("*").alias("n_gold"))
    tp = pc.join(gc.drop("relation"), ["gk", "mk"]).groupBy("extractor", "relation").agg(F.sum(F.least("n_pred", "n_gold")).alias("tp"))
    n_pred = pc.groupBy("extractor", "relation").agg(F.sum("n_pred").alias("n_pred"))
    n_gold = gc.groupBy("relation").agg(F.sum("n_gold").alias("n_gold"))
    cells = n_pred.select("extractor").distinct().crossJoin(n_gold.select("relation").union(n_pred.select("relation")).distinct())  # extractors x relations, both tiny
    j = cells.join(n_pred, ["extractor", "relation"], "left").join(tp, ["extractor", "relation"], "left").join(n_gold, "relation", "left").na.fill(0)
    return j.select("extractor", "relation", F.col("tp").cast("bigint").alias("tp"), (F.col("n_pred") - F.col("tp")).cast("bigint").alias("fp"), (F.col("n_gold") - F.col("tp")).cast("bigint").alias("fn"))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """A2: zero denominators are 0.0."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    return p, r, f


def scores(counts: DataFrame) -> DataFrame:
    """A2: per field, with support."""
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return counts.select("*", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def micro(counts: DataFrame) -> DataFrame:
    """Counts summed over fields, per extractor, with the number of triples emitted."""
    s = counts.groupBy("extractor").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    return s.select("extractor", (F.col("tp") + F.col("fp")).alias("n_predicted"), "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f, 6).alias("f1"))


def macro(counts: DataFrame) -> DataFrame:
    """A4: unweighted mean over fields with support, and which they were."""
    p, r, f = precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn"))
    has = F.col("tp") + F.col("fn") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(has, c)), F.lit(0.0)), 6)
    return counts.groupBy("extractor").agg(
        mean(p).alias("macro_precision"), mean(r).alias("macro_recall"), mean(f).alias("macro_f1"), F.array_join(F.array_sort(F.collect_set(F.when(has, F.col("relation")))), ",").alias("macro_fields")
    )


def skipped_relations(predicted: DataFrame, gold: DataFrame, relations: tuple[str, ...] = SCORED) -> DataFrame:
    """A5: triples of both sides whose relation is not scored, counted by relation."""
    both = predicted.select("relation").unionByName(gold.select("relation"))
    return both.where(F.col("relation").isNull() | ~F.col("relation").isin(*relations)).groupBy("relation").agg(F.count("*").alias("n"))


def n_passages(predicted: DataFrame, gold: DataFrame, relations: tuple[str, ...] = SCORED) -> DataFrame:
    """A5: distinct (paper, section) keys of scored triples on either side; null keys count."""
    both = predicted.select(*GROUP).unionByName(gold.select(*GROUP)).where(F.col("relation").isin(*relations))
    return both.select("source_paper_id", "source_section").distinct().agg(F.count("*").alias("n_passages"))


def _prepared(triples: DataFrame, side: str) -> DataFrame:
    k = keyed(triples)
    for c in ("s", "o"):
        k = k.withColumn(f"{c}_tokens", tx.tokens(F.col(f"{c}_key"))).withColumn(f"{c}_numbers", tx.numbers(F.col(f"{c}_key")))
    gk = F.sha2(F.to_json(F.struct(*GROUP), {"ignoreNullFields": "false"}), 256)
    cols = ["subject_type", "object_type", "s_key", "o_key", "s_tokens", "o_tokens", "s_numbers", "o_numbers"]
    return k.select(gk.alias("gk"), "relation", _id().alias(f"{side}_id"), *[F.col(c).alias(f"{side}_{c}") for c in cols], *(["extractor"] if side == "p" else []))


def candidates(predicted: DataFrame, gold: DataFrame, mode: str = "relaxed", threshold: float = THRESHOLD, agnostic: tuple[str, ...] = SUBJECT_AGNOSTIC) -> DataFrame:
    """(extractor, gk, relation, p_id, g_id, score) of similar pairs inside a group: equi join, then similarity."""
    j = _prepared(predicted, "p").join(_prepared(gold, "g").drop("relation"), "gk")

    def alike(side: str, kind: str) -> Column:
        c = lambda who, what: F.col(f"{who}_{side}_{what}")
        s = tx.name_similarity(c("p", "key"), c("g", "key"), c("p", "tokens"), c("g", "tokens"), c("p", "numbers"), c("g", "numbers"), mode, threshold)
        return F.when(F.col(f"p_{kind}") == F.col(f"g_{kind}"), s).otherwise(0.0)

    s, o = alike("s", "subject_type"), alike("o", "object_type")
    score = F.when(F.col("relation").isin(*agnostic), o).when((s > 0) & (o > 0), (s + o) / 2).otherwise(0.0)
    return j.withColumn("score", score).where("score > 0").select("extractor", "gk", "relation", "p_id", "g_id", "score")


def greedy(pairs: DataFrame) -> DataFrame:
    """One-to-one matches of each (extractor, group): best score first, ties by gold then prediction.

    A fold over the group's sorted candidate pairs; a group is one passage and relation of one extractor.
    """
    listed = pairs.groupBy("extractor", "gk", "relation").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "g_id", "p_id"))).alias("c"))
    empty = F.array().cast("array<struct<neg:double,g_id:string,p_id:string>>")
    taken = F.aggregate("c", empty, lambda acc, x: F.when(F.exists(acc, lambda t: (t["g_id"] == x["g_id"]) | (t["p_id"] == x["p_id"])), acc).otherwise(F.array_append(acc, x)))
    return listed.select("extractor", "gk", "relation", F.explode(taken).alias("m")).select("extractor", "gk", "relation", "m.p_id", "m.g_id", (-F.col("m.neg")).alias("score"))


def counts_relaxed(predicted: DataFrame, gold: DataFrame, threshold: float = THRESHOLD, agnostic: tuple[str, ...] = SUBJECT_AGNOSTIC, relations: tuple[str, ...] = SCORED) -> DataFrame:
    """A1 in relaxed mode."""
    p, g = predicted.where(F.col("relation").isin(*relations)), gold.where(F.col("relation").isin(*relations))
    tp = greedy(candidates(p, g, "relaxed", threshold, agnostic)).groupBy("extractor", "relation").agg(F.count("*").alias("tp"))
    n_pred = p.groupBy("extractor", "relation").agg(F.count("*").alias("n_pred"))
    n_gold = g.groupBy("relation").agg(F.count("*").alias("n_gold"))
    cells = p.select("extractor").distinct().crossJoin(n_gold.select("relation").union(p.select("relation")).distinct())  # extractors x relations, both tiny
    j = cells.join(n_pred, ["extractor", "relation"], "left").join(tp, ["extractor", "relation"], "left").join(n_gold, "relation", "left").na.fill(0)
    return j.select("extractor", "relation", F.col("tp").cast("bigint").alias("tp"), (F.col("n_pred") - F.col("tp")).cast("bigint").alias("fp"), (F.col("n_gold") - F.col("tp")).cast("bigint").alias("fn"))


def _id() -> Column:
    """Order of a triple as text; 19 digits hold every line_no."""
    return F.format_string("%019d:%010d", "line_no", "triple_ix")


def false_positives(predicted: DataFrame, matches: DataFrame, relations: tuple[str, ...] = SCORED) -> DataFrame:
    """Scored predictions that no match (of ``greedy``) uses."""
    return predicted.where(F.col("relation").isin(*relations)).withColumn("p_id", _id()).join(matches.select("p_id"), "p_id", "left_anti").drop("p_id")


def false_negatives(gold: DataFrame, matches: DataFrame, extractors: list[str], relations: tuple[str, ...] = SCORED) -> DataFrame:
    """Scored gold triples that an extractor (a short list) has no match for, one row per extractor."""
    each = gold.where(F.col("relation").isin(*relations)).drop("extractor").withColumn("extractor", F.explode(F.array(*[F.lit(e) for e in extractors])))
    return each.withColumn("g_id", _id()).join(matches.select("extractor", "g_id"), ["extractor", "g_id"], "left_anti").drop("g_id")


def examples(rows: DataFrame, n: int = 20, by: tuple[str, ...] = ("extractor", "relation")) -> DataFrame:
    """The first ``n`` rows per group for a report; the lists themselves are never cut."""
    order = Window.partitionBy(*by).orderBy("line_no", "triple_ix")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def value_mismatches(predicted: DataFrame, gold: DataFrame, relations: tuple[str, ...] = SCORED) -> DataFrame:
    """(extractor, relation, n) of unmatched pairs with the same subject: a wrong value for a fact that exists.

    Exact names; the subject concession does not apply here. Per (group, subject) the least of both leftovers.
    """
    gk = F.sha2(F.to_json(F.struct(*GROUP), {"ignoreNullFields": "false"}), 256)
    subject = F.when(F.col("s_key") != "", F.concat_ws("\u0001", "subject_type", "s_key"))

    def side(df: DataFrame, *extra: str) -> DataFrame:
        k = keyed(df.where(F.col("relation").isin(*relations))).withColumn("mk", _match_key(SUBJECT_AGNOSTIC))
        k = k.select(*extra, "relation", gk.alias("gk"), "mk", subject.alias("sk"), "line_no", "triple_ix")
        # of equal triples the first ones are matched, on both sides
        return k.withColumn("rn", F.row_number().over(Window.partitionBy(*extra, "gk", "mk").orderBy("line_no", "triple_ix")))

    p, g = side(predicted, "extractor"), side(gold)
    n_gold = g.where("mk IS NOT NULL").groupBy("gk", "mk").agg(F.count("*").alias("n"))
    n_pred = p.where("mk IS NOT NULL").groupBy("extractor", "gk", "mk").agg(F.count("*").alias("n"))
    over = (F.col("mk").isNull()) | (F.col("rn") > F.coalesce("n", F.lit(0)))
    fp = p.join(n_gold, ["gk", "mk"], "left").where(over & F.col("sk").isNotNull()).groupBy("extractor", "relation", "gk", "sk").agg(F.count("*").alias("fp"))
    used = g.join(n_pred, ["gk", "mk"]).where("rn <= n AND sk IS NOT NULL").groupBy("extractor", "gk", "sk").agg(F.count("*").alias("used"))
    stated = g.where("sk IS NOT NULL").groupBy("gk", "sk").agg(F.count("*").alias("n_gold"))
    pair = fp.join(stated, ["gk", "sk"]).join(used, ["extractor", "gk", "sk"], "left")
    m = F.least(F.col("fp"), F.col("n_gold") - F.coalesce("used", F.lit(0)))
    return pair.withColumn("m", m).where("m > 0").groupBy("extractor", "relation").agg(F.sum("m").alias("n"))


def run_summary(results: DataFrame) -> DataFrame:
    """Per extractor passages, triples, cost, latency and rows with errors."""
    return results.groupBy("extractor").agg(
        F.count("*").alias("n_passages"), F.sum("n_triples").alias("n_triples"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.avg("n_triples"), 2).alias("mean_triples"),
        F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"), F.sum((F.coalesce(F.size("errors"), F.lit(0)) > 0).cast("int")).alias("n_with_errors"),
    )


def operations(results: DataFrame) -> DataFrame:
    """Calls, cost, latency and failed calls per extractor."""
    failed = F.coalesce(F.exists("errors", lambda e: e.contains("client call failed")), F.lit(False))
    return results.groupBy("extractor").agg(
        F.count("*").alias("calls"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.round(F.avg("latency_ms"), 1).alias("mean_latency_ms"), F.sum(failed.cast("int")).alias("failed_calls")
    )


def with_operations(totals: DataFrame, results: DataFrame) -> DataFrame:
    """``totals`` (one row per extractor, as of :func:`micro`) with calls, cost, latency and failed calls of its runs."""
    ops = operations(results).withColumnRenamed("extractor", "_e")
    return totals.join(ops, F.col("extractor").eqNullSafe(F.col("_e")), "left").drop("_e")
