"""Queries of the llm problems, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagekg.llm import canonical, entity_match, mixing, packing, sameness, split, stuffing
from passagekg.runtime import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.found_ids(*(table(spark, sf_dir, n) for n in ("results", "gold", "canon_entities", "metal_symbols")))


def p2_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = canonical.name_rows(table(spark, sf_dir, "results"), table(spark, sf_dir, "gold"))
    return canonical.misses(canonical.mapped(rows, table(spark, sf_dir, "canon_entities"), table(spark, sf_dir, "metal_symbols")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sameness.found_pairs(table(spark, sf_dir, "passages"), table(spark, sf_dir, "results"))


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sameness.canonical_forms(table(spark, sf_dir, "passages"), table(spark, sf_dir, "results"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.oversized(table(spark, sf_dir, "papers"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.section_pieces(table(spark, sf_dir, "papers"))


def p3_stored_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stored_pieces(table(spark, sf_dir, "papers"))


def p3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.coverage(p3_stored_pieces(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.flagged(table(spark, sf_dir, "documents"))


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.scores(table(spark, sf_dir, "documents"))


def _p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.matches(*(table(spark, sf_dir, n) for n in ("gold", "digimof_synmof_merged", "canon_entities", "metal_symbols")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p4_matches(spark, sf_dir).select("passage_id", "refcode")


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity_match.one_to_one(_p4_matches(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def p7_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summary(p7_containers(spark, sf_dir))


def p7_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.placed(p7_containers(spark, sf_dir))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p8_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_kept_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.kept_to(p8_mixture(spark, sf_dir), table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


QUERIES = {
    "p2_found": p2_found,
    "p2_misses": p2_misses,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_stored_pieces": p3_stored_pieces,
    "p3_coverage": p3_coverage,
    "p4_found": p4_found,
    "p4_matches": p4_matches,
    "p6_found": p6_found,
    "p6_canonical": p6_canonical,
    "p7_containers": p7_containers,
    "p7_summary": p7_summary,
    "p7_placed": p7_placed,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p8_kept_to": p8_kept_to,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}

_SPACE = "\\t\\n\\v\\f\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"



def _same_look(x: str) -> str:
    """The look-alike map as SQL: one-to-one by translate() (which also deletes), the few longer forms by replace()."""
    from passagekg.functions.lookalike import lookalikes

    table = lookalikes()
    single = {k: v for k, v in table.items() if len(v) == 1}
    gone = [k for k, v in table.items() if not v]
    longer = {k: v for k, v in table.items() if len(v) > 1 and (0x2100 <= k < 0x2190 or 0xFB00 <= k <= 0xFB06 or k == 0x2026)}
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    for k, v in longer.items():
        x = f"replace({x}, {quote(chr(k))}, {quote(v)})"
    source, target = "".join(map(chr, [*single, *gone])), "".join(single.values())
    return f"nfc_normalize(translate({x}, {quote(source)}, {quote(target)}))"


_PARAGRAPHS = f"""secs AS (SELECT paper_id, i AS section_ix, sections[i + 1].text AS text FROM (SELECT paper_id, sections, unnest(range(CAST(len(sections) AS BIGINT))) AS i FROM papers)),
runs AS (SELECT paper_id, section_ix, string_split(text, chr(10)) AS parts FROM secs WHERE text IS NOT NULL),
placed AS (SELECT paper_id, section_ix, parts[k] AS run, list_sum(list_transform(parts[:k - 1], lambda x: length(x) + 1)) AS before FROM (SELECT *, unnest(range(1, CAST(len(parts) AS BIGINT) + 1)) AS k FROM runs)),
trimmed AS (SELECT *, length(run) - length(regexp_replace(run, '^[{_SPACE}]+', '')) AS lead, regexp_replace(regexp_replace(run, '^[{_SPACE}]+', ''), '[{_SPACE}]+$', '') AS body FROM placed),
paragraphs AS (SELECT paper_id, CAST(section_ix AS INTEGER) AS section_ix, CAST(coalesce(before, 0) + lead AS INTEGER) AS para_start, body FROM trimmed WHERE length(body) > 2500)"""

ORACLES: dict[str, str] = {
    "p6_found": f"""
WITH texts AS (SELECT DISTINCT passage_id AS k, text AS v FROM passages WHERE regexp_matches(text, '[^{_SPACE}]')),
looks AS (SELECT k, v, {_same_look('v')} AS look FROM texts),
ends AS (SELECT line_no, i, triples[i + 1] AS t FROM (SELECT line_no, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM results)),
names AS (
    SELECT line_no, line_no || ':' || CASE WHEN i < 10 THEN '0' ELSE '' END || i || ':s' AS k, t.subject.name AS v FROM ends
    UNION ALL SELECT line_no, line_no || ':' || CASE WHEN i < 10 THEN '0' ELSE '' END || i || ':o', t.object.name FROM ends),
name_looks AS (SELECT line_no, k, v, {_same_look('v')} AS look FROM names WHERE regexp_matches(v, '[^{_SPACE}]'))
SELECT DISTINCT 'text' AS field, a.k AS key_a, b.k AS key_b FROM looks a JOIN looks b ON a.look = b.look AND a.v <> b.v AND a.k < b.k
UNION ALL SELECT DISTINCT 'name', a.k, b.k FROM name_looks a JOIN name_looks b ON a.line_no = b.line_no AND a.look = b.look AND a.v <> b.v AND a.k < b.k
""",
    "p6_canonical": f"""
WITH raw_ AS (
    SELECT 'text' AS field, passage_id AS key, text AS value FROM passages
    UNION ALL SELECT 'name', line_no || ':' || CASE WHEN i < 10 THEN '0' ELSE '' END || i || ':s', t.subject.name FROM (SELECT line_no, i, triples[i + 1] AS t FROM (SELECT line_no, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM results)) WHERE t.subject.name IS NOT NULL
    UNION ALL SELECT 'name', line_no || ':' || CASE WHEN i < 10 THEN '0' ELSE '' END || i || ':o', t.object.name FROM (SELECT line_no, i, triples[i + 1] AS t FROM (SELECT line_no, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM results)) WHERE t.object.name IS NOT NULL)
SELECT field, key, value, CASE WHEN regexp_matches(value, '[^{_SPACE}]') THEN min(value) OVER (PARTITION BY field, {_same_look('value')}) ELSE value END AS canonical FROM raw_
""",
    "p7_placed": "SELECT doc_id, true AS whole, true AS fits FROM documents WHERE length(text) > 0",
    "p8_kept_to": "SELECT source, target_share, max_repeats, true AS near, true AS capped FROM mix_targets WHERE source IS NOT NULL",
    "p3_found": f"""
WITH {_PARAGRAPHS}
SELECT DISTINCT paper_id, section_ix, para_start FROM paragraphs
""",
    "p3_coverage": f"""
WITH {_PARAGRAPHS}
SELECT DISTINCT paper_id, section_ix, para_start, CAST(para_start + length(body) AS INTEGER) AS para_end, true AS fits, true AS overlaps, md5(body) AS paragraph FROM paragraphs
""",
}
