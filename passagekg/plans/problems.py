"""Queries of the general problems (1: flat tables, 5: units), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekg.operators import flatten, units
from passagekg.runtime import stage_table, table


def _emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.emit_all(*(table(spark, sf_dir, n) for n in ("results", "gold", "raw_lines")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flatten.endpoints(_emission(spark, sf_dir))


def _p1_table(tag: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return flatten.read_flat(spark, flatten.write_tagged(_emission(spark, sf_dir)), tag)

    query.__name__ = f"p1_{tag}_table"
    return query


def p1_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every child table by source, and how many of them have a parent key that is in no row of the level above (must be 0)."""
    path = flatten.write_tagged(_emission(spark, sf_dir))
    out = None
    for child, parent in (("triple", "record"), ("error", "record"), ("entity", "triple")):
        c, p = (flatten.read_flat(spark, path, t) for t in (child, parent))
        held = c.select("src", "parent_key").join(p.select(F.col("key").alias("parent_key"), F.lit(1).alias("held")), "parent_key", "left")
        rows = held.groupBy("src").agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("held").isNull(), 1)).alias("n_orphans")).select(F.lit(child).alias("tag"), "src", "n_rows", "n_orphans")
        out = rows if out is None else out.unionByName(rows)
    return out


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.converted(table(spark, sf_dir, "results"), table(spark, sf_dir, "gold"))


def _measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.measurements(units.quantity_names(table(spark, sf_dir, "results"), table(spark, sf_dir, "gold")))


def p5_unit_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unit_aliases(stage_table(_measures(spark, sf_dir), "measures"))


def p5_unknown_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.unknown_units(stage_table(_measures(spark, sf_dir), "measures"))


QUERIES = {
    "p1_found": p1_found,
    "p1_records": _p1_table("record"),
    "p1_triples": _p1_table("triple"),
    "p1_entities": _p1_table("entity"),
    "p1_errors": _p1_table("error"),
    "p1_fields": _p1_table("field"),
    "p1_orphans": p1_orphans,
    "p5_found": p5_found,
    "p5_unit_aliases": p5_unit_aliases,
    "p5_unknown_units": p5_unknown_units,
}

# Raw lines in SQL: ``el`` is the object that states a relation, ``g`` the group it stands in (else null), ``ix`` its position.
_RAW_SQL = """
lines AS (SELECT line_no, CAST(payload AS JSON) AS rec FROM raw_lines WHERE json_valid(payload) AND json_type(CAST(payload AS JSON)) = 'OBJECT'),
opened AS (SELECT line_no, CASE WHEN json_type(rec -> 'triples') = 'VARCHAR' THEN CASE WHEN json_valid(rec ->> 'triples') THEN CAST(rec ->> 'triples' AS JSON) END ELSE rec -> 'triples' END AS t FROM lines),
listed AS (SELECT line_no, CASE json_type(t) WHEN 'ARRAY' THEN t
    WHEN 'OBJECT' THEN CASE WHEN json_type(t -> 'items') = 'ARRAY' THEN t -> 'items' WHEN len(json_keys(t)) = 0 THEN '[]' ELSE json_array(t) END END AS t FROM opened),
numbered AS (SELECT line_no, unnest(range(CAST(json_array_length(t) AS BIGINT))) AS i, t FROM listed WHERE t IS NOT NULL),
items AS (SELECT line_no, i, t -> CAST('$[' || i || ']' AS VARCHAR) AS el FROM numbered),
grouped AS (SELECT line_no, i, el, CASE WHEN json_type(el -> 'relations') = 'ARRAY' THEN el -> 'relations' END AS rels FROM items),
stated AS (
    SELECT line_no, i, -1 AS k, el, CAST(NULL AS JSON) AS g FROM grouped WHERE rels IS NULL
    UNION ALL
    SELECT line_no, i, k, rels -> CAST('$[' || k || ']' AS VARCHAR), el FROM (SELECT line_no, i, el, rels, unnest(range(CAST(json_array_length(rels) AS BIGINT))) AS k FROM grouped WHERE rels IS NOT NULL)),
placed AS (SELECT line_no, row_number() OVER (PARTITION BY line_no ORDER BY i, k) - 1 AS ix, el, g FROM stated),
ranked AS (SELECT * FROM placed WHERE json_type(el) = 'OBJECT'),
sides AS (
    SELECT line_no, ix, 'subject' AS role, 0 AS n, coalesce(el -> 'subject', g -> 'subject') AS e, coalesce(el -> 'subject_type', g -> 'subject_type') AS ft, coalesce(el -> 'subject_name', g -> 'subject_name') AS fn,
        coalesce(el -> 'subject_span', g -> 'subject_span') AS fs FROM ranked
    UNION ALL SELECT line_no, ix, 'object', 1, el -> 'object', el -> 'object_type', el -> 'object_name', el -> 'object_span' FROM ranked),
ends AS (
    SELECT line_no, ix, role, n, e,
        CASE json_type(e) WHEN 'OBJECT' THEN e -> 'type' WHEN 'VARCHAR' THEN NULL ELSE ft END AS t, CASE json_type(e) WHEN 'OBJECT' THEN e -> 'name' WHEN 'VARCHAR' THEN e ELSE fn END AS m,
        CASE json_type(e) WHEN 'OBJECT' THEN e -> 'span' WHEN 'VARCHAR' THEN NULL ELSE fs END AS s
    FROM sides),
stated_ends AS (SELECT line_no, ix, role, n, e, t ->> '$' AS type, CASE WHEN json_type(m) = 'VARCHAR' THEN m ->> '$' END AS name, TRY_CAST(s ->> '$[0]' AS INTEGER) AS span_start, TRY_CAST(s ->> '$[1]' AS INTEGER) AS span_end
    FROM ends WHERE json_type(e) IN ('OBJECT', 'VARCHAR') OR (t ->> '$') IS NOT NULL OR (m ->> '$') IS NOT NULL OR (s ->> '$') IS NOT NULL),
typed AS (SELECT 'results' AS src, line_no, i AS ix, triples[i + 1] AS t FROM (SELECT line_no, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM results)),
flat AS (SELECT 'gold' AS src, line_no, i AS ix, triples[i + 1] AS t FROM (SELECT line_no, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM gold)),
entities AS (
    SELECT src, line_no, ix, 'subject' AS role, 0 AS n, t.subject.type AS type, t.subject.name AS name, t.subject.span[1] AS span_start, t.subject.span[2] AS span_end FROM typed WHERE t.subject IS NOT NULL
    UNION ALL SELECT src, line_no, ix, 'object', 1, t.object.type, t.object.name, t.object.span[1], t.object.span[2] FROM typed WHERE t.object IS NOT NULL
    UNION ALL SELECT src, line_no, ix, 'subject', 0, t.subject_type, t.subject_name, t.subject_span[1], t.subject_span[2] FROM flat WHERE coalesce(t.subject_type, t.subject_name) IS NOT NULL OR t.subject_span IS NOT NULL
    UNION ALL SELECT src, line_no, ix, 'object', 1, t.object_type, t.object_name, t.object_span[1], t.object_span[2] FROM flat WHERE coalesce(t.object_type, t.object_name) IS NOT NULL OR t.object_span IS NOT NULL
    UNION ALL SELECT 'raw_lines', line_no, ix, role, n, type, name, span_start, span_end FROM stated_ends),
statements AS (
    SELECT src, line_no, ix, t.relation AS relation, t.evidence AS evidence, t.confidence AS confidence, 'object' AS form, NULL AS note, t.source_paper_id AS source_paper_id, t.source_section AS source_section, t.extractor AS extractor
    FROM typed WHERE t IS NOT NULL
    UNION ALL SELECT src, line_no, ix, t.relation, t.evidence, t.confidence, 'fields', t.note, NULL, NULL, NULL FROM flat WHERE t IS NOT NULL
    UNION ALL SELECT 'raw_lines', line_no, ix, coalesce(el ->> 'relation', g ->> 'relation'), coalesce(el ->> 'evidence', g ->> 'evidence'), coalesce(el ->> 'confidence', g ->> 'confidence'),
        CASE WHEN g IS NOT NULL THEN 'group' WHEN list_has_any(json_keys(el), ['subject_name', 'object_name']) THEN 'fields' ELSE 'object' END,
        coalesce(el ->> 'note', g ->> 'note'), coalesce(el ->> 'source_paper_id', g ->> 'source_paper_id'), coalesce(el ->> 'source_section', g ->> 'source_section'), coalesce(el ->> 'extractor', g ->> 'extractor') FROM ranked),
said AS (
    SELECT 'results' AS src, line_no, i, errors[i + 1] AS message FROM (SELECT line_no, errors, unnest(range(CAST(len(errors) AS BIGINT))) AS i FROM results)
    UNION ALL SELECT 'raw_lines', line_no, i, errors ->> CAST('$[' || i || ']' AS VARCHAR) FROM (SELECT line_no, rec -> 'errors' AS errors, unnest(range(CAST(json_array_length(rec -> 'errors') AS BIGINT))) AS i FROM lines WHERE json_type(rec -> 'errors') = 'ARRAY'))
"""
_IDS = "src, CAST(line_no AS BIGINT) AS line_no"
_T = "src || ':' || line_no || ':' || ix"

ORACLES = {
    "p1_found": f"""
WITH {_RAW_SQL}
SELECT DISTINCT {_IDS}, CAST(ix AS INTEGER) AS triple_ix, role FROM entities
WHERE regexp_matches(name, '[^\\s\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')
""",
    "p1_entities": f"""
WITH {_RAW_SQL}
SELECT {_IDS}, {_T} || ':' || role AS key, {_T} AS parent_key, CAST(n AS INTEGER) AS ordinal, CAST(ix AS INTEGER) AS triple_ix, role, type, name, CAST(span_start AS INTEGER) AS span_start, CAST(span_end AS INTEGER) AS span_end FROM entities
""",
    "p1_triples": f"""
WITH {_RAW_SQL}
SELECT {_IDS}, {_T} AS key, src || ':' || line_no AS parent_key, CAST(ix AS INTEGER) AS ordinal, relation, evidence, confidence, form, note, source_paper_id, source_section, extractor FROM statements
""",
    "p1_records": f"""
WITH {_RAW_SQL},
records AS (
    SELECT 'results' AS src, line_no, passage_id, paper_id, section_name AS section, extractor AS origin, NULL AS status, n_triples, cost_usd, latency_ms, run_at, NULL AS note, NULL AS passage_text, NULL AS source_doi, NULL AS source_title,
        NULL AS source_license, NULL AS source_url FROM results
    UNION ALL SELECT 'gold', line_no, passage_id, paper_id, section, annotator, status, NULL, NULL, NULL, annotated_at, note, passage_text, source_doi, source_title, source_license, source_url FROM gold
    UNION ALL SELECT 'raw_lines', line_no, rec ->> 'passage_id', rec ->> 'paper_id', coalesce(rec ->> 'section', rec ->> 'section_name'), coalesce(rec ->> 'extractor', rec ->> 'annotator'), rec ->> 'status', TRY_CAST(rec ->> 'n_triples' AS INTEGER),
        TRY_CAST(rec ->> 'cost_usd' AS DOUBLE), TRY_CAST(rec ->> 'latency_ms' AS DOUBLE), coalesce(rec ->> 'run_at', rec ->> 'annotated_at'), rec ->> 'note', rec ->> 'passage_text', rec ->> 'source_doi', rec ->> 'source_title', rec ->> 'source_license',
        rec ->> 'source_url' FROM lines)
SELECT {_IDS}, src || ':' || line_no AS key, CAST(NULL AS VARCHAR) AS parent_key, passage_id, paper_id, section, origin, status, CAST(n_triples AS INTEGER) AS n_triples, cost_usd, latency_ms, run_at, note, passage_text, source_doi, source_title,
    source_license, source_url FROM records
""",
    "p1_errors": f"""
WITH {_RAW_SQL}
SELECT {_IDS}, src || ':' || line_no || ':error:' || i AS key, src || ':' || line_no AS parent_key, CAST(i AS INTEGER) AS ordinal, message FROM said
""",
    "p1_fields": f"""
WITH {_RAW_SQL},
owners AS (
    SELECT 'record' AS owner, 'raw_lines:' || line_no AS k, line_no, rec AS o, ['passage_id', 'paper_id', 'section', 'extractor', 'annotator', 'status', 'n_triples', 'cost_usd', 'latency_ms', 'run_at', 'annotated_at', 'note', 'passage_text', 'source_doi',
        'source_title', 'source_license', 'source_url', 'errors', 'triples', 'section_name'] AS known FROM lines
    UNION ALL SELECT 'triple', 'raw_lines:' || line_no || ':' || ix, line_no, el, ['relation', 'evidence', 'confidence', 'note', 'source_paper_id', 'source_section', 'extractor', 'subject', 'object', 'subject_type', 'subject_name', 'subject_span',
        'object_type', 'object_name', 'object_span'] FROM ranked
    UNION ALL SELECT 'entity', 'raw_lines:' || line_no || ':' || ix || ':' || role, line_no, e, ['type', 'name', 'span'] FROM stated_ends WHERE json_type(e) = 'OBJECT'),
named AS (
    SELECT owner, k, line_no, name, o -> name AS value, list_position(json_keys(o), name) AS pos FROM (SELECT *, unnest(list_filter(json_keys(o), lambda x: NOT list_contains(known, x))) AS name FROM owners)
    UNION ALL SELECT 'record', 'raw_lines:' || line_no, line_no, 'triples.' || name, t -> name, 1000000 + list_position(json_keys(t), name)
    FROM (SELECT *, unnest(list_filter(json_keys(t), lambda x: x <> 'items')) AS name FROM opened WHERE json_type(t) = 'OBJECT' AND json_type(t -> 'items') = 'ARRAY')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS n FROM named)
SELECT 'raw_lines' AS src, CAST(line_no AS BIGINT) AS line_no, k || ':field:' || n AS key, k AS parent_key, CAST(n AS INTEGER) AS ordinal, owner, name, CAST(value AS VARCHAR) AS value FROM ordered
""",
    "p1_orphans": f"""
WITH {_RAW_SQL}
SELECT 'triple' AS tag, src, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_orphans FROM statements GROUP BY src
UNION ALL SELECT 'error', src, count(*), 0 FROM said GROUP BY src
UNION ALL SELECT 'entity', src, count(*), 0 FROM entities GROUP BY src
""",
}
