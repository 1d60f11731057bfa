"""SQL fragments shared by the oracles."""

from __future__ import annotations

from passagekg.plans import sqltext

LATEST_RESULTS = "SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY passage_id, extractor ORDER BY run_at DESC NULLS LAST, line_no DESC) = 1"
LATEST_GOLD = "SELECT * FROM gold QUALIFY row_number() OVER (PARTITION BY passage_id ORDER BY annotated_at DESC NULLS LAST, line_no DESC) = 1"
_AT = "unnest(range(CAST(len(triples) AS BIGINT))) AS i"
PREDICTED = f"""SELECT line_no, i AS triple_ix, passage_id, paper_id, passage_id AS source_paper_id, section_name AS source_section, extractor, t.relation AS relation, t.subject.type AS subject_type,
    t.subject.name AS subject_name, t.object.type AS object_type, t.object.name AS object_name, t.evidence AS evidence, t.confidence AS confidence
    FROM (SELECT *, triples[i + 1] AS t FROM (SELECT *, {_AT} FROM {{0}})) WHERE t IS NOT NULL"""
GOLD = f"""SELECT line_no, i AS triple_ix, passage_id, paper_id, passage_id AS source_paper_id, section AS source_section, 'gold' AS extractor, t.relation AS relation, t.subject_type AS subject_type,
    t.subject_name AS subject_name, t.object_type AS object_type, t.object_name AS object_name, t.evidence AS evidence, t.confidence AS confidence
    FROM (SELECT *, triples[i + 1] AS t FROM (SELECT *, {_AT} FROM {{0}})) WHERE t IS NOT NULL"""
SPACE = "\\t\\n\\v\\f\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def predicted(latest: bool = True) -> str:
    return PREDICTED.format(f"({LATEST_RESULTS})" if latest else "results")


def gold(latest: bool = True) -> str:
    return GOLD.format(f"({LATEST_GOLD})" if latest else "gold")


def both_keys(source: str) -> str:
    return sqltext.keyed(f"({sqltext.keyed(source, 'subject_type', 'subject_name', 's_key')})", "object_type", "object_name", "o_key")


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"
