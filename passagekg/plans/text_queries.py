"""Text, segmentation and annotation queries (F*, P*, T*, U8) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagekg.functions import text as tx
from passagekg.operators import annotate, ingest, segment
from passagekg.plans import common as c
from passagekg.plans import sqltext
from passagekg.runtime import table


def _endpoints(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "results").select(F.explode("triples").alias("t")).where("t IS NOT NULL")
    return t.select(F.inline(F.array("t.subject", "t.object"))).select("type", "name").distinct()


_ENDS = "(SELECT DISTINCT e.type AS type, e.name AS name FROM (SELECT unnest([t.subject, t.object]) AS e FROM (SELECT unnest(triples) AS t FROM results) WHERE t IS NOT NULL) WHERE e IS NOT NULL)"


def f1_fold(spark, sf):
    return _endpoints(spark, sf).select("name").where("name IS NOT NULL").distinct().select("name", tx.fold(F.col("name")).alias("folded"))


def f5_keys(spark, sf):
    return tx.with_key(_endpoints(spark, sf).where("name IS NOT NULL"), "type", "name", "key").select("type", "name", "key")


def f6_tokens(spark, sf):
    k = tx.with_key(_endpoints(spark, sf).where("name IS NOT NULL"), "type", "name", "key").select("key").distinct()
    return k.select("key", F.array_join(F.array_sort(tx.tokens(F.col("key"))), " ").alias("tokens"), F.array_join(tx.numbers(F.col("key")), " ").alias("numbers"))


def f11_clean(spark, sf):
    return table(spark, sf, "gold").select("line_no", F.array_join(tx.clean_values(F.array("note", "annotator", "section")), "|").alias("cleaned"))


def f12_elements(spark, sf):
    return table(spark, sf, "digimof_synmof_merged").select("metal").distinct().select("metal", F.array_join(F.array_sort(tx.elements_in(F.col("metal"))), ",").alias("elements"))


def f13_slug(spark, sf):
    return table(spark, sf, "passages").select("section_name").where("section_name IS NOT NULL").distinct().select("section_name", tx.slug(F.col("section_name")).alias("slug"))


def f15_family(spark, sf):
    return table(spark, sf, "results").select("extractor").where("extractor IS NOT NULL").distinct().select("extractor", tx.extractor_family(F.col("extractor")).alias("family"))


def f16_span(spark, sf):
    t = table(spark, sf, "results").select("line_no", F.posexplode("triples").alias("triple_ix", "t")).select("line_no", "triple_ix", tx.span_of(F.col("t.subject.span")).alias("s"))
    return t.where("s IS NOT NULL").select("line_no", "triple_ix", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def p2_backfill(spark, sf):
    p = table(spark, sf, "papers")
    hits = p.groupBy("pmcid").agg(F.max("doi").alias("doi"), F.max("license").alias("license"))
    return ingest.backfilled(p.withColumnRenamed("pmcid", "hit"), hits).groupBy("paper_id").agg(F.max("doi").alias("doi"), F.max("license").alias("license"))


def p3_distinct(spark, sf):
    return ingest.distinct_papers(table(spark, sf, "papers")).select("paper_id", "doi", "title", F.size("sections").alias("n_sections"))


def p4_blocks(spark, sf):
    return segment.blocks(table(spark, sf, "papers")).distinct()


def p7_passages(spark, sf):
    return segment.passages(table(spark, sf, "papers")).select("passage_id", "paper_id", "section_name", "char_start", "char_end", F.sha1("text").alias("text_sha1")).distinct()


def p8_ids(spark, sf):
    s = segment.sections(table(spark, sf, "papers"))
    return s.select("paper_id", "section_ix", "occurrence", segment.passage_id(F.col("paper_id"), F.col("section_name"), F.col("occurrence"), F.lit(0)).alias("passage_id")).distinct()


def p9_signals(spark, sf):
    s = segment.scored(table(spark, sf, "passages").select("passage_id", "text", "section_name").distinct())
    return s.select("passage_id", F.sha1("text").alias("text_sha1"), *[F.coalesce(F.col("signals")[k], F.lit(0)).cast("bigint").alias(k) for k in segment.WEIGHTS])


def p9_scores(spark, sf):
    s = segment.scored(table(spark, sf, "passages").select("passage_id", "text", "section_name").distinct())
    return s.select("passage_id", F.sha1("text").alias("text_sha1"), "synthesis_score", "is_synthesis", F.col("signals")["quantity"].alias("quantity"))


def full_text(spark, sf):
    p = segment.full_text(table(spark, sf, "papers"))
    return p.select("paper_id", "retrieved_at", F.sha1("full_text").alias("full_text_sha1"), "n_chars").distinct()


def first_section(spark, sf):
    p = segment.first_section(table(spark, sf, "papers"), annotate.SECTION_KEYWORDS)
    return p.select("paper_id", "retrieved_at", F.col("section.name").alias("section_name")).distinct()


def a9_summary(spark, sf):
    return segment.summary(table(spark, sf, "passages"))


def a14_funnel(spark, sf):
    return segment.funnel(table(spark, sf, "papers"), table(spark, sf, "passages"), table(spark, sf, "gold"))


def a15_curve(spark, sf):
    return segment.threshold_curve(table(spark, sf, "passages"))


def a16_licences(spark, sf):
    return ingest.licences(table(spark, sf, "papers"))


def p12_sentences(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "text").distinct()
    return p.select("passage_id", F.sha1("text").alias("text_sha1"), F.coalesce(F.size(annotate.sentences(F.col("text"))), F.lit(0)).cast("bigint").alias("n_sentences"))


def p13_chunks(spark, sf):
    p = table(spark, sf, "passages").select("passage_id", "text").distinct()
    return p.select("passage_id", F.posexplode(annotate.chunks(F.col("text"))).alias("chunk_ix", "chunk")).select("passage_id", "chunk_ix", F.length("chunk").alias("n_chars"), F.sha1("chunk").alias("chunk_sha1")).distinct()


def _gold_names(spark, sf):
    g = table(spark, sf, "gold").select("line_no", "passage_text", F.posexplode("triples").alias("triple_ix", "t"))
    return g.select("line_no", "triple_ix", F.col("passage_text").alias("text"), F.col("t.object_name").alias("name")).where("text IS NOT NULL AND name IS NOT NULL")


def p14_spans(spark, sf):
    s = _gold_names(spark, sf).withColumn("s", annotate.find_span(F.col("text"), F.col("name")))
    return s.where("s IS NOT NULL").select("line_no", "triple_ix", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))


def p15_sentence(spark, sf):
    return _gold_names(spark, sf).select("line_no", "triple_ix", annotate.sentence_containing(F.col("text"), F.col("name")).alias("sentence"))


def src15_fallback(spark, sf):
    return annotate.passages_from_papers(table(spark, sf, "papers")).select("passage_id", "section", F.length("text").alias("n_chars")).distinct()


def t1_first(spark, sf):
    return table(spark, sf, "results").orderBy("line_no").limit(100).select("line_no", "passage_id", "extractor")


def t5_sample(spark, sf):
    return annotate.sample(table(spark, sf, "passages").select("passage_id").distinct(), 100).select("passage_id")


def t6_worklist(spark, sf):
    p = table(spark, sf, "passages").groupBy("passage_id").agg(F.max("is_synthesis").alias("is_synthesis"))
    return annotate.worklist(p).select("passage_id", "is_synthesis", "position")


def a17_progress(spark, sf):
    return annotate.progress(table(spark, sf, "gold"))


def j8_pending(spark, sf):
    return annotate.pending(table(spark, sf, "passages").select("passage_id").distinct(), table(spark, sf, "gold"))


def u8_upsert(spark, sf):
    from passagekg.operators.evaluate import latest_gold

    gold = table(spark, sf, "gold")
    return annotate.upsert(gold, latest_gold(gold)).groupBy("status").agg(F.count("*").alias("n"), F.countDistinct("passage_id").alias("n_passages"))


QUERIES = {
    "ref_f1_fold": f1_fold, "ref_f5_keys": f5_keys, "ref_f6_tokens": f6_tokens, "ref_f11_clean_values": f11_clean, "ref_f12_elements": f12_elements, "ref_f13_slug": f13_slug,
    "ref_f15_family": f15_family, "ref_f16_spans": f16_span, "ref_p2_backfill": p2_backfill, "ref_p3_distinct_papers": p3_distinct, "ref_p4_blocks": p4_blocks, "ref_p7_passages": p7_passages,
    "ref_p8_ids": p8_ids, "ref_p9_signals": p9_signals, "ref_p9_scores": p9_scores, "ref_m1_full_text": full_text, "ref_m1_first_section": first_section, "ref_a9_summary": a9_summary,
    "ref_a14_funnel": a14_funnel, "ref_a15_threshold_curve": a15_curve, "ref_a16_licences": a16_licences, "ref_p12_sentences": p12_sentences, "ref_p13_chunks": p13_chunks, "ref_p14_spans": p14_spans,
    "ref_p15_sentence": p15_sentence, "ref_src15_fallback": src15_fallback, "ref_t1_first": t1_first, "ref_t5_sample": t5_sample, "ref_t6_worklist": t6_worklist, "ref_a17_progress": a17_progress,
    "ref_j8_pending": j8_pending, "ref_u8_upsert": u8_upsert,
}

_KEYED = sqltext.keyed(f"(SELECT * FROM {_ENDS} WHERE name IS NOT NULL)", "type", "name", "key")
_STOP = "[" + ", ".join(sqltext.lit(s) for s in tx.STOPWORDS) + "]"
_NULLS = "(" + ", ".join(sqltext.lit(s) for s in tx.NULL_TOKENS) + ")"
_SECTIONS = "SELECT paper_id, doi, i AS section_ix, sections[i + 1] AS s FROM (SELECT paper_id, doi, sections, unnest(range(CAST(len(sections) AS BIGINT))) AS i FROM papers)"


def _re(phrases: tuple[str, ...], left: bool, right: bool) -> str:
    import re

    parts = [(r"\b" if left and p[0].isalnum() else "") + re.escape(p).replace("\\ ", " ") + (r"\b" if right and p[-1].isalnum() else "") for p in phrases]
    return sqltext.lit("(?i)" + "|".join(parts))


_CUES = " OR ".join(f"contains(lower(coalesce(section_name, '')), {sqltext.lit(x)})" for x in segment.SECTION_CUES)
_SIGNALS = ", ".join(
    f"CAST({f'({_CUES})' if k == 'section_cue' else f'len(regexp_extract_all(text, {_re(*segment.VOCABULARY[k])}))'} AS BIGINT) AS {k}" for k in segment.WEIGHTS if k != "quantity"
)
# quantities: the number must not follow, nor the unit be followed by, a letter; a mark before each such number stands for lookbehind
_UNITS = sqltext.lit(
    "\\x01\\p{Nd}+(?:[.,]\\p{Nd}+)?[" + c.SPACE + "]*(?:mg|g|kg|mmol|mol|m|mm|nm|ml|l|µl|ul|wt[" + c.SPACE + "]*%|%|h|hr|hrs|hour|hours|min|mins|minute|minutes|°[" + c.SPACE + "]*c|º[" + c.SPACE + "]*c|degrees?[" + c.SPACE + "]*c|k|rpm|bar|mpa)(?:[^a-z]|$)"
)
_QUANTITY = f"CAST(len(regexp_extract_all(regexp_replace(lower(orig), '(^|[^a-z0-9])(\\p{{Nd}})', '\\1' || chr(1) || chr(1) || '\\2', 'g'), {_UNITS})) AS BIGINT) AS quantity"
_SCANNED = f"(SELECT passage_id, orig, section_name, regexp_replace(regexp_replace(orig, '[^\\p{{L}}\\p{{N}}\\x00-\\x7f]', ' ', 'g'), '[^\\x00-\\x7f]', '_', 'g') AS text FROM (SELECT DISTINCT passage_id, text AS orig, section_name FROM passages))"
_SCORE = "greatest(0.0, least(1.0, round(" + " + ".join(f"CAST({w} AS DOUBLE) * least({k}, {cap}) / {cap}" for k, (w, cap) in segment.WEIGHTS.items()) + ", 4)))"
_KEYWORDS = " OR ".join(f"contains(lower(coalesce(x.name, '')), {sqltext.lit(k)})" for k in annotate.SECTION_KEYWORDS)

_SENTENCES = "list_filter(list_transform(string_split(regexp_replace(" + c.strip("{x}").replace("{", "{{").replace("}", "}}").replace("{{x}}", "{x}") + ", '([.!?])[" + c.SPACE.replace("{", "{{").replace("}", "}}") + "]+([A-Z0-9(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda v: " + c.strip("v").replace("{", "{{").replace("}", "}}") + "), lambda v: v <> '')"
_PACK = "list_reduce(list_transform({s}, lambda v: [v]), lambda acc, x: CASE WHEN length(acc[len(acc)]) + 1 + length(x[1]) > 2500 THEN list_concat(acc, x) ELSE list_append(acc[:len(acc) - 1], acc[len(acc)] || ' ' || x[1]) END)"

ORACLES = {
    "ref_f1_fold": f"SELECT DISTINCT name, {sqltext.fold('name')} AS folded FROM {_ENDS} WHERE name IS NOT NULL",
    "ref_f5_keys": f"SELECT type, name, key FROM ({_KEYED})",
    "ref_f6_tokens": f"""SELECT key, array_to_string(list_sort(CASE WHEN len(kept) > 0 THEN kept ELSE toks END), ' ') AS tokens, array_to_string(list_sort(regexp_extract_all(key, '\\d+(?:\\.\\d+)?')), ' ') AS numbers
        FROM (SELECT *, list_filter(toks, lambda x: NOT list_contains({_STOP}, x)) AS kept FROM (SELECT DISTINCT key, list_distinct(regexp_extract_all(key, '[a-z0-9]+')) AS toks FROM ({_KEYED})))""",
    "ref_f11_clean_values": f"""SELECT line_no, array_to_string(list_filter(list_transform([note, annotator, section], lambda x: {c.strip('x')}), lambda v: v IS NOT NULL AND lower(v) NOT IN {_NULLS}), '|') AS cleaned FROM gold""",
    "ref_f12_elements": f"""SELECT DISTINCT metal, CASE WHEN metal IS NULL OR lower({c.strip('metal')}) IN ('', 'nan', 'none') THEN '' ELSE array_to_string(list_sort(list_distinct(regexp_extract_all(metal, '[A-Z][a-z]?'))), ',') END AS elements FROM digimof_synmof_merged""",
    "ref_f13_slug": "SELECT DISTINCT section_name, coalesce(nullif(trim(regexp_replace(lower(section_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') AS slug FROM passages WHERE section_name IS NOT NULL",
    "ref_f15_family": "SELECT DISTINCT extractor, CASE WHEN starts_with(extractor, 'rule') THEN 'rule' ELSE coalesce(string_split(extractor, ':')[2], extractor) END AS family FROM results WHERE extractor IS NOT NULL",
    "ref_f16_spans": "SELECT line_no, CAST(i AS INTEGER) AS triple_ix, triples[i + 1].subject.span[1] AS span_start, triples[i + 1].subject.span[2] AS span_end FROM (SELECT line_no, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM results) WHERE len(triples[i + 1].subject.span) = 2 AND triples[i + 1].subject.span[1] IS NOT NULL AND triples[i + 1].subject.span[2] IS NOT NULL",
    "ref_p2_backfill": """WITH h AS (SELECT pmcid, max(doi) AS d, max(license) AS l FROM papers GROUP BY pmcid)
        SELECT paper_id, max(coalesce(nullif(doi, ''), d)) AS doi, max(coalesce(nullif(license, ''), l)) AS license FROM papers LEFT JOIN h USING (pmcid) GROUP BY paper_id""",
    "ref_p4_blocks": f"""WITH secs AS ({_SECTIONS}), runs AS (SELECT paper_id, section_ix, string_split(s.text, chr(10)) AS parts FROM secs WHERE s.text IS NOT NULL),
        placed AS (SELECT paper_id, section_ix, k, parts[k] AS run, coalesce(list_sum(list_transform(parts[:k - 1], lambda x: length(x) + 1)), 0) AS before FROM (SELECT *, unnest(range(1, CAST(len(parts) AS BIGINT) + 1)) AS k FROM runs)),
        cut AS (SELECT *, length(run) - length(regexp_replace(run, '^[{c.SPACE}]+', '')) AS lead, length({c.strip('run')}) AS size FROM placed),
        copies AS (SELECT DISTINCT * FROM cut WHERE size > 0)
        SELECT DISTINCT paper_id, CAST(section_ix AS INTEGER) AS section_ix, CAST(block_ix AS INTEGER) AS block_ix, CAST(before + lead AS INTEGER) AS "start", CAST(before + lead + size AS INTEGER) AS "end" FROM (
            SELECT d.*, row_number() OVER (PARTITION BY paper_id, section_ix, parts ORDER BY k) - 1 AS block_ix FROM (
                SELECT DISTINCT paper_id, section_ix, parts, k, before, lead, size FROM (SELECT paper_id, section_ix, parts, k, parts[k] AS run, coalesce(list_sum(list_transform(parts[:k - 1], lambda x: length(x) + 1)), 0) AS before,
                    length(parts[k]) - length(regexp_replace(parts[k], '^[{c.SPACE}]+', '')) AS lead, length({c.strip('parts[k]')}) AS size FROM (SELECT *, unnest(range(1, CAST(len(parts) AS BIGINT) + 1)) AS k FROM runs)) WHERE size > 0) d)""",
    "ref_p8_ids": f"""WITH p AS (SELECT row_number() OVER () AS r, * FROM papers), s AS (SELECT r, paper_id, i AS section_ix, coalesce(sections[i + 1].name, '') AS name FROM (SELECT r, paper_id, sections, unnest(range(CAST(len(sections) AS BIGINT))) AS i FROM p)),
        o AS (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY section_ix) - 1 AS occurrence FROM s)
        SELECT DISTINCT paper_id, CAST(section_ix AS INTEGER) AS section_ix, CAST(occurrence AS INTEGER) AS occurrence, paper_id || '-' || sha1(paper_id || '|' || name || '|' || occurrence || '|0')[:10] AS passage_id FROM o""",
    "ref_p9_signals": f"SELECT DISTINCT passage_id, sha1(orig) AS text_sha1, {_SIGNALS}, {_QUANTITY} FROM {_SCANNED}",
    "ref_p9_scores": f"SELECT passage_id, text_sha1, {_SCORE} AS synthesis_score, {_SCORE} >= 0.45 AS is_synthesis, CAST(quantity AS INTEGER) AS quantity FROM (SELECT DISTINCT passage_id, sha1(orig) AS text_sha1, section_name, {_SIGNALS}, {_QUANTITY} FROM {_SCANNED})",
    "ref_p3_distinct_papers": """WITH one AS (SELECT * FROM papers WHERE paper_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY retrieved_at DESC NULLS LAST) = 1)
        SELECT paper_id, doi, title, CAST(len(sections) AS INTEGER) AS n_sections FROM one QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(lower(trim(doi)), ''), 'no doi:' || paper_id) ORDER BY paper_id) = 1""",
    "ref_p13_chunks": f"""WITH p AS (SELECT DISTINCT passage_id, text FROM passages WHERE text IS NOT NULL), parts AS (SELECT passage_id, text, {_SENTENCES.format(x="text")} AS s FROM p),
        packed AS (SELECT DISTINCT passage_id, CASE WHEN length(text) <= 2500 THEN [text] ELSE {_PACK.format(s="s")} END AS chunks FROM parts)
        SELECT DISTINCT passage_id, CAST(i AS INTEGER) AS chunk_ix, CAST(length(chunks[i + 1]) AS INTEGER) AS n_chars, sha1(chunks[i + 1]) AS chunk_sha1 FROM (SELECT *, unnest(range(CAST(len(chunks) AS BIGINT))) AS i FROM packed)""",
    "ref_src15_fallback": f"""WITH firsts AS (SELECT paper_id, list_filter(sections, lambda x: {_KEYWORDS})[1] AS s FROM papers),
        paras AS (SELECT paper_id, s.name AS section, list_filter(list_transform(string_split(s.text, chr(10)), lambda x: {c.strip('x')}), lambda x: length(x) >= 200) AS ps FROM firsts WHERE s IS NOT NULL),
        each AS (SELECT paper_id, section, r, i, ps[i + 1] AS para FROM (SELECT *, unnest(range(CAST(len(ps) AS BIGINT))) AS i FROM (SELECT *, row_number() OVER () AS r FROM paras))),
        cut AS (SELECT *, {_SENTENCES.format(x="para")} AS s FROM each), chunked AS (SELECT r, paper_id, section, i, CASE WHEN length(para) <= 2500 THEN [para] ELSE {_PACK.format(s="s")} END AS chunks FROM cut),
        flat AS (SELECT r, paper_id, section, i, k, chunks[k + 1] AS text FROM (SELECT *, unnest(range(CAST(len(chunks) AS BIGINT))) AS k FROM chunked)),
        kept AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY i, k) - 1 AS ix FROM flat WHERE length(text) >= 200)
        SELECT DISTINCT paper_id || ':' || coalesce(nullif(trim(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'section') || ':' || printf('%03d', ix) AS passage_id, section, CAST(length(text) AS INTEGER) AS n_chars FROM kept""",
    "ref_p7_passages": f"""WITH p AS (SELECT row_number() OVER () AS r, * FROM papers),
        secs AS (SELECT r, paper_id, i, coalesce(sections[i + 1].name, '') AS name, sections[i + 1].text AS text FROM (SELECT *, unnest(range(CAST(len(sections) AS BIGINT))) AS i FROM p)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY r, name ORDER BY i) - 1 AS occurrence FROM secs),
        lines AS (SELECT r, i, paper_id, name, occurrence, text, string_split(text, chr(10)) AS parts FROM numbered WHERE text IS NOT NULL),
        placed AS (SELECT *, parts[k] AS run, coalesce(list_sum(list_transform(parts[:k - 1], lambda x: length(x) + 1)), 0) AS before FROM (SELECT *, unnest(range(1, CAST(len(parts) AS BIGINT) + 1)) AS k FROM lines)),
        blocks AS (SELECT *, before + length(run) - length(regexp_replace(run, '^[{c.SPACE}]+', '')) AS a, length({c.strip('run')}) AS n FROM placed),
        merged AS (SELECT r, i, paper_id, name, occurrence, any_value(text) AS text, list_reduce(list([[CAST(a AS BIGINT), CAST(a + n AS BIGINT)]] ORDER BY k), lambda acc, x: CASE
            WHEN least(x[1][2] - x[1][1], acc[len(acc)][2] - acc[len(acc)][1]) < 200 AND x[1][2] - acc[len(acc)][1] <= 3000 THEN list_append(acc[:len(acc) - 1], [acc[len(acc)][1], x[1][2]]) ELSE list_concat(acc, x) END) AS spans
            FROM blocks WHERE n > 0 GROUP BY r, i, paper_id, name, occurrence),
        each AS (SELECT *, spans[j][1] AS a, spans[j][2] AS b FROM (SELECT *, unnest(range(1, CAST(len(spans) AS BIGINT) + 1)) AS j FROM merged)),
        ends AS (SELECT *, list_transform(string_split(regexp_replace(substring(text, a + 1, b - a), '([.!?])([{c.SPACE}]+)', '\\1\\2' || chr(1), 'g'), chr(1)), lambda x: CAST(length(x) AS BIGINT)) AS sizes FROM each),
        stops AS (SELECT *, list_transform(range(1, CAST(len(sizes) AS BIGINT) + 1), lambda q: CAST(a + list_sum(sizes[:q]) AS BIGINT)) AS stop FROM ends),
        cuts AS (SELECT *, CASE WHEN b - a <= 2500 THEN [a] ELSE list_reduce(list_concat([[a]], list_transform(range(1, CAST(len(stop) AS BIGINT) + 1), lambda q: [CASE WHEN q = 1 THEN a ELSE stop[q - 1] END, stop[q]])),
            lambda acc, x: CASE WHEN x[2] - acc[len(acc)] >= 2500 THEN list_append(acc, CASE WHEN x[1] = acc[len(acc)] THEN x[2] ELSE x[1] END) ELSE acc END) END AS cut FROM stops),
        pieces AS (SELECT *, cut[q] AS lo, coalesce(cut[q + 1], b) AS hi FROM (SELECT *, unnest(range(1, CAST(len(cut) AS BIGINT) + 1)) AS q FROM cuts)),
        trimmed AS (SELECT *, substring(text, lo + 1, hi - lo) AS piece FROM pieces),
        kept AS (SELECT *, lo + length(piece) - length(regexp_replace(piece, '^[{c.SPACE}]+', '')) AS s0, {c.strip('piece')} AS body FROM trimmed),
        indexed AS (SELECT *, row_number() OVER (PARTITION BY r, i ORDER BY s0) - 1 AS ix FROM kept WHERE length(body) >= 40)
        SELECT DISTINCT paper_id || '-' || sha1(paper_id || '|' || name || '|' || occurrence || '|' || ix)[:10] AS passage_id, paper_id, name AS section_name, CAST(s0 AS INTEGER) AS char_start, CAST(s0 + length(body) AS INTEGER) AS char_end, sha1(body) AS text_sha1 FROM indexed""",
    "ref_m1_full_text": """SELECT DISTINCT paper_id, retrieved_at, sha1(coalesce(array_to_string(list_transform(sections, lambda s: '## ' || coalesce(s.name, '') || chr(10) || coalesce(s.text, '')), chr(10) || chr(10)), '')) AS full_text_sha1,
        CAST(coalesce(list_sum(list_transform(sections, lambda s: coalesce(length(s.text), 0))), 0) AS BIGINT) AS n_chars FROM papers""",
    "ref_m1_first_section": f"SELECT DISTINCT paper_id, retrieved_at, list_filter(sections, lambda x: {_KEYWORDS})[1].name AS section_name FROM papers",
    "ref_a9_summary": """SELECT count(*) AS n_passages, count(DISTINCT paper_id) AS n_papers, round(avg(length(text)), 2) AS mean_chars, CAST(count(*) FILTER (coalesce(is_synthesis, false)) AS BIGINT) AS n_synthesis,
        count(DISTINCT paper_id) FILTER (coalesce(is_synthesis, false)) AS n_synthesis_papers, round(100 * avg(CAST(coalesce(is_synthesis, false) AS DOUBLE)), 2) AS pct_synthesis FROM passages""",
    "ref_a14_funnel": """SELECT 'papers' AS stage, count(DISTINCT paper_id) AS n FROM papers UNION ALL SELECT 'papers with flagged', count(DISTINCT paper_id) FILTER (is_synthesis) FROM passages
        UNION ALL SELECT 'passages', count(*) FROM passages UNION ALL SELECT 'flagged passages', count(*) FILTER (is_synthesis) FROM passages UNION ALL SELECT 'gold', count(*) FROM gold""",
    "ref_a15_threshold_curve": "SELECT CAST(c AS DOUBLE) AS cutoff, count(passage_id) AS n_passages, count(DISTINCT paper_id) AS n_papers FROM (VALUES (0.25), (0.35), (0.45), (0.55), (0.65)) v(c) LEFT JOIN passages ON synthesis_score >= CAST(c AS DOUBLE) GROUP BY c",
    "ref_a16_licences": "SELECT coalesce(nullif(license, ''), 'unknown') AS license, count(*) AS n FROM papers GROUP BY 1",
    "ref_p12_sentences": f"""SELECT passage_id, sha1(text) AS text_sha1, CAST(len(list_filter(string_split(regexp_replace({c.strip('text')}, '([.!?])[{c.SPACE}]+([A-Z0-9(\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: {c.strip('s')} <> '')) AS BIGINT) AS n_sentences
        FROM (SELECT DISTINCT passage_id, text FROM passages)""",
    "ref_p15_sentence": f"""WITH rows_ AS (SELECT line_no, i, passage_text AS text, lower({c.strip('triples[i + 1].object_name')}) AS needle FROM (SELECT line_no, passage_text, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM gold)
            WHERE passage_text IS NOT NULL AND triples[i + 1].object_name IS NOT NULL),
        spans AS (SELECT *, CASE WHEN needle <> '' AND instr(lower(text), needle) > 0 THEN instr(lower(text), needle) - 1 END AS span, {_SENTENCES.format(x="text")} AS s FROM rows_),
        walked AS (SELECT *, list_reduce(list_concat([{{'s': '', 'at': CAST(0 AS BIGINT), 'hit': CAST(NULL AS VARCHAR)}}], list_transform(s, lambda v: {{'s': v, 'at': CAST(0 AS BIGINT), 'hit': CAST(NULL AS VARCHAR)}})),
            lambda acc, x: {{'s': '', 'at': CASE WHEN instr(substring(text, acc.at + 1), x.s) > 0 THEN CAST(acc.at + instr(substring(text, acc.at + 1), x.s) - 1 + length(x.s) AS BIGINT) ELSE acc.at END,
                'hit': coalesce(acc.hit, CASE WHEN instr(substring(text, acc.at + 1), x.s) > 0 AND acc.at + instr(substring(text, acc.at + 1), x.s) - 1 <= span AND span < acc.at + instr(substring(text, acc.at + 1), x.s) - 1 + length(x.s) THEN x.s END)}}) AS w FROM spans)
        SELECT line_no, CAST(i AS INTEGER) AS triple_ix, CASE WHEN span IS NULL THEN '' ELSE coalesce(w.hit, {c.strip('text')}) END AS sentence FROM walked""",
    "ref_p14_spans": f"""SELECT line_no, CAST(i AS INTEGER) AS triple_ix, CAST(pos - 1 AS INTEGER) AS span_start, CAST(pos - 1 + length(needle) AS INTEGER) AS span_end
        FROM (SELECT *, strpos(lower(passage_text), needle) AS pos FROM (SELECT line_no, i, passage_text, lower({c.strip('triples[i + 1].object_name')}) AS needle FROM (SELECT line_no, passage_text, triples, unnest(range(CAST(len(triples) AS BIGINT))) AS i FROM gold) WHERE passage_text IS NOT NULL AND triples[i + 1].object_name IS NOT NULL)) WHERE needle <> '' AND pos > 0""",
    "ref_t1_first": "SELECT line_no, passage_id, extractor FROM results ORDER BY line_no LIMIT 100",
    "ref_t5_sample": "SELECT passage_id FROM (SELECT DISTINCT passage_id FROM passages) ORDER BY sha1(passage_id || ':2026'), passage_id LIMIT 100",
    "ref_t6_worklist": """WITH p AS (SELECT passage_id, coalesce(max(is_synthesis), true) AS is_synthesis FROM passages GROUP BY 1),
        n AS (SELECT least(count(*), 10) AS c FROM p WHERE NOT is_synthesis),
        r AS (SELECT *, row_number() OVER (PARTITION BY is_synthesis ORDER BY sha1(passage_id || ':' || CASE WHEN is_synthesis THEN '2026' ELSE '2027' END), passage_id) AS k FROM p),
        s AS (SELECT passage_id, is_synthesis FROM r, n WHERE k <= CASE WHEN is_synthesis THEN 100 - c ELSE c END)
        SELECT passage_id, is_synthesis, CAST(row_number() OVER (ORDER BY sha1(passage_id || ':2028'), passage_id) AS INTEGER) AS position FROM s""",
    "ref_a17_progress": """SELECT reviewed, annotated, no_synthesis, skipped, triples, CAST(greatest(0, 80 - annotated) AS BIGINT) AS remaining, round(least(1.0, annotated / 80), 4) AS fraction, annotated >= 80 AS complete FROM (
        SELECT count(*) AS reviewed, count(*) FILTER (status = 'annotated') AS annotated, count(*) FILTER (status = 'no_synthesis') AS no_synthesis, count(*) FILTER (status = 'skipped') AS skipped, CAST(coalesce(sum(len(triples)), 0) AS BIGINT) AS triples FROM gold)""",
    "ref_j8_pending": "SELECT DISTINCT passage_id FROM passages WHERE passage_id NOT IN (SELECT passage_id FROM gold WHERE passage_id IS NOT NULL AND (status IS NULL OR status <> 'skipped'))",
    "ref_u8_upsert": f"SELECT status, count(*) AS n, count(DISTINCT passage_id) AS n_passages FROM ({c.LATEST_GOLD}) GROUP BY status",
}
