"""Problem 1: nested records -> related flat tables, by single-pass tagged emission.

One depth-first visit of every record yields rows ``(tag, key, parent_key, src, line_no, ordinal, payload)``: a
``record`` row and its ``error`` rows, then per triple a ``triple`` row followed by its ``entity`` rows, and below each of
them a ``field`` row for whatever the record states beyond the known fields. Keys are paths (``results:17``,
``results:17:3``, ``results:17:3:subject``), so a child's ``parent_key`` is always the key of a row of the level
above. The payload has one struct per tag, of which a row fills its own. The emission is written once, partitioned by
tag; each table is then one partition read, its schema the struct of the tag.

Typed tables (results, gold) are visited by Catalyst array expressions; raw JSON lines, whose shape is not known to the scan,
by a visitor over Arrow batches. Both are narrow: no shuffle, so a hot record, paper or extractor costs nothing extra.

Nothing a record states is lost: every column of the typed tables has its place in a flat table; in raw lines unknown
fields of records, triples and endpoints, a ``triples`` text that is no JSON, members of a ``triples`` object beside its
items and elements that are no objects are ``field`` rows, their value as JSON. JSON of any depth is read.

Defined results for odd input: null arrays give only the record row; a null element keeps its position
(``triple_ix`` counts it) and emits nothing; an endpoint that states nothing emits no entity, one without name does
(``endpoints`` leaves out null and blank names); a line that is not a complete JSON object (or is null) emits nothing;
further columns of typed tables are ignored; rows of one line_no are emitted once per row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagekg.runtime import shared_path

#: Fields and types of each flat table.
SCHEMAS: dict[str, dict[str, str]] = {
    "record": {
        "passage_id": "string", "paper_id": "string", "section": "string", "origin": "string", "status": "string", "n_triples": "int", "cost_usd": "double", "latency_ms": "double", "run_at": "string",
        "note": "string", "passage_text": "string", "source_doi": "string", "source_title": "string", "source_license": "string", "source_url": "string",
    },
    "error": {"message": "string"},
    "triple": {"relation": "string", "evidence": "string", "confidence": "string", "form": "string", "note": "string", "source_paper_id": "string", "source_section": "string", "extractor": "string"},
    "entity": {"role": "string", "type": "string", "name": "string", "span_start": "int", "span_end": "int"},
    "field": {"owner": "string", "name": "string", "value": "string"},
}
_PAYLOAD = "struct<" + ", ".join(f"{tag}: struct<{', '.join(f'{k}: {v}' for k, v in fields.items())}>" for tag, fields in SCHEMAS.items()) + ">"
EMISSION = f"tag string, key string, parent_key string, src string, line_no bigint, ordinal int, payload {_PAYLOAD}"
#: Any character that is not white space (Unicode sense) makes a name non-blank.
NON_BLANK = r"(?U)[^\s\x1c-\x1f\x85]"


def _payload(tag: str, **fields: Column) -> Column:
    """The payload of a row of ``tag``; fields not given are null."""
    def struct(t: str) -> Column:
        kind = "struct<" + ", ".join(f"{k}: {v}" for k, v in SCHEMAS[t].items()) + ">"
        if t != tag:
            return F.lit(None).cast(kind)
        return F.struct(*[fields.get(k, F.lit(None)).try_cast(v).alias(k) for k, v in SCHEMAS[t].items()])

    return F.struct(*[struct(t).alias(t) for t in SCHEMAS])


def _row(tag: str, key: Column, parent: Column, ordinal: Column, **fields: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), key.alias("key"), parent.cast("string").alias("parent_key"), ordinal.cast("int").alias("ordinal"), _payload(tag, **fields).alias("payload"))


def _visit(df: DataFrame, src: str, record: dict[str, Column], parts, errors: Column | None = None) -> DataFrame:
    key = F.concat_ws(":", F.lit(src), F.col("line_no"))

    def of_triple(t: Column, i: Column) -> Column:
        tkey = F.concat_ws(":", key, i)
        triple, ends = parts(t)
        rows = [F.when(t.isNotNull(), _row("triple", tkey, key, i, **triple))]
        for n, (role, (stated, fields)) in enumerate(ends):
            rows.append(F.when(stated, _row("entity", F.concat_ws(":", tkey, F.lit(role)), tkey, F.lit(n), role=F.lit(role), **fields)))
        return F.array(*rows)

    head = F.array(_row("record", key, F.lit(None), F.lit(0), **record))
    if errors is not None:
        said = F.coalesce(errors, F.array().cast("array<string>"))
        head = F.concat(head, F.transform(said, lambda e, i: _row("error", F.concat_ws(":", key, F.lit("error"), i), key, i, message=e)))
    children = F.flatten(F.transform(F.coalesce(F.col("triples"), F.array().cast(df.schema["triples"].dataType)), of_triple))
    rows = F.concat(head, F.filter(children, lambda r: r.isNotNull()))
    exploded = df.select(F.col("line_no").cast("bigint").alias("no"), F.explode(rows).alias("r"))
    return exploded.select("r.tag", "r.key", "r.parent_key", F.lit(src).alias("src"), F.col("no").alias("line_no"), "r.ordinal", "r.payload")


def _span(span: Column) -> dict[str, Column]:
    return {"span_start": F.try_element_at(span, F.lit(1)), "span_end": F.try_element_at(span, F.lit(2))}


def emit_results(results: DataFrame) -> DataFrame:
    """Tagged emission of ``results`` (nested entities)."""

    def parts(t: Column):
        def end(e: Column):
            return e.isNotNull(), {"type": e["type"], "name": e["name"], **_span(e["span"])}

        same = ("relation", "evidence", "confidence", "source_paper_id", "source_section", "extractor")
        return {**{c: t[c] for c in same}, "form": F.lit("object")}, [("subject", end(t["subject"])), ("object", end(t["object"]))]

    same = ("passage_id", "paper_id", "n_triples", "cost_usd", "latency_ms", "run_at")
    record = {**{c: F.col(c) for c in same}, "section": F.col("section_name"), "origin": F.col("extractor")}
    return _visit(results, "results", record, parts, F.col("errors"))


def emit_gold(gold: DataFrame) -> DataFrame:
    """Tagged emission of ``gold`` (flat endpoint fields)."""

    def parts(t: Column):
        def end(role: str):
            kind, name, span = (t[f"{role}_{f}"] for f in ("type", "name", "span"))
            return kind.isNotNull() | name.isNotNull() | span.isNotNull(), {"type": kind, "name": name, **_span(span)}

        same = ("relation", "evidence", "confidence", "note")
        return {**{c: t[c] for c in same}, "form": F.lit("fields")}, [("subject", end("subject")), ("object", end("object"))]

    same = ("passage_id", "paper_id", "section", "status", "note", "passage_text", "source_doi", "source_title", "source_license", "source_url")
    return _visit(gold, "gold", {**{c: F.col(c) for c in same}, "origin": F.col("annotator"), "run_at": F.col("annotated_at")}, parts)


# -- raw JSON lines --

_SCALAR = json.JSONDecoder().scan_once


def _parse_deep(text: str) -> object:
    """JSON nested too deeply for the recursive decoder, by a stack of open containers."""
    root: list = []
    stack: list[tuple[list | dict, list]] = [(root, [])]  # (container, the key that waits for its value)
    i, n, ready = 0, len(text), True  # ready: a value may come

    def skip(i: int) -> int:
        while i < n and text[i] in " \t\n\r":
            i += 1
        return i

    def put(value: object) -> None:
        holder, keys = stack[-1]
        if isinstance(holder, dict):
            holder[keys.pop()] = value
        else:
            holder.append(value)

    while True:
        i = skip(i)
        if i >= n:
            break
        c = text[i]
        holder, keys = stack[-1]
        if c in "]}":
            if len(stack) == 1 or (c == "}") != isinstance(holder, dict) or keys or (ready and holder):
                raise ValueError("unexpected bracket")
            stack.pop()
            i, ready = i + 1, False
        elif c == ",":
            if ready or len(stack) == 1:
                raise ValueError("unexpected comma")
            i, ready = i + 1, True
        elif not ready:
            raise ValueError("missing comma")
        elif isinstance(holder, dict) and not keys:
            if c != '"':
                raise ValueError("missing key")
            key, i = scanstring(text, i + 1, True)
            i = skip(i)
            if text[i : i + 1] != ":":
                raise ValueError("missing colon")
            keys.append(key)
            i += 1
        elif c in "[{":
            inner: list | dict = [] if c == "[" else {}
            put(inner)
            stack.append((inner, []))
            i += 1
        else:
            try:
                value, i = _SCALAR(text, i)
            except StopIteration:
                raise ValueError("no value") from None
            put(value)
            ready = False
    if len(stack) > 1 or len(root) != 1:
        raise ValueError("incomplete")
    return root[0]


def parse_json(text: str) -> object:
    """``json.loads`` for any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return _parse_deep(text)


def dump_json(value: object) -> str:
    """Compact JSON for any depth."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[bool, object]] = [(False, value)]  # (literal text?, value)
    while todo:
        literal, v = todo.pop()
        if literal:
            out.append(v)
        elif isinstance(v, dict):
            parts = [x for k, w in v.items() for x in ((True, ","), (True, json.dumps(k, ensure_ascii=False) + ":"), (False, w))][1:]
            todo += reversed([(True, "{"), *parts, (True, "}")])
        elif isinstance(v, list):
            parts = [x for w in v for x in ((True, ","), (False, w))][1:]
            todo += reversed([(True, "["), *parts, (True, "]")])
        else:
            out.append(json.dumps(v, ensure_ascii=False))
    return "".join(out)


def _text(v: object) -> str | None:
    """A payload value as text; whatever is not a string keeps its JSON form."""
    return v if v is None or isinstance(v, str) else dump_json(v)


def _number(v: object, kind: type) -> object:
    """A number, or a text that states one; else None (the field is then kept as an unknown one)."""
    try:
        return kind(v) if isinstance(v, (int, float, str)) and not isinstance(v, bool) else None
    except (ValueError, OverflowError):
        return None


def _small(v: object) -> int | None:
    n = _number(v, int)
    return n if n is not None and -(1 << 31) <= n < 1 << 31 else None


#: Known fields of raw records: (field of the flat table, names it goes by, reader).
_RECORD = (
    ("passage_id", ("passage_id",), _text), ("paper_id", ("paper_id",), _text), ("section", ("section", "section_name"), _text), ("origin", ("extractor", "annotator"), _text),
    ("status", ("status",), _text), ("n_triples", ("n_triples",), _small), ("cost_usd", ("cost_usd",), lambda v: _number(v, float)), ("latency_ms", ("latency_ms",), lambda v: _number(v, float)),
    ("run_at", ("run_at", "annotated_at"), _text), ("note", ("note",), _text), ("passage_text", ("passage_text",), _text), ("source_doi", ("source_doi",), _text), ("source_title", ("source_title",), _text),
    ("source_license", ("source_license",), _text), ("source_url", ("source_url",), _text),
)
_TRIPLE = tuple((f, (f,), _text) for f in SCHEMAS["triple"] if f != "form")


def _known(owner: dict, fields: tuple) -> tuple[dict, set[str]]:
    """(known fields of ``owner``, the names read): each field is read from the first of its names that states it."""
    out, read = {}, set()
    for field, names, reader in fields:
        for name in names:
            if name in owner:
                out[field] = reader(owner[name])
                if out[field] is not None or owner[name] is None:
                    read.add(name)
                break
    return out, read


def _endpoint(owner: dict, role: str, inherited: object = None) -> tuple[dict | None, dict, set[str]]:
    """(entity fields or None, unknown fields of the endpoint, names of ``owner`` that were read)."""
    if role in owner or inherited is not None:
        end, read = owner.get(role, inherited), {role}
        if isinstance(end, str):
            end = {"name": end}
        if end is None and f"{role}_name" in owner:
            end, read = None, set()
        elif not isinstance(end, dict):
            return None, {}, read if end is None else set()
    else:
        end, read = None, set()
    if end is None:
        names = {f"{role}_{f}": f for f in ("type", "name", "span")}
        end = {f: owner[n] for n, f in names.items() if n in owner}
        read = {role, *names}
        if all(v is None for v in end.values()):
            return None, {}, read
    span = end.get("span")
    pair = isinstance(span, list) and len(span) == 2
    start, stop = map(_small, span) if pair else (None, None)
    name = end.get("name")
    known = {"role": role, "type": _text(end.get("type")), "name": name if isinstance(name, str) else None, "span_start": start, "span_end": stop}
    rest = {k: v for k, v in end.items() if k not in ("type", "name", "span")}
    if name is not None and not isinstance(name, str):
        rest["name"] = name
    if span is not None and (start is None or stop is None):
        rest["span"] = span
    return known, rest, read


def _stated(triples: object) -> tuple[list[tuple[dict | None, dict]], dict]:
    """([(triple or None, what it inherits from its group)] in reading order, one per stated relation; what else ``triples`` states)."""
    rest: dict = {}
    if isinstance(triples, str):
        try:
            triples = parse_json(triples)
        except ValueError:
            return [], {"triples": triples}
    if isinstance(triples, dict):
        if isinstance(triples.get("items"), list):
            rest = {f"triples.{k}": v for k, v in triples.items() if k != "items"}
            triples = triples["items"]
        else:
            triples = [triples] if triples else []
    if not isinstance(triples, list):
        return [], {} if triples is None else {"triples": triples}
    out: list[tuple[dict | None, dict]] = []
    for i, item in enumerate(triples):
        if not isinstance(item, dict):
            if item is not None:
                rest[f"triples.{i}"] = item
            out.append((None, {}))
        elif isinstance(item.get("relations"), list):
            shared = {k: v for k, v in item.items() if k != "relations"}
            for j, relation in enumerate(item["relations"]):
                if not isinstance(relation, dict) and relation is not None:
                    rest[f"triples.{i}.relations.{j}"] = relation
                out.append((relation, shared) if isinstance(relation, dict) else (None, {}))
        else:
            out.append((item, {}))
    return out, rest


def visit_line(line_no: int, payload: str | None) -> Iterator[tuple]:
    """Depth-first visit of one raw JSON line; yields (tag, key, parent key, ordinal, fields)."""
    try:
        record = parse_json(payload) if payload else None
    except ValueError:
        return
    if not isinstance(record, dict):
        return

    def unknown(owner: str, key: str, fields: dict) -> Iterator[tuple]:
        for n, (name, value) in enumerate(fields.items()):
            yield "field", f"{key}:field:{n}", key, n, {"owner": owner, "name": name, "value": dump_json(value)}

    key = f"raw_lines:{line_no}"
    known, read = _known(record, _RECORD)
    yield "record", key, None, 0, known
    errors = record.get("errors")
    if isinstance(errors, list) or errors is None:
        read.add("errors")
        for n, e in enumerate(errors or ()):
            yield "error", f"{key}:error:{n}", key, n, {"message": _text(e)}
    stated, rest = _stated(record.get("triples"))
    yield from unknown("record", key, {k: v for k, v in record.items() if k not in read and k != "triples"} | rest)
    for ix, (own, shared) in enumerate(stated):
        if own is None:
            continue
        tkey = f"{key}:{ix}"
        triple = {k: v for k, v in shared.items() if k != "subject"} | own
        inherited = shared.get("subject")
        known, read = _known(triple, _TRIPLE)
        form = "group" if shared else "fields" if "subject_name" in triple or "object_name" in triple else "object"
        yield "triple", tkey, key, ix, known | {"form": form}
        ends = [_endpoint(triple, "subject", inherited), _endpoint(triple, "object")]
        gone = read.union(*(e[2] for e in ends))
        yield from unknown("triple", tkey, {k: v for k, v in triple.items() if k not in gone})
        for n, (role, (end, more, _)) in enumerate(zip(("subject", "object"), ends, strict=True)):
            if end:
                yield "entity", f"{tkey}:{role}", tkey, n, end
                yield from unknown("entity", f"{tkey}:{role}", more)


def _visit_batches(schema: pa.Schema):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"tag": tag, "key": key, "parent_key": parent, "src": "raw_lines", "line_no": no, "ordinal": ordinal, "payload": {tag: fields}}
                for no, text in zip(batch["line_no"].to_pylist(), batch["payload"].to_pylist(), strict=True)
                for tag, key, parent, ordinal, fields in visit_line(no, text)
            ]
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return visit


def emit_raw(raw_lines: DataFrame) -> DataFrame:
    """Tagged emission of raw JSON lines of either file, in whatever shape they were written."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(EMISSION))
    return raw_lines.select(F.col("line_no").cast("bigint").alias("line_no"), "payload").mapInArrow(_visit_batches(schema), EMISSION)


def emit_all(results: DataFrame, gold: DataFrame, raw_lines: DataFrame) -> DataFrame:
    return emit_results(results).unionByName(emit_gold(gold)).unionByName(emit_raw(raw_lines))


def write_tagged(emission: DataFrame, path: str | None = None) -> str:
    """Write the emission once, partitioned by tag; returns the folder."""
    path = path or shared_path(emission.sparkSession, "flat")
    emission.write.mode("overwrite").partitionBy("tag").parquet(path)
    return path


def apply_schema(emission: DataFrame, tag: str) -> DataFrame:
    """The flat table of ``tag``: links as columns, then the fields of its payload."""
    links = ["src", "line_no", "key", "parent_key"]
    if tag != "record":
        links.append("ordinal")
    rows = emission.where(F.col("tag") == tag)
    fields = [F.col(f"payload.{tag}.{name}").alias(name) for name in SCHEMAS[tag]]
    if tag == "entity":
        fields.insert(0, F.element_at(F.split("key", ":"), 3).cast("int").alias("triple_ix"))
    return rows.select(*links, *fields)


def read_flat(spark, path: str, tag: str) -> DataFrame:
    """One partition of a written emission, with its schema applied."""
    rows = spark.read.schema(EMISSION).parquet(path)
    return apply_schema(rows, tag)


def endpoints(emission: DataFrame) -> DataFrame:
    """(src, line_no, triple_ix, role) of every endpoint with a non-blank name; distinct, as every row has its own line_no."""
    path = write_tagged(emission)
    named = read_flat(emission.sparkSession, path, "entity").where(F.col("name").rlike(NON_BLANK))
    return named.select("src", "line_no", "triple_ix", "role")
