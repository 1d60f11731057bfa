"""Problem 3: oversized paragraphs -> pieces under a limit, cut at natural boundaries, with a fixed overlap.

Texts are processed in ranges of ``RANGE`` code points with halos, never as a whole:

1. each range reports its *fragments*: newline-free runs that touch a range edge or are oversized by themselves;
2. the fragment table is stitched (a running sum of paragraph starts per text, over at most two rows a range), which
   gives every oversized paragraph with its trimmed offsets;
3. each (range, oversized paragraph) pair emits its pieces, offsets and text, from the range's own chunk. Where a paragraph
   crosses into a range, the cut nearest the range start is fixed by the range's own text, so neighbouring ranges
   agree without talking. A paragraph inside one range gives its pieces in the pass that finds it; only those that
   cross a range edge take the second pass. Pieces are numbered by a prefix sum of the ranges' counts, so no text is
   ever joined back.

``stored_sections`` lays texts out as a few large files on the shared folder with a table of their byte offsets, and
``file_ranges`` reads byte ranges of such files by seeking: a file, or a section in it, may be larger than any
task's memory. ``section_ranges`` is the same for texts that are small enough to be cells of a table.

Defined results: null and empty texts and paragraphs within the limit give nothing; a paragraph without any natural
boundary is cut at the limit; repeated texts of one key give their pieces once; papers without id give no pieces; offsets count
code points from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from passagekg.runtime import shared_path, stage_table

LIMIT, OVERLAP = 2_500, 200
RANGE = 65_536
#: Characters of context on either side of a range; at least LIMIT, so a seam can be sought on both sides.
HALO = LIMIT + 64
#: Stretch after a range start in which the seam is sought.
SEEK = LIMIT - 2 * OVERLAP

_SENTENCE = re.compile(r"[.!?。！？][\"')\]’”]*\s+|[。！？]")
_CLAUSE = re.compile(r"[;:,，；、]\s*")
_SPACE = re.compile(r"\s+")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:e\.g|i\.e|approx|ca|cf|Fig|Figs|Eq|Eqs|Ref|Refs|No|vs|al|wt|vol|Dr|Prof|resp|etc|St|[A-Z])\.\s*$")


def section_ranges(papers: DataFrame) -> DataFrame:
    """(paper_id, section_ix, text_id, base, lead, own, total, chunk): one row per range of every section text.

    Copies of a paper are not removed here, which would shuffle all texts: their fragments and pieces are equal
    rows, and those few are made distinct.
    """
    s = papers.select("paper_id", F.posexplode("sections").alias("section_ix", "s")).select("paper_id", "section_ix", F.col("s.text").alias("text"))
    s = s.where("length(text) > 0").withColumn("text_id", F.xxhash64("text")).withColumn("total", F.length("text"))
    r = s.withColumn("base", F.explode(F.sequence(F.lit(0), F.col("total") - 1, F.lit(RANGE))))
    lead = F.least(F.col("base"), F.lit(HALO))
    return r.select(
        "paper_id", "section_ix", "text_id", F.col("base").cast("bigint").alias("base"), lead.cast("int").alias("lead"), F.least(F.lit(RANGE), F.col("total") - F.col("base")).cast("int").alias("own"),
        F.col("total").cast("bigint").alias("total"), F.substring(F.col("text"), F.col("base") - lead + 1, lead + F.lit(RANGE + HALO)).alias("chunk"),
    )


def file_ranges(spark: SparkSession, path: str, byte_range: int = 1 << 18) -> DataFrame:
    """:func:`ranges_of` every text file under ``path``."""
    return ranges_of(spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc"), "length"), byte_range)  # content is pruned


def ranges_of(files: DataFrame, byte_range: int = 1 << 18) -> DataFrame:
    """The ranges of text files (doc, length; UTF-8), read by seeking; no file is ever read as a whole.

    Columns: doc, base, lead, own, total, chunk. Code point offsets are prefix sums of the ranges' counts.
    """
    cuts = files.where("length > 0").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(byte_range))))
    counted = cuts.repartition(F.col("doc"), F.col("at")).mapInPandas(_reader(byte_range, False), "doc string, at bigint, length bigint, own int")
    w = Window.partitionBy("doc").orderBy("at")
    based = counted.withColumn("base", F.coalesce(F.sum("own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "total", F.sum("own").over(Window.partitionBy("doc"))
    )
    return based.repartition(F.col("doc"), F.col("at")).mapInPandas(_reader(byte_range, True), "doc string, base bigint, lead int, own int, total bigint, chunk string")


def _reader(byte_range: int, with_text: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def starts(blob: bytes, i: int) -> int:
            while i < len(blob) and blob[i] & 0xC0 == 0x80:
                i += 1
            return i

        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                system, name = _open(row.doc)
                pad = 4 * HALO if with_text else 4
                lo, hi = max(0, row.at - pad), min(row.length, row.at + byte_range + pad)
                with system.open_input_file(name) as f:
                    f.seek(lo)
                    blob = f.read(hi - lo)
                a, b = starts(blob, row.at - lo), starts(blob, min(row.at + byte_range, row.length) - lo)
                own = blob[a:b].decode("utf-8", "replace")
                if not with_text:
                    rows.append((row.doc, row.at, row.length, len(own)))
                    continue
                before = blob[starts(blob, 0) if lo else 0 : a].decode("utf-8", "replace")[-HALO:]
                after = blob[b:].decode("utf-8", "ignore")[:HALO]
                rows.append((row.doc, row.base, len(before), len(own), row.total, before + own + after))
            yield pd.DataFrame(rows, columns=["doc", "base", "lead", "own", "total", "chunk"] if with_text else ["doc", "at", "length", "own"])

    return read


def range_fragments(base: int, lead: int, own: int, total: int, chunk: str, limit: int = LIMIT) -> Iterator[tuple[int, bool, int | None, int | None]]:
    """(start, continues, first, last) of the newline-free runs that matter beyond this range.

    ``continues``: the run goes on from the range before; ``first``/``last``: offsets of its trimmed text, or None.
    """
    end = lead + own
    at = lead
    while at <= end:
        stop = chunk.find("\n", at, end)
        edge = stop < 0
        stop = end if edge else stop
        continues = at == lead and base > 0 and chunk[lead - 1] != "\n"
        goes_on = edge and base + own < total and chunk[end : end + 1] != "\n"
        if stop > at and (continues or goes_on or stop - at > limit):
            run = chunk[at:stop]
            body = run.strip()
            if body:
                first = base - lead + at + len(run) - len(run.lstrip())
                if continues or goes_on or len(body) > limit:
                    yield base - lead + at, continues, first, first + len(body)
            else:
                yield base - lead + at, continues, None, None
        if edge:
            break
        at = stop + 1


def stitched(fragments: DataFrame, keys: list[str], limit: int = LIMIT) -> DataFrame:
    """(*keys, para_start, para_end) of every paragraph of more than ``limit`` code points, trimmed, from its fragments."""
    order = Window.partitionBy(*keys).orderBy("start")
    held = fragments.select(*keys, "start", "continues", "first", "last").distinct()
    numbered = held.withColumn("para", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(order))
    whole = numbered.groupBy(*keys, "para").agg(F.min("first").alias("para_start"), F.max("last").alias("para_end"))
    return whole.where(F.col("para_end") - F.col("para_start") > limit).drop("para")


def best_cut(text: str, lo: int, hi: int) -> int | None:
    """Last natural boundary in (lo, hi] of ``text``: after a sentence, else a clause, else white space."""
    window = text[lo:hi]
    for pattern, veto in ((_SENTENCE, _ABBREVIATION), (_CLAUSE, None), (_SPACE, None)):
        ends = [m.end() for m in pattern.finditer(window) if not (veto and veto.search(window[max(0, m.start() - 12) : m.end()]))]
        if ends:
            return lo + ends[-1]
    return None


def _seam(text: str, at: int, offset: int) -> int:
    """The fixed cut after a range start ``at`` (index into ``text``), as an offset."""
    return (best_cut(text, at, at + SEEK) or at + SEEK) + offset


def range_pieces(base: int, lead: int, own: int, total: int, chunk: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """(char_start, char_end) of this range's pieces of the paragraph start..end (offsets of the text)."""
    shift = base - lead
    first = start if start >= base else min(_seam(chunk[: end - shift], lead, shift), end)
    stop = end
    if end > base + own:
        stop = min(_seam(chunk[: end - shift], lead + own, shift), end)
    if first >= stop:
        return
    at = first  # end of the last piece
    lo = first if first == start else first - OVERLAP
    while at < stop:
        if stop - lo <= LIMIT:
            cut = stop
        else:
            least, middle, most = lo + OVERLAP + 1 - shift, lo + LIMIT // 2 - shift, lo + LIMIT - shift
            cut = (best_cut(chunk, middle, most) or best_cut(chunk, least, middle) or most) + shift
        yield lo, cut
        at, lo = cut, cut - OVERLAP


def _pass(ranges: DataFrame, keys: list[str], with_text: bool) -> DataFrame:
    """One pass over ``ranges``: fragments at range edges (kind 0) and the pieces of paragraphs inside one range (kind 1)."""
    kinds = dict(ranges.dtypes)
    columns = [*keys, "kind", "start", "continues", "first", "last", "char_start", "char_end", "ix", "text"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind int, start bigint, continues boolean, first bigint, last bigint, char_start bigint, char_end bigint, ix bigint, text string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, base, lead, own, total, chunk in zip(batch[keys].itertuples(index=False, name=None), *(batch[c] for c in ("base", "lead", "own", "total", "chunk")), strict=True):
                for start, continues, first, last in range_fragments(base, lead, own, total, chunk):
                    inside = not continues and first is not None and (last < base + own or base + own == total or chunk[lead + own] == "\n")
                    if not inside:
                        rows.append((*key, 0, start, continues, first, last, None, None, None, None))
                        continue
                    shift = base - lead
                    for ix, (a, b) in enumerate(range_pieces(base, lead, own, total, chunk, first, last)):
                        rows.append((*key, 1, None, None, first, last, a, b, ix, chunk[a - shift : b - shift] if with_text else None))
            yield pd.DataFrame(rows, columns=columns).astype(dict.fromkeys(["start", "first", "last", "char_start", "char_end", "ix"], "Int64"))

    return ranges.mapInPandas(work, schema)


def _crossing(ranges: DataFrame, fragments: DataFrame, keys: list[str], with_text: bool) -> DataFrame:
    """Pieces of the oversized paragraphs stitched from ``fragments``: each range cuts its part, counts number them."""
    kinds = dict(ranges.dtypes)
    paras = stitched(fragments, keys)
    near = (F.col("para_start") < F.col("base") + F.col("own")) & (F.col("para_end") > F.col("base"))
    columns = [*keys, "para_start", "base", "char_start", "char_end", "ix", "text"]
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", para_start bigint, base bigint, char_start bigint, char_end bigint, ix bigint, text string"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, base, lead, own, total, chunk, ps, pe in zip(
                batch[keys].itertuples(index=False, name=None), *(batch[c] for c in ("base", "lead", "own", "total", "chunk", "para_start", "para_end")), strict=True
            ):
                shift = base - lead
                rows += [(*key, ps, base, a, b, ix, chunk[a - shift : b - shift] if with_text else None) for ix, (a, b) in enumerate(range_pieces(base, lead, own, total, chunk, ps, pe))]
            yield pd.DataFrame(rows, columns=columns)

    cut = stage_table(ranges.join(paras, keys).where(near).mapInPandas(work, schema), "crossing-pieces")
    counts = cut.groupBy(*keys, "para_start", "base").agg(F.max("ix").alias("most"))
    before = F.sum(F.col("most") + 1).over(Window.partitionBy(*keys, "para_start").orderBy("base").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "para_start", "base", before.alias("before")).where("before > 0")
    numbered = cut.join(offsets, [*keys, "para_start", "base"], "left")
    return numbered.select(*keys, "para_start", (F.col("ix") + F.coalesce("before", F.lit(0))).alias("piece_ix"), "char_start", "char_end", "text")


def pieces(ranges: DataFrame, keys: list[str], with_text: bool = True) -> DataFrame:
    """(*keys, para_start, piece_ix, char_start, char_end, text): the pieces of every paragraph beyond the limit, distinct."""
    seen = stage_table(_pass(ranges, keys, with_text), "range-pass")
    inside = seen.where("kind = 1").select(*keys, F.col("first").alias("para_start"), F.col("ix").alias("piece_ix"), "char_start", "char_end", "text")
    fragments = seen.where("kind = 0")
    if fragments.isEmpty():
        return inside.distinct()
    return inside.unionByName(_crossing(ranges, fragments, keys, with_text)).distinct()


SECTION_KEYS = ["paper_id", "section_ix", "text_id"]
_INT = ("section_ix", "para_start", "piece_ix", "char_start", "char_end")


def oversized(papers: DataFrame) -> DataFrame:
    """(paper_id, section_ix, para_start) of every paragraph beyond the limit, that is of every one that was cut; distinct."""
    cut = pieces(section_ranges(papers), SECTION_KEYS, with_text=False)
    return cut.where("piece_ix = 0").select("paper_id", "section_ix", F.col("para_start").cast("int").alias("para_start")).distinct()


def section_pieces(papers: DataFrame) -> DataFrame:
    """(paper_id, section_ix, para_start, piece_ix, char_start, char_end, text) of all oversized paragraphs."""
    cut = pieces(section_ranges(papers), SECTION_KEYS)
    return cut.select("paper_id", *[F.col(c).cast("int").alias(c) for c in _INT], "text").distinct()


def _open(uri: str):
    """(file system, path) of a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!//)", "file:///", uri) if ":" in uri else "file://" + uri)


def stored_sections(papers: DataFrame, folder: str) -> DataFrame:
    """Write the section texts as one large UTF-8 file per task under ``folder``; returns where each lies: (doc, at, size, paper_id, section_ix).

    ``at`` counts code points, ``size`` the bytes written so far. Sections end with a line break, so paragraphs of a file are those of its sections. A file has
    a fresh name, and only the files of the table returned (which is written) are meant: those of lost tasks are unused.
    """
    rows = papers.select("paper_id", F.posexplode("sections").alias("section_ix", "s")).select("paper_id", "section_ix", F.col("s.text").alias("text")).where("length(text) > 0")
    kind = dict(papers.dtypes)["paper_id"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        doc, at, size, held = f"{folder}/{uuid.uuid4().hex}.txt", 0, 0, []
        system, path = _open(doc)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as f:
            for batch in batches:
                for paper_id, section_ix, text in batch.itertuples(index=False, name=None):
                    blob = (text + "\n").encode("utf-8", "surrogatepass")
                    f.write(blob)
                    size += len(blob)
                    held.append((doc, at, size, paper_id, section_ix))
                    at += len(text) + 1
        yield pd.DataFrame(held, columns=["doc", "at", "size", "paper_id", "section_ix"])

    return stage_table(rows.mapInPandas(write, f"doc string, at bigint, size bigint, paper_id {kind}, section_ix int"), "stored-sections")


def stored_pieces(papers: DataFrame) -> DataFrame:
    """:func:`section_pieces` by byte ranges of the files of :func:`stored_sections`; no file is read as a whole."""
    spark = papers.sparkSession
    folder = shared_path(spark, "sections")
    places = stored_sections(papers, folder)
    if places.isEmpty():
        return section_pieces(papers.limit(0))
    files = places.groupBy("doc").agg(F.max("size").alias("length"))
    cut = pieces(ranges_of(files), ["doc"])
    # the section of a piece is the last one that starts at or before its paragraph
    both = places.select("doc", "at", F.lit(0).alias("kind"), "paper_id", "section_ix", F.lit(None).cast("struct<i:bigint,a:bigint,b:bigint,t:string>").alias("p"), F.col("at").alias("base"))
    asked = cut.select("doc", F.col("para_start").alias("at"), F.lit(1).alias("kind"), F.lit(None).alias("paper_id"), F.lit(None).alias("section_ix"), F.struct(F.col("piece_ix").alias("i"), F.col("char_start").alias("a"), F.col("char_end").alias("b"), F.col("text").alias("t")).alias("p"), F.lit(None).alias("base"))
    last = Window.partitionBy("doc").orderBy("at", "kind")
    placed = both.unionByName(asked).select("at", "kind", "p", *[F.last(c, True).over(last).alias(c) for c in ("paper_id", "section_ix", "base")]).where("kind = 1")
    offset = lambda c: (F.col(c) - F.col("base")).cast("int")
    return placed.select(
        "paper_id", "section_ix", offset("at").alias("para_start"), F.col("p.i").cast("int").alias("piece_ix"), offset("p.a").alias("char_start"), offset("p.b").alias("char_end"), F.col("p.t").alias("text")
    ).distinct()


def coverage(pieces_: DataFrame) -> DataFrame:
    """What the pieces of each paragraph make up: (paper_id, section_ix, para_start, para_end, n_pieces, fits, overlaps, paragraph), the last an MD5 of the text without the overlaps."""
    by = ["paper_id", "section_ix", "para_start"]
    order = Window.partitionBy(*by).orderBy("piece_ix")
    p = pieces_.withColumn("shared", F.lag("char_end").over(order) - F.col("char_start"))
    own = F.when(F.col("shared").isNull(), F.col("text")).otherwise(F.substr("text", F.col("shared") + 1))
    lists = p.groupBy(*by).agg(
        F.max("char_end").alias("para_end"), F.max(F.col("char_end") - F.col("char_start")).alias("longest"), F.min("shared").alias("least"), F.max("shared").alias("most"), F.array_sort(F.collect_list(F.struct("piece_ix", own.alias("own")))).alias("owns")
    )
    whole = F.md5(F.array_join(F.transform("owns", lambda o: o["own"]), ""))
    return lists.select(*by, "para_end", (F.col("longest") <= LIMIT).alias("fits"), ((F.col("least") == OVERLAP) & (F.col("most") == OVERLAP)).alias("overlaps"), whole.alias("paragraph"))
