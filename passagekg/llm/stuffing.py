"""Problem 9: keyword-stuffed pages, link lists, navigation and product tags.

A text is cut into blocks (a line of writing is one, the lines between two such lines are one), a block into a sequence
of terms, in which every link and every hash sign is one mark. Blocks are judged by the statistics of that sequence:

* term recurrence gaps: the share of terms met again within ``LAG`` places;
* positional autocorrelation: the share of places whose term equals the term l places before, counted for every
  lag 1..``LAG`` and for the ``LONG_LAGS`` most frequent longer recurrence gaps (a longer period piles up there);
* the share of function words (writing has them in any language, lists have not) and how few different ones make it up;
* recurrence gaps of the marks: a link or hash sign at least every ``LINK_TERMS`` terms;
* lists of different terms: almost no function words and no sentences, whether or not anything recurs.

Lists that people write keep their layout and are left alone: bibliographies, tables of numbers, glossaries (lines
``name: text`` with different names), contents, numbered steps.

Defined results: null and blank texts are not flagged; a block of fewer than ``LEAST_TERMS`` terms has no statistics and
counts neither way (a heading, a caption), so a text of nothing else is not flagged; repeated rows are judged alike; very long texts are judged whole (the recurrence pass is linear).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAG = 48
LONG_LAGS = 8
SHARE = 0.5
#: Below ``FEW`` function words per term a block is a list; below ``SOME`` it is one if its terms recur regularly.
FEW, SOME = 0.085, 0.17
#: Share of recurring terms from which repetition is unnatural.
RECURRENCE = 0.62
AUTOCORRELATION = 0.22
LEAST_TERMS = 8
#: Terms from which a block without function words, sentences or honest layout is a keyword list, and the terms a sentence has.
LIST_TERMS, SENTENCE_TERMS = 24, (5.5, 40)
#: Terms to a link or hash sign up to which their recurrence makes a block a list of them.
LINK_TERMS = 10
#: Terms in a window of a long line, and the share of function words from which a line is surely writing throughout.
WINDOW, SPARSE = 40, 0.24
#: Different function words from which a block counts as writing even if its terms recur.
WORDS_OF_WRITING = 4

#: Function words of English, German, French and Spanish, and function characters of Chinese.
FUNCTION_WORDS = frozenset(
    """the of and to in a is was for with on at by from that as are were be been it its this which or an not but than then so if these those there their his her our we i you he she they
    has have had do does did can could may might will would should must who what when where why because although while since until after before between within without under over about into through
    during against among also only any some no nor such both each other another here however please my your use per beyond above below across upon towards was
    der die das den dem des und in von zu mit ist im für auf ein eine einer einem einen wurde wurden nicht sich als auch bei nach aus dass wird werden war sind zur zum durch über unter ob was noch danach
    le la les de du des et à un une est dans pour par sur en que qui ne pas au aux il elle ce cette ces sont été a plus soit puis avec se son sa ses on l d après ensuite ont nous leur lors comme
    el los las y en que del una un con por se lo su sus para es al como más fue son ha durante según hasta""".split()
)
FUNCTION_CHARACTERS = frozenset("的了在是与将该后仍于经下中和为其及而并被由以至从则但或把上前时间")

#: Marks that stand for a link and for a hash sign in the sequence of terms.
LINK, TAG = "\x01", "\x02"
_TERM = re.compile(r"[^\W\d_]+|[\x01\x02]")
_NUMBERS = re.compile(r"\d+(?:[.,]\d+)*")
_LINK = re.compile(r"https?://(?!doi\.|dx\.doi|[^\s/]*/10\.\d{4})[^\s)\]>\"']+|<a\s[^>]*>|\]\([^)]*\)|\b(?:[a-z0-9][a-z0-9-]*\.)+(?:com|net|org|info|biz|shop|store|online|io|co|cn|de|ru|example|test|invalid)\b(?:/[^\s)\]>\"']*)?", re.I)
_TAG = re.compile(r"(?:^|(?<=\s))#(?=\w)")
_CITED = re.compile(r"^ ?\[?\d+[\].)] .*(?:\b(?:19|20)\d\d\b|doi)", re.I)
_NAMED = re.compile(r"^([^:|#]{1,60}): [^:]{1,200}$")
_ENTRY = re.compile(r"\.{3,} ?\d+ ?$|^\d+[.)] +\w[^.]*\.$|^\d+(?:\.\d+)* +\w.*\.{2,}")
_SENTENCE_END = re.compile(r"[.!?](?=\s|$)|[。！？]")
_ITEM = re.compile(r"[.,;:|•›»★!?>\n\t]+| - |  +")


def terms(text: str) -> tuple[list[str], int, int]:
    """Lower-case terms (Han characters singly, links and hash signs as marks); how many are function words, and how many different ones."""
    if "." in text or "](" in text or "<" in text:
        text = _LINK.sub(f" {LINK} ", text.replace("</a>", " "))
    if "#" in text:
        text = _TAG.sub(f"{TAG} ", text)
    found = _TERM.findall(text.lower())
    kinds = len(FUNCTION_WORDS.intersection(found))
    if text.isascii():
        return found, sum(map(FUNCTION_WORDS.__contains__, found)) if kinds else 0, kinds
    out: list[str] = []
    function = 0
    for w in found:
        if "㐀" <= w[-1] <= "鿿" or "㐀" <= w[0] <= "鿿":
            out += w
            function += sum(map(FUNCTION_CHARACTERS.__contains__, w)) * 2
        else:
            out.append(w)
            function += w in FUNCTION_WORDS
    return out, function, kinds + len(FUNCTION_CHARACTERS.intersection(out))


def recurrence(found: list[str], lag: int = LAG) -> tuple[float, float]:
    """(share of terms met again within ``lag`` places, highest positional autocorrelation over the lags)."""
    n = len(found)
    codes: dict[str, int] = {}
    x = np.array([codes.setdefault(w, len(codes)) for w in found], dtype=np.int32)
    order = np.argsort(x, kind="stable")
    gaps = np.diff(order)[x[order][1:] == x[order][:-1]]  # places between a term and its next copy
    near = int((gaps <= lag).sum())
    far, times = np.unique(gaps[gaps > lag], return_counts=True)
    lags = [*range(1, min(lag, n - 1) + 1), *far[np.argsort(-times, kind="stable")[:LONG_LAGS]].tolist()]
    return near / n, max((int(np.count_nonzero(x[g:] == x[:-g])) for g in lags), default=0) / n


def is_writing(line: str, n: int, function: int, kinds: int) -> bool:
    return kinds >= WORDS_OF_WRITING and function >= SOME * n and "/" not in line and "|" not in line


def writing_window(window: list[str]) -> bool:
    inside = [w for w in window if w in FUNCTION_WORDS or w in FUNCTION_CHARACTERS]
    return len(inside) >= SOME * len(window) and len(set(inside)) >= WORDS_OF_WRITING


def few_kinds(found: list[str]) -> int:
    """How many different function words make up most of the function words of a block."""
    counts = sorted(Counter(w for w in found if w in FUNCTION_WORDS or w in FUNCTION_CHARACTERS).values(), reverse=True)
    need, kinds = 0.75 * sum(counts), 0
    for c in counts:
        if need <= 0:
            break
        need -= c
        kinds += 1
    return kinds


def keyword_list(lines: list[str], n: int) -> bool:
    """Whether ``n`` terms without function words are a bare list: no sentences (of a language without fixed words), no amount on most lines."""
    if n < LIST_TERMS:
        return False
    ends = sum(len(_SENTENCE_END.findall(x)) for x in lines)
    if ends and SENTENCE_TERMS[0] <= n / ends <= SENTENCE_TERMS[1]:
        return False
    return len(lines) < 3 or sum(1 for x in lines if _NUMBERS.search(x)) * 2 < len(lines)


def honest_layout(lines: list[str], marks: int, n: int) -> bool:
    """Whether most lines are references, entries of a glossary or of contents, numbered steps or rows of a table."""
    half = len(lines) / 2
    if sum(1 for x in lines if _CITED.search(x)) >= half:
        return True
    if marks:
        return False
    names = [m[1].lower() for x in lines if (m := _NAMED.match(x))]
    # one name on line after line is a label and not an entry
    entries = len(names) if 2 * len(set(names)) > len(names) else 0
    if entries + sum(1 for x in lines if _ENTRY.search(x) or "\t" in x) >= half:
        return True
    return sum(len(_NUMBERS.findall(x)) for x in lines) > n


def stuffed(lines: list[str], found: list[str], function: int, kinds: int) -> bool | None:
    """Whether a block is stuffing; None when it says nothing either way (a heading, a few terms)."""
    if not found:
        return None
    body = "\n".join(lines)
    n = len(found)
    share = function / n
    marks = sum(w in (LINK, TAG) for w in found)
    if honest_layout(lines, marks, n):
        return False
    if marks and n <= LINK_TERMS * marks:
        return True
    if n < LEAST_TERMS:
        return None
    if share >= SOME and kinds >= WORDS_OF_WRITING:
        return False
    near, regular = recurrence(found)
    if share < FEW:
        return near >= RECURRENCE * 0.4 or regular >= AUTOCORRELATION / 2 or keyword_list(lines, n)
    items = sum(1 for x in _ITEM.split(body) if len(x) > 1)
    if n >= 24 and few_kinds(found) <= 2 and (n < 5.5 * items or n >= 60 and near >= 1.25 * RECURRENCE):
        return near >= RECURRENCE * 0.8
    if share < SOME * 0.8 and n < 3.5 * items:
        return near >= RECURRENCE / 2 or keyword_list(lines, n)
    return share < SOME and n < 5.5 * items and (near >= RECURRENCE or regular >= AUTOCORRELATION and near >= RECURRENCE * 0.8)


def stuffing_share(text: str | None) -> float:
    """Share of a text's characters in blocks of stuffing (of those that say something either way).

    A line that is writing is a block of its own; the lines between two such lines form one block.
    """
    if not text:
        return 0.0
    bad = good = 0
    run: list[str] = []
    found: list[str] = []
    function = 0
    for line in [*text.split("\n"), None]:
        if line is not None:
            line = line.strip()
            if not line:
                continue
            words, n_function, kinds = terms(line)
            n = len(words)
            if n > 2 * WINDOW and n_function < SPARSE * n and not _LINK.search(line):
                # a long line may hold writing and stuffing side by side: its windows are judged
                rest: list[str] = []
                for i in range(0, n, WINDOW):
                    window = words[i : i + WINDOW]
                    size = len(line) * len(window) / n
                    if writing_window(window):
                        good += size
                    else:
                        rest += window
                if len(rest) < n:
                    rest_function = sum(w in FUNCTION_WORDS or w in FUNCTION_CHARACTERS for w in rest)
                    verdict = stuffed([" ".join(rest)], rest, rest_function, len(FUNCTION_WORDS.intersection(rest))) if rest else None
                    bad += len(line) * len(rest) / n if verdict else 0
                    good += len(line) * len(rest) / n if verdict is False else 0
                    continue
            if not is_writing(line, n, n_function, kinds):
                run.append(line)
                found += words
                function += n_function
                continue
            good += len(line)
        if run:
            kinds = len(FUNCTION_WORDS.intersection(found)) + len(FUNCTION_CHARACTERS.intersection(found))
            verdict = stuffed(run, found, function, kinds)
            size = sum(map(len, run))
            bad += size if verdict else 0
            good += size if verdict is False else 0
            run, found, function = [], [], 0
    return bad / (bad + good) if bad else 0.0


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, stuffing): share of stuffing of every document."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "stuffing": [stuffing_share(t) for t in batch["text"]]})

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, stuffing double")


def flagged(documents: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id of every document that is wholly or mostly stuffing, distinct."""
    return scores(documents).where(F.col("stuffing") > share).select("doc_id").distinct()
