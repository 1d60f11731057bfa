"""The identity rule as DuckDB SQL, generated from the same fixed values."""

from __future__ import annotations

import unicodedata
from functools import cache

from passagekg.functions import text as t


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def _compat() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility characters: one-to-one pairs for translate(), longer ones for replace()."""
    single, many = [], []
    for cp in [*range(0xA0, 0x2C00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800), 0x3000]:
        ch = chr(cp)
        plain = unicodedata.normalize("NFKC", ch)
        if plain != ch and unicodedata.normalize("NFC", ch) == ch or ch in "KÅ":
            if len(plain) == 1:
                single.append((ch, plain))
            elif cp in range(0x2150, 0x2190) or cp in range(0xFB00, 0xFB07) or cp in (0x2103, 0x2109, 0x2026):
                many.append((ch, plain))
    return "".join(a for a, _ in single), "".join(b for _, b in single), tuple(many)


def fold(x: str) -> str:
    a, b, many = _compat()
    x = f"translate({x}, {lit(a)}, {lit(b)})"
    for ch, plain in many:
        x = f"replace({x}, {lit(ch)}, {lit(plain)})"
    x = f"lower(strip_accents(replace({x}, '°', ' degrees ')))"
    return f"coalesce(trim(regexp_replace({x}, '[\\s\\x{{b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g')), '')"


def _map() -> str:
    return "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in t.SYNONYMS.items()) + "}"


def _syn(x: str) -> str:
    return f"({_map()}[{x}])"


def _bare(x: str) -> str:
    return f"trim(regexp_replace({x}, {lit(t.PUNCTUATION)}, ' ', 'g'))"


def keyed(source: str, kind: str, name: str, key: str) -> str:
    """SELECT that adds ``key`` (F5) to the rows of ``source``."""
    dry = f"trim(regexp_replace(_f, {lit('(?i)' + t.HYDRATE)}, '', 'g'))"
    cond = "_f"
    for p, u in t.CONDITION_UNITS:
        edge = t.WORD.replace("[", "[^")
        cond = f"regexp_replace({cond}, {lit(f'(^|{edge}){p}($|{edge})')}, {lit(chr(92) + '1' + u + chr(92) + '2')}, 'g')"
    halves = f"list_concat([trim(regexp_replace(_b, {lit(t.PARENTHETICAL)}, ' ', 'g'))], regexp_extract_all(_b, {lit(t.PARENTHETICAL)}, 1))"
    known = f"list_filter(list_transform({halves}, lambda h: coalesce({_syn('trim(h)')}, {_syn(_bare('h'))})), lambda k: k IS NOT NULL)"
    chem = f"CASE WHEN _f = '' THEN '' ELSE coalesce({_syn(_bare('_b'))}, CASE WHEN contains(_b, '(') THEN ({known})[1] END, _b) END"
    mof = f"CASE WHEN regexp_matches(_f, {lit(t.FRAMEWORK)}) THEN trim(regexp_replace(_f, {lit(t.FRAMEWORK)}, '\\1-\\2\\3')) ELSE _f END"
    return f"""
    SELECT * EXCLUDE (_f, _d, _b), CASE WHEN {kind} = 'MOF' THEN {mof} WHEN {kind} = 'Condition' THEN trim(regexp_replace({cond}, ' +', ' ', 'g')) ELSE {chem} END AS {key}
    FROM (SELECT *, coalesce({_syn('_d')}, _d) AS _b FROM (SELECT *, {dry} AS _d FROM (SELECT *, {fold(name)} AS _f FROM {source})))"""
