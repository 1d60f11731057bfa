"""Look-alike folding: one spelling for text that looks the same.

``LOOKALIKES`` maps a code point to what it looks like. It is built by rule from the Unicode database
(compatibility forms except super- and subscripts, spaces, invisible characters) plus the short list of
letters of other scripts below. Letter case, super- and subscripts, accents and dashes of visible length stay.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

#: Letters of other scripts drawn like a Latin letter.
HOMOGLYPHS = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s",
    "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    # Armenian, Latin extensions
    "օ": "o", "Ս": "U", "Օ": "O", "ɡ": "g", "ɑ": "a", "ꓳ": "O",
    # hyphens of the same length
    "‐": "-", "‑": "-", "⁃": "-", "µ": "μ",
}
_SCRIPTS = ("<super>", "<sub>")


@cache
def lookalikes() -> dict[int, str]:
    """Code point -> plain spelling, by rule over the Unicode database."""
    out: dict[int, str] = {}
    for cp in [*range(0x80, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1F252), *range(0x2F800, 0x2FA1E)]:
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Mn") and (kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or cp == 0x034F):
            out[cp] = ""
        elif kind in ("Zs", "Zl", "Zp"):
            out[cp] = " "
        elif kind not in ("Cn", "Cs", "Co"):
            form = unicodedata.decomposition(ch)
            if form and not form.startswith(_SCRIPTS):
                plain = unicodedata.normalize("NFKC", ch).replace("⁄", "/")
                if plain != ch and not (plain[0] == " " and kind != "Zs"):
                    out[cp] = "".join(HOMOGLYPHS.get(c, c) for c in plain)
    out |= {ord(k): v for k, v in HOMOGLYPHS.items()}
    out |= {cp: "" for cp in (0x115F, 0x1160, 0x3164, 0xFFA0)}
    return out


def fold_lookalikes(text: str) -> str:
    """``text`` in its one consistent form (Python side; ASCII passes through untouched)."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(lookalikes()))


_SCRIPT_DIGITS = {ord(c): unicodedata.normalize("NFKC", c) for c in "⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉⁺₊⁽⁾₍₎"} | {ord(c): "-" for c in "⁻₋−–—―‒"}
_TEN_POWER = re.compile("10([⁰¹²³⁴⁵⁶⁷⁸⁹⁻]+)")
_SPACES = re.compile(r"\s+")


def plain_text(text: str) -> str:
    """Folded further for parsing: digits for super- and subscripts, one kind of dash, single spaces."""
    if not text.isascii():
        text = fold_lookalikes(_TEN_POWER.sub(r"10^\1", text)).translate(_SCRIPT_DIGITS)
    return _SPACES.sub(" ", text).strip()
