"""Vocabulary and patterns of the rule extractor. Fixed values, stated plainly."""

from __future__ import annotations

import re

# Vocabulary.
MOF_NAMES = ("HKUST-1", "ZIF-8", "ZIF-67", "UiO-66", "UiO-67", "MOF-5", "MOF-74", "MIL-53", "MIL-100", "MIL-101", "NU-1000", "PCN-222", "IRMOF-1", "CAU-10")
MOF_FAMILIES = ("HKUST", "IRMOF", "UiO", "MOF", "MIL", "ZIF", "PCN", "CAU", "NU")
METAL_SYMBOLS = ("Zn", "Cu", "Zr", "Fe", "Al", "Cr", "Co", "Ni", "Mg", "Ce", "Ti")
ANION_FORMULAS = (r"\(NO3\)", r"\(SO4\)", r"\(CH3COO\)", r"\(CH3CO2\)", r"\(C2H3O2\)", r"\(OAc\)", r"\(ClO4\)", "NO3", "SO4", "Cl", "Br")
METAL_WORDS = (
    "zinc", "copper", "cupric", "zirconium", "zirconyl", "iron", "ferric", "ferrous", "aluminium", "aluminum", "chromium", "chromic", "cobalt", "nickel", "magnesium", "cerium", "ceric",
    "titanium",
)
ANION_WORDS = ("nitrate", "chloride", "sulfate", "sulphate", "acetate", "perchlorate", "oxychloride")
HYDRATE_WORDS = ("monohydrate", "dihydrate", "trihydrate", "tetrahydrate", "pentahydrate", "hexahydrate", "heptahydrate", "octahydrate", "nonahydrate", "decahydrate", "hydrate")
LINKER_NAMES = (
    "benzene-1,3,5-tricarboxylic acid", "1,3,5-benzenetricarboxylic acid", "benzene-1,4-dicarboxylic acid", "1,4-benzenedicarboxylic acid", "2-aminoterephthalic acid",
    "terephthalic acid", "trimesic acid", "isophthalic acid", "fumaric acid", "2-methylimidazole", "2-methyl imidazole", "2-ethylimidazole", "benzimidazole",
)
LINKER_ABBREVIATIONS = ("H2BDC", "H3BTC", "2-MeIM", "HmIM", "MeIM", "mIM", "BDC", "BTC")
SHORTHAND_LINKERS = ("DOBDC", "BPDC", "TCPP", "PZDC", "BTC", "BDC", "BTB", "NDC", "TPA", "ADC", "FUM", "MeIM", "mIM", "IM")
ORGANIC_SOLVENTS = (
    "N,N-dimethylformamide", "N,N-diethylformamide", "N,N-dimethylacetamide", "N-methyl-2-pyrrolidone", "dimethylformamide", "diethylformamide", "dimethylacetamide",
    "dimethyl sulfoxide", "dimethylsulfoxide", "tetrahydrofuran", "acetonitrile", "isopropanol", "2-propanol", "chloroform", "methanol", "ethanol", "acetone", "toluene", "CHCl3",
    "CH3CN", "C2H5OH", "CH3OH", "MeOH", "EtOH", "MeCN", "DMSO", "DMF", "DEF", "DMA", "NMP", "THF", "ACN", "IPA",
)
AQUEOUS_SOLVENTS = ("ultrapure water", "deionized water", "deionised water", "distilled water", "Milli-Q water", "DI water", "water", "H2O")
PROPERTY_TERMS = (
    "Brunauer-Emmett-Teller surface area", "BET specific surface area", "Langmuir surface area", "BET surface area", "specific surface area", "total pore volume", "micropore volume",
    "surface area", "pore volume", "pore diameter", "pore size", "pore width",
)
NO_SPLIT = ("fig", "figs", "eq", "eqs", "tab", "ref", "refs", "no", "ca", "approx", "vs", "cf", "e.g", "i.e", "etc", "al", "dr", "prof", "wt", "vol", "min", "max", "cm", "mm", "mol")
METHODS = {
    "solvothermal": r"solvothermal(?:ly)?|hydro\(solvo\)thermal(?:ly)?",
    "hydrothermal": r"hydrothermal(?:ly)?",
    "microwave-assisted": r"microwave[\s‐-―−-]?(?:assisted|irradiation)",
    "mechanochemical": r"mechanochemical(?:ly)?|ball[\s‐-―−-]?mill(?:ing|ed)",
    "sonochemical": r"sono[\s‐-―−-]?chemical(?:ly)?|ultrasound[\s‐-―−-]?assisted",
    "electrochemical": r"electrochemical(?:ly)?",
    "room-temperature stirring": r"room[\s‐-―−-]temperature\s+(?:stirring|synthes[ie]s)|stirr(?:ed|ing)\s+at\s+room\s+temperature",
    "reflux": r"reflux(?:ing|ed)?",
    "layer-by-layer": r"layer[\s‐-―−-]by[\s‐-―−-]layer",
}
UNITS = (r"m\s*[2²]\s*(?:/|\s)?\s*g(?:\s*[−–-]\s*[1¹])?", r"c(?:m\s*[3³]|c)\s*(?:/|\s)?\s*g(?:\s*[−–-]\s*[1¹])?|mL\s*/\s*g", r"nm|Å|pm")
# Tunables.
HOT_C, WINDOW, MAX_EVIDENCE, VALUE_GAP = 80.0, 2, 500, 60


def _any(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


_DIGIT, _HYPHEN, _SEPARATOR, _NUMBER = r"[0-9₀-₉]", r"[\s‐-―−-]", r"[‐-―−-]?", r"\d+(?:[.,]\d+)?"
_SYMBOL = "|".join(METAL_SYMBOLS)
_SOLVENT = _any(ORGANIC_SOLVENTS + AQUEOUS_SOLVENTS)
_FREE = r"(?<![A-Za-z0-9])"
_I = re.IGNORECASE

# Patterns, in the order in which the finder applies them: (type, kind, pattern).
MENTIONS: tuple[tuple[str, str, re.Pattern[str]], ...] = (
    ("MOF", "", re.compile(rf"{_FREE}(?:(?:{'|'.join(MOF_FAMILIES)}){_SEPARATOR}\d+[A-Za-z]?(?:\([A-Za-z]{{1,3}}\d?\))?|{_any(MOF_NAMES)}|(?:{_SYMBOL}){_HYPHEN}(?:{_any(SHORTHAND_LINKERS)}))(?![A-Za-z0-9])", _I)),
    ("MetalPrecursor", "", re.compile(rf"{_FREE}(?:{_SYMBOL})(?:{'|'.join(ANION_FORMULAS)}){_DIGIT}?(?:\s*[.·‧⋅*x×]\s*\d+(?:\.\d+)?\s*H2O)?(?![a-z])")),
    ("MetalPrecursor", "", re.compile(rf"(?<![A-Za-z])(?:{'|'.join(METAL_WORDS)})(?:\s*\((?:I{{1,3}}|IV|V|VI)\))?\s+(?:{'|'.join(ANION_WORDS)})(?:\s+(?:{'|'.join(HYDRATE_WORDS)}))?(?![A-Za-z])", _I)),
    ("OrganicLinker", "", re.compile(rf"{_FREE}(?:{_any(LINKER_NAMES)})(?![A-Za-z0-9])", _I)),
    ("OrganicLinker", "", re.compile(rf"{_FREE}(?:{_any(LINKER_ABBREVIATIONS)})(?![A-Za-z0-9])", _I)),
    ("OrganicLinker", "general", re.compile(rf"{_FREE}[A-Za-z0-9][A-Za-z0-9,'’()\[\]‐-―−-]*(?:carboxylic\s+acids?|imidazol(?:e|ate)s?)(?![A-Za-z0-9])", _I)),
    ("Solvent", "", re.compile(rf"{_FREE}(?:{_SOLVENT})(?![A-Za-z0-9])", _I)),
    ("SynthesisMethod", "explicit", re.compile(rf"(?<![A-Za-z])(?:{'|'.join(f'(?:{p})' for p in METHODS.values())})(?![A-Za-z])", _I)),
    ("Condition", "temperature", re.compile(rf"{_FREE}{_NUMBER}(?:\s*[‐-―−-]\s*{_NUMBER})?\s*(?:[°º˚]\s*C|℃|degrees?\s*(?:C(?:elsius)?)|deg\.?\s*C)(?![A-Za-z])")),
    ("Condition", "temperature", re.compile(r"(?<![A-Za-z0-9.])\d{2,3}\s+C(?![A-Za-z0-9])")),
    ("Condition", "temperature", re.compile(rf"{_FREE}\d{{2,4}}(?:\.\d+)?\s*K(?![A-Za-z0-9])")),
    ("Condition", "time", re.compile(rf"{_FREE}{_NUMBER}\s*(?:hours?|hrs?|h|minutes?|mins?|min|days?|weeks?)(?![A-Za-z])")),
    ("Condition", "pressure", re.compile(rf"{_FREE}{_NUMBER}\s*(?:mbar|bar|MPa|kPa|GPa|Pa|atm|psi|[Tt]orr)(?![A-Za-z])")),
    ("Condition", "ph", re.compile(rf"{_FREE}pH\s*(?:=|of|~|≈)?\s*{_NUMBER}(?![A-Za-z0-9])")),
)
PROPERTY = re.compile(rf"(?P<term>{_any(PROPERTY_TERMS)})(?P<gap>[^.;]{{0,{VALUE_GAP}}}?)(?P<value>{_NUMBER})\s*(?P<unit>{'|'.join(f'(?:{u})' for u in UNITS)})(?![A-Za-z0-9])", _I)
MIXTURE = re.compile(
    rf"{_FREE}(?:{_SOLVENT})(?:\s*[/:]\s*(?:{_SOLVENT})){{1,3}}\s*\(\s*(?:v\s*[/:]\s*v\s*[,;]?\s*)?{_NUMBER}(?:\s*:\s*{_NUMBER}){{1,2}}(?:\s*[,;]?\s*v\s*[/:]\s*v)?\s*\)", _I
)
SENTENCE = re.compile(r"(?<=[.!?])[ \t]+(?=[\"'(\[]?[A-Z0-9])|\n+")
LAST_TOKEN = re.compile(r"([A-Za-z.]+)\.$")
KELVIN = re.compile(r"K(?![A-Za-z0-9])")
DIGIT_OR_HYPHEN = re.compile(r"[0-9]|[‐-―−-]")
