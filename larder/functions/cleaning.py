"""Ingredient-text cleaning: each stage is an ordered list of rewriting steps."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.steps import SQUEEZE, Step, any_of, cut_after, rewrite

# ---- fixed values -------------------------------------------------------------------------------
SPECIAL_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "þ": "th"}

BOILERPLATE = [
    "allerg", "it may contain", "may contain", "our method", "www", "dietary advice", "not suitable for",
    "suitable for", "this product is made in", "made in", "free from", "rainforest alliance",
    "organic ingredients certified", "certified organic ingredients", "from sustainably grown",
]

TRACE_PHRASES = [
    "it can contain", "can contain", "it does not contain", "this product coes not contain",
    "this chocolate coes not contain", "does not contain", "possible traces", "keep refrigerated",
]

ORGANIC_PHRASES = [
    "product from organic farming", "products from organic farming", "all the ingredients come from organic farmin",
    "agricultural ingredient from organic farming", "ingredient from organic farming",
    "ingredients from organic farming", "from organic farming",
]

ORIGIN_PHRASES = [
    "origin france", "origin, france", "developed from eu origin", "eu origin, asia", "eu original", "eu origin",
    "origin eu", "origin spain", "brittany origin", "origin of the netherlands and france",
    "zygochlams patagonjca, argentinian origin", "ingredients origin france (100%)",
    "developed from france origin france", "this product is made from eu original pork", "origin england or france",
    "ingredients of natural origin", "france",
]

FOREIGN_TERMS = {
    " ble ": " wheat ", "soja ": " soya ", " leche ": " milk ", " ait ": " milk ", " oeuf ": " egg ", " euf ": " egg ",
    " oeufs ": " eggs ", " eufs ": " eggs ", " moutarde ": " mustard ", " sucre ": " sugar ", " beurre ": " butter ",
}

COLON_WORDS = [
    "preservative:", "preservatives:", "conservative:", "conservatives:", "acidifying:", "acidity:", "acidic:", "acid:",
    "color:", "colors:", "colour:", "coloring:", "regulator:", "regulators:", "corrector:", "emulgator:", "emulsifying:",
    "antioxidant:", "fier:", "fiers:", "zer:", "less:", "following:", "of:", "thickening:", "contains:", "cultures:",
    "agent:",
]

ALLOWED_PLAIN = "^[A-Za-z0-9.(),% ]+$"
ALLOWED_HYPHEN = "^[A-Za-z0-9.(),% -]+$"
ALLOWED_COLON = "^[A-Za-z0-9.(),%: ]+$"
# ---- end of fixed values ------------------------------------------------------------------------


def _accent_map() -> tuple[str, str]:
    """Letters whose canonical decomposition is one base letter plus combining marks."""
    pairs = []
    for code in range(0xC0, 0x2000):
        kept = [c for c in unicodedata.normalize("NFD", chr(code)) if not 0x300 <= ord(c) <= 0x36F]
        if len(kept) == 1 and kept[0] != chr(code):
            pairs.append((chr(code), kept[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_map()

_DROPPED = ["“", "”", "& quot;", "â€\xa0", "​"]

CLEAN: list[Step] = [
    ("lower",),
    ("chars", "*_?=^’", "     '"),
    SQUEEZE,
    ("text", ";", ","), ("text", ",,", ","), ("text", ", ,", ","), ("text", ": (", "("),
    *[("text", d, "") for d in _DROPPED],
    ("text", "&", "and"), ("text", "ingredients:", ""), ("text", "ingredients list:", ""),
    ("text", "(", " ("),
    *[("text", a, b) for a, b in SPECIAL_LETTERS.items()],
    ("chars", ACCENTED, PLAIN),
    ("re", "[̀-ͯ]", ""),
    ("chars", "[]{}", "()()"),
    # one spelling of the percent sign, then one place for it: "(12%)" right after the name
    ("re", r"per\s?cent", "%"), ("text", " %", "%"), ("text", "%", "% "), ("text", "( ", "("), ("text", " )", ")"),
    SQUEEZE,
    ("text", "%%", "%"),
    ("re", r"\((\d+(?:\.\d+)?)%(\s)", "($1%)$2"),
    ("re", r"\s+([+-]?\d+(?:\.\d+)?)%\)", " ($1%)"),
    ("text", "%)", "\u0001"), ("re", r"(^|[^(])(\d+(?:\.\d+)?)%", "$1($2%)"), ("text", "\u0001", "%)"),
    cut_after(BOILERPLATE),
    ("text", "sustainably grown", ""),
    ("re", "†from.*", ""), ("text", "†", " "),
    ("strip",), SQUEEZE, ("text", "()", " "), ("strip",), SQUEEZE,
]

ORIGIN_CLAUSES: list[Step] = [
    ("re", r"\(origin:[^)]*\)", ""), ("re", r"\(country of origin:[^)]*\)", ""), ("re", r"origin:[^.]*\.", ""),
    ("re", "although every care.*", ""),
]

TRACES: list[Step] = [
    cut_after(TRACE_PHRASES),
    ("re", r"contains (or less|less than|two% or less)( of the following:| of :| of the following| of)?", ""),
    ("re", r"\.$", ""), ("re", ",$", ""),
    # a full stop that is no decimal point separates ingredients; twice, for runs of stops
    ("re", r"(^|[^0-9])\.", "$1,"), ("re", r"(^|[^0-9])\.", "$1,"),
    ("strip",),
]

ORGANIC_ORIGIN: list[Step] = [
    cut_after(ORGANIC_PHRASES),
    *[("text", p, "") for p in ORIGIN_PHRASES],
    ("text", ":", ""), SQUEEZE, ("strip",), ("re", r"\.$", ""), ("re", ",$", ""), ("text", "()", ""), ("strip",),
]

TRANSLATED: list[Step] = [("text", a, b) for a, b in FOREIGN_TERMS.items()]

PRE_PARSE: list[Step] = [
    ("text", ";", ","), ("re", r"(?i)per\s?cent", "%"),
    ("text", "Allergy Advice: For allergens see highlighted ingredients", ""), ("chars", "[]{}", "()()"),
]

TIDY_STRUCTURE: list[Step] = [SQUEEZE, ("re", r"\.$", ""), ("re", ",$", "")]
PERCENT_AFTER_NAME: list[Step] = [
    ("re", r"\((\d+(\.\d+)?)%\)\s+([^(),]+)", "$3 ($1%)"),
    ("re", r"([^(),]+)\s*\(([^()]+)\)\s*\((\d+(\.\d+)?)%\)", "$1 ($3%) ($2)"),
]
SPACED: list[Step] = [("re", r"\s+", " "), ("text", "(", " ("), SQUEEZE, ("strip",)]


def clean_ingredients(text: Column) -> Column:
    """Lower-case, one alphabet, one kind of bracket, one percent notation, no boilerplate."""
    return rewrite(text, CLEAN)


def drop_origin_clauses(text: Column) -> Column:
    """' - ' separates when there is no comma; origin clauses go."""
    return rewrite(F.when(text.contains(","), text).otherwise(F.replace(text, F.lit(" - "), F.lit(", "))), ORIGIN_CLAUSES)


def correct_structure(text: Column, max_rounds: int = 10) -> Column:
    """Move every percentage right behind its ingredient, to a fixpoint.

    A text that still changes in round ``max_rounds - 1`` is given up and becomes ''.  NULL stays NULL: ``text`` stands
    here once, so that the steps before it run once.
    """
    start = rewrite(text, TIDY_STRUCTURE)
    state = F.struct(F.lit(None).cast("string").alias("before"), start.alias("now"))

    def one_round(s: Column, _: Column) -> Column:
        again = F.struct(s["now"].alias("before"), rewrite(s["now"], PERCENT_AFTER_NAME).alias("now"))
        return F.when(s["before"].eqNullSafe(s["now"]), s).otherwise(again)

    rounds = F.sequence(F.lit(1), F.lit(max_rounds - 1))
    done = F.aggregate(rounds, state, one_round, lambda s: F.when(s["before"].eqNullSafe(s["now"]), s["now"]).otherwise(""))
    return rewrite(done, SPACED)


def drop_traces(text: Column) -> Column:
    """Trace and 'contains … or less' phrases go; stops that are no decimal points become commas."""
    return rewrite(text, TRACES)


def drop_organic_origin(text: Column) -> Column:
    """Organic-farming and place-of-origin phrases go."""
    return rewrite(text, ORGANIC_ORIGIN)


def translate_terms(text: Column) -> Column:
    """A few left-over foreign words."""
    return rewrite(text, TRANSLATED)


def starred_grams(text: Column) -> Column:
    """'12g**' means percent, unless the stars follow egg, veg or ...ing."""
    low = F.lower(text)
    meant = low.contains("g**") & ~low.rlike(r"egg\*\*|veg\*\*|ing\*\*")
    return F.when(meant, F.replace(text, F.lit("g**"), F.lit("%"))).otherwise(text)


def pre_parse(text: Column) -> Column:
    """The light normalisation that comes right before splitting a list."""
    return rewrite(text, PRE_PARSE)


def quality_route(text: Column) -> Column:
    """Which of the cleaning branches a text takes, by the characters it uses.

    ``plain`` and ``empty`` texts are kept, ``hyphen`` texts when the hyphen only joins words, ``colon``
    texts when the colon follows a known label; everything else is ``discard``.
    """
    return (
        F.when(text == "", "empty")
        .when(text.rlike(ALLOWED_PLAIN), "plain")
        .when(text.rlike(ALLOWED_HYPHEN), F.when(text.contains("-") & ~text.contains(" - "), "hyphen").otherwise("discard"))
        .when(text.rlike(ALLOWED_COLON), F.when(text.rlike(any_of(COLON_WORDS, ignore_case=False)), "colon").otherwise("discard"))
        .otherwise("discard")
    )
