"""Small row-local column functions: nulls, codes, percentages, flags, points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------
NULL_TOKENS = ["", "-", "\\N", "NULL", "NaN", "na"]

COUNTRY_GROUPS = {
    "EUwest": ["Germany", "France", "Austria", "Belgium", "Switzerland", "Netherlands", "Luxembourg"],
    "EUsouth": ["Italy", "Spain", "Portugal"],
    "Nordic": ["Norway", "Sweden", "Finland", "Denmark", "Lithuania", "Latvia", "Estonia"],
    "EUeast": [
        "Poland", "Czech Republic", "Slovakia", "Romania", "Hungary", "Bulgaria", "Slovenia", "Croatia", "Serbia",
        "Ukraine", "Russia", "New Caledonia",
    ],
    "MedAf": [
        "Greece", "Turkey", "Cyprus", "Israel", "Lebanon", "Egypt", "Morocco", "Tunisia", "Algeria", "South Africa",
    ],
    "LatAmMeSAsia": [
        "India", "United Arab Emirates", "Saudi Arabia", "Qatar", "Kuwait", "Iraq", "Réunion", "Mexico", "Argentina",
        "Bolivia", "Venezuela", "Peru", "Chile", "Ecuador", "Brazil", "Cuba", "Puerto Rico", "Guadeloupe", "Martinique",
        "French Polynesia", "Panama", "Costa Rica", "Colombia",
    ],
    "EAsia": [
        "Japan", "South Korea", "Thailand", "Indonesia", "Philippines", "Malaysia", "Singapore", "Hong Kong",
    ],
}
DEFAULT_COUNTRY_GROUP = "UK"

COUNTRY_NAMES = {
    "C\x99te d'Ivoire": "Ivory Coast", "Iran (Islamic Republic of)": "Iran, Islamic Republic of",
    "Russian Federation": "Russia", "United States of America": "United States", "Viet Nam": "Vietnam",
}

STORES = ["waitrose", "morrisons", "tesco", "sainsbury", "cook", "aldi", "iceland", "ocado"]

LEAF_CLASSES = [
    "Savoury Snacks", "Alcoholic Beverages", "Nuts and Seeds", "Not Food", "Dietary Supplements",
    "Artificial Sweeteners", "Commercial Toddlers Foods and Drinks",
]
# ---- end of fixed values ------------------------------------------------------------------------


def computed_once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def no_null_tokens(col: Column, tokens: list[str] = NULL_TOKENS) -> Column:
    """The many spellings of 'missing' become NULL."""
    return F.when(~F.coalesce(col.isin(tokens), F.lit(False)), col)


def area_code(col: Column) -> Column:
    """Text codes such as ``'004`` to integers; anything else is NULL."""
    return F.substring(col, 2, 32).try_cast("int")


def percent_number(col: Column) -> Column:
    """'12%' to 12.0; '-' and other text is NULL."""
    return F.regexp_replace(col, "%", "").try_cast("double")


def longer_text(a: Column, b: Column) -> Column:
    """``b`` where it is present and longer than ``a``, else ``a``."""
    return F.when(b.isNotNull() & (F.length(b) > F.length(a)), b).otherwise(a)


def country_group(country: Column) -> Column:
    """One of eight country groups; an unlisted country counts as the default group."""
    out = F.lit(None).cast("string")
    for group, names in COUNTRY_GROUPS.items():
        out = F.when(country.isin(names), group).otherwise(out)
    return F.coalesce(out, F.lit(DEFAULT_COUNTRY_GROUP))


def renamed(col: Column, names: dict[str, str]) -> Column:
    """Replace listed values, keep the others."""
    out = col
    for old, new in names.items():
        out = F.when(col == old, new).otherwise(out)
    return out


def store_of(*url_like: Column) -> Column:
    """Store named in the last URL-like column; the raw URL when no known store is in it."""
    url = F.coalesce(*[F.when(c.contains("http"), c) for c in reversed(url_like)], F.lit("null"))
    tesco = F.when(url.contains("tesco.ie"), "tesco ireland").when(url.contains("tesco"), "tesco")
    return F.coalesce(tesco, *[F.when(url.contains(s), s) for s in STORES if s != "tesco"], url)


def plausible_percent(percent: Column, pos: Column, slack: float = 0.0) -> Column:
    """An ingredient in place n cannot exceed 100/n percent; impossible values are NULL."""
    return F.when(percent <= F.lit(100.0) / pos + slack, percent)


def equal_parentheses(text: Column) -> Column:
    """'Equal' when the text opens and closes the same number of parentheses."""
    return F.when(F.regexp_count(text, F.lit(r"\(")) == F.regexp_count(text, F.lit(r"\)")), "Equal").otherwise("Unequal")


def leaf_or(level: Column, parent: Column, leaves: list[str] = LEAF_CLASSES) -> Column:
    """Classes without children repeat their own name on the lower levels."""
    return F.when(parent.isin(leaves), parent).otherwise(level)


def points_above(value: Column, cuts: list[float], points: list[int] | None = None) -> Column:
    """How many of the ascending cuts a value exceeds, or the points listed for the highest cut passed."""
    if points is None:
        return sum(((value > c).cast("int") for c in cuts[1:]), (value > cuts[0]).cast("int"))
    out = F.lit(0)
    for c, p in zip(cuts, points, strict=True):
        out = F.when(value > c, p).otherwise(out)
    return out


def combined_text(name: Column, ingredients: Column) -> Column:
    """'name - ingredients' in lower case, as the text models read it."""
    return F.concat_ws(" - ", F.lower(name), F.lower(ingredients))
