"""Text rewriting as data: an ordered list of steps folded into one column expression.

A step is a tuple.  ``("re", pattern, replacement)`` replaces every match, ``("text", old, new)``
replaces a literal, ``("chars", from, to)`` maps single characters, ``("lower",)`` and ``("strip",)``
take no argument.  Patterns avoid lookaround so that they mean the same in every regex engine;
groups in a replacement are written ``$1``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = tuple[str, ...]

SQUEEZE: Step = ("re", " +", " ")

#: Patterns that Java's engine takes long over, and patterns with the same result that it doesn't; steps and SQL keep the portable ones.
#: A single blank needs no replacement; a name begins behind a delimiter, and no shorter part of it would do.
FASTER = {
    (" +", " "): "  +",
    (r"([^(),]+)\s*\(([^()]+)\)\s*\((\d+(\.\d+)?)%\)", "$1 ($3%) ($2)"): r"(?<![^(),])([^(),]++)\s*\(([^()]++)\)\s*\((\d+(\.\d+)?)%\)",
}


def rewrite(col: Column, steps: list[Step]) -> Column:
    """Apply the steps in order; the result stays one code-generated expression."""
    for kind, *args in steps:
        if kind == "re":
            col = F.regexp_replace(col, F.lit(FASTER.get(tuple(args), args[0])), F.lit(args[1]))
        elif kind == "text":
            col = F.replace(col, F.lit(args[0]), F.lit(args[1]))
        elif kind == "chars":
            col = F.translate(col, args[0], args[1])
        elif kind == "lower":
            col = F.lower(col)
        elif kind == "strip":
            col = F.regexp_replace(col, r"^\s+|\s+$", "")
        else:
            raise ValueError(f"unknown step {kind!r}")
    return col


def cut_after(phrases: list[str]) -> Step:
    """Drop everything on the line from the earliest of the phrases on."""
    pattern = f"({'|'.join(phrases)}).*"
    if all(re.fullmatch(r"[\w ]{3,}", p) for p in phrases):  # three letters rule out most places before any phrase is tried
        FASTER[pattern, ""] = f"(?={''.join(f'[{"".join(sorted({p[i] for p in phrases}))}]' for i in range(3))}){pattern}"
    return ("re", pattern, "")


def any_of(words: list[str], ignore_case: bool = True) -> str:
    """One alternation out of a word list, so that a text is scanned once, not once per word."""
    return ("(?i)" if ignore_case else "") + f"({'|'.join(words)})"


def literal(text: str) -> str:
    """Escape a literal for use inside a pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def rewrite_sql(expr: str, steps: list[Step]) -> str:
    """The same steps as a DuckDB expression, for checks."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for kind, *args in steps:
        if kind == "re":
            expr = f"regexp_replace({expr}, {q(args[0])}, {q(re.sub(r'[$]([0-9])', r'\\\1', args[1]))}, 'g')"
        elif kind == "text":
            expr = f"replace({expr}, {q(args[0])}, {q(args[1])})"
        elif kind == "chars":
            expr = f"translate({expr}, {q(args[0])}, {q(args[1])})"
        elif kind == "lower":
            expr = f"lower({expr})"
        elif kind == "strip":
            expr = rf"regexp_replace({expr}, '^\s+|\s+$', '', 'g')"
    return expr
