"""Quality rules: a table of thresholds compiled into one Spark projection.

The measures of a text are column expressions; the table names a measure, a bound and a side; all rules together are one
boolean expression. No user functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import SPACE

#: Function words of four languages: running text holds some, lists and codes hold hardly any.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "on", "as", "be", "by", "it", "this", "are", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para", "no", "es"],
}

#: The rules: measure, smallest and largest value that passes (None: no bound).
RULES: list[tuple[str, float | None, float | None]] = [
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_chars", 2, 14),
    ("symbol_ratio", None, 0.2),
    ("stop_word_ratio", 0.03, None),
    ("dup_line_ratio", None, 0.3),
    ("upper_ratio", None, 0.4),
    ("bullet_line_ratio", None, 0.9),
]
#: Rules that a text fails whatever the table says.
BASE = ["n_words", "repeat_word_ratio"]

#: Bits of a packed entry that hold a position; longer texts take the unpacked way.
_BITS = 21


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words that stand in a three-word window found twice or more in ``w``.

    Windows are compared by a 64-bit hash. Sorted entries of hash prefix and position bring equal windows together;
    where a prefix stands for two hashes, or positions don't fit, whole hashes are sorted instead.
    """
    mask = (1 << _BITS) - 1
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def covered(positions: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(positions, lambda p: F.array(p, p + 1, p + 2)))))

    def packed(h: Column) -> Column:
        entries = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        prefix = lambda x: F.shiftright(x, _BITS)
        at = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")

        def marked(s: Column) -> Column:
            near = lambda i, j: prefix(F.get(s, i)) == prefix(F.get(s, j))
            mixed = F.exists(F.sequence(F.lit(0), F.size(s) - 2), lambda i: near(i, i + 1) & (F.get(h, at(F.get(s, i))) != F.get(h, at(F.get(s, i + 1)))))
            same = F.filter(s, lambda x, i: ((i > 0) & near(i, i - 1)) | ((i < F.size(s) - 1) & near(i, i + 1)))
            return F.when(mixed, whole(h)).otherwise(covered(F.transform(same, at)))

        return let(entries, marked)

    def whole(h: Column) -> Column:
        entries = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            near = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
            same = F.filter(s, lambda x, i: ((i > 0) & near(i, i - 1)) | ((i < F.size(s) - 1) & near(i, i + 1)))
            return covered(F.transform(same, lambda x: x["i"]))

        return let(entries, marked)

    def counted(h: Column) -> Column:
        none = F.size(F.array_distinct(h)) == F.size(h)
        return F.when(none, 0).when(F.size(h) <= mask, packed(h)).otherwise(whole(h))

    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, counted)).cast("long")


def measures(text: Column) -> Column:
    """A struct of counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    stop = sorted({x for words_ in STOP_WORDS.values() for x in words_})

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

        def counts(w: Column, own: Column) -> Column:
            joined = F.array_join(w, "")
            count = lambda pattern: F.length(joined) - F.length(F.regexp_replace(joined, pattern, ""))
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(joined).cast("long").alias("word_chars"),
                count(r"[#*$%&|<>]").cast("long").alias("n_symbols"),
                (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
                repeated_words(w).alias("n_repeat_words"),
                F.size(own).cast("long").alias("n_lines"),
                F.size(F.filter(w, lambda x: F.lower(F.regexp_replace(x, r"[.,;:!?]+$", "")).isin(stop))).cast("long").alias("n_stop_words"),
                count("[A-Z]").cast("long").alias("n_upper"),
                F.size(F.filter(own, lambda x: x.rlike(r"^[\x20\t]*[-*\u2022]\x20"))).cast("long").alias("n_bullet_lines"),
            )

        return let(words(t), lambda w: let(lines, lambda own: counts(w, own)))

    return of(text)


def _ratios(m: str) -> dict[str, Column]:
    ratio = lambda a, b: F.when(F.col(f"{m}.{b}") > 0, F.col(f"{m}.{a}") / F.col(f"{m}.{b}")).otherwise(0.0)
    return {
        "n_words": F.col(f"{m}.n_words"), "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"), "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "upper_ratio": ratio("n_upper", "word_chars"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"), "bullet_line_ratio": ratio("n_bullet_lines", "n_lines"),
    }


def compiled(rules: list[tuple[str, float | None, float | None]], ratios: dict[str, Column]) -> Column:
    """True where a text passes every rule of the table."""
    ok = F.lit(True)
    for name, least, most in rules:
        if least is not None:
            ok = ok & (ratios[name] >= least)
        if most is not None:
            ok = ok & (ratios[name] <= most)
    return ok


def judged(docs: DataFrame, text_col: str = "text", rules: list[tuple[str, float | None, float | None]] = RULES) -> DataFrame:
    """``docs`` with ``measures`` (struct), ``base_failed`` and ``kept``.

    A null or empty text has no words and fails. Repeated rows are judged alike. Input columns with these names are
    replaced. An empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("measures", "base_failed", "kept")])
    measured = docs.withColumn("measures", measures(F.col(text_col)))
    ratios = _ratios("measures")
    base = compiled([r for r in RULES if r[0] in BASE], ratios)
    return measured.withColumn("base_failed", ~base).withColumn("kept", base & compiled(rules, ratios))
