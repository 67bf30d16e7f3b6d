"""Personal data by patterns, and by contexts bootstrapped from what the patterns find. DataFrame functions only.

Matches of four patterns are seeds. A lexical pattern is the last one, two or three words before an identifier; words end
at white space and after ``:``, ``=`` and ``#``, so ``user=`` and ``contact me at`` are patterns. Candidates are all strings with a
digit, an at sign or ``(at)``, numbers with blanks between their groups among them. Patterns and identifiers form a graph. In
each round a pattern's confidence is the sum of its identifiers' scores over all of its occurrences in the corpus, with or
without an identifier behind them (so articles earn none), and an identifier's score is the chance that not all its patterns
are wrong; seeds keep score 1. Patterns that are confident and supported by several seeds extract the other candidates
that they stand before, whatever their shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, null_safe, stored
from larder.llm.quality_rules import let
from larder.llm.spans import matches

# The kinds in order. The patterns match what the plain ones do: possessive repeats can't give anything back
# that would match, and a run's inside can't match where its start doesn't, unless a match ended there (\G). Leading zeros
# of an address part do give back: a part may be nothing but zeros.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "context"]
_SMALL_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"

#: What ends a context word and can't be in an identifier, besides white space.
_ENDS = r"\x20\x09-\x0D:=#\"'<>\[\]{},;|"
#: Groups of digits with at most one blank between, or a word with a digit, an at sign or "(at)": what contexts may discover.
CANDIDATE = (
    rf"(?<![^{_ENDS}(])(?:[+(]?+[0-9][0-9()./-]*+(?:\x20[(]?+[0-9][0-9()./-]*+)*+(?![^{_ENDS}.!?])|(?=[^{_ENDS}]*?(?:[0-9@]|\(at\)))[^{_ENDS}]++)"
)
#: Words of contexts, with what ends them.
WORD = r"[^\x20\x09-\x0D:=#\"'(<\[{]*+[:=#]++|[^\x20\x09-\x0D:=#\"'(<\[{]++"
#: Most words of a context, and characters before an identifier in which they are looked for.
WORDS, NEAR = 3, 80
#: Rounds of scoring; confidence and seed identifiers that a pattern needs; occurrences that damp its confidence; least characters of an identifier.
ROUNDS, CONFIDENT, SEEDS, DAMPING, LEAST = 3, 0.8, 5, 1.0, 5
#: Last words of patterns that are looked for by a literal set; with more of them all words are joined.
LITERAL = 5_000


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(found: Column) -> Column:
    d = F.reverse(_digits(found))

    def value(i: Column) -> Column:
        x = F.substr(d, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x))

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(d).between(13, 19), total % 10 == 0).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    """Matches of each kind that hold; see :func:`larder.llm.spans.matches`."""
    none = F.array().cast("array<struct<kind:string,start:long,end:long,found:string,before:string>>")
    guarded = lambda needs, kind, pattern, holds: F.when(needs, F.filter(matches(text, pattern, kind), lambda m: holds(m["found"]))).otherwise(none)
    return {
        "email": guarded(text.contains("@"), "email", EMAIL, lambda f: F.lit(True)),
        "ip": guarded(text.rlike(r"[0-9]\.[0-9]"), "ip", IP, lambda f: f.rlike(_SMALL_PARTS)),
        "card": guarded(text.rlike(r"[0-9][\x20-]?[0-9]"), "card", CARD, _luhn),
        "phone": guarded(text.contains("+"), "phone", PHONE, lambda f: F.length(_digits(f)).between(9, 15)),
    }


def _ends_of(words: Column, end: Column) -> Column:
    """The last 1 to WORDS of the first ``end`` words, each run as one string."""
    sizes = F.sequence(F.lit(1), F.least(F.lit(WORDS), end))
    return F.when(end > 0, F.transform(sizes, lambda k: F.array_join(F.slice(words, end - k + 1, k), " "))).otherwise(F.array().cast("array<string>"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _contexts(spans: Column, trim: bool) -> Column:
    """Array of (patterns, found, start, end) with the punctuation around the identifier left out."""

    def entry(m: Column) -> Column:
        core = F.regexp_extract(m["found"], r"^[\"'(\[{<]*+(.*?)[\"')\]}>.,;:!?#*$%&|]*+$", 1) if trim else m["found"]
        skipped = F.length(F.regexp_extract(m["found"], r"^[\"'(\[{<]*+", 0)) if trim else F.lit(0)
        start = m["start"] + skipped
        patterns = let(_words(F.right(m["before"], F.lit(NEAR))), lambda w: _ends_of(w, F.size(w)))
        return F.struct(patterns.alias("patterns"), core.alias("found"), start.alias("start"), (start + F.length(core)).alias("end"))

    return F.filter(F.transform(spans, entry), lambda c: (F.size(c["patterns"]) > 0) & (F.length(c["found"]) >= LEAST))


def _outside(candidates: Column, base: Column) -> Column:
    """Candidates that overlap no match, or go beyond one on either side with letters or digits."""
    meets = lambda c, m: (m["start"] < c["end"]) & (c["start"] < m["end"])
    wider = lambda c, m: (c["start"] <= m["start"]) & (m["end"] <= c["end"]) & (c["end"] - c["start"] > m["end"] - m["start"])
    return F.filter(candidates, lambda c: F.forall(base, lambda m: ~meets(c, m) | wider(c, m)))


def occurrences(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often each of ``patterns`` (pattern) occurs in the texts of ``docs`` (text)."""
    last = stored(patterns.select(F.substring_index("pattern", " ", -1).alias("last")).distinct(), "last")
    some = last.limit(LITERAL + 1).collect()  # a bounded number of words
    ends = F.sequence(F.lit(1), F.size("w"))
    if len(some) <= LITERAL:
        known = [r["last"] for r in some]
        ends = F.filter(ends, lambda i: F.get(F.col("w"), i - 1).isin(known))
    rows = docs.select(_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    met = rows.select(F.explode(F.flatten(F.transform(ends, lambda i: _ends_of(F.col("w"), i)))).alias("pattern"))
    # in-task sums of patterns that seeds support; no row for the others leaves its task
    return met.join(broadcast_if_small(patterns), "pattern").groupBy("pattern").agg(F.count("*").alias("total"))


def _confident(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (pattern) that earn confidence in the graph of (pattern, found, seed, times)."""
    edges = stored(edges.groupBy("pattern", "found").agg(F.max("seed").alias("seed"), F.sum("times").alias("times")), "edges")
    seeds = edges.where("seed > 0").select("found").distinct().withColumn("is_seed", F.lit(True))
    # only patterns that a seed supports can earn anything
    supported = stored(edges.where("seed > 0").groupBy("pattern").agg(F.count("*").alias("support")).where(f"support >= {SEEDS}").select("pattern"), "supported")
    totals = stored(occurrences(docs, supported), "totals")
    edges = edges.join(broadcast_if_small(totals), "pattern").join(broadcast_if_small(stored(seeds, "seeds")), "found", "left")
    edges = stored(edges.select("pattern", "found", "times", "total", "is_seed"), "graph")
    trust_of = lambda scores: scores.groupBy("pattern").agg((F.sum(F.col("score") * F.col("times")) / (F.greatest(F.max("total"), F.sum("times")) + DAMPING)).alias("trust"))
    scores = edges.withColumn("score", F.when(F.col("is_seed"), 1.0).otherwise(0.0))
    for _ in range(ROUNDS):
        told = edges.join(trust_of(scores), "pattern")
        chance = told.groupBy("found").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("chance"))
        scores = edges.join(chance, "found").withColumn("score", F.when(F.col("is_seed"), 1.0).otherwise(F.col("chance")))
        scores = stored(scores.select(*edges.columns, "score"), "scores")
    return trust_of(scores).where(f"trust >= {CONFIDENT}").select("pattern")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans, an array of (kind, start, end, found) by kind, then start.

    Offsets are code points, end exclusive. The first four kinds are the fixed patterns' matches that hold; ``context`` are
    identifiers that the method adds; where one meets a match it goes beyond it. A null or empty text has no spans. Rows that repeat
    id and text have the same spans; other columns are ignored; an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), text.alias("text"), F.sha2(text, 256).alias("sha"))
    some = F.col("text").rlike(r"[0-9@]|\(at\)")
    base = rows.select("id", "sha", *[c.alias(k) for k, c in base_spans(F.col("text")).items()], F.when(some, matches(F.col("text"), CANDIDATE, "context")).alias("candidates"))
    every = F.concat(*KINDS[:4])
    base = base.select("id", "sha", F.transform(every, lambda m: m.dropFields("before")).alias("base"), _contexts(every, False).alias("seeds"), _contexts(F.coalesce("candidates", F.slice("email", 1, 0)), True).alias("others"))
    base = stored(base.withColumn("others", _outside(F.col("others"), F.col("base"))), "spans")

    edge = lambda column, seed: base.select(F.explode(column).alias("c")).select(F.explode("c.patterns").alias("pattern"), "c.found", F.lit(seed).alias("seed"), F.lit(1).alias("times"))
    confident = broadcast_if_small(stored(_confident(edge("seeds", 1).union(edge("others", 0)), rows.select("text")), "patterns"))
    met = base.select("id", "sha", F.explode("others").alias("c")).select("id", "sha", "c", F.explode("c.patterns").alias("pattern")).join(confident, "pattern", "left_semi")
    found = F.struct(F.lit("context").alias("kind"), F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.found").alias("found"))
    added = met.groupBy(F.col("id").alias("__id"), F.col("sha").alias("__sha")).agg(F.array_sort(F.collect_set(found)).alias("added"))
    added = broadcast_if_small(stored(added, "added"))
    joined = base.join(added, null_safe(base, added, {"id": "__id", "sha": "__sha"}), "left")
    return joined.select("id", F.concat("base", F.coalesce("added", F.slice("base", 1, 0))).alias("spans"))
