"""Language of a text by a learned word profile or by character grams, and translation through a cache."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.session import reliable_checkpoint

WORD = "[^a-zà-ÿ]+"
UNDETERMINED = "und"
#: At most so many words, the most frequent of a profile, have their shares broadcast; the others are joined through the shuffle.
FREQUENT_WORDS = 200_000


def words(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per word."""
    return df.select(*keys, F.explode(F.split(F.lower(text), WORD)).alias("word")).where("word <> ''")


def word_profile(labelled: DataFrame, text: str, lang: str, top: int | None = None) -> DataFrame:
    """The words of each language with their share among its words; with ``top`` only the most frequent."""
    counts = words(labelled, text, [lang]).groupBy(F.col(lang).alias("lang"), "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    if top is None:
        return counts.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("r", rank).where(F.col("r") <= top)
    return best.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("share"))


def detect_languages(df: DataFrame, key: str, profile: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The language whose profile fits best, for several texts of a row at once; 'und' for empty or unknown texts.

    ``columns`` maps text columns to the columns of their languages.  The profile may be as large as the languages'
    vocabularies, so only its most frequent words are brought to the texts.
    """

    def tagged(column: str) -> Column:
        found = F.split(F.lower(F.coalesce(column, F.lit(""))), WORD)
        return F.transform(found, lambda w: F.struct(F.lit(column).alias("which"), w.alias("word")))

    hits = df.select(key, F.explode(F.flatten(F.array(*map(tagged, columns)))).alias("x")).select(key, "x.*").where("word <> ''")
    by_word = profile.where("word IS NOT NULL").groupBy("word").agg(F.collect_list(F.struct("lang", "share")).alias("told"), F.max("share").alias("top"))
    by_word = reliable_checkpoint(by_word)  # read for its most frequent words and for the others
    languages = by_word.select(F.explode("told.lang").alias("lang")).distinct().count()
    # shares of a language add up to 1, so there are FREQUENT_WORDS such words at most
    often = F.col("top") >= languages / FREQUENT_WORDS
    frequent = F.broadcast(by_word.where(often).select("word", "told"))
    # a row for each place of a word that most texts have would be most of all rows: those meet their shares before the shuffle
    near = hits.join(frequent, "word")
    far = hits.join(frequent.select("word"), "word", "left_anti").join(by_word.where(~often).select("word", "told"), "word")
    told = near.unionByName(far).select(key, "which", F.inline("told"))
    scores = told.groupBy(key, "which", "lang").agg(F.round(F.sum("share"), 9).alias("score"))
    best = {c: F.min(F.when(F.col("which") == c, F.struct(-F.col("score"), F.col("lang").alias("lang")))).getField("lang") for c in columns}
    best = scores.groupBy(key).agg(*[v.alias(f"__{out}") for v, out in zip(best.values(), columns.values(), strict=True)])
    # told before the join, so that texts nobody asks for are not shuffled
    df = df.withColumns({f"__long_{o}": F.length(F.trim(c)) > 1 for c, o in columns.items()})
    out = df.join(best, key, "left")
    known = {o: F.when(F.col(f"__long_{o}"), F.col(f"__{o}")) for o in columns.values()}
    return out.withColumns({o: F.coalesce(v, F.lit(UNDETERMINED)) for o, v in known.items()}).drop(*[f"__{p}{o}" for o in columns.values() for p in ("", "long_")])


def detect_language(df: DataFrame, text: str, key: str, profile: DataFrame, out: str = "language") -> DataFrame:
    """The language of one text per row; see :func:`detect_languages`."""
    return detect_languages(df, key, profile, {text: out})


def translated(df: DataFrame, text: str, cache: DataFrame, out: str) -> DataFrame:
    """Translations from a cache of distinct texts; failed or missing ones keep the original, 'na' becomes ''."""
    distinct = df.select(F.col(text).alias("text")).distinct().join(cache.select("text", "translation"), "text", "left")
    failed = F.col("translation").isNull() | F.lower("translation").contains("error:")
    distinct = distinct.select(F.col("text").alias(text), F.when(failed, F.col("text")).when(F.col("translation") == "na", "").otherwise(F.col("translation")).alias(out))
    return df.join(distinct, text, "left")


#: Buckets of hashed grams, the factor of their hash, and characters of a text that are hashed at a time.
BUCKETS, FACTOR, PIECE = 1 << 16, 4_099, 1 << 20


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the runs of 1, 2 and 3 characters of the lower-cased text with a blank at either end.

    A run's hash takes its code points in turn: ``h = h * FACTOR + code``; the bucket is ``h % BUCKETS``.
    """
    padded = f" {text.lower()} "
    for start in range(0, len(padded), PIECE):
        piece = padded[start : start + PIECE + 2]  # the last two runs of a piece reach into the next one
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last, h = start + PIECE >= len(padded), np.zeros(len(codes), np.int64)
        for n in range(1, 4):
            h = h[: len(codes) - n + 1] * FACTOR + codes[n - 1 :]
            yield (h if last else h[:PIECE]) % BUCKETS


@dataclass(frozen=True)
class GramModel:
    """Log-probabilities of gram buckets per language, with one count added to each bucket; languages in order of name."""

    languages: list[str]
    logs: np.ndarray

    def scores(self, text: str) -> np.ndarray:
        return sum((self.logs[:, b].sum(1) for b in gram_buckets(text)), np.zeros(len(self.languages)))


def gram_model(labelled: DataFrame, text: str, lang: str) -> GramModel:
    """Counts of every language's grams over all texts; what comes to the driver is one array per language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                for buckets in gram_buckets(t):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for name, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(own[at])], ["lang", "bucket", "n"])

    known = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.ones((len(names), BUCKETS))
    for i, name in enumerate(names):
        own = counts[counts["lang"] == name]
        table[i, own["bucket"]] += own["n"]
    return GramModel(names, np.log(table / table.sum(1, keepdims=True)))


def detect_by_grams(df: DataFrame, text: str, model: GramModel, out: str = "language", least: float = 0.5) -> DataFrame:
    """``df`` with ``out``, the likeliest language, and its probability; 'und' below ``least`` and for texts of one character or none."""
    told = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("language string, probability double")
    def best(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            if t is None or len(t.strip()) <= 1 or not told.value.languages:
                rows.append((UNDETERMINED, None))
                continue
            s = told.value.scores(t)
            p = np.exp(s - s.max())
            top = int(s.argmax())
            rows.append((told.value.languages[top] if p[top] / p.sum() >= least else UNDETERMINED, float(p[top] / p.sum())))
        return pd.DataFrame(rows, columns=["language", "probability"])

    return df.withColumn("__best", best(F.col(text))).withColumns({out: F.col("__best.language"), f"{out}_probability": F.col("__best.probability")}).drop("__best")
