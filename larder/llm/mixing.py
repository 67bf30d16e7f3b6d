"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its share of the target times the size of the mix, over its rows. A document's
count is drawn by inverting the Poisson distribution at a number hashed from seed and id, the document is exploded by its
count, and all copies are dealt out and ordered by a hash of their own. Draws depend on keys only, so a repeated task
repeats them. A Poisson number of mean ``r`` is the sum of ``m`` of mean ``r / m``; pieces keep the table of the inverse short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from larder.llm.common import broadcast_if_small, null_safe, stored

#: Largest mean of a piece, and entries of its cumulative distribution (beyond them less than 2**-40 is left).
PIECE_MEAN, ENTRIES = 16.0, 72


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 hashed from the parts, on a grid of 2**-32."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def cumulative(mean: Column) -> Column:
    """Poisson distribution function at 0, 1, 2, ... ENTRIES - 1."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def add(x: Column, k: Column) -> Column:
        p = x["p"] * mean / k
        return F.struct(p.alias("p"), (x["sum"] + p).alias("sum"), F.concat(x["all"], F.array(x["sum"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ENTRIES - 1)), start, add, lambda x: x["all"])


def rates(docs: DataFrame, weights: DataFrame | None, source_col: str, rows: int | None, temperature: float) -> DataFrame:
    """Rows (source, n, rate) of each source of ``docs``; see :func:`mixed`."""
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = stored(weights.groupBy(F.col("source").alias("__source")).agg(F.sum(F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).alias("weight"), F.min(F.col("weight").cast("double")).alias("least")), "given")
        wrong = given.where("weight >= double('infinity') OR isnan(weight) OR least < 0").limit(1).collect()
        if wrong:
            raise ValueError(f"weights are finite numbers of 0 or more; source {wrong[0]['__source']!r} has others")
        given = given.drop("least")
        weighed = sizes.join(given, null_safe(sizes, given, {"source": "__source"}), "left").drop("__source").fillna(0.0, ["weight"])
    weighed = stored(weighed, "weights")
    whole = weighed.agg(F.sum("weight"), F.sum("n")).first()
    if not whole[0]:
        return weighed.select("source", "n", F.lit(0.0).alias("rate"))
    return weighed.select("source", "n", (F.col("weight") / whole[0] * float(whole[1] if rows is None else rows) / F.col("n")).alias("rate"))


def mixed(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source", rows: int | None = None, temperature: float = 0.5, seed: int = 42
) -> DataFrame:
    """Copies of the rows of ``docs`` in shuffled order, with ``rate``, ``copy`` (from 0) and ``shuffle_key``.

    ``weights`` (source, weight) gives target shares up to a factor; sources that it doesn't name get none, a source named
    several times gets the sum, null weighs nothing, and negative, infinite and NaN weights are refused. Without it a
    source weighs its number of rows to the power ``temperature``. ``rows``: expected rows of the mix, by default those
    of ``docs``. Null is a source of its own. Rows that repeat an id share its draw; rows without id draw by a hash of their
    other columns, so equal ones share a draw.
    Input columns named ``rate``, ``copy`` or ``shuffle_key`` are replaced. An empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("rate", "copy", "shuffle_key")])
    by_source = rates(docs, weights, source_col, rows, temperature).select(F.col("source").alias("__source"), "rate")
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE_MEAN)).cast("int")
    by_source = stored(by_source.withColumn("__pieces", pieces).withColumn("__table", cumulative(F.col("rate") / F.col("__pieces"))), "rates")
    by_source = broadcast_if_small(by_source, 20_000)
    others = [F.col(c).cast("string") if not isinstance(docs.schema[c].dataType, (ArrayType, MapType, StructType)) else F.to_json(F.struct(c)) for c in docs.columns if c != id_col]
    # each part with its length, so that texts that run on into the next column differ
    whole = F.concat_ws("|", *[F.concat_ws(":", F.coalesce(F.length(c), F.lit(-1)).cast("string"), c) for c in others])
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.md5(whole)))

    def drawn(j: Column) -> Column:
        u = uniform(F.lit(str(seed)), key, j.cast("string"))
        return F.size(F.filter("__table", lambda c: c < u))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("__pieces")), drawn), F.lit(0), lambda a, b: a + b)
    joined = docs.join(by_source, null_safe(docs, by_source, {source_col: "__source"}))
    counted = joined.withColumn("__count", count).where("__count > 0").drop("__table", "__pieces", "__source")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__count") - 1))).drop("__count")
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(f"{seed} order"), key, F.col("copy").cast("string"))))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
