"""Quality by importance resampling.

A text's importance is the ratio of its probability under a model of target text to that under a model of raw text. Both
models are frequencies of hashed byte n-grams: of the documents labelled good, and of all documents. Documents are drawn
without replacement in proportion to importance by the Gumbel top-k rule: the ``k`` largest of log importance plus Gumbel
noise, hashed from the id. ``k`` counts the documents whose importance reaches nearly all that of labelled good ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import PIECE, broadcast_if_small, stored

#: Bytes of an n-gram; hash buckets; buckets that travel in one row.
GRAM, BUCKETS, SLICE = 4, 1 << 16, 1 << 10
#: Most labelled rows that the target model and the calibration use, taken by the hash of their id.
LABELLED = 50_000
#: Texts that are Python objects at a time.
ROWS = 256
#: Share of labelled good documents below the level that ``k`` is counted at, and log importance that the level is lowered by.
LOST, MARGIN = 0.001, 3.0


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw frequency of each bucket, and the smallest key that is drawn."""

    ratios: np.ndarray
    least_key: float
    k: int


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of the byte n-grams of a text between line ends, a bounded number at a time."""
    data = np.frombuffer(b"\n" + (text or "").encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    for at in range(0, max(1, len(data) - GRAM + 1), PIECE):
        part = data[at : at + PIECE + GRAM - 1].astype(np.uint32)
        n = len(part) - GRAM + 1
        if n > 0:
            h = np.zeros(n, np.uint32)
            for i in range(GRAM):
                h = h * np.uint32(257) + part[i : i + n]
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            yield (h >> np.uint32(16)).astype(np.int64)


def gumbel(ids: list, texts: list, seed: int) -> np.ndarray:
    """Gumbel noise hashed from seed and id; from the text where there is no id."""
    h = [xxhash.xxh3_64_intdigest(f"{i}" if i is not None else f"text {t}", seed) for i, t in zip(ids, texts, strict=True)]
    return -np.log(-np.log((np.array(h, np.uint64) >> np.uint64(11)).astype(float) / 2**53 + 2**-54))


def _weights(texts: list, ratios: np.ndarray) -> np.ndarray:
    return np.array([sum(float(ratios[g].sum()) for g in grams(t)) for t in texts], float)


def _counts(rows: DataFrame) -> np.ndarray:
    """n-gram counts (2, BUCKETS) over all of (text, good): of all rows, and of those that are good."""

    def packed(counts: np.ndarray, slices) -> pa.RecordBatch:
        slices = list(slices)
        return pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([counts[:, s * SLICE : (s + 1) * SLICE].tobytes() for s in slices], pa.binary())], ["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros((2, BUCKETS), np.int64), False
        for b in batches:
            good = b.column(1).to_pylist()
            for row in (1, 0):  # good rows count in both
                held, size = [], 0
                for t, g in zip(b.column(0), good, strict=True):
                    if bool(g) == bool(row):
                        for x in grams(t.as_py()):
                            held.append(x)
                            size += len(x)
                            if size > PIECE:
                                counts[: row + 1] += np.bincount(np.concatenate(held), minlength=BUCKETS)
                                held, size = [], 0
                if held:
                    counts[: row + 1] += np.bincount(np.concatenate(held), minlength=BUCKETS)
            seen = seen or b.num_rows > 0
        if seen:
            yield packed(counts, range(BUCKETS // SLICE))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, slices = np.zeros((2, BUCKETS), np.int64), set()
        for b in batches:
            for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[:, s * SLICE : (s + 1) * SLICE] += np.frombuffer(c, np.int64).reshape(2, SLICE)
                slices.add(s)
        if slices:
            yield packed(counts, sorted(slices))

    schema = "slice int, counts binary"
    parts = rows.select("text", "good").mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema)
    out = np.zeros((2, BUCKETS), np.int64)
    for s, c in parts.collect():  # bounded: BUCKETS / SLICE rows
        out[:, s * SLICE : (s + 1) * SLICE] += np.frombuffer(c, np.int64).reshape(2, SLICE)
    return out


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1_024) -> float:
    """The ``k``-th largest value of a column by counting bins and narrowing to one of them; -inf where there are at most ``k``."""
    found = values.where(F.col(column).isNotNull()).agg(F.count("*"), F.min(column), F.max(column)).first()
    n, low, high = found
    if n <= k:
        return -math.inf
    if k <= 0:
        return math.inf
    above = 0
    while low < high:
        width = (high - low) / bins
        at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width > 0 else F.lit(0)
        counted = values.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for row in sorted(counted.collect(), key=lambda r: -r["bin"]):  # bounded: one row per bin
            if above + row["n"] >= k:
                low, high = row["low"], row["high"]
                break
            above += row["n"]
    return low


def scored(docs: DataFrame, ratios: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    """Rows (id, log_weight, key)."""
    held = docs.sparkSession.sparkContext.broadcast(ratios)  # bounded: one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                w = _weights(texts, held.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w), pa.array(w + gumbel(part.column(0).to_pylist(), texts, seed))], ["id", "log_weight", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, log_weight double, key double")


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 42) -> tuple[Model, DataFrame]:
    """The model, and the scores (id, log_weight, key) of all rows of ``docs`` as a stored table.

    ``labels`` (id, quality): 1 is good. At most ``labelled`` of them are used. The raw model counts all documents. Without
    labelled good documents all texts weigh the same and all are drawn.
    """
    some = labels.where(f"{id_col} is not null and quality is not null").select(F.col(id_col).alias("__id"), "quality")
    some = stored(some.dropDuplicates(["__id"]).orderBy(F.xxhash64("__id"), "__id").limit(labelled), "labels")
    good = some.where("quality = 1").select("__id")
    marked = docs.join(broadcast_if_small(good.withColumn("__good", F.lit(True))), docs[id_col] == F.col("__id"), "left")
    counts = _counts(marked.select(F.col(text_col).alias("text"), F.coalesce("__good", F.lit(False)).alias("good")))
    share = (counts + 1) / (counts.sum(1, keepdims=True) + BUCKETS)
    ratios = np.log(share[1] / share[0]) if counts[1].sum() else np.zeros(BUCKETS)
    scores = stored(scored(docs, ratios, id_col, text_col, seed), "scores")
    level = scores.join(broadcast_if_small(good), F.col("id") == F.col("__id")).agg(F.percentile("log_weight", F.lit(LOST))).first()[0]
    k = scores.count() if level is None else scores.where(F.col("log_weight") >= F.lit(level - MARGIN)).count()
    return Model(ratios, kth_largest(scores, "key", k), k), scores


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: id, log_weight, key, kept.

    A null text counts as empty. Rows that repeat id and text share their key and stay or go together, as do equal keys at
    the limit. Rows without id draw their noise by text. Labels that name no document or lack a value are passed over.
    Other columns are ignored; an empty table gives an empty result.
    """
    model, scores = fitted(docs, labels, id_col, text_col, labelled, seed)
    return scores.withColumn("kept", F.col("key") >= F.lit(model.least_key))


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that :func:`resampled` keeps, with their columns. Keys are computed again where the texts are."""
    model, _ = fitted(docs, labels, id_col, text_col, labelled, seed)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, texts = part.column(id_col).to_pylist(), part.column(text_col).to_pylist()
                keys = _weights(texts, held.value.ratios) + gumbel(ids, texts, seed)
                yield part.filter(pa.array(keys >= held.value.least_key))

    return docs.mapInArrow(run, docs.schema)
