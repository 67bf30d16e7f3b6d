"""Byte-level BPE: encoding to ids and decoding back to raw bytes.

Long texts are cut into overlapping chunks that are pre-tokenised in parallel. Two neighbours are stitched at the first
position of their overlap where both end a pre-token on other than white space: the pattern looks at no text before a
pre-token, so from there on both chunks agree with the whole text. The pieces between the stitches are encoded in
parallel and their ids concatenated in order. A text whose chunks never resynchronise (a run of letters longer than the
overlap) is encoded as one piece. Texts within one chunk are their own piece and are not moved between tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 65_536, 2_048


class Vocabulary:
    """The bytes of a rank file and its pattern; read on the driver and sent to the tasks, so no task needs the file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern


@lru_cache(2)
def _encoding(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    raw = [b""] * (max(merges.values()) + 1)
    for token, i in merges.items():
        raw[i] = token
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={}), raw


def _pieces_encoded(pieces: DataFrame, vocabulary, decode: bool) -> DataFrame:
    """``pieces`` with the text as last column, in whose place come ``ids`` and, if asked, the bytes ``decoded`` from them."""
    kept = pieces.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, raw = _encoding(vocabulary.value.ranks, vocabulary.value.pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # the ids of few texts at a time are Python objects
                part = b.slice(at, 256)
                ids = [encoding.encode_ordinary(t or "") for t in part.column(len(kept)).to_pylist()]
                cols = [*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))]
                if decode:
                    cols.append(pa.array([b"".join(map(raw.__getitem__, x)) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, [*kept, "ids", *["decoded"] * decode])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields[:-1])
    return pieces.mapInArrow(run, f"{schema}{', ' * bool(kept)}ids array<int>{', decoded binary' * decode}")


def _ends(pattern: regex.Pattern, text: str) -> list[int]:
    """Where pre-tokens end on other than white space; the end of the text isn't one, as more could follow."""
    return [e for m in pattern.finditer(text) if (e := m.end()) < len(text) and not text[e - 1].isspace()]


def _cuts(chunks: DataFrame, vocabulary, chunk: int, overlap: int) -> DataFrame:
    """Rows (sha, cuts): where each text may be cut, from rows (sha, k, text) of its chunks; no cuts where two chunks don't resynchronise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(vocabulary.value.pattern)
        for b in batches:
            ends = [_ends(pattern, t) for t in b.column(2).to_pylist()]
            base = [k * chunk for k in b.column(1).to_pylist()]
            head = [[o + e for e in x if e <= overlap] for o, x in zip(base, ends, strict=True)]
            tail = [[o + e for e in x if e > chunk] for o, x in zip(base, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.list_(pa.int64())) for x in (head, tail))], ["sha", "k", "head", "tail"])

    both = chunks.select("sha", "k", "text").mapInArrow(run, "sha string, k long, head array<long>, tail array<long>")
    # only the overlaps' positions meet here, a bounded list for each chunk of a text
    ordered = both.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail"))).alias("x"))
    pairs = F.transform(F.sequence(F.lit(2), F.size("x")), lambda i: F.array_min(F.array_intersect(F.element_at("x", i - 1)["tail"], F.element_at("x", i)["head"])))
    cuts = F.when(F.size("x") > 1, pairs).otherwise(F.array().cast("array<long>"))
    return ordered.select("sha", F.when(F.exists(cuts, F.isnull), F.array().cast("array<long>")).otherwise(cuts).alias("cuts"))


def encoded(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", decode: bool = False, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs`` with ``ids`` (array of int), and ``decoded`` (binary) if asked, in place of the text column.

    Ids are those that encoding the whole text without special tokens gives. A null or empty text has no ids. Repeated
    long texts are encoded once. Input columns named ``ids`` or ``decoded`` are replaced. An empty table stays empty.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "decoded")])
    kept = [c for c in docs.columns if c != text_col]
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: a rank file
    is_long = F.coalesce(F.length(text_col), F.lit(0)) > chunk + overlap
    short = _pieces_encoded(docs.where(~is_long).select(*kept, F.col(text_col).alias("__text")), held, decode)

    long = docs.where(is_long).withColumn("__sha", F.sha2(text_col, 256))
    texts = long.groupBy(F.col("__sha").alias("sha")).agg(F.first(text_col).alias("text"))
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("long")))
    chunks = texts.withColumn("k", starts).select("sha", "k", F.col("text").substr((F.col("k") * chunk + 1).cast("int"), F.lit(chunk + overlap)).alias("text"))
    cuts = _cuts(chunks.repartition("sha", "k"), held, chunk, overlap)
    bounds = F.concat(F.array(F.lit(0).cast("long")), "cuts", F.array(F.length("text").cast("long")))
    pieces = texts.join(cuts, "sha").withColumn("at", bounds).select("sha", "text", "at", F.explode(F.sequence(F.lit(1), F.size("at") - 1)).alias("k"))
    start, end = F.element_at("at", F.col("k")), F.element_at("at", F.col("k") + 1)
    pieces = pieces.select("sha", "k", F.col("text").substr((start + 1).cast("int"), (end - start).cast("int")).alias("text"))
    done = _pieces_encoded(pieces.repartition("sha", "k"), held, decode)
    fields = ["ids", *["decoded"] * decode]
    ordered = done.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("x"))
    joined = ordered.select(F.col("sha").alias("__key"), F.flatten("x.ids").alias("ids"), *[_joined_bytes("x.decoded").alias("decoded")] * decode)
    return short.unionByName(long.drop(text_col).join(joined, long["__sha"] == joined["__key"]).select(*kept, *fields))


def _joined_bytes(parts: str) -> Column:
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def decoded(tokens: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the concatenated raw bytes of the ids; null ids give null."""
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    tokens = tokens.drop(*[c for c in tokens.columns if c.lower() == "decoded"])

    @F.pandas_udf("binary")
    def raw_bytes(ids: pd.Series) -> pd.Series:
        raw = _encoding(held.value.ranks, held.value.pattern)[1]
        return pd.Series([None if x is None else b"".join(map(raw.__getitem__, x)) for x in ids])

    return tokens.withColumn("decoded", raw_bytes(ids_col))


def digests() -> dict[str, Column]:
    """Columns n_tokens, ids_sha256 and decoded_sha256 from ``ids`` and ``decoded``."""
    return {
        "n_tokens": F.size("ids").cast("long"),
        "ids_sha256": F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256),
        "decoded_sha256": F.sha2(F.col("decoded"), 256),
    }
