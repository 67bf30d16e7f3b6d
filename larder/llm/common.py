"""What several corpus operators share: reading, scratch tables, size-checked broadcasts, words and shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.session import scratch_path

#: Rows up to which a table of short columns (ids, digests, scores) counts as small enough to broadcast.
BROADCAST_ROWS = 200_000

#: White space between words, in Java's and Python's pattern syntax.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of one text that are turned into Python objects at a time.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint when ``df`` (cheap to count: a stored table) has at most ``rows`` rows; else the shuffled join stands."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Refuse input columns that the operator would overwrite or confuse with its own."""
    clash = [c for c in df.columns if c.lower() in {n.lower() for n in names}]
    return df.drop(*clash)


def null_safe(left: DataFrame, right: DataFrame, on: dict[str, str]) -> Column:
    """Join condition in which null equals null; ``on`` maps left to right columns."""
    out = None
    for a, b in on.items():
        c = left[a].eqNullSafe(right[b])
        out = c if out is None else out & c
    return out


def ascii_lower(texts: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text with only A-Z lower-cased; null is empty."""
    for v in texts:
        yield b"" if not v.is_valid else v.as_py().encode("utf-8", "surrogatepass").lower()


def word_hashes(lowered: bytes) -> np.ndarray:
    """64-bit hash of each word between white space, in order. Only PIECE bytes at a time become Python objects."""
    out, at, digest = [], 0, xxhash.xxh3_64_intdigest
    while at < len(lowered):
        end = min(at + PIECE, len(lowered))
        while end < len(lowered) and lowered[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = lowered[at:end].split()
        out.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of the whole sequence where it is shorter; empty without words."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    h = np.full(n, np.uint64(min(width, len(words))))
    for i in range(min(width, len(words))):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return np.unique(h)


def segments(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Cut a stream sorted by ``key`` into tables that hold whole groups; only the last, still open group is carried over."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key)
        if held and held[-1].column(key)[-1].as_py() != k[0].as_py():
            yield pa.concat_tables(held).combine_chunks()
            held = []
        last, n = k[-1].as_py(), t.num_rows
        first = n
        while first and k[first - 1].as_py() == last:
            first -= 1
        if first and held:
            yield pa.concat_tables([*held, t.slice(0, first)]).combine_chunks()
            held = []
        elif first:
            yield t.slice(0, first).combine_chunks()
        held.append(t.slice(first))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def group_starts(keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal values, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]).astype(np.int64)
