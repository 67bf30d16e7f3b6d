"""Exact de-duplication through a cuckoo-filter index of live digests.

The index is a table with one row per bucket of digests (``bucket`` = leading bits of the SHA-256 modulo the number of
buckets). A row holds a cuckoo filter (16-bit fingerprints, two homes of four slots) and the bucket's content: the full
digests, the id that stays and the group's size. A fingerprint hit is verified against the stored digest; an insertion
that finds no home after ``KICKS`` moves rebuilds the filter at twice the size from the stored digests. Digests can be
deleted, which frees their slot.

Copies are combined twice: each task passes its rows through a filter of its own and sends one row per digest and
``FLUSH`` distinct digests, so that a group holding a third of all rows reaches its bucket as a few rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from larder.llm.common import ascii_lower, broadcast_if_small, null_safe, stored

#: Distinct digests that a task gathers before it sends them on.
FLUSH = 200_000
#: Rows of the input for each bucket of the index, on average.
BUCKET_ROWS = 4_096
KICKS, SLOTS = 200, 4

STATE = "bucket long, homes int, fingerprints binary, refs binary, digests binary, ids binary, has_id binary, counts binary, at_top binary"
_STATE_COLUMNS = [x.split()[0] for x in STATE.split(", ")]


class Cuckoo:
    """A cuckoo filter over digests with its content. ``ids``: the largest id of each digest, None without one."""

    def __init__(self, homes: int = 64):
        self.digests: list[bytes | None] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []
        self.at_top: list[int] = []
        self._empty(homes)

    def _empty(self, homes: int) -> None:
        self.homes, self.prints, self.refs = homes, [0] * (homes * SLOTS), [-1] * (homes * SLOTS)

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[8:18], "big")
        mark, one = (h & 0xFFFF) or 1, (h >> 16) & (self.homes - 1)
        return mark, one, self._other(one, mark)

    def _other(self, home: int, mark: int) -> int:
        return home ^ ((mark * 0x5BD1E995 >> 7) & (self.homes - 1))

    def find(self, digest: bytes) -> int:
        """Where the digest's content is, -1 if it isn't live. Fingerprint hits are verified."""
        mark, one, two = self._place(digest)
        for home in (one, two):
            for s in range(home * SLOTS, home * SLOTS + SLOTS):
                if self.prints[s] == mark and self.digests[self.refs[s]] == digest:
                    return self.refs[s]
        return -1

    def _settle(self, ref: int) -> bool:
        mark, one, two = self._place(self.digests[ref])
        home = one
        for kick in range(KICKS):
            for h in (one, two) if not kick else (home,):
                for s in range(h * SLOTS, h * SLOTS + SLOTS):
                    if not self.prints[s]:
                        self.prints[s], self.refs[s] = mark, ref
                        return True
            s = home * SLOTS + (mark + kick) % SLOTS
            mark, self.prints[s] = self.prints[s], mark
            ref, self.refs[s] = self.refs[s], ref
            home = self._other(home, mark)
        return False

    def insert(self, digest: bytes, top: int | None, count: int = 1, at_top: int = 1) -> None:
        at = self.find(digest)
        if at >= 0:
            old = self.ids[at]
            if top == old:
                self.at_top[at] += at_top
            elif old is None or (top is not None and top > old):
                self.ids[at], self.at_top[at] = top, at_top
            self.counts[at] += count
            return
        self.digests.append(digest)
        self.ids.append(top)
        self.counts.append(count)
        self.at_top.append(at_top)
        if not self._settle(len(self.digests) - 1):
            self._grow()

    def _grow(self) -> None:
        homes = self.homes
        while True:
            homes *= 2
            self._empty(homes)
            if all(self._settle(i) for i, d in enumerate(self.digests) if d is not None):
                return

    def delete(self, digest: bytes) -> bool:
        at = self.find(digest)
        if at < 0:
            return False
        for s in (s for home in self._place(digest)[1:] for s in range(home * SLOTS, home * SLOTS + SLOTS)):
            if self.refs[s] == at:
                self.prints[s], self.refs[s] = 0, -1
        self.digests[at] = None
        return True

    def live(self) -> list[tuple[bytes, int | None, int, int]]:
        return [x for x in zip(self.digests, self.ids, self.counts, self.at_top, strict=True) if x[0] is not None]

    def row(self, bucket: int) -> dict:
        rows = self.live()
        if len(rows) < len(self.digests):  # freed places go
            at = {d: i for i, (d, *_) in enumerate(rows)}
            self.refs = [at[self.digests[r]] if r >= 0 else -1 for r in self.refs]
            self.digests, self.ids, self.counts, self.at_top = ([x[i] for x in rows] for i in range(4))
        pack = lambda x, kind: np.asarray(x, kind).tobytes()
        return {
            "bucket": bucket, "homes": self.homes, "fingerprints": pack(self.prints, np.uint16), "refs": pack(self.refs, np.int32), "digests": b"".join(self.digests),
            "ids": pack([x or 0 for x in self.ids], np.int64), "has_id": pack([x is not None for x in self.ids], np.uint8), "counts": pack(self.counts, np.int64), "at_top": pack(self.at_top, np.int64),
        }

    @classmethod
    def of(cls, row) -> Cuckoo:
        out = cls(int(row.homes))
        read = lambda x, kind: np.frombuffer(x, kind).tolist()
        out.prints, out.refs = read(row.fingerprints, np.uint16), read(row.refs, np.int32)
        out.digests = [bytes(row.digests[i : i + 32]) for i in range(0, len(row.digests), 32)]
        out.ids = [x if ok else None for x, ok in zip(read(row.ids, np.int64), read(row.has_id, np.uint8), strict=True)]
        out.counts, out.at_top = read(row.counts, np.int64), read(row.at_top, np.int64)
        return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id long, digest binary): SHA-256 of each text in UTF-8 after lower-casing A-Z only; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([hashlib.sha256(t).digest() for t in ascii_lower(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made], ["id", "digest"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, digest binary")


def combined(rows: DataFrame) -> DataFrame:
    """Rows (digest, top, n, at_top) of each task's part of (id, digest): one per digest and FLUSH distinct digests."""

    def out(index: Cuckoo) -> pa.RecordBatch:
        cols = list(zip(*index.live(), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["digest", "top", "n", "at_top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Cuckoo(1024)
        for b in batches:
            for i, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                index.insert(d, i)
                if len(index.digests) >= FLUSH:
                    yield out(index)
                    index = Cuckoo(1024)
        if index.digests:
            yield out(index)

    return rows.select("id", "digest").mapInArrow(run, "digest binary, top long, n long, at_top long")


def updated(state: DataFrame | None, changes: DataFrame, buckets: int) -> DataFrame:
    """The index after ``changes`` (digest, top, n, at_top, and optionally ``gone`` boolean for deletions).

    ``state``: an index of as many buckets, or None for an empty one. Deletions come after insertions of the same call.
    """
    spark = changes.sparkSession
    changes = changes if "gone" in changes.columns else changes.withColumn("gone", F.lit(False))
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long"), F.lit(buckets))
    changes = changes.withColumn("bucket", bucket).groupBy("bucket")
    if state is None:
        state = spark.createDataFrame([], STATE)

    def run(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        index = Cuckoo.of(next(old.itertuples())) if len(old) else Cuckoo()
        bucket = int((old if len(old) else new)["bucket"].iloc[0])
        for d, top, n, at, gone in zip(new["digest"], new["top"], new["n"], new["at_top"], new["gone"], strict=True):
            if not gone:
                index.insert(bytes(d), None if pd.isna(top) else int(top), int(n), int(at))
        for d, gone in zip(new["digest"], new["gone"], strict=True):
            if gone:
                index.delete(bytes(d))
        return pd.DataFrame([index.row(bucket)], columns=_STATE_COLUMNS)

    return state.groupBy("bucket").cogroup(changes).applyInPandas(run, STATE)


def entries(state: DataFrame) -> DataFrame:
    """Rows (digest, keep_id, group_size, at_top) of all live digests of an index."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                out = pd.DataFrame(Cuckoo.of(row).live(), columns=["digest", "keep_id", "group_size", "at_top"])
                yield out.astype({"keep_id": "Int64"})

    return state.mapInPandas(run, "digest binary, keep_id long, group_size long, at_top long")


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    rows = stored(digests(docs, id_col, text_col), "digests")
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    return rows, entries(updated(None, combined(rows), buckets))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest id of a group
    stays; a null id is below all others and stays only in a group without ids. Rows that repeat an id within a group
    share its verdict. An empty table gives an empty result; other columns are ignored.
    """
    rows, groups = _groups(docs, id_col, text_col)
    joined = rows.join(groups, "digest")
    return joined.select("id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with the columns of ``docs``.

    Where the staying id is repeated within its group, one of its rows stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([hashlib.sha256(t).digest() for t in ascii_lower(b.column(text_col))], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, "__digest"])

    rows, groups = _groups(docs, id_col, text_col)
    groups = stored(groups.where("group_size > 1"), "copies")
    gone = stored(rows.join(groups, "digest").where(~F.col("id").eqNullSafe(F.col("keep_id"))).select("id", "digest").distinct(), "gone")
    again = groups.where("at_top > 1").select(F.col("keep_id").alias("id"), "digest")
    own = docs.withColumn("__id", F.col(id_col).cast("long"))
    own = own.mapInArrow(run, StructType([*own.schema.fields, StructField("__digest", BinaryType())]))
    on = {"__id": "id", "__digest": "digest"}
    kept = own.join(gone := broadcast_if_small(gone), null_safe(own, gone, on), "left_anti")
    if not again.isEmpty():
        again = broadcast_if_small(again)
        match = null_safe(kept, again, on)
        kept = kept.join(again, match, "left_anti").unionByName(kept.join(again, match, "left_semi").dropDuplicates(["__id", "__digest"]))
    return kept.select(*docs.columns)
