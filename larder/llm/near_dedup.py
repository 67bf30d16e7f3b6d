"""Near-duplicates by a set-similarity join on minwise tokens.

Each distinct shingle set has ``COORDINATES`` minwise tokens (the least value of its shingles under independent
permutations). The root, and every node that is far too large, branches by coordinates that no other step uses: sets with
the same token at a coordinate go to the same child. A pair of similarity ``s`` shares each token with probability ``s``,
so a step of ``k`` coordinates loses it with ``(1 - s) ** k``, whatever the node's size; ``k`` makes all steps together lose
a pair at the threshold with at most ``1 - recall``. Nodes of at most ``SMALL`` sets are compared exhaustively on their
tokens, larger ones in pairs of blocks, which loses nothing; sets whose estimated similarity is within ``SLACK`` standard
errors of the threshold form candidate classes, and each class is confirmed on full shingle sets.

Equal sets count as one from the start, links go on as the spanning tree of their class, never as all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from larder.llm.common import ascii_lower, broadcast_if_small, group_starts, mixed, segments, shingles, stored, word_hashes
from larder.llm.components import components

COORDINATES = 128
#: Most sets, and most shingles together, of a node that is compared exhaustively (two sets always are).
SMALL, SMALL_SHINGLES = 1_024, 8_000_000
#: Standard errors of the estimate by which a candidate may fall short of the threshold.
SLACK = 4.0
#: Nodes of so many times SMALL are compared in blocks at once; larger ones are split first, in STEPS steps at most (a
#: split of sets that are much alike makes more copies than it saves comparisons).
BLOCKED, STEPS = 8, 1

_RNG = np.random.default_rng(20_160_417)
_ODD = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1)
_XOR = _RNG.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def sketch(h: np.ndarray) -> np.ndarray:
    """Least value of the shingles under each permutation of 32-bit values."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        part = (low[i : i + 1024, None] ^ _XOR) * _ODD
        np.minimum(out, (part ^ (part >> np.uint32(15))).min(0), out=out)
    return out


def _sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    for t in ascii_lower(texts):
        yield shingles(word_hashes(t), width)


def signed(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Rows (id, key, n, sketch): key is a 128-bit digest of the shingle set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, sketches = [], [], []
            for s in _sets(b.column(1), width):
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s))
                sketches.append(sketch(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["id", "key", "n", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, key binary, n long, sketch binary")


def _bits(tokens: np.ndarray) -> np.ndarray:
    """One bit of each of the first 64 tokens, as one integer: two sets differ in half of the bits of the tokens that they don't share."""
    low = (tokens[:, :64] >> np.uint64(7)) & np.uint64(1)
    return (low << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).astype(np.int64)


def _marks(sketch: str) -> Column:
    """One byte of each token, enough to compare by."""

    @F.pandas_udf(BinaryType())
    def low(s: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.uint8)[::4].tobytes() for x in s])

    return low(sketch)


def _paths(threshold: float, recall: float) -> int:
    """Coordinates of a step, so that all steps together lose a pair at the threshold with at most ``1 - recall``."""
    lost = (1 - recall) / (STEPS + 1)
    paths = max(1, math.ceil(math.log(lost) / math.log(max(1 - threshold, 1e-9))))
    if paths * (STEPS + 1) > COORDINATES:
        raise ValueError(f"a recall of {recall} at {threshold} takes more than {COORDINATES} coordinates")
    return paths


def _branched(sets: DataFrame, step: int, paths: int) -> DataFrame:
    """Rows (node, key, n, bits) of the children that each row goes to, one for each coordinate of the step. ``sets``: (key, n, sketch, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            tokens = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            nodes = np.asarray(b.column(2)).astype(np.uint64)
            bits = pa.array(_bits(tokens))
            for at in range(step * paths, (step + 1) * paths):
                child = mixed(nodes ^ mixed(tokens[:, at] + (np.uint64(at + 1) << np.uint64(32))))
                yield pa.RecordBatch.from_arrays([pa.array(child.astype(np.int64)), b.column(0), b.column(3), bits], ["node", "key", "n", "bits"])

    return sets.select("key", "sketch", "node", "n").mapInArrow(run, "node long, key binary, n long, bits long")


def _classes(groups: DataFrame, threshold: float) -> DataFrame:
    """Rows (class, key): within each group of (grp, key, n, marks), the sets that candidates connect; classes that several groups find count once."""
    least = max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / COORDINATES))

    def linked(s: np.ndarray, n: np.ndarray, i: int, among: np.ndarray) -> np.ndarray:
        fit = np.minimum(n[among], n[i]) >= threshold * np.maximum(n[among], n[i]) - 1e-9
        among = among[fit]
        return among[(s[among] == s[i]).mean(1) >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in segments(batches, "grp"):
            keys = t.column("key").to_pylist()
            n = np.asarray(t.column("n"))
            s = np.frombuffer(b"".join(t.column("marks").to_pylist()), np.uint8).reshape(-1, COORDINATES)
            starts = group_starts(np.asarray(t.column("grp")))
            out_class, out_key = [], []

            def give(rows) -> None:
                own = sorted({keys[i] for i in rows})
                if len(own) > 1:
                    out_class.extend([xxhash.xxh3_128_digest(b"".join(own))] * len(own))
                    out_key.extend(own)

            sizes = np.diff(starts)
            two = starts[:-1][sizes == 2]
            fit = np.minimum(n[two], n[two + 1]) >= threshold * np.maximum(n[two], n[two + 1]) - 1e-9
            two = two[fit]
            for i in two[(s[two] == s[two + 1]).mean(1) >= least] if len(two) else ():
                give((i, i + 1))
            for a, z in zip(starts[:-1][sizes > 2], starts[1:][sizes > 2], strict=True):
                if z - a <= 64 and ((s[a:z, None] == s[None, a:z]).mean(2) >= least).sum() == z - a:
                    continue  # no candidate but each set itself
                rest = np.arange(a, z)
                while len(rest) > 1:
                    found, todo, rest = [rest[0]], [rest[0]], rest[1:]
                    while todo and len(rest):
                        near = linked(s, n, todo.pop(), rest)
                        if len(near):
                            found.extend(near)
                            todo.extend(near)
                            rest = np.setdiff1d(rest, near, assume_unique=True)
                    give(found)
            if out_key:
                yield pa.RecordBatch.from_arrays([pa.array(out_class, pa.binary()), pa.array(out_key, pa.binary())], ["class", "key"])

    dealt = groups.select("grp", "key", "n", "marks").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(run, "class binary, key binary").distinct()


def _confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that span the connected parts of each class of (class, key, shingles), every one confirmed on full sets: 100 * |A and B| >= percent * |A or B|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in segments(batches, "class"):
            keys, classes, parts = t.column("key").to_pylist(), t.column("class").to_pylist(), t.column("shingles").to_pylist()
            cut = [0, *(i for i in range(1, len(keys)) if classes[i] != classes[i - 1]), len(keys)]
            links = []
            for a, z in zip(cut, cut[1:], strict=False):
                own = {keys[i]: np.frombuffer(parts[i], np.uint64) for i in range(a, z)}
                links += _spanning(list(own), list(own.values()), percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return sets.repartition("class").sortWithinPartitions("class").mapInArrow(run, "a binary, b binary")


def _spanning(keys: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Breadth first: each set met is compared with all sets not met yet."""
    if len(keys) == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return [tuple(keys)] if 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    n = np.array([len(s) for s in sets])
    values, places = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(n)])
    rest, links = np.arange(len(keys)), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            i = todo.pop()
            mark = np.zeros(len(values), np.int64)
            mark[places[at[i] : at[i + 1]]] = 1
            both = np.add.reduceat(mark[places], at[:-1])[rest]
            near = rest[100 * both >= percent * (n[rest] + n[i] - both)]
            links += [(keys[i], keys[j]) for j in near]
            todo.extend(near)
            rest = np.setdiff1d(rest, near, assume_unique=True)
    return links


def _seen() -> list[Column]:
    """Of each node: what identifies its sets, and what shows a node of two sets to be no candidate."""
    return [F.bit_xor(F.xxhash64("key")).alias("same"), F.bit_xor("bits").alias("differ"), F.min("n").alias("least"), F.max("n").alias("most")]


def _most_bits(threshold: float) -> int:
    """Of 64 bits, the most in which two sets at the threshold differ, by SLACK standard errors."""
    p = (1 - threshold) / 2
    return math.ceil(64 * p + SLACK * math.sqrt(64 * p * (1 - p)))


def _in_blocks(stubborn: DataFrame) -> DataFrame:
    """Groups (grp, key, n, marks) in which every two sets of a large node meet: pairs of blocks of half a small node each."""
    half = SMALL // 2
    blocks = F.ceil(1.3 * F.greatest(F.col("size") / half, 2 * F.col("shingles") / SMALL_SHINGLES)).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = stubborn.withColumn("blocks", blocks).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("grp"), "key", "n", "marks")


def _linked(signs: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, recall: float) -> DataFrame:
    """Links (a, b) between keys of ``signs`` that span all connected parts."""
    threshold = percent / 100
    paths = _paths(threshold, recall)
    distinct = signs.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id", "n", "sketch")).alias("x"))
    distinct = stored(distinct.select("key", "x.id", "x.n", "x.sketch"), "sets")
    marks = distinct.select("key", _marks("sketch").alias("marks"))
    parents = distinct.select("key", "n", "sketch", F.lit(0).cast("long").alias("node"))
    classes: DataFrame | None = None
    for step in range(STEPS + 1):
        rows = stored(_branched(parents, step, paths), "nodes")
        nodes = rows.groupBy("node").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), *_seen())
        nodes = stored(nodes.where("size > 1").where(f"size > 2 or (least >= {threshold} * most and bit_count(differ) <= {_most_bits(threshold)})"), "sizes")
        is_large = f"size > {SMALL} or (size > 2 and shingles > {SMALL_SHINGLES})"
        small = nodes.where(f"not ({is_large})").groupBy("size", "same").agg(F.min("node").alias("node"))  # nodes of the same sets count once
        found = _classes(rows.drop("bits").join(small.select("node"), "node").join(marks, "key").withColumnRenamed("node", "grp"), threshold)
        classes = found if classes is None else classes.union(found)
        large = nodes.where(is_large).groupBy("size", "same").agg(F.min("node").alias("node"), F.max("shingles").alias("shingles")).drop("same")
        if large.isEmpty():
            break
        huge = large.where(f"size > {BLOCKED * SMALL} or shingles > {BLOCKED * SMALL_SHINGLES}")
        last = step == STEPS or huge.isEmpty()
        blocked = large if last else large.where(f"size <= {BLOCKED * SMALL} and shingles <= {BLOCKED * SMALL_SHINGLES}")
        classes = classes.union(_classes(_in_blocks(rows.drop("bits").join(blocked, "node").join(marks, "key")), threshold))
        if last:
            break
        parents = rows.drop("bits").join(huge.select("node"), "node").join(distinct.select("key", "sketch"), "key")
    classes = stored(classes.distinct(), "classes")
    needed = stored(classes.join(distinct.select("key", "id"), "key"), "needed")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # a set is in few classes, one for each node that finds it at most
    by_id = needed.where("id is not null").groupBy("id").agg(F.collect_list(F.struct("key", "class")).alias("of"))
    named = texts.join(broadcast_if_small(by_id), "id").select("text", "of")
    full = named.mapInArrow(_full_sets(width), "class binary, key binary, shingles binary")
    if not needed.where("id is null").isEmpty():  # sets that only rows without id have are found by their digest
        lost = needed.where("id is null").select("key", "class")
        sets = texts.where("id is null").select("text").mapInArrow(_keyed_sets(width), "key binary, shingles binary")
        full = full.unionByName(sets.join(lost, "key").select("class", "key", "shingles"))
    return _confirmed(full, percent)


def _keyed_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [s.tobytes() for s in _sets(b.column(0), width)]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(p) for p in packed], pa.binary()), pa.array(packed, pa.binary())], ["key", "shingles"])

    return run


def _full_sets(width: int):
    """Rows (class, key, shingles) from texts and the (key, class) pairs of their id; other texts of a repeated id give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            classes, keys, parts = [], [], []
            for s, pairs in zip(_sets(b.column(0), width), b.column(1).to_pylist(), strict=True):
                packed = s.tobytes()
                own = xxhash.xxh3_128_digest(packed)
                for x in pairs:
                    if x["key"] == own:
                        classes.append(x["class"])
                        keys.append(own)
                        parts.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (classes, keys, parts)], ["class", "key", "shingles"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Texts are lower-cased (A-Z only), words are runs of other than white space, a document's set is its distinct runs of
    ``width`` words, or all its words as one run where there are fewer. Sets A and B are linked when
    ``100 * |A and B| >= percent * |A or B|``. ``component_id``: the smallest id reachable through links. A null or empty
    text has an empty set and is linked with nothing. Null ids are passed over as component ids; a row without id is
    kept only where no row of its component has an id. Repeated rows each come back. Other columns are ignored.
    """
    signs = stored(signed(docs, id_col, text_col, width), "signed")
    links = _linked(signs, docs, id_col, text_col, width, percent, recall)
    roots = components(links)
    sets = signs.where("key is not null").groupBy("key").agg(F.min("id").alias("id"))
    sets = sets.join(roots, sets["key"] == roots["node"], "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    sets = stored(sets, "roots")
    least = sets.groupBy("root").agg(F.min("id").alias("component_id"))
    named = sets.join(least, "root").select("key", "component_id")
    full = signs.where("key is not null").select("id", "key", "n").join(named, "key").select("id", F.col("n").alias("n_shingles"), "component_id")
    empty = signs.where("key is null").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return full.union(empty).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with the columns of ``docs``.

    Rows that share id and component stay or go together; rows without id stay.
    """
    marked = near_duplicates(docs, id_col, text_col, **settings)
    gone = stored(marked.where(~F.col("kept") & F.col("id").isNotNull()).select(F.col("id").alias("__gone")).distinct(), "gone")
    gone = broadcast_if_small(gone)
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
