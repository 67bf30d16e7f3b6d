"""Stored tables in buckets under interrupted and competing writes, and mergeable summaries against exact ones."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from larder.operators import sketches as sk
from larder.sources import versioned


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("kind"), F.concat(F.lit("v"), "id").alias("text"))
    versioned.create(base, path, ["id"], buckets=16)
    return path, base


def test_upsert_rewrites_changed_buckets_only(spark, stored):
    path, base = stored
    before = versioned.current(spark, path)
    new = spark.createDataFrame([("fix", 3, 1), ("fix", 777, 2)], "text string, id long, kind long")  # other column order
    after = versioned.upsert(new, path)
    want = [r for r in rows_of(base) if r[0] != 3] + [(3, 1, "fix"), (777, 2, "fix")]
    assert rows_of(versioned.read_version(spark, path)) == sorted(want, key=str)
    changed = {b for b in after.folders if after.folders[b] != before.folders.get(b)}
    assert 1 <= len(changed) <= 2 and after.number == 2
    assert rows_of(versioned.read_version(spark, path, before)) == rows_of(base)  # old versions stay readable
    assert versioned.upsert(new.limit(0), path).number == 2


def test_killed_write_leaves_the_old_version(spark, stored):
    path, base = stored

    def broken(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    bad = base.where("id < 200").mapInArrow(broken, base.schema)
    with pytest.raises(Exception, match="lost"):
        versioned.upsert(bad, path)
    assert rows_of(versioned.read_version(spark, path)) == rows_of(base)
    # rows and list are written, the pointer isn't: still the old version
    old = versioned.current(spark, path)
    folders = versioned._written(base.withColumn("kind", F.lit(0)), path, "data/9", ["id"], 16)
    assert len(folders) == 16 and versioned.current(spark, path) == old


def test_two_writers_of_one_version(spark, stored):
    path, base = stored
    old = versioned.current(spark, path)
    versioned.upsert(base.where("id = 1").withColumn("kind", F.lit(9).cast("long")), path)
    late = versioned.Version(2, old.keys, old.buckets, old.schema, old.folders)
    with pytest.raises(Exception, match="(?i)exists"):
        versioned._commit(spark, path, late)
    assert versioned.read_version(spark, path).where("kind = 9").count() == 1


def test_empty_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        versioned.read_version(spark, path)
    none = spark.createDataFrame([], "id long, text string")
    versioned.create(none, path, ["id"])
    assert versioned.read_version(spark, path).count() == 0
    versioned.upsert(spark.createDataFrame([(None, "x"), (2, "y")], "id long, text string"), path)
    versioned.upsert(spark.createDataFrame([(None, "z")], "id long, text string"), path)  # null is a key like others
    assert rows_of(versioned.read_version(spark, path)) == [(2, "y"), (None, "z")]
    assert os.path.exists(f"{path}/current")


def test_merged_sketches_describe_the_union(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("part"), (F.col("id") % 20_011).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.rand(7)).alias("b"), F.lit(None).cast("double").alias("c"))
    stored = sk.sketched(df, ["part"], ["a", "b", "c"])
    got = {r["column"]: r for r in sk.described(sk.merged(stored, []), []).collect()}
    exact = df.agg(F.countDistinct("a"), F.countDistinct("b"), F.avg("a"), F.stddev("a"), F.min("b"), F.max("b")).first()
    assert got["a"]["n"] == 60_000 and got["b"]["n"] == 48_000 and got["c"]["n"] == 0
    assert abs(got["a"]["distinct"] - exact[0]) <= sk.DISTINCT_ERROR * exact[0] and abs(got["b"]["distinct"] - exact[1]) <= sk.DISTINCT_ERROR * exact[1]
    assert abs(got["a"]["mean"] - exact[2]) < 1e-6 and abs(got["a"]["sd"] - exact[3]) < 1e-6 and (got["b"]["least"], got["b"]["most"]) == (exact[4], exact[5])
    assert got["b"]["null_share"] == 0.2 and got["c"]["mean"] is None and got["c"]["q50"] is None and got["c"]["distinct"] == 0
    for q in (0.25, 0.5, 0.75):
        assert abs(df.where(F.col("b") <= got["b"][f"q{round(100 * q)}"]).count() / 48_000 - q) <= sk.RANK_ERROR
    whole = {r["column"]: r["distinct"] for r in sk.described(sk.sketched(df, [], ["a", "b", "c"]), []).collect()}
    assert whole == {c: r["distinct"] for c, r in got.items()}  # merging loses nothing
