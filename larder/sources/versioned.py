"""A stored table in hash buckets whose corrections rewrite only the buckets that they touch.

A version is a list of one folder per bucket. An upsert writes the changed buckets anew, beside the old ones, then the list of
the new version, then the pointer to it; the last step is one rename. Readers follow the pointer, so a write that dies
at any point leaves the version before it. Two writers of one version meet at its list, which only one can create.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larder.operators.relational import anti, bounded_rows

#: Most buckets of a table: their folders are listed by the driver.
MAX_BUCKETS = 10_000
BUCKET = "__bucket"


class _Files:
    """Small files in whatever store the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        stream = self.fs.create(self._at(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, source: str, target: str) -> None:
        """Rename over a file, in one step where the store can; else a reader may wait a moment for the pointer."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri())
        option = self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        options = self.jvm.java.lang.reflect.Array.newInstance(option[1].getClass(), 1)
        options[0] = next(o for o in option if o.toString() == "OVERWRITE")
        context.rename(self._at(source), self._at(target), options)


@dataclass(frozen=True)
class Version:
    number: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[int, str]  # buckets without rows have none


def current(spark: SparkSession, path: str) -> Version | None:
    files = _Files(spark, path)
    if not files.exists("current"):
        return None
    told = json.loads(files.read(f"versions/{files.read('current').strip()}.json"))
    return Version(told["number"], told["keys"], told["buckets"], told["schema"], {int(k): v for k, v in told["folders"].items()})


def read_version(spark: SparkSession, path: str, version: Version | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of the current version (or the given one), of some buckets only where they are named."""
    version = version or current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    schema = StructType.fromJson(json.loads(version.schema))
    folders = [f"{path.rstrip('/')}/{f}" for b, f in sorted(version.folders.items()) if buckets is None or b in set(buckets)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _written(rows: DataFrame, path: str, folder: str, keys: list[str], buckets: int) -> dict[int, str]:
    """Buckets and their new folders; a bucket is one task's file, or several by size."""
    spark, files = rows.sparkSession, _Files(rows.sparkSession, path)
    rows.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path.rstrip('/')}/{folder}")
    found = files.fs.listStatus(files._at(folder))
    names = [s.getPath().getName() for s in found]
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def _commit(spark: SparkSession, path: str, version: Version) -> None:
    files = _Files(spark, path)
    # fails where another writer made this version
    files.create(f"versions/{version.number}.json", json.dumps(version.__dict__))
    files.create(f"next-{version.number}", str(version.number), overwrite=True)
    files.replace(f"next-{version.number}", "current")


def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> Version:
    """The first version of a table; ``keys`` tell its rows apart."""
    if not 0 < buckets <= MAX_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MAX_BUCKETS}")
    made = Version(1, keys, buckets, rows.schema.json(), _written(rows, path, "data/1", keys, buckets))
    _commit(rows.sparkSession, path, made)
    return made


def upsert(rows: DataFrame, path: str) -> Version:
    """The next version: ``rows`` take the place of all rows with their keys; buckets without any of them keep their files."""
    spark = rows.sparkSession
    old = current(spark, path)
    if old is None:
        raise FileNotFoundError(f"no table at {path}")
    number = old.number + 1
    names = StructType.fromJson(json.loads(old.schema)).names
    new = rows.select(*names)
    touched = new.select(_bucket(old.keys, old.buckets).alias("b")).distinct()
    changed = sorted(r["b"] for r in bounded_rows(touched, MAX_BUCKETS, "buckets"))
    if not changed:
        return old
    kept = anti(read_version(spark, path, old, changed), new, old.keys)
    folders = _written(kept.unionByName(new), path, f"data/{number}", old.keys, old.buckets)
    made = Version(number, old.keys, old.buckets, old.schema, {**{b: f for b, f in old.folders.items() if b not in changed}, **folders})
    _commit(spark, path, made)
    return made
