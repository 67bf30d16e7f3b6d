"""Sharding by a hierarchical weighted hash tree.

A key descends regions, racks and shards. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from key
and child, and the least draw wins: a child wins in proportion to its weight, and when one child's weight grows, keys move
only into it. A change of weights therefore moves keys only into, out of or within the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, stored
from larder.llm.mixing import uniform

#: Shards of a rack, racks of a region, and shards of the plan that fills them.
RACK, REGION, PLANNED = 5, 2, 40
#: Rows that are numbered in one window, on average.
WINDOW_ROWS = 2_000


@dataclass(frozen=True)
class Shard:
    number: int
    region: str
    rack: str
    weight: float = 1.0


def topology(shards: int, planned: int = PLANNED, weights: dict[int, float] | None = None) -> list[Shard]:
    """The first ``planned`` shards fill racks and regions; shards added to the plan are regions of their own.

    So one more shard (beyond ``planned``, or below it) takes keys only into itself; a new plan moves keys between regions.
    """
    out = []
    for i in range(shards):
        full = shards >= planned and i < planned
        region, rack = (f"region{i // (RACK * REGION)}", f"rack{i // RACK}") if full else (f"region-of-shard{i}", f"rack-of-shard{i}")
        out.append(Shard(i, region, rack, (weights or {}).get(i, 1.0)))
    return out


def _winner(children: Column, key: Column) -> Column:
    """The child struct (name, weight, ...) with the least draw; the smallest name of equal draws."""
    draws = F.transform(children, lambda c: F.struct((-F.log(uniform(key, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name"), c.alias("child")))
    return F.array_min(draws)["child"]


def placed(key: Column, tree: list[Shard]) -> Column:
    """The shard number of ``key``; shards of no weight get none."""
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in tree:
        if s.weight > 0:
            regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    leaf = lambda s: F.struct(F.lit(f"shard{s.number}").alias("name"), F.lit(float(s.weight)).alias("weight"), F.lit(s.number).alias("number"))
    total = lambda shards: F.lit(float(sum(s.weight for s in shards))).alias("weight")
    rack = lambda name, shards: F.struct(F.lit(name).alias("name"), total(shards), F.array(*map(leaf, shards)).alias("below"))
    region = lambda name, racks: F.struct(F.lit(name).alias("name"), total([s for x in racks.values() for s in x]), F.array(*[rack(*x) for x in racks.items()]).alias("below"))
    top = F.array(*[region(*x) for x in regions.items()])
    return _winner(_winner(_winner(top, key)["below"], key)["below"], key)["number"]


def numbered(rows: DataFrame, group: str, order: list[Column], slices: int) -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 within ``group``, in the order of a hash column ``__hash`` and ``order``.

    A group is cut by the leading digits of the hash into 16**digits slices of ``slices`` at least; slices are numbered
    each on its own and moved up by the rows of the slices before.
    """
    digits = max(1, len(f"{max(1, slices - 1):x}"))
    cut = rows.withColumn("__slice", F.substring("__hash", 1, digits))
    sizes = stored(cut.groupBy(group, "__slice").agg(F.count("*").alias("__size")), "slices")
    before = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, "__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, "__slice").orderBy("__hash", *order)
    own = cut.withColumn("__own", F.row_number().over(inside) - 1)
    joined = own.join(broadcast_if_small(sizes, 100_000), [group, "__slice"])
    return joined.withColumn("slot", F.col("__before") + F.col("__own")).drop("__own", "__before", "__slice")


def sharded(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tree: list[Shard] | None = None, grown: list[Shard] | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    ``size``: UTF-8 bytes of the text plus 16; ``text_crc32`` of those bytes; a null text has none. Law ``key``: the id and
    the tree decide. A row without id goes by its text. ``slot`` numbers a shard's rows from 0 by the hash of the key, then
    id, size and crc. ``grown_shard``: the shard with one more (or in the tree ``grown``). Repeated rows get slots of their
    own. Other columns are ignored. An empty table gives an empty result.
    """
    tree, grown = tree or topology(shards), grown or topology(shards + 1)
    data = F.encode(F.coalesce(text_col, F.lit("")), "UTF-8")
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.sha2(data, 256)))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(F.coalesce(text_col, F.lit(""))) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), key.alias("__key"))
    rows = rows.withColumns({"shard": placed(F.col("__key"), tree), "grown_shard": placed(F.col("__key"), grown), "__hash": F.md5(F.concat(F.lit("slot|"), "__key"))})
    rows = stored(rows.withColumn("law", F.lit("key")), "placed")
    slices = -(-rows.count() // (WINDOW_ROWS * len(tree)))
    out = numbered(rows, "shard", [F.col("id"), F.col("size"), F.col("text_crc32")], slices)
    return out.select("id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
