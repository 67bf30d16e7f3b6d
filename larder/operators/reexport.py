"""Tracing of re-exports: which country's production ends up in which country's supply.

Exports leave a country in proportion to everything it has, grown or imported.  With exports limited to what
is available, the supply matrix is a convergent series of ever longer trade routes, so it solves a linear system.

:func:`solved` takes each item and year as one system of its countries: a task holds it as a matrix.  Systems of more than
``COUNTRIES`` go by :func:`re_export`, which adds up the series; each of its rounds extends all routes of all items and years
by one step: one join on the exporter and one sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from larder.session import reliable_checkpoint

#: Most countries of a system that one task solves; its matrix has the square of that.
COUNTRIES = 1_000
#: Share of a country's amount below which nothing counts as staying: what rounding leaves.
NOTHING = 1e-12


def limited_exports(production: DataFrame, edges: DataFrame, groups: list[str], rounds: int | None = None,
                    max_rounds: int = 600, tolerance: float = 1e-9, every: int = 5) -> DataFrame:
    """Per country: ``available`` (grown and imported), ``wanted`` exports and the ``kept`` share of them.

    A country that reports more exports than it has ships all it has; less arriving elsewhere may limit others
    in turn, so this repeats until nothing changes (or for exactly ``rounds`` rounds).
    """
    out = edges.groupBy(*groups, F.col("exporter").alias("iso3")).agg(F.sum("qty").alias("wanted"))
    arrived = edges.groupBy(*groups, F.col("importer").alias("iso3")).agg(F.sum("qty").alias("arrived"))
    own = production.groupBy(*groups, "iso3").agg(F.sum("production").alias("grown"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    nodes = own.join(out, [*groups, "iso3"], "full").join(arrived, [*groups, "iso3"], "full")
    nodes = nodes.select(*groups, "iso3", zero("grown"), zero("wanted"), zero("arrived"))
    kept = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("grown") + F.col("arrived"), F.col("wanted")), F.lit(1.0)))
    nodes = reliable_checkpoint(nodes.withColumn("kept", kept))
    for i in range(1, (rounds or max_rounds) + 1):
        shares = nodes.select(*groups, F.col("iso3").alias("exporter"), "kept")
        shipped = edges.join(shares, [*groups, "exporter"]).groupBy(*groups, F.col("importer").alias("iso3"))
        shipped = shipped.agg(F.sum(F.col("qty") * F.col("kept")).alias("arrived"))
        nodes = nodes.drop("arrived").withColumnRenamed("kept", "__before").join(shipped, [*groups, "iso3"], "left")
        nodes = nodes.withColumn("arrived", F.coalesce(F.col("arrived"), F.lit(0.0))).withColumn("kept", kept)
        settled = i % every == 0 or i == rounds
        if settled:
            nodes = reliable_checkpoint(nodes)
            moved = nodes.agg(F.max(F.abs(F.col("kept") - F.col("__before")))).first()[0]
            if rounds is None and (moved is None or moved < tolerance):
                break
        nodes = nodes.drop("__before")
    else:
        if rounds is None:
            raise RuntimeError(f"exports did not settle in {max_rounds} rounds")
    return nodes.select(*groups, "iso3", "grown", "wanted", "kept", (F.col("grown") + F.col("arrived")).alias("available"))


def re_export(production: DataFrame, edges: DataFrame, groups: list[str], rounds: int | None = None, limit_rounds: int | None = None,
              max_rounds: int = 600, tolerance: float = 1e-9, every: int = 5) -> DataFrame:
    """Supply by origin: ``(groups, origin, consumer, supply)``.

    ``rounds`` fixes the number of trade steps; by default steps are added until the amount still moving is
    below ``tolerance`` of the total, which takes 17 to 30 rounds on real trade.
    """
    edges = edges.where("exporter <> importer AND qty > 0").groupBy(*groups, "exporter", "importer").agg(F.sum("qty").alias("qty"))
    edges = reliable_checkpoint(edges)
    nodes = limited_exports(production, edges, groups, limit_rounds, max_rounds, tolerance, every)
    rate = nodes.select(*groups, F.col("iso3").alias("at"), F.try_divide("kept", "available").alias("__rate"))
    routes = edges.withColumnRenamed("exporter", "at").join(rate, [*groups, "at"])
    routes = reliable_checkpoint(
        routes.where("__rate > 0").select(*groups, "at", F.col("importer").alias("next"), (F.col("qty") * F.col("__rate")).alias("leaves"))
    )
    start = nodes.where("grown > 0").select(*groups, F.col("iso3").alias("origin"), F.col("iso3").alias("at"), F.col("grown").alias("amount"))
    whole = nodes.agg(F.sum("grown")).first()[0] or 1.0
    passed = start
    for i in range(1, (rounds or max_rounds) + 1):
        moved = passed.join(routes, [*groups, "at"]).select(
            *groups, "origin", F.col("next").alias("at"), (F.col("amount") * F.col("leaves")).alias("amount")
        )
        grown = start.unionByName(moved).groupBy(*groups, "origin", "at").agg(F.sum("amount").alias("amount"))
        if i % every == 0 or i == rounds:
            grown = reliable_checkpoint(grown)
            if rounds is None:
                change = grown.agg(F.sum("amount")).first()[0] - (passed.agg(F.sum("amount")).first()[0] or 0.0)
                passed = grown
                if abs(change) < tolerance * whole:
                    break
        passed = grown
    else:
        if rounds is None:
            raise RuntimeError(f"re-exports still moved more than {tolerance} of the total after {max_rounds} rounds")
    stays = F.try_divide(F.col("available") - F.col("kept") * F.col("wanted"), F.col("available"))
    home = nodes.select(*groups, F.col("iso3").alias("at"), F.greatest(stays, F.lit(0.0)).alias("__stays"))
    out = passed.join(home, [*groups, "at"]).withColumn("supply", F.col("amount") * F.col("__stays"))
    return out.where("supply > 0").select(*groups, "origin", F.col("at").alias("consumer"), "supply")


def kept_shares(grown: np.ndarray, flows: np.ndarray, tolerance: float = 1e-14, rounds: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(kept, available) of countries that ship at most what they have; ``flows[i, j]`` is wanted from i to j."""
    wanted, kept = flows.sum(1), np.ones(len(grown))
    for _ in range(rounds):
        available = grown + kept @ flows
        now = np.minimum(1.0, np.divide(available, wanted, out=np.ones_like(kept), where=wanted > 0))
        if np.abs(now - kept).max(initial=0.0) <= tolerance:
            return now, available
        kept = now
    raise RuntimeError(f"exports did not settle in {rounds} rounds")


def supply_matrix(grown: np.ndarray, flows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(supply[origin, consumer], reached[origin, consumer], residual[origin]): the residual is the part of an origin's production that no country keeps or that the solution misses, over its production."""
    n = len(grown)
    kept, available = kept_shares(grown, flows)
    rate = np.divide(kept, available, out=np.zeros(n), where=available > 0)
    routes = flows * rate[:, None]
    stays = np.divide(available - kept * flows.sum(1), available, out=np.zeros(n), where=available > 0)
    stays = np.where((kept < 1) | (stays < NOTHING), 0.0, stays)
    # a little less than everything moves on, so that rings that keep nothing have a solution too
    system = np.eye(n) - routes * (1 - 1e-13)
    amounts = np.linalg.solve(system.T, np.diag(grown)).T
    reach = np.eye(n, dtype=bool) | (routes > 0)
    for _ in range(max(1, int(np.ceil(np.log2(max(n, 2)))))):
        reach = (reach.astype(np.float32) @ reach.astype(np.float32)) > 0
    reach &= (grown > 0)[:, None] & (stays > 0)[None, :]
    supply = np.where(reach, np.maximum(amounts, 0) * stays, 0.0)
    residual = np.divide(np.abs(supply.sum(1) - grown), grown, out=np.zeros(n), where=grown > 0)
    return supply, reach, residual


def solved(production: DataFrame, edges: DataFrame, groups: list[str], countries: int = COUNTRIES) -> DataFrame:
    """Supply by origin: ``(groups, origin, consumer, supply, residual)``, every pair with any way between them.

    Each group is one linear system. ``residual`` is the part of the origin's production that the solution leaves without
    a consumer. Groups of more than ``countries`` countries go by the series, whose residual is null.
    """
    kind, key = production.schema["iso3"].dataType, [*groups]
    grown = production.groupBy(*groups, "iso3").agg(F.sum("production").cast("double").alias("qty")).where("qty > 0").select(*groups, F.col("iso3").alias("a"), F.lit(None).cast(kind).alias("b"), "qty")
    moved = edges.where("exporter <> importer AND qty > 0").groupBy(*groups, F.col("exporter").alias("a"), F.col("importer").alias("b")).agg(F.sum("qty").cast("double").alias("qty"))
    rows = reliable_checkpoint(grown.unionByName(moved))
    names = rows.select(*groups, F.explode(F.array("a", "b")).alias("x")).where("x IS NOT NULL").distinct()
    large = names.groupBy(*groups).count().where(F.col("count") > countries).select(*groups)
    schema = StructType([*rows.select(*groups).schema.fields]).add("origin", kind).add("consumer", kind).add("supply", DoubleType()).add("residual", DoubleType())

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        places, names = pd.factorize(pd.concat([rows["a"], rows["b"].dropna()]), sort=True)
        own, a = rows["b"].isna().to_numpy(), places[: len(rows)]
        grown, flows = np.zeros(len(names)), np.zeros((len(names), len(names)))
        qty = rows["qty"].to_numpy(float)
        np.add.at(grown, a[own], qty[own])
        np.add.at(flows, (a[~own], places[len(rows) :]), qty[~own])
        supply, reach, residual = supply_matrix(grown, flows)
        o, c = np.nonzero(reach)
        out = {g: [rows[g].iloc[0]] * len(o) for g in key}
        return pd.DataFrame({**out, "origin": np.asarray(names)[o], "consumer": np.asarray(names)[c], "supply": supply[o, c], "residual": residual[o]})

    if large.isEmpty():
        return rows.groupBy(*groups).applyInPandas(solve, schema)
    far = reliable_checkpoint(large)  # few: groups of many countries
    small = rows.join(far, groups, "left_anti").groupBy(*groups).applyInPandas(solve, schema)
    series = re_export(production.join(far, groups), edges.join(far, groups), groups)
    return small.unionByName(series.withColumn("residual", F.lit(None).cast("double")))
