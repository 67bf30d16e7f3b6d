"""A content-addressed Merkle manifest: every tree's nodes as digest-to-children records, proofs by descent from the root.

Trees are built in pages of ``LEVELS`` levels: a page's records tell the children of each digest in it, and its top digest
is a node of the page above. A request for leaves goes down from the root: at each page it is joined with the records of
the digest that it has reached, the digits of the leaf's rank choose the child, and the children that are not chosen are
collected. Requests with a common way go down as one; at a leaf the way is reversed, which is the proof.

Ranks come from one range sort and the row counts of its partitions, so no task holds a whole tree. Equal subtrees are
one record, whatever the number of places they stand in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.common import broadcast_if_small, stored
from larder.llm.quality_rules import let

#: Children of a node.
FANOUT = 2
#: Levels of a page: it has up to FANOUT ** LEVELS lowest children.
LEVELS = 6
#: Stands for the node itself in a run of siblings.
HERE = "*"

_NONE = "array()"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(parts: Column | list[Column]) -> Column:
    """Lower-case hex SHA-256 of strings set end to end (a list of columns, or an array column)."""
    return F.sha2(F.concat(*parts) if isinstance(parts, list) else F.array_join(parts, ""), 256)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``rank`` (from 0, within ``tree``, by ``order``) and ``size`` (rows of the tree)."""
    part = F.shiftright("__pos", 33)
    put = stored(rows.sort("tree", *order).withColumn("__pos", F.monotonically_increasing_id()), "ranked").withColumn("__part", part)
    runs = put.groupBy("tree", "__part").agg(F.min("__pos").alias("__first"), F.count("*").alias("__n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.select("tree", "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(tree).alias("size")), "runs")
    out = put.join(broadcast_if_small(runs), ["tree", "__part"])
    return out.withColumn("rank", F.col("__pos") - F.col("__first") + F.col("__before")).drop("__pos", "__part", "__first", "__before")


def _depth(size: Column, fanout: int) -> Column:
    """Levels from a page's lowest children to its top; all of them where the tree goes on above."""
    return sum(((size > fanout**j).cast("int") for j in range(1, LEVELS)), (size > 1).cast("int"))


def _run(nodes: Column, i: Column, fanout: int) -> Column:
    return F.slice(nodes, i * fanout + 1, F.lit(fanout))


def pages(nodes: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Stored tables of pages, lowest first: (tree, page, digest, size, depth, children).

    ``nodes`` has (tree, rank, size, digest), ranks from 0 without gaps. ``size`` counts the tree's nodes of that level,
    ``children`` maps the digest of each node in the page to its children. A page with ``size <= fanout ** LEVELS`` is the
    top of its tree, and its digest the tree's.
    """
    width, out = fanout**LEVELS, []
    while True:
        rows = nodes.groupBy("tree", F.expr(f"rank div {width}").alias("page")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("rank", "digest")))["digest"].alias("n0"))
        rows = rows.withColumn("depth", _depth(F.col("size"), fanout))
        for j in range(1, LEVELS + 1):
            below = f"n{j - 1}"
            starts = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
            above = F.transform(starts, lambda i: digest(_run(F.col(below), i, fanout)))  # noqa: B023
            rows = rows.withColumn(f"n{j}", F.when(F.col("depth") >= j, above).otherwise(F.expr(_NONE).cast("array<string>")))
        known = [F.transform(f"n{j}", lambda d, i: F.struct(d.alias("digest"), _run(F.col(f"n{j - 1}"), i, fanout).alias("children"))) for j in range(1, LEVELS + 1)]  # noqa: B023
        children = F.map_from_entries(F.array_distinct(F.concat(*known)))
        top = F.element_at(F.array(*[F.col(f"n{j}") for j in range(LEVELS + 1)]), F.col("depth") + 1)[0]
        out.append(stored(rows.select("tree", "page", top.alias("digest"), "size", "depth", children.alias("children")), "pages"))
        above = out[-1].where(f"size > {width}")
        if above.isEmpty():
            return out
        nodes = above.select("tree", F.col("page").alias("rank"), F.ceil(F.col("size") / width).cast("long").alias("size"), "digest")


def tops(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(tree, digest) of every tree."""
    found = [p.where(f"size <= {fanout**LEVELS}").select("tree", "digest") for p in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _walk(at: Column, fanout: int) -> Column:
    """From a page's top down to its ``at``-th lowest child: the node reached, and each level's run with HERE for the chosen child."""

    def step(way: Column, level: Column) -> Column:
        digit = F.pmod(F.floor(at / F.pow(F.lit(fanout), level)), F.lit(fanout)).cast("int")

        def down(kids: Column) -> Column:
            others = F.transform(kids, lambda k, i: F.when(i == digit, HERE).otherwise(k))
            return F.struct(F.get(kids, digit).alias("node"), F.array_append(way["path"], F.array_join(others, "")).alias("path"))

        return let(F.element_at("children", way["node"]), down)

    first = F.struct(F.col("digest").alias("node"), F.col("path"))
    digits = F.when(F.col("depth") == 0, F.expr(_NONE).cast("array<int>")).otherwise(F.sequence(F.col("depth") - 1, F.lit(0), F.lit(-1)))
    return F.aggregate(digits, first, step)


def descended(levels: list[DataFrame], roots: DataFrame, requests: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, rank, asked, node, path): for each request (tree, rank, asked struct) the leaf and the way down to it.

    ``roots``: (tree, digest, path), where the descent starts and the way above. A rank is requested once at most; ranks
    beyond the tree give a null node.
    """
    width = fanout**LEVELS
    page, at = F.expr(f"rank div {width}").alias("page"), F.expr(f"rank % {width}").cast("int").alias("at")
    wanted = [requests.groupBy("tree", page).agg(F.collect_list(F.struct(at, "asked")).alias("wanted"))]
    for _ in levels[1:]:
        below = wanted[-1].select("tree", F.col("page").alias("rank"))
        wanted.append(below.groupBy("tree", page).agg(F.collect_list(F.struct(at)).alias("wanted")))
    reached: DataFrame | None = None
    for n in reversed(range(len(levels))):
        ends = levels[n].where(f"size <= {width}").select("tree", "page").join(roots, "tree")
        reached = ends if reached is None else ends.unionByName(reached)
        records = levels[n].groupBy("digest").agg(F.first("depth").alias("depth"), F.first("children").alias("children"))
        here = reached.join(wanted[n], ["tree", "page"]).join(records, "digest")
        ways = here.select("tree", "page", F.explode(F.transform("wanted", lambda w: F.struct(w.alias("want"), _walk(w["at"], fanout).alias("way")))).alias("x"))
        rank = (F.col("page") * width + F.col("x.want.at")).alias("rank")
        if n == 0:
            return ways.select("tree", rank, "x.want.asked", "x.way.node", "x.way.path")
        reached = ways.select("tree", rank.alias("page"), F.col("x.way.node").alias("digest"), "x.way.path")
    raise AssertionError("a manifest has a level")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof (lowest run first) give."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.replace(run, F.lit(HERE), node), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof end to end, lowest level first, left to right."""
    return F.replace(F.array_join(proof, ""), F.lit(HERE), F.lit(""))


@dataclass(frozen=True)
class Manifest:
    """Leaves (tree, rank, size, digest and columns of the caller), the pages of their trees, and those of the tree over the trees."""

    leaves: DataFrame
    levels: list[DataFrame]
    trees: DataFrame
    upper: list[DataFrame]
    root: str | None
    fanout: int

    def proofs(self, requests: DataFrame) -> DataFrame:
        """(tree, rank, asked, leaf, subroot, proof) of each request (tree, rank, asked struct); the proof is lowest run first."""
        if self.root is None:
            return requests.selectExpr("tree", "rank", "asked", "string(null) leaf", "string(null) subroot", "cast(null as array<string>) proof").limit(0)
        top = self.trees.select(F.lit("").alias("tree"), "rank", F.struct(F.col("tree").alias("of"), F.col("digest").alias("subroot")).alias("asked"))
        start = self.trees.select(F.lit("").alias("tree"), F.lit(self.root).alias("digest"), F.expr(_NONE).cast("array<string>").alias("path")).limit(1)
        roots = descended(self.upper, start, top, self.fanout).select(F.col("asked.of").alias("tree"), F.col("node").alias("digest"), "path")
        roots = broadcast_if_small(stored(roots, "subroots"))
        found = descended(self.levels, roots, requests, self.fanout).join(roots.select("tree", F.col("digest").alias("subroot")), "tree")
        return found.select("tree", "rank", "asked", F.col("node").alias("leaf"), "subroot", F.reverse("path").alias("proof"))


def manifest(leaves: DataFrame, order: list[Column], fanout: int = FANOUT) -> Manifest:
    """The manifest of ``leaves`` with (tree string not null, digest); trees go by the bytes of their names, leaves by ``order``.

    Every ``fanout`` consecutive nodes (the last run: what is left, even one) become the digest of their digests, until
    one node is left; a lone leaf is its tree's digest. No leaves: no root.
    """
    rows = stored(ranked(leaves, order), "leaves")
    levels = pages(rows.select("tree", "rank", "size", "digest"), fanout)
    trees = ranked(tops(levels, fanout).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), [F.col("name")])
    upper = pages(trees.select("tree", "rank", "size", "digest"), fanout)
    root = tops(upper, fanout).first()
    return Manifest(rows, levels, trees.select(F.col("name").alias("tree"), "rank", "digest"), upper, root["digest"] if root else None, fanout)


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def documents_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", extra: dict[str, Column] | None = None, fanout: int = FANOUT) -> Manifest:
    """The manifest of a table: a leaf per row over ``fields``, a tree per value of ``tree_col`` (null has one of its own, the first).

    Leaves ascend by ``id_col`` (null first), equal ids by leaf digest. Null, empty and very long texts are leaves like any
    other; repeated rows are leaves of their own. ``extra`` columns come along in ``leaves``; others are ignored.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(tree_col).cast("string")), F.lit(""))
    own = {f"__{name}": c for name, c in (extra or {}).items()}
    leaves = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), digest([field(F.col(f)) for f in fields]).alias("digest"), *[c.alias(n) for n, c in own.items()])
    return manifest(leaves, [F.col("id").asc_nulls_first(), F.col("digest")], fanout)


def audited(docs: DataFrame, altered: Column, changed: dict[str, Column], fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof, folded_root, verified.

    Rows where ``altered`` holds are checked with the columns of ``changed`` in place of their own; ``folded_root`` is what
    their leaf and the manifest's proof give, ``verified`` whether that is the root. An empty table gives an empty result.
    """
    other = F.when(altered, digest([field(changed.get(f, F.col(f))) for f in fields]))
    m = documents_manifest(docs, fields, tree_col, id_col, {"other": other}, fanout)
    requests = m.leaves.select("tree", "rank", F.struct("id", F.col("__other").alias("other")).alias("asked"))
    found = m.proofs(requests)
    seen = found.select(F.col("asked.id").alias("id"), "leaf", "subroot", F.lit(m.root).cast("string").alias("root"), "proof", folded(F.coalesce("asked.other", "leaf"), F.col("proof")).alias("folded_root"))
    return seen.withColumn("verified", F.col("folded_root") == F.col("root"))
