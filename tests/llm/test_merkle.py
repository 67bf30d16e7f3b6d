"""Merkle manifests against plain recursion, for several fan-outs and the odd cases that the docstrings define."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from larder.llm import merkle
from tests.llm.test_operators import CLASHING, SCHEMA


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def way(levels, i, fanout):
    """Of each level below the top: siblings before and after."""
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append((nodes[first:i], nodes[i + 1 : first + fanout]))
        i //= fanout
    return out


def brute(rows, altered, fanout):
    """(id, leaf) to sorted (subroot, root, siblings, folded root): equal rows are told apart by nothing else."""
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    leaf = lambda r, more=0: sha(*[field(v) for v in (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])])
    trees = {}
    for lang in order:
        own = sorted(by_lang[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = own, levels_of([leaf(r) for r in own], fanout)
    top = levels_of([trees[lang][1][-1][0] for lang in order], fanout)
    out = {}
    for k, lang in enumerate(order):
        own, levels = trees[lang]
        for i, r in enumerate(own):
            steps = way(levels, i, fanout) + way(top, k, fanout)
            node = leaf(r, 1 if altered(r) else 0)
            for before, after in steps:
                node = sha(*before, node, *after)
            out.setdefault((r[0], leaf(r)), []).append((levels[-1][0], top[-1][0], "".join(x for b, a in steps for x in b + a), node))
    return {k: sorted(v) for k, v in out.items()}


def told(spark, rows, altered, fanout, clashing=False):
    docs = spark.createDataFrame([(*r, *[None] * 11) for r in rows] if clashing else rows, CLASHING if clashing else SCHEMA)
    seen = merkle.audited(docs, altered, {"n_chars": F.col("n_chars") + 1}, fanout=fanout)
    out = {}
    for r in seen.select("id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")).alias("s"), "folded_root", "verified").collect():
        assert r.verified == (r.folded_root == r.root)
        out.setdefault((r.id, r.leaf), []).append((r.subroot, r.root, r.s, r.folded_root))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("n", "fanout"), [(1, 2), (2, 2), (3, 2), (65, 2), (150, 3)])
def test_proofs_of_every_leaf(spark, n, fanout):
    # fan-out 2: 64 leaves fill a page, 65 need a second one
    rows = [(i, f"text {i * 7 % 11}", "en" if i % 5 else ("dé" if i % 2 else None), "a", i) for i in range(n)]
    rows += [(1_000 + i, "x", "en", None, None) for i in range(60)]
    got = told(spark, rows, F.col("doc_id") % 3 == 0, fanout)
    assert got == brute(rows, lambda r: r[0] % 3 == 0, fanout)


def test_odd_cases(spark):
    """Nulls in every column, repeated rows (equal leaves, equal subtrees), a very long text, clashing names, other languages."""
    rows = [(None, None, None, None, None), (None, "", None, "a", 0), (4, "x", "en", "a", 1), (4, "y", "en", "a", 1), (5, "é\U0001f600", "Ünï", "a", 2), (6, "z" * 3_000_000, "en", "a", 3)]
    rows += [(7, "same", "xx", "a", 4)] * 70
    got = told(spark, rows, F.col("doc_id") == 6, 2, clashing=True)
    assert got == brute(rows, lambda r: r[0] == 6, 2)
    assert len(got) == 7 and len(got[next(k for k in got if k[0] == 7)]) == 70


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.audited(docs, F.lit(True), {"n_chars": F.col("n_chars") + 1}).collect() == []


def test_requests_for_some_leaves(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "a", i) for i in range(300)]
    m = merkle.documents_manifest(spark.createDataFrame(rows, SCHEMA))
    asked = m.leaves.where("id in (0, 7, 299)").select("tree", "rank", F.struct("id").alias("asked"))
    got = m.proofs(asked).select("asked.id", "leaf", merkle.folded(F.col("leaf"), F.col("proof")).alias("root")).collect()
    assert sorted(r.id for r in got) == [0, 7, 299] and {r.root for r in got} == {m.root}


def test_plan_has_no_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = merkle.audited(docs, F.lit(False), {})._jdf.queryExecution().toString()
    assert "Python" not in plan and "mapInArrow" not in plan
