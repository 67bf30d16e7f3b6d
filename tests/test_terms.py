"""Rules by automaton against the plain fold, keywords by gram index against plain containment, small regressions, re-exports, languages."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.catalog.txt import class_rules
from larder.fixtures import derived
from larder.operators import language as lg
from larder.operators import matching as mt
from larder.operators import reexport as rx
from larder.operators import regression as rg
from larder.operators import rules as ru
from larder.operators import terms


def test_labelled_equals_the_plain_fold(spark):
    """All kinds of tests, terms inside terms, rules without any term, null and empty texts, rules that see labels of others."""
    rng = random.Random(3)
    words = ["milk", "ilk", "soy milk", "oat", "almond", "a", "nut", "peanut", "cheese", "é", "(x)", "10%"]
    rules = []
    for k in range(150):
        tests = lambda: [ru.atom(rng.choice(["name", "ingredients"]), rng.choice(["contains", "contains", "starts", "equals"]), rng.choice(words), rng.random() < 0.25) for _ in range(rng.randint(1, 3))] + ([ru.atom("label", rng.choice(["equals", "one_of"]), f"L{rng.randrange(9)}|x" if rng.random() < 0.3 else f"L{rng.randrange(9)}", rng.random() < 0.5)] if rng.random() < 0.5 else [])
        rules.append(ru.rule(f"L{k % 9}", *[tests() for _ in range(rng.randint(1, 2))]))
    rules += [ru.rule("none told", [ru.atom("label", "equals", "start")]), ru.rule("year", [ru.atom("year", "equals", "7"), ru.atom("name", "contains", "oat")])]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words).upper() if rng.random() < 0.2 else rng.choice(words) for _ in range(rng.randint(1, 5)))])
    rows = [(i, text(), text(), rng.choice(["start", None]), i % 9) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, name string, ingredients string, before string, year int")
    got = {r["id"]: r["label"] for r in ru.labelled(df, rules, "before", "name", "ingredients", "year").collect()}
    want = {r["id"]: r["l"] for r in df.select("id", ru.apply_rules(rules, F.col("before"), F.col("name"), F.col("ingredients"), F.col("year")).alias("l")).collect()}
    assert got == want and len(set(got.values())) > 3


def test_rules_at_their_number_equal_the_plain_fold(spark, sf_dir):
    items = derived(spark, sf_dir, "txt").limit(60).select("id", F.concat(F.lit("product "), F.col("id").cast("string")).alias("name"), "ingredients_text", F.lit("none").alias("before"))
    rules = class_rules()
    assert len(rules) == 2280
    got = {r["id"]: r["label"] for r in ru.labelled(items, rules, "before", "name", "ingredients_text").collect()}
    want = {r["id"]: r["l"] for r in items.select("id", ru.apply_rules(rules, F.col("before"), F.col("name"), F.col("ingredients_text")).alias("l")).collect()}
    assert got == want


def test_terms_in_equals_containment(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdéF") for _ in range(n))
    values = list({text(rng.randint(0, 14)) for _ in range(250)}) + [None, "%_.*", "abc abc"]
    found = [(k % 40, text(rng.randint(1, 7))) for k in range(300)] + [(41, "%_"), (42, "bc a")]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {r["v"]: r["hits"] for r in terms.terms_in(df, "v", found).collect()}
    want = {v: sorted({n for n, t in found if t.lower() in v.lower()}) for v in values if v is not None}
    assert got == {v: h for v, h in want.items() if h}


def test_many_keywords_match_as_few_do(spark, monkeypatch):
    """The index and a pattern per category give the same, patterns among the terms and exclusions included."""
    rng = random.Random(2)
    rules = [(f"c{c}", ["".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(6)] + (["b.c"] if c == 3 else [])) for c in range(12)]
    rows = [(i, rng.choice([None, *["".join(rng.choice("abcd") for _ in range(9)) for _ in range(30)]]), "xy"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, value string, shop string")
    excluded = {"c1": ["ab"], "c3": ["dd"]}
    few = {tuple(r) for r in mt.match_categories(df, "value", rules, ["shop"], excluded).select("id", "food_category").collect()}
    monkeypatch.setattr(mt, "INDEXED", 0)
    many = mt.match_categories(df, "value", rules, ["shop"], excluded)
    assert {tuple(r) for r in many.select("id", "food_category").collect()} == few


def test_index_plan_has_no_pattern_per_category(spark):
    rules = [(f"c{c}", [f"term{c}x{k}" for k in range(100)]) for c in range(50)]
    df = spark.createDataFrame([(1, "term3x4 here")], "id long, value string")
    out = mt.match_categories(df, "value", rules)
    assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString().upper() and out.first()["food_category"] == "c3"


@pytest.mark.parametrize("rows", [[("k", 1, None)], [("k", 1, 40.0)], [("k", 2, 10.0), ("k", 2, 30.0)], [("k", 1, 0.0), ("k", 2, 0.0)], [("k", 1, 50.0), ("k", 2, 25.0)]])
def test_every_group_has_a_regression_row(spark, rows):
    out = rg.position_regression(spark.createDataFrame(rows, "k string, pos int, percent double"), ["k"]).collect()
    assert len(out) == 1 and out[0]["n"] == sum(r[2] is not None for r in rows) and not out[0]["accepted"]
    told = [out[0][c] is None for c in ("form", "slope", "adj_r2")]
    assert all(told) or not any(told)
    if rows[0][1] == 2:
        assert out[0]["form"] in (1, 2)  # one place has no straight line


def _series(grown, flows, rounds=4000):
    n, kept = len(grown), np.ones(len(grown))
    for _ in range(rounds):
        available = grown + kept @ flows
        kept = np.array([min(1.0, available[i] / flows[i].sum()) if flows[i].sum() else 1.0 for i in range(n)])
    rate = np.array([kept[i] / available[i] if available[i] else 0.0 for i in range(n)])
    at, total = np.diag(grown), np.zeros((n, n))
    for _ in range(rounds):
        total += at
        at = at @ (flows * rate[:, None])
    stays = np.array([(available[i] - kept[i] * flows[i].sum()) / available[i] if available[i] else 0.0 for i in range(n)])
    return total * np.where((kept < 1) | (stays < 1e-12), 0, stays)


def test_solved_re_export_equals_the_series(spark):
    """Random systems with exporters that run dry, and mass balance: what an origin grows ends somewhere."""
    rng, production, edges, want = np.random.default_rng(5), [], [], {}
    for g in range(4):
        n = int(rng.integers(2, 9))
        grown = np.round(rng.random(n) * 100 * (rng.random(n) < 0.7), 3)
        flows = np.round(rng.random((n, n)) * 40 * (rng.random((n, n)) < 0.5), 3) * (1 - np.eye(n))
        production += [(g, f"c{i}", float(grown[i])) for i in range(n)]
        edges += [(g, f"c{i}", f"c{j}", float(flows[i, j])) for i in range(n) for j in range(n)]
        s = _series(grown, flows)
        want |= {(g, f"c{i}", f"c{j}"): s[i, j] for i in range(n) for j in range(n) if s[i, j] > 1e-12}
    p, e = spark.createDataFrame(production, "g int, iso3 string, production double"), spark.createDataFrame(edges, "g int, exporter string, importer string, qty double")
    rows = rx.solved(p, e, ["g"]).collect()
    got = {(r["g"], r["origin"], r["consumer"]): r["supply"] for r in rows if r["supply"] > 1e-12}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    for g, c, grown in production:
        own = [r for r in rows if r["g"] == g and r["origin"] == c]
        if own:
            assert abs(sum(r["supply"] for r in own) - grown * (1 - own[0]["residual"])) < 1e-6
    large = {(r["g"], r["origin"], r["consumer"]): r["supply"] for r in rx.solved(p, e, ["g"], countries=4).collect() if r["supply"] > 1e-6}
    assert all(abs(large[k] - got.get(k, 0)) < 1e-4 for k in large)


def test_ring_of_exporters_keeps_only_what_flows_in(spark):
    grown, flows = np.array([10.0, 0.0, 0.0]), np.array([[0, 4.0, 0], [0, 0, 60.0], [0, 50.0, 0]])
    supply, reach, residual = rx.supply_matrix(grown, flows)
    assert np.allclose(supply[0], [6, 0, 4]) and abs(residual[0]) < 1e-9 and not reach[0, 1] and not supply[1:].any()


def test_languages_by_grams_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").where("lang IS NOT NULL")
    out = lg.detect_by_grams(docs.where("doc_id % 5 = 0"), "text", lg.gram_model(docs.where("doc_id % 5 <> 0"), "text", "lang"))
    n, hit, sure = out.selectExpr("count(*)", "count_if(language = lang)", "min(language_probability)").first()
    assert n > 150 and hit / n > 0.98 and 0.25 <= sure <= 1
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " x "), (4, "the and of " * 200_000)], "doc_id long, text string")
    model = lg.gram_model(docs, "text", "lang")
    assert [r["language"] for r in lg.detect_by_grams(odd, "text", model).sort("doc_id").collect()] == ["und", "und", "und", "en"]


def test_gram_buckets_do_not_depend_on_pieces(monkeypatch):
    text = "Ünï \U0001f600 abc" * 30
    whole = np.sort(np.concatenate(list(lg.gram_buckets(text))))
    for piece in (1, 2, 7, 100):
        monkeypatch.setattr(lg, "PIECE", piece)
        assert (np.sort(np.concatenate(list(lg.gram_buckets(text)))) == whole).all()


def test_choice_grows_with_hits_and_not_with_rules(spark):
    """No scan of all rules for each value and no row for each gram; ties and missing batches go as by a sort."""
    rows = [(1, "ab", "x"), (2, "ab", "x"), (3, "b", "x"), (4, "b c", None), (5, "c", None), (6, "q", None), (7, None, "x")]
    df = spark.createDataFrame(rows, "id long, value string, shop string")
    rules = [("first", ["a"]), ("second", ["b"]), ("third", ["c"]), *[(f"none{k}", [f"zz{k}"]) for k in range(250)]]
    out = mt.match_categories(df, "value", rules, ["shop"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "flatten" not in plan
    # in x: first 2 rows, second 3; without a shop: second 1, third 2
    assert {r["id"]: r["food_category"] for r in out.collect()} == {1: "first", 2: "first", 3: "second", 4: "second", 5: "third", 6: None, 7: None}
