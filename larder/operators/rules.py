"""Ordered label rules held as data.

A rule sets a label where a condition holds; later rules see the labels set by earlier ones.  Thousands of
rules are one literal array and one array fold, so the plan does not grow with the number of rules.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.operators.relational import join_null_safe
from larder.operators.terms import rules_met

ATOM = "struct<field:string,op:string,value:string,negate:boolean>"
RULES = f"array<struct<target:string,any:array<array<{ATOM}>>>>"


def atom(field: str, op: str, value: str, negate: bool = False) -> dict:
    """One test: ``field`` is 'name', 'ingredients', 'label' or 'year'; ``op`` contains, starts, equals or one_of."""
    return {"field": field, "op": op, "value": value, "negate": negate}


def rule(target: str, *alternatives: list[dict]) -> dict:
    """Set ``target`` where all tests of any of the alternatives hold."""
    return {"target": target, "any": list(alternatives)}


def apply_rules(
    rules: list[dict], label: Column, name: Column, ingredients: Column | None = None, year: Column | None = None,
    lower: bool = True, only: Column | None = None,
) -> Column:
    """The label after all rules.  A missing text matches nothing; values are literals, not patterns.

    ``only``: ascending numbers of the rules that can hold; the others are passed over.
    """
    table = F.from_json(F.lit(json.dumps(rules)), RULES)
    ingredients = F.lit(None).cast("string") if ingredients is None else ingredients
    year = F.lit(None).cast("string") if year is None else year.cast("string")
    fields = F.struct(
        (F.lower(name) if lower else name).alias("name"),
        (F.lower(ingredients) if lower else ingredients).alias("ingredients"), year.alias("year"),
    )

    def holds(a: Column, current: Column) -> Column:
        text = (
            F.when(a["field"] == "name", fields["name"]).when(a["field"] == "ingredients", fields["ingredients"])
            .when(a["field"] == "year", fields["year"]).otherwise(current)
        )
        test = (
            F.when(a["op"] == "contains", F.contains(text, a["value"])).when(a["op"] == "starts", F.startswith(text, a["value"]))
            .when(a["op"] == "one_of", F.array_contains(F.split(a["value"], r"\|"), text)).otherwise(text == a["value"])
        )
        return F.coalesce(test, F.lit(False)) != a["negate"]

    def step(current: Column, r: Column) -> Column:
        met = F.exists(r["any"], lambda tests: F.forall(tests, lambda a: holds(a, current)))
        return F.when(met, r["target"]).otherwise(current)

    tried = table if only is None else F.transform(only, lambda i: F.get(table, i))
    return F.aggregate(tried, label.cast("string"), step)


def key_terms(rules: list[dict], fields: list[str]) -> tuple[list[list[tuple[int, str]]], list[int]]:
    """For each rule a (field, term) of each alternative without which it can't hold; and the rules that have none for some alternative."""
    keys, always = [], []
    for number, r in enumerate(rules):
        own = []
        for tests in r["any"]:
            needed = [(fields.index(a["field"]), a["value"]) for a in tests if a["field"] in fields and a["op"] in ("contains", "starts", "equals") and not a["negate"] and a["value"]]
            if not needed:
                always.append(number)
                own = []
                break
            own.append(max(needed, key=lambda x: len(x[1])))
        keys.append(own)
    return keys, always


def labelled(df: DataFrame, rules: list[dict], label: str, name: str, ingredients: str, year: str | None = None, out: str = "label") -> DataFrame:
    """``df`` with ``out``: the label after all rules, for thousands of rules.

    Each distinct pair of texts is read once for the terms that rules need; only rules whose terms occur (and those that
    need none) are tried, in their order. The result is that of :func:`apply_rules`.
    """
    low = df.withColumns({"__name": F.lower(name), "__ingredients": F.lower(ingredients)})
    keys, always = key_terms(rules, ["name", "ingredients"])
    met = rules_met(low.select("__name", "__ingredients").distinct(), ["__name", "__ingredients"], keys, "__met")
    if always:
        # the numbers are a literal array
        met = met.withColumn("__met", F.array_sort(F.array_union("__met", F.array(*map(F.lit, always)))))
    joined = join_null_safe(low, met, ["__name", "__ingredients"])
    told = apply_rules(rules, F.col(label), F.col("__name"), F.col("__ingredients"), None if year is None else F.col(year), lower=False, only=F.col("__met"))
    return joined.withColumn(out, told).drop("__name", "__ingredients", "__met")


def rules_from_table(table: DataFrame, limit: int = 20000) -> list[dict]:
    """Rules from a table ``(seq, target, conditions)``, conditions as JSON lists of lists of tests.

    The rule table is a hand-written dimension; a table beyond ``limit`` rows is refused.
    """
    from larder.operators.relational import bounded_rows

    rows = bounded_rows(table.select("seq", "target", "conditions"), limit, "the rule table")
    return [{"target": r["target"], "any": json.loads(r["conditions"])} for r in sorted(rows, key=lambda r: r["seq"])]
