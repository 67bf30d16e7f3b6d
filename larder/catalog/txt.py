"""Text cleaning and parsing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog.registry import query
from larder.fixtures import ctes, derived
from larder.functions import cleaning as c
from larder.functions import foods as fd
from larder.functions import labels as lb
from larder.functions import nested as n
from larder.functions.columns import combined_text
from larder.functions.steps import rewrite_sql
from larder.operators import matching as mt
from larder.operators import rules as ru


def _texts(source: str, column: str, key: str, fn, steps_sql: str):
    """Query and check that apply one text function to every row of a source."""

    def run(spark, sf_dir):
        df = derived(spark, sf_dir, source)
        return df.select(F.col(key).alias("id"), fn(F.col(column)).alias("text"))

    prefix = "" if source in ("documents", "pages") else ctes(source)
    return run, f"{prefix}SELECT {key} AS id, {steps_sql} AS text FROM {source}"


def _add(name, source, column, key, fn, sql):
    run, check = _texts(source, column, key, fn, sql)
    query(name, check)(run)


_add("txt01_clean", "dirty", "ingredients_text", "id", c.clean_ingredients, rewrite_sql("ingredients_text", c.CLEAN))
_add("txt01_clean_documents", "documents", "text", "doc_id", c.clean_ingredients, rewrite_sql("text", c.CLEAN))
_add(
    "txt02_origin_clauses", "documents", "text", "doc_id",
    lambda t: c.drop_origin_clauses(F.concat(t, F.lit(" (origin: farm) - end"))),
    rewrite_sql(
        "CASE WHEN contains(text, ',') THEN text || ' (origin: farm) - end' "
        "ELSE replace(text || ' (origin: farm) - end', ' - ', ', ') END",
        c.ORIGIN_CLAUSES,
    ),
)

_ROUNDS = f"SELECT id, CAST(NULL AS VARCHAR) AS before, {rewrite_sql('text', c.TIDY_STRUCTURE)} AS now FROM cleaned"
for _ in range(9):
    _ROUNDS = f"SELECT id, now AS before, {rewrite_sql('now', c.PERCENT_AFTER_NAME)} AS now FROM ({_ROUNDS})"


@query(
    "txt03_structure",
    ctes("dirty")
    + f", cleaned AS (SELECT id, {rewrite_sql('ingredients_text', c.CLEAN)} AS text FROM dirty) "
    + f"SELECT id, {rewrite_sql('CASE WHEN before = now THEN now ELSE $$$$ END', c.SPACED)} AS text FROM ({_ROUNDS})",
)
def txt03(spark, sf_dir):
    d = derived(spark, sf_dir, "dirty")
    return d.select("id", c.correct_structure(c.clean_ingredients(F.col("ingredients_text"))).alias("text"))


_add(
    "txt04_traces", "dirty", "ingredients_text", "id", lambda t: c.drop_traces(F.lower(t)),
    rewrite_sql("lower(ingredients_text)", c.TRACES),
)
_add(
    "txt05_organic_origin", "dirty", "ingredients_text", "id", lambda t: c.drop_organic_origin(F.lower(t)),
    rewrite_sql("lower(ingredients_text)", c.ORGANIC_ORIGIN),
)
_add(
    "txt06_translation_terms", "documents", "text", "doc_id",
    lambda t: c.translate_terms(F.concat(F.lit(" sucre , soja "), F.lower(t))),
    rewrite_sql("' sucre , soja ' || lower(text)", c.TRANSLATED),
)
_add(
    "txt07_starred_grams", "txt", "ingredients_text", "id",
    lambda t: c.starred_grams(F.concat(t, F.when(F.col("id") % 3 == 0, " egg**").otherwise(""), F.lit(" 12g**"))),
    "CASE WHEN id % 3 = 0 THEN ingredients_text || ' egg** 12g**' ELSE ingredients_text || ' 12%' END",
)
_add(
    "txt08_pre_parse", "dirty", "ingredients_text", "id", c.pre_parse,
    "replace(regexp_replace(replace(translate(ingredients_text, '[]{}', '()()'), ';', ','), '(per cent|percent)', '%', 'gi'),"
    " 'Allergy Advice: For allergens see highlighted ingredients', '')",
)


@query(
    "txt09_embedded",
    ctes("ing") + "SELECT id, pos, CASE WHEN pos % 3 = 0 THEN lower(food_category) || ', ' || lower(replace(food_category_sub, '#', ' ')) END AS embedded FROM ing",
)
def txt09(spark, d):
    t = derived(spark, d, "txt").select("id", F.explode(n.parse_list(F.col("ingredients_text"))).alias("x"))
    return t.select("id", "x.pos", "x.embedded")


@query(
    "txt10_split",
    ctes("ing") + "SELECT id, pos, value || CASE WHEN pos % 3 = 0 THEN ' (' || lower(food_category) || ', ' || lower(replace(food_category_sub, '#', ' ')) || ')' ELSE '' END "
    "|| CASE WHEN percent0 IS NOT NULL THEN ' (' || CAST(CAST(percent0 AS DECIMAL(5,2)) AS VARCHAR) || '%)' ELSE '' END AS piece FROM ing",
)
def txt10(spark, d):
    t = derived(spark, d, "txt").select("id", F.posexplode(n.split_top_level(F.col("ingredients_text"))).alias("p", "piece"))
    return t.select("id", (F.col("p") + 1).alias("pos"), "piece")


@query("txt11_printed_percent", ctes("ing") + "SELECT id, pos, CASE WHEN percent0 <= 100.0 / pos THEN percent0 END AS percent FROM ing")
def txt11(spark, d):
    return n.printed_percent_items(derived(spark, d, "txt"), F.col("ingredients_text")).select("id", "x.pos", "x.percent")


WORDS = [("Rings", ["ring", "red"]), ("Bolts", ["bolt", "cold b"]), ("Plates", ["plate", "hot"]), ("Tools", ["gear", "gizmo", "anvil"]), ("New goods", ["new"])]
_HITS = ", ".join(f"(CASE WHEN regexp_matches(value, '{'|'.join(t)}') THEN 1 ELSE 0 END) AS h{i}" for i, (_, t) in enumerate(WORDS))


def _rarest(batch: str, exclude: str = "") -> str:
    parts = " UNION ALL ".join(
        f"SELECT id, pos, {batch} AS b, '{c}' AS category, {i} AS seq, "
        + (f"CASE WHEN category_bar = '{c}' THEN 0 ELSE h{i} END" if exclude else f"h{i}") + f" AS eff, h{i} AS hit FROM h"
        for i, (c, _) in enumerate(WORDS)
    )
    return f""", m AS ({parts}), c AS (SELECT b, category, sum(hit) AS n FROM m GROUP BY b, category),
    r AS (SELECT m.id, m.pos, m.category, row_number() OVER (PARTITION BY m.id, m.pos ORDER BY c.n, m.seq) AS k
          FROM m JOIN c ON c.b = m.b AND c.category = m.category WHERE m.eff = 1)
    SELECT h.id, h.pos, r.category AS food_category FROM h LEFT JOIN r ON r.id = h.id AND r.pos = h.pos AND r.k = 1"""


#: Terms and categories of a keyword file's size: the words above, and numbers that some names hold.
N_TERMS, N_CATEGORIES = 5_000, 60
MANY = [(f"Kind {c}", [str(10_000 + k * 7_919 % 90_000) for k in range(c, N_TERMS, N_CATEGORIES)] + [t for i, (_, w) in enumerate(WORDS) if i == c for t in w]) for c in range(N_CATEGORIES)]
_CODED = "value || ' ' || CAST((id * 7919 + pos * 104729) % 1000003 AS {text}) AS value"


def _many_sql(table: str, batch: str) -> str:
    words = ", ".join(f"('{t}', {i})" for i, (_, terms) in enumerate(WORDS) for t in terms)
    return ctes(table) + f""", v AS (SELECT id, pos, {batch} AS b, {_CODED.format(text='VARCHAR')} FROM {table}),
    t(term, seq) AS (SELECT CAST(10000 + k * 7919 % 90000 AS VARCHAR), k % {N_CATEGORIES} FROM (SELECT unnest(range({N_TERMS})) AS k) UNION ALL VALUES {words}),
    hit AS (SELECT DISTINCT d.value, seq FROM (SELECT DISTINCT value FROM v) d JOIN t ON contains(d.value, t.term)),
    c AS (SELECT b, seq, count(*) AS n FROM v JOIN hit ON hit.value = v.value GROUP BY b, seq),
    r AS (SELECT v.id, v.pos, hit.seq, row_number() OVER (PARTITION BY v.id, v.pos ORDER BY c.n, hit.seq) AS k FROM v JOIN hit ON hit.value = v.value JOIN c ON c.b = v.b AND c.seq = hit.seq)
    SELECT v.id, v.pos, 'Kind ' || r.seq AS food_category FROM v LEFT JOIN r ON r.id = v.id AND r.pos = v.pos AND r.k = 1"""


def _coded(spark, d, table: str, *more: str):
    return derived(spark, d, table).select("id", "pos", *more, F.expr(_CODED.format(text="STRING")))


@query("txt12_match", _many_sql("ing", "0"))
def txt12(spark, d):
    return mt.match_categories(_coded(spark, d, "ing"), "value", MANY).select("id", "pos", "food_category")


@query("txt12_match_few", ctes("ing") + f", h AS (SELECT id, pos, {_HITS} FROM ing)" + _rarest("0"))
def txt12_few(spark, d):
    return mt.match_categories(derived(spark, d, "ing").select("id", "pos", "value"), "value", WORDS).select("id", "pos", "food_category")


@query("jon09_match_by_department", _many_sql("ingprod", "department"))
def jon09(spark, d):
    return mt.match_categories(_coded(spark, d, "ingprod", "department"), "value", MANY, ["department"]).select("id", "pos", "food_category")


@query(
    "txt12_overrides",
    ctes("ing") + """SELECT id, pos, CASE WHEN value LIKE '%ring%' THEN 'Anything' WHEN value LIKE '%bolt%' AND food_category = 'SMALL' THEN 'Nuts & bolts'
    WHEN value LIKE '%old%' AND food_category IS NULL THEN 'Old' ELSE food_category END AS food_category FROM ing""",
)
def txt12_overrides(spark, d):
    rules = [("bolt", "^SMALL$", "Nuts & bolts"), ("old", None, "Old"), ("ring", "", "Anything")]
    return derived(spark, d, "ing").select("id", "pos", mt.with_overrides(F.col("value"), F.col("food_category"), rules).alias("food_category"))


SUBS = [("SMALL", "small rings", "ring", 1), ("SMALL", "small old", "old", 2), ("SMALL", "small other", None, 9), ("PROMO", "promo hot", "hot", 1), ("PROMO", "promo rest", "x", 5)]


@query(
    "txt13_subcategory",
    ctes("ing") + """SELECT id, pos, CASE food_category WHEN 'SMALL' THEN CASE WHEN value LIKE '%old%' THEN 'small old' WHEN value LIKE '%ring%' THEN 'small rings' ELSE 'small other' END
      WHEN 'PROMO' THEN CASE WHEN value LIKE '%hot%' THEN 'promo hot' ELSE 'promo rest' END END AS food_category_sub FROM ing""",
)
def txt13(spark, d):
    return derived(spark, d, "ing").select("id", "pos", mt.subcategory(F.col("food_category"), F.col("value"), SUBS).alias("food_category_sub"))


@query(
    "txt14_product_match",
    ctes("ing") + f", h AS (SELECT id, pos, CASE WHEN value LIKE '%new%' THEN 'Rings' END AS category_bar, {_HITS} FROM ing)" + _rarest("0", "bar"),
)
def txt14(spark, d):
    i = derived(spark, d, "ing").select("id", "pos", "value")
    return mt.match_categories(i, "value", WORDS, excluded={"Rings": ["new"]}).select("id", "pos", "food_category")


_TAGGED = "value || CASE id % 9 WHEN 0 THEN ' salt' WHEN 1 THEN ' water' WHEN 2 THEN ' vitamin b6' WHEN 3 THEN ' calcium' WHEN 4 THEN ' yeast' WHEN 5 THEN ' xantham gum' WHEN 6 THEN ' yeast extract' ELSE '' END"


@query(
    "txt15_additives",
    ctes("ing") + """SELECT id, pos, CASE id % 9 WHEN 0 THEN 'Salt' WHEN 1 THEN 'Water' WHEN 2 THEN 'Vitamin' WHEN 3 THEN 'Mineral'
       WHEN 4 THEN CASE WHEN pos <> 1 THEN 'Other Food Additive' END WHEN 5 THEN 'Other Food Additive' END AS food_category FROM ing""",
)
def txt15(spark, d):
    tagged = F.expr(_TAGGED)
    return derived(spark, d, "ing").select("id", "pos", mt.with_additives(tagged, F.lit(None).cast("string"), F.col("pos")).alias("food_category"))


_PAREN = "CASE id % 6 WHEN 0 THEN 'milk' WHEN 1 THEN 'soy, water' WHEN 2 THEN 'wheat' WHEN 3 THEN '' WHEN 4 THEN 'milk, salt, cream' END"
_NAMED = "CASE pos % 4 WHEN 0 THEN 'cheese' WHEN 1 THEN 'soy milk' WHEN 2 THEN 'tofu' ELSE 'butter' END"


@query(
    "txt16_main_ingredient",
    ctes("ing") + f""", x AS (SELECT id, pos, {_NAMED} AS v, {_PAREN} AS e FROM ing)
    SELECT id, pos, CASE WHEN e IS NULL THEN NULL WHEN v = 'soy milk' AND e LIKE '%soy%' THEN 'Soymilk' WHEN v = 'tofu' AND e LIKE '%soy%' THEN 'Tofu'
      WHEN v = 'butter' AND e LIKE '%milk%' THEN 'Butter' WHEN v = 'cheese' AND e = 'milk' THEN 'Cheese' WHEN e <> '' AND e NOT LIKE '%,%' THEN v ELSE e END AS embedded FROM x""",
)
def txt16(spark, d):
    return derived(spark, d, "ing").select("id", "pos", mt.main_ingredient(F.expr(_NAMED), F.expr(_PAREN)).alias("embedded"))


@query(
    "txt17_claims",
    ctes("ing") + "SELECT id, pos, CASE WHEN id % 3 = 0 THEN value || ' 0 milk' WHEN id % 3 = 1 THEN value || ' 30 salt' ELSE value || ' 12%' END AS value FROM ing",
)
def txt17(spark, d):
    claim = F.when(F.col("id") % 3 == 0, " 0%low fat milk").when(F.col("id") % 3 == 1, " 30% Reduced salt").otherwise(" 12%")
    return derived(spark, d, "ing").select("id", "pos", lb.without_claims(F.concat("value", claim)).alias("value"))


@query(
    "txt18_tidy_value",
    ctes("ing") + """SELECT id, pos, ltrim(regexp_replace(regexp_replace(regexp_replace(' (' || value || ' Vitamin B' || pos || ') 12%*', '[()%]', '', 'g'),
       '(?i)Vitamin\\s?B?[0-9]*', 'VitaminNUMBER', 'g'), '[0-9*]', '', 'g')) AS value FROM ing""".replace("\\\\", "\\"),
)
def txt18(spark, d):
    raw = F.concat(F.lit(" ("), F.col("value"), F.lit(" Vitamin B"), F.col("pos").cast("string"), F.lit(") 12%*"))
    return derived(spark, d, "ing").select("id", "pos", mt.tidy_value(raw).alias("value"))


@query(
    "txt19_grams_per_100",
    ctes("ing") + "SELECT id, pos, CASE WHEN pos % 4 = 0 AND 100 + id % 90 > 100 THEN CAST(100 + id % 90 AS DOUBLE) END AS total FROM ing",
)
def txt19(spark, d):
    t = F.when(
        F.col("pos") % 4 == 0, F.concat((100 + F.col("id") % 90).cast("string"), F.lit("g of "), F.col("value"), F.lit(" per 100g"))
    ).otherwise(F.concat(F.lit("150g "), F.col("value")))
    return derived(spark, d, "ing").select("id", "pos", lb.grams_per_100(t).alias("total"))


@query("txt23_organic", ctes("ing") + "SELECT id, pos, CASE WHEN id % 5 = 0 OR pos = 2 THEN 'Organic' ELSE 'Not Organic' END AS organic FROM ing")
def txt23(spark, d):
    name = F.when(F.col("id") % 5 == 0, "ORGANIC soup").otherwise("soup")
    value = F.when(F.col("pos") == 2, F.concat(F.lit("organic "), "value")).otherwise(F.col("value"))
    return derived(spark, d, "ing").select("id", "pos", fd.organic(value, name).alias("organic"))


@query("txt24_broth", ctes("ing") + "SELECT id, pos, round(CASE WHEN id % 4 = 0 THEN true_percent / 10 ELSE true_percent END, 6) AS percent FROM ing")
def txt24(spark, d):
    value = F.when(F.col("id") % 4 == 0, F.concat("value", F.lit(" Stock"))).otherwise(F.col("value"))
    return derived(spark, d, "ing").select("id", "pos", F.round(fd.broth_percent(value, F.col("true_percent")), 6).alias("percent"))


@query(
    "txt25_brewed",
    ctes("ing") + """SELECT id, pos, CASE WHEN id % 2 = 0 AND id % 3 <> 1 THEN 'Coffee' WHEN id % 2 = 1 AND id % 3 = 0 THEN 'Tea' END AS brewed FROM ing""",
)
def txt25(spark, d):
    i = F.col("id")
    category = F.when(i % 2 == 0, "Coffee").otherwise("Tea")
    name = F.when(i % 3 == 0, "Brewed").when(i % 3 == 1, "instant latte").otherwise("plain")
    value = F.when(i % 2 == 0, "Cappuccino").otherwise("leaves")
    return derived(spark, d, "ing").select("id", "pos", fd.brewed(name, value, category).alias("brewed"))


@query(
    "txt26_plant_milk",
    ctes("ing") + """SELECT id, pos, CASE id % 6 WHEN 0 THEN 'Soymilk' WHEN 1 THEN 'Almond milk' WHEN 2 THEN 'Milk' WHEN 3 THEN 'Oat milk'
       WHEN 4 THEN CASE WHEN true_percent >= 50 THEN 'Cheese' ELSE 'Milk' END ELSE 'Rice milk' END AS food_category FROM ing""",
)
def txt26(spark, d):
    names = F.element_at(
        F.array(*[F.lit(x) for x in ("Soya milk", "Almond drink", "almond milk bar", "oat milk", "blue cheese", "rice drink")]),
        (F.col("id") % 6 + 1).cast("int"),
    )
    return derived(spark, d, "ing").select("id", "pos", mt.plant_milk(names, F.lit("Milk"), F.col("true_percent")).alias("food_category"))


@query("txt27_explode", "SELECT doc_id, unnest(string_split(lang || ',' || source, ',')) AS country FROM documents")
def txt27(spark, d):
    t = derived(spark, d, "documents")
    return t.select("doc_id", F.explode(F.split(F.concat_ws(",", "lang", "source"), ",")).alias("country"))


@query("txt28_combined_text", "SELECT p_partkey, lower(p_name) || ' - ' || lower(p_type) AS text FROM part")
def txt28(spark, d):
    return derived(spark, d, "part").select("p_partkey", combined_text(F.col("p_name"), F.col("p_type")).alias("text"))


@query(
    "txt31_language_route",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN 'eng' WHEN doc_id % 4 <> 0 THEN 'non_eng_ingredients' ELSE 'non_eng_name_only' END AS route FROM documents "
    "WHERE lang = 'en' OR doc_id % 5 <> 0",
)
def txt31(spark, d):
    t = derived(spark, d, "documents").withColumn("ingredients", F.when(F.col("doc_id") % 4 == 0, "").otherwise("x"))
    name_lang = F.when(F.col("doc_id") % 5 == 0, "en").otherwise("fr")
    return t.select("doc_id", fd.language_route(F.col("lang"), name_lang, F.col("ingredients")).alias("route")).where("route IS NOT NULL")


@query(
    "txt32_embedded_eligible",
    ctes("ing") + """SELECT id, pos FROM ing WHERE pos % 3 = 0 AND food_category <> 'PROMO' AND NOT (value LIKE '%hot%' AND id % 2 = 0)""",
)
def txt32(spark, d):
    i = derived(spark, d, "ing")
    category = F.when(F.col("food_category") == "PROMO", "Cheese").otherwise(F.col("food_category"))
    value = F.replace("value", F.lit("hot"), F.lit("flour"))
    embedded = F.when(F.col("pos") % 3 == 0, F.when(F.col("id") % 2 == 0, "iron, x").otherwise("a, b")).otherwise("")
    return i.where(mt.embedded_eligible(category, value, embedded)).select("id", "pos")


@query(
    "txt33_adopt_percent",
    ctes("ing") + "SELECT id, pos, CASE WHEN percent0 IS NOT NULL THEN percent0 WHEN pos % 2 = 0 AND id % 60 + 0.5 <= 100.0 / pos THEN CAST(id % 60 + 0.5 AS DOUBLE) END AS percent FROM ing",
)
def txt33(spark, d):
    text = F.concat((F.col("id") % 60).cast("string"), F.lit(".5 % milk"), F.when(F.col("pos") % 2 == 0, "").otherwise(", 3% x"))
    return derived(spark, d, "ing").select("id", "pos", mt.adopted_percent(F.col("percent0"), text, F.col("pos")).alias("percent"))


N_RULES = 2_280


def class_rules(n: int = N_RULES) -> list[dict]:
    """Rules of the kinds that label files hold, by formula: terms of the name and the ingredients, exclusions, labels so far, a second alternative."""
    out = []
    for k in range(n):
        first = [ru.atom("name", "contains", f"{100 + k * 37 % 900}")]
        if k % 3:
            first.append(ru.atom("ingredients", "contains", f"{k * 53 % 100:02}%"))
        if k % 4 == 1:
            first.append(ru.atom("ingredients", "contains", WORDS[k % 5][1][0], True))
        if k % 5 == 2:
            first.append(ru.atom("label", "equals", f"Class {k * 11 % 40}", k % 2 == 1))
        second = [[ru.atom("name", "contains", f"{10_000 + k * 61 % 50_000}"), ru.atom("ingredients", "starts", WORDS[k % 5][1][-1])]] if k % 6 == 0 else []
        out.append(ru.rule(f"Class {k % 40}", first, *second))
    return out


def _rules_sql() -> str:
    rows = []
    for r in class_rules():
        one, two = r["any"][0], (r["any"][1] if len(r["any"]) > 1 else None)
        part = lambda tests, field, negate: next((f"'{a['value']}'" for a in tests or [] if a["field"] == field and a["negate"] == negate), "NULL")
        rows.append(f"{{'n': {part(one, 'name', False)}, 'i': {part(one, 'ingredients', False)}, 'x': {part(one, 'ingredients', True)}, 'l': {part(one, 'label', False)}, 'm': {part(one, 'label', True)}, 'p': {part(two, 'name', False)}, 's': {part(two, 'ingredients', False)}, 't': '{r['target']}'}}")
    first = "{'n': NULL, 'i': NULL, 'x': NULL, 'l': NULL, 'm': NULL, 'p': NULL, 's': NULL, 't': 'none'}"
    holds = """(contains(name, r.n) AND (r.i IS NULL OR contains(ing, r.i)) AND (r.x IS NULL OR NOT contains(ing, r.x)) AND (r.l IS NULL OR a.t = r.l) AND (r.m IS NULL OR a.t <> r.m))
      OR (r.p IS NOT NULL AND contains(name, r.p) AND starts_with(ing, r.s))"""
    same = ", ".join(f"'{c}': a.{c}" for c in "nixlmps")
    return ctes("txt") + f""", items AS (SELECT id, 'product ' || id AS name, coalesce(lower(ingredients_text), '') AS ing FROM txt),
    rules AS (SELECT [{', '.join(rows)}] AS list)
    SELECT id, (list_reduce(list_prepend({first}, rules.list), lambda a, r: {{{same}, 't': CASE WHEN {holds} THEN r.t ELSE a.t END}})).t AS label FROM items, rules"""


def _labelled_items(spark, d):
    return derived(spark, d, "txt").select("id", F.concat(F.lit("product "), F.col("id").cast("string")).alias("name"), "ingredients_text", F.lit("none").alias("before"))


@query("cls04_rules", _rules_sql())
def cls04(spark, d):
    return ru.labelled(_labelled_items(spark, d), class_rules(), "before", "name", "ingredients_text").select("id", "label")


CLASS_RULES = [
    ru.rule("Rings", [ru.atom("name", "contains", "ring")]),
    ru.rule("Big", [ru.atom("name", "starts", "large"), ru.atom("label", "equals", "Rings", True)]),
    ru.rule("Ring or bolt", [ru.atom("label", "one_of", "Rings|Big"), ru.atom("ingredients", "contains", "promo")], [ru.atom("name", "equals", "cold bolt")]),
]


@query(
    "cls04_rules_few",
    """SELECT p_partkey, CASE WHEN (l2 IN ('Rings', 'Big') AND p_type = 'PROMO') OR p_name = 'cold bolt' THEN 'Ring or bolt' ELSE l2 END AS label
       FROM (SELECT *, CASE WHEN p_name LIKE 'large%' AND l1 <> 'Rings' THEN 'Big' ELSE l1 END AS l2
             FROM (SELECT *, CASE WHEN p_name LIKE '%ring%' THEN 'Rings' ELSE p_brand END AS l1 FROM part))""",
)
def cls04_few(spark, d):
    p = derived(spark, d, "part")
    return p.select("p_partkey", ru.apply_rules(CLASS_RULES, F.col("p_brand"), F.upper("p_name"), F.col("p_type")).alias("label"))
