"""Queries of the corpus operators over whole tables, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import bpe, conversations, exact_dedup, jaccard_join, licenses, merkle, mixing, near_dedup, pii, quality_classifier, quality_rules, secrets, sharding
from larder.llm.common import table

QUERIES: dict[str, Callable] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


#: Every text's words (A-Z lower-cased) as rows of (id, position, word) in DuckDB.
_SETS = """
WITH RECURSIVE docs AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
words AS (SELECT doc_id, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') w FROM docs),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) s FROM words),
"""

def _linked_sql(percent: int, more: str = "") -> str:
    return _SETS + f"""
sizes AS (SELECT doc_id, count(*) n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, n, md5(string_agg(s, chr(10) ORDER BY s)) k FROM shingles JOIN sizes USING (doc_id) GROUP BY doc_id, n),
reps AS (SELECT k, min(doc_id) doc_id, any_value(n) n FROM sets GROUP BY k),
own AS (SELECT doc_id, s FROM shingles JOIN reps USING (doc_id)),
met AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN reps x ON x.doc_id = a JOIN reps y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT doc_id, doc_id FROM reps UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON r.b = l.a),
roots AS (SELECT a, min(b) root FROM reached GROUP BY a)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT n_shingles, coalesce(root, d.doc_id) component_id{more}
FROM documents d LEFT JOIN sets z ON z.doc_id = d.doc_id LEFT JOIN reps p ON p.k = z.k LEFT JOIN roots o ON o.a = p.doc_id
"""


@query("op1_near_dedup", _linked_sql(85, ", coalesce(root, d.doc_id) = d.doc_id kept"))
def near_dedup_query(spark, sf_dir: str) -> DataFrame:
    out = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return out.withColumnRenamed("id", "doc_id")


def byte_vocabulary() -> bpe.Vocabulary:
    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_bpe")
def bpe_query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encoded(docs, byte_vocabulary(), decode=True)
    return out.select("doc_id", *[c.alias(n) for n, c in bpe.digests().items()])


@query("op10_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) keep_id, count(*)::BIGINT group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id kept, text_sha256 FROM t JOIN g USING (text_sha256)
""")  # fmt: skip
def exact_dedup_query(spark, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op8_secrets")
def secrets_query(spark, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(spans, s -> s.kind <> 'novel')"))
    return found.select(F.col("id").alias("doc_id"), *[count_of("spans", k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


_STOP = ", ".join(f"'{w}'" for w in sorted({x for words in quality_rules.STOP_WORDS.values() for x in words}))
_RULES_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(r.n, 0)::BIGINT n_repeat_words, len(l) n_lines,
  len(list_filter(w, lambda x: list_contains([{_STOP}], lower(regexp_replace(x, '[.,;:!?]+$', ''))))) n_stop, length(regexp_replace(t, '[^A-Z]', '', 'g')) n_upper,
  len(list_filter(l, lambda x: regexp_matches(x, '^[ \t]*[-*•] '))) n_bullet
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / word_chars <= 0.2
  AND n_stop / n_words >= 0.03 AND n_dup_lines / n_lines <= 0.3 AND n_upper / word_chars <= 0.4 AND n_bullet / n_lines <= 0.9 kept FROM b
"""


@query("op9_quality_rules", _RULES_SQL)
def quality_rules_query(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


_MIX = """
WITH RECURSIVE sizes AS (SELECT source, count(*) n, sqrt(count(*)) weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n rate FROM sizes),
p(source, rate, k, p, c) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM p WHERE k < 71),
tables AS (SELECT source, rate, list(c ORDER BY k) c FROM p GROUP BY source, rate),
drawn AS (SELECT d.*, t.rate, t.c, (('0x' || substr(md5('42|' || doc_id || '|1'), 1, 8))::BIGINT + 0.5) / 4294967296.0 u FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, len(list_filter(c, lambda x: x < u)) n FROM drawn)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) rate, copy::INTEGER copy, md5('42 order|' || doc_id || '|' || copy) shuffle_key FROM (SELECT *, unnest(range(0, n)) copy FROM counted)
"""


@query("op2_mixing", _MIX)
def mixing_query(spark, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 9))


@query("op4_quality_classifier")
def quality_classifier_query(spark, sf_dir: str) -> DataFrame:
    out = quality_classifier.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


@query("op3_pii")
def pii_query(spark, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents")).withColumn("base", F.expr("filter(spans, s -> s.kind <> 'context')"))
    counts = [count_of("spans", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@query("op7_license_scan")
def license_query(spark, sf_dir: str) -> DataFrame:
    found = licenses.licenses(table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), F.size("licenses").cast("long").alias("n_licenses"), listed.alias("licenses"))


#: CRC-32 in DuckDB: a table by rule, and a fold over the characters (ASCII) of ``%s``.
_CRC_TABLE = "(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) t FROM (SELECT range i FROM range(256)))"


def crc_sql(text: str, table: str = "crc.t") -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR) || ':' || {value} END"


_MERKLE = f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
docs AS (SELECT doc_id, coalesce('=' || lang, '') tree, sha256({' || '.join(_field(c) for c in merkle.FIELDS)}) leaf,
  CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 THEN sha256({' || '.join(_field('n_chars + 1' if c == 'n_chars' else c) for c in merkle.FIELDS)}) END other FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 i, count(*) OVER (PARTITION BY tree) n FROM docs),
low(tree, l, i, d, n) AS (SELECT tree, 0, i, leaf, n FROM leaves UNION ALL SELECT tree, l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, l, i // 2, n),
trees AS (SELECT tree, d subroot, row_number() OVER (ORDER BY tree) - 1 i, count(*) OVER () n FROM low WHERE n = 1),
high(l, i, d, n) AS (SELECT 0, i, subroot, n FROM trees UNION ALL SELECT l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY l, i // 2, n),
steps AS (SELECT tree, 0 upper, l, i, CASE WHEN i % 2 = 0 THEN '*' || coalesce(s, '') ELSE s || '*' END run FROM (SELECT a.tree, a.l, a.i, a.n, b.d s FROM low a LEFT JOIN low b ON a.tree = b.tree AND a.l = b.l AND b.i = xor(a.i, 1)) WHERE n > 1
  UNION ALL SELECT NULL, 1, l, i, CASE WHEN i % 2 = 0 THEN '*' || coalesce(s, '') ELSE s || '*' END FROM (SELECT a.l, a.i, a.n, b.d s FROM high a LEFT JOIN high b ON a.l = b.l AND b.i = xor(a.i, 1)) WHERE n > 1),
ways AS (SELECT doc_id, leaf, other, x.tree, subroot, list(run ORDER BY upper, l) FILTER (run IS NOT NULL) runs FROM leaves x JOIN trees USING (tree)
  LEFT JOIN steps s ON (s.upper = 0 AND s.tree = x.tree AND s.i = x.i >> s.l) OR (s.upper = 1 AND s.i = trees.i >> s.l) GROUP BY ALL),
told AS (SELECT doc_id, leaf, subroot, (SELECT d FROM high WHERE n = 1) root, sha256(replace(array_to_string(coalesce(runs, []), ''), '*', '')) proof_sha256,
  list_reduce([coalesce(other, leaf)] || coalesce(runs, []), lambda node, run: sha256(replace(run, '*', node))) folded_root FROM ways)
SELECT *, folded_root = root verified FROM told
"""


@query("op11_merkle_manifest", _MERKLE)
def merkle_query(spark, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    seen = merkle.audited(table(spark, sf_dir, "documents"), altered, {"n_chars": F.col("n_chars") + 1})
    return seen.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("proof")), 256).alias("proof_sha256"), "folded_root", "verified")


def _repair_sql() -> str:
    """A backward recursion over whole (cost, letters, lines) of each state, without checkpoints."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    who = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    edit = lambda cost, letter, line, then: f"{{'c': {cost} + {then}.c, 'a': '{letter}' || {then}.a, 't': {line} || {then}.t}}"
    least = lambda *ways: f"list_sort([{', '.join(ways)}])[1]"
    kept = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    row = []
    for s in range(4):
        ways = [edit(2, "D", "''", f"v.s{s}")]
        never = "{'c': 1000000000::BIGINT, 'a': '', 't': ''}"
        ways.append(f"CASE WHEN must THEN {never} ELSE {edit('1 + extra', 'R', f'chr(10) || {chr(39)}{who[s]}:{chr(39)} || text', f'v.s{after[s]}')} END")
        for initial, moves in kept.items():
            if s in moves:
                ways.append(f"CASE WHEN must OR initial <> '{initial}' THEN {never} ELSE {edit('extra', 'K', 'chr(10) || role || chr(58) || text', f'v.s{moves[s]}')} END")
        row.append(f"{least(*ways)} u{s}")
    put = lambda s, then: edit(5, "I", f"chr(10) || '{who[s]}:'", then)
    return f"""
WITH RECURSIVE crc AS {_CRC_TABLE},
named AS (SELECT conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 fault FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END text,
  unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) copy FROM named WHERE fault > 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text)) i FROM damaged),
judged AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 again,
  NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') cut, left(role, 1) initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) past FROM placed),
r AS (SELECT *, blank OR again must, CASE WHEN cut THEN 5 ELSE 0 END extra FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps, count(*) FILTER (blank) blank, count(*) FILTER (again AND NOT blank) duplicate,
  count(*) FILTER (cut AND NOT must) truncated, count(*) FILTER (past IS NOT NULL AND past || initial NOT IN ('su', 'ua', 'au')) illegal, max(i) n FROM r GROUP BY conv_id),
v(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, n + 1, {{'c': 0::BIGINT, 'a': '', 't': ''}}, {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0::BIGINT, 'a': '', 't': ''}} FROM counts
  UNION ALL
  SELECT conv_id, i, {least('u0', put(0, 'w'))}, {least('u1', put(1, 'w'))}, w, {least('u3', put(3, 'u2'))} FROM (
    SELECT *, {least('u2', put(2, 'u3'))} w FROM (
      SELECT v.conv_id, r.i, {', '.join(row)} FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i - 1)))
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate, coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal,
  coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') audit, sha256(coalesce(substr(s0.t, 2), '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM o.conv_id AND v.i = 1
"""


@query("op13_conversation_repair", _repair_sql())
def repair_query(spark, sf_dir: str) -> DataFrame:
    rows, copies = conversations.damaged(table(spark, sf_dir, "conversations"))
    return conversations.repaired(rows, copies=copies)


@query("op12_jaccard_join", _linked_sql(90))
def jaccard_join_query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(table(spark, sf_dir, "documents"), width=3, percent=90).withColumnRenamed("id", "doc_id")


def _shards_sql() -> str:
    u = lambda name: f"(('0x' || substr(md5(k || '|' || {name}), 1, 8))::BIGINT + 0.5) / 4294967296.0"
    least = lambda name: f"arg_min({name}, -ln({u(name)}) / w)"
    placed = lambda tree: f"""{tree}_region AS (SELECT k, {least('region')} region FROM keys, (SELECT region, count(*)::DOUBLE w FROM {tree} GROUP BY 1) GROUP BY k),
{tree}_rack AS (SELECT k, region, {least('rack')} rack FROM {tree}_region JOIN (SELECT region, rack, count(*)::DOUBLE w FROM {tree} GROUP BY ALL) USING (region) GROUP BY ALL),
{tree}_shard AS (SELECT k, {least('shard')} shard FROM {tree}_rack JOIN (SELECT rack, shard, 1.0 w FROM {tree}) USING (rack) GROUP BY k)"""  # noqa: E731
    codes = "list_transform(regexp_extract_all(hex(encode(d.t)), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"""
WITH crc AS {_CRC_TABLE},
docs AS (SELECT doc_id, coalesce(text, '') t, coalesce(doc_id::VARCHAR, 'text ' || sha256(coalesce(text, ''))) k FROM documents), keys AS (SELECT DISTINCT k FROM docs),
tree AS (SELECT 'region' || (i // 10) region, 'rack' || (i // 5) rack, 'shard' || i shard FROM range(40) r(i)), grown AS (FROM tree UNION ALL SELECT 'region-of-shard40', 'rack-of-shard40', 'shard40'),
{placed('tree')}, {placed('grown')},
sized AS (SELECT doc_id, k, strlen(d.t) + 16 size, xor(list_reduce([4294967295] || {codes}, lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295) text_crc32 FROM docs d, crc)
SELECT doc_id, size::BIGINT size, text_crc32::BIGINT text_crc32, 'key' law, substr(a.shard, 6)::INTEGER shard, row_number() OVER (PARTITION BY a.shard ORDER BY md5('slot|' || k), doc_id, size, text_crc32) - 1 slot, substr(b.shard, 6)::INTEGER grown_shard
FROM sized JOIN tree_shard a USING (k) JOIN grown_shard b USING (k)
"""


@query("op6_sharding", _shards_sql())
def sharding_query(spark, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents"), 40).withColumnRenamed("id", "doc_id")
