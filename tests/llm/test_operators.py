"""Corpus operators against brute force, and on the odd cases that their docstrings define."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from larder.llm import bpe, catalog, exact_dedup, licenses, mixing, near_dedup, pii, quality_classifier, quality_rules, secrets, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators use inside.
CLASHING = SCHEMA + ", id long, key string, n int, sha string, kept boolean, spans string, ids string, copy int, rate double, good string, measures int"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def frame(spark, rows, clashing=False):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in rows]
    return spark.createDataFrame([(*r, *[None] * 11) for r in rows] if clashing else rows, CLASHING if clashing else SCHEMA)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return " ".join(rng.choice([*vocabulary, "the", "of", "and"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text, clashing columns."""
    long = prose(1, 60_000)
    rows = [(1, None, None), (2, "", "a"), (3, " \t\n", "a"), (4, prose(2, 80), "b"), (4, prose(2, 80), "b"), (5, prose(2, 80).upper(), "b"), (None, prose(2, 80), None), (None, "x", "c"), (6, long, "a"), (7, long, "a"), (8, "é \U0001f600 Ünïcode", "a")]
    return frame(spark, rows, clashing=True), rows


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# near duplicates


def brute_components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = words_of("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    least = {i: i for i, _ in sets}
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                moved = True
    return {i: (len(s), least[i]) for i, s in sets}


def near_copies(seed, groups=12, copies=9):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(1000 + g, rng.choice([3, 12, 60, 200])).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = "".join(rng.choice("xyz") for _ in range(6))
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    rows = near_copies(width)
    got = near_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), width=width, percent=percent).collect()
    want = brute_components(rows, width, percent)
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("steps", [0, 2])
def test_large_nodes_descend_and_meet_in_blocks(spark, monkeypatch, steps):
    monkeypatch.setattr(near_dedup, "SMALL", 6)
    monkeypatch.setattr(near_dedup, "STEPS", steps)
    rows = near_copies(7, groups=3, copies=30)
    got = near_dedup.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows]), width=3, percent=85).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute_components(rows, 3, 85).items()}


def test_pairs_at_the_threshold_are_found_in_a_large_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 128)  # nodes of 1,500 sets are huge
    common, rows = [f"c{j}" for j in range(86)], []
    for i in range(1_000):  # similarity 0.75 between pairs, 0.852 within
        own = [*common, *(f"o{i}x{j}" for j in range(14))]
        rows += [(2 * i, " ".join(own), "s"), (2 * i + 1, " ".join([*own[:-8], *(f"p{i}x{j}" for j in range(8))]), "s")]
    got = {r["id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), width=1, percent=85).collect()}
    assert set(got.values()) <= set(range(0, 2_000, 2)) | {2 * i + 1 for i in range(1_000)}
    assert sum(got[2 * i + 1] != 2 * i for i in range(1_000)) <= 2


def test_near_duplicates_odd_cases(odd, empty):
    docs, rows = odd
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got if r[0] is not None}
    assert by_id[1][1:] == (0, 1, True) and by_id[3][1:] == (0, 3, True)
    assert by_id[5][2:] == (4, False) and by_id[7][2:] == (6, False)
    assert {r[2:] for r in got if r[0] is None} == {(4, False), (None, True)}
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 2, 3, 4, 4, 6, 8]


def test_a_near_duplicate_stage_leaves_one_of_each_group(spark):
    rows = near_copies(3, groups=5, copies=6)
    kept = {r["doc_id"] for r in near_dedup.drop_near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()}
    assert kept == {c for _, c in brute_components(rows, 5, 80).values()}


# mixing


def test_mixing_hits_target_shares_and_repeats_itself(spark):
    docs = frame(spark, [(i, f"t{i}", "big" if i % 10 else "small") for i in range(4000)])
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0), ("absent", 5.0)], "source string, weight double")
    first = sorted(tuple(r) for r in mixing.mixed(docs, weights).collect())
    assert first == sorted(tuple(r) for r in mixing.mixed(docs.repartition(7), weights).collect())
    share = sum(r[3] == "small" for r in first) / len(first)
    assert abs(len(first) - 4000) < 250 and abs(share - 0.5) < 0.04


def test_mixing_counts_follow_the_poisson_law(spark):
    docs = frame(spark, [(i, "", "s") for i in range(3000)])
    for mean in (0.7, 40.0):  # in one piece, and in several
        n = np.zeros(3000)
        for r in mixing.mixed(docs, rows=int(3000 * mean)).groupBy("doc_id").count().collect():
            n[r["doc_id"]] = r["count"]
        assert abs(n.mean() - mean) < 0.1 * mean + 0.05 and abs(n.var() - mean) < 0.15 * mean


def test_mixing_draws_rows_without_id_one_by_one(spark):
    docs = frame(spark, [(None, f"t{i}", "s") for i in range(3000)])
    out = mixing.mixed(docs, rows=1500)
    n = {r["text"]: r["count"] for r in out.groupBy("text").count().collect()}
    assert abs(sum(n.values()) - 1500) < 200 and 900 < len(n) < 1400
    assert out.select("shuffle_key").distinct().count() == sum(n.values())


def test_mixing_odd_cases(odd, empty):
    docs, rows = odd
    out = mixing.mixed(docs, rows=200)
    assert {"rate", "copy", "shuffle_key"} < set(out.columns) and out.count() > 50
    assert {r["source"] for r in out.collect()} == {None, "a", "b", "c"}
    assert mixing.mixed(empty).count() == 0


def test_mixing_weights_are_summed_and_checked(spark):
    docs = frame(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(2000)])
    table = lambda rows: spark.createDataFrame(rows, "source string, weight double")
    twice = sorted(tuple(r) for r in mixing.mixed(docs, table([("a", 1.0), ("b", 1.0), ("a", 1.0), ("b", None)])).collect())
    once = sorted(tuple(r) for r in mixing.mixed(docs, table([("a", 2.0), ("b", 1.0)])).collect())
    assert twice == once and len({(r[0], r[6]) for r in twice}) == len(twice)
    for bad in (-1.0, float("nan"), float("inf"), float("-inf")):
        with pytest.raises(ValueError, match="finite"):
            mixing.mixed(docs, table([("a", bad), ("b", 2.0)]))
        with pytest.raises(ValueError, match="finite"):
            mixing.mixed(docs, table([("a", bad), ("a", 2.0)]))


# personal data

_EMAIL, _IP, _CARD, _PHONE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(found):
    d = [int(c) for c in re.sub("[^0-9]", "", found)][::-1]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def brute_pii(text):
    holds = [("email", _EMAIL, lambda f: True), ("ip", _IP, lambda f: all(int(x) <= 255 for x in f.split("."))), ("card", _CARD, luhn), ("phone", _PHONE, lambda f: 9 <= len(re.sub("[^0-9]", "", f)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in holds for m in re.finditer(p, text or "") if ok(m[0])]


def test_pii_base_equals_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["a@b.co", "x.y%z@mail-1.example.com", "@", "a@b", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.08.9.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (415) 555-2671", "+12", "+1234567890123456", " ", " ", "é", "\U0001f600", "\n", "-", "%", "5", "12", "a.b", "q@w.e%r@t.y"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    texts += [None, "", "1" * 50_000, "a" * 50_000 + "@x.y", "1 " * 20_000, "4111 1111 1111 1111x" * 1_500, "+" + "1(" * 20_000]
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "context"] for r in pii.personal_data(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_pii(t), t and t[:80]


def test_pii_addresses_with_zero_parts_equal_plain_patterns(spark):
    bits = ["0", "00", "000", "0256", "10", "255", "256", "007"]
    texts = [f"at {a}.{b}.{c}.{d}, then" for a in bits for b in bits for c in bits for d in bits]
    texts += ["10.0.0.1", "127.0.0.1 and 192.168.0.1", "0.0.0.0", "00.1.2.3", "0.0.0.0.0.0.0.0", "0" * 4_000 + ".0.0.0", "0.0.0." + "0" * 4_000 + "256"]
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "context"] for r in pii.personal_data(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute_pii(t), t and t[:80]


def test_pii_contexts_discover_what_the_patterns_miss(spark, odd, empty):
    def card(i):
        d = f"4{i:014d}"
        return next(d + c for c in "0123456789" if luhn(d + c))

    rows = [(i, f"words before card: {card(i * 7919)} and after", "s") for i in range(30)]
    rows += [(100, "words before card: 4000000000000001 and after", "s"), (101, "the 4000000000000001 of nothing", "s"), (102, "version: 3.14159 here", "s")]
    got = {r["id"]: [(s["kind"], s["found"]) for s in r["spans"]] for r in pii.personal_data(frame(spark, rows)).collect()}
    assert got[100] == [("context", "4000000000000001")] and got[101] == [] == got[102] and all(len(got[i]) == 1 for i in range(30))
    docs, rows = odd
    assert pii.personal_data(docs).count() == len(rows) and pii.personal_data(empty).count() == 0


def test_pii_contexts_find_other_shapes_and_reject_articles(spark):
    """Four contexts of 40 seeds each; identifiers that no pattern nearly matches; the same strings behind other words."""
    unseen = ["phone: 030-1234567", "phone: 030 1234567", "phone: 0049 30 1234567", "contact me at john.doe(at)example.com", "contact me at bob7(at)corp.example.com", "user=x1234567", "e-mail: m\u00fcller@example.com"]
    rows = []
    for i in range(40):
        rows += [f"{prose(i, 12)} phone: +49 30 {1234000 + i * 37} {prose(i + 1, 5)}", f"{prose(i, 9)} e-mail: p{i}.q@mail{i % 7}.example.com, {prose(i, 4)}", f"{prose(i, 9)} user=n{i}@corp.example.com&x {prose(i, 4)}", f"please contact me at k{i}@home.example.org {prose(i, 9)}"]
        # an article before identifiers as often as before anything
        rows += [f"the +1 415 555 {2000 + i} of {prose(i, 20)} the {prose(i, 5)} the bc{i} the gate at noon, at home or at last"]
    first = len(rows)
    rows += [f"{prose(i, 8)} {x} {prose(i + 9, 8)}" for i, x in enumerate(unseen)]
    clean = ["the 030-1234567 of the", "a table 12345 wide", "version=1.22.333", "room: 12345", "at 12345678 of the", "look at x1234567 now"]
    rows += clean
    got = {r["id"]: [s["found"] for s in r["spans"] if s["kind"] == "context"] for r in pii.personal_data(frame(spark, [(i, t, "s") for i, t in enumerate(rows)])).collect()}
    want = [x.split(" ", 1)[1] if x.startswith(("phone", "e-mail")) else x.removeprefix("contact me at ").removeprefix("user=") for x in unseen]
    assert [got[first + i] for i in range(len(unseen))] == [[w] for w in want]
    assert [got[first + len(unseen) + i] for i in range(len(clean))] == [[] for _ in clean]
    assert all(not got[i] for i in range(first) if "user=" not in rows[i])


def brute_confident(texts):
    """Patterns by the docstring's rules, from plain Python loops."""
    words = lambda t: [m[0] for m in re.finditer(r"[^\x20\x09-\x0D:=#\"'(<\[{]*[:=#]+|[^\x20\x09-\x0D:=#\"'(<\[{]+", t.lower())]
    runs = lambda w, end: [" ".join(w[end - k : end]) for k in range(1, min(3, end) + 1)]
    edges = []
    for t in texts:
        base = brute_pii(t)
        for kind, pattern in zip(pii.KINDS, (_EMAIL, _IP, _CARD, _PHONE), strict=False):
            past = 0
            for m in re.finditer(pattern, t):
                if (kind, m.start(), m.end()) in base:
                    w = words(t[past : m.start()][-80:])
                    edges += [(p, m[0], True) for p in runs(w, len(w))] if len(m[0]) >= 5 else []
                past = m.end()
    support = {}
    for p, f, _ in edges:
        support.setdefault(p, set()).add(f)
    totals = {}
    for t in texts:
        w = words(t)
        for end in range(1, len(w) + 1):
            for p in runs(w, end):
                totals[p] = totals.get(p, 0) + 1
    return {p for p, found in support.items() if len(found) >= 5}, totals


def test_pii_occurrences_equal_plain_counts(spark, monkeypatch):
    texts = [f"{prose(i, 12)} phone: +49 30 {1234000 + i * 37} {prose(i + 1, 5)}" for i in range(30)] + ["a: b=c #d 'e' phone:phone: phone : x", "", " \n"]
    supported, totals = brute_confident(texts)
    assert "phone:" in supported
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    patterns = spark.createDataFrame([(p,) for p in [*supported, *sorted(totals)[:40]]], "pattern string").distinct()
    for literal in (5_000, 0):
        monkeypatch.setattr(pii, "LITERAL", literal)
        got = {r["pattern"]: r["total"] for r in pii.occurrences(docs, patterns).collect()}
        assert got == {r["pattern"]: totals[r["pattern"]] for r in patterns.collect()}


# quality


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.resampled(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id").toPandas()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.kept.mean() >= 0.98 and bad.kept.mean() <= 0.05


def test_top_k_is_exact(spark):
    values = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 1, -2.5, 9, 9, 0.1, 1e9, -1e-12]], "v double")
    ordered = sorted((r[0] for r in values.collect()), reverse=True)
    assert [quality_classifier.kth_largest(values, "v", k, bins=3) for k in range(1, 10)] == ordered[:9]


def test_classifier_odd_cases(spark, odd, empty):
    docs, rows = odd
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 1), (None, 1), (2, None), (99, 0)], "doc_id long, quality int")
    out = quality_classifier.resampled(docs, labels)
    assert out.count() == len(rows) and all(r["log_weight"] is not None for r in out.collect())
    nothing = labels.where("false")
    assert quality_classifier.resampled(docs, nothing).where("kept").count() == len(rows)
    assert quality_classifier.resampled(empty, labels).count() == 0
    kept = quality_classifier.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.where("kept").count()


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return catalog.byte_vocabulary()


def whole_ids(vocabulary, text):
    return bpe._encoding(vocabulary.ranks, vocabulary.pattern)[0].encode_ordinary(text or "")


def test_chunks_encode_as_the_whole_text(spark, vocabulary):
    rng = random.Random(11)
    bits = ["a", "the", "  ", " ", "\n\n", "\t ", "123", "'s", "'", "é", "ß日本", "!!", "\U0001f600", " \n ", "can't", "x" * 40, " ", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 400))) for _ in range(120)] + [None, "", "z" * 3000, " " * 3000, "\n" * 500]
    out = bpe.encoded(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), vocabulary, decode=True, chunk=60, overlap=25)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["ids"]) == whole_ids(vocabulary, t)
        assert bytes(got[i]["decoded"]) == (t or "").encode()


def test_decoding_is_a_round_trip(spark, vocabulary):
    texts = ["", "Grüße aus\tKöln\n", "日本語 \U0001f600", "  two  spaces "]
    tokens = bpe.encoded(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), vocabulary)
    assert sorted(bytes(r["decoded"]).decode() for r in bpe.decoded(tokens, vocabulary).collect()) == sorted(texts)


def test_bpe_odd_cases(odd, empty, vocabulary):
    docs, rows = odd
    out = bpe.encoded(docs, vocabulary, decode=True)
    assert sorted(len(r["ids"]) for r in out.collect()) == sorted(len(whole_ids(vocabulary, t)) for _, t, _ in rows)
    assert bpe.encoded(empty, vocabulary).count() == 0


# sharding


def test_sharding_law_and_slots(spark):
    docs = frame(spark, [(i, f"t{i}" * (i % 7), "s") for i in range(20_000)])
    out = sharding.sharded(docs, 40).toPandas()
    assert set(out["law"]) == {"key"} and set(out["shard"]) == set(range(40))
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {40} and abs(len(moved) - 20_000 / 41) < 100
    again = sharding.sharded(docs.repartition(5), 40).toPandas().set_index("id").sort_index()
    assert again.equals(out.set_index("id").sort_index())
    text = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    assert all(r.size_ == len(text[r.id]) + 16 and r.text_crc32 == zlib.crc32(text[r.id]) for r in out.rename(columns={"size": "size_"}).itertuples())


def test_sharding_follows_weights_and_confines_movement(spark):
    docs = frame(spark, [(i, "", "s") for i in range(20_000)])
    plain, heavier = sharding.topology(40), sharding.topology(40, weights={3: 3.0})
    out = sharding.sharded(docs, tree=plain, grown=heavier).toPandas()
    assert abs((out["grown_shard"] == 3).mean() - 3 / 42) < 0.01
    before, after = out["shard"] // 10, out["grown_shard"] // 10
    assert set(after[before != after]) == {0}  # between regions, rows move only into the one that grew


def test_sharding_odd_cases(odd, empty):
    docs, rows = odd
    out = sharding.sharded(docs, 3).toPandas()
    assert len(out) == len(rows) and out["size"].min() == 16 and out[out["id"] == 1]["text_crc32"].iloc[0] == 0
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sharding.sharded(empty).count() == 0


# licenses


def brute_licenses(text, templates):
    def grams(t):
        w = [x for x in re.split(r"[^\w]+|_+", (t or "").lower()) if x]
        return [tuple(w[i : i + licenses.WIDTH]) for i in range(len(w) - licenses.WIDTH + 1)]

    have = grams(text)
    sizes = {n: set(grams(t)) for n, t in templates.items()}
    out = set()
    for least, most, step, window, _ in licenses._plan([len(s) for s in sizes.values() if s]):
        for n, s in sizes.items():
            if least <= len(s) <= most and any(len(set(have[k : k + window]) & s) >= licenses.CONTAINED * len(s) for k in range(0, len(have), step)):
                out.add(n)
    return out


def test_licenses_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        text = prose(i, rng.randint(0, 120)).split()
        for t in rng.sample(sorted(licenses.TEMPLATES.values()), rng.randint(0, 2)):
            own = t.split()
            if rng.random() < 0.5 and len(own) > 20:
                own[rng.randrange(len(own))] = "changed"
            at = rng.randint(0, len(text))
            text[at:at] = own
        rows.append((i, " ".join(text) if i else None, "s"))
    got = {r["id"]: {x["name"] for x in r["licenses"]} for r in licenses.licenses(frame(spark, rows)).collect()}
    assert got == {i: brute_licenses(t, licenses.TEMPLATES) for i, t, _ in rows}
    assert sum(map(len, got.values())) > 60


def test_licenses_odd_cases(odd, empty):
    docs, rows = odd
    assert licenses.licenses(docs).count() == len(rows) and licenses.licenses(empty).count() == 0
    assert licenses.licenses(docs, {"short": "too short"}).where("size(licenses) > 0").count() == 0


# secrets

_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute_secrets(text):
    out = [("assign", m) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16] + [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(((k, m.start(), m.end()) for k, m in out), key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_secrets_base_equals_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["password", "PassWd", "token", "ſecret", "SECRET", "api_key", "apiKey", "=", ":", " ", '"', "'", "abcdefgh", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "f" * 20, "é", "İ", "x", "\n", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", "a" * 100_000, "token" + " " * 50_000]
    got = {r["id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "novel"] for r in secrets.secrets(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert all(got[i] == brute_secrets(t) for i, t in enumerate(texts))


def random_key(rng, n, of="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(rng.choice(of) for _ in range(n))


def test_novel_strings_near_sensitive_words_are_reported(spark, odd, empty):
    """On either side, in any spelling, short or long, of letters alone or with punctuation; told twice; never the prose around."""
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    around = prose(31, 60), prose(32, 60)
    forms = {
        "authorization header is {}": random_key(rng, 12), "bearer {}": random_key(rng, 20, letters), "Bearer {} again": random_key(rng, 32, letters), "{} is the access_key": random_key(rng, 32),
        "the private key reads {}": random_key(rng, 32), "bearer {} here": random_key(rng, 12) + "!" + random_key(rng, 12), "webhook " + prose(3, 11)[:70] + " {}": random_key(rng, 32),
        "passphrase: {}": random_key(rng, 24, letters[26:]), "api-key {} and once more": random_key(rng, 16), "credential for the service is {} keep it": random_key(rng, 40),
    }
    texts = [f"{around[0]} {form.format(key)} {around[1]}" for form, key in forms.items()] + [f"{around[0]} token {k} or {k} {around[1]}" for k in [random_key(rng, 24)]]
    want = [[key] for key in forms.values()] + [[texts[-1].split(" token ")[1].split(" ")[0]] * 2]
    clean = [f"{around[0]} {form.format('')} {around[1]}" for form in forms] + [f"{around[0]} {random_key(rng, 40)} {around[1]}", "the credential is your_password_here_1 as an example", "bearer 00000000000000000000000000000000000a", "get_access_token(settings.SECRET_KEY) returns the token"]
    got = {r["id"]: [s["found"] for s in r["spans"] if s["kind"] == "novel"] for r in secrets.secrets(frame(spark, [(i, t, "s") for i, t in enumerate(texts + clean)])).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert [got[len(texts) + i] for i in range(len(clean))] == [[] for _ in clean]
    docs, rows = odd
    assert secrets.secrets(docs).count() == len(rows) and secrets.secrets(empty).count() == 0


def test_novelty_tells_keys_from_words():
    """Of random keys of 12 characters and more, 19 of 20 are found; of words, one in a hundred at most."""
    rng, texts = random.Random(6), [prose(100 + i, 300) for i in range(10)]
    hit = {n: sum(secrets.novelty(t[:512], random_key(rng, n), t[512:1024]) >= secrets.NOVEL for t in texts for _ in range(10)) for n in (12, 16, 24)}
    assert all(h >= 95 for h in hit.values())
    words = [w for i in range(200, 230) for w in prose(i, 60).split() if len(w) >= 7]
    assert sum(secrets.novelty(t[:512], w + w[::-1], t[512:1024]) >= secrets.NOVEL for t in texts[:3] for w in words) <= len(words) * 3 // 10


def test_novel_spans_equal_all_windows(spark):
    """Every candidate in reach of every sensitive word, measured one by one."""
    rng = random.Random(12)
    bits = ["token", "access key", "bearer", "###", "is", "the", "é", "\n", "x" * 9, "your_password_here"]
    texts = []
    for _ in range(60):
        parts = [rng.choice(bits) if rng.random() < 0.3 else (random_key(rng, rng.randint(8, 30)) if rng.random() < 0.2 else rng.choice(prose(1, 40).split())) for _ in range(80)]
        texts.append(" ".join(parts))
    got = {r["id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "novel"] for r in secrets.secrets(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        base = [(a, z) for _, a, z in brute_secrets(t)]
        spots = [(m.start(), m.end()) for m in secrets.sensitive_words().finditer(t.lower())]
        want = []
        for m in secrets.CANDIDATE.finditer(t):
            a, z = secrets._core(t, m.start(), m.end())
            near = any(m.start() <= e + secrets.REACH and m.end() > s - secrets.REACH for s, e in spots)
            if near and z - a >= secrets.SHORTEST and not any(x < z and a < y for x, y in base) and secrets.novelty(t[max(0, a - 512) : a], t[a:z], t[z : z + 512]) >= secrets.NOVEL:
                want.append((a, z))
        assert got[i] == want


# quality rules


def brute_measures(text):
    text = text or ""
    w = words_of(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set()
    lines = [x for x in text.split("\n") if words_of(x)]
    repeated = {p for i, g in enumerate(grams) if g in seen for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated))


def test_quality_measures_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["a", "b", "c", "dé", "#x", "\n", "\n\n", "\t", "the"]) for _ in range(rng.randint(0, 90))) for _ in range(200)] + [None, "", "a a a a", "   x"]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for bits in (21, 3):  # packed entries; prefixes that collide and positions that don't fit
        monkeypatch.setattr(quality_rules, "_BITS", bits)
        for r in quality_rules.judged(docs).collect():
            m = r["measures"]
            assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute_measures(texts[r["doc_id"]])
            assert r["base_failed"] == (m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])


def test_quality_rules_odd_cases(odd, empty):
    docs, rows = odd
    out = quality_rules.judged(docs)
    assert out.count() == len(rows) and not out.where("kept is null or (base_failed and kept)").count()
    assert quality_rules.judged(empty).count() == 0


# exact de-duplication


def test_exact_duplicates_odd_cases(odd, empty):
    docs, rows = odd
    out = exact_dedup.exact_duplicates(docs).collect()
    assert len(out) == len(rows)
    by_text = {}
    for i, t, _ in rows:
        by_text.setdefault((t or "").encode().lower(), []).append(i)
    for r in out:
        group = next(g for t, g in by_text.items() if hashlib.sha256(t).digest() == bytes(r["digest"]))
        top = max((i for i in group if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (top, len(group), r["id"] == top)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "3", "5", "None", "7", "8"])
    assert exact_dedup.exact_duplicates(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0


def test_cuckoo_index_inserts_grows_and_deletes():
    index, keys = exact_dedup.Cuckoo(2), [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.homes >= 1024 and all(index.find(k) >= 0 for k in keys)  # grown from stored keys
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    packed = exact_dedup.Cuckoo.of(type("Row", (), index.row(0)))
    assert [packed.find(k) >= 0 for k in keys] == [i % 2 == 1 for i in range(3000)]
    packed.insert(keys[1], 5000, 2)
    assert next(x for x in packed.live() if x[0] == keys[1])[1:] == (5000, 3, 1)


def test_index_table_takes_batches_and_deletions(spark):
    def batch(numbers, gone=False):
        rows = [(bytearray(hashlib.sha256(str(i).encode()).digest()), i, 1, 1, gone) for i in numbers]
        return spark.createDataFrame(rows, "digest binary, top long, n long, at_top long, gone boolean")

    state = exact_dedup.updated(None, batch(range(100)), 8)
    state = exact_dedup.updated(state, batch(range(50, 150)).union(batch(range(10), True)), 8)
    got = {r["keep_id"]: r["group_size"] for r in exact_dedup.entries(state).collect()}
    assert got == {i: 2 if 50 <= i < 100 else 1 for i in range(10, 150)}
