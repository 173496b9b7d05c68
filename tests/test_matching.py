import functools
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import brute_distinct, brute_occurrences, dictionary, occurrences, texts
from needlework.functions import hits
from needlework.operators import anchored, evaluate, matching
from needlework.operators.anchored import anchored_hits

ENTRIES = [
    (0, "--", 5),
    (1, ",\n", 1),
    (2, ",\n", 1),
    (3, "a", 2),
    (4, "abab", 3),
    (5, "union select", 7),
    (6, "\\E.*", 11),
    (7, "é-é", 13),
    (8, "= =", 4),
    (9, "select from users", 6),
]
TEXTS = [
    "",
    "-----",
    "-- --",
    "x,\ny",
    "ababab and a",
    "a union select from users --",
    "\\E.*\\E.*",
    "é-é-é",
    "= = = =",
    "nothing here",
    "é" * 50 + "abab" * 30,
]


def _scores(df):
    return {r.qid: r.score for r in df.collect()}


@pytest.fixture(params=["expression", "anchored"])
def form(request, monkeypatch):
    """Both physical forms of the scan."""
    if request.param == "anchored":
        monkeypatch.setattr(matching, "small_patterns", lambda *a, **k: None)
    return request.param


def test_scores_against_brute_force(spark, form):
    t, d = texts(spark, TEXTS), dictionary(spark, ENTRIES)
    assert _scores(matching.score_distinct(t, d)) == {i: brute_distinct(x, ENTRIES) for i, x in enumerate(TEXTS)}
    assert _scores(matching.score_occurrences(t, d)) == {i: brute_occurrences(x, ENTRIES) for i, x in enumerate(TEXTS)}


def test_repeats_overlaps_and_double_ids(spark, form):
    t, d = texts(spark, ["-----", "-- --", "x,\ny"]), dictionary(spark, ENTRIES[:3])
    assert _scores(matching.score_distinct(t, d)) == {0: 5, 1: 5, 2: 2}
    assert _scores(matching.score_occurrences(t, d)) == {0: 20, 1: 10, 2: 2}
    assert _scores(matching.score_occurrences_first_id(t, d)) == {0: 20, 1: 10, 2: 1}


def test_hits_lists_and_positions(spark, form):
    t, d = texts(spark, TEXTS), dictionary(spark, ENTRIES)
    want = {(i, pid): occurrences(x, p) for i, x in enumerate(TEXTS) for pid, p, _ in ENTRIES if p in x}
    assert {(r.qid, r.pid): r.hits for r in matching.pattern_hits(t, d).collect()} == {k: len(v) for k, v in want.items()}
    got = matching.match_positions(t, d).collect()
    lengths = {pid: len(p) for pid, p, _ in ENTRIES}
    assert sorted((r.qid, r.pid, r.start_pos, r.end_pos) for r in got) == sorted(
        (i, pid, at + 1, at + lengths[pid]) for (i, pid), ats in want.items() for at in ats
    )
    lists = {r.qid: r.matched for r in matching.matched_patterns(t, d).collect()}
    assert lists == {
        i: ", ".join(f"{p}({w})" for _, p, w in ENTRIES if p in x) for i, x in enumerate(TEXTS)
    }


def test_detection(spark, form):
    t, d = texts(spark, TEXTS), dictionary(spark, [e for e in ENTRIES if e[1] != "a"])
    found = {i for i, x in enumerate(TEXTS) if any(p in x for _, p, _ in ENTRIES if p != "a")}
    assert {r.qid for r in matching.detect_any(t, d).collect()} == found
    assert {r.qid for r in matching.detect_none(t, d).collect()} == set(range(len(TEXTS))) - found


def test_empty_dictionary(spark, form):
    t, d = texts(spark, ["a", "b"]), dictionary(spark, [])
    assert _scores(matching.score_distinct(t, d)) == {0: 0, 1: 0}
    assert matching.pattern_hits(t, d).count() == 0
    assert matching.detect_any(t, d).count() == 0
    assert matching.detect_none(t, d).count() == 2


def test_positions_across_chunks(spark, form, monkeypatch):
    monkeypatch.setattr(matching, "CHUNK", 7)
    rng = random.Random(5)
    values = ["".join(rng.choice("ab-") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    entries = [(0, "ab-a", 1), (1, "--", 1), (2, "b", 1), (3, "aba", 1)]
    got = matching.match_positions(texts(spark, values), dictionary(spark, entries)).collect()
    want = [(i, pid, at + 1) for i, x in enumerate(values) for pid, p, _ in entries for at in occurrences(x, p)]
    assert sorted((r.qid, r.pid, r.start_pos) for r in got) == sorted(want)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.text(alphabet="ab-é", max_size=25), min_size=20, max_size=30),
    st.lists(st.text(alphabet="ab-é", min_size=1, max_size=10), min_size=5, max_size=15),
)
def test_all_forms_agree(spark, values, patterns):
    entries = [(i, p, i + 1) for i, p in enumerate(patterns)]
    t, d = texts(spark, values), dictionary(spark, entries)
    want = {i: brute_occurrences(x, entries) for i, x in enumerate(values)}
    assert _scores(matching.score_occurrences(t, d)) == want
    distinct = {i: brute_distinct(x, entries) for i, x in enumerate(values)}
    assert _scores(matching.score_distinct(t, d)) == distinct
    assert all(distinct[i] <= want[i] for i in want)
    for rows in (10**6, 0):  # broadcast, then shuffled
        found = anchored_hits(t, d, ["qid"], "normalized", broadcast_rows=rows)
        got = {(r.qid, r.pid): r.hits for r in found.collect()}
        assert got == {(i, k): len(occurrences(x, p)) for i, x in enumerate(values) for k, p, _ in entries if p in x}
        assert found.count() == len(got)


def test_large_dictionary_takes_the_join(spark):
    entries = [(i, f"word{i:05d}", 1) for i in range(hits.EXPRESSION_PATTERNS + 1)]
    t, d = texts(spark, ["word00001 word00256 word99999", "none"]), dictionary(spark, entries)
    assert matching.small_patterns(d) is None
    assert _scores(matching.score_distinct(t, d)) == {0: 2, 1: 0}


def test_implications(spark, form):
    entries = [(0, "union", 1), (1, "union select", 1), (2, "select", 1), (3, "union", 1), (4, "x", 1)]
    got = {(r.pid, r.implied_pid) for r in matching.implications(dictionary(spark, entries)).collect()}
    assert got == {(1, 0), (1, 2)}


def test_gates_cover_every_pattern_once():
    patterns = [hits.Pattern(*e) for e in ENTRIES]
    groups = hits.gate_groups(patterns)
    assert sorted(p for _, members in groups for p in members) == sorted(patterns)
    assert all(gate in p.pattern for gate, members in groups for p in members)


def test_several_key_columns(spark, form):
    t = texts(spark, TEXTS).select((F.col("qid") % 3).alias("a"), (F.col("qid") / 3).cast("int").alias("b"), "normalized")
    got = matching.score_distinct(t, dictionary(spark, ENTRIES), ["a", "b"]).collect()
    assert {(r.a, r.b): r.score for r in got} == {
        (i % 3, i // 3): brute_distinct(x, ENTRIES) for i, x in enumerate(TEXTS)
    }


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
@pytest.mark.parametrize("tail", [64, 2])
def test_long_texts_are_cut_into_pieces(spark, broadcast_rows, tail):
    rng = random.Random(3)
    values = ["".join(rng.choice("abcé-") for _ in range(rng.randint(0, 80))) for _ in range(40)]
    entries = [(0, "ab", 1), (1, "abc", 1), (2, "-é-", 1), (3, "c", 1), (4, "bcab-", 1), (5, "abcabcabca", 1)]
    values += ["x" * 30 + "abcabcabcabca", "abcabcabcabcabcabcabcabc"]
    found = anchored_hits(
        texts(spark, values), dictionary(spark, entries), ["qid"], "normalized", broadcast_rows, tail=tail, piece=9
    ).collect()
    want = {(i, k): len(occurrences(x, p)) for i, x in enumerate(values) for k, p, _ in entries if p in x}
    assert len(found) == len(want)
    assert {(r.qid, r.pid): r.hits for r in found} == want


def test_many_ids_of_one_text(spark, form):
    entries = [(i, "ab" if i % 3 else f"x{i}", 1) for i in range(30)]
    t, d = texts(spark, ["abab x3", "x6"]), dictionary(spark, entries)
    assert _scores(matching.score_distinct(t, d)) == {0: 21, 1: 1}
    assert _scores(matching.score_occurrences(t, d)) == {0: 41, 1: 1}


@pytest.mark.parametrize("kind", ["constant", "broadcast", "shuffled"])
def test_null_and_repeated_keys_give_the_same_rows_in_every_form(spark, monkeypatch, kind):
    rows = [(None, 1, "a union select --"), (None, 1, "nothing"), (1, None, "-- --"), (1, None, "-- --"), (1, 2, ""), (2, 2, None)]
    logged = [(*row, "low") for row in rows]
    t = spark.createDataFrame(logged, "qid bigint, part int, normalized string, expected string").repartition(3)
    d = dictionary(spark, ENTRIES)
    if kind != "constant":
        for module in (matching, evaluate):
            monkeypatch.setattr(module, "small_patterns", lambda *a, **k: None)
    if kind == "shuffled":
        monkeypatch.setattr(matching, "anchored_hits", functools.partial(anchored_hits, broadcast_rows=0))

    def held(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)

    keys, distinct = ["qid", "part"], [brute_distinct(x or "", ENTRIES) for _, _, x in rows]
    counted = [brute_occurrences(x or "", ENTRIES) for _, _, x in rows]
    want = sorted(((a, b, s) for (a, b, _), s in zip(rows, distinct, strict=True)), key=repr)
    assert held(matching.score_distinct(t, d, keys), *keys, "score") == want
    hit = [row for row, s in zip(rows, distinct, strict=True) if s]
    none = [row for row, s in zip(rows, distinct, strict=True) if not s]
    assert held(matching.detect_any(t, d, keys), *keys, "normalized") == sorted(hit, key=repr)
    assert held(matching.detect_none(t, d, keys), *keys, "normalized") == sorted(none, key=repr)
    lists = [(a, b, ", ".join(f"{p}({w})" for _, p, w in ENTRIES if p in (x or ""))) for a, b, x in rows]
    assert held(matching.matched_patterns(t, d, keys), *keys, "matched") == sorted(lists, key=repr)
    hits = [(a, b, pid, len(occurrences(x, p))) for a, b, x in rows if x for pid, p, _ in ENTRIES if p in x]
    assert held(matching.pattern_hits(t, d, keys), *keys, "pid", "hits") == sorted(hits, key=repr)
    scored = [(a, x, s) for (a, _, x), s in zip(rows, counted, strict=True)]
    assert held(evaluate.score_log(t, d, "occurrences"), "qid", "normalized", "score") == sorted(scored, key=repr)
    ways = evaluate.score_log_all(t, d).where("algorithm = 'distinct'")
    assert held(ways, "qid", "normalized", "score") == sorted(
        ((a, x, s) for (a, _, x), s in zip(rows, distinct, strict=True)), key=repr
    )


def test_positions_in_repetitive_texts(spark, form):
    got = matching.match_positions(texts(spark, ["-" * 4096] * 3), dictionary(spark, [(0, "--", 1), (1, "-", 1)]))
    assert {(r.qid, r.pid): r.n for r in got.groupBy("qid", "pid").agg(F.count("*").alias("n")).collect()} == {
        (i, pid): 4095 + pid for i in range(3) for pid in (0, 1)
    }


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    anchors = spark.range(5000).selectExpr("id * 7919 + 13 AS gram")
    found = anchored.filter_of(anchors.repartition(3), 5000)
    own = (np.arange(5000) * 7919 + 13).astype(np.uint64)
    assert found.passes(own).all()
    assert found.passes(own + np.uint64(1)).mean() < 0.03


def test_only_candidates_leave_the_scan(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(50)]
    entries = [(i, v[k : k + 9], 1) for i, v in enumerate(values) for k in (3, 90)]
    filed = anchored.filed(dictionary(spark, entries))
    sizes = [r[0] for r in filed.selectExpr("int(shiftright(gram, 56))").distinct().collect()]
    rows = anchored.candidates(texts(spark, values), ["qid"], "normalized", sizes, anchored.filter_of(filed.select("gram"), len(entries)))
    strangers = rows.join(filed, "gram", "left_anti").count()
    assert sizes == [8] and rows.count() - strangers >= len(entries) and strangers < 0.03 * sum(map(len, values))


def test_a_gram_in_every_text_is_dealt_out(spark):
    values = [f"common prefix {i} common pr" for i in range(3000)]
    entries = [(i, f"common prefix {i} ", 1) for i in range(40)] + [(90 + i, f"rare{i}", 1) for i in range(20)]
    t, d = texts(spark, values), dictionary(spark, entries)
    found = {(r.qid, r.pid): r.hits for r in anchored_hits(t, d, ["qid"], "normalized", broadcast_rows=0).collect()}
    assert found == {(i, i): 1 for i in range(40)}
    entries = anchored.filed(d)
    grams = t.repartition(3).select("qid", F.lit(entries.where("pid = 0").first()["gram"]).alias("gram"))
    settings_ = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings_}
    for k, v in settings_.items():
        spark.conf.set(k, v)
    try:
        met = anchored._salted(grams, entries, grams.select("gram"), ["qid"])
        sizes = met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 40 * 3000 and len(sizes) == 8 and max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("tail", [64, 3])
def test_patterns_that_begin_alike_are_not_paired_with_every_text(spark, tail):
    entries = [(i, f"prefixes{i:04d}", 1) for i in range(2000)] + [(5000 + i, w, 1) for i, w in enumerate(["p", "xes", "prefixe", "prefixes", "prefixes0001 and"])]
    values = [f"a prefixes{i:04d} prefixes0001 an prefixes{2 * i:04d}" for i in range(300)] + ["prefixe", "", None]
    d, t = dictionary(spark, entries), texts(spark, values)
    heads = anchored.filed_by_heads(d, tail)
    if tail == 64:
        assert heads.groupBy("gram").count().agg(F.max("count")).first()[0] == 1
        lengths = sorted({len(p) for _, p, _ in entries if len(p) > 7})
        known = anchored.filter_of(heads.select(F.explode(F.array("gram", "first"))), 2 * len(entries))
        met = anchored.candidates(t, ["qid"], "normalized", [1, 3, 7, 8], known, lengths=lengths).join(heads, "gram")
        assert met.where("rest IS NOT NULL").count() < 5 * len(values)
    want = {(i, k): len(occurrences(x, p)) for i, x in enumerate(values) for k, p, _ in entries if p in (x or "")}
    for rows in (10**6, 100, 0):  # broadcast, longer patterns shuffled, all shuffled
        found = anchored_hits(t, d, ["qid"], "normalized", broadcast_rows=rows, tail=tail, piece=20).collect()
        assert len(found) == len(want) and {(r.qid, r.pid): r.hits for r in found} == want


def test_chains_of_implications(spark):
    n = 200
    entries = [(1000 - k, "a" * k, 1) for k in range(1, n + 1)] + [(2000, "b", 1), (2001, "ba" + "a" * 50, 1), (2002, "b", 1)]
    d = dictionary(spark, entries)
    rows = {r.pid: r for r in matching.implication_order(d).collect()}
    assert [rows[1000 - k].depth for k in range(1, n + 1)] == list(range(n))
    assert rows[2001].depth == 51 and rows[2001].n_direct == 2 and rows[2001].n_implied == 52
    assert {pid for pid, r in rows.items() if r.is_root} == {1000 - n, 2001} and set(rows) == {e[0] for e in entries} - {2002}
    direct = {(r.pid, r.implied_pid) for r in matching.direct_implications(d).collect()}
    assert direct == {(1000 - k, 1000 - k + 1) for k in range(2, n + 1)} | {(2001, 2000), (2001, 1000 - 51)}
