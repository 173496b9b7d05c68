from helpers import dictionary, texts
from needlework import fixed
from needlework.operators import dictionary as dicts
from needlework.operators import evaluate, matching
from needlework.tables import literal_table

ROWS = [  # dataset, expected, score
    ("a", "low", 0),
    ("a", "low", 20),
    ("a", "low", 21),
    ("b", "medium", 45),
    ("b", "high", 76),
]


def _assessed(spark, rows=ROWS):
    data = [{"qid": i, "dataset": d, "expected": e, "score": s} for i, (d, e, s) in enumerate(rows)]
    return evaluate.assess(literal_table(spark, data, "qid:bigint,dataset:string,expected:string,score:bigint"))


def test_accuracy_and_zero_share(spark):
    assert tuple(evaluate.accuracy(_assessed(spark)).first()) == (5, 3, 60.0)
    assert tuple(evaluate.zero_score_share(_assessed(spark)).first()) == (5, 1, 20.0)


def test_empty_log(spark):
    empty = _assessed(spark).where("false")
    assert tuple(evaluate.accuracy(empty).first()) == (0, 0, 0.0)
    assert tuple(evaluate.zero_score_share(empty).first()) == (0, 0, None)
    assert evaluate.confusion_matrix(empty).count() == 0


def test_matrix_and_totals(spark):
    rows = evaluate.accuracy_matrix(_assessed(spark), ["dataset", "expected"]).collect()
    got = {(r.dataset, r.expected): (r.total, r.correct, r.zero_scores) for r in rows}
    assert got == {
        ("a", "low"): (3, 2, 1),
        ("a", "(all)"): (3, 2, 1),
        ("b", "medium"): (1, 1, 0),
        ("b", "high"): (1, 0, 0),
        ("b", "(all)"): (2, 1, 0),
        ("(all)", "(all)"): (5, 3, 1),
    }


def test_confusion_and_stats(spark):
    rows = {r.expected: tuple(r[c] for c in fixed.LABELS) for r in evaluate.confusion_matrix(_assessed(spark)).collect()}
    assert rows == {"low": (2, 1, 0, 0), "medium": (0, 1, 0, 0), "high": (0, 0, 0, 1)}
    stats = {r.expected: (r.min_score, r.max_score, r.avg_score) for r in evaluate.score_stats(_assessed(spark)).collect()}
    assert stats["low"] == (0, 21, 41 / 3)


def test_filters_and_previews(spark):
    assessed = _assessed(spark)
    assert {r.qid for r in evaluate.filter_zero_score(assessed).collect()} == {0}
    assert {r.qid for r in evaluate.filter_mismatch(assessed).collect()} == {2, 4}
    first = evaluate.preview_per_class(assessed, "expected", "qid", 2).collect()
    assert sorted((r.expected, r.rank, r.qid) for r in first) == [("high", 1, 4), ("low", 1, 0), ("low", 2, 1), ("medium", 1, 3)]


def test_modes_disagree_on_repeats(spark, monkeypatch):
    t = texts(spark, ["--", "-- " * 20, "none"])
    d = dictionary(spark, [(0, "--", 5)])
    for large in (False, True):
        if large:
            monkeypatch.setattr(evaluate, "small_patterns", lambda *a, **k: None)
        rows = evaluate.algorithm_agreement(t, d).collect()
        assert [tuple(r) for r in rows] == [(1, 5, 100, "low", "critical")]


def test_all_modes_with_a_large_dictionary(spark, monkeypatch):
    log = texts(spark, ["-- --", "x,\ny", "none"]).selectExpr("*", "'low' AS expected", "normalized AS query")
    d = dictionary(spark, [(0, "--", 5), (1, ",\n", 1), (2, ",\n", 1)])
    small = {(r.qid, r.algorithm): r.score for r in evaluate.score_log_all(log, d).collect()}
    monkeypatch.setattr(evaluate, "small_patterns", lambda *a, **k: None)
    monkeypatch.setattr(matching, "small_patterns", lambda *a, **k: None)
    assert {(r.qid, r.algorithm): r.score for r in evaluate.score_log_all(log, d).collect()} == small
    assert small[0, "occurrences"] == 10 and small[1, "first_id"] == 1 and small[1, "distinct"] == 2


def test_pattern_frequency(spark):
    hits = matching.pattern_hits(texts(spark, ["-- --", "--", "a"]), dictionary(spark, [(0, "--", 5), (1, "b", 1)]))
    assert [tuple(r) for r in evaluate.pattern_frequency(hits).collect()] == [(0, 3, 2)]


def test_dictionary_reports(spark):
    d = dictionary(spark, [(i, p, 1) for i, p in enumerate(["ab", "abc", "ab", "x"])])
    assert [tuple(r) for r in dicts.duplicates(d).collect()] == [("ab", 0, 2, 2)]
    assert sorted(tuple(r) for r in dicts.first_ids(d).collect()) == [(0, "ab", 1), (1, "abc", 1), (3, "x", 1)]
    assert dicts.trie_stats(d).first().nodes == 1 + 4
    assert tuple(dicts.limits(d, max_nodes=4, max_patterns=4).first()) == (4, 5, False, True)
    assert [tuple(r) for r in dicts.preview(d, 3).collect()] == [(1, "ab"), (2, "abc"), (3, "ab"), (4, "... and 1 more patterns")]
    assert dicts.preview(d, 10).count() == 4


def test_weights(spark):
    given = ["xp_cmdshell; drop table", "drop table", "union", "union select", "zzz", "; delete x", "; drop"]
    t = dictionary(spark, [(i, p, 0) for i, p in enumerate(given)]).drop("weight")
    tiers = [r.w for r in t.select("pid", dicts.tiered_weight(t.pattern).alias("w")).orderBy("pid").collect()]
    assert tiers == [90, 50, 18, 30, 1, 1, 1]
    simple = [r.w for r in t.select("pid", dicts.simple_weight(t.pattern).alias("w")).orderBy("pid").collect()]
    assert simple == [100, 100, 10, 10, 10, 15, 100]
    exact = {r.pattern: r.weight for r in dicts.weight_lookup(t).collect()}
    assert exact == dict(zip(given, [0, 50, 18, 30, 0, 0, 0], strict=True))
