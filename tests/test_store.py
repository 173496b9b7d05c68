"""The data-set store, exact samples and evaluation that is added to."""

import io
import random
from collections import Counter
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from helpers import dictionary
from needlework import fixed
from needlework.operators import evaluate, sampling, states
from needlework.sources import store


def rows(spark, sets):
    made = [(f"drop {i}" if i % 3 else f"x {i}", risk, f"drop {i}" if i % 3 else f"x {i}", risk, n) for risk, n in sets for i in range(n)]
    return spark.createDataFrame(made, store.FIELDS)


def counts(spark, path, names=None):
    return {(r.set_risk, r.set_size): r["count"] for r in store.read_sets(spark, path, names).groupBy(*store.SET).count().collect()}


def test_sets_are_replaced_whole_and_others_stay(spark, tmp_path):
    path = str(tmp_path)
    store.write_sets(rows(spark, [(r, n) for r in fixed.LABELS for n in (10, 100)]), path)
    store.write_sets(rows(spark, [("low", 100)]).limit(7), path)
    store.write_sets(rows(spark, [("high", 1000)]), path)
    want = {(r, n): n for r in fixed.LABELS for n in (10, 100)} | {("low", 100): 7, ("high", 1000): 1000}
    assert counts(spark, path) == want
    store.drop_set(spark, path, "high", 1000)
    assert counts(spark, path) == {k: n for k, n in want.items() if k != ("high", 1000)}
    assert counts(spark, path, ["Low_100", "sql_dataset_Critical_10.csv", "High_5000"]) == {("low", 100): 7, ("critical", 10): 10}
    with pytest.raises(ValueError):
        store.named(["Extreme_10"])


def test_reading_by_name_touches_only_these_folders(spark, tmp_path):
    store.write_sets(rows(spark, [(r, n) for r in fixed.LABELS for n in (10, 20)]), str(tmp_path))
    few = store.read_sets(spark, str(tmp_path), ["Medium_20"])
    out = io.StringIO()
    with redirect_stdout(out):
        few.explain("formatted")
    filters = next(line for line in out.getvalue().splitlines() if line.startswith("PartitionFilters"))
    assert "set_risk" in filters and "set_size" in filters
    assert len(few.inputFiles()) > 1 and few.select(F.input_file_name().alias("f")).distinct().where("f NOT LIKE '%medium/set_size=20%'").isEmpty()


@pytest.mark.parametrize("n", [0, 1, 10, 100, 1000, 5000, 10_000])
def test_samples_are_exact_and_do_not_hang_on_partitions(spark, n):
    table = spark.range(24_000).selectExpr("id AS k", "IF(id % 4 = 0, 'a', IF(id % 40 = 1, 'c', 'b')) AS risk", "id % 7 AS v")
    got = {}
    for parts in (1, 6):
        taken = sampling.exact_sample(table.repartition(parts, "v"), "risk", n, "k")
        got[parts] = sorted((r.risk, r.k) for r in taken.collect())
    assert got[1] == got[6]
    assert Counter(r for r, _ in got[1]) == Counter({r: min(n, size) for r, size in (("a", 6000), ("b", 17_400), ("c", 600)) if n})
    if n:
        lowest = table.where("risk = 'b'").select("k", sampling.order_of("k").alias("h")).orderBy("h").limit(n).collect()
        assert {k for r, k in got[1] if r == "b"} == {r.k for r in lowest}


def test_samples_cut_ties_and_leave_rows_without_class(spark, monkeypatch):
    same = [(1, "a", i) for i in range(50)] + [(2, "a", i) for i in range(50)] + [(None, "a", 1), (3, None, 1)] + [(7, "b", 0)] * 30
    table = spark.createDataFrame(same, "k bigint, risk string, v bigint").repartition(4)
    for n in (5, 50, 73, 100, 500):
        taken = sampling.exact_sample(table, "risk", n, "k").collect()
        assert Counter(r.risk for r in taken) == {"a": min(n, 100), "b": min(n, 30)}
    assert sampling.exact_sample(table.where("false"), "risk", 5, "k").count() == 0
    # a sketch that misses the threshold is found out
    monkeypatch.setattr(sampling, "REACH", 0)
    monkeypatch.setattr(sampling, "SKETCH_K", 8)
    wide = spark.range(20_000).selectExpr("id AS k", "'a' AS risk")
    for n in (1, 7777, 19_990):
        assert sampling.exact_sample(wide, "risk", n, "k").count() == n


def test_states_of_further_sets_merge_into_the_whole(spark, tmp_path):
    words = dictionary(spark, [(0, "drop", 50), (1, "x", 5)])
    path, rnd = str(tmp_path), random.Random(1)
    every = None
    for n in (10, 200, 1000):
        made = [(f"drop {i}" if rnd.random() < 0.4 else f"y {i}", "low", f"drop {i}" if rnd.random() < 0.4 else f"x {i}") for i in range(n)]
        part = spark.createDataFrame([(*r, "low", n) for r in made], store.FIELDS)
        assessed = evaluate.score_log(part, words, key="query")
        states.add_sets(assessed, path)
        every = assessed if every is None else every.unionByName(assessed)
    states.add_sets(assessed, path)  # the last one again
    got = states.results(states.merged(states.read_states(spark, path))).first()
    want = evaluate.accuracy(every).first()
    zero = evaluate.zero_score_share(every).first()
    assert (got.total, got.correct, got.accuracy) == (want.total, want.correct, pytest.approx(want.accuracy))
    assert got.zero_scores == zero.zero_scores and got.zero_share == pytest.approx(zero.zero_share)
    scores = sorted(r.score for r in every.select("score").collect())
    assert got.avg_score == pytest.approx(sum(scores) / len(scores)) and (got.min_score, got.max_score) == (scores[0], scores[-1])
    assert abs(sum(s <= got.middle_score for s in scores) / len(scores) - 0.5) < 0.5 and got.middle_score in set(scores)
    cells = {(r.set_risk, r.set_size): r.total for r in states.merged(states.read_states(spark, path), store.SET).collect()}
    assert cells == {("low", 10): 10, ("low", 200): 200, ("low", 1000): 1000}
