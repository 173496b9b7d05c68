"""Final windows, late rows, rows sent twice and changing dictionaries, over several micro-batches and restarts."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from needlework.operators import matching
from needlework.streaming import scoring, versions, windows

SCHEMA = "qid bigint, ts timestamp, normalized string, expected string, computed string"
START = datetime(2024, 1, 1)


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder):
    return scoring.read_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def shuffled_rows(n=400):
    rnd = random.Random(3)
    rows = [(i, START + timedelta(hours=rnd.random() * 24 * 9), "x", "low", rnd.choice(["low", "high"])) for i in range(n)]
    return rows + [(n, None, "x", "low", "low")]


def run_windows(spark, folder, out):
    return windows.run_final_windows(stream(spark, folder), f"{out}/tables", f"{out}/checkpoint", delay="1 day")


def test_windows_and_late_rows_hold_every_row_once(spark, tmp_path):
    rows = shuffled_rows()
    for k in range(5):
        write(spark, tmp_path / "in", k, rows[k::5])
    run_windows(spark, tmp_path / "in", tmp_path).awaitTermination()
    path = f"{tmp_path}/tables"
    late = windows.late_rows(spark, path).collect()
    final = {(r.window_start, r.computed): r.n for r in windows.final_windows(spark, path).collect()}
    batch = Counter((datetime(r[1].year, r[1].month, r[1].day), r[4]) for r in rows if r[1])
    got = {(r.window_start, r.computed): r.n for r in windows.all_counts(spark, path).collect()}
    assert got == batch and final and len(late) > 20
    assert [r.qid for r in late if r.ts is None] == [400]
    # a window is final once, and what came for it later is late
    assert len(final) == windows.final_windows(spark, path).count()
    missing = Counter((datetime(r.ts.year, r.ts.month, r.ts.day), r.computed) for r in late if r.ts)
    assert all(n + missing[k] == batch[k] for k, n in final.items())
    assert sum(final.values()) + windows.open_windows(spark, path).agg(F.sum("n")).first()[0] + len(late) == len(rows)


def test_windows_go_on_after_a_restart(spark, tmp_path):
    rows = shuffled_rows()
    for k in range(4):
        write(spark, tmp_path / "in", k, rows[k::4])
        run_windows(spark, tmp_path / "in", tmp_path).awaitTermination()
    got = {(r.window_start, r.computed): r.n for r in windows.all_counts(spark, f"{tmp_path}/tables").collect()}
    assert got == Counter((datetime(r[1].year, r[1].month, r[1].day), r[4]) for r in rows if r[1])


def test_a_batch_that_is_written_again_changes_nothing(spark, tmp_path):
    rows = shuffled_rows(60)
    path = str(tmp_path / "tables")
    make = lambda part: spark.createDataFrame(part, SCHEMA)
    how = (path, ["window_start", "window_end", "computed"], "ts", "1 day", "1 day")
    for nr in (0, 1, 1, 2, 2):
        windows._write_batch(spark, make(rows[nr::3]), nr, *how)
    got = {(r.window_start, r.computed): r.n for r in windows.all_counts(spark, path).collect()}
    assert got == Counter((datetime(r[1].year, r[1].month, r[1].day), r[4]) for r in rows if r[1])


def test_files_sent_again_change_no_row(spark, tmp_path):
    rows = [(i, START + timedelta(minutes=i), "x", "low", "low") for i in range(300)]
    out, sizes = f"{tmp_path}/rows", []
    for name, part in {"a": rows[:100], "b": rows[50:150], "c": rows[:100], "d": rows[140:], "e": rows[250:]}.items():
        write(spark, tmp_path / "in", name, part)
        once = windows.distinct_rows(stream(spark, tmp_path / "in"), ["qid"], delay="2 hours")
        query = scoring.run_to_files(once, out, f"{tmp_path}/checkpoint")
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    found = [r.qid for r in spark.read.parquet(out).collect()]
    assert len(found) == len(set(found)) and set(found) >= set(range(150))
    assert max(sizes) < 300  # keys leave the state behind the watermark


def version(spark, path, start, entries):
    rows = [(start, i, p, w) for i, (p, w) in enumerate(entries)]
    spark.createDataFrame(rows, "valid_from timestamp, pid bigint, pattern string, weight bigint").write.mode("append").parquet(path)


@pytest.mark.parametrize("large", [False, True])
def test_rows_are_scored_by_the_version_of_their_time(spark, tmp_path, monkeypatch, large):
    if large:
        monkeypatch.setattr(versions, "small_patterns", lambda *a: None)
    words = f"{tmp_path}/words"
    version(spark, words, START + timedelta(days=1), [("drop", 10), ("--", 5)])
    hours = lambda h: START + timedelta(hours=h)
    first = [(0, hours(1), "drop --", "low", None), (1, hours(30), "drop --", "low", None), (2, hours(47), "drop", "low", None), (3, None, "drop", "low", None)]
    write(spark, tmp_path / "in", "a", [(*r[:4], "") for r in first])

    def run(out):
        log = stream(spark, tmp_path / "in").drop("computed")
        versions.run_versioned_score(log, words, f"{tmp_path}/{out}", f"{tmp_path}/{out}-checkpoint").awaitTermination()
        return {r.qid: (r.score, r.computed) for r in versions.versioned_scores(spark, f"{tmp_path}/{out}").collect()}

    assert run("rows") == {0: (0, "low"), 1: (15, "low"), 2: (10, "low"), 3: (0, "low")}
    # announced before its time, while the stream stands still
    version(spark, words, START + timedelta(days=2), [("drop", 50), ("x", 40), ("", 7)])
    second = [(4, hours(47), "drop x", "low", ""), (5, hours(48), "drop x", "low", ""), (6, hours(99), "--", "low", "")]
    write(spark, tmp_path / "in", "b", second)
    both = run("rows")
    assert both == {0: (0, "low"), 1: (15, "low"), 2: (10, "low"), 3: (0, "low"), 4: (10, "low"), 5: (90, "critical"), 6: (0, "low")}
    assert run("again") == both  # a run from the start repeats every score


def test_versions_score_like_single_dictionaries(spark):
    rnd = random.Random(2)
    log = [(i, START + timedelta(hours=i), " ".join(rnd.choices(["drop", "union", "x", "--"], k=4)), "low") for i in range(60)]
    table = spark.createDataFrame(log, "qid bigint, ts timestamp, normalized string, expected string")
    starts = [START + timedelta(hours=h) for h in (0, 20, 40)]
    every = [(s, k, p, w + n) for n, s in enumerate(starts) for k, (p, w) in enumerate([("drop", 3), ("union", 7), ("op", 1)])]
    words = spark.createDataFrame(every, "valid_from timestamp, pid bigint, pattern string, weight bigint")
    got = {r.qid: r.score for r in versions.score_by_version(table, words).collect()}
    for n, start in enumerate(starts):
        one = words.where(F.col("valid_from") == F.lit(start)).drop("valid_from")
        part = table.where((F.col("qid") >= 20 * n) & (F.col("qid") < 20 * n + 20))
        assert {r.qid: r.score for r in matching.score_distinct(part, one).collect()} == {q: s for q, s in got.items() if 20 * n <= q < 20 * n + 20}
