from datetime import datetime, timedelta

from pyspark.sql import functions as F

from needlework.operators import dictionary as dicts
from needlework.operators import matching
from needlework.plans import inputs
from needlework.streaming import scoring

SCHEMA = "qid bigint, ts timestamp, normalized string, expected string"


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / name))


def _run(spark, folder, out):
    patterns = matching.small_patterns(dicts.standard_dictionary(spark))
    log = scoring.read_stream(spark, f"{folder}/*", spark.createDataFrame([], SCHEMA).schema)
    return scoring.stream_score(log, patterns), f"{out}/rows", f"{out}/checkpoint"


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    now = datetime(2024, 1, 1)
    _write(spark, src, "a", [(i, now, f"' or 1={i % 3} --", "low") for i in range(20)])
    scored, path, checkpoint = _run(spark, src, out)
    scoring.run_to_files(scored, path, checkpoint).awaitTermination()
    assert spark.read.parquet(path).count() == 20
    _write(spark, src, "b", [(i, now, "'; drop table x", "high") for i in range(20, 30)])
    scored, path, checkpoint = _run(spark, src, out)
    scoring.run_to_files(scored, path, checkpoint).awaitTermination()
    got = {r.qid: (r.score, r.computed) for r in spark.read.parquet(path).collect()}
    batch = spark.read.schema(SCHEMA).parquet(f"{src}/*")
    want = matching.score_distinct(batch, dicts.standard_dictionary(spark)).collect()
    assert {q: s for q, (s, _) in got.items()} == {r.qid: r.score for r in want}
    assert got[25] == (50, "high")


def test_windows_and_late_rows(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    day = datetime(2024, 1, 1, 12)
    for name, rows in {
        "a": [(0, day, "x", "low"), (1, day, "drop table", "high"), (2, day + timedelta(days=1), "x", "low")],
        "b": [(3, day, "x", "low"), (4, day + timedelta(days=1), "x", "low")],  # the first row is a day late
    }.items():
        _write(spark, src, name, rows)
        scored, _, checkpoint = _run(spark, src, out)
        counts = scoring.stream_risk_windows(scored)
        query = scoring.run_updates_to_files(counts, f"{out}/counts", checkpoint)
        query.awaitTermination()
    assert scoring.late_rows(query) == 1
    latest = scoring.latest_counts(spark, f"{out}/counts")
    got = {(r.window_start.day, r.computed): r.n for r in latest.collect()}
    assert got == {(1, "low"): 1, (1, "high"): 1, (2, "low"): 2}


def test_label_events_works_on_a_stream(spark, tmp_path):
    events = spark.range(10).select(F.col("id").alias("event_id"), F.current_timestamp().alias("ts"), F.lit("x").alias("event_type"))
    events.write.parquet(str(tmp_path / "e"))
    stream = inputs.label_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    rows = stream.select("qid", "normalized", "expected")
    scoring.run_to_files(rows, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 10


def test_many_batches_equal_one(spark, tmp_path):
    start = datetime(2024, 1, 1)
    for n in range(4):
        rows = [(i, start + timedelta(hours=i), "drop table" if i % 2 else "x", "low") for i in range(10 * n, 10 * n + 10)]
        _write(spark, tmp_path / "in", f"f{n}", rows)
    patterns = matching.small_patterns(dicts.standard_dictionary(spark))
    found = {}
    for files in (1, 1000):
        out = tmp_path / f"out{files}"
        schema = spark.createDataFrame([], SCHEMA).schema
        log = scoring.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=files, partitions=2)
        counts = scoring.stream_risk_windows(scoring.stream_score(log, patterns))
        query = scoring.run_updates_to_files(counts, f"{out}/counts", f"{out}/checkpoint")
        query.awaitTermination()
        assert scoring.late_rows(query) == 0
        latest = scoring.latest_counts(spark, f"{out}/counts")
        found[files] = {(r.window_start, r.computed): r.n for r in latest.collect()}
    assert found[1] == found[1000] and sum(found[1].values()) == 40
