from pyspark.sql import functions as F

from needlework.operators import corpus, dictionary, evaluate, measurements
from needlework.sources import query_log, reports, sinks, timings
from needlework.tables import literal_table


def test_first_line_of_every_file_is_lost(spark, tmp_path):
    (tmp_path / "a.csv").write_text("query,risk\nx,low\n\n\"a,\"\"b\"\"\",high\n")
    (tmp_path / "b.csv").write_text("no header,low\ny,medium,40\nz,none\n")
    rows = query_log.read_query_log(spark, str(tmp_path)).collect()
    assert sorted((r.query, r.expected) for r in rows) == [("a,b", "high"), ("x", "low"), ("y", "medium")]


def test_named_files_make_one_matrix(spark, tmp_path):
    (tmp_path / "sql_dataset_Low_2.csv").write_text("query,risk\n' OR 1=1,low\nOR 1=1,low\n")
    (tmp_path / "sql_dataset_High_1.csv").write_text("query,risk\n'; DROP TABLE temp,high\n")
    log = query_log.read_named_logs(spark, str(tmp_path))
    runs = evaluate.score_log_all(log, dictionary.standard_dictionary(spark))
    cells = evaluate.accuracy_matrix(runs, ["algorithm", "set_risk", "set_size"]).where("algorithm = 'distinct'")
    got = {(r.set_risk, r.set_size): (r.total, r.correct) for r in cells.collect()}
    assert got == {
        ("low", "2"): (2, 1),
        ("low", "(all)"): (2, 1),
        ("high", "1"): (1, 1),
        ("high", "(all)"): (1, 1),
        ("(all)", "(all)"): (3, 2),
    }


def test_numbered_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("\nx,low\n\n" + "".join(f"q{i},low\n" for i in range(20)))
    log = query_log.read_numbered_log(spark, str(tmp_path))
    shown = evaluate.preview_queries(evaluate.score_log(log, dictionary.standard_dictionary(spark))).collect()
    assert [r.query for r in shown] == ["x", *[f"q{i}" for i in range(9)]]


def test_numbers_run_through_the_blocks_of_split_files(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 1), ("c", 0)):
        rows = "".join(f"q{i}\r{i},low\n" if i % 7 else "\n" for i in range(1, n + 1))
        (tmp_path / f"{name}.csv").write_bytes(("query,risk\n" + rows).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = query_log.read_numbered_log(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    found = sorted((r.file[-5:], r.qid, r.query) for r in rows)
    expected = [("a.csv", i, f"q{i}\r{i}") for i in range(1, 3001) if i % 7] + [("b.csv", 1, "q1\r1")]
    assert found == expected


def test_split_files_lose_one_line_only(spark, tmp_path):
    (tmp_path / "big.csv").write_text("query,risk\n" + "".join(f"q{i},low\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = query_log.read_log_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 3
        assert query_log.parse_log(lines).count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_dataset_round_trip(spark, tmp_path):
    path = str(tmp_path / "sets")
    rows = literal_table(
        spark,
        [
            {"d": "x", "query": '" = 1', "risk": "low"},
            {"d": "x", "query": "' UNION SELECT 1,2 --", "risk": "medium"},
            {"d": "y", "query": " lead", "risk": "high"},
        ],
        "d:string,query:string,risk:string",
    )
    sinks.write_dataset(rows, path, ["d"])
    got = sorted((r.query, r.expected) for r in query_log.read_query_log(spark, path).collect())
    # The reader drops quotes and outer blanks; that is its format.
    assert got == [("' UNION SELECT 1,2 --", "medium"), ("= 1", "low"), ("lead", "high")]
    raw = "".join(p.read_text() for p in (tmp_path / "sets").rglob("*.csv"))
    assert '""" = 1",low\n' in raw and "\n lead,high\n" in raw and "query,risk\n" in raw


def test_append_writes_no_header(spark, tmp_path):
    path = str(tmp_path / "sets")
    rows = literal_table(spark, [{"d": "x", "query": "a", "risk": "low"}], "d:string,query:string,risk:string")
    for _ in range(2):
        sinks.write_dataset(rows, path, ["d"], append=True)
    raw = [p.read_text() for p in (tmp_path / "sets").rglob("*.csv")]
    assert raw == ["a,low\n", "a,low\n"]


def _log(spark):
    return corpus.label_rows(spark.range(540).withColumnRenamed("id", "qid"), "qid").select(
        "qid",
        F.when(F.col("qid") % 2 == 0, "even").otherwise("odd").alias("dataset"),
        F.col("template").alias("query"),
        F.lower("template").alias("normalized"),
        F.col("risk").alias("expected"),
    )


def _assessed(spark, log):
    return evaluate.score_log_all(log, dictionary.standard_dictionary(spark))


def test_reports_come_back(spark, tmp_path):
    path, dims = str(tmp_path / "reports"), ["algorithm", "dataset"]
    assessed = _assessed(spark, _log(spark)).cache()
    shown = _assessed(spark, reports.first_rows(_log(spark), ["dataset"]))
    reports.write_run_reports(assessed, shown, path, dims)
    back = reports.read_reports(spark, path)
    want = {
        (r.algorithm, r.dataset): r for r in evaluate.accuracy_matrix(assessed, dims).where("dataset <> '(all)'").collect()
    }
    got = reports.parse_reports(back).collect()
    assert len(got) == len(want) == 6
    for r in got:
        w = want[r.algorithm, r.dataset]
        assert (r.loaded, r.total, r.correct, r.zero_scores) == (w.total, w.total, w.correct, w.zero_scores)
        assert abs(r.accuracy - w.accuracy) < 1e-3
    shown = reports.parse_report_queries(back)
    assert shown.count() == 60
    first = assessed.select("algorithm", "dataset", "query", "normalized", "score", "computed", "expected", "flag")
    columns = first.columns
    assert shown.select(columns).exceptAll(first).count() == 0


OLD_REPORT = """Extracted 304 patterns using regex
Loaded 2 queries.
Query 0: computed=high, expected=critical [Mismatch]
Query 1: computed=low, expected= password FROM users [Mismatch]

Total: 2, Correct: 0, Accuracy: 0%
Queries with zero score: 1 (50%)
Some kernel execution time: 1.13971 ms
"""
SHORT_REPORT = "Query 0: computed=low, expected=low, score=12\n\nTotal: 1, Correct: 1, Accuracy: 100%\n"


def test_older_reports(spark, tmp_path):
    (tmp_path / "result_Fast_sql_dataset_High_100.txt").write_text(OLD_REPORT)
    (tmp_path / "other.txt").write_text(SHORT_REPORT)
    files = reports.read_reports(spark, str(tmp_path))
    rows = {r.file_algorithm: r for r in reports.parse_reports(files).collect()}
    old = rows["Fast"]
    assert (old.file_risk, old.file_size, old.patterns, old.total, old.kernel_ms) == ("high", 100, 304, 2, 1.13971)
    assert (rows[None].total, rows[None].zero_scores, rows[None].accuracy) == (1, None, 100.0)
    shown = {(r.nr, r.expected): (r.computed, r.score, r.flag) for r in reports.parse_report_queries(files).collect()}
    assert shown == {
        (0, "critical"): ("high", None, "[Mismatch]"),
        (1, " password FROM users"): ("low", None, "[Mismatch]"),
        (0, "low"): ("low", 12, "[OK]"),
    }


def test_six_digits(spark):
    values = [100.0, 68.0, 85.71428571, 8.571428571, 0.0, 33.33333333, 0.5, 0.000123456789, 1.23456789e-05, 1234567.8]
    want = ["100", "68", "85.7143", "8.57143", "0", "33.3333", "0.5", "0.000123457", "1.23457e-05", "1.23457e+06"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = rows.select("i", reports.six_digits(F.col("v")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == want


def test_timing_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Algorithm,A,B,C,D\nX,10,72,1.5,Low\n\n\nY,20,72,2.5,High\n")
    rows = timings.read_timings(spark, str(tmp_path)).orderBy("nr").collect()
    assert [(r.algorithm, r.dataset_size, r.time_us, r.risk) for r in rows] == [("X", 10, 1.5, "Low"), ("Y", 20, 2.5, "High")]
    assert timings.published_timings(spark).count() == 40


def _brute_nearest(rows, size):
    return min(rows, key=lambda r: (abs(r.dataset_size - size), r.nr))


def test_nearest_against_all_pairs(spark):
    published = timings.published_timings(spark)
    rows = published.collect()
    for sizes in [(10.0, 10000.0, 100), (0.0, 100.0, 11), (2000.0, 9000.0, 8), (5.0, 15.0, 3)]:
        got = measurements.nearest_measurement(published, sizes).collect()
        assert len(got) == 2 * sizes[2]
        for r in got:
            mine = [t for t in rows if t.algorithm == r.algorithm]
            want = _brute_nearest(mine, r.dataset_size)
            assert (r.nr, r.base_us) == (want.nr, want.time_us), (sizes, r)


def test_ties_go_to_the_first_row(spark):
    data = [{"nr": n, "algorithm": "a", "dataset_size": s, "time_us": float(n)} for n, s in enumerate([30, 10, 30, 10])]
    timed = literal_table(spark, data, "nr:int,algorithm:string,dataset_size:int,time_us:double")
    got = {r.dataset_size: r.nr for r in measurements.nearest_measurement(timed, (0.0, 40.0, 5)).collect()}
    assert got == {0.0: 1, 10.0: 1, 20.0: 0, 30.0: 0, 40.0: 0}


def test_surface_and_throughput(spark):
    import math

    published = timings.published_timings(spark)
    surface = measurements.time_surface(published)
    assert surface.count() == 2 * 50 * 100
    point = surface.where("algorithm = 'PFAC' and p = 0 and s = 99").first()
    assert point.dataset_size == 10000.0 and point.pattern_count == 50.0
    assert math.isclose(point.time_us, 68.652 + (50 - 72) * 0.5 + math.log10(10000) * 2, rel_tol=1e-12)
    fast = measurements.throughput(published).where("nr = 1").first()
    assert math.isclose(fast.queries_per_second, 10 / 69.403e-6)
    pivot = measurements.by_algorithm(published, ["PFAC", "Aho-Corasick"])
    low = pivot.where("risk = 'Low' and dataset_size = 10").first()
    assert low["PFAC"] == 69.403 and math.isclose(low["ratio"], 69.403 / 105.094)
    assert measurements.parameter_grid(spark.range(3)).count() == 15_000


def test_only_the_first_line_is_dropped_even_if_it_is_blank(spark, tmp_path):
    texts = {"a": "\nq1,low\nq2,low\n", "b": "query,risk\n\n \t\nq3,high\n", "c": "q0,low\nq4,low", "d": "", "e": "\n\n\nq5,low"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    got = sorted(r.query for r in query_log.read_query_log(spark, str(tmp_path)).collect())
    assert got == ["q1", "q2", "q3", "q4", "q5"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        (tmp_path / "large").mkdir()
        (tmp_path / "large" / "x.csv").write_text("\n" + "".join(f"q{i},low\n" for i in range(30_000)))
        lines = query_log.read_log_lines(spark, str(tmp_path / "large"))
        assert lines.rdd.getNumPartitions() > 1 and lines.count() == 30_000
        numbered = query_log.read_numbered_log(spark, str(tmp_path / "large")).select("query")
        assert query_log.read_query_log(spark, str(tmp_path / "large")).select("query").exceptAll(numbered).isEmpty()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
