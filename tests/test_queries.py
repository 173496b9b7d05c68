"""Registered queries: SQL comparison on the smallest tables, and their plans."""

import io
from collections import Counter
from contextlib import redirect_stdout
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from needlework.plans import inputs
from needlework.tables import spread

SF_DIR = "/root/testdata/sf0.001"
TABLES = "customer part events documents pages conversations".split()
QUERIES, SQL = contract.queries(), contract.oracle_sql()
#: The queries of the training-data operators, where present, have their own tests beside them.
OTHERS = {*contract.llm.QUERIES, "pipeline"} if contract.llm else set()

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) - OTHERS <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = Counter(tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall())


def _plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


WRITERS = {n for n in QUERIES if n.startswith(("write_", "stream_"))} | {"scan_run_reports"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_pairing_of_all_rows(spark, name):
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "EvalPython" not in plan


@pytest.mark.parametrize("name", ["score_distinct", "score_occurrences", "pattern_hits", "matched_patterns", "detect_any"])
def test_scan_is_narrow(spark, name, monkeypatch):
    """No shuffle once the input has as many splits as there are cores."""
    monkeypatch.setattr(inputs, "spread", lambda df: df)
    monkeypatch.setattr("needlework.plans.registry.spread", lambda df: df)
    plan = _plan(QUERIES[name](spark, SF_DIR))
    assert "Exchange hashpartitioning" not in plan and "RoundRobin" not in plan
    wanted = "page_id:bigint,html:string" if name == "detect_any" else "doc_id:bigint,text:string"
    assert f"ReadSchema: struct<{wanted}>" in plan


def test_filters_do_not_repeat_the_scan(spark):
    plan = _plan(QUERIES["algorithm_agreement"](spark, SF_DIR))
    assert plan.count("lambdafunction(Contains(") == 2  # the gate and the pattern, once


def test_groups_are_limited_before_the_shuffle(spark):
    assert _plan(QUERIES["preview_generated"](spark, SF_DIR)).count("WindowGroupLimit") == 2


def test_aggregates_are_partial(spark):
    plan = _plan(QUERIES["pattern_frequency"](spark, SF_DIR))
    assert "partial_sum" in plan and "partial_count" in plan


def test_spread_leaves_large_inputs_alone(spark):
    large = spark.range(0, 1000, 1, 16)
    assert spread(large) is large
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert sum(r.texts for r in rows) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
