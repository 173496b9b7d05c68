"""Published results: normalized query -> score, class, label."""

import pytest
from pyspark.sql import functions as F

from needlework import fixed
from needlework.operators import dictionary as dicts
from needlework.operators import evaluate
from needlework.tables import literal_table

# Fixed values: (normalized query, score, computed class, label).
GOLDEN = [
    ("= 1", 1, "low", "low"),
    ("' <> 1", 5, "low", "low"),
    ("' >= 1", 6, "low", "low"),
    ("' <= 1", 6, "low", "low"),
    ("' = 1", 7, "low", "low"),
    ("or 1=1", 11, "low", "low"),
    ("' || 1=1 --", 17, "low", "low"),
    ("' or 1=1", 22, "medium", "low"),
    ("admin' --", 23, "medium", "low"),
    ("' limit 1 /**/", 23, "medium", "medium"),
    ("' group by 1", 30, "medium", "medium"),
    ("' or 'x'='x", 32, "medium", "low"),
    ("1' or '1'='1", 32, "medium", "low"),
    ("' or convert(int, '1') --", 34, "medium", "medium"),
    ("' or cast('1' as int) --", 34, "medium", "medium"),
    ("' or md5('test') --", 34, "medium", "medium"),
    ("1' or admin' --", 34, "medium", "medium"),
    ("' group by 1 --", 35, "medium", "medium"),
    ("' having 1=1", 41, "medium", "medium"),
    ("' having 1=1 #", 41, "medium", "medium"),
    ("'; drop table temp", 50, "high", "high"),
    ("'; drop table temp --", 55, "high", "high"),
    ("'; drop procedure admin_login --", 55, "high", "high"),
    ("'; insert into logs values('hack') --", 55, "high", "high"),
    ("'; select sleep(5) --", 55, "high", "high"),
    ("'; waitfor delay '0:0:5' --", 55, "high", "high"),
    ("'; alter table users add col --", 55, "high", "high"),
    ("'; exec sp_configure 'options', 1 --", 55, "high", "high"),
    ("'; drop database temp --", 55, "high", "high"),
    ("'; select @@version --", 55, "high", "medium"),
    ("'; update users set pass='hack' --", 56, "high", "high"),
    ("' or @@version", 61, "high", "high"),
    ("'; select benchmark(10000,md5('x')) --", 73, "high", "high"),
    ("' or 1=1; drop table users --", 77, "critical", "high"),
    ("'; delete from users --", 85, "critical", "high"),
    ("' into outfile '/tmp/test'", 90, "critical", "critical"),
    ("'; create user 'hack'@'%' identified by 'pass' --", 95, "critical", "critical"),
    ("'; call mysql.lambda_async('127.0.0.1', 1234) --", 95, "critical", "critical"),
    ("'; create trigger evil before insert on users --", 95, "critical", "critical"),
    ("'; grant all privileges on *.* to 'hack' --", 95, "critical", "critical"),
    ("' union select @@version --", 103, "critical", "high"),
    ("'; select pg_sleep(5) --", 105, "critical", "high"),
    ("' union all select username, password from users --", 131, "critical", "critical"),
    ("'; union select username, password from users --", 131, "critical", "critical"),
    ("'; exec master..xp_cmdshell 'ping' --", 145, "critical", "high"),
    ("'; exec(@cmd) -- or xp_cmdshell", 146, "critical", "critical"),
    ("'; exec(@cmd) -- and load_file('test')", 146, "critical", "critical"),
    ("'; select * from mysql.user -- and load_file('test')", 146, "critical", "critical"),
    ("'; select * from mysql.user -- or xp_cmdshell", 146, "critical", "critical"),
    ("'; select table_name from information_schema.tables -- and load_file('test')", 156, "critical", "critical"),
    ("'; select table_name from information_schema.tables -- or xp_cmdshell", 156, "critical", "critical"),
    ("'; select count(*) from information_schema.tables -- and load_file('test')", 156, "critical", "critical"),
    ("'; exec xp_cmdshell('dir')", 180, "critical", "critical"),
    ("' into outfile '/var/www/shell.php' --", 185, "critical", "critical"),
    ("'; select load_file('/etc/passwd') --", 185, "critical", "critical"),
    ("'; load data infile '/etc/passwd' into table users --", 185, "critical", "critical"),
]


def _log(spark):
    rows = [
        {"qid": i, "query": q, "normalized": q, "expected": label} for i, (q, _, _, label) in enumerate(GOLDEN)
    ]
    return literal_table(spark, rows, "qid:bigint,query:string,normalized:string,expected:string")


@pytest.mark.parametrize("mode", evaluate.MODES)
def test_scores_and_classes(spark, mode):
    rows = evaluate.score_log(_log(spark), dicts.standard_dictionary(spark), mode).orderBy("qid").collect()
    assert [(r.normalized, r.score, r.computed, r.expected) for r in rows] == GOLDEN
    assert [r.flag for r in rows] == ["[OK]" if c == e else "[Mismatch]" for _, _, c, e in GOLDEN]


def test_all_modes_in_one_scan(spark):
    runs = evaluate.score_log_all(_log(spark), dicts.standard_dictionary(spark))
    got = {(r.algorithm, r.normalized): r.score for r in runs.collect()}
    assert got == {(m, q): s for m in evaluate.MODES for q, s, _, _ in GOLDEN}


def test_standard_dictionary(spark):
    entries = dicts.standard_dictionary(spark)
    assert entries.count() == 73
    weights = {r.weight: r.patterns for r in dicts.weight_distribution(entries).collect()}
    assert weights == {90: 12, 50: 16, 30: 10, 18: 9, 10: 7, 5: 11, 1: 8}
    phase_shift = {49: " or", 51: " and", 53: "=", 54: ",\n", 55: ",\n", 56: ",\n", 57: " ||", 65: " ="}
    found = {r.pid: r.pattern for r in entries.where(F.col("weight") == 1).collect()}
    assert found == phase_shift


def test_trie_size(spark):
    stats = dicts.trie_stats(dicts.standard_dictionary(spark)).first()
    assert (stats.patterns, stats.nodes, stats.transitions) == (73, 489, 488)
    assert stats.transitions_per_node == pytest.approx(0.997955, abs=1e-6)
    assert dicts.trie_stats(dicts.plain_dictionary(spark)).first().nodes == 501


def test_older_default_weight(spark):
    older = dicts.standard_dictionary(spark, lambda p: dicts.tiered_weight(p, fixed.OLD_DEFAULT_WEIGHT))
    scores = {r.normalized: r.score for r in evaluate.score_log(_log(spark), older).collect()}
    assert scores["= 1"] == 3
    assert scores["'; select table_name from information_schema.tables -- and load_file('test')"] == 158
