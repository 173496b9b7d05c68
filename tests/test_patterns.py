from pyspark.sql import functions as F

from helpers import lines, single
from needlework import fixed
from needlework.operators.dictionary import plain_dictionary
from needlework.sources import patterns, sinks


def _found(spark, form, content):
    return single(spark, form(F.col("c")), c=content)


def test_quotes_pair_up_across_lines(spark):
    content = '"a",\n"" or",\n""="",\n"b,",\n"",\n'
    # Pairs: "a" | ,\n inverted by the opening quotes of the second and third line.
    import re

    want = [m[:-1] if m.endswith(",") else m for m in re.findall(r'"([^"]+)"', content)]
    assert _found(spark, patterns.quoted_patterns, content) == [w for w in want if w]
    assert len(_found(spark, patterns.quoted_patterns, fixed.pattern_file_text())) == 73


def test_line_form_is_the_fallback(spark):
    content = '# note\n\nunion select,\n  drop table \n"\nx"y,\n#,5\n'
    assert _found(spark, patterns.line_patterns, content) == ["union select", "drop table", '"', 'x"y']
    assert _found(spark, patterns.loaded_patterns, "a,\nb") == ["a", "b"]
    assert _found(spark, patterns.loaded_patterns, 'a,\n"b"') == ["b"]
    assert _found(spark, patterns.line_patterns, '"a",\n"b"\n""\n",') == ["a", "b", '"']


def test_strict_form(spark):
    assert _found(spark, patterns.strict_patterns, fixed.pattern_file_text()) == fixed.pattern_lines()
    assert _found(spark, patterns.strict_patterns, '  "a",  \n"b"\nc",\n",\n"",') == ["a", "", ""]


def test_weighted_form(spark):
    given = ["# note", "", ", delete,10", "#,5", " >=,10", "x", "y,", "a,b,7", "z,8\r"]
    rows = patterns.scan_weighted_patterns(lines(spark, given)).orderBy("nr").collect()
    assert [(r.pattern, r.weight) for r in rows] == [(", delete", 10), ("#", 5), (" >=", 10), ("a,b", 7), ("z", 8)]


def test_written_patterns_come_back(spark, tmp_path):
    path = str(tmp_path / "patterns")
    sinks.write_patterns(plain_dictionary(spark), path)
    back = spark.read.text(path).select(F.explode(patterns.strict_patterns(F.col("value"))).alias("p"))
    assert sorted(r.p for r in back.collect()) == sorted(fixed.pattern_lines())
