from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helpers import lines, single
from needlework import fixed
from needlework.functions import risk, text
from needlework.sources import query_log


def _toggle(line):
    fields, current, quoted = [], "", False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            fields.append(current)
            current = ""
        else:
            current += c
    return [*fields, current]


def test_lower_case_is_ascii_only(spark):
    # Kelvin sign and dotted capital I change under a Unicode lower case.
    for given_, want in [("UNION Select", "union select"), ("KX", "Kx"), ("İA", "İa"), ("ÀB", "Àb")]:
        assert single(spark, text.normalize_query(F.col("t")), t=given_) == want


def test_trim_and_strip(spark):
    assert single(spark, text.trim_field(F.col("t")), t=" \t\r\n a b \n\t") == "a b"
    assert single(spark, text.trim_field(F.col("t")), t=" \t ") == ""
    for given_, want in [('"a"', "a"), ('""', ""), ('"', '"'), ('"a', '"a'), ("a", "a"), ('""a""', '"a"')]:
        assert single(spark, text.strip_outer_quotes(F.col("t")), t=given_) == want


LINES = [
    '""" = 1",low',
    "\"' UNION SELECT 1,2 --\",medium",
    "a,b,c",
    "plain",
    'open "quote, no end,low',
    ",,",
    "\u0001,x\u0002b,\u0002a",
    'x"\u0001"y,low',
    '"a ""b,c"" d",high,10',
]


def test_toggle_fields(spark):
    rows = lines(spark, LINES).select("nr", text.toggle_fields(F.col("value")).alias("f")).orderBy("nr").collect()
    assert [r.f for r in rows] == [_toggle(line) for line in LINES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='",ab\u0001\u0002 ', max_size=30), min_size=40, max_size=60))
def test_toggle_fields_any_text(spark, values):
    rows = lines(spark, values).select("nr", text.toggle_fields(F.col("value")).alias("f")).orderBy("nr").collect()
    assert [r.f for r in rows] == [_toggle(v) for v in values]


def test_toggle_fields_long_line(spark):
    long = '"' + 'a""' * 100_000 + '",low'
    assert single(spark, text.toggle_fields(F.col("t")), t=long) == _toggle(long)


def test_parse_log_keeps_only_labelled_rows(spark):
    given_ = ['""" = 1",low', "x,Low", "", "only one", "y, high ,10", "\"A,B\",critical", "z,unknown"]
    rows = query_log.parse_log(lines(spark, given_)).orderBy("nr").collect()
    assert [(r.query, r.normalized, r.expected) for r in rows] == [
        ("= 1", "= 1", "low"),
        ("y", "y", "high"),
        ("A,B", "a,b", "critical"),
    ]


def test_naive_log_splits_everywhere(spark):
    given_ = ["\"A,B\",critical,5", "", "x", "y,low"]
    rows = query_log.parse_log_naive(lines(spark, given_)).orderBy("nr").collect()
    assert [(r.query, r.expected, r.score) for r in rows] == [('"A', 'B"', "critical"), ("x", "", ""), ("y", "low", "")]


def test_class_bounds(spark):
    for bounds in (fixed.THRESHOLDS_V1, fixed.THRESHOLDS_V2):
        want = {0: "low"}
        for label, upper, bound in zip(fixed.LABELS, fixed.LABELS[1:], bounds, strict=False):
            want |= {bound: label, bound + 1: upper}
        for score, label in want.items():
            assert single(spark, risk.classify_risk(F.col("s"), bounds), s=score) == label


def test_labels(spark):
    assert single(spark, risk.nominal_score(F.col("l")), l="high") == 70
    assert single(spark, risk.nominal_score(F.col("l")), l="High") is None
    assert [single(spark, risk.risk_order(F.col("l")), l=x) for x in ["low", "critical", "none"]] == [0, 3, None]
    assert single(spark, risk.match_flag(F.col("a"), F.col("b")), a="low", b="low") == "[OK]"


def test_evasion_forms(spark):
    got = [single(spark, text.obfuscate_query(F.col("q"), F.lit(v)), q="' OR 1") for v in range(4)]
    assert got == ["' OR 1", "'/**/OR/**/1", "' OR 1 /* test */", "'/**/OR/**/1 /* test */"]
