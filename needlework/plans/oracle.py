"""The registered queries as SQL for an independent engine.

Each text states the result from scratch on the given tables: quote handling by regular
expression, occurrence counts by stepping through the text, nearest timings by comparing
all pairs.
"""

from __future__ import annotations

from needlework import fixed
from needlework.plans.inputs import CYCLE, HEADER, PAYLOADS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _s(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    def cell(x):
        return _s(x) if isinstance(x, str) else str(x)

    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows) + ")"


def _fold(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


def _risk(score: str, bounds=fixed.THRESHOLDS_V1) -> str:
    a, b, c = bounds
    return (
        f"CASE WHEN {score} <= {a} THEN 'low' WHEN {score} <= {b} THEN 'medium' "
        f"WHEN {score} <= {c} THEN 'high' ELSE 'critical' END"
    )


_TEMPLATES = [
    (tid, risk, i, t)
    for tid, (risk, i, t) in enumerate((r, i, t) for r in fixed.LABELS for i, t in enumerate(fixed.TEMPLATES[r]))
]
_N = len(_TEMPLATES)
_RULES = [(tier, n, w) for tier, (w, needles) in enumerate(fixed.WEIGHT_TIERS) for n in needles]

TEMPLATES = f"templates(tid, risk, idx, template) AS (SELECT * FROM {_values(_TEMPLATES)})"
RULES = f"rules(tier, needle, weight) AS (SELECT * FROM {_values(_RULES)})"
SIMPLE_RULES = "rules(tier, needle, weight) AS (SELECT * FROM " + _values(
    [(i, n, w) for i, (w, needles) in enumerate(fixed.SIMPLE_WEIGHTS) for n in needles]
) + ")"
PLAIN_DICT = "dict(pid, pattern, weight) AS (SELECT * FROM " + _values(
    [(i, n, w) for i, (_, n, w) in enumerate(_RULES)]
) + ")"


def _dict(rules: str, default: int) -> str:
    return f"""pattern_file(l) AS (SELECT regexp_extract_all({_s(fixed.pattern_file_text())}, '"([^"]+)"', 1)),
found AS (SELECT i - 1 AS pid, {_fold("regexp_replace(l[i], ',$', '')")} AS pattern
          FROM pattern_file, unnest(range(1, len(l) + 1)) AS t(i)),
{rules},
dict AS (SELECT pid, any_value(pattern) AS pattern, coalesce(arg_min(weight, tier), {default}) AS weight
         FROM found LEFT JOIN rules ON contains(pattern, needle) GROUP BY pid)"""


DICT = _dict(RULES, fixed.DEFAULT_WEIGHT)
SIMPLE_DICT = _dict(SIMPLE_RULES, fixed.SIMPLE_DEFAULT_WEIGHT)
FIRST_DICT = """first_dict AS (SELECT pattern, min(pid) AS pid, arg_min(weight, pid) AS weight FROM dict GROUP BY pattern)"""

_PAYLOADS = f"payloads(slot, payload) AS (SELECT * FROM {_values(enumerate(PAYLOADS))})"
INJECTED = f"""{_PAYLOADS},
injected AS (SELECT doc_id, CASE WHEN payload IS NULL THEN text ELSE text || ' ' || payload END AS text
             FROM documents LEFT JOIN payloads ON doc_id % {CYCLE} = slot)"""
TEXTS = f"""{INJECTED},
texts AS (SELECT doc_id AS id, {_fold("text")} AS norm FROM injected)"""
LOG = f"""{TEMPLATES},
log AS (SELECT event_id AS qid, ts, event_type AS dataset, template AS query, {_fold("template")} AS norm,
               risk AS expected FROM events JOIN templates ON tid = event_id % {_N})"""
LOG_TEXTS = f"{LOG}, texts AS (SELECT qid AS id, norm FROM log)"
HITS = "hits AS (SELECT id, pid, pattern, weight, norm FROM texts JOIN {d} ON contains(norm, pattern))"
OCC = """occ(id, pid, pattern, weight, pos, rest) AS (
  SELECT id, pid, pattern, weight, instr(norm, pattern), substring(norm, instr(norm, pattern) + 1) FROM hits
  UNION ALL
  SELECT id, pid, pattern, weight, pos + instr(rest, pattern), substring(rest, instr(rest, pattern) + 1)
  FROM occ WHERE contains(rest, pattern)),
counts AS (SELECT id, pid, any_value(weight) AS weight, count(*) AS n FROM occ GROUP BY id, pid)"""
DISTINCT_SCORES = """scores AS (SELECT t.id, coalesce(sum(weight), 0)::BIGINT AS score
  FROM texts t LEFT JOIN hits h ON t.id = h.id GROUP BY t.id)"""
OCC_SCORES = """occ_scores AS (SELECT t.id, coalesce(sum(weight * n), 0)::BIGINT AS score
  FROM texts t LEFT JOIN counts c ON t.id = c.id GROUP BY t.id)"""


CHAINS = """firsts AS (SELECT pattern, min(pid) AS pid FROM dict GROUP BY pattern),
implied AS (SELECT a.pid, b.pid AS implied_pid FROM firsts a JOIN firsts b ON contains(a.pattern, b.pattern) AND a.pid <> b.pid),
chains(pid, implied_pid, steps) AS (SELECT pid, implied_pid, 1 FROM implied
  UNION SELECT c.pid, i.implied_pid, steps + 1 FROM chains c JOIN implied i ON c.implied_pid = i.pid)"""


def _with(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


_HITS = HITS.format(d="dict")
_FIRST_HITS = HITS.format(d="first_dict")
_DOC_SCORES = (TEXTS, DICT, _HITS, DISTINCT_SCORES)
_LOG_SCORES = (LOG_TEXTS, DICT, _HITS, DISTINCT_SCORES)
ASSESSED = f"""assessed AS (SELECT log.*, score, {_risk("score")} AS computed FROM log JOIN scores ON qid = id)"""

LOOSE = """loose AS (SELECT *, CASE dataset WHEN 'error' THEN upper(expected)
  WHEN 'signup' THEN chr(9) || expected || ' ' ELSE expected END AS label FROM log)"""
LINES = f"""{LOG}, {LOOSE},
fields AS (SELECT *, CASE WHEN contains(query, '"') OR contains(query, ',')
  THEN '"' || replace(query, '"', '""') || '"' ELSE query END AS field FROM loose),
lines AS (SELECT qid, CASE WHEN qid % 97 = 0 THEN '' WHEN qid % 89 = 0 THEN field
  WHEN qid % 2 = 0 THEN field || ',' || label ELSE field || ',' || label || ',10' END AS line FROM fields)"""
BLANKS = "' ' || chr(9) || chr(13) || chr(10)"

RUNS = f"""{LOG_TEXTS}, {DICT}, {_HITS}, {DISTINCT_SCORES},
first_dict AS (SELECT min(pid) AS pid, CASE WHEN contains(pattern, 'drop table') OR contains(pattern, '; drop') THEN 100
  WHEN contains(pattern, '; delete') OR contains(pattern, '; insert') THEN 15 ELSE 10 END AS short_weight
  FROM dict GROUP BY pattern),
{OCC}, {OCC_SCORES},
first_scores AS (SELECT t.id, coalesce(sum(short_weight * n), 0)::BIGINT AS score FROM texts t
  LEFT JOIN (SELECT id, n, short_weight FROM counts JOIN first_dict USING (pid)) c ON t.id = c.id GROUP BY t.id),
all_scores AS (SELECT 'distinct' AS algorithm, * FROM scores UNION ALL SELECT 'occurrences', * FROM occ_scores
  UNION ALL SELECT 'first_id', * FROM first_scores),
runs AS (SELECT algorithm, dataset, expected, score, CASE WHEN algorithm = 'first_id'
    THEN {_risk("score", fixed.THRESHOLDS_V2)} ELSE {_risk("score")} END AS computed
  FROM log JOIN all_scores ON qid = id)"""
_CELLS = """count(*) AS total, count(*) FILTER (computed = expected) AS correct,
  100.0::DOUBLE * count(*) FILTER (computed = expected) / count(*) AS accuracy,
  count(*) FILTER (score = 0) AS zero_scores,
  100.0::DOUBLE * count(*) FILTER (score = 0) / count(*) AS zero_share"""

_QUOTED_WORDS = """'"' || replace(text, ' ', '",' || chr(10) || '"') || '",' || chr(10)"""
QUOTED_FILES = f"""files AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN '"" or",' || chr(10) ELSE '' END
  || {_QUOTED_WORDS} AS value FROM conversations)"""
MIXED_FILES = """files AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1
  THEN '# ' || role || chr(10) || chr(10) || replace(text, ' ', ' ,' || chr(10) || ' ') || '"' || chr(10)
  ELSE '"' || replace(text, ' ', '",' || chr(10) || '"') || '"' END AS value FROM conversations)"""
_NUMBERED = """SELECT conv_id, turn, (i - 1)::INTEGER AS pid, l[i] AS pattern
FROM listed, unnest(range(1, len(l) + 1)) AS t(i)"""

PARTS = f"""parts AS (SELECT p_partkey, unnest([0, 1, 2]) AS nr,
    unnest([p_name, p_type, p_name || ' ' || p_brand]) AS text FROM part),
dict AS (SELECT p_partkey * 3 + nr AS pid, {_fold("text")} AS pattern FROM parts)"""
LOG_DICT = f"""{LOG}, needles(l) AS (SELECT [{", ".join(_s(n) for n in fixed.pattern_lines())}]),
patterns AS (SELECT qid AS pid, CASE WHEN qid % 4 = 0 THEN l[qid % len(l) + 1] ELSE norm END AS pattern
  FROM log, needles)"""
TRIE = """prefixes AS (SELECT DISTINCT substring(pattern, 1, n) AS prefix
  FROM (SELECT DISTINCT pattern FROM dict), unnest(range(1, length(pattern) + 1)) AS t(n)),
trie AS (SELECT (SELECT count(*) FROM dict WHERE pattern <> '') AS patterns, count(*) + 1 AS nodes,
  count(*) AS transitions FROM prefixes)"""

SIZES = {r: len(t) for r, t in fixed.TEMPLATES.items()}
_LEVELS = f"""levels(risk, n, low, high, adds, reps) AS (SELECT * FROM (VALUES {", ".join(
    f"({_s(r)}, {SIZES[r]}, {fixed.TARGET_RANGES[r][0]}, {fixed.TARGET_RANGES[r][1]}, "
    f"[{', '.join(map(_s, fixed.ADDITIONS[r]))}], [{', '.join(map(_s, fixed.REPLACEMENTS[r]))}])"
    for r in fixed.LABELS)}))"""
SAMPLED = f"""{TEMPLATES}, {_LEVELS},
sampled AS (SELECT event_id, t.risk, template, low, high, adds, reps FROM events, levels v JOIN templates t
  ON t.risk = v.risk WHERE t.idx = event_id % v.n)"""
ADJUSTED = f"""{SAMPLED}, {PLAIN_DICT},
kinds AS (SELECT t.risk, idx, choice, low, high, [template, template || adds[choice + 1], reps[choice + 1]] AS forms
  FROM templates t JOIN levels v ON t.risk = v.risk, unnest(range(len(adds))) AS c(choice)),
forms AS (SELECT risk, idx, choice, low, high, form, forms[form] AS t FROM kinds, unnest([1, 2, 3]) AS f(form)),
form_scores AS (SELECT risk, idx, choice, form, any_value(low) AS low, any_value(high) AS high, any_value(t) AS t,
  coalesce(sum(weight), 0)::BIGINT AS score FROM forms LEFT JOIN dict ON contains({_fold("t")}, pattern) GROUP BY ALL),
fitting AS (SELECT *, max(score) FILTER (form = 1) OVER (PARTITION BY risk, idx, choice) AS own FROM form_scores),
outcomes AS (SELECT risk, idx, choice, arg_max(t, form) AS final_query, arg_max(score, form) AS score FROM fitting
  WHERE form = 1 OR form = 2 AND own < low AND score BETWEEN low AND high
    OR form = 3 AND own > high AND score BETWEEN low AND high GROUP BY risk, idx, choice),
places AS (SELECT event_id, risk, event_id % n AS idx, event_id % len(adds) AS choice FROM events, levels),
adjusted AS (SELECT event_id, risk, final_query, score FROM places JOIN outcomes USING (risk, idx, choice))"""

_LABEL_LIST = "[" + ", ".join(map(_s, fixed.LABELS)) + "]"
TIMINGS = f"""raw AS (SELECT event_id, user_id, floor(value * 1000)::BIGINT AS ms FROM events),
lines AS (SELECT event_id AS nr, CASE WHEN event_id % 53 = 0 THEN '' WHEN event_id % 59 = 0 THEN {_s(HEADER)}
  ELSE CASE WHEN event_id % 2 = 0 THEN 'distinct' ELSE 'occurrences' END || ',' ||
    ((user_id * 37 + event_id) % 9991 + 10)::VARCHAR || ',72,' || (ms // 1000)::VARCHAR || '.' ||
    lpad((ms % 1000)::VARCHAR, 3, '0') || ',' || {_LABEL_LIST}[event_id % 4 + 1] END AS line FROM raw),
timings AS (SELECT nr, split_part(line, ',', 1) AS algorithm, split_part(line, ',', 2)::INTEGER AS dataset_size,
  split_part(line, ',', 3)::INTEGER AS pattern_count, split_part(line, ',', 4)::DOUBLE AS time_us,
  split_part(line, ',', 5) AS risk FROM lines WHERE line <> '' AND line NOT LIKE 'Algorithm,%')"""


def _axis(axis, nr: str) -> str:
    start, stop, points = axis
    return f"({start}::DOUBLE + {nr} * {(stop - start) / (points - 1)!r}::DOUBLE)"


NEAREST = f"""grid AS (SELECT s, {_axis(fixed.GRID_SIZES, "s")} AS dataset_size FROM range({fixed.GRID_SIZES[2]}) AS t(s)),
nearest AS (SELECT algorithm, s, any_value(g.dataset_size) AS dataset_size,
  arg_min(nr, (abs(t.dataset_size - g.dataset_size), nr)) AS nr,
  arg_min(time_us, (abs(t.dataset_size - g.dataset_size), nr)) AS base_us
  FROM timings t, grid g GROUP BY algorithm, s)"""

_AMOUNT = "CASE WHEN x > 0 THEN round(x, 5 - floor(log10(x))::INTEGER) ELSE x END"

ORACLE: dict[str, str] = {
    "scan_query_log": _with(
        LINES,
        """split AS (SELECT qid, list_transform(
  regexp_extract_all(line, '((?:[^",]|"[^"]*(?:"|$))*)(?:,|$)', 1), lambda x: replace(x, '"', '')) AS f
  FROM lines WHERE line <> '')""",
        f"parsed AS (SELECT qid, trim(f[1], {BLANKS}) AS query, trim(f[2], {BLANKS}) AS expected FROM split)",
        select=f"""SELECT qid, query, {_fold("query")} AS normalized, expected FROM parsed
WHERE expected IN ('low', 'medium', 'high', 'critical')""",
    ),
    "scan_log_files": _with(
        LOG,
        select=f"""SELECT expected AS set_risk, length(expected)::VARCHAR AS set_size, expected, count(*) AS n,
  sum(length(trim(replace(query, '"', ''), {BLANKS})))::BIGINT AS characters FROM log GROUP BY ALL""",
    ),
    "scan_query_log_naive": _with(
        LINES,
        select=f"""SELECT qid, split_part(line, ',', 1) AS query, {_fold("split_part(line, ',', 1)")} AS normalized,
  split_part(line, ',', 2) AS expected, split_part(line, ',', 3) AS score FROM lines WHERE line <> ''""",
    ),
    "scan_patterns_quoted": _with(
        QUOTED_FILES,
        """listed AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(value, '"([^"]+)"', 1),
  lambda x: CASE WHEN right(x, 1) = ',' THEN left(x, length(x) - 1) ELSE x END), lambda x: x <> '') AS l FROM files)""",
        select=_NUMBERED,
    ),
    "scan_patterns_lines": _with(
        MIXED_FILES,
        f"""both_forms AS (SELECT conv_id, turn,
  list_filter(list_transform(regexp_extract_all(value, '"([^"]+)"', 1),
    lambda x: CASE WHEN right(x, 1) = ',' THEN left(x, length(x) - 1) ELSE x END), lambda x: x <> '') AS quoted,
  list_transform(list_filter(string_split(value, chr(10)), lambda x: x <> '' AND left(x, 1) <> '#'),
    lambda x: trim(x, {BLANKS})) AS lines FROM files)""",
        """listed AS (SELECT conv_id, turn, CASE WHEN len(quoted) > 0 THEN quoted ELSE list_filter(
  list_transform(lines, lambda x: CASE
    WHEN length(x) >= 3 AND left(x, 1) = '"' AND right(x, 2) = '",' THEN x[2:-3]
    WHEN length(x) >= 2 AND left(x, 1) = '"' AND right(x, 1) = '"' THEN x[2:-2]
    WHEN right(x, 1) = ',' THEN left(x, length(x) - 1) ELSE x END), lambda x: x <> '') END AS l FROM both_forms)""",
        select=_NUMBERED,
    ),
    "scan_patterns_strict": _with(
        QUOTED_FILES,
        """listed AS (SELECT conv_id, turn, list_transform(list_filter(
  list_transform(string_split(value, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))),
  lambda x: regexp_matches(x, '^"(?s:.*)",$') OR x = '",'), lambda x: substring(x, 2, greatest(length(x) - 3, 0))) AS l
  FROM files)""",
        select=_NUMBERED,
    ),
    "scan_weighted_patterns": """WITH listed AS (SELECT conv_id, turn,
  string_split('# ' || role || chr(10) || chr(10) || replace(text, ' ', ',10' || chr(10)), chr(10)) AS l
  FROM conversations),
lines AS (SELECT conv_id, turn, (i - 1)::INTEGER AS nr, regexp_replace(l[i], '\\r$', '') AS line
  FROM listed, unnest(range(1, len(l) + 1)) AS t(i))
SELECT conv_id, turn, nr, regexp_extract(line, '^(.*),(\\d+)$', 1, 's') AS pattern,
  regexp_extract(line, '^(.*),(\\d+)$', 2, 's')::INTEGER AS weight
FROM lines WHERE regexp_matches(line, '^.*,\\d+$', 's')""",
    "scan_run_reports": _with(
        RUNS,
        f"""cells AS (SELECT algorithm, dataset, {_CELLS} FROM runs GROUP BY algorithm, dataset)""",
        select=f"""SELECT algorithm, dataset, total AS loaded, total, correct,
  (SELECT {_AMOUNT} FROM (SELECT accuracy AS x)) AS accuracy, zero_scores FROM cells""",
    ),
    "scan_benchmark_table": _with(TIMINGS, select="SELECT * FROM timings"),
    "write_run_report": _with(
        RUNS,
        select=f"SELECT algorithm, dataset, expected, {_CELLS} FROM runs GROUP BY ALL",
    ),
    "write_dataset": _with(
        ADJUSTED,
        select=f"""SELECT trim(replace(final_query, '"', ''), {BLANKS}) AS query, risk AS expected, count(*) AS n
FROM adjusted GROUP BY ALL""",
    ),
    "scan_numbered_log": """SELECT event_type AS dataset, 4 * count(*) AS queries, 4 * count(*) AS last_numbers, TRUE AS unbroken
FROM events GROUP BY event_type""",
    "write_patterns": _with(PARTS, select="SELECT pattern, count(*) AS n FROM dict GROUP BY pattern"),
    "normalize_query": f"SELECT doc_id, {_fold('text')} AS normalized FROM documents",
    "trim_fields": f"SELECT doc_id, trim(text, {BLANKS}) AS trimmed FROM documents",
    "strip_outer_quotes": """WITH wrapped AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '"' || text || '"'
  WHEN 1 THEN '"' || text ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) >= 2 AND left(t, 1) = '"' AND right(t, 1) = '"' THEN t[2:-2] ELSE t END AS bare
FROM wrapped""",
    "classify_risk_v1": _with(
        *_DOC_SCORES, select=f"SELECT id AS doc_id, score, {_risk('score')} AS computed FROM scores"
    ),
    "classify_risk_v2": _with(
        *_DOC_SCORES,
        select=f"SELECT id AS doc_id, score, {_risk('score', fixed.THRESHOLDS_V2)} AS computed FROM scores",
    ),
    "weight_patterns_tiered": _with(
        LOG_DICT,
        RULES,
        select="""SELECT pid, any_value(pattern) AS pattern, coalesce(arg_min(weight, tier), 1)::BIGINT AS weight
FROM patterns LEFT JOIN rules ON contains(pattern, needle) GROUP BY pid""",
    ),
    "weight_patterns_simple": _with(
        LOG_DICT,
        select="""SELECT pid, pattern, (CASE WHEN contains(pattern, 'drop table') OR contains(pattern, '; drop') THEN 100
  WHEN contains(pattern, '; delete') OR contains(pattern, '; insert') THEN 15 ELSE 10 END)::BIGINT AS weight
FROM patterns""",
    ),
    "weight_lookup": _with(
        LOG_DICT,
        RULES,
        select="""SELECT pid, pattern, coalesce(weight, 0)::BIGINT AS weight FROM patterns
LEFT JOIN rules ON pattern = needle""",
    ),
    "expected_score": _with(
        LOG,
        LOOSE,
        select="""SELECT qid, label, CASE label WHEN 'low' THEN 10 WHEN 'medium' THEN 40 WHEN 'high' THEN 70
  WHEN 'critical' THEN 100 END AS score FROM loose""",
    ),
    "obfuscate_query": _with(
        LOG,
        select="""SELECT qid, CASE WHEN qid % 4 IN (1, 3) THEN replace(query, ' ', '/**/') ELSE query END ||
  CASE WHEN qid % 4 IN (2, 3) THEN ' /* test */' ELSE '' END AS variation FROM log""",
    ),
    "match_flag": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="""SELECT qid, score, computed, expected,
  CASE WHEN computed = expected THEN '[OK]' ELSE '[Mismatch]' END AS flag FROM assessed""",
    ),
    "filter_valid_labels": _with(
        LOG,
        LOOSE,
        select="SELECT qid, query, label FROM loose WHERE label IN ('low', 'medium', 'high', 'critical')",
    ),
    "filter_blank_lines": """SELECT doc_id, len(list_filter(string_split(text, chr(10)),
  lambda x: x <> '' AND left(x, 1) <> '#'))::BIGINT AS kept_lines FROM documents""",
    "filter_zero_score": _with(
        TEXTS,
        DICT,
        _HITS,
        select="SELECT id AS doc_id FROM texts WHERE id NOT IN (SELECT id FROM hits)",
    ),
    "filter_mismatch": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="SELECT qid, score, computed, expected FROM assessed WHERE computed <> expected",
    ),
    "dictionary_trie_stats": _with(
        PARTS,
        TRIE,
        select="SELECT patterns, nodes, transitions, transitions / nodes::DOUBLE AS transitions_per_node FROM trie",
    ),
    "dictionary_implications": _with(
        PARTS,
        "firsts AS (SELECT pattern, min(pid) AS pid FROM dict GROUP BY pattern)",
        select="""SELECT a.pid, b.pid AS implied_pid FROM firsts a JOIN firsts b
ON contains(a.pattern, b.pattern) AND a.pid <> b.pid""",
    ),
    "dictionary_direct_implications": _with(
        PARTS,
        CHAINS,
        select="SELECT pid, implied_pid FROM chains GROUP BY pid, implied_pid HAVING max(steps) = 1",
    ),
    "dictionary_implication_order": _with(
        PARTS,
        CHAINS,
        "longest AS (SELECT pid, implied_pid, max(steps) AS steps FROM chains GROUP BY pid, implied_pid)",
        select="""SELECT pid, coalesce(max(steps), 0)::BIGINT AS depth, count(*) FILTER (steps = 1) AS n_direct,
  count(steps) AS n_implied, pid NOT IN (SELECT implied_pid FROM longest) AS is_root
FROM firsts LEFT JOIN longest USING (pid) WHERE pattern <> '' GROUP BY pid""",
    ),
    "dictionary_duplicates": _with(
        PARTS,
        select="""SELECT pattern, min(pid) AS first_pid, max(pid) AS last_pid, count(*) AS copies
FROM dict GROUP BY pattern HAVING count(*) > 1""",
    ),
    "dictionary_limits": _with(
        PARTS,
        TRIE,
        select=f"""SELECT patterns, nodes, nodes <= {fixed.MAX_NODES} AS nodes_fit,
  patterns <= {fixed.MAX_PATTERNS} AS patterns_fit FROM trie""",
    ),
    "dictionary_preview": _with(
        PARTS,
        select="""SELECT (row_number() OVER (ORDER BY pid))::INTEGER AS line, pattern AS shown
FROM (SELECT * FROM dict ORDER BY pid LIMIT 10)
UNION ALL SELECT 11, '... and ' || (count(*) - 10)::VARCHAR || ' more patterns' FROM dict HAVING count(*) > 10""",
    ),
    "weight_distribution": _with(
        LOG_DICT,
        RULES,
        """weighted AS (SELECT pid, coalesce(arg_min(weight, tier), 1)::BIGINT AS weight
FROM patterns LEFT JOIN rules ON contains(pattern, needle) GROUP BY pid)""",
        select="SELECT weight, count(*) AS patterns FROM weighted GROUP BY weight",
    ),
    "score_distinct": _with(*_DOC_SCORES, select="SELECT id AS doc_id, score FROM scores"),
    "score_occurrences": _with(
        TEXTS, DICT, _HITS, OCC, OCC_SCORES, select="SELECT id AS doc_id, score FROM occ_scores"
    ),
    "score_occurrences_first_id": _with(
        TEXTS,
        SIMPLE_DICT,
        FIRST_DICT,
        _FIRST_HITS,
        OCC,
        OCC_SCORES,
        select=f"SELECT id AS doc_id, score, {_risk('score', fixed.THRESHOLDS_V2)} AS computed FROM occ_scores",
    ),
    "pattern_hits": _with(TEXTS, DICT, _HITS, OCC, select="SELECT id AS doc_id, pid, n AS hits FROM counts"),
    "matched_patterns": _with(
        TEXTS,
        PLAIN_DICT,
        _HITS,
        DISTINCT_SCORES,
        """lists AS (SELECT id, string_agg(pattern || '(' || weight::VARCHAR || ')', ', ' ORDER BY pid) AS matched
  FROM hits GROUP BY id)""",
        select="""SELECT s.id AS doc_id, score, coalesce(matched, '') AS matched FROM scores s LEFT JOIN lists l
ON s.id = l.id""",
    ),
    "match_positions": _with(
        TEXTS,
        DICT,
        _HITS,
        OCC,
        select="SELECT id AS doc_id, pid, pos AS start_pos, pos + length(pattern) - 1 AS end_pos FROM occ",
    ),
    "detect_any": _with(
        DICT,
        select=f"""SELECT page_id FROM pages
WHERE EXISTS (SELECT 1 FROM dict WHERE contains({_fold("html")}, pattern))""",
    ),
    "score_large_dictionary": _with(
        TEXTS,
        f"""words AS (SELECT DISTINCT unnest(regexp_extract_all({_fold("text")}, '[a-z]+')) AS pattern
  FROM conversations)""",
        "dict AS (SELECT 0 AS pid, pattern, length(pattern) % 5 + 1 AS weight FROM words)",
        _HITS,
        DISTINCT_SCORES,
        select="SELECT id AS doc_id, score FROM scores",
    ),
    "score_all_words": _with(
        TEXTS,
        f"""words AS (SELECT DISTINCT unnest(regexp_extract_all({_fold("text")}, '[a-z]+')) AS pattern
  FROM conversations)""",
        "dict AS (SELECT 0 AS pid, pattern, length(pattern) % 5 + 1 AS weight FROM words)",
        _HITS,
        DISTINCT_SCORES,
        select="SELECT id AS doc_id, score FROM scores",
    ),
    "accuracy": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="""SELECT count(*) AS total, count(*) FILTER (computed = expected) AS correct,
  100.0::DOUBLE * count(*) FILTER (computed = expected) / count(*) AS accuracy FROM assessed""",
    ),
    "zero_score_share": _with(
        *_DOC_SCORES,
        select="""SELECT count(*) AS total, count(*) FILTER (score = 0) AS zero_scores,
  100.0::DOUBLE * count(*) FILTER (score = 0) / count(*) AS zero_share FROM scores""",
    ),
    "score_stats": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="""SELECT expected, min(score) AS min_score, max(score) AS max_score, avg(score) AS avg_score
FROM assessed GROUP BY expected""",
    ),
    "accuracy_matrix": _with(
        RUNS,
        select=f"""SELECT CASE WHEN grouping(algorithm) = 1 THEN '(all)' ELSE algorithm END AS algorithm,
  CASE WHEN grouping(expected) = 1 THEN '(all)' ELSE expected END AS expected,
  CASE WHEN grouping(dataset) = 1 THEN '(all)' ELSE dataset END AS dataset, {_CELLS}
FROM runs GROUP BY ROLLUP (algorithm, expected, dataset)""",
    ),
    "confusion_matrix": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="SELECT expected, "
        + ", ".join(f"count(*) FILTER (computed = {_s(r)}) AS {r}" for r in fixed.LABELS)
        + " FROM assessed GROUP BY expected",
    ),
    "pattern_frequency": _with(
        TEXTS,
        DICT,
        _HITS,
        OCC,
        select="SELECT pid, sum(n)::BIGINT AS hits, count(*) AS texts FROM counts GROUP BY pid",
    ),
    "algorithm_agreement": _with(
        TEXTS,
        DICT,
        _HITS,
        OCC,
        DISTINCT_SCORES,
        OCC_SCORES,
        select=f"""SELECT a.id AS doc_id, a.score AS distinct_score, b.score AS occurrence_score,
  {_risk("a.score")} AS distinct_risk, {_risk("b.score")} AS occurrence_risk
FROM scores a JOIN occ_scores b ON a.id = b.id WHERE a.score <> b.score""",
    ),
    "throughput": _with(
        TIMINGS,
        select="""SELECT nr, algorithm, dataset_size, time_us,
  dataset_size / nullif(time_us / 1e6::DOUBLE, 0) AS queries_per_second FROM timings""",
    ),
    "preview_queries": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="""SELECT qid, query, norm AS normalized, score, computed, expected,
  CASE WHEN computed = expected THEN '[OK]' ELSE '[Mismatch]' END AS flag FROM assessed ORDER BY qid LIMIT 10""",
    ),
    "preview_generated": _with(
        ADJUSTED,
        "numbered AS (SELECT *, row_number() OVER (PARTITION BY risk ORDER BY event_id) AS rank FROM adjusted)",
        f"""lists AS (SELECT event_id, risk, string_agg(pattern || '(' || weight::VARCHAR || ')', ', ' ORDER BY pid) AS matched
  FROM numbered JOIN dict ON contains({_fold("final_query")}, pattern) WHERE rank <= 3 GROUP BY event_id, risk)""",
        select="""SELECT n.risk, rank::INTEGER AS rank, n.event_id, final_query AS query, score,
  coalesce(matched, '') AS matched FROM numbered n LEFT JOIN lists l ON n.event_id = l.event_id AND n.risk = l.risk
WHERE rank <= 3""",
    ),
    "template_catalog": _with(
        TEMPLATES,
        select=f"""SELECT tid, risk, idx, template, count(event_id) AS used FROM templates
LEFT JOIN events ON tid = event_id % {_N} GROUP BY tid, risk, idx, template""",
    ),
    "sample_templates": _with(SAMPLED, select="SELECT event_id, risk, template FROM sampled"),
    "adjust_to_target": _with(ADJUSTED, select="SELECT event_id, risk, final_query, score FROM adjusted"),
    "generate_dataset": _with(ADJUSTED, select="SELECT event_id, risk, final_query AS query, score FROM adjusted"),
    "generate_matrix": _with(
        ADJUSTED.replace("FROM events,", "FROM row_numbers,").replace("SELECT event_id, t.risk", "SELECT DISTINCT event_id, t.risk"),
        select="""SELECT event_type AS dataset, risk, count(*) AS queries, sum(score)::BIGINT AS score_sum
FROM typed JOIN adjusted USING (event_id) GROUP BY ALL""",
    ).replace(
        "WITH RECURSIVE ",
        """WITH RECURSIVE typed AS (SELECT event_type, row_number() OVER (PARTITION BY event_type) - 1 AS event_id FROM events),
row_numbers AS (SELECT DISTINCT event_id FROM typed),
""",
    ),
    "dataset_store_matrix": _with(
        *_LOG_SCORES,
        ASSESSED,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY expected ORDER BY md5(qid::VARCHAR)) AS nr FROM assessed)",
        f"""members AS (SELECT expected AS set_risk, set_size,
  CASE WHEN expected = 'critical' AND set_size = 100 THEN 'high' ELSE expected END AS expected, computed, score
  FROM ranked, unnest({fixed.MATRIX_SIZES}) AS t(set_size) WHERE nr <= set_size)""",
        *[
            f"""{name} AS (SELECT {dims}, count(*) AS total, count(*) FILTER (computed = expected) AS correct,
  100.0::DOUBLE * count(*) FILTER (computed = expected) / count(*) AS accuracy, count(*) FILTER (score = 0) AS zero_scores,
  min(score)::BIGINT AS min_score, max(score)::BIGINT AS max_score, sum(score)::DOUBLE / count(*) AS avg_score FROM members {group})"""
            for name, dims, group in (
                ("cells", "set_risk, set_size::VARCHAR AS set_size", "GROUP BY ALL"),
                ("whole", "'(all)' AS set_risk, '(all)' AS set_size", ""),
            )
        ],
        select="SELECT * FROM cells UNION ALL SELECT * FROM whole",
    ),
    "generate_variations": _with(
        LOG,
        select="""SELECT qid, expected AS risk, variant::INTEGER AS variant, CASE WHEN variant IN (1, 3)
  THEN replace(query, ' ', '/**/') ELSE query END || CASE WHEN variant IN (2, 3) THEN ' /* test */' ELSE '' END AS variation,
  CASE expected WHEN 'low' THEN 10 WHEN 'medium' THEN 40 WHEN 'high' THEN 70 ELSE 100 END AS score
FROM log, range(4) AS t(variant)""",
    ),
    "inject_payloads": _with(INJECTED, select="SELECT doc_id, text FROM injected"),
    "benchmark_by_algorithm": _with(
        TIMINGS,
        """cells AS (SELECT risk, dataset_size, arg_min(time_us, nr) FILTER (algorithm = 'distinct') AS "distinct",
  arg_min(time_us, nr) FILTER (algorithm = 'occurrences') AS occurrences FROM timings GROUP BY risk, dataset_size)""",
        select="""SELECT *, "distinct" / nullif(occurrences, 0) AS ratio FROM cells""",
    ),
    "parameter_grid": _with(
        TIMINGS,
        select=f"""SELECT algorithm, risk, timings, p::INTEGER AS p, s::INTEGER AS s,
  {_axis(fixed.GRID_PATTERNS, "p")} AS pattern_count, {_axis(fixed.GRID_SIZES, "s")} AS dataset_size
FROM (SELECT algorithm, risk, count(*) AS timings FROM timings GROUP BY ALL),
  range({fixed.GRID_PATTERNS[2]}) AS a(p), range({fixed.GRID_SIZES[2]}) AS b(s)""",
    ),
    "nearest_measurement": _with(
        TIMINGS,
        NEAREST,
        select="SELECT algorithm, s::INTEGER AS s, dataset_size, nr, base_us FROM nearest",
    ),
    "modelled_time": _with(
        TIMINGS,
        NEAREST,
        select=f"""SELECT algorithm, p::INTEGER AS p, s::INTEGER AS s, round(greatest(30.0::DOUBLE, base_us +
  ({_axis(fixed.GRID_PATTERNS, "p")} - 72) * 0.5::DOUBLE + log10(greatest(1.0::DOUBLE, dataset_size)) * 2.0::DOUBLE), 6)
  AS time_us FROM nearest, range({fixed.GRID_PATTERNS[2]}) AS a(p)""",
    ),
    "stream_score": _with(
        *_DOC_SCORES, select=f"SELECT id AS doc_id, score, {_risk('score')} AS computed FROM scores"
    ),
    "stream_risk_windows": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, computed, count(*) AS n
FROM assessed GROUP BY ALL""",
    ),
    "stream_final_windows": _with(
        *_LOG_SCORES,
        ASSESSED,
        select="""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, computed, count(*) AS n
FROM assessed GROUP BY ALL""",
    ),
    "stream_distinct_rows": """SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
  count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL""",
    "stream_versioned_score": _with(
        *_LOG_SCORES,
        "middle AS (SELECT (epoch(min(ts))::BIGINT + epoch(max(ts))::BIGINT) / 2.0 AS mid FROM events)",
        f"""assessed AS (SELECT ts, s AS score, {_risk("s")} AS computed FROM (
  SELECT ts, CASE WHEN epoch_us(ts) / 1000000.0 >= mid THEN 2 * score ELSE score END AS s
  FROM log JOIN scores ON qid = id, middle))""",
        select="""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, computed, count(*) AS n,
  sum(score)::BIGINT AS score FROM assessed GROUP BY ALL""",
    ),
}
