from pyspark.sql import functions as F

from helpers import brute_distinct
from needlework import fixed
from needlework.operators import corpus
from needlework.tables import literal_table

ENTRIES = [(0, n, w) for w, needles in fixed.WEIGHT_TIERS for n in needles]


def _adjust(query, risk, key):
    low, high = fixed.TARGET_RANGES[risk]
    score = brute_distinct(query.lower(), ENTRIES)
    changed = None
    if score < low:
        changed = query + fixed.ADDITIONS[risk][key % len(fixed.ADDITIONS[risk])]
    elif score > high:
        changed = fixed.REPLACEMENTS[risk][key % len(fixed.REPLACEMENTS[risk])]
    if changed is not None and low <= brute_distinct(changed.lower(), ENTRIES) <= high:
        return changed, brute_distinct(changed.lower(), ENTRIES)
    return query, score


def test_catalog(spark):
    rows = corpus.template_catalog(spark).orderBy("tid").collect()
    assert [r.template for r in rows] == [t for r in fixed.LABELS for t in fixed.TEMPLATES[r]]
    assert {r: len(t) for r, t in fixed.TEMPLATES.items()} == {"low": 13, "medium": 12, "high": 15, "critical": 14}


def test_every_outcome_of_the_adjustment(spark):
    keys = spark.range(360).withColumnRenamed("id", "key")
    sampled = corpus.sample_templates(keys, "key")
    rows = corpus.adjust_to_target(sampled, "key").collect()
    assert len(rows) == 4 * 360
    for r in rows:
        assert (r.final_query, r.score) == _adjust(r.template, r.risk, r.key), r
    made = corpus.generate_dataset(keys, "key").collect()
    assert sorted((r.key, r.risk, r.query, r.score) for r in made) == sorted(
        (r.key, r.risk, r.final_query, r.score) for r in rows
    )


def test_matrix_sizes(spark, monkeypatch):
    monkeypatch.setattr(corpus, "ROWS_PER_TASK_ROW", 7)
    sizes = literal_table(
        spark, [{"dataset": str(n), "size": n} for n in [0, 1, 7, 8, 100]], "dataset:string,size:bigint"
    )
    made = corpus.generate_matrix(sizes)
    counts = made.groupBy("dataset", "risk").agg(F.count("*").alias("n"), F.count_distinct("row").alias("d")).collect()
    assert {(r.dataset, r.risk): (r.n, r.d) for r in counts} == {
        (str(n), risk): (n, n) for n in [1, 7, 8, 100] for risk in fixed.LABELS
    }


def test_variations(spark):
    base = literal_table(
        spark, [{"query": q, "risk": "high"} for q in fixed.VARIATION_SEEDS["high"]], "query:string,risk:string"
    )
    rows = corpus.generate_variations(base).collect()
    assert len(rows) == 20 and {r.score for r in rows} == {70}
    assert {r.variation for r in rows if r.variant == 0} == set(fixed.VARIATION_SEEDS["high"])
    assert all("/**/" in r.variation and " SELECT" not in r.variation for r in rows if r.variant == 1)


def test_payloads(spark):
    docs = spark.range(6).select(F.col("id").alias("k"), F.lit("text").alias("t"))
    rows = corpus.inject_payloads(docs, "k", "t", ["a", "b\nc"], 3).orderBy("k").collect()
    assert [r.t for r in rows] == ["text a", "text b\nc", "text"] * 2
